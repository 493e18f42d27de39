"""Validation checks: matches and context in, issue rows out. Every check gives (doc_id, error_code, semantic_key, paragraph_ids).

A template's rules come as a small table; the matched-paragraph table is built once and shared by the checks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.sources.shared import written

from .classify import _decimal, exact_mean
from .templates import rule_issues

ISSUE = ("doc_id", "error_code", "semantic_key", "paragraph_ids")
_CHECKS: dict[str, Callable[..., DataFrame]] = {}


def register_check(name: str, check: Callable[..., DataFrame]) -> None:
    """Add a user's check: (matched, context, rules) -> issue rows, united with the others by run_checks."""
    _CHECKS[name] = check


def run_checks(matched: DataFrame, context: DataFrame, rules: DataFrame, checks: dict | None = None) -> DataFrame:
    """The union of all checks. Matches and context are written once; each check reads the columns it needs."""
    matched, context, out = written(matched), written(context), None
    for check in (checks if checks is not None else _CHECKS).values():
        part = check(matched, context, rules).select(*ISSUE)
        out = part if out is None else out.unionByName(part)
    return out


def _ids(order: str = "paragraph_index") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "paragraph_id"))), lambda x: x["paragraph_id"]), "|")


def issue(df: DataFrame, code: str, semantic: Column | None = None, ids: Column | None = None) -> DataFrame:
    key = F.col("semantic_key") if semantic is None else semantic
    return df.select("doc_id", F.lit(code).alias("error_code"), key.alias("semantic_key"), (F.lit("") if ids is None else ids).alias("paragraph_ids"))


def per_semantic(matched: DataFrame) -> DataFrame:
    return matched.groupBy("doc_id", "semantic_key").agg(_ids().alias("ids"), F.countDistinct("paragraph_id").alias("n"), F.min("paragraph_index").alias("first"), F.max("paragraph_index").alias("last"),
        exact_mean(F.sum(_decimal("confidence")), F.count("confidence")).alias("confidence"))


def check_confidence(matched, context, rules, least: float = 0.8) -> DataFrame:
    """Semantics and documents whose mean confidence is under the minimum."""
    per = per_semantic(matched)
    whole = per.groupBy("doc_id").agg(exact_mean(F.sum(_decimal("confidence") * F.col("n")), F.sum("n")).alias("overall"))
    return issue(per.filter(F.col("confidence") < least), "semantic_confidence_too_low", ids=F.col("ids")).unionByName(issue(whole.filter(F.col("overall") < least), "overall_confidence_too_low", F.lit(None).cast("string")))


def _each_rule(context: DataFrame, rules: DataFrame) -> DataFrame:
    """Documents x a template's rules: the rules are a bounded broadcast."""
    return context.select("doc_id").distinct().withColumn("_t", F.lit(1)).join(F.broadcast(rules.withColumn("_t", F.lit(1))), "_t").drop("_t")


def check_required(matched, context, rules) -> DataFrame:
    need = _each_rule(context, rules.filter("required").select("semantic_key"))
    return issue(need.join(matched.select("doc_id", "semantic_key").distinct(), ["doc_id", "semantic_key"], "left_anti"), "required_semantic_missing")


def check_single(matched, context, rules) -> DataFrame:
    single = rules.filter("NOT multiple").select("semantic_key")
    return issue(per_semantic(matched).join(F.broadcast(single), "semantic_key").filter("n > 1"), "single_instance_semantic_has_multiple_matches", ids=F.col("ids"))


def check_occurrence(matched, context, rules) -> DataFrame:
    want = _each_rule(context, rules.select("semantic_key", "min_occurs", "max_occurs")).join(per_semantic(matched).select("doc_id", "semantic_key", "n", "ids"), ["doc_id", "semantic_key"], "left")
    n = F.coalesce("n", F.lit(0))
    low = issue(want.filter(n < F.col("min_occurs")), "occurrence_below_min", ids=F.coalesce("ids", F.lit("")))
    return low.unionByName(issue(want.filter(n > F.col("max_occurs")), "occurrence_above_max", ids=F.coalesce("ids", F.lit(""))))


def check_negative(matched, context, rules) -> DataFrame:
    """A matched paragraph that holds the semantic's negative example."""
    bad = rules.filter("negative <> ''").select("semantic_key", "negative")
    hit = matched.join(F.broadcast(bad), "semantic_key").filter(tx.contains_text("text", "negative"))
    return issue(hit, "negative_example_matched", ids=F.col("paragraph_id"))


def check_text_hints(matched, context, rules) -> DataFrame:
    """A matched semantic none of whose paragraphs holds its hint."""
    hints = rules.filter("hint <> ''").select("semantic_key", "hint")
    per = matched.join(F.broadcast(hints), "semantic_key").groupBy("doc_id", "semantic_key").agg(F.max(tx.contains_text("text", "hint")).alias("any"), _ids().alias("ids"))
    return issue(per.filter("NOT any"), "text_hint_missing", ids=F.col("ids"))


def check_position(matched, context, rules) -> DataFrame:
    from .classify import position_ok

    ok = position_ok(context, rules).select("doc_id", "paragraph_id", "semantic_key")
    return issue(matched.join(ok, ["doc_id", "paragraph_id", "semantic_key"], "left_anti"), "position_hint_violation", ids=F.col("paragraph_id"))


def check_numbering(matched, context, rules, everywhere: tuple[str, ...] = ()) -> DataFrame:
    """A numbering prefix that matches none of the semantic's patterns (or, without any, the global ones; without
    these either, all are allowed). Body paragraphs only warn; headings whose rule asks for a level are left out."""
    known = [tuple(r) for r in rules.select("semantic_key", "numbering", "heading_level").collect()]  # a template's rules
    levelled = [key for key, _, level in known if level is not None]
    found = matched.filter(~((F.col("role") == "heading") & F.col("semantic_key").isin(levelled)))
    # A generator keeps the prefix, a long expression, from being written out again in every condition on it.
    found = found.withColumn("prefix", F.explode(F.array(tx.numbering_prefix("text")))).filter("prefix IS NOT NULL")
    allowed = F.lit(False)
    for key, pattern, _ in known:
        patterns = [pattern] if pattern else list(everywhere)
        mine = F.col("semantic_key") == key
        allowed = allowed | (mine & (tx.pattern_match("prefix", patterns) if patterns else F.lit(True)))
    code = F.when(F.col("role") == "body", "numbering_pattern_warning").otherwise("numbering_pattern_not_allowed")
    return found.filter(~allowed).select("doc_id", code.alias("error_code"), "semantic_key", F.col("paragraph_id").alias("paragraph_ids"))


def check_placement(matched, context, rules) -> DataFrame:
    """before / after / immediately before / immediately after another semantic, by first and last index."""
    per = per_semantic(matched)
    want = rules.filter("placement IS NOT NULL").select("semantic_key", "placement", "other")
    other = per.select("doc_id", F.col("semantic_key").alias("other"), F.col("first").alias("o_first"), F.col("last").alias("o_last"))
    both = per.join(F.broadcast(want), "semantic_key").join(other, ["doc_id", "other"])
    ok = (
        F.when(F.col("placement") == "before", F.col("last") < F.col("o_first")).when(F.col("placement") == "after", F.col("first") > F.col("o_last"))
        .when(F.col("placement") == "immediately_before", F.col("last") + 1 == F.col("o_first")).when(F.col("placement") == "immediately_after", F.col("first") - 1 == F.col("o_last"))
    )
    return issue(both.filter(~ok), "placement_rule_violation", ids=F.col("ids"))


def check_conflicts(conflicts: DataFrame, reject: bool = True) -> DataFrame:
    """One issue per conflicting paragraph, unless the policy lets conflicts pass."""
    return issue(conflicts.filter(F.lit(reject)).select("doc_id", "paragraph_id").distinct(), "classification_conflict", F.lit(None).cast("string"), F.col("paragraph_id"))


def check_unmatched(unmatched: DataFrame, reject: bool = True, allowed: bool = False) -> DataFrame:
    """Unmatched paragraphs where the policy rejects them and the template's global rule does not allow them."""
    return issue(unmatched.filter(F.lit(reject and not allowed)), "unclassified_paragraph", F.lit(None).cast("string"), F.col("paragraph_id"))


def check_ordering(matched, context, rules) -> DataFrame:
    """A semantic that begins before the previous present one of the template's order."""
    per = per_semantic(matched).join(F.broadcast(rules.select("semantic_key", "rank")), "semantic_key")
    before = F.lag("first").over(Window.partitionBy("doc_id").orderBy("rank"))
    return issue(per.withColumn("before", before).filter("first < before"), "semantic_order_violation", ids=F.col("ids"))


def check_style(matched, context, rules) -> DataFrame:
    """The first failing structural hint of each matched paragraph, in fixed order."""
    r = rules.select("semantic_key", F.col("role").alias("want_role"), F.col("in_table").alias("want_table"), F.col("require_image").alias("want_image"), F.col("allow_empty").alias("may_be_empty"),
        F.col("heading_level").alias("want_level"))
    blank = F.trim("text") == ""
    c = matched.join(context.select("doc_id", "paragraph_id", "has_image", "bucket", "in_table", "heading_level"), ["doc_id", "paragraph_id"]).join(F.broadcast(r), "semantic_key")
    code = (
        F.when(F.col("may_be_empty") & ~F.col("want_image") & (blank | (F.col("bucket") == "unknown")), None)
        .when(F.col("want_image") & ~F.col("has_image"), "style_require_image").when(~F.col("may_be_empty") & ~F.col("want_image") & blank, "style_empty")
        .when(F.col("want_role") != F.col("role"), "style_role").when(F.col("want_table") != F.col("in_table"), "style_in_table")
        .when(F.col("want_level").isNotNull() & ~F.col("want_level").eqNullSafe(F.col("heading_level")), "style_heading_level")
    )
    return c.withColumn("error_code", code).filter("error_code IS NOT NULL").select("doc_id", "error_code", "semantic_key", F.col("paragraph_id").alias("paragraph_ids"))


def check_forbidden(matched, context, rules) -> DataFrame:
    """A paragraph that its semantic forbids: one also matched by the named semantic, or of the named structure.

    A structure is a role, a bucket, heading_level_n or list_item_level_n.
    """
    bad = rules.filter("forbidden IS NOT NULL AND forbidden <> semantic_key").select("semantic_key", F.col("forbidden").alias("other"))
    also = matched.select("doc_id", "paragraph_id", F.col("semantic_key").alias("other")).distinct().withColumn("also", F.lit(True))
    shape = context.select("doc_id", "paragraph_id", F.array(
        "role", "bucket", F.when(F.col("role") == "heading", F.concat(F.lit("heading_level_"), F.col("heading_level").cast("string"))),
        F.when(F.col("role") == "list_item", F.concat(F.lit("list_item_level_"), F.col("list_level").cast("string"))),
    ).alias("shape"))
    hit = matched.drop("role").join(F.broadcast(bad), "semantic_key").join(also, ["doc_id", "paragraph_id", "other"], "left").join(shape, ["doc_id", "paragraph_id"], "left")
    hit = hit.filter(F.coalesce("also", F.lit(False)) | F.coalesce(F.array_contains("shape", F.col("other")), F.lit(False)))
    return issue(hit, "forbidden_semantic_matched", ids=F.col("paragraph_id"))


def check_seal(template: DataFrame, evidence: DataFrame) -> DataFrame:
    """A template whose text speaks of a seal needs a document with image evidence. template: one row, text."""
    wants = template.filter(F.col("text").rlike("(?i)(seal|stamp|印章|公章)")).withColumn("_t", F.lit(1))
    none = evidence.filter("n_images = 0").withColumn("_t", F.lit(1)).join(F.broadcast(wants.select("_t")), "_t")
    return issue(none, "seal_evidence_missing", F.lit(None).cast("string"))


def validation_gate(docs: DataFrame, issues: DataFrame, enforce: bool) -> DataFrame:
    """Per document the number of issues that count, and whether it passes; without enforcement nothing counts."""
    n = issues.groupBy("doc_id").agg(F.count("*").alias("n_issues"))
    out = docs.select("doc_id").join(n, "doc_id", "left").withColumn("n_issues", F.coalesce("n_issues", F.lit(0)) if enforce else F.lit(0).cast("long"))
    return out.withColumn("passed", F.col("n_issues") == 0)


STANDARD = {
    "confidence": check_confidence, "required": check_required, "single": check_single, "occurrence": check_occurrence, "negative": check_negative, "text_hints": check_text_hints,
    "position": check_position, "numbering": check_numbering, "placement": check_placement, "ordering": check_ordering, "style": check_style, "forbidden": check_forbidden,
}


@dataclass(frozen=True)
class Policy:
    """What a template enforces."""

    enforce: bool = True
    reject_conflicts: bool = True
    reject_unmatched: bool = True
    allow_unclassified: bool = False


def validate(
    docs: DataFrame, matched: DataFrame, context: DataFrame, rules: DataFrame, conflicts: DataFrame, unmatched: DataFrame,
    template: DataFrame, evidence: DataFrame, policy: Policy = Policy(),
) -> tuple[DataFrame, DataFrame]:
    """All issues of the standard checks (templates.rule_issues, two passes over the matches) and the registered ones, of
    conflicts, unmatched paragraphs and seals; and the gate.

    Numbering warnings on body paragraphs are issues of their own code that don't close the gate.
    """
    issues = rule_issues(docs, matched, context, rules)
    if _CHECKS:
        issues = issues.unionByName(run_checks(matched, context, rules))
    for part in (check_conflicts(conflicts, policy.reject_conflicts), check_unmatched(unmatched, policy.reject_unmatched, policy.allow_unclassified), check_seal(template, evidence)):
        issues = issues.unionByName(part)
    return issues, validation_gate(docs, issues.filter("error_code <> 'numbering_pattern_warning'"), policy.enforce)


SUPPORTED_VERSIONS = ("1.0", "2.0")
SCOPES = ("paragraph", "run", "document")


def contract_issues(semantics: DataFrame, derived: DataFrame, blocks: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Quality rules of many templates: blank keys and labels, repeated keys, dangling references, one block per
    semantic, ranges, scopes outside the enumeration, and, with templates, blank ids and unknown versions.

    semantics: (template_id, key, label, min_occurs, max_occurs); derived: (template_id, key, parent); blocks:
    (template_id, key[, scope]); templates: (template_id, version).
    """
    row = lambda df, code: df.select("template_id", F.lit(code).alias("error_code"), "key")
    blank = row(semantics.filter("trim(label) = '' OR label IS NULL"), "label_required")
    keyless = row(semantics.filter("trim(key) = '' OR key IS NULL"), "key_required")
    twice = row(semantics.groupBy("template_id", "key").agg(F.count("*").alias("n")).filter("n > 1"), "duplicate_key")
    lost = row(derived.join(semantics.select("template_id", F.col("key").alias("parent")), ["template_id", "parent"], "left_anti"), "dangling_reference")
    count = blocks.groupBy("template_id", "key").agg(F.count("*").alias("n"))
    per = semantics.select("template_id", "key").distinct().join(count, ["template_id", "key"], "left")
    one = row(per.filter("coalesce(n, 0) <> 1"), "operation_block_count")
    span = row(semantics.filter("min_occurs > max_occurs OR min_occurs < 0"), "occurrence_range")
    out = blank.unionByName(keyless).unionByName(twice).unionByName(lost).unionByName(one).unionByName(span)
    if "scope" in blocks.columns:
        out = out.unionByName(row(blocks.filter(~F.coalesce(F.col("scope").isin(*SCOPES), F.lit(False))), "scope_unknown"))
    if templates is not None:
        known = F.coalesce(F.col("version").isin(*SUPPORTED_VERSIONS), F.lit(False))
        out = out.unionByName(row(templates.filter(~known).withColumn("key", F.col("version")), "version_unsupported"))
    return out
