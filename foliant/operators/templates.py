"""Many templates over one corpus: rules keyed by template, the best template of each document, and all rule checks as
two passes over its matches.

Rule tables have a template_id and the columns of a template's rules; where there is only one template the column may
be missing everywhere. Joins are equi-joins on template, semantic, role and table flag; what else a rule asks for is a
filter on the joined row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from foliant.functions import text as tx
from foliant.sources.shared import written

from .classify import _decimal, _placed, _position_holds, exact_mean

ISSUE = ("doc_id", "error_code", "semantic_key", "paragraph_ids")
ROLES = ("heading", "title", "subtitle", "list_item", "table_text", "body", "header", "footer", "footnote", "endnote", "unknown")


def of_template(df: DataFrame) -> DataFrame:
    return df if "template_id" in df.columns else df.withColumn("template_id", F.lit(""))


def expanded(rules: DataFrame) -> DataFrame:
    """Rules with a row for every role and table flag that they accept (role_key, table_key): what can be joined by equality."""
    role = F.when(F.col("role").isNull(), F.array(*map(F.lit, ROLES))).otherwise(F.array("role"))
    flag = F.when(F.col("in_table").isNull(), F.array(F.lit(True), F.lit(False))).otherwise(F.array("in_table"))
    return rules.withColumn("role_key", F.explode(role)).withColumn("table_key", F.explode(flag)).drop("role", "in_table")


BATCH_DOCS = 1024
FACTS = ("role", "in_table", "has_image", "blank", "heading_level", "near_top", "is_first", "is_first_text")


def paragraph_facts(context: DataFrame, *more: str | Column) -> DataFrame:
    """What rules ask of a paragraph: (doc_id, paragraph_id, FACTS), and more columns made of its own.

    A text goes to its document's other paragraphs only if one of more holds it.
    """
    blank = (F.trim("text") == "").alias("blank")
    c = _placed(context.select("doc_id", "paragraph_id", "paragraph_index", blank, "role", "in_table", "has_image", "heading_level", *more))
    near = F.col("paragraph_index") < F.greatest(F.lit(2), F.floor(F.col("n") * 0.2))
    first_text = F.coalesce(F.col("paragraph_index") == F.col("first_text"), F.lit(True))
    c = c.withColumn("near_top", near).withColumn("is_first", F.col("paragraph_index") == 0).withColumn("is_first_text", first_text)
    return c.drop("paragraph_index", "n", "first_text")


def accepts() -> Column:
    """Whether a rule takes the paragraph beside it, role and table flag apart."""
    place = F.when(F.col("position_hint") == "near_top", F.col("near_top")).when(F.col("position_hint") == "first_paragraph", F.col("is_first")).when(F.col("position_hint") == "first_non_blank", F.col("is_first_text")).otherwise(True)
    level = F.col("want_level").isNull() | F.coalesce(F.col("want_level") == F.col("heading_level"), F.lit(False))
    return (~F.col("require_image") | F.col("has_image")) & (F.col("allow_empty") | ~F.col("blank")) & level & place


def best_templates(context: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, template_id, n_covered, n_missing): for each document the template that accepts most of its paragraphs,
    then the one that lacks fewest required semantics, then the first by id. A document that none fits has no row.

    Paragraphs that rules can't tell apart are of one kind; a corpus has few kinds (thousands at most), so which rules
    accept a kind is found once for all documents. A document is one row of counts by kind, and batches of documents
    meet all templates in matrix products: no row for a document and template is ever moved.
    """
    kinds = paragraph_facts(context).groupBy("doc_id", *FACTS).agg(F.count("*").alias("n")).withColumn("kind", F.xxhash64(*FACTS))
    docs = written(kinds.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "n", *FACTS)).alias("kinds")))
    r = expanded(rules.select("template_id", "semantic_key", "required", "role", "in_table", "require_image", "allow_empty", F.col("heading_level").alias("want_level"), "position_hint"))
    few = docs.select(F.explode("kinds").alias("x")).select("x.kind", *[f"x.{f}" for f in FACTS]).distinct()
    fit = few.join(F.broadcast(r), (F.col("role") == F.col("role_key")) & (F.col("in_table") == F.col("table_key"))).filter(accepts())
    fits = fit.select("kind", "template_id", "semantic_key", F.coalesce("required", F.lit(False))).distinct().collect()  # kinds times rules
    needs = rules.groupBy("template_id").agg(F.countDistinct(F.when(F.col("required"), F.col("semantic_key"))).alias("n"))
    need = {x["template_id"]: x["n"] for x in needs.collect() if x["template_id"] is not None}
    best = _best_by_counts(fits, need, to_arrow_type(rules.schema["template_id"].dataType))
    types = {f.name: f.dataType.simpleString() for f in rules.schema.fields + docs.schema.fields}
    flat = docs.select("doc_id", F.transform("kinds", lambda x: F.struct(x["kind"].alias("kind"), x["n"].alias("n"))).alias("kinds"))
    return flat.mapInArrow(best, f"doc_id {types['doc_id']}, template_id {types['template_id']}, n_covered long, n_missing long")


def _best_by_counts(fits: list, need: dict, template_type: pa.DataType):
    """A worker that gives rows (doc_id, kinds: kind and count) their best template.

    fits: (kind, template, semantic, required), what accepts what; need: how many semantics each template requires.
    """
    templates = sorted(need)
    place = {t: i for i, t in enumerate(templates)}
    known = np.array(sorted({k for k, *_ in fits}), np.int64)
    wanted = sorted({(place[t], s) for _, t, s, required in fits if t in place and required})
    at = {w: i for i, w in enumerate(wanted)}
    covers, meets = np.zeros((len(known), len(templates))), np.zeros((len(known), len(wanted)))
    for k, t, s, required in fits:
        if t in place:
            row = np.searchsorted(known, k)
            covers[row, place[t]] = 1
            if required:
                meets[row, at[place[t], s]] = 1
    owner = np.zeros((len(wanted), len(templates)))
    owner[np.arange(len(wanted)), [t for t, _ in wanted]] = 1
    asked = np.array([need[t] for t in templates], np.float64)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows if len(known) else 0, BATCH_DOCS):
                b = whole.slice(start, BATCH_DOCS)
                flat = b.column(1).flatten()
                kind, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                doc = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy(zero_copy_only=False))
                col = np.minimum(np.searchsorted(known, kind), len(known) - 1)
                ok = known[col] == kind
                counts = np.zeros((b.num_rows, len(known)))
                counts[doc[ok], col[ok]] = n[ok]
                covered = counts @ covers
                missing = asked - (((counts > 0) @ meets) > 0) @ owner
                most = covered.max(axis=1)
                chosen = np.where(covered == most[:, None], missing, np.inf).argmin(axis=1)  # the first of equals
                kept = np.flatnonzero(most > 0)
                ids = pa.array([templates[i] for i in chosen[kept]], template_type)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(kept)), ids, pa.array(most[kept].astype(np.int64)), pa.array(missing[kept, chosen[kept]].astype(np.int64))], ["doc_id", "template_id", "n_covered", "n_missing"]
                )

    return best


def classify_by_templates(context: DataFrame, rules: DataFrame, chosen: DataFrame) -> DataFrame:
    """(template_id, doc_id, paragraph_id, semantic_key, confidence): each paragraph by the rules of its document's template,
    the first semantic by rank that accepts it, one whose hint its text holds first."""
    mine = paragraph_facts(context, F.lower("text").alias("low")).join(chosen.select("doc_id", "template_id"), "doc_id")
    r = expanded(rules.select("template_id", "semantic_key", "rank", "hint", "role", "in_table", "require_image", "allow_empty", F.col("heading_level").alias("want_level"), "position_hint"))
    fit = mine.join(F.broadcast(r.withColumnRenamed("role_key", "role").withColumnRenamed("table_key", "in_table")), ["template_id", "role", "in_table"]).filter(accepts())
    hit = (F.col("hint") != "") & F.col("low").contains(F.lower("hint"))
    # The comparison is done before rows are sorted by paragraph, so none of them carries its text there.
    fit = fit.select("template_id", "doc_id", "paragraph_id", "semantic_key", "rank", hit.alias("hit"))
    hit = F.col("hit")
    best = fit.groupBy("template_id", "doc_id", "paragraph_id").agg(F.min_by("semantic_key", F.struct(~hit, "rank")).alias("semantic_key"), F.max(hit).alias("by_hint"))
    return best.select("template_id", "doc_id", "paragraph_id", "semantic_key", F.when(F.col("by_hint"), 0.9).otherwise(0.6).alias("confidence"))


def _issue(cond: Column, code: str | Column, key: Column | None = None, ids: Column | None = None) -> Column:
    text = F.lit(code) if isinstance(code, str) else code
    key = F.lit(None).cast("string") if key is None else key
    return F.when(cond, F.struct(text.alias("error_code"), key.alias("semantic_key"), (F.lit("") if ids is None else ids).alias("paragraph_ids")))


def rule_issues(docs: DataFrame, matched: DataFrame, context: DataFrame, rules: DataFrame, least: float = 0.8, everywhere: tuple[str, ...] = ()) -> DataFrame:
    """All issues that rules alone decide, (doc_id, error_code, semantic_key, paragraph_ids); with several templates also template_id.

    docs: (doc_id[, template_id]); a document is held against its own template. Every match meets its paragraph and its
    rule once, and what is wrong with it is one array; the counts of a document's semantics are one row, held against
    the array of its template's rules, so presence, counts, hints, order and placement are read off that row.
    """
    many = "template_id" in rules.columns
    docs, matched, rules = of_template(docs), of_template(matched), of_template(rules)
    keys = ["template_id", "doc_id"]
    blank = (F.trim("text") == "").alias("blank")
    facts = _placed(context.select("doc_id", "paragraph_id", "paragraph_index", blank, F.col("role").alias("own_role"), "bucket", F.col("in_table").alias("own_table"), "has_image", F.col("heading_level").alias("own_level"), "list_level"))
    facts = facts.drop("blank").withColumnRenamed("paragraph_index", "own_index")
    r = rules.select(
        "template_id", "semantic_key", "rank", "negative", "hint", "position_hint", "numbering", "forbidden", F.col("role").alias("want_role"), F.col("in_table").alias("want_table"),
        "require_image", "allow_empty", F.col("heading_level").alias("want_level"),
    )
    also = matched.groupBy("template_id", "doc_id", "paragraph_id").agg(F.collect_list(F.struct("semantic_key", "paragraph_index", "confidence", "role", "text")).alias("own"))
    rows = also.withColumn("every", F.col("own.semantic_key")).join(facts, ["doc_id", "paragraph_id"])
    rows = rows.withColumn("x", F.explode("own")).select("*", "x.*").drop("own", "x").join(r, ["template_id", "semantic_key"])
    blank = F.trim("text") == ""
    shape = F.array(
        "own_role", "bucket", F.when(F.col("own_role") == "heading", F.concat(F.lit("heading_level_"), F.col("own_level").cast("string"))),
        F.when(F.col("own_role") == "list_item", F.concat(F.lit("list_item_level_"), F.col("list_level").cast("string"))),
    )
    style = (
        F.when(F.col("allow_empty") & ~F.col("require_image") & (blank | (F.col("bucket") == "unknown")), None)
        .when(F.col("require_image") & ~F.col("has_image"), "style_require_image").when(~F.col("allow_empty") & ~F.col("require_image") & blank, "style_empty")
        .when(F.col("want_role") != F.col("role"), "style_role").when(F.col("want_table") != F.col("own_table"), "style_in_table")
        .when(F.col("want_level").isNotNull() & ~F.col("want_level").eqNullSafe(F.col("own_level")), "style_heading_level")
    )
    forbids = F.col("forbidden").isNotNull() & (F.col("forbidden") != F.col("semantic_key"))
    forbids = forbids & (F.array_contains("every", F.col("forbidden")) | F.coalesce(F.array_contains(shape, F.col("forbidden")), F.lit(False)))
    patterns = [p["numbering"] for p in rules.select("numbering").distinct().collect()]  # the templates' own few rows
    allowed = F.lit(False)
    for p in patterns:
        wanted = [p] if p else list(everywhere)
        allowed = allowed | (F.col("numbering").eqNullSafe(F.lit(p)) & (tx.pattern_match("prefix", wanted) if wanted else F.lit(True)))
    numbering = F.col("prefix").isNotNull() & ~allowed & ~((F.col("role") == "heading") & F.col("want_level").isNotNull())
    # A generator keeps the prefix, a long expression, from being written out again in every condition on it.
    rows = rows.withColumn("prefix", F.explode(F.array(tx.numbering_prefix("text"))))
    placed = rows.withColumnRenamed("paragraph_index", "match_index").withColumnRenamed("own_index", "paragraph_index")
    codes = F.array_compact(F.array(
        F.when((F.col("negative") != "") & tx.contains_text("text", "negative"), "negative_example_matched"), F.when(~_position_holds("position_hint"), "position_hint_violation"),
        F.when(numbering, F.when(F.col("role") == "body", "numbering_pattern_warning").otherwise("numbering_pattern_not_allowed")), style, F.when(forbids, "forbidden_semantic_matched"),
    ))
    hit = F.when(F.col("hint") != "", tx.contains_text("text", "hint"))
    rows = written(placed.select(*keys, "semantic_key", "paragraph_id", F.col("match_index").alias("paragraph_index"), "confidence", "rank", hit.alias("hit"), codes.alias("codes")))
    own = rows.select(*keys, F.explode("codes").alias("error_code"), "semantic_key", F.col("paragraph_id").alias("paragraph_ids"))

    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_index", "paragraph_id"))), lambda x: x["paragraph_id"]), "|")
    per = rows.groupBy(*keys, "semantic_key", "rank").agg(
        ids.alias("ids"), F.countDistinct("paragraph_id").alias("n"), F.min("paragraph_index").alias("first"), F.max("paragraph_index").alias("last"),
        exact_mean(F.sum(_decimal("confidence")), F.count("confidence")).alias("confidence"), F.max("hit").alias("hit"),
    )
    whole = per.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "semantic_key", "ids", "n", "first", "last", "confidence", "hit"))).alias("per"),
        exact_mean(F.sum(_decimal("confidence") * F.col("n")), F.sum("n")).alias("overall"),
    )
    asked = F.struct("semantic_key", "required", "multiple", "min_occurs", "max_occurs", "placement", "other", "hint")
    whole = docs.select(*keys).join(whole, keys, "left").join(rules.groupBy("template_id").agg(F.collect_list(asked).alias("rules")), "template_id")

    def against(rule: Column) -> Column:
        names = F.transform("per", lambda p: p["semantic_key"])
        at = lambda key: F.coalesce(F.array_position(names, key), F.lit(0)).cast("int")
        place = at(rule["semantic_key"])
        m, before, o = F.get("per", place - 1), F.get("per", place - 2), F.get("per", at(rule["other"]) - 1)
        n, key, found = F.coalesce(m["n"], F.lit(0)), rule["semantic_key"], F.coalesce(m["ids"], F.lit(""))
        kind = rule["placement"]
        ok = (
            F.when(kind == "before", m["last"] < o["first"]).when(kind == "after", m["first"] > o["last"])
            .when(kind == "immediately_before", m["last"] + 1 == o["first"]).when(kind == "immediately_after", m["first"] - 1 == o["last"])
        )
        return F.array_compact(F.array(
            _issue(rule["required"] & m.isNull(), "required_semantic_missing", key), _issue(~rule["multiple"] & (n > 1), "single_instance_semantic_has_multiple_matches", key, found),
            _issue(n < rule["min_occurs"], "occurrence_below_min", key, found), _issue(n > rule["max_occurs"], "occurrence_above_max", key, found),
            _issue(m["confidence"] < least, "semantic_confidence_too_low", key, found), _issue(m.isNotNull() & (rule["hint"] != "") & ~m["hit"], "text_hint_missing", key, found),
            _issue(m.isNotNull() & o.isNotNull() & ~ok, "placement_rule_violation", key, found), _issue((place > 1) & (m["first"] < before["first"]), "semantic_order_violation", key, found),
        ))

    low = F.array_compact(F.array(_issue(F.col("overall") < least, "overall_confidence_too_low")))
    all_of = whole.select(*keys, F.explode(F.concat(F.flatten(F.transform("rules", against)), low)).alias("x")).select(*keys, "x.*")
    return own.unionByName(all_of).select(*(["template_id"] if many else []), *ISSUE)
