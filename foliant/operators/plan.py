"""Plan building from matches and patch blocks, plan checks and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as tx


# Scopes of blocks that stand for a document, with or without paragraphs.
DOCUMENT_SCOPES = ("section", "style", "numbering_level", "settings_node")


def claim_steps(derived: DataFrame) -> DataFrame:
    """(template_id, steps): for every derived semantic, in declared order, the semantics that it takes paragraphs from.

    derived: (template_id, seq, key, mode, parents). All take from their parents; a refined one also takes from the
    aggregates that share a parent with it, wherever these are declared.
    """
    each = derived.select("template_id", "seq", "key", "mode", F.explode("parents").alias("parent"))
    refined, aggregate = each.filter("mode = 'refine'"), each.filter("mode <> 'refine'").select("template_id", "parent", F.col("key").alias("target"))
    siblings = refined.join(aggregate, ["template_id", "parent"]).select("template_id", "seq", "key", "target")
    claims = each.select("template_id", "seq", "key", F.col("parent").alias("target")).unionByName(siblings).filter("target <> key")
    steps = claims.groupBy("template_id", "seq", "key").agg(F.collect_set("target").alias("targets"))
    return steps.groupBy("template_id").agg(F.array_sort(F.collect_list(F.struct("seq", "key", "targets"))).alias("steps"))


def atomic_plan(held: DataFrame, derived: DataFrame, blocks: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, block, paragraph_id): what every block and derived semantic of a plan works on.

    held: (doc_id, paragraph_id, semantic_key), matches and the paragraphs of derived semantics alike; derived as for
    claim_steps; blocks: (template_id, block, scope), those with an operation. All may have a template_id per row, and
    held has none where there is only one template. A derived semantic takes its paragraphs from others, in declared
    order; what an earlier one has taken from it, it no longer takes. Blocks without paragraphs drop out, but one of a
    document-level scope stands once for each of docs, with a null paragraph.

    Claims are resolved inside a paragraph's row, over the few semantics that hold it: one aggregation in all.
    """
    keys = ["doc_id", "paragraph_id"]
    own = held if "template_id" in held.columns else held.withColumn("template_id", F.lit(""))
    rows = own.groupBy("template_id", *keys).agg(F.collect_set("semantic_key").alias("keys")).join(F.broadcast(claim_steps(derived)), "template_id", "left")
    take = lambda left, s: F.when(F.array_contains(left, s["key"]), F.array_except(left, s["targets"])).otherwise(left)
    left = F.when(F.col("steps").isNull(), F.col("keys")).otherwise(F.aggregate("steps", F.col("keys"), take))
    out = rows.select("template_id", *keys, F.explode(left).alias("block")).join(F.broadcast(blocks.select("template_id", "block").distinct()), ["template_id", "block"])
    if docs is not None:
        whole = F.broadcast(blocks.filter(F.col("scope").isin(*DOCUMENT_SCOPES)).select("template_id", "block").distinct())
        own = docs.select("doc_id", "template_id" if "template_id" in docs.columns else F.lit("").alias("template_id")).join(whole, "template_id")
        bare = own.join(out.select("doc_id", "template_id", "block").distinct(), ["doc_id", "template_id", "block"], "left_anti")
        out = out.unionByName(bare.withColumn("paragraph_id", F.lit(None).cast("string")))
    return out.select(*(["template_id"] if "template_id" in held.columns else []), "doc_id", "block", "paragraph_id")


def block_operations(blocks: DataFrame) -> DataFrame:
    """Style groups of a block to operation rows; unset values give none.

    blocks: block, font_name, font_size_pt, space_before_pt, space_after_pt and, if there, first_line_indent_chars; an
    indent keeps the block's font size as the size of its characters.
    """
    one = lambda kind, attribute, hint=F.lit(None): F.struct(F.lit(kind).alias("op"), F.lit(attribute).alias("attribute"), F.col(attribute).cast("string").alias("value"), hint.cast("double").alias("size_hint_pt"))
    rows = [one("set_font", "font_name"), one("set_size", "font_size_pt"), one("set_space_before", "space_before_pt"), one("set_space_after", "space_after_pt")]
    indents = "first_line_indent_chars" in blocks.columns
    rows += [one("set_paragraph_indent", "first_line_indent_chars", F.col("font_size_pt"))] if indents else []
    out = blocks.select("block", F.explode(F.array(*rows)).alias("x")).select("block", "x.*").filter("value IS NOT NULL")
    return out if indents else out.drop("size_hint_pt")


def resolve_selector(plan: DataFrame, matched_ids: DataFrame) -> DataFrame:
    """Selectors without paragraph ids get those of their block."""
    return plan.join(matched_ids, ["doc_id", "block"], "left").withColumn("paragraph_ids", F.coalesce("paragraph_ids", "block_ids")).drop("block_ids")


def write_plan(plan: DataFrame, operations: DataFrame) -> DataFrame:
    """Plan x operation to write items with stable ids; operations are a template's few rows.

    An indent in characters becomes points: characters times the size hint, 12 points without one.
    """
    if "size_hint_pt" in operations.columns:
        chars = F.col("attribute") == "first_line_indent_chars"
        points = F.round(F.col("value").try_cast("double") * F.coalesce("size_hint_pt", F.lit(12.0)), 4).cast("string")
        operations = operations.withColumn("value", F.when(chars, points).otherwise(F.col("value"))).withColumn("attribute", F.when(chars, "first_line_indent_pt").otherwise(F.col("attribute"))).drop("size_hint_pt")
    items = plan.join(F.broadcast(operations), "block")
    return items.withColumn("item_id", F.concat_ws(":", "block", "op", "attribute", "paragraph_id"))


def filter_writable(items: DataFrame, paragraphs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Items with a status: unknown_paragraph, unwritable (dropped later) or ok."""
    known = paragraphs.select("doc_id", "paragraph_id").withColumn("_known", F.lit(True))
    can = nodes.select("doc_id", "paragraph_id").distinct().withColumn("_can", F.lit(True))
    out = items.join(known, ["doc_id", "paragraph_id"], "left").join(can, ["doc_id", "paragraph_id"], "left")
    return out.withColumn("status", F.when(F.col("_known").isNull(), "unknown_paragraph").when(F.col("_can").isNull(), "unwritable").otherwise("ok")).drop("_known", "_can")


# Fields of an older plan format that a plan must not carry.
LEGACY_FIELDS = ("style_name", "numbering_id", "indent_left")


def plan_issues(items: DataFrame, supported: tuple[str, ...], legacy: tuple[str, ...] = LEGACY_FIELDS) -> DataFrame:
    """Items of one id, of a legacy field, without a value to write, and of an operation that can't be compiled."""
    row = lambda df, code: df.select("doc_id", F.lit(code).alias("error_code"), "item_id")
    twice = row(items.groupBy("doc_id", "item_id").agg(F.count("*").alias("n")).filter("n > 1"), "duplicate_operation_id")
    old = row(items.filter(F.col("attribute").isin(*legacy)), "unsupported_legacy_field")
    unmeant = row(items.filter("coalesce(trim(value), '') = ''"), "intent_missing")
    other = row(items.filter(~F.col("op").isin(*supported)), "uncompilable_item")
    return twice.unionByName(old).unionByName(unmeant).unionByName(other)


def executable_plan(items: DataFrame, issues: DataFrame) -> DataFrame:
    """The items of documents without any issue: one issue empties a document's plan."""
    return items.join(issues.select("doc_id").distinct(), "doc_id", "left_anti")


def plan_level_issues(docs: DataFrame, steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Documents without steps and documents without nodes."""
    row = lambda df, code: df.select("doc_id", F.lit(code).alias("error"))
    idle = row(docs.select("doc_id").join(steps.select("doc_id").distinct(), "doc_id", "left_anti"), "E_PLAN_EMPTY")
    return idle.unionByName(row(docs.select("doc_id").join(nodes.select("doc_id").distinct(), "doc_id", "left_anti"), "E_DOCUMENT_EMPTY"))


def plan_validation(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """The first failing rule of each step: operation, target, placeholder, payload, unknown node."""
    known = nodes.select("doc_id", F.col("run_id").alias("target_id")).distinct().withColumn("_known", F.lit(True))
    out = steps.join(known, ["doc_id", "target_id"], "left")
    code = (
        F.when(F.coalesce(F.trim("op_type"), F.lit("")) == "", "E_OPERATION_MISSING").when(F.coalesce(F.trim("target_id"), F.lit("")) == "", "E_TARGET_MISSING")
        .when(tx.is_placeholder("target_id"), "E_TARGET_PLACEHOLDER").when(F.coalesce(F.trim("payload"), F.lit("")) == "", "E_PAYLOAD_EMPTY").when(F.col("_known").isNull(), "E_TARGET_UNKNOWN")
    )
    return out.withColumn("error", code).drop("_known")


def modified_paragraphs(patches: DataFrame, runs: DataFrame) -> DataFrame:
    key = F.regexp_extract("target_id", "^target:[a-z]+:(.*)$", 1)
    block = patches.filter(F.col("target_id").startswith("target:block:")).select("doc_id", key.alias("paragraph_id"))
    inline = patches.filter(F.col("target_id").startswith("target:inline:")).select("doc_id", key.alias("run_id")).join(runs.select("doc_id", "run_id", "paragraph_id"), ["doc_id", "run_id"]).select("doc_id", "paragraph_id")
    return block.unionByName(inline).distinct()


def numbering_warnings(modified: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Modified body paragraphs that still start with a numbering prefix."""
    hit = modified.join(paragraphs.filter("role = 'body'").select("doc_id", "paragraph_id", "text"), ["doc_id", "paragraph_id"]).withColumn("prefix", tx.numbering_prefix("text")).filter("prefix IS NOT NULL")
    return hit.select("doc_id", F.lit("body_numbering_prefix").alias("code"), "paragraph_id", "prefix").distinct()


def execution_artifacts(items: DataFrame) -> DataFrame:
    """Distinct blocks, patch sets (operations), targets and parts, items, executed items and skipped paragraphs."""
    parts = [F.countDistinct("part_path").alias("n_parts")] if "part_path" in items.columns else []
    return items.groupBy("doc_id").agg(
        F.countDistinct("block").alias("n_blocks"), F.countDistinct("block", "op").alias("n_patch_sets"), F.countDistinct("paragraph_id").alias("n_targets"), *parts, F.count("*").alias("n_items"),
        F.count_if(F.col("status") == "ok").alias("n_executed"), F.countDistinct(F.when(F.col("status") == "unwritable", F.col("paragraph_id"))).alias("n_skipped"),
    )


def run_report(docs: DataFrame, gate: DataFrame, planned: DataFrame, failed: DataFrame) -> DataFrame:
    """Status of each document's run: where it failed first, else executed."""
    out = docs.select("doc_id").join(gate.select("doc_id", "passed"), "doc_id", "left")
    out = out.join(planned.select("doc_id").distinct().withColumn("_issue", F.lit(True)), "doc_id", "left").join(failed.select("doc_id").distinct().withColumn("_fail", F.lit(True)), "doc_id", "left")
    status = F.when(~F.coalesce("passed", F.lit(True)), "failed_validation").when(F.col("_issue"), "failed_planning").when(F.col("_fail"), "failed_execution").otherwise("executed")
    return out.select("doc_id", status.alias("status"))


STAGES = ("observation", "classification", "refinement", "validation", "execution")


def stage_timings(events: DataFrame) -> DataFrame:
    """Duration of each stage per run; classification without refinement, never under 0. events: run_id, stage, ms."""
    wide = events.groupBy("run_id").agg(*[F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("ms"))), F.lit(0.0)).alias(s) for s in STAGES])
    return wide.withColumn("classification", F.greatest(F.lit(0.0), F.col("classification") - F.col("refinement")))


def refinement_summary(refined: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Refined paragraphs, or where a document has none its conflicts as rejected_conflict."""
    own = refined.select("doc_id", "paragraph_id", "outcome")
    other = conflicts.select("doc_id", "paragraph_id").distinct().join(own.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("outcome", F.lit("rejected_conflict"))
    both = own.unionByName(other)
    return both.withColumn("line", F.format_string("%s: %s", "paragraph_id", "outcome"))


def first_issue(validation: DataFrame, execution: DataFrame) -> DataFrame:
    """The first issue of a document, validation before execution. Rows: doc_id, seq, error_code."""
    both = validation.select("doc_id", F.lit(0).alias("source"), "seq", "error_code").unionByName(execution.select("doc_id", F.lit(1).alias("source"), "seq", "error_code"))
    order = Window.partitionBy("doc_id").orderBy("source", "seq", "error_code")
    return both.withColumn("n", F.row_number().over(order)).filter("n = 1").select("doc_id", "source", "error_code")
