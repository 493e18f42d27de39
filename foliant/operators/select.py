"""Selection, target analysis and binding: filters, semi joins and anti joins on (doc_id, id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAIN_PART = "word/document.xml"
SINGLE_TARGET = ("merge_paragraph", "split_paragraph")
PARAGRAPH_ATTRIBUTES = ("paragraph_alignment", "line_spacing", "space_before_pt", "space_after_pt", "first_line_indent_pt")


def select_targets(paragraphs: DataFrame, nodes: DataFrame, scope: str, level: int | None = None) -> DataFrame:
    """Nodes of the paragraphs of a scope: body, heading (of a level) or list_item."""
    wanted = paragraphs.filter(F.col("role") == scope)
    if scope == "heading" and level is not None:
        wanted = wanted.filter(F.col("heading_level") == level)
    return nodes.join(wanted.select("doc_id", "paragraph_id"), ["doc_id", "paragraph_id"], "left_semi").select("doc_id", "paragraph_id", "run_id")


def select_all_text(nodes: DataFrame) -> DataFrame:
    return nodes.select("doc_id", F.lit(None).cast("string").alias("paragraph_id"), "run_id")


def select_ids(table: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Requested ids in request order, each once, with whether they exist. requests: (doc_id, place, key)."""
    once = requests.groupBy("doc_id", key).agg(F.min("place").alias("place"))
    known = table.select("doc_id", key).distinct().withColumn("found", F.lit(True))
    return once.join(known, ["doc_id", key], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def node_owners(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested nodes with their paragraph; a missing node has none."""
    return select_ids(nodes, requests, "run_id").join(nodes.select("doc_id", "run_id", "paragraph_id"), ["doc_id", "run_id"], "left")


def select_patch_targets(requests: DataFrame) -> DataFrame:
    return requests.filter(F.length("part_path") > 0).select("doc_id", "target_id", "part_path").distinct()


def writable_split(matched: DataFrame, nodes: DataFrame) -> DataFrame:
    """Matched paragraphs with whether a run of theirs can be written, and why not."""
    can = nodes.select("doc_id", "paragraph_id").distinct().withColumn("writable", F.lit(True))
    out = matched.join(can, ["doc_id", "paragraph_id"], "left").withColumn("writable", F.coalesce("writable", F.lit(False)))
    return out.withColumn("skip_reason", F.when(~F.col("writable"), "no_writable_runs"))


def target_status(intents: DataFrame) -> DataFrame:
    """The first error of an intent. intents: counts of requested, missing, matched and writable targets, and, for
    intents on patch targets, n_patch_targets (else null), which alone decides there."""
    patches = F.col("n_patch_targets") if "n_patch_targets" in intents.columns else F.lit(None).cast("long")
    return intents.withColumn(
        "error",
        F.when(F.col("op_type") == "set_page_layout", None)
        .when(patches == 0, "E_PATCH_TARGETS_EMPTY").when(patches > 0, None)
        .when(F.col("n_missing_paragraphs") > 0, "E_PARAGRAPH_TARGETS_MISSING").when(F.col("n_missing_nodes") > 0, "E_NODE_TARGETS_MISSING")
        .when((F.col("n_matched") > 0) & (F.col("n_writable") == 0), "E_SELECTOR_TARGETS_EMPTY").when(F.col("n_matched") == 0, "E_SELECTOR_NO_MATCH"),
    )


def part_paths(targets: DataFrame, paragraphs: DataFrame) -> DataFrame:
    joined = targets.join(paragraphs.select("doc_id", "paragraph_id", "part_path"), ["doc_id", "paragraph_id"], "left")
    return joined.select("doc_id", F.coalesce("part_path", F.lit(MAIN_PART)).alias("part_path")).distinct()


def bind_intents(intents: DataFrame, targets: DataFrame) -> DataFrame:
    """One operation with all its targets, or one for each target (suffix __n) for merging and splitting.

    A bound operation lists the targets of one document; its size is bounded by the document.
    """
    joined = intents.join(targets, ["doc_id", "scope"])
    single = F.col("op_type").isin(*SINGLE_TARGET)
    order = Window.partitionBy("doc_id", "op_id").orderBy("paragraph_index", "run_index")
    placed = joined.withColumn("n", F.when(single, F.row_number().over(order)).otherwise(0))
    rows = F.array_sort(F.collect_list(F.struct("paragraph_index", "run_index", "run_id")))
    bound = placed.groupBy("doc_id", "op_id", "op_type", "n").agg(F.transform(rows, lambda x: x["run_id"]).alias("target_ids"))
    name = F.when(F.col("n") > 0, F.concat_ws("__", "op_id", F.col("n").cast("string"))).otherwise(F.col("op_id"))
    return bound.select("doc_id", name.alias("op_id"), "op_type", "target_ids")


def operation_to_intent(ops: DataFrame) -> DataFrame:
    """How an operation names its targets: selector before patch targets before nodes."""
    kind = F.when(F.col("scope").isNotNull(), "selector").when(F.size("patch_target_ids") > 0, "patch_targets").when(F.size("node_ids") > 0, "node_ids").otherwise("none")
    return ops.withColumn("target_kind", kind)


def expand_plan(steps: DataFrame, bound: DataFrame) -> DataFrame:
    """Selector steps become their bound steps; where there are several, step and idempotency key get a number."""
    joined = steps.join(bound, ["doc_id", "op_id"])
    whole, order = Window.partitionBy("doc_id", "step_id"), Window.partitionBy("doc_id", "step_id").orderBy("bound_seq")
    many, n = F.count("*").over(whole) > 1, F.row_number().over(order).cast("string")
    numbered = lambda c: F.when(F.col("_many"), F.concat_ws("__", c, "_n")).otherwise(F.col(c))
    out = joined.withColumn("_many", many).withColumn("_n", n)
    return out.withColumn("step_id", numbered("step_id")).withColumn("idempotency_key", numbered("idempotency_key")).drop("_many", "_n")


def patch_target_index(observed: DataFrame, paragraphs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Observed targets, and made-up block and inline targets for what has none."""
    made = paragraphs.select("doc_id", F.concat(F.lit("target:block:"), "paragraph_id").alias("target_id"), F.lit("block").alias("kind"))
    made = made.unionByName(nodes.select("doc_id", F.concat(F.lit("target:inline:"), "run_id").alias("target_id"), F.lit("inline").alias("kind")))
    extra = made.join(observed, ["doc_id", "target_id"], "left_anti").withColumn("observed", F.lit(False))
    return observed.select("doc_id", "target_id", "kind").withColumn("observed", F.lit(True)).unionByName(extra)


def coerce_to_block(targets: DataFrame) -> DataFrame:
    """Paragraph attributes move from a run's target to its paragraph's; of equal (target, attribute) the last wins."""
    moved = F.when(F.col("attribute").isin(*PARAGRAPH_ATTRIBUTES), F.concat(F.lit("target:block:"), "paragraph_id")).otherwise(F.concat(F.lit("target:inline:"), "run_id"))
    return targets.withColumn("target_id", moved).groupBy("doc_id", "target_id", "attribute").agg(F.max_by("value", "seq").alias("value"))


def synthetic_targets(ids: DataFrame) -> DataFrame:
    """Part and key of style, default, numbering-level and settings targets by their id."""
    t = F.col("target_id")
    part = F.when(t.startswith("target:style:"), "word/styles.xml").when(t == "target:docDefaults", "word/styles.xml").when(t.startswith("target:numbering:"), "word/numbering.xml").when(t.startswith("target:settings:"), "word/settings.xml")
    return ids.select("doc_id", "target_id", part.alias("part_path"), F.nullif(F.regexp_extract(t, "^target:[a-zA-Z]+:(.*)$", 1), F.lit("")).alias("key")).filter("part_path IS NOT NULL")


def locate_node_ids(ids: DataFrame, runs: DataFrame) -> DataFrame:
    """Paragraph and run numbers of ids such as p_3_r_1, and whether such a run exists."""
    at = lambda i: F.regexp_extract("run_id", "^p_([0-9]+)_r_([0-9]+)$", i).try_cast("int")
    known = runs.select("doc_id", "run_id").distinct().withColumn("found", F.lit(True))
    return ids.withColumn("p", at(1)).withColumn("r", at(2)).join(known, ["doc_id", "run_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def role_bind_check(selectors: DataFrame, role_counts: DataFrame) -> DataFrame:
    """Selectors with whether their role occurs in the document."""
    joined = selectors.join(role_counts.select("doc_id", F.col("role").alias("scope"), "n"), ["doc_id", "scope"], "left")
    return joined.select("doc_id", "scope", F.col("n").isNotNull().alias("binds"))


def template_targets(blocks: DataFrame, paragraphs: DataFrame, nodes: DataFrame, sections: DataFrame) -> DataFrame:
    """Targets of template blocks by selector scope: paragraph, run, section, style, settings, numbering_level, path.

    blocks: (semantic_key, scope, key), a template's few rows; paragraphs carry the semantic that they match.
    """
    few = F.broadcast(blocks)
    rows = lambda df, scope, target: df.join(few.filter(F.col("scope") == scope), "semantic_key").select("doc_id", "semantic_key", "scope", target.alias("target_id"))
    every = paragraphs.select("doc_id", "semantic_key").distinct()
    run = nodes.join(paragraphs.select("doc_id", "paragraph_id", "semantic_key"), ["doc_id", "paragraph_id"])
    part = sections.join(every, "doc_id")
    out = rows(paragraphs, "paragraph", F.concat(F.lit("target:block:"), "paragraph_id"))
    out = out.unionByName(rows(run, "run", F.concat(F.lit("target:inline:"), "run_id"))).unionByName(rows(part, "section", F.concat(F.lit("target:section:"), F.col("section").cast("string"))))
    for scope, head in (("style", "target:style:"), ("settings", "target:settings:"), ("numbering_level", "target:numbering:"), ("path", "")):
        out = out.unionByName(rows(every, scope, F.concat(F.lit(head), "key")))
    return out.distinct()
