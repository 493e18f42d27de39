"""Write operations as folds, joins and re-ranking over run, paragraph and layout tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as tx

ALIGNMENTS = ("left", "right", "center", "both", "justify")


@dataclass(frozen=True)
class OperationSpec:
    """A write operation: the attribute that it sets and its canonical value; null means an invalid payload."""

    name: str
    attribute: str
    value: Callable[[Column], Column]


def _number(rule: str) -> Callable[[Column], Column]:
    return lambda p: tx.first_number(rule, p).cast("string")


def _spacing(p: Column) -> Column:
    """A positive multiple, or a JSON object of mode exact and a positive number of points, as exact:points."""
    points = F.get_json_object(p, "$.pt").try_cast("double")
    exact = (F.get_json_object(p, "$.mode") == "exact") & (points > 0)
    return F.when(p.rlike("^\\s*\\{"), F.when(exact, F.concat(F.lit("exact:"), points.cast("string")))).otherwise(_number("positive")(p))


def _flag(p: Column) -> Column:
    return tx.loose_boolean(p).cast("string")


def _record(p: Column) -> Column:
    """A JSON object with at least one field."""
    return F.when(p.rlike('^\\s*\\{\\s*"'), p)


# The 25 operation types and the attribute each one writes.
SPECS = (
    OperationSpec("set_font", "font_name", tx.first_text),
    OperationSpec("set_size", "font_size_pt", _number("positive")),
    OperationSpec("set_line_spacing", "line_spacing", _spacing),
    OperationSpec("set_alignment", "paragraph_alignment", tx.first_text),
    OperationSpec("set_font_color", "font_color", tx.hex_color),
    OperationSpec("set_bold", "is_bold", _flag),
    OperationSpec("set_italic", "is_italic", _flag),
    OperationSpec("set_underline", "is_underline", _flag),
    OperationSpec("set_strike", "is_strike", _flag),
    OperationSpec("set_all_caps", "is_all_caps", _flag),
    OperationSpec("set_highlight_color", "highlight_color", tx.highlight_color),
    OperationSpec("set_paragraph_spacing", "space_before_pt", _number("non_negative")),
    OperationSpec("set_paragraph_indent", "first_line_indent_pt", _number("non_negative")),
    OperationSpec("set_text", "text", lambda p: F.coalesce(p, F.lit(""))),
    OperationSpec("split_paragraph", "split_offset", lambda p: tx.first_number("integer", p).cast("long").cast("string")),
    OperationSpec("merge_paragraph", "merge", lambda p: F.lit("next")),
    OperationSpec("set_page_layout", "paper_size", tx.paper_size),
    OperationSpec("set_style_definition", "style_definition", _record),
    OperationSpec("set_numbering_level", "numbering_level", _record),
    OperationSpec("set_settings_flag", "settings_flag", _record),
    OperationSpec("set_attr", "attr", tx.first_text),
    OperationSpec("remove_attr", "removed_attr", tx.first_text),
    OperationSpec("remove_node", "removed_node", lambda p: F.coalesce(p, F.lit(""))),
    OperationSpec("ensure_node", "tag", tx.first_text),
    OperationSpec("replace_node_xml", "xml", tx.first_text),
)


def normalize_payload(ops: DataFrame, specs: tuple[OperationSpec, ...] = SPECS) -> DataFrame:
    """(…, type, payload) with attribute, canonical value and error; unknown types are errors too."""
    attribute, value, known = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)
    for spec in specs:
        here = F.col("type") == spec.name
        attribute, value, known = F.when(here, spec.attribute).otherwise(attribute), F.when(here, spec.value(F.col("payload"))).otherwise(value), known | here
    out = ops.withColumn("attribute", attribute).withColumn("value", value)
    error = F.when(~known, F.concat(F.col("type"), F.lit(": unsupported operation"))).when(F.col("value").isNull(), F.concat(F.col("type"), F.lit(": invalid payload")))
    return out.withColumn("error", error)


def canonical_value(attribute: str | Column, value: str | Column) -> Column:
    """The canonical text of a value for its attribute; null where it is invalid."""
    a, v = (F.col(x) if isinstance(x, str) else x for x in (attribute, value))
    return (
        F.when(a == "font_size_pt", tx.first_number("positive", v).cast("string")).when(a.startswith("is_"), _flag(v))
        .when(a == "font_color", tx.hex_color(v)).when(a == "highlight_color", tx.highlight_color(v)).otherwise(tx.first_text(v))
    )


def last_writes(writes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The last set value of each attribute and the operation that set it; map-side partial aggregation."""
    return writes.filter("value IS NOT NULL").groupBy(*keys, "attribute").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def apply_style_ops(runs: DataFrame, writes: DataFrame, attributes: tuple[str, ...], keys: tuple[str, ...] = ("doc_id", "run_id")) -> DataFrame:
    """Fold ordered attribute writes onto runs; what no write sets stays.

    Where writes name their operation (op_type), written_by holds the operation that set each attribute.
    """
    named = "op_type" in writes.columns
    last = F.struct("value", "op_type") if named else F.struct("value")
    folded = writes.filter("value IS NOT NULL").groupBy(*keys).agg(
        *[F.max_by(F.when(F.col("attribute") == a, last), F.when(F.col("attribute") == a, F.col("seq"))).alias(f"_{a}") for a in attributes]
    )
    out = runs.join(folded, list(keys), "left")
    kinds = dict(runs.dtypes)
    if named:
        by = F.filter(F.array(*[F.struct(F.lit(a).alias("key"), F.col(f"_{a}.op_type").alias("value")) for a in attributes]), lambda x: x["value"].isNotNull())
        out = out.withColumn("written_by", F.map_from_entries(by))
    for a in attributes:
        out = out.withColumn(a, F.coalesce(F.col(f"_{a}.value").cast(kinds[a]), F.col(a))).drop(f"_{a}")
    return out


def apply_style_map(runs: DataFrame, styles: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """Styles by node id onto runs; a document with a style for an unknown node keeps its runs and gets an error."""
    unknown = styles.join(runs.select("doc_id", "run_id"), ["doc_id", "run_id"], "left_anti").select("doc_id").distinct().withColumn("failed", F.lit(True))
    new = styles.select("doc_id", "run_id", *[F.col(a).alias(f"_{a}") for a in attributes])
    out = runs.join(new, ["doc_id", "run_id"], "left").join(unknown, "doc_id", "left")
    for a in attributes:
        out = out.withColumn(a, F.when(F.col("failed"), F.col(a)).otherwise(F.coalesce(f"_{a}", a))).drop(f"_{a}")
    return out.withColumn("failed", F.coalesce("failed", F.lit(False)))


def valid_attributes(styles: DataFrame) -> DataFrame:
    """Values that may be written; others become unset."""
    out = styles.withColumn("font_size_pt", F.when(F.col("font_size_pt") > 0, F.col("font_size_pt")))
    out = out.withColumn("space_before_pt", F.when(F.col("space_before_pt") >= 0, F.col("space_before_pt")))
    return out.withColumn("paragraph_alignment", F.when(F.lower("paragraph_alignment").isin(*ALIGNMENTS), F.lower("paragraph_alignment")))


LAYOUT = ("margin_top_cm", "margin_bottom_cm", "margin_left_cm", "margin_right_cm")


def page_layout(docs: DataFrame, ops: DataFrame) -> DataFrame:
    """The last valid paper size and the last positive value of each margin over a document's current layout."""
    ok = F.when(F.col("field") == "paper_size", tx.paper_size("value")).otherwise(tx.first_number("positive", "value").cast("string"))
    valid = ops.withColumn("value", ok).filter("value IS NOT NULL")
    pick = lambda f: F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("seq"))).alias(f"_{f}")
    out = docs.join(valid.groupBy("doc_id").agg(*map(pick, ("paper_size", *LAYOUT))), "doc_id", "left")
    return out.select("doc_id", F.coalesce("_paper_size", "paper_size").alias("paper_size"), *[F.coalesce(F.col(f"_{m}").cast("double"), m).alias(m) for m in LAYOUT])


def merge_paragraphs(paragraphs: DataFrame, ops: DataFrame) -> DataFrame:
    """Each paragraph named in ops takes the text of the one after it, which goes; positions are counted anew.

    A run of named neighbours flows into its first. A named last paragraph gets an error and stays.
    """
    order = Window.partitionBy("doc_id").orderBy("paragraph_index")
    marked = paragraphs.join(ops.select("doc_id", "paragraph_id").distinct().withColumn("named", F.lit(1)), ["doc_id", "paragraph_id"], "left")
    marked = marked.withColumn("named", F.coalesce("named", F.lit(0)))
    starts = F.when(F.coalesce(F.lag("named").over(order), F.lit(0)) == 1, 0).otherwise(1)
    grouped = marked.withColumn("start", starts).withColumn("last", F.lead("paragraph_id").over(order).isNull())
    grouped = grouped.withColumn("paragraph_no", F.sum("start").over(order) - 1)
    rows = F.array_sort(F.collect_list(F.struct("paragraph_index", "paragraph_id", "text")))
    return grouped.groupBy("doc_id", "paragraph_no").agg(
        F.min_by("paragraph_id", "paragraph_index").alias("paragraph_id"), F.array_join(F.transform(rows, lambda x: x["text"]), "").alias("text"),
        F.max(F.when((F.col("named") == 1) & F.col("last"), "E_NO_NEXT_PARAGRAPH")).alias("error"),
    )


def merge_runs(paragraphs: DataFrame, runs: DataFrame, ops: DataFrame) -> DataFrame:
    """The runs of merge_paragraphs: each keeps its text and style, moves to the paragraph it flows into and is numbered anew.

    (doc_id, paragraph_no, run_no, run_id, source_run_id and the other columns of runs).
    """
    order = Window.partitionBy("doc_id").orderBy("paragraph_index")
    marked = paragraphs.select("doc_id", "paragraph_id", "paragraph_index").join(ops.select("doc_id", "paragraph_id").distinct().withColumn("named", F.lit(1)), ["doc_id", "paragraph_id"], "left")
    starts = F.when(F.lag(F.coalesce("named", F.lit(0)), 1, 0).over(order) == 1, 0).otherwise(1)
    placed = marked.withColumn("start", starts).withColumn("paragraph_no", F.sum("start").over(order) - 1).select("doc_id", "paragraph_id", "paragraph_no", F.col("paragraph_index").alias("_place"))
    moved = runs.withColumnRenamed("run_id", "source_run_id").join(placed, ["doc_id", "paragraph_id"])
    run_no = F.row_number().over(Window.partitionBy("doc_id", "paragraph_no").orderBy("_place", "run_index")) - 1
    moved = moved.withColumn("run_no", run_no).drop("_place", "run_index", "paragraph_id", "paragraph_index")
    return moved.withColumn("run_id", F.concat(F.lit("p_"), F.col("paragraph_no").cast("string"), F.lit("_r_"), F.col("run_no").cast("string")))


def split_paragraphs(runs: DataFrame, ops: DataFrame) -> DataFrame:
    """Cut the run of each op at its offset, strictly inside its text; later runs of the paragraph follow the suffix.

    ops: (doc_id, run_id, split_offset), at most one for a paragraph. Paragraphs and runs are numbered anew.
    """
    marked = runs.join(ops.select("doc_id", "run_id", "split_offset"), ["doc_id", "run_id"], "left")
    inside = (F.col("split_offset") > 0) & (F.col("split_offset") < F.length("text"))
    whole = F.array(F.struct(F.lit(0).alias("part"), F.col("text").alias("t")))
    cut = F.array(
        F.struct(F.lit(0).alias("part"), F.substring("text", F.lit(1), F.col("split_offset")).alias("t")),
        F.struct(F.lit(1).alias("part"), F.substring("text", F.col("split_offset") + 1, F.length("text")).alias("t")),
    )
    pieces = marked.withColumn("x", F.explode(F.when(inside, cut).otherwise(whole))).select("doc_id", "paragraph_index", "run_index", "x.part", F.col("x.t").alias("text"))
    order = Window.partitionBy("doc_id").orderBy("paragraph_index", "run_index", "part")
    fresh = F.when((F.col("part") == 1) | F.coalesce(F.lag("paragraph_index").over(order) != F.col("paragraph_index"), F.lit(True)), 1).otherwise(0)
    numbered = pieces.withColumn("fresh", fresh).withColumn("paragraph_no", F.sum("fresh").over(order) - 1)
    run_no = F.row_number().over(Window.partitionBy("doc_id", "paragraph_no").orderBy("run_index", "part")) - 1
    return numbered.withColumn("run_no", run_no).select("doc_id", "paragraph_no", "run_no", "text", F.concat(F.lit("p_"), F.col("paragraph_no").cast("string"), F.lit("_r_"), F.col("run_no").cast("string")).alias("run_id"))


# One stretch of one language, as split_language() says. In front, for speed, a plain word before a blank and blanks before one.
_ZH, _EN = "[\\p{IsHan}]", "[a-zA-Z0-9\\p{IsLatin}\\p{Nd}]"
_PUNCT, _OTHER = "[\\p{P}&&[^\\p{IsHan}\\p{IsLatin}\\p{Nd}]]", "[ \\t\\n[^\\p{IsHan}\\p{IsLatin}\\p{Nd}\\p{P}]]"
_LETTERS = "|".join(f"{_PUNCT}*+{own}++(?:{_PUNCT}++{own}++)*+(?:{_PUNCT}++(?!{other}))?+" for own, other in ((_EN, _ZH), (_ZH, _EN)))
_STRETCH = f"[a-zA-Z0-9]++(?= )| ++(?=[a-zA-Z0-9])|{_LETTERS}|(?:{_OTHER}++|{_PUNCT}++(?!{_ZH}|{_EN}))++"


def split_language(runs: DataFrame) -> DataFrame:
    """Maximal stretches of one language in each run, with ids run__seg_n beside the source run's columns.

    Punctuation takes the language right after its block, else right before it, else stays unknown. One regular
    expression cuts a text into its stretches in one pass that never goes back over a stretch, and a stretch holds the
    letters of one language only, which says what it is. No shuffle, and linear in the text.
    """
    kept = [c for c in runs.columns if c != "text"]
    out = runs.filter("text <> ''").select(*kept, F.posexplode(F.regexp_extract_all("text", F.lit(_STRETCH), F.lit(0))).alias("seg", "text"))
    language = F.when(F.trim("text") == "", "unknown").when(F.col("text").rlike(_EN), "en").when(F.col("text").rlike(_ZH), "zh").otherwise("unknown")
    return out.select(*kept, "seg", language.alias("language"), "text", F.concat_ws("__seg_", "run_id", F.col("seg").cast("string")).alias("segment_id"))


def language_font_ops(plan: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs of exactly the language of a semantic's override, as targets of one font operation. plan: (doc_id, paragraph_id, semantic_key, language, font_name)."""
    spoken = runs.withColumn("language", tx.single_language("text")).filter("language IS NOT NULL").select("doc_id", "paragraph_id", "run_id", "language")
    hits = plan.join(spoken, ["doc_id", "paragraph_id", "language"])
    return hits.groupBy("doc_id", "semantic_key", "language", "font_name").agg(F.array_sort(F.collect_list("run_id")).alias("target_ids"))


def rebuild_runs(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """Desired nodes with the style of their source run; an unknown source is an error."""
    source = runs.select("doc_id", F.col("run_id").alias("source_run_id"), "font_name", "font_size_pt").withColumn("_known", F.lit(True))
    out = nodes.join(source, ["doc_id", "source_run_id"], "left")
    return out.withColumn("error", F.when(F.col("_known").isNull(), "E_SOURCE_RUN_MISSING")).drop("_known")


def compile_patches(ops: DataFrame, targets: DataFrame) -> DataFrame:
    """Operation x target x attribute to patch rows with ids op:patch:n. ops: attributes MAP<STRING,STRING>."""
    rows = ops.select("doc_id", "op_id", "scope", F.explode("attributes").alias("name", "value")).join(targets, ["doc_id", "scope"])
    n = F.row_number().over(Window.partitionBy("doc_id", "op_id").orderBy("target_id", "name")) - 1
    return rows.withColumn("n", n).withColumn("patch_id", F.concat_ws(":patch:", "op_id", F.col("n").cast("string"))).drop("scope", "n")


def apply_patches(runs: DataFrame, patches: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """Patches on inline targets reach their run, those on block targets all runs of the paragraph; then the fold."""
    key = F.regexp_extract("target_id", "^target:[a-z]+:(.*)$", 1)
    block = patches.filter(F.col("target_id").startswith("target:block:")).withColumn("paragraph_id", key)
    block = block.join(runs.select("doc_id", "paragraph_id", "run_id"), ["doc_id", "paragraph_id"]).select("doc_id", "run_id", "attribute", "value", "seq")
    inline = patches.filter(F.col("target_id").startswith("target:inline:")).select("doc_id", key.alias("run_id"), "attribute", "value", "seq")
    return apply_style_ops(runs, block.unionByName(inline), attributes)


SECTION_TARGET = "target:section:document"


def unknown_targets(runs: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches whose target is no run, no paragraph and not the document's section, with their error."""
    known = runs.select("doc_id", F.explode(F.array(F.concat(F.lit("target:inline:"), "run_id"), F.concat(F.lit("target:block:"), "paragraph_id"), F.lit(SECTION_TARGET))).alias("target_id"))
    return patches.join(known.distinct(), ["doc_id", "target_id"], "left_anti").withColumn("error", F.lit("E_PATCH_TARGET_NOT_FOUND"))


def apply_section_patches(docs: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches on a document's section set its page layout: paper size and margins."""
    own = patches.filter(F.col("target_id") == SECTION_TARGET)
    return page_layout(docs, own.select("doc_id", F.col("attribute").alias("field"), "value", "seq"))


def _last_of_each(changes: Column) -> Column:
    """The last change of every name, of changes in their order."""
    return F.filter(changes, lambda x, i: ~F.exists(F.slice(changes, i + 2, F.size(changes)), lambda y: y["name"] == x["name"]))


def edit_nodes(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """set_attr, remove_attr, set_text, remove_node, ensure_node and replace_node_xml on (doc_id, path, tag, text, attrs MAP).

    edits: (doc_id, path, seq, type, name, value). A node is replaced first: tag, attributes and text come from the
    new element and the nodes below it go, replaced ones among them; ensured nodes are made where none is left. Of
    several edits of one attribute the last wins; removal of a node takes all below it and beats edits of them.

    A subtree is an interval of a document's paths in order: from the node's key to its key and a sign above all that
    follow a node. Intervals nest, so a node lies in one exactly if the largest end before it is beyond its key: one
    join with the edits, then one sort of each document, and no row for an ancestor.
    """
    of = lambda *types: F.col("type").isin(*types)
    change = F.when(of("set_attr", "remove_attr"), F.struct("seq", "type", "name", "value"))
    last = lambda name, value: F.max_by(F.when(of(name), value), F.when(of(name), F.col("seq")))
    per = edits.groupBy("doc_id", "path").agg(
        F.array_sort(F.collect_list(change)).alias("_changes"), last("set_text", F.coalesce("value", F.lit(""))).alias("_text"), last("replace_node_xml", F.col("value")).alias("_xml"),
        last("ensure_node", F.col("value")).alias("_ensured"), F.max(of("remove_node")).alias("_removed"),
    )
    key = F.translate("path", "/", "\x01")
    end = F.concat("_key", F.lit("\x02"))
    out = nodes.select("doc_id", "path", "tag", "text", "attrs", F.lit(True).alias("_there")).join(per, ["doc_id", "path"], "full").withColumn("_key", key)
    order = Window.partitionBy("doc_id").orderBy("_key")
    over = lambda root, upto: F.coalesce(F.max(F.when(root, end)).over(order.rowsBetween(Window.unboundedPreceding, upto)) > F.col("_key"), F.lit(False))
    out = out.withColumn("_gone", over(F.col("_removed"), 0)).withColumn("_kept", F.col("_there").isNotNull() & ~over(F.col("_xml").isNotNull(), -1))
    out = out.filter(~F.col("_gone") & (F.col("_kept") | F.col("_ensured").isNotNull()))
    opening = F.regexp_extract("_xml", "^\\s*<([^>]*?)/?>", 1)
    pairs = F.transform(F.regexp_extract_all(opening, F.lit('[^\\s=]+\\s*=\\s*"[^"]*"'), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, "^[^\\s=]+", 0).alias("key"), F.regexp_extract(x, '"([^"]*)"', 1).alias("value")))
    inner = F.regexp_replace(F.regexp_extract("_xml", "^\\s*<[^>]*>(?s)(.*)</[^>]*>\\s*$", 1), "<[^>]*>", "")
    pick = lambda xml, old, new: F.when(~F.col("_kept"), new).when(F.col("_xml").isNotNull(), xml).otherwise(F.col(old))
    out = out.withColumn("tag", pick(F.regexp_extract(opening, "^[^\\s/]+", 0), "tag", F.col("_ensured"))).withColumn("text", F.coalesce("_text", pick(inner, "text", F.lit(""))))
    out = out.withColumn("attrs", F.map_entries(pick(F.map_from_entries(pairs), "attrs", F.create_map().cast("map<string,string>")))).withColumn("_changes", _last_of_each(F.col("_changes")))
    kept = F.filter("attrs", lambda e: ~F.exists("_changes", lambda x: x["name"] == e["key"]))
    put = F.transform(F.filter("_changes", lambda x: x["type"] == "set_attr"), lambda x: F.struct(x["name"].alias("key"), x["value"].alias("value")))
    return out.select("doc_id", "path", "tag", "text", F.map_from_entries(F.when(F.col("_changes").isNull(), F.col("attrs")).otherwise(F.concat(kept, put))).alias("attrs"))


def patch_history(patches: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("applied_at", "patch_id")
    return patches.withColumn("n", F.row_number().over(order))


def change_diff(before: DataFrame, after: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """One row per run and attribute whose value differs, as text; unset differs from false.

    The sides meet once by run and are compared inside the row; only what differs becomes rows.
    """
    side = lambda df, name: df.select("doc_id", "run_id", F.struct(*[F.col(a).cast("string").alias(a) for a in attributes]).alias(name))
    both = side(before, "_b").join(side(after, "_a"), ["doc_id", "run_id"], "full")
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"_b.{a}").alias("before"), F.col(f"_a.{a}").alias("after")) for a in attributes])
    changed = F.filter(pairs, lambda x: ~x["before"].eqNullSafe(x["after"]))
    return both.select("doc_id", "run_id", F.explode(changed).alias("x")).select("doc_id", "run_id", "x.*")


def without_runs(patches: DataFrame, rolled_back: DataFrame) -> DataFrame:
    """Patches without those of rolled-back runs."""
    return patches.join(rolled_back.select("run_id").distinct(), "run_id", "left_anti")


def state_as_of(snapshots: DataFrame, log: DataFrame, asked: DataFrame, rolled_back: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """The runs of documents as of each version asked for, as if rolled-back tasks had never written.

    snapshots: (doc_id, version, run_id, attributes), whole documents after the patch of that number; log: (doc_id, seq,
    task, run_id, attribute, value); asked: (doc_id, version); rolled_back: (doc_id, task). A state begins at the nearest
    snapshot up to the version that no rolled-back patch has gone into, or at nothing where there is none, and the
    patches after it are folded, the last write of each attribute winning. Runs that only patches name come out too.

    The nearest snapshot is found by one sort of each document's snapshots and versions; patches meet the versions of
    their document only from the snapshot on.
    """
    gone = rolled_back.select("doc_id", "task").distinct()
    first_bad = log.join(gone, ["doc_id", "task"], "left_semi").groupBy("doc_id").agg(F.min("seq").alias("_bad"))
    wanted = asked.select("doc_id", "version").distinct().join(first_bad, "doc_id", "left")
    wanted = wanted.select("doc_id", "version", F.least("version", F.col("_bad") - 1).alias("at"), F.lit(None).cast("long").alias("from"))
    taken = snapshots.select("doc_id", F.col("version").cast("long").alias("at")).distinct()
    taken = taken.select("doc_id", F.lit(None).cast("long").alias("version"), "at", F.col("at").alias("from"))
    order = Window.partitionBy("doc_id").orderBy("at", F.col("from").asc_nulls_last())
    placed = wanted.unionByName(taken).withColumn("from", F.last("from", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("version IS NOT NULL").drop("at")
    base = placed.join(snapshots.withColumnRenamed("version", "from"), ["doc_id", "from"]).select("doc_id", "version", "run_id", F.struct(*attributes).alias("_base"))
    later = log.join(gone, ["doc_id", "task"], "left_anti").filter("value IS NOT NULL").join(placed, "doc_id").filter("seq <= version AND (`from` IS NULL OR seq > `from`)")
    last = lambda a: F.max_by(F.when(F.col("attribute") == a, F.col("value")), F.when(F.col("attribute") == a, F.col("seq"))).alias(a)
    folded = later.groupBy("doc_id", "version", "run_id").agg(*map(last, attributes))
    folded = folded.select("doc_id", "version", "run_id", F.struct(*attributes).alias("_new"))
    kinds = dict(snapshots.dtypes)
    out = base.join(folded, ["doc_id", "version", "run_id"], "full")
    return out.select("doc_id", "version", "run_id", *[F.coalesce(F.col(f"_new.{a}").cast(kinds[a]), F.col(f"_base.{a}")).alias(a) for a in attributes])


def write_summary(ops: DataFrame) -> DataFrame:
    line = (
        F.when(F.col("dry_run"), F.format_string("%s: dry run, %d targets", "op_type", "n_targets")).when(F.col("op_type") == "set_page_layout", F.lit("set_page_layout: document"))
        .when(F.col("n_targets") == 1, F.format_string("%s: 1 target", "op_type")).when(F.col("n_targets") == 0, F.format_string("%s: pending", "op_type"))
        .otherwise(F.format_string("%s: %d targets", "op_type", "n_targets"))
    )
    return ops.withColumn("summary", line)
