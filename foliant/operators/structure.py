"""Structure extraction: blocks, runs, tables, records, styles, numbering and evidence. DataFrames in, DataFrame out.

Windows and groups are keyed by document (and paragraph), so one hash partitioning by doc_id serves them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import structure as st
from foliant.functions import text as tx

STYLE_ATTRIBUTES = ("font_name", "font_size_pt", "font_color", "is_bold")


def flatten_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, seq, node_type) to ordinals per kind and a path anchor."""
    place = F.row_number().over(Window.partitionBy("doc_id", "node_type").orderBy("seq")) - 1
    return blocks.withColumn("ordinal", place).withColumn("anchor", F.concat_ws("", F.lit("body/"), "node_type", F.lit("["), F.col("ordinal").cast("string"), F.lit("]")))


def flatten_runs(paragraphs: DataFrame, delimiter: str) -> DataFrame:
    """Pieces of a paragraph as runs; the ordinal counts all pieces, rows are the non-empty ones."""
    cut = paragraphs.select("doc_id", "paragraph_id", F.posexplode(F.split("text", delimiter)).alias("run_index", "text"))
    return cut.filter(F.length("text") > 0).withColumn("run_id", F.concat_ws("_r_", "paragraph_id", F.col("run_index").cast("string")))


def flatten_tables(tables: DataFrame) -> DataFrame:
    """(doc_id, tbl, rows array<array<array<string>>>) to one row per cell paragraph with its coordinates and id."""
    cells = tables.select("doc_id", "tbl", F.posexplode("rows").alias("r", "cells")).select("doc_id", "tbl", "r", F.posexplode("cells").alias("c", "paras"))
    out = cells.select("doc_id", "tbl", "r", "c", F.posexplode("paras").alias("p", "text"))
    text = lambda x: F.col(x).cast("string")
    return out.withColumn("id", F.concat_ws("_", F.lit("tbl"), text("tbl"), F.lit("r"), text("r"), F.lit("c"), text("c"), F.lit("p"), text("p")))


def paragraph_records(runs: DataFrame) -> DataFrame:
    """Trimmed text and ordered run ids of each paragraph."""
    rows = F.array_sort(F.collect_list(F.struct("run_index", "run_id", "text")))
    grouped = runs.groupBy("doc_id", "paragraph_id").agg(rows.alias("rows"), F.first("style_name").alias("style_name"), F.first("in_table").alias("in_table"))
    return grouped.select(
        "doc_id", "paragraph_id", tx.strip(F.array_join(F.transform("rows", lambda x: x["text"]), "")).alias("text"),
        F.transform("rows", lambda x: x["run_id"]).alias("run_ids"), "style_name", "in_table",
    )


def derive_paragraphs(runs: DataFrame) -> DataFrame:
    """Records where no index exists: table text inside tables, body elsewhere."""
    return paragraph_records(runs).withColumn("role", F.when(F.col("in_table"), "table_text").otherwise("body"))


def role_counts(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.filter(F.trim("role") != "").groupBy("doc_id", "role").agg(F.count("*").alias("n"))


def resolve_styles(styles: DataFrame, defaults: DataFrame, attributes: tuple[str, ...] = STYLE_ATTRIBUTES) -> DataFrame:
    """Each attribute from the nearest style of the based_on chain that sets it, else from the document's defaults.

    Chains may be of any length. The styles of a document meet in one row, a table of a few hundred at most; there
    every style takes over from the ancestor that it points to and then points as far again, so a chain of n styles
    needs log2(n) steps and no further shuffle. In a cycle every style sees all of its members.
    """
    fields = F.struct("style_id", "based_on", *attributes)
    whole = styles.groupBy("doc_id").agg(F.array_sort(F.collect_list(fields)).alias("s")).withColumn("ids", F.transform("s", lambda x: x["style_id"]))
    up = lambda x: F.nullif(F.array_position("ids", x["based_on"]).cast("int"), F.lit(0))
    start = F.transform("s", lambda x: F.struct(x["style_id"].alias("style_id"), up(x).alias("up"), *[x[a].alias(a) for a in attributes]))
    doubled = lambda acc, x: F.struct(
        x["style_id"].alias("style_id"), F.element_at(acc, x["up"])["up"].alias("up"), *[F.coalesce(x[a], F.element_at(acc, x["up"])[a]).alias(a) for a in attributes]
    )
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size("s") + 1)).cast("int"))
    done = F.aggregate(rounds, start, lambda acc, _: F.transform(acc, lambda x: doubled(acc, x)))
    found = whole.select("doc_id", F.explode(done).alias("x")).select("doc_id", "x.*").drop("up")
    base = defaults.select("doc_id", *[F.col(a).alias(f"_{a}") for a in attributes])
    return found.join(base, "doc_id", "left").select("doc_id", "style_id", *[F.coalesce(a, f"_{a}").alias(a) for a in attributes])


def resolve_run_style(
    runs: DataFrame, styles: DataFrame, defaults: DataFrame, constants: dict,
    attributes: tuple[str, ...] = ("font_name", "font_size_pt", "font_color"), paragraph_attributes: tuple[str, ...] = (),
) -> DataFrame:
    """Per attribute: direct, character style, paragraph style, Normal, document defaults, constants.

    paragraph_attributes (alignment, say) come from the run's paragraph, its style, Normal and the constants only;
    line_spacing, if runs has it, is the paragraph's own.
    """
    every = (*attributes, *paragraph_attributes)

    def level(name: str) -> DataFrame:
        return styles.select("doc_id", F.col("style_id").alias(f"{name}_id"), *[F.col(a).alias(f"{name}_{a}") for a in every])

    out = runs
    for name, key in (("char", "char_style"), ("para", "para_style")):
        out = out.join(level(name).withColumnRenamed(f"{name}_id", key), ["doc_id", key], "left")
    normal = level("normal").filter(F.col("normal_id") == "Normal").drop("normal_id")
    base = defaults.select("doc_id", *[F.col(a).alias(f"base_{a}") for a in attributes])
    out = out.join(normal, "doc_id", "left").join(base, "doc_id", "left")
    chosen = [F.coalesce(a, f"char_{a}", f"para_{a}", f"normal_{a}", f"base_{a}", F.lit(constants[a])).alias(a) for a in attributes]
    chosen += [F.coalesce(a, f"para_{a}", f"normal_{a}", F.lit(constants[a])).alias(a) for a in paragraph_attributes]
    return out.select("doc_id", "run_id", *chosen, *(["line_spacing"] if "line_spacing" in runs.columns else []))


def run_properties(raw: DataFrame, keys: tuple[str, ...] = ("doc_id", "run_id")) -> DataFrame:
    """Direct properties: fonts by script order, half points to points, auto colour unset, toggles with three states.

    Columns that raw lacks (i, strike, caps, highlight) give no attribute.
    """
    toggle = lambda c: F.when(F.lower(c).isin("", "1", "true", "on"), True).when(F.lower(c).isin("0", "false", "off", "none"), False)
    more = [toggle(F.col(c)).alias(n) for c, n in (("i", "is_italic"), ("strike", "is_strike"), ("caps", "is_all_caps")) if c in raw.columns]
    more += [F.nullif(F.col("highlight"), F.lit("")).alias("highlight_color")] if "highlight" in raw.columns else []
    return raw.select(
        *keys, tx.first_text("east_asia", "ascii", "h_ansi", "cs").alias("font_name"),
        (F.col("sz").try_cast("double") / 2).alias("font_size_pt"),
        F.when(F.lower("color") != "auto", F.upper("color")).alias("font_color"),
        toggle(F.col("b")).alias("is_bold"),
        F.when(F.col("u").isNotNull(), ~F.lower("u").isin("none", "false")).alias("is_underline"), *more,
    )


def numbering_projection(nums: DataFrame, levels: DataFrame) -> DataFrame:
    """Levels of each numbering instance by ilvl; an unknown abstract numbering gives an empty list."""
    lists = levels.groupBy("doc_id", "abstract_id").agg(F.array_sort(F.collect_list(F.struct("ilvl", "num_fmt"))).alias("levels"))
    joined = nums.join(lists, ["doc_id", "abstract_id"], "left")
    return joined.withColumn("levels", F.coalesce("levels", F.array().cast("array<struct<ilvl:int,num_fmt:string>>")))


def project_nodes(runs: DataFrame) -> DataFrame:
    return runs.filter((F.trim("text") != "") & (F.trim("run_id") != ""))


def structure_index(indexed: DataFrame, listed: DataFrame, derived: DataFrame) -> DataFrame:
    """The paragraphs of the best source that a document has (index, list, derived), beside its number of their role."""
    every = None
    for rank, part in enumerate((indexed, listed, derived)):
        part = part.select("doc_id", "paragraph_id", "role").withColumn("source_rank", F.lit(rank))
        every = part if every is None else every.unionByName(part)
    best = every.groupBy("doc_id").agg(F.min("source_rank").alias("source_rank"))
    chosen = every.join(best, ["doc_id", "source_rank"])
    return chosen.join(role_counts(chosen).withColumnRenamed("n", "n_role"), ["doc_id", "role"], "left")


def projection_diagnostics(paragraphs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per document: paragraphs that have runs but none among the nodes, and distinct run totals on both sides."""
    runs = paragraphs.select("doc_id", "paragraph_id", F.explode("run_ids").alias("run_id"))
    hit = runs.join(nodes.select("doc_id", "run_id").distinct().withColumn("here", F.lit(1)), ["doc_id", "run_id"], "left")
    per = hit.groupBy("doc_id", "paragraph_id").agg(F.count("here").alias("n_here"), F.count("*").alias("n_runs"))
    out = per.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("n_here") == 0, F.col("paragraph_id")))).alias("unprojected"), F.sum("n_here").alias("projected"), F.sum("n_runs").alias("structured")
    )
    return out


def emphasis_index(runs: DataFrame, k: int = 24) -> DataFrame:
    """The k most emphatic runs of a document in document order. The rank filter is pushed into the window."""
    strength = sum(F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n in (("is_bold", 2), ("is_italic", 1), ("is_underline", 1)))
    strength = strength + F.when(F.col("highlight_color").isNotNull(), 3).otherwise(0)
    text = tx.strip("text")
    scored = runs.withColumn("strength", strength).filter("strength > 0").withColumn("priority", F.col("strength") * 100 - F.least(F.length(text), F.lit(60)) - 2 * F.col("paragraph_index"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("priority"), "paragraph_index", "run_index")
    top = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return top.select("doc_id", "run_id", "paragraph_index", "run_index", "strength", "priority", tx.truncate_text("text", 80).alias("preview"))


def image_evidence(inline: DataFrame) -> DataFrame:
    """Per paragraph: images, whether it has any, and whether it has nothing else. inline: (doc_id, paragraph_id, node_type, text)."""
    images, words = F.count_if(F.col("node_type") == "image"), F.count_if((F.col("node_type") == "text") & (F.trim("text") != ""))
    out = inline.groupBy("doc_id", "paragraph_id").agg(images.alias("n_images"), words.alias("n_text"))
    return out.select("doc_id", "paragraph_id", "n_images", (F.col("n_images") > 0).alias("has_image"), ((F.col("n_images") > 0) & (F.col("n_text") == 0)).alias("image_dominant"))


RUN_STYLE = ("font_name", "font_size_pt", "is_bold")


def paragraph_context(paragraphs: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Position, first and last flags, bucket and image flags beside each paragraph; with runs also the ordered ids
    and direct styles of its runs."""
    order, whole = Window.partitionBy("doc_id").orderBy("paragraph_index"), Window.partitionBy("doc_id")
    out = paragraphs.withColumn("position", F.row_number().over(order) - 1).withColumn("n_paragraphs", F.count("*").over(whole))
    out = (
        out.withColumn("is_first", F.col("position") == 0).withColumn("is_last", F.col("position") == F.col("n_paragraphs") - 1)
        .withColumn("bucket", st.bucket_type("role", "in_table"))
        .withColumn("has_image", F.col("n_images") > 0).withColumn("image_dominant", (F.col("n_images") > 0) & (F.trim("text") == ""))
    )
    if runs is None:
        return out
    rows = F.array_sort(F.collect_list(F.struct("run_index", "run_id", F.struct(*RUN_STYLE).alias("style"))))
    own = runs.groupBy("doc_id", "paragraph_id").agg(rows.alias("_rows"))
    own = own.select("doc_id", "paragraph_id", F.transform("_rows", lambda x: x["run_id"]).alias("run_ids"), F.transform("_rows", lambda x: x["style"]).alias("run_styles"))
    return out.join(own, ["doc_id", "paragraph_id"], "left")


def evidence_summary(context: DataFrame) -> DataFrame:
    """Counts per document, distinct numbering patterns and a histogram of style names."""
    styles = context.groupBy("doc_id", "style_name").agg(F.count("*").alias("n"))
    styles = styles.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("style_name", "n"))).alias("styles"))
    counts = context.groupBy("doc_id").agg(
        F.count_if("in_table").alias("n_table"), F.sum("n_images").alias("n_images"), F.count_if("has_image").alias("n_image_paragraphs"),
        F.count_if("image_dominant").alias("n_image_dominant"), F.array_sort(F.collect_set(tx.numbering_pattern("text"))).alias("patterns"),
    )
    return counts.join(styles, "doc_id")


def observation_summary(context: DataFrame) -> DataFrame:
    """Excerpts of all paragraphs beside their document's counts."""
    counts = context.groupBy("doc_id").agg(F.count_if("in_table").alias("n_table"), F.count_if("has_image").alias("n_image_paragraphs"))
    return context.select("doc_id", "paragraph_id", "role", tx.truncate_text("text", 120).alias("excerpt")).join(counts, "doc_id")


def structure_samples(paragraphs: DataFrame, n: int = 20) -> DataFrame:
    """The first n paragraphs of each document, each beside the document's number of paragraphs of its role."""
    order = Window.partitionBy("doc_id").orderBy("paragraph_index")
    same = F.count("*").over(Window.partitionBy("doc_id", "role"))
    return paragraphs.withColumn("n_role", same).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def block_samples(blocks: DataFrame, n: int = 6) -> DataFrame:
    """The first n blocks of each document."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    return blocks.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def inspect_count(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id").agg(F.count("*").alias("n_nodes"))
