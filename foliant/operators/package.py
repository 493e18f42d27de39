"""Package model: parts, content types, relationships, properties and document totals; reading and writing a corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from foliant.functions import structure as st
from foliant.sources.package_files import package_files


def scan_docx_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part_path, xml, error, kind, part_order) of every package under path; .rels parts and folders are left out.

    part_order is the reading order: main document, headers, footers, footnotes, endnotes, the rest. A package that is
    no zip is one row with an error. A filter on kind reaches the scan: other parts are not read.
    """
    return content_parts(package_files(spark, path))


def content_parts(parts: DataFrame) -> DataFrame:
    return parts.filter("part_path is null or not part_path like '%.rels'")


def resolve_content_types(parts: DataFrame, overrides: DataFrame, defaults: DataFrame) -> DataFrame:
    """An override by part name beats the default of the lower-cased extension; defaults may be each document's own."""
    ext = F.lower(F.regexp_extract("part_path", "\\.([^./]+)$", 1))
    out = parts.withColumn("ext", ext).join(overrides.withColumnRenamed("content_type", "_o"), ["doc_id", "part_path"], "left")
    out = out.join(defaults.withColumnRenamed("content_type", "_d"), ["doc_id", "ext"] if "doc_id" in defaults.columns else "ext", "left")
    return out.withColumn("content_type", F.coalesce("_o", "_d")).drop("_o", "_d", "ext")


def relationship_edges(rels: DataFrame) -> DataFrame:
    """Rows with id, type and target, targets resolved against the source's folder; external ones stay."""
    whole = rels.filter("rel_id IS NOT NULL AND type IS NOT NULL AND target IS NOT NULL AND rel_id <> '' AND type <> '' AND target <> ''")
    resolved = F.when(F.col("target_mode") == "External", F.col("target")).otherwise(st.normalized_target("source_part", "target"))
    return whole.withColumn("target", resolved)


def part_models(parts: DataFrame, edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Outgoing relationships of each part and, from its XML nodes, the name of its root element."""
    n = edges.groupBy("doc_id", F.col("source_part").alias("part_path")).agg(F.count("*").alias("relationship_count"))
    out = parts.join(n, ["doc_id", "part_path"], "left").withColumn("relationship_count", F.coalesce("relationship_count", F.lit(0)))
    if nodes is None:
        return out
    roots = nodes.filter("node = 0").select("doc_id", "part_path", F.col("tag").alias("root_name"))
    return out.join(roots, ["doc_id", "part_path"], "left")


def package_meta(parts: DataFrame, edges: DataFrame, sections: DataFrame) -> DataFrame:
    kinds = ("header", "footer", "footnotes", "endnotes", "custom_xml", "media")
    counts = parts.groupBy("doc_id").agg(F.count("*").alias("n_parts"), F.count_if(F.col("part_path").endswith(".xml")).alias("n_xml"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])
    rels = edges.groupBy("doc_id").agg(F.count("*").alias("n_relationships"))
    secs = sections.groupBy("doc_id").agg(F.count("*").alias("n_sections"))
    out = counts.join(rels, "doc_id", "left").join(secs, "doc_id", "left")
    return out.withColumn("n_relationships", F.coalesce("n_relationships", F.lit(0))).withColumn("n_sections", F.greatest(F.lit(1), F.coalesce("n_sections", F.lit(0))))


PROPERTIES = ("creator", "lastModifiedBy", "created", "modified", "revision")


def core_properties(props: DataFrame) -> DataFrame:
    """One row per document; values are fixed, so this is one aggregation without a pass to find them."""
    return props.groupBy("doc_id").agg(*[F.max(F.when(F.col("name") == p, F.col("value"))).alias(p) for p in PROPERTIES])


def header_footer_bindings(sections: DataFrame, edges: DataFrame) -> DataFrame:
    """Header and footer references of sections resolved to parts; unresolved ones go. sections: doc_id, section, refs array<struct<kind, rel_id>>."""
    refs = sections.select("doc_id", "section", F.explode("refs").alias("x")).select("doc_id", "section", "x.kind", "x.rel_id")
    return refs.join(edges.select("doc_id", "rel_id", "target"), ["doc_id", "rel_id"]).select("doc_id", "section", "kind", F.col("target").alias("part_path"))


NOTE_TOTALS = ("n_header", "n_footer", "n_footnotes", "n_endnotes")


def document_meta(paragraphs: DataFrame, warnings: DataFrame, package: DataFrame) -> DataFrame:
    """Totals of paragraphs, images and formulas, of the package's headers, footers and notes, and all warnings."""
    totals = paragraphs.groupBy("doc_id").agg(
        F.count_if(F.col("part_kind") == "main_document").alias("n_paragraphs"), F.count_if("in_table").alias("n_table"),
        F.sum("n_images").alias("n_images"), F.sum("n_formulas").alias("n_formulas"),
    )
    warned = warnings.groupBy("doc_id").agg(F.array_sort(F.collect_set("message")).alias("warnings"))
    out = totals.join(package.select("doc_id", *NOTE_TOTALS), "doc_id", "left").join(warned, "doc_id", "left")
    out = out.select(*totals.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in NOTE_TOTALS], F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))
    return out.withColumn("first_warning", F.try_element_at("warnings", F.lit(1)))


CONTRACT = """template_id STRING, version STRING, semantics ARRAY<STRUCT<key:STRING,label:STRING,required:BOOLEAN,multiple:BOOLEAN>>,
 derived ARRAY<STRUCT<key:STRING,mode:STRING,inherits_from:ARRAY<STRING>,text_hints:ARRAY<STRING>,negative_examples:ARRAY<STRING>>>,
 rules ARRAY<STRUCT<semantic_key:STRING,position_hints:ARRAY<STRING>,text_hints:ARRAY<STRING>,numbering_patterns:ARRAY<STRING>,min_occurs:INT,max_occurs:INT>>,
 patch_blocks ARRAY<STRUCT<semantic_key:STRING,scope:STRING,operations:ARRAY<STRUCT<type:STRING,attributes:MAP<STRING,STRING>>>>>,
 operation_blocks ARRAY<STRUCT<semantic_key:STRING,scope:STRING,operations:ARRAY<STRUCT<type:STRING,attributes:MAP<STRING,STRING>>>>>,
 policy STRUCT<enforce_validation:BOOLEAN,min_confidence:DOUBLE,reject_conflicting_matches:BOOLEAN,reject_unmatched_when_required:BOOLEAN,allow_unclassified:BOOLEAN,ordering:ARRAY<STRING>>"""


def load_templates(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Template files as rule tables; legacy operation_blocks stand in only where patch_blocks is empty."""
    return template_tables(spark.read.schema(CONTRACT).option("multiLine", "true").json(path))


def template_tables(contracts: DataFrame) -> dict[str, DataFrame]:
    """Six tables: semantics, derived semantics, rules, patch blocks, their operations, and each template's policy."""
    blocks = F.when(F.size(F.coalesce("patch_blocks", F.array())) > 0, F.col("patch_blocks")).otherwise(F.col("operation_blocks"))
    patches = contracts.select("template_id", F.posexplode(blocks).alias("patch_order", "x")).select("template_id", "patch_order", "x.*")
    each = lambda column, order: contracts.select("template_id", F.posexplode(column).alias(order, "x")).select("template_id", order, "x.*")
    return {
        "t_semantic": each("semantics", "semantic_order"), "t_derived": each("derived", "derived_order"), "t_rule": each("rules", "rule_order"),
        "t_patch": patches.select("template_id", "semantic_key", "scope"),
        "t_operation": patches.select("template_id", "semantic_key", "patch_order", F.posexplode("operations").alias("operation_order", "x")).select("template_id", "semantic_key", "patch_order", "operation_order", "x.*"),
        "t_policy": contracts.filter("policy IS NOT NULL").select("template_id", "policy.*"),
    }


def block_nodes(runs: DataFrame) -> DataFrame:
    """One node per block: its run text in order and the first style that a run has."""
    rows = F.array_sort(F.collect_list(F.struct("run_index", "text")))
    first = F.min_by("font_name", F.when(F.col("font_name").isNotNull(), F.col("run_index")))
    return runs.groupBy("doc_id", "paragraph_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "").alias("text"), first.alias("font_name"))


BUCKET_ROWS = 1_000_000


def buckets_for(final: DataFrame, bucket_rows: int = BUCKET_ROWS) -> int:
    """As many buckets as bucket_rows go into the rows, so files stay of one size whatever the corpus."""
    return max(1, -(-final.select("doc_id").count() // bucket_rows))


def materialize(final: DataFrame, sources: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS, buckets: int | None = None) -> tuple[DataFrame, int]:
    """Write final rows at path, bucketed and sorted by document, and read them back, with the number of rows written.

    Rows of a document without a source are refused. Tables of equal buckets join by document, or by document and
    more, without a shuffle; so give the tables of one corpus the same number (buckets_for of the largest).
    """
    spark = final.sparkSession
    known = final.join(sources.select("doc_id").distinct(), "doc_id", "left_semi")
    n = buckets or buckets_for(known, bucket_rows)
    count, name = Observation(), f"materialized_{uuid.uuid4().hex}"
    kept = known.observe(count, F.count("*").alias("n")).repartition(n, "doc_id")
    kept.write.mode("overwrite").option("path", path).bucketBy(n, "doc_id").sortBy("doc_id").saveAsTable(name)
    return materialized(spark, name), count.get["n"]


def materialized(spark: SparkSession, name: str, path: str | None = None, schema: str | None = None, buckets: int | None = None) -> DataFrame:
    """A bucketed table by its name; with path, schema and buckets it is declared first, for a session that has not written it."""
    if path is not None:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY (doc_id) SORTED BY (doc_id) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def join_by_buckets(spark: SparkSession) -> None:
    """From now on joins of the session on doc_id and more use buckets of doc_id alone; by default Spark wants all keys in them."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def rebuild_paragraphs(nodes: DataFrame) -> DataFrame:
    """A new paragraph for each node of a document without a package, in node order."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("paragraph_index", "run_index")) - 1
    return nodes.select("doc_id", F.concat(F.lit("p_"), place.cast("string")).alias("paragraph_id"), "text", "font_name")
