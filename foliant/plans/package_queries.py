"""Queries that read whole packages: parts, paragraphs, runs, cells, styles and relationships from their XML.

The packages are the documents, zipped by sources.corpus.packages; the SQL says what must be found in them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import package as pk
from foliant.operators import structure as ops
from foliant.sources import corpus
from foliant.sources import packages as pg
from foliant.sources.shared import shared_folder, written

from . import views
from .table_queries import CTE

QUERIES: dict = {}
SQL: dict[str, str] = {}
c = F.col


def reg(name, fn, sql, *ctes) -> None:
    QUERIES[name] = fn
    SQL[name] = views.query(sql, *ctes)


CONTENT = pg.PART_ORDER


def parts(s: SparkSession, d: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    return pg.package_parts(corpus.packages(s, d), kinds)


def parsed(s: SparkSession, d: str, kinds: tuple[str, ...] | None = None, tags: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and parts of all packages, or of some kinds of parts and some tags, each written once: zips are opened and
    XML is walked once for all that read them."""
    found = written(parts(s, d, kinds))
    return written(pg.xml_nodes(found, tags)), found.drop("xml")


def numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", c("doc_id").cast("long"))


SOUND = "sound AS (SELECT * FROM raw_paragraphs WHERE doc_id % 50 <> 7), docs AS (SELECT DISTINCT doc_id FROM raw_paragraphs)"


def s1(s, d):
    found = pk.content_parts(parts(s, d))
    return numbered(found.select("doc_id", "part_path", "kind", "part_order", c("error").isNotNull().alias("broken")))


reg("s1_scan_corpus", s1, """SELECT doc_id, 'word/' || name || '.xml' AS part_path, kind, part_order::INTEGER AS part_order, false AS broken FROM docs,
 (VALUES ('document', 'main_document', 0), ('header1', 'header', 1), ('styles', 'styles', 5)) AS p(name, kind, part_order) WHERE doc_id % 50 <> 7
 UNION ALL SELECT doc_id, NULL, NULL, 5, true FROM docs WHERE doc_id % 50 = 7""", CTE, SOUND)  # fmt: skip


def s1_source(s, d):
    """Styles and headers of package files in several folders with equal names, by a filter that the scan meets."""
    folder = corpus.write_packages(s, d, f"{shared_folder(s)}/packages-{uuid.uuid4().hex}")
    found = pk.scan_docx_corpus(s, folder).filter(c("kind").isin("styles", "header"))
    return found.select("doc_id", "part_path", "kind", F.when(c("kind") == "header", F.length("xml")).alias("n_chars"))


reg("s1_scan_files", s1_source, f"""SELECT doc_id % 7 || '/' || doc_id // 7 AS doc_id, 'word/' || name || '.xml' AS part_path, kind,
 (CASE kind WHEN 'header' THEN 126 + length(doc_id::VARCHAR) END)::INTEGER AS n_chars FROM docs,
 (VALUES ('header1', 'header'), ('styles', 'styles')) AS p(name, kind) WHERE doc_id % 50 <> 7""", CTE, SOUND)  # fmt: skip


def s1_paragraphs(s, d):
    out = pg.document_paragraphs(pg.xml_nodes(parts(s, d, CONTENT), pg.PARAGRAPH_TAGS))
    return numbered(out.select("doc_id", "part_path", "paragraph_id", "text", "style_id", "num_ilvl", "in_table", "n_images", c("line_spacing.value").alias("line_spacing")))


reg("s1_read_paragraphs", s1_paragraphs, """, clean AS (SELECT *, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS t FROM sound)
 SELECT doc_id, 'word/document.xml' AS part_path, paragraph_id, regexp_replace(replace(t, '. ', ''), '^\\s+|\\s+$', '', 'g') AS text, style_name AS style_id,
 CASE WHEN is_numbered THEN num_ilvl END AS num_ilvl, in_table, n_images, CASE WHEN (doc_id + paragraph_index) % 6 = 0 THEN 1.5::DOUBLE END AS line_spacing FROM clean
 UNION ALL SELECT doc_id, 'word/header1.xml', 'p_' || count(*), 'Header ' || doc_id, NULL, NULL, false, 0, NULL FROM sound GROUP BY doc_id""", CTE, SOUND)  # fmt: skip


def s1_runs(s, d):
    runs = pg.document_runs(pg.xml_nodes(parts(s, d, CONTENT), pg.RUN_TAGS))
    out = ops.run_properties(runs, ("doc_id", "run_id", "text"))
    return numbered(out.select("doc_id", "run_id", "text", "font_size_pt", "is_bold", "is_underline"))


reg("s1_read_runs", s1_runs, """, r AS (SELECT *, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS t FROM run_pieces WHERE doc_id % 50 <> 7)
 SELECT doc_id, paragraph_id || '_r_' || run_index AS run_id, t AS text, CASE WHEN (paragraph_index + run_index) % 4 = 0 THEN (20 + run_index % 7)::DOUBLE / 2 END AS font_size_pt,
 true AS is_bold, NULL::BOOLEAN AS is_underline FROM r WHERE t <> '' UNION ALL SELECT doc_id, 'p_' || count(*) || '_r_0', 'Header ' || doc_id, NULL, NULL, NULL FROM sound
  GROUP BY doc_id""", CTE, SOUND)  # fmt: skip


def t1(s, d):
    return numbered(pg.document_blocks(*parsed(s, d, CONTENT, ("p", "tbl", "sectPr"))).select("doc_id", "part_path", "node_type", "ordinal"))


reg("t1_read_blocks", t1, """, kinds AS (SELECT doc_id, CASE WHEN in_table THEN 'table' ELSE 'paragraph' END AS node_type, paragraph_index FROM sound)
 SELECT doc_id, 'word/document.xml' AS part_path, node_type, (row_number() OVER (PARTITION BY doc_id, node_type ORDER BY paragraph_index) - 1)::INTEGER AS ordinal FROM kinds
 UNION ALL SELECT DISTINCT doc_id, 'word/document.xml', 'section_break', 0 FROM sound UNION ALL SELECT DISTINCT doc_id, 'word/header1.xml', 'paragraph', 0 FROM sound""", CTE, SOUND)  # fmt: skip


def t3(s, d):
    return numbered(pg.document_cells(*parsed(s, d, CONTENT, ("p",))).drop("part_path"))


reg("t3_read_cells", t3, """, t AS (SELECT doc_id, paragraph_index, (doc_id + paragraph_index) % 20 = 17 AS nested, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index) - 1 AS n
  FROM sound WHERE in_table)
 SELECT doc_id, paragraph_index, CASE WHEN nested THEN 2 ELSE 1 END AS depth, 'tb_' || n || '/tr_0/tc_0' || CASE WHEN nested THEN '/tb_0/tr_0/tc_0' ELSE '' END AS cell, 0 AS p
  FROM t""", CTE, SOUND)  # fmt: skip


def t9(s, d):
    nodes, found = parsed(s, d, ("styles",))
    keys = ("doc_id", "style_id", "based_on")
    styles = ops.run_properties(pg.style_rows(nodes, found), keys)
    defaults = ops.run_properties(pg.default_rows(nodes, found), ("doc_id",))
    return numbered(ops.resolve_styles(styles, defaults))


reg("t9_read_styles", t9, f"""SELECT doc_id, 'S' || j AS style_id, 'Font' || doc_id % 3 AS font_name, CASE
  WHEN j <= doc_id % {corpus.LONG_CHAIN} THEN (20 + doc_id % {corpus.LONG_CHAIN})::DOUBLE / 2 ELSE 9.5 END AS font_size_pt,
 NULL::VARCHAR AS font_color, NULL::BOOLEAN AS is_bold FROM docs, range({corpus.LONG_CHAIN}) AS r(j) WHERE doc_id % 50 <> 7""", CTE, SOUND)  # fmt: skip


def s5(s, d):
    nodes, found = parsed(s, d)
    edges = pk.relationship_edges(pg.relationship_rows(nodes))
    return numbered(pk.part_models(pk.content_parts(found).filter("part_path is not null"), edges, nodes).select("doc_id", "part_path", "root_name", "relationship_count"))


reg("s5_read_part_models", s5, """SELECT doc_id, 'word/' || name || '.xml' AS part_path, root AS root_name, n::BIGINT AS relationship_count FROM docs,
 (VALUES ('document', 'document', 2), ('header1', 'hdr', 0), ('styles', 'styles', 0)) AS p(name, root, n) WHERE doc_id % 50 <> 7""", CTE, SOUND)  # fmt: skip


def s8(s, d):
    nodes, _ = parsed(s, d, ("main_document", "relationships"), ("sectPr", "headerReference", "footerReference", "Relationship"))
    return numbered(pk.header_footer_bindings(pg.section_rows(nodes), pk.relationship_edges(pg.relationship_rows(nodes))))


reg("s8_read_bindings", s8, "SELECT doc_id, 0 AS section, 'header' AS kind, 'word/header1.xml' AS part_path FROM docs WHERE doc_id % 50 <> 7", CTE, SOUND)
