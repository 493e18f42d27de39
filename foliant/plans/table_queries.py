"""Queries of package, structure, selection and write operators over the corpus views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import structure as st
from foliant.functions import text as tx
from foliant.operators import select as sel
from foliant.operators import structure as ops
from foliant.operators import write as wr
from foliant.sources import corpus
from foliant.sources.shared import written

from . import views
from .text_queries import PREFIX_SQL, T, _ALIASES, strip

QUERIES: dict = {}
SQL: dict[str, str] = {}
c = F.col
CTE = views.ALL


def add(name: str, fn, sql: str | None, *ctes: str) -> None:
    QUERIES[name] = fn
    if sql is not None:
        SQL[name] = views.query(sql, *ctes)


def _join(column: str, sep: str = "|"):
    return F.array_join(column, sep)


# ---------------------------------------------------------------- structure


def t1(s: SparkSession, d: str) -> DataFrame:
    p = corpus.paragraphs(s, d)
    kind = F.when(c("in_table"), "table").when((c("doc_id") + c("paragraph_index")) % 15 == 0, "section_break").otherwise("paragraph")
    return ops.flatten_blocks(p.select("doc_id", c("paragraph_index").alias("seq"), kind.alias("node_type")))


add("t1_flatten_blocks", t1, """, blocks AS (SELECT doc_id, paragraph_index AS seq, CASE WHEN in_table THEN 'table'
  WHEN (doc_id + paragraph_index) % 15 = 0 THEN 'section_break' ELSE 'paragraph' END AS node_type FROM paragraphs),
 placed AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, node_type ORDER BY seq) - 1)::INTEGER AS ordinal FROM blocks)
 SELECT *, 'body/' || node_type || '[' || ordinal || ']' AS anchor FROM placed""", CTE)  # fmt: skip
add("t2_flatten_runs", lambda s, d: ops.flatten_runs(corpus.paragraphs(s, d), "\\. "), "SELECT doc_id, paragraph_id, run_index, text, run_id FROM runs", CTE)


def t3(s, d):
    p = corpus.paragraphs(s, d).filter("in_table")
    rows = F.transform(F.split("text", "\\. "), lambda r: F.transform(F.split(r, ", "), lambda x: F.split(x, " ")))
    return ops.flatten_tables(p.select("doc_id", c("paragraph_index").alias("tbl"), rows.alias("rows")))


add("t3_flatten_tables", t3, """, a AS (SELECT doc_id, paragraph_index AS tbl, unnest(string_split(text, '. ')) AS x, (generate_subscripts(string_split(text, '. '), 1) - 1)::INTEGER AS r
  FROM paragraphs WHERE in_table),
 b AS (SELECT doc_id, tbl, r, unnest(string_split(x, ', ')) AS y, (generate_subscripts(string_split(x, ', '), 1) - 1)::INTEGER AS c FROM a),
 e AS (SELECT doc_id, tbl, r, c, unnest(string_split(y, ' ')) AS text, (generate_subscripts(string_split(y, ' '), 1) - 1)::INTEGER AS p FROM b)
 SELECT *, 'tbl_' || tbl || '_r_' || r || '_c_' || c || '_p_' || p AS id FROM e""", CTE)  # fmt: skip
RECORDS = f"records AS (SELECT doc_id, paragraph_id, {strip("string_agg(text, '' ORDER BY run_index)")} AS text, string_agg(run_id, '|' ORDER BY run_index) AS run_ids, any_value(style_name) AS style_name, any_value(in_table) AS in_table FROM runs GROUP BY doc_id, paragraph_id)"
add("t4_paragraph_records", lambda s, d: ops.paragraph_records(corpus.runs(s, d)).withColumn("run_ids", _join("run_ids")), ", " + RECORDS + " SELECT * FROM records", CTE)
add("t5_derive_paragraphs", lambda s, d: ops.derive_paragraphs(corpus.runs(s, d)).withColumn("run_ids", _join("run_ids")), ", " + RECORDS + " SELECT *, CASE WHEN in_table THEN 'table_text' ELSE 'body' END AS role FROM records", CTE)
add("t6_role_by_name", lambda s, d: corpus.paragraphs(s, d).select("doc_id", "paragraph_id", "role", "heading_level", "list_level"), "SELECT doc_id, paragraph_id, role, heading_level, list_level FROM paragraphs", CTE)
ROLE_BY_PART = f"CASE part_kind WHEN 'header' THEN 'header' WHEN 'footer' THEN 'footer' WHEN 'footnotes' THEN 'footnote' WHEN 'endnotes' THEN 'endnote' ELSE CASE WHEN in_table THEN 'table_text' WHEN {views.LEVEL} IS NOT NULL THEN 'heading' WHEN is_numbered THEN 'list_item' ELSE 'body' END END"
add("t7_role_by_part", lambda s, d: corpus.paragraphs(s, d).select("doc_id", "paragraph_id", st.role_by_part("part_kind", "style_name", "is_numbered", "in_table").alias("role")), f"SELECT doc_id, paragraph_id, {ROLE_BY_PART} AS role "
    f"FROM paragraphs", CTE)
add("t8_role_counts", lambda s, d: ops.role_counts(corpus.paragraphs(s, d)), "SELECT doc_id, role, count(*) AS n FROM paragraphs GROUP BY ALL", CTE)

# A chain from a character style to Normal, a pair that name each other, one alone, and a long chain whose last one
# alone sets a font.
_LONG = 13
_CHAIN = [("Normal", None), ("Base", "Normal"), ("Body", "Base"), ("Quote", "Body"), ("LoopA", "LoopB"), ("LoopB", "LoopA"), ("Alone", "Missing")]
_CHAIN += [(f"L{i}", f"L{i + 1}" if i + 1 < _LONG else None) for i in range(_LONG)]


def styles(s, d):
    docs = corpus.table(s, d, "documents").select("doc_id")
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("style_id"), F.lit(b).cast("string").alias("based_on")) for i, (n, b) in enumerate(_CHAIN)])
    x = docs.select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.*")
    k = c("doc_id") + c("i")
    return x.select(
        "doc_id", "style_id", "based_on", F.when((c("i") < 7) & (k % 3 == 0) | (c("i") == 6 + _LONG), F.concat(F.lit("Font"), c("i").cast("string"))).alias("font_name"), F.when(k % 4 == 0, (c("i") + 9).cast("double")).alias("font_size_pt"),
        F.when(k % 5 == 0, F.lpad(c("i").cast("string"), 6, "0")).alias("font_color"), F.when(k % 2 == 0, k % 4 == 0).alias("is_bold"),
    )


def defaults(s, d):
    return corpus.table(s, d, "documents").select("doc_id", F.when(c("doc_id") % 2 == 0, "Base Font").alias("font_name"), F.lit(11.0).alias("font_size_pt"), F.lit(None).cast("string").alias("font_color"), F.lit(False).alias("is_bold"))


STYLES = "chain(i, style_id, based_on) AS (VALUES " + ", ".join(f"({i}, '{n}', {repr(b) if b else 'NULL'})" for i, (n, b) in enumerate(_CHAIN)) + """),
styles AS (SELECT doc_id, style_id, based_on, CASE WHEN i < 7 AND (doc_id + i) % 3 = 0 OR i = """ + str(6 + _LONG) + """ THEN 'Font' || i END AS font_name, CASE
  WHEN (doc_id + i) % 4 = 0 THEN (i + 9)::DOUBLE END AS font_size_pt,
 CASE WHEN (doc_id + i) % 5 = 0 THEN lpad(i::VARCHAR, 6, '0') END AS font_color, CASE WHEN (doc_id + i) % 2 = 0 THEN (doc_id + i) % 4 = 0 END AS is_bold FROM documents, chain),
defaults AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Base Font' END AS font_name, 11.0::DOUBLE AS font_size_pt, NULL::VARCHAR AS font_color, false AS is_bold FROM documents)"""
SQL["t9_resolve_styles"] = "WITH RECURSIVE " + STYLES + """,
walk AS (SELECT doc_id, style_id AS leaf, style_id, based_on, [style_id] AS seen, 0 AS level FROM styles
 UNION ALL SELECT w.doc_id, w.leaf, s.style_id, s.based_on, list_append(w.seen, s.style_id), w.level + 1 FROM walk w JOIN styles s ON s.doc_id = w.doc_id AND s.style_id = w.based_on
  WHERE NOT list_contains(w.seen, s.style_id)),
near AS (SELECT w.doc_id, leaf AS style_id, arg_min(s.font_name, level) FILTER (s.font_name IS NOT NULL) AS font_name, arg_min(s.font_size_pt, level) FILTER (s.font_size_pt IS NOT NULL) AS font_size_pt,
 arg_min(s.font_color, level) FILTER (s.font_color IS NOT NULL) AS font_color, arg_min(s.is_bold, level) FILTER (s.is_bold IS NOT NULL) AS is_bold FROM walk w JOIN styles s USING (doc_id, style_id)
  GROUP BY ALL)
SELECT doc_id, style_id, coalesce(n.font_name, d.font_name) AS font_name, coalesce(n.font_size_pt, d.font_size_pt) AS font_size_pt, coalesce(n.font_color, d.font_color) AS font_color, coalesce(n.is_bold, d.is_bold) AS is_bold FROM near n JOIN defaults d USING (doc_id)"""
QUERIES["t9_resolve_styles"] = lambda s, d: ops.resolve_styles(styles(s, d), defaults(s, d))
CONSTANTS = {"font_name": "Times", "font_size_pt": 10.0, "font_color": "000000"}


def t10(s, d):
    m = c("doc_id") + c("paragraph_index") + c("run_index")
    names = F.array(*[F.lit(n) for n, _ in _CHAIN])
    r = corpus.runs(s, d).withColumn("char_style", F.when(m % 4 == 0, F.element_at(names, (m % 7 + 1).cast("int")))).withColumn("para_style", F.element_at(names, (c("paragraph_index") % 7 + 1).cast("int")))
    return ops.resolve_run_style(r, styles(s, d), defaults(s, d), CONSTANTS)


_m = "(r.doc_id + paragraph_index + run_index)"
_names = "[" + ", ".join(f"'{n}'" for n, _ in _CHAIN) + "]"
add("t10_resolve_run_style", t10, f""", picked AS (SELECT r.*, CASE WHEN {_m} % 4 = 0 THEN {_names}[{_m} % 7 + 1] END AS char_style, {_names}[paragraph_index % 7 + 1] AS para_style FROM runs r)
 SELECT r.doc_id, r.run_id, """ + ", ".join(f"coalesce(r.{a}, ch.{a}, pa.{a}, n.{a}, de.{a}, {repr(v)}) AS {a}" for a, v in CONSTANTS.items()) + """ FROM picked r
 LEFT JOIN styles ch ON ch.doc_id = r.doc_id AND ch.style_id = r.char_style LEFT JOIN styles pa ON pa.doc_id = r.doc_id AND pa.style_id = r.para_style
 LEFT JOIN styles n ON n.doc_id = r.doc_id AND n.style_id = 'Normal' LEFT JOIN defaults de ON de.doc_id = r.doc_id""", CTE + ",\n" + STYLES)  # fmt: skip


def raw_properties(df, *keys):
    m = c("doc_id") + c("paragraph_index") * 3 + c("run_index")
    return df.select(
        *keys, F.when(m % 5 == 0, "SimHei").when(m % 5 == 1, " ").alias("east_asia"), F.when(m % 3 == 0, "Arial").alias("ascii"), F.when(m % 2 == 0, "Calibri").alias("h_ansi"), F.lit("Symbol").alias("cs"),
        F.when(m % 6 != 0, (m % 40).cast("string")).alias("sz"), F.when(m % 4 == 0, "auto").when(m % 4 == 1, "ff00aa").alias("color"),
        F.when(m % 4 == 0, "").when(m % 4 == 1, "0").when(m % 4 == 2, "true").alias("b"), F.when(m % 5 == 0, "none").when(m % 5 == 1, "single").alias("u"),
    )


_PROPS = """SELECT {keys}, coalesce(CASE WHEN m % 5 = 0 THEN 'SimHei' END, CASE WHEN m % 3 = 0 THEN 'Arial' END, CASE WHEN m % 2 = 0 THEN 'Calibri' END, 'Symbol') AS font_name,
 CASE WHEN m % 6 <> 0 THEN (m % 40)::DOUBLE / 2 END AS font_size_pt, CASE WHEN m % 4 = 1 THEN 'FF00AA' END AS font_color,
 CASE m % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS is_bold, CASE m % 5 WHEN 0 THEN false WHEN 1 THEN true END AS is_underline FROM ({source})"""
add("t11_run_properties", lambda s, d: ops.run_properties(raw_properties(corpus.runs(s, d), "doc_id", "run_id")), _PROPS.format(keys="doc_id, run_id", source="SELECT *, doc_id + paragraph_index * 3 + run_index AS m FROM runs"), CTE)


def t12(s, d):
    docs = corpus.table(s, d, "documents").select("doc_id", F.lit(0).alias("paragraph_index"), F.lit(0).alias("run_index"))
    return ops.run_properties(raw_properties(docs, "doc_id"), ("doc_id",)).select("doc_id", "font_name", "font_size_pt", "font_color")


add("t12_doc_defaults", t12, "SELECT doc_id, font_name, font_size_pt, font_color FROM (" + _PROPS.format(keys="doc_id", source="SELECT doc_id, doc_id AS m FROM documents") + ")")


def t13(s, d):
    docs = corpus.table(s, d, "documents").select("doc_id")
    nums = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("num_id")).withColumn("abstract_id", ((c("doc_id") + c("num_id")) % 4).cast("int"))
    levels = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("abstract_id")).select("doc_id", "abstract_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ilvl"))
    levels = levels.withColumn("num_fmt", F.when((c("doc_id") + c("ilvl")) % 2 == 0, "decimal").otherwise("bullet"))
    out = ops.numbering_projection(nums, levels)
    return out.select("doc_id", "num_id", "abstract_id", F.array_join(F.transform("levels", lambda x: F.concat_ws(":", x["ilvl"].cast("string"), x["num_fmt"])), "|").alias("levels"))


add("t13_numbering_projection", t13, """nums AS (SELECT doc_id, n::INTEGER AS num_id, ((doc_id + n) % 4)::INTEGER AS abstract_id FROM documents, range(1, 4) t(n)),
 levels AS (SELECT doc_id, a::INTEGER AS abstract_id, string_agg(l || ':' || CASE WHEN (doc_id + l) % 2 = 0 THEN 'decimal' ELSE 'bullet' END, '|' ORDER BY l) AS levels
  FROM documents, range(3) t(a), range(3) u(l) GROUP BY ALL)
 SELECT doc_id, num_id, abstract_id, coalesce(levels, '') AS levels FROM nums LEFT JOIN levels USING (doc_id, abstract_id)""".replace("nums AS", "WITH nums AS", 1))  # fmt: skip
add("t14_project_nodes", lambda s, d: ops.project_nodes(corpus.runs(s, d)).select("doc_id", "run_id", "text"), "SELECT doc_id, run_id, text FROM runs WHERE trim(text) <> '' AND trim(run_id) <> ''", CTE)


def t15(s, d):
    p = corpus.paragraphs(s, d)
    part = lambda r: p.filter(c("doc_id") % 3 >= r)
    derived = p.withColumn("role", F.when(c("in_table"), "table_text").otherwise("body"))
    return ops.structure_index(part(2), part(1).withColumn("role", F.upper("role")), derived)


add("t15_structure_index", t15, ", chosen AS (SELECT doc_id, paragraph_id, CASE doc_id % 3 WHEN 2 THEN role WHEN 1 THEN upper(role) ELSE CASE WHEN in_table "
    "THEN 'table_text' ELSE 'body' END END AS role, (2 - doc_id % 3)::INTEGER AS source_rank FROM paragraphs) SELECT *, count(*) OVER (PARTITION BY doc_id, role) AS n_role FROM chosen", CTE)


def t16(s, d):
    r = corpus.runs(s, d)
    nodes = r.filter((c("doc_id") + c("paragraph_index")) % 6 != 0)
    return ops.projection_diagnostics(ops.paragraph_records(r), nodes).withColumn("unprojected", _join("unprojected"))


add("t16_projection_diagnostics", t16, """, per AS (SELECT doc_id, paragraph_id, count(*) AS n, count(*) FILTER ((doc_id + paragraph_index) % 6 <> 0) AS h FROM runs GROUP BY ALL)
 SELECT doc_id, coalesce(string_agg(paragraph_id, '|' ORDER BY paragraph_id) FILTER (h = 0), '') AS unprojected, sum(h)::BIGINT AS projected, sum(n)::BIGINT AS structured FROM per
  GROUP BY ALL""", CTE)  # fmt: skip
add("t17_emphasis_index", lambda s, d: ops.emphasis_index(corpus.runs(s, d)), f""", e AS (SELECT *, (CASE WHEN is_bold THEN 2 ELSE 0 END + CASE WHEN is_italic THEN 1 ELSE 0 END + CASE
  WHEN is_underline THEN 1 ELSE 0 END + CASE WHEN highlight_color IS NOT NULL THEN 3 ELSE 0 END)::INTEGER AS strength, {T} AS tt FROM runs),
 f AS (SELECT *, (strength * 100 - least(length(tt), 60) - 2 * paragraph_index)::INTEGER AS priority FROM e WHERE strength > 0),
 g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, paragraph_index, run_index) AS rn FROM f)
 SELECT doc_id, run_id, paragraph_index, run_index, strength, priority, CASE WHEN length(tt) > 80 THEN substr(tt, 1, 77) || '...' ELSE tt END AS preview FROM g WHERE rn <= 24""", CTE)  # fmt: skip


def t18(s, d):
    p = corpus.paragraphs(s, d)
    images = p.filter("n_images > 0").select("doc_id", "paragraph_id", F.explode(F.sequence(F.lit(1), "n_images")).alias("i")).select("doc_id", "paragraph_id", F.lit("image").alias("node_type"), F.lit("").alias("text"))
    return ops.image_evidence(p.select("doc_id", "paragraph_id", F.lit("text").alias("node_type"), "text").unionByName(images))


add("t18_image_evidence", t18, "SELECT doc_id, paragraph_id, n_images::BIGINT AS n_images, n_images > 0 AS has_image, n_images > 0 AND trim(text) = '' AS image_dominant FROM paragraphs", CTE)
BUCKET = "CASE WHEN in_table THEN 'table_text' WHEN role IN ('heading', 'title', 'subtitle', 'list_item', 'body') THEN role ELSE 'unknown' END"
add("t19_bucket_type", lambda s, d: corpus.paragraphs(s, d).select("doc_id", "paragraph_id", st.bucket_type("role", "in_table").alias("bucket")), f"SELECT doc_id, paragraph_id, {BUCKET} AS bucket FROM paragraphs", CTE)
CONTEXT = f""", context AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index) - 1)::INTEGER AS position, count(*) OVER (PARTITION BY doc_id) AS n_paragraphs,
 {BUCKET} AS bucket, n_images > 0 AS has_image, n_images > 0 AND trim(text) = '' AS image_dominant FROM paragraphs)"""
_ctx = ("doc_id", "paragraph_id", "position", "is_first", "is_last", "bucket", "has_image", "image_dominant")


def context(s, d):
    return ops.paragraph_context(corpus.paragraphs(s, d))


add("t20_paragraph_context", lambda s, d: context(s, d).select(*_ctx), CONTEXT + " SELECT doc_id, paragraph_id, position, position = 0 AS is_first, position = n_paragraphs - 1 AS is_last, bucket, has_image, image_dominant "
    "FROM context", CTE)


def t20_runs(s, d):
    show = F.array_join(F.transform("run_styles", lambda x: F.concat_ws("/", F.coalesce(x["font_name"], F.lit("-")), F.coalesce(x["font_size_pt"].cast("string"), F.lit("-")), F.coalesce(x["is_bold"].cast("string"), F.lit("-")))), "|")
    return ops.paragraph_context(corpus.paragraphs(s, d), corpus.runs(s, d)).select("doc_id", "paragraph_id", _join("run_ids").alias("run_ids"), show.alias("run_styles"))


add("t20_paragraph_runs", t20_runs, """, r AS (SELECT doc_id, paragraph_id, string_agg(run_id, '|' ORDER BY run_index) AS run_ids, string_agg(coalesce(font_name, '-') || '/' || coalesce(font_size_pt::VARCHAR, '-') || '/' || coalesce(is_bold::VARCHAR, '-'), '|' ORDER BY run_index) AS run_styles FROM runs GROUP BY ALL)
 SELECT p.doc_id, p.paragraph_id, run_ids, run_styles FROM paragraphs p LEFT JOIN r USING (doc_id, paragraph_id)""", CTE)  # fmt: skip


def t21(s, d):
    show = F.array_join(F.transform("styles", lambda x: F.concat_ws(":", x["style_name"], x["n"].cast("string"))), "|")
    return ops.evidence_summary(context(s, d)).withColumn("styles", show).withColumn("patterns", _join("patterns"))


from .text_queries import PATTERN_SQL  # noqa: E402

add("t21_evidence_summary", t21, CONTEXT + f""", h AS (SELECT doc_id, string_agg(style_name || ':' || n, '|' ORDER BY style_name) AS styles FROM (SELECT doc_id, style_name, count(*) AS n
  FROM paragraphs GROUP BY ALL) GROUP BY ALL),
 g AS (SELECT doc_id, count(*) FILTER (in_table) AS n_table, sum(n_images)::BIGINT AS n_images, count(*) FILTER (has_image) AS n_image_paragraphs, count(*) FILTER (image_dominant) AS n_image_dominant,
 array_to_string(list_sort(list_distinct(list({PATTERN_SQL}))), '|') AS patterns FROM context GROUP BY ALL)
 SELECT * FROM g JOIN h USING (doc_id)""", CTE)  # fmt: skip
add("t22_observation_summary", lambda s, d: ops.observation_summary(context(s, d)), CONTEXT + f""" SELECT doc_id, paragraph_id, role, CASE
  WHEN length({T}) > 120 THEN substr({T}, 1, 117) || '...' ELSE {T} END AS excerpt,
 count(*) FILTER (in_table) OVER w AS n_table, count(*) FILTER (has_image) OVER w AS n_image_paragraphs FROM context WINDOW w AS (PARTITION BY doc_id)""", CTE)  # fmt: skip
add("t23_structure_samples", lambda s, d: ops.structure_samples(corpus.paragraphs(s, d)).select("doc_id", "paragraph_id", "role", "n_role", "place"), "SELECT * "
    "FROM (SELECT doc_id, paragraph_id, role, count(*) OVER (PARTITION BY doc_id, role) AS n_role, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index)::INTEGER AS place FROM paragraphs) WHERE place <= 20", CTE)
add("t23_block_samples", lambda s, d: ops.block_samples(t1(s, d)).select("doc_id", "node_type", "anchor", "place"), """, blocks AS (SELECT doc_id, paragraph_index AS seq, CASE
  WHEN in_table THEN 'table' WHEN (doc_id + paragraph_index) % 15 = 0 THEN 'section_break' ELSE 'paragraph' END AS node_type FROM paragraphs),
 placed AS (SELECT *, 'body/' || node_type || '[' || (row_number() OVER (PARTITION BY doc_id, node_type ORDER BY seq) - 1) || ']' AS anchor, row_number() OVER (PARTITION BY doc_id ORDER BY seq)::INTEGER AS place FROM blocks)
 SELECT doc_id, node_type, anchor, place FROM placed WHERE place <= 6""", CTE)
add("t24_inspect_count", lambda s, d: ops.inspect_count(ops.project_nodes(corpus.runs(s, d))), "SELECT doc_id, count(*) AS n_nodes FROM runs WHERE trim(text) <> '' GROUP BY ALL", CTE)

# ---------------------------------------------------------------- selection


def nodes(s, d):
    """Writable nodes: a paragraph in eight has none."""
    return ops.project_nodes(corpus.runs(s, d)).filter((c("doc_id") + c("paragraph_index")) % 8 != 0)


NODES = ", nodes AS (SELECT * FROM runs WHERE trim(text) <> '' AND (doc_id + paragraph_index) % 8 <> 0)"


def j1(s, d):
    p, n = corpus.paragraphs(s, d), nodes(s, d)
    parts = [sel.select_targets(p, n, scope, level).withColumn("scope", F.lit(scope)) for scope, level in (("body", None), ("heading", 2), ("list_item", None))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


add("j1_select_scope", j1, NODES + " SELECT n.doc_id, n.paragraph_id, n.run_id, p.role AS scope FROM nodes n JOIN paragraphs p USING (doc_id, paragraph_id) WHERE p.role IN ('body', 'list_item') OR (p.role = 'heading' "
    "AND p.heading_level = 2)", CTE)
add("j2_select_all_text", lambda s, d: sel.select_all_text(nodes(s, d)), NODES + " SELECT doc_id, NULL::VARCHAR AS paragraph_id, run_id FROM nodes", CTE)


def wanted(s, d):
    docs = corpus.table(s, d, "documents").select("doc_id", F.posexplode(F.array(F.lit("p_3"), F.lit("p_0"), F.lit("p_999"), F.lit("p_3"))).alias("place", "paragraph_id"))
    return docs


WANTED = ", wanted AS (SELECT doc_id, i::INTEGER AS place, ['p_3', 'p_0', 'p_999', 'p_3'][i + 1] AS paragraph_id FROM documents, range(4) t(i))"
add("j3_select_paragraph_ids", lambda s, d: sel.select_ids(corpus.paragraphs(s, d), wanted(s, d), "paragraph_id"), WANTED + " SELECT doc_id, paragraph_id, min(place) AS place, bool_or(EXISTS (SELECT 1 FROM paragraphs p "
    "WHERE p.doc_id = w.doc_id AND p.paragraph_id = w.paragraph_id)) AS found FROM wanted w GROUP BY ALL", CTE)
add("j4_select_node_ids", lambda s, d: sel.node_owners(nodes(s, d), wanted(s, d).select("doc_id", "place", F.concat("paragraph_id", F.lit("_r_0")).alias("run_id"))),
    NODES + WANTED + ", once AS (SELECT doc_id, paragraph_id || '_r_0' AS run_id, min(place) AS place FROM wanted GROUP BY ALL) SELECT o.doc_id, o.run_id, o.place, n.run_id IS NOT NULL AS found, n.paragraph_id FROM once o LEFT "
        "JOIN nodes n ON n.doc_id = o.doc_id AND n.run_id = o.run_id", CTE)


def j5(s, d):
    r = corpus.runs(s, d)
    return sel.select_patch_targets(r.select("doc_id", F.concat(F.lit("target:block:"), "paragraph_id").alias("target_id"), F.when(c("paragraph_index") % 3 != 0, "word/document.xml").otherwise("").alias("part_path")))


add("j5_select_patch_targets", j5, "SELECT DISTINCT doc_id, 'target:block:' || paragraph_id AS target_id, 'word/document.xml' AS part_path FROM runs WHERE paragraph_index % 3 <> 0", CTE)
add("j6_writable_split", lambda s, d: sel.writable_split(corpus.paragraphs(s, d).filter("role = 'body'").select("doc_id", "paragraph_id"), nodes(s, d)), NODES + ", w AS (SELECT DISTINCT doc_id, paragraph_id FROM nodes) "
    "SELECT p.doc_id, p.paragraph_id, w.doc_id IS NOT NULL AS writable, CASE WHEN w.doc_id IS NULL THEN 'no_writable_runs' END AS skip_reason FROM paragraphs p LEFT JOIN w ON w.doc_id = p.doc_id AND w.paragraph_id = p.paragraph_id "
        "WHERE role = 'body'", CTE)


def j7(s, d):
    p = corpus.paragraphs(s, d).join(nodes(s, d).select("doc_id", "paragraph_id").distinct().withColumn("w", F.lit(1)), ["doc_id", "paragraph_id"], "left")
    g = p.groupBy("doc_id", "role").agg(F.count("*").alias("n_matched"), F.count("w").alias("n_writable"), F.count_if(c("paragraph_index") > 60).alias("n_missing_paragraphs"), F.lit(0).cast("long").alias("n_missing_nodes"))
    g = g.withColumn("n_patch_targets", F.when(c("role") == "subtitle", c("n_writable")))
    return sel.target_status(g.withColumn("op_type", F.when(c("role") == "title", "set_page_layout").otherwise("set_font"))).select("doc_id", "role", "error")


add("j7_target_status", j7, NODES + """, w AS (SELECT DISTINCT doc_id, paragraph_id FROM nodes),
 g AS (SELECT p.doc_id, p.role, count(*) AS m, count(w.doc_id) AS n, count(*) FILTER (paragraph_index > 60) AS x FROM paragraphs p LEFT JOIN w ON w.doc_id = p.doc_id
  AND w.paragraph_id = p.paragraph_id GROUP BY ALL)
 SELECT doc_id, role, CASE WHEN role = 'title' THEN NULL WHEN role = 'subtitle' THEN CASE WHEN n = 0 THEN 'E_PATCH_TARGETS_EMPTY' END WHEN x > 0 THEN 'E_PARAGRAPH_TARGETS_MISSING'
  WHEN n = 0 THEN 'E_SELECTOR_TARGETS_EMPTY' END AS error FROM g""", CTE)  # fmt: skip
_PART = lambda: F.when(c("part_kind") != "main_document", F.concat(F.lit("word/"), "part_kind", F.lit(".xml"))).alias("part_path")
add("j8_part_paths", lambda s, d: sel.part_paths(nodes(s, d), corpus.paragraphs(s, d).select("doc_id", "paragraph_id", _PART())), NODES + " SELECT DISTINCT n.doc_id, CASE WHEN part_kind = 'main_document' "
    "THEN 'word/document.xml' ELSE 'word/' || part_kind || '.xml' END AS part_path FROM nodes n JOIN paragraphs p USING (doc_id, paragraph_id)", CTE)
_INTENTS = [("op1", "set_font", "body"), ("op2", "merge_paragraph", "heading"), ("op3", "split_paragraph", "list_item")]


def intents(s, d):
    rows = F.array(*[F.struct(F.lit(a).alias("op_id"), F.lit(b).alias("op_type"), F.lit(x).alias("scope")) for a, b, x in _INTENTS])
    return corpus.table(s, d, "documents").select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.*")


def scoped(s, d):
    return nodes(s, d).join(corpus.paragraphs(s, d).select("doc_id", "paragraph_id", c("role").alias("scope")), ["doc_id", "paragraph_id"]).select("doc_id", "scope", "paragraph_index", "run_index", "run_id")


INTENTS = ", intents(op_id, op_type, scope) AS (VALUES " + ", ".join(map(str, _INTENTS)) + "), scoped AS (SELECT n.*, p.role AS scope FROM nodes n JOIN paragraphs p USING (doc_id, paragraph_id))"
BOUND = """, bound AS (SELECT doc_id, op_id, op_type, CASE WHEN op_type IN ('merge_paragraph', 'split_paragraph') THEN row_number() OVER (PARTITION BY doc_id, op_id ORDER BY paragraph_index, run_index) ELSE 0 END AS n, paragraph_index, run_index, run_id FROM scoped JOIN intents USING (scope)),
 ops AS (SELECT doc_id, op_id || CASE WHEN n > 0 THEN '__' || n ELSE '' END AS op_id, op_type, string_agg(run_id, '|' ORDER BY paragraph_index, run_index) AS target_ids FROM bound
  GROUP BY doc_id, op_id, op_type, n)"""
add("j9_bind_intents", lambda s, d: sel.bind_intents(intents(s, d), scoped(s, d)).withColumn("target_ids", _join("target_ids")), NODES + INTENTS + BOUND + " SELECT * FROM ops", CTE)


def j10(s, d):
    p = corpus.paragraphs(s, d)
    k = c("doc_id") + c("paragraph_index")
    o = p.select("doc_id", "paragraph_id", F.when(k % 4 == 0, "body").alias("scope"), F.when(k % 4 <= 1, F.array(F.lit("t"))).otherwise(F.array()).alias("patch_target_ids"), F.when(k % 4 <= 2,
        F.array("paragraph_id")).otherwise(F.array()).alias("node_ids"))
    return sel.operation_to_intent(o).select("doc_id", "paragraph_id", "target_kind")


add("j10_operation_to_intent", j10, "SELECT doc_id, paragraph_id, CASE (doc_id + paragraph_index) % 4 WHEN 0 THEN 'selector' WHEN 1 THEN 'patch_targets' WHEN 2 THEN 'node_ids' ELSE 'none' END AS target_kind FROM paragraphs", CTE)


def j11(s, d):
    bound = scoped(s, d).join(intents(s, d).drop("op_type"), ["doc_id", "scope"]).select("doc_id", "op_id", (c("paragraph_index") * 10000 + c("run_index")).alias("bound_seq"), "run_id")
    steps = intents(s, d).select("doc_id", "op_id", F.concat(F.lit("step-"), "op_id").alias("step_id"), F.concat(F.lit("key-"), "op_id").alias("idempotency_key"))
    return sel.expand_plan(steps, bound).select("doc_id", "step_id", "idempotency_key", "run_id")


add("j11_expand_plan", j11, NODES + INTENTS + """, e AS (SELECT doc_id, op_id, run_id, row_number() OVER (PARTITION BY doc_id, op_id ORDER BY paragraph_index * 10000 + run_index) AS n, count(*) OVER (PARTITION BY doc_id, op_id) AS m FROM scoped JOIN intents USING (scope))
 SELECT doc_id, 'step-' || op_id || CASE WHEN m > 1 THEN '__' || n ELSE '' END AS step_id, 'key-' || op_id || CASE WHEN m > 1 THEN '__' || n ELSE '' END AS idempotency_key, run_id
  FROM e""", CTE)  # fmt: skip


def j12(s, d):
    p, n = corpus.paragraphs(s, d), nodes(s, d)
    observed = p.filter("paragraph_index % 2 = 0").select("doc_id", F.concat(F.lit("target:block:"), "paragraph_id").alias("target_id"), F.lit("block").alias("kind"))
    return sel.patch_target_index(observed, p, n)


add("j12_patch_target_index", j12, NODES + " SELECT doc_id, 'target:block:' || paragraph_id AS target_id, 'block' AS kind, paragraph_index % 2 = 0 AS observed FROM paragraphs UNION ALL "
    "SELECT doc_id, 'target:inline:' || run_id, 'inline', false FROM nodes", CTE)


def j13(s, d):
    r = corpus.runs(s, d)
    a = F.when(c("run_index") % 2 == 0, "paragraph_alignment").otherwise("font_name")
    return sel.coerce_to_block(r.select("doc_id", "paragraph_id", "run_id", a.alias("attribute"), (c("run_index") % 5).cast("string").alias("value"), c("run_index").alias("seq")))


add("j13_coerce_to_block", j13, "SELECT doc_id, CASE WHEN run_index % 2 = 0 THEN 'target:block:' || paragraph_id ELSE 'target:inline:' || run_id END AS target_id, CASE WHEN run_index % 2 = 0 "
    "THEN 'paragraph_alignment' ELSE 'font_name' END AS attribute, arg_max((run_index % 5)::VARCHAR, run_index) AS value FROM runs GROUP BY 1, 2, 3", CTE)
_IDS = ["target:style:Body", "target:docDefaults", "target:numbering:3", "target:settings:updateFields", "target:inline:p_0"]
add(
    "j14_synthetic_targets", lambda s, d: sel.synthetic_targets(corpus.table(s, d, "documents").select("doc_id", F.explode(F.array(*map(F.lit, _IDS))).alias("target_id"))),
    f"WITH t AS (SELECT doc_id, unnest({_IDS}) AS target_id FROM documents) SELECT doc_id, target_id, CASE WHEN target_id LIKE 'target:style:%' OR target_id = 'target:docDefaults' THEN 'word/styles.xml' "
        f"WHEN target_id LIKE 'target:numbering:%' THEN 'word/numbering.xml' ELSE 'word/settings.xml' END AS part_path, nullif(regexp_extract(target_id, '^target:[a-zA-Z]+:(.*)$', 1), '') AS key FROM t "
            f"WHERE target_id NOT LIKE 'target:inline:%'",
)
_FOUND = lambda: F.concat(F.lit("p_"), ((c("doc_id") + c("place")) % 30).cast("string"), F.lit("_r_"), c("place").cast("string"))
add(
    "j16_locate_node_ids", lambda s, d: sel.locate_node_ids(corpus.table(s, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("place")).select("doc_id", _FOUND().alias("run_id")), corpus.runs(s, d)),
    ", a AS (SELECT doc_id, (doc_id + i) % 30 AS p, i AS r FROM documents, range(4) t(i)), b AS (SELECT doc_id, 'p_' || p || '_r_' || r AS run_id, p::INTEGER AS p, r::INTEGER AS r FROM a) SELECT b.*, x.run_id IS NOT NULL AS found FROM b "
        "LEFT JOIN runs x ON x.doc_id = b.doc_id AND x.run_id = b.run_id", CTE,
)
add("j17_role_bind_check", lambda s, d: sel.role_bind_check(intents(s, d).select("doc_id", "scope"), ops.role_counts(corpus.paragraphs(s, d))), NODES + INTENTS + " SELECT doc_id, i.scope, EXISTS (SELECT 1 FROM paragraphs p "
    "WHERE p.doc_id = t.doc_id AND p.role = i.scope) AS binds FROM documents t, intents i", CTE)

# ---------------------------------------------------------------- writes

_PAYLOADS = [("set_font", " SimSun "), ("set_size", "12.5"), ("set_size", "-1"), ("set_bold", "TRUE"), ("set_bold", "maybe"), ("set_font_color", "#a0b1c2"), ("set_highlight_color", "Dark Blue"), ("set_highlight_color", "mauve"),
    ("split_paragraph", "5"), ("split_paragraph", "0"), ("set_table_style", "x"), ("merge_paragraph", None), ("set_alignment", "  "), ("set_page_layout", "a4"), ("set_page_layout", "A3"), ("set_style_definition", '{"font":"x"}'),
        ("set_numbering_level", "{}"), ("set_settings_flag", '{"on":1}'), ("set_attr", " w:val "), ("remove_attr", ""), ("remove_node", None), ("ensure_node", "w:p"), ("replace_node_xml", "<w:p/>"), ("set_line_spacing", "1.5"),
            ("set_line_spacing", "0"), ("set_line_spacing", '{"mode":"exact","pt":20}'), ("set_line_spacing", '{"mode":"exact"}')]
_RESULTS = [("font_name", "SimSun"), ("font_size_pt", "12.5"), ("font_size_pt", None), ("is_bold", "true"), ("is_bold", None), ("font_color", "A0B1C2"), ("highlight_color", "darkBlue"), ("highlight_color", None), ("split_offset", "5"),
    ("split_offset", None), (None, None), ("merge", "next"), ("paragraph_alignment", None), ("paper_size", "A4"), ("paper_size", None), ("style_definition", '{"font":"x"}'), ("numbering_level", None), ("settings_flag", '{"on":1}'),
        ("attr", "w:val"), ("removed_attr", None), ("removed_node", ""), ("tag", "w:p"), ("xml", "<w:p/>"), ("line_spacing", "1.5"), ("line_spacing", None), ("line_spacing", "exact:20.0"), ("line_spacing", None)]


def w1(s, d):
    rows = F.array(*[F.struct(F.lit(a).alias("type"), F.lit(b).cast("string").alias("payload")) for a, b in _PAYLOADS])
    i = corpus.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(rows, (c("l_partkey") % len(_PAYLOADS) + 1).cast("int")).alias("x"))
    return wr.normalize_payload(i.select("l_orderkey", "l_linenumber", "x.*")).drop("payload")


_q = lambda v: "NULL" if v is None else f"'{v}'"
add("w1_normalize_payload", w1, f"WITH v(i, type, attribute, value) AS (VALUES {', '.join(f'({i}, {_q(a)}, {_q(r[0])}, {_q(r[1])})' for i, ((a, _), r) in enumerate(zip(_PAYLOADS, _RESULTS)))}) "
    f"SELECT l_orderkey, l_linenumber, type, attribute, value, CASE WHEN type = 'set_table_style' THEN 'set_table_style: unsupported operation' WHEN value IS NULL THEN type || ': invalid payload' END AS error FROM lineitem "
        f"JOIN v ON v.i = l_partkey % {len(_PAYLOADS)}")
CANON = f"""CASE attribute WHEN 'font_size_pt' THEN CASE WHEN try_cast(value AS DOUBLE) > 0 THEN try_cast(value AS DOUBLE)::VARCHAR END WHEN 'is_bold' THEN CASE WHEN value = 'true' THEN 'true' END
 WHEN 'font_color' THEN upper(replace(value, '#', '')) WHEN 'highlight_color' THEN CASE WHEN value = 'Yellow' THEN 'yellow' END ELSE value END"""
ATTRS = ("font_name", "font_size_pt", "font_color", "is_bold", "highlight_color")


def folded(s, d):
    w = corpus.write_ops(s, d).withColumn("value", wr.canonical_value("attribute", "value"))
    blank = corpus.table(s, d, "orders").select(c("o_orderkey").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("run_no"))
    m = c("doc_id") + c("run_no")
    base = blank.select("doc_id", "run_no", F.when(m % 3 == 0, "Base").alias("font_name"), F.lit(11.0).alias("font_size_pt"), F.lit(None).cast("string").alias("font_color"), F.when(m % 4 == 0, False).alias("is_bold"),
        F.lit(None).cast("string").alias("highlight_color"))
    return base, wr.apply_style_ops(base, w, ATTRS, ("doc_id", "run_no"))


_last = lambda a: f"arg_max(value, seq) FILTER (attribute = '{a}' AND value IS NOT NULL)"
FOLD = f"""{views.OPS}, canon AS (SELECT doc_id, seq, run_no, attribute, {CANON} AS value FROM ops),
 new AS (SELECT doc_id, run_no, {', '.join(f'{_last(a)} AS {a}' for a in ATTRS)} FROM canon GROUP BY ALL),
 base AS (SELECT o_orderkey AS doc_id, i::INTEGER AS run_no, CASE WHEN (o_orderkey + i) % 3 = 0 THEN 'Base' END AS font_name, 11.0::DOUBLE AS font_size_pt, CASE
  WHEN (o_orderkey + i) % 4 = 0 THEN false END AS is_bold FROM orders, range(8) t(i)),
 styled AS (SELECT doc_id, run_no, coalesce(n.font_name, b.font_name) AS font_name, coalesce(n.font_size_pt::DOUBLE, b.font_size_pt) AS font_size_pt, n.font_color, coalesce(n.is_bold::BOOLEAN, b.is_bold) AS is_bold, n.highlight_color, b.font_name AS f0, b.font_size_pt AS s0, b.is_bold AS b0 FROM base b LEFT JOIN new n USING (doc_id, run_no))"""
add("w2_apply_style_ops", lambda s, d: folded(s, d)[1], "SELECT doc_id, run_no, font_name, font_size_pt, font_color, is_bold, highlight_color FROM styled", FOLD)


def w2_written_by(s, d):
    base, _ = folded(s, d)
    w = corpus.write_ops(s, d).withColumn("value", wr.canonical_value("attribute", "value"))
    out = wr.apply_style_ops(base, w.withColumn("op_type", F.concat(F.lit("set_"), "attribute", F.lit("_"), (c("seq") % 3).cast("string"))), ATTRS, ("doc_id", "run_no"))
    show = F.array_join(F.array_sort(F.transform(F.map_entries("written_by"), lambda e: F.concat_ws("=", e["key"], e["value"]))), "|")
    return out.select("doc_id", "run_no", show.alias("written_by"))


_by = lambda a: f"'{a}=set_{a}_' || arg_max(seq % 3, seq) FILTER (attribute = '{a}' AND value IS NOT NULL)"
add("w2_written_by", w2_written_by, f""", o AS (SELECT doc_id, run_no, concat_ws('|', {', '.join(_by(a) for a in sorted(ATTRS))}) AS w FROM canon GROUP BY ALL)
 SELECT b.doc_id, b.run_no, coalesce(w, '') AS written_by FROM base b LEFT JOIN o USING (doc_id, run_no)""", FOLD)


def w3(s, d):
    r = corpus.runs(s, d).select("doc_id", "run_id", "font_name", "font_size_pt")
    given = r.filter(F.xxhash64("doc_id").isNotNull() & (c("doc_id") % 2 == 0)).select("doc_id", "run_id", F.lit("New").alias("font_name"), F.lit(None).cast("double").alias("font_size_pt"))
    bad = corpus.table(s, d, "documents").filter("doc_id % 10 = 0").select("doc_id", F.lit("p_x").alias("run_id"), F.lit("New").alias("font_name"), F.lit(1.0).alias("font_size_pt"))
    return wr.apply_style_map(r, given.unionByName(bad), ("font_name", "font_size_pt"))


add("w3_apply_style_map", w3, "SELECT doc_id, run_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 10 <> 0 THEN 'New' ELSE font_name END AS font_name, font_size_pt, doc_id % 10 = 0 AS failed FROM runs", CTE)
_AL = ["left", "Center", "middle", "BOTH"]
add(
    "w4_valid_attributes",
    lambda s, d: wr.valid_attributes(corpus.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (c("l_quantity") - 10).alias("font_size_pt"), (c("l_quantity") - 20).alias("space_before_pt"), F.element_at(F.array(*map(F.lit, _AL)),
        (c("l_partkey") % 4 + 1).cast("int")).alias("paragraph_alignment"))),
    f"SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 10 THEN l_quantity - 10 END AS font_size_pt, CASE WHEN l_quantity >= 20 THEN l_quantity - 20 END AS space_before_pt, CASE WHEN l_partkey % 4 <> 2 "
        f"THEN lower({_AL}[l_partkey % 4 + 1]) END AS paragraph_alignment FROM lineitem",
)


_FIELDS = ["paper_size", *wr.LAYOUT]


def w5(s, d):
    i = corpus.table(s, d, "lineitem")
    f = F.element_at(F.array(*map(F.lit, _FIELDS)), (c("l_linenumber") % 5 + 1).cast("int"))
    v = F.when(f == "paper_size", F.element_at(F.array(*map(F.lit, ["a4", "Letter", "A3"])), (c("l_partkey") % 3 + 1).cast("int"))).otherwise((c("l_quantity") - 25).cast("string"))
    docs = corpus.table(s, d, "orders").select(c("o_orderkey").alias("doc_id"), F.lit("A5").alias("paper_size"), *[F.lit(2.5).alias(m) for m in wr.LAYOUT])
    return wr.page_layout(docs, i.select(c("l_orderkey").alias("doc_id"), corpus.SEQ().alias("seq"), f.alias("field"), v.alias("value")))


add("w5_page_layout", w5, f"""WITH o AS (SELECT l_orderkey AS doc_id, arg_max(['A4', 'Letter', NULL][l_partkey % 3 + 1], {views.SEQ}) FILTER (l_linenumber % 5 = 0 AND l_partkey % 3 < 2) AS p,
 {', '.join(f"arg_max(l_quantity - 25, {views.SEQ}) FILTER (l_linenumber % 5 = {i} AND l_quantity > 25) AS m{i}" for i in range(1, 5))} FROM lineitem GROUP BY ALL)
 SELECT o_orderkey AS doc_id, coalesce(p, 'A5') AS paper_size, {', '.join(f'coalesce(m{i}, 2.5)::DOUBLE AS {m}' for i, m in enumerate(wr.LAYOUT, 1))} FROM orders LEFT
  JOIN o ON o.doc_id = o_orderkey""")  # fmt: skip
add("w6_merge_paragraphs", lambda s, d: wr.merge_paragraphs(corpus.paragraphs(s, d), corpus.paragraphs(s, d).filter("role = 'heading'")),
    """, m AS (SELECT *, role = 'heading' AS named, lead(paragraph_id) OVER w IS NULL AS is_last, CASE WHEN lag(role) OVER w = 'heading' THEN 0 ELSE 1 END AS st FROM paragraphs WINDOW w AS (PARTITION BY doc_id ORDER BY paragraph_index)),
 g AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY paragraph_index) - 1 AS paragraph_no FROM m)
 SELECT doc_id, paragraph_no::BIGINT AS paragraph_no, arg_min(paragraph_id, paragraph_index) AS paragraph_id, string_agg(text, '' ORDER BY paragraph_index) AS text, max(CASE WHEN named
  AND is_last THEN 'E_NO_NEXT_PARAGRAPH' END) AS error FROM g GROUP BY doc_id, paragraph_no""", CTE)  # fmt: skip
add("w6_merge_runs", lambda s, d: wr.merge_runs(corpus.paragraphs(s, d), corpus.runs(s, d), corpus.paragraphs(s, d).filter("role = 'heading'")).select("doc_id", "paragraph_no", "run_no", "run_id", "source_run_id", "text", "font_name"),
""", m AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY doc_id ORDER BY paragraph_index) = 'heading' THEN 0 ELSE 1 END AS st FROM paragraphs),
 g AS (SELECT doc_id, paragraph_id, (sum(st) OVER (PARTITION BY doc_id ORDER BY paragraph_index) - 1)::BIGINT AS paragraph_no FROM m),
 r AS (SELECT r.*, paragraph_no, (row_number() OVER (PARTITION BY r.doc_id, paragraph_no ORDER BY paragraph_index, run_index) - 1)::INTEGER AS run_no FROM runs r JOIN g USING (doc_id, paragraph_id))
 SELECT doc_id, paragraph_no, run_no, 'p_' || paragraph_no || '_r_' || run_no AS run_id, run_id AS source_run_id, text, font_name FROM r""", CTE)  # fmt: skip
add("w7_split_paragraphs", lambda s, d: wr.split_paragraphs(corpus.runs(s, d), corpus.runs(s, d).filter("run_index = 1 "
    "AND paragraph_index % 3 = 0").select("doc_id", "run_id", F.lit(5).alias("split_offset"))), """, x AS (SELECT *, run_index = 1 AND paragraph_index % 3 = 0 AND length(text) > 5 AS cut FROM runs),
 y AS (SELECT doc_id, paragraph_index, run_index, 0 AS part, CASE WHEN cut THEN substr(text, 1, 5) ELSE text END AS text FROM x UNION ALL SELECT doc_id, paragraph_index, run_index, 1, substr(text, 6)
  FROM x WHERE cut),
 z AS (SELECT *, CASE WHEN part = 1 OR lag(paragraph_index) OVER w IS DISTINCT FROM paragraph_index THEN 1 ELSE 0 END AS fresh
  FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY paragraph_index, run_index, part)),
 n AS (SELECT *, (sum(fresh) OVER (PARTITION BY doc_id ORDER BY paragraph_index, run_index, part) - 1)::BIGINT AS paragraph_no FROM z),
 r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, paragraph_no ORDER BY run_index, part) - 1)::INTEGER AS run_no FROM n)
 SELECT doc_id, paragraph_no, run_no, text, 'p_' || paragraph_no || '_r_' || run_no AS run_id FROM r""", CTE)  # fmt: skip
_MIXED = lambda: F.concat(F.lit("这是"), "text", F.lit(",模型2025报告"))
MIXED = "mixed AS (SELECT doc_id, run_id, paragraph_id, font_name, '这是' || text || ',模型2025报告' AS text FROM runs)"
_kind = "CASE WHEN regexp_matches(ch, '\\p{Han}') THEN 'zh' WHEN regexp_matches(ch, '[\\p{Latin}\\p{Nd}]') THEN 'en' WHEN regexp_matches(ch, '\\p{P}') THEN 'punct' ELSE 'other' END"
add("w8_split_language", lambda s, d: wr.split_language(corpus.runs(s, d).withColumn("text", _MIXED())).select("doc_id", "run_id", "font_name", "seg", "language", "text", "segment_id"),
    f""", {MIXED}, ch AS (SELECT doc_id, run_id, font_name, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS pos FROM mixed),
 k AS (SELECT *, {_kind} AS kind FROM ch WHERE ch <> ''),
 b AS (SELECT *, last_value(CASE WHEN kind <> 'punct' THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id, run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bef,
 first_value(CASE WHEN kind <> 'punct' THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id, run_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM k),
 l AS (SELECT *, CASE WHEN kind IN ('zh', 'en') THEN kind WHEN kind = 'punct' THEN CASE WHEN after IN ('zh', 'en') THEN after
  WHEN bef IN ('zh', 'en') THEN bef ELSE 'unknown' END ELSE 'unknown' END AS language FROM b),
 g AS (SELECT *, CASE WHEN lag(language) OVER (PARTITION BY doc_id, run_id ORDER BY pos) = language THEN 0 ELSE 1 END AS st FROM l),
 h AS (SELECT *, (sum(st) OVER (PARTITION BY doc_id, run_id ORDER BY pos) - 1)::INTEGER AS seg FROM g)
 SELECT doc_id, run_id, any_value(font_name) AS font_name, seg, language, string_agg(ch, '' ORDER BY pos) AS text, run_id || '__seg_' || seg AS segment_id FROM h
  GROUP BY doc_id, run_id, seg, language""", CTE)  # fmt: skip


def w9(s, d):
    p = corpus.paragraphs(s, d).filter("role = 'body'")
    plan = p.select("doc_id", "paragraph_id", c("role").alias("semantic_key"), F.explode(F.create_map(F.lit("zh"), F.lit("SimSun"), F.lit("en"), F.lit("Arial"))).alias("language", "font_name"))
    r = corpus.runs(s, d).withColumn("text", F.when(c("run_index") % 2 == 0, F.lit("报告")).otherwise(c("text")))
    return wr.language_font_ops(plan, r).withColumn("target_ids", _join("target_ids"))


add("w9_language_font_ops", w9, """, r AS (SELECT doc_id, paragraph_id, run_id, CASE WHEN run_index % 2 = 0 THEN 'zh' WHEN regexp_matches(text, '[\\p{Latin}\\p{Nd}]')
  AND NOT regexp_matches(text, '\\p{Han}') THEN 'en' WHEN regexp_matches(text, '\\p{Han}') AND NOT regexp_matches(text, '[\\p{Latin}\\p{Nd}]') THEN 'zh' END AS language FROM runs)
 SELECT doc_id, role AS semantic_key, language, CASE language WHEN 'zh' THEN 'SimSun' ELSE 'Arial' END AS font_name, array_to_string(list_sort(list(run_id)), '|') AS target_ids FROM r
  JOIN paragraphs USING (doc_id, paragraph_id) WHERE role = 'body' AND language IS NOT NULL GROUP BY ALL""", CTE)  # fmt: skip


def w10(s, d):
    r = corpus.runs(s, d)
    want = r.select("doc_id", F.concat("run_id", F.lit("__n")).alias("node_id"), "text", F.when(c("run_index") % 4 == 3, "gone").otherwise(c("run_id")).alias("source_run_id"))
    return wr.rebuild_runs(want, r)


add("w10_rebuild_runs", w10, "SELECT doc_id, run_id || '__n' AS node_id, text, CASE WHEN run_index % 4 = 3 THEN 'gone' ELSE run_id END AS source_run_id, CASE WHEN run_index % 4 <> 3 THEN font_name END AS font_name, CASE "
    "WHEN run_index % 4 <> 3 THEN font_size_pt END AS font_size_pt, CASE WHEN run_index % 4 = 3 THEN 'E_SOURCE_RUN_MISSING' END AS error FROM runs", CTE)


def w11(s, d):
    o = intents(s, d).select("doc_id", "op_id", "scope", F.create_map(F.lit("font_name"), F.lit("Arial"), F.lit("is_bold"), F.lit("true")).alias("attributes"))
    t = scoped(s, d).select("doc_id", "scope", F.concat(F.lit("target:inline:"), "run_id").alias("target_id"))
    return wr.compile_patches(o, t)


COMPILED = """, rows AS (SELECT doc_id, op_id, 'target:inline:' || run_id AS target_id, name, value FROM scoped
  JOIN intents USING (scope), (VALUES ('font_name', 'Arial'), ('is_bold', 'true')) v(name, value))
 SELECT *, op_id || ':patch:' || (row_number() OVER (PARTITION BY doc_id, op_id ORDER BY target_id, name) - 1) AS patch_id FROM rows"""
add("w11_compile_patches", w11, NODES + INTENTS + COMPILED, CTE)


def w12(s, d):
    r = corpus.runs(s, d).select("doc_id", "paragraph_id", "run_id", "paragraph_index", "run_index", "font_name", "font_color")
    block = r.filter("paragraph_index % 4 = 0 AND run_index = 0").select("doc_id", F.concat(F.lit("target:block:"), "paragraph_id").alias("target_id"), F.lit("font_name").alias("attribute"), F.lit("Block").alias("value"),
        F.lit(1).alias("seq"))
    inline = r.filter("run_index = 1").select("doc_id", F.concat(F.lit("target:inline:"), "run_id").alias("target_id"), F.lit("font_name").alias("attribute"), F.lit("Inline").alias("value"), F.lit(2).alias("seq"))
    return wr.apply_patches(r, block.unionByName(inline), ("font_name", "font_color")).select("doc_id", "run_id", "font_name", "font_color")


add("w12_apply_patches", w12, ", b AS (SELECT DISTINCT doc_id, paragraph_id FROM runs WHERE paragraph_index % 4 = 0 AND run_index = 0) SELECT r.doc_id, r.run_id, CASE WHEN run_index = 1 THEN 'Inline' WHEN b.doc_id IS NOT NULL "
    "THEN 'Block' ELSE font_name END AS font_name, font_color FROM runs r LEFT JOIN b ON b.doc_id = r.doc_id AND b.paragraph_id = r.paragraph_id", CTE)


def w12_section(s, d):
    k = c("o_orderkey")
    field = F.element_at(F.array(*map(F.lit, _FIELDS)), (k % 5 + 1).cast("int"))
    value = F.when(k % 5 == 0, "letter").otherwise((k % 7 - 2).cast("string"))
    target = F.when(k % 3 == 0, F.lit("target:inline:p_0_r_0")).otherwise(wr.SECTION_TARGET)
    docs = corpus.table(s, d, "orders").select(k.alias("doc_id"), F.lit("A5").alias("paper_size"), *[F.lit(2.5).alias(m) for m in wr.LAYOUT])
    return wr.apply_section_patches(docs, corpus.table(s, d, "orders").select(k.alias("doc_id"), target.alias("target_id"), field.alias("attribute"), value.alias("value"), F.lit(1).alias("seq")))


add("w12_section_patches", w12_section, "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0 "
    "THEN 'Letter' ELSE 'A5' END AS paper_size, " + ", ".join(f"CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 = {i} AND o_orderkey % 7 > 2 "
        f"THEN (o_orderkey % 7 - 2)::DOUBLE ELSE 2.5 END AS {m}" for i, m in enumerate(wr.LAYOUT, 1)) + " FROM orders")


def w12_unknown(s, d):
    r = corpus.runs(s, d)
    kinds = F.array(F.lit("inline"), F.lit("block"), F.lit("section"), F.lit("cell"))
    kind = F.element_at(kinds, (c("paragraph_index") % 4 + 1).cast("int"))
    key = F.when(kind == "block", c("paragraph_id")).when(kind == "section", F.lit("document")).otherwise(F.when(c("doc_id") % 2 == 0, c("run_id")).otherwise("gone"))
    return wr.unknown_targets(r, r.select("doc_id", F.concat_ws(":", F.lit("target"), kind, key).alias("target_id"), "run_id"))


add("w12_unknown_targets", w12_unknown, "SELECT doc_id, 'target:' || CASE paragraph_index % 4 WHEN 0 THEN 'inline' ELSE 'cell' END || ':' || CASE WHEN doc_id % 2 = 0 "
    "THEN run_id ELSE 'gone' END AS target_id, run_id, 'E_PATCH_TARGET_NOT_FOUND' AS error FROM runs WHERE paragraph_index % 4 = 3 OR paragraph_index % 4 = 0 AND doc_id % 2 = 1", CTE)


def node_table(s, d):
    return corpus.paragraphs(s, d).select("doc_id", c("paragraph_id").alias("path"), F.lit("w:p").alias("tag"), "text", F.create_map(F.lit("role"), "role", F.lit("style"), "style_name").alias("attrs"), "paragraph_index")


def w13(s, d):
    n = node_table(s, d)
    k = c("doc_id") + c("paragraph_index")
    kind = F.when(k % 5 == 0, "set_attr").when(k % 5 == 1, "remove_attr").when(k % 5 == 2, "set_text").when(k % 5 == 3, "remove_node").otherwise("ensure_node")
    path = F.when(k % 5 == 4, F.concat("path", F.lit("/pPr"))).otherwise(c("path"))
    edits = n.select("doc_id", path.alias("path"), c("paragraph_index").alias("seq"), kind.alias("type"), F.lit("style").alias("name"), F.when(k % 5 == 4, "w:pPr").otherwise("new").alias("value"))
    out = wr.edit_nodes(n, edits)
    show = F.array_join(F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat_ws("=", e["key"], e["value"]))), "|")
    return out.withColumn("attrs", show)


add("w13_edit_nodes", w13, """, n AS (SELECT *, (doc_id + paragraph_index) % 5 AS k FROM paragraphs)
 SELECT doc_id, paragraph_id AS path, 'w:p' AS tag, CASE WHEN k = 2 THEN 'new' ELSE text END AS text, 'role=' || role || CASE k WHEN 0 THEN '|style=new'
  WHEN 1 THEN '' ELSE '|style=' || style_name END AS attrs FROM n WHERE k <> 3
 UNION ALL SELECT doc_id, paragraph_id || '/pPr', 'w:pPr', '', '' FROM n WHERE k = 4""", CTE)  # fmt: skip


def w13_replace(s, d):
    n = node_table(s, d).drop("paragraph_index")
    below = n.select("doc_id", F.concat("path", F.lit("/pPr")).alias("path"), F.lit("w:pPr").alias("tag"), F.lit("").alias("text"), F.create_map().cast("map<string,string>").alias("attrs"))
    xml = F.concat(F.lit('<w:p w:rsidR="'), c("doc_id").cast("string"), F.lit('"><w:r><w:t>new</w:t></w:r></w:p>'))
    edits = n.filter(F.substring("path", 3, 9).cast("int") % 3 == 0).select("doc_id", "path", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), F.lit("replace_node_xml").alias("type"), F.lit("").alias("name"), xml.alias("xml"))
    edits = edits.select("doc_id", "path", "seq", "type", "name", F.when(c("seq") == 2, c("xml")).otherwise("<old/>").alias("value"))
    show = F.array_join(F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat_ws("=", e["key"], e["value"]))), "|")
    return wr.edit_nodes(n.unionByName(below), edits).withColumn("attrs", show)


add("w13_replace_nodes", w13_replace, """, n AS (SELECT *, paragraph_index % 3 = 0 AS k FROM paragraphs)
 SELECT doc_id, paragraph_id AS path, 'w:p' AS tag, CASE WHEN k THEN 'new' ELSE text END AS text, CASE WHEN k THEN 'w:rsidR=' || doc_id ELSE 'role=' || role || '|style=' || style_name END AS attrs
  FROM n
 UNION ALL SELECT doc_id, paragraph_id || '/pPr', 'w:pPr', '', '' FROM n WHERE NOT k""", CTE)  # fmt: skip


def w13_nested(s, d):
    """Three levels: paragraphs of a section, runs and texts below; sections, paragraphs and runs are removed or replaced, and made again below."""
    r = corpus.runs(s, d).select("doc_id", "paragraph_index", "run_index")
    none = F.create_map().cast("map<string,string>").alias("attrs")
    sect, para = F.concat(F.lit("s_"), F.expr("(paragraph_index div 4)").cast("string")), F.concat(F.lit("/p_"), c("paragraph_index").cast("string"))
    run = F.concat(F.lit("/r_"), c("run_index").cast("string"))
    node = lambda tag, *path: F.struct(F.concat(*path).alias("path"), F.lit(tag).alias("tag"), F.lit(tag).alias("text"))
    n = r.select("doc_id", F.explode(F.array(node("s", sect), node("p", sect, para), node("r", sect, para, run), node("t", sect, para, run, F.lit("/t")))).alias("x")).select("doc_id", "x.*").distinct().select("*", none)
    k = c("doc_id") + c("paragraph_index")
    edit = lambda seq, type_, value, *path: F.struct(F.concat(*path).alias("path"), F.lit(seq).alias("seq"), F.lit(type_).alias("type"), F.lit("").alias("name"), F.lit(value).alias("value"))
    edits = r.filter("run_index = 0").select("doc_id", F.explode(F.array_compact(F.array(
        F.when(k % 16 == 0, edit(1, "replace_node_xml", '<w:s a="1">new</w:s>', sect)), F.when(k % 7 == 0, edit(2, "replace_node_xml", "<w:p>newp</w:p>", sect, para)),
        F.when(k % 5 == 0, edit(3, "remove_node", None, sect, para, run)), F.when(k % 11 == 0, edit(4, "remove_node", None, sect, para)),
        F.when(k % 3 == 0, edit(5, "ensure_node", "made", sect, para, run)), F.when(k % 2 == 0, edit(6, "set_text", "set", sect, para)),
    ))).alias("x")).select("doc_id", "x.*")
    return wr.edit_nodes(n, edits).withColumn("attrs", F.size("attrs"))


add("w13_nested_edits", w13_nested, """, k AS (SELECT doc_id, 's_' || paragraph_index // 4 AS s, 's_' || paragraph_index // 4 || '/p_' || paragraph_index AS p, run_index, doc_id + paragraph_index AS k FROM runs),
 n AS (SELECT DISTINCT doc_id, s AS path, 's' AS tag FROM k UNION ALL SELECT DISTINCT doc_id, p, 'p' FROM k UNION ALL SELECT doc_id, p || '/r_' || run_index, 'r' FROM k UNION ALL
  SELECT doc_id, p || '/r_' || run_index || '/t', 't' FROM k),
 e AS (SELECT * FROM k WHERE run_index = 0),
 replaced AS (SELECT DISTINCT doc_id, s AS path, '<w:s>' AS x FROM e WHERE k % 16 = 0 UNION ALL SELECT doc_id, p, '<w:p>' FROM e WHERE k % 7 = 0),
 removed AS (SELECT doc_id, p || '/r_0' AS path FROM e WHERE k % 5 = 0 UNION ALL SELECT doc_id, p FROM e WHERE k % 11 = 0),
 kept AS (SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM replaced x WHERE x.doc_id = n.doc_id AND starts_with(n.path, x.path || '/'))),
 made AS (SELECT doc_id, p || '/r_0' AS path, 'made' AS tag FROM e WHERE k % 3 = 0 AND NOT EXISTS (SELECT 1 FROM kept WHERE kept.doc_id = e.doc_id AND kept.path = e.p || '/r_0')),
 both_ AS (SELECT *, true AS old FROM kept UNION ALL SELECT *, false FROM made),
 left_ AS (SELECT * FROM both_ b WHERE NOT EXISTS (SELECT 1 FROM removed x WHERE x.doc_id = b.doc_id AND (b.path = x.path OR starts_with(b.path, x.path || '/'))))
 SELECT l.doc_id, l.path, coalesce(CASE WHEN old THEN CASE x WHEN '<w:s>' THEN 'w:s' WHEN '<w:p>' THEN 'w:p' END END, tag) AS tag,
 CASE WHEN t.doc_id IS NOT NULL THEN 'set' WHEN NOT old THEN '' WHEN x = '<w:s>' THEN 'new' WHEN x = '<w:p>' THEN 'newp' ELSE tag END AS text, CASE WHEN old AND x = '<w:s>' THEN 1 ELSE 0 END AS attrs
 FROM left_ l LEFT JOIN replaced r ON r.doc_id = l.doc_id AND r.path = l.path LEFT JOIN (SELECT doc_id, p AS path FROM e WHERE k % 2 = 0) t ON t.doc_id = l.doc_id
  AND t.path = l.path""", CTE)  # fmt: skip


def w14(s, d):
    defs = styles(s, d).select("doc_id", c("style_id").alias("path"), F.lit("w:style").alias("tag"), F.lit("").alias("text"), F.create_map(F.lit("font"), F.coalesce("font_name", F.lit("-"))).alias("attrs"))
    edits = defs.filter("path IN ('Body', 'Quote')").select("doc_id", "path", F.lit(1).alias("seq"), F.lit("set_attr").alias("type"), F.lit("size").alias("name"), F.lit("12").alias("value"))
    show = F.array_join(F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat_ws("=", e["key"], e["value"]))), "|")
    return wr.edit_nodes(defs, edits).select("doc_id", "path", show.alias("attrs"))


SQL["w14_style_definition_ops"] = "WITH " + STYLES + " SELECT doc_id, style_id AS path, 'font=' || coalesce(font_name, '-') || CASE WHEN style_id IN ('Body', 'Quote') THEN '|size=12' ELSE '' END AS attrs FROM styles"
QUERIES["w14_style_definition_ops"] = w14
add("w15_patch_history", lambda s, d: wr.patch_history(corpus.table(s, d, "events").select(c("user_id").alias("doc_id"), c("event_id").alias("patch_id"), c("ts").alias("applied_at"))).select("doc_id", "patch_id", "n"),
    "SELECT user_id AS doc_id, event_id AS patch_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS n FROM events")


def w16(s, d):
    base, new = folded(s, d)
    name = lambda df: df.withColumnRenamed("run_no", "run_id")
    return wr.change_diff(name(base), name(new), ATTRS)


_diff = lambda a, old, new: f"SELECT doc_id, run_no AS run_id, '{a}' AS attribute, {old} AS before, {new} AS after FROM styled WHERE {old} IS DISTINCT FROM {new}"
add("w16_change_diff", w16, " UNION ALL ".join([_diff("font_name", "f0", "font_name"), _diff("font_size_pt", "s0::VARCHAR", "font_size_pt::VARCHAR"), _diff("font_color", "NULL::VARCHAR", "font_color"), _diff("is_bold", "b0::VARCHAR",
    "is_bold::VARCHAR"), _diff("highlight_color", "NULL::VARCHAR", "highlight_color")]), FOLD)


def w17(s, d):
    e = corpus.table(s, d, "events").select("event_id", c("user_id").alias("run_id"), "event_type")
    return wr.without_runs(e, e.filter("event_type = 'error' AND event_id % 16 = 0"))


add("w17_state_as_of", w17, "SELECT event_id, user_id AS run_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.event_id % 16 = 0)")
_STYLE = ("font_name", "font_size_pt")


def w17_states(s, d):
    """Every document as before its first failed task and as of its end; a snapshot was taken halfway, failed writes and all."""
    r = written(corpus.runs(s, d).select("doc_id", "paragraph_index", "run_index", "run_id", *_STYLE))  # texts are cut once for all that follows
    k = c("doc_id") + c("paragraph_index") * 2 + c("run_index")
    log = r.filter(k % 3 == 0).withColumn("seq", (c("paragraph_index") * 8 + c("run_index")).cast("long") + 1).withColumn("task", c("seq") % 5)
    name = F.when(c("seq") % 2 == 0, "font_name").otherwise("font_size_pt")
    value = F.when(c("seq") % 2 == 0, F.concat(F.lit("F"), (c("seq") % 4).cast("string"))).otherwise((c("seq") % 9 + 6).cast("string"))
    log = log.select("doc_id", "seq", "task", c("run_id"), name.alias("attribute"), value.alias("value"))
    log = log.unionByName(log.filter("seq % 7 = 0").withColumn("seq", c("seq") + 1000).withColumn("task", c("task") + 5).withColumn("attribute", F.lit("font_size_pt")).withColumn("value", F.lit("20")))
    failed = log.filter("task = 2 + doc_id % 7").select("doc_id", "task").distinct()
    before = log.filter("task = 2 + doc_id % 7").groupBy("doc_id").agg((F.min("seq") - 1).alias("version"))
    asked = before.unionByName(log.groupBy("doc_id").agg(F.max("seq").alias("version")))
    first = r.select("doc_id", F.lit(0).cast("long").alias("version"), "run_id", *_STYLE)
    half = wr.apply_style_ops(first, log.filter("seq <= 24"), _STYLE).withColumn("version", F.lit(24).cast("long"))
    return wr.state_as_of(first.unionByName(half.select(*first.columns)), log, asked, failed, _STYLE)


add("w17_states_as_of", w17_states, """, l0 AS (SELECT doc_id, run_id, (paragraph_index * 8 + run_index)::BIGINT + 1 AS seq FROM runs WHERE (doc_id + paragraph_index * 2 + run_index) % 3 = 0),
 l1 AS (SELECT doc_id, run_id, seq, seq % 5 AS task, CASE WHEN seq % 2 = 0 THEN 'font_name' ELSE 'font_size_pt' END AS attribute, CASE
  WHEN seq % 2 = 0 THEN 'F' || seq % 4 ELSE (seq % 9 + 6)::VARCHAR END AS value FROM l0),
 log AS (SELECT * FROM l1 UNION ALL SELECT doc_id, run_id, seq + 1000, task + 5, 'font_size_pt', '20' FROM l1 WHERE seq % 7 = 0),
 asked AS (SELECT doc_id, min(seq) - 1 AS version FROM log WHERE task = 2 + doc_id % 7 GROUP BY doc_id UNION SELECT doc_id, max(seq) FROM log GROUP BY doc_id),
 good AS (SELECT * FROM log WHERE task <> 2 + doc_id % 7),
 folded AS (SELECT a.doc_id, a.version, g.run_id, arg_max(value, seq) FILTER (attribute = 'font_name') AS f, arg_max(value, seq) FILTER (attribute = 'font_size_pt')::DOUBLE AS z FROM asked a
  JOIN good g ON g.doc_id = a.doc_id AND g.seq <= a.version GROUP BY ALL)
 SELECT a.doc_id, a.version, r.run_id, coalesce(f, font_name) AS font_name, coalesce(z, font_size_pt) AS font_size_pt FROM asked a JOIN runs r USING (doc_id) LEFT JOIN folded x ON x.doc_id = a.doc_id
  AND x.version = a.version AND x.run_id = r.run_id""", CTE)  # fmt: skip
add("w18_write_summary", lambda s, d: wr.write_summary(corpus.steps(s, d).withColumn("dry_run", c("step_id") % 10 == 0)).select("step_id", "summary"), "SELECT step_id, CASE WHEN step_id % 10 = 0 "
    "THEN op_type || ': dry run, ' || n_targets || ' targets' WHEN n_targets = 1 THEN op_type || ': 1 target' WHEN n_targets = 0 THEN op_type || ': pending' ELSE op_type || ': ' || n_targets || ' targets' END AS summary "
        "FROM steps", views.STEPS)


def flagship(s, d):
    """Roles, heading selection, two ordered operations and the changed attributes per document."""
    r = corpus.runs(s, d)
    targets = sel.select_targets(corpus.paragraphs(s, d), ops.project_nodes(r), "heading")
    ops_rows = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(t).alias("type"), F.lit(p).alias("payload")) for i, t, p in ((1, "set_font", "Arial"), (2, "set_size", "16"))])
    writes = wr.normalize_payload(targets.select("doc_id", "run_id", F.explode(ops_rows).alias("x")).select("doc_id", "run_id", "x.*")).filter("error IS NULL")
    after = wr.apply_style_ops(r, writes, ("font_name", "font_size_pt"))
    return wr.change_diff(r, after, ("font_name", "font_size_pt")).groupBy("doc_id", "attribute").agg(F.count("*").alias("n_changed"))


add("flagship_change_counts", flagship, """, t AS (SELECT r.* FROM runs r JOIN paragraphs p USING (doc_id, paragraph_id) WHERE p.role = 'heading' AND trim(r.text) <> '')
 SELECT doc_id, 'font_name' AS attribute, count(*) AS n_changed FROM t WHERE font_name IS DISTINCT FROM 'Arial' GROUP BY 1 UNION ALL SELECT doc_id, 'font_size_pt', count(*) FROM t
  WHERE font_size_pt IS DISTINCT FROM 16 GROUP BY 1""", CTE)  # fmt: skip
