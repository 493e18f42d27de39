"""Queries of package, run-log, streaming and extension operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import audit as au
from foliant.operators import package as pk
from foliant.operators import structure as ops
from foliant.operators.classify import rules_table
from foliant.operators import write as wr
from foliant.functions import structure as st
from foliant.sources import corpus
from foliant.streaming import events as ev

from . import views
from .table_queries import CTE, STYLES

QUERIES: dict = {}
SQL: dict[str, str] = {}
c = F.col


def reg(name, fn, sql=None, *ctes) -> None:
    QUERIES[name] = fn
    if sql is not None:
        SQL[name] = views.query(sql, *ctes)


# ---------------------------------------------------------------- packages: pages stand for packages, with made-up parts
PART_NAMES = ["word/document.xml", "word/header1.xml", "word/footer2.xml", "word/footnotes.xml", "word/endnotes.xml", "word/styles.xml", "word/numbering.xml", "docProps/core.xml", "customXml/item1.xml", "word/media/a.png",
    "word/_rels/document.xml.rels", "word/theme.xml", "word/blob.bin"]
KINDS = ["main_document", "header", "footer", "footnotes", "endnotes", "styles", "numbering", "docprops", "custom_xml", "media", "relationships", "xml", "binary"]
_names, _kinds = str(PART_NAMES), str(KINDS)
PARTS = f"parts AS (SELECT page_id AS doc_id, {_names}[i + 1] AS part_path, {_kinds}[i + 1] AS kind FROM pages, range(13) t(i) WHERE i = 0 OR (page_id + i) % 3 <> 0)"


def parts(s, d):
    p = corpus.table(s, d, "pages").select(c("page_id").alias("doc_id"), F.posexplode(F.array(*map(F.lit, PART_NAMES))).alias("i", "part_path"))
    return p.filter((c("i") == 0) | ((c("doc_id") + c("i")) % 3 != 0)).select("doc_id", "part_path", st.part_kind("part_path", F.lit(None).cast("string")).alias("kind"))


TARGETS = ["styles.xml", "./media/../media/a.png", "../docProps/core.xml", "/word/header1.xml", "http://x.example/a", ""]
RESOLVED = ["word/styles.xml", "word/media/a.png", "docProps/core.xml", "word/header1.xml", "http://x.example/a"]


def rels(s, d):
    p = corpus.table(s, d, "pages").select(c("page_id").alias("doc_id"), F.posexplode(F.array(*map(F.lit, TARGETS))).alias("i", "target"))
    return p.select("doc_id", F.lit("word/document.xml").alias("source_part"), F.concat(F.lit("rId"), c("i").cast("string")).alias("rel_id"), F.when((c("doc_id") + c("i")) % 5 != 0, "part").alias("type"), "target", F.when(c("i") == 4,
        "External").alias("target_mode"))


EDGES = f"edges AS (SELECT page_id AS doc_id, 'word/document.xml' AS source_part, 'rId' || i AS rel_id, 'part' AS type, {RESOLVED}[i + 1] AS target, CASE WHEN i = 4 THEN 'External' END AS target_mode FROM pages, range(5) t(i) WHERE (page_id + i) % 5 <> 0)"


def edges(s, d):
    return pk.relationship_edges(rels(s, d))


reg("s2_part_kind", parts, "SELECT * FROM parts", PARTS)


def s3(s, d):
    over = parts(s, d).filter("kind = 'main_document' AND doc_id % 2 = 0").select("doc_id", "part_path", F.lit("main+xml").alias("content_type"))
    default = rules_table(s, [("xml", "application/xml"), ("png", "image/png"), ("rels", "rels+xml")], "ext STRING, content_type STRING")
    return pk.resolve_content_types(parts(s, d), over, default)


reg("s3_resolve_content_types", s3, "SELECT doc_id, part_path, kind, CASE WHEN kind = 'main_document' AND doc_id % 2 = 0 THEN 'main+xml' WHEN part_path LIKE '%.xml' THEN 'application/xml' WHEN part_path LIKE '%.png' THEN 'image/png' "
    "WHEN part_path LIKE '%.rels' THEN 'rels+xml' END AS content_type FROM parts", PARTS)
reg("s4_relationship_edges", edges, "SELECT * FROM edges", EDGES)
reg("s5_part_models", lambda s, d: pk.part_models(parts(s, d), edges(s, d)), "SELECT p.*, (SELECT count(*) FROM edges e WHERE e.doc_id = p.doc_id AND e.source_part = p.part_path) AS relationship_count FROM parts p", PARTS, EDGES)


def sections(s, d):
    p = corpus.table(s, d, "pages").filter("page_id % 4 <> 0").select(c("page_id").alias("doc_id"), F.explode(F.sequence(F.lit(0), (c("page_id") % 3).cast("int"))).alias("section"))
    return p.withColumn("refs", F.array(F.struct(F.lit("header").alias("kind"), F.concat(F.lit("rId"), (c("section") + 2).cast("string")).alias("rel_id")), F.struct(F.lit("footer").alias("kind"), F.lit("rId9").alias("rel_id"))))


SECTIONS = "sections AS (SELECT page_id AS doc_id, unnest(range(0, page_id % 3 + 1))::INTEGER AS section FROM pages WHERE page_id % 4 <> 0)"
reg("s6_package_meta", lambda s, d: pk.package_meta(parts(s, d), edges(s, d), sections(s, d)),
    """, p AS (SELECT doc_id, count(*) AS n_parts, count(*) FILTER (part_path LIKE '%.xml') AS n_xml, """ + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("header", "footer", "footnotes", "endnotes", "custom_xml",
        "media")) + """ FROM parts GROUP BY ALL)
 SELECT p.*, (SELECT count(*) FROM edges e WHERE e.doc_id = p.doc_id) AS n_relationships, greatest(1, (SELECT count(*) FROM sections s WHERE s.doc_id = p.doc_id)) AS n_sections
  FROM p""", PARTS, EDGES, SECTIONS)  # fmt: skip


def s7(s, d):
    p = corpus.table(s, d, "pages").select(c("page_id").alias("doc_id"), F.posexplode(F.array(*map(F.lit, pk.PROPERTIES))).alias("i", "name"))
    return pk.core_properties(p.filter((c("doc_id") + c("i")) % 4 != 0).withColumn("value", F.concat_ws("-", "name", c("doc_id").cast("string"))))


reg("s7_core_properties", s7, "SELECT page_id AS doc_id, " + ", ".join(f"CASE WHEN (page_id + {i}) % 4 <> 0 THEN '{p}-' || page_id END AS {p}" for i, p in enumerate(pk.PROPERTIES)) + " FROM pages")
reg("s8_header_footer_bindings", lambda s, d: pk.header_footer_bindings(sections(s, d), edges(s, d)), "SELECT s.doc_id, s.section, 'header' AS kind, e.target AS part_path FROM sections s JOIN edges e ON e.doc_id = s.doc_id "
    "AND e.rel_id = 'rId' || (s.section + 2)", EDGES, SECTIONS)


def s9(s, d):
    p = corpus.paragraphs(s, d).withColumn("n_formulas", (c("doc_id") + c("paragraph_index")) % 3)
    w = p.filter("paragraph_index > 5 AND in_table").select("doc_id", F.concat(F.lit("table at "), "paragraph_id").alias("message"))
    package = pk.package_meta(parts(s, d), edges(s, d), sections(s, d))
    return pk.document_meta(p, w, package).withColumn("warnings", F.array_join("warnings", "|"))


reg("s9_document_meta", s9, """, w AS (SELECT doc_id, list_sort(list('table at ' || paragraph_id)) AS ws FROM paragraphs WHERE paragraph_index > 5 AND in_table GROUP BY ALL),
 t AS (SELECT doc_id, count(*) FILTER (part_kind = 'main_document') AS n_paragraphs, count(*) FILTER (in_table) AS n_table, sum(n_images)::BIGINT AS n_images,
  sum((doc_id + paragraph_index) % 3)::BIGINT AS n_formulas FROM paragraphs GROUP BY ALL),
 k AS (SELECT doc_id, """ + ", ".join(f"count(*) FILTER (kind = '{x[2:]}') AS {x}" for x in pk.NOTE_TOTALS) + """ FROM parts GROUP BY doc_id)
 SELECT t.*, """ + ", ".join(f"coalesce(k.{x}, 0) AS {x}" for x in pk.NOTE_TOTALS) + """, coalesce(array_to_string(ws, '|'), '') AS warnings, ws[1] AS first_warning
 FROM t LEFT JOIN k USING (doc_id) LEFT JOIN w USING (doc_id)""", CTE, PARTS)  # fmt: skip


def contracts(s, d):
    """A template for each part, read from JSON text as template files are."""
    k, text = c("p_partkey"), lambda x: F.concat(F.lit("k"), F.lit(x).cast("string"))
    operation = F.array(F.struct(F.lit("set_font").alias("type"), F.create_map(F.lit("font_name"), F.concat(F.lit("F"), (k % 4).cast("string"))).alias("attributes")))
    block = lambda i: F.struct(text(i).alias("semantic_key"), F.lit("paragraph").alias("scope"), operation.alias("operations"))
    semantic = lambda i: F.struct(F.concat(F.lit(f"k{i}_"), (k % 3).cast("string")).alias("key"), c("p_name").alias("label"), F.lit(i == 0).alias("required"), F.lit(True).alias("multiple"))
    whole = F.struct(
        k.cast("string").alias("template_id"), F.lit("2.0").alias("version"), F.array(semantic(0), semantic(1)).alias("semantics"),
        F.when(k % 4 == 0, F.array(F.struct(F.lit("d0").alias("key"), F.lit("refine").alias("mode"), F.array(F.lit("k0")).alias("inherits_from")))).alias("derived"),
        F.array(F.struct(F.lit("k1").alias("semantic_key"), (k % 5).cast("int").alias("min_occurs"))).alias("rules"),
        F.when(k % 2 == 0, F.array(block(0))).alias("patch_blocks"), F.array(block(1), block(2)).alias("operation_blocks"),
        F.when(k % 7 != 0, F.struct((k % 3 == 0).alias("enforce_validation"))).alias("policy"),
    )
    return corpus.table(s, d, "part").select(F.from_json(F.to_json(whole), pk.CONTRACT).alias("x")).select("x.*")


def s10(s, d):
    t = pk.template_tables(contracts(s, d))
    row = lambda name, key, value: t[name].select("template_id", F.lit(name).alias("kind"), key.alias("key"), value.alias("value"))
    none = F.lit(None).cast("string")
    rows = [
        row("t_semantic", c("key"), c("required").cast("string")), row("t_derived", c("key"), F.array_join("inherits_from", "|")), row("t_rule", c("semantic_key"), c("min_occurs").cast("string")),
        row("t_patch", c("semantic_key"), c("scope")), row("t_operation", c("semantic_key"), F.concat_ws("=", "type", F.element_at("attributes", "font_name"))), row("t_policy", none, c("enforce_validation").cast("string")),
    ]
    out = rows[0]
    for part in rows[1:]:
        out = out.unionByName(part)
    return out


reg("s10_load_template_contract", s10, """WITH p AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS template_id FROM part), b AS (SELECT k, template_id, i FROM p, range(3) t(i) WHERE CASE
  WHEN k % 2 = 0 THEN i = 0 ELSE i > 0 END)
 SELECT template_id, 't_semantic' AS kind, 'k' || i || '_' || k % 3 AS key, CASE WHEN i = 0 THEN 'true' ELSE 'false' END AS value FROM p, range(2) t(i) UNION ALL
  SELECT template_id, 't_derived', 'd0', 'k0' FROM p WHERE k % 4 = 0
 UNION ALL SELECT template_id, 't_rule', 'k1', (k % 5)::VARCHAR FROM p UNION ALL SELECT template_id, 't_patch', 'k' || i, 'paragraph' FROM b UNION ALL
  SELECT template_id, 't_operation', 'k' || i, 'set_font=F' || k % 4 FROM b
 UNION ALL SELECT template_id, 't_policy', NULL, CASE WHEN k % 3 = 0 THEN 'true' ELSE 'false' END FROM p WHERE k % 7 <> 0""")  # fmt: skip
reg("s11_block_nodes", lambda s, d: pk.block_nodes(corpus.runs(s, d)), "SELECT doc_id, paragraph_id, string_agg(text, '' ORDER BY run_index) AS text, arg_min(font_name, run_index) FILTER (font_name IS NOT NULL) AS font_name FROM runs "
    "GROUP BY doc_id, paragraph_id", CTE)


def s12(s, d):
    import uuid

    r = corpus.runs(s, d).select("doc_id", "run_id", "text", "font_name")
    return pk.materialize(r, corpus.table(s, d, "documents").filter("doc_id % 3 <> 0"), f"{ev.shared_folder(s)}/corpus-{uuid.uuid4().hex}")[0]


reg("s12_materialize_corpus", s12, "SELECT doc_id, run_id, text, font_name FROM runs WHERE doc_id % 3 <> 0", CTE)


def s12_joined(s, d):
    """Materialised runs and styles of one corpus, joined by document and style without a shuffle of either."""
    import uuid

    from .table_queries import styles

    pk.join_by_buckets(s)
    folder = f"{ev.shared_folder(s)}/corpus-{uuid.uuid4().hex}"
    docs = corpus.table(s, d, "documents")
    runs = corpus.runs(s, d).select("doc_id", "run_id", c("style_name").alias("style_id"))
    n = pk.buckets_for(runs, 50_000)
    left = pk.materialize(runs, docs, f"{folder}/runs", buckets=n)[0]
    right = pk.materialize(styles(s, d).select("doc_id", "style_id", c("font_name").alias("style_font")), docs, f"{folder}/styles", buckets=n)[0]
    return left.join(right.hint("merge"), ["doc_id", "style_id"], "left")


reg("s12_join_materialized", s12_joined, ", " + STYLES + " SELECT r.doc_id, r.style_name AS style_id, run_id, s.font_name AS style_font FROM runs r LEFT JOIN styles s ON s.doc_id = r.doc_id AND s.style_id = r.style_name", CTE)
reg("s13_rebuild_paragraphs", lambda s, d: pk.rebuild_paragraphs(ops.project_nodes(corpus.runs(s, d))),
    "SELECT doc_id, 'p_' || (row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index, run_index) - 1) AS paragraph_id, text, font_name FROM runs WHERE trim(text) <> ''", CTE)

# ---------------------------------------------------------------- run log


def events(s, d):
    return corpus.table(s, d, "events").withColumn("run_id", c("user_id"))


reg("e1_event_sequence", lambda s, d: au.event_sequence(events(s, d)).select("run_id", "event_id", "seq"), "SELECT user_id AS run_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS seq FROM events")
reg("e2_run_state", lambda s, d: au.run_state(events(s, d)), "SELECT user_id AS run_id, arg_max(event_type, (ts, event_id)) AS status, max((ts, event_id, props))[3] AS payload, min(ts) AS started, max(ts) AS ended, count(*) AS n_events "
    "FROM events GROUP BY ALL")


def e3(s, d):
    e = corpus.table(s, d, "events")
    return au.pending_tasks(e.select((c("user_id") % 50).alias("task_id"), c("event_id").alias("run_id"), "ts", F.when(c("event_type") == "click", "waiting").when(c("event_type") == "purchase",
        "resolved").otherwise("other").alias("status")))


reg("e3_pending_tasks", e3, "WITH t AS (SELECT user_id % 50 AS task_id, max((ts, event_id)) FILTER (event_type = 'click') AS w, max(ts) FILTER (event_type = 'purchase') AS done FROM events GROUP BY ALL) "
    "SELECT task_id, w[2] AS run_id, w[1] AS waiting_since FROM t WHERE w IS NOT NULL AND (done IS NULL OR done <= w[1])")
reg("e4_turn_trace", lambda s, d: au.turn_trace(corpus.table(s, d, "conversations").select("conv_id", "turn", "role", "text"), 3, 1, every=True), "SELECT conv_id, turn, role, text "
    "FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) WHERE n BETWEEN 2 AND 4")


def e5(s, d):
    o = corpus.table(s, d, "orders")
    sessions = o.select(c("o_orderkey").alias("session_id"), c("o_orderdate").alias("updated"), F.when(c("o_orderkey") % 3 == 0, "doc.docx").alias("document"))
    return au.session_list(sessions, o.filter("o_orderkey % 2 = 0").select(c("o_orderkey").alias("session_id"), c("o_orderpriority").alias("goal")))


reg("e5_session_list", e5, "SELECT o_orderkey AS session_id, o_orderdate AS updated, o_orderkey % 3 = 0 AS has_document, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS goal FROM orders")


def e6(s, d):
    shown = F.array_join(F.transform("turns", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"], x["text"])), "|")
    t = corpus.table(s, d, "conversations")
    sessions = t.select("conv_id").distinct().filter("conv_id % 3 <> 0").select("conv_id", F.concat(F.lit("goal "), c("conv_id").cast("string")).alias("goal"), F.when(c("conv_id") % 2 == 0, "doc.docx").alias("document"))
    return au.session_snapshot(t, sessions).select("conv_id", shown.alias("turns"), "goal", "document")


reg("e6_session_snapshot", e6, "SELECT conv_id, string_agg(turn || ':' || role || ':' || text, '|' ORDER BY turn, role, text) AS turns, CASE WHEN conv_id % 3 <> 0 THEN 'goal ' || conv_id END AS goal, CASE WHEN conv_id % 3 <> 0 "
    "AND conv_id % 2 = 0 THEN 'doc.docx' END AS document FROM conversations GROUP BY conv_id")


def e7(s, d):
    e = corpus.table(s, d, "events").withColumn("title", F.when(c("event_id") % 3 == 0, "  ").otherwise(c("event_type")))
    return au.titled(au.latest_by_key(e, "user_id", ["ts", "event_id"], ["title", "value"]), "user_id", "title")


reg("e7_latest_upsert", e7, "SELECT user_id, coalesce(nullif(trim(arg_max(CASE WHEN event_id % 3 = 0 THEN '  ' ELSE event_type END, (ts, event_id))), ''), user_id::VARCHAR) AS title, arg_max(value, (ts, event_id)) AS value FROM events "
    "GROUP BY user_id")
reg("e8_latest_turn_run", lambda s, d: au.latest_by_key(corpus.table(s, d, "conversations"), "conv_id", ["turn", "role", "text"], ["turn", "role", "text"]),
    "SELECT conv_id, max((turn, role, text))[1] AS turn, max((turn, role, text))[2] AS role, max((turn, role, text))[3] AS text FROM conversations GROUP BY conv_id")


def e9(s, d):
    t = corpus.table(s, d, "conversations")
    left = au.cascade_delete({"turns": t.select("conv_id", F.lit("turn").alias("kind")), "sessions": t.select("conv_id", F.lit("session").alias("kind")).distinct()}, t.filter("conv_id % 4 = 1"), "conv_id")
    return left["turns"].unionByName(left["sessions"]).groupBy("conv_id", "kind").agg(F.count("*").alias("n"))


reg("e9_cascade_delete", e9, "SELECT conv_id, 'turn' AS kind, count(*) AS n FROM conversations WHERE conv_id % 4 <> 1 GROUP BY conv_id UNION ALL SELECT DISTINCT conv_id, 'session', 1 FROM conversations WHERE conv_id % 4 <> 1")
reg("e10_goal_status", lambda s, d: au.goal_status(au.run_state(events(s, d))).select("run_id", "status", "goal_status"), "SELECT *, CASE status WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'active' END AS goal_status "
    "FROM (SELECT user_id AS run_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY ALL)")
_SCOPE = "CASE scope WHEN 'body' THEN '正文' WHEN 'heading' THEN '标题' ELSE '列表' END"
_OP = "CASE op_type WHEN 'set_font' THEN '字体' WHEN 'set_size' THEN '字号' WHEN 'merge_paragraph' THEN '段落合并' WHEN 'set_bold' THEN '加粗' WHEN 'set_alignment' THEN '对齐方式' WHEN 'split_paragraph' THEN '段落拆分' END"
reg("e11_step_summary", lambda s, d: au.step_summary(corpus.steps(s, d)), f"SELECT run_id, scope, op_type, sum(CASE WHEN status = 'succeeded' THEN n_targets ELSE 0 END)::BIGINT AS n_targets, count(*) AS n_steps, CASE "
    f"WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' ELSE 'completed' END AS state, {_SCOPE} || {_OP} AS title FROM steps WHERE NOT read_only GROUP BY run_id, scope, op_type", views.STEPS)
reg("e12_idempotent_steps", lambda s, d: au.idempotent_steps(corpus.steps(s, d)).select("step_id", "idempotency_key", "skipped"),
    "SELECT step_id, idempotency_key, coalesce(bool_or(status = 'succeeded') OVER (PARTITION BY idempotency_key ORDER BY ts, step_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS skipped FROM steps "
        "WHERE NOT read_only", views.STEPS)
reg("e13_phase_groups", lambda s, d: au.phase_groups(corpus.steps(s, d)).select("run_id", "step_id", "phase", "chunk"), """, a AS (SELECT *, CASE WHEN read_only
  AND coalesce(lag(read_only) OVER w, false) THEN 0 ELSE 1 END AS ch FROM steps WINDOW w AS (PARTITION BY run_id ORDER BY ts, step_id)),
 b AS (SELECT *, sum(ch) OVER (PARTITION BY run_id ORDER BY ts, step_id)::BIGINT AS phase FROM a)
  SELECT run_id, step_id, phase, ((row_number() OVER (PARTITION BY run_id, phase ORDER BY ts, step_id) - 1) // 4)::INTEGER AS chunk FROM b""", views.STEPS)  # fmt: skip
reg("e14_run_outcome", lambda s, d: au.run_outcome(corpus.steps(s, d)), """, a AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, step_id) AS n, CASE WHEN NOT read_only
  AND op_type IN ('merge_paragraph', 'split_paragraph') AND NOT approved THEN 'waiting_user' WHEN status = 'failed' THEN 'failed' END AS stop FROM steps),
 f AS (SELECT run_id, min(n) FILTER (stop IS NOT NULL) AS at, arg_min(stop, n) FILTER (stop IS NOT NULL) AS stop FROM a GROUP BY ALL),
 g AS (SELECT a.run_id, f.stop, count(*) FILTER (f.at IS NULL OR n < f.at) AS n_done, count(*) FILTER ((f.at IS NULL OR n < f.at) AND NOT read_only) AS m FROM a JOIN f ON f.run_id = a.run_id
  GROUP BY ALL)
 SELECT run_id, CASE WHEN stop IS NULL THEN 'completed' WHEN stop = 'failed' AND m > 0 THEN 'rolled_back' ELSE stop END AS outcome, n_done FROM g""", views.STEPS)  # fmt: skip
reg("e15_retry_stats", lambda s, d: au.retry_stats(corpus.steps(s, d)), "SELECT op_type, sum(retries)::BIGINT AS n_retries, count(*) FILTER (retries >= 3 "
    "AND status = 'failed') AS n_exhausted, round(avg(duration_ms), 4) AS mean_ms, max(duration_ms) AS max_ms FROM steps GROUP BY ALL", views.STEPS)
reg("e15_retry_stats_by_step", lambda s, d: au.retry_stats(corpus.steps(s, d), by=("run_id", "step_id", "op_type")), "SELECT run_id, step_id, op_type, sum(retries)::BIGINT AS n_retries, count(*) FILTER (retries >= 3 "
    "AND status = 'failed') AS n_exhausted, round(avg(duration_ms), 4) AS mean_ms, max(duration_ms) AS max_ms FROM steps GROUP BY ALL", views.STEPS)
reg("e16_confirmation_needed", lambda s, d: au.needs_confirmation(corpus.steps(s, d)).select("run_id", "step_id", "op_type"), "SELECT run_id, step_id, op_type FROM steps WHERE NOT read_only "
    "AND op_type IN ('merge_paragraph', 'split_paragraph')", views.STEPS)
reg("e17_change_summary", lambda s, d: au.change_summary(corpus.steps(s, d)), "SELECT run_id, 'ChangeSet(' || run_id || ') ' || CASE WHEN count(*) FILTER (status = 'failed') > 0 "
    "THEN 'rolled back' ELSE 'committed' END || ', total=' || count(*) || chr(10) || string_agg('- ' || step_id || ': ' || op_type || ' x' || n_targets, chr(10) ORDER BY ts, step_id) AS summary FROM steps WHERE NOT read_only "
        "GROUP BY run_id", views.STEPS)
def e18(s, d):
    json_line = F.concat(F.lit('{"phase": "'), "event_type", F.lit('", '), F.substring("props", F.lit(2), F.length("props")))
    lines = corpus.table(s, d, "events").select(c("user_id").alias("run_id"), "ts", "event_id", F.when(c("event_id") % 2 == 0, json_line).otherwise(c("event_type")).alias("line"))
    return au.log_digest(lines, phase="phase")


reg("e18_log_digest", e18, """WITH l AS (SELECT user_id AS run_id, CASE WHEN event_id % 2 = 0 THEN 'phase=' || event_type || ' k=' || json_extract_string(props, '$.k') ELSE event_type END AS line,
  CASE WHEN event_id % 2 = 0 THEN event_type END AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
 SELECT run_id, substr(string_agg(line, ' | ' ORDER BY n DESC), 1, 1000) AS digest, arg_min(k, n) FILTER (k IS NOT NULL) AS phase FROM l WHERE n <= 6 GROUP BY run_id""")  # fmt: skip
DECISIONS = ['{"mode":"Chat","goal":"hi"}', '{"mode":"execute","goal":" bold ","requires_document":"true"}', '{"mode":"fly","goal":"x"}', '{"mode":"inspect","goal":""}', '{"mode":"chat","goal":"x","needsClarification":true}',
    '{"mode":"chat","goal":"x","clarification_reason":"which"}', '{"mode":"execute","goal":"x","needs_clarification":"1","clarificationReason":"y"}', '{"mode":"execute","goal":"x","requiresDocument":"perhaps"}']
_EXPECT = [("chat", "hi", False, False, None), ("execute", "bold", True, False, None), ("fly", "x", True, False, "mode"), ("inspect", "", True, False, "goal"), ("chat", "x", False, True, "clarification_reason"), ("chat", "x", False, True,
    None), ("execute", "x", True, True, "clarification_mode"), ("execute", "x", True, False, "requiresDocument")]
_row = lambda i, r: "(" + ", ".join([str(i), *("NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" for v in r)]) + ")"
reg("e19_normalize_decisions", lambda s, d: au.normalize_decisions(corpus.table(s, d, "events").select(c("event_id").alias("id"), F.element_at(F.array(*map(F.lit, DECISIONS)), (c("event_id") % 8 + 1).cast("int")).alias("json"))),
    f"WITH v(i, mode, goal, requires_document, needs_clarification, error) AS (VALUES {', '.join(_row(i, r) for i, r in enumerate(_EXPECT))}) SELECT event_id AS id, mode, goal, requires_document, needs_clarification, error FROM events "
        f"JOIN v ON v.i = event_id % 8")
reg("e20_stage_errors", lambda s, d: au.stage_errors(corpus.steps(s, d)), "SELECT scope AS stage, op_type AS code, count(*) AS n FROM steps WHERE status = 'failed' GROUP BY ALL", views.STEPS)

# ---------------------------------------------------------------- streams


def table_path(d: str, name: str) -> str:
    """A table's path as a pattern: a stream takes a plain path for a folder only, and a table may be one file or a folder."""
    return f"{d}/{name}.parque[t]"


def stream(s, d):
    return ev.stream_events(s, table_path(d, "events"))


reg("r1_stream_events", lambda s, d: ev.available(stream(s, d)).select("event_id", "user_id", "event_type", "value"), "SELECT event_id, user_id, event_type, value FROM events")
reg("r2_stream_dedupe", lambda s, d: ev.available(ev.stream_dedupe(stream(s, d).withColumn("key", c("event_id")), "key")).select("event_id", "user_id"), "SELECT event_id, user_id FROM events")


def last_state(df, *key):
    last = F.max(F.struct("_batch", *[x for x in df.columns if x not in key and x != "_batch"]))
    return df.groupBy(*key).agg(last.alias("x")).select(*key, "x.*").drop("_batch")


reg("r3_stream_step_summary", lambda s, d: last_state(ev.available(ev.stream_step_summary(stream(s, d)), "update"), "user_id", "event_type"), "SELECT user_id, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events "
    "GROUP BY ALL")


def with_state_store(s, run):
    """State operators with several columns need the RocksDB provider; the session's own setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(name)
    s.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run()
    finally:
        s.conf.set(name, before)


_STATE = "CASE {0} WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'waiting' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END"
reg("r4_stream_turn_state", lambda s, d: with_state_store(s, lambda: last_state(ev.available(ev.stream_turn_state(stream(s, d)), "update").withColumn("steps", F.array_join("steps", "|")), "run_id")),
    f"SELECT user_id AS run_id, {_STATE.format('arg_max(event_type, (ts, event_id))')} AS status, array_to_string(list_sort(list(event_id)), '|') AS steps FROM events GROUP BY ALL")


def r5(s, d):
    """Every run's last row: its state, or timed_out where it stays open for a day of event time before the watermark."""
    rows = with_state_store(s, lambda: ev.available(ev.stream_deadline(stream(s, d), DAY_MS), "update"))
    return rows.filter("status = 'timed_out'").select("run_id", "status", F.array_join("steps", "|").alias("steps"))


DAY_MS = 24 * 3600 * 1000
# The watermark ends an hour before the newest event; an open run whose last event is a day older than that is timed out.
reg("r5_stream_deadline", r5, f""", last AS (SELECT user_id AS run_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS kind, array_to_string(list_sort(list(event_id)), '|') AS steps FROM events
  GROUP BY ALL),
 mark AS (SELECT max(ts) - INTERVAL 1 HOUR AS ts FROM events)
 SELECT run_id, 'timed_out' AS status, steps FROM last WHERE kind NOT IN ('purchase', 'error') AND epoch_ms(ts) + {DAY_MS} <= (SELECT epoch_ms(ts) FROM mark)""".replace(", last", "WITH last", 1))


def r6(s, d):
    import uuid

    folder = f"{ev.shared_folder(s)}/latest-{uuid.uuid4().hex}"
    q = ev.stream_latest(stream(s, d), folder, f"{folder}-checkpoint", "user_id", ["ts", "event_id"]).trigger(availableNow=True).start()
    q.awaitTermination()
    return ev.latest_table(s, folder).select("user_id", "event_id", "event_type")


reg("r6_stream_latest", r6, "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")


def r7(s, d):
    p = s.readStream.schema(corpus.table(s, d, "documents").schema).parquet(table_path(d, "documents"))
    lines = p.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    prefix = F.element_at(F.array(*map(F.lit, corpus.PREFIXES)), ((c("doc_id") + c("pos")) % 9 + 1).cast("int"))
    ps = lines.select("doc_id", F.concat(F.lit("p_"), c("pos").cast("string")).alias("paragraph_id"), F.concat(prefix, "line").alias("text"), F.when(c("pos") == 0, "heading").otherwise("body").alias("role"))
    return ev.available(ev.stream_warnings(ps, rules_table(s, [("body", "body_numbering_prefix")], "role STRING, code STRING")))


from .text_queries import PREFIX_SQL  # noqa: E402

reg("r7_stream_template_warnings", r7, f", p AS (SELECT doc_id, 'p_' || pos AS paragraph_id, ['1. ', '2.1 ', '(3) ', 'A. ', '一、', '0.7003', '', '', ''][(doc_id + pos) % 9 + 1] || line AS text, pos "
    f"FROM raw_lines), q AS (SELECT doc_id, paragraph_id, {PREFIX_SQL} AS prefix FROM p WHERE pos > 0) SELECT doc_id, paragraph_id, 'body_numbering_prefix' AS code, prefix FROM q WHERE prefix IS NOT NULL", CTE)


def u2(s, d):
    spec = wr.OperationSpec("set_shadow", "shadow", lambda p: F.when(F.lower(p).isin("soft", "hard"), F.lower(p)))
    i = corpus.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("set_shadow").alias("type"), F.when(c("l_partkey") % 3 == 0, "Soft").when(c("l_partkey") % 3 == 1, "HARD").otherwise("odd").alias("payload"))
    return wr.normalize_payload(i, (*wr.SPECS, spec)).select("l_orderkey", "l_linenumber", "attribute", "value", "error")


reg("u2_custom_operation", u2, "SELECT l_orderkey, l_linenumber, 'shadow' AS attribute, CASE l_partkey % 3 WHEN 0 THEN 'soft' WHEN 1 THEN 'hard' END AS value, CASE WHEN l_partkey % 3 = 2 THEN 'set_shadow: invalid payload' END AS error "
    "FROM lineitem")
