"""The corpus views of sources.corpus as SQL, for the oracles."""

from __future__ import annotations

BODY_STYLE = "lower(trim(style_name))"
LEVEL = f"try_cast(nullif(regexp_extract({BODY_STYLE}, '^(?:heading|标题)\\s*([1-9])$', 1), '') AS INTEGER)"
ROLE_BY_NAME = f"""CASE WHEN {LEVEL} IS NOT NULL THEN 'heading' WHEN {BODY_STYLE} = 'title' THEN 'title' WHEN {BODY_STYLE} = 'subtitle' THEN 'subtitle'
 WHEN is_numbered THEN 'list_item' WHEN in_table THEN 'table_text' WHEN regexp_replace(text, '\\s+', '', 'g') <> '' THEN 'body' ELSE 'unknown' END"""

RAW = """raw_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS pos FROM documents),
raw_paragraphs AS (SELECT doc_id, 'p_' || pos AS paragraph_id, pos AS paragraph_index,
 CASE WHEN (doc_id + pos) % 11 = 5 THEN '' ELSE ['1. ', '2.1 ', '(3) ', 'A. ', '一、', '0.7003', '', '', ''][(doc_id + pos) % 9 + 1] || line END AS text,
 CASE WHEN (doc_id + pos) % 13 = 0 THEN 'heading 2' WHEN (doc_id + pos) % 17 = 1 THEN '标题3' WHEN (doc_id + pos) % 19 = 2 THEN 'Title'
  WHEN (doc_id + pos) % 23 = 3 THEN 'Subtitle' ELSE 'Normal' END AS style_name,
 CASE WHEN (doc_id + pos) % 7 = 0 THEN ((doc_id + pos) % 3)::VARCHAR WHEN (doc_id + pos) % 7 = 1 THEN 'x' END AS num_ilvl,
 (doc_id + pos) % 7 <= 1 AS is_numbered, (doc_id + pos) % 10 = 7 AS in_table,
 (CASE WHEN (doc_id + pos) % 8 = 3 THEN (doc_id + pos) % 2 + 1 ELSE 0 END)::INTEGER AS n_images,
 CASE WHEN (doc_id + pos) % 29 = 0 THEN 'header' WHEN (doc_id + pos) % 29 = 1 THEN 'footer' WHEN (doc_id + pos) % 31 = 0 THEN 'footnotes'
  WHEN (doc_id + pos) % 37 = 0 THEN 'endnotes' ELSE 'main_document' END AS part_kind
 FROM raw_lines)"""

PARAGRAPHS = RAW + f""",
paragraphs AS (SELECT *, {LEVEL} AS heading_level, CASE WHEN is_numbered THEN coalesce(try_cast(num_ilvl AS INTEGER), 0) END AS list_level, {ROLE_BY_NAME} AS role FROM raw_paragraphs)"""

RUN_PIECES = """run_pieces AS (SELECT doc_id, paragraph_id, paragraph_index, in_table, style_name, unnest(string_split(text, '. ')) AS text, (generate_subscripts(string_split(text, '. '), 1) - 1)::INTEGER AS run_index FROM raw_paragraphs),
runs AS (SELECT doc_id, paragraph_id, paragraph_index, run_index, in_table, style_name, paragraph_id || '_r_' || run_index AS run_id, text,
 CASE m % 3 WHEN 0 THEN 'SimSun' WHEN 1 THEN 'Arial' END AS font_name, CASE m % 4 WHEN 1 THEN 10.5::DOUBLE WHEN 2 THEN 12.0::DOUBLE WHEN 3 THEN 16.0::DOUBLE END AS font_size_pt,
 CASE WHEN m % 6 = 0 THEN 'FF0000' END AS font_color, CASE m % 5 WHEN 0 THEN true WHEN 1 THEN false END AS is_bold, CASE WHEN m % 7 = 0 THEN true END AS is_italic,
 CASE WHEN m % 11 = 0 THEN true END AS is_underline, CASE WHEN m % 23 = 0 THEN 'yellow' END AS highlight_color
 FROM (SELECT *, doc_id + paragraph_index * 3 + run_index AS m FROM run_pieces) WHERE length(text) > 0)"""

ALL = PARAGRAPHS + ",\n" + RUN_PIECES

STEPS = """steps AS (SELECT user_id AS run_id, event_id AS step_id, ts, op_type, op_type = 'inspect' AS read_only, 'key-' || user_id || '-' || event_id % 50 AS idempotency_key,
 CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status, ['body', 'heading', 'list_item'][event_id % 3 + 1] AS scope,
 (event_id % 4)::INTEGER AS retries, round(value, 3) AS duration_ms, (event_id % 9)::INTEGER AS n_targets, event_type, event_id % 6 = 0 AS approved
 FROM (SELECT *, ['set_font', 'set_size', 'merge_paragraph', 'set_bold', 'inspect', 'set_alignment', 'split_paragraph'][event_id % 7 + 1] AS op_type FROM events))"""

SEQ = "(l_linenumber * 1000000000000 + l_partkey * 10000000 + l_suppkey * 100 + l_quantity::BIGINT)"
OPS = f"""ops AS (SELECT l_orderkey AS doc_id, {SEQ} AS seq, (l_partkey % 8)::INTEGER AS run_no,
 CASE l_linenumber % 5 WHEN 0 THEN 'font_name' WHEN 1 THEN 'font_size_pt' WHEN 2 THEN 'is_bold' WHEN 3 THEN 'font_color' ELSE 'highlight_color' END AS attribute,
 CASE l_linenumber % 5 WHEN 0 THEN l_returnflag WHEN 1 THEN (l_quantity::INTEGER % 20)::VARCHAR WHEN 2 THEN CASE WHEN l_linestatus = 'O' THEN 'true' ELSE 'maybe' END
 WHEN 3 THEN '#00ff0' || l_suppkey % 10 ELSE CASE WHEN l_suppkey % 2 = 0 THEN 'Yellow' ELSE 'mauve' END END AS value FROM lineitem)"""

TRANSCRIPTS = """whole AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS w FROM conversations GROUP BY conv_id),
transcripts AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN w || '<|im_start|>assistant' || chr(10) || 'to be continued' WHEN 1 THEN 'Well: ' || w ELSE w END AS transcript FROM whole)"""


def query(sql: str, *views: str) -> str:
    """The views as common tables before sql; sql may begin with ", name AS (...)" to add its own."""
    return "WITH " + ",\n".join(views) + "\n" + sql if views else sql
