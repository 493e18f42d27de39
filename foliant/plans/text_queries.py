"""Queries of the text and value functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import register as registered
from foliant.functions import structure as st
from foliant.functions import text as tx
from foliant.sources import corpus

from . import views

QUERIES: dict = {}
SQL: dict[str, str] = {}

STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def strip(c: str) -> str:
    return STRIP.format(c)


def over(view, name: str, columns, sql: str, keys: tuple[str, ...], *ctes: str, source: str = "", where=None) -> None:
    """Register a projection of a view and its SQL. columns: a function that gives them, called once Spark runs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = view(spark, sf_dir)
        return df.select(*keys, *[c.alias(n) for n, c in columns().items()])

    QUERIES[name] = run
    SQL[name] = views.query(f"SELECT {', '.join(keys)}, {sql} FROM {source}", *ctes)


def paragraph(name: str, column, sql: str, many: bool = False) -> None:
    columns = column if many else lambda: {"value": column()}
    sql = sql if many else f"{sql} AS value"
    over(corpus.paragraphs, name, columns, sql, ("doc_id", "paragraph_index"), views.PARAGRAPHS, source="paragraphs")


def order_line(name: str, columns, sql: str) -> None:
    over(lambda s, d: corpus.table(s, d, "lineitem"), name, columns, sql, ("l_orderkey", "l_linenumber"), source="lineitem")


c = F.col
NOISY = lambda: F.replace(F.col("text"), F.lit(", "), F.lit(" \t\r\n​\u0007\n\n "))
NOISY_SQL = "replace(text, ', ', ' ' || chr(9) || chr(13) || chr(10) || chr(8203) || chr(7) || chr(10) || chr(10) || ' ')"


def norm(x: str) -> str:
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '[\\x{{200b}}-\\x{{200f}}\\x{{feff}}]', '', 'g')"
    x = f"regexp_replace({x}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"
    x = f"regexp_replace({x}, '[ \\t]+(\\n|$)', '\\1', 'g')"
    return strip(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


over(lambda s, d: corpus.table(s, d, "documents"), "f1_normalize_text", lambda: {"value": tx.normalize_text(NOISY())}, norm(NOISY_SQL) + " AS value", ("doc_id",), source="documents")

BLOCK = "<\\|im_start\\|>([^\\n]*)\\n([\\s\\S]*?)(?:<\\|im_end\\|>\\n?|$)"
BLOCKS = f"""pieces AS (SELECT conv_id, text, unnest(regexp_extract_all(text, '{BLOCK}', 0)) AS b, generate_subscripts(regexp_extract_all(text, '{BLOCK}', 0), 1) AS block_no FROM normalized),
parsed AS (SELECT conv_id, block_no::INTEGER AS block_no, {strip(f"regexp_extract(b, '{BLOCK}', 1)")} AS role, {strip(f"regexp_extract(b, '{BLOCK}', 2)")} AS content,
 regexp_replace(b, '\\n$', '') LIKE '%<|im_end|>' AS closed FROM pieces),
blocks AS (SELECT * FROM parsed p WHERE block_no < coalesce((SELECT min(block_no) FROM parsed q WHERE q.conv_id = p.conv_id AND q.role = ''), 1000000000))"""
NORMALIZED = f"normalized AS (SELECT conv_id, {norm('transcript')} AS text FROM transcripts)"


def f2_chatml_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus.transcripts(spark, sf_dir).withColumn("text", tx.normalize_text("transcript"))
    b = t.select("conv_id", F.posexplode(tx.chatml_blocks("text")).alias("i", "b"))
    return b.select("conv_id", (c("i") + 1).alias("block_no"), "b.role", "b.content", "b.closed")


QUERIES["f2_chatml_blocks"] = f2_chatml_blocks
SQL["f2_chatml_blocks"] = views.query("SELECT conv_id, block_no, role, content, closed FROM blocks", views.TRANSCRIPTS, NORMALIZED, BLOCKS)

over(
    corpus.transcripts, "f3_assistant_output", lambda: {"value": tx.assistant_output("transcript")},
    f"""CASE WHEN strpos(text, '<|im_start|>') = 0 THEN text WHEN {norm("substr(text, 1, strpos(text, '<|im_start|>') - 1)")} <> '' THEN {norm("substr(text, 1, strpos(text, '<|im_start|>') - 1)")}
 ELSE coalesce((SELECT {norm("arg_max(content, block_no)")} FROM blocks b WHERE b.conv_id = n.conv_id AND role = 'assistant' AND content <> ''),
 {norm("replace(replace(text, '<|im_start|>', ''), '<|im_end|>', '')")}) END AS value""",
    ("conv_id",), views.TRANSCRIPTS, NORMALIZED, BLOCKS, source="normalized n",
)
_SHOW = "'<' || role || '>' || chr(10) || content || chr(10) || '</' || role || '>' || chr(10) || chr(10)"
over(
    corpus.transcripts, "f4_transcript_markdown", lambda: {"value": tx.transcript_markdown("transcript")},
    f"""coalesce((SELECT nullif({strip(f'''coalesce('## System' || chr(10) || string_agg({_SHOW}, '' ORDER BY block_no) FILTER (role = 'system' AND closed), '')
 || CASE WHEN count(*) FILTER (role IN ('user', 'assistant')) > 0 THEN '## Conversation' || chr(10) ELSE '' END
 || coalesce(string_agg({_SHOW}, '' ORDER BY block_no) FILTER (role = 'user' OR (role = 'assistant' AND closed)), '')
 || CASE WHEN count(*) FILTER (role = 'assistant' AND NOT closed) > 0 THEN '## Assistant' || chr(10) || '<assistant>' ELSE '' END''')}, '') FROM blocks b WHERE b.conv_id = n.conv_id), text) AS value""",
    ("conv_id",), views.TRANSCRIPTS, NORMALIZED, BLOCKS, source="normalized n",
)

T = strip("text")
paragraph("f5_truncate_text", lambda: tx.truncate_text("text", 60), f"CASE WHEN length({T}) > 60 THEN substr({T}, 1, 57) || '...' ELSE {T} END")

MANY, ONE = "^\\s*([1-9][0-9]*(?:\\.[0-9]{1,2})+)", "^\\s*([0-9]+[.)、．])"
WORDS = "^(?:\\s+\\S|[A-Za-z\\x{4E00}-\\x{9FFF}（(])"
REST = f"regexp_replace(text, '{MANY}', '')"


def got(x: str, p: str) -> str:
    return f"nullif(regexp_extract({x}, '{p}', 1), '')"


PREFIX_SQL = f"""coalesce(CASE WHEN regexp_matches(text, '{MANY}') THEN CASE WHEN regexp_matches({REST}, '^[)）、．。]') THEN {got('text', MANY)} || substr({REST}, 1, 1)
 WHEN regexp_matches({REST}, '{WORDS}') THEN {got('text', MANY)} END END,
 CASE WHEN regexp_matches(regexp_replace(text, '{ONE}', ''), '{WORDS}') THEN {got('text', ONE)} END,
 {got('text', '^\\s*([一二三四五六七八九十]+[、.)．])')}, {got('text', '^\\s*([（(][一二三四五六七八九十0-9]+[）)])')}, {got('text', '^\\s*([A-Za-z][.)])')})"""
paragraph("f6_numbering_prefix", lambda: tx.numbering_prefix("text"), PREFIX_SQL)
PATTERN_SQL = "coalesce(" + ", ".join(got(T, f"^({p})") for p in ("[一二三四五六七八九十]+、", "（[一二三四五六七八九十]+）", "[0-9]+\\.", "\\([0-9]+\\)")) + ")"
paragraph("f7_numbering_pattern", lambda: tx.numbering_pattern("text"), PATTERN_SQL)
COMPARABLE = "regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g')"
paragraph("f8_comparable_text", lambda: tx.comparable_text("text"), COMPARABLE)
paragraph("f9_contains_text", lambda: tx.contains_text("text", F.lit("THE AND")), "contains(lower(text), 'the and')")


def f10_char_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = corpus.paragraphs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''")
    return ch.groupBy("doc_id", tx.char_language("ch").alias("language")).agg(F.count("*").alias("n"))


CHAR_SQL = "CASE WHEN regexp_matches(ch, '\\p{Han}') THEN 'zh' WHEN regexp_matches(ch, '[\\p{Latin}\\p{Nd}]') THEN 'en' WHEN regexp_matches(ch, '\\p{P}') THEN 'punct' ELSE 'other' END"
QUERIES["f10_char_language"] = f10_char_language
SQL["f10_char_language"] = views.query(
    f"SELECT doc_id, {CHAR_SQL} AS language, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM paragraphs) WHERE ch <> '' GROUP BY ALL", views.PARAGRAPHS
)
paragraph(
    "f11_single_language", lambda: tx.single_language("text"),
    "CASE WHEN regexp_matches(text, '\\p{Han}') AND NOT regexp_matches(text, '[\\p{Latin}\\p{Nd}]') THEN 'zh' WHEN regexp_matches(text, '[\\p{Latin}\\p{Nd}]') AND NOT regexp_matches(text, '\\p{Han}') THEN 'en' END",
)
paragraph(
    "f12_heading_level", lambda: {"by_name": st.heading_level_by_name("style_name"), "by_id": st.heading_level_by_id(F.replace("style_name", F.lit(" "), F.lit("")))},
    f"{views.LEVEL} AS by_name, try_cast(nullif(regexp_extract(lower(replace(style_name, ' ', '')), 'heading\\s*([1-9])', 1), '') AS INTEGER) AS by_id",
    many=True,
)
paragraph("f13_list_level", lambda: st.list_level("is_numbered", "num_ilvl"), "CASE WHEN is_numbered THEN coalesce(try_cast(num_ilvl AS INTEGER), 0) END")

RULE = lambda: F.when(c("l_linenumber") % 4 == 0, "exact").when(c("l_linenumber") % 4 == 1, "auto").when(c("l_linenumber") % 4 == 2, "atLeast")
SPACING = lambda: tx.line_spacing((c("l_quantity") * 10 - 50).cast("string"), RULE())
order_line(
    "f14_line_spacing", lambda: {"mode": SPACING()["mode"], "value": SPACING()["value"]},
    """CASE WHEN l_quantity * 10 - 50 > 0 AND l_linenumber % 4 <> 2 THEN CASE WHEN l_linenumber % 4 = 0 THEN 'exact' ELSE 'multiple' END END AS mode,
 CASE WHEN l_quantity * 10 - 50 > 0 AND l_linenumber % 4 <> 2 THEN CASE WHEN l_linenumber % 4 = 0 THEN round((l_quantity * 10 - 50) / 20, 4) ELSE round((l_quantity * 10 - 50) / 240, 4) END END AS value""",
)
CODE = lambda: F.concat(F.when(c("l_linenumber") % 2 == 0, " #").otherwise(""), F.lpad(F.lower(F.hex("l_partkey")), 6, "0"), F.when(c("l_suppkey") % 5 == 0, "g").otherwise(" "))
CODE_SQL = "((CASE WHEN l_linenumber % 2 = 0 THEN ' #' ELSE '' END) || lpad(lower(to_hex(l_partkey)), 6, '0') || (CASE WHEN l_suppkey % 5 = 0 THEN 'g' ELSE ' ' END))"
_PLAIN = f"regexp_replace({strip(CODE_SQL)}, '^#', '')"
order_line("f15_hex_color", lambda: {"value": tx.hex_color(CODE())}, f"CASE WHEN regexp_matches({_PLAIN}, '^[0-9a-fA-F]{{6}}$') THEN upper({_PLAIN}) END AS value")
SHADES = ["Yellow", "# 00FF00", "00ffff", "Dark Blue", "#c0c0c0", "none", "mauve", "808000", "BLACK"]
SHADE_LIST = "[" + ", ".join(f"'{x}'" for x in SHADES) + "]"
_ALIASES = {k.lower(): k for k in tx.HIGHLIGHTS} | {h: k for k, h in tx.HIGHLIGHTS.items()} | {"#" + h: k for k, h in tx.HIGHLIGHTS.items()} | {"none": "none"}
order_line(
    "f16_highlight_color", lambda: {"value": tx.highlight_color(F.element_at(F.array(*map(F.lit, SHADES)), (c("l_partkey") % 9 + 1).cast("int")))},
    "CASE regexp_replace(lower(" + SHADE_LIST + "[l_partkey % 9 + 1]), '\\s+', '', 'g') " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _ALIASES.items()) + " END AS value",
)
SIZES = ["a4", " A4 ", "letter", "A3", "LETTER"]
_size = lambda x: f"CASE lower(trim({x})) WHEN 'a4' THEN 'A4' WHEN 'letter' THEN 'Letter' END"
order_line(
    "f17_paper_size", lambda: {"value": tx.paper_size(F.element_at(F.array(*map(F.lit, SIZES)), (c("l_partkey") % 5 + 1).cast("int")), F.when(c("l_suppkey") % 2 == 0, "letter"))},
    f"coalesce({_size(str(SIZES) + '[l_partkey % 5 + 1]')}, CASE WHEN l_suppkey % 2 = 0 THEN 'Letter' END) AS value",
)
order_line(
    "f18_unit_conversions",
    lambda: {"half_points": tx.to_half_points("l_quantity"), "twips": tx.to_twips("l_quantity"), "line": tx.to_line("l_quantity"), "cm": tx.cm_to_twips("l_quantity"), "px": tx.emu_to_px(c("l_partkey") * 9525),
        "pt": tx.pt_to_px("l_quantity")},
    """round(l_quantity * 2)::BIGINT AS half_points, round(l_quantity * 20)::BIGINT AS twips, round(l_quantity * 240)::BIGINT AS line, round(l_quantity * 567)::BIGINT AS cm,
 round(l_partkey * 9525 / 9525::DOUBLE, 2) AS px, round(l_quantity * 96 / 72, 2) AS pt""",
)
FLAGS = ["true", "1", " FALSE ", "0", "yes", ""]
order_line(
    "f19_loose_boolean", lambda: {"value": tx.loose_boolean(F.element_at(F.array(*map(F.lit, FLAGS)), (c("l_partkey") % 6 + 1).cast("int")))},
    f"CASE WHEN lower(trim({FLAGS}[l_partkey % 6 + 1])) IN ('true', '1') THEN true WHEN lower(trim({FLAGS}[l_partkey % 6 + 1])) IN ('false', '0') THEN false END AS value",
)
NUMBERS = ["12", "-3", "abc", " 7.5 ", "0"]
_n = f"try_cast(trim({NUMBERS}[l_partkey % 5 + 1]) AS DOUBLE)"
_first = lambda: F.element_at(F.array(*map(F.lit, NUMBERS)), (c("l_partkey") % 5 + 1).cast("int"))
order_line(
    "f20_first_number", lambda: {"positive": tx.first_number("positive", _first(), c("l_suppkey") + 1), "non_negative": tx.first_number("non_negative", _first(), c("l_suppkey") + 1), "whole": tx.first_number("integer", _first(),
        c("l_suppkey") + 1)},
    f"""coalesce(CASE WHEN {_n} > 0 THEN {_n} END, (l_suppkey + 1)::DOUBLE) AS positive, coalesce(CASE WHEN {_n} >= 0 THEN {_n} END, (l_suppkey + 1)::DOUBLE) AS non_negative,
 coalesce(CASE WHEN {_n} > 0 AND {_n} = floor({_n}) THEN {_n} END, (l_suppkey + 1)::DOUBLE) AS whole""",
)
paragraph("f21_first_text", lambda: tx.first_text("text", "style_name"), f"coalesce(nullif({T}, ''), nullif({strip('style_name')}, ''))")
WORD = "regexp_extract(lower(text), '^\\s*(\\S+)', 1)"
MARKS = ["Todo", " tbd ", "Target", "real"]
paragraph("f22_is_placeholder", lambda: tx.is_placeholder(F.element_at(F.array(*map(F.lit, MARKS)), (c("doc_id") % 4 + 1).cast("int"))), f"lower(trim({MARKS}[doc_id % 4 + 1])) IN ('placeholder', 'unused', 'target', 'todo', 'tbd')")
ASKED = ["Body", "list item", "List-Item", "all  text", "headings", "paragraph-ids"]
_asked = f"regexp_replace(lower(trim({ASKED}[doc_id % 6 + 1])), '[\\s-]+', '_', 'g')"
paragraph("f23_selector_scope", lambda: tx.selector_scope(F.element_at(F.array(*map(F.lit, ASKED)), (c("doc_id") % 6 + 1).cast("int"))), f"CASE WHEN {_asked} IN ('body', 'heading', 'list_item', 'paragraph_ids', 'all_text') "
    f"THEN {_asked} END")
paragraph("f24_id_list", lambda: F.array_join(F.array_sort(tx.id_list("text")), "|"), f"array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(text, ','), lambda x: {strip('x')}), lambda x: x <> ''))), '|')")
GOALS = ["把正文设为宋体", "正文和列表项", "普通正文加粗", "标题加粗", "正文 bullet"]
_goal = lambda: F.element_at(F.array(*map(F.lit, GOALS)), (c("doc_id") % 5 + 1).cast("int"))
_g = f"{GOALS}[doc_id % 5 + 1]"
paragraph(
    "f25_expand_body_scope", lambda: tx.expand_body_scope(_goal(), "text"),
    f"contains(text || chr(10) || {_g}, '正文') AND NOT contains({_g}, '普通正文和项目符号/编号段落') AND NOT regexp_matches(text || chr(10) || {_g}, '(?i)(list_item|列表项|列表段落|项目符号|编号段落|编号列表|有序列表|无序列表|bullet|numbered)') "
        f"AND NOT regexp_matches(text || chr(10) || {_g}, '(普通正文|纯正文|正文（不含列表）|正文\\(不含列表\\)|不含列表|不包括列表|排除列表)')",
)
STEP_IDS = ["set_heading_1", "BODY-font", "list_all_text", "all_text_x", "paragraph_7", "misc"]
_id = f"lower({STEP_IDS}[doc_id % 6 + 1])"
paragraph(
    "f26_scope_from_step", lambda: tx.scope_from_step(F.element_at(F.array(*map(F.lit, STEP_IDS)), (c("doc_id") % 6 + 1).cast("int"))),
    f"CASE WHEN contains({_id}, 'heading') THEN 'heading' WHEN contains({_id}, 'body') THEN 'body' WHEN contains({_id}, 'list') THEN 'list_item' WHEN contains({_id}, 'all_text') THEN 'all_text' WHEN contains({_id}, 'paragraph') "
        f"THEN 'paragraph_ids' END",
)
_case = lambda x, pairs: f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + " END"
over(corpus.steps, "f27_labels", lambda: {"scope_label": tx.scope_label("scope"), "operation_label": tx.operation_label("op_type")},
    f"{_case('scope', tx.SCOPE_LABELS)} AS scope_label, {_case('op_type', tx.OPERATION_LABELS)} AS operation_label", ("step_id",), views.STEPS, source="steps")
_clean = strip("regexp_replace(text, '\\s+', ' ', 'g')")
paragraph("f28_clean_sentence", lambda: tx.clean_sentence("text"), f"CASE WHEN {_clean} = '' OR regexp_matches({_clean}, '[。！？.!?]$') THEN {_clean} ELSE {_clean} || '。' END")
paragraph("f29_pattern_match", lambda: tx.pattern_match("text", ["^[0-9]+\\. ", "(unclosed", "^\\(3\\)"]), "regexp_matches(text, '^[0-9]+\\. ') OR text = '(unclosed' OR regexp_matches(text, '^\\(3\\)')")


def u1_register_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    registered.register(spark)
    p = corpus.paragraphs(spark, sf_dir)
    return p.selectExpr("doc_id", "paragraph_index", "comparable_text(text) AS comparable", "truncate_text(text, 20) AS short", "contains_text(text, 'the') AS has_the", "to_half_points(doc_id / 2.0D) AS half_points")


QUERIES["u1_register_functions"] = u1_register_functions
SQL["u1_register_functions"] = views.query(f"SELECT doc_id, paragraph_index, {COMPARABLE} AS comparable, CASE WHEN length(trim(text)) > 20 "
    f"THEN substr(trim(text), 1, 17) || '...' ELSE trim(text) END AS short, contains(lower(text), 'the') AS has_the, round(doc_id / 2.0 * 2)::BIGINT AS half_points FROM paragraphs", views.PARAGRAPHS)
