"""SQL names for the text and value functions: SQL functions, without Python per row."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text as tx


def _s(x: str) -> str:
    """x as a SQL string literal."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in(values) -> str:
    return "(" + ", ".join(map(_s, values)) + ")"


def _case(c: str, pairs: dict[str, str]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {_s(a)} THEN {_s(b)}" for a, b in pairs.items()) + " END"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, {_s('^\\s+|\\s+$')}, '')"


def _replaced(c: str, *pairs: tuple[str, str]) -> str:
    for pattern, by in pairs:
        c = f"regexp_replace({c}, {_s(pattern)}, {_s(by)})"
    return c


def _group(c: str, pattern: str) -> str:
    return f"nullif(regexp_extract({c}, {_s(pattern)}, 1), '')"


_NORMAL = _strip(_replaced("c", ("\\r\\n?", "\n"), ("[\\u200b-\\u200f\\ufeff]", ""), ("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", ""), ("[ \\t]+(\\n|$)", "$1"), ("\\n{3,}", "\n\n")))
_EACH = f"transform(regexp_extract_all(c, {_s(tx._BLOCK)}, 0), b -> named_struct('role', {_strip(f'regexp_extract(b, {_s(tx._BLOCK)}, 1)')}, 'content', {_strip(f'regexp_extract(b, {_s(tx._BLOCK)}, 2)')}, 'closed', endswith(rtrim(regexp_replace(b, {_s('\\n$')}, '')), {_s(tx.END)})))"
_BLOCK = "ARRAY<STRUCT<role: STRING, content: STRING, closed: BOOLEAN>>"
_SHOW = "b -> concat('<', b.role, '>\\n', b.content, '\\n</', b.role, '>\\n\\n')"
_MANY, _ONE, _WORDS = "^\\s*([1-9][0-9]*(?:\\.[0-9]{1,2})+)", "^\\s*([0-9]+[.)、．])", "(?:\\s+\\S|[A-Za-z\\u4E00-\\u9FFF（(])"
_NAMES = {k.lower(): k for k in tx.HIGHLIGHTS} | {h: k for k, h in tx.HIGHLIGHTS.items()} | {"#" + h: k for k, h in tx.HIGHLIGHTS.items()} | {"none": "none"}
_NUMBER = "try_cast(trim(c) AS DOUBLE)"
_PATTERNS = (f"[{tx.CHINESE}]+、", f"（[{tx.CHINESE}]+）", "[0-9]+\\.", "\\([0-9]+\\)")

# Later functions use earlier ones.
SQL_FUNCTIONS = {
    "strip_text": ("c STRING", "STRING", _strip("c")),
    "normalize_text": ("c STRING", "STRING", _NORMAL),
    "chatml_all_blocks": ("c STRING", _BLOCK, _EACH),
    "chatml_upto_blank": ("bs " + _BLOCK, _BLOCK, "CASE WHEN array_position(transform(bs, b -> b.role), '') > 0 THEN slice(bs, 1, cast(array_position(transform(bs, b -> b.role), '') - 1 AS INT)) ELSE bs END"),
    "chatml_blocks": ("c STRING", _BLOCK, "chatml_upto_blank(chatml_all_blocks(c))"),
    "assistant_of": (
        "t STRING", "STRING",
        f"CASE WHEN instr(t, {_s(tx.START)}) = 0 THEN t WHEN normalize_text(substring(t, 1, greatest(instr(t, {_s(tx.START)}) - 1, 0))) <> '' THEN normalize_text(substring(t, 1, greatest(instr(t, {_s(tx.START)}) - 1, 0)))"
        f" ELSE coalesce(normalize_text(try_element_at(filter(chatml_blocks(t), b -> b.role = 'assistant' AND b.content <> ''), -1).content), normalize_text(replace(replace(t, {_s(tx.START)}, ''), {_s(tx.END)}, ''))) END",
    ),
    "assistant_output": ("c STRING", "STRING", "assistant_of(normalize_text(c))"),
    "markdown_of": (
        "t STRING, bs " + _BLOCK, "STRING",
        "CASE WHEN size(bs) = 0 THEN t ELSE coalesce(nullif(strip_text(concat("
        f"CASE WHEN exists(bs, b -> b.role = 'system' AND b.closed) THEN concat('## System\\n', array_join(transform(filter(bs, b -> b.role = 'system' AND b.closed), {_SHOW}), '')) ELSE '' END, "
        f"CASE WHEN exists(bs, b -> b.role IN ('user', 'assistant')) THEN concat('## Conversation\\n', array_join(transform(filter(bs, b -> b.role = 'user' OR b.role = 'assistant' AND b.closed), {_SHOW}), '')) ELSE '' END, "
        "CASE WHEN exists(bs, b -> b.role = 'assistant' AND NOT b.closed) THEN '## Assistant\\n<assistant>' ELSE '' END)), ''), t) END",
    ),
    "transcript_markdown": ("c STRING", "STRING", "markdown_of(normalize_text(c), chatml_blocks(normalize_text(c)))"),
    "truncate_text": ("c STRING, n INT", "STRING", "CASE WHEN length(strip_text(c)) > n THEN concat(substring(strip_text(c), 1, n - 3), '...') ELSE strip_text(c) END"),
    "numbering_prefix": (
        "c STRING", "STRING",
        f"coalesce(CASE WHEN c RLIKE {_s(_MANY)} THEN CASE WHEN regexp_replace(c, {_s(_MANY)}, '') RLIKE {_s('^[)）、．。]')} THEN concat({_group('c', _MANY)}, substring(regexp_replace(c, {_s(_MANY)}, ''), 1, 1))"
        f" WHEN regexp_replace(c, {_s(_MANY)}, '') RLIKE {_s('^' + _WORDS)} THEN {_group('c', _MANY)} END END, CASE WHEN regexp_replace(c, {_s(_ONE)}, '') RLIKE {_s('^' + _WORDS)} THEN {_group('c', _ONE)} END, "
        + ", ".join(_group("c", p) for p in (f"^\\s*([{tx.CHINESE}]+[、.)．])", f"^\\s*([（(][{tx.CHINESE}0-9]+[）)])", "^\\s*([A-Za-z][.)])")) + ")",
    ),
    "numbering_pattern": ("c STRING", "STRING", "coalesce(" + ", ".join(_group("strip_text(c)", f"^({p})") for p in _PATTERNS) + ")"),
    "comparable_text": ("c STRING", "STRING", f"regexp_replace(lower(c), {_s('[^\\p{L}\\p{N}]+')}, '')"),
    "contains_text": ("a STRING, b STRING", "BOOLEAN", "contains(lower(a), lower(b))"),
    "char_language": ("c STRING", "STRING", f"CASE WHEN c RLIKE {_s('\\p{IsHan}')} THEN 'zh' WHEN c RLIKE {_s('[\\p{IsLatin}\\p{Nd}]')} THEN 'en' WHEN c RLIKE {_s('\\p{P}')} THEN 'punct' ELSE 'other' END"),
    "single_language": ("c STRING", "STRING", f"CASE WHEN c RLIKE {_s('\\p{IsHan}')} AND NOT c RLIKE {_s('[\\p{IsLatin}\\p{Nd}]')} THEN 'zh' WHEN c RLIKE {_s('[\\p{IsLatin}\\p{Nd}]')} AND NOT c RLIKE {_s('\\p{IsHan}')} THEN 'en' END"),
    "heading_level_by_name": ("c STRING", "INT", f"cast({_group('lower(trim(c))', '^(?:heading|标题)\\s*([1-9])$')} AS INT)"),
    "heading_level_by_id": ("c STRING", "INT", f"cast({_group('lower(c)', 'heading\\s*([1-9])')} AS INT)"),
    "list_level": ("is_numbered BOOLEAN, ilvl STRING", "INT", "CASE WHEN is_numbered THEN coalesce(try_cast(ilvl AS INT), 0) END"),
    "line_spacing": (
        "line STRING, rule STRING", "STRUCT<mode: STRING, value: DOUBLE>",
        "CASE WHEN try_cast(line AS DOUBLE) > 0 AND NOT isnan(try_cast(line AS DOUBLE)) AND lower(coalesce(rule, '')) IN ('exact', '', 'auto') THEN named_struct('mode', CASE WHEN lower(rule) = 'exact' THEN 'exact' ELSE 'multiple' END,"
        " 'value', CASE WHEN lower(rule) = 'exact' THEN round(try_cast(line AS DOUBLE) / 20, 4) ELSE round(try_cast(line AS DOUBLE) / 240, 4) END) END",
    ),
    "hex_color": ("c STRING", "STRING", f"CASE WHEN regexp_replace(strip_text(c), '^#', '') RLIKE {_s('^[0-9a-fA-F]{6}$')} THEN upper(regexp_replace(strip_text(c), '^#', '')) END"),
    "highlight_color": ("c STRING", "STRING", _case(f"lower(regexp_replace(c, {_s('\\s+')}, ''))", _NAMES)),
    "paper_size": ("c STRING", "STRING", "CASE lower(strip_text(c)) WHEN 'a4' THEN 'A4' WHEN 'letter' THEN 'Letter' END"),
    "to_half_points": ("pt DOUBLE", "BIGINT", "CAST(round(pt * 2) AS BIGINT)"),
    "to_twips": ("pt DOUBLE", "BIGINT", "CAST(round(pt * 20) AS BIGINT)"),
    "to_line": ("multiple DOUBLE", "BIGINT", "CAST(round(multiple * 240) AS BIGINT)"),
    "cm_to_twips": ("cm DOUBLE", "BIGINT", "CAST(round(cm * 567) AS BIGINT)"),
    "emu_to_px": ("emu DOUBLE", "DOUBLE", "round(emu / 9525, 2)"),
    "pt_to_px": ("pt DOUBLE", "DOUBLE", "round(pt * 96 / 72, 2)"),
    "loose_boolean": ("c STRING", "BOOLEAN", "CASE WHEN lower(strip_text(c)) IN ('true', '1') THEN true WHEN lower(strip_text(c)) IN ('false', '0') THEN false END"),
    "positive_number": ("c STRING", "DOUBLE", f"CASE WHEN {_NUMBER} > 0 AND NOT isnan({_NUMBER}) THEN {_NUMBER} END"),
    "non_negative_number": ("c STRING", "DOUBLE", f"CASE WHEN {_NUMBER} >= 0 AND NOT isnan({_NUMBER}) THEN {_NUMBER} END"),
    "positive_integer": ("c STRING", "DOUBLE", f"CASE WHEN {_NUMBER} > 0 AND {_NUMBER} = floor({_NUMBER}) AND NOT isnan({_NUMBER}) THEN {_NUMBER} END"),
    "first_text": ("a STRING, b STRING", "STRING", "coalesce(nullif(strip_text(a), ''), nullif(strip_text(b), ''))"),
    "is_placeholder": ("c STRING", "BOOLEAN", f"lower(strip_text(c)) IN {_in(tx.PLACEHOLDERS)}"),
    "scope_form": ("c STRING", "STRING", f"regexp_replace(lower(strip_text(c)), {_s('[\\s-]+')}, '_')"),
    "selector_scope": ("c STRING", "STRING", f"CASE WHEN scope_form(c) IN {_in(tx.SCOPES)} THEN scope_form(c) END"),
    "id_list": ("c STRING", "ARRAY<STRING>", f"array_distinct(filter(transform(split(c, ','), x -> {_strip('x')}), x -> x <> ''))"),
    "expand_body_scope": (
        "goal STRING, said STRING", "BOOLEAN",
        f"contains(concat(said, '\\n', goal), '正文') AND NOT contains(goal, '普通正文和项目符号/编号段落') AND NOT concat(said, '\\n', goal) RLIKE {_s(tx.LIST_WORDS)} AND NOT concat(said, '\\n', goal) RLIKE {_s(tx.NO_LIST_WORDS)}",
    ),
    "scope_from_step": ("c STRING", "STRING", "CASE " + " ".join(f"WHEN contains(lower(c), {_s(a)}) THEN {_s(b)}" for a, b in tx.STEP_SCOPES) + " END"),
    "scope_label": ("c STRING", "STRING", _case("c", tx.SCOPE_LABELS)),
    "operation_label": ("c STRING", "STRING", _case("c", tx.OPERATION_LABELS)),
    "sentence_of": ("t STRING", "STRING", f"CASE WHEN t = '' OR t RLIKE {_s('[。！？.!?]$')} THEN t ELSE concat(t, '。') END"),
    "clean_sentence": ("c STRING", "STRING", f"sentence_of(strip_text(regexp_replace(coalesce(c, ''), {_s('\\s+')}, ' ')))"),
    "pattern_match": ("value STRING, pattern STRING", "BOOLEAN", "regexp_like(value, pattern)"),
}


def register(spark: SparkSession) -> None:
    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
