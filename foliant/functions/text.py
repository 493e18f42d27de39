"""Text and value functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Transcript markers.
START, END = "<|im_start|>", "<|im_end|>"
_BLOCK = "<\\|im_start\\|>([^\\n]*)\\n([\\s\\S]*?)(?:<\\|im_end\\|>\\n?|$)"

# Highlight colour names and their hex codes.
HIGHLIGHTS = {
    "yellow": "ffff00", "green": "00ff00", "cyan": "00ffff", "magenta": "ff00ff", "blue": "0000ff", "red": "ff0000",
    "darkBlue": "000080", "darkCyan": "008080", "darkGreen": "008000", "darkMagenta": "800080", "darkRed": "800000",
    "darkYellow": "808000", "darkGray": "808080", "lightGray": "c0c0c0", "black": "000000",
}
# Display names of scopes and operations.
SCOPE_LABELS = {"body": "正文", "heading": "标题", "list_item": "列表", "all_text": "全文", "paragraph_ids": "指定段落", "table_text": "表格"}
OPERATION_LABELS = {
    "set_font": "字体", "set_size": "字号", "set_line_spacing": "行间距", "set_font_color": "颜色", "set_alignment": "对齐方式",
    "set_bold": "加粗", "set_italic": "斜体", "set_underline": "下划线", "set_strike": "删除线", "set_highlight_color": "高亮颜色",
    "set_all_caps": "大写", "set_page_layout": "页面布局", "set_paragraph_spacing": "段落间距", "set_paragraph_indent": "段落缩进",
    "set_style_definition": "样式定义", "set_numbering_level": "编号级别", "set_settings_flag": "文档设置", "set_attr": "XML 属性",
    "remove_attr": "XML 属性移除", "set_text": "XML 文本", "remove_node": "XML 节点移除", "ensure_node": "XML 节点补齐",
    "replace_node_xml": "XML 节点替换", "merge_paragraph": "段落合并", "split_paragraph": "段落拆分",
}
# Selector scopes, placeholder ids and the Chinese numerals of numbering.
SCOPES = ["body", "heading", "list_item", "paragraph_ids", "all_text"]
PLACEHOLDERS = ["placeholder", "unused", "target", "todo", "tbd"]
CHINESE = "一二三四五六七八九十"
# Words for lists and for their exclusion, and the words of step ids with the scope each one means.
LIST_WORDS = "(?i)(list_item|列表项|列表段落|项目符号|编号段落|编号列表|有序列表|无序列表|bullet|numbered)"
NO_LIST_WORDS = "(普通正文|纯正文|正文（不含列表）|正文\\(不含列表\\)|不含列表|不包括列表|排除列表)"
STEP_SCOPES = [("heading", "heading"), ("body", "body"), ("list", "list_item"), ("all_text", "all_text"), ("paragraph", "paragraph_ids")]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), "^\\s+|\\s+$", "")


def normalize_text(c: Column | str) -> Column:
    """One kind of line end, no zero-width or control characters, no trailing blanks, at most one blank line."""
    for pattern, by in (
        ("\\r\\n?", "\n"), ("[\\u200b-\\u200f\\ufeff]", ""), ("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", ""), ("[ \\t]+(\\n|$)", "$1"), ("\\n{3,}", "\n\n"),
    ):
        c = F.regexp_replace(_c(c), pattern, by)
    return strip(c)


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is computed once however often then names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def chatml_blocks(c: Column | str) -> Column:
    """array<struct<role, content, closed>> of a transcript; a blank role ends it, the last block may be open."""
    blocks = F.transform(
        F.regexp_extract_all(_c(c), F.lit(_BLOCK), F.lit(0)),
        lambda b: F.struct(
            strip(F.regexp_extract(b, _BLOCK, 1)).alias("role"), strip(F.regexp_extract(b, _BLOCK, 2)).alias("content"),
            F.rtrim(F.regexp_replace(b, "\\n$", "")).endswith(END).alias("closed"),
        ),
    )
    stop = lambda b: F.array_position(F.transform(b, lambda x: x["role"]), "")
    return _with(blocks, lambda b: F.when(stop(b) > 0, F.slice(b, 1, (stop(b) - 1).cast("int"))).otherwise(b))


def assistant_output(c: Column | str) -> Column:
    """The words before the first marker, else the last non-empty assistant block, else the text without markers."""

    def output(text: Column) -> Column:
        at = F.instr(text, START)
        before = normalize_text(F.substring(text, F.lit(1), F.greatest(at - 1, F.lit(0))))
        said = F.filter(chatml_blocks(text), lambda b: (b["role"] == "assistant") & (b["content"] != ""))
        last = F.try_element_at(said, F.lit(-1))["content"]
        bare = normalize_text(F.replace(F.replace(text, F.lit(START), F.lit("")), F.lit(END), F.lit("")))
        return F.when(at == 0, text).when(before != "", before).otherwise(F.coalesce(normalize_text(last), bare))

    return _with(normalize_text(c), output)


def transcript_markdown(c: Column | str) -> Column:
    """Closed system and conversation blocks under headings; an open assistant block becomes an open tag at the end."""
    show = lambda b: F.concat(F.lit("<"), b["role"], F.lit(">\n"), b["content"], F.lit("\n</"), b["role"], F.lit(">\n\n"))
    part = lambda head, rows, on: F.when(F.size(on) > 0, F.concat(F.lit(head), F.array_join(F.transform(rows, show), ""))).otherwise("")

    def body(blocks: Column) -> Column:
        talk = F.filter(blocks, lambda b: b["role"].isin("user", "assistant"))
        shown = F.filter(talk, lambda b: (b["role"] == "user") | b["closed"])
        system = F.filter(blocks, lambda b: (b["role"] == "system") & b["closed"])
        still = F.exists(talk, lambda b: (b["role"] == "assistant") & ~b["closed"])
        whole = F.concat(part("## System\n", system, system), part("## Conversation\n", shown, talk), F.when(still, "## Assistant\n<assistant>").otherwise(""))
        return F.when(F.size(blocks) > 0, F.nullif(strip(whole), F.lit("")))

    return _with(normalize_text(c), lambda text: F.coalesce(_with(chatml_blocks(text), body), text))


def truncate_text(c: Column | str, n: int) -> Column:
    t = strip(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - 3), F.lit("..."))).otherwise(t)


def _matched(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def numbering_prefix(c: Column | str) -> Column:
    """The numbering at the start of a paragraph; a bare decimal such as 0.7003 is none."""
    t = _c(c)
    # The numbering forms.
    many, one = "^\\s*([1-9][0-9]*(?:\\.[0-9]{1,2})+)", "^\\s*([0-9]+[.)、．])"
    words = "(?:\\s+\\S|[A-Za-z\\u4E00-\\u9FFF（(])"
    rest = F.regexp_replace(t, many, "")
    hierarchical = F.when(
        t.rlike(many),
        F.when(rest.rlike("^[)）、．。]"), F.concat(_matched(t, many), F.substring(rest, 1, 1))).when(rest.rlike("^" + words), _matched(t, many)),
    )
    single = F.when(F.regexp_replace(t, one, "").rlike("^" + words), _matched(t, one))
    return F.coalesce(
        hierarchical, single, _matched(t, f"^\\s*([{CHINESE}]+[、.)．])"), _matched(t, f"^\\s*([（(][{CHINESE}0-9]+[）)])"), _matched(t, "^\\s*([A-Za-z][.)])")
    )


def numbering_pattern(c: Column | str) -> Column:
    """The four-pattern prefix that evidence counts."""
    t = strip(c)
    return F.coalesce(*[_matched(t, f"^({p})") for p in (f"[{CHINESE}]+、", f"（[{CHINESE}]+）", "[0-9]+\\.", "\\([0-9]+\\)")])


def comparable_text(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(c)), "[^\\p{L}\\p{N}]+", "")


def contains_text(a: Column | str, b: Column | str) -> Column:
    return F.lower(_c(a)).contains(F.lower(_c(b)))


def char_language(ch: Column | str) -> Column:
    x = _c(ch)
    return F.when(x.rlike("\\p{IsHan}"), "zh").when(x.rlike("[\\p{IsLatin}\\p{Nd}]"), "en").when(x.rlike("\\p{P}"), "punct").otherwise("other")


def single_language(c: Column | str) -> Column:
    """zh or en where a text holds characters of just one of them."""
    zh, en = _c(c).rlike("\\p{IsHan}"), _c(c).rlike("[\\p{IsLatin}\\p{Nd}]")
    return F.when(zh & ~en, "zh").when(en & ~zh, "en")


def line_spacing(line: Column | str, rule: Column | str) -> Column:
    """struct(mode, value): exact points or a multiple; null for other rules and values that are not positive."""
    n, r = _c(line).try_cast("double"), F.lower(F.coalesce(_c(rule), F.lit("")))
    exact, auto = r == "exact", r.isin("", "auto")
    mode = F.when(exact, "exact").otherwise("multiple")
    value = F.when(exact, F.round(n / 20, 4)).when(auto, F.round(n / 240, 4))
    return F.when((n > 0) & ~F.isnan(n) & (exact | auto), F.struct(mode.alias("mode"), value.alias("value")))


def hex_color(c: Column | str) -> Column:
    t = F.regexp_replace(strip(c), "^#", "")
    return F.when(t.rlike("^[0-9a-fA-F]{6}$"), F.upper(t))


def highlight_color(c: Column | str) -> Column:
    """The canonical highlight name of a name or hex code, or null."""
    names = {k.lower(): k for k in HIGHLIGHTS} | {h: k for k, h in HIGHLIGHTS.items()} | {"#" + h: k for k, h in HIGHLIGHTS.items()} | {"none": "none"}
    return F.try_element_at(_map(names), F.lower(F.regexp_replace(_c(c), "\\s+", "")))


def paper_size(*cs: Column | str) -> Column:
    one = lambda c: F.when(F.lower(strip(c)) == "a4", "A4").when(F.lower(strip(c)) == "letter", "Letter")
    return F.coalesce(*map(one, cs))


def to_half_points(pt: Column | str) -> Column:
    return F.round(_c(pt) * 2).cast("long")


def to_twips(pt: Column | str) -> Column:
    return F.round(_c(pt) * 20).cast("long")


def to_line(multiple: Column | str) -> Column:
    return F.round(_c(multiple) * 240).cast("long")


def cm_to_twips(cm: Column | str) -> Column:
    return F.round(_c(cm) * 567).cast("long")


def emu_to_px(emu: Column | str) -> Column:
    return F.round(_c(emu) / 9525, 2)


def pt_to_px(pt: Column | str) -> Column:
    return F.round(_c(pt) * 96 / 72, 2)


def loose_boolean(c: Column | str) -> Column:
    t = F.lower(strip(_c(c).cast("string")))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


def first_number(rule: str, *cs: Column | str) -> Column:
    """The first candidate that parses and is positive, non_negative or a positive integer, as the rule says."""
    test = {"positive": lambda n: n > 0, "non_negative": lambda n: n >= 0, "integer": lambda n: (n > 0) & (n == F.floor(n))}[rule]
    number = lambda c: F.trim(_c(c).cast("string")).try_cast("double")
    return F.coalesce(*[F.when(test(number(c)) & ~F.isnan(number(c)), number(c)) for c in cs])


def first_text(*cs: Column | str) -> Column:
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cs])


def is_placeholder(c: Column | str) -> Column:
    return F.lower(strip(c)).isin(PLACEHOLDERS)


def selector_scope(c: Column | str) -> Column:
    t = F.regexp_replace(F.lower(strip(c)), "[\\s-]+", "_")
    return F.when(t.isin(SCOPES), t)


def id_list(c: Column | str) -> Column:
    """Distinct trimmed ids of a comma-separated text."""
    return F.array_distinct(F.filter(F.transform(F.split(_c(c), ","), strip), lambda x: x != ""))


def expand_body_scope(goal: Column | str, said: Column | str) -> Column:
    """Whether a request that names body text also means list items: no list word and no exclusion in it."""
    g, both = _c(goal), F.concat(_c(said), F.lit("\n"), _c(goal))
    return both.contains("正文") & ~g.contains("普通正文和项目符号/编号段落") & ~both.rlike(LIST_WORDS) & ~both.rlike(NO_LIST_WORDS)


def scope_from_step(c: Column | str) -> Column:
    t = F.lower(_c(c))
    out = F.lit(None).cast("string")
    for word, scope in reversed(STEP_SCOPES):
        out = F.when(t.contains(word), scope).otherwise(out)
    return out


def scope_label(c: Column | str) -> Column:
    return F.try_element_at(_map(SCOPE_LABELS), _c(c))


def operation_label(c: Column | str) -> Column:
    return F.try_element_at(_map(OPERATION_LABELS), _c(c))


def clean_sentence(c: Column | str) -> Column:
    t = strip(F.regexp_replace(F.coalesce(_c(c), F.lit("")), "\\s+", " "))
    return F.when((t == "") | t.rlike("[。！？.!?]$"), t).otherwise(F.concat(t, F.lit("。")))


def pattern_match(value: Column | str, patterns: list[str]) -> Column:
    """Whether value matches any of the rules' patterns; one that is no valid expression must equal it."""
    import re

    out = F.lit(False)
    for p in patterns:
        try:
            re.compile(p)
            out = out | _c(value).rlike(p)
        except re.error:
            out = out | (_c(value) == p)
    return out
