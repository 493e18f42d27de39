"""Column functions that read structure from style names and numbering properties."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def heading_level_by_name(name: Column | str) -> Column:
    """Level of a style name such as "heading 2" or "标题3"; null for other names."""
    level = F.regexp_extract(F.lower(F.trim(_c(name))), "^(?:heading|标题)\\s*([1-9])$", 1)
    return F.when(level != "", level.cast("int"))


def heading_level_by_id(style_id: Column | str) -> Column:
    """Level where a style id holds "heading" and a digit anywhere."""
    level = F.regexp_extract(F.lower(_c(style_id)), "heading\\s*([1-9])", 1)
    return F.when(level != "", level.cast("int"))


def list_level(is_numbered: Column | str, ilvl: Column | str) -> Column:
    """The numbering level, 0 for a numbered paragraph without a readable one, null if not numbered."""
    return F.when(_c(is_numbered), F.coalesce(_c(ilvl).try_cast("int"), F.lit(0)))


def role_by_name(name, is_numbered, in_table, text) -> Column:
    """Role as the name-based reader gives it: heading, title, subtitle, list item, table text, body, unknown."""
    style = F.lower(F.trim(_c(name)))
    return (
        F.when(heading_level_by_name(name).isNotNull(), "heading")
        .when(style == "title", "title").when(style == "subtitle", "subtitle")
        .when(_c(is_numbered), "list_item").when(_c(in_table), "table_text")
        .when(F.regexp_replace(_c(text), "\\s+", "") != "", "body").otherwise("unknown")
    )


def role_by_part(part_kind, style_name, is_numbered, in_table) -> Column:
    """Role as the part-based reader gives it; the part decides first, then table, heading, list and body."""
    kind = _c(part_kind)
    return (
        F.when(kind == "header", "header").when(kind == "footer", "footer")
        .when(kind == "footnotes", "footnote").when(kind == "endnotes", "endnote")
        .when(_c(in_table), "table_text").when(heading_level_by_name(style_name).isNotNull(), "heading")
        .when(_c(is_numbered), "list_item").otherwise("body")
    )


def bucket_type(role, in_table) -> Column:
    known = ["heading", "title", "subtitle", "list_item", "body"]
    return F.when(_c(in_table), "table_text").when(_c(role).isin(known), _c(role)).otherwise("unknown")


# Part kinds by path and by what a content type holds; the first rule that holds decides.
PART_RULES = (
    ("main_document", "word/document\\.xml$", "document.main+xml"), ("header", "word/header[0-9]*\\.xml$", "header+xml"), ("footer", "word/footer[0-9]*\\.xml$", "footer+xml"),
    ("footnotes", "footnotes\\.xml$", None), ("endnotes", "endnotes\\.xml$", None), ("styles", "styles\\.xml$", None), ("numbering", "numbering\\.xml$", None),
    ("docprops", "^docprops/", None), ("custom_xml", "^customxml/", None), ("media", "/media/", None), ("relationships", "\\.rels$", None), ("xml", "\\.xml$", "[/+]xml$"),
)


def part_kind(path: Column | str, content_type: Column | str) -> Column:
    """Kind of a package part; the first rule that holds decides."""
    p, t = F.lower(_c(path)), F.lower(F.coalesce(_c(content_type), F.lit("")))
    out = F.lit("binary")
    for kind, by_path, by_type in reversed(PART_RULES):
        typed = F.lit(False) if by_type is None else t.rlike(by_type) if by_type.endswith("$") else t.contains(by_type)
        out = F.when(p.rlike(by_path) | typed, kind).otherwise(out)
    return out


def part_kind_of(path: str) -> str:
    """part_kind by the path alone, for workers that open packages and read only some kinds."""
    return next((kind for kind, by_path, _ in PART_RULES if re.search(by_path, path.lower())), "binary")


def normalized_target(source: Column | str, target: Column | str) -> Column:
    """A relationship target resolved against its source's folder, with . and .. folded away."""
    t = _c(target)
    folder = F.regexp_replace(_c(source), "[^/]*$", "")
    whole = F.when(t.startswith("/"), F.substring(t, 2, 1 << 20)).otherwise(F.concat(folder, t))
    step = lambda acc, x: F.when((x == "") | (x == "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")
