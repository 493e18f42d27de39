"""Document packages as tables: parts of zip files, their XML as node rows, and what a document is made of from these.

Two small Python workers open zip files and walk XML; each emits rows and keeps nothing. All else is DataFrame work on
the node table, whose rows carry the path from the root: paragraphs, runs, cells, styles, numbering and relationships
are filters and one aggregation each, keyed by document, part and node.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import structure as st
from foliant.functions import text as tx

# The order in which the parts of a package are read; what else follows.
PART_ORDER = ("main_document", "header", "footer", "footnotes", "endnotes")
BLOCK_PARENTS = ("body", "hdr", "ftr", "footnote", "endnote", "tc")
PARTS = "doc_id string, part_path string, xml string, error string"
PART_SCHEMA = pa.schema([(name, pa.string()) for name in ("doc_id", "part_path", "xml", "error")])
BATCH_CHARS, BATCH_NODES = 4 << 20, 5_000
NODES = "doc_id string, part_path string, node int, tag string, ord int, attrs map<string,string>, text string, path array<struct<tag:string,node:int,ord:int>>"


def below_root(path: Column, root: str) -> Column:
    """The part of a file's path below root, without .docx: the document's id, unlike for equal names in two folders."""
    bare = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    at = F.locate(bare, path)
    inside = F.when(at > 0, F.substring(path, at + len(bare), F.length(path)))
    return F.regexp_replace(F.coalesce(inside, F.element_at(F.split(path, "/"), -1)), "\\.docx$", "")


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content) of every package under path, found by Spark's own reader, for stores that only Spark reads.

    A whole package is one value, so it must stay under 2 GB; package_files() has no such limit.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return files.select(below_root(F.col("path"), path).alias("doc_id"), "content")


def part_rows(doc: str | None, package, kinds: frozenset[str] | None) -> Iterator[tuple]:
    """(doc, part, text, error) of the parts of one package, an open file; only those of some kinds are read, if given.

    Folders are left out; media parts keep no text. What is no zip is one row with an error and no part.
    """
    try:
        with zipfile.ZipFile(package) as z:
            for part in z.namelist():
                if not part.endswith("/") and (kinds is None or st.part_kind_of(part) in kinds):
                    yield doc, part, z.read(part).decode("utf-8-sig", "replace") if part.endswith((".xml", ".rels")) else None, None
    except (zipfile.BadZipFile, zipfile.zlib.error, NotImplementedError, RuntimeError, OSError) as e:
        yield doc, None, None, f"{type(e).__name__}: {e}"


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of record batches one by one: a batch's large values are never all held as Python objects."""
    for b in batches:
        for row in zip(*b.columns):
            yield tuple(v.as_py() for v in row)


def batches_of(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of a bounded number of characters or bytes."""
    columns, held = [[] for _ in schema], 0
    for row in rows:
        for column, v in zip(columns, row):
            column.append(v)
            held += len(v) if isinstance(v, (str, bytes)) else 8
        if held > BATCH_CHARS:
            yield pa.record_batch(columns, schema=schema)
            columns, held = [[] for _ in schema], 0
    if columns[0]:
        yield pa.record_batch(columns, schema=schema)


def package_parts(packages: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, part_path, xml, error, kind, part_order) of every part, or of those of some kinds, folders left out.

    Only the parts asked for are unpacked. A package that is no zip, or is null, is one row with an error and no part.
    """
    wanted = None if kinds is None else frozenset(kinds)

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of((row for doc, content in rows_of(batches) for row in part_rows(doc, io.BytesIO(content or b""), wanted)), PART_SCHEMA)

    return with_kind(packages.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(unzip, PARTS))


def with_kind(parts: DataFrame) -> DataFrame:
    return with_order(parts.withColumn("kind", F.when(F.col("part_path").isNotNull(), st.part_kind("part_path", F.lit(None).cast("string")))))


def with_order(parts: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, PART_ORDER)), F.col("kind"))
    return parts.withColumn("part_order", F.when(place > 0, place - 1).otherwise(len(PART_ORDER)).cast("int"))


class _Nodes:
    """Columns of node rows, kept flat."""

    def __init__(self):
        self.doc, self.part, self.node, self.tag, self.ord, self.text = [], [], [], [], [], []
        self.attrs_at, self.keys, self.values = [0], [], []
        self.path_at, self.path_tag, self.path_node, self.path_ord = [0], [], [], []

    def add(self, doc, part, node, tag, ord_, attrs, text, tags, nodes, ords) -> None:
        for column, v in ((self.doc, doc), (self.part, part), (self.node, node), (self.tag, tag), (self.ord, ord_), (self.text, text)):
            column.append(v)
        for k, v in attrs.items():
            self.keys.append(k)
            self.values.append(v)
        self.attrs_at.append(len(self.keys))
        self.path_tag += tags
        self.path_node += nodes
        self.path_ord += ords
        self.path_at.append(len(self.path_tag))

    def batch(self) -> pa.RecordBatch:
        text, number = pa.string(), pa.int32()
        path = pa.StructArray.from_arrays([pa.array(self.path_tag, text), pa.array(self.path_node, number), pa.array(self.path_ord, number)], ["tag", "node", "ord"])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.doc, text), pa.array(self.part, text), pa.array(self.node, number), pa.array(self.tag, text), pa.array(self.ord, number),
                pa.MapArray.from_arrays(pa.array(self.attrs_at, number), pa.array(self.keys, text), pa.array(self.values, text)), pa.array(self.text, text),
                pa.ListArray.from_arrays(pa.array(self.path_at, number), path),
            ],
            ["doc_id", "part_path", "node", "tag", "ord", "attrs", "text", "path"],
        )


def xml_nodes(parts: DataFrame, tags: tuple[str, ...] | None = None) -> DataFrame:
    """One row per element, numbered in document order, with local names, its own text and the path from the root.

    With tags only elements of these names are rows; their numbers and paths stay those among all. ord counts siblings of one tag. A part that is not well-formed is one row of tag #error with the message as text.
    """

    asked = None if tags is None else frozenset(tags)

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, str] = {}

        def local(name: str) -> str:
            found = names.get(name)
            if found is None:
                found = name.rsplit("}", 1)[-1]
                if len(names) < 10_000:
                    names[name] = found
            return found

        out = _Nodes()
        for doc, part, xml in rows_of(batches):
            number = 0
            try:
                root = ElementTree.fromstring(xml.encode("utf-8", "replace"))
                stack = [(root, (), (), (), 0)]
            except ElementTree.ParseError as e:
                stack = []
                out.add(doc, part, 0, "#error", 0, {}, str(e), ("#error",), (0,), (0,))
            while stack:
                element, tags, nodes, ords, place = stack.pop()
                tags, nodes, ords = (*tags, local(element.tag)), (*nodes, number), (*ords, place)
                if asked is None or tags[-1] in asked:
                    out.add(doc, part, number, tags[-1], place, {local(k): v for k, v in element.attrib.items()}, element.text, tags, nodes, ords)
                if len(out.node) >= BATCH_NODES:
                    yield out.batch()
                    out = _Nodes()
                number += 1
                seen: dict[str, int] = {}
                below = []
                for child in element:
                    n = seen.get(child.tag, 0)
                    below.append((child, tags, nodes, ords, n))
                    seen[child.tag] = n + 1
                below.reverse()
                stack += below
        if out.node:
            yield out.batch()

    return parts.filter("xml is not null").select("doc_id", "part_path", "xml").mapInArrow(shred, NODES)


def _tag(i: int) -> Column:
    """The tag at place i of the path, 1 being the root; null beyond."""
    return F.try_element_at("path", F.lit(i))["tag"]


def _val(tag: str, attr: str = "val") -> Column:
    return F.when(F.col("tag") == tag, F.col("attrs")[attr])


def _toggle(tag: str) -> Column:
    """The value of a switch that may stand without one: empty then."""
    return F.when(F.col("tag") == tag, F.coalesce(F.col("attrs")["val"], F.lit("")))


def _run_values(here: Column) -> dict[str, Column]:
    """Raw properties of a node below a properties element, as operators.structure.run_properties takes them."""
    fonts = {n: _val("rFonts", a) for a, n in (("eastAsia", "east_asia"), ("ascii", "ascii"), ("hAnsi", "h_ansi"), ("cs", "cs"))}
    values = {n: _val(t) for t, n in (("sz", "sz"), ("color", "color"), ("highlight", "highlight"), ("rStyle", "char_style"))}
    toggles = {t: _toggle(t) for t in ("b", "i", "u", "strike", "caps")}
    return {n: F.when(here, x) for n, x in (fonts | values | toggles).items()}


def _run_columns(here: Column) -> list[Column]:
    return [F.max(x).alias(n) for n, x in _run_values(here).items()]


def _in_paragraphs(nodes: DataFrame) -> DataFrame:
    """Nodes of block paragraphs with p (the paragraph's place in the path), para and run: the nodes they belong to."""
    at = F.array_position(F.transform("path", lambda x: x["tag"]), "p").cast("int")
    inside = nodes.withColumn("p", at).filter("p > 1")
    inside = inside.filter(F.element_at("path", F.col("p") - 1)["tag"].isin(*BLOCK_PARENTS)).withColumn("para", F.element_at("path", F.col("p")))
    below = F.try_element_at("path", F.col("p") + 1)
    return inside.withColumn("run", F.when(below["tag"] == "r", below))


def paragraph_ids(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, part_path, para, paragraph_index): block paragraphs numbered over a document's parts in reading order."""
    order = parts.filter(F.col("kind").isin(*PART_ORDER)).select("doc_id", "part_path", "part_order")
    own = _in_paragraphs(nodes.filter("tag = 'p'")).filter("size(path) = p").select("doc_id", "part_path", F.col("node").alias("para"), "path")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("part_order", "part_path", "para")) - 1
    return own.join(order, ["doc_id", "part_path"]).withColumn("paragraph_index", place)


PARAGRAPH_TAGS = ("p", "t", "pStyle", "ilvl", "numId", "jc", "spacing", "drawing", "pict", "oMath")
RUN_TAGS = ("p", "t", "rFonts", "sz", "color", "highlight", "rStyle", "b", "i", "u", "strike", "caps")


def _by_document(nodes: DataFrame, parts: DataFrame | None, *columns: Column) -> DataFrame:
    """Nodes of block paragraphs as narrow rows (doc_id, part_order, part_path, para, run_index, columns), shuffled by document.

    Aggregations by paragraph or run and windows by document then need no other shuffle, and sort what they need only.
    Without parts, the kind of a part is what its path says, as in package_parts().
    """
    if parts is None:
        placed = with_kind(nodes).filter(F.col("kind").isin(*PART_ORDER))
    else:
        placed = nodes.join(parts.filter(F.col("kind").isin(*PART_ORDER)).select("doc_id", "part_path", "part_order"), ["doc_id", "part_path"])
    keys = ("doc_id", "part_order", "part_path", F.col("para.node").alias("para"), F.col("run.ord").alias("run_index"))
    return _in_paragraphs(placed).select(*keys, *columns).repartition("doc_id")


def _text_of(texts: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(texts)), lambda x: x["text"]), "")


def document_paragraphs(nodes: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """One row per paragraph: id, anchor, text, style id, numbering, alignment, line spacing, table, image and formula facts.

    Of the nodes it reads PARAGRAPH_TAGS only. One shuffle, by document.
    """
    own = lambda tag, n: (F.col("tag") == tag) & (F.try_element_at("path", F.col("p") + 1)["tag"] == "pPr") & (F.size("path") == F.col("p") + n)
    value = lambda tag, n, attr="val": F.when(own(tag, n), F.col("attrs")[attr])
    step = lambda x: F.when(F.array_contains(F.array(*map(F.lit, ("p", "tbl", "tr", "tc", "r"))), x["tag"]), F.concat(x["tag"], F.lit("["), x["ord"].cast("string"), F.lit("]"))).otherwise(x["tag"])
    is_p = (F.col("tag") == "p") & (F.size("path") == F.col("p"))
    read = {
        "style_id": value("pStyle", 2), "num_ilvl": value("ilvl", 3), "num_id": value("numId", 3), "alignment": value("jc", 2), "line": value("spacing", 2, "line"), "line_rule": value("spacing", 2, "lineRule"),
        "in_table": F.when(is_p, F.exists("path", lambda x: x["tag"] == "tc")), "anchor": F.when(is_p, F.concat(F.lit("/"), F.array_join(F.transform("path", step), "/"))),
    }
    said = F.when((F.col("tag") == "t") & F.col("run").isNotNull(), F.struct("node", F.coalesce("text", F.lit("")).alias("text")))
    wanted = nodes.filter(F.col("tag").isin(*PARAGRAPH_TAGS))
    rows = _by_document(wanted, parts, said.alias("said"), F.col("tag").isin("drawing", "pict").alias("image"), (F.col("tag") == "oMath").alias("formula"), *[x.alias(n) for n, x in read.items()])
    facts = rows.groupBy("doc_id", "part_order", "part_path", "para").agg(
        _text_of(F.col("said")).alias("text"), *[F.max(n).alias(n) for n in read], F.count_if("image").cast("int").alias("n_images"), F.count_if("formula").cast("int").alias("n_formulas")
    )
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("part_order", "part_path", "para")) - 1
    out = facts.withColumn("paragraph_index", place).withColumn("paragraph_id", F.concat(F.lit("p_"), F.col("paragraph_index").cast("string")))
    return out.withColumn("text", tx.strip("text")).withColumn("line_spacing", tx.line_spacing(F.col("line"), F.col("line_rule")))


def document_runs(nodes: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """One row per run with text: ids p_i_r_j (j counts all runs of the paragraph), text and raw direct properties.

    Of the nodes it reads RUN_TAGS only. One shuffle, by document: a paragraph's own row, which has no run, counts it.
    """
    direct = F.col("run").isNotNull() & (F.try_element_at("path", F.col("p") + 2)["tag"] == "rPr") & (F.size("path") == F.col("p") + 3)
    said = F.when((F.col("tag") == "t") & F.col("run").isNotNull(), F.struct("node", F.coalesce("text", F.lit("")).alias("text")))
    raw = _run_values(direct)
    rows = _by_document(nodes.filter(F.col("tag").isin(*RUN_TAGS)), parts, said.alias("said"), *[x.alias(n) for n, x in raw.items()])
    runs = rows.groupBy("doc_id", "part_order", "part_path", "para", "run_index").agg(_text_of(F.col("said")).alias("text"), *[F.max(n).alias(n) for n in raw])
    order = Window.partitionBy("doc_id").orderBy("part_order", "part_path", "para", F.col("run_index").asc_nulls_first())
    place = F.count_if(F.col("run_index").isNull()).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    out = runs.withColumn("paragraph_index", place.cast("int")).filter("run_index is not null and text <> ''").drop("part_order")
    out = out.withColumn("paragraph_id", F.concat(F.lit("p_"), F.col("paragraph_index").cast("string")))
    return out.withColumn("run_id", F.concat("paragraph_id", F.lit("_r_"), F.col("run_index").cast("string")))


def document_blocks(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """Children of bodies, headers, footers and notes: (doc_id, part_path, seq, node_type, ordinal)."""
    kinds = {"p": "paragraph", "tbl": "table", "sectPr": "section_break"}
    named = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("tag"))
    above = F.try_element_at("path", F.size("path") - 1)["tag"]
    own = nodes.filter(F.col("tag").isin(*kinds) & (F.size("path") > 1)).filter(above.isin(*[p for p in BLOCK_PARENTS if p != "tc"]))
    order = parts.filter(F.col("kind").isin(*PART_ORDER)).select("doc_id", "part_path")
    return own.join(order, ["doc_id", "part_path"]).select("doc_id", "part_path", F.col("node").alias("seq"), named.alias("node_type"), F.col("ord").alias("ordinal"))


def document_cells(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """Paragraphs inside tables with the coordinates of every enclosing cell, outermost first, nested tables included."""
    ids = paragraph_ids(nodes, parts)
    inner = F.filter("path", lambda x: x["tag"].isin("tbl", "tr", "tc"))
    coordinate = F.array_join(F.transform(inner, lambda x: F.concat(F.substring(x["tag"], 1, 2), F.lit("_"), x["ord"].cast("string"))), "/")
    own = ids.filter(F.exists("path", lambda x: x["tag"] == "tc"))
    depth = F.size(F.filter("path", lambda x: x["tag"] == "tbl"))
    p = F.element_at("path", -1)["ord"]
    return own.select("doc_id", "part_path", "paragraph_index", depth.alias("depth"), coordinate.alias("cell"), p.alias("p"))


def style_rows(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, style_id, style_type, style_name, based_on, is_default, alignment) and the raw run properties of styles."""
    own = nodes.join(parts.filter("kind = 'styles'").select("doc_id", "part_path"), ["doc_id", "part_path"], "left_semi")
    own = own.filter(_tag(2) == "style")
    size = F.size("path")
    rows = own.groupBy("doc_id", "part_path", F.element_at("path", 2)["node"].alias("style")).agg(
        F.max(F.when(size == 2, F.col("attrs")["styleId"])).alias("style_id"), F.max(F.when(size == 2, F.col("attrs")["type"])).alias("style_type"),
        F.max(F.when(size == 2, F.col("attrs")["default"])).alias("is_default"),
        F.max(F.when(size == 3, _val("name"))).alias("style_name"), F.max(F.when(size == 3, _val("basedOn"))).alias("based_on"),
        F.max(F.when((size == 4) & (_tag(3) == "pPr"), _val("jc"))).alias("alignment"), *_run_columns((size == 4) & (_tag(3) == "rPr")),
    )
    return rows.drop("part_path", "style").filter("style_id is not null and style_type is not null").withColumn("is_default", F.col("is_default") == "1")


def default_rows(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """Raw run properties of each document's defaults."""
    own = nodes.join(parts.filter("kind = 'styles'").select("doc_id", "part_path"), ["doc_id", "part_path"], "left_semi").filter(_tag(2) == "docDefaults")
    return own.groupBy("doc_id").agg(*_run_columns((F.size("path") == 5) & (_tag(3) == "rPrDefault") & (_tag(4) == "rPr"))).drop("char_style")


def numbering_rows(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, num_id, abstract_id) and (doc_id, abstract_id, ilvl, num_fmt), as numbering_projection takes them."""
    own = nodes.filter(_tag(1) == "numbering").withColumn("top", F.try_element_at("path", F.lit(2)))
    size, attr = F.size("path"), lambda a: F.col("attrs")[a]
    nums = own.filter(F.col("top.tag") == "num").groupBy("doc_id", "part_path", "top.node").agg(
        F.max(F.when(size == 2, attr("numId"))).alias("num_id"), F.max(F.when(size == 3, _val("abstractNumId"))).alias("abstract_id")
    )
    abstract = own.filter(F.col("top.tag") == "abstractNum")
    named = abstract.filter(size == 2).select("doc_id", "part_path", "top.node", attr("abstractNumId").alias("abstract_id")).filter("abstract_id is not null")
    levels = abstract.filter(_tag(3) == "lvl").groupBy("doc_id", "part_path", "top.node", F.element_at("path", 3)["node"].alias("level")).agg(
        F.max(F.when(size == 3, F.coalesce(attr("ilvl").try_cast("int"), F.lit(0)))).alias("ilvl"), F.max(F.when(size == 4, _val("numFmt"))).alias("num_fmt")
    )
    keys = ["doc_id", "part_path", "node"]
    return nums.filter("num_id is not null").select("doc_id", "num_id", "abstract_id"), levels.join(named, keys).select("doc_id", "abstract_id", "ilvl", "num_fmt")


def relationship_rows(nodes: DataFrame) -> DataFrame:
    """Relationship elements of .rels parts beside the part they belong to, as relationship_edges takes them."""
    own = nodes.filter(F.col("part_path").endswith(".rels") & (F.col("tag") == "Relationship"))
    source = F.regexp_replace(F.regexp_replace("part_path", "(^|/)_rels/", "$1"), "\\.rels$", "")
    attr = lambda a: F.col("attrs")[a]
    return own.select("doc_id", source.alias("source_part"), attr("Id").alias("rel_id"), attr("Type").alias("type"), attr("Target").alias("target"), attr("TargetMode").alias("target_mode"))


def content_type_rows(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overrides (doc_id, part_path, content_type) and defaults (doc_id, ext, content_type) of [Content_Types].xml."""
    own = nodes.filter("part_path = '[Content_Types].xml'")
    attr = lambda a: F.col("attrs")[a]
    over = own.filter("tag = 'Override'").select("doc_id", F.regexp_replace(attr("PartName"), "^/", "").alias("part_path"), attr("ContentType").alias("content_type"))
    return over, own.filter("tag = 'Default'").select("doc_id", F.lower(attr("Extension")).alias("ext"), attr("ContentType").alias("content_type"))


def property_rows(nodes: DataFrame) -> DataFrame:
    """(doc_id, name, value) of the core properties."""
    return nodes.filter("lower(part_path) = 'docprops/core.xml' and size(path) = 2").select("doc_id", F.col("tag").alias("name"), F.trim("text").alias("value"))


def section_rows(nodes: DataFrame) -> DataFrame:
    """(doc_id, section, refs) of every section of a main document, as header_footer_bindings takes them."""
    at = F.array_position(F.transform("path", lambda x: x["tag"]), "sectPr").cast("int")
    own = nodes.filter(_tag(1) == "document").withColumn("s", at).filter("s > 0").withColumn("sect", F.element_at("path", F.col("s"))["node"])
    kind = F.when(F.col("tag") == "headerReference", "header").when(F.col("tag") == "footerReference", "footer")
    ref = F.when(kind.isNotNull() & F.col("attrs")["id"].isNotNull(), F.struct(kind.alias("kind"), F.col("attrs")["id"].alias("rel_id")))
    rows = own.groupBy("doc_id", "sect").agg(F.collect_list(ref).alias("refs"))
    return rows.withColumn("section", F.row_number().over(Window.partitionBy("doc_id").orderBy("sect")) - 1).drop("sect")
