"""Views of the test tables as a document corpus: paragraphs, runs and the small tables beside them.

Each view is a pure projection of an input table; attributes that the tables lack come from arithmetic on ids, so row
counts follow the input. plans.views holds the same views as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources import packages as pg

# Line numbers repeat within an order; part, supplier and quantity make the order of operations total.
SEQ = lambda: F.col("l_linenumber") * F.lit(10**12).cast("long") + F.col("l_partkey") * 10**7 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")
PREFIXES = ["1. ", "2.1 ", "(3) ", "A. ", "一、", "0.7003", "", "", ""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line of a document, with the raw properties that roles are derived from."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    k = F.col("doc_id") + F.col("pos")
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), (k % 9 + 1).cast("int"))
    style = F.when(k % 13 == 0, "heading 2").when(k % 17 == 1, "标题3").when(k % 19 == 2, "Title").when(k % 23 == 3, "Subtitle").otherwise("Normal")
    kind = F.when(k % 29 == 0, "header").when(k % 29 == 1, "footer").when(k % 31 == 0, "footnotes").when(k % 37 == 0, "endnotes").otherwise("main_document")
    return lines.select(
        "doc_id",
        F.concat(F.lit("p_"), F.col("pos").cast("string")).alias("paragraph_id"),
        F.col("pos").alias("paragraph_index"),
        F.when(k % 11 == 5, "").otherwise(F.concat(prefix, "line")).alias("text"),
        style.alias("style_name"),
        F.when(k % 7 == 0, (k % 3).cast("string")).when(k % 7 == 1, "x").alias("num_ilvl"),
        (k % 7 <= 1).alias("is_numbered"),
        (k % 10 == 7).alias("in_table"),
        F.when(k % 8 == 3, k % 2 + 1).otherwise(0).cast("int").alias("n_images"),
        kind.alias("part_kind"),
    )


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_paragraphs with role, heading_level and list_level by style name."""
    from foliant.functions.structure import heading_level_by_name, list_level, role_by_name

    raw = raw_paragraphs(spark, sf_dir)
    return raw.withColumn("heading_level", heading_level_by_name("style_name")).withColumn(
        "list_level", list_level("is_numbered", "num_ilvl")
    ).withColumn("role", role_by_name("style_name", "is_numbered", "in_table", "text"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text runs: a paragraph cut after sentence ends, with direct properties that may be unset (null)."""
    p = raw_paragraphs(spark, sf_dir)
    cut = p.select("doc_id", "paragraph_id", "paragraph_index", "in_table", "style_name", F.posexplode(F.split("text", "\\. ")).alias("run_index", "text"))
    m = F.col("doc_id") + F.col("paragraph_index") * 3 + F.col("run_index")
    return cut.filter(F.length("text") > 0).select(
        "doc_id", "paragraph_id", "paragraph_index", "run_index", "in_table", "style_name",
        F.concat("paragraph_id", F.lit("_r_"), F.col("run_index").cast("string")).alias("run_id"),
        "text",
        F.when(m % 3 == 0, "SimSun").when(m % 3 == 1, "Arial").alias("font_name"),
        F.when(m % 4 == 1, 10.5).when(m % 4 == 2, 12.0).when(m % 4 == 3, 16.0).cast("double").alias("font_size_pt"),
        F.when(m % 6 == 0, "FF0000").alias("font_color"),
        F.when(m % 5 == 0, True).when(m % 5 == 1, False).alias("is_bold"),
        F.when(m % 7 == 0, True).alias("is_italic"),
        F.when(m % 11 == 0, True).alias("is_underline"),
        F.when(m % 23 == 0, "yellow").alias("highlight_color"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write and read steps of runs, one per event: a user is a run, event order its step order."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    kinds = F.element_at(F.array(*map(F.lit, ["set_font", "set_size", "merge_paragraph", "set_bold", "inspect", "set_alignment", "split_paragraph"])), (k % 7 + 1).cast("int"))
    return e.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("step_id"), "ts", kinds.alias("op_type"),
        (kinds == "inspect").alias("read_only"),
        F.concat_ws("-", F.lit("key"), F.col("user_id").cast("string"), (k % 50).cast("string")).alias("idempotency_key"),
        F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"),
        F.element_at(F.array(*map(F.lit, ["body", "heading", "list_item"])), (k % 3 + 1).cast("int")).alias("scope"),
        (k % 4).cast("int").alias("retries"), F.round("value", 3).alias("duration_ms"), (k % 9).cast("int").alias("n_targets"),
        "event_type", (k % 6 == 0).alias("approved"),
    )


def write_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered write operations: an order is a document, a line an operation, eight runs to a document."""
    i = table(spark, sf_dir, "lineitem")
    kind = F.col("l_linenumber") % 5
    return i.select(
        F.col("l_orderkey").alias("doc_id"), SEQ().alias("seq"), (F.col("l_partkey") % 8).cast("int").alias("run_no"),
        F.when(kind == 0, "font_name").when(kind == 1, "font_size_pt").when(kind == 2, "is_bold").when(kind == 3, "font_color").otherwise("highlight_color").alias("attribute"),
        F.when(kind == 0, F.col("l_returnflag")).when(kind == 1, (F.col("l_quantity").cast("int") % 20).cast("string"))
        .when(kind == 2, F.when(F.col("l_linestatus") == "O", "true").otherwise("maybe")).when(kind == 3, F.concat(F.lit("#00ff0"), (F.col("l_suppkey") % 10).cast("string")))
        .otherwise(F.when(F.col("l_suppkey") % 2 == 0, "Yellow").otherwise("mauve")).alias("value"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One marked-up transcript per conversation; every third one ends in an open block."""
    c = table(spark, sf_dir, "conversations")
    block = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text", block.alias("b"))))
    whole = F.array_join(F.transform(parts, lambda x: x["b"]), "")
    return c.groupBy("conv_id").agg(whole.alias("w")).select(
        "conv_id",
        F.when(F.col("conv_id") % 3 == 0, F.concat("w", F.lit("<|im_start|>assistant\nto be continued")))
        .when(F.col("conv_id") % 3 == 1, F.concat(F.lit("Well: "), "w")).otherwise(F.col("w")).alias("transcript"),
    )


LONG_CHAIN = 13  # styles of a package's chain: each is based on the next one, only the last has a font


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content): every document as a zipped package whose paragraphs are its lines; some packages are broken.

    XML is put together by string functions; the only Python closes the zip.
    """
    k = F.col("doc_id") + F.col("paragraph_index")
    tag = lambda name, value: F.concat(F.lit(f'<w:{name} w:val="'), value.cast("string"), F.lit('"/>'))
    clean = F.regexp_replace("text", "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    safe = F.replace(F.replace(F.replace(F.replace(clean, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("\r"), F.lit("&#13;"))
    size = lambda j: F.when((F.col("paragraph_index") + j) % 4 == 0, tag("sz", 20 + j % 7)).otherwise("")
    run = lambda t, j: F.concat(F.lit("<w:r><w:rPr><w:b/>"), size(j), F.lit('</w:rPr><w:t xml:space="preserve">'), t, F.lit("</w:t></w:r>"))
    pieces = F.array_join(F.transform(F.split(safe, "\\. "), run), "")
    numbered = F.when(F.col("is_numbered") & F.col("num_ilvl").isNotNull(), F.concat(F.lit("<w:numPr>"), tag("ilvl", F.col("num_ilvl")), F.lit("</w:numPr>"))).otherwise("")
    line = F.when(k % 6 == 0, F.lit('<w:spacing w:line="360"/>')).otherwise("")
    images = F.repeat(F.lit("<w:r><w:drawing/></w:r>"), F.col("n_images"))
    p = F.concat(F.lit("<w:p><w:pPr>"), tag("pStyle", F.col("style_name")), numbered, line, F.lit("</w:pPr>"), pieces, images, F.lit("</w:p>"))
    cell = lambda x: F.concat(F.lit("<w:tbl><w:tr><w:tc>"), x, F.lit("</w:tc></w:tr></w:tbl>"))
    block = F.when(k % 20 == 17, cell(cell(p))).when(F.col("in_table"), cell(p)).otherwise(p)
    blocks = F.array_sort(F.collect_list(F.struct("paragraph_index", block.alias("xml"))))
    docs = raw_paragraphs(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(blocks, lambda x: x["xml"]), "").alias("body"))
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    sect = '<w:sectPr><w:headerReference w:type="default" r:id="rId2" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"/></w:sectPr>'
    document = F.concat(F.lit(f"<w:document {w}><w:body>"), F.col("body"), F.lit(f"{sect}</w:body></w:document>"))
    header = F.concat(F.lit(f"<w:hdr {w}><w:p><w:r><w:t>Header "), F.col("doc_id").cast("string"), F.lit("</w:t></w:r></w:p></w:hdr>"))
    last = LONG_CHAIN - 1
    chain = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: F.concat(
        F.lit('<w:style w:type="paragraph" w:styleId="S'), i.cast("string"), F.lit('">'), F.when(i < last, tag("basedOn", F.concat(F.lit("S"), (i + 1).cast("string")))).otherwise(""),
        F.lit("<w:rPr>"), F.when(i == last, F.concat(F.lit('<w:rFonts w:ascii="Font'), (F.col("doc_id") % 3).cast("string"), F.lit('"/>'))).otherwise(""),
        F.when(i == F.col("doc_id") % LONG_CHAIN, tag("sz", 20 + i)).otherwise(""), F.lit("</w:rPr></w:style>"),
    ))
    defaults = '<w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="19"/><w:color w:val="auto"/></w:rPr></w:rPrDefault></w:docDefaults>'
    styles = F.concat(F.lit(f"<w:styles {w}>{defaults}"), F.array_join(chain, ""), F.lit("</w:styles>"))
    rel = '<Relationship Id="rId2" Type="header" Target="header1.xml"/><Relationship Id="rId3" Type="styles" Target="./styles.xml"/><Relationship Id="rId4" Target="nowhere"/>'
    rels = F.lit(f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rel}</Relationships>')
    parts = {"word/document.xml": document, "word/header1.xml": header, "word/styles.xml": styles, "word/_rels/document.xml.rels": rels}

    def close(batches):
        import io
        import zipfile

        import pyarrow as pa

        def zipped():
            for doc, *xml in pg.rows_of(batches):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, x in zip(parts_named, xml):
                        z.writestr(name, x)
                yield doc, b"no package" if doc % 50 == 7 else buffer.getvalue()

        yield from pg.batches_of(zipped(), pa.schema([("doc_id", pa.int64()), ("content", pa.binary())]))

    parts_named = list(parts)
    return docs.select("doc_id", *[x.alias(f"x{i}") for i, x in enumerate(parts.values())]).mapInArrow(close, "doc_id long, content binary")


def write_packages(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """packages() as files folder/<doc_id mod 7>/<doc_id div 7>.docx, so that names come again in other folders."""

    def put(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)
        n = 0
        for doc, content in pg.rows_of(batches):
            store.create_dir(f"{root}/{doc % 7}", recursive=True)
            with store.open_output_stream(f"{root}/{doc % 7}/{doc // 7}.docx") as f:
                f.write(content)
            n += 1
        yield pa.record_batch({"n": [n]})

    packages(spark, sf_dir).mapInArrow(put, "n long").agg(F.sum("n")).collect()
    return folder
