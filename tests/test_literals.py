"""Literal cases: single operators on small inputs.

Fixed values: the inputs and expected outputs below state what the formats and labels ask for; the code around them is own.
"""

from __future__ import annotations

import zipfile

from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import classify as cl
from foliant.operators import package as pk
from foliant.operators import select as sel
from foliant.operators import structure as ops
from foliant.operators import write as wr
from foliant.sources import packages as pg
from foliant.streaming import events as ev


def one(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "v STRING")
    return [r[0] for r in df.select(fn("v")).collect()]


def test_numbering_prefix(spark):
    assert one(spark, ["0.7003", "2.1 数据来源", "3.1.1数据来源", "1. x", "（3）", "A. b"], tx.numbering_prefix) == [None, "2.1", "3.1.1", "1.", "（3）", "A."]


def test_colors_and_spacing(spark):
    assert one(spark, ["#112233", "12"], tx.hex_color) == ["112233", None]
    assert one(spark, ["#FFFF00", "Dark Blue", "mauve"], tx.highlight_color) == ["yellow", "darkBlue", None]
    row = spark.range(1).select(tx.line_spacing(F.lit("400"), F.lit("exact")).alias("x")).first()["x"]
    assert (row["mode"], row["value"]) == ("exact", 20.0)


def test_payload_errors(spark):
    rows = [("split_paragraph", "0"), ("set_line_spacing", "0"), ("set_bold", "yes"), ("split_paragraph", "5")]
    out = wr.normalize_payload(spark.createDataFrame(rows, "type STRING, payload STRING")).collect()
    assert [r["error"] is None for r in out] == [False, False, False, True]


def runs(spark, rows):
    return spark.createDataFrame([(1, f"p_{p}", p, r, f"p_{p}_r_{r}", t) for p, r, t in rows], "doc_id INT, paragraph_id STRING, paragraph_index INT, run_index INT, run_id STRING, text STRING")


def test_split_language(spark):
    out = wr.split_language(runs(spark, [(2, 1, "这是NLP,模型2025报告")])).orderBy("seg").collect()
    assert [r["text"] for r in out] == ["这是", "NLP", ",模型", "2025", "报告"]
    assert [r["segment_id"] for r in out] == [f"p_2_r_1__seg_{i}" for i in range(5)]


def test_merge_and_split(spark):
    two = runs(spark, [(0, 0, "hello"), (1, 0, "world")])
    merged = wr.merge_paragraphs(two, two.filter("paragraph_id = 'p_0'")).collect()
    assert [(r["paragraph_id"], r["text"], r["error"]) for r in merged] == [("p_0", "helloworld", None)]
    last = wr.merge_paragraphs(two, two.filter("paragraph_id = 'p_1'")).orderBy("paragraph_no").collect()
    assert [r["error"] for r in last] == [None, "E_NO_NEXT_PARAGRAPH"]
    whole = runs(spark, [(0, 0, "helloworld")])
    cut = wr.split_paragraphs(whole, whole.select("doc_id", "run_id", F.lit(5).alias("split_offset"))).orderBy("paragraph_no").collect()
    assert [(r["run_id"], r["text"]) for r in cut] == [("p_0_r_0", "hello"), ("p_1_r_0", "world")]
    outside = wr.split_paragraphs(whole, whole.select("doc_id", "run_id", F.lit(10).alias("split_offset"))).collect()
    assert [r["text"] for r in outside] == ["helloworld"]


def test_select_and_bind(spark):
    p = spark.createDataFrame([(1, "p_0", 0, "heading", 1), (1, "p_1", 1, "body", None), (1, "p_2", 2, "body", None), (1, "p_3", 3, "list_item", None)], "doc_id INT, paragraph_id STRING, paragraph_index INT, role STRING, heading_level INT")
    n = runs(spark, [(0, 0, "a"), (1, 0, "b"), (1, 1, "c"), (2, 0, "d"), (3, 0, "e")])
    got = sel.select_targets(p, n, "body")
    assert sorted(r["run_id"] for r in got.collect()) == ["p_1_r_0", "p_1_r_1", "p_2_r_0"]
    intents = spark.createDataFrame([(1, "m", "merge_paragraph", "body"), (1, "f", "set_font", "body")], "doc_id INT, op_id STRING, op_type STRING, scope STRING")
    scoped = got.join(n, ["doc_id", "paragraph_id", "run_id"]).withColumn("scope", F.lit("body"))
    bound = {r["op_id"]: r["target_ids"] for r in sel.bind_intents(intents, scoped).collect()}
    assert bound == {"f": ["p_1_r_0", "p_1_r_1", "p_2_r_0"], "m__1": ["p_1_r_0"], "m__2": ["p_1_r_1"], "m__3": ["p_2_r_0"]}


def test_aggregate_predictions(spark):
    rows = [(1, "p1", 1, "title", 0.95), (1, "p2", 2, "body", 0.8), (1, "p3", 3, "body", 0.8), (1, "p4", 4, "body", 0.6), (1, "p4", 4, "title", 0.7)]
    pred = spark.createDataFrame(rows, "doc_id INT, paragraph_id STRING, paragraph_index INT, semantic_key STRING, confidence DOUBLE")
    agg = cl.aggregate_predictions(pred)
    got = {r["semantic_key"]: (r["paragraph_ids"], r["confidence"]) for r in agg.collect()}
    assert got == {"title": (["p1", "p4"], 0.825), "body": (["p2", "p3", "p4"], 0.733333)}
    assert cl.overall_confidence(agg).first()["overall"] == 0.77
    ps = spark.createDataFrame([(1, f"p{i}") for i in range(1, 6)], "doc_id INT, paragraph_id STRING")
    assert [r["paragraph_id"] for r in cl.unmatched_paragraphs(ps, pred, ps.limit(0)).collect()] == ["p5"]


def test_style_cycle(spark):
    styles = spark.createDataFrame([(1, "A", "B", "FontA"), (1, "B", "A", None), (1, "C", "B", None)], "doc_id INT, style_id STRING, based_on STRING, font_name STRING")
    base = spark.createDataFrame([(1, "Base")], "doc_id INT, font_name STRING")
    got = {r["style_id"]: r["font_name"] for r in ops.resolve_styles(styles, base, ("font_name",)).collect()}
    assert got == {"A": "FontA", "B": "FontA", "C": "FontA"}


def test_scan_packages(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "one.docx", "w") as z:
        for name in ("word/header1.xml", "word/document.xml", "word/_rels/document.xml.rels", "word/media/a.png"):
            z.writestr(name, "<x/>")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    rows = pk.scan_docx_corpus(spark, str(tmp_path)).orderBy("doc_id", "part_order").collect()
    assert [(r["doc_id"], r["part_path"], r["kind"]) for r in rows] == [("bad", None, None), ("one", "word/document.xml", "main_document"), ("one", "word/header1.xml", "header"), ("one", "word/media/a.png", "media")]
    assert rows[0]["error"].startswith("BadZipFile") and rows[1]["error"] is None


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'


def test_read_document(spark, tmp_path):
    """A package with styles, numbering, a nested table, a formula, notes and broken XML, read to resolved runs."""
    parts = {
        "[Content_Types].xml": '<Types><Default Extension="XML" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="main+xml"/></Types>',
        "word/document.xml": f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Ti</w:t></w:r><w:r/><w:r><w:t>tle</w:t></w:r></w:p>
 <w:p><w:pPr><w:pStyle w:val="B"/><w:jc w:val="center"/><w:spacing w:line="400" w:lineRule="exact"/><w:numPr><w:ilvl w:val="1"/><w:numId w:val="7"/></w:numPr></w:pPr>
 <w:r><w:rPr><w:rStyle w:val="C"/><w:b/><w:i w:val="0"/><w:strike/><w:u w:val="none"/><w:highlight w:val="yellow"/></w:rPr><w:t>a</w:t><w:t> &amp; b</w:t></w:r>
 <w:r><m:oMath><m:r><m:t>x</m:t></m:r></m:oMath></w:r><w:r><w:drawing/></w:r></w:p>
 <w:tbl><w:tr><w:tc><w:p/></w:tc><w:tc><w:tbl><w:tr><w:tc><w:p><w:r><w:t>deep</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>
 <w:sectPr><w:headerReference w:type="default" r:id="h1" xmlns:r="x"/><w:footerReference w:type="default" r:id="gone" xmlns:r="x"/></w:sectPr></w:body></w:document>""",
        "word/_rels/document.xml.rels": '<Relationships><Relationship Id="h1" Type="header" Target="header1.xml"/><Relationship Id="up" Type="x" Target="../a/./b.xml"/><Relationship Id="" Type="x" Target="y"/></Relationships>',
        "word/header1.xml": f"<w:hdr {W}><w:p><w:r><w:t>top</w:t></w:r></w:p></w:hdr>",
        "word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:id="2"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>',
        "word/styles.xml": f"""<w:styles {W}><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Base" w:eastAsia="East"/><w:sz w:val="24"/></w:rPr></w:rPrDefault></w:docDefaults>
 <w:style w:type="paragraph" w:styleId="Normal" w:default="1"><w:pPr><w:jc w:val="left"/></w:pPr></w:style><w:style w:type="paragraph" w:styleId="B"><w:name w:val="Body"/><w:basedOn w:val="Normal"/><w:rPr><w:sz w:val="20"/><w:color w:val="00aa00"/></w:rPr></w:style>
 <w:style w:type="paragraph" w:styleId="H"><w:basedOn w:val="B"/></w:style><w:style w:type="character" w:styleId="C"><w:rPr><w:rFonts w:hAnsi="Mono"/></w:rPr></w:style></w:styles>""",
        "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="4"><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="7"><w:abstractNumId w:val="4"/></w:num><w:num w:numId="8"/></w:numbering>',
        "docProps/core.xml": "<c><creator>Ada</creator><revision> 9 </revision></c>",
        "word/endnotes.xml": "<broken",
    }
    with zipfile.ZipFile(tmp_path / "one.docx", "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    found = pg.package_parts(pg.read_packages(spark, str(tmp_path))).cache()
    nodes = pg.xml_nodes(found).cache()
    assert [r["part_path"] for r in nodes.filter("tag = '#error'").collect()] == ["word/endnotes.xml"]
    p = {r["paragraph_index"]: r for r in pg.document_paragraphs(nodes, found).collect()}
    assert [p[i]["text"] for i in range(6)] == ["Title", "a & bx", "", "deep", "top", "note"]  # a formula's text counts
    assert (p[1]["style_id"], p[1]["alignment"], p[1]["num_id"], p[1]["num_ilvl"], p[1]["n_images"], p[1]["n_formulas"]) == ("B", "center", "7", "1", 1, 1)
    assert (p[1]["line_spacing"]["mode"], p[1]["line_spacing"]["value"]) == ("exact", 20.0)
    assert p[3]["in_table"] and p[3]["anchor"] == "/document/body/tbl[0]/tr[0]/tc[1]/tbl[0]/tr[0]/tc[0]/p[0]" and not p[0]["in_table"]
    cells = {r["paragraph_index"]: (r["depth"], r["cell"]) for r in pg.document_cells(nodes, found).collect()}
    assert cells == {2: (1, "tb_0/tr_0/tc_0"), 3: (2, "tb_0/tr_0/tc_1/tb_0/tr_0/tc_0")}
    runs = pg.document_runs(nodes, found).cache()
    assert {r["run_id"] for r in runs.collect()} == {"p_0_r_0", "p_0_r_2", "p_1_r_0", "p_3_r_0", "p_4_r_0", "p_5_r_0", "p_1_r_1"}
    direct = ops.run_properties(runs, ("doc_id", "run_id", "char_style")).join(pg.document_paragraphs(nodes, found).join(runs.select("run_id", "paragraph_index"), "paragraph_index").select("run_id", F.col("style_id").alias("para_style"), "alignment", "line_spacing"), "run_id")
    raw = pg.style_rows(nodes, found)
    base = ops.run_properties(pg.default_rows(nodes, found), ("doc_id",))
    names = ("font_name", "font_size_pt", "font_color", "is_bold")
    styles = ops.resolve_styles(ops.run_properties(raw, ("doc_id", "style_id", "based_on", "alignment")), base.withColumn("alignment", F.lit(None).cast("string")), (*names, "alignment"))
    constants = {"font_name": "Times", "font_size_pt": 10.0, "font_color": "000000", "is_bold": False, "alignment": "left"}
    got = {r["run_id"]: r for r in ops.resolve_run_style(direct, styles, base, constants, names, ("alignment",)).collect()}
    assert tuple(got["p_0_r_0"][n] for n in (*names, "alignment")) == ("East", 10.0, "00AA00", False, "left")
    # A character style that is not based on another one starts from the document's defaults.
    assert tuple(got["p_1_r_0"][n] for n in (*names, "alignment")) == ("Mono", 12.0, "00AA00", True, "center") and got["p_1_r_0"]["line_spacing"]["value"] == 20.0
    one = next(r for r in ops.run_properties(runs, ("run_id",)).collect() if r["run_id"] == "p_1_r_0")
    assert (one["is_italic"], one["is_strike"], one["is_underline"], one["highlight_color"]) == (False, True, False, "yellow")
    edges = pk.relationship_edges(pg.relationship_rows(nodes))
    assert {r["target"] for r in edges.collect()} == {"word/header1.xml", "a/b.xml"}
    assert [(r["kind"], r["part_path"]) for r in pk.header_footer_bindings(pg.section_rows(nodes), edges).collect()] == [("header", "word/header1.xml")]
    levels = {r["num_id"]: [(x["ilvl"], x["num_fmt"]) for x in r["levels"]] for r in ops.numbering_projection(*pg.numbering_rows(nodes)).collect()}
    assert levels == {"7": [(0, "decimal"), (1, "bullet")], "8": []}
    assert tuple(pk.core_properties(pg.property_rows(nodes)).first())[1:] == ("Ada", None, None, None, "9")
    kinds = {r["part_path"]: r["content_type"] for r in pk.resolve_content_types(found.select("doc_id", "part_path"), *pg.content_type_rows(nodes)).collect()}
    assert kinds["word/document.xml"] == "main+xml" and kinds["word/styles.xml"] == "application/xml"


def test_load_templates(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"template_id":"t","version":"2.0","semantics":[{"key":"a","label":"A","required":true,"multiple":false}],"patch_blocks":[],"operation_blocks":[{"semantic_key":"a","scope":"run"}]}')
    tables = pk.load_templates(spark, str(tmp_path))
    assert [r["key"] for r in tables["t_semantic"].collect()] == ["a"]
    assert [r["scope"] for r in tables["t_patch"].collect()] == ["run"]


def test_edit_nodes(spark):
    n = spark.createDataFrame([(1, "/a", "w:p", "x", {"k": "1"}), (1, "/b", "w:p", "y", {})], "doc_id INT, path STRING, tag STRING, text STRING, attrs MAP<STRING,STRING>")
    e = spark.createDataFrame([(1, "/a", 1, "set_attr", "k", "2"), (1, "/a", 2, "remove_attr", "k", None), (1, "/a", 3, "set_text", None, None), (1, "/b", 4, "remove_node", None, None), (1, "/c", 5, "ensure_node", None, "w:r")], "doc_id INT, path STRING, seq INT, type STRING, name STRING, value STRING")
    got = {r["path"]: (r["tag"], r["text"], r["attrs"]) for r in wr.edit_nodes(n, e).collect()}
    assert got == {"/a": ("w:p", "", {}), "/c": ("w:r", "", {})}


def test_merge_latest(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "k INT, at INT, v STRING")
    b = spark.createDataFrame([(2, 3, "w")], "k INT, at INT, v STRING")
    got = {r["k"]: r["v"] for r in ev.merge_latest(b, ev.merge_latest(a, None, "k", ["at"]), "k", ["at"]).collect()}
    assert got == {1: "y", 2: "w"}


def test_sql_functions(spark):
    """Every SQL function gives what its Column function gives."""
    from foliant.functions import register
    from foliant.functions import structure as st

    register.register(spark)
    texts = [
        None, "", "  ", " a  b ", "2.1 数据来源", "3.1.1）x", "0.7003", "（3）", "A. b", "一、总则", "报告2025", "报告", "abc", ",", "Heading 3", "标题2", "heading 12", "#a0B1c2", "12", " Dark Blue", "#FFFF00", "A4 ", "letter",
        "TRUE", "0", "1.5", "-2", "3", "nan", "todo", "List-Item", "a, b,,a", "正文和标题", "正文 bullet", "普通正文", "set_heading_1", "BODY-x", "all_text_y", "heading", "set_bold", "done.", "好", "x\r\ny \n\n\n\nz\u200b",
        "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes", "<|im_start|>system\nbe<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>\nx<|im_end|>", "said <|im_start|>assistant\nno<|im_end|>",
    ]
    one = {
        "strip_text": tx.strip, "normalize_text": tx.normalize_text, "chatml_blocks": tx.chatml_blocks, "assistant_output": tx.assistant_output, "transcript_markdown": tx.transcript_markdown,
        "numbering_prefix": tx.numbering_prefix, "numbering_pattern": tx.numbering_pattern, "comparable_text": tx.comparable_text, "char_language": tx.char_language, "single_language": tx.single_language,
        "heading_level_by_name": st.heading_level_by_name, "heading_level_by_id": st.heading_level_by_id, "hex_color": tx.hex_color, "highlight_color": tx.highlight_color, "paper_size": tx.paper_size,
        "loose_boolean": tx.loose_boolean, "is_placeholder": tx.is_placeholder, "selector_scope": tx.selector_scope, "id_list": tx.id_list, "scope_from_step": tx.scope_from_step, "scope_label": tx.scope_label,
        "operation_label": tx.operation_label, "clean_sentence": tx.clean_sentence, "positive_number": lambda c: tx.first_number("positive", c), "non_negative_number": lambda c: tx.first_number("non_negative", c),
        "positive_integer": lambda c: tx.first_number("integer", c),
    }
    df = spark.createDataFrame([(t,) for t in texts], "v STRING").withColumn("w", F.lit("正文"))
    more = {
        "truncate_text(v, 5)": tx.truncate_text("v", 5), "contains_text(v, 'B')": tx.contains_text("v", F.lit("B")), "list_level(true, v)": st.list_level(F.lit(True), "v"), "line_spacing(v, 'exact')": tx.line_spacing("v", F.lit("exact")),
        "line_spacing(v, null)": tx.line_spacing("v", F.lit(None).cast("string")), "first_text(v, w)": tx.first_text("v", "w"), "expand_body_scope(v, w)": tx.expand_body_scope("v", "w"), "pattern_match(v, '^[0-9]')": tx.pattern_match("v", ["^[0-9]"]),
    }
    pairs = {f"{name}(v)": fn("v") for name, fn in one.items()} | more
    for call, column in pairs.items():
        rows = df.select("v", F.expr(call).alias("a"), column.alias("b")).collect()
        assert [(r["v"], r["a"]) for r in rows] == [(r["v"], r["b"]) for r in rows], call
    units = {"to_half_points": tx.to_half_points, "to_twips": tx.to_twips, "to_line": tx.to_line, "cm_to_twips": tx.cm_to_twips, "emu_to_px": tx.emu_to_px, "pt_to_px": tx.pt_to_px}
    got = spark.range(1).select(*[F.expr(f"{n}(2.54D)").alias(f"{n}_a") for n in units], *[f(F.lit(2.54)).alias(f"{n}_b") for n, f in units.items()]).first()
    assert all(got[f"{n}_a"] == got[f"{n}_b"] for n in units)
    helpers = {"chatml_all_blocks", "chatml_upto_blank", "assistant_of", "markdown_of", "scope_form", "sentence_of"}
    tested = set(one) | {c.split("(")[0] for c in more} | set(units)
    assert set(register.SQL_FUNCTIONS) == tested | helpers
