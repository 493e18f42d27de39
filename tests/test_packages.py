"""Package files as a data source: ids, splits by bytes, broken packages, and parts that a filter leaves unread."""

from __future__ import annotations

import io
import zipfile

from foliant.operators import package as pk
from foliant.sources import packages as pg
from foliant.sources.package_files import package_files


def package(**parts) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        for name, text in parts.items():
            z.writestr(f"word/{name}.xml", text)
    return buffer.getvalue()


def put(root, name: str, content: bytes) -> None:
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    (root / name).write_bytes(content)


def test_equal_names_in_two_folders_stay_apart(spark, tmp_path):
    put(tmp_path, "a/x.docx", package(document="<d>1</d>"))
    put(tmp_path, "b/x.docx", package(document="<d>2</d>"))
    put(tmp_path, "x.docx", package(document="<d>3</d>"))
    put(tmp_path, "b/other.txt", b"no package")
    want = {("a/x", "<d>1</d>"), ("b/x", "<d>2</d>"), ("x", "<d>3</d>")}
    for path in (str(tmp_path), f"file:{tmp_path}", f"{tmp_path}/"):
        assert {(r["doc_id"], r["xml"]) for r in package_files(spark, path).collect()} == want
        assert {(r["doc_id"], r["xml"]) for r in pg.package_parts(pg.read_packages(spark, path)).collect()} == want


def test_a_filter_on_kind_leaves_other_parts_unread(spark, tmp_path):
    """The main document is damaged: whoever reads it gets an error row, whoever asks for styles does not."""
    whole = package(styles="<s/>", document="<d>damaged</d>", header1="<h/>").replace(b"damaged", b"DAMAGED")
    put(tmp_path, "x.docx", whole)
    assert [(r["part_path"], r["error"] is None) for r in package_files(spark, str(tmp_path)).collect()] == [("word/styles.xml", True), (None, False)]
    for condition in ("kind = 'styles'", "kind IN ('styles', 'header')"):
        got = package_files(spark, str(tmp_path)).filter(condition).collect()
        assert {(r["kind"], r["error"]) for r in got} == {("styles", None)} | ({("header", None)} if "IN" in condition else set())
    assert pk.scan_docx_corpus(spark, str(tmp_path)).filter("kind = 'footer'").count() == 0
    content = spark.createDataFrame([("x", whole)], "doc_id string, content binary")
    assert [r["kind"] for r in pg.package_parts(content, ("styles",)).collect()] == ["styles"]


def test_files_are_dealt_by_bytes(spark, tmp_path):
    for i in range(10):
        put(tmp_path, f"{i % 3}/{i}.docx", package(document=f"<d>{'x' * 500}</d>"))
    assert package_files(spark, str(tmp_path)).rdd.getNumPartitions() == 1
    few = package_files(spark, str(tmp_path), split_bytes=1500)
    assert few.rdd.getNumPartitions() == 5 and few.count() == 10


def test_broken_and_empty_packages(spark, tmp_path):
    put(tmp_path, "bad.docx", b"no package")
    put(tmp_path, "none.docx", b"")
    put(tmp_path, "bare.docx", package())
    got = {r["doc_id"]: (r["part_path"], r["kind"]) for r in package_files(spark, str(tmp_path)).collect()}
    assert got == {"bad": (None, None), "none": (None, None)}
    (tmp_path / "nothing").mkdir()
    assert package_files(spark, str(tmp_path / "nothing")).count() == 0


def test_batches_of_packages_are_bounded(tmp_path, monkeypatch):
    """The reader and the unzipping give batches of a bounded size, and rows of a batch become Python objects one by one."""
    from foliant.sources.package_files import Files, PackageReader

    monkeypatch.setattr(pg, "BATCH_CHARS", 1000)
    for i in range(10):
        put(tmp_path, f"{i}.docx", package(document=f"<d>{'x' * 700}</d>"))
    files = Files([(str(tmp_path / f"{i}.docx"), str(i)) for i in range(10)])
    got = list(PackageReader({"path": str(tmp_path)}).read(files))
    assert [b.num_rows for b in got] == [2] * 5 and [r[0] for r in pg.rows_of(got)] == [str(i) for i in range(10)]


def test_nodes_of_some_tags_keep_their_numbers(spark):
    parts = spark.createDataFrame([("a", "x.xml", "<d><p><t>1</t></p><t/><p/></d>"), ("b", "x.xml", "<d>")], "doc_id string, part_path string, xml string")
    every = {r["node"]: r.asDict(True) for r in pg.xml_nodes(parts).filter("doc_id = 'a'").collect()}
    got = pg.xml_nodes(parts, ("p",)).collect()
    assert [r["tag"] for r in got if r["doc_id"] == "b"] == ["#error"]
    assert [r.asDict(True) for r in got if r["doc_id"] == "a"] == [every[1], every[4]]
