"""A folder of document packages as a data source: parts are rows, and only the parts asked for are read.

Files are dealt to partitions by their bytes. Of a package the directory at its end is read and then the parts that a
filter on their kind leaves, so styles of a million documents cost their styles and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from . import packages

SPLIT_BYTES = 128 << 20


def _store(path: str):
    """The file system of a path and the path within it; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


class Seekable:
    """An open file of a store; a seek before its beginning is an OSError, as zipfile expects of files."""

    def __init__(self, file):
        self.file = file

    def seek(self, *to) -> int:
        try:
            return self.file.seek(*to)
        except pa.ArrowInvalid as e:
            raise OSError(str(e)) from e

    def __getattr__(self, name: str):
        return getattr(self.file, name)


class PackageFiles(DataSource):
    """format("package_parts"): doc_id (the path below the folder), part_path, xml, error, kind."""

    @classmethod
    def name(cls) -> str:
        return "package_parts"

    def schema(self) -> str:
        return packages.PARTS + ", kind string"

    def reader(self, schema) -> DataSourceReader:
        return PackageReader(self.options)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class PackageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.split = int(options.get("splitbytes") or options.get("splitBytes") or SPLIT_BYTES)
        self.kinds: frozenset[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """kind = x and kind IN (...) are met here: other parts are not even unpacked. Broken packages have no kind."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("kind",):
                own = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.kinds = own if self.kinds is None else self.kinds & own
            yield f  # checked again behind the scan, which costs nothing

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _store(self.root)
        found = [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(".docx")]
        out, files, held = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            if files and held + f.size > self.split:
                out.append(Files(files))
                files, held = [], 0
            files.append((f.path, f.path[len(root) :].lstrip("/").removesuffix(".docx")))
            held += f.size
        return [*out, Files(files)] if files else [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """Batches of a bounded size; rows would be gathered by the ten thousand, whatever their length."""
        from foliant.functions.structure import part_kind_of

        store, _ = _store(self.root)

        def rows() -> Iterator[tuple]:
            for path, doc in partition.files:
                with store.open_input_file(path) as f:
                    for row in packages.part_rows(doc, Seekable(f), self.kinds):
                        yield (*row, part_kind_of(row[1]) if row[1] else None)

        yield from packages.batches_of(rows(), packages.PART_SCHEMA.append(pa.field("kind", pa.string())))


def package_files(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(doc_id, part_path, xml, error, kind, part_order) of the packages under path; a filter on kind prunes the reading.

    Needs a store that pyarrow reads; packages.read_packages() reads any that Spark does. Filters reach Python sources
    only where spark.sql.python.filterPushdown.enabled is set, so it is set here.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackageFiles)
    return packages.with_order(spark.read.format("package_parts").option("splitBytes", split_bytes).load(path))
