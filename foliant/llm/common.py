"""Shared helpers: table reading, materialised steps, hashing of words and shingles, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


# ---------------------------------------------------------------- tables and materialised steps


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session of one machine (master local or local[n]) gets a new folder; any other is an error,
    as executors don't see each other's folders.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


_written: list[str] = []  # folders that stage() wrote and nothing has deleted yet


def stage(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged() -> int:
    """A mark for drop_staged(): how many folders stage() has written and kept."""
    return len(_written)


def drop_staged(spark: SparkSession, first: int, last: int) -> None:
    """Delete the folders that stage() wrote between two marks, once nothing reads them any more."""
    for path in _written[first:last]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _written[first:last]


# ---------------------------------------------------------------- ranges of a number


def quantiles(numbers: DataFrame, n: int) -> list[int]:
    """At most n - 1 cuts that deal the only column of numbers into n parts of about equal size; nulls don't count."""
    marks = [i / n for i in range(1, n)]
    return sorted(set(numbers.agg(F.percentile_approx(numbers.columns[0], marks or [0.5], 10 * n + 1000)).first()[0] or []))


def bucket_of(spark: SparkSession, cuts: list[int]):
    """A function of a long column: how many of the sorted cuts lie below it, by binary search; null for null."""
    shared = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.arrow_udf("int")
    def place(x: pa.Array) -> pa.Array:
        known = x.is_valid().to_numpy(zero_copy_only=False)
        at = np.searchsorted(shared.value, x.fill_null(0).to_numpy(zero_copy_only=False))
        return pa.array(at.astype(np.int32), mask=~known)

    return place


# ---------------------------------------------------------------- Arrow batches


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the named string column of each holds about SLICE_BYTES (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        arr = batch.column(batch.schema.get_field_index(column))
        offsets = text_buffers(arr)[1]
        start = 0
        while start < n:
            end = int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, side="right")) - 1
            end = min(n, max(end, start + 1))
            yield batch.slice(start, end - start)
            start = end


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; a null row is empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    body = arr.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_array(chunks: list[np.ndarray]) -> pa.Array:
    return pa.array([c.tobytes() for c in chunks], pa.binary())


# ---------------------------------------------------------------- hashing


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h = h ^ (h >> np.uint64(27))
    h = h * _M2
    return h ^ (h >> np.uint64(31))


def _sequence(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = _sequence(11, 256)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = _sequence(23, 64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, list[np.ndarray]] = {}


def _powers_to(n: int) -> list[np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64; those for SLICE_BYTES are kept for the worker's lifetime."""
    if n > SLICE_BYTES + 1:
        return _powers_to(n)
    if "both" not in _powers:
        _powers["both"] = _powers_to(SLICE_BYTES + 1)
    return _powers["both"]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (maximal run without blank, tab or line ends) and the word offsets of each row.

    Long data is hashed a slice at a time, cut before white space, so memory follows the slice and the longest word.
    """
    hashes, at, a, words = [], np.zeros(len(offsets), np.int64), 0, 0
    while a < len(data):
        b = min(len(data), a + SLICE_BYTES)
        while b < len(data) and not _SPACE[data[b]]:
            gap = np.flatnonzero(_SPACE[data[b : b + 4096]])
            b += int(gap[0]) if len(gap) else min(4096, len(data) - b)
        i, j = np.searchsorted(offsets, [a, b], side="left")
        h, own = _slice_hashes(data[a:b], np.concatenate([offsets[i:j] - a, [b - a]]), lower)
        at[i:j] = own[:-1] + words
        hashes.append(h)
        words += len(h)
        a = b
    at[np.searchsorted(offsets, a, side="left") :] = words
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), at


def _slice_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    word = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[:n], out=total[1:])
    return mix((total[e] - total[s]) * down[s]), np.searchsorted(s, offsets)


def shingles(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of each row, and their row offsets. A row of 1..k-1 words gives one of all its words."""
    counts = np.diff(offsets)
    per_row = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate([[0], np.cumsum(per_row)])
    if out_offsets[-1] == 0:
        return np.zeros(0, np.uint64), out_offsets
    starts = np.repeat(offsets[:-1] - out_offsets[:-1], per_row) + np.arange(out_offsets[-1])
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    left = np.repeat(offsets[1:], per_row) - starts
    h = np.zeros(len(starts), np.uint64)
    for j in range(k):
        h += np.where(left > j, padded[starts + j] * _STEP[j], np.uint64(0))
    short = left < k
    h[short] += _STEP[32 + left[short]]
    return mix(h), out_offsets


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Smallest reachable id for every id in an edge list: rows (id, component).

    Alternates large-star and small-star contraction (Kiveris et al. 2014) until the edges stay as they are; every
    round is two aggregations and two joins on the remaining edges and is checkpointed, so a lost executor costs one
    round at most. The stars of a hub are joined, never gathered into one row.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).filter("a > b").distinct()
    shared_dir(spark)
    e = e.checkpoint()
    mark = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(joined.select("a", F.col("m").alias("b"))).filter("a > b").distinct()
        e = small.checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    stars = e.groupBy("a").agg(F.min("b").alias("b"))
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())
