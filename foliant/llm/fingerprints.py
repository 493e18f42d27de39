"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

Every five-word shingle is hashed once; the top bits choose one of BINS bins and each bin keeps its least hash. An
empty bin copies the bin that its own pseudo-random probe sequence reaches first (Shrivastava 2017). Eight low bits
per bin are packed; the likeness of two fingerprints removes the share of bins that agree by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, bucket_of, documents, mix, quantiles, shingles, shuffle_partitions, slices, word_hashes

BINS, BITS, WORDS = 256, 8, 5
RANGE_ROWS = 20_000
_PROBES = 64
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_probe = (
    mix(np.arange(BINS * _PROBES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77)) % np.uint64(BINS)
).astype(np.int64).reshape(BINS, _PROBES)


def sketch(hashes: np.ndarray) -> np.ndarray | None:
    """BINS bytes for a row's shingle hashes; None where there is no shingle."""
    if not len(hashes):
        return None
    least = np.sort(hashes)
    bins = (least >> _SHIFT).astype(np.int64)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    filled = np.zeros(BINS, bool)
    value = np.zeros(BINS, np.uint64)
    filled[bins[first]] = True
    value[bins[first]] = least[first]
    empty = np.flatnonzero(~filled)
    if len(empty):
        reach = filled[_probe[empty]]
        found = reach.any(axis=1)
        donor = _probe[empty, reach.argmax(axis=1)]
        if not found.all():  # beyond the probes: the next filled bin from the last probed one
            have = np.flatnonzero(filled)
            far = _probe[empty[~found], -1]
            donor[~found] = have[np.searchsorted(have, far) % len(have)]
        value[empty] = value[donor]
    return (mix(value) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard similarity: agreement of bins, less what 2**-BITS chance agreement gives. Two empties: 1."""
    if a is None or b is None:
        return 1.0 if a is b else 0.0
    chance = 2.0**-BITS
    return min(1.0, max(0.0, (float(np.mean(a == b)) - chance) / (1 - chance)))


def sketches(texts: list[str]) -> list[np.ndarray | None]:
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
    words, at = word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets)
    h, at = shingles(words, at, WORDS)
    return [sketch(h[a:b]) for a, b in zip(at[:-1], at[1:])]


def _hex(s: np.ndarray | None) -> str:
    return "" if s is None else s.tobytes().hex()


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fingerprint of every whole text; a map over rows. Null and blank texts: the empty fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [_hex(s) for s in sketches([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", docs[text].alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; each is held until the row after it is known. Look-ahead rows only serve as the next."""
    held: list[tuple[int, str]] = []  # rows that wait, the last one included
    size = 0

    def emit(rows: list[tuple[int, str]], after: tuple[int, str]) -> pa.RecordBatch:
        texts = [t for _, t in rows] + [after[1]]
        cuts = [len(t) // 3 for t in texts[:-1]]
        edited = [t[: len(t) - m] + n[:m] for t, n, m in zip(texts, texts[1:], cuts)]
        prints, changed = sketches(texts), sketches(edited)
        columns = [
            [d for d, _ in rows],
            [len(t) for t in texts[:-1]],
            [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            [_hex(s) for s in prints[:-1]],
            [_hex(s) for s in changed],
            [likeness(a, b) for a, b in zip(prints, changed)],
            [likeness(a, b) for a, b in zip(prints, prints[1:])],
        ]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [f.split()[0] for f in RESULT.split(",")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    bucket = None
    for batch in slices(batches):
        for b, d, ahead, t in zip(*(batch.column(i).to_pylist() for i in range(4))):
            row = (d, t or "")
            if bucket is not None and b != bucket:
                held, size = [], 0
            bucket = b
            if ahead:
                if held:
                    yield emit(held, row)
                held, size = [], 0
                continue
            held.append(row)
            size += len(row[1])
            if size > SLICE_BYTES and len(held) > 1:
                yield emit(held[:-1], row)
                held, size = [row], len(row[1])


def edited_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each document, its edited text and the next document by descending doc_id (after the last: the first).

    The edit replaces the last third by the start of the next document. Texts move once: rows go to ranges of doc_id,
    sorted there, and the first row of every range is also sent to the range before it. Ranges hold RANGE_ROWS rows
    or fewer. Null texts are empty; rows of equal doc_id are ordered by their text, rows without doc_id come last; an
    only document is its own next. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(docs[text], F.lit("")).alias("text"))
    size = docs.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("no_id")).first()
    cuts = quantiles(rows.select("doc_id"), max(shuffle_partitions(spark), -(-size["n"] // RANGE_ROWS)))
    tail = max(1, -(-size["no_id"] // RANGE_ROWS))
    # Range 0 holds the largest ids: number of cuts above the id. Rows without id are ordered and dealt by a hash.
    order = F.coalesce("doc_id", F.xxhash64("text"))
    last = F.least(F.floor((0.5 - order / F.lit(2.0**64)) * tail), F.lit(tail - 1)).cast("int")
    place = F.when(F.col("doc_id").isNull(), len(cuts) + 1 + last).otherwise(len(cuts) - bucket_of(spark, cuts)("doc_id"))
    rows = rows.select("doc_id", order.alias("o"), place.alias("place"), "text")
    # One row for each range: what leads it, the row that the range before it must see.
    tops = {r["place"]: r["top"] for r in rows.groupBy("place").agg(F.max("o").alias("top")).collect()}
    ranges = sorted(tops)
    if not ranges:
        return spark.createDataFrame([], RESULT)
    dense = {x: i for i, x in enumerate(ranges)}
    shared = spark.sparkContext.broadcast((np.array([dense.get(x, 0) for x in range(ranges[-1] + 1)]), np.array([tops[x] for x in ranges], np.int64)))

    @F.arrow_udf("array<struct<bucket: int, ahead: boolean>>")
    def targets(places: pa.Array, orders: pa.Array) -> pa.Array:
        """The row's own range, and the range before it where it leads its own; the first range follows the last."""
        to, top = shared.value
        at = to[places.to_numpy()]
        leads = top[at] == orders.to_numpy()
        both = [[(b, False), ((b - 1) % len(top), True)] if lead else [(b, False)] for b, lead in zip(at.tolist(), leads.tolist())]
        return pa.array([[{"bucket": b, "ahead": a} for b, a in x] for x in both], pa.list_(pa.struct([("bucket", pa.int32()), ("ahead", pa.bool_())])))

    sent = rows.withColumn("to", F.explode(targets("place", "o"))).select("to.bucket", "doc_id", "to.ahead", "text", "o")
    placed = sent.repartitionById(len(ranges), "bucket").sortWithinPartitions("bucket", "ahead", F.desc("o"), "text")
    return placed.select("bucket", "doc_id", "ahead", "text").mapInArrow(_with_next, RESULT)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
