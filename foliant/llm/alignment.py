"""Alignment of two tokenizers: which tokens cover the same bytes, and how often each pair of ids does so corpus-wide.

Texts are encoded once; their ids stay as a table. The distinct pairs of linked ids get a minimal perfect hash, built
per bucket of pairs by Spark: levels of bit arrays, a pair set at the first level where nothing meets it. Every
counting task keeps one dense vector of counts, indexed by that hash, and the vectors are summed as a tree. A second
pass aligns the documents again and looks the counts up; each lookup is verified by the pair kept at its slot.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mix, slices, stage
from .pieces import SPACE, Lexicon, Pieces
from .token_counts import _UNUSUAL, WHITE, Merger, byte_symbols

BUCKET_PAIRS = 1 << 14
AT_ONCE = 1 << 21  # pairs of one pass: its hash, pairs and counts take 50 MB of each task
FAN_IN = 16
PORTION_BYTES = 1 << 19
KNOWN_WORDS = 300_000  # of each side: a task holds two lexicons
# The split of byte-level tokenizers, a fixed value, with white space as the tokenizer's library sees it.
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^W\p{L}\p{N}]+|[W]+(?![^W])|[W]+".replace("W", WHITE)


class ByteTokens:
    """A byte-level merging tokenizer from its JSON: ids of words, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"]
        if spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError(f"{path}: not a byte-level tokenizer without normaliser and prefix")
        merger = Merger(spec)
        self._words = regex.compile(WORDS, regex.V0).findall
        self.lexicon = Lexicon(merger.symbols, KNOWN_WORDS)
        back = {c: b for b, c in enumerate(byte_symbols())}
        self.bytes = [b""] * merger.size
        for token, i in spec["model"]["vocab"].items():
            self.bytes[i] = bytes(map(back.get, token)) if all(c in back for c in token) else token.encode()

    def words(self, text: str) -> list[str]:
        return self._words(text) if _UNUSUAL(text) else _PLAIN_WORDS(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.lexicon.ids([self.words(t) for t in texts])


class PieceTokens:
    """A sentencepiece model: new words go through its library, each beginning with the blank that this puts in front."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = Pieces(path)
        self.library = SentencePieceProcessor(model_file=path)
        self.lexicon = Lexicon(self._learn, KNOWN_WORDS)
        self.bytes = self.model.bytes

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.library.encode([w[1:] for w in words], num_threads=1)
        ids = [own if own and w[0] == SPACE else self.model.ids(w) for w, own in zip(words, ids)]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.lexicon.ids([self.model.words(self.model.marked(t)) for t in texts])


def encode(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """(doc_id, a, b): ids of blank and text by A and of the text by B, packed as unit() says.

    Null and empty texts, and those whose tokens don't join to blank and text, have none. A gives back every byte, B
    all but U+2581, which it turns into a blank, two bytes less: so the lengths tell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = ByteTokens(a_path), PieceTokens(b_path)
        sizes = [np.array([len(x) for x in t.bytes], np.int64) for t in (one, two)]
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sides = [one.encode([" " + x if x else "" for x in texts]), two.encode(texts)]
            want = np.array([1 + (len(x) if x.isascii() else len(x.encode())) if x else -1 for x in texts])
            whole = want >= 0
            for size, (ids, at) in zip(sizes, sides):
                whole &= np.diff(np.append(0, np.cumsum(size[ids]))[at]) == want
            yield pa.RecordBatch.from_arrays([batch.column(0), *(packed(ids, at, whole, unit(len(size))) for size, (ids, at) in zip(sizes, sides))], ["doc_id", "a", "b"])

    return docs.select("doc_id", docs[text].alias("text")).mapInArrow(run, "doc_id long, a binary, b binary")


def unit(vocabulary: int) -> np.dtype:
    """Little-endian unsigned integers of the size that a vocabulary's ids need."""
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def packed(ids: np.ndarray, at: np.ndarray, whole: np.ndarray, kind: np.dtype) -> pa.Array:
    data, n = ids.astype(kind).tobytes(), kind.itemsize
    return pa.array([data[n * s : n * e] if w else b"" for w, s, e in zip(whole.tolist(), at[:-1].tolist(), at[1:].tolist())], pa.binary())


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the ids of each, in column a, take about PORTION_BYTES."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index("a"))).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PORTION_BYTES, side="right")))
            yield batch.slice(start, end - start)
            start = end


def ragged(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and row offsets of a column of packed ids."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    flat = np.frombuffer(body, np.uint8)[at[0] : at[-1]].view(kind) if body is not None else np.zeros(0, kind)
    return flat.astype(np.int64), (at.astype(np.int64) - at[0]) // kind.itemsize


@dataclass
class Aligned:
    """The tokens of some documents and their links, in byte order; ends are byte offsets over all of them."""

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray  # row offsets of a
    b_at: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    pairs: np.ndarray  # a * width + b of each link
    link_at: np.ndarray  # row offsets of links
    group_ends: np.ndarray


def align(batch: pa.RecordBatch, a_size: np.ndarray, b_size: np.ndarray) -> Aligned:
    """Two tokens overlap where some stretch between neighbouring ends lies in both; each stretch is one link.

    Ends are marks on a line of bytes, so one sweep over the line finds the stretches and numbers the tokens at each.
    """
    (a, a_at), (b, b_at) = (ragged(batch.column(batch.schema.get_field_index(c)), unit(len(size))) for c, size in (("a", a_size), ("b", b_size)))
    a_ends, b_ends = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    line = np.zeros((2, (int(a_ends[-1]) if len(a_ends) else 0) + 1), bool)
    line[0, a_ends], line[1, b_ends] = True, True
    ends = np.flatnonzero(line[0] | line[1])
    in_a, in_b = line[0, ends], line[1, ends]
    pairs = a[np.cumsum(in_a) - in_a] * len(b_size) + b[np.cumsum(in_b) - in_b]
    link_at = np.searchsorted(ends, np.append(0, a_ends)[a_at], side="right")
    return Aligned(a, b, a_at, b_at, a_ends, b_ends, pairs, link_at, ends[in_a & in_b])


def group_digests(x: Aligned, names: list[str], n_a: int) -> list[str]:
    """Per row the digest of its groups, a1,a2|b1;a3|b2,b3; names: each id of A with , and with |, then of B with , and ;."""
    a_group, b_group = np.searchsorted(x.group_ends, x.a_ends), np.searchsorted(x.group_ends, x.b_ends)
    code = np.empty(len(x.a) + len(x.b), np.int64)
    code[np.arange(len(x.a)) + np.searchsorted(b_group, a_group, side="left")] = x.a * 2 + (x.group_ends[a_group] == x.a_ends)
    code[np.arange(len(x.b)) + np.searchsorted(a_group, b_group, side="right")] = (n_a + x.b) * 2 + (x.group_ends[b_group] == x.b_ends)
    at = x.a_at + x.b_at
    texts = ("".join(map(names.__getitem__, code[s:e].tolist()))[:-1] for s, e in zip(at[:-1], at[1:]))
    return [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]


# ---------------------------------------------------------------- minimal perfect hashing


def level_places(keys: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    return (mix(keys.astype(np.uint64) * np.uint64(2) + mix(np.array([level + 1], np.uint64))) % np.asarray(size).astype(np.uint64)).astype(np.int64)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def perfect(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, their bits, and the keys in slot order: a key's slot is the number of bits set before its own."""
    sizes, bits, placed, rest = [], [], [], keys
    while len(rest):
        size = max(16, 2 * len(rest))
        at = level_places(rest, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        placed.append(rest[mine][np.argsort(at[mine])])
        sizes.append(size)
        bits.append(alone)
        rest = rest[~mine]
    return sizes, np.concatenate(bits), np.concatenate(placed)


def build(pairs: DataFrame, n: int) -> DataFrame:
    """(bucket, n, levels, bits, keys) of distinct pairs: one perfect hash for each of n buckets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.sort(pdf["pair"].to_numpy())
        sizes, bits, placed = perfect(keys)
        return pd.DataFrame([(int(pdf["bucket"].iloc[0]), len(keys), sizes, np.packbits(bits).tobytes(), placed.tobytes())], columns=["bucket", "n", "levels", "bits", "keys"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(b.column(0).to_numpy(), n)), b.column(0)], ["bucket", "pair"])

    return pairs.mapInArrow(place, "bucket long, pair long").groupBy("bucket").applyInPandas(run, "bucket long, n long, levels array<int>, bits binary, keys binary")


class Slots:
    """The perfect hashes of some buckets as one: slots(pairs) are 0..n-1 for known pairs, -1 for all others."""

    def __init__(self, rows: list, n_buckets: int):
        rows = sorted(rows, key=lambda r: r["bucket"])
        self.buckets, self.n_buckets = np.array([r["bucket"] for r in rows], np.int64), n_buckets
        self.sizes = np.zeros((max(len(r["levels"]) for r in rows), len(rows)), np.int64)
        for i, r in enumerate(rows):
            self.sizes[: len(r["levels"]), i] = r["levels"]
        total = self.sizes.sum(0)
        self.bases = np.cumsum(self.sizes, 0) - self.sizes + (np.cumsum(total) - total)
        self.bits = np.concatenate([np.unpackbits(np.frombuffer(r["bits"], np.uint8))[:t] for r, t in zip(rows, total)]).astype(bool)
        self.keys = np.concatenate([np.frombuffer(r["keys"], np.int64) for r in rows])
        self.first = np.append(0, np.cumsum([r["n"] for r in rows])).astype(np.int64)  # slots of each bucket
        self.rank = np.cumsum(self.bits, dtype=np.int32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "rank"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.rank = np.cumsum(self.bits, dtype=np.int32)

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        bucket = bucket_of(pairs, self.n_buckets)
        own = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
        slot, open_ = np.full(len(pairs), -1, np.int64), np.flatnonzero(self.buckets[own] == bucket)
        for level in range(len(self.sizes)):
            size = self.sizes[level][own[open_]]
            open_, size = open_[size > 0], size[size > 0]
            at = self.bases[level][own[open_]] + level_places(pairs[open_], level, size)
            hit = self.bits[at]
            slot[open_[hit]] = self.rank[at[hit]] - 1
            open_ = open_[~hit]
        slot[(slot >= 0) & (self.keys[slot] != pairs)] = -1
        return slot


# ---------------------------------------------------------------- counts and lookups


def distinct_pairs(ids: DataFrame, a_size: np.ndarray, b_size: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            yield pa.RecordBatch.from_arrays([pa.array(pd.unique(align(batch, a_size, b_size).pairs), pa.int64())], ["pair"])

    return ids.select("a", "b").mapInArrow(run, "pair long").distinct()


def count_vectors(ids: DataFrame, shared, n_tasks: int, a_size: np.ndarray, b_size: np.ndarray) -> DataFrame:
    """(bucket, counts): how many links hold the pair of each slot, one dense vector for a bucket.

    Every task adds up one vector over all slots and hands it on bucket by bucket; FAN_IN of these at a time are summed
    until one is left. A task reads several times the bytes of its vector, so the vectors stay below the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        vector = np.zeros(len(slots.keys), np.int64)
        for batch in portions(batches):
            place, pairs = pd.factorize(align(batch, a_size, b_size).pairs)
            slot, n = slots(pairs), np.bincount(place, minlength=len(pairs))
            vector[slot[slot >= 0]] += n[slot >= 0]
        task = TaskContext.get().partitionId()
        for i, bucket in enumerate(slots.buckets.tolist()):
            part = vector[slots.first[i] : slots.first[i + 1]]
            if part.any():
                yield pa.RecordBatch.from_pydict({"bucket": [bucket], "task": [task], "counts": [part.tobytes()]}, pa.schema([("bucket", pa.int64()), ("task", pa.int32()), ("counts", pa.binary())]))

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = sum(np.frombuffer(c, np.int64) for c in pdf["counts"])
        return pd.DataFrame([(pdf["bucket"].iloc[0], pdf["task"].iloc[0] // FAN_IN, vectors.tobytes())], columns=["bucket", "task", "counts"])

    out = ids.select("a", "b").coalesce(n_tasks).mapInArrow(run, "bucket long, task int, counts binary")
    while n_tasks > 1:
        out = out.groupBy("bucket", F.expr(f"task div {FAN_IN}").alias("under")).applyInPandas(total, "bucket long, task int, counts binary")
        n_tasks = -(-n_tasks // FAN_IN)
    return out.select("bucket", "counts")


def align_documents(docs: DataFrame, a_path: str, b_path: str, text: str = "text", at_once: int = AT_ONCE, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those that either tokenizer doesn't give back, have no tokens: zeros and an empty digest.
    Repeated rows give repeated results and count as often as they stand there; other columns are ignored.

    Up to at_once pairs are counted and looked up in one pass over the ids, and their hash is broadcast, 50 MB at most;
    more pairs take a pass each. Ids of both vocabularies bound the pairs and so the passes.
    """
    spark = docs.sparkSession
    one, two = ByteTokens(a_path), PieceTokens(b_path)
    a_size, b_size = (np.array([len(x) for x in t.bytes], np.int64) for t in (one, two))
    n_a = len(a_size)
    names = [f"{i}{end}" for n, ends in ((n_a, ",|"), (len(b_size), ",;")) for i in range(n) for end in ends]
    named = spark.sparkContext.broadcast(names)
    ids = stage(encode(docs, a_path, b_path, text).withColumn("row", F.monotonically_increasing_id()))
    pairs = stage(distinct_pairs(ids, a_size, b_size))
    n = pairs.count()
    if n == 0:
        zeros = [F.lit(0).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
        return ids.select("doc_id", *zeros, F.lit("").alias("groups_sha256"))
    n_buckets = -(-n // bucket_pairs)
    hashes = stage(build(pairs, n_buckets))
    per = max(1, at_once // bucket_pairs)
    size = ids.agg(F.sum(F.octet_length("a") + F.octet_length("b"))).first()[0]
    n_tasks = max(1, min(ids.rdd.getNumPartitions(), size // (4 * 8 * min(n, at_once))))
    groups = []
    for low in range(0, n_buckets, per):
        rows = hashes.filter(F.col("bucket").between(low, low + per - 1)).collect()  # at most at_once pairs
        if not rows:
            continue
        slots = Slots(rows, n_buckets)
        shared = spark.sparkContext.broadcast(slots)
        counted = stage(count_vectors(ids, shared, n_tasks, a_size, b_size))
        shared.unpersist()
        groups.append((low, counted))
    best = {}
    width = len(b_size)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                b = np.frombuffer(keys, np.int64) % width
                most = np.zeros(width, np.int64)
                np.maximum.at(most, b, np.frombuffer(counts, np.int64))
                known = np.flatnonzero(most)
                yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(most[known])], ["b", "n"])

    all_counts = groups[0][1]
    for _, counted in groups[1:]:
        all_counts = all_counts.unionByName(counted)
    per_b = hashes.join(all_counts, "bucket").select("keys", "counts").mapInArrow(tops, "b long, n long").groupBy("b").agg(F.max("n").alias("n"))
    best = np.zeros(width, np.int64)
    for r in per_b.collect():  # one row for each id of B at most
        best[r["b"]] = r["n"]
    parts = []
    for k, (low, counted) in enumerate(groups):
        slots = Slots(hashes.filter(F.col("bucket").between(low, low + per - 1)).collect(), n_buckets)
        vector = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(counted.collect(), key=lambda r: r["bucket"])])
        shared = spark.sparkContext.broadcast((slots, vector, best))
        parts.append(look_up(ids, shared, named, a_size, b_size, k == 0))
    if len(parts) == 1:
        return parts[0].drop("row")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    facts = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    out = out.groupBy("row").agg(*[F.max(c).alias(c) for c in facts], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select(*facts[:-1], "n_best", "count_sum", "groups_sha256")


def look_up(ids: DataFrame, shared, named, a_size: np.ndarray, b_size: np.ndarray, digests: bool) -> DataFrame:
    """The second pass: every row aligned again, with the counts of those of its pairs that have a slot here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (slots, vector, best), n_a, width = shared.value, len(a_size), len(b_size)
        for batch in portions(batches):
            x = align(batch, a_size, b_size)
            place, pairs = pd.factorize(x.pairs)
            slot = slots(pairs)
            n = np.where(slot >= 0, vector[slot], 0)
            top = (slot >= 0) & (n == best[pairs % width])
            at = x.link_at
            sums = lambda v: np.diff(np.append(0, np.cumsum(v))[at])  # noqa: B023, E731
            row_ends = np.append(0, x.a_ends)[x.a_at]
            n_groups = np.diff(np.searchsorted(x.group_ends, row_ends, side="right"))
            own = group_digests(x, named.value, n_a) if digests else [None] * batch.num_rows
            columns = [np.diff(x.a_at), np.diff(x.b_at), n_groups, np.diff(at), sums(top[place].astype(np.int64)), sums(n[place])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), *(pa.array(c, pa.int64()) for c in columns), pa.array(own, pa.string())], FOUND_NAMES)

    return ids.select("doc_id", "a", "b", "row").mapInArrow(run, FOUND)


FOUND = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
