"""Language-model scoring by stupid backoff (Brants et al. 2007), relationally.

Count tables of 1..ORDER-grams are partitioned by hash and joined to the exploded n-grams of the documents, whose log
scores are summed per document. Nothing is broadcast: documents are dealt into slices by doc_id, a slice sends each
distinct n-gram once with its count to the n-gram's hash partition, gets back the counts of the whole corpus for the
n-grams it holds, in the order of their keys and without these, which the slice's own texts give again, and scores its
documents. A frequent n-gram is one entry per slice, so no key is hot. The query is registered with ORDER, uncut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _STEP, SLICE_BYTES, documents, mix, quantiles, shuffle_partitions, slices, text_buffers, word_hashes

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
SLICE_CHARS, WEIGHT_CHARS, PARTITION_WORDS, HELD_WORDS, HELD_BYTES = 16 << 20, 4096, 1 << 21, 1 << 21, 16 << 20


def grams(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the k-grams that end at each word, and which words have one inside their row."""
    n = len(words)
    key = np.zeros(n, np.uint64)
    for j in range(k):
        key[k - 1 :] += words[j : n - k + 1 + j] * _STEP[40 + j] if n >= k else 0
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    return mix(key + np.uint64(k)), place >= k - 1


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def expand(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)


def pack_keys(keys: np.ndarray) -> bytes:
    """Low seven bytes of sorted keys as steps, byte plane by byte plane; the top byte is the partition's."""
    low = keys & np.uint64((1 << 56) - 1)
    return squeeze(np.ascontiguousarray(np.diff(low, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].T).tobytes())


def unpack_keys(blob: bytes, top: int) -> np.ndarray:
    raw = expand(blob)
    n = len(raw) // 7
    out = np.zeros((n, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(7, n).T
    return np.cumsum(out.reshape(-1).view("<u8"), dtype=np.uint64) | np.uint64(top << 56)


def pack_counts(counts: np.ndarray) -> bytes:
    return squeeze(np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_counts(blob: bytes) -> np.ndarray:
    raw = expand(blob)
    n = len(raw) // 8
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).reshape(-1).view("<u8").astype(np.int64)


TABLE = "slice int, gram int, part long, keys binary, counts binary"


def slices_of_rows(batch: pa.RecordBatch, cuts: np.ndarray) -> np.ndarray:
    """The slice of each row (doc_id, dealt): how many of the cuts lie below its doc_id; dealt where it has none."""
    ids = batch.column(0)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    at = np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int32)
    return np.where(known, at, batch.column(1).to_numpy())


def slice_counts(docs: DataFrame, cuts: Broadcast, order: int, bits: int) -> DataFrame:
    """Distinct n-grams of the rows (doc_id, dealt, text) of each slice with counts, one row per hash partition of 2**bits."""

    def table(grams_of: dict[int, list[np.ndarray]], slices_of: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
        rows = []
        for k in list(grams_of):
            key, own = np.concatenate(grams_of.pop(k)), np.concatenate(slices_of.pop(k))
            by = np.argsort(own, kind="stable")
            key, own = key[by], own[by]
            edges = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own)) if len(own) else []
            for a, b in zip(edges[:-1], edges[1:]):
                u, n = np.unique(key[a:b], return_counts=True)
                part = u >> np.uint64(64 - bits)
                cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(u))
                rows += [(int(own[a]), k, int(part[x]), pack_keys(u[x:y]), pack_counts(n[x:y])) for x, y in zip(cuts[:-1], cuts[1:])]
        columns = list(zip(*rows)) or [()] * 5
        types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["slice", "gram", "part", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, held = {}, {}, 0
        for batch in slices(batches):
            words, at = word_hashes(*text_buffers(batch.column(2)))
            own = np.repeat(slices_of_rows(batch, cuts.value), np.diff(at))
            for k in range(1, order + 1):
                key, ok = grams(words, at, k)
                keys.setdefault(k, []).append(key[ok])
                owners.setdefault(k, []).append(own[ok])
            held += len(words)
            if held >= HELD_WORDS:  # a repeated n-gram is sent once for so many words
                yield table(keys, owners)
                held = 0
        if held:
            yield table(keys, owners)

    return docs.mapInArrow(run, TABLE)


def corpus_counts(counted: DataFrame, bits: int, min_count: int) -> DataFrame:
    """For each slice and partition, the counts over all slices of the slice's n-grams in the order of their keys.
    2-grams and longer ones under min_count count 0, as in a count table with a cut-off."""

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        k, part = int(pdf["gram"].iloc[0]), int(pdf["part"].iloc[0])
        top = part >> (bits - 8)
        keys = [unpack_keys(r, top) for r in pdf["keys"]]
        u, place = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(place, np.concatenate([unpack_counts(r) for r in pdf["counts"]])).astype(np.int64)
        if k > 1:
            n[n < min_count] = 0
        ends = np.cumsum([len(x) for x in keys])
        rows = []
        of = pdf["slice"].to_numpy()
        for s in np.unique(of).tolist():
            mine = np.unique(np.concatenate([place[e - len(x) : e] for x, e, o in zip(keys, ends, of) if o == s]))
            rows.append((s, k, part, pack_counts(n[mine])))
        return pd.DataFrame(rows, columns=["slice", "gram", "part", "counts"])

    return counted.groupBy("gram", "part").applyInPandas(total, TABLE.replace("keys binary, ", ""))


def score_words(words: np.ndarray, at: np.ndarray, tables: dict[int, np.ndarray], order: int, alpha: float, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, summed natural-log scores and backed-off words of each text of a slice; tables: counts by order of keys."""
    n = len(words)
    counts = {}
    for k in range(1, order + 1):
        key, ok = grams(words, at, k)
        u, place = np.unique(key[ok], return_inverse=True)
        own = tables.pop(k, np.zeros(0, np.int64))
        if len(own) != len(u):
            raise RuntimeError(f"{len(own)} counts for {len(u)} {k}-grams of a slice")
        counts[k] = np.zeros(n, np.int64)
        counts[k][ok] = own[place]
        del key, u, place
    score = np.log(counts[1] / max(total, 1))
    open_words = np.ones(n, bool)
    steps = np.zeros(n, np.int64)
    place = np.arange(n) - np.repeat(at[:-1], np.diff(at))
    for k in range(order, 1, -1):
        possible = open_words & (place >= k - 1)
        context = np.append(0, counts[k - 1][:-1]) if n else counts[k - 1]
        hit = possible & (counts[k] > 0) & (context > 0)
        score[hit] = np.log(counts[k][hit] / context[hit])
        open_words &= ~hit
        steps += possible & ~hit
    # A word backs off once for each order that it could have and missed before a hit.
    score += steps * np.log(alpha)
    missed = np.concatenate([[0], np.cumsum(steps > 0)])
    per_doc = np.array([score[a:b].sum() for a, b in zip(at[:-1], at[1:])])
    return np.diff(at), per_doc, missed[at[1:]] - missed[at[:-1]]


PACKED = "slice int, ids binary, known binary, sizes binary, texts binary"


def packed_texts(docs: DataFrame, cuts: Broadcast) -> DataFrame:
    """Rows (doc_id, dealt, text) as one compressed block for each slice of about HELD_BYTES of text."""

    def blocks(held: dict[int, list[tuple[int, bytes]]]) -> pa.RecordBatch:
        columns = [], [], [], [], []
        for s, rows in held.items():
            ids, texts = zip(*rows)
            known = np.array([d is not None for d in ids])
            lengths = np.array([len(x) for x in texts], np.int64)
            row = s, np.array([d or 0 for d in ids], np.int64).tobytes(), known.tobytes(), lengths.tobytes(), squeeze(b"".join(texts))
            for c, x in zip(columns, row):
                c.append(x)
        arrays = [pa.array(c, pa.binary() if i else pa.int32()) for i, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in slices(batches):
            for s, d, t in zip(slices_of_rows(batch, cuts.value).tolist(), batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                raw = t.encode()
                held.setdefault(s, []).append((d, raw))
                size += len(raw)
            if size >= HELD_BYTES:
                yield blocks(held)
                held, size = {}, 0
        if held:
            yield blocks(held)

    return docs.mapInArrow(run, PACKED)


def block_words(sizes: bytes, texts: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words of a block and the number of words of each text, a few MB of text at a time."""
    ends = np.append(0, np.cumsum(np.frombuffer(sizes, np.int64)))
    data = np.frombuffer(expand(texts), np.uint8)
    a = 0
    while a < len(ends) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE_BYTES, side="right")) - 1)
        words, at = word_hashes(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
        yield words, np.diff(at)
        a = b


RESULT = "doc_id long, n_words long, log_score double, n_backoff long"


def backoff_scores(docs: DataFrame, order: int = 2, alpha: float = ALPHA, min_count: int = MIN_COUNT, text: str = "text") -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logs), n_backoff, mean_log_score for every row.

    S(w | context) = count(context w) / count(context) if the n-gram was counted min_count times, else
    alpha * S(w | shorter context); at the end count(w) / words. Counts are of all rows. Null, empty and blank texts
    have no words, a sum of 0 and a null mean. Repeated rows and rows without doc_id are counted and scored each.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(docs[text], F.lit("")).alias("text"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_buffers(batch.column(0))
            n = len(word_hashes(data, offsets)[0])
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([len(data)], pa.int64())], ["w", "c"])

    seen = rows.select("text").mapInArrow(sizes, "w long, c long").agg(F.sum("w").alias("w"), F.sum("c").alias("c")).first()
    total, chars = seen["w"] or 0, seen["c"] or 0
    n_slices = max(shuffle_partitions(spark), -(-chars // SLICE_CHARS))
    bits = max(8, (total // PARTITION_WORDS).bit_length())
    # Slices are ranges of doc_id of about equal size: a row weighs by its length. Rows without id are dealt by text.
    weighted = rows.select("doc_id", F.explode(F.sequence(F.lit(0), (F.length("text") / WEIGHT_CHARS).cast("int")))).select("doc_id")
    cuts = spark.sparkContext.broadcast(np.array(quantiles(weighted, n_slices), np.int64))
    rows = rows.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(n_slices)).cast("int").alias("dealt"), "text")
    back = corpus_counts(slice_counts(rows, cuts, order, bits), bits, min_count)

    def score(texts: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        tables = {int(k): np.concatenate([unpack_counts(r) for r in own.sort_values("part")["counts"]]) for k, own in table.groupby("gram")}
        parts = [x for block in zip(texts["sizes"], texts["texts"]) for x in block_words(*block)]
        if not parts:
            return pd.DataFrame({"doc_id": [], "n_words": [], "log_score": [], "n_backoff": []})
        words, at = np.concatenate([w for w, _ in parts]), np.append(0, np.cumsum(np.concatenate([m for _, m in parts])))
        n, sums, missed = score_words(words, at, tables, order, alpha, total)
        ids = pd.Series(np.concatenate([np.frombuffer(x, np.int64) for x in texts["ids"]]), dtype="Int64")
        known = np.concatenate([np.frombuffer(x, bool) for x in texts["known"]])
        return pd.DataFrame({"doc_id": ids.where(known, pd.NA), "n_words": n, "log_score": sums, "n_backoff": missed})

    scored = packed_texts(rows, cuts).groupBy("slice").cogroup(back.groupBy("slice")).applyInPandas(score, RESULT)
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by n-grams that stand twice or more: what a document alone holds backs off, as it would for new text.

    Sums to six and means to eight decimals, so that the order of addition does not show.
    """
    out = backoff_scores(documents(spark, sf_dir), ORDER)
    return out.withColumn("log_score", F.round("log_score", 6)).withColumn("mean_log_score", F.round("mean_log_score", 8))


OP1_SQL = f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[ \\x09-\\x0D]+'), lambda x: x <> '') AS words, row_number() OVER () AS r FROM documents),
i AS (SELECT r, words, unnest(range(1, len(words) + 1)) AS p FROM w),
g AS (SELECT r, p, k, words[p - k + 1 : p] AS gram FROM i, range(1, {ORDER + 1}) AS o(k) WHERE k <= p),
c AS (SELECT gram, count(*) AS n FROM g GROUP BY gram),
t AS (SELECT count(*) AS n FROM i),
s AS (SELECT g.r, g.p, g.k, CASE WHEN g.k = 1 THEN ln(c.n / (SELECT n FROM t)) ELSE ln(c.n / b.n) END AS v
 FROM g JOIN c ON g.gram = c.gram LEFT JOIN c AS b ON b.gram = g.gram[:-2] WHERE g.k = 1 OR c.n >= {MIN_COUNT}),
hit AS (SELECT r, p, arg_max(v, k) AS v, least(p, {ORDER}) - max(k) AS steps FROM s GROUP BY r, p),
d AS (SELECT r, count(*) AS n, sum(v + steps * ln({ALPHA})) AS v, count(*) FILTER (steps > 0) AS missed FROM hit GROUP BY r)
SELECT doc_id, coalesce(d.n, 0) AS n_words, round(coalesce(d.v, 0.0), 6) AS log_score, coalesce(d.missed, 0) AS n_backoff, round(d.v / d.n, 8) AS mean_log_score
FROM w LEFT JOIN d ON w.r = d.r
"""
