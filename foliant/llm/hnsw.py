"""Embedding near-dedup by one navigable small-world hierarchy per shard.

Equal vectors become one with a count. Shards are dealt by hash; each gets a layered proximity graph with diverse
neighbours (Malkov and Yashunin 2016), built and searched for many queries at a time with numpy. An audit against
brute force widens the shard's beam until recall holds for groups of every size, or has the shard compared whole. Every vector queries every shard in blocks; a query whose
beam is full of links is searched again with twice the beam. Links are verified in double precision; what leaves a
block is a count per query and a forest of its links, and components are united over all.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, stage
from .jaccard_join import forest

THRESHOLD = 0.9
LINKS, BASE_LINKS, BUILD_BEAM = 16, 32, 48
FIRST_BEAM, RECALL, AUDIT = 24, 0.99, 192
SHARDS, SHARD_ROWS, QUERY_ROWS, SALTS = 8, 250_000, 4096, 4


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Of the candidates of each row (-1: none) at most keep: those nearer to the row than to a chosen one, then the nearest."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    n, width = ids.shape
    out = np.full((n, keep), -1, np.int32)
    for a in range(0, n, 256):
        part, near = ids[a : a + 256], sims[a : a + 256]
        x = vectors[np.maximum(part, 0)]
        gram = x @ x.transpose(0, 2, 1)
        chosen = np.zeros(part.shape, bool)
        blocked = np.full(part.shape, -np.inf, np.float32)
        for c in range(width):
            take = (part[:, c] >= 0) & (near[:, c] > blocked[:, c]) & (chosen.sum(axis=1) < keep)
            chosen[:, c] = take
            blocked = np.where(take[:, None], np.maximum(blocked, gram[:, :, c]), blocked)
        rank = np.where(chosen, 0, np.where(part >= 0, 1, 2)) * width + np.arange(width)
        best = np.argsort(rank, axis=1)[:, :keep]
        out[a : a + 256, : best.shape[1]] = np.take_along_axis(part, best, 1)
    return out


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities of the beam of each query, unsorted, -1 where there are fewer; entry: start ids of each."""
    n_all, size = len(queries), len(vectors)
    out_ids, out_sims = np.full((n_all, beam), -1, np.int32), np.full((n_all, beam), -np.inf, np.float32)
    step = int(max(1, min(512, (1 << 25) // max(size, 1))))
    for a in range(0, n_all, step):
        q = queries[a : a + step]
        n = len(q)
        rows = np.arange(n)
        seen = np.zeros((n, size), bool)
        ids, sims = np.full((n, beam), -1, np.int32), np.full((n, beam), -np.inf, np.float32)
        open_sims = np.full((n, beam), -np.inf, np.float32)
        start = entry[a : a + step, :beam]
        first = np.where(start >= 0, np.einsum("bkd,bd->bk", vectors[np.maximum(start, 0)], q), -np.inf)
        ids[:, : start.shape[1]], sims[:, : start.shape[1]] = start, first
        open_sims[:, : start.shape[1]] = first
        seen[np.repeat(rows, start.shape[1]), np.maximum(start, 0).ravel()] = True
        while True:
            best = open_sims.argmax(axis=1)
            live = np.flatnonzero(open_sims[rows, best] > -np.inf)
            if not len(live):
                break
            slot = best[live]
            open_sims[live, slot] = -np.inf
            near = links[ids[live, slot]]
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            if not len(r):
                continue
            found = near[r, c]
            seen[live[r], found] = True
            value = np.full(near.shape, -np.inf, np.float32)
            value[r, c] = np.einsum("kd,kd->k", vectors[found], q[live[r]])
            useful = value.max(axis=1) > sims[live].min(axis=1)
            live, near, value = live[useful], near[useful], value[useful]
            if not len(live):
                continue
            all_sims = np.concatenate([sims[live], value], axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(value > -np.inf, near, -1)], axis=1), top, 1)
            open_sims[live] = np.take_along_axis(np.concatenate([open_sims[live], value], axis=1), top, 1)
            sims[live] = np.take_along_axis(all_sims, top, 1)
        out_ids[a : a + step], out_sims[a : a + step] = ids, sims
    return out_ids, out_sims


class Hierarchy:
    """Layers from the top: node numbers of the layer and, for each, its links as places in that layer."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]] | None = None, beam: int = FIRST_BEAM):
        self.vectors, self.layers, self.beam = vectors, layers if layers is not None else [], beam
        self.whole = False  # the audit failed at every beam: compare with all vectors
        if layers is None:
            self._build()

    def _build(self) -> None:
        n = len(self.vectors)
        rng = np.random.default_rng(n)
        level = np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int)
        order = np.argsort(-level, kind="stable")  # upper nodes come first in every layer below
        sizes = [int((level >= lv).sum()) for lv in range(int(level.max(initial=0)), -1, -1)] if n else []
        for size in sizes:
            if size >= min(n, 2 * LINKS) or size == n:
                self.layers.append(self._layer(order[:size], BASE_LINKS if size == n else LINKS))

    def _layer(self, nodes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        x = self.vectors[nodes]
        n = len(nodes)
        links = np.full((n, most), -1, np.int32)
        done = 0
        while done < n:
            end = min(n, max(256, done * 2), done + 1024)
            q = x[done:end]
            inner = q @ q.T
            np.fill_diagonal(inner, -np.inf)
            k = min(LINKS * 2, end - done)
            peers = np.argpartition(-inner, k - 1, axis=1)[:, :k]
            peer_sims = np.take_along_axis(inner, peers, 1)
            ids, sims = np.where(peer_sims > -np.inf, peers + done, -1).astype(np.int32), peer_sims
            if done:
                got, value = beam_search(x[:done], links[:done], q, self._entries(q, nodes[:done]), BUILD_BEAM)
                ids, sims = np.concatenate([got, ids], axis=1), np.concatenate([value, sims], axis=1)
            mine = diverse(x, ids, sims, LINKS)
            links[done:end, : mine.shape[1]] = mine
            self._link_back(x, links, mine, done, end)
            done = end
        return nodes, links

    @staticmethod
    def _link_back(x: np.ndarray, links: np.ndarray, mine: np.ndarray, done: int, end: int) -> None:
        source = np.repeat(np.arange(done, end), mine.shape[1])
        target = mine.ravel()
        source, target = source[target >= 0], target[target >= 0]
        sims = np.einsum("kd,kd->k", x[source], x[target])
        by = np.lexsort((-sims, target))
        source, target = source[by], target[by]
        first = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, int)
        place = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
        source, target, place = source[place < 32], target[place < 32], place[place < 32]
        rows, own = np.unique(target, return_inverse=True)
        if not len(rows):
            return
        extra = np.full((len(rows), int(place.max()) + 1), -1, np.int32)
        extra[own, place] = source
        held = links[rows]
        known = (extra[:, :, None] == held[:, None, :]).any(axis=2)
        merged = np.concatenate([held, np.where(known, -1, extra)], axis=1)
        value = np.where(merged >= 0, np.einsum("bkd,bd->bk", x[np.maximum(merged, 0)], x[rows]), -np.inf).astype(np.float32)
        links[rows] = diverse(x, merged, value, links.shape[1])

    def _entries(self, q: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Start places in the next layer for each query: what a descent through the finished layers finds."""
        entry = np.zeros((len(q), 1), np.int32)
        for nodes, links in self.layers:
            ids, sims = beam_search(self.vectors[nodes], links, q, entry, 4)
            # Nodes of a layer lead the layer below in the same order, so places carry over.
            entry = np.where(sims > -np.inf, ids, -1)
            if below is not None:
                entry = np.where(entry < len(below), entry, -1)
            entry[(entry < 0).all(axis=1), 0] = 0
        return entry

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Node numbers and similarities of the beam of each query."""
        top, (nodes, links) = Hierarchy(self.vectors, self.layers[:-1]), self.layers[-1]
        ids, sims = beam_search(self.vectors[nodes], links, q, top._entries(q), min(beam, len(nodes)))
        return np.where(ids >= 0, nodes[np.maximum(ids, 0)], -1), sims

    def within(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all found with similarity of at least least; beams widen where links fill half of them."""
        rows, nodes, todo, beam, n = [], [], np.arange(len(q)), self.beam, len(self.vectors)
        if self.whole:
            step = max(1, (1 << 24) // max(n, 1))
            for a in range(0, len(q), step):
                r, c = np.nonzero(q[a : a + step] @ self.vectors.T >= least)
                rows.append(r + a)
                nodes.append(c)
            todo = todo[:0]
        while len(todo):
            ids, sims = self.search(q[todo], beam)
            hit = sims >= least
            full = (hit.sum(axis=1) > min(beam, n) // 2) & (beam < n)
            r, c = np.nonzero(hit & ~full[:, None])
            rows.append(todo[r])
            nodes.append(ids[r, c])
            todo, beam = todo[full], beam * 2
        return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(nodes or [np.zeros(0, int)])

    def audit(self, least: float) -> float:
        """Recall of links against brute force, for sampled members and for points as far from them as a link may be.

        Each query has its own recall, and the mean is taken over the queries of a class of link counts (1, 2 to 3, 4
        to 7 and so on), so a large group does not hide the small ones; the least of the classes counts. The beam is
        doubled until it holds; where it does not at a beam of the whole shard, as links may not lead everywhere, the
        shard is compared with every query by matrix products.
        """
        n, d = self.vectors.shape
        rng = np.random.default_rng(n + 1)
        some = rng.choice(n, min(n, AUDIT), replace=False)
        noise = rng.standard_normal((len(some), d)).astype(np.float32)
        own = self.vectors[some]
        noise -= np.einsum("bd,bd->b", noise, own)[:, None] * own
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-9)
        away = least + 0.005
        q = np.concatenate([own, away * own + np.sqrt(1 - away * away) * noise]).astype(np.float32)
        link = q @ self.vectors.T >= least + 1e-6  # beyond what rounding decides
        truth = link.sum(axis=1)
        of = np.frexp(np.maximum(truth, 1))[1]
        some = [np.flatnonzero((of == x) & (truth > 0)) for x in np.unique(of)]
        while True:
            r, c = self.within(q, least)
            found = np.bincount(r, link[r, c], minlength=len(q))
            recall = min((float((found[x] / truth[x]).mean()) for x in some if len(x)), default=1.0)
            if recall >= RECALL:
                return recall
            if self.beam >= n:
                self.whole = True
                return 1.0
            self.beam *= 2

    def dump(self) -> bytes:
        out = io.BytesIO()
        arrays = {f"{part}{i}": a for i, layer in enumerate(self.layers) for part, a in zip(("nodes", "links"), layer)}
        np.savez(out, beam=self.beam, whole=self.whole, **arrays)
        return out.getvalue()

    @classmethod
    def load(cls, vectors: np.ndarray, blob: bytes) -> Hierarchy:
        z = np.load(io.BytesIO(blob))
        layers = [(z[f"nodes{i}"], z[f"links{i}"]) for i in range((len(z.files) - 2) // 2)]
        out = cls(vectors, layers, int(z["beam"]))
        out.whole = bool(z["whole"])
        return out


# ---------------------------------------------------------------- Spark


def _rows(values, kind) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def distinct_vectors(table: DataFrame) -> DataFrame:
    """(rep, copies, dim, raw): usable vectors, equal ones as one; raw holds the components' bytes."""
    wide = dict(table.dtypes)["embedding"] == "array<double>"
    kind = np.float64 if wide else np.float32
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    usable = table.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound & some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.asarray(v, kind) + kind(0) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v) for v in raw], pa.int32()), pa.array([v.tobytes() for v in raw], pa.binary())], ["vec_id", "dim", "raw"])

    return usable.mapInArrow(run, "vec_id long, dim int, raw binary")


def near_components(table: DataFrame, threshold: float = THRESHOLD, shards: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every distinct vec_id of (vec_id, embedding).

    Null, empty, zero or non-finite vectors link with nothing; vectors of different lengths don't link. Of repeated
    vec_ids the vector that sorts first counts. shards: SHARDS, or more where a shard would pass SHARD_ROWS rows;
    each vector is searched in every shard.
    """
    kind = np.float64 if dict(table.dtypes)["embedding"] == "array<double>" else np.float32
    vectors = distinct_vectors(table.select("vec_id", "embedding"))
    vectors = stage(vectors.groupBy("vec_id").agg(F.min(F.struct("dim", "raw")).alias("v")).select("vec_id", "v.dim", "v.raw"))
    reps = stage(vectors.groupBy("dim", "raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    n = reps.count()
    shards = shards or max(SHARDS, -(-n // SHARD_ROWS))
    placed = reps.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        graph = Hierarchy(unit(_rows(pdf["raw"], kind)))
        recall = graph.audit(threshold)
        ids = pdf["rep"].to_numpy(np.int64).tobytes()
        return pd.DataFrame({
            "dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "ids": [ids], "copies": [pdf["copies"].to_numpy(np.int64).tobytes()],
            "data": [b"".join(pdf["raw"])], "graph": [graph.dump()], "beam": [graph.beam], "recall": [recall],
        })

    index = "dim int, shard int, ids binary, copies binary, data binary, graph binary, beam int, recall double"
    index = stage(placed.groupBy("dim", "shard").applyInPandas(build, index))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    # An index goes to SALTS tasks, however many queries there are; these stream through in blocks behind it.
    salt = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(SALTS)).cast("int").alias("salt")
    queries = reps.select("dim", every(shards).alias("shard"), salt, "rep", "raw")
    indexed = index.select("dim", "shard", every(SALTS).alias("salt"), F.struct("ids", "copies", "data", "graph").alias("index"))
    both = indexed.unionByName(queries, allowMissingColumns=True).withColumn("rank", F.col("index").isNull())
    dealt = both.repartitionById(shards * SALTS, F.col("shard") * SALTS + F.col("salt")).sortWithinPartitions("dim", "shard", "salt", "rank")

    def search(own: np.ndarray, raw: np.ndarray, index: dict) -> pa.RecordBatch:
        ids, copies, data, graph = (index[x] for x in ("ids", "copies", "data", "graph"))
        q, node = graph.within(unit(raw), threshold - 1e-5)
        q, node = q[own[q] != ids[node]], node[own[q] != ids[node]]
        a, b = raw[q].astype(np.float64), data[node].astype(np.float64)
        cosine = np.einsum("kd,kd->k", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
        q, node = q[cosine >= threshold], node[cosine >= threshold]
        count = np.bincount(q, copies[node], minlength=len(own)).astype(np.int64)
        some = np.flatnonzero(count)
        every_id, place = np.unique(np.concatenate([own[q], ids[node]]), return_inverse=True)
        pairs = forest(place[: len(q)], place[len(q) :], len(every_id))
        left = [*own[some].tolist(), *(int(every_id[x]) for x, _ in pairs)]
        right = [*own[some].tolist(), *(int(every_id[y]) for _, y in pairs)]
        columns = pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array([*count[some].tolist(), *[0] * len(pairs)], pa.int64())
        return pa.RecordBatch.from_arrays(list(columns), ["u", "v", "n"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = index = None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            starts = [i for i in range(batch.num_rows) if not i or any(c[i] != c[i - 1] for c in columns)]
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                now = tuple(c[a] for c in columns)
                if now != key:
                    key, index = now, None
                head = batch.column(3)[a]
                if head.is_valid:
                    row = head.as_py()
                    ids = np.frombuffer(row["ids"], np.int64)
                    data = np.frombuffer(row["data"], kind).reshape(len(ids), -1)
                    index = {"ids": ids, "copies": np.frombuffer(row["copies"], np.int64), "data": data, "graph": Hierarchy.load(unit(data), row["graph"])}
                    a += 1
                if index is not None:  # a shard without vectors of this length has no index
                    for i in range(a, b, QUERY_ROWS):
                        part = batch.slice(i, min(b - i, QUERY_ROWS))
                        yield search(part.column(4).to_numpy(), _rows(part.column(5).to_pylist(), kind), index)

    found = dealt.select("dim", "shard", "salt", "index", "rep", "raw").mapInArrow(stream, "u long, v long, n long")
    found = stage(found)
    counts = found.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    groups = components(found.filter("u <> v").select("u", "v")).withColumnRenamed("id", "rep")
    label = vectors.join(reps, ["dim", "raw"]).join(counts, "rep", "left").join(groups, "rep", "left")
    label = label.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = table.select("vec_id").filter("vec_id is not null").distinct().join(label, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda a: a IS NULL OR NOT isfinite(a))) = 0 AND len(list_filter(x, lambda a: a <> 0)) > 0),
e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
c(vec_id, reached) AS (SELECT vec_id, vec_id FROM v UNION SELECT c.vec_id, e.v FROM c JOIN e ON e.u = c.reached),
m AS (SELECT vec_id, min(reached) AS component_id FROM c GROUP BY vec_id),
n AS (SELECT u, count(*) AS n FROM e GROUP BY u)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, component_id, m.vec_id = component_id AS kept FROM m LEFT JOIN n ON n.u = m.vec_id
"""
