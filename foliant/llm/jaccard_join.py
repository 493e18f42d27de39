"""N-gram Jaccard join by multiple-global-order filtering.

Two sets of Jaccard similarity t or more share a shingle among the first |x| - ceil(t |x|) + 1 shingles of each, under
any global order. Orders here put common shingles last (counts gathered from all documents) and the rest by different
hashes. Steps, each a Spark job over rows that stay bounded:

1. One pass gives each document its set's size, a 128-bit signature, the prefix under the first order, and small
   bit vectors: of the prefixes under two more orders and of the whole set's parity. Equal sets become one.
2. Prefix shingles are grouped; a shingle of many documents is dealt out as pairs of blocks. Inside each block pairs
   survive that fit in size, share prefix bits under every other order and whose parity vectors allow the overlap.
   What leaves is a forest of the surviving pairs, not the pairs.
3. Connected candidates meet, again in blocks of bounded size, with their whole sets; survivors of all filters are
   counted exactly by matrix products, and a forest of the true links gives the components.

No filter loses a link: each is a necessary condition of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, documents, mix, shingles, slices, stage, text_buffers, word_hashes

LOCAL_COMMON, LOCAL_SHINGLES = 8, 1 << 19  # a shingle of so many of the documents that hold so many shingles is reported as common
COMMON_LIMIT = 200_000  # most common shingles that the order knows: a broadcast of 3 MB
BLOCK_DOCS = 512
BLOCK_SHINGLES = 1 << 18
MAP_BITS, MAP_PART = 1 << 27, 1 << 15  # most bits of a map of keys, a broadcast of 16 MB, and those of a row of it
_SALTS = [np.uint64(0), np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)]
BITS = 4  # words of 64 bits of each prefix vector


def row_sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index("text")))
    h, at = shingles(*word_hashes(data, offsets), k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield np.unique(h[a:b])


def common_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of common shingles, the rarest first. Every document is counted; groups of slices report what is common in them.

    Any such list is a valid order. The COMMON_LIMIT most frequent are kept, so the broadcast has a fixed bound.
    """

    def report(sets: list[np.ndarray]) -> pa.RecordBatch:
        u, n = np.unique(np.concatenate(sets), return_counts=True)
        keep = n >= LOCAL_COMMON
        return pa.RecordBatch.from_arrays([pa.array(u[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], ["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            for s in row_sets(batch, k):
                held.append(s)
                size += len(s)
                if size >= LOCAL_SHINGLES:
                    yield report(held)
                    held, size = [], 0
        if held:
            yield report(held)

    counted = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "h").limit(COMMON_LIMIT).collect()
    return np.array([r["h"] for r in reversed(top)], np.int64).view(np.uint64)


class Order:
    """Rank of shingles: unknown ones by a salted hash, then the common ones from rare to frequent."""

    def __init__(self, common: np.ndarray):
        by_hash = np.argsort(common)
        self.common, self.rank = common[by_hash], by_hash.astype(np.uint64)

    def prefix(self, s: np.ndarray, n: int, salt: np.uint64) -> np.ndarray:
        """The first n shingles of s under the order of salt."""
        key = mix(s ^ salt) >> np.uint64(1)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, s), len(self.common) - 1)
            hot = self.common[at] == s
            key[hot] = np.uint64(1 << 63) + self.rank[at[hot]]
        if n >= len(s):
            return s
        return s[np.argpartition(key, n - 1)[:n]]


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def prefix_bits(prefix: np.ndarray) -> np.ndarray:
    out = np.zeros(64 * BITS, np.uint8)
    out[(prefix % np.uint64(64 * BITS)).astype(np.int64)] = 1
    return np.packbits(out)


def parity_bits(s: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each cell; the cells are a power of two, as many as shingles or 256."""
    m = 1 << max(8, (len(s) - 1).bit_length())
    return np.packbits((np.bincount((mix(s) % np.uint64(m)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little")


def folded(bits: bytes, width: int) -> bytes:
    """The parity vector over half the cells where bits is twice as wide."""
    if len(bits) == width:
        return bits
    x = np.frombuffer(bits, np.uint8)
    return (x[:width] ^ x[width:]).tobytes()


SUMMARY = "doc_id long, row binary, n long, sig binary, prefix binary, other binary, parity binary"


def row_key(text: str = "text") -> Column:
    """A digest of doc_id and text: equal for repeated rows only."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))))


def summaries(rows: DataFrame, k: int, percent: int, common: np.ndarray) -> DataFrame:
    spread = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(spread.value)
        for batch in slices(batches):
            sizes, sigs, firsts, others, parities = [], [], [], [], []
            for s in row_sets(batch, k):
                n = len(s)
                sizes.append(n)
                sigs.append(np.array([mix(s ^ _SALTS[1]).sum(), mix(s ^ _SALTS[2]).sum()], np.uint64).tobytes() if n else None)
                p = prefix_length(n, percent)
                firsts.append(order.prefix(s, p, _SALTS[0]).tobytes() if n else None)
                others.append(b"".join(prefix_bits(order.prefix(s, p, salt)).tobytes() for salt in _SALTS[1:]) if n else None)
                parities.append(parity_bits(s).tobytes() if n else None)
            arrays = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (sigs, firsts, others, parities))]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SUMMARY.split(", ")])

    return rows.mapInArrow(run, SUMMARY)


# ---------------------------------------------------------------- pairs inside a block


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forest(left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges that connect what the pairs (left, right) connect, n - 1 at most."""
    parent, out = list(range(n)), []
    for a, b in zip(left.tolist(), right.tolist()):
        x, y = _find(parent, a), _find(parent, b)
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


def plausible(n: np.ndarray, other: np.ndarray, parities: list[bytes], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the index pairs that pass the size, prefix and parity filters, of the most similar pairs.

    Sets that can link have parity vectors of one width or of neighbouring widths; the wider one is folded. Rows are
    compared in strips, so memory is bounded by the square of a block.
    """
    m = len(n)
    near = np.zeros((m, m), np.float32)  # bound of the similarity of a pair, 0 where it can't link
    widths, half = np.array([len(p) for p in parities]), other.shape[1] // 2
    for width in np.unique(widths).tolist():
        at = np.flatnonzero((widths == width) | (widths == 2 * width))
        own, size, bits = widths[at] == width, n[at], other[at]
        parity = _matrix([folded(parities[i], width) for i in at])
        strip = max(1, (1 << 19) // (len(at) * (parity.shape[1] + bits.shape[1])))
        for a in range(0, len(at), strip):
            i = slice(a, a + strip)
            x, y = size[i, None], size[None, :]
            ok = (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (own[i, None] | own)
            both = bits[i, None, :] & bits[None, :, :]
            ok &= both[..., :half].any(axis=2) & both[..., half:].any(axis=2)
            # |x & y| <= (|x| + |y| - differing parities) / 2, and the link needs (100 + p) |x & y| >= p (|x| + |y|).
            differ = np.bitwise_count(parity[i, None, :] ^ parity[None, :, :]).sum(axis=2, dtype=np.int64)
            most = x + y - differ
            ok &= (100 + percent) * most >= 2 * percent * (x + y)
            r, c = np.nonzero(ok)
            near[at[r + a], at[c]] = (most / (2 * (x + y) - most))[r, c]
    np.fill_diagonal(near, 0)
    return spanning(near)


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the largest weights of a symmetric matrix (0: no edge), by Prim's rule."""
    m = len(near)
    best, origin, left = np.zeros(m, np.float32), np.full(m, -1), np.ones(m, bool)
    out = []
    for _ in range(m):
        i = int(np.where(left, best, -1).argmax())
        left[i] = False
        if best[i] > 0:
            out.append((int(origin[i]), i))
        nearer = near[i] > best
        best[nearer] = near[i][nearer]
        origin[nearer] = i
    return out


def linked(sets: list[np.ndarray], percent: int, order: Order) -> list[tuple[int, int]]:
    """A forest of the pairs with 100 |x & y| >= percent |x | y|, exactly, by products of membership matrices."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(m), n)
    u, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    ok = (100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n)) & (np.arange(m)[:, None] < np.arange(m))
    if m > 2:  # pairs must also share prefix shingles under every other order
        for salt in _SALTS[1:]:
            picked = [order.prefix(s, prefix_length(len(s), percent), salt) for s in sets]
            ok &= _overlap(np.searchsorted(u, np.concatenate(picked)), np.repeat(np.arange(m), list(map(len, picked))), m, count) > 0
    if not ok.any():
        return []
    shared = count[column] > 1
    both = _overlap(column[shared], row[shared], m, count)
    ok &= (100 + percent) * both >= percent * (n[:, None] + n)
    return forest(*np.nonzero(ok), m)


def _overlap(column: np.ndarray, row: np.ndarray, m: int, count: np.ndarray, width: int = 2048) -> np.ndarray:
    """Pairwise numbers of common columns; the columns are taken width at a time."""
    total = np.zeros((m, m), np.int64)
    _, column = np.unique(column, return_inverse=True)
    by = np.argsort(column, kind="stable")
    column, row = column[by], row[by]
    top = int(column[-1]) + 1 if len(column) else 0
    edges = np.searchsorted(column, np.arange(0, top + width, width))
    for c, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if a < b:
            part = np.zeros((m, min(width, top - c * width)), np.float32)
            part[row[a:b], column[a:b] - c * width] = 1
            total += np.rint(part @ part.T).astype(np.int64)
    return total


def _matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint64).reshape(len(values), -1)


EDGES = "u long, v long"


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    left, right = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])


def in_blocks(df: DataFrame, key: str, member: Column, blocks: Column, rows: list[str]) -> DataFrame:
    """Groups (key, lo, hi) with the members of two blocks of a key, as arrays; together they hold every pair of a key.

    A key of one block is one group. blocks must be the same for all rows of a key.
    """
    b = F.pmod(F.xxhash64(member), blocks)
    dealt = df.withColumn("_b", b).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return _gathered(dealt, key, rows)


def _gathered(dealt: DataFrame, key: str, rows: list[str]) -> DataFrame:
    met = dealt.groupBy(key, F.least("_b", "_o").alias("lo"), F.greatest("_b", "_o").alias("hi"))
    return met.agg(F.collect_list(F.struct(*rows)).alias("rows")).filter(F.size("rows") > 1)


def candidate_edges(reps: DataFrame, percent: int) -> DataFrame:
    """A forest of the candidate pairs of step 2; reps holds one row per distinct set."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            if prefixes:
                n = list(map(len, prefixes))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefixes)), pa.array(np.repeat(batch.column(0).to_numpy(), n))], ["h", "node"])

    postings = reps.select("node", "prefix").mapInArrow(explode, "h long, node long")
    often = postings.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    shared = postings.join(often, "h")
    blocks = F.ceil(F.col("df") / BLOCK_DOCS)
    groups = in_blocks(shared, "h", F.col("node"), blocks, ["node"])
    # Near copies share many shingles: equal groups of documents are looked at once.
    groups = groups.select(F.array_sort(F.col("rows.node")).alias("ids")).dropDuplicates(["ids"])
    groups = groups.withColumn("g", F.xxhash64("ids"))
    rows = groups.select("g", F.explode("ids").alias("node")).join(reps.select("node", "n", "other", "parity"), "node")
    met = rows.groupBy("g").agg(F.collect_list(F.struct("node", "n", "other", "parity")).alias("rows"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0)
            node, n, other, parity = (groups.flatten().field(i) for i in range(4))
            ids, sizes, bits = node.to_numpy(), n.to_numpy(), _matrix(other.to_pylist())
            at = groups.offsets.to_numpy() - groups.offsets[0].as_py()
            first, pair = at[:-1], np.diff(at) == 2
            # Most groups are pairs: those that fail a filter leave all at once.
            x, y = first[pair], first[pair] + 1
            both = (bits[x] & bits[y]).reshape(len(x), 2, BITS).any(axis=2).all(axis=1)
            go = ~pair
            go[pair] = both & (100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y]))
            for a, b in zip(first[go].tolist(), at[1:][go].tolist()):
                found = plausible(sizes[a:b], bits[a:b], parity[a:b].to_pylist(), percent)
                if found:
                    yield _edges([(ids[a + i], ids[a + j]) for i, j in found])

    return met.select("rows").mapInArrow(check, EDGES)


def likely(rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """rows less most of those whose key kept lacks, so that an exact join moves few others; every row whose key kept has stays.

    A bit of a map that is broadcast stands for each key of kept: 64 bits or more for a key up to two million keys. Beyond
    that the map stays at MAP_BITS and more other rows stay, which costs their move only.
    """
    bits = min(MAP_BITS, max(MAP_PART, 1 << (64 * kept.count()).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits).cast("long"))
    part, bit = F.floor(place / MAP_PART), place % MAP_PART
    held = kept.select(part.alias("_part"), bit.alias("_bit")).groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    met = rows.withColumn("_part", part).withColumn("_bit", bit).join(F.broadcast(held), "_part")
    byte = F.conv(F.hex(F.substring("_map", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.filter((F.floor(byte / F.pow(F.lit(2), F.col("_bit") % 8)) % 2) == 1).select(*rows.columns)


def whole_sets(rows: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """node, component and s, the set's sorted hashes, of all placed (node, row, component), from their whole texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = pa.array([s.tobytes() for s in row_sets(batch, k)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), got], ["node", "component", "s"])

    # A merge join at every size: it leaves repeated rows side by side, so that dropping them moves no text again.
    texts = likely(rows.select("row", "text"), placed, "row").join(placed.hint("merge"), "row").dropDuplicates(["row"])
    return texts.select("node", "component", "text").mapInArrow(sets, "node long, component long, s binary")


def links_inside(groups: DataFrame, percent: int, common: np.ndarray) -> DataFrame:
    """A forest of the true links inside each group of rows (node, s)."""
    spread = groups.sparkSession.sparkContext.broadcast(common)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(spread.value)
        for batch in batches:
            for rows in batch.column(0):
                node, s = rows.values.field(0).to_numpy(), rows.values.field(1)
                found = linked([np.frombuffer(x.as_buffer(), np.uint64) for x in s], percent, order)
                if found:
                    yield _edges([(node[a], node[b]) for a, b in found])

    return groups.select("rows").mapInArrow(check, EDGES)


def true_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) that link. Each pair meets its two sets by joins; nothing is gathered."""
    u, v = sets.select(F.col("node").alias("u"), F.col("s").alias("x")), sets.select(F.col("node").alias("v"), F.col("s").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append((100 + percent) * both >= percent * (len(x) + len(y)))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(u, "u").join(v, "v").select("u", "v", "x", "y").mapInArrow(check, EDGES)


def verified_edges(rows: DataFrame, members: DataFrame, candidates: DataFrame, k: int, percent: int, common: np.ndarray) -> DataFrame:
    """A forest of the true links among members (node, row, n, component), from their whole texts.

    A component of one block is compared whole. In a larger one the candidate pairs are verified first: where they
    all link, it is connected. Else what they connect falls into classes, and only the largest class is not compared
    with itself: the sets outside it meet each other and every block of it.
    """
    sizes = members.groupBy("component").agg(F.sum("n").alias("total"), F.count("*").alias("docs"))
    fits = (F.col("total") <= BLOCK_SHINGLES) & (F.col("docs") <= 2 * BLOCK_DOCS)
    placed = stage(members.join(sizes.select("component", (~fits).alias("large")), "component"))
    small = whole_sets(rows, placed.filter("not large").select("node", "row", "component"), k)
    none = F.lit(0).cast("long")
    found = links_inside(_gathered(small.withColumn("_b", none).withColumn("_o", none), "component", ["node", "s"]), percent, common)
    large = placed.filter("large")
    if large.isEmpty():
        return found
    sets = stage(whole_sets(rows, large.select("node", "row", "component"), k).withColumn("n", F.length("s") / 8))
    pairs = candidates.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    sure = stage(true_pairs(pairs.join(sets.select(F.col("node").alias("u")), "u", "left_semi"), sets, percent))
    classes = components(sure).select(F.col("id").alias("node"), F.col("component").alias("class"))
    classed = sets.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    weight = classed.groupBy("component", "class").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
    main = F.max(F.struct("docs", "total", "class"))
    parts = weight.groupBy("component").agg(main.alias("main"), F.sum("docs").alias("docs"), F.sum("total").alias("total")).filter("docs > main.docs")
    blocks = lambda total, docs: F.ceil(F.greatest(total / BLOCK_SHINGLES, docs / BLOCK_DOCS))
    inner = blocks(F.col("main.total"), F.col("main.docs"))
    outer = blocks(F.col("total") - F.col("main.total"), F.col("docs") - F.col("main.docs"))
    open_sets = classed.join(parts.select("component", "main.class", inner.alias("inner"), outer.alias("outer")).withColumnRenamed("class", "main"), "component")
    own = F.col("class") == F.col("main")
    hashed = F.xxhash64("node")
    block = F.when(own, F.pmod(hashed, F.col("inner"))).otherwise(F.col("inner") + F.pmod(hashed, F.col("outer")))
    facing = F.sequence(F.when(own, F.col("inner")).otherwise(none), F.col("inner") + F.col("outer") - 1)
    dealt = open_sets.withColumn("_b", block).withColumn("_o", F.explode(facing))
    rest = links_inside(_gathered(dealt, "component", ["node", "s"]), percent, common)
    return found.unionByName(sure).unionByName(rest)


def linked_rows(docs: DataFrame, k: int, percent: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All rows as (doc_id, row, n, sig), and every distinct set of shingles as (sig, component_id, first).

    component_id is the smallest doc_id of the rows whose sets the set's links reach; first is the row of that doc_id
    (of equal ids the smallest digest), the same in the whole component. Null ids come last.
    """
    rows = docs.select("doc_id", row_key(text).alias("row"), F.col(text).alias("text"))
    common = common_shingles(rows, k)
    all_rows = stage(summaries(rows, k, percent, common))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    same = F.first(F.struct("row", "n", "prefix", "other", "parity")).alias("one")
    reps = all_rows.filter("n > 0").groupBy("sig").agg(same, F.min(rank).alias("head"))
    reps = stage(reps.select("sig", "one.*", "head", F.monotonically_increasing_id().alias("node")))
    candidates = stage(candidate_edges(reps, percent))
    groups = components(candidates)
    members = reps.join(groups.withColumnRenamed("id", "node"), "node").select("node", "row", "n", "component")
    links = verified_edges(rows, members, candidates, k, percent, common)
    found = components(stage(links)).withColumnRenamed("id", "node")
    labelled = reps.select("node", "sig", "head").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = labelled.groupBy("component").agg(F.min("head").alias("head"))
    of = labelled.select("sig", "component").join(heads, "component").select("sig", F.col("head.doc_id").alias("component_id"), F.col("head.row").alias("first"))
    return all_rows.select("doc_id", "row", "n", "sig"), of


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row: the smallest doc_id that links of Jaccard >= percent / 100 reach.

    Rows are the documents: repeated rows and rows of one doc_id with other texts each keep their own set, and rows
    with equal sets link. A null doc_id stays null and takes part; where a component has no other id, its component_id
    is null. Null, empty and blank texts have no shingles and are their own component. An empty table gives no rows.
    """
    rows, of = linked_rows(docs, k, percent, text)
    # Copies hang on their set: one join instead of rounds over all of them.
    out = rows.join(of, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group that links connect: the first row of its smallest doc_id. Texts without words all stay."""
    columns = docs.columns
    _, of = linked_rows(docs.select("doc_id", "text"), k, percent)
    first = of.select(F.col("first").alias("row")).distinct().withColumn("stays", F.lit(True))
    blank = ~F.coalesce("text", F.lit("")).rlike("[^ \\t-\\r]")
    whole = docs.select(F.struct(*columns).alias("whole"), row_key().alias("row"), blank.alias("blank"))
    kept = whole.join(first, "row", "left").filter("blank or stays")
    # Repeated rows of one doc_id have one key: the join has brought them together, so this needs no shuffle of its own.
    kept = kept.withColumn("each", F.when(F.col("blank"), F.monotonically_increasing_id())).dropDuplicates(["row", "each"])
    return kept.select("whole.*")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


_WORDS_SQL = """w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[ \\x09-\\x0D]+'), lambda x: x <> '') AS words, row_number() OVER () AS r FROM documents)"""
OP7_SQL = f"""
WITH RECURSIVE {_WORDS_SQL},
g AS (SELECT r, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0),
s AS (SELECT DISTINCT r, words[i : i + 3] AS shingle FROM g),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS m FROM s a JOIN s b ON a.shingle = b.shingle AND a.r <> b.r GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * p.m >= 85 * (a.n + b.n - p.m)),
c(r, reached) AS (SELECT r, r FROM w UNION SELECT c.r, e.y FROM c JOIN e ON e.x = c.reached),
m AS (SELECT c.r, min(w.doc_id) AS component_id FROM c JOIN w ON w.r = c.reached GROUP BY c.r)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM w JOIN m ON m.r = w.r LEFT JOIN n ON n.r = w.r
"""
