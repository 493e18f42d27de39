"""A Merkle manifest of a dataset: every row gets the proof that ties it to one root.

Rows are leaves of one tree per source, the trees' roots are leaves of one tree above. Leaves of a tree are cut into
aligned blocks of FANOUT ** levels; each block hashes its own leaves. Then blocks exchange as a butterfly: in round r
the FANOUT groups of FANOUT ** r blocks below one ancestor swap their roots, every block with one partner in each other
group, and all of them hash the ancestor. So each block gathers the proof above it on the way up, and nothing has to
be sent down again. A round is one shuffle of one short row for each block and partner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stage

FANOUT = 3
LEVELS = 7  # a block has 2187 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """A value with its length in UTF-8 bytes before it, so that fields can't run into each other; null is a dash."""
    value = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_hash(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def blocks(leaves: DataFrame, levels: int, *order: Column) -> DataFrame:
    """(tree, block, n_blocks, rows) of leaves (tree, digest, ...): each tree's leaves in order, cut into blocks.

    Leaves are sorted by ranges over all trees, so a tree of any size is spread over many tasks; a leaf's place is its
    place in its range plus the counts of its tree in the ranges before.
    """
    tied = leaves.withColumn("tie", F.monotonically_increasing_id())
    keys = [F.col("tree"), *order, F.col("tie")]
    ranged = stage(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).drop("tie"))
    part = F.shiftright("at", 33).alias("part")
    spans = ranged.groupBy("tree", part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.withColumn("before", before - F.col("first")).withColumn("total", F.sum("n").over(tree)).drop("first", "n")
    placed = ranged.withColumn("part", part).join(spans, ["tree", "part"]).withColumn("place", F.col("at") + F.col("before"))
    size = FANOUT**levels
    row = F.struct("place", "digest", *[c for c in leaves.columns if c not in ("tree", "digest")])
    out = placed.groupBy("tree", F.expr(f"place div {size}").alias("block")).agg(F.expr(f"(max(total) + {size - 1}) div {size}").alias("n_blocks"), F.array_sort(F.collect_list(row)).alias("rows"))
    return stage(out)


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(digests: list[str], steps: int | None) -> list[list[str]]:
    """The levels of one block from its leaves up to its root: so many steps in a larger tree, else until one is left."""
    out = [digests]
    while len(out[-1]) > 1 if steps is None else len(out) <= steps:
        below = out[-1]
        out.append([h("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return out


def path_of(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """Leaf i's siblings on every level of its block: those left of it, joined, and those right of it."""
    out = []
    for level in levels[:-1]:
        a = i - i % FANOUT
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + FANOUT])))
        i //= FANOUT
    return out


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        digest = h(left + digest + right)
    return digest


def proof(path: list[tuple[str, str]]) -> str:
    return h("".join(left + right for left, right in path))


PATH = "array<struct<l:string,r:string>>"


def climb(cut: DataFrame, levels: int) -> DataFrame:
    """(tree, block, n_blocks, digest, path): for each block its tree's root and the siblings on the way there."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            top = [levels_of(digests, levels if n > 1 else None)[-1][0] for digests, n in zip(b.column(3).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(top, pa.string())], ["tree", "block", "n_blocks", "digest"])

    own = cut.select("tree", "block", "n_blocks", F.col("rows.digest").alias("digests"))
    state = stage(own.mapInArrow(tops, "tree string, block long, n_blocks long, digest string").withColumn("path", F.array().cast(PATH)))
    most = state.agg(F.max("n_blocks")).first()[0] or 0
    width = 1
    while width < most:
        state = stage(state.filter(F.col("n_blocks") <= width).unionByName(swap(state.filter(F.col("n_blocks") > width), width)))
        width *= FANOUT
    return state


def swap(state: DataFrame, width: int) -> DataFrame:
    """One round: groups of width blocks under one ancestor swap roots.

    Block t of a group gets the root of each other group from its block t, or where that group is the last one and has
    only m blocks, from its block t mod m. So every block gets one message from each group, its own among them.
    """
    size = lambda g: f"least({width}, n_blocks - {g} * {width})"
    sent = state.withColumn("g", F.expr(f"block div {width}")).withColumn("low", F.expr(f"block % {width}"))
    to = lambda g: F.expr(
        f"CASE WHEN {g} * {width} < n_blocks AND low < {size(g)} THEN transform(sequence(low, {size(g)} - 1, {size('g')}), t -> {g} * {width} + t) ELSE cast(array() AS array<bigint>) END"
    )
    targets = F.concat(*[to(f"((g div {FANOUT}) * {FANOUT} + {d})") for d in range(FANOUT)])
    message = sent.select("tree", "n_blocks", F.explode(targets).alias("to"), "block", F.expr(f"g % {FANOUT}").alias("from"), "digest", "path")
    met = message.groupBy("tree", "n_blocks", F.col("to").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("from", "digest"))).alias("run"), F.max(F.when(F.col("to") == F.col("block"), F.col("path"))).alias("path")
    )
    own = F.expr(f"(block div {width}) % {FANOUT}")
    side = lambda keep: F.array_join(F.transform(F.filter("run", keep), lambda x: x["digest"]), "")
    step = F.struct(side(lambda x: x["from"] < own).alias("l"), side(lambda x: x["from"] > own).alias("r"))
    digest = F.sha2(F.array_join(F.col("run.digest"), ""), 256)
    return met.select("tree", "block", "n_blocks", digest.alias("digest"), F.concat("path", F.array(step)).alias("path"))


def proofs(cut: DataFrame, above: DataFrame, levels: int, kept: str) -> DataFrame:
    """Every leaf of blocks with its whole path: the columns kept of its row, digest, root and path."""
    names = [c.split()[0] for c in kept.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                digests = [x["digest"] for x in r["rows"]]
                own, upper = levels_of(digests, levels if r["n_blocks"] > 1 else None), [(x["l"], x["r"]) for x in r["path"]]
                out = {c: [x[c] for x in r["rows"]] for c in names} | {"digest": digests, "root": [r["root"]] * len(digests)}
                out["path"] = [[{"l": left, "r": right} for left, right in path_of(own, i) + upper] for i in range(len(digests))]
                yield pa.RecordBatch.from_pydict(out, schema)

    one = cut.join(above.select("tree", "block", F.col("digest").alias("root"), "path"), ["tree", "block"]).select("n_blocks", "rows", "root", "path")
    types = {f.name: f for f in one.schema["rows"].dataType.elementType.fields}
    text, path = pa.string(), pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
    schema = pa.schema([(c, {"bigint": pa.int64(), "string": text}[types[c].dataType.simpleString()]) for c in names] + [("digest", text), ("root", text), ("path", path)])
    return one.mapInArrow(run, f"{kept}, digest string, root string, path {PATH}")


def manifest(docs: DataFrame, claimed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, and whether claimed, a text for each row (by default its own),
    folds to the root with the row's siblings: folded_root, verified.

    Null sources are a tree of their own, the first. Rows of one doc_id stand beside each other in a tree by their
    leaves; equal rows are equal leaves, each with its own place. Null doc_ids come first in their tree. An empty table
    has no rows and no root. Other columns of docs are neither hashed nor touched.
    """
    given = F.col("text") if claimed is None else claimed
    hashed, other = [F.col(c) for c in FIELDS], [F.col(c) for c in FIELDS[:-1]] + [given]
    tree = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    leaves = stage(docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(*hashed).alias("digest"), leaf_hash(*other).alias("claim")))
    cut = blocks(leaves, levels, F.col("doc_id"), F.col("digest"))
    below = climb(cut, levels)
    tops = stage(below.filter("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("own"), "digest"))
    top_cut = blocks(tops, levels, F.col("own"))
    top = proofs(top_cut, climb(top_cut, levels), levels, "own string").select(F.col("own").alias("tree"), "root", F.col("path").alias("over"))
    found = below.join(top, "tree").select("tree", "block", F.col("digest").alias("subroot"), "root", F.concat("path", "over").alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                root, rows, upper = r["root"], r["rows"], [(x["l"], x["r"]) for x in r["path"]]
                own = levels_of([x["digest"] for x in rows], levels if r["n_blocks"] > 1 else None)
                paths = [path_of(own, i) + upper for i in range(len(rows))]
                folded = [fold(x["claim"], p) for x, p in zip(rows, paths)]
                n = len(rows)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([x["doc_id"] for x in rows], pa.int64()), "leaf": [x["digest"] for x in rows], "subroot": [r["subroot"]] * n, "root": [root] * n,
                    "proof_sha256": [proof(p) for p in paths], "folded_root": folded, "verified": [f == root for f in folded],
                })

    whole = cut.join(found, ["tree", "block"]).select("n_blocks", "rows", "subroot", "root", "path")
    return whole.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, *FIELDS)
    return manifest(docs, F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


# DuckDB has no crc32: folded here bit by bit over the digits of doc_id; 3988292384 is its reversed polynomial.
_CRC = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, [unicode(x)::UBIGINT FOR x IN string_split(doc_id::VARCHAR, '')]),
 lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT FOR i IN range(8)]), lambda v, z: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))))"""


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


def _levels(name: str, base: str, tree: str) -> str:
    """Recursive levels of trees: nodes (tree, lvl, pos, digest, n) with n nodes on their level."""
    return f"""{name} AS (SELECT {tree}, 0 AS lvl, pos, digest, n FROM {base}
 UNION ALL SELECT {tree}, lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY {tree}, lvl, pos // 3)"""


OP11_SQL = f"""WITH RECURSIVE given AS (SELECT *, coalesce('=' || source, '') AS tree, CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS claimed FROM documents),
 hashed AS (SELECT doc_id, tree, sha256({' || '.join(map(_field, FIELDS))}) AS digest, sha256({' || '.join(map(_field, (*FIELDS[:-1], 'claimed')))}) AS claim FROM given),
 leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
 {_levels('low', 'leaves', 'tree')},
 subroots AS (SELECT tree AS own, digest, 0 AS top, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
 {_levels('high', 'subroots', 'top')},
 below AS (SELECT a.doc_id, a.pos, b.lvl, string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos // (3 ** b.lvl)::BIGINT) AS l, string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos // (3 ** b.lvl)::BIGINT) AS r
  FROM leaves a JOIN low b ON a.tree = b.tree AND b.n > 1 AND b.pos // 3 = a.pos // (3 ** (b.lvl + 1))::BIGINT GROUP BY a.doc_id, a.tree, a.pos, b.lvl),
 above AS (SELECT a.own, b.lvl + 1000 AS lvl, string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos // (3 ** b.lvl)::BIGINT) AS l, string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos // (3 ** b.lvl)::BIGINT) AS r
  FROM subroots a JOIN high b ON b.n > 1 AND b.pos // 3 = a.pos // (3 ** (b.lvl + 1))::BIGINT GROUP BY a.own, b.lvl),
 steps AS (SELECT tree, pos, lvl, coalesce(l, '') AS l, coalesce(r, '') AS r FROM (SELECT a.tree, a.pos, b.lvl, b.l, b.r FROM leaves a JOIN below b ON a.doc_id = b.doc_id AND a.pos = b.pos
  UNION ALL SELECT a.tree, a.pos, b.lvl, b.l, b.r FROM leaves a JOIN above b ON a.tree = b.own)),
 paths AS (SELECT tree, pos, list({{'l': l, 'r': r}} ORDER BY lvl) AS path, string_agg(l || r, '' ORDER BY lvl) AS proof FROM steps GROUP BY tree, pos),
 folds AS (SELECT a.tree, a.pos, 0 AS k, a.claim AS digest, p.path FROM leaves a LEFT JOIN paths p ON a.tree = p.tree AND a.pos = p.pos
  UNION ALL SELECT tree, pos, k + 1, sha256(path[k + 1].l || digest || path[k + 1].r), path FROM folds WHERE k < len(path)),
 ends AS (SELECT tree, pos, digest FROM folds WHERE k = coalesce(len(path), 0))
SELECT a.doc_id, a.digest AS leaf, s.digest AS subroot, t.digest AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.digest AS folded_root, e.digest = t.digest AS verified
FROM leaves a JOIN subroots s ON a.tree = s.own JOIN high t ON t.n = 1 JOIN ends e ON a.tree = e.tree AND a.pos = e.pos LEFT JOIN paths p ON a.tree = p.tree AND a.pos = p.pos"""
