"""The Merkle manifest against a plain tree in one process, and its query against SQL."""

from __future__ import annotations

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from foliant.llm import merkle, queries
from tests.oracle import actual, expected

from .conftest import shaped


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """The root of the leaves and, for each, its siblings as (left, right) from below."""
    at, paths, nodes = list(range(len(leaves))), [[] for _ in leaves], list(leaves)
    while len(nodes) > 1:
        for i, p in enumerate(at):
            a = p - p % 3
            paths[i].append((nodes[a:p], nodes[p + 1 : a + 3]))
            at[i] = p // 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain(rows, claimed):
    by = collections.defaultdict(list)
    for r in rows:
        value = lambda text: h(*(field(r[c]) for c in merkle.FIELDS[:-1]), field(text))  # noqa: B023, E731
        by["" if r["source"] is None else "=" + r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, value(r["text"]), value(claimed(r)), r["doc_id"]))
    sources = sorted(by, key=str.encode)
    below = {s: (sorted(by[s], key=lambda x: x[:3]), *tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])])) for s in sources}
    root, above = tree([below[s][1] for s in sources])
    out = []
    for s, upper in zip(sources, above):
        leaves, subroot, paths = below[s]
        for (*_, leaf, claim, doc_id), path in zip(leaves, paths):
            whole, folded = path + upper, claim
            for left, right in whole:
                folded = h(*left, folded, *right)
            out.append((doc_id, leaf, subroot, root, h(*(x for left, right in whole for x in left + right)), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [0, 1, 2, 7])
def test_manifest_of_odd_rows(spark, odd, levels):
    got = [tuple(r) for r in merkle.manifest(odd, F.lower("text"), levels).collect()]
    assert sorted(got, key=str) == plain(odd.collect(), lambda r: r["text"] and r["text"].lower())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 100])
def test_trees_of_any_size(spark, n):
    docs = shaped(spark, [(i * 7 % n, f"text {i}", "a" if i % 3 else "b") for i in range(n)])
    assert sorted((tuple(r) for r in merkle.manifest(docs, levels=1).collect()), key=str) == plain(docs.collect(), lambda r: r["text"])


def test_one_tree_of_many_blocks_and_sources_of_one_leaf(spark):
    docs = shaped(spark, [(i, "x\n" * (i % 5), "hot" if i % 2 else f"s{i}") for i in range(120)])
    cut = F.replace("text", F.lit("\n"), F.lit(""))
    got = merkle.manifest(docs, cut, 1).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs.collect(), lambda r: r["text"].replace("\n", ""))
    assert {r["doc_id"] for r in got if r["verified"]} == {i for i in range(120) if i % 5 == 0}


def test_empty_table(spark, none):
    assert merkle.manifest(none).count() == 0


def test_query(spark, sf):
    name = "op11_merkle_manifest"
    assert actual(queries.QUERIES[name](spark, sf)) == expected(sf, queries.SQL[name])
