"""Toxicity, near duplicates, embeddings, mixing and the pipeline: held-out labels, odd inputs and brute force."""

from __future__ import annotations

import collections
import importlib
import math
import zlib

import numpy as np
import pytest

from foliant.llm import hnsw, jaccard_join, mixing, toxicity
from foliant.llm.common import components

from .conftest import shaped


def sets(text, k):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_rows(rows, k, percent):
    """(doc_id, set size, component_id) of every (doc_id, text), and the groups as lists of row numbers."""
    s = [sets(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(s[i] & s[j])
            if n and 100 * n >= percent * (len(s[i]) + len(s[j]) - n):
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    least = {g: min((rows[i][0] for i in at if rows[i][0] is not None), default=None) for g, at in groups.items()}
    return [(rows[i][0], len(s[i]), least[root(i)]) for i in range(len(rows))], list(groups.values())


def brute(texts, k, percent):
    return {d: (n, c) for d, n, c in brute_rows(list(texts.items()), k, percent)[0]}


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is None, x) for x in r])


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_jaccard(spark, sf, k, percent):
    rng = np.random.default_rng(k)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(12):  # groups of copies with edits around the threshold, and a passage that all share
        words = rng.choice(vocabulary, 90).tolist() + ["shared", "words", "of", "a", "common", "line"]
        for i in range(8):
            new = list(words)
            for _ in range(i // 2):
                new[rng.integers(90)] = "edit%d" % rng.integers(10**6)
            rows.append((1000 * g + i, " ".join(new), "a"))
    rows += [(r["doc_id"] + 10**6, r["text"], "b") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = shaped(spark, rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, k, percent).collect()}
    assert got == brute({d: t for d, t, _ in rows}, k, percent)


def near_copies(seed, m):
    """m texts of one source text: most near it, some farther, some far from it but near each other."""
    rng = np.random.default_rng(seed)
    base = [f"t{i}" for i in range(100)]
    out = []
    for i in range(m):
        new = list(base)
        for _ in range(int(rng.integers(0, 5)) + (i % 4 == 0) * int(rng.integers(0, 6))):
            new[rng.integers(100)] = f"x{rng.integers(40)}"
        out.append(" ".join(new))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_blocks(spark, monkeypatch, seed):
    """Groups beyond a block are verified along their candidate pairs, and by blocks where these don't all link."""
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 5)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 800)
    rows = [(i, t, "a") for i, t in enumerate(near_copies(seed, 60))]
    got = jaccard_join.jaccard_components(shaped(spark, rows)).collect()
    assert ordered(got) == ordered(brute_rows([r[:2] for r in rows], 4, 85)[0])
    base = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :]), "a") for i in range(40)]
    got = jaccard_join.jaccard_components(shaped(spark, rows)).collect()
    assert {r["component_id"] for r in got} == {0}


def test_jaccard_rows(spark):
    """Repeated ids of different texts, repeated rows and rows without id keep their own sets and links."""
    x, y = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, x), (1, y), (3, x + " more"), (5, y), (9, y + " end"), (None, x), (None, None), (None, "alone here"), (7, x), (7, x), (8, ""), (8, "")]
    got = jaccard_join.jaccard_components(shaped(spark, [(d, t, "a") for d, t in rows])).collect()
    assert ordered(got) == ordered(brute_rows(rows, 4, 85)[0])
    docs = shaped(spark, [(d, t, "a") for d, t in rows]).selectExpr("*", "'clash' AS whole", "1 AS row", "2 AS stays")
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(docs).collect()]
    first = [min((rows[i] for i in at), key=lambda r: (r[0] is None, r[0])) for at in brute_rows(rows, 5, 80)[1]]
    assert ordered(kept) == ordered(first)


def test_jaccard_odd(spark, odd, none):
    got = jaccard_join.jaccard_components(odd).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == odd.count()
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[2]["component_id"] == 2
    assert sorted(r["component_id"] for r in got if r["doc_id"] in (4, 5)) == [4, 4, 4, 5]
    assert by[7]["n_shingles"] == 1 and by[None]["component_id"] is None
    assert jaccard_join.jaccard_components(none).count() == 0
    assert jaccard_join.one_of_each(none).count() == 0 and jaccard_join.one_of_each(odd).columns == odd.columns


def test_jaccard_moves_texts_of_candidates_only(spark, monkeypatch):
    """The texts that are read again pass a map of the candidates' keys first: none of theirs is lost, few others move."""
    rows = spark.range(20_000).selectExpr("id AS doc_id", "unhex(md5(cast(id AS string))) AS row", "concat('text ', id) AS text")
    kept = rows.filter("doc_id % 100 = 7").selectExpr("doc_id AS node", "row", "0L AS component")
    assert "_map" in jaccard_join.whole_sets(rows, kept, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert jaccard_join.whole_sets(rows, kept, 4).count() == 200
    for bits, most in ((1 << 27, 1000), (1 << 15, 1000)):
        monkeypatch.setattr(jaccard_join, "MAP_BITS", bits)
        found = [r["doc_id"] for r in jaccard_join.likely(rows, kept, "row").collect()]
        assert len(set(found)) == len(found) < most and {i for i in range(20_000) if i % 100 == 7} <= set(found)
    assert jaccard_join.likely(rows, kept.limit(0), "row").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u LONG, v LONG")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "u LONG, v LONG")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>, label INT, copies STRING")


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 24))
    for i in range(300):  # near pairs, chains and one dense group
        x[400 + i] = x[i % 40 if i < 200 else 3] + 0.08 * rng.standard_normal(24) * np.linalg.norm(x[i % 40]) / 5
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(x.astype(np.float32).astype(float))]
    rows += [(900, rows[3][1], 0, "x"), (901, rows[3][1], 0, "x")]
    bad = [(910, None, 0, "x"), (911, [0.0] * 24, 0, "x"), (912, [float("nan")] + [1.0] * 23, 0, "x"), (913, [None] + [1.0] * 23, 0, "x"), (914, [], 0, "x"), (915, [1.0, 2.0], 0, "x"), (None, [1.0] * 24, 0, "x")]
    got = {r["vec_id"]: r for r in hnsw.near_components(vectors(spark, rows + bad), shards=3).collect()}
    ids = [r[0] for r in rows]
    m = np.array([r[1] for r in rows])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    link = m @ m.T >= 0.9
    np.fill_diagonal(link, False)
    found = sum(got[i]["n_links"] for i in ids)
    assert found >= 0.99 * link.sum() and all(got[i]["n_links"] <= n for i, n in zip(ids, link.sum(1)))
    assert len(got) == len(rows) + 6
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(910, 916))
    assert got[900]["component_id"] == got[901]["component_id"] == got[3]["component_id"]
    assert hnsw.near_components(vectors(spark, [])).count() == 0
    assert hnsw.near_components(vectors(spark, bad)).count() == 6


def test_embedding_audit():
    """Nodes that no links reach, and small groups beside a large one, are found after the audit."""
    rng = np.random.default_rng(7)
    x = hnsw.unit(rng.standard_normal((600, 24)))
    x[200:400] = x[:200]  # 200 pairs
    x[400:] = hnsw.unit(x[399] + 0.01 * rng.standard_normal((200, 24)))  # one large group
    for lost in (np.arange(600), np.arange(200)):  # all nodes, or one of each pair, lose their links
        graph = hnsw.Hierarchy(x)
        nodes, links = graph.layers[-1]
        gone = np.isin(nodes, lost)
        links[gone] = -1
        links[np.isin(links, np.flatnonzero(gone))] = -1
        del graph.layers[:-1]
        assert graph.audit(0.9) >= 0.99
        graph = hnsw.Hierarchy.load(x, graph.dump())
        q, node = graph.within(x, 0.9)
        assert set(zip(q.tolist(), node.tolist())) == set(zip(*(v.tolist() for v in np.nonzero(x @ x.T >= 0.9))))


def test_toxicity_held_out(spark):
    """The English words are learnt from the rows of the other folds and found in the held-out one, disguised ones too."""
    rng = np.random.default_rng(1)
    clean = ["".join(rng.choice(list("bdfgkmprtvz")) + rng.choice(list("aeou")) for _ in range(3)) for _ in range(400)]
    bad = ["idiot", "moron", "clown"]
    rows, labels = [], []
    for i in range(900):
        words = rng.choice(clean, 40).tolist()
        toxic = i % 9 == 0
        if toxic:
            for at in rng.choice(40, 3, replace=False):
                words[at] = bad[rng.integers(3)] + ("s" if rng.random() < 0.2 else "")
        rows.append((i, " ".join(words), "a"))
        labels.append((i, 1, int(toxic)))
    docs, table = shaped(spark, rows), spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT")
    model = toxicity.fit(docs, table)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(d, t) for d, _, t in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    assert sum(got[d]["predicted"] == t for d, t in held) >= 0.98 * len(held)
    disguised = shaped(spark, [(1, "you 1d10t and M0R0N, a real с1оwn " + " ".join(clean[:20]), "a"), (2, " ".join(clean[:30]), "a"), (3, None, "a")])
    assert [r["predicted"] for r in toxicity.score(disguised, model).orderBy("doc_id").collect()] == [1, 0, 0]
    assert toxicity.keep_clean(docs, model).count() == sum(r["predicted"] == 0 for r in got.values())


def test_toxicity_exceptions():
    model = toxicity.Model({"clown": 5.0}, frozenset({"clown fish"}), (-3.0, 2.0, 1.0))
    automaton = toxicity.Model.matcher(model)
    assert toxicity.evidence("a clown fish swims", model, automaton) == (0.0, 0.0)
    assert toxicity.evidence("a clown swims", model, automaton)[0] > 0


def test_toxicity_signs_at_word_ends():
    model = toxicity.Model({"clown ": 5.0, "ass ": 5.0})
    automaton = model.matcher()
    for text, n in (("you clown!!", 1), ("¡clown!", 1), ("you a$$!", 1), ("an as$ here", 1), ("@ss clown|", 2), ("clowning!", 0)):
        whole, *others = toxicity.forms(text)
        assert toxicity.evidence(whole, model, automaton, *others)[0] == math.log1p(5.0 * n), text


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 1), (None, 1, 1), (5, None, None), (2, 0, 0)], "doc_id LONG, quality INT, toxic INT")
    for table in (labels, labels.limit(0)):
        model = toxicity.fit(odd, table)
        rows = toxicity.score(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_mixing(spark, odd, none, sf):
    out = mixing.replicate(odd)
    assert out.columns == [*odd.columns, "n_copies", "copy_no"]
    want = {r["doc_id"]: r["n_copies"] for r in out.collect()}
    assert all(sum(1 for r in out.collect() if r["doc_id"] == d) % n == 0 for d, n in want.items())
    assert mixing.replicate(none).count() == 0
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 5) END AS source")
    got = collections.Counter(r["source"] for r in mixing.replicate(docs, weights={"hot": 1.0, "s1": 3.0}, total=40_000).collect())
    assert set(got) == {"hot", "s1"} and abs(got["hot"] - 10_000) < 500 and abs(got["s1"] - 30_000) < 900


def test_poisson_inverse(spark):
    """Counts follow the distribution at small and at very large rates."""
    for rate in (0.3, 7.5, 900.0):
        docs = spark.range(3000).selectExpr("id AS doc_id", "'x' AS source")
        n = np.array([r["n_copies"] for r in mixing.replicate(docs, weights={"x": 1.0}, total=3000 * rate).select("doc_id", "n_copies").distinct().collect()])
        n = np.concatenate([n, np.zeros(3000 - len(n))])
        assert abs(n.mean() - rate) < 5 * (rate / 3000) ** 0.5 and abs(n.var() / rate - 1) < 0.15


def test_pipeline_stages(spark, sf, odd, none):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(pipeline.STAGES)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rejected = {r["doc_id"] for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    clean = pipeline.stage(steps["toxicity"](spark, docs, sf))
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - rejected
    kept = pipeline.stage(steps["near_duplicates"](spark, clean, sf))
    groups = brute({r["doc_id"]: r["text"] for r in clean.collect()}, 5, 80)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, (_, c) in groups.items() if c == d}
    safe = pipeline.stage(steps["personal_data"](spark, kept, sf))
    assert safe.count() == kept.count()
    mixed = pipeline.stage(steps["mixing"](spark, safe, sf))
    assert all(x.columns == docs.columns for x in (clean, kept, safe, mixed))
    assert mixed.count() == mixing.replicate(safe).count()
    assert steps["packing"](spark, mixed, sf).agg({"doc_tokens": "count"}).first()[0] > 0
    for rows in (odd.select(*docs.columns), none):
        for name, step in pipeline.STAGES:
            rows = pipeline.stage(step(spark, rows, sf))


def test_registered(spark):
    entry = importlib.import_module("__spark_entry__")
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 11)} and "pipeline" in entry.queries()


def test_mixing_many_sources(spark, monkeypatch):
    """Beyond the size for a broadcast, rows meet the tables by source and salt, with the same counts."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id % 7) AS source")
    want = sorted(map(tuple, mixing.replicate(docs).collect()))
    monkeypatch.setattr(mixing, "TABLE_DOUBLES", 10)
    monkeypatch.setattr(mixing, "SALT_ROWS", 100)
    assert sorted(map(tuple, mixing.replicate(docs).collect())) == want


def test_sql(spark, sf):
    from foliant.llm import queries
    from tests.oracle import actual, expected

    for name, sql in queries.SQL.items():
        assert actual(queries.QUERIES[name](spark, sf)) == expected(sf, sql)
