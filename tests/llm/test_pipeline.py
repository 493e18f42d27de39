"""Every stage of the pipeline against plain Python over the same rows."""

from __future__ import annotations

import collections
import hashlib
import importlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from tokenizers import Tokenizer

from foliant.llm import pii, toxicity
from foliant.llm.common import _written

from .conftest import shaped
from .test_table_ops import brute_rows, ordered
from .test_text_ops import base

pipeline = pytest.importorskip("corpus_pipeline")
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
CARDS = ("4539578763621486", "4716258050958645", "4929144317631246", "4485040993287616", "4532015112830366", "4556737586899855")


# ---------------------------------------------------------------- toxicity by plain search


def plain_hits(text, lexicon):
    """Start: weight of the heaviest entry at each word start, by comparing every entry at every place."""
    out = {}
    for start in range(len(text)):
        if start and text[start - 1].isalnum():
            continue
        for entry, weight in lexicon.items():
            bare, whole = entry.rstrip(), entry.endswith(" ")
            for form in {bare, bare.replace("l", "i")}:
                end = start + len(form)
                if text.startswith(form, start) and not (whole and end < len(text) and text[end].isalnum()):
                    out[start] = max(weight, out.get(start, 0))
    return out


@settings(max_examples=300, deadline=None)
@given(some.text(some.sampled_from("abcli! .1"), max_size=40), some.dictionaries(some.text(some.sampled_from("abcli"), min_size=1, max_size=4), some.tuples(some.booleans(), some.integers(1, 9)), max_size=6))
def test_hits_are_those_of_plain_search(text, entries):
    lexicon = {word + " " * whole: float(weight) for word, (whole, weight) in entries.items()}
    found = toxicity.hits(text, toxicity.Model(lexicon).matcher())
    assert {s: weight for s, (_, weight, _) in found.items()} == plain_hits(text, lexicon)


def plain_score(text, model):
    total, taken = 0.0, set()
    whole, *others = toxicity.forms(text or "")
    automaton = model.matcher()
    for form in (whole, *others):
        found = plain_hits(form, model.lexicon)
        ends = {s: e for s, (_, _, e) in toxicity.hits(form, automaton).items()}
        assert found.keys() == ends.keys()
        here = [s for s in found if not others or taken.isdisjoint(range(s, ends[s]))]
        for s in here:
            taken.update(range(s, ends[s]) if others else ())
            if model.exceptions.isdisjoint(toxicity.phrases(form, s, ends[s])):
                total += found[s]
    c, a, b = model.curve
    z = c + a * math.log1p(total) + b * math.log1p(10 * total / math.sqrt(1 + len(whole) / 6))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def planted(rng):
    """Rows (doc_id, text) and labels: every ninth document is toxic."""
    clean = ["".join(rng.choice(list("bdfgkmprtvz")) + rng.choice(list("aeou")) for _ in range(3)) for _ in range(300)]
    rows, labels = [], []
    for i in range(360):
        words = rng.choice(clean, 60).tolist()
        if i % 9 == 0:
            for at in rng.choice(60, 4, replace=False):
                words[at] = ("idiot", "moron", "clown")[rng.integers(3)]
        rows.append((i, " ".join(words[:30]) + ". " + " ".join(words[30:]) + "."))
        labels.append((i, int(i % 9 == 0)))
    return rows, labels


def test_held_out_labels_decide_nothing(spark):
    """Flipping the labels of the held-out rows leaves every score as it is."""
    rows, marks = planted(np.random.default_rng(4))
    docs, labels = shaped(spark, [(d, t, "a") for d, t in rows]), spark.createDataFrame(marks, "doc_id LONG, toxic INT")
    held = toxicity.held_out()
    flipped = labels.select("doc_id", pii.F.when(held, 1 - pii.F.col("toxic")).otherwise(pii.F.col("toxic")).alias("toxic"))
    a, b = (toxicity.score(docs, toxicity.fit(docs, x)).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b and any(r["predicted"] for r in a)


# ---------------------------------------------------------------- personal data by plain loops


def plain_discovery(rows, rounds=3, least=5, sure=0.9, least_shape=0.5):
    """Spans (row, kind, s, e) that bootstrapping finds in rows (doc_id, text)."""
    spans = []
    for i, (_, text) in enumerate(rows):
        text = text or ""
        own = pii.base_spans(text)
        for k, s, e in [(k, s, e) for s, k, e in own] + [(-1, s, e) for s, e in pii.candidates(text, own)]:
            spans.append((i, k, s, e, pii.shape(text[s:e]), pii.value(text[s:e]), pii.fits(text[s:e]) if k < 0 else 17 << k, *pii.context(text, s, e)))
    based = {x[4] for x in spans if x[1] >= 0}
    held = []  # span, pattern, keyed
    for x in spans:
        if x[1] >= 0 or x[6] or x[4] in based:
            token, left, right, before, after = x[4], *x[7:]
            if left:
                near = left.split(" ")[-1]
                held += [(x, ("l", left), False), (x, ("l", left, token), True), (x, ("o", near), False), (x, ("o", near, token), True)]
                held += [(x, ("b", left, right), False), (x, ("b", left, right, token), True)] if right else []
            held += [(x, ("w", before, token), True), (x, ("v", after, token), True)]
    free = [h for h in held if h[0][1] < 0]
    hits = collections.Counter((p, keyed, x[1]) for x, p, keyed in held if x[1] >= 0)
    ok = lambda x, p, keyed, k: x[6] >> (4 + k) & 1 if p[0] in 'owv' else keyed or x[6] >> k & 1
    shape_seeds = collections.Counter((x[4], x[1]) for x in spans if x[1] >= 0)

    def best(support):
        out = {}
        for p, keyed in {(p, keyed) for p, keyed, _ in support}:
            top = max((support[p, keyed, k], hits[p, keyed, k], k) for k in range(4) if (p, keyed, k) in support)
            if top[0] >= least:
                out[p] = (keyed, top[2], top[1], sum(hits[p, keyed, k] for k in range(4)))
        return out

    patterns = best(hits)
    score = {p: h / (n + (0 if keyed else sum(q == p and bool(ok(x, q, kd, k)) for x, q, kd in free))) for p, (keyed, k, h, n) in patterns.items()}
    shapes = None

    def edges():
        for x, p, keyed in free:
            if p in patterns and ok(x, p, keyed, patterns[p][1]):
                k = patterns[p][1]
                worth = 1.0 if shapes is None else shapes.get((x[4], k), 1.0)
                yield x, p, keyed, k, worth, score[p] if keyed else score[p] * worth

    def together(weights):
        return 1 - math.exp(sum(math.log(max(1e-9, 1 - w)) for w in weights))

    for _ in range(rounds):
        of = collections.defaultdict(list)
        for x, _, _, k, _, w in edges():
            of[x, k].append(w)
        belief = {key: together(w) for key, w in of.items()}
        values = collections.defaultdict(float)
        worth = collections.defaultdict(lambda: [0.0, 0])
        for (x, k), b in belief.items():
            values[x[5], k] = max(values[x[5], k], b)
            worth[x[4], k][0] += b
            worth[x[4], k][1] += 1
        for (token, k), n in shape_seeds.items():
            worth[token, k][0] += n
            worth[token, k][1] += n
        every = collections.Counter()
        for (token, _), (_, n) in worth.items():
            every[token] += n
        shapes = {(t, k): (b + least) / (every[t] + least) for (t, k), (b, _) in worth.items()}
        support = collections.Counter(hits)
        for x, p, keyed in free:
            for k in range(4):
                if p[0] not in "owv" and values.get((x[5], k), 0) >= sure and ok(x, p, keyed, k):
                    support[p, keyed, k] += 1
        patterns = best(support) | patterns
        score = {}
        for p, (_, k, h, n) in patterns.items():
            members = [values.get((x[5], k), 0.0) for x, q, keyed in free if q == p and ok(x, q, keyed, k)]
            score[p] = (h + sum(members)) / (n + len(members))
    marks = collections.defaultdict(list)
    for x, p, keyed, k, worth_, w in edges():
        if score[p] >= sure and (keyed or worth_ >= least_shape):
            marks[x, k].append(w)
    top = {}
    for (x, k), w in marks.items():
        top[x] = max(top.get(x, (0.0, -1)), (together(w), k))
    out = []
    for i in {x[0] for x in top}:
        kept = []
        for _, _, s, e, k in sorted((x[2] - x[3], -b, x[2], x[3], k) for x, (b, k) in top.items() if x[0] == i):
            if all(e <= a or b <= s for a, b, _ in kept):
                kept.append((s, e, k))
        out += [(i, k, s, e) for s, e, k in kept]
    return out


def personal_rows():
    say = "Please call our office number {} today".format
    ring = "You can ring us under {} after noon".format
    texts = [say(f"+1 (743) 555-38{i}") for i in range(10, 18)] + [say(f"(743) 555-38{i}") for i in range(20, 25)] + [ring(f"(743) 555-38{i}") for i in range(20, 25)]
    texts += [ring("(212) 999 1234"), say("10:30"), "We had sold (743) 555-3899 of them", *[f"Pay with the card number {n} soon" for n in CARDS], "Pay with the card number 4539 5787 6376 2148 soon"]
    texts += [f"write to me at jo{i}@ex.com please" for i in range(6)] + ["write to me at jo [at] ex dot com please", None, "", "host 10.0.0.1 and 999.1.2.3 is up"]
    return [(i, t) for i, t in enumerate(texts)]


def plain_redaction(rows):
    more = collections.defaultdict(list)
    for i, k, s, e in plain_discovery(rows):
        more[i].append((s, k, e))
    out = []
    for i, (d, text) in enumerate(rows):
        new, done = "", 0
        for s, k, e in sorted(base(text or "") + more[i]):
            if s >= done:
                new += text[done:s] + f"<{pii.KINDS[k].upper()}>"
            done = max(done, e)
        out.append((d, None if text is None else new + text[done:]))
    return out


def test_discovery_is_the_plain_loops(spark):
    rows = personal_rows()
    found = pii.stage(pii.scan(shaped(spark, [(d, t, "a") for d, t in rows])))
    got = sorted((r["doc_id"], r["kind"], r["s"], r["e"]) for r in pii.discover(found).collect())
    assert got == sorted(plain_discovery(rows)) and len(got) > 10


# ---------------------------------------------------------------- mixing and packing by plain loops


def plain_mixing(rows):
    """Copies of each row (doc_id, source, ...) by the inverse Poisson of an MD5 of its doc_id."""
    n = collections.Counter(r[1] for r in rows)
    weight = {s: math.sqrt(x) for s, x in n.items()}
    out = collections.Counter()
    for r in rows:
        rate = len(rows) * weight[r[1]] / sum(weight.values()) / n[r[1]]
        u = int(hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest()[:13], 16) / 2.0**52
        k, p = 0, math.exp(-rate)
        total = p
        while total < u:
            k += 1
            p *= rate / k
            total += p
        out[r] += k
    return out


def test_stages(spark):
    """The five stages one after another on planted rows."""
    rng = np.random.default_rng(3)
    rows, labels = planted(rng)
    for i in range(40):  # near copies, some of copies
        words = rows[(7 * i) % 300 + 1][1].split()
        for _ in range(i % 4):
            words[rng.integers(60)] = "edit%d" % rng.integers(100)
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000 + d, t) for d, t in personal_rows()] + [rows[5], (None, rows[6][1])]
    source = lambda d: "hot" if (d or 0) % 3 == 0 else f"s{(d or 0) % 4}"
    docs = shaped(spark, [(d, t, source(d)) for d, t in rows])
    folder = f"{pipeline.stage(docs)._jdf.inputFiles()[0].rsplit('/', 2)[0]}/case-{np.random.randint(1 << 30)}"
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id LONG, toxic INT").write.parquet(f"{folder}/labels.parquet")
    steps = dict(pipeline.STAGES)
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]

    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    now = pipeline.stage(steps["toxicity"](spark, docs, folder))
    want = [r for r in rows if plain_score(r[1], model) < toxicity.THRESHOLD]
    assert ordered(pairs(now)) == ordered(want) and len(rows) - len(want) >= 38

    now = pipeline.stage(steps["near_duplicates"](spark, now, folder))
    before, (_, groups) = want, brute_rows(want, 5, 80)
    want = [min((before[i] for i in at), key=lambda r: (r[0] is None, r[0])) for at in groups]
    assert ordered(pairs(now)) == ordered(want) and len(want) < len(before) - 15

    now = pipeline.stage(steps["personal_data"](spark, now, folder))
    want = plain_redaction(want)
    assert ordered(pairs(now)) == ordered(want) and sum("<PHONE>" in (t or "") for _, t in want) > 3
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in now.collect())

    now = pipeline.stage(steps["mixing"](spark, now, folder))
    named = [(d, source(d), t) for d, t in want if d is not None]
    copies = {r: n for r, n in plain_mixing(named).items() if n}
    got = collections.Counter((r["doc_id"], r["source"], r["text"]) for r in now.collect())
    assert {r: n for r, n in got.items() if r[0] is not None} == copies

    pieces = pipeline.stage(steps["packing"](spark, now, folder)).collect()
    check_pieces(pieces, [(r["doc_id"], r["text"]) for r in now.collect()])
    kept = len(_written)
    out = pipeline.run(spark, folder)
    assert out.columns == list(pieces[0].asDict()) and out.count() > 0 and len(_written) == kept + 1


def check_pieces(pieces, rows):
    """Every document's ids lie in exactly one piece each, and pieces lie in sequences without gaps."""
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        by[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    texts = collections.defaultdict(list)
    for d, t in rows:
        texts[d].append(LIBRARY.encode(t or "", add_special_tokens=False).ids + [2])
    assert by.keys() == texts.keys()
    for d, ids in texts.items():  # copies of one document have the same ids
        covered = collections.Counter(p for s, n, _, _ in by[d] for p in range(s, s + n))
        assert covered == collections.Counter(p for x in ids for p in range(len(x)))
        for s, n, crc, total in by[d]:
            assert any(total == len(x) and crc == zlib.crc32(np.array(x[s : s + n], "<u4").tobytes()) for x in ids)
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096


def test_guard():
    entry = importlib.import_module("__spark_entry__")
    assert entry.corpus_pipeline is pipeline
