"""Text operators: odd inputs, empty tables and brute force."""

from __future__ import annotations

import collections
import hashlib
import json
import math
import re
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as some
from tokenizers import Tokenizer

from foliant.llm import fingerprints, lm_scoring, packing, pii, queries, substring_dedup, token_counts
from tests.oracle import actual, expected

from .conftest import shaped

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = token_counts.Counter49k(PATH)
ENCODER = packing.Encoder(PATH)
ALPHABET = "abcdeéüßIİΣσς'stllvedm \n\t\x85\x1c ​0123½²Ⅷ一中🙂́!?.,<|>-_"


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(some.text(some.sampled_from(ALPHABET), max_size=60))
def test_tokens_are_the_librarys(text):
    assert COUNTER.counts([text])[0] == len(ids(text))
    flat, offsets = ENCODER.encode([text])
    assert flat.tolist() == ids(text) + [2] and offsets.tolist() == [0, len(flat)]


@settings(max_examples=200, deadline=None)
@given(some.lists(some.lists(some.sampled_from(["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'r", "''", "_'", "ab", "É", "ß", "l", "7", "½", "一", " ", "\n", "\x1c", "\xa0", ".", "...", "\0end", "<|endoftext|>", "<|ENDOFTEXT|>", " <|startoftext|>", "<|"]), max_size=12).map("".join), max_size=6))
def test_batches_are_the_librarys(texts):
    """Plain texts, those with unusual characters and those with special strings, mixed in one batch."""
    flat, offsets = ENCODER.encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [ids(t) + [2] for t in texts]
    assert COUNTER.counts(texts).tolist() == [len(ids(t)) for t in texts]


def test_plain_characters_are_the_librarys():
    """Every character that plain texts may hold, between others."""
    texts = [t for c in map(chr, range(0x250)) for t in (f"a{c}b", f"1{c}'s", f".{c}'re {c}{c}")]
    flat, offsets = ENCODER.encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [ids(t) + [2] for t in texts]


def test_each_word_is_looked_up_once_a_batch():
    class Counted(dict):
        n = 0

        def __getitem__(self, key):
            Counted.n += 1
            return super().__getitem__(key)

        def get(self, *args):
            Counted.n += 1
            return super().get(*args)

    encoder = packing.Encoder(PATH)
    encoder.code = Counted(encoder.code)
    flat, offsets = encoder.encode(["one two three. " * 1000] * 3)
    assert len(flat) == offsets[-1] == 12_003 and Counted.n <= 10


def test_merge_ranks():
    """The hash table gives each pair its rank, and no other pair any."""
    spec = json.load(open(PATH, encoding="utf-8"))
    merge, vocab = token_counts.Merger(spec), spec["model"]["vocab"]
    pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
    left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
    assert merge._rank(left, right).tolist() == list(range(len(pairs)))
    known = set(zip(left.tolist(), right.tolist()))
    other = [k for k, pair in enumerate(zip(right.tolist(), left.tolist())) if pair not in known]
    assert (merge._rank(right[other], left[other]) == len(pairs)).all()


def test_special_strings():
    for text in ("<|endoftext|>a<|startoftext|>", "a<|endoftext|", "<|ENDOFTEXT|>", "aaaaaaaaaaa", "'s's'll"):
        assert COUNTER.counts([text])[0] == len(ids(text))


def test_token_counts(spark, odd, none):
    got = token_counts.token_counts(odd, PATH).collect()
    texts = [r["text"] for r in odd.collect()]
    assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted((len((t or "").encode()), len(ids(t)), len(ids(t)) > 2048) for t in texts)
    assert token_counts.token_counts(none, PATH).count() == 0


def check_pack(docs, rows):
    want = collections.Counter()
    for r in docs.collect():
        want[(r["doc_id"], tuple(ids(r["text"]) + [2]))] += 1
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id in {d for d, _ in want}:
        texts = [(t, n) for (d, t), n in want.items() if d == doc_id]
        assert sum(len(t) * n for t, n in texts) == sum(r["length"] for r in by[doc_id])
        if sum(n for _, n in texts) == 1:
            at, whole = 0, np.array(texts[0][0], "<u4")
            for r in sorted(by[doc_id], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(whole) and r["ids_crc32"] == zlib.crc32(whole[at : at + r["length"]].tobytes())
                at += r["length"]
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096


def test_packing(spark, odd, none, sf):
    check_pack(odd, packing.pack(odd, PATH).collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    rows = packing.pack(docs, PATH).collect()
    check_pack(docs, rows)
    used = collections.Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert sum(4096 - n for n in used.values() if n & (n - 1)) < 0.02 * sum(used.values())
    assert packing.pack(none, PATH).count() == 0
    # Cuts inside documents are at sentence ends, but for the powers of two at the end of each of the three tasks.
    texts = {r["doc_id"]: ids(r["text"]) for r in docs.collect()}
    last = {s for s in used if s >= max(x for x in used if x >> 40 == s >> 40) - 12}
    inside = [r for r in rows if r["sequence_id"] not in last and r["start"] + r["length"] < r["doc_tokens"]]
    assert inside and all(ENCODER.ends_sentence[texts[r["doc_id"]][r["start"] + r["length"] - 1]] for r in inside)


def test_cut_places():
    """Grid places only in stretches beyond the capacity."""
    ends = np.array([False, True])
    ids_ = np.zeros(200, np.int64)
    ids_[[49, 89]] = 1
    places, penalty = packing.candidates(ids_, np.array([0, 60, 200]), ends, 100)
    assert places.tolist() == [0, 50, 60, 90, *range(106, 200, 16), 200] and penalty[1] == packing.SENTENCE_PENALTY and penalty[2] == 0
    places, _ = packing.candidates(ids_, np.array([0, 60, 200]), ends, 150)
    assert places.tolist() == [0, 50, 60, 90, 200]

@settings(max_examples=100, deadline=None)
@given(some.lists(some.integers(1, 9), min_size=1, max_size=12), some.data())
def test_cuts_are_cheapest(steps, data):
    places = np.concatenate([[0], np.cumsum(steps)])
    penalty = np.array(data.draw(some.lists(some.integers(0, 5), min_size=len(places), max_size=len(places))))

    def cost(path):
        return sum(12 - (b - a) for a, b in zip(path[:-1], path[1:-1])) + sum(penalty[np.searchsorted(places, path[1:])])

    best = [0] + [math.inf] * (len(places) - 1)
    for j in range(1, len(places)):
        best[j] = min(best[i] + 12 - (places[j] - places[i]) + penalty[j] for i in range(j) if places[j] - places[i] <= 12)
    last = len(places) - 1
    best[-1] = min(best[i] + penalty[last] for i in range(last) if places[last] - places[i] <= 12)
    cuts = packing.best_cuts(places, penalty, 12)
    assert all(b - a <= 12 for a, b in zip(cuts, cuts[1:])) and cost(cuts.tolist()) == best[-1]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(some.text(some.sampled_from("a1.@-+ ()0249_%é"), max_size=50))
def test_base_spans(text):
    assert pii.base_spans(text) == base(text)


def test_pii(spark, odd, none):
    got = pii.find_pii(odd).collect()
    assert len(got) == odd.count() and pii.find_pii(none).count() == 0
    mail = next(r for r in got if r["n_email"] == 1)
    assert mail["base_sha256"] == hashlib.sha256(mail["spans"].encode()).hexdigest() and mail["spans"].startswith("email:")
    assert sum(r["n_phone"] for r in got) == 1
    new = pii.redact_documents(odd)
    assert new.columns == odd.columns and new.count() == odd.count()
    assert any("<EMAIL>" in (r["text"] or "") for r in new.collect()) and not any("x.y@ex.com" in (r["text"] or "") for r in new.collect())


def test_pii_context(spark):
    """Where a context holds card numbers, a number of the same shape that fails the checksum is found there."""
    good = [f"Please use card number {n} today" for n in ("4539578763621486", "4716258050958645", "4929144317631246", "4485040993287616", "4532015112830366", "4556737586899855")]
    assert all(base(t) for t in good)
    rows = [(i, t, "a") for i, t in enumerate(good)] + [(90, "Please use card number 4539578763621487 today", "a"), (91, "We counted up 4539578763621487 today", "a")]
    got = {r["doc_id"]: r for r in pii.find_pii(shaped(spark, rows)).collect()}
    assert got[90]["spans"] == "card:23:39" and got[90]["n_card"] == 0 and got[91]["spans"] == ""
    rows += [(None, rows[-2][1], "a"), (None, rows[-1][1], "a"), (90, rows[-2][1], "a")]  # no id, and a repeated row
    got = collections.Counter((r["doc_id"], r["spans"]) for r in pii.find_pii(shaped(spark, rows)).collect() if r["doc_id"] in (90, None))
    assert got == {(90, "card:23:39"): 2, (None, "card:23:39"): 1, (None, ""): 1}
    texts = [r["text"] for r in pii.redact_documents(shaped(spark, rows)).collect() if r["doc_id"] is None]
    assert sorted(texts) == ["Please use card number <CARD> today", rows[7][1]]


def test_pii_unseen_forms(spark):
    """Forms that no base pattern has are found in known contexts, and contexts that such instances stand in are learnt."""
    say = lambda x: f"Please call our office number {x} today"
    ring = lambda x: f"You can ring us under {x} after noon"
    rows = [(i, say(f"+1 (743) 555-38{i}"), "a") for i in range(10, 18)]
    rows += [(i, say(f"(743) 555-38{i}"), "a") for i in range(20, 25)] + [(i + 10, ring(f"(743) 555-38{i}"), "a") for i in range(20, 25)]
    rows += [(40, ring("(212) 999 1234"), "a"), (41, say("10:30"), "a"), (42, "We had sold (743) 555-3899 of them", "a")]
    cards = ["4539 5787 6376 2148", "4716-2580-5095-8645"]
    rows += [(50 + i, f"Pay with the card number {n} soon", "a") for i, n in enumerate(("4539578763621486", "4716258050958645", "4929144317631246", "4485040993287616", "4532015112830366", "4556737586899855"))]
    rows += [(60, f"Pay with the card number {cards[0]} soon", "a")]
    rows += [(70 + i, f"write to me at jo{i}@ex.com please", "a") for i in range(6)] + [(80, "write to me at jo [at] ex dot com please", "a")]
    text = {d: t for d, t, _ in rows}
    assert all(not base(text[d]) for d in (*range(20, 25), *range(30, 35), 40, 41, 42, 60, 80))
    want = {**{d: "(743) 555-38%d" % d for d in range(20, 25)}, **{d + 10: "(743) 555-38%d" % d for d in range(20, 25)}, 40: "(212) 999 1234", 41: None, 42: None, 60: cards[0], 80: "jo [at] ex dot com"}
    got = {r["doc_id"]: r for r in pii.find_pii(shaped(spark, rows)).collect()}
    kind = lambda d: "card" if d == 60 else "email" if d == 80 else "phone"
    for d, x in want.items():
        at = text[d].index(x) if x else 0
        assert got[d]["spans"] == (f"{kind(d)}:{at}:{at + len(x)}" if x else ""), (d, got[d]["spans"])


def words5(text):
    w = re.sub("[A-Z]", lambda m: m.group().lower(), text).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    got = fingerprints.edited_fingerprints(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    assert len(got) == len(texts)
    errors = []
    for r in got:
        t, n = texts[r["doc_id"]], texts[after[r["doc_id"]]]
        m = len(t) // 3
        edited = t[: len(t) - m] + n[:m]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = words5(t), words5(edited)
        errors.append(abs(len(a & b) / len(a | b) - r["near_edited"]))
    assert np.mean(errors) < 0.04
    rows = fingerprints.edited_fingerprints(odd).collect()
    assert len(rows) == odd.count() and sum(r["doc_id"] is None for r in rows) == 1
    prints = {r["fingerprint"] for r in rows if r["doc_id"] == 4}
    assert len(prints) == 1
    assert fingerprints.edited_fingerprints(none).count() == 0
    only = fingerprints.edited_fingerprints(shaped(spark, [(3, "a b c d e f g", "a")])).collect()
    assert only[0]["near_next"] == 1.0


def test_lm_scores(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(shaped(spark, [(-1, None, "a"), (-2, " ", "a")]))
    for order in (2, 3):
        got = {r["doc_id"]: r for r in lm_scoring.backoff_scores(docs, order).collect()}
        texts = {r["doc_id"]: re.sub("[A-Z]", lambda m: m.group().lower(), r["text"] or "").split() for r in docs.collect()}
        counts = collections.Counter()
        for w in texts.values():
            for k in range(1, order + 1):
                counts.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        total = sum(map(len, texts.values()))
        for d, w in texts.items():
            want = 0.0
            for i in range(len(w)):
                factor = 0.0
                for k in range(min(order, i + 1), 0, -1):
                    gram = tuple(w[i - k + 1 : i + 1])
                    if k == 1:
                        want += factor + math.log(counts[gram] / total)
                    elif counts[gram] >= 2:
                        want += factor + math.log(counts[gram] / counts[gram[:-1]])
                        break
                    else:
                        factor += math.log(0.4)
            assert abs(got[d]["log_score"] - want) < 1e-6 * max(1, abs(want)) and got[d]["n_words"] == len(w)
    assert got[-1]["mean_log_score"] is None
    rows = lm_scoring.backoff_scores(odd).collect()
    assert len(rows) == odd.count() and [r["n_words"] for r in rows if r["doc_id"] is None] == [9]
    assert lm_scoring.backoff_scores(none).count() == 0


def test_lm_query_backs_off(spark, sf):
    """The registered query is trigrams of all texts; words whose n-grams stand once back off; SQL says the same."""
    out = queries.QUERIES["op1_lm_scoring"](spark, sf)
    rows = out.collect()
    assert actual(out) == expected(sf, queries.SQL["op1_lm_scoring"])
    assert 0 < sum(r["n_backoff"] for r in rows) < sum(r["n_words"] for r in rows)


def test_substring_query(spark, sf):
    got = queries.QUERIES["op2_substring_dedup"](spark, sf)
    assert actual(got) == expected(sf, queries.SQL["op2_substring_dedup"])


def test_substring_dedup(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in substring_dedup.repeated_spans(docs).collect()}
    seen = set()
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        spans = []
        for s, e, norm in substring_dedup.units(r["text"]):
            assert " ".join(r["text"][s:e].lower().split()) == norm
            if norm in seen:
                spans.append(f"{s}:{e}")
            seen.add(norm)
        assert got[r["doc_id"]]["spans"] == ",".join(spans)
    out = substring_dedup.repeated_spans(odd).collect()
    assert len(out) == odd.count()
    assert {r["spans"] for r in out if r["doc_id"] == 4} == {""} and sorted(r["chars_removed"] > 0 for r in out if r["doc_id"] == 5) == [False, True]
    assert substring_dedup.repeated_spans(none).count() == 0


def test_substring_rows(spark):
    """Rows of one doc_id lose the spans of their own text only; rows without id come last, each for itself."""
    one, two = "The first long sentence that stands in many texts.", "Another sentence of more than five words here."
    rows = [(1, one), (2, f"{one} Then short."), (2, two), (None, f"{two} {one}"), (None, "Only this row has these five words."), (None, "Only this row has these five words. And more of its own words."), (1, one)]
    docs = shaped(spark, [(d, t, "a") for d, t in rows]).selectExpr("*", "'x' AS row", "'y' AS whole")
    spans = substring_dedup.repeated_spans(docs)
    got = sorted(((r["doc_id"], r["text"], r["row"]) for r in substring_dedup.remove_repeats(docs, spans).collect()), key=str)
    texts = [t for _, t, _ in got]
    assert len(got) == len(rows) and all(x == "x" for _, _, x in got)
    assert texts.count(one) == 2 and texts.count(two) == 1 and texts.count("Then short.") == 1 and texts.count("") in (1, 2)
    assert sum(t.count("Only this row") for t in texts) == 1
    assert {r["n_units"] for r in spans.filter("doc_id = 1").collect()} == {1}


def test_next_without_ids(spark):
    """Rows without doc_id come after all others; every row has the next one of one order, whatever the ranges."""
    rows = [(i, f"text {i} " * (i % 5 + 3), "a") for i in range(50)] + [(None, f"no id {i} " * 4, "a") for i in range(60)]
    docs = shaped(spark, rows)
    edited = lambda t, n: hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest()
    got = fingerprints.edited_fingerprints(docs).collect()
    hashes = collections.Counter(r["edited_sha256"] for r in got)
    some = [t for d, t, _ in rows if d is None]
    of = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    order = [t for d, t, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])] + sorted(some, key=lambda t: -of[t])
    assert hashes == collections.Counter(edited(t, n) for t, n in zip(order, order[1:] + order[:1]))


def test_passage_anywhere(spark):
    passage = " ".join(f"This sentence number {i} of the shared passage has its own words." for i in range(6))
    docs = shaped(spark, [(1, f"Start here with something. {passage} The end of it.", "a"), (2, f"Other words open this one\nand {passage} Then more.", "a")])
    got = {r["doc_id"]: r for r in substring_dedup.repeated_spans(docs).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["chars_removed"] > 0.75 * len(passage)
    text = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(docs, substring_dedup.repeated_spans(docs)).collect()}
    assert len(text[2]) == len(docs.filter("doc_id = 2").first()["text"]) - got[2]["chars_removed"]
