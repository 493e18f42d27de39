"""Piece encoding and the alignment of tokenizers against the libraries and plain loops."""

from __future__ import annotations

import collections
import gc
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as some
from tokenizers import Tokenizer

from foliant.llm import alignment, pieces, queries

MODEL, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
OTHER = Tokenizer.from_file(BYTES)
OTHER.encode_special_tokens = True
OWN, OWN_BYTES = pieces.Pieces(MODEL), alignment.ByteTokens(BYTES)
ALPHABET = "abcdeéüßIİΣσς'stllvedm \n\t\x85\x1c\x1f​0123½²Ⅷ一中🙂́!?.,<|>-_▁  Ж한ア\0  "


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(some.one_of(some.text(some.sampled_from(ALPHABET), max_size=60), some.text(some.sampled_from("aelnrst ▁"), max_size=80), some.text(max_size=30)))
def test_ids_are_the_libraries(text):
    text = text.encode("utf-8", "replace").decode()
    assert OWN.encode(text) == LIBRARY.encode(text)
    assert OWN.decode(OWN.encode(text)) == LIBRARY.decode(LIBRARY.encode(text))
    assert OWN_BYTES.encode([text])[0].tolist() == OTHER.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(some.lists(some.one_of(some.integers(0, 300), some.integers(0, 31999), some.sampled_from([0, 1, 2, 29871, 259, 198, 260])), max_size=10))
def test_any_ids_decode_as_the_library_does(ids):
    assert OWN.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", ["x" * 100_000, " " * 30_001, "the" * 20_000, "aaaaaaab" * 9_000, "中" * 20_000, "a b" * 30_000, "<|endoftext|></s><s>"])
def test_long_words(text):
    assert OWN.encode(text) == LIBRARY.encode(text)
    assert OWN_BYTES.encode([text])[0].tolist() == OTHER.encode(text, add_special_tokens=False).ids


def test_what_is_kept_costs_no_collections_and_is_bounded(monkeypatch):
    """Garbage collection has nothing to follow in the ids of parts; full tables are emptied in the middle of a word."""
    text = "The unusualness of reclassifications, 12345 straßenbahnhaltestellen and 🙂 zzyzx-qwrtp " * 3
    own = pieces.Pieces(MODEL)
    assert own.encode(text) == LIBRARY.encode(text) and own.known
    gc.collect()
    assert not any(map(gc.is_tracked, own.known.values()))
    monkeypatch.setattr(pieces, "KNOWN_PAIRS", 3)
    monkeypatch.setattr(pieces, "KNOWN_PARTS", 2)
    own = pieces.Pieces(MODEL)
    assert own.encode(text) == LIBRARY.encode(text)
    assert sum(map(len, own.pairs.values())) <= 3 and len(own.known) <= 2


def test_lexicon_learns_a_word_once():
    asked = []

    def learn(words):
        asked.extend(words)
        return np.array([len(w) for w in words]), np.ones(len(words), np.int64)

    lexicon = pieces.Lexicon(learn)
    for rows in ([["bb", "a", "bb"], [], ["ccc"]], [["a", "dddd"], ["bb"]]):
        ids, at = lexicon.ids(rows)
        assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [[len(w) for w in row] for row in rows]
    assert asked == ["bb", "a", "ccc", "dddd"]


def test_pieces_of_odd_rows(spark, odd, none):
    want = sorted((r["doc_id"] or 0, len(i := LIBRARY.encode(r["text"] or "")), sha(",".join(map(str, i))), sha(LIBRARY.decode(i))) for r in odd.collect())
    assert sorted((r[0] or 0, *r[1:]) for r in pieces.piece_digests(odd, MODEL).collect()) == want
    whole = pieces.piece_ids(odd, MODEL).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"]), sha(",".join(map(str, r["ids"]))), sha(r["decoded"])) for r in whole) == want
    assert pieces.piece_digests(none, MODEL).count() == 0


def test_pieces_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = sorted((r["doc_id"], len(i := LIBRARY.encode(r["text"] or "")), sha(",".join(map(str, i))), sha(LIBRARY.decode(i))) for r in docs)
    assert sorted(map(tuple, queries.QUERIES["op12_pieces"](spark, sf).collect())) == want


@settings(max_examples=50, deadline=None)
@given(some.sets(some.integers(0, 1 << 40), min_size=1, max_size=400), some.integers(1, 7))
def test_perfect_hash(keys, n):
    keys = np.array(sorted(keys), np.int64)
    rows = []
    for bucket in range(n):
        own = keys[alignment.bucket_of(keys, n) == bucket]
        if len(own):
            levels, bits, placed = alignment.perfect(own)
            rows.append({"bucket": bucket, "n": len(own), "levels": levels, "bits": np.packbits(bits).tobytes(), "keys": placed.tobytes()})
    slots = alignment.Slots(rows, n)
    assert sorted(slots(keys).tolist()) == list(range(len(keys))) and (slots.keys[slots(keys)] == keys).all()
    strange = np.setdiff1d(np.arange(1000), keys)
    assert (slots(strange) == -1).all()


def plain(rows):
    """Alignment by stepping through the bytes of each text."""
    b_bytes = [bytes([int(p[3:-1], 16)]) if LIBRARY.is_byte(i) else p.replace("▁", " ").encode() for i in range(LIBRARY.vocab_size()) for p in [LIBRARY.id_to_piece(i)]]
    links, out = [], []
    for r in rows:
        text = r["text"] or ""
        a, b, whole = [], [], b" " + text.encode()
        if text:
            a = [(i, len(OWN_BYTES.bytes[i])) for i in OTHER.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, len(b_bytes[i])) for i in LIBRARY.encode(text)]
            if b"".join(b_bytes[i] for i, _ in b) != whole or sum(n for _, n in a) != len(whole):
                a, b = [], []
        owner = [[k for k, (_, n) in enumerate(side) for _ in range(n)] for side in (a, b)]
        own = list(dict.fromkeys(zip(*owner)))
        links.append([(a[i][0], b[j][0]) for i, j in own])
        ends = [{sum(n for _, n in side[: k + 1]): k for k in range(len(side))} if len(side) < 300 else dict(zip(np.cumsum([n for _, n in side]).tolist(), range(len(side)))) for side in (a, b)]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            groups.append(",".join(str(x) for x, _ in a[i : ends[0][e] + 1]) + "|" + ",".join(str(x) for x, _ in b[j : ends[1][e] + 1]))
            i, j = ends[0][e] + 1, ends[1][e] + 1
        out.append([r["doc_id"], len(a), len(b), len(groups), len(own), sha(";".join(groups)) if groups else ""])
    count = collections.Counter(x for own in links for x in own)
    top: dict = {}
    for (_, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    return sorted(((*o[:5], sum(count[x] == top[x[1]] for x in own), sum(count[x] for x in own), o[5]) for o, own in zip(out, links)), key=str)


@pytest.mark.parametrize("at_once,bucket", [(1 << 21, 1 << 14), (64, 16), (1, 1 << 14)])
def test_alignment_of_odd_rows(spark, odd, at_once, bucket):
    more = odd.unionByName(odd.selectExpr("doc_id + 100 AS doc_id", "concat(text, ' ▁') AS text", *[c for c in odd.columns if c not in ("doc_id", "text")]))
    got = alignment.align_documents(more, BYTES, MODEL, at_once=at_once, bucket_pairs=bucket)
    assert sorted(map(tuple, got.collect()), key=str) == plain(more.select("doc_id", "text").collect())


def test_alignment_without_tokens(spark, odd, none):
    assert alignment.align_documents(none, BYTES, MODEL).count() == 0
    assert {tuple(r)[1:] for r in alignment.align_documents(odd.filter("text is null or text = ''"), BYTES, MODEL).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_alignment_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.QUERIES["op13_alignment"](spark, sf).collect()), key=str) == plain(docs)
