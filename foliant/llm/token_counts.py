"""Token counts by rank-synchronous merging of ragged numpy arrays.

A batch's texts are cut into pre-tokens together, and each different one is looked up once. New ones become one flat
array of symbol ids with row offsets. In every step each sequence finds its
lowest-rank adjacent pair and applies it at all places at once; the sequences advance together until none has a
known pair. What survives is counted.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import documents, slices

OVER_LIMIT = 2048
CACHE_WORDS = 400_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
# White space as the tokenizer's regular expressions see it: the Unicode White_Space property.
WHITE = r"\t-\r\x20\x85\xa0  -     　"


# Texts of these characters alone are split by the standard library, whose classes agree with the pattern's there:
# letters, decimal digits and signs up to U+024F without the superscript digits and fractions.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]").search
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+").findall
# The same split for whole batches: what each character of such texts is. MARK, which none of them holds, ends a text.
MARK = "\x1c"
GAP, SIGN, ALONE, LETTER = range(4)


def _kind(c: str) -> int:
    return ALONE if c == MARK or re.match(r"\d", c) else GAP if c.isspace() else LETTER if re.match(r"[^\W_]", c) else SIGN


_KIND = np.array([_kind(chr(c)) for c in range(0x250)], np.uint8)
END_WORD = " "  # stands for the end of a text; a special string stands behind a blank, which no pre-token holds


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte value, by the public byte-level rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return [table[b] for b in range(256)]


class Splitter:
    """Text to pre-tokens and special ids: special strings first, then NFC, lower case and the split pattern."""

    def __init__(self, spec: dict):
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._words = regex.compile(pattern.replace(r"[^\s", "[^" + WHITE), regex.V0).findall

    def words(self, text: str) -> list[str]:
        return self._words(text) if _UNUSUAL(text) else _PLAIN_WORDS(text)

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def pieces(self, text: str) -> Iterator[tuple[list[str], str | None]]:
        """Runs of pre-tokens, each followed by the special string that ended it (None at the end)."""
        if self.cut is None or "<|" not in text:
            yield self.words(self.normal(text)), None
            return
        parts = self.cut.split(text)
        for k in range(0, len(parts), 2):
            yield self.words(self.normal(parts[k])), parts[k + 1] if k + 1 < len(parts) else None

    @staticmethod
    def plain(texts: list[str]) -> pa.Array:
        """The pre-tokens of normal texts without unusual characters, END_WORD after each text's."""
        chars = np.frombuffer((MARK.join(texts) + MARK).encode("utf-32-le"), np.uint32)
        kind = _KIND[chars]
        first = np.append(True, kind[1:] != kind[:-1]) | (kind == ALONE)
        quote = np.flatnonzero(chars == ord("'"))
        quote = quote[first[quote] & (kind[quote + 1] == LETTER)]
        a, b = chars[quote + 1], chars[np.minimum(quote + 2, len(chars) - 1)]
        one = quote[np.isin(a, [*map(ord, "stmd")])]
        two = quote[np.isin(a, [*map(ord, "rv")]) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]
        first[one + 1] = first[two + 1] = False
        first[one + 2] = first[two + 3] = True
        inside = kind != GAP
        chars, starts = chars[inside], np.flatnonzero(first[inside])
        chars[chars == ord(MARK)] = ord(END_WORD)
        data = chars.tobytes().decode("utf-32-le").encode()
        if len(data) > len(chars):  # two bytes each from U+0080 on
            starts = starts + np.append(0, np.cumsum(chars >= 0x80))[starts]
        offsets = np.append(starts, len(data)).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))

    def table(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different words of texts, the place there of every word in order, and where each text ends among those.

        END_WORD follows the words of every text.
        """
        plain, others, of_plain, of_others = [], [], [], []
        for i, text in enumerate(texts):
            normal = self.normal(text)
            if "<|" not in text and not _UNUSUAL(normal):
                plain.append(normal)
                of_plain.append(i)
                continue
            for words, special in self.pieces(text):
                others += words
                if special is not None:
                    others.append(" " + special)
            others.append(END_WORD)
            of_others.append(i)
        parts = [self.plain(plain)] if plain else []
        if others:
            parts.append(pa.array(others, pa.large_string()))
        coded = pa.concat_arrays(parts).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = coded.indices.to_numpy()
        last = words.index(END_WORD)
        if plain and others:
            end = place == last
            text_of = np.array(of_plain + of_others)[np.cumsum(end) - end]
            place = place[np.argsort(text_of, kind="stable")]
        return words, place, np.flatnonzero(place == last)


class Merger:
    """Counts the symbols that byte-pair merging leaves of each word."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        chars = byte_symbols()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        size = max(vocab.values()) + 1
        self.size = size
        keys, made = [], []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            keys.append(vocab[a] * size + vocab[b])
            made.append(vocab[a + b])
        self.made = np.array(made, np.int64)
        self._hash(np.array(keys, np.int64))

    def _hash(self, keys: np.ndarray) -> None:
        """Places of the pairs in a table with linear probing, at most a quarter full; the rank is the pair's number."""
        self.shift = np.uint64(64 - len(keys).bit_length() - 2)
        size = 1 << (len(keys).bit_length() + 2)
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, len(keys), np.int32)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            settled = self.keys[at[left]] == keys[left]
            self.ranks[at[left[settled]]] = left[settled]
            left = left[~settled]
            at[left] = (at[left] + 1) % size

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _SPREAD >> self.shift).view(np.int64)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbol ids of all words, flat, and the number of each word's symbols."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        flat = self.inner[data]
        ends = np.cumsum(lengths)
        flat[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(raw)), lengths)
        none = len(self.made)
        done_ids, done_owner = [], []
        rank = np.append(self._rank(flat[:-1], flat[1:]), none)
        rank[ends - 1] = none
        while len(flat):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, starts)
            best = np.repeat(least, np.diff(np.append(starts, len(flat))))
            if (least == none).any():
                settled = best == none
                done_ids.append(flat[settled])
                done_owner.append(owner[settled])
                flat, owner, rank, best = flat[~settled], owner[~settled], rank[~settled], best[~settled]
                if not len(flat):
                    break
            hit = np.flatnonzero(rank == best)
            # Of overlapping hits (a a a) every second one of a run counts, from the left.
            first = np.append(True, np.diff(hit) != 1)
            run = np.flatnonzero(first)
            hit = hit[(np.arange(len(hit)) - run[np.cumsum(first) - 1]) % 2 == 0]
            flat[hit] = self.made[best[hit]]
            keep = np.ones(len(flat), bool)
            keep[hit + 1] = False
            # The pairs on both sides of a merged symbol are new; all others keep their rank.
            place = np.cumsum(keep) - 1
            flat, owner, rank = flat[keep], owner[keep], rank[keep]
            now = place[hit]
            changed = np.concatenate([now, now[now > 0] - 1])
            inside = changed[changed < len(flat) - 1]
            inside = inside[owner[inside] == owner[inside + 1]]
            rank[changed] = none
            rank[inside] = self._rank(flat[inside], flat[inside + 1])
        ids, own = np.concatenate(done_ids), np.concatenate(done_owner)
        return ids[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(words))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; one beyond the last where it is no merge."""
        keys = left * self.size + right
        at = self._place(keys)
        seen = self.keys[at]
        other = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(other):
            at[other] = (at[other] + 1) % len(self.keys)
            seen[other] = self.keys[at[other]]
            other = other[(seen[other] != keys[other]) & (seen[other] >= 0)]
        return np.where(seen == keys, self.ranks[at], len(self.made))


class Counter49k:
    """Token counts of texts; the counts of words seen before are kept in a table of bounded size."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.split, self.merge = Splitter(spec), Merger(spec)
        self._reset()

    def _reset(self) -> None:
        self.known = {END_WORD: 0, **{" " + token: 1 for token in self.split.special}}

    def counts(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0, np.int64)
        words, place, ends = self.split.table(texts)
        if len(self.known) > CACHE_WORDS:
            self._reset()
        n = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(n < 0)
        names = [words[i] for i in new.tolist()]
        n[new] = self.merge.symbols(names)[1]
        self.known.update(zip(names, n[new].tolist()))
        return np.diff(np.cumsum(n[place])[ends], prepend=0)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = OVER_LIMIT, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit, over the whole text. One pass, no shuffle.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated results; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter49k(tokenizer_path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = counter.counts(texts)
            size = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", docs[text].alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
