"""Exact merge-type subword encoding by backtracking, and decoding.

The encoding of a text is the only sequence of pieces in which every two neighbours are compatible: merging their text
again, best score first, gives just these two. So from each place the longest piece is tried first (the longest ones
at all places come from one sweep of an Aho-Corasick automaton over the reversed text), then its shorter prefixes;
where none is compatible, the place is marked in a bitfield as failed and the piece before gives way. A prefix of a
text has one encoding at most, so a failed place is never entered twice and the work is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, slices

SPACE, NONE = "▁", -np.inf
KNOWN_WORDS, KNOWN_IDS, KNOWN_PAIRS, KNOWN_PARTS = 800_000, 8_000_000, 500_000, 400_000
LETTER = re.compile(r"[^\W\d_]")


def part_pattern(pieces: dict[str, int]) -> str:
    """Parts of a word that no piece reaches beyond: blanks with the letters or with the other signs after them.

    A word may be cut wherever no piece holds the two signs beside the cut. Letters that stand beside other signs in a
    piece count as such signs; a vocabulary whose pieces hold a blank after another sign leaves words whole.
    """
    pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:])}
    if any(b == SPACE != a for a, b in pairs):
        return "(?s:.+)"
    odd: set[str] = set()
    letter = lambda c: c not in odd and LETTER.match(c) is not None
    while more := {c for a, b in pairs if a != SPACE and letter(a) != letter(b) for c in (a, b) if letter(c)}:
        odd |= more
    own = (f"(?![{re.escape(''.join(sorted(odd)))}])" if odd else "") + LETTER.pattern
    return f"{SPACE}*(?:{own})+|{SPACE}*(?:(?!{SPACE}|{own})(?s:.))+|{SPACE}+"


class Pieces:
    """The vocabulary of a sentencepiece model of merge type with identity normalisation, encoded by our own code."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        own = spec.normalizer_spec
        kinds = {p.type for p in spec.pieces}
        # 1 normal, 2 unknown, 3 control, 6 byte
        if spec.trainer_spec.model_type != 2 or own.precompiled_charsmap or own.remove_extra_whitespaces or not spec.trainer_spec.byte_fallback or kinds - {1, 2, 3, 6}:
            raise ValueError(f"{path}: not a merge-type model with byte fallback, normal pieces and identity normalisation")
        self.prefix = SPACE if own.add_dummy_prefix else ""
        normal = [(i, p.piece, p.score) for i, p in enumerate(spec.pieces) if p.type == 1]
        self.id = {p: i for i, p, _ in normal}
        self.score = {p: s for _, p, s in normal}
        self.byte = {int(p.piece[3:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == 6}
        # What an id stands for: a text, or one byte as an int.
        self.means: list = [p.piece.replace(SPACE, " ") if p.type == 1 else int(p.piece[3:-1], 16) if p.type == 6 else spec.trainer_spec.unk_surface if p.type == 2 else "" for p in spec.pieces]
        self.rare = frozenset(i for i, p in enumerate(spec.pieces) if p.type != 1)
        # The bytes of an id; control and unknown ids have a byte that no text has, so texts with them are decoded one by one.
        self.bytes = [bytes([m]) if isinstance(m, int) else m.encode() if p.type == 1 else b"\xff" for m, p in zip(self.means, spec.pieces)]
        self.shorter = {p: next((n for n in range(len(p) - 1, 0, -1) if p[:n] in self.id), int(len(p) > 1)) for p in self.id}
        self.backward = ahocorasick.Automaton()
        for p in self.id:
            self.backward.add_word(p[::-1], len(p))
        self.backward.make_automaton()
        # No piece goes on with a blank after another sign, so a text falls apart before such blanks.
        apart = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if apart else "(?s:.+)").findall
        self.parts = re.compile(part_pattern(self.id)).findall
        self.known: dict[str, tuple[int, ...]] = {}  # ids of parts
        self.pairs: dict[str, dict[str, bool]] = {}  # left to right
        self.n_pairs = 0

    def marked(self, text: str) -> str:
        """The text as the model sees it: blanks visible, one in front; an empty text stays empty."""
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by the rule itself: the neighbours of the best score join, leftmost first."""
        parts, score = list(text), self.score.get
        scores = [score(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) != NONE:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], NONE)
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], NONE)
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether two pieces stay as they are beside each other, also kept in pairs; an empty left asks for the right one alone."""
        if self.n_pairs >= KNOWN_PAIRS:
            for rights in self.pairs.values():  # emptied, not replaced: split() holds one of them
                rights.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        known = self.pairs.setdefault(left, {})[right] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def split(self, word: str) -> list[str]:
        """The pieces of a word; a sign that is no piece stands for itself."""
        n = len(word)
        longest = bytearray(b"\1" * n)
        for end, size in self.backward.iter(word[::-1]):
            if size > longest[~end]:
                longest[~end] = size
        failed: bytearray | None = None
        out: list[str] = []
        pairs, shorter = self.pairs, self.shorter.get
        at, size, last = 0, longest[0] if n else 0, ""
        known = pairs.setdefault(last, {}).get
        while at < n:
            if size == 0:
                failed = failed or bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                size = shorter(last, 0)
                out.pop()
                at -= len(last)
                last = out[-1] if out else ""
                known = pairs.setdefault(last, {}).get
                continue
            end = at + size
            piece = word[at:end]
            fits = known(piece)
            if fits is None:
                fits = self.compatible(last, piece)
            if fits and not (failed and failed[end >> 3] >> (end & 7) & 1):
                out.append(piece)
                at, last = end, piece
                if at == n:
                    break
                size = longest[at]
                known = (pairs.get(last) or pairs.setdefault(last, {})).get
            else:
                size = shorter(piece, 0)
        return out

    def add_ids(self, word: str, out: list[int]) -> None:
        """Append the ids of a word, part by part; those of short parts are kept, as tuples: garbage collection passes over these."""
        known = self.known
        for part in self.parts(word):
            own = known.get(part)
            if own is None:
                found = list(map(self.id.get, pieces := self.split(part)))
                if None in found:
                    found = [i for piece, at in zip(pieces, found) for i in ([at] if at is not None else [self.byte[b] for b in piece.encode()])]
                own = tuple(found)
                if len(part) <= 32:
                    if len(known) >= KNOWN_PARTS:
                        known.clear()
                    known[part] = own
            out += own

    def ids(self, word: str) -> list[int]:
        out: list[int] = []
        self.add_ids(word, out)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for word in self.words(self.marked(text)) for i in self.ids(word)]

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: a blank in front goes, bytes become characters, those that can't U+FFFD each."""
        if ids and ids[0] not in self.rare:
            try:  # whole characters, as every encoded text has them: bytes and pieces in one go
                return b"".join(map(self.bytes.__getitem__, ids)).decode().removeprefix(" " if self.prefix else "")
            except UnicodeDecodeError:
                pass
        return self._decode_rare(ids)

    def _decode_rare(self, ids: list[int]) -> str:
        out, run, begun = [], bytearray(), not self.prefix
        for i in ids:
            m = self.means[i]
            if isinstance(m, int):
                run.append(m)
                continue
            if run:
                out.append(characters(run))
                run.clear()
                begun = True
            if not begun and m:
                m, begun = m.removeprefix(" ") if i not in self.rare else m, True
            out.append(m)
        return "".join(out) + characters(run)


def characters(run: bytearray) -> str:
    """Bytes as UTF-8; a byte that begins no whole character is one U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


class Codes(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        return code


class Lexicon:
    """Ids of words that are learnt once and kept in a table of bounded size; rows of words to flat ids."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], known: int = KNOWN_WORDS):
        self.learn, self.known = learn, known
        self._reset()

    def _reset(self) -> None:
        self.code = Codes()
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, flat, and row offsets."""
        if len(self.code) > self.known or len(self.flat) > KNOWN_IDS:
            self._reset()
        words = list(chain.from_iterable(rows))
        seen = len(self.code)
        codes = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        if len(self.code) > seen:
            new = list(islice(reversed(self.code), len(self.code) - seen))[::-1]
            ids, n = self.learn(new)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(n) - n])
            self.length = np.concatenate([self.length, n])
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        lengths = self.length[codes]
        ends = np.cumsum(lengths)
        at = np.repeat(self.start[codes] - (ends - lengths), lengths)
        at += np.arange(len(at))
        return self.flat[at], np.append(0, ends)[np.append(0, np.cumsum(sizes))]


def piece_lexicon(model: Pieces) -> Lexicon:
    def learn(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[int] = []
        ends = np.zeros(len(words), np.int64)
        for k, w in enumerate(words):
            model.add_ids(w, ids)
            ends[k] = len(ids)
        return np.array(ids, np.int32), np.diff(ends, prepend=0)

    return Lexicon(learn)


def piece_ids(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Per row: doc_id, ids (array<int>) and decoded text. One pass, no shuffle; a text is held whole in its task.

    Null and empty texts have no ids and decode to an empty text. Repeated rows give repeated results; other columns
    are ignored. A U+2581 in a text is a blank to the model, so it decodes as one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, rows, decoded in encoded(batches, model_path):
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(rows, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", docs[text].alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoded(batches: Iterator[pa.RecordBatch], model_path: str) -> Iterator[tuple[pa.Array, list[list[int]], list[str]]]:
    """doc_id, ids and decoded texts of batches (doc_id, text)."""
    model = Pieces(model_path)
    lexicon = piece_lexicon(model)
    for batch in slices(batches):
        ids, offsets = lexicon.ids([model.words(model.marked(t or "")) for t in batch.column(1).to_pylist()])
        rows = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
        yield batch.column(0), rows, list(map(model.decode, rows))


def piece_digests(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """piece_ids with digests in place of ids and text: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for doc_id, rows, decoded in encoded(batches, model_path):
            names = names or [str(i) for i in range(1 << 17)]
            own = [sha(",".join(map(names.__getitem__, row))) for row in rows]
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(map(len, rows), pa.int64()), pa.array(own, pa.string()), pa.array(map(sha, decoded), pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", docs[text].alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
