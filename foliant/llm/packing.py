"""Order-preserving packing of token streams by dynamic programming over window cuts.

A task strings its documents together in order. Cuts may fall at document ends (free), sentence ends and, only in
stretches without either that are longer than a sequence, at a grid of token places (each with a truncation penalty). The least sum of padding and
penalties over all ways to cut windows of at most CAPACITY tokens is found in one sweep: the best earlier cut is the
minimum of a sliding window, kept in a monotone queue. The last, open window moves on to the next block, so only a
partition's end leaves a partial window, which is cut into powers of two that need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import documents, slices
from .token_counts import CACHE_WORDS, END_WORD, Merger, Splitter

CAPACITY = 4096
END_ID = 2
BLOCK_TOKENS = 1 << 18
SENTENCE_PENALTY, INNER_PENALTY, GRID = 4, 10, 16


class Encoder:
    """Token ids of texts as the tokenizers library gives them: new words go through Merger, whose ids are the
    library's (tests compare them), and their ids are kept in a table of bounded size. Each different word of a batch
    is looked up once."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.split, self.merge = Splitter(spec), Merger(spec)
        vocab = spec["model"]["vocab"]
        self.ends_sentence = np.zeros(max([*vocab.values(), *self.split.special.values()]) + 1, bool)
        for token, i in vocab.items():
            bare = token.removesuffix("</w>")
            self.ends_sentence[i] = bare[:1] in ".!?" and bool(bare)
        self._reset()

    def _reset(self) -> None:
        fixed = {END_WORD: END_ID, **{" " + token: i for token, i in self.split.special.items()}}
        self.code = {w: c for c, w in enumerate(fixed)}
        self.flat = np.array(list(fixed.values()), np.uint32)
        self.length = np.ones(len(fixed), np.int64)
        self.start = np.arange(len(fixed))

    def _learn(self, words: list[str]) -> None:
        ids, n = self.merge.symbols(words)
        self.code.update(zip(words, range(len(self.code), len(self.code) + len(words))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(n) - n])
        self.length = np.concatenate([self.length, n])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, END_ID after each, and the row offsets."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        words, place, text_ends = self.split.table(texts)
        if len(self.code) > CACHE_WORDS:
            self._reset()
        codes = np.fromiter(map(self.code.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(codes < 0)
        codes[new] = len(self.code) + np.arange(len(new))
        self._learn([words[i] for i in new.tolist()])
        codes = codes[place]
        lengths = self.length[codes]
        ends = np.cumsum(lengths)
        at = np.repeat(self.start[codes] - (ends - lengths), lengths)
        at += np.arange(len(at))
        return self.flat[at], np.append(0, ends[text_ends])


def candidates(ids: np.ndarray, offsets: np.ndarray, ends_sentence: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, first and last included, and the penalty of each."""
    sentence = np.flatnonzero(ends_sentence[ids]) + 1
    places = np.union1d(sentence, offsets)
    gaps = np.flatnonzero(np.diff(places) > capacity)
    inner = [np.arange(places[g] + GRID, places[g + 1], GRID) for g in gaps]
    all_places = np.union1d(places, np.concatenate(inner)) if inner else places
    penalty = np.full(len(all_places), INNER_PENALTY)
    penalty[np.searchsorted(all_places, sentence)] = SENTENCE_PENALTY
    penalty[np.searchsorted(all_places, offsets)] = 0
    return all_places, penalty


def best_cuts(places: np.ndarray, penalty: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The cheapest chain of places from first to last with steps of at most capacity.

    cost[j] = min over i in reach of cost[i] + capacity - (p[j] - p[i]) + penalty[j]; cost[i] + p[i] is kept in a
    queue of rising values. The last step pays no padding: it stays open or is cut into powers of two.
    """
    p, pen = places.tolist(), penalty.tolist()
    key, back = [p[0]] + [0] * (len(p) - 1), [0] * len(p)
    queue = deque([0])
    for j in range(1, len(p)):
        low = p[j] - capacity
        while p[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        back[j] = i
        k = key[i] + capacity + pen[j]
        key[j] = k
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    reach = range(int(np.searchsorted(places, places[-1] - capacity)), len(p) - 1)
    if len(reach):
        back[-1] = min(reach, key=lambda i: key[i] - p[i])
    path = [len(p) - 1]
    while path[-1]:
        path.append(back[path[-1]])
    return places[path[::-1]]


def powers(length: int) -> list[int]:
    """Lengths that are powers of two and sum to length, falling."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


class Stream:
    """The documents that a task has read and not yet emitted."""

    def __init__(self, task: int, ends_sentence: np.ndarray):
        self.sequence = task << 40
        self.ends_sentence = ends_sentence
        self.ids, self.size = [], 0
        self.rows: list[tuple[np.ndarray, ...]] = []  # doc_id, whether it is null, start in its document, length here, tokens of the document

    def add(self, doc_ids: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> None:
        n = np.diff(offsets)
        self.ids.append(ids)
        missing = doc_ids.is_null().to_numpy(zero_copy_only=False)
        self.rows.append((doc_ids.fill_null(0).to_numpy(zero_copy_only=False), missing, np.zeros(len(n), np.int64), n, n))
        self.size += len(ids)

    def flush(self, last: bool) -> pa.RecordBatch | None:
        if not self.size:
            return None
        ids = np.concatenate(self.ids)
        doc, missing, base, here, total = (np.concatenate(c) for c in zip(*self.rows))
        offsets = np.concatenate([[0], np.cumsum(here)])
        cuts = best_cuts(*candidates(ids, offsets, self.ends_sentence))
        if last:
            cuts = np.concatenate([cuts[:-2], cuts[-2] + np.cumsum([0, *powers(int(cuts[-1] - cuts[-2]))])])
        elif len(cuts) > 2:
            cuts = cuts[:-1]
        limit = cuts[-1]
        bounds = np.union1d(cuts, offsets[offsets <= limit])
        s, e = bounds[:-1], bounds[1:]
        own = np.searchsorted(offsets, s, side="right") - 1
        window = np.searchsorted(cuts, s, side="right") - 1
        raw = ids.astype("<u4").tobytes()
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(s.tolist(), e.tolist())]
        numbers = [s - offsets[own] + base[own], e - s, np.array(crc, np.int64), total[own], self.sequence + window, s - cuts[window]]
        self.sequence += len(cuts) - 1
        k = int(np.searchsorted(offsets, limit, side="right")) - 1
        self.ids, self.size = [ids[limit:]], len(ids) - int(limit)
        rest = here[k:].copy()
        base = base[k:].copy()
        if len(rest):
            base[0] += limit - offsets[k]
            rest[0] -= limit - offsets[k]
        self.rows = [(doc[k:], missing[k:], base, rest, total[k:])]
        return pa.RecordBatch.from_arrays([pa.array(doc[own], pa.int64(), mask=missing[own]), *(pa.array(c.astype(np.int64)) for c in numbers)], NAMES)


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """One row per piece of a document in a sequence. One pass without a shuffle; each partition packs its own rows.

    Null and empty texts are the end id alone. Repeated rows are packed once each; a null
    doc_id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        stream = Stream(TaskContext.get().partitionId(), encoder.ends_sentence)
        for batch in slices(batches):
            ids, offsets = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            stream.add(batch.column(0), ids, offsets)
            if stream.size >= BLOCK_TOKENS:
                yield stream.flush(False)
        done = stream.flush(True)
        if done is not None:
            yield done

    return docs.select("doc_id", docs[text].alias("text")).mapInArrow(run, SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
