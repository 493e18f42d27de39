"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases and maps homoglyphs and digit substitutions to plain letters. The lexicon holds word beginnings
and whole words whose share of toxic documents is far above chance; exception phrases are word pairs in which a hit
was seen only in clean documents. The summed weights, normalised by length, go through a logistic curve. Lexicon and
curve are fitted on TRAIN_ROWS labelled rows at most, chosen by a hash of doc_id; every document is scored whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, stage

TRAIN_ROWS = 20_000
THRESHOLD = 0.7
SHORTEST, LONGEST = 3, 9
# Letters and signs that pass for a plain letter.
HOMOGLYPHS = {
    "a": "@4аαɑ", "b": "8ЬвƄ", "c": "сϲ¢", "d": "ԁɗ", "e": "3еεє€", "g": "9ɡ", "h": "һн", "i": "1!іι¡", "j": "јϳ",
    "k": "кκ", "l": "|ӏ", "m": "м", "n": "п", "o": "0оοσ", "p": "рρ", "q": "ԛ", "r": "г", "s": "5$ѕ", "t": "7тτ", "u": "υц",
    "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "2ʐ",
}
_FOLD = {ord(c): plain for plain, marks in HOMOGLYPHS.items() for c in marks.lower()}
_FOLD |= {ord(c): None for c in "​‌‍⁠﻿­"}
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in _FOLD) + "]")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        if re.search("[＀-￯]", text):
            text = unicodedata.normalize("NFKC", text).lower()
    return text.translate(_FOLD) if _ODD.search(text) else text


_SIGNS = "[" + re.escape("".join(sorted({chr(c) for c, plain in _FOLD.items() if plain and not chr(c).isalnum()}))) + "]++"
_TAIL, _HEAD = re.compile(f"(?<=[^\\W_]){_SIGNS}(?![^\\W_])"), re.compile(f"(?<![^\\W_]){_SIGNS}(?=[^\\W_])")
_CALL = re.compile(f"[!¡]++(?![^\\W_]|{_SIGNS})")


def forms(text: str) -> list[str]:
    """fold(text), and forms of the same length in which signs at the ends or beginnings of words stay punctuation."""
    text = text.lower()
    if not text.isascii() and re.search("[＀-￯]", text):
        text = unicodedata.normalize("NFKC", text).lower()
    blank = lambda m: "\ue000" * len(m.group())
    ends = dict.fromkeys((text, _CALL.sub(blank, text), _TAIL.sub(blank, text)))
    return list(dict.fromkeys(fold(y) for x in ends for y in (x, _HEAD.sub(blank, x))))


def features(folded: str) -> set[str]:
    """Word beginnings, and whole words marked by a final blank."""
    out = set()
    for w in set(_WORD.findall(folded)):
        if len(w) >= SHORTEST:
            out.update(w[:n] for n in range(SHORTEST, min(len(w), LONGEST) + 1))
            if len(w) <= 24:
                out.add(w + " ")
    return out


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)  # a beginning, or a whole word and a blank: its weight
    exceptions: frozenset[str] = frozenset()  # "word hit" and "hit word"
    curve: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def matcher(self) -> ahocorasick.Automaton | None:
        found: dict[str, list] = defaultdict(list)
        for entry, weight in self.lexicon.items():
            for form in {entry.rstrip(), entry.rstrip().replace("l", "i")}:  # 1 stands for i or l
                found[form].append((entry, entry.endswith(" "), weight))
        if not found:
            return None
        automaton = ahocorasick.Automaton()
        for form, entries in found.items():
            automaton.add_word(form, (len(form), entries))
        automaton.make_automaton()
        return automaton


def hits(folded: str, automaton: ahocorasick.Automaton | None) -> dict[int, tuple[str, float, int]]:
    """Start: (entry, weight, end) of the heaviest lexicon match at each word start."""
    out: dict[int, tuple[str, float, int]] = {}
    if automaton is None:
        return out
    size = len(folded)
    for last, (length, entries) in automaton.iter(folded):
        start = last - length + 1
        if start and folded[start - 1].isalnum():
            continue
        for entry, whole, weight in entries:
            if whole and last + 1 < size and folded[last + 1].isalnum():
                continue
            if start not in out or weight > out[start][1]:
                out[start] = (entry, weight, last + 1)
    return out


def phrases(folded: str, start: int, end: int) -> tuple[str, str]:
    """The hit's word with the word before it, and with the word after it."""
    while end < len(folded) and folded[end].isalnum():
        end += 1
    before = _WORD.findall(folded[max(0, start - 40) : start])[-1:]
    after = _WORD.findall(folded[end : end + 40])[:1]
    word = folded[start:end]
    return (f"{before[0]} {word}" if before else ""), (f"{word} {after[0]}" if after else "")


def evidence(folded: str, model: Model, automaton: ahocorasick.Automaton | None, *others: str) -> tuple[float, float]:
    """Summed weight of hits outside exception phrases, plain and normalised by the root of the length in words.

    A hit in one of the other forms counts where no form before has one.
    """
    total = 0.0
    taken: set[int] = set()
    for form in (folded, *others):
        found = [x for x in hits(form, automaton).items() if not others or taken.isdisjoint(range(x[0], x[1][2]))]
        for start, (_, weight, end) in found:
            taken.update(range(start, end) if others else ())
            if model.exceptions and not model.exceptions.isdisjoint(phrases(form, start, end)):
                continue
            total += weight
    return math.log1p(total), math.log1p(10 * total / math.sqrt(1 + len(folded) / 6))


def _labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """At most rows training rows, chosen by a hash of doc_id, equal texts as one (toxic if any is)."""
    own = labels.filter("toxic is not null and doc_id is not null")
    own = own.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # The labels to join number TRAIN_ROWS at most: a bounded broadcast.
    return text.join(F.broadcast(own), "doc_id").groupBy("text").agg((F.max("toxic") > 0).cast("int").alias("toxic"))


def _count(train: DataFrame, toxic: int, only: frozenset | None = None) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bag: Counter = Counter()
        for pdf in frames:
            for t in pdf["text"]:
                f = set().union(*map(features, forms(t)))
                bag.update(f if only is None else f & only)
        yield pd.DataFrame({"feature": list(bag), "n": list(bag.values())})

    counted = train.filter(F.col("toxic") == toxic).select("text").mapInPandas(run, "feature string, n long")
    return counted.groupBy("feature").agg(F.sum("n").alias("n"))


def choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, tried: int) -> dict[str, float]:
    """Lexicon entries: purity of 0.7 or more, and less than 0.01 chance finds expected among all features tried."""
    base = n_toxic / max(1, n_toxic + n_clean)
    kept = {}
    for f, k in toxic.items():
        c = clean.get(f, 0)
        p = k / (k + c)
        if p < 0.7 or p <= base:
            continue
        kl = p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0)
        if math.log(max(tried, 1)) - (k + c) * kl < math.log(0.01):
            kept[f] = p
    # The longest form that keeps the support stands for its beginnings ...
    longer: dict[str, list[str]] = defaultdict(list)
    for g in kept:
        for n in range(SHORTEST, len(g)):
            longer[g[:n]].append(g)
    forms = {f for f in kept if not any(toxic[g] >= 0.95 * toxic[f] for g in longer[f])}
    # ... and a beginning as pure as its longer forms stands for them.
    out = {}
    for f in sorted(forms, key=len):
        heads = [f[:n] for n in range(SHORTEST, len(f)) if f[:n] in out]
        if not any(kept[h] >= kept[f] - 0.02 for h in heads):
            k, c = toxic[f], clean.get(f, 0)
            out[f] = math.log((k + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Newton's method for a ridge logistic regression; the last column is the constant."""
    w = np.zeros(x.shape[1])
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(h, x.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, exceptions: tuple[str, ...] = ()) -> Model:
    """Learn lexicon, exception phrases and curve. What reaches the driver comes from the bounded training rows."""
    train = stage(_labelled(docs, labels, rows))
    n = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:  # nothing to learn from: every text gets the base rate
        rate = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
        return Model({}, frozenset(exceptions), (math.log(rate / (1 - rate)) if n else -3.0, 0.0, 0.0))
    counted = stage(_count(train, 1))
    tried = counted.count()
    toxic = {r["feature"]: r["n"] for r in counted.filter("n >= 4").collect()}
    clean = {r["feature"]: r["n"] for r in _count(train, 0, frozenset(toxic)).collect()}
    model = Model(choose(toxic, clean, n_toxic, n_clean, tried), frozenset(exceptions))

    def seen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = model.matcher()
        for pdf in frames:
            rows = []
            for t, y in zip(pdf["text"], pdf["toxic"]):
                found = {p for f in forms(t) for s, (_, _, e) in hits(f, automaton).items() for p in phrases(f, s, e) if p}
                rows += [(p, int(y)) for p in found]
            yield pd.DataFrame(rows, columns=["phrase", "toxic"])

    pairs = train.mapInPandas(seen, "phrase string, toxic int").groupBy("phrase")
    pairs = pairs.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).filter("bad = 0 and n >= 4")
    model.exceptions |= {r["phrase"] for r in pairs.collect()}

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = model.matcher()
        for pdf in frames:
            got = [evidence(f[0], model, automaton, *f[1:]) for f in map(forms, pdf["text"])]
            yield pd.DataFrame(got, columns=["a", "b"]).assign(y=pdf["toxic"].to_numpy())

    data = train.mapInPandas(measured, "a double, b double, y int").toPandas().sort_values(["a", "b", "y"])  # TRAIN_ROWS rows at most
    x = np.column_stack([data["a"], data["b"], np.ones(len(data))])
    a, b, c = logistic(x, data["y"].to_numpy(float))
    model.curve = (float(c), float(a), float(b))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row, one pass. Null and empty texts score as texts without a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.matcher()
        c, a, b = model.curve
        for batch in slices(batches):
            out = []
            for t in batch.column(1).to_pylist():
                whole, *others = forms(t or "")
                x, y = evidence(whole, model, automaton, *others)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, c + a * x + b * y)))))
            s = pa.array(out, pa.float64())
            flag = pa.array([int(v >= THRESHOLD) for v in out], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), s, flag], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", docs[text].alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text scores under the threshold, in one pass; all columns stay as they are."""
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.matcher()
        c, a, b = model.curve
        for batch in slices(batches):
            keep = []
            for t in batch.column(at).to_pylist():
                whole, *others = forms(t or "")
                x, y = evidence(whole, model, automaton, *others)
                keep.append(1 / (1 + math.exp(-max(-30.0, min(30.0, c + a * x + b * y)))) < THRESHOLD)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
