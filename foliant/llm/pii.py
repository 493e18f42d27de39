"""Personal data: fixed patterns for seeds, then bootstrapped contextual extraction.

Seeds are the spans of four fixed patterns. The words beside a span are its lexical patterns, with its shape and
without; candidates are other words that hold digits or an at sign, runs of number words, and addresses with a
written-out at sign. A bipartite graph of patterns and instances is scored by turns: a pattern is worth the mean belief
of the instances it holds, an instance what its patterns support together, shapes are scored beside, and each round
adds the patterns that instances of high belief stand in. Confident patterns then mark the candidates they surround.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, stage

KINDS = ("email", "ip", "card", "phone")
# The four base patterns. Each is scanned in a form whose time is linear in the text.
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_HEAD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBERS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^ \xa0]+")
_CANDIDATE = re.compile(r"[0-9@]\S*+")  # the rest of a word; its beginning is found by stepping back
_EDGE = ".,;:!?()[]{}<>\"'"
_RUN = re.compile(r"(?<![^\s\"'\[<{,;:=])[+(]{0,2}[0-9*][0-9*().+/-]*+(?:[ \xa0]{1,2}(?:[-/.][ \xa0])?[+(]{0,2}[0-9*][0-9*().+/-]*+)++")
_AT = re.compile(
    r"(?:\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\s(?:at|@)\s)[a-z0-9-]++(?:(?:\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s)[a-z0-9-]++)++", re.I
)
_FOUR = re.compile(r"[0-9]{1,3}(?:(?:[.,:_ -]|[\[(](?:\.|dot)[\])])[0-9]{1,3}){3}(?::[0-9]{1,5}|/[0-9]{1,2})?")
_SIX = re.compile(r"(?=.*::|(?:[^:]*:){3})[0-9A-Fa-f:]{4,39}(?:/[0-9]{1,3})?")
RUN_WORDS = 6  # words of a part of a run of number words; the whole run is a candidate too


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start and then kind; code points, end exclusive."""
    out = []
    if "@" in text:
        done = 0
        for m in _EMAIL_TAIL.finditer(text):
            at = s = m.start()
            while s > done and text[s - 1] in _EMAIL_HEAD:
                s -= 1
            if s < at:
                done = m.end()
                out.append((s, 0, done))
    for m in _NUMBERS.finditer(text):
        parts = m.group().split(".")
        s = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            e = s + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                out.append((s, 1, e))
            s = e + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _DIGITS.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def shape(token: str) -> str:
    """A token with letters and digits of any value as one: what makes tokens of a kind look alike."""
    return re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", token))


def fits(token: str) -> int:
    """Bits of the kinds whose data a token can be, in whatever form: by what it is made of and how much of it; and,
    four bits higher, of those whose own check it meets too: parts up to 255, Luhn's sum where no digit is hidden, 9
    digits after a plus."""
    if len(token) > 128:
        return 0
    n = sum(c in "0123456789*" for c in token)
    plain = not any(c.isalpha() for c in token)
    at = "@" in token[1:-1] or _AT.search(token) is not None
    four, six = _FOUR.fullmatch(token), _SIX.fullmatch(token)
    card, phone = plain and not at and 12 <= n <= 19, plain and not at and 7 <= n <= 15
    can = at | bool(four or six) << 1 | card << 2 | phone << 3
    ip = six or four and all(int(p) <= 255 for p in re.findall("[0-9]+", token)[:4])
    card = card and ("*" in token or luhn(_DIGITS.sub("", token)))
    return can | (at | bool(ip) << 1 | card << 2 | (phone and (n >= 9 or token[0] != "+")) << 3) << 4


def value(token: str) -> int:
    """What is the same in all writings of an instance, as 64 bits: the digits, or the lower-cased token."""
    plain = token.lower() if any(c.isalpha() or c in "@*" for c in token) else _DIGITS.sub("", token)
    return int.from_bytes(hashlib.blake2b(plain.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of what may be an unseen instance and touches no base span."""
    starts, reach = [s for s, _, _ in spans], [0, *accumulate((e for _, _, e in spans), max)]
    free = lambda s, e: reach[bisect_left(starts, e)] <= s
    out = set()
    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        while s and not text[s - 1].isspace():
            s -= 1
        while s < e and text[s] in _EDGE:
            s += 1
        while e > s and text[e - 1] in _EDGE:
            e -= 1
        if s and text[s - 1] == "(" and e - s < 128 and text[s:e].count(")") > text[s:e].count("("):
            s -= 1
        if e - s >= 4 and free(s, e):
            out.add((s, e))
    for m in _RUN.finditer(text):
        words = [(w.start(), w.end()) for w in _WORD.finditer(text, *m.span())]
        parts = [(i, j) for i in range(len(words)) for j in range(i + 1, min(len(words), i + RUN_WORDS))] + [(0, len(words) - 1)]
        for i, j in parts:
            s, e = words[i][0], words[j][1]
            while e > s and text[e - 1] in ".,-/(+":
                e -= 1
            if e - s <= 128 and text[s] != "/" and free(s, e) and fits(text[s:e]):
                out.add((s, e))
    for m in _AT.finditer(text):
        s = at = m.start()
        while s and at - s < 64 and text[s - 1] in _EMAIL_HEAD:
            s -= 1
        if s < at and free(s, m.end()):
            out.add((s, m.end()))
    return sorted(out)


def word_class(word: str, left: bool) -> str:
    """What kind of word stands beside an instance; on its left, whether a mark ends it."""
    core = word.strip(_EDGE)
    own = "none" if not word else "mark" if not core else "number" if any(c.isdigit() for c in core) else "capital" if core[0].isupper() else "word"
    return own + "." if left and core and word[-1] in _EDGE else own


def context(text: str, s: int, e: int) -> tuple[str, str, str, str]:
    """Two words to the left and one to the right, lower-cased, digits as 0, without edge marks, and the classes of the
    nearest word on either side."""
    left, right = text[max(0, s - 60) : s].split()[-2:], text[e : e + 30].split()[:1]
    clean = lambda ws: re.sub(r"[0-9]+", "0", " ".join(w for w in (w.strip(_EDGE).lower() for w in ws) if w))
    return clean(left), clean(right), word_class(left[-1] if left else "", True), word_class(right[0] if right else "", False)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, row string, near array<struct<kind:int,s:int,e:int,token:string,value:long,fit:int,left:string,right:string,before:string,after:string>>"
_NEAR = pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("token", pa.string()), ("value", pa.int64()), ("fit", pa.int32()), ("left", pa.string()), ("right", pa.string()), ("before", pa.string()), ("after", pa.string())]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: base counts and spans, and every span and candidate with its context (kind -1: candidate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, bases, nears = [], [], []
            for t in batch.column(1).to_pylist():
                t = t or ""
                spans = base_spans(t)
                n = [0, 0, 0, 0]
                for _, k, _ in spans:
                    n[k] += 1
                near = [(k, s, e) for s, k, e in spans] + [(-1, s, e) for s, e in candidates(t, spans)]
                counts.append(n)
                bases.append(digest(spans))
                nears.append([
                    {"kind": k, "s": s, "e": e, "token": shape(t[s:e]), "value": value(t[s:e]), "fit": fits(t[s:e]) if k < 0 else 17 << k, "left": c[0], "right": c[1], "before": c[2], "after": c[3]}
                    for k, s, e in near for c in [context(t, s, e)]
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(bases, pa.string()), batch.column(2), pa.array(nears, _NEAR)],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "row", "near"],
            )

    return docs.select("doc_id", docs[text].alias("text"), row_key(text).alias("row")).mapInArrow(run, FOUND)


def row_key(text: str = "text") -> Column:
    """A digest of doc_id (null or not) and text: repeated rows are equal and get the same spans, others are apart."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))))


def discover(found: DataFrame, rounds: int = 3, least_support: int = 5, confidence: float = 0.9, least_shape: float = 0.5) -> DataFrame:
    """Unseen identifiers: rows (doc_id, row, kind, s, e).

    Patterns come in families of narrower and wider contexts: the two words to the left, with the right word or alone;
    the word to the left; each with the token's shape or without; and the class of the word on the left or the right
    (a word, a capitalised one, a number, a mark, none; whether a mark ends it) with the token's shape. One of two words
    holds the tokens of its shape or, without one, those that can be of its kind at all; the wider ones hold only what
    meets the kind's own check as well (fits). A base
    span supports its kind fully, a candidate as far as the patterns of the round before support its value anywhere;
    a shape is worth the mean belief of its members in known patterns (least_support trials in its favour before) and
    weighs what patterns without a shape say. Each round adds patterns that hold least_support base spans and
    candidates whose value has a belief of at least confidence; wider ones hold that many base spans. Patterns of fewer, or of a mean belief under
    confidence, mark nothing, nor do those without a shape where the shape's worth is under least_shape. Counts cover
    all documents. Of overlapping marks the longest stays, then the one of the highest belief.
    """
    spans = found.select("doc_id", "row", F.explode("near").alias("x")).select("doc_id", "row", "x.*")
    key = lambda *parts: F.concat_ws("\x1f", *parts)
    one = lambda name, shaped, *parts: F.struct(key(F.lit(name), *parts, *(["token"] if shaped else [])).alias("pattern"), F.lit(shaped).alias("keyed"), F.lit(name in "owv").alias("wide"))
    near = F.substring_index("left", " ", -1)
    worded, both = F.col("left") != "", (F.col("left") != "") & (F.col("right") != "")
    keys = F.array(
        *[F.when(worded, one("l", shaped, "left")) for shaped in (False, True)], *[F.when(worded, one("o", shaped, near)) for shaped in (False, True)],
        *[F.when(both, one("b", shaped, "left", "right")) for shaped in (False, True)], one("w", True, "before"), one("v", True, "after"),
    )
    based = spans.filter("kind >= 0").groupBy("token").count()
    able = spans.filter("kind >= 0 or fit > 0").unionByName(spans.filter("kind < 0 and fit = 0").join(based, "token", "left_semi").select(*spans.columns))
    held = able.select("doc_id", "row", "kind", "s", "e", "token", "value", "fit", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key"))
    held = stage(held.select(*held.columns[:-1], "key.*"))
    instance = ["doc_id", "row", "s", "e"]
    free = held.filter("kind < 0").drop("kind")
    holds = F.expr("CASE WHEN wide THEN (fit & shiftleft(16, k)) <> 0 ELSE keyed or (fit & shiftleft(1, k)) <> 0 END")
    seeds = stage(held.filter("kind >= 0").groupBy("pattern", "keyed", F.col("kind").alias("k")).agg(F.count("*").alias("hits")))
    shape_seeds = spans.filter("kind >= 0").groupBy("token", F.col("kind").alias("k")).agg(F.count("*").alias("n"))

    def best(support: DataFrame) -> DataFrame:
        """pattern, keyed, k, hits, seeds of the patterns of enough support; hits and seeds are base spans."""
        top = F.max(F.struct("support", "hits", "k"))
        out = support.groupBy("pattern", "keyed").agg(top.alias("top"), F.sum("hits").alias("seeds"))
        return out.filter(F.col("top.support") >= least_support).select("pattern", "keyed", "top.k", "top.hits", "seeds")

    patterns = best(seeds.withColumn("support", F.col("hits")))
    members = free.join(patterns.drop("keyed"), "pattern").filter(holds).groupBy("pattern").agg(F.count("*").alias("n"))
    others = F.when(F.col("keyed"), 0).otherwise(F.coalesce("n", F.lit(0)))
    scores = stage(patterns.join(members, "pattern", "left").withColumn("score", F.col("hits") / (F.col("seeds") + others)).drop("n"))
    shapes = None

    def edges() -> DataFrame:
        out = free.join(scores.select("pattern", "k", "score"), "pattern").filter(holds)
        out = out.withColumn("worth", F.lit(1.0)) if shapes is None else out.join(shapes, ["token", "k"], "left").withColumn("worth", F.coalesce("worth", F.lit(1.0)))
        return out.withColumn("weight", F.when(F.col("keyed"), F.col("score")).otherwise(F.col("score") * F.col("worth")))

    together = 1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("weight")))))
    for _ in range(rounds):
        belief = stage(edges().groupBy(*instance, "token", "value", "k").agg(together.alias("belief")))
        values = stage(belief.groupBy("value", "k").agg(F.max("belief").alias("belief")))
        worth = belief.groupBy("token", "k").agg(F.sum("belief").alias("b"), F.count("*").alias("n"))
        worth = worth.select("token", "k", "b", "n").unionByName(shape_seeds.select("token", "k", F.col("n").cast("double").alias("b"), "n"))
        worth = worth.groupBy("token", "k").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        every = worth.groupBy("token").agg(F.sum("n").alias("n"))
        shapes = stage(worth.drop("n").join(every, "token").select("token", "k", ((F.col("b") + least_support) / (F.col("n") + least_support)).alias("worth")))
        sure = free.filter("not wide").join(values.filter(F.col("belief") >= confidence).select("value", "k"), "value").filter(holds)
        sure = sure.groupBy("pattern", "keyed", "k").agg(F.count("*").alias("support"), F.lit(0).cast("long").alias("hits"))
        support = sure.unionByName(seeds.select("pattern", "keyed", "k", F.col("hits").alias("support"), "hits"))
        support = support.groupBy("pattern", "keyed", "k").agg(F.sum("support").alias("support"), F.sum("hits").alias("hits"))
        known = scores.select("pattern", "keyed", "k", "hits", "seeds")
        patterns = stage(known.unionByName(best(support).join(known.select("pattern"), "pattern", "left_anti").select(*known.columns)))
        mean = free.join(patterns.select("pattern", "k"), "pattern").filter(holds).join(values, ["value", "k"], "left")
        mean = mean.groupBy("pattern").agg(F.sum(F.coalesce("belief", F.lit(0.0))).alias("b"), F.count("*").alias("n"))
        score = (F.col("hits") + F.coalesce("b", F.lit(0.0))) / (F.col("seeds") + F.coalesce("n", F.lit(0)))
        scores = stage(patterns.join(mean, "pattern", "left").withColumn("score", score).select(*known.columns, "score"))
    chosen = edges().filter(F.col("score") >= confidence).filter(F.col("keyed") | (F.col("worth") >= least_shape))
    marks = chosen.groupBy(*instance, "k").agg(together.alias("belief")).groupBy(*instance).agg(F.max(F.struct("belief", "k")).alias("top"))
    mark = F.struct((F.col("s") - F.col("e")).alias("less"), (-F.col("top.belief")).alias("order"), "s", "e", F.col("top.k").alias("kind"))
    marks = marks.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(mark)).alias("all"))
    none = F.filter("all", lambda _: F.lit(False))
    apart = lambda held, x: ~F.exists(held, lambda h: (h["s"] < x["e"]) & (x["s"] < h["e"]))
    kept = F.aggregate("all", none, lambda held, x: F.when(apart(held, x), F.concat(held, F.array(x))).otherwise(held))
    return marks.select("doc_id", "row", F.explode(kept).alias("x")).select("doc_id", "row", "x.s", "x.e", "x.kind")


def find_pii(docs: DataFrame, text: str = "text", rounds: int = 3) -> DataFrame:
    """Base counts, their digest, and all spans of every row.

    Null texts are empty; repeated rows give repeated results; a document without data has an empty span list. The
    texts are read once; what goes on is spans and contexts.
    """
    found = stage(scan(docs, text))
    more = discover(found, rounds).groupBy("row").agg(F.collect_list(F.struct("s", "kind", "e")).alias("more"))
    own = F.transform(F.filter("near", lambda x: x["kind"] >= 0), lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e")))
    names = F.array(*[F.lit(k) for k in KINDS])
    both = F.array_sort(F.concat("own", F.coalesce("more", F.array().cast("array<struct<s:int,kind:int,e:int>>"))))
    text_of = F.transform(both, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string")))
    return (
        found.withColumn("own", own)
        .drop("near")
        .join(more, "row", "left")
        .select(
            "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"),
            F.array_join(text_of, ",").alias("spans"), F.size(F.coalesce("more", F.array())).cast("long").alias("n_discovered"),
        )
    )


def fresh(columns: list[str], name: str) -> str:
    """The name, with underscores in front until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with every span of find_pii replaced by <KIND>, overlapping spans as one; n_chars, if there, follows.

    Base spans are found again in the pass that rewrites the texts, so only the discovered ones, few, are joined.
    Null texts stay null; rows without spans stay as they are.
    """
    columns = docs.columns
    row, extra_ = (fresh(columns, name) for name in ("row", "more"))
    found = stage(scan(docs))
    more = discover(found).select(F.col("row").alias(row), F.struct("s", "kind", "e").alias(extra_))
    joined = docs.withColumn(row, row_key()).join(more.groupBy(row).agg(F.collect_list(extra_).alias(extra_)), row, "left")
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, extra = batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()
            new = []
            for t, m in zip(texts, extra):
                spans = base_spans(t or "") + [(x["s"], x["kind"], x["e"]) for x in m or ()]
                new.append(redacted(t, digest(sorted(spans))))
            out = {c: batch.column(i) for i, c in enumerate(columns)} | {"text": pa.array(new, batch.column(at).type)}
            if "n_chars" in columns:
                out["n_chars"] = pa.array([n if a is b else len(b) for n, a, b in zip(out["n_chars"].to_pylist(), texts, new)], out["n_chars"].type)
            yield pa.RecordBatch.from_arrays([out[c] for c in columns], columns)

    return joined.select(*[F.col(f"`{c}`") for c in columns], extra_).mapInArrow(run, docs.schema)


def redacted(text: str | None, spans: str | None) -> str | None:
    if not text or not spans:
        return text
    out, done = [], 0
    for kind, s, e in (x.split(":") for x in spans.split(",")):
        s, e = int(s), int(e)
        if s >= done:
            out += [text[done:s], f"<{kind.upper()}>"]
        done = max(done, e)
    return "".join(out) + text[done:]


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))
