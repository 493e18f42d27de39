"""Substring dedup by hashing of lines and of the sentences inside them.

A unit is a sentence of a line, with shorter sentences before it joined to it, so that a unit's borders depend on its
own words alone and a passage is cut alike wherever it stands. Units are lower-cased, white space is collapsed and
digested to 128 bits. Over all documents the occurrence of the smallest doc_id, then of the smallest offset, stays;
the spans of the others are removed. Offsets are code points of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, stage

MIN_WORDS = 5
_SENTENCE_END = re.compile(r"[.!?]+(?:\s+|\Z)")


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised text) of the units of at least min_words words."""
    at = 0
    for line in text.split("\n"):
        start = at
        words: list[str] = []
        begin = 0
        for stop in [*(m.end() for m in _SENTENCE_END.finditer(line)), len(line)]:
            own = line[begin:stop].lower().split()
            words += own
            begin = stop
            if len(own) >= min_words:
                yield start, at + stop, " ".join(words)
                start, words = at + stop, []
        if len(words) >= min_words:
            yield start, at + len(line), " ".join(words)
        at += len(line) + 1


UNITS = "doc_id long, row long, of int, s int, e int, hi long, lo long, again boolean"


def row_of(text: str = "text") -> Column:
    """Tells the rows of one doc_id apart; repeated rows are equal."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def unit_digests(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per unit of docs (doc_id, text, row); of: units of the text; again: the same text holds it earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = [[] for _ in range(8)]
            for d, t, r in zip(*(batch.column(i).to_pylist() for i in range(3))):
                seen = set()
                found = list(units(t or "", min_words))
                for a, b, norm in found:
                    h = xxhash.xxh3_128_digest(norm)
                    values = d, r, len(found), a, b, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), h in seen
                    for column, x in zip(columns, values):
                        column.append(x)
                    seen.add(h)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [f.split()[0] for f in UNITS.split(", ")])

    return docs.mapInArrow(run, UNITS)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, row, n_units, n_removed, chars_removed, spans ("start:end" by start, comma-joined).

    Null, empty and short texts have no units. Rows of one doc_id count as one document: they don't remove each
    other's units, but each has the spans of its own text. Rows without doc_id come after all others, by a hash of
    their text, each for itself. Counting is an aggregation with map-side sums and the decision a join, so a line that
    a third of all documents holds is split by Spark's skew join and never gathered.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"), row_of(text).alias("row"))
    found = stage(unit_digests(docs, min_words))
    rest = F.when(F.col("doc_id").isNull(), F.col("row"))
    first = found.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.min(rest).alias("first_rest"), F.count("*").alias("n")).filter("n > 1")
    later = (F.col("doc_id") > F.col("first")) | F.col("doc_id").isNull() & (F.col("first").isNotNull() | (F.col("row") > F.col("first_rest")))
    gone = found.join(first, ["hi", "lo"]).filter(F.col("again") | later)
    gone = gone.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("gone"))
    counts = found.groupBy("doc_id", "row").agg(F.max("of").cast("long").alias("n_units"))
    out = _beside(_beside(docs.select("doc_id", "row"), counts), gone)
    spans = F.coalesce("gone", F.array().cast("array<struct<s:int,e:int>>"))
    size = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + (x["e"] - x["s"]))
    return out.select(
        "doc_id", "row", F.coalesce("n_units", F.lit(0)).alias("n_units"), F.size(spans).cast("long").alias("n_removed"),
        size.alias("chars_removed"), F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string"))), ",").alias("spans"),
    )


def _beside(rows: DataFrame, more: DataFrame) -> DataFrame:
    """rows with the other columns of more, one row per doc_id and row; a null doc_id meets a null one."""
    # The row hash comes first and alone decides the partition, so that null ids don't meet in one task.
    other = more.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), *more.columns[2:])
    return rows.join(other, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id", "_row")


def without_spans(text: str | None, spans: str | None) -> str | None:
    if not text or not spans:
        return text
    out, done = [], 0
    for s, e in (map(int, x.split(":")) for x in spans.split(",")):
        out.append(text[done:s])
        done = max(done, e)
    return "".join(out) + text[done:]


def remove_repeats(docs: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """docs with the spans of repeated_spans cut out of each row's text and kept in removed_spans, by original offsets."""

    @F.pandas_udf("string")
    def cut(texts, lists):
        return texts.combine(lists, without_spans)

    columns = [c for c in docs.columns if c != "removed_spans"]
    whole = docs.select(F.struct(*columns).alias("whole"), "doc_id", row_of(text).alias("row"))
    kept = spans.select("doc_id", "row", F.col("spans").alias("removed_spans")).dropDuplicates(["doc_id", "row"])
    joined = _beside(whole, kept).select("whole.*", "removed_spans")
    return joined.select(*[cut(text, "removed_spans").alias(c) if c == text else c for c in columns], "removed_spans")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir)).drop("row")


# Units by the definition above: sentences of a line, numbered; one of MIN_WORDS words or more ends a unit, what is left
# at the line's end is one if it has that many. The texts themselves stand for their digests. Python's white space and
# lower case beyond ASCII are taken from the Unicode classes that DuckDB knows.
OP2_SQL = f"""
WITH lines AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ln FROM documents),
placed AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_line,
 string_split(regexp_replace(line, '([.!?]+)([\\s\\pZ\\x0b\\x1c-\\x1f\\x85]+|$)', '\\1\\2' || chr(1), 'g'), chr(1)) AS cut FROM lines),
pieces AS (SELECT doc_id, ln, line, at_line, unnest(cut) AS piece, generate_subscripts(cut, 1) AS i FROM placed),
worded AS (SELECT *, trim(regexp_replace(lower(piece), '[\\s\\pZ\\x0b\\x1c-\\x1f\\x85]+', ' ', 'g')) AS words, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, ln ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pieces),
counted AS (SELECT *, CASE WHEN words = '' THEN 0 ELSE len(string_split(words, ' ')) END AS n FROM worded),
grouped AS (SELECT *, coalesce(sum((n >= {MIN_WORDS})::INT) OVER (PARTITION BY doc_id, ln ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit FROM counted),
units AS (SELECT doc_id, (min(at_line + before))::BIGINT AS s, (max(at_line + before + length(piece)))::BIGINT AS e, string_agg(words, ' ' ORDER BY i) FILTER (words <> '') AS norm FROM grouped GROUP BY doc_id, ln, unit HAVING sum(n) >= {MIN_WORDS}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, s) AS r FROM units),
gone AS (SELECT doc_id, count(*) AS n, sum(e - s)::BIGINT AS chars, string_agg(s || ':' || e, ',' ORDER BY s, e) AS spans FROM ranked WHERE r > 1 GROUP BY doc_id)
SELECT d.doc_id, coalesce(u.n, 0) AS n_units, coalesce(g.n, 0) AS n_removed, coalesce(g.chars, 0) AS chars_removed, coalesce(g.spans, '') AS spans
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM units GROUP BY doc_id) u USING (doc_id) LEFT JOIN gone g USING (doc_id)
"""
