"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source of n_s documents and target weight w_s repeats each document at the mean rate total * w_s / n_s. A uniform
number from an MD5 of seed and doc_id is put through the inverse of the Poisson distribution of that rate, the
document is exploded by the count, and copies are spread over the output by a second hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

SEED = "mix-1"
TEMPERATURE = 0.5
TABLE_DOUBLES = 1 << 20  # distribution tables of at most so many numbers (8 MB) are broadcast
SALT_ROWS = 1_000_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _log_factorial(k: Column) -> Column:
    """Stirling's series for ln k!, from k = 100 on exact to double precision."""
    x = k + 1.0
    return (x - 0.5) * F.log(x) - x + 0.918938533204672742 + 1 / (12 * x) - 1 / (360 * x * x * x)


def poisson_table(rate: Column) -> Column:
    """struct(first, cdf): cumulative probabilities of the counts from first on, as far as doubles tell them apart."""
    wide = rate > 400.0
    first = F.when(wide, F.floor(rate - 12 * F.sqrt(rate))).otherwise(F.lit(0)).cast("long")
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("long")
    start = F.when(wide, F.exp(first.cast("double") * F.log(rate) - rate - _log_factorial(first.cast("double")))).otherwise(F.exp(-rate))
    zero = F.struct(start.alias("p"), F.array(start).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.struct(first.alias("first"), F.aggregate(F.sequence(first + 1, last), zero, step)["cdf"].alias("cdf"))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, total: float | None = None) -> DataFrame:
    """source_key, n, rate. weights: target weight by source (missing: 0); else size ** temperature. A null source is its own."""
    sizes = docs.groupBy(F.struct(F.col("source")).alias("source_key")).agg(F.count("*").alias("n"))
    if weights is not None:
        pairs = [F.lit(x) for s, w in weights.items() for x in (s, float(w))]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source_key.source")), F.lit(0.0)) if pairs else F.lit(0.0)
    else:
        weight = F.pow(F.col("n").cast("double"), F.lit(temperature))
    sizes = sizes.withColumn("w", weight)
    sums = sizes.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()  # two numbers
    goal = float(total) if total is not None else float(sums["n"] or 0)
    rate = F.lit(goal) * F.col("w") / F.lit(sums["w"]) / F.col("n") if sums["w"] else F.lit(0.0)
    return sizes.select("source_key", "n", rate.alias("rate"))


def replicate(docs: DataFrame, seed: str = SEED, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, total: float | None = None) -> DataFrame:
    """docs with n_copies and copy_no, each row repeated by its Poisson count and spread over the output at random.

    Rows of count 0 leave; that is the method. Equal doc_ids draw equal counts, rows without doc_id by a hash of the
    row; columns of docs named n_copies or
    copy_no are replaced. Null texts and sources are kept as they are; an empty table gives no rows. The tables of the
    sources are measured: up to TABLE_DOUBLES numbers they are broadcast and texts move once, in the global shuffle;
    beyond, rows meet them by source and a salt, of which there are as many as the largest source has SALT_ROWS rows.
    """
    columns = [c for c in docs.columns if c not in ("n_copies", "copy_no")]
    # Whole rows travel in one struct, so no column of theirs can meet a name used here.
    whole = docs.select(F.struct(*columns).alias("row"), "doc_id", F.struct("source").alias("source_key"))
    rates = source_rates(docs.select("source"), weights, temperature, total)
    tables = stage(rates.withColumn("table", poisson_table(F.col("rate"))))
    measured = tables.agg(F.sum(F.size("table.cdf") + 8).alias("size"), F.max("n").alias("most")).first()  # two numbers
    if (measured["size"] or 0) <= TABLE_DOUBLES:
        met = whole.join(F.broadcast(tables), "source_key")
    else:
        salts = -(-measured["most"] // SALT_ROWS)
        salted = tables.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = whole.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).join(salted, ["source_key", "salt"])
    own = F.coalesce("doc_id", F.xxhash64("row"))
    u = uniform(F.lit(seed), own.cast("string"))
    below = F.size(F.filter("table.cdf", lambda c: c < u)).cast("long")
    count = F.when(F.col("rate") <= 0, F.lit(0).cast("long")).otherwise(F.col("table.first") + below)
    drawn = met.select("row", own.alias("own"), count.alias("n_copies")).filter("n_copies > 0")
    copies = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), "n_copies")))
    placed = copies.withColumn("place", F.xxhash64(F.lit(seed), "own", "copy_no"))
    return placed.repartition("place").sortWithinPartitions("place").select("row.*", "n_copies", "copy_no")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return replicate(docs)


OP9_SQL = f"""
WITH s AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {TEMPERATURE}) AS w FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM s)::DOUBLE * w / (SELECT sum(w) FROM s) / n AS rate FROM s),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS j FROM r),
p AS (SELECT source, rate, j, exp(j * ln(rate) - rate - lgamma(j + 1.0)) AS p FROM k),
c AS (SELECT source, j, sum(p) OVER (PARTITION BY source ORDER BY j) AS cdf FROM p),
u AS (SELECT *, ('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT / pow(2.0, 52) AS u FROM documents),
n AS (SELECT u.*, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.cdf < u.u) AS n_copies FROM u)
SELECT doc_id, text, lang, source, n_chars, n_copies, unnest(range(1, n_copies + 1)) AS copy_no FROM n WHERE n_copies > 0
"""
