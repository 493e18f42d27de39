"""The corpus pipeline: toxicity, near duplicates, personal data, mixing and packing, in this order.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; all but
the last return the columns of documents. run() writes each stage's result as Parquet into the shared folder and
reads it again, so a lost executor costs one stage at most. A stage decides by its own input alone.

SQL can't express the learned lexicon, the bootstrapped patterns or the tokenizer, so ORACLE_SQL is None and
tests/llm/test_pipeline.py compares every stage with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import jaccard_join, mixing, packing, pii, toxicity
from foliant.llm.common import drop_staged, stage, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of five-word-shingle Jaccard >= 0.8 connect, one row of the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by its kind; n_chars follows the text."""
    return pii.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson counts, so that sources approach the target weights."""
    return mixing.replicate(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    first = staged()
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
        drop_staged(spark, first, staged() - 1)  # what the stage read and wrote on its way; its result stays
    return docs
