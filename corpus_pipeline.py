"""A corpus from ``documents``: toxic ones go, one of each near-copy group stays, benchmark
passages go, sources are mixed to their targets, and what is left is written as token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runledger.llm import decontam, mixing, ngram_join, token_grammar, toxicity
from runledger.llm.common import drop_path, new_path, table
from runledger.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts stay, unless no labels were given and the curve's base is above it."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more."""
    return ngram_join.one_per_group(docs, 5, 80, 100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of sources without words go, for they are taken 0 times; null source is one of its own."""
    return mixing.mixed(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null text is empty and gives its end id only; rows without doc_id come first."""
    return token_grammar.token_table(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("token_ids", write_token_ids),
]

#: Learned scores, hashes and token ids: tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table goes once the next one is written; the last stage writes its own."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, name)
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before is not None:
            drop_path(spark, before)
        before = path
    return docs
