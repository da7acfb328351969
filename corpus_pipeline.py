"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it back as the next one's docs, so a lost executor costs part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import decontaminate, jaccard_join, line_dedup, mixing, toxicity
from tallymark.llm.common import read, save, unused

#: SQL cannot express a fitted classifier or the random draws of the mix; tests hold the stages against brute force.
ORACLE_SQL = None


def _sized(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with n_chars brought up to date where there is one."""
    return docs.select(*[F.length("text").cast(like.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in like.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below one half."""
    machine = toxicity.train(docs, read(spark, sf_dir, "labels"))
    (name,) = unused(docs, "_toxicity")
    kept = toxicity.score(docs, machine, name).where(F.col(name) < 0.5)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that an earlier document or line has."""
    return _sized(line_dedup.dedup_lines(docs, min_words=line_dedup.ANY_WORDS), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs, shingle=5, percent=80)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words that occur in a benchmark item."""
    return _sized(decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many copies and words of each."""
    return mixing.take(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
