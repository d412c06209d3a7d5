"""A training corpus from raw documents: each stage is one operator on all that its predecessor kept.

Defined cases, by stage.  All: an empty table gives an empty result with the stage's columns, and columns besides ``doc_id`` and ``text`` pass
through whatever they are called.
quality_rules: null and empty texts, and all under 20 words, fail the base rules and go; repeated rows get one verdict.
exact_dedup: of equal texts the row with the smallest id stays, rows without id last; of rows with equal id and text one stays.
near_dedup: the same order among near copies; of rows with equal id and text one stays, and texts without words all stay.
secrets: no row goes; a null text stays null, and ``n_chars``, if there is one, follows a text that changes.
packing: a null text is one piece that holds the end alone; rows without id and repeated rows are packed like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm._common import fresh, vocabulary, written
from gridmill.llm.exact_dedup import drop_exact_duplicates
from gridmill.llm.near_dedup import drop_near_duplicates
from gridmill.llm.packing import pack
from gridmill.llm.quality_rules import quality_rules
from gridmill.llm.secrets import scan


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    The verdicts are written first: a filter on them would be pushed below the projections that make
    them, and the optimizer would repeat every shared expression there.
    """
    marked, verdict = quality_rules(docs), fresh("_kept", docs)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    judged = written(marked.select(*columns, F.col(f"`{marked.columns[-1]}`.kept").alias(verdict)))
    return judged.where(verdict).select(*columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8."""
    return drop_near_duplicates(docs, words=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in the text replaced and n_chars brought up to date."""
    clean = scan(docs, redact=True)
    if "n_chars" not in docs.columns:
        return clean.select(*[F.col(f"`{c}`") for c in docs.columns])
    found = F.size(F.col(f"`{clean.columns[-1]}`.found")) > 0
    n_chars = F.when(found, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return clean.select(*[n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 4096 tokens."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("secrets", secrets), ("packing", packing)]

#: The quality rules and later stages hash and search; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
