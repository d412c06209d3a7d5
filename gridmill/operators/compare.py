"""Comparison of results cell by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import new_path


def by_key(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: float = 0.001) -> DataFrame:
    """Per value column: cells compared, unmatched keys, the largest difference and whether it is within tolerance."""
    l = left.select(*keys, *[F.col(v).cast("double").alias(f"l_{v}") for v in values], F.lit(1).alias("_l"))
    r = right.select(*keys, *[F.col(v).cast("double").alias(f"r_{v}") for v in values], F.lit(1).alias("_r"))
    j = l.join(r, keys, "full")
    alone = F.count_if(F.col("_l").isNull() | F.col("_r").isNull())
    facts = F.array(*[
        F.struct(F.lit(v).alias("value"), F.count(F.lit(1)).alias("cells"), alone.alias("unmatched"), F.max(F.abs(F.col(f"l_{v}") - F.col(f"r_{v}"))).alias("max_difference")) for v in values
    ])
    df = j.agg(facts.alias("f")).select(F.explode("f").alias("x")).select("x.*")
    return df.withColumn("passes", (F.col("unmatched") == 0) & (F.coalesce("max_difference", F.lit(0.0)) <= tolerance))


def numbered(df: DataFrame, by: list[str | Column], name: str = "_n") -> DataFrame:
    """``df`` with one more column, its row numbers from 1 in the order of ``by``; rows that tie are in any order.

    Rows are dealt by ranges of ``by`` and written with the number of their range; the counts of the ranges before, a few rows, give what each range's own
    numbers start from.  So no task sorts more than a range; only rows that tie stay in one.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, "ranges")
    ranged = df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(path)
    dealt = spark.read.schema(ranged.schema).parquet(path)
    counts, starts, before = dict(dealt.groupBy("_range").count().collect()), [], 0
    for k in sorted(counts):
        starts.append((k, before))
        before += counts[k]
    first = spark.createDataFrame(starts, "_range int, _before long")  # a row a range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return dealt.withColumn("_own", own).join(F.broadcast(first), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


def ordered(left: DataFrame, right: DataFrame, by: list[str | Column], tolerance: float = 0.001) -> DataFrame:
    """Two ordered results row by row: rows of each, rows that differ, and whether they pass.

    Floats and decimals may differ by ``tolerance``; other values, nulls included, must be equal.
    """
    names = left.columns
    l = numbered(left, by).select("_n", *[F.col(c).alias(f"l_{c}") for c in names], F.lit(1).alias("_l"))
    r = numbered(right, by).select("_n", *[F.col(c).alias(f"r_{c}") for c in names], F.lit(1).alias("_r"))
    same = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    for c in names:
        a, b = F.col(f"l_{c}"), F.col(f"r_{c}")
        close = a.eqNullSafe(b)
        if left.schema[c].dataType.typeName() in ("double", "float", "decimal"):
            close = close | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
        same = same & close
    facts = l.join(r, "_n", "full").agg(F.count("_l").alias("rows_left"), F.count("_r").alias("rows_right"), F.count_if(~same).alias("differing"))
    return facts.withColumn("passes", F.col("differing") == 0)
