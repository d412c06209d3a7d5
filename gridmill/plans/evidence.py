"""What a physical plan shows: pushed filters, pruned partitions, columns that are read, and exchanges."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def evidence(df: DataFrame) -> dict:
    """Facts of the plan of ``df``, from its formatted explanation."""
    plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[-1]
    listed = lambda name: [x.strip() for part in re.findall(rf"{name}: \[(.*?)(?:\](?:,|\n|$)|\.\.\.)", plan) for x in re.split(r", (?![^()]*\))", part) if x.strip()]
    columns = sorted({c.split(":")[0] for part in re.findall(r"ReadSchema: struct<(.*?)>", plan) for c in part.split(",") if c})
    return {"pushed": listed("PushedFilters"), "partitions": listed("PartitionFilters"), "columns": columns, "exchanges": len(re.findall(r"\bExchange (?:hash|range|Single|RoundRobin)", plan))}


def report(named: dict[str, DataFrame]) -> DataFrame:
    """(query, filters_pushed, partitions_pruned, columns_read, exchanges) of each query."""
    rows = [(name, bool(e["pushed"]), bool(e["partitions"]), ",".join(e["columns"]), e["exchanges"]) for name, e in ((n, evidence(df)) for n, df in named.items())]
    spark = next(iter(named.values())).sparkSession
    return spark.createDataFrame(rows, "query string, filters_pushed boolean, partitions_pruned boolean, columns_read string, exchanges int")
