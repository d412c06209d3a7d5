"""Exact duplicates by a tree merge of sorted digest runs.

Every row gets a digest of its normalised text and belongs to one of ``runs`` leaf runs, at least 64 and more for a large table.  A leaf run
holds each digest once, with the smallest id seen and the number of copies.  The runs are then merged
``fan_in`` at a time, in rounds, until one run is left; a merge keeps, for every digest, the smallest
identifier and adds up the copies.  Entries count as equal only if digest *and* length in code points agree.
Each round is a grouped aggregate keyed by (parent run, digest), so Spark combines on the map side,
sorts the runs it exchanges and spreads a round over all tasks.  A text with any number of copies has
at most one entry for each run.  Going back down, rows meet the decision by (leaf run, digest),
so a hot text is dealt to as many tasks as there are runs.

Defined cases: a null text equals the empty text.  A null id sorts after all ids, so it stays only if
no copy has an id.  Of repeated rows with the same id and text one stays.  An empty table gives an empty
result.  Other columns are never touched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, fresh, text_or_empty, written

RUNS, FAN_IN = 64, 8
RUN_ROWS = 5_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def _digests(id_col: str, text_col: str) -> list[Column]:
    row = F.monotonically_increasing_id()
    text = normalised(text_or_empty(text_col))
    return [
        F.col(id_col).alias("_id"),
        row.alias("_row"),
        F.unhex(F.sha2(text, 256)).alias("_sha"),
        F.length(text).alias("_len"),
    ]


def _dealt(rows: DataFrame, runs: int, fan_in: int) -> tuple[DataFrame, int]:
    """Digest rows with their leaf run, and how many runs there are: a level more whenever a run would get over ``RUN_ROWS`` rows."""
    n = rows.count()
    while n > runs * RUN_ROWS:
        runs *= fan_in
    return rows.withColumn("_run", F.pmod(F.xxhash64("_row"), F.lit(runs)).cast("int")), runs


def merge_runs(rows: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """(leaf entries, root entries) of the merge tree over digest rows."""
    least = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    leaves = rows.groupBy("_run", "_sha", "_len").agg(F.min(least).alias("_keep"), F.count(F.lit(1)).alias("_n"))
    level, left = leaves, runs
    while left > 1:
        parent = F.floor(F.col("_run") / fan_in).cast("int").alias("_run")
        level = level.groupBy(parent, "_sha", "_len").agg(F.min("_keep").alias("_keep"), F.sum("_n").alias("_n"))
        left = -(-left // fan_in)
    return leaves, level.drop("_run")


def _decided(rows: DataFrame, runs: int, fan_in: int) -> DataFrame:
    leaves, root = merge_runs(rows, runs, fan_in)
    down = leaves.select("_run", "_sha", "_len").join(root, ["_sha", "_len"])
    return rows.join(down, ["_run", "_sha", "_len"]).select(
        "_id", "_row", "_sha", F.col("_keep.id").alias("_keep_id"), F.col("_n"), (F.col("_row") == F.col("_keep.row")).alias("_kept")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    rows, runs = _dealt(written(docs.select(*_digests(id_col, text_col))), runs, fan_in)
    return _decided(rows, runs, fan_in).select(
        F.col("_id").alias(id_col),
        F.col("_keep_id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_kept").alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    mark = fresh("_mark", docs)
    whole = written(docs.withColumn(mark, F.struct(*_digests(id_col, text_col))))
    rows, runs = _dealt(whole.select(*[F.col(f"{mark}.{c}").alias(c) for c in ("_id", "_row", "_sha", "_len")]), runs, fan_in)
    stay = _decided(rows, runs, fan_in).where("_kept").select(F.col("_row").alias("_stay"))
    return whole.join(stay, F.col(f"{mark}._row") == F.col("_stay"), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
