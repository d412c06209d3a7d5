"""Tables that are made once for a session and a set of inputs: the meter dimension, baselines and rollups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from . import scratch

_schemas: dict[str, StructType] = {}
_made: dict[tuple[str, str, str], tuple[str, str]] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], None], inputs: tuple[str, ...] = ("events",)) -> str:
    """The folder of a stored table; ``build`` writes it the first time, again if it has gone, and again if a file of its inputs is new, gone or changed."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    seen = scratch.fingerprint(spark, *(f"{sf_dir}/{x}.parquet" for x in inputs))
    path, told = _made.get(key, ("", ""))
    if told != seen or not path or not scratch.there(spark, path):
        path = scratch.new_path(spark, name)
        build(path)
        _made[key] = path, seen
    return path


def table(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, written once and read from then on."""
    path = once(spark, sf_dir, name, lambda path: make().write.parquet(path))
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)
