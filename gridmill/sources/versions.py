"""Tables that change in one step: new rows go to a folder of their own, and one numbered pointer makes them the table.

``data/ver=<id>/`` holds what one write left, by partition if there is one.  ``pointers/<n>`` is a small file that names the versions of each partition and
carries a few facts of the table (a watermark, say).  A writer reads the newest pointer, writes its rows aside, and creates the next number, which fails if another writer
has taken it.  So a reader sees the old rows or the new ones whatever breaks off in between; rows that no pointer names are never read, and
``vacuum`` removes them.  A pointer that was begun and not ended counts as not there.  There is no more to it: no log of changes, no schema evolution, no merging of writers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .scratch import listed, read_text, remove, text_created

END = "\n.\n"


class Conflict(RuntimeError):
    """Another writer was first; read anew and try again."""


class Table:
    """A versioned table.  Its schema, with the partition column last, and that column's name are kept in the pointer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _pointers(self) -> list[str]:
        return sorted(x for x in (x.rsplit("/", 1)[-1] for x in listed(self.spark, f"{self.path}/pointers")) if x.isdigit())

    def pointer(self, number: int | None = None) -> tuple[int, dict]:
        """(number, {"parts": {partition: versions}, "facts": {...}}) of the newest pointer, or of the one up to ``number``; -1 and nothing if there is none."""
        for name in reversed([x for x in self._pointers() if number is None or int(x) <= number]):
            text = read_text(self.spark, f"{self.path}/pointers/{name}")
            if text.endswith(END):
                return int(name), json.loads(text[: -len(END)])
        return -1, {"parts": {}, "facts": {}}

    def facts(self) -> dict:
        return self.pointer()[1]["facts"]

    def exists(self) -> bool:
        return self.pointer()[0] >= 0

    def stage(self, df: DataFrame, partition: str | None = None, **options: str) -> dict:
        """Write ``df`` aside, by ``partition`` if there is one; nothing reads it yet."""
        version = uuid.uuid4().hex
        writer = df.write.options(**options)
        (writer.partitionBy(partition) if partition else writer).parquet(f"{self.path}/data/ver={version}")
        names = [x.rsplit("/", 1)[-1] for x in listed(self.spark, f"{self.path}/data/ver={version}")]
        fields = [f for f in df.schema if f.name != partition] + [f for f in df.schema if f.name == partition]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        return {"version": version, "parts": [x for x in names if x.startswith(f"{partition}=")] if partition else [""], "schema": schema, "partition": partition}

    def point(self, staged: dict, replaced: Iterable[str] | None = None, after: tuple[int, dict] | None = None, append: bool = False, **facts) -> None:
        """The one step: what was staged becomes the table, or its partitions ``replaced``, or is added to it.

        Replaced partitions that get no row are gone.  ``after`` is the pointer that the rows were made from; if there is a newer one by now, nothing happens but an error.
        """
        number, now = after or self.pointer()
        gone = set() if append else set(now["parts"]) if replaced is None else set(replaced) | set(staged["parts"])
        parts = {k: v for k, v in now["parts"].items() if k not in gone}
        parts |= {k: [*parts.get(k, []), staged["version"]] for k in staged["parts"]}
        told = {"parts": parts, "facts": now["facts"] | {"schema": staged["schema"], "partition": staged["partition"]} | facts}
        if self.pointer()[0] != number:
            raise Conflict(f"{self.path} has changed since pointer {number}")
        free = max([number, *map(int, self._pointers())]) + 1  # past one that was begun and not ended
        if not text_created(self.spark, f"{self.path}/pointers/{free:09d}", json.dumps(told) + END):
            raise Conflict(f"{self.path} has a pointer {free}")

    def put(self, df: DataFrame, partition: str | None = None, append: bool = False) -> None:
        """Make ``df`` the table, or add it."""
        self.point(self.stage(df, partition), append=append)

    def folders(self, parts: Iterable[str] | None = None, told: dict | None = None) -> list[str]:
        """The folders that hold all partitions or some, by the newest pointer or the one given."""
        told = told or self.pointer()[1]
        wanted = set(told["parts"]) if parts is None else set(parts)
        return [f"{self.path}/data/ver={v}/{k}".rstrip("/") for k, versions in sorted(told["parts"].items()) if k in wanted for v in versions]

    def read(self, parts: Iterable[str] | None = None, told: dict | None = None) -> DataFrame:
        """The rows of all partitions or some; only their folders are listed."""
        told = told or self.pointer()[1]
        schema, paths = told["facts"]["schema"], self.folders(parts, told)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, ver string").option("basePath", f"{self.path}/data").parquet(*paths).drop("ver")

    def vacuum(self, keep: int = 2) -> int:
        """Remove the versions that none of the last ``keep`` pointers names, and older pointers; returns the versions removed."""
        names = self._pointers()
        texts = [read_text(self.spark, f"{self.path}/pointers/{x}") for x in names[-keep:]]
        named = {v for t in texts if t.endswith(END) for x in json.loads(t[: -len(END)])["parts"].values() for v in x}
        gone = [x for x in listed(self.spark, f"{self.path}/data") if x.rsplit("ver=", 1)[-1] not in named]
        for x in [*gone, *(f"{self.path}/pointers/{n}" for n in names[:-keep])]:
            remove(self.spark, x)
        return len(gone)
