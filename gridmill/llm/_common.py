"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import new_path

#: ASCII white space, as every operator here splits words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one numpy step handles at once; bounds the workers' temporary arrays.
BLOCK_BYTES = 1 << 19


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores in front until no frame has such a column."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def sliced(batches: Iterable, rows: int = 256) -> Iterator:
    """Arrow batches in parts of a few hundred rows, so that what a task makes of them at once stays small."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()


def tidied(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """``run`` for ``mapInArrow``, giving Arrow's memory back at its end: a worker that waits for its next task keeps what it held."""

    def wrapped(batches):
        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return wrapped


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(id_column: Column, n: int) -> Column:
    """crc32 of an id as text, modulo ``n``; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % n


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's vocabulary file, which every machine has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
