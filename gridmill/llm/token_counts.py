"""Token counts kept up by deltas.

A ledger in the shared folder holds a small table of totals by source, language and tokenizer version, and the
signed rows behind them: +count for an insert, -count for a delete, both for a revision, in buckets by id.  A batch writes its
signed rows and adds their sums to the last totals.  Inserts need nothing else; for the ids that it deletes or revises it reads the
buckets that they fall in, to learn what they hold.  Buckets are powers of two and grow with what is written at once, so one has about
``BUCKET_ROWS`` rows at any size.  So a batch costs its own size, those buckets and the totals; nothing else is summed again.

A batch is prepared in a folder of its own and becomes visible by its commit, a numbered file that names it and is
created only if that number is free; a second writer fails and may try again.  Applying a committed batch
again changes nothing, and what a broken batch left is never read.  ``compact`` folds the signed rows of all batches into one
set and keeps the totals and the committed names.

Defined cases: null text has no tokens; null source or language is a group of its own; rows without id are counted but can't
be revised or deleted.  Rows that repeat an id all count, and a revision or a delete replaces all of them.  Of the changes to
one id and version in one batch, those before the last delete or revision (by ``seq``) are void.  A delete or revision of an id that isn't there
counts nothing.  An empty batch commits no rows, and an empty ledger has no totals.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_path
from ._common import WORD, text_or_empty

GROUP = ["source", "lang", "version"]
SIGNED = "doc_id long, source string, lang string, version string, docs long, tokens long"
TOTALS = "source string, lang string, version string, docs long, tokens long"
BUCKET_ROWS = 1 << 18
#: A batch whose deletes and revisions fall in more buckets than that reads a folder's rows all.
LISTED = 4096

#: Tokenizer versions by name: a text column's count of tokens, in Spark's own functions.
VERSIONS: dict[str, Callable[[Column], Column]] = {
    "words-1": lambda text: F.regexp_count(text, F.lit(WORD)),
    "pieces-1": lambda text: F.regexp_count(text, F.lit(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]")),
}


def bpe_counter(path: str) -> Callable[[Column], Column]:
    """A version that counts byte-level BPE tokens with the vocabulary at ``path``."""

    @F.pandas_udf("long")
    def count(texts):
        from .bpe import loaded

        encode = loaded(path).encode
        return texts.map(lambda x: len(encode(x or "")) // 4)

    return count


def counted(docs: DataFrame, version: str, op: str = "insert", counter: Callable[[Column], Column] | None = None) -> DataFrame:
    """Changes (doc_id, source, lang, version, op, tokens, seq) for all rows of ``docs``."""
    tokens = (counter or VERSIONS[version])(text_or_empty("text"))
    return docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.lit(version).alias("version"),
        F.lit(op).alias("op"), tokens.cast("long").alias("tokens"), F.lit(0).cast("long").alias("seq"),
    )


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, *GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")


def _bucket(buckets: int) -> Column:
    return F.when(F.col("doc_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).cast("int")


def _buckets(rows: int, each: int) -> int:
    """The power of two that leaves about ``each`` rows in a bucket."""
    return 1 << max(0, -(-rows // each) - 1).bit_length()


class Ledger:
    """Totals and committed batches of signed counts under one folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.bucket_rows = spark, bucket_rows
        self.path = path or new_path(spark, "ledger")

    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _log(self) -> list[tuple[str, str, str]]:
        """(batch, folder, "add" or "base") of each commit, in order; a base replaces the rows of all before it."""
        fs, where = self._file("commits")
        read, log = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils, []
        for file in sorted(x.getPath().toString() for x in fs.listStatus(where)) if fs.exists(where) else []:
            stream = fs.open(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file))
            told = read.toString(stream, "UTF-8").split("|")
            stream.close()
            if len(told) != 3:
                raise RuntimeError(f"{file} was begun and not ended; if its writer is gone, delete it")
            log.append(tuple(told))
        return log

    def _commit(self, number: int, batch: str, folder: str, kind: str) -> None:
        """The ``number``-th commit; an error if another writer has made it."""
        fs, where = self._file(f"commits/{number:09d}")
        out = fs.create(where, False)
        out.write(bytearray(f"{batch}|{folder}|{kind}".encode()))
        out.close()

    def committed(self) -> list[str]:
        """Names of the committed batches, in order."""
        return [batch for batch, _, kind in self._log() if kind == "add"]

    def _folders(self) -> list[str]:
        """The folders of signed rows since the last base."""
        log = self._log()
        return [folder for _, folder, _ in log[max((k for k, x in enumerate(log) if x[2] == "base"), default=0) :]]

    def _read(self, folders: list[str]) -> DataFrame:
        parts = [self.spark.read.schema(f"{SIGNED}, bucket int").parquet(f"{self.path}/{folder}/rows") for folder in folders]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{SIGNED}, bucket int")

    def rows(self) -> DataFrame:
        """The signed rows of all committed batches, with their bucket."""
        return self._read(self._folders())

    def held(self, named: DataFrame) -> DataFrame:
        """The signed rows in the buckets that the ids of ``named`` fall in; a folder's name ends in its number of buckets, a power of two."""
        folders = self._folders()
        finest = max((int(x.rsplit("-", 1)[1]) for x in folders), default=1)
        touched = [r[0] for r in named.select(_bucket(finest)).distinct().limit(LISTED + 1).collect()]
        if not folders or not touched:
            return self._read([])
        if len(touched) > LISTED:
            return self._read(folders)
        return reduce(DataFrame.unionByName, [self._read([x]).where(F.col("bucket").isin(sorted({t % int(x.rsplit("-", 1)[1]) for t in touched}))) for x in folders])

    def _write(self, rows: DataFrame, folder: str) -> None:
        """Signed rows, in folders by bucket, each written by one task."""
        dealt = rows.withColumn("bucket", _bucket(int(folder.rsplit("-", 1)[1])))
        dealt.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}/rows")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit ``changes`` as ``batch``; False if that batch was committed before."""
        if "|" in batch or "/" in batch:
            raise ValueError("a batch's name has no | and no /")
        log = self._log()
        if any(x[0] == batch and x[2] == "add" for x in log):
            return False
        name = uuid.uuid4().hex
        whole = changes.groupBy("doc_id", *GROUP, "op", "seq").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
        whole.write.parquet(f"{self.path}/changes-{name}")
        whole = self.spark.read.schema(whole.schema).parquet(f"{self.path}/changes-{name}")
        size, others = whole.agg(F.count(F.lit(1)), F.count_if(F.col("op") != "insert")).first()
        folder = f"batch-{name}-{_buckets(size, self.bucket_rows)}"

        if others:
            keyed, key = whole.where("doc_id IS NOT NULL"), ["doc_id", "version"]
            named = keyed.groupBy(*key).agg(F.max(F.when(F.col("op") != "insert", F.col("seq"))).alias("last"))
            ended = named.where("last IS NOT NULL")
            old = _summed(self.held(ended).join(ended, key, "left_semi"), "doc_id")
            minus = old.select("doc_id", *GROUP, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
            valid = keyed.join(named, key).where("last IS NULL OR seq >= last")
            fresh = valid.where("op = 'insert'")
            revised = valid.where("op = 'revise'").join(old.select(*key).distinct(), key, "left_semi")
            loose = whole.where("doc_id IS NULL AND op = 'insert'")
            parts = (fresh, revised, loose, minus)
        else:
            parts = (whole,)
        signed = [x.select("doc_id", *GROUP, "docs", "tokens") for x in parts]
        self._write(_summed(reduce(DataFrame.union, signed), "doc_id"), folder)

        delta = self.spark.read.schema(SIGNED).parquet(f"{self.path}/{folder}/rows").select(*GROUP, "docs", "tokens")
        _summed(self._totals(log).union(delta)).coalesce(1).write.parquet(f"{self.path}/{folder}/totals")
        self._commit(len(log), batch, folder, "add")
        return True

    def _totals(self, log: list) -> DataFrame:
        return self.spark.read.schema(TOTALS).parquet(f"{self.path}/{log[-1][1]}/totals") if log else self.spark.createDataFrame([], TOTALS)

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens: the totals that the last commit left."""
        return self._totals(self._log())

    def recounted(self) -> DataFrame:
        """The totals, summed anew from all signed rows; an audit, which costs the whole ledger."""
        return _summed(self.rows())

    def compact(self) -> None:
        """Fold the signed rows of all batches into one set; totals and committed names stay."""
        log = self._log()
        if log:
            rows = self.rows()
            folder = f"base-{uuid.uuid4().hex}-{_buckets(rows.count(), self.bucket_rows)}"
            self._write(_summed(rows, "doc_id"), folder)
            self._totals(log).write.parquet(f"{self.path}/{folder}/totals")
            self._commit(len(log), "", folder, "base")


def rolled_up(docs: DataFrame) -> DataFrame:
    """Totals of ``docs`` after four batches, with a compaction and repeated batches between.

    1, 2: inserts of all rows in two versions.  3: documents of over 2,000 characters move to the source ``<source>/long`` and are
    counted anew in words-1, without words of one character.  4: documents of fewer than five words are deleted in both versions.
    """
    ledger, text = Ledger(docs.sparkSession), text_or_empty("text")
    first = counted(docs, "words-1")
    ledger.apply("1-words", first)
    ledger.apply("2-pieces", counted(docs, "pieces-1"))
    moved = docs.where(F.length(text) > 2000).withColumn("source", F.concat("source", F.lit("/long")))
    again = counted(moved, "words-1", "revise", lambda t: F.regexp_count(t, F.lit(WORD + WORD)))
    ledger.apply("3-revised", again)
    ledger.apply("3-revised", again)
    ledger.compact()
    ledger.apply("1-words", first)
    short = docs.where(VERSIONS["words-1"](text) < 5)
    ledger.apply("4-deleted", counted(short, "words-1", "delete").unionByName(counted(short, "pieces-1", "delete")))
    return ledger.totals()
