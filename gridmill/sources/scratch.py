"""The folder for intermediate and stored tables, and the few things that are done to files from the driver."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one that ``spark.checkpoint.dir`` names, else one in the warehouse, which a cluster shares too.  Only a session that
    runs in one process, as in tests, gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/gridmill-scratch"
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="gridmill-")
    return _local[app]


def new_path(spark: SparkSession, name: str = "t") -> str:
    """A path in the shared folder that nothing uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def hadoop(spark: SparkSession, path: str):
    """(file system, path) as Hadoop's objects."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder, wherever Spark keeps it."""
    fs, where = hadoop(spark, path)
    return fs.delete(where, True)


def there(spark: SparkSession, path: str) -> bool:
    fs, where = hadoop(spark, path)
    return fs.exists(where)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Paths of what a folder holds; nothing if there is no such folder."""
    fs, where = hadoop(spark, path)
    return [x.getPath().toString() for x in fs.listStatus(where)] if fs.exists(where) else []


def text_created(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; False if it is there already."""
    fs, where = hadoop(spark, path)
    try:
        out = fs.create(where, False)
    except Exception as e:
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = hadoop(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Path, size and time of every file of some files or folders, so that a change of any shows."""
    told = []
    for path in paths:
        fs, where = hadoop(spark, path)
        if fs.exists(where):
            files = fs.listFiles(where, True)
            while files.hasNext():
                x = files.next()
                told.append(f"{x.getPath().toString()}:{x.getLen()}:{x.getModificationTime()}")
    return "\n".join(sorted(told))
