"""Session-level helpers shared by all operators: tables, keys and materialised intermediates."""

from __future__ import annotations

import atexit
import functools
import hashlib
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every character that counts as white space at the ends of a key (Unicode white space and the separators 1C to 1F).
WHITESPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


class Opened:
    """A session with the store views that one query has opened, so that a view used twice is planned once."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self.views: dict = {}

    def __getattr__(self, name: str):
        return getattr(self._spark, name)


def view(f):
    """A store view: (session, data directory) -> DataFrame, kept for the rest of the query in an Opened session."""

    @functools.wraps(f)
    def get(spark, d):
        if not isinstance(spark, Opened):
            return f(spark, d)
        key = (f.__name__, d)
        if key not in spark.views:
            spark.views[key] = f(spark, d)
        return spark.views[key]

    return get


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data directory (one file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_of(column: Column | str) -> Column:
    """A reference key: trimmed of white space and lower-cased; blank becomes null."""
    c = F.col(column) if isinstance(column, str) else column
    k = F.lower(F.btrim(c, F.lit(WHITESPACE)))
    return F.when(k != "", k)


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only where it is unset on one machine, a new local one.

    On a cluster without that setting executors would each write to a disk of their own, so it is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tessera-work-")
        spark.sparkContext.setCheckpointDir(d)
        d = spark.sparkContext.getCheckpointDir() or d
    return d


def _drop_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Cut the lineage: write `df` as a table in the shared work folder and read it back.

    The files survive the loss of executors, keep column statistics for later pruning and are removed when the
    driver's interpreter ends.
    """
    spark = df.sparkSession
    path = os.path.join(work_dir(spark), "tessera", f"{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_drop_path, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _version_of(spark: SparkSession, path: str) -> str:
    """What tells whether a table has changed: name, length and time of its files."""
    p, fs = _file_system(spark, path)
    if not fs.exists(p):
        return f"{path} none"
    files, out = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        out.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return "\n".join(sorted(out))


#: Part of the name of every stored table: to be raised when what is stored is built otherwise.
LAYOUT = 2


def stored(spark: SparkSession, name: str, source: str, build, partition_by: list[str] | None = None) -> DataFrame:
    """A derived table kept in the shared work folder for as long as the files of its source table stay the same.

    `build()` gives it where it is not there yet. It is written beside its place and then renamed, so an unfinished one is
    never read; of two writers one wins and both tables are equal.
    """
    key = hashlib.sha256(f"{LAYOUT}\n{name}\n{_version_of(spark, source)}".encode()).hexdigest()[:24]
    path = os.path.join(work_dir(spark), "tessera", "stored", f"{name}-{key}")
    p, fs = _file_system(spark, path)
    if not fs.exists(p):
        side = f"{path}.{uuid.uuid4().hex}"
        w = build().write.option("compression", "zstd")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(side)
        moved, _ = _file_system(spark, side)
        if not fs.rename(moved, p) and not fs.exists(p):
            raise OSError(f"cannot move {side} to {path}")
        _drop_path(spark, side)
    return spark.read.parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan: exact file sizes for a plain scan, an upper-leaning guess otherwise."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit_bytes: int = 32 << 20) -> DataFrame:
    """Hint a broadcast only where the estimated size is within `limit_bytes`; beyond it the plain join stays."""
    return F.broadcast(df) if size_in_bytes(df) <= limit_bytes else df
