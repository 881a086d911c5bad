"""Tables built once for an application and read by many queries, and stages written so that no later one repeats them."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_BUILT: dict[tuple[str, ...], str] = {}
#: Names of the built tables that are dealt by a column, by their paths.
_DEALT: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, or one temporary folder where all tasks run on this machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("quillspark.store.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("quillspark.store.dir", base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def _dealt(rows: DataFrame, path: str, *deal: str) -> str:
    """``rows``, which are dealt by the columns ``deal``, written to ``path`` in buckets by these; the name of their table."""
    named = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.write.option("compression", "zstd").format("parquet").bucketBy(buckets, *deal).option("path", path).saveAsTable(named)
    return named


def settled(rows: DataFrame, name: str, *deal: str) -> DataFrame:
    """``rows`` written to the shared folder and read back: a plan that names them twice reads them twice, and a lost executor loses none.

    With ``deal``, by which they are dealt, they are bucketed by these columns, so that what groups or joins them by these sends none again.
    """
    path = scratch(rows.sparkSession, name)
    if deal:
        return rows.sparkSession.table(_dealt(rows, path, *deal))
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _state(spark: SparkSession, source: str) -> str:
    """Names, sizes and times of the files below ``source``, which tell whether it is still what a table was built from."""
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(source)
    files, said = hpath.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(hpath, True), []
    while files.hasNext():
        f = files.next()
        said.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(said)).encode()).hexdigest()


def built(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame], *partition_by: str, deal: str | None = None, plain: bool = False) -> DataFrame:
    """The table ``name`` derived from the files of ``source``: written at the first call of this application, read until those files change.

    With ``deal`` its rows are bucketed by that column, so that what later groups or joins them by it sends none of them again. ``plain`` reads
    them without their buckets: Spark leaves out a repartition by these and then the buckets too, as no grouping or join asks for them.
    It is removed when the driver's JVM ends, or by ``forget``. A lost executor loses none of it.
    """
    key = (spark.sparkContext.applicationId, name, source, _state(spark, source))
    if key not in _BUILT:
        rows, path = build(), scratch(spark, name)
        if deal:
            _DEALT[path] = _dealt(rows, path, deal)
        else:
            writer = rows.write.option("compression", "zstd")
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        _BUILT[key] = path
    path = _BUILT[key]
    return spark.table(_DEALT[path]) if path in _DEALT and not plain else spark.read.parquet(path)


def forget(spark: SparkSession, source: str | None = None) -> None:
    """Remove the tables built from ``source``, or from any."""
    for key in [k for k in _BUILT if source in (None, k[2])]:
        built_at = _BUILT.pop(key)
        if built_at in _DEALT:
            spark.sql(f"DROP TABLE IF EXISTS {_DEALT.pop(built_at)}")
        path = spark._jvm.org.apache.hadoop.fs.Path(built_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
