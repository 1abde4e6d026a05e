"""Scratch tables in the folder all executors share, used to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL_DEFAULT = "file:///tmp/checkpoints"
_roots: dict[str, SparkSession] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a local default only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _LOCAL_DEFAULT
    root = f"{base.rstrip('/')}/scratch-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots[root] = spark
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch root."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes within go as each write ends: what was written is read from then on."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a reader of it.

    Unlike ``checkpoint()`` this runs the plan a single time. A lost executor
    loses nothing: the files live in the shared store.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_split(df: DataFrame, path: str, flag: str, **totals: Column) -> dict[str, object]:
    """Write ``df`` to ``path`` split by the boolean ``flag``, and return ``totals`` over it.

    The totals are gathered while the rows are written, so a round of a loop is one job.
    """
    seen = Observation()
    df.observe(seen, *(c.alias(k) for k, c in totals.items())).write.partitionBy(flag).parquet(path)
    return seen.get


def read_split(spark: SparkSession, path: str, flag: str, value: bool, ddl: str, base: str | None = None) -> DataFrame:
    """The rows of ``write_split`` with that flag; ``path`` may be a pattern over rounds, whose folders below ``base`` are columns."""
    reader = spark.read.schema(ddl) if base is None else spark.read.schema(ddl).option("basePath", base)
    return reader.parquet(f"{path}/{flag}={str(value).lower()}")


def drop_split(spark: SparkSession, path: str, flag: str, value: bool) -> None:
    """Delete what nothing will read again of a round."""
    _delete(spark, f"{path}/{flag}={str(value).lower()}")


def release(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing will read again."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if any(_bare(path).startswith(_bare(root)) for root in _roots):
                _delete(df.sparkSession, path)


def _bare(uri: str) -> str:
    """A file URI without its scheme, whatever the number of slashes."""
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target.getFileSystem(conf).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in any store that Spark can open."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


@atexit.register
def _cleanup() -> None:
    for root, spark in _roots.items():
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, root)
        except Exception:  # the JVM may have ended already; nothing is left to tidy through it
            pass
