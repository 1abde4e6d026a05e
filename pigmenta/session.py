"""Session helpers."""

from __future__ import annotations

import contextlib
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(app: str = "pigmenta", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and local runs."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """For entry points, which own their session: at most ``rows`` rows a batch between Spark and Python.

    Operators bound what they make of a batch themselves and leave the session as it is.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most ``rows`` rows between Spark and Python in what is written within, whose rows have a bound."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Python functions in plans are pickled by reference, so the workers must be able
    to import the package however the driver found it.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as work:
        shutil.copytree(root, Path(work, "src", root.name), ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(str(Path(work, f"{root.name}_src")), "zip", str(Path(work, "src")))
        # addPyFile keeps serving the file from its path, so it must outlive this block
        keep = Path(tempfile.mkdtemp(), Path(archive).name)
        shutil.copy(archive, keep)
    context.addPyFile(str(keep))
    _shipped.add(context.applicationId)
