"""Adjacency that stays in place: a table bucketed by vertex, and steps that exchange states only.

Each vertex has a bucket, and a bucket's rows lie together in a bucketed table that is written once. A
step groups that table and the rows addressed to each bucket by bucket: the table is read where it
lies, without an exchange, and only states and messages are shuffled. A task holds one bucket,
which has ``BUCKET_EDGES`` entries or so. Entries of a vertex with more than ``HUB_EDGES`` (a hub) lie with its
neighbours instead of with it: each bucket sums up what its own vertices mean to the hub and sends
that, so no bucket holds or receives a hub's neighbours one by one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import freed_shuffles, scratch_path

#: Entries of a bucket, about, and most entries that a vertex may have in its own bucket.
BUCKET_EDGES, HUB_EDGES = 1_000_000, 250_000
#: Most hubs that are broadcast; more are joined by shuffle.
BROADCAST_HUBS = 1_000_000
EDGE, ROUTE, MIRROR = 0, 1, 2


@dataclass(frozen=True)
class Resident:
    """The table ``name`` in ``buckets`` buckets: (bucket, kind, id, other, goal).

    ``EDGE``: ``id`` of this bucket depends on ``other``; ``ROUTE``: what ``id`` of this bucket says goes to the
    bucket ``goal``, where vertices depend on it; ``MIRROR``: the hub ``id`` of the bucket ``goal`` depends on ``other`` of this bucket.
    """

    spark: SparkSession
    name: str
    buckets: int

    def bucket(self, vertex: str) -> Column:
        return bucket_of(vertex, self.buckets)

    def step(self, rows: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], ddl: str) -> DataFrame:
        """What ``work`` makes of each bucket's table and the ``rows`` addressed to it by ``bucket``."""
        return self.spark.table(self.name).groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInArrow(work, ddl)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def bucket_of(vertex: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(vertex), F.lit(buckets)).cast("int")


def bucketed(df: DataFrame, buckets: int, column: str, name: str) -> str:
    """Write ``df`` as a table with one sorted file for each bucket of ``column``; its name."""
    table = f"{name}_{uuid.uuid4().hex}"
    with freed_shuffles(df.sparkSession):
        df.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column).option("path", scratch_path(df.sparkSession, name)).saveAsTable(table)
    return table


def settle(edges: DataFrame, size: int, bucket_edges: int | None = None, hub_edges: int | None = None) -> Resident:
    """Lay ``edges`` (id, other), ``size`` stored rows, into buckets by ``id``."""
    spark = edges.sparkSession
    bucket_edges, hub_edges = bucket_edges or BUCKET_EDGES, hub_edges or HUB_EDGES
    buckets = max(1, -(-size // bucket_edges))
    at = lambda c: bucket_of(c, buckets)
    plain = lambda df: df.select(at("id").alias("bucket"), F.lit(EDGE).alias("kind"), "id", "other", F.lit(None).cast("int").alias("goal"))
    if buckets == 1:
        return Resident(spark, bucketed(plain(edges), 1, "bucket", "resident"), 1)
    hubs = edges.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub_edges).select("id", F.lit(True).alias("hub"))
    n_hubs = hubs.count()
    marked = edges.join(F.broadcast(hubs) if n_hubs <= BROADCAST_HUBS else hubs, "id", "left") if n_hubs else edges.withColumn("hub", F.lit(None).cast("boolean"))
    mirrors = marked.where("hub").select(at("other").alias("bucket"), F.lit(MIRROR).alias("kind"), "id", "other", at("id").alias("goal"))
    near = marked.where("hub IS NULL")
    routes = near.select(at("other").alias("bucket"), F.col("other").alias("id"), at("id").alias("goal")).where("bucket != goal").distinct()
    routes = routes.select("bucket", F.lit(ROUTE).alias("kind"), "id", F.lit(None).cast("long").alias("other"), "goal")
    return Resident(spark, bucketed(plain(near).unionByName(mirrors).unionByName(routes), buckets, "bucket", "resident"), buckets)
