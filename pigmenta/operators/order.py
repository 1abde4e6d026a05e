"""Total orders of vertices: which neighbour is coloured first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import int_hash, is_large, signed32
from ..graph import Graph
from .numbering import numbered

#: Chains of keys, most significant first; larger values are coloured first.
CHAINS = {
    "device": ("large", "pri", "deg", "hash", "id"),
    "cpu": ("large", "round", "rdeg", "hash_signed", "id"),
    "degree": ("deg", "hash", "id"),
    "large_degree": ("large", "deg", "hash", "id"),
    "natural": ("minus_id",),
    "degree_id": ("deg", "minus_id"),
    "random": ("large", "pri", "deg", "random", "id"),
}


def keyed(vertices: DataFrame, chain: str, wrap: bool = False, seed: int = 0) -> DataFrame:
    """(id, key): ``key`` is a struct whose larger values come first.

    ``vertices`` has id, deg and, for peeled orders, round, rdeg and pri. ``wrap`` reads a
    priority as an unsigned 32-bit word, so one below zero is on top of its class. The
    chain ``random`` breaks ties by a number drawn for the id and ``seed``.
    """
    deg = F.col("deg")

    def part(name: str) -> Column:
        if name == "large":
            return is_large(deg).alias(name)
        if name == "hash":
            return int_hash(F.col("id")).alias(name)
        if name == "hash_signed":
            return signed32(int_hash(F.col("id"))).alias(name)
        if name == "random":
            return F.xxhash64(F.lit(seed), F.col("id")).alias(name)
        if name == "minus_id":
            return (-F.col("id")).alias(name)
        if name == "pri" and wrap:
            word = F.col("pri").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1 << 30))
            return word.alias(name)
        return F.col(name).cast("long").alias(name)

    return vertices.select("id", F.struct(*(part(c) for c in CHAINS[chain])).alias("key"))


def ranked(keys: DataFrame) -> DataFrame:
    """(id, rk): 1 is coloured first."""
    return numbered(keys, "rk", F.col("key").desc()).select("id", (F.col("rk") + 1).alias("rk"))


def dag(graph: Graph, keys: DataFrame) -> DataFrame:
    """(id, higher): each vertex with its neighbours that come before it; loops and repeats go."""
    low, high = keys.select(F.col("id").alias("src"), F.col("key").alias("low")), keys.select(F.col("id").alias("dst"), F.col("key").alias("high"))
    return graph.edges.join(low, "src").join(high, "dst").where("high > low").select(F.col("src").alias("id"), F.col("dst").alias("higher")).distinct()
