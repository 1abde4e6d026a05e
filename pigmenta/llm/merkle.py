"""Merkle manifest of a dataset, with its nodes in an external store.

A row's leaf is the SHA-256 of its columns, each as its length and its value. Leaves are
written as sorted runs and numbered; every ``FANOUT`` consecutive nodes of a tree (one a
language) are a block. The blocks of level 0 are stored first; each further level reads the one
below it and is stored in turn, until each tree is down to one node, its subroot. The
subroots, in the order of their languages, are the leaves of one more tree, whose last node
is the root. A proof is read off by coordinates: from the top level down, the blocks of a
level are merge-joined with the paths of their own nodes, so that a path is sent once a block and not once a leaf.

Memory is bounded by a block and a path, whatever the table's size or the share of a
language; a level of the store is a finished table before it is read, so a lost executor costs tasks only.

Defined cases: a null column is ``-`` in a leaf; a null language is a tree of its own and the first;
rows without an id come first in their tree and are never tampered with; repeated ids are
ordered by their leaves, equal rows are leaves next to each other; a lone leaf is its tree's subroot, and
a lone subroot is the root; an empty table has no root and no rows; extra columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import freed_shuffles, materialize, scratch_path
from .names import column
from .ranges import placed

FANOUT = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A path: for each level, from the leaf's on, the digests before and after the own one.
_NO_PATH = "CAST(array() AS array<struct<left: string, right: string>>)"


def sealed(*columns: Column) -> Column:
    """The digest of columns: each is ``-`` if null, else its length in bytes, a colon and its value."""
    return F.sha2(F.concat(*(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns)), 256)


@dataclass(frozen=True)
class NodeStore:
    """Trees in ``folder``, a folder a level: (tree, block, n, nodes), where ``n`` counts the tree's nodes in that level.

    ``lone`` are trees of a single leaf, which have no block; ``roots`` is (tree, depth, digest).
    """

    spark: SparkSession
    folder: str
    levels: int
    schema: str
    lone: DataFrame
    roots: DataFrame

    def blocks(self, level: int) -> DataFrame:
        return self.spark.read.schema(self.schema if not level else _INNER).parquet(f"{self.folder}/level={level}")

    def proofs(self, tops: DataFrame, *carried: str) -> DataFrame:
        """(tree, node, path and the ``carried`` columns of ``tops``) of every leaf.

        ``tops``: tree, depth, the path above the tree's root, and what all leaves of the tree carry.
        """
        names = ["tree", "path", *carried]

        def starts(depth: int) -> DataFrame:
            return tops.where(F.col("depth") == depth).select(F.lit(0).cast("long").alias("at"), *names)

        above = starts(self.levels)
        for level in reversed(range(self.levels)):
            parents = above if level == self.levels - 1 else above.unionByName(starts(level + 1))
            met = self.blocks(level).withColumnRenamed("block", "at").join(parents.hint("merge"), ["tree", "at"])
            each = met.select("tree", "at", "nodes", F.posexplode("nodes").alias("i", "node"), "path", *carried)
            digests = F.col("nodes.digest")
            left = F.array_join(F.slice(digests, F.lit(1), F.col("i")), "")
            right = F.array_join(F.slice(digests, F.col("i") + 2, F.lit(FANOUT)), "")
            path = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("path"))
            above = each.select((F.col("at") * FANOUT + F.col("i")).alias("at"), "tree", "node", path.alias("path"), *carried)
            if level:
                above = above.drop("node")
        lone = self.lone.join(tops.select(*names), "tree").select("tree", "node", "path", *carried)
        return above.select("tree", "node", "path", *carried).unionByName(lone) if self.levels else lone


_INNER = "tree string, block long, n long, nodes array<struct<at: long, digest: string>>"


def build(leaves: DataFrame, *extra: str) -> NodeStore:
    """Store the trees over ``leaves`` (tree, at, n, digest and ``extra`` columns that a leaf's node keeps)."""
    spark = leaves.sparkSession
    folder = scratch_path(spark, "nodes")
    leaves = materialize(leaves.select("tree", "at", "n", F.struct("at", "digest", *extra).alias("node")), "leaves")
    kinds = leaves.schema["node"].dataType.simpleString()
    schema = f"tree string, block long, n long, nodes array<{kinds}>"
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels = 0
    while most > 1:
        most, levels = -(-most // FANOUT), levels + 1
    lone = leaves.where("n = 1").select("tree", "node")
    roots = lone.select("tree", F.lit(0).alias("depth"), "node.digest")
    nodes = leaves
    for level in range(levels):
        grouped = nodes.where("n > 1").groupBy("tree", F.floor(F.col("at") / FANOUT).alias("block") if level else F.floor(F.col("node.at") / FANOUT).alias("block"))
        blocks = grouped.agg(F.max("n").alias("n"), F.array_sort(F.collect_list("node")).alias("nodes"))
        with freed_shuffles(spark):
            blocks.sortWithinPartitions("tree", "block").write.parquet(f"{folder}/level={level}")
        stored = spark.read.schema(schema if not level else _INNER).parquet(f"{folder}/level={level}")
        nodes = stored.select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / FANOUT).alias("n"), F.sha2(F.array_join("nodes.digest", ""), 256).alias("digest"))
        roots = roots.unionByName(nodes.where("n = 1").select("tree", F.lit(level + 1).alias("depth"), "digest"))
        nodes = nodes.select("tree", "at", "n", F.struct("at", "digest").alias("node"))
    return NodeStore(spark, folder, levels, schema, lone, materialize(roots, "roots"))


@dataclass(frozen=True)
class Manifest:
    """The trees of a table, the tree over their roots, and the root (None for an empty table)."""

    trees: NodeStore
    top: NodeStore
    root: str | None

    def proofs(self) -> DataFrame:
        """(node, subroot, root, path) of every row: ``path`` leads from the leaf to the root."""
        start = self.top.roots.select("tree", "depth", F.expr(_NO_PATH).alias("path"))
        tops = self.top.proofs(start).select("node.tree_", "node.depth", F.col("node.digest").alias("subroot"), "path")
        tops = materialize(tops.withColumnRenamed("tree_", "tree"), "tops")
        return self.trees.proofs(tops, "subroot").withColumn("root", F.lit(self.root).cast("string")).drop("tree")


def manifest(df: DataFrame, columns: list[str], id_column: str = "doc_id", tree: str = "lang", altered: Column | None = None) -> Manifest:
    """The manifest of ``df`` over the named columns, in trees by ``tree``, ordered by ``id_column``.

    A leaf's node has its id and the leaf. With ``altered``, a digest that may be null, it keeps that
    as ``other``, to be checked against the manifest later.
    """
    named = F.coalesce(F.concat(F.lit("="), column(df, tree).cast("string")), F.lit(""))  # null first, then by bytes
    other = F.lit(None).cast("string") if altered is None else altered
    # rows are hashed once; the salt spreads rows that are equal in all that orders them
    leaves = materialize(df.select(named.alias("tree"), column(df, id_column).alias("id"), sealed(*(column(df, c) for c in columns)).alias("digest"), other.alias("other"), F.rand(7).alias("salt")), "leaf-digests")
    trees = build(placed(leaves, "tree", "id", "digest", "salt").drop("salt"), "id", "other")
    tops = materialize(trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("tree_"), "depth", "digest"), "subroots")
    top = build(placed(tops, "tree", "tree_"), "tree_", "depth")
    root = top.roots.first()
    return Manifest(trees, top, None if root is None else root["digest"])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along its path."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def verified(found: Manifest, id_column: str = "doc_id") -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``folded_root`` follows the altered leaf where a row has one, its own leaf otherwise.
    """
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    rows = found.proofs().select(
        F.col("node.id").alias("id"), F.col("node.digest").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.coalesce("node.other", "node.digest"), F.col("path")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("id", id_column)


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, some of which are tampered with after the manifest was made."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = [F.translate(F.col(c), _UPPER, _LOWER) if c == "text" else F.col(c) for c in COLUMNS]
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, sealed(*tampered))
    return verified(manifest(docs, COLUMNS, altered=altered))
