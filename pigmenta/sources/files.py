"""Readers of graph files. Text is parsed with DataFrame functions; binary files are
read in ranges by many tasks."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.numbering import numbered
from ..scratch import exists, materialize

#: Edges of one range of a binary file.
RANGE_EDGES = 4_000_000


@dataclass(frozen=True)
class Meta:
    """What a header says, and whether ids start at 0."""

    nodes: int | None = None
    edges: int | None = None
    zero_based: bool | None = None


def resolve(name: str, folder: str = "Datasets/SNAP") -> str:
    """A path as it is, else the name, or the name with ``.txt``, in the data folder."""
    for path in (Path(name), Path(folder, name), Path(folder, f"{name}.txt")):
        if path.is_file():
            return str(path)
    raise FileNotFoundError(name)


def discover(folder: str, pattern: str = "*.egr", recursive: bool = False) -> list[str]:
    """Files of a folder by pattern, sorted."""
    found = Path(folder).rglob(pattern) if recursive else Path(folder).glob(pattern)
    return sorted(str(p) for p in found if p.is_file())


def _fields(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def _pairs(lines: DataFrame, *more: str) -> DataFrame:
    parts = lines.where("length(trim(value)) > 0").select(_fields(F.col("value")).alias("p"), *more)
    return parts.select(F.col("p")[0].try_cast("long").alias("src"), F.col("p")[1].try_cast("long").alias("dst"), *more)  # filters may be moved before that of comments


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, at): the lines of text files; ``at`` is larger for later lines, however the files are cut."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select("value", place.alias("at"))


def first_seen(pairs: DataFrame) -> DataFrame:
    """(id, dense): the ids of (src, dst, at) numbered from 0 in the order in which they first occur."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("side")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("side")))).alias("e"), "at")
    ids = ends.groupBy("e.id").agg(F.min(F.struct("at", "e.side")).alias("first")).where("id IS NOT NULL")
    return numbered(ids, "dense", F.col("first")).select("id", "dense")


def snap_meta(spark: SparkSession, path: str) -> Meta:
    """Numbers of a ``# Nodes: N Edges: M`` line, and whether vertex 0 is there (or one id is missing)."""
    lines = spark.read.text(path)
    head = lines.where(F.col("value").rlike(r"^#.*Nodes:")).select(F.regexp_extract("value", r"Nodes:\s*(\d+)", 1).alias("n"), F.regexp_extract("value", r"Edges:\s*(\d+)", 1).alias("m")).head(1)
    nodes, edges = (int(head[0]["n"] or 0) or None, int(head[0]["m"] or 0) or None) if head else (None, None)
    pairs = _pairs(lines.where(~F.col("value").startswith("#")))
    ids = pairs.select(F.explode(F.array("src", "dst")).alias("id"))
    row = ids.agg(F.min("id").alias("low"), F.countDistinct("id").alias("n")).first()
    zero = row["low"] == 0 or (nodes is not None and row["n"] + 1 == nodes)
    return Meta(nodes, edges, bool(zero))


def read_snap(spark: SparkSession, path: str, symmetrize: bool = True, simple: bool = False, compact: bool = False, strict: bool = False) -> Graph:
    """Edge lines of a text file with ``#`` comments.

    Lines stay as they are, repeated ones and loops too: a multigraph whose vertices are
    0 to the largest id. ``simple`` drops loops and repeats; ``compact`` numbers the ids
    that occur in the order of their first line, those of loops too; ``strict`` checks ids
    and edges against the header.
    """
    pairs = _pairs(_lines(spark, path).where(~F.col("value").startswith("#")), "at")
    if compact:
        pairs = materialize(pairs.where("src IS NOT NULL AND dst IS NOT NULL"), "lines")
        dense = materialize(first_seen(pairs), "ids")
        ids = dense.select(F.col("dense").alias("id"))
        pairs = pairs.join(dense.withColumnsRenamed({"id": "src", "dense": "s"}), "src").join(dense.withColumnsRenamed({"id": "dst", "dense": "d"}), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
        if simple and symmetrize:
            return Graph.of_pairs(pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")), ids)
    pairs = pairs.select("src", "dst")
    if strict:
        meta = snap_meta(spark, path)
        row = pairs.agg(F.count(F.lit(1)).alias("m"), F.min(F.least("src", "dst")).alias("low"), F.max(F.greatest("src", "dst")).alias("high")).first()
        if meta.nodes is None or meta.edges != row["m"] or (row["m"] and not 0 <= row["low"] <= row["high"] < meta.nodes):
            raise ValueError(f"{path}: the header ({meta.nodes} nodes, {meta.edges} edges) does not agree with {row['m']} edges of ids {row['low']} to {row['high']}")
        return Graph(spark.range(meta.nodes), pairs, True)
    if simple:
        pairs = pairs.where("src != dst").distinct()
        if symmetrize:
            return Graph.of_pairs(pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    high = pairs.agg(F.max(F.greatest("src", "dst"))).first()[0]
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if symmetrize else pairs
    return Graph(spark.range((high if high is not None else -1) + 1), both, True)


def _ints(stream, at: int, n: int) -> np.ndarray:
    stream.seek(4 * at)
    body = stream.read(4 * n)
    if len(body) != 4 * n:
        raise ValueError("the file ends too early")
    return np.frombuffer(body, dtype="<i4")


def _open(path: str) -> pa.NativeFile:
    fs, place = pyarrow.fs.FileSystem.from_uri(path if "://" in path else str(Path(path).resolve()))
    return fs.open_input_file(place)


def _read_csr(spark: SparkSession, path: str, index_at: int, list_at: int, weight_at: int | None, nodes: int, edges: int) -> DataFrame:
    """Edges of a CSR file: each task reads the index and the list of a range of vertices."""
    n_ranges = max(1, min(nodes, -(-edges // RANGE_EDGES)))
    step = -(-nodes // n_ranges)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                low, high = i * step, min(nodes, (i + 1) * step)
                if low >= high:
                    continue
                with _open(path) as stream:
                    index = _ints(stream, index_at + low, high - low + 1).astype(np.int64)
                    src = np.repeat(np.arange(low, high), np.diff(index))
                    dst = _ints(stream, list_at + index[0], int(index[-1] - index[0])).astype(np.int64)
                    weight = _ints(stream, weight_at + index[0], len(dst)) if weight_at is not None else None
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst), pa.array(np.arange(index[0], index[-1]), pa.int64()), pa.array(weight, pa.int32()) if weight is not None else pa.nulls(len(dst), pa.int32())], names=["src", "dst", "pos", "weight"])

    return spark.range(n_ranges).repartition(n_ranges, "id").mapInArrow(read, "src long, dst long, pos long, weight int")


def read_egr(spark: SparkSession, path: str) -> Graph:
    """Binary CSR: nodes, edges, index, list and perhaps weights, 32-bit little-endian. ``edges`` also has pos and weight."""
    with _open(path) as stream:
        size = stream.size()
        nodes, edges = struct.unpack("<ii", stream.read(8))
    if nodes < 1 or edges < 0 or size < 4 * (3 + nodes + edges):
        raise ValueError(f"{path}: {nodes} nodes, {edges} edges, {size} bytes")
    list_at = 3 + nodes
    weight_at = list_at + edges if size >= 4 * (3 + nodes + 2 * edges) and edges else None
    return Graph(spark.range(nodes), _read_csr(spark, path, 2, list_at, weight_at, nodes, edges), True)


def read_bin(spark: SparkSession, path: str) -> Graph:
    """Binary cache: nodes, edges, edges read, list, then index. All capacities are 1."""
    with _open(path) as stream:
        size = stream.size()
        nodes, edges, _ = struct.unpack("<iii", stream.read(12))
    if nodes < 0 or edges < 0 or size < 4 * (4 + nodes + edges):
        raise ValueError(f"{path}: {nodes} nodes, {edges} edges, {size} bytes")
    rows = _read_csr(spark, path, 3 + edges, 3, None, nodes, edges)
    return Graph(spark.range(nodes), rows.withColumn("weight", F.lit(1)), True)


#: Kinds of a MatrixMarket banner.
_OBJECTS, _FORMATS = ("matrix",), ("coordinate", "array")
_VALUES, _SYMMETRY = ("real", "complex", "pattern", "integer"), ("general", "symmetric", "skew-symmetric", "hermitian")


@dataclass(frozen=True)
class Banner:
    format: str
    values: str
    symmetry: str

    @property
    def valid(self) -> bool:
        """Dense patterns, real Hermitian and skew-symmetric patterns do not exist."""
        return not (self.format == "array" and self.values == "pattern" or self.values == "real" and self.symmetry == "hermitian" or self.values == "pattern" and self.symmetry in ("hermitian", "skew-symmetric"))

    def line(self) -> str:
        return f"%%MatrixMarket matrix {self.format} {self.values} {self.symmetry}"


def parse_banner(line: str) -> Banner:
    parts = line.split()
    if len(parts) != 5 or parts[0] != "%%MatrixMarket":
        raise ValueError(f"not a MatrixMarket banner: {line!r}")
    what, form, values, symmetry = (p.lower() for p in parts[1:])
    if what not in _OBJECTS or form not in _FORMATS or values not in _VALUES or symmetry not in _SYMMETRY:
        raise ValueError(f"unsupported MatrixMarket type: {line!r}")
    return Banner(form, values, symmetry)


@dataclass(frozen=True)
class Matrix:
    """``entries`` (i, j, re, im) from 0, each stored one once."""

    banner: Banner
    rows: int
    columns: int
    entries: DataFrame

    def mirrored(self) -> DataFrame:
        """The entries of the whole matrix: those below the diagonal also above it, by the symmetry."""
        kind = self.banner.symmetry
        if kind == "general":
            return self.entries
        sign = -1.0 if kind == "skew-symmetric" else 1.0
        turn = -1.0 if kind in ("skew-symmetric", "hermitian") else 1.0
        above = self.entries.where("i != j").select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("re") * sign).alias("re"), (F.col("im") * turn).alias("im"))
        return self.entries.unionByName(above)


def _dense_place(k: Column, rows: int, symmetry: str) -> tuple[Column, Column]:
    """Row and column of the ``k``-th value of a dense file, which goes column by column."""
    if symmetry == "general":
        return k % rows, F.floor(k / rows).cast("long")
    below = 1 if symmetry == "skew-symmetric" else 0  # only what is below the diagonal is stored
    m = rows - below
    before = lambda j: j * m - F.floor(j * (j - 1) / 2).cast("long")
    guess = F.floor((2 * m + 1 - F.sqrt(F.greatest(F.lit(0.0), F.lit(float((2 * m + 1) ** 2)) - 8.0 * k))) / 2).cast("long")
    column = F.when(before(guess) > k, guess - 1).when(before(guess + 1) <= k, guess + 1).otherwise(guess)
    return k - before(column) + column + below, column


def read_matrix(spark: SparkSession, path: str) -> Matrix:
    """A MatrixMarket file, coordinate or dense, with its values (1 where the banner is of patterns).

    Values are complex (two numbers), real (one) or none; integer files are rejected, as are
    files whose number of entries is not that of the size line, or whose banner no matrix has.
    """
    lines = _lines(spark, path)
    banner = parse_banner(lines.agg(F.min_by("value", "at")).first()[0] or "")
    if not banner.valid or banner.values == "integer":
        raise ValueError(f"{path}: cannot read {banner.line()}")
    body = materialize(lines.where(~F.col("value").startswith("%") & (F.length(F.trim("value")) > 0)).select("value", "at"), "matrix")
    size = body.agg(F.min_by("value", "at").alias("value"), F.min("at").alias("at")).first()
    if size["value"] is None:
        raise ValueError(f"{path}: no size line")
    numbers = [int(x) for x in size["value"].split()[:3]]
    rest = numbered(body, "k", F.col("at")).where("k > 0").select(_fields(F.col("value")).alias("p"), (F.col("k") - 1).alias("k"))
    rows, columns = numbers[:2]
    sparse = banner.format == "coordinate"
    if sparse:
        i, j, first, expected = F.col("p")[0].try_cast("long") - 1, F.col("p")[1].try_cast("long") - 1, 2, numbers[2]
    else:
        i, j = _dense_place(F.col("k"), rows, banner.symmetry)
        first, expected = 0, {"general": rows * columns, "skew-symmetric": rows * (rows - 1) // 2}.get(banner.symmetry, rows * (rows + 1) // 2)
    value = lambda at: F.get("p", F.lit(at)).try_cast("double")
    re_ = F.lit(1.0) if banner.values == "pattern" else value(first)
    im = value(first + 1) if banner.values == "complex" else F.lit(0.0)
    entries = rest.select(i.alias("i"), j.alias("j"), re_.alias("re"), im.alias("im"))
    found = entries.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("i").isNull() | F.col("j").isNull() | F.col("re").isNull() | F.col("im").isNull() | ~F.col("i").between(0, rows - 1) | ~F.col("j").between(0, columns - 1), 1)).alias("bad")).first()
    if found["n"] != expected or found["bad"]:
        raise ValueError(f"{path}: {found['n']} entries, {found['bad']} of them wrong; the size line says {expected}")
    return Matrix(banner, rows, columns, entries)


def read_matrix_market(spark: SparkSession, path: str, lower_triangle: bool = True) -> Graph:
    """Coordinate files as graphs. Each entry is an edge; values are read over.

    Complex sparse matrices are rejected. ``lower_triangle`` asks for entries below the
    diagonal only; without it a symmetric file gives the edges of the whole matrix.
    """
    matrix = read_matrix(spark, path)
    if matrix.banner.format != "coordinate" or matrix.banner.values == "complex":
        raise ValueError(f"only sparse matrices that are not complex are graphs: {matrix.banner.line()}")
    pairs = (matrix.entries if lower_triangle else matrix.mirrored()).select(F.col("i").alias("src"), F.col("j").alias("dst"))
    if lower_triangle and pairs.where("src <= dst").head(1):
        raise ValueError(f"{path}: entries on or above the diagonal")
    return Graph(spark.range(max(matrix.rows, matrix.columns)), pairs, True)


@dataclass(frozen=True)
class FlowProblem:
    """A graph with capacities (``edges.weight``), its source and its sink."""

    graph: Graph
    source: int
    sink: int


def read_dimacs(spark: SparkSession, path: str) -> FlowProblem:
    """Max-flow problem: ``p`` sizes, ``n id s|t``, ``a u v capacity``; ids from 1. Each arc has its reverse with capacity 0."""
    lines = spark.read.text(path).select(_fields(F.col("value")).alias("p"))
    head = lines.where(F.col("p")[0] == "p").head(1)
    if not head:
        raise ValueError(f"{path}: no problem line")
    ends = {r["p"][2]: int(r["p"][1]) - 1 for r in lines.where(F.col("p")[0] == "n").collect()}  # two lines
    arcs = lines.where(F.col("p")[0] == "a").select((F.col("p")[1].try_cast("long") - 1).alias("src"), (F.col("p")[2].try_cast("long") - 1).alias("dst"), F.col("p")[3].try_cast("int").alias("weight"))
    both = arcs.unionByName(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).alias("weight")))
    return FlowProblem(Graph(spark.range(int(head[0]["p"][2])), both, True), ends["s"], ends["t"])


def read_graph(spark: SparkSession, path: str) -> Graph:
    """By extension: .egr, .bin, .txt, .mmio/.mtx. A .txt with a Parquet cache beside it is read from there."""
    kind = Path(path).suffix.lower()
    if kind == ".egr":
        return read_egr(spark, path)
    if kind == ".bin":
        return read_bin(spark, path)
    if kind in (".mmio", ".mtx"):
        return read_matrix_market(spark, path)
    if kind == ".txt":
        return read_snap(spark, path)
    raise ValueError(f"unknown graph format: {path}")


def cached(spark: SparkSession, path: str, cache: str | None = None) -> Graph:
    """The graph of a file, through a Parquet copy that is made and checked once.

    The copy lies in any store that Spark can open, beside the file unless ``cache`` says where.
    """
    base = cache or f"{path}.cache"
    if not exists(spark, f"{base}/checked"):
        graph = read_graph(spark, path)
        graph.vertices.write.mode("overwrite").parquet(f"{base}/vertices")
        graph.edges.select("src", "dst").write.mode("overwrite").parquet(f"{base}/edges")
        again = spark.read.parquet(f"{base}/edges")
        if again.exceptAll(graph.edges.select("src", "dst")).head(1) or graph.edges.select("src", "dst").exceptAll(again).head(1):
            raise ValueError(f"{base}: the copy does not agree with {path}")
        spark.range(1).write.mode("overwrite").parquet(f"{base}/checked")
    return Graph(spark.read.parquet(f"{base}/vertices"), spark.read.parquet(f"{base}/edges"), True)
