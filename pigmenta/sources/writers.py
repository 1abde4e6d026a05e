"""Writers of graph files and of results.

The binary formats and MatrixMarket are single files by definition: rows are cut into sorted ranges, each
range is encoded and written by a task as a piece beside the file, and the pieces are joined in order, block by block. Rows
do not go to the driver. Paths may name any store that pyarrow opens and that driver and executors share. Parquet
is the engine's own sink.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.numbering import numbered
from ..scratch import materialize
from .files import Banner

#: Bytes that are copied at once as pieces are joined, and ids whose degrees one task sums up.
_BLOCK, _BLOCK_IDS = 1 << 22, 1 << 17


def _create(path: str):
    """A binary stream to a new file, a local path or a URI."""
    if "://" not in path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        return open(path, "wb")
    fs, place = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(place.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(place)


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else str(Path(path).resolve()))


def _write_pieces(df: DataFrame, order: list[str], encode: Callable[[pa.RecordBatch], bytes], path: str) -> list[str]:
    """Paths of the pieces, in order, of ``df`` sorted by ``order`` and encoded batch by batch; each one is written by a task."""
    spark = df.sparkSession
    parts = max(1, spark.sparkContext.defaultParallelism)
    path = path if "://" in path else str(Path(path).resolve())
    columns = list(df.columns)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, attempt = task.partitionId(), task.taskAttemptId()
        batch = next(batches, None)
        if batch is None:
            return
        fs, place = _place(f"{path}.piece-{number:06d}-{attempt}")  # attempts do not share a file
        with fs.open_output_stream(place) as out:
            while batch is not None:
                out.write(encode(batch.select(columns)))
                batch = next(batches, None)
        yield pa.RecordBatch.from_pydict({"number": [number], "attempt": [attempt]}, pa.schema([("number", pa.int32()), ("attempt", pa.int64())]))

    ranges = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    done = ranges.mapInArrow(write, "number int, attempt long").collect()  # one row a range
    return [f"{path}.piece-{r['number']:06d}-{r['attempt']}" for r in sorted(done)]


def _join(out: object, pieces: list[str]) -> None:
    """Append pieces to a stream, in blocks, and delete them."""
    for piece in pieces:
        fs, place = _place(piece)
        with fs.open_input_stream(place) as stream:
            while block := stream.read(_BLOCK):
                out.write(block)
        fs.delete_file(place)


def _integers(column: str) -> Callable[[pa.RecordBatch], bytes]:
    return lambda batch: batch.column(column).to_numpy(zero_copy_only=False).astype("<i4").tobytes()


def _index(graph: Graph) -> tuple[int, int, DataFrame]:
    """Vertices, edges, and (id, upto): the edges before the end of each vertex's list."""
    degrees = numbered(graph.degrees(), "at", F.col("id"))
    row = degrees.agg(F.count(F.lit(1)), F.coalesce(F.sum("deg"), F.lit(0)), F.coalesce(F.max("id"), F.lit(-1)), F.coalesce(F.min("id"), F.lit(0))).first()
    nodes, edges, last = int(row[0]), int(row[1]), int(row[2])
    if last + 1 != nodes or row[3] < 0:
        raise ValueError("ids must be 0 to n - 1: use dense_ids")
    if edges >= 1 << 31:
        raise ValueError(f"the format counts edges in 32 bits, which {edges} do not fit")
    block = materialize(degrees.select("id", "deg", F.floor(F.col("at") / _BLOCK_IDS).alias("block")), "degrees")
    sums = block.groupBy("block").agg(F.sum("deg").alias("sum"))
    before = sums.select("block", (F.sum("sum").over(Window.orderBy("block")) - F.col("sum")).alias("before"))  # one row a block of ids
    within = F.sum("deg").over(Window.partitionBy("block").orderBy("id"))
    return nodes, edges, block.select("id", "block", within.alias("within")).join(before, "block").select("id", (F.col("before") + F.col("within")).alias("upto"))


def write_egr(graph: Graph, path: str, weights: bool = False) -> None:
    """Binary CSR with sorted neighbours; weights from ``edges.weight`` (null: 0)."""
    nodes, edges, offsets = _index(graph)
    with _create(path) as out:
        out.write(struct.pack("<iii", nodes, edges, 0))
        _join(out, _write_pieces(offsets, ["id"], _integers("upto"), f"{path}.index"))
        _join(out, _write_pieces(graph.edges.select("src", "dst"), ["src", "dst"], _integers("dst"), f"{path}.list"))
        if weights:
            filled = graph.edges.select("src", "dst", (F.coalesce("weight", F.lit(0)) if "weight" in graph.edges.columns else F.lit(0)).alias("weight"))
            _join(out, _write_pieces(filled, ["src", "dst"], _integers("weight"), f"{path}.weights"))


def write_bin(graph: Graph, path: str) -> None:
    """Binary cache: sizes, sorted neighbours, index."""
    nodes, edges, offsets = _index(graph)
    with _create(path) as out:
        out.write(struct.pack("<iii", nodes, edges, edges))
        _join(out, _write_pieces(graph.edges.select("src", "dst"), ["src", "dst"], _integers("dst"), f"{path}.list"))
        out.write(struct.pack("<i", 0))
        _join(out, _write_pieces(offsets, ["id"], _integers("upto"), f"{path}.index"))


def write_matrix(entries: DataFrame, rows: int, columns: int, path: str, banner: Banner | None = None) -> None:
    """A MatrixMarket file of the entries (i, j, re, im), from 0: sparse, or dense column by column.

    A dense file needs every value that its symmetry stores, once; nothing is filled in.
    """
    banner = banner or Banner("coordinate", "real", "general")
    if not banner.valid:
        raise ValueError(f"no matrix has the banner {banner.line()}")
    sparse = banner.format == "coordinate"
    order = ("i", "j") if sparse else ("j", "i")
    n = entries.count()
    whole = {"general": rows * columns, "skew-symmetric": rows * (rows - 1) // 2}.get(banner.symmetry, rows * (rows + 1) // 2)
    if not sparse and n != whole:
        raise ValueError(f"a dense file of {rows} by {columns} has {whole} values, not {n}")
    number = (lambda x: str(int(x))) if banner.values == "integer" else lambda x: repr(float(x))
    values = {"pattern": [], "complex": ["re", "im"]}.get(banner.values, ["re"])

    def lines(batch: pa.RecordBatch) -> bytes:
        cells = [[str(x + 1) for x in batch.column(c).to_pylist()] for c in ("i", "j") if sparse]
        cells += [[number(x) for x in batch.column(c).to_pylist()] for c in values]
        return "".join(" ".join(row) + "\n" for row in zip(*cells)).encode()

    with _create(path) as out:
        out.write(f"{banner.line()}\n{rows} {columns}{f' {n}' if sparse else ''}\n".encode())
        _join(out, _write_pieces(entries.select("i", "j", "re", "im"), list(order), lines, path))


def write_matrix_market(graph: Graph, path: str) -> None:
    """Each edge to a smaller id as an entry of value 1."""
    low = graph.edges.where("src > dst").select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    n = graph.vertices.count()
    write_matrix(low, n, n, path)


def write_snap(graph: Graph, folder: str) -> None:
    """Edge lines as text files, one a task, after a line with the sizes; any number of edges."""
    n, m = graph.vertices.count(), graph.edges.count()
    head = graph.vertices.sparkSession.range(1).select(F.lit(f"# Nodes: {n} Edges: {m}").alias("value"))
    head.unionByName(graph.edges.select(F.concat_ws("\t", "src", "dst").alias("value"))).write.text(folder)


def write_dimacs(edges: DataFrame, nodes: int, source: int, sink: int, path: str) -> None:
    """A max-flow problem of arcs (src, dst, weight); ids from 1 in the file."""
    m = edges.count()
    with _create(path) as out:
        out.write(f"p max {nodes} {m}\nn {source + 1} s\nn {sink + 1} t\n".encode())
        for row in edges.orderBy("src", "dst", "weight").toLocalIterator():
            out.write(f"a {row['src'] + 1} {row['dst'] + 1} {row['weight']}\n".encode())


def write_parts(edges: DataFrame, folder: str, stem: str) -> list[str]:
    """One text file a part, ``<stem>_<part + 1>.txt``, from (part, src, dst) with local ids."""
    sizes = {r["part"]: (r["n"], r["m"]) for r in edges.groupBy("part").agg((F.max(F.greatest("src", "dst")) + 1).alias("n"), F.count(F.lit(1)).alias("m")).collect()}  # one row a part
    paths = []
    for part in sorted(sizes):
        path = f"{folder}/{stem}_{part + 1}.txt"
        with _create(path) as out:
            out.write(f"# Part {part + 1} of {stem}\n# Nodes: {sizes[part][0]} Edges: {sizes[part][1]}\n# FromNodeId\tToNodeId\n".encode())
            for row in edges.where(F.col("part") == part).orderBy("src", "dst").toLocalIterator():
                out.write(f"{row['src']}\t{row['dst']}\n".encode())
        paths.append(path)
    return paths


def write_runs_json(runs: list[dict], config: dict, path: str) -> None:
    """Result file: the configuration and, for each dataset, its best run and all runs."""
    datasets: dict[str, dict] = {}
    for run in runs:
        datasets.setdefault(run["dataset"], {"all_runs": []})["all_runs"].append(run)
    for found in datasets.values():
        good = [r for r in found["all_runs"] if r.get("ok", True) and r.get("color") is not None]
        best = min(good, key=lambda r: (r["color"], r["runtime_ms"]), default=None)
        found |= {"best_color": best and best["color"], "best_runtime_ms": best and best["runtime_ms"]}
    Path(path).write_text(json.dumps({"config": config, "datasets": datasets}, indent=2))


def write_runs_csv(runs: DataFrame, path: str, append: bool = False) -> None:
    """Result table as CSV with a header."""
    runs.write.mode("append" if append else "overwrite").option("header", True).csv(path)
