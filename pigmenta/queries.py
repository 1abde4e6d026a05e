"""Graph queries by name, each with (spark, sf_dir), and their oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .functions import int_hash
from .graph import Graph
from .operators import degrees, flow, verify
from .operators.coloring import color_rounds
from .operators.local import TooLarge
from .operators.numbering import dense_ids
from .operators.order import dag, keyed
from .operators.partition import boundary, boundary_graph, color_boundary, cut_edges, members, part_edges, partition
from .operators.peel import peel_rounds
from .plans import algorithm, color, margin, order_keys, priorities
from .plans import experiments as ex
from .plans import logs
from .plans import theta as th
from .plans.report import timed
from .scratch import materialize, scratch_path
from .sources import files, writers
from .sources.tables import GRAPHS, consecutive_pairs

Query = Callable[[SparkSession, str], DataFrame]


def _graph(spark: SparkSession, sf_dir: str, name: str = "g1") -> Graph:
    return GRAPHS[name](spark, sf_dir)


def _stored(spark: SparkSession, sf_dir: str, name: str = "g1") -> Graph:
    return _graph(spark, sf_dir, name).stored(name)


def _edges(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir, name).edges


def _peel(rule: str, theta: int, engine: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """In rounds over buckets, however small the graph, or in one task."""
    return priorities(_stored(spark, sf_dir), rule, theta, engine, bucket_edges=0).select("id", "round", "rdeg", "theta", "pri")


def _color(name: str, theta: int, engine: str, graph: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the engine; one task with the edges on its disk takes what the local one cannot hold, or else the rounds between buckets, with the same colours."""
    g, what = _stored(spark, sf_dir, graph), algorithm(name)
    for by in (engine, "disk"):
        try:
            return color(g, name, theta, by)
        except TooLarge:
            if what.kernel and by == "disk":
                raise
    return color_rounds(g, order_keys(g, what, theta, by=peel_rounds))


def _bucket_color(name: str, theta: int, graph: str, most: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours in rounds between buckets of at most so many edges, hubs apart."""
    g = _stored(spark, sf_dir, graph)
    keys = order_keys(g, algorithm(name), theta)
    return color_rounds(g, keys, bucket_edges=most, hub_edges=20)


def degree_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).degrees()


def hash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id")).distinct()
    return keys.select("id", int_hash(F.col("id")).alias("hash"))


def isolated_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id")).distinct()
    return degrees.isolated(Graph(parts, _graph(spark, sf_dir, "g4").edges))


def dag_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _stored(spark, sf_dir)
    return dag(g, materialize(keyed(g.degrees(), "large_degree"), "keys"))


def histogram_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.histogram(color(_stored(spark, sf_dir), "ldf"))


def colors_used_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _stored(spark, sf_dir)
    return verify.verify(g, materialize(color(g, "ldf"), "colors"))


def broken_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the check says of numbers that are no colouring, and of vertices without any."""
    g = _stored(spark, sf_dir)
    return verify.verify(g, g.vertices.where("id % 7 != 0").select("id", F.pmod("id", F.lit(5)).cast("int").alias("color")))


def triangle_query(which: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw pairs, with loops and repeats, and those of one direction."""
    pairs = consecutive_pairs(spark, sf_dir).select(F.col("a").cast("long").alias("src"), F.col("b").cast("long").alias("dst"))
    if which == "below":
        pairs = pairs.where("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    return degrees.lower_triangle(Graph(pairs.select(F.col("src").alias("id")).distinct(), pairs, True))


def status_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as vertices: some have no edge."""
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id")).distinct()
    return degrees.graph_status(Graph(ids, _graph(spark, sf_dir, "g4").edges).stored("status"))


def symmetry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees.symmetry(_stored(spark, sf_dir))


def _parts(method: str, spark: SparkSession, sf_dir: str, name: str = "g4", k: int = 4) -> tuple[Graph, DataFrame]:
    g = _stored(spark, sf_dir, name)
    return g, materialize(partition(g, k, method), "parts")


def partition_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts("rr", spark, sf_dir)[1]


def sizes_query(method: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(method, spark, sf_dir)[1].groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def boundary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary(*_parts("rr", spark, sf_dir))


def cut_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_edges(*_parts("rr", spark, sf_dir)).groupBy("src_part", "dst_part").agg(F.count(F.lit(1)).alias("n"))


def members_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(*_parts("rr", spark, sf_dir), 4, "all")


def part_edges_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_edges(*_parts("rr", spark, sf_dir))


def propagated_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label propagation keeps its capacity and cuts fewer edges than the random parts it starts from."""
    g, parts = _parts("lp", spark, sf_dir)
    room = int(-(-g.vertices.count() * 1.03 // 4))
    cut = cut_edges(g, parts).agg(F.count(F.lit(1)).alias("cut"))
    before = cut_edges(g, partition(g, 4, "random")).agg(F.count(F.lit(1)).alias("before"))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n_vertices"), F.max("n").alias("largest"))
    return sizes.join(cut).join(before).select("parts", "n_vertices", (F.col("largest") <= room).alias("within_capacity"), (F.col("cut") < F.col("before")).alias("cuts_less"))


def multilevel_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vertex has one part, parts are of nearly one size, and fewer edges are cut than by label propagation."""
    g, parts = _parts("metis", spark, sf_dir, name)
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n_vertices"), F.max("n").alias("largest"))
    once = parts.join(g.vertices, "id").agg(F.countDistinct("id").alias("distinct_vertices"))
    cut = cut_edges(g, parts).agg(F.count(F.lit(1)).alias("cut"))
    other = cut_edges(g, partition(g, 4, "lp")).agg(F.count(F.lit(1)).alias("other"))
    row = counts.join(once).join(cut).join(other)  # one row each
    return row.select("parts", "n_vertices", "distinct_vertices", (F.col("largest") * 4 <= F.ceil(F.col("n_vertices") * 1.05)).alias("balanced"), (F.col("cut") < F.col("other")).alias("cuts_less"))


def boundary_graph_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, parts = _parts("rr", spark, sf_dir)
    return boundary_graph(g, boundary(g, parts)).edges


def boundary_colors_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, parts = _parts("rr", spark, sf_dir)
    return color_boundary(g, materialize(boundary(g, parts), "edge"), 10)


def part_colors_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return color(_stored(spark, sf_dir, "g4"), "sl_els_sdc", 10, parts=4, partitioner="rr", copies="all")


def _rgp(method: str, copies: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _stored(spark, sf_dir, "g4")
    found = materialize(color(g, "sl_els_sdc", 10, parts=4, partitioner=method, copies=copies), "colors")
    return verify.verify(g, found).select("n_vertices", "uncolored", "conflicts")


def _dense(spark: SparkSession, sf_dir: str) -> Graph:
    """The part graph with ids 0 to n - 1, as files need them."""
    g = _stored(spark, sf_dir)
    ids = materialize(dense_ids(g.vertices), "dense")
    left, right = (ids.select(F.col("id").alias(c), F.col("dense").alias(f"{c}_")) for c in ("src", "dst"))
    edges = g.edges.join(left, "src").join(right, "dst").select(F.col("src_").alias("src"), F.col("dst_").alias("dst"))
    return Graph(ids.select(F.col("dense").alias("id")), edges).stored("dense")


def file_query(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of a graph written as a file of the kind and read back."""
    g, path = _dense(spark, sf_dir), f"{scratch_path(spark, 'files')}/g.{kind}"
    if kind in ("egr", "bin"):
        (writers.write_egr if kind == "egr" else writers.write_bin)(g, path)
        return files.read_graph(spark, path).edges.select("src", "dst")
    if kind == "mtx":
        writers.write_matrix_market(g, path)
        return files.read_graph(spark, path).edges
    once = Graph(g.vertices, g.edges.where("src < dst"))
    writers.write_snap(once, path)
    return files.cached(spark, path).edges


def weights_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, path = _dense(spark, sf_dir), f"{scratch_path(spark, 'files')}/w.egr"
    writers.write_egr(Graph(g.vertices, g.edges.withColumn("weight", (F.col("src") * 3 + F.col("dst")).cast("int"))), path, weights=True)
    return files.read_egr(spark, path).edges.select("src", "dst", "weight")


def strict_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and ids of a text file, checked, and its lines as they are."""
    g, path = _dense(spark, sf_dir), scratch_path(spark, "strict")
    writers.write_snap(Graph(g.vertices, g.edges.where("src < dst")), path)
    meta = files.snap_meta(spark, path)
    read = files.read_snap(spark, path, symmetrize=False, strict=True)
    return read.edges.agg(F.count(F.lit(1)).alias("edges"), F.min("src").alias("low"), F.max("dst").alias("high")).select("*", F.lit(meta.nodes).cast("long").alias("header_nodes"), F.lit(meta.edges).cast("long").alias("header_edges"), F.lit(meta.zero_based).alias("zero_based"))


def compact_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a text file whose ids are numbered as they first occur; loops and repeats go."""
    path = scratch_path(spark, "lines")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").orderBy("o_orderkey").coalesce(1)
    orders.select(F.concat_ws(" ", F.col("o_custkey"), (F.col("o_orderkey") * 37) % 977).alias("value")).write.text(path)
    return files.read_snap(spark, path, simple=True, compact=True).edges


def matrix_query(form: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a matrix written, read back and mirrored: sparse complex, or dense, by symmetry."""
    path = f"{scratch_path(spark, 'matrix')}/m.mtx"
    if form == "dense":
        banner = files.Banner("array", "real", "skew-symmetric")
        pairs = spark.range(40).select(F.col("id").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("i")))).where("i > j")
        entries, size = pairs.select("i", "j", (F.col("i") * 100.5 + F.col("j")).alias("re"), F.lit(0.0).alias("im")), 40
    else:
        banner, g = files.Banner("coordinate", "complex", "hermitian"), _dense(spark, sf_dir)
        low = g.edges.where("src > dst")
        entries, size = low.select(F.col("src").alias("i"), F.col("dst").alias("j"), (F.col("src") / 4).alias("re"), (F.col("dst") / 8).alias("im")), g.vertices.count()
    writers.write_matrix(entries, size, size, path, banner)
    return files.read_matrix(spark, path).mirrored()


def part_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the files of all parts, with their part."""
    edges = materialize(part_edges(*_parts("rr", spark, sf_dir)), "part-edges")
    paths = writers.write_parts(edges, f"{scratch_path(spark, 'parts')}", "g4")
    read = [files.read_snap(spark, p, symmetrize=False).edges.withColumn("part", F.lit(int(p.rpartition("_")[2].removesuffix(".txt")) - 1)) for p in paths]
    return reduce(DataFrame.unionByName, read).select("part", "src", "dst")


def _flow(spark: SparkSession, sf_dir: str) -> files.FlowProblem:
    """From customers by region and nation to suppliers: a tree of arcs, written and read as a file."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nations = table("nation").select((F.col("n_nationkey") + 100).cast("long").alias("nation"), (F.col("n_regionkey") + 1).cast("long").alias("region"))
    count = lambda name, key: table(name).groupBy((F.col(key) + 100).cast("long").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    customers = nations.join(count("customer", "c_nationkey"), "nation", "left").select("region", "nation", F.coalesce("n", F.lit(0)).alias("n"))
    suppliers = nations.join(count("supplier", "s_nationkey"), "nation", "left").select("nation", F.coalesce("n", F.lit(0)).alias("n"))
    arcs = customers.groupBy("region").agg(F.sum("n").alias("n")).select(F.lit(0).cast("long").alias("src"), F.col("region").alias("dst"), F.floor(F.col("n") * 2 / 3).cast("int").alias("weight"))
    arcs = arcs.unionByName(customers.select(F.col("region").alias("src"), F.col("nation").alias("dst"), F.col("n").cast("int").alias("weight")))
    arcs = arcs.unionByName(suppliers.select(F.col("nation").alias("src"), F.lit(1000).cast("long").alias("dst"), (F.col("n") * 9).cast("int").alias("weight")))
    path = f"{scratch_path(spark, 'flow')}/f.max"
    writers.write_dimacs(arcs, 1001, 0, 1000, path)
    return files.read_dimacs(spark, path)


def max_flow_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.max_flow(_flow(spark, sf_dir))


def residual_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.residual(_flow(spark, sf_dir).graph.edges)


def flow_vertices_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.describe(_flow(spark, sf_dir)).where("arcs > 0")


def reachable_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that a chain of rising order keys reaches from the first one."""
    edges = _stored(spark, sf_dir, "g4").edges.where("src < dst")
    return flow.reachable(edges, edges.agg(F.min("src")).first()[0])


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table of graphs: vertices and edges of the suppliers' nations, by nation."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey")
    return lines.groupBy((F.col("l_suppkey") % 10).alias("dataset")).agg(F.countDistinct("l_partkey").alias("v"), F.count(F.lit(1)).alias("e"))


def theta_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir).select("dataset", "v", "e", F.round(th.linear_score(F.col("v"), F.col("e"))).cast("int").alias("theta"))


def kernel_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel sum with vectors taken from the data: the model's own are loaded from where it is kept."""
    sizes = _sizes(spark, sf_dir)
    vectors = sizes.select("v", "e", ((F.col("dataset") - 4.5) / 5).alias("alpha"))
    return th.kernel_score(sizes, vectors, gamma=1e-6).select("dataset", F.round("score", 6).alias("score"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs made up from the order table: five a dataset and margin."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    rows = orders.select(
        (F.col("o_custkey") % 7).cast("int").alias("dataset"), (F.col("o_orderkey") % 3).cast("int").alias("algorithm"), (F.col("o_orderkey") % 20).cast("int").alias("theta"), F.col("o_orderkey").cast("int").alias("run_idx"),
        F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_totalprice").cast("long") % 9).cast("int")).alias("color"), F.col("o_totalprice").alias("runtime_ms"),
    )
    return rows


def best_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.best_runs(_runs(spark, sf_dir)).select("dataset", "algorithm", "run_idx", "color", "runtime_ms")


def best_by_colors_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.best_runs(_runs(spark, sf_dir), by_runtime=False).select("dataset", "algorithm", "run_idx", "color", "runtime_ms")


def labels_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ex.best_runs(_runs(spark, sf_dir).withColumn("algorithm", F.col("theta"))).select("dataset", "theta", "color", "runtime_ms")
    return th.labels(best)


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _sizes(spark, sf_dir).select(th.linear_score(F.col("v"), F.col("e")).alias("prediction"), (F.lit(1.0) + F.col("dataset") / 5).alias("truth"))
    return th.quality(scored).select(*(F.round(c, 6).alias(c) for c in ("violation_ratio", "mse", "rmse", "r2")))


def features_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return th.features(_sizes(spark, sf_dir).unionByName(_sizes(spark, sf_dir).select((F.col("dataset") + 100).alias("dataset"), (F.col("e") * 3).alias("v"), F.col("v").alias("e"))))


def _phase_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    device = lambda i: F.concat(F.lit(f"\n| {i}      | "), key % 5 + i, F.lit("               |          "), (key / 16 + i).cast("decimal(12,4)"), F.lit(" |              "), (key % 900).cast("decimal(8,2)"), F.lit(" |             24111.06 |"))
    text = F.concat(F.lit("nodes: "), F.col("o_custkey"), F.lit("\n  Edges: 5\nColors  Used: "), key % 31, F.lit("\nPhase 1 (Boundary+Preload)    : "), (key / 4).cast("decimal(12,4)"), F.lit(" ms\nPhase 2 (Parallel Exec)       :     1.5000 ms"), F.when(key % 3 == 0, "\nPhase 3 (Result Merge)        :     0.2500 ms").otherwise(""), F.lit("\n| GPU ID | Partitions      | Exec Time (ms)   |"), device(0), F.when(key % 2 == 0, device(1)).otherwise(""))
    return orders.select(key.alias("run"), text.alias("text"))


def phase_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_logs(_phase_logs(spark, sf_dir)).select("run", "nodes", F.coalesce("edges", F.lit(-1)).cast("long").alias("edges"), "color", "phase_1_ms", "phase_2_ms", "phase_3_ms")


def device_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_devices(_phase_logs(spark, sf_dir))


def log_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.concat(F.lit("Nodes: "), F.col("o_custkey"), F.lit("\nEdges: "), F.col("o_orderkey"), F.lit("\nEGC θ: "), F.col("o_orderkey") % 13, F.when(F.col("o_orderkey") % 2 == 0, " (Predicted)").otherwise(""), F.lit("\nruntime: "), (F.col("o_orderkey") / 8).cast("decimal(10,3)"), F.lit(" ms\ncolors used: "), F.col("o_custkey") % 40, F.lit("\nIter count: "), F.col("o_orderkey") % 17)
    found = logs.parse_logs(orders.select(F.col("o_orderkey").alias("run"), text.alias("text")))
    return found.drop("phase_1_ms", "phase_2_ms", "phase_3_ms")


def margin_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The margin that the linear model predicts for the part graph and for the dense one, by their own sizes."""
    rows = [(name, margin(_stored(spark, sf_dir, name), "linear")) for name in ("g1", "g2")]
    return spark.createDataFrame(rows, "graph string, theta int")


def run_log_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log of a run says, read back."""
    run = timed(_stored(spark, sf_dir), "sl_els_sdc", 10)
    text = spark.createDataFrame([(1, run.log())], "run int, text string")
    return logs.parse_logs(text).select("nodes", "edges", "theta", "color", "iter_count", "theta_predicted")


def throughput_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = verify.throughput(F.col("v"), F.col("e"), F.col("dataset") / 8 + 1)
    return _sizes(spark, sf_dir).select("dataset", *(F.round(c, 9).alias(name) for name, c in figures.items()))


def grid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs over margins and over parts, by their colours."""
    graphs = {"g4": _stored(spark, sf_dir, "g4")}
    whole = ex.measure(spark, graphs, ["sl_els", "ldf"], thetas=(0, 10), engine="local")
    parted = ex.measure(spark, graphs, ["sl_els_sdc"], thetas=(10,), parts=(4,), partitioners=("rr",), copies="all")
    return whole.unionByName(parted).select("dataset", "algorithm", "theta", "parts", "partitioner", "color", "nodes", "edges", "ok")


def one_part_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph in one part, and in parts without a cut: nothing is at a boundary."""
    g = _stored(spark, sf_dir, "g4")
    apart = Graph(g.vertices, g.edges.where("src % 4 = dst % 4"))
    return partition(g, 1).groupBy("part").agg(F.count(F.lit(1)).alias("n")).join(boundary(apart, partition(apart, 4, "rr")).agg(F.count(F.lit(1)).alias("at_boundary")))


def zero_weights_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a file that was written with weights for a graph without any: they are 0."""
    g, path = _dense(spark, sf_dir), f"{scratch_path(spark, 'files')}/z.egr"
    writers.write_egr(g, path, weights=True)
    return files.read_egr(spark, path).edges.select("src", "dst", "weight")


_RUNS_SQL = """runs as (select (o_custkey % 7)::int dataset, (o_orderkey % 3)::int algorithm, (o_orderkey % 20)::int theta, o_orderkey::int run_idx,
  case when o_orderkey % 11 <> 0 then (trunc(o_totalprice)::bigint % 9)::int end color, o_totalprice runtime_ms from orders)"""
_SIZES_SQL = "sizes as (select l_suppkey % 10 dataset, count(distinct l_partkey) v, count(*) e from lineitem group by 1)"
_LINEAR_SQL = "1.0825496073100667::double + 5.954294734547475e-07::double * v + 1.2596129615914713e-07::double * e"


def _best_sql(tie: str) -> str:
    return f"with {_RUNS_SQL} select dataset, algorithm, run_idx, color, runtime_ms from runs where color is not null qualify row_number() over (partition by dataset, algorithm order by color, {tie}, run_idx) = 1"


_LABELS_SQL = f"""with recursive {_RUNS_SQL},
best as materialized (select dataset, theta, color, runtime_ms, row_number() over (partition by dataset order by theta) i from (
  select * from runs where color is not null qualify row_number() over (partition by dataset, theta order by color, runtime_ms, run_idx) = 1)),
walk(dataset, i, theta, base, last, go) as (
  select dataset, i, theta, color, runtime_ms, true from best where i = 1
  union all
  select w.dataset, b.i, case when b.color <= w.base then b.theta else w.theta end, w.base, b.runtime_ms, b.color <= w.base and w.last / b.runtime_ms > 1.2
  from walk w join best b on b.dataset = w.dataset and b.i = w.i + 1 where w.go)
select dataset, max(theta) as theta from walk group by 1"""

_MEMBERS_SQL = f"""with {oracle.graph("g4")}, part as (select v id, (v % 4)::int part from deg),
cut as (select e.src, e.dst from edges e join part a on a.id = e.src join part b on b.id = e.dst where a.part <> b.part),
edge as (select src id from cut union select dst from cut),
m as (select part, id, true is_owned, id in (select id from edge) is_boundary from part
  union all select k::int, e.id, false, true from edge e join part using (id) cross join range(4) t(k) where k <> part)
select part, (row_number() over (partition by part order by is_owned desc, id) - 1)::int as local_id, id, is_owned, is_boundary from m"""
_CUT_SQL = f"""with {oracle.graph("g4")}, cut as (select src, dst, (src % 4)::int src_part, (dst % 4)::int dst_part from edges where src % 4 <> dst % 4)"""

_RULES = (("sl_els", 0), ("sl_els", 3), ("sl_els", 10), ("sl_els_sdc", 3), ("sl_els_sdc", 10), ("rgp", 10), ("jp_sl", 10), ("jp_sll", 0), ("jp_adg", 0), ("cpu_adg", 0), ("cpu_sl", 0), ("cpu_sll", 0))
_COLORS = (
    ("ldf", "ldf", None, "large_degree", 0), ("ecl", "ecl", None, "degree", 0), ("greedy_degree", "greedy", None, "degree_id", 0), ("natural", "natural", None, "natural", 0),
    ("sl_els_t0", "sl_els", "sl_els", "device", 0), ("sl_els_t10", "sl_els", "sl_els", "device", 10), ("sl_els_sdc_t3", "sl_els_sdc", "sl_els_sdc", "device", 3), ("sl_els_sdc_t10", "sl_els_sdc", "sl_els_sdc", "device", 10),
    ("jp_sl_t10", "jp_sl", "jp_sl", "device", 10), ("jp_sll", "jp_sll", "jp_sll", "device", 0), ("jp_adg", "jp_adg", "jp_adg", "device", 0), ("cpu_adg", "cpu_adg", "cpu_adg", "cpu", 0), ("cpu_sl", "cpu_sl", "cpu_sl", "cpu", 0), ("cpu_sll", "cpu_sll", "cpu_sll", "cpu", 0),
)


def _registry() -> tuple[dict[str, Query], dict[str, str]]:
    q: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def add(name: str, query: Query, oracle_sql: str | None = None) -> None:
        q[name] = query
        if oracle_sql is not None:
            sql[name] = oracle_sql

    for name in GRAPHS:
        add(f"{name}_edges", partial(_edges, name), oracle.edges_of(name))
    g1 = oracle.graph("g1")
    add("degree", degree_query, f"with {g1} select v as id, d as deg from deg")
    add("degree_stats", lambda s, d: degrees.degree_stats(_graph(s, d)), f"with {g1} select count(*) as n_vertices, sum(d)::bigint as n_edges, avg(d) as avg_degree, stddev_pop(d) as std_degree, min(d) as min_degree, max(d) as max_degree from deg")
    add("degree_extremes", lambda s, d: degrees.degree_extremes(_graph(s, d)), f"with {g1} select (select v from deg order by d desc, v limit 1) as max_id, (select max(d) from deg) as max_degree, (select v from deg order by d, v limit 1) as min_id, (select min(d) from deg) as min_degree")
    add("isolated_vertices", isolated_query, f"with {oracle.graph('g4')} select distinct o_orderkey as id from orders where o_orderkey not in (select src from edges)")
    add("graph_status", status_query, f"""with {oracle.graph('g4')}, d as (select o_orderkey id, coalesce(d, 0) d from (select distinct o_orderkey from orders) left join deg on v = o_orderkey)
select count(*) as n_vertices, sum(d)::bigint as n_edges, avg(d) as avg_degree, stddev_pop(d) as std_degree, min(d) as min_degree, max(d) as max_degree,
(select id from d order by d desc, id limit 1) as max_id, (select id from d order by d, id limit 1) as min_id, count(*) filter (where d = 0) as isolated, 0::bigint as one_way, 0::bigint as loops, bool_or(id = 0) as has_zero from d""")
    raw = "raw as (select x.l_partkey src, y.l_partkey dst from lineitem x join lineitem y on x.l_orderkey = y.l_orderkey and x.l_linenumber + 1 = y.l_linenumber)"
    triangle = "select coalesce(sum(n) filter (where dst >= src), 0)::bigint as upward, coalesce(sum(n - 1), 0)::bigint as repeated, coalesce(sum(n) filter (where dst >= src), 0) + coalesce(sum(n - 1), 0) = 0 as is_lower_triangle from (select src, dst, count(*) n from {} group by 1, 2)"
    add("lower_triangle", partial(triangle_query, "raw"), f"with {raw} {triangle.format('raw')}")
    add("lower_triangle_below", partial(triangle_query, "below"), f"with {raw} {triangle.format('(select distinct greatest(src, dst) src, least(src, dst) dst from raw where src <> dst)')}")
    add("symmetric_check", symmetry_query, f"with {g1} select (select count(*) from edges e where not exists (select 1 from edges r where r.src = e.dst and r.dst = e.src)) as one_way, (select count(*) from edges where src = dst) as loops, (select count(*) from edges) as degree_sum, exists (select 1 from deg where v = 0) as has_zero")
    add("int_hash", hash_query, "select id, xor(h2 >> 16, h2) as hash from (select id, " + oracle._X.format("h1") + " h2 from (select id, " + oracle._X.format("id") + " h1 from (select distinct o_orderkey id from orders)))")
    add("priority_dag_ldf", dag_query, f"with {g1}, {oracle.HASHED}, prio as (select v, row_number() over (order by {oracle.ORDERS['large_degree']}) rk from deg_h) select e.src as id, e.dst as higher from edges e join prio a on a.v = e.src join prio b on b.v = e.dst where b.rk < a.rk")
    for rule, theta in _RULES:
        found = oracle.peel_of("g1", rule, theta)
        add(f"peel_{rule}_t{theta}", partial(_peel, rule, theta, "dataframe"), found)
        add(f"peel_{rule}_t{theta}_local", partial(_peel, rule, theta, "local"), found)
    for name, algorithm, rule, order, theta in _COLORS:
        found = oracle.color_of("g1", order, rule, theta)
        add(f"color_{name}", partial(_color, algorithm, theta, "dataframe", "g1"), found)
        add(f"color_{name}_local", partial(_color, algorithm, theta, "local", "g1"), found)
    add("color_buckets_ldf", partial(_bucket_color, "ldf", 0, "g1", 20_000), oracle.color_of("g1", "large_degree"))
    add("color_buckets_natural", partial(_bucket_color, "natural", 0, "g4", 4_000), oracle.color_of("g4", "natural"))
    add("color_dense_ldf", partial(_color, "ldf", 0, "dataframe", "g2"), oracle.color_of("g2", "large_degree"))
    add("color_bipartite_sl_els_t10", partial(_color, "sl_els", 10, "dataframe", "g3"), oracle.color_of("g3", "device", "sl_els", 10))
    add("color_rounds_sl_els_sdc_t10", partial(_color, "sl_els_sdc", 10, "dataframe", "g4"), oracle.color_of("g4", "device", "sl_els_sdc", 10))
    for name, found in (("smallest_last", oracle.smallest_last_of("g1")), ("dsatur", oracle.saturation_of("g1")), ("speculative", oracle.speculative_of("g1"))):
        add(f"color_{name}", partial(_color, name, 0, "dataframe", "g1"), found)
    add("color_histogram", histogram_query, oracle.color_of("g1", "large_degree", select="select color::int as color, count(*) as n, 100.0 * sum(count(*)) over (order by color) / sum(count(*)) over () as cumulative_percent from k group by color qualify color < 16"))
    add("verify_ldf", colors_used_query, oracle.color_of("g1", "large_degree", select="select count(*) as n_vertices, 0::bigint as uncolored, max(color) + 1 as colors_used, 0::bigint as conflicts from k"))
    add("verify_conflicts", broken_query, f"""with {g1}, c as (select v, (v % 5)::int c from deg where v % 7 <> 0)
select (select count(*) from deg) as n_vertices, (select count(*) from deg where v % 7 = 0) as uncolored, (select max(c) + 1 from c)::bigint as colors_used,
(select count(*) from edges join c a on a.v = src join c b on b.v = dst where src < dst and a.c = b.c) as conflicts""")
    add("partition_rr", partition_query, f"with {oracle.graph('g4')} select v as id, (v % 4)::int as part from deg")
    sizes = f"with {oracle.graph('g4')} select k::int as part, (select count(*) from deg) // 4 + (k < (select count(*) from deg) % 4)::int as n from range(4) t(k)"
    add("partition_random_sizes", partial(sizes_query, "random"), sizes)
    add("partition_ldg", lambda s, d: _parts("ldg", s, d, "g1")[1], oracle.greedy_partition_of("g1", 4))
    add("partition_ldg_sizes", partial(sizes_query, "ldg"), f"select part, count(*) as n from ({oracle.greedy_partition_of('g4', 4)}) group by 1")
    add("partition_lp", propagated_query, f"with {oracle.graph('g4')} select 4::bigint as parts, count(*) as n_vertices, true as within_capacity, true as cuts_less from deg")
    for name in ("g1", "g4"):
        add(f"partition_multilevel_{name}", partial(multilevel_query, name), f"with {oracle.graph(name)} select 4::bigint as parts, count(*) as n_vertices, count(*) as distinct_vertices, true as balanced, true as cuts_less from deg")
    add("boundary_rr", boundary_query, _CUT_SQL + " select src as id from cut union select dst from cut")
    add("cut_edges_rr", cut_query, _CUT_SQL + " select src_part, dst_part, count(*) as n from cut group by 1, 2")
    add("subgraph_members_rr", members_query, _MEMBERS_SQL)
    add("part_edges_rr", part_edges_query, f"with {oracle.graph('g4')}, ids as (select v, (v % 4)::int part, (row_number() over (partition by v % 4 order by v) - 1)::int lid from deg) select a.part, a.lid as src, b.lid as dst from edges e join ids a on a.v = e.src join ids b on b.v = e.dst and a.part = b.part where a.lid < b.lid")
    add("boundary_graph_rr", boundary_graph_query, _CUT_SQL + ", edge as (select src v from cut) select src, dst from edges where src in (select v from edge) and dst in (select v from edge)")
    add("color_boundary_rr4", boundary_colors_query, oracle.boundary_colors_of("g4", 4, 10))
    add("color_rgp_rr4", part_colors_query, oracle.part_colors_of("g4", 4, 10))
    for method in ("ldg", "random", "lp"):
        add(f"color_rgp_{method}4", partial(_rgp, method, "all"), oracle.summary_of("g4"))
    add("color_rgp_halo4", partial(_rgp, "lp", "halo"), oracle.summary_of("g4"))
    dense = f"with {g1}, ids as (select v, row_number() over (order by v) - 1 i from deg), dense as (select a.i src, b.i dst from edges join ids a on a.v = src join ids b on b.v = dst)"
    for kind in ("egr", "bin", "txt"):
        add(f"file_{kind}", partial(file_query, kind), f"{dense} select src, dst from dense")
    add("file_mtx", partial(file_query, "mtx"), f"{dense} select src, dst from dense where src > dst")
    add("file_egr_weights", weights_query, f"{dense} select src, dst, (src * 3 + dst)::int as weight from dense")
    add("file_txt_strict", strict_query, f"{dense} select count(*) as edges, min(src) as low, max(dst) as high, (select count(*) from ids) as header_nodes, count(*) as header_edges, true as zero_based from dense where src < dst")
    add("file_txt_compact", compact_query, """with l as (select o_custkey a, (o_orderkey * 37) % 977 b, row_number() over (order by o_orderkey) i from orders),
ids as (select id, row_number() over (order by min(p)) - 1 c from (select a id, 2 * i p from l union all select b, 2 * i + 1 from l) group by id),
p as (select distinct least(x.c, y.c) a, greatest(x.c, y.c) b from l join ids x on x.id = l.a join ids y on y.id = l.b where x.c <> y.c)
select a as src, b as dst from p union all select b, a from p""")
    add("matrix_hermitian", partial(matrix_query, "sparse"), f"{dense} select src as i, dst as j, greatest(src, dst) / 4 as re, case when src > dst then 1 else -1 end * least(src, dst) / 8 as im from dense")
    add("matrix_dense_skew", partial(matrix_query, "dense"), "with p as (select i::bigint i, j::bigint j, i * 100.5 + j re from range(40) a(i), range(40) b(j) where i > j) select i, j, re::double as re, 0.0::double as im from p union all select j, i, -re::double, 0.0::double from p")
    add("part_files_rr", part_files_query, f"with {oracle.graph('g4')}, ids as (select v, (v % 4)::int part, row_number() over (partition by v % 4 order by v) - 1 lid from deg) select a.part, a.lid as src, b.lid as dst from edges e join ids a on a.v = e.src join ids b on b.v = e.dst and a.part = b.part where a.lid < b.lid")
    arcs = """n as (select n_nationkey + 100 nation, n_regionkey + 1 region, (select count(*) from customer where c_nationkey = n_nationkey) c, 9 * (select count(*) from supplier where s_nationkey = n_nationkey) s from nation),
arcs as (select 0::bigint src, region::bigint dst, (sum(c) * 2 // 3)::bigint w from n group by region union all select region, nation, c from n union all select nation, 1000, s from n)"""
    add("max_flow", max_flow_query, f"with {arcs}, r as (select least(sum(c) * 2 // 3, sum(least(c, s))) f from n group by region) select sum(f)::bigint as max_flow, sum(f) > 0 as has_path from r")
    add("flow_residual", residual_query, f"with {arcs} select src, dst, w as residual, 0::bigint as back from arcs union all select dst, src, 0, w from arcs")
    add("flow_vertices", flow_vertices_query, f"""with {arcs}, b as (select src, dst, w f, 0 r from arcs union all select dst, src, 0, w from arcs)
select src as id, case src when 0 then 'source' when 1000 then 'sink' else 'inner' end as kind, sum(f)::bigint as out_room, sum(r)::bigint as in_room, count(*) as arcs from b group by src""")
    add("flow_reachable", reachable_query, f"with recursive {oracle.graph('g4')}, r(id) as (select min(src) from edges union select dst from r join edges on src = id where dst > src) select id from r")
    add("theta_features", features_query, f"with {_SIZES_SQL}, g as (select dataset, v, e from sizes union all select dataset + 100, 3 * e, v from sizes) select dataset, v::int as v, e::int as e, trunc(v / e)::int as ratio from g")
    add("parse_phases", phase_query, "select o_orderkey as run, o_custkey as nodes, -1::bigint as edges, (o_orderkey % 31)::int as color, cast(cast(o_orderkey / 4 as decimal(12,4)) as double) as phase_1_ms, 1.5::double as phase_2_ms, case when o_orderkey % 3 = 0 then 0.25::double end as phase_3_ms from orders")
    add("parse_devices", device_query, "select o_orderkey as run, i::int as device, (o_orderkey % 5 + i)::int as parts, cast(cast(o_orderkey / 16 + i as decimal(12,4)) as double) as exec_ms, (o_orderkey % 900)::double as max_mem_mb, 24111.06::double as total_mem_mb from orders, range(2) t(i) where i = 0 or o_orderkey % 2 = 0")
    add("theta_margin", margin_query, " union all ".join(f"select * from (with {oracle.graph(n)} select '{n}' as graph, round({_LINEAR_SQL})::int as theta from (select count(*) v, sum(d) e from deg))" for n in ("g1", "g2")))
    add("run_log", run_log_query, oracle.color_of("g1", "device", "sl_els_sdc", 10, select="select (select count(*) from deg) as nodes, (select sum(d) from deg)::bigint as edges, 10::int as theta, (max(color) + 1)::int as color, (select max(rnd) + 1 from peeled)::int as iter_count, false as theta_predicted from k"))
    add("run_throughput", throughput_query, f"with {_SIZES_SQL} select dataset, round(v / (dataset / 8 + 1) / 1e6::double, 9) as mnodes_per_s, round(e / (dataset / 8 + 1) / 1e6::double, 9) as medges_per_s from sizes")
    grid = lambda sql, algorithm, theta, parts=1, partitioner="null": f"select 'g4' as dataset, '{algorithm}' as algorithm, {theta}::int as theta, {parts}::int as parts, {partitioner}::varchar as partitioner, (select max(color) + 1 from ({sql}))::int as color, (select count(*) from deg) as nodes, (select sum(d) from deg)::bigint as edges, true as ok"
    cells = [grid(oracle.color_of("g4", "device", "sl_els", t), "sl_els", t) for t in (0, 10)] + [grid(oracle.color_of("g4", "large_degree"), "ldf", t) for t in (0, 10)]
    cells.append(grid(oracle.part_colors_of("g4", 4, 10), "sl_els_sdc", 10, 4, "'rr'"))
    add("grid_runs", grid_query, f"with {oracle.graph('g4')} " + " union all ".join(cells))
    add("partition_one", one_part_query, f"with {oracle.graph('g4')} select 0::int as part, count(*) as n, 0::bigint as at_boundary from deg")
    add("file_egr_zero_weights", zero_weights_query, f"{dense} select src, dst, 0::int as weight from dense")
    add("theta_linear", theta_query, f"with {_SIZES_SQL} select dataset, v, e, round({_LINEAR_SQL})::int as theta from sizes")
    add("theta_kernel", kernel_query, f"with {_SIZES_SQL} select a.dataset, round(2.1715487363425177::double + sum((b.dataset - 4.5) / 5 * exp(-1e-6::double * (pow(a.v - b.v, 2) + pow(a.e - b.e, 2)))), 6) as score from sizes a, sizes b group by a.dataset")
    add("theta_labels", labels_query, _LABELS_SQL)
    add("violation_ratio", quality_query, f"with {_SIZES_SQL}, s as (select {_LINEAR_SQL} p, 1.0::double + dataset / 5.0 t from sizes) select round(avg((p > t)::int), 6) as violation_ratio, round(avg((p - t) * (p - t)), 6) as mse, round(sqrt(avg((p - t) * (p - t))), 6) as rmse, round(1 - avg((p - t) * (p - t)) / var_pop(t), 6) as r2 from s")
    add("best_run", best_query, _best_sql("runtime_ms"))
    add("best_run_by_colors", best_by_colors_query, _best_sql("run_idx"))
    add("parse_logs", log_query, "select o_orderkey as run, o_custkey as nodes, o_orderkey as edges, (o_orderkey % 13)::int as theta, cast(cast(o_orderkey / 8 as decimal(10,3)) as double) as runtime_ms, (o_custkey % 40)::int as color, (o_orderkey % 17)::int as iter_count, o_orderkey % 2 = 0 as theta_predicted from orders")
    return q, sql


QUERIES, SQL = _registry()
