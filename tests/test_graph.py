"""Graph operators on hand-made and random graphs."""

from __future__ import annotations

import functools
import itertools
import random

import pytest
from pyspark.sql import functions as F

from pigmenta.functions import int_hash
from pigmenta.graph import Graph
from pigmenta.operators.coloring import color_rounds, speculate
from pigmenta.operators.degrees import degree_extremes, degree_stats, isolated, lower_triangle, symmetry
from pigmenta.operators import local
from pigmenta.operators.local import Csr, dsatur, first_fit, greedy_partition, hash32, peel_local, smallest_last
from pigmenta.operators.order import dag, keyed, ranked
from pigmenta.operators.partition import boundary, members, parse_method, part_edges, partition
from pigmenta.operators.peel import RULES, peel
from pigmenta.operators.verify import histogram, throughput, verify
from pigmenta.plans import ALGORITHMS, algorithm, check_engine, color, margin, priorities
from pigmenta.plans.report import timed


def make(spark, pairs, n=None, simple=True):
    edges = spark.createDataFrame(list(pairs), "a long, b long") if pairs else spark.createDataFrame([], "a long, b long")
    ids = spark.range(n if n is not None else max(itertools.chain.from_iterable(pairs), default=-1) + 1)
    if simple:
        return Graph.of_pairs(edges, ids)
    both = edges.selectExpr("a src", "b dst").union(edges.selectExpr("b src", "a dst"))
    return Graph(ids, both, True)


HAND = {
    "empty": ([], 3, 1),
    "path4": ([(0, 1), (1, 2), (2, 3)], None, 2),
    "star33": ([(0, i) for i in range(1, 34)], None, 2),
    "tail": ([(0, 1), (1, 2), (0, 2), (2, 3)], None, 3),
    "k5": (list(itertools.combinations(range(5), 2)), None, 5),
    "c5": ([(i, (i + 1) % 5) for i in range(5)], None, 3),
    "gap": ([(1, 5)], None, 2),
    "hetero": ([*itertools.combinations(range(40), 2), *((0, 40 + i) for i in range(5))], None, 40),
}


def colors_of(df):
    return {r["id"]: r["color"] for r in df.collect()}


@pytest.mark.parametrize("name", HAND)
def test_hand_made(spark, name):
    pairs, n, best = HAND[name]
    g = make(spark, pairs, n)
    for which in ("smallest_last", "sl_els", "dsatur"):
        found = verify(g, color(g, which, engine="local")).first()
        assert (found["uncolored"], found["conflicts"], found["colors_used"]) == (0, 0, best)


@pytest.mark.parametrize("method", [speculate, functools.partial(color_rounds, bucket_edges=2)])
def test_rounds_that_run_out_are_no_result(spark, method):
    g = make(spark, list(itertools.combinations(range(5), 2)))
    keys = keyed(g.degrees(), algorithm("natural").chain)
    with pytest.raises(RuntimeError):
        method(g, keys, most_rounds=1).collect()
    assert sorted(colors_of(method(g, keys)).values()) == list(range(5))


def test_crown(spark):
    pairs = [(2 * i, 2 * j + 1) for i in range(4) for j in range(4) if i != j]
    g = make(spark, pairs)
    assert verify(g, color(g, "natural", engine="local")).first()["colors_used"] == 4
    assert verify(g, color(g, "dsatur")).first()["colors_used"] == 2


def test_multigraph_and_loops(spark):
    multi = make(spark, [(0, 1), (0, 1), (1, 2)], simple=False)
    assert {r["id"]: r["deg"] for r in multi.degrees().collect()} == {0: 2, 1: 3, 2: 1}
    loop = make(spark, [(0, 0), (0, 1)], simple=False)
    assert {r["id"]: r["deg"] for r in loop.degrees().collect()} == {0: 3, 1: 1}
    colors = color(loop, "ldf").cache()
    assert verify(loop, colors).first()["colors_used"] == 2
    assert verify(loop, colors, loops_conflict=True).first()["conflicts"] == 1


@pytest.fixture(scope="module")
def rough(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(500)] + [(0, i) for i in range(1, 60)]
    return make(spark, pairs).stored()


@pytest.mark.parametrize("rule,theta", [*((r, 3) for r in sorted(RULES)), ("sl_els", 0)])
def test_engines_peel_alike(rough, rule, theta):
    one = {tuple(r) for r in priorities(rough, rule, theta, "local").select("id", "deg", "round", "rdeg", "theta", "pri").collect()}
    assert one == {tuple(r) for r in peel(rough, rule, theta, bucket_edges=100).select("id", "deg", "round", "rdeg", "theta", "pri").collect()}
    assert len(one) == 60


@pytest.mark.parametrize("name", ["sl_els", "cpu_sll"])
def test_engines_color_alike(rough, name):
    assert colors_of(color(rough, name, 3, "local")) == colors_of(color(rough, name, 3, "dataframe"))


def test_empty_graph(spark):
    g = make(spark, [], 0)
    assert color(g, "sl_els").collect() == [] and color(g, "sl_els", engine="local").collect() == []


def test_random_ties(rough):
    peeled = rough.degrees().withColumn("pri", F.lit(0))
    one, again, other = ([r["id"] for r in ranked(keyed(peeled, "random", seed=n)).orderBy("rk").collect()] for n in (1, 1, 2))
    assert one == again != other
    assert verify(rough, color(rough, "ldf", tie="random", seed=1)).first()["conflicts"] == 0


def test_one_task_has_a_bound(rough, monkeypatch):
    monkeypatch.setattr(local, "LOCAL_EDGES", 50)
    for run in (lambda: color(rough, "dsatur"), lambda: color(rough, "ldf", engine="local"), lambda: partition(rough, 3, "ldg")):
        with pytest.raises(ValueError, match="one task"):
            run()


def test_greedy_partition_by_hand():
    import numpy as np

    rng = random.Random(3)
    pairs = {(a, b) for a, b in ((rng.randrange(200), rng.randrange(200)) for _ in range(2600)) if a != b}
    pairs |= {(b, a) for a, b in pairs}
    g = Csr(np.arange(200), np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    near = {v: [b for a, b in pairs if a == v] for v in range(200)}
    part, count = {}, [0] * 4
    for v in range(200):  # the rule, written out
        scores = [sum(part.get(u) == p for u in near[v]) - min(1.0, count[p] / 50) for p in range(4)]
        best = min(range(4), key=lambda p: (-round(scores[p], 9), count[p], p))
        if count[best] >= 50:
            best = min(range(4), key=lambda p: (count[p], p))
        part[v] = best
        count[best] += 1
    assert greedy_partition(g, 4).tolist() == [part[v] for v in range(200)]


def test_timed_runs(spark, rough):
    from pigmenta.plans.logs import DEVICE_CELLS, parse_devices, parse_logs

    run = timed(rough, "sl_els_sdc", 3)
    assert run.proper and set(run.phases) == {"PA", "CA"} and run.rounds > 1
    assert (run.nodes, run.edges) == (60, rough.edges.count())
    assert [r["phase"] for r in run.summary().collect()] == ["PA", "CA", "total"]
    parts = timed(rough, "1", 3, parts=3, partitioner="rr")
    assert parts.proper and sum(d.parts for d in parts.devices) == 3 and all(0 < d.max_mem_mb < d.total_mem_mb for d in parts.devices)
    assert parts.runtime_ms == pytest.approx(sum(parts.phases.values()) - parts.phases["Partition Time"])
    predicted = timed(rough, "ldf", "linear", engine="local")
    runs = {1: run, 2: parts, 3: predicted}
    logs = spark.createDataFrame([(i, r.log()) for i, r in runs.items()], "run int, text string")
    found = {r["run"]: r for r in parse_logs(logs).collect()}
    for i, r in runs.items():
        assert (found[i]["nodes"], found[i]["edges"], found[i]["theta"], found[i]["color"], found[i]["iter_count"], found[i]["theta_predicted"]) == (r.nodes, r.edges, r.theta, r.colors_used, r.rounds, r.predicted)
        assert found[i]["runtime_ms"] == pytest.approx(r.runtime_ms, abs=1e-5)
    assert found[2]["phase_2_ms"] == pytest.approx(parts.phases["Phase 2 (Parallel Exec)"], abs=1e-3) and found[1]["phase_2_ms"] is None
    table = parse_devices(logs).orderBy("device").collect()
    assert [r["run"] for r in table] == [2] * len(parts.devices)
    for r, d in zip(table, parts.devices, strict=True):
        assert [r[name] for name, _ in DEVICE_CELLS] == pytest.approx([d.device, d.parts, d.exec_ms, d.max_mem_mb, d.total_mem_mb], abs=0.006)


def test_lines_of_other_logs(spark):
    from pigmenta.plans.logs import parse_logs

    texts = ["runtime: 12.345 ms   colors used: 4", "  Nodes: 5\nEdges: 7 x\nEGC  θ: 3 (predicted)", "NODES: 9\nNodes: 8\nruntime: soon", "# Nodes: 6 Edges: 2"]
    found = [tuple(r)[1:] for r in parse_logs(spark.createDataFrame(list(enumerate(texts)), "run int, text string")).select("run", "nodes", "edges", "theta", "theta_predicted", "runtime_ms", "color").orderBy("run").collect()]
    assert found == [(None, None, None, False, 12.345, 4), (None, None, 3, True, None, None), (9, None, None, False, None, None), (None, None, None, False, None, None)]


def test_options_that_would_not_act(rough):
    for wrong in ({"algorithm_name": "ldf", "parts": 2}, {"algorithm_name": "sl_els", "parts": 2}, {"parts": 2, "wrap": True}, {"parts": 2, "tie": "random"}, {"engine": "local", "tie": "random"}, {"algorithm_name": "natural", "tie": "random"}, {"algorithm_name": "ldf", "wrap": True}, {"parts": 2, "engine": "local"}, {"tie": "none"}):
        with pytest.raises(ValueError):
            color(rough, **wrong)
        with pytest.raises(ValueError):
            timed(rough, **({"algorithm_name": "sl_els_sdc" if "parts" in wrong else "sl_els"} | wrong))
    with pytest.raises(TypeError):
        timed(rough, "ldf", colour=1)


def test_margins_by_name(spark, rough):
    vectors = spark.createDataFrame([(60.0, float(rough.edges.count()), 1.0)], "v double, e double, alpha double")
    assert margin(Graph(spark.range(1000), spark.range(4_000_000).select(F.col("id").alias("src"), F.col("id").alias("dst"))), "linear") == 2  # 1 with half of the entries
    assert margin(rough, "linear") == 1 and margin(rough, 7) == 7 and margin(rough, "svr", vectors) == 3
    with pytest.raises(ValueError):
        margin(rough, "svr")


@pytest.mark.parametrize("name", sorted(ALGORITHMS))
def test_all_are_proper(rough, name):
    most = degree_stats(rough).first()["max_degree"]
    found = verify(rough, color(rough, name, 2, "local")).first()
    assert (found["uncolored"], found["conflicts"]) == (0, 0) and found["colors_used"] <= most + 1


def test_rounds_are_first_fit(rough):
    keys = keyed(rough.degrees(), "degree_id")
    order = [r["id"] for r in ranked(keys).orderBy("rk").collect()]
    near = {}
    for r in rough.edges.collect():
        near.setdefault(r["src"], set()).add(r["dst"])
    out = {}
    for v in order:
        taken = {out[u] for u in near.get(v, ()) if u in out}
        out[v] = next(c for c in itertools.count() if c not in taken)
    assert colors_of(color_rounds(rough, keys)) == out


def first_fit_of(order, near):
    out = {}
    for v in order:
        taken = {out[u] for u in near.get(v, ()) if u in out}
        out[v] = next(c for c in itertools.count() if c not in taken)
    return out


def neighbours_of(g):
    near = {}
    for r in g.edges.where("src != dst").collect():
        near.setdefault(r["src"], set()).add(r["dst"])
    return near


@pytest.mark.parametrize("bucket_edges,hub_edges", [(None, None), (60, None), (60, 12), (15, 5)])
@pytest.mark.parametrize("chain", ["degree_id", "natural"])
def test_buckets_do_not_change_colors(rough, chain, bucket_edges, hub_edges):
    keys = keyed(rough.degrees(), chain)
    order = [r["id"] for r in ranked(keys).orderBy("rk").collect()]
    rounds = []
    found = colors_of(color_rounds(rough, keys, bucket_edges=bucket_edges, hub_edges=hub_edges, seen=rounds.append))
    assert found == first_fit_of(order, neighbours_of(rough))
    assert rounds == [1] if bucket_edges is None else rounds[0] > 1


def test_chains_that_buckets_cut(spark):
    """Paths in id order, cut at random: each bucket colours its pieces at once."""
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(0, 400) if i % 50 != 49] + [(i, i + 2) for i in range(0, 380) if rng.random() < 0.3]
    g = make(spark, pairs).stored()
    rounds = []
    found = colors_of(color_rounds(g, keyed(g.degrees(), "natural"), bucket_edges=260, seen=rounds.append))
    assert found == first_fit_of(sorted(found), neighbours_of(g))
    # in step, one vertex of each path is decided a round
    depth = {}
    near = neighbours_of(g)
    for v in sorted(found):
        depth[v] = 1 + max((depth[u] for u in near[v] if u < v), default=0)
    assert 1 < rounds[0] <= max(depth.values()) / 2


def test_many_colors_in_buckets(spark):
    """A clique has more colours than the words of a set."""
    n = 290
    g = make(spark, list(itertools.combinations(range(n), 2))).stored()
    for bucket_edges in (None, 15_000):
        assert colors_of(color_rounds(g, keyed(g.degrees(), "natural"), bucket_edges=bucket_edges)) == {i: i for i in range(n)}


def test_hub_is_spread(spark):
    from pigmenta.operators.resident import settle

    leaves = 20_000
    g = make(spark, [(leaves, i) for i in range(leaves)], leaves + 1).stored()
    keys = keyed(g.degrees(), "natural")  # the hub comes last
    edges = dag(g, keys).withColumnRenamed("higher", "other")
    home = settle(edges, leaves, bucket_edges=2_500, hub_edges=100)
    sizes = sorted(r["count"] for r in spark.table(home.name).groupBy("bucket").count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    home.drop()
    found = colors_of(color_rounds(g, keys, bucket_edges=2_500, hub_edges=100))
    assert found == {i: int(i == leaves) for i in range(leaves + 1)}


def test_edges_stay_where_they_are(rough):
    """The plan of a round shuffles what buckets say, not the table of edges."""
    from pigmenta.operators import coloring
    from pigmenta.operators.resident import settle

    edges = dag(rough, keyed(rough.degrees(), "natural")).withColumnRenamed("higher", "other")
    home = settle(edges, 400, bucket_edges=100)
    rows = rough.vertices.selectExpr("0 AS kind", "CAST(id % 4 AS INT) AS bucket", "id", "CAST(NULL AS INT) AS color", "0 AS n", "0 AS waits", "0L AS w0", "0L AS w1", "0L AS w2", "0L AS w3", "CAST(array() AS array<int>) AS more")
    plan = home.step(rows, coloring._round, f"kind int, {coloring._ROW_DDL}")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    home.drop()


def test_wrapped_priorities_stay_proper(rough):
    found = verify(rough, color(rough, "sl_els", 0, "local", wrap=True)).first()
    assert (found["uncolored"], found["conflicts"]) == (0, 0)


def test_smallest_last_bound():
    rng = random.Random(9)
    import numpy as np

    pairs = {(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(200)) if a != b}
    src, dst = np.array([p for a, b in pairs for p in (a, b)]), np.array([p for a, b in pairs for p in (b, a)])
    g = Csr(np.arange(40), src, dst)
    index = smallest_last(g)
    core = max(sum(index[u] > index[v] for u in g.neighbours(v)) for v in range(40))
    assert first_fit(g, np.argsort(index)[::-1]).max() <= core
    assert dsatur(g).min() == 0 and sorted(peel_local(g, "cpu_sl", 0)["id"]) == list(range(40))


def test_hash(spark):
    import numpy as np

    ids = [0, 1, 2, 12345, 2**31, 2**32 - 1]
    found = [r["h"] for r in spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).select(int_hash(F.col("id")).alias("h")).collect()]

    def plain(x):
        for _ in range(2):
            x = ((x >> 16) ^ x) * 0x45D9F3B % 2**32
        return (x >> 16) ^ x

    assert found == [plain(i) for i in ids] == hash32(np.array(ids)).tolist()


def test_statistics(spark):
    g = make(spark, [(1, 2), (1, 3), (4, 3)], 6)
    row = degree_stats(g).first()
    assert (row["n_vertices"], row["n_edges"], row["avg_degree"], row["max_degree"], row["min_degree"]) == (6, 6, 1.0, 2, 0)
    assert tuple(degree_extremes(g).first()) == (1, 2, 0, 0)
    assert sorted(r["id"] for r in isolated(g).collect()) == [0, 5]
    assert not lower_triangle(g).first()["is_lower_triangle"]
    assert tuple(symmetry(g).first()) == (0, 0, 6, True)
    one_way = Graph(g.vertices, g.edges.where("src < dst"))
    assert symmetry(one_way).first()["one_way"] == 3


def test_histogram(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([0, 0, 1, 2])], "id long, color int")
    assert [tuple(r) for r in histogram(df).orderBy("color").collect()] == [(0, 2, 50.0), (1, 1, 75.0), (2, 1, 100.0)]
    assert throughput(2_000_000, 4_000_000, 2.0) == {"mnodes_per_s": 1.0, "medges_per_s": 2.0}


@pytest.mark.parametrize("method,copies", [("rr", "all"), ("ldg", "halo"), ("METIS", "halo")])
def test_parts_are_proper(rough, method, copies):
    found = verify(rough, color(rough, "sl_els_sdc", 2, parts=3, partitioner=method, copies=copies)).first()
    assert (found["uncolored"], found["conflicts"]) == (0, 0)


def test_partitions(spark, rough):
    for method in ("rr", "random", "ldg", "lp"):
        sizes = [r["count"] for r in partition(rough, 4, method).groupBy("part").count().collect()]
        assert sum(sizes) == 60 and max(sizes) <= 16
    assert {r["part"] for r in partition(rough, 1).collect()} == {0}
    assert parse_method("KaHIP") == "multilevel" and algorithm("1", "jp") is ALGORITHMS["jp_adg"] and algorithm("2", "jp") is ALGORITHMS["jp_sll"]
    for bad in (lambda: parse_method("none"), lambda: partition(rough, 0), lambda: algorithm("none"), lambda: check_engine("none")):
        with pytest.raises(ValueError):
            bad()


def test_levels(spark):
    """Cliques in a ring: contraction and refinement find the few edges between them; every step keeps the weights."""
    from pigmenta.operators.multilevel import gathered, levels, matched, multilevel

    pairs = [(12 * c + a, 12 * c + b) for c in range(8) for a, b in itertools.combinations(range(12), 2)] + [(12 * c, (12 * c + 12) % 96) for c in range(8)]
    g = make(spark, pairs, 96).stored()
    parts = multilevel(g, 4, coarse=20)
    rows = {r["id"]: r["part"] for r in parts.collect()}
    assert sorted(rows) == list(range(96)) and {list(rows.values()).count(p) for p in range(4)} == {24}
    assert sum(rows[r["src"]] != rows[r["dst"]] for r in g.edges.collect()) == 8
    nodes, edges = g.vertices.withColumn("w", F.lit(1).cast("long")), g.edges.withColumn("w", F.lit(1).cast("long"))
    up = {r["id"]: r["up"] for r in matched(nodes, edges, 5).collect()}
    ends = {(r["src"], r["dst"]) for r in g.edges.collect()}
    assert all(i == u or (i, u) in ends for i, u in up.items()) and max(list(up.values()).count(u) for u in up.values()) == 2
    for level, level_edges, _ in levels(nodes, edges, 20, 24):
        assert level.agg(F.sum("w")).first()[0] == 96 and level_edges.where("src = dst").count() == 0
    star = make(spark, [(0, i) for i in range(1, 200)], 400).stored()  # hardly any match, half of the vertices alone
    flat = star.vertices.withColumn("w", F.lit(1).cast("long")), star.edges.withColumn("w", F.lit(1).cast("long"))
    assert gathered(*flat, 100).select("up").distinct().count() < 200
    sizes = [r["count"] for r in multilevel(star, 4, coarse=60).groupBy("part").count().collect()]
    assert sum(sizes) == 400 and max(sizes) <= 105
    assert multilevel(make(spark, [], 0), 3).collect() == []


def test_boundary_and_members(spark):
    g = make(spark, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)])
    parts = spark.createDataFrame([(i, i // 3) for i in range(6)], "id long, part int")
    assert sorted(r["id"] for r in boundary(g, parts).collect()) == [2, 3]
    rows = sorted(tuple(r) for r in members(g, parts, 2, "all").collect())
    assert rows == [(0, 0, 0, True, False), (0, 1, 1, True, False), (0, 2, 2, True, True), (0, 3, 3, False, True), (1, 0, 3, True, True), (1, 1, 4, True, False), (1, 2, 5, True, False), (1, 3, 2, False, True)]
    assert sorted(tuple(r) for r in part_edges(g, parts).collect()) == [(0, 0, 1), (0, 1, 2), (1, 0, 1), (1, 1, 2)]


def test_no_boundary(spark):
    g = make(spark, [(0, 1), (2, 3)])
    parts = spark.createDataFrame([(i, i // 2) for i in range(4)], "id long, part int")
    from pigmenta.operators.partition import color_parts

    assert verify(g, color_parts(g, parts, 2).select("id", "color")).first()["conflicts"] == 0
