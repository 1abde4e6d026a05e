"""Graphs beyond what one task holds, in groups of whole components."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pigmenta import queries, scratch
from pigmenta.graph import Graph
from pigmenta.operators import local, peel as peeling, pieces as groups
from pigmenta.operators.local import Csr, peel_local
from pigmenta.operators.partition import partition
from pigmenta.operators.peel import peel
from pigmenta.plans import _local_color, algorithm, color


@pytest.fixture(scope="module")
def apart(spark):
    """Components of several sizes and shapes (one of them a path, which few contractions join), and vertices on their own."""
    rng = random.Random(9)
    pairs = [(100 * c + rng.randrange(n), 100 * c + rng.randrange(n)) for c, n, m in ((0, 60, 300), (1, 60, 300), (2, 40, 90), (3, 30, 250)) for _ in range(m)]
    pairs += [(400 + i, 401 + i) for i in range(40)] + [(500 + 2 * i, 501 + 2 * i) for i in range(10)]
    g = Graph.of_pairs(spark.createDataFrame(pairs, "a long, b long"), spark.range(530).where("id < 100 AND id < 60 OR id >= 100")).stored()
    rows = g.edges.toPandas()
    ids = g.vertices.toPandas()["id"].to_numpy()
    return g, Csr(ids, rows["src"].to_numpy(np.int64), rows["dst"].to_numpy(np.int64))


@pytest.fixture
def small_tasks(monkeypatch):
    """A task holds less than the graph and more than any component; the rounds between buckets are not to run."""
    monkeypatch.setattr(local, "LOCAL_EDGES", 700)
    monkeypatch.setattr(groups, "BUCKET_EDGES", 300)
    monkeypatch.setattr(peeling, "BUCKET_EDGES", 300)
    monkeypatch.setattr("pigmenta.plans.BUCKET_EDGES", 300)
    monkeypatch.setattr(peeling, "write_split", None)
    monkeypatch.setattr("pigmenta.plans.color_rounds", None)


COLUMNS = ["id", "deg", "round", "rdeg", "theta", "pri"]


@pytest.mark.parametrize("rule,theta", [("sl_els", 10), ("jp_adg", 0), ("cpu_sll", 0)])
def test_peeled_as_one(apart, small_tasks, rule, theta, monkeypatch):
    g, whole = apart
    monkeypatch.setattr(groups, "MOST_PASSES", 60)  # components that are unlike settle few rounds a run
    expected = set(peel_local(whole, rule, theta)[COLUMNS].itertuples(index=False, name=None))
    assert {tuple(r) for r in peel(g, rule, theta).select(*COLUMNS).collect()} == expected


@pytest.mark.parametrize("engine,name", [("local", "cpu_sll"), ("dataframe", "ecl"), ("dataframe", "smallest_last"), ("dataframe", "dsatur")])
def test_colored_as_one(apart, small_tasks, engine, name):
    g, whole = apart
    expected = {r.id: r.color for r in _local_color(whole, algorithm(name), 0, False).itertuples()}
    assert {r["id"]: r["color"] for r in color(g, name, engine=engine).collect()} == expected


def test_equal_components_settle_at_once(spark, small_tasks, monkeypatch):
    """Copies of one component take the same thresholds, so the first run of the groups has them all."""
    rng = random.Random(2)
    one = [(rng.randrange(60), rng.randrange(60)) for _ in range(300)]
    g = Graph.of_pairs(spark.createDataFrame([(a + 60 * c, b + 60 * c) for c in range(4) for a, b in one], "a long, b long")).stored()
    monkeypatch.setattr(groups, "MOST_PASSES", 1)
    found = peel(g, "cpu_sl").toPandas().sort_values("id")
    copies = [found[found["id"] // 60 == c][["round", "rdeg"]].to_numpy().tolist() for c in range(4)]
    assert copies[0] == copies[1] == copies[2] == copies[3] and len(set(map(tuple, copies[0]))) > 5


@pytest.mark.parametrize("rule", ["cpu_sl", "jp_sl"])
def test_unlike_components_take_one_run(apart, small_tasks, rule, monkeypatch):
    """The strict rules need no agreement: one run of the groups gives every threshold."""
    g, whole = apart
    monkeypatch.setattr(groups, "MOST_PASSES", 1)
    expected = set(peel_local(whole, rule, 0)[COLUMNS].itertuples(index=False, name=None))
    assert {tuple(r) for r in peel(g, rule).select(*COLUMNS).collect()} == expected
    assert len({r[2] for r in expected}) > 20


@pytest.mark.parametrize("engine", ["local", "dataframe"])
def test_colored_without_agreement(apart, small_tasks, engine, monkeypatch):
    """Groups whose thresholds do not come to agree are peeled in rounds and coloured all the same."""
    g, whole = apart
    monkeypatch.setattr(groups, "MOST_PASSES", 1)
    monkeypatch.setattr(peeling, "write_split", scratch.write_split)
    expected = {r.id: r.color for r in _local_color(whole, algorithm("sl_els_sdc"), 3, False).itertuples()}
    assert {r["id"]: r["color"] for r in color(g, "sl_els_sdc", 3, engine=engine).collect()} == expected


@pytest.mark.parametrize("name", ["color_ldf_local", "color_sl_els_t10_local"])
def test_query_of_a_large_component(apart, spark, name, monkeypatch):
    """A query of the local engine does the whole job where no task holds a component."""
    g, whole = apart
    monkeypatch.setattr(local, "LOCAL_EDGES", 300)
    monkeypatch.setattr(queries, "_stored", lambda *_: g)
    what, theta = (algorithm("ldf"), 0) if "ldf" in name else (algorithm("sl_els"), 10)
    expected = {r.id: r.color for r in _local_color(whole, what, theta, False).itertuples()}
    assert {r["id"]: r["color"] for r in queries.QUERIES[name](spark, "").collect()} == expected


def test_first_fit_holds_no_list_of_edges():
    rng = np.random.default_rng(4)
    ends = rng.integers(0, 3000, (2, 200_000))
    g = Csr(np.arange(3000), np.concatenate([ends[0], ends[1]]), np.concatenate([ends[1], ends[0]]))
    tracemalloc.start()
    local.first_fit(g, np.arange(g.n))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000


def test_groups_are_whole_and_bounded(apart, small_tasks, spark):
    g, _ = apart
    found = groups.pieces(g)
    rows = spark.table(found.name)
    home = rows.select("id", "group")
    cut = g.edges.join(home.withColumnRenamed("id", "src"), "src").join(home.withColumnsRenamed({"id": "dst", "group": "other"}), "dst").where("group != other")
    assert cut.count() == 0 and rows.count() == g.vertices.count()
    assert rows.groupBy("group").agg(F.sum(F.size("near") + 1).alias("n")).agg(F.max("n")).first()[0] <= 700
    assert rows.select("group").distinct().count() > 4
    found.drop()
    assert groups.pieces(g, 400) is None  # a component is larger


def test_greedy_partition_in_ranges(apart, monkeypatch):
    """Ranges of ids that follow each other give the parts of one pass."""
    g, whole = apart
    monkeypatch.setattr(local, "LOCAL_EDGES", 400)
    expected = dict(zip(whole.ids.tolist(), local.greedy_partition(whole, 3).tolist()))
    assert {r["id"]: r["part"] for r in partition(g, 3, "ldg").collect()} == expected


#: Queries beyond one task, with the algorithm and margin they name.
BEYOND = [("color_dsatur", "dsatur", 0), ("color_greedy_degree_local", "greedy", 0), ("color_jp_sl_t10_local", "jp_sl", 10), ("color_sl_els_t0_local", "sl_els", 0), ("color_cpu_sll", "cpu_sll", 0)]


@pytest.mark.parametrize("query,name,theta", BEYOND)
def test_query_in_groups(apart, small_tasks, spark, query, name, theta, monkeypatch):
    """A query over a graph that no task holds gives what the kernel gives over the whole, without rounds between buckets."""
    g, whole = apart
    monkeypatch.setattr(groups, "MOST_PASSES", 60)
    monkeypatch.setattr(queries, "_stored", lambda *_: g)
    expected = {r.id: r.color for r in _local_color(whole, algorithm(name), theta, False).itertuples()}
    assert {r["id"]: r["color"] for r in queries.QUERIES[query](spark, "").collect()} == expected


@pytest.mark.parametrize("rule", ["cpu_adg", "cpu_sll"])
def test_peel_query_in_groups(apart, small_tasks, spark, rule, monkeypatch):
    g, whole = apart
    monkeypatch.setattr(groups, "MOST_PASSES", 60)
    monkeypatch.setattr(queries, "_stored", lambda *_: g)
    shown = ["id", "round", "rdeg", "theta", "pri"]
    expected = set(peel_local(whole, rule, 0)[shown].itertuples(index=False, name=None))
    assert {tuple(r) for r in queries.QUERIES[f"peel_{rule}_t0_local"](spark, "").collect()} == expected
