"""Graphs with a component that no task holds: one task has the vertices, and the edges on its disk."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from pigmenta import queries
from pigmenta.graph import Graph
from pigmenta.operators import disk, local, peel as peeling
from pigmenta.operators.components import components, components_in_one, roots
from pigmenta.operators.local import Csr, TooLarge, peel_local
from pigmenta.plans import _local_color, algorithm, color


@pytest.fixture(scope="module")
def linked(spark):
    """One component of ids far apart, a small one, and vertices on their own."""
    rng = random.Random(5)
    pairs = [(7 * rng.randrange(80), 7 * rng.randrange(80)) for _ in range(900)] + [(10**12, 10**12 + 1)]
    ids = [(7 * i,) for i in range(80)] + [(10**12 + i,) for i in range(4)]
    g = Graph.of_pairs(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(ids, "id long")).stored()
    rows = g.edges.toPandas()
    return g, Csr(g.vertices.toPandas()["id"].to_numpy(), rows["src"].to_numpy(np.int64), rows["dst"].to_numpy(np.int64))


@pytest.fixture
def no_rounds(monkeypatch, linked):
    """A task holds less than the component; rounds of a job each are not to run."""
    monkeypatch.setattr(local, "LOCAL_EDGES", 300)
    monkeypatch.setattr("pigmenta.plans.BUCKET_EDGES", 300)
    monkeypatch.setattr(peeling, "write_split", None)
    monkeypatch.setattr("pigmenta.plans.color_rounds", None)
    monkeypatch.setattr(queries, "color_rounds", None)
    monkeypatch.setattr(queries, "_stored", lambda *_: linked[0])


#: Queries with a component beyond one task, with the algorithm and margin they name.
BEYOND = [
    ("color_dense_ldf", "ldf", 0), ("color_cpu_sl", "cpu_sl", 0), ("color_cpu_sl_local", "cpu_sl", 0), ("color_dsatur", "dsatur", 0), ("color_sl_els_sdc_t3", "sl_els_sdc", 3),
    ("color_sl_els_sdc_t3_local", "sl_els_sdc", 3), ("color_smallest_last", "smallest_last", 0), ("color_cpu_adg", "cpu_adg", 0), ("color_sl_els_t0_local", "sl_els", 0), ("color_jp_sl_t10", "jp_sl", 10),
]


@pytest.mark.parametrize("query,name,theta", BEYOND)
def test_query_on_disk(linked, no_rounds, spark, query, name, theta):
    expected = {r.id: r.color for r in _local_color(linked[1], algorithm(name), theta, False).itertuples()}
    assert {r["id"]: r["color"] for r in queries.QUERIES[query](spark, "").collect()} == expected


@pytest.mark.parametrize("query", ["peel_cpu_sl_t0", "peel_cpu_sl_t0_local"])
def test_peel_query_on_disk(linked, no_rounds, spark, query):
    shown = ["id", "round", "rdeg", "theta", "pri"]
    expected = set(peel_local(linked[1], "cpu_sl", 0)[shown].itertuples(index=False, name=None))
    assert {tuple(r) for r in queries.QUERIES[query](spark, "").collect()} == expected


def test_vertices_have_a_bound(linked, monkeypatch):
    monkeypatch.setattr(disk, "LOCAL_VERTICES", 50)
    with pytest.raises(TooLarge, match="one task"):
        color(linked[0], "dsatur", engine="disk")


def test_lists_of_a_file(monkeypatch):
    """Neighbours are those of the arrays, whatever the blocks, with repeats and loops."""
    monkeypatch.setattr(disk, "BLOCK", 40)
    monkeypatch.setattr(disk, "CHUNK", 64)
    rng = np.random.default_rng(3)
    ids = np.arange(60, dtype=np.int64) * 1000 - 500
    src, dst = (ids[rng.integers(0, 50, 700)] for _ in range(2))
    whole = Csr(ids, src, dst)

    def rows(k: int) -> list[pa.RecordBatch]:
        of, mine = src % 3 == k, ids[ids % 3 == k]
        return pa.table({"src": np.concatenate([mine, src[of]]), "dst": pa.concat_arrays([pa.nulls(len(mine), pa.int64()), pa.array(dst[of])])}).to_batches(max_chunksize=50)

    g = disk.DiskCsr(block for k in range(3) for block in disk._pack(iter(rows(k))))
    assert g.ids.tolist() == whole.ids.tolist() and g.degree.tolist() == whole.degree.tolist()
    order = rng.permutation(60)
    assert [sorted(x) for x in g.lists(order)] == [sorted(x) for x in whole.lists(order)]
    assert sorted(np.concatenate(list(g.beside(order[:40]))).tolist()) == sorted(next(whole.beside(order[:40])).tolist())


def test_roots_of_a_path():
    order = np.random.default_rng(1).permutation(500)
    assert set(roots(order[:-1], order[1:], 502).tolist()) == {0, 500, 501}


def test_components_in_one_task(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, rng.randrange(400), i) for i in range(0, 400, 3)], "id long, a long, b long")
    assert set(components_in_one(rows).collect()) >= set(components(rows, "id", "a").collect())
