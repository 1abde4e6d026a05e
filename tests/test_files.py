"""Readers and writers of graph files, flow, margins and experiments."""

from __future__ import annotations

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from pigmenta.graph import Graph
from pigmenta.operators.flow import max_flow, reachable
from pigmenta.operators.numbering import dense_ids
from pigmenta.plans import experiments as ex
from pigmenta.plans import theta as th
from pigmenta.plans.logs import parse_devices, parse_logs
from pigmenta.sources import files, writers


def edges_of(graph):
    return sorted((r["src"], r["dst"]) for r in graph.edges.select("src", "dst").collect())


@pytest.fixture
def graph(spark):
    rng = random.Random(2)
    pairs = sorted({(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(80)) if a != b} | {(29, 0)})
    return Graph.of_pairs(spark.createDataFrame(pairs, "a long, b long"), spark.range(30))


@pytest.mark.parametrize("kind", ["egr", "bin"])
def test_binary_round_trip(spark, graph, tmp_path, kind, monkeypatch):
    path = str(tmp_path / f"g.{kind}")
    (writers.write_egr if kind == "egr" else writers.write_bin)(graph, path)
    monkeypatch.setattr(files, "RANGE_EDGES", 7)  # many ranges
    again = files.read_graph(spark, path)
    assert edges_of(again) == edges_of(graph) and again.vertices.count() == 30
    (tmp_path / "g.cut").write_bytes((tmp_path / f"g.{kind}").read_bytes()[:-4])
    with pytest.raises(ValueError):
        (files.read_egr if kind == "egr" else files.read_bin)(spark, str(tmp_path / "g.cut"))


def test_weights(spark, graph, tmp_path):
    path = str(tmp_path / "w.egr")
    weighted = Graph(graph.vertices, graph.edges.withColumn("weight", (F.col("src") * 100 + F.col("dst")).cast("int")))
    writers.write_egr(weighted, path, weights=True)
    assert all(r["weight"] == r["src"] * 100 + r["dst"] for r in files.read_egr(spark, path).edges.collect())


def test_snap(spark, tmp_path):
    path = tmp_path / "s.txt"
    path.write_text("# a comment\n# Nodes: 6 Edges: 4\n1\t5\n5 1\n2  2\n1\t5\n")
    g = files.read_snap(spark, str(path))
    assert g.vertices.count() == 6 and len(edges_of(g)) == 8 and g.multigraph
    assert files.snap_meta(spark, str(path)).nodes == 6
    assert edges_of(files.read_snap(spark, str(path), simple=True)) == [(1, 5), (5, 1)]
    found = files.read_snap(spark, str(path), simple=True, compact=True)
    assert edges_of(found) == [(0, 1), (1, 0)] and found.vertices.count() == 3
    assert len(edges_of(files.read_snap(spark, str(path), strict=True))) == 4
    path.write_text("# Nodes: 4 Edges: 1\n1 5\n")
    with pytest.raises(ValueError):
        files.read_snap(spark, str(path), strict=True)
    assert not files.snap_meta(spark, str(path)).zero_based


def test_cache(spark, tmp_path):
    path = tmp_path / "c.txt"
    path.write_text("0 1\n1 2\n")
    one, two = files.cached(spark, str(path)), files.cached(spark, str(path))
    assert edges_of(one) == edges_of(two) == [(0, 1), (1, 0), (1, 2), (2, 1)]


def test_matrix_market(spark, graph, tmp_path):
    path = str(tmp_path / "m.mtx")
    writers.write_matrix_market(graph, path)
    assert edges_of(files.read_graph(spark, path)) == [e for e in edges_of(graph) if e[0] > e[1]]
    banner = files.parse_banner("%%MatrixMarket matrix coordinate Pattern symmetric")
    assert banner.valid and files.parse_banner(banner.line()) == banner
    assert not files.Banner("array", "pattern", "general").valid and not files.Banner("coordinate", "real", "hermitian").valid
    for text in ("%%MatrixMarket matrix coordinate complex general\n1 1 0\n", "%%MatrixMarket vector coordinate real general\n", "hello\n", "%%MatrixMarket matrix coordinate real general\n3 3 2\n2 1 5\n", "%%MatrixMarket matrix coordinate real general\n3 3 1\n1 2 5\n"):
        (tmp_path / "bad.mtx").write_text(text)
        with pytest.raises(ValueError):
            files.read_matrix_market(spark, str(tmp_path / "bad.mtx"))


def test_flow(spark, tmp_path):
    path = tmp_path / "f.max"
    path.write_text("c a problem\np max 6 8\nn 1 s\nn 6 t\na 1 2 10\na 1 3 8\na 2 4 5\na 3 4 7\na 2 5 4\na 4 6 10\na 5 6 9\na 3 2 1\n")
    problem = files.read_dimacs(spark, str(path))
    assert tuple(max_flow(problem).first()) == (14, True)
    assert sorted(r["id"] for r in reachable(problem.graph.edges.where("weight > 0"), 4).collect()) == [4, 5]
    cut = files.FlowProblem(Graph(problem.graph.vertices, problem.graph.edges.where("dst != 5")), 0, 5)
    assert tuple(max_flow(cut).first()) == (0, False)


def test_dense_ids(spark):
    df = spark.createDataFrame([(i * i,) for i in range(50)], "id long")
    assert [r["dense"] for r in dense_ids(df).orderBy("id").collect()] == list(range(50))


def test_matrices(spark, tmp_path):
    path = str(tmp_path / "d.mtx")
    (tmp_path / "d.mtx").write_text("%%MatrixMarket matrix array real symmetric\n% c\n3 3\n1\n2\n3\n4\n5\n6\n")
    found = {(r["i"], r["j"]): r["re"] for r in files.read_matrix(spark, path).mirrored().collect()}
    assert found == {(0, 0): 1, (1, 0): 2, (2, 0): 3, (1, 1): 4, (2, 1): 5, (2, 2): 6, (0, 1): 2, (0, 2): 3, (1, 2): 5}
    again = str(tmp_path / "e.mtx")
    dense = files.read_matrix(spark, path)
    writers.write_matrix(dense.entries, 3, 3, again, dense.banner)
    assert files.read_matrix(spark, again).entries.exceptAll(dense.entries).count() == 0
    for text in ("%%MatrixMarket matrix coordinate integer general\n1 1 0\n", "%%MatrixMarket matrix array real general\n2 2\n1\n2\n3\n", "%%MatrixMarket matrix coordinate real hermitian\n1 1 0\n", "%%MatrixMarket matrix coordinate real general\n2 2 1\n3 1 5\n"):
        (tmp_path / "f.mtx").write_text(text)
        with pytest.raises(ValueError):
            files.read_matrix(spark, str(tmp_path / "f.mtx"))
    with pytest.raises(ValueError):
        writers.write_matrix(dense.entries, 3, 3, again, files.Banner("array", "real", "general"))


def test_command_line(spark, graph, tmp_path, capsys):
    from pigmenta.__main__ import main

    path = str(tmp_path / "g.egr")
    writers.write_egr(graph, path)
    assert main(["-f", path, "-a", "1", "--family", "jp", "--engine", "local", "--status", "--output", str(tmp_path / "out")]) == 0
    assert "colors used:" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "out")).count() == 30


def test_part_files(spark, tmp_path):
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 3)], "part int, src int, dst int")
    paths = writers.write_parts(edges, str(tmp_path / "p"), "g")
    assert [p[-7:] for p in paths] == ["g_1.txt", "g_2.txt"]
    assert files.snap_meta(spark, paths[0]).edges == 2
    assert files.discover(str(tmp_path / "p"), "*.txt") == paths and files.resolve(paths[0]) == paths[0]


def test_margins(spark):
    runs = spark.createDataFrame([("a", 0, 9, 100.0), ("a", 1, 9, 50.0), ("a", 2, None, None), ("a", 3, 8, 45.0), ("a", 4, 8, 1.0), ("b", 0, 5, 10.0), ("b", 1, 6, 1.0), ("c", 0, None, None)], "dataset string, theta int, color int, runtime_ms double")
    assert {r["dataset"]: r["theta"] for r in th.labels(runs).collect()} == {"a": 3, "b": 0}
    assert th.linear_theta(1_000_000, 10_000_000) == 3
    graphs = spark.createDataFrame([("g", 10, 20)], "dataset string, v long, e long")
    assert th.kernel_score(graphs, spark.createDataFrame([(10.0, 20.0, 0.5)], "v double, e double, alpha double")).first()["score"] == pytest.approx(th.KERNEL_BIAS + 0.5)
    assert tuple(th.features(graphs).first()) == ("g", 10, 20, 0)
    row = th.quality(spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "truth double, prediction double")).first()
    assert (row["violation_ratio"], row["mse"]) == (0.5, 0.5)


@pytest.mark.parametrize("kind", ["linear", "forest"])
def test_training(spark, kind):
    table = spark.createDataFrame([(float(i), float(i % 7), 0.0, 2.0 * i + 1) for i in range(200)], "v double, e double, ratio double, theta double")
    _, scored = th.train(table, kind)
    found = th.quality(scored).first()
    assert found["r2"] > 0.9
    _, again = th.train(table.repartition(7), kind)
    assert th.quality(again).first()["r2"] == pytest.approx(found["r2"], abs=0.02 if kind == "forest" else 1e-6)


def test_kernel_training(spark):
    table = spark.createDataFrame([(float(i), 0.0, 0.0, float(i % 40 > 20) * 4) for i in range(200)], "v double, e double, ratio double, theta double")
    above = table.withColumn("theta", F.col("theta") + 1)  # the weak fit stays below every margin, the strong one does not
    wary, low = th.train(above, "svr", grid={"c": [10.0, 0.001], "gamma": [0.05]})
    assert th.quality(low).first()["violation_ratio"] <= 0.1 and wary.vectors.count() > 10
    model, scored = th.train(table, "svr", c=10.0, gamma=0.05)
    assert th.quality(scored).first()["r2"] > 0.7 and model.vectors.count() > 10
    held = scored.count()
    assert 20 < held < 60
    with pytest.raises(ValueError):
        th.train(table, "none")


def plain_regression(x, y, c, epsilon, gamma, steps=4000):
    """Epsilon-insensitive regression by accelerated projected gradient on the dual, the bias in the kernel; a function of new rows."""
    import numpy as np

    kernel = lambda a, b: np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(-1)) + 1.0
    k = kernel(x, x)
    rate, beta, ahead, t = 1 / np.linalg.eigvalsh(k)[-1], np.zeros(len(y)), np.zeros(len(y)), 1.0
    for _ in range(steps):
        moved = ahead - rate * (k @ ahead - y)
        new = np.clip(np.sign(moved) * np.maximum(np.abs(moved) - rate * epsilon, 0), -c, c)
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        beta, ahead = new, new + (last - 1) / t * (new - beta)
    return lambda other: kernel(other, x) @ beta


def test_kernel_grid_is_that_of_plain_regression(spark):
    """The option with fewest margins predicted too high over the folds, and its predictions, as a plain fit has them."""
    import numpy as np

    table = spark.createDataFrame([(float(i), 0.0, 0.0, float(i % 40 > 20) * 4 + 2) for i in range(200)], "v double, e double, ratio double, theta double")
    options = [{"c": c, "gamma": 0.05} for c in (10.0, 0.001)]
    rows = table.withColumns({"held": th.fold_of(table, 5, 42) == 0, "fold": th.fold_of(table, 5, 43)}).toPandas()
    learn, test = rows[~rows.held], rows[rows.held]
    values = lambda part: (part[["v", "e"]].to_numpy(), part["theta"].to_numpy())

    def plain_score(option):
        scores = []
        for i in sorted(set(learn.fold)):
            (x, y), (new, truth) = values(learn[learn.fold != i]), values(learn[learn.fold == i])
            scores.append((plain_regression(x, y, option["c"], 0.1, option["gamma"])(new) > truth).mean())
        return np.mean(scores)

    plain = [plain_score(o) for o in options]
    best = options[int(np.argmin(plain))]
    assert max(plain) - min(plain) > 0.02  # the choice does not hang on rounding
    _, scored = th.train(table, "svr", grid={"c": [10.0, 0.001], "gamma": [0.05]})
    fitted = plain_regression(*values(learn), best["c"], 0.1, best["gamma"])(values(test)[0])
    assert sorted(r["prediction"] for r in scored.collect()) == pytest.approx(sorted(fitted), abs=0.05)


def test_experiments(spark, graph, tmp_path):
    late = ex.measure(spark, {"g": graph}, ["ldf"], thetas=(0, 1), repeats=2, timeout=0.05, skip_dataset_on_timeout=True).collect()
    assert [(r["ok"], r["error"]) for r in late] == [(False, "timeout")]
    runs = ex.measure(spark, {"g": graph}, ["ldf", "none"], thetas=(0,), repeats=2, engine="local")
    rows = runs.collect()
    assert [r["ok"] for r in rows] == [True, True, False, False] and "unknown" in rows[2]["error"]
    assert ex.best_runs(runs).count() == 1
    assert ex.best_runs(runs, by_runtime=False).first()["run_idx"] == 0
    writers.write_runs_csv(runs, str(tmp_path / "runs"))
    writers.write_runs_json([r.asDict() for r in rows], {"runs": 2}, str(tmp_path / "runs.json"))
    assert json.loads((tmp_path / "runs.json").read_text())["datasets"]["g"]["best_color"] == rows[0]["color"]
    stopped = ex.measure(spark, {"g": graph}, ["none"], repeats=3, stop_after_failure=True)
    assert stopped.count() == 1
    logs = spark.createDataFrame([(1, "Nodes: 5\nEdges: 7\nEGC θ: 3 (Predicted)\nruntime: 1.5 ms\ncolors used: 4\nIter count: 9"), (2, "")], "run int, text string")
    found = {r["run"]: r for r in parse_logs(logs).collect()}
    assert (found[1]["nodes"], found[1]["theta"], found[1]["runtime_ms"], found[1]["color"], found[1]["theta_predicted"]) == (5, 3, 1.5, 4, True)
    assert found[2]["nodes"] is None and not found[2]["theta_predicted"]


def test_rows_are_written_by_tasks(spark, graph, tmp_path, monkeypatch):
    """Files are the same bytes as by hand, no row comes to the driver, and no piece is left."""
    edges = sorted((r["src"], r["dst"]) for r in graph.edges.collect())
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toLocalIterator", None)
    writers.write_egr(Graph(graph.vertices, graph.edges.withColumn("weight", (F.col("src") * 100 + F.col("dst")).cast("int"))), str(tmp_path / "g.egr"), weights=True)
    writers.write_matrix_market(graph, str(tmp_path / "g.mtx"))
    index = [sum(a < v for a, _ in edges) for v in range(31)]
    numbers = [30, len(edges), *index, *(b for _, b in edges), *(100 * a + b for a, b in edges)]
    assert (tmp_path / "g.egr").read_bytes() == struct.pack(f"<{len(numbers)}i", *numbers)
    low = [f"{a + 1} {b + 1} 1.0" for a, b in edges if a > b]
    assert (tmp_path / "g.mtx").read_text().splitlines()[1:] == [f"30 30 {len(low)}", *low]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["g.egr", "g.mtx"]
