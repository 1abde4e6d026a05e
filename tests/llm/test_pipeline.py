"""The pipeline, stage by stage, against plain versions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from pigmenta.llm.mixing import mix

from . import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = [a + b + c for a in ("ba", "do", "ri", "mel", "son") for b in ("ta", "ne", "lo") for c in ("", "r", "ng", "st")]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(14)) for i in range(4)]
    docs = []
    for i in range(120):
        docs.append((i, say(rng.randrange(40, 160)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None])))
    for i in range(120, 150):
        docs.append((i, docs[i - 120][1] + " more", "en", "a"))
    for i in range(150, 156):
        docs.append((i, say(30) + " " + items[i % 4][1] + " " + say(30), "en", "b"))
    docs += [(156, "go " * 90, "en", "a"), (157, None, "en", "a"), (158, "", "en", "a"), (159, docs[3][1], "en", "c"), (3, docs[3][1], "en", "c")]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), docs, items


def test_stages(spark, folder):
    d, rows, items = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "benchmark", "mixing", "sharding"]
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, d)
    kept = Counter((r["doc_id"], r["text"]) for r in good.collect())
    assert kept == Counter((i, t) for i, t, _, _ in rows if not brute.quality(t)[5])
    alone = stage["near_copies"](spark, good, d)
    left = [(i, t) for (i, t), n in kept.items() for _ in range(n)]
    groups = defaultdict(set)
    for (i, _), (_, _, c) in zip(left, brute.components(left, 5, 80), strict=True):
        groups[c].add(i)
    assert sorted(r["doc_id"] for r in alone.collect()) == sorted(groups)
    clean = stage["benchmark"](spark, alone, d)
    texts = {r["doc_id"]: r["text"] for r in alone.collect()}
    expected = sorted(r[0] for r in brute.contamination(list(texts.items()), items) if not r[5])
    assert sorted(r["doc_id"] for r in clean.collect()) == expected and len(expected) == len(texts) - 6
    taken = stage["mixing"](spark, clean, d)
    copies = {r["id"]: r["copies"] for r in mix(clean).collect()}
    sizes = defaultdict(int)
    got = defaultdict(int)
    for r in clean.collect():
        sizes[r["source"]] += len(brute.words(r["text"]))
    for r in taken.collect():
        got[r["source"]] += len(brute.words(r["text"]))
    assert set(copies) == set(expected)
    for s, t in brute.targets(sizes).items():
        assert abs(got[s] - t) <= 320
    for made in (good, alone, clean, taken):
        assert made.columns == columns
    placed = stage["sharding"](spark, taken, d)
    assert placed.columns == [*columns, "slot", "shard"] and placed.count() == taken.count()


def test_run_is_the_stages(spark, folder):
    d, _, _ = folder
    one, two = (corpus_pipeline.run(spark, d) for _ in range(2))
    assert one.exceptAll(two).count() == 0 and one.count() == two.count() > 0


def test_stages_take_extra_columns_of_any_name(spark, folder):
    d, _, _ = folder
    plain = spark.read.parquet(f"{d}/documents.parquet")
    docs = plain.selectExpr("*", "1 AS `a.b`", "'x' AS kept", "2 AS id_", "3 AS c0")
    for name, stage in corpus_pipeline.STAGES:
        docs, columns = stage(spark, docs, d), docs.columns
        assert docs.columns[: len(columns)] == columns
        if name in ("quality", "near_copies", "benchmark"):  # the mix is drawn by a hash of whole rows
            plain = stage(spark, plain, d)
            assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == sorted(r["doc_id"] for r in plain.select("doc_id").collect())
    assert docs.count() > 0


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
