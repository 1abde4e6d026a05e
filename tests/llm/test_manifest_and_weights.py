"""Merkle manifest, importance resampling and the compression classifier against plain versions."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pigmenta.llm import importance
from pigmenta.llm.compression import fit, quality_scores
from pigmenta.llm.importance import Weighing, chunk_entries, chunks, resampled
from pigmenta.llm.merkle import COLUMNS, manifest, sealed, verified
from pigmenta.llm.names import column

from . import brute
from .test_text_operators import SCHEMA, awkward_rows, same


@pytest.fixture(scope="module")
def rows():
    return [(i, t, lang, f"s{n % 5}" if n % 7 else None, None if n % 4 else n) for n, (i, t, lang) in enumerate(awkward_rows())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, n, n % 2 == 0, str(n), "x", n, "k", 1, 2) for n, r in enumerate(rows)], SCHEMA).repartition(5)


def _altered(df):
    changed = [F.translate(column(df, c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == "text" else column(df, c) for c in COLUMNS]
    return F.when(F.crc32(column(df, "doc_id").cast("string")) % 3 == 0, sealed(*changed))


def _proved(df):
    return [tuple(r) for r in verified(manifest(df, COLUMNS, altered=_altered(df))).collect()]


def test_manifest(docs, rows):
    expected = brute.merkle([(i, s, lang, n, t) for i, t, lang, s, n in rows])
    same(_proved(docs), expected)
    assert {r[6] for r in expected} == {True, False}


@pytest.mark.parametrize("sizes", [{}, {"en": 1}, {None: 1, "en": 1}, {"en": 8}, {"en": 9, None: 64, "é": 65, "zz": 1}, {f"l{i}": 1 for i in range(70)}])
def test_manifest_of_trees_of_many_sizes(spark, sizes):
    rows = [(i, "s", lang, i, f"Text {i}") for lang, n in sizes.items() for i in range(n)]
    rows = [(i + 1000 * k, *r[1:]) for k, (i, *r) in enumerate((r[0], *r) for r in rows)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    same(_proved(df), brute.merkle(rows))


def test_manifest_finds_any_change(spark, docs):
    found = manifest(docs, COLUMNS)
    assert found.root == manifest(docs.repartition(3), COLUMNS).root  # whatever the partitioning
    for change in ({"n_chars": F.lit(1)}, {"text": F.concat("text", F.lit(" "))}, {"source": F.lit("-")}):
        assert manifest(docs.withColumns(change), COLUMNS).root != found.root
    nodes = found.trees.blocks(0)
    assert nodes.where(F.size("nodes") > 8).count() == 0 and nodes.select(F.sum(F.size("nodes"))).first()[0] + found.trees.lone.count() == docs.count()


def test_equal_rows_are_leaves_of_their_own(spark):
    rows = [(7, None, None, None, "Same")] * 100
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    same(_proved(df), brute.merkle(rows))


ITEMS = ["w1 w2 w3 w1 w2", "W5, w6!", None, "", "été ça"]


@pytest.mark.parametrize("weighing", [Weighing(), Weighing(buckets=7, passes=1), Weighing(buckets=70_000, passes=2)])
def test_resampling(spark, docs, rows, weighing):
    items = spark.createDataFrame([(x,) for x in ITEMS], "text string")
    found = resampled(docs, items, percent=20, weighing=weighing)
    same([tuple(r) for r in found.collect()], brute.importance([(r[0], r[1]) for r in rows], ITEMS, weighing.buckets, 20))


def test_resampling_of_little(spark):
    items = spark.createDataFrame([], "text string")
    df = spark.createDataFrame([(1, None), (2, "a b"), (None, "a")], "`doc.id` long, Text string")
    found = resampled(df, items, id_column="doc.id")
    assert found.columns[0] == "doc.id"
    same([tuple(r) for r in found.collect()], brute.importance([(1, None), (2, "a b"), (None, "a")], []))
    assert resampled(df.where("false"), items, id_column="doc.id").collect() == []


def _counted(texts, weighing):
    """Features and their texts as chunks of these texts give them, over all slices and groups."""
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array([3] * len(part)), pa.array(part)], ["task", "text"]) for part in (texts[:2], texts[2:]) if part])
    out, n_chunks = Counter(), 0
    for pass_ in range(weighing.passes):
        for chunk in chunks(batches(), weighing.longest):
            n_chunks += 1
            for group, words, strings, count, held, at, copies in chunk_entries(chunk, weighing, pass_, 4, False):
                body, pairs = importance.zstandard.decompress(strings).decode().split(" "), iter(zip(importance._unpack_places(at, chunk.n_rows).tolist(), importance._unpack(copies, "<u4").tolist()))
                for n, (total, h) in enumerate(zip(importance._unpack(count, "<u4").tolist(), importance._unpack(held, "<u4").tolist(), strict=True)):
                    own = [next(pairs) for _ in range(h)]
                    assert sum(c for _, c in own) == total
                    for t, c in own:
                        out[(chunk.first_row - (3 << 40) + t, " ".join(body[n * words : (n + 1) * words]))] += c
    return out, n_chunks


@pytest.mark.parametrize("size", [64, 700, 1 << 20])
def test_chunks_lose_no_feature(monkeypatch, size):
    """Long texts are cut at word ends; runs of words across a cut count once."""
    monkeypatch.setattr(importance, "CHUNK_BYTES", size)
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["The", "été", "x" * 90, "a1", "--", "b"]) for _ in range(rng.randrange(0, 120))) for _ in range(9)] + ["", None, "tail", "x" * 300]
    expected = Counter({(i, f): n for i, t in enumerate(texts) for f, n in brute.features(t).items()})
    for weighing in (Weighing(passes=1), Weighing(passes=3)):
        found, n_chunks = _counted(texts, weighing)
        assert found == expected
    assert (n_chunks > 10) == (size < 1000)


def test_features_whose_hashes_clash(monkeypatch):
    rolling = importance.rolling
    monkeypatch.setattr(importance, "rolling", lambda values, k, which: rolling(values, k, which) % np.uint64(5 if which == 0 else 1 << 63))
    texts = ["a b c a b d", "b c d e", "a"]
    found, _ = _counted(texts, Weighing(passes=1))
    assert found == Counter({(i, f): n for i, t in enumerate(texts) for f, n in brute.features(t).items()})


def _labelled(rng, n):
    good = "the river ran past old mill and quiet valley road by house garden with small stone bridge over water".split()
    data = []
    for i in range(n):
        q = int(rng.random() < 0.7)
        text = " ".join(rng.choice(good) for _ in range(rng.randrange(30, 200))) if q else " ".join(rng.choice(good).upper() + "!!" for _ in range(rng.randrange(30, 200)))
        data.append((i, text, q))
    return data


def test_classifier(spark):
    data = _labelled(random.Random(5), 400)
    awkward = [(1000, None), (1001, ""), (None, data[0][1]), (1002, "x" * 3_000_000), (1003, data[0][1]), (1003, data[0][1])]
    docs = spark.createDataFrame([(i, t, "1", 1) for i, t, _ in data] + [(*r, "0", 0) for r in awkward], "doc_id long, text string, score string, quality int").repartition(3)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data] + [(1003, 1, 0), (None, 0, 0), (1001, None, 0)], "doc_id long, quality int, toxic int")
    found = quality_scores(docs, labels).collect()
    assert len(found) == 406 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    truth = {i: q for i, _, q in data}
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.95 * len(held)
    scores = {r["doc_id"]: r["score"] for r in found}
    assert scores[1000] == scores[1001] and scores[1003] == scores[None] == scores[0]
    # what is held out teaches nothing, nor do other columns
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_scores(docs.select("doc_id", "text"), turned).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in again) == sorted((str(r["doc_id"]), r["score"]) for r in found)


@pytest.mark.parametrize("marks,score", [([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0), ([(1, 1), (2, 1), (5, 0), (8, 1)], None)])
def test_classifier_with_few_labels(spark, marks, score):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([m for m in marks if zlib.crc32(str(m[0]).encode()) % 4 != 2], "doc_id long, quality int")
    found = quality_scores(docs, labels).collect()
    kept = [q for i, q in marks if zlib.crc32(str(i).encode()) % 4 != 2]
    expected = score if score is not None else sum(kept) / len(kept)
    assert all(r["score"] == pytest.approx(expected if kept else 0.5, abs=1e-5) for r in found)


def test_classifier_learns_within_its_bounds(spark, monkeypatch):
    from pigmenta.llm import compression

    monkeypatch.setattr(compression, "SAMPLE_ROWS", 5)
    monkeypatch.setattr(compression, "TEXT_BYTES", 20)
    docs = spark.createDataFrame([(i, f"text number {i}" * (1 if i % 2 else 9)) for i in range(60)], "id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "id long, quality int")
    model = fit(docs, labels)
    assert model.good == b"" and model.offset != 0  # bad texts are all too long to learn from


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_scores(docs, labels).collect() == [] and resampled(docs, docs).collect() == [] and _proved(docs) == []
