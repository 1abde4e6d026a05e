"""A quality classifier that compresses: which of two dictionaries fits a text better.

One zstandard dictionary is trained on text labelled good and one on text labelled bad. A text
is compressed with each, in pieces of ``PIECE_BYTES`` so that long texts do not become their own
dictionary; the difference of the two sizes a byte of text is its evidence. Pieces cover
the whole text. A logistic curve, fitted on labelled texts under dictionaries that have not seen them (two halves
in turn), turns the evidence into the probability of the label good. Evidence of short texts is drawn towards the
mean, as if ``PRIOR_BYTES`` more bytes had it.

Learning is bounded: the ``SAMPLE_ROWS`` labelled rows of each label with the least hashes are
looked up, and texts are taken in that order up to ``SAMPLE_BYTES`` a label, those above ``TEXT_BYTES``
passed over. Every text is scored, by one narrow
pass with a broadcast whose size those bounds fix.

Defined cases: null and empty texts have the mean evidence; a row is held out by its id, and a null id is never;
repeated rows are scored alike, and a text whose id is repeated is learned from once (the longest, then the last);
ids with two labels count for both; without labels of both kinds every score is the share of good ones (0.5 without
any); too little text to train on is used as a dictionary as it is; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import column
from .textbatch import column_buffer, slices

#: Bounds of what is learned from: rows and bytes of each label, and the longest text.
SAMPLE_ROWS, SAMPLE_BYTES, TEXT_BYTES = 6_000, 16 << 20, 256 << 10
PIECE_BYTES, PRIOR_BYTES, DICTIONARY_BYTES, LEVEL = 2048, 64, 256 << 10, 3


def pieces(body: bytes) -> list[bytes]:
    return [body[i : i + PIECE_BYTES] for i in range(0, len(body), PIECE_BYTES)]


def trained(texts: list[bytes]) -> bytes:
    """A dictionary trained on the texts, or the texts themselves where they are too few."""
    samples = [p for t in texts for p in pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


@dataclass(frozen=True)
class Model:
    """Two dictionaries, the mean evidence, and the curve over the evidence; dictionaries are empty where nothing could be learned."""

    good: bytes
    bad: bytes
    mean: float = 0.0
    slope: float = 0.0
    offset: float = 0.0

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(body), **options) for body in (self.good, self.bad)]

    def sizes(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(bytes saved by the good dictionary over the bad one, bytes) of each text."""
        good, bad = self.compressors()
        saved = [sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces(b)) for b in bodies]
        return np.array(saved, dtype=float), np.array([len(b) for b in bodies], dtype=float)

    def scores(self, bodies: list[bytes]) -> np.ndarray:
        if not self.good:
            return np.full(len(bodies), 1 / (1 + np.exp(-self.offset)))
        saved, size = self.sizes(bodies)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.drawn(saved, size) + self.offset, -500, 500)))

    def drawn(self, saved: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Evidence a byte, drawn towards the mean."""
        return (saved + PRIOR_BYTES * self.mean) / (size + PRIOR_BYTES)


def logistic(x: np.ndarray, y: np.ndarray, share: float, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the curve that fits labels best, by Newton steps.

    Labels are drawn in a little, so it is finite; they weigh as if ``share`` of them were 1.
    """
    n1, n0 = y.sum(), len(y) - y.sum()
    weight = np.where(y > 0, share / n1, (1 - share) / n0) * len(y)
    aim = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = x.std() or 1.0
    z, w = np.stack([x / scale, np.ones(len(x))], 1), np.array([0.0, np.log(share / (1 - share))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (weight * (aim - p)))
        w += step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def learned(good: list[bytes], bad: list[bytes], share: float = 0.5) -> Model:
    """A model of labelled texts, of which ``share`` are good in all: the curve is fitted on each half under dictionaries of the other, the dictionaries are of all."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    if not good or not bad:
        return Model(b"", b"", offset=float(np.log(share / (1 - share))))
    if len(good) == 1 or len(bad) == 1:
        folds = [(good, bad, good, bad)]
    else:
        folds = [(good[i::2], bad[i::2], good[1 - i :: 2], bad[1 - i :: 2]) for i in (0, 1)]
    saved, size, label = [], [], []
    for known_good, known_bad, new_good, new_bad in folds:
        part = Model(trained(known_good), trained(known_bad)).sizes(new_good + new_bad)
        saved.append(part[0])
        size.append(part[1])
        label.append(np.repeat([1.0, 0.0], [len(new_good), len(new_bad)]))
    saved, size, label = (np.concatenate(x) for x in (saved, size, label))
    mean = float(saved.sum() / max(1.0, size.sum()))
    model = Model(trained(good), trained(bad), mean)
    slope, offset = logistic(model.drawn(saved, size), label, share)
    return Model(model.good, model.bad, mean, slope, offset)


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, labels: DataFrame) -> Model:
    """The model of ``df`` (id, text) under ``labels`` (id, quality), learned from ids that are not held out."""
    usable = labels.where(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("quality").isin(0, 1)).distinct()
    counts = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a label
    ranked = usable.withColumn("hash", F.xxhash64(F.lit(13), F.col("id").cast("string")))
    drawn = [ranked.where(F.col("quality") == q).orderBy("hash", "id").limit(SAMPLE_ROWS) for q in (0, 1)]
    sample = drawn[0].unionByName(drawn[1])  # of bounded size
    best = F.max_by("text", F.struct(F.octet_length("text"), F.col("text")))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    sized = df.select("id", size.alias("size")).join(F.broadcast(sample), "id").groupBy("quality", "hash", "id").agg(F.max("size").alias("size"))
    chosen, used = [], {0: 0, 1: 0}
    for r in sorted(sized.collect(), key=lambda r: (r["hash"], str(r["id"]))):
        if 0 < r["size"] <= TEXT_BYTES and used[r["quality"]] + r["size"] <= SAMPLE_BYTES:
            used[r["quality"]] += r["size"]
            chosen.append((r["id"], r["quality"], len(chosen)))
    total = sum(counts.values())
    if not chosen:
        return learned([], [], counts.get(1, 0) / total if total else 0.5)
    wanted = df.sparkSession.createDataFrame(chosen, f"id {df.schema['id'].dataType.simpleString()}, quality int, place int")
    texts = df.join(F.broadcast(wanted), "id").groupBy("quality", "place").agg(best.alias("text")).collect()  # at most twice ``SAMPLE_BYTES``
    by_label = [[r["text"].encode() for r in sorted(texts, key=lambda r: r["place"]) if r["quality"] == q] for q in (1, 0)]
    return learned(*by_label, counts.get(1, 0) / total)


def quality_scores(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """One row per row of ``df``: its id, whether it was held out, the probability of the label 1, and the prediction."""
    narrow = df.select(column(df, id_column).alias("id"), column(df, text).cast("string").alias("text"))
    marks = labels.select(column(labels, id_column).cast(narrow.schema["id"].dataType).alias("id"), column(labels, label).cast("int").alias("quality"))
    model = df.sparkSession.sparkContext.broadcast(fit(narrow, marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, offsets = column_buffer(batch.column(1))
            bodies = [raw[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(bodies), pa.float64())], names=["id", "score"])

    scored = narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, score double")
    return scored.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")).withColumnRenamed("id", id_column)


def op13_compression(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
