"""Language-model scoring: prediction by partial matching over bytes, and a word unigram base.

The model is a trie of byte contexts up to three bytes, pretrained on the training
documents. A byte seen after its context costs its share there (method C: one count for
each distinct successor goes to the escape); else the escape is paid and the next
shorter context is asked, without the symbols that the longer one has already offered.
Below the empty context all bytes left are equally likely. The end of a text is a symbol
of its own, a byte that UTF-8 never has, so the scores of all texts are one distribution.
A text's score is the sum over its bytes and its end.

Nothing grows on the driver or in a broadcast. Texts are stored once, with the split that
they belong to: a run of about ``SPLIT_BYTES`` of their partition. The first pass makes, for each
split, its distinct words and four-byte sequences with their training counts; these are
summed over all splits (counts of the whole corpus), the trie is evaluated for each
group of contexts that end alike (65536 sequences at most), and each split gets back
the answers to its own words and sequences, next to which its documents are streamed.
Only two-byte counts, 65536 of them at most, are collected.

Words are told apart by a 64-bit hash.

Defined cases: null and empty texts have one token (the end) and the score of the end; a null id
counts as the empty text for the split into training and held-out documents; repeated
rows are learned and scored each for itself; without training documents all counts are 0
and every byte costs log10(256); extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .textbatch import LOWER, Words, column_buffer, groups

WORD, GRAM, DOCS = 0, 1, 2
_BLOB, _DOCUMENT = 0, 1


#: Bytes of texts that are counted and scored together.
SPLIT_BYTES = 16 << 20
#: The end of a text.
END = 0xFF


def gram_keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row offsets): for each byte and the end of the rows, the three bytes before it in its row (0 where there are none) and itself."""
    raw = np.insert(words.raw, words.offsets[1:], np.uint8(END))
    offsets = words.offsets + np.arange(len(words.offsets))
    key = raw.astype(np.uint32)
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in (1, 2, 3):
        before = np.zeros(len(raw), dtype=np.uint32)
        before[back:] = raw[:-back]
        before[place < back] = 0
        key |= before << np.uint32(8 * back)
    return key, offsets


def _counted(keys: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, weight = np.concatenate(keys), np.concatenate(weights)
    if not len(key):
        return key, weight
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(weight, first)


class _SplitCounts:
    """Distinct keys of one split with their training counts."""

    def __init__(self) -> None:
        self.held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {WORD: ([], []), GRAM: ([], [])}
        self.size = {WORD: 0, GRAM: 0}
        self.documents = 0

    def add(self, kind: int, keys: np.ndarray, train: np.ndarray) -> None:
        """``train``: whether each key's row is a training document."""
        for flag in (True, False):
            some = keys[train] if flag else keys[~train]
            if len(some):
                key, n = np.unique(some, return_counts=True)
                self.held[kind][0].append(key)
                self.held[kind][1].append(n.astype(np.int64) * flag)
                self.size[kind] += len(key)
        if self.size[kind] > 4_000_000:
            self.settle(kind)

    def settle(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.held[kind][0]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, n = _counted(*self.held[kind])
        self.held[kind] = ([key], [n])
        self.size[kind] = len(key) // 2
        return key, n


_REQUEST_DDL = "split long, kind int, key long, n long"


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns split, train, text -> what each split has and what it taught."""
    counts: dict[int, _SplitCounts] = {}

    def out(split: int, own: _SplitCounts) -> Iterator[pa.RecordBatch]:
        for kind in (WORD, GRAM):
            key, n = own.settle(kind)
            key = key.view(np.int64) if kind == WORD and len(key) else key.astype(np.int64)
            for i in range(0, len(key), 100_000):
                part = slice(i, i + 100_000)
                m = len(key[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, split)), pa.array(np.full(m, kind, np.int32)), pa.array(key[part]), pa.array(n[part])], names=["split", "kind", "key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([split], pa.int64()), pa.array([DOCS], pa.int32()), pa.array([0], pa.int64()), pa.array([own.documents], pa.int64())], names=["split", "kind", "key", "n"])

    for batch in batches:
        splits = batch.column(0).to_numpy(zero_copy_only=False)
        train = batch.column(1).to_numpy(zero_copy_only=False)
        raw, offsets = column_buffer(batch.column(2))
        for split in np.unique(splits).tolist():
            if split not in counts:
                for done in [s for s in counts if s not in splits]:  # a scan reads one split after another
                    yield from out(done, counts.pop(done))
                counts[split] = _SplitCounts()
        edges = np.flatnonzero(np.diff(splits)) + 1
        for low_s, high_s in zip([0, *edges], [*edges, len(splits)]):
            own = counts[int(splits[low_s])] if len(splits) else None
            part_off = offsets[low_s : high_s + 1]
            if own is None or not len(splits):
                continue
            own.documents += int(train[low_s:high_s].sum())
            for low, high in groups(part_off):
                off = part_off[low : high + 1]
                words = Words(raw[off[0] : off[-1]], off - off[0])
                teach = train[low_s + low : low_s + high]
                own.add(WORD, words.hashes(0, LOWER), teach[words.row])
                grams, ends = gram_keys(words)
                own.add(GRAM, grams, np.repeat(teach, np.diff(ends)))
    for split, own in counts.items():
        yield from out(split, own)


def _log10(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


def trie_scores(key: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each sequence after the three before it.

    ``key``: distinct sequences, sorted, all those with a training count whose middle
    two bytes occur here; ``n``: their training counts, 0 for asked ones never seen.
    ``pairs[c, s]``: training counts of all two-byte sequences.
    """
    out = np.zeros(len(key))
    if not len(key):
        return out
    n = n.astype(np.float64)
    seen = n > 0

    def by_context(context: np.ndarray, symbol: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct contexts, index of each row's, total, distinct symbols)."""
        distinct, index = np.unique(context, return_inverse=True)
        return distinct, index, np.bincount(index, count, len(distinct)), np.bincount(index, count > 0, len(distinct))

    # order 3
    _, at3, total3, kinds3 = by_context(key >> 8, key, n)
    # order 2: sequences bcs, their counts summed over a
    bcs, at_bcs = np.unique(key & 0xFFFFFF, return_inverse=True)
    n2 = np.bincount(at_bcs, n, len(bcs))
    _, at2, total2, kinds2 = by_context(bcs >> 8, bcs, n2)
    c2, s2 = (bcs >> 8) & 0xFF, bcs & 0xFF
    n1 = pairs.astype(np.float64)
    total1, kinds1 = n1.sum(1), (n1 > 0).sum(1).astype(np.float64)
    n0 = n1.sum(0)
    total0, kinds0 = n0.sum(), float((n0 > 0).sum())

    t3, d3 = total3[at3], kinds3[at3]
    known = t3 > 0
    out[seen] = np.log10(n[seen] / (t3 + d3)[seen])
    # what order 2 offers beyond the symbols of order 3, by order-3 context
    shadow3 = np.bincount(at3, np.where(seen, n2[at_bcs], 0.0), len(total3))
    left_t2 = (total2[at2])[at_bcs] - shadow3[at3]
    left_d2 = (kinds2[at2])[at_bcs] - d3
    # the same for order 1 beyond order 2, by order-2 context, and for order 0 beyond order 1
    shadow2 = np.bincount(at2, np.where(n2 > 0, n1[c2, s2], 0.0), len(total2))
    left_t1 = (total1[c2] - shadow2[at2])[at_bcs]
    left_d1 = (kinds1[c2] - kinds2[at2])[at_bcs]
    shadow1 = ((n1 > 0) * n0).sum(1)
    c, s = c2[at_bcs], s2[at_bcs]
    left_t0, left_d0 = (total0 - shadow1)[c], kinds0 - kinds1[c]

    def escape(t: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.where(d > 0, _log10(d / np.maximum(t + d, 1.0)), 0.0)

    cost = np.where(known, escape(t3, d3), 0.0)
    open_ = ~seen
    for count, t, d in ((n2[at_bcs], left_t2, left_d2), (n1[c, s], left_t1, left_d1), (n0[s], left_t0, left_d0)):
        here = open_ & (count > 0)
        out[here] = cost[here] + np.log10(count[here] / (t + d)[here])
        open_ &= ~here
        cost = cost + escape(t, d)
    out[open_] = cost[open_] - np.log10(256.0 - kinds0) if kinds0 < 256 else cost[open_]
    return out


class _GramTable:
    """Scores by sequence: a table by context and symbol, or a sorted list where that would be large."""

    _slots: np.ndarray | None = None

    def __init__(self, key: np.ndarray, score: np.ndarray) -> None:
        order = np.argsort(key)
        self.key, self.score = key[order], score[order]
        contexts, index = np.unique(self.key >> 8, return_inverse=True)
        symbols = np.unique(self.key & 0xFF)
        self.dense = len(contexts) * len(symbols) <= 24_000_000
        if self.dense:
            if _GramTable._slots is None:
                _GramTable._slots = np.zeros(1 << 24, dtype=np.int32)
            self.contexts = contexts.astype(np.int64)
            self.symbol = np.zeros(256, dtype=np.int64)
            self.symbol[symbols] = np.arange(len(symbols))
            self.width = len(symbols)
            self.table = np.zeros(len(contexts) * self.width)
            self.table[index * self.width + self.symbol[self.key & 0xFF]] = self.score

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not self.dense:
            return self.score[np.searchsorted(self.key, keys.astype(np.int64))]
        slots = _GramTable._slots
        slots[self.contexts] = np.arange(len(self.contexts))  # contexts of this split only are asked
        return self.table[slots[keys >> np.uint32(8)].astype(np.int64) * self.width + self.symbol[keys & np.uint32(0xFF)]]


def _row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


_OUT = [("held_out", "boolean"), ("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")]


def score_texts(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    fold = F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5
    rows = df.select(F.col(id_column).alias("id_"), F.col(text).cast("string").alias("text_"), (fold == 1).alias("held_"))
    id_type = rows.schema["id_"].dataType.simpleString()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with their split: a run of about ``SPLIT_BYTES`` of their partition."""
        split, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            _, offsets = column_buffer(batch.column(1))
            found = split + (size + offsets[:-1]) // SPLIT_BYTES
            size += int(offsets[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=["id_", "text_", "held_", "split_"])

    rows = materialize(rows.mapInArrow(dealt, f"id_ {id_type}, text_ string, held_ boolean, split_ long"), "texts")
    asked = rows.select(F.col("split_").alias("split"), (~F.col("held_")).alias("train"), F.col("text_").alias("text")).mapInArrow(_requests, _REQUEST_DDL)
    asked = materialize(asked, "asked")
    totals = materialize(asked.groupBy("kind", "key").agg(F.sum("n").alias("n")), "totals")
    sums = {r["kind"]: (r["n"] or 0, r["v"]) for r in totals.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).collect()}  # three rows
    n_docs = sums.get(DOCS, (0, 0))[0]
    n_all = sums.get(WORD, (0, 0))[0] + n_docs
    v_all = sums.get(WORD, (0, 0))[1] + (1 if n_docs else 0)
    grams = totals.where(F.col("kind") == GRAM).select("key", "n")
    pairs = np.zeros((256, 256), dtype=np.int64)
    for r in grams.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("p")).agg(F.sum("n").alias("n")).collect():  # 65536 rows at most
        pairs[r["p"] >> 8, r["p"] & 0xFF] = r["n"]
    pairs_all = df.sparkSession.sparkContext.broadcast(pairs)

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        if held:
            key, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key)
            key, n = key[order], n[order]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(trie_scores(key, n, pairs_all.value))], names=["key", "value"])

    by_middle = grams.withColumn("middle", F.shiftright("key", 8).bitwiseAND(0xFFFF)).repartition("middle").select("key", "n")
    answers = by_middle.mapInArrow(evaluate, "key long, value double").withColumn("kind", F.lit(GRAM))
    answers = answers.unionByName(totals.where(F.col("kind") == WORD).select("key", F.col("n").cast("double").alias("value"), "kind"))
    told = asked.where(F.col("kind") != DOCS).select("split", "kind", "key").join(answers, ["kind", "key"]).select("split", "kind", "key", "value")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answers of one split and kind as one row of bytes, for every million of them."""
        held: list[list[np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            split, kind, key, value = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((key, kind, split))
            split, kind, key, value = split[order], kind[order], key[order], value[order]
            cut = np.flatnonzero((np.diff(split) != 0) | (np.diff(kind) != 0)) + 1
            for low, high in zip([0, *cut.tolist()], [*cut.tolist(), len(split)]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([split[low]], pa.int64()), pa.array([_BLOB], pa.int32()), pa.array([int(kind[low])], pa.int32()), pa.array([key[low:high].tobytes()], pa.binary()), pa.array([value[low:high].tobytes()], pa.binary())],
                    names=["split_", "what_", "kind_", "keys_", "values_"],
                )

        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            size += batch.num_rows
            if size >= 1_000_000:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    packed = told.mapInArrow(pack, "split_ long, what_ int, kind_ int, keys_ binary, values_ binary").select("split_", "what_", "kind_", "keys_", "values_", F.lit(None).cast(id_type).alias("id_"), F.lit(None).cast("string").alias("text_"), F.lit(None).cast("boolean").alias("held_"))
    documents = rows.select("split_", F.lit(_DOCUMENT).alias("what_"), F.lit(None).cast("int").alias("kind_"), F.lit(None).cast("binary").alias("keys_"), F.lit(None).cast("binary").alias("values_"), "id_", "text_", "held_")
    streams = packed.unionByName(documents).repartition("split_").sortWithinPartitions("split_", "what_")
    denominator = n_all + 0.5 * (v_all + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, word_key, word_n, table = None, {WORD: [], GRAM: []}, None, None, None
        for batch in batches:
            splits = batch.column(0).to_numpy(zero_copy_only=False)
            what = batch.column(1).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((np.diff(splits) != 0) | (np.diff(what) != 0)) + 1
            for low_s, high_s in zip([0, *cut.tolist()], [*cut.tolist(), len(splits)]):
                if high_s == low_s:
                    continue
                if splits[low_s] != now:
                    now, blobs, word_key, table = splits[low_s], {WORD: [], GRAM: []}, None, None
                if what[low_s] == _BLOB:
                    for i in range(low_s, high_s):
                        blobs[batch.column(2)[i].as_py()].append((np.frombuffer(batch.column(3)[i].as_py(), np.int64), np.frombuffer(batch.column(4)[i].as_py(), np.float64)))
                    continue
                if word_key is None:
                    both = {k: [np.concatenate(x) for x in zip(*v)] if v else [np.zeros(0, np.int64), np.zeros(0)] for k, v in blobs.items()}
                    order = np.argsort(both[WORD][0].view(np.uint64))
                    word_key, word_n = both[WORD][0].view(np.uint64)[order], both[WORD][1][order]
                    table = _GramTable(both[GRAM][0], both[GRAM][1])
                    blobs = {WORD: [], GRAM: []}
                raw, offsets = column_buffer(batch.column(6).slice(low_s, high_s - low_s))
                for low, high in groups(offsets):
                    off = offsets[low : high + 1]
                    words = Words(raw[off[0] : off[-1]], off - off[0])
                    n = word_n[np.searchsorted(word_key, words.hashes(0, LOWER))] if len(words) else np.zeros(0)
                    cost = np.log10((n + 0.5) / denominator)
                    base = _row_sums(cost, words.bounds) + np.log10((n_docs + 0.5) / denominator)
                    known = _row_sums((n > 0).astype(np.float64), words.bounds).astype(np.int64) + (1 if n_docs else 0)
                    grams, ends = gram_keys(words)
                    total = _row_sums(table.of(grams), ends)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(5).slice(low_s + low, high - low), batch.column(7).slice(low_s + low, high - low), pa.array(words.counts + 1, pa.int64()), pa.array(known), pa.array(np.full(high - low, n_all, np.int64)), pa.array(base), pa.array(total)],
                        names=[id_column, *(c for c, _ in _OUT)],
                    )

    return streams.mapInArrow(score, ", ".join([f"`{id_column}` {id_type}", *(f"{c} {t}" for c, t in _OUT)]))


def op7_lm_scores(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model learned from four fifths of them."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
