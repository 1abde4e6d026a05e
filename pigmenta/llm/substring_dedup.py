"""Substring deduplication: a count-min prefilter, then exact groups of what it lets through.

A window is ``window`` consecutive words of one document. Each window is counted
through its *anchor*: the smallest hash among its runs of ``ANCHOR`` words. Equal
windows have equal anchors, so the number of documents that hold an anchor, and any
count-min estimate of it, is never below the number that hold the window. Partition
sketches over the anchors of each document are merged at a fixed size; windows
whose estimate is 2 or more go to the second pass, which groups them exactly by a
96-bit hash of their word hashes. No window that two documents share is lost.

Of texts that are equal as a whole only the rows of the smallest id are looked at.
Rows without flagged windows are finished where they are read. The other rows of a
task are taken in runs of bounded bytes, whatever the sketch lets through; a run groups its
windows first, so it sends each distinct window once, with its smallest id, whoever holds
it: a passage in a third of all documents costs one entry a run. Entries meet in buckets by their anchor, packed as bytes; a bucket answers each
task with the windows that a smaller id holds elsewhere, and the task's rows are
finished next to the answers.

Defined cases: ids are integers; null and empty texts have no words; texts below the
window length lose nothing; a null id is larger than any other and rows that share an
id do not make each other go; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .mixing import word_count
from .sketch import bits_at, cells_of, input_bytes, merged_sketch, present, repeated, width_for
from .textbatch import Words, slices, mix64, rolling, rolling_min, text_groups

WINDOW = 50
ANCHOR = 8
#: Most cells of a row of the sketch, and bytes of input for one.
SKETCH_WIDTH, CELL_BYTES = 1 << 27, 16
COPY_WIDTH = 1 << 23
#: Bytes of texts and windows that a task holds for one run.
RUN_BYTES = 24 << 20
SKETCH_ROWS = 4


def _anchors(words: Words, window: int, run: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each window, its anchor)."""
    at = words.windows(window)
    if not len(at):
        return at, np.zeros(0, dtype=np.uint64)
    runs = mix64(rolling(hashes, run))
    return at, rolling_min(runs, window - run + 1)[at]


def _distinct_anchors(words: Words, window: int, run: int) -> np.ndarray:
    at, anchor = _anchors(words, window, run, words.hashes(0))
    if not len(at):
        return anchor
    row = words.row[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    anchor, row = anchor[new], row[new]
    order = np.lexsort((anchor, row))
    anchor, row = anchor[order], row[order]
    once = np.ones(len(anchor), dtype=bool)
    once[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    return anchor[once]


def _flagged(words: Words, window: int, run: int, cells: np.ndarray, width: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, two hashes, anchor) of the windows that the sketch estimates at 2 or more."""
    hashes = words.hashes(0)
    at, anchor = _anchors(words, window, run, hashes)
    keep = np.ones(len(at), dtype=bool)
    for r in range(rows):
        keep &= bits_at(cells, cells_of(anchor, r, width).astype(np.int64) + r * width)
    at, anchor = at[keep], anchor[keep]
    if not len(at):
        return at, anchor, anchor, anchor
    return at, mix64(rolling(hashes, window, 0)[at]), mix64(rolling(words.hashes(1), window, 1)[at]), anchor


def _joined_sha(body: bytes, gone: np.ndarray | None) -> str:
    """SHA-256 of the words that stay, joined by one space."""
    words = body.split()
    if gone is not None:
        words = [w for w, g in zip(words, gone.tolist()) if not g]
    return hashlib.sha256(b" ".join(words)).hexdigest()


_NULL_ID = (1 << 63) - 1
_PASSED_DDL = "what int, id_ long, n_words long, kept_sha256 string, task long, text_ string, sure array<int>, begins array<int>, entries array<int>, bucket int, packed binary"
_PASSED = pa.schema([("what", pa.int32()), ("id_", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("task", pa.int64()), ("text_", pa.string()), *((c, pa.list_(pa.int32())) for c in ("sure", "begins", "entries")), ("bucket", pa.int32()), ("packed", pa.binary())])
_OUT_DDL = "id_ long, n_words long, n_removed long, kept_sha256 string, removed array<struct<low: long, high: long>>"
_OUT = pa.schema([("id_", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))])
#: Bytes of input for one bucket of windows, and the largest number of buckets.
_BUCKET_BYTES, _MAX_BUCKETS = 4 << 20, 1 << 20


def _bucket_count(df: DataFrame) -> int:
    """Buckets by the size of the input."""
    return max(8, min(_MAX_BUCKETS, input_bytes(df) // _BUCKET_BYTES))


def _passed_batch(ids: pa.Array, **given: object) -> pa.RecordBatch:
    """A batch of one kind: ``done`` (words, digest) or ``waiting`` (task, text, sure, begins, entries)."""
    n = len(ids)
    columns = {f.name: pa.nulls(n, f.type) for f in _PASSED}
    columns["id_"] = ids.cast(pa.int64())
    if "done" in given:
        counts, shas = given["done"]
        columns |= {"what": pa.array(np.zeros(n, np.int32)), "n_words": pa.array(counts, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
    else:
        task, texts, sure, begins, entries = given["waiting"]
        columns |= {"what": pa.array(np.ones(n, np.int32)), "task": pa.array(np.full(n, task, np.int64)), "text_": texts.cast(pa.string()), "sure": sure, "begins": begins, "entries": entries}
    return pa.RecordBatch.from_arrays([columns[f.name] for f in _PASSED], schema=_PASSED)


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _lists(values: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """One list a row; ``row`` ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _ask(task: int, held: list[tuple], buckets: int) -> Iterator[pa.RecordBatch]:
    """Group the windows of a run: what is decided, what each row asks, and the entries for the buckets. Empties ``held``."""
    rows = [h[:2] for h in held]
    base = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])])
    doc = np.concatenate([h[2] + b for h, b in zip(held, base)])
    ids, begin, one, two, anchors = (np.concatenate([h[i] for h in held]) for i in range(3, 8))
    held.clear()  # each window is held once from here on
    order = np.lexsort((ids, two, one))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    group = np.cumsum(new) - 1
    least = ids[order][new]
    of = np.empty(len(order), dtype=np.int64)  # group of each window
    of[order] = group
    sure = ids > least[of]
    # entries are numbered in the order in which they occur, so their lists are short to store
    first = np.full(len(least), len(order), dtype=np.int64)
    np.minimum.at(first, of[~sure], np.flatnonzero(~sure))
    by_place = np.argsort(first, kind="stable")
    number = np.empty(len(least), dtype=np.int64)
    number[by_place] = np.arange(len(least))
    entry = number[of]
    head = first[by_place]
    anchors, one, two, ids = (x[head] for x in (anchors, one, two, ids))  # of the entries
    del order, new, group, of, first, number, by_place
    at = 0
    for (row_ids, texts), low in zip(rows, base):
        n = len(row_ids)
        high = at + int(np.searchsorted(doc[at:], low + n))
        mine, certain = doc[at:high] - low, sure[at:high]
        yield _passed_batch(row_ids, waiting=(task, texts, _lists(begin[at:high][certain], mine[certain], n), _lists(begin[at:high][~certain], mine[~certain], n), _lists(entry[at:high][~certain], mine[~certain], n)))
        at = high
    bucket = (mix64(anchors) % np.uint64(buckets)).astype(np.int32)
    by_bucket = np.lexsort((np.arange(len(head)), bucket))
    cut = np.flatnonzero(np.diff(bucket[by_bucket])) + 1
    out: dict[str, list] = {"bucket": [], "packed": []}
    for part in np.split(by_bucket, cut):
        out["bucket"].append(int(bucket[part[0]]))
        out["packed"].append(_pack(one[part].tobytes() + ids[part].tobytes() + two[part].tobytes() + part.astype(np.uint32).tobytes()))
    n = len(out["bucket"])
    columns = {f.name: pa.nulls(n, f.type) for f in _PASSED} | {"what": pa.array(np.full(n, 2, np.int32)), "task": pa.array(np.full(n, task, np.int64)), "bucket": pa.array(out["bucket"], pa.int32()), "packed": pa.array(out["packed"], pa.binary())}
    yield pa.RecordBatch.from_arrays([columns[f.name] for f in _PASSED], schema=_PASSED)


def _decide(parts: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """The entries of each task in one bucket that another entry of a smaller id equals."""
    if not parts:
        return
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    for task, packed in parts:
        data = _unpack(packed)
        n = len(data) // 24
        for i, (low, high, kind) in enumerate(((0, 8, np.uint64), (8, 16, np.int64), (16, 20, np.uint32), (20, 24, np.uint32))):
            columns[i].append(np.frombuffer(data[low * n : high * n], dtype=kind))
        columns[4].append(np.full(n, task, dtype=np.int64))
    one, ids, two, entry, task = (np.concatenate(c) for c in columns)
    order = np.lexsort((ids, two, one))
    one, ids, two, entry, task = (c[order] for c in (one, ids, two, entry, task))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    goes = ids > ids[new][np.cumsum(new) - 1]
    entry, task = entry[goes], task[goes]
    order = np.lexsort((entry, task))
    entry, task = entry[order], task[order]
    cut = np.flatnonzero(np.diff(task)) + 1
    rows = [(int(task[low]), _pack(entry[low:high].tobytes())) for low, high in zip([0, *cut.tolist()], [*cut.tolist(), len(task)]) if high > low]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["task", "packed"])


def _finished(row_id: int | None, text: str, begins: np.ndarray, window: int) -> dict:
    """The result of a row whose windows at ``begins`` go."""
    body = text.encode()
    n = len(body.split())
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, begins, 1)
    np.add.at(delta, begins + window, -1)
    out = np.cumsum(delta[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
    return {"id_": row_id, "n_words": n, "n_removed": int(out.sum()), "kept_sha256": _joined_sha(body, out), "removed": [{"low": int(a), "high": int(b)} for a, b in zip(edges[::2], edges[1::2])]}


def _without(batch: pa.RecordBatch, copies: np.ndarray) -> pa.RecordBatch:
    """The rows of (id_, text_, h1, h2) whose text the sketch of copies does not hold."""
    h1 = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
    return batch.filter(pa.array(~bits_at(copies, cells_of(mix64(h1), 0, COPY_WIDTH).astype(np.int64))))


def removed_words(df: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, width: int | None = None, rows: int = SKETCH_ROWS) -> DataFrame:
    """Per row of ``df``: id, n_words, n_removed, kept_sha256 and the word ranges that go."""
    anchor = min(anchor, window)
    width = width or width_for(df, CELL_BYTES, SKETCH_WIDTH)
    hashed = df.select(F.col(id_column).alias("id_"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text_")).withColumns({"h1": F.xxhash64("text_"), "h2": F.xxhash64(F.lit(1), "text_")})
    id_type = hashed.schema["id_"].dataType.simpleString()
    ddl = f"id_ {id_type}, text_ string, h1 long, h2 long"

    # exact copies: only the rows of a text's smallest id take part, the others lose all their windows
    copied = materialize(hashed.select("id_", "h1", "h2").groupBy("h1", "h2").agg(F.min("id_").alias("first_"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first_"), "copied")

    def hash_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield mix64(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))

    copies = merged_sketch(copied.select("h1"), hash_of, COPY_WIDTH, 1, present)

    def only_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h1 = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(bits_at(copies.value, cells_of(mix64(h1), 0, COPY_WIDTH).astype(np.int64))))

    some = hashed.mapInArrow(only_copies, ddl).join(copied, ["h1", "h2"], "left")
    some = materialize(some.withColumn("again", F.col("first_").isNotNull() & (F.col("id_").isNull() | (F.col("id_") > F.col("first_")))), "copies")

    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, words in text_groups(batch, "text_"):
            yield _distinct_anchors(words, window, anchor)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _without(batch, copies.value)

    distinct = hashed.mapInArrow(others, ddl).unionByName(some.where("NOT again").select("id_", "text_", "h1", "h2"))
    sketch = merged_sketch(distinct, keys_of, width, rows, repeated)

    # pass 2: rows without flagged windows are finished here, the others keep their text and what they ask
    buckets = _bucket_count(df)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, size = TaskContext.get().partitionId() << 24, 0  # and the run in it
        held: list[tuple] = []
        for batch in slices(batches):
            for low, high, words in text_groups(batch, "text_"):
                at, one, two, anchors = _flagged(words, window, anchor, sketch.value, width, rows)
                has = np.diff(np.searchsorted(at, words.bounds)) > 0
                body = words.raw.tobytes()
                ids, texts = (batch.column(i).slice(low, high - low) for i in range(2))
                done = np.flatnonzero(~has)
                shas = [_joined_sha(body[words.offsets[i] : words.offsets[i + 1]], None) for i in done.tolist()]
                yield _passed_batch(ids.take(pa.array(done)), done=(words.counts[done], shas))
                if len(at):
                    rank = np.cumsum(has) - 1
                    row = words.row[at]
                    number = ids.fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
                    kept = texts.take(pa.array(np.flatnonzero(has)))
                    held.append((ids.take(pa.array(np.flatnonzero(has))), kept, rank[row], number[row], (at - words.bounds[row]).astype(np.int32), one, two.astype(np.uint32), anchors))
                    size += kept.nbytes + 44 * len(at)
                    if size >= RUN_BYTES:
                        yield from _ask(task, held, buckets)
                        task, held, size = task + 1, [], 0
        if held:
            yield from _ask(task, held, buckets)

    passed = materialize(distinct.select(F.col("id_").cast("long").alias("id_"), "text_", "h1", "h2").mapInArrow(second, _PASSED_DDL), "windows")
    sketch.unpersist()
    asked = passed.where("what = 2").select("bucket", "task", "packed")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in slices(batches):
            for bucket, task, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if bucket != now:
                    yield from _decide(parts)
                    now, parts = bucket, []
                parts.append((task, packed))
        yield from _decide(parts)

    answers = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answer, "task long, packed binary")
    waiting = passed.where("what = 1").select("task", F.lit(1).alias("what"), "id_", "text_", "sure", "begins", "entries", F.lit(None).cast("binary").alias("packed"))
    told = answers.select("task", F.lit(0).alias("what"), F.lit(None).cast("long").alias("id_"), F.lit(None).cast("string").alias("text_"), *(F.lit(None).cast("array<int>").alias(c) for c in ("sure", "begins", "entries")), "packed")
    streams = told.unionByName(waiting).repartition("task").sortWithinPartitions("task", "what")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gone = None, np.zeros(0, dtype=bool)
        for batch in slices(batches):
            tasks, what = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[dict] = []
            for i, task in enumerate(tasks):
                if task != now:
                    now, gone = task, np.zeros(0, dtype=bool)
                if what[i] == 0:
                    entries = np.frombuffer(_unpack(batch.column(7)[i].as_py()), dtype=np.uint32)
                    if len(entries) and entries.max() >= len(gone):
                        gone = np.concatenate([gone, np.zeros(int(entries.max()) + 1 - len(gone), dtype=bool)])
                    gone[entries] = True
                    continue
                sure, begins, entries = (batch.column(c)[i].values.to_numpy() for c in (4, 5, 6))
                asked_for = entries < len(gone)
                at = np.concatenate([sure, begins[asked_for][gone[entries[asked_for]]]])
                out.append(_finished(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), at, window))
            yield pa.RecordBatch.from_pylist(out, schema=_OUT)

    nothing = "cast(array() as array<struct<low: long, high: long>>)"
    finished = passed.where("what = 0").select("id_", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.expr(nothing).alias("removed"))
    # of a later copy everything goes, unless it is too short to hold a window
    again = some.where("again").select(F.col("id_").cast("long").alias("id_"), "text_", word_count(F.col("text_")).alias("n_words")).withColumn("goes", F.col("n_words") >= window)
    no_words = F.sha2(F.lit("").cast("binary"), 256)
    kept = F.sha2(F.trim(F.regexp_replace("text_", r"[\x20\x09-\x0D]+", " ")).cast("binary"), 256)
    again = again.select("id_", "n_words", F.when(F.col("goes"), F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("goes"), no_words).otherwise(kept).alias("kept_sha256"), F.when(F.col("goes"), F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("n_words").alias("high")))).otherwise(F.expr(nothing)).alias("removed"))
    return finished.unionByName(again).unionByName(streams.mapInArrow(finish, _OUT_DDL)).withColumnRenamed("id_", id_column)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of all documents that a window shared with a smaller document covers."""
    return removed_words(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")
