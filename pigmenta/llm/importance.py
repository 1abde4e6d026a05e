"""Importance resampling towards a target, over a dictionary of distinct features.

A text's features are its runs of one to ``longest`` words. Each chunk of texts is brought down to
its distinct features, each with its texts and counts (the per-document feature counts), so a
feature that is everywhere is one entry a chunk. Features are dealt by hash; where all chunks'
entries of a feature meet, equal strings are counted globally and each distinct string is
hashed once. The buckets' totals give the gains, which are joined back to the per-document counts, now
by bucket, and add up to a weight a text. Noise drawn from the id by a hash is added, and the
highest scores are drawn.

The dictionary is built in ``passes`` slices of the hash range, one after the other: each reads the texts
again and holds only its share of the strings in shuffle files, which go when the slice is stored.
Within a slice, features fall into as many groups as keep the strings of one near ``GROUP_BYTES``,
by the counted features. A text longer than ``CHUNK_BYTES`` is cut at word ends into chunks that share
``longest - 1`` words, so memory is bounded by those two sizes and the longest word.

Texts are numbered by task and place, so they must come in the same order whenever they are read:
a table's do, and what comes out of a shuffle is stored first.

Defined cases: null and empty texts and texts without words have no features and weight 0; texts with
fewer than ``least_words`` words are scored but never drawn; repeated rows are scored alike, each may be
drawn, and among rows equal in score and id any order is right; a null id counts as an empty string in the noise and comes first among ties;
with an empty table nothing is returned, with an empty target every t is 0; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..scratch import freed_shuffles, materialize, release, scratch_path
from .names import column
from .ranges import placed
from .textbatch import ALNUM_WORDS_RAW, LOWER, Words, column_buffer, rolling, slices

#: Bytes of text in a chunk, and of a group's strings as they are read.
CHUNK_BYTES, GROUP_BYTES = 8 << 20, 32 << 20
#: Bytes of strings for each feature of a text, about: half of them are met in a chunk for the first time.
STRING_BYTES = 8
#: Low bits of a row's number that count within a task.
_TASK_BITS = 40
FEATURES, TOTALS = 0, 1


@dataclass(frozen=True)
class Weighing:
    """What the features are, and how many buckets they fall into."""

    longest: int = 3
    buckets: int = 10_000
    passes: int = 3


def _pack(values: np.ndarray, kind: str) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values, dtype=kind).tobytes(), 1)


def _unpack(body: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(body), dtype=kind)


def _place(n_rows: int) -> str:
    return "<u2" if n_rows <= 1 << 16 else "<u4"


def _pack_places(texts: np.ndarray, n_rows: int) -> bytes:
    """Texts of a chunk as steps from one to the next, which wrap around."""
    kind = _place(n_rows)
    return _pack(np.diff(texts.astype(kind), prepend=np.zeros(1, dtype=kind)), kind)


def _unpack_places(body: bytes, n_rows: int) -> np.ndarray:
    kind = _place(n_rows)
    return np.cumsum(_unpack(body, kind), dtype=kind)


class Chunk:
    """Consecutive texts as one buffer, each with a byte after it; the first ``skip`` words of a piece repeat the end of the piece before it."""

    def __init__(self, first_row: int, raw: np.ndarray, offsets: np.ndarray, skip: int = 0) -> None:
        self.first_row, self.skip = first_row, skip
        self.words = Words(raw, offsets, ALNUM_WORDS_RAW)
        self.n_rows = len(offsets) - 1

    def grams(self, k: int) -> np.ndarray:
        """Where the runs of ``k`` words begin."""
        at = self.words.windows(k)
        return at[at + k > self.skip] if self.skip else at

    def n_words(self) -> np.ndarray:
        return self.words.counts - self.skip

    def n_features(self, longest: int) -> np.ndarray:
        return sum(np.maximum(self.words.counts - k + 1, 0) - max(self.skip - k + 1, 0) for k in range(1, longest + 1))

    def normal(self) -> tuple[np.ndarray, np.ndarray]:
        """The words in lower case with a space after each, and where each begins; the end comes last."""
        w = self.words
        start = np.zeros(len(w) + 1, dtype=np.int64)
        np.cumsum(w.ends - w.starts + 1, out=start[1:])
        # each word and the byte after it; texts are joined by a byte, so there is one
        keep = ALNUM_WORDS_RAW[w.raw]
        keep[w.ends] = True
        return _PLAIN[w.raw[keep]], start


#: Letters and digits in lower case, all else a space.
_PLAIN = np.where(ALNUM_WORDS_RAW, LOWER, np.uint8(0x20))


def _lanes(body: np.ndarray, start: np.ndarray, k: int) -> list[pa.Array]:
    """Arrays of all runs of ``k`` words with the space after them: runs that begin ``k`` words apart do not overlap, so each array is over the buffer as it is."""
    bounds = [np.ascontiguousarray(start[lane::k]) for lane in range(k)]
    return [pa.LargeBinaryArray.from_buffers(pa.large_binary(), max(0, len(b) - 1), [None, pa.py_buffer(b), pa.py_buffer(body)]) for b in bounds]


def _strings(lanes: list[pa.Array], at: np.ndarray) -> pa.Array:
    """The runs that begin at ``at``, those of the first lane first."""
    k = len(lanes)
    return pa.concat_arrays([lane.take(pa.array(at[at % k == i] // k)) for i, lane in enumerate(lanes)])


#: What CRC-32 makes of a byte.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def crc32(strings: pa.Array, drop: int = 0) -> np.ndarray:
    """CRC-32 of each string without its last ``drop`` bytes, byte by byte over all strings in step."""
    raw, offsets = column_buffer(strings)
    size = np.diff(offsets) - drop
    most = int(size.max(initial=0))
    by_size = np.argsort((most - size).astype(np.uint16 if most < 1 << 16 else np.int64), kind="stable")  # two bytes are sorted by digits
    start, left = offsets[:-1][by_size], np.searchsorted(-size[by_size], -np.arange(1, most + 1), "right")
    value = np.full(len(size), 0xFFFFFFFF, dtype=np.uint32)
    for i, n in enumerate(left.tolist()):
        low = value[:n]
        value[:n] = _CRC[(low ^ raw[start[:n] + i]) & np.uint32(255)] ^ (low >> np.uint32(8))
    out = np.empty(len(size), dtype=np.uint32)
    out[by_size] = ~value
    return out


def chunk_entries(chunk: Chunk, weighing: Weighing, pass_: int, groups: int, target: bool) -> Iterator[tuple]:
    """(group, words a string, strings, counts, texts a string, texts, counts a text) of the distinct features of one slice."""
    w = chunk.words
    if not len(w):
        return
    hashes = w.hashes(0, LOWER)
    body, start = chunk.normal()
    for k in range(1, weighing.longest + 1):
        at = chunk.grams(k)
        key = rolling(hashes, k, 0)[at]
        if weighing.passes > 1:
            mine = (key >> np.uint64(32)) % np.uint64(weighing.passes) == np.uint64(pass_)
            at, key = at[mine], key[mine]
        if not len(at):
            continue
        check = rolling(hashes, k, 1)[at]
        coded = pa.array(key).dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        first = np.zeros(len(distinct), dtype=np.int64)
        first[code[::-1]] = np.arange(len(at) - 1, -1, -1)
        if np.any(check != check[first[code]]):  # two runs of one key: tell them apart by both hashes
            both = np.empty(len(at), dtype=[("a", "u8"), ("b", "u8")])
            both["a"], both["b"] = key, check
            _, first, code = np.unique(both, return_index=True, return_inverse=True)
            distinct = key[first]
        count = np.bincount(code, minlength=len(first))
        group = ((distinct & np.uint64(0xFFFFFFFF)) % np.uint64(groups)).astype(np.int64)
        where = at[first]
        order = np.argsort((group * k + where % k).astype(np.uint16 if groups * k < 1 << 16 else np.int64), kind="stable")  # as ``_strings`` gives them, group by group
        texts, copies, held = _postings(code, w.row[at], count, first, order) if not target else (None, None, None)
        lanes = _lanes(body, start, k)
        bounds = np.searchsorted(group[order], np.arange(groups + 1))
        posted = np.concatenate([[0], np.cumsum(held)]) if not target else None
        for g in np.flatnonzero(np.diff(bounds)).tolist():
            low, high = int(bounds[g]), int(bounds[g + 1])
            strings = _strings(lanes, where[order[low:high]])
            _, bounds_, data = strings.buffers()
            end = int(np.frombuffer(bounds_, dtype=np.int64)[high - low])
            row = (g, k, zstandard.compress(memoryview(data)[:end], 3), _pack(count[order[low:high]], "<u4"))
            if target:
                yield (*row, None, None, None)
            else:
                a, b = int(posted[low]), int(posted[high])
                yield (*row, _pack(held[low:high], "<u4"), _pack_places(texts[a:b], chunk.n_rows), _pack(copies[a:b], "<u4"))


def _postings(code: np.ndarray, row: np.ndarray, count: np.ndarray, first: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts and counts of each feature, features in ``order``, and how many texts each has."""
    several = count[code] > 1
    pairs = code[several].astype(np.int64) << 32 | row[several]
    pairs.sort()
    begins = np.flatnonzero(np.diff(pairs, prepend=-1))
    pair_code, pair_row = pairs[begins] >> 32, pairs[begins] & 0xFFFFFFFF
    pair_count = np.diff(np.append(begins, len(pairs)))
    held = np.ones(len(first), dtype=np.int64)
    held += np.bincount(pair_code, minlength=len(first)) - (count > 1)
    # features of one occurrence have one text; the others' pairs lie together, by code
    lies = np.cumsum(np.where(count > 1, held, 0)) - np.where(count > 1, held, 0)
    h = held[order]
    at = np.repeat(np.where(count > 1, lies, 0)[order], h) + np.arange(int(h.sum())) - np.repeat(np.cumsum(h) - h, h)
    single = np.repeat((count == 1)[order], h)
    texts, copies = np.repeat(row[first][order], h), np.ones(len(at), dtype=np.int64)
    texts[~single], copies[~single] = pair_row[at[~single]], pair_count[at[~single]]
    return texts, copies, h


_SPACE = np.array([0x20], dtype=np.uint8)


def _spaced(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space after each."""
    size = np.diff(offsets)
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(size + 1)])
    out = np.full(int(bounds[-1]), 0x20, dtype=np.uint8)
    inside = np.ones(len(out), dtype=bool)
    inside[bounds[1:] - 1] = False
    out[inside] = raw[offsets[0] : offsets[-1]]
    return out, bounds


def _pieces(raw: np.ndarray, longest: int, row: int) -> Iterator[Chunk]:
    """One long text as chunks cut at word ends, each after the last ``longest - 1`` words of the one before."""
    low, before = 0, np.zeros(0, dtype=np.uint8)
    while low < len(raw):
        high = min(len(raw), low + CHUNK_BYTES)
        while high < len(raw) and ALNUM_WORDS_RAW[raw[high]]:  # to the end of the word
            step = ALNUM_WORDS_RAW[raw[high : high + 65_536]]
            high += len(step) if step.all() else int(step.argmin())
        part = np.concatenate([before, raw[low:high], _SPACE])
        words = Words(before, np.array([0, len(before)]), ALNUM_WORDS_RAW)
        chunk = Chunk(row, part, np.array([0, len(part)]), len(words))
        yield chunk
        n = min(longest - 1, len(chunk.words))
        last = part[chunk.words.starts[len(chunk.words) - n] :] if n else part[:0]
        before = np.concatenate([last, _SPACE]) if n else last
        low = high


def chunks(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[Chunk]:
    """Chunks of the texts of a task. ``batches``: task, text; a row's number is that of its task and its place there."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, row = 0, None

    def whole() -> Chunk:
        ends = np.cumsum([0, *(len(r) for r, _ in held)])
        offsets = np.concatenate([np.zeros(1, np.int64), *(o[1:] + e for (_, o), e in zip(held, ends))])
        return Chunk(row, np.concatenate([r for r, _ in held]), offsets)

    for batch in batches:
        row = batch.column(0)[0].as_py() << _TASK_BITS if row is None else row
        raw, offsets = column_buffer(batch.column(1))
        low = 0
        while low < len(offsets) - 1:
            if offsets[low + 1] - offsets[low] > CHUNK_BYTES:
                if held:
                    made = whole()
                    yield made
                    row, held, size = row + made.n_rows, [], 0
                yield from _pieces(raw[offsets[low] : offsets[low + 1]], longest, row)
                row, low = row + 1, low + 1
                continue
            high = int(np.searchsorted(offsets, offsets[low] + CHUNK_BYTES - size, "right")) - 1
            long = np.flatnonzero(np.diff(offsets[low : high + 1]) > CHUNK_BYTES)
            high = min(high, low + int(long[0])) if len(long) else high
            if high > low:
                held.append(_spaced(raw, offsets[low : high + 1]))
                size += int(offsets[high] - offsets[low])
                low = high
            if low < len(offsets) - 1 and held:
                made = whole()
                yield made
                row, held, size = row + made.n_rows, [], 0
    if held:
        yield whole()


_ENTRIES = pa.schema([("group", pa.int32()), ("row", pa.int64()), ("rows", pa.int32()), ("words", pa.int32()), ("strings", pa.binary()), ("counts", pa.binary()), ("held", pa.binary()), ("texts", pa.binary()), ("copies", pa.binary())])
_ENTRIES_DDL = "group int, row long, rows int, words int, strings binary, counts binary, held binary, texts binary, copies binary"
_STORED_DDL = "kind int, row long, rows int, buckets binary, held binary, texts binary, copies binary, bucket int, s long, t long"
_STORED = pa.schema([("kind", pa.int32()), ("row", pa.int64()), ("rows", pa.int32()), ("buckets", pa.binary()), ("held", pa.binary()), ("texts", pa.binary()), ("copies", pa.binary()), ("bucket", pa.int32()), ("s", pa.int64()), ("t", pa.int64())])
_PARTS = pa.schema([("row", pa.int64()), ("rows", pa.int32()), ("body", pa.binary())])
#: Bytes of entries that leave a task together.
_OUT_BYTES = 4 << 20


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, bytes))
        if size > _OUT_BYTES or len(held) >= 500:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def entries(texts: DataFrame, weighing: Weighing, pass_: int, groups: int, target: bool) -> DataFrame:
    """The distinct features of each chunk of ``texts`` (task, text), in groups; without texts and counts for the target's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(slices(batches), weighing.longest):
            found = chunk_entries(chunk, weighing, pass_, groups, target)
            yield from _batched(((e[0], None if target else chunk.first_row, chunk.n_rows, *e[1:]) for e in found), _ENTRIES)

    return texts.mapInArrow(run, _ENTRIES_DDL)


def texts_of(df: DataFrame, weighing: Weighing) -> DataFrame:
    """(row, id, n_words, n_features) of ``df`` (task, text, id); pieces of one text share its row number, and the first has its id."""
    id_type = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                ids.append(b.column(2))
                yield b

        last = None
        for chunk in chunks(noted(), weighing.longest):
            left = pa.concat_arrays(ids)
            own = left.slice(0, chunk.n_rows)
            if chunk.first_row == last:  # one more piece of the same text
                own = pa.nulls(chunk.n_rows, left.type)
            else:
                ids[:] = [left.slice(chunk.n_rows)]
            last = chunk.first_row
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(chunk.n_rows) + last), own, *(pa.array(n.astype(np.int64)) for n in (chunk.n_words(), chunk.n_features(weighing.longest)))], names=["row", "id", "n_words", "n_features"])

    return df.select("task", "text", "id").mapInArrow(run, f"row long, id {id_type}, n_words long, n_features long")


def _dictionary(buckets: int):
    """Of one group of features: strings counted over all chunks, each distinct one hashed once."""

    def run(table: pa.Table) -> pa.Table:
        strings, counts, target = [], [], []
        for words, body, count, row in zip(*(table.column(c) for c in ("words", "strings", "counts", "row"))):
            body = zstandard.decompress(body.as_py())
            # a space after each word: a string ends after every so many
            ends = np.flatnonzero(np.frombuffer(body, dtype=np.uint8) == 0x20)[words.as_py() - 1 :: words.as_py()] + 1
            bounds = np.concatenate([np.zeros(1, dtype=np.int64), ends])
            strings.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(body)]))
            counts.append(_unpack(count.as_py(), "<u4"))
            target.append(np.full(len(ends), not row.is_valid))
        coded = pa.concat_arrays(strings).dictionary_encode()
        code, n = coded.indices.to_numpy(), np.concatenate(counts).astype(np.int64)
        of_target = np.concatenate(target)
        words = coded.dictionary
        hashed = (crc32(words, drop=1) % np.uint32(buckets)).astype(np.int64)  # a string ends in the space after it, which is no part of it
        every = np.bincount(code, weights=n, minlength=len(words))
        wanted = np.bincount(code[of_target], weights=n[of_target], minlength=len(words))
        sums = [np.bincount(hashed, weights=x, minlength=buckets).astype(np.int64) for x in (every - wanted, wanted)]
        out, low = [], 0
        for i, part in enumerate(strings):
            high = low + len(part)
            if table.column("row")[i].is_valid:
                keep = [table.column(c)[i].as_py() for c in ("row", "rows", "held", "texts", "copies")]
                out.append((FEATURES, keep[0], keep[1], hashed[code[low:high]].astype("<u4" if buckets > 65_536 else "<u2").tobytes(), *keep[2:], None, None, None))
            low = high
        out += [(TOTALS, None, None, None, None, None, None, b, int(sums[0][b]), int(sums[1][b])) for b in np.flatnonzero(sums[0] + sums[1]).tolist()]
        return pa.Table.from_batches(list(_batched(iter(out), _STORED)), _STORED)

    return run


def _in_order(df: DataFrame) -> DataFrame:
    """``df`` itself where reading it again gives the same rows in the same order; if it is shuffled, it is stored first."""
    return materialize(df, "texts") if "Exchange" in str(df._jdf.queryExecution().executedPlan()) else df


def weights(df: DataFrame, target: DataFrame, weighing: Weighing) -> DataFrame:
    """(row, id, n_words, n_features, weight) of ``df`` (id, text) against ``target`` (text)."""
    spark = df.sparkSession
    df, target = (_in_order(x).withColumn("task", F.spark_partition_id()) for x in (df, target))
    seen = Observation()
    counted = F.coalesce(F.sum("n_features"), F.lit(0)).alias("n")
    texts = materialize(texts_of(df, weighing).observe(seen, counted), "texts-seen")
    features = seen.get["n"] + (target.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0)
    groups = max(4 * spark.sparkContext.defaultParallelism, int(features * STRING_BYTES // weighing.passes // GROUP_BYTES))
    folder = scratch_path(spark, "features")
    for i in range(weighing.passes):
        found = entries(df.select("task", "text"), weighing, i, groups, False).unionByName(entries(target.select("task", "text"), weighing, i, groups, True))
        with freed_shuffles(spark):
            found.groupBy("group").applyInArrow(_dictionary(weighing.buckets), _STORED_DDL).write.partitionBy("kind").parquet(f"{folder}/pass={i}")
    stored = spark.read.schema(_STORED_DDL.replace("kind int, ", "") + ", pass int, kind int").option("basePath", folder).parquet(f"{folder}/pass=*")
    gains = gains_of(stored.where(F.col("kind") == TOTALS), weighing.buckets)
    unit, width = ("<u4" if weighing.buckets > 65_536 else "<u2"), weighing.buckets

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = gains.value
        assert len(gain) == width
        for batch in slices(batches):
            sums: dict[tuple[int, int], np.ndarray] = {}
            for row, n, buckets, held, texts, copies in zip(*(c.to_pylist() for c in batch.columns)):
                each = np.repeat(gain[np.frombuffer(buckets, dtype=unit)], _unpack(held, "<u4")) * _unpack(copies, "<u4")
                part = np.bincount(_unpack_places(texts, n), weights=each, minlength=n).astype(np.int64)
                key = (row, n)
                sums[key] = sums[key] + part if key in sums else part
            yield from _batched(((row, n, _pack(total, "<i8")) for (row, n), total in sums.items()), _PARTS)

    def total(table: pa.Table) -> pa.Table:
        parts: dict[int, np.ndarray] = {}  # chunks that begin with one row are pieces of it, so of one size
        for row, n, body in zip(*(c.to_pylist() for c in table.columns)):
            parts[row] = parts.get(row, 0) + _unpack(body, "<i8")
        return pa.table({"row": np.concatenate([row + np.arange(len(x)) for row, x in parts.items()]), "weight": np.concatenate(list(parts.values()))})

    id_type = df.schema["id"].dataType.simpleString()
    parts_ = stored.where(F.col("kind") == FEATURES).select("row", "rows", "buckets", "held", "texts", "copies").mapInArrow(add, "row long, rows int, body binary")
    added = parts_.groupBy("row").applyInArrow(total, "row long, weight long")
    none = F.lit(0).cast("long")
    parts = added.select("row", F.lit(None).cast(id_type).alias("id"), none.alias("n_words"), none.alias("n_features"), "weight").unionByName(texts.withColumn("weight", none))
    out = materialize(parts.groupBy("row").agg(F.max("id").alias("id"), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight"))), "weights")
    gains.unpersist()
    release(stored, texts)
    return out


def gains_of(totals: DataFrame, buckets: int):
    """The buckets' gains as a broadcast array, whose size the number of buckets fixes."""
    sums = totals.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    ends = totals.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    all_s, all_t = float(ends["s"] + buckets), float(ends["t"] + buckets)
    gain = F.floor(1000 * F.log((F.col("t") + 1.0) * F.lit(all_s) / ((F.col("s") + 1.0) * F.lit(all_t))))
    rows = sums.select("bucket", gain.alias("gain")).collect()  # one row a bucket
    out = np.zeros(buckets, dtype=np.int64)  # a bucket without features is never asked for
    for r in rows:
        out[r["bucket"]] = r["gain"]
    return totals.sparkSession.sparkContext.broadcast(out)


def resampled(df: DataFrame, target: DataFrame, id_column: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42, weighing: Weighing | None = None) -> DataFrame:
    """One row per row of ``df``: id, n_features, weight, score and rank (null where it is not drawn)."""
    narrow = df.select(column(df, id_column).alias("id"), column(df, text).cast("string").alias("text"))
    found = weights(narrow, target.select(column(target, target_text).cast("string").alias("text")), weighing or Weighing())
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    scored = found.select("id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("fit"))
    fit = materialize(scored.where("fit").select("id", "n_features", "weight", "score", (-F.col("score")).alias("least"), F.lit("").alias("all")), "scored")
    ranked = placed(fit, "all", "least", "id").withColumn("rank", F.when((F.col("at") + 1) <= F.floor(F.lit(percent) * F.col("n") / 100), F.col("at") + 1))
    names = ["id", "n_features", "weight", "score", "rank"]
    rest = scored.where("NOT fit").withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*names).unionByName(rest.select(*names)).withColumnRenamed("id", id_column)


def op11_importance(spark, sf_dir: str) -> DataFrame:
    """All documents resampled towards the benchmark."""
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
