"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of the benchmark items. For each pattern length a shift
table over blocks of words says how far a search may jump; blocks at which it may
not jump select, by the hash of the pattern's last words, the windows to test, and
a comparison of the words themselves confirms an occurrence. All rows of a batch
are searched in step, so a jump costs a fraction of a numpy call.

The benchmark is searched in blocks of at most ``block_words`` pattern words (or one item),
each a broadcast of that bounded size, one at a time; a larger benchmark takes more
passes, never a larger broadcast.

Defined cases: null and empty texts have no words and no hits; items without words
give no window; equal windows of several items count for each of them; null item
ids are searched but not listed; repeated rows are judged alike; extra columns are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .names import column, keep_rows, position
from .textbatch import ALNUM_WORDS_RAW, LOWER, Words, slices, column_buffer, groups, rolling

WINDOW = 10
#: Pattern words of a block: its tables take some 60 bytes a word, 30 MB at most.
BLOCK_WORDS = 500_000


class PatternSet:
    """Shift and bucket tables of the windows of one length, as arrays.

    Windows are where they stand in the items' words, so no text is copied; equal
    windows (by two hashes) are one pattern with a list of items.
    """

    def __init__(self, length: int, words: Words, first: np.ndarray, item: np.ndarray) -> None:
        """``first``: the word at which each window begins; ``item``: the item it is of."""
        self.length, self.block = length, min(2, length)
        self.raw, self.starts, self.ends = LOWER[words.raw], words.starts.astype(np.int32), words.ends.astype(np.int32)
        hashes = words.hashes(0, LOWER)
        one, two = rolling(hashes, length, 0)[first], rolling(words.hashes(1, LOWER), length, 1)[first]
        order = np.lexsort((item, two, one))
        one, two, first, item = one[order], two[order], first[order], item[order]
        new = np.ones(len(first), dtype=bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        self.first = first[new].astype(np.int32)
        once = new.copy()
        once[1:] |= item[1:] != item[:-1]
        self.items = item[once].astype(np.int32)
        self.items_at = np.append(np.flatnonzero(new[once]), len(self.items)).astype(np.int32)
        blocks = rolling(hashes, self.block)
        last = length - self.block
        keys = np.concatenate([blocks[self.first + i] for i in range(last + 1)])
        shifts = np.repeat(np.arange(last, -1, -1, dtype=np.int32), len(self.first))
        order = np.lexsort((shifts, keys))
        keys, shifts = keys[order], shifts[order]
        head = np.ones(len(keys), dtype=bool)
        head[1:] = keys[1:] != keys[:-1]
        self.keys, self.shifts = keys[head], shifts[head]
        # buckets: patterns by the hash of their last block
        ends = blocks[self.first + last]
        self.by_end = np.argsort(ends, kind="stable").astype(np.int32)
        self.end_keys = ends[self.by_end]
        bits = min(24, max(10, int(len(self.keys) * 16).bit_length()))
        self.bits = np.uint64(64 - bits)
        present = np.zeros(1 << bits, dtype=bool)
        present[(self.keys >> self.bits).astype(np.int64)] = True
        self.any = np.packbits(present)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def text(self, pattern: int) -> bytes:
        low = int(self.first[pattern])
        return b" ".join(self.raw[s:e].tobytes() for s, e in zip(self.starts[low : low + self.length].tolist(), self.ends[low : low + self.length].tolist()))

    def items_of(self, pattern: int) -> list[int]:
        return self.items[self.items_at[pattern] : self.items_at[pattern + 1]].tolist()

    def shift_at(self, keys: np.ndarray) -> np.ndarray:
        """How far the search may move from each block; 0 where a pattern may end."""
        out = np.full(len(keys), self.length - self.block + 1, dtype=np.int64)
        cell = (keys >> self.bits).astype(np.int64)
        near = np.flatnonzero((self.any[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & np.uint8(1))
        if len(near):
            at = np.searchsorted(self.keys, keys[near])
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == keys[near]
            out[near[hit]] = self.shifts[at[hit]]
        return out

    def search(self, words: Words, hashes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(pattern, index of its first word) of every occurrence."""
        if len(words) < self.length:
            return
        blocks = rolling(hashes, self.block)
        rows = np.flatnonzero(words.counts >= self.length)
        at = words.bounds[rows] + self.length - 1  # the word at which a window would end
        stop = words.bounds[rows + 1]
        raw = words.raw
        while len(at):
            keys = blocks[at - self.block + 1]
            shift = self.shift_at(keys)
            ended = np.flatnonzero(shift == 0)
            low, high = np.searchsorted(self.end_keys, keys[ended], "left"), np.searchsorted(self.end_keys, keys[ended], "right")
            for i, a, b in zip(ended.tolist(), low.tolist(), high.tolist()):
                first = int(at[i]) - self.length + 1
                found = normal(words, raw, first, first + self.length)
                for pattern in self.by_end[a:b].tolist():
                    if found == self.text(pattern):
                        yield pattern, first
            at = at + np.maximum(shift, 1)
            left = at < stop
            at, stop = at[left], stop[left]


def normal(words: Words, raw: np.ndarray, low: int, high: int) -> bytes:
    """The words ``low`` to ``high``, lower-cased and joined by one space."""
    return b" ".join(LOWER[raw[s:e]].tobytes() for s, e in zip(words.starts[low:high].tolist(), words.ends[low:high].tolist()))


def pattern_sets(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[PatternSet]:
    """Tables for all windows of the items; ids are positions in ``items``."""
    raw, offsets = column_buffer(pa.array([text for _, text in items], pa.large_string()))
    words = Words(raw, offsets, ALNUM_WORDS_RAW)
    lengths = np.minimum(words.counts, window)
    out = []
    for length in np.unique(lengths[lengths > 0]).tolist():
        at = words.windows(length)
        item = words.row[at]
        here = lengths[item] == length
        if here.any():
            out.append(PatternSet(length, words, at[here], item[here]))
    return out


def find_hits(texts: pa.Array, sets: list[PatternSet]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[int]]]:
    """Per row: words, merged ranges of hit words, positions of the items found."""
    raw, offsets = column_buffer(texts)
    n_words: list[int] = []
    ranges: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
    items: list[set[int]] = [set() for _ in range(len(texts))]
    for low, high in groups(offsets):
        part = offsets[low : high + 1]
        words = Words(raw[part[0] : part[-1]], part - part[0], ALNUM_WORDS_RAW)
        n_words += words.counts.tolist()
        if not len(words):
            continue
        hashes = words.hashes(0, LOWER)
        for s in sets:
            for pattern, first in s.search(words, hashes):
                row = int(words.row[first])
                begin = first - int(words.bounds[row])
                ranges[low + row].append((begin, begin + s.length))
                items[low + row].update(s.items_of(pattern))
    return n_words, [merged(r) for r in ranges], items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in lists of at most ``block_words`` words (or one item)."""
    block: list[tuple[str | None, str | None]] = []
    words = 0
    rows = benchmark.select(column(benchmark, item_id).cast("string"), column(benchmark, text).cast("string"))
    for item, body in rows.toLocalIterator():  # one partition at a time, never the whole table
        n = (len(body or "") + 1) // 2
        if block and words + n > block_words:
            yield block
            block, words = [], 0
        block.append((item, body))
        words += n
    if block:
        yield block


_DDL = "n_words long, hits array<struct<low: long, high: long>>, items array<string>"
_HITS = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))


def _search_block(narrow: DataFrame, block: list[tuple[str | None, str | None]], window: int) -> tuple[DataFrame, Broadcast]:
    """Hits of one block of items, as (key columns, n_words, hits, items), and the tables that the tasks read."""
    tables = narrow.sparkSession.sparkContext.broadcast((pattern_sets(block, window), [item for item, _ in block]))
    keys = [f for f in narrow.schema if f.name != "text_"]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), _DDL])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, names = tables.value
        for batch in slices(batches):
            n_words, ranges, items = find_hits(batch.column(batch.schema.get_field_index("text_")), sets)
            listed = [sorted({names[i] for i in found if names[i] is not None}) for found in items]
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in keys]
            hits = pa.array([[{"low": a, "high": b} for a, b in r] for r in ranges], _HITS)
            yield pa.RecordBatch.from_arrays([*own, pa.array(n_words, pa.int64()), hits, pa.array(listed, pa.list_(pa.string()))], names=[*(f.name for f in keys), "n_words", "hits", "items"])

    return narrow.mapInArrow(run, ddl), tables


_DIGEST_DDL = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hits array<struct<low: long, high: long>>, items array<string>"


def contamination(df: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``df``: words, hit words and their ranges, items found, verdict.

    With one block of items nothing is shuffled. With more, each is searched for on its own,
    its hits are stored (once for equal rows) and its tables are let go; the hits of a
    row are then brought together by its id and the hash of its text.
    """
    narrow = df.select(column(df, id_column).alias("id_"), column(df, text).cast("string").alias("text_"))
    keyed = narrow.withColumn("key_", F.xxhash64("id_", "text_"))
    blocks = benchmark_blocks(benchmark, item_id, item_text, block_words)
    found, _tables = _search_block(keyed, next(blocks, []), window)
    more, tables = [], _tables
    for block in blocks:
        if not more:
            found = materialize(found, "hits")
        tables.unpersist()
        hits, tables = _search_block(keyed, block, window)
        more.append(materialize(hits.where(F.size("hits") > 0).dropDuplicates(["id_", "key_"]).select("id_", "key_", "hits", "items"), "hits"))
    if more:
        tables.unpersist()
        joined = reduce(DataFrame.unionByName, more).groupBy("id_", "key_").agg(F.flatten(F.collect_list("hits")).alias("hits_"), F.flatten(F.collect_list("items")).alias("items_"))
        joined = joined.withColumnsRenamed({"id_": "id__", "key_": "key__"})
        both = found.join(joined, found["id_"].eqNullSafe(joined["id__"]) & (found["key_"] == joined["key__"]), "left")
        with_more = lambda c: F.concat(c, F.coalesce(f"{c}_", F.expr(f"slice({c}, 1, 0)")))
        found = both.select("id_", "n_words", with_more("hits").alias("hits"), F.array_sort(F.array_distinct(with_more("items"))).alias("items"))
    id_type = narrow.schema["id_"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = batch.select(["n_words", "hits", "items"]).to_pylist()
            hits = [merged([(h["low"], h["high"]) for h in r["hits"]]) for r in rows]
            n_hit = [sum(b - a for a, b in h) for h in hits]
            items = [r["items"] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("id_")), pa.array([r["n_words"] for r in rows], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]), pa.array([n > 0 for n in n_hit]), pa.array([[{"low": a, "high": b} for a, b in h] for h in hits], _HITS), pa.array(items, pa.list_(pa.string())),
                ],
                names=["id_", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits", "items"],
            )

    return found.select("id_", "n_words", "hits", "items").mapInArrow(digest, f"id_ {id_type}, {_DIGEST_DDL}").withColumnRenamed("id_", id_column)


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``df`` in which no benchmark window occurs, with all their columns; one narrow pass per block of items."""
    at = position(df, text)
    out = df
    for block in benchmark_blocks(benchmark, item_id, item_text, block_words):
        sets = df.sparkSession.sparkContext.broadcast(pattern_sets(block, window))
        if out is not df:
            out = materialize(out, "clean")  # one block's tables at a time
        out = keep_rows(out, lambda batch, sets=sets: [not hits for hits in find_hits(batch.column(at), sets.value)[1]])
    return out


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents, against the whole benchmark."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
