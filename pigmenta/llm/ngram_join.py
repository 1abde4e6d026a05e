"""N-gram Jaccard join with rare-first prefix filtering.

Every document is the set of its distinct ``k``-word shingles. Shingles are put in
one global order, estimated rarest first (a count sketch of fixed size over all
documents; any order is correct, a rare-first one is selective). Two sets that
reach the threshold share a shingle within their prefixes, so only prefix shingles
that some other document may hold (estimate of 2 or more) are indexed. Equal sets
are one class from the start.

Shingles of a text are kept only for its prefix. To verify pairs, the texts that occur in
them are read again, found by a filter of fixed size, so whole sets of texts
without candidates are neither stored nor moved.

The index is not expanded into pairs. In each bucket the entry with the earliest
position is the pivot; every entry that length, positional and signature filter leave is
verified against it once. Components of these links are built, and only entries that
are not in their pivot's component are compared with the bucket's entries of other
components. Large buckets are dealt by a salt, and all three filters apply within
the join, before anything is written. The signature is the parity of a set's shingles in
128 cells: two of them differ in no more cells than the sets have shingles of one only,
so it never drops a link. A suffix filter and the sets themselves decide. A linked pair
shares the bucket of its first common shingle: there one of them is the pivot, or both
already are in one component, or it is compared. So no link between components is lost,
while copies of a passage or a large group of near copies cost links to a pivot, not pairs.

Defined cases: texts without words have an empty set and are linked with nothing;
fewer than ``k`` words are one shingle; null ids are ignored when the smallest id of
a component is taken (a component of null ids only has a null id); repeated rows
are equal sets; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .names import fresh, quoted
from ..scratch import materialize, release
from .sketch import bits_at, cells_of, log_levels, merged_sketch, present, width_for
from .textbatch import LOWER, Words, slices, mix64, rolling, text_groups

#: Most cells of the sketch, and bytes of input for one.
SKETCH_WIDTH, CELL_BYTES = 1 << 26, 2
#: Entries of a bucket that one task compares with the others.
SALT_ROWS = 2048
_CELLS = 128


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash), distinct and sorted by row, then hash."""
    hashes = words.hashes(0, LOWER)
    at = words.windows(k)
    keys, rows = mix64(rolling(hashes, k)[at] if len(at) else np.zeros(0, np.uint64)), words.row[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        own = []
        for i in short.tolist():
            h = np.uint64(words.counts[i])
            for x in hashes[words.bounds[i] : words.bounds[i + 1]]:
                h = mix64(np.array([h ^ x]))[0] + np.uint64(1)
            own.append(h)
        keys, rows = np.concatenate([keys, np.array(own, np.uint64)]), np.concatenate([rows, short])
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    once = np.ones(len(keys), dtype=bool)
    once[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    return rows[once], keys[once]


def _set_digest(keys: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    """Order-free 64-bit digest of each row's set; 0 for empty ones."""
    total = np.zeros(len(keys) + 1, dtype=np.uint64)
    np.cumsum(mix64(keys ^ np.uint64(salt)), out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _signatures(rows: np.ndarray, keys: np.ndarray, n_rows: int) -> np.ndarray:
    """Two words a row: the parity of its shingles in each of 128 cells."""
    cell = (keys >> np.uint64(33)).astype(np.int64) & (_CELLS - 1)
    odd = np.bincount(rows * _CELLS + cell, minlength=n_rows * _CELLS).reshape(n_rows, _CELLS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


_ROW_DDL = "n long, cls struct<a: long, b: long>, sig struct<a: long, b: long>, prefix array<struct<token: long, pos: int>>"
#: Bits of the filter that names the texts to verify.
_FILTER_WIDTH = 1 << 23
_CLS = pa.struct([("a", pa.int64()), ("b", pa.int64())])
_PREFIX = pa.struct([("token", pa.int64()), ("pos", pa.int32())])


def _set_rows(words: Words, n_rows: int, k: int, percent: int, cells: np.ndarray, width: int) -> list[pa.Array]:
    rows, keys = shingle_sets(words, k)
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    n = np.diff(bounds)
    level = cells[cells_of(keys, 0, width)]
    order = np.lexsort((keys, level, rows))
    pos = np.arange(len(keys)) - bounds[rows]
    size = n[rows]
    prefix = size + (-percent * size // 100) + 1  # size - ceil(percent * size / 100) + 1
    pick = (pos < prefix) & (level[order] >= 2)
    picked = order[pick]
    at = np.searchsorted(rows[picked], np.arange(n_rows + 1)) if len(picked) else np.zeros(n_rows + 1, np.int64)
    entries = pa.StructArray.from_arrays([pa.array(keys[picked].view(np.int64)), pa.array(pos[pick].astype(np.int32))], fields=list(_PREFIX))
    signs = _signatures(rows, keys, n_rows)
    signature = pa.StructArray.from_arrays([pa.array(signs[:, 0].copy()), pa.array(signs[:, 1].copy())], fields=list(_CLS))
    return [pa.array(n, pa.int64()), _classes(keys, bounds, n), signature, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), entries)]


def _classes(keys: np.ndarray, bounds: np.ndarray, n: np.ndarray) -> pa.Array:
    """The class of each row's set, null for empty ones."""
    return pa.StructArray.from_arrays([pa.array(_set_digest(keys, bounds, s).view(np.int64)) for s in (0x51ED270B, 0x2545F491)], fields=list(_CLS), mask=pa.array(n == 0))


def _sets_of(keyed: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """(cls, n, tokens) of the texts whose key is in ``keys``, one row a class.

    A filter of fixed size over the keys goes to the tasks, so only texts that are to be
    verified (and a few more) are cut into shingles and moved.
    """

    def key_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield mix64(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))

    wanted = merged_sketch(keys, key_of, _FILTER_WIDTH, 1, present)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches):
            cell = cells_of(mix64(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)), 0, _FILTER_WIDTH)
            for low, high, words in text_groups(batch.filter(pa.array(bits_at(wanted.value, cell.astype(np.int64)))), "text_"):
                rows, tokens = shingle_sets(words, k)
                bounds = np.searchsorted(rows, np.arange(high - low + 1))
                n = np.diff(bounds)
                names = _classes(tokens, bounds, n)
                new = []
                for i, c in enumerate(names.to_pylist()):
                    if c is not None and (c["a"], c["b"]) not in seen:
                        seen.add((c["a"], c["b"]))
                        new.append(i)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tokens.view(np.int64)))
                pick = pa.array(new, pa.int64())
                yield pa.RecordBatch.from_arrays([names.take(pick), pa.array(n, pa.int64()).take(pick), lists.take(pick)], names=["cls", "n", "tokens"])

    found = keyed.select("key_", "text_").mapInArrow(sets, "cls struct<a: long, b: long>, n long, tokens array<bigint>")
    return found.groupBy("cls").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))


def _reach(percent: int, overlap: Column, a: Column, b: Column) -> Column:
    """Whether ``overlap`` common shingles of sets of sizes ``a`` and ``b`` reach the threshold."""
    return (100 + percent) * overlap >= percent * (a + b)


def _may_link(percent: int, x: str, y: str) -> Column:
    """Length, positional and signature filter at a shared prefix shingle."""
    differ = F.expr(f"bit_count({x}.sig.a ^ {y}.sig.a) + bit_count({x}.sig.b ^ {y}.sig.b)")
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    left = F.least(nx - F.col(f"{x}.pos"), ny - F.col(f"{y}.pos"))
    alike = (100 + percent) * (nx + ny - differ) >= 2 * percent * (nx + ny)
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & _reach(percent, left, nx, ny) & alike


def _suffix_bound(tx: Column, ty: Column, nx: Column, ny: Column) -> Column:
    """Upper bound of the overlap from both halves of the range of hashes.

    What each half can share is the smaller of its two parts; the hashes are
    uniform, so zero splits a set about evenly.
    """
    lx, ly = F.size(F.filter(tx, lambda t: t < 0)), F.size(F.filter(ty, lambda t: t < 0))
    return F.least(lx, ly) + F.least(nx - lx, ny - ly)


def _verified(pairs: DataFrame, active: DataFrame, keyed: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """The pairs (x, y) whose sets reach the threshold, each verified once."""
    pairs = materialize(pairs.distinct(), "pairs")
    nodes = pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct()
    sets = materialize(_sets_of(keyed, nodes.join(active.select("cls", "key_"), "cls").select("key_"), k), "sets")
    full = pairs.join(sets.select(F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("tokens").alias("tx")), "x")
    full = full.join(sets.select(F.col("cls").alias("y"), F.col("n").alias("ny"), F.col("tokens").alias("ty")), "y")
    nx, ny, tx, ty = (F.col(c) for c in ("nx", "ny", "tx", "ty"))
    common = F.size(F.array_intersect(tx, ty))
    links = materialize(full.where(_reach(percent, _suffix_bound(tx, ty, nx, ny), nx, ny) & _reach(percent, common, nx, ny)).select("x", "y"), name)
    release(pairs, sets)
    return links


def linked_groups(df: DataFrame, id_column: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, width: int | None = None) -> DataFrame:
    """One row per row of ``df``: id, key of its text, set size, class and component.

    Returns (id_, key_, n_shingles, cls, component_id): ``component_id`` is the smallest
    id that links of Jaccard similarity ``percent``/100 or more reach from the row.
    """
    narrow = df.select(F.col(id_column).alias("id_"), F.col(text).cast("string").alias("text_"))
    id_type = narrow.schema["id_"].dataType.simpleString()

    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, words in text_groups(batch, "text_"):
            yield shingle_sets(words, k)[1]

    width = width or width_for(df, CELL_BYTES, SKETCH_WIDTH)
    sketch = merged_sketch(narrow.select("text_"), keys_of, width, 1, log_levels)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for low, high, words in text_groups(batch, "text_"):
                own = [batch.column(i).slice(low, high - low) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, *_set_rows(words, high - low, k, percent, sketch.value, width)], names=["id_", "key_", "n", "cls", "sig", "prefix"])

    keyed = narrow.withColumn("key_", F.xxhash64("text_"))
    wide = materialize(keyed.mapInArrow(sets, f"id_ {id_type}, key_ long, {_ROW_DDL}"), "rows")
    rows = materialize(wide.select("id_", "key_", "n", "cls"), "narrow")
    # any text of a class will do to verify it
    active = materialize(wide.where(F.size("prefix") > 0).groupBy("cls").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("prefix").alias("prefix"), F.first("key_").alias("key_")), "classes")
    release(wide)
    sketch.unpersist()

    entries = active.select("cls", "n", "sig", F.explode("prefix").alias("p")).select("cls", "n", "sig", "p.token", "p.pos")
    pivots = entries.groupBy("token").agg(F.min(F.struct("pos", "n", "cls", "sig")).alias("p"), F.count(F.lit(1)).alias("m")).where("m > 1").select("token", "m", "p.pos", "p.n", "p.cls", "p.sig")
    met = entries.alias("e").join(pivots.alias("p"), "token")
    at = materialize(met.select("token", "m", "e.cls", "e.n", "e.pos", "e.sig", F.col("p.cls").alias("p_cls"), ((F.col("e.cls") != F.col("p.cls")) & _may_link(percent, "e", "p")).alias("star")), "buckets")
    star = _verified(at.where("star").select(F.col("cls").alias("x"), F.col("p_cls").alias("y")), active, keyed, k, percent, "links")
    roots = materialize(components(star, "x", "y"), "roots")

    # second pairs: only entries outside their pivot's component, in buckets of three or more, dealt by a salt
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    rooted = at.where("m > 2 AND cls != p_cls").join(root_of("cls"), "cls", "left").join(root_of("p_cls"), "p_cls", "left")
    salts = F.ceil(F.col("m") / SALT_ROWS).cast("long").alias("salts")
    rooted = rooted.select("token", salts, "cls", "n", "pos", "sig", F.coalesce("cls_root", "cls").alias("root"), F.coalesce("p_cls_root", "p_cls").alias("p_root")).withColumn("out", F.col("root") != F.col("p_root"))
    rooted = materialize(rooted, "rooted")
    outside = rooted.where("out").withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")))
    every = rooted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    second = outside.alias("o").join(every.alias("e"), (F.col("o.token") == F.col("e.token")) & (F.col("o.salt") == F.col("e.salt")))
    second = second.where((F.col("o.root") != F.col("e.root")) & (~F.col("e.out") | (F.col("o.cls") < F.col("e.cls"))) & _may_link(percent, "o", "e"))
    second = _verified(second.select(F.least("o.cls", "e.cls").alias("x"), F.greatest("o.cls", "e.cls").alias("y")), active, keyed, k, percent, "more-links")
    if second.head(1):
        stars = roots.where("node != root").select(F.col("node").alias("x"), F.col("root").alias("y"))
        roots = components(stars.unionByName(second), "x", "y")
    release(rooted)
    release(at, active)

    classes = rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("id_").alias("min_"))
    rooted_classes = classes.join(roots, classes["cls"] == roots["node"], "left").select("cls", "min_", F.coalesce("root", "cls").alias("root"))
    rooted_classes = materialize(rooted_classes, "rooted-classes")
    ids = rooted_classes.groupBy("root").agg(F.min("min_").alias("component_id"))
    of_class = rooted_classes.join(ids, "root").select("cls", "component_id")
    return rows.select("id_", "key_", "n", "cls").join(of_class, "cls", "left").select("id_", "key_", F.col("n").alias("n_shingles"), "cls", F.when(F.col("cls").isNull(), F.col("id_")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(df: DataFrame, id_column: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, width: int | None = None) -> DataFrame:
    """The rows of ``df`` without those linked to a smaller id: one row of each component stays.

    Rows without words all stay. Of repeated rows of the smallest id one stays.
    """
    found = linked_groups(df, id_column, text, k, percent, width).where(F.col("cls").isNotNull())
    keeper = found.groupBy("component_id").agg(F.min(F.struct(F.col("id_").isNull(), "id_", "key_", "cls")).alias("k")).select("k.id_", "k.key_")
    key, empty = fresh(df, "key__", "empty__")
    (id_name, text_name), columns = quoted(id_column, text), quoted(*df.columns)
    body = F.col(text_name).cast("string")
    keyed = df.withColumns({key: F.xxhash64(body), empty: ~F.coalesce(body, F.lit("")).rlike(r"[^\x20\x09-\x0D]")})
    none = keyed.where(F.col(empty)).select(*columns)
    rest = keyed.where(~F.col(empty)).alias("d").join(keeper.alias("k"), F.col(f"d.{id_name}").eqNullSafe(F.col("k.id_")) & (F.col(f"d.{key}") == F.col("k.key_")), "left_semi")
    return rest.dropDuplicates([id_column, key]).select(*columns).unionAll(none)


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of all documents under 3-word shingles and a similarity of 0.9 or more."""
    found = linked_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)
    return found.select(F.col("id_").alias("doc_id"), "n_shingles", "component_id")
