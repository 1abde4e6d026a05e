"""Mixing sources to target weights by pivotal dependent rounding, DataFrame functions only.

Every document of a source gets ``target / size`` copies on average: the whole part
at once, the fraction by dependent rounding. Documents are blocked by source, class
of size and a hash, each block is sorted by size and folded: two fractions meet, one
gives mass to the other at random (so that both keep their expectation) until one of
them is 0 or 1, and the other goes on. Each block ends with one fractional
document at most; those are blocked again, level by level, until one is left for a
source, which is rounded at random. As documents of like size meet, the words taken
come near the target, not only the number of documents.

Rows that are equal in id, text and source are one unit: of their fractions together the
whole copies go to as many of them, what is left is folded like a document's. So a block
holds about ``BLOCK`` units however large a source, a class or a group of equal rows is. Mass is held in
integers (2**40 is one copy), so sums are exact. The random draws are hashes of the
documents met and the seed: reruns agree whatever the partitioning.

Defined cases: null and empty texts have size 0 and are folded like any others (they
take 0 words); a null source is a source of its own, last; a source whose size is 0 has
target 0; null ids are rows like others; repeated rows share what they are due, each
taking the whole part or one copy more; an empty table gives an empty table; extra
columns are not looked at, and may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .names import fresh, quoted, row_key

ONE = 1 << 40
BLOCK = 64
_CLASSES_PER_OCTAVE = 4
_UNIT = "struct<size: long, spread: long, id: {id}, row: long, mass: long, base: long, n: long, whole: long>"
#: Repeated rows that one step writes out.
_RUN = 4096


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) for (source, source_size): one row for each source.

    Sources in code-point order, null last, weigh ``weights``, repeating, and share the
    sum of all sizes. Targets above ``cap`` times their source's size stop there; what
    is over is shared by weight among the others. All those not stopped share one
    rate: with sources sorted by the rate at which they would stop, it is the first
    rate below the next source's. One row a source is all that is windowed.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(ordered) - 1) % n + 1).cast("int")))
    stops = Window.orderBy("stop", F.col("source").isNull(), "source")
    sorted_ = weighed.withColumn("stop", F.lit(cap) * F.col("source_size") / F.col("w"))
    upto = stops.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    rates = sorted_.withColumns(
        {
            "used": F.coalesce(F.lit(cap) * F.sum("source_size").over(upto), F.lit(0.0)),
            "w_used": F.coalesce(F.sum("w").over(upto), F.lit(0.0)),
            "all": F.sum("source_size").over(total).cast("double"),
            "w_all": F.sum("w").over(total),
            "rank": F.row_number().over(stops),
        }
    ).withColumn("rate", (F.col("all") - F.col("used")) / (F.col("w_all") - F.col("w_used")))
    # the first source that its predecessors' rate does not stop gives the common rate
    rates = rates.withColumn("common", F.min(F.when(F.col("rate") < F.col("stop"), F.struct("rank", "rate"))).over(total)["rate"])
    return rates.select("source", "source_size", F.when(F.col("common").isNull() | (F.col("common") >= F.col("stop")), F.lit(cap) * F.col("source_size")).otherwise(F.col("common") * F.col("w")).cast("double").alias("target"))


def _class(size: Column) -> Column:
    """Classes of like sizes, a bounded number of them."""
    return F.floor(F.log2((size + 1).cast("double")) * _CLASSES_PER_OCTAVE).cast("int")


def _draw(seed: int, level: int, a: Column, b: Column, turn: Column) -> Column:
    """A number in [0, 1) that depends on the two documents, the level and the turn."""
    h = F.xxhash64(F.lit(seed), F.lit(level), a["row"], a["id"], b["row"], b["id"], turn)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def _fold(units: DataFrame, keys: list[str], level: int, seed: int, unit: str) -> DataFrame:
    """Fold each block of ``keys``: (keys, rest: the fractional unit or null, done: the others)."""
    none, empty = F.lit(None).cast(unit), F.array().cast(f"array<{unit}>")
    start = F.struct(none.alias("rest"), empty.alias("done"), F.lit(0).alias("turn"))

    def with_mass(u: Column, mass: Column) -> Column:
        return F.struct(u["size"].alias("size"), u["spread"].alias("spread"), u["id"].alias("id"), u["row"].alias("row"), mass.cast("long").alias("mass"), u["base"].alias("base"), u["n"].alias("n"), u["whole"].alias("whole"))

    def step(acc: Column, b: Column) -> Column:
        a, turn = acc["rest"], acc["turn"]
        both = a["mass"] + b["mass"]
        draw = _draw(seed, level, a, b, turn)
        under = both < ONE
        # under one copy: one unit gets all, the other none; else one gets a copy, the other the rest
        b_wins = F.when(under, draw * both < b["mass"]).otherwise(draw * (F.lit(2 * ONE) - both) < F.lit(ONE) - a["mass"])
        high, low = F.when(under, both).otherwise(F.lit(ONE)), F.when(under, F.lit(0).cast("long")).otherwise(both - ONE)
        new_a, new_b = with_mass(a, F.when(b_wins, low).otherwise(high)), with_mass(b, F.when(b_wins, high).otherwise(low))
        a_whole = F.when(under, b_wins).otherwise(~b_wins)  # a's mass is 0 or one copy now
        rest, done = F.when(a_whole, new_b).otherwise(new_a), F.when(a_whole, new_a).otherwise(new_b)
        met = F.struct(F.when(rest["mass"].isin(0, ONE), none).otherwise(rest).alias("rest"), F.when(rest["mass"].isin(0, ONE), F.concat(acc["done"], F.array(done, rest))).otherwise(F.concat(acc["done"], F.array(done))).alias("done"), (turn + 1).alias("turn"))
        alone = F.struct(b.alias("rest"), acc["done"].alias("done"), turn.alias("turn"))
        return F.when(a.isNull(), alone).otherwise(met)

    blocks = units.groupBy(*keys).agg(F.array_sort(F.collect_list("unit")).alias("members"))
    return blocks.select(*keys, F.aggregate("members", start, step).alias("fold"))


def mix(df: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 7, key: Column | None = None) -> DataFrame:
    """One row per row of ``df``: (id, row, size, source_size, target, copies, taken).

    ``row`` is ``key`` (a long), by default a hash of the id and the text; it names rows for a
    join back to ``df``.
    """
    row = F.xxhash64(F.col(id_column), F.col(text).cast("string")) if key is None else key
    each = df.select(F.col(id_column).alias("id"), row.alias("row"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    sized = materialize(each.groupBy("id", "row", "source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    unit = _UNIT.format(id=sized.schema["id"].dataType.simpleString())
    by_source = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = materialize(targets(by_source, weights, cap), "targets")
    per_class = sized.groupBy("source", _class(F.col("size")).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    blocks = per_class.select("source", "cls", F.ceil(F.col("n") / BLOCK).alias("n_blocks"))
    blocks = materialize(blocks, "blocks")
    most = blocks.agg(F.max("n_blocks")).first()[0] or 1

    def null_safe(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
        other = right.withColumnsRenamed({c: f"{c}__" for c in names})
        on = reduce(lambda a, b: a & b, (left[c].eqNullSafe(other[f"{c}__"]) for c in names))
        return left.join(other, on).drop(*(f"{c}__" for c in names))

    rated = null_safe(sized.withColumn("cls", _class(F.col("size"))), null_safe(blocks, goals, ["source"]), ["source", "cls"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    mass = F.round(rate * ONE).cast("long")
    # n equal rows are due n fractions: whole copies of them, and the mass of one more
    due = F.col("n").cast("decimal(20,0)") * (mass % ONE).cast("decimal(18,0)")
    own = due % F.lit(ONE).cast("decimal(18,0)")
    extra = ((due - own) / F.lit(ONE).cast("decimal(18,0)")).cast("long")
    block = F.pmod(F.shiftright(F.xxhash64("row", "id"), 7), F.col("n_blocks"))
    rated = rated.select("source", "cls", block.alias("block"), F.struct("size", F.xxhash64("row", "id", "size").alias("spread"), "id", "row", own.cast("long").alias("mass"), F.floor(mass / ONE).cast("long").alias("base"), "n", extra.alias("whole")).cast(unit).alias("unit"))
    whole = rated.where("unit.mass = 0").select("source", "unit")
    units, done, level = rated.where("unit.mass != 0"), [whole], 0
    while True:
        folded = materialize(_fold(units, ["source", "cls", "block"], level, seed, unit), f"fold-{level}")
        done.append(folded.select("source", F.explode("fold.done").alias("unit")))
        rest = folded.where("fold.rest IS NOT NULL")
        units = rest.select("source", "cls", F.floor(F.col("block") / BLOCK).cast("long").alias("block"), F.col("fold.rest").alias("unit"))
        level += 1
        if most <= 1:
            break
        most = (most + BLOCK - 1) // BLOCK
    # one unit a class is left, a bounded number for a source: the last fold, then a draw
    last = materialize(_fold(units.select("source", "unit"), ["source"], level, seed, unit), "fold-last")
    done.append(last.select("source", F.explode("fold.done").alias("unit")))
    left = last.where("fold.rest IS NOT NULL").select("source", F.col("fold.rest").alias("u"))
    up = _draw(seed, level + 1, F.col("u"), F.col("u"), F.lit(0)) * ONE < F.col("u.mass")
    done.append(left.select("source", F.struct("u.size", "u.spread", "u.id", "u.row", F.when(up, F.lit(ONE)).otherwise(F.lit(0)).cast("long").alias("mass"), "u.base", "u.n", "u.whole").alias("unit")))
    every = reduce(DataFrame.unionByName, done)
    out = null_safe(every, goals, ["source"])
    # the n rows of a unit: the first ones take a copy more
    more = F.col("unit.whole") + F.when(F.col("unit.mass") == ONE, 1).otherwise(0)
    out = out.select(F.col("unit.id").alias("id"), F.col("unit.row").alias("row"), F.col("unit.size").alias("size"), "source_size", "target", F.col("unit.base").alias("base"), F.col("unit.n").alias("n"), more.cast("long").alias("more"))
    single = out.where("n = 1").select("id", "row", "size", "source_size", "target", (F.col("base") + F.col("more")).alias("copies"))
    runs = out.where("n > 1").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_RUN).cast("long")))).repartition(F.col("row"), F.col("first"))
    nth = runs.withColumn("nth", F.explode(F.sequence("first", F.least(F.col("first") + _RUN, F.col("n")) - 1)))
    repeated = nth.select("id", "row", "size", "source_size", "target", (F.col("base") + F.when(F.col("nth") < F.col("more"), 1).otherwise(0)).cast("long").alias("copies"))
    return single.unionByName(repeated).withColumn("taken", F.col("copies") * F.col("size"))


def resample(df: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 7) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, with all their columns.

    Rows that are equal in every column share the copies given to any of them: each is
    written the whole number of times that all of them are, and what is left over is written
    from one of them, in runs. So only the remainders of repeated rows are moved.
    """
    key, row, total, rows, left, first = fresh(df, "key__", "row__", "copies__", "rows__", "left__", "first__")
    mixed = mix(df, id_column, text, source, weights, cap, seed, row_key(df))
    given = materialize(mixed.groupBy(F.col("row").alias(row)).agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(rows)), "given")
    keyed = df.withColumn(key, row_key(df))
    columns = quoted(*df.columns)
    each = F.floor(F.col(total) / F.col(rows)).cast("long")
    times = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n))
    whole = keyed.join(given.where(F.col(total) >= F.col(rows)), F.col(key) == F.col(row)).withColumn(left, times(each)).select(*columns)
    over = given.where(F.col(total) % F.col(rows) > 0).withColumn(left, F.col(total) % F.col(rows))
    one = keyed.join(over, F.col(key) == F.col(row))
    spare = one.where(F.col(rows) > 1).dropDuplicates([key]).withColumn(first, F.explode(F.sequence(F.lit(0).cast("long"), F.col(left) - 1, F.lit(_RUN).cast("long")))).repartition(F.col(key), F.col(first))
    spare = spare.withColumn(total, times(F.least(F.lit(_RUN).cast("long"), F.col(left) - F.col(first))))
    return whole.unionAll(spare.select(*columns))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3 of their sources."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
