"""Spans of regular expressions as DataFrame expressions only.

Spark gives the matches of an expression but not where they are. The text between
the matches has the missing lengths: ``split`` by the same expression returns it,
so the running sum of both lengths is the position of each match, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements of one block of a running sum.
_BLOCK = 128


def _add(columns: list[str], make) -> dict[str, Column]:
    return {c: make(c) for c in columns}


def _running_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace integer arrays of n elements by the sums of their first 1 ... n elements.

    Sums run within blocks and over the totals of blocks, so an array of n elements
    costs about n * sqrt(n) copies at most, not n squared. Steps are separate
    projections, so none is evaluated twice.
    """
    empty = F.array().cast("array<int>")
    grow = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
    one_block = lambda c: F.size(c) <= _BLOCK
    blocks = lambda c: F.when(one_block(c), F.array(F.col(c))).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / _BLOCK).cast("int")), lambda b: F.slice(c, b * _BLOCK + 1, _BLOCK)))
    df = df.withColumns(_add(columns, blocks))
    df = df.withColumns(_add(columns, lambda c: F.transform(c, lambda b: F.aggregate(b, empty, grow))))
    before = lambda c: F.aggregate(F.transform(c, lambda b: F.coalesce(F.try_element_at(b, F.lit(-1)), F.lit(0))), F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    df = df.withColumns({f"{c}_before": before(c) for c in columns})
    joined = lambda c: F.flatten(F.zip_with(c, F.slice(f"{c}_before", 1, F.size(c)), lambda b, o: F.transform(b, lambda x: x + o)))
    return df.withColumns(_add(columns, joined)).drop(*(f"{c}_before" for c in columns))


SPANS = "array<struct<word: string, start: int, end: int, before: string, after: string>>"


def locate(df: DataFrame, text: str, patterns: dict[str, str], has: dict[str, Column] | None = None) -> DataFrame:
    """Add a column of each name: array of struct(word, start, end, before, after).

    All matches of the name's pattern, left to right. ``start`` and ``end`` are code
    points, the end exclusive; ``before`` and ``after`` are the text up to the next
    match on either side, 48 characters at most. Patterns must not match the empty
    string. ``has`` holds cheap conditions without which a pattern cannot match.
    """
    none, numbers, kinds = F.array().cast("array<string>"), F.array().cast("array<int>"), list(patterns)
    has = has or {}

    def found(k: str) -> Column:
        got = F.regexp_extract_all(text, F.lit(f"({patterns[k]})"), F.lit(1))
        return F.when(has[k], got).otherwise(none) if k in has else got

    words, gaps, ends = ([f"{k}__{x}" for k in kinds] for x in ("words", "gaps", "ends"))
    df = df.withColumns({w: found(k) for k, w in zip(kinds, words)})
    df = df.withColumns({g: F.when(F.size(w) > 0, F.split(text, patterns[k], -1)).otherwise(none) for k, w, g in zip(kinds, words, gaps)})
    step = lambda w, g: F.zip_with(F.slice(g, 1, F.size(w)), w, lambda a, b: F.length(a) + F.length(b))
    df = df.withColumns({e: F.when(F.size(w) > 0, step(w, g)).otherwise(numbers) for w, g, e in zip(words, gaps, ends)})
    df = _running_sums(df, ends)

    def spans(w: str, g: str, e: str) -> Column:
        rows = F.arrays_zip(F.col(w).alias("word"), F.col(e).alias("end"), F.slice(g, 1, F.size(w)).alias("before"), F.slice(g, 2, F.size(w)).alias("after"))
        made = F.transform(rows, lambda x: F.struct(x["word"].alias("word"), (x["end"] - F.length(x["word"])).alias("start"), x["end"].alias("end"), F.substring(x["before"], -48, 48).alias("before"), F.substring(x["after"], 1, 48).alias("after")))
        return F.when(F.size(w) > 0, made).otherwise(F.array().cast(SPANS))

    return df.withColumns({k: spans(w, g, e) for k, w, g, e in zip(kinds, words, gaps, ends)}).drop(*words, *gaps, *ends)


def listed(spans: Column, kind_order: bool) -> Column:
    """``kind:start:end`` of struct(kind, rank, start, end), comma-joined.

    By rank of the kind, then start, or the other way round.
    """
    if kind_order:
        keyed = F.transform(spans, lambda s: F.struct(s["rank"].alias("a"), s["start"].alias("b"), s["end"].alias("end"), s["kind"].alias("kind")))
        name = lambda s: F.concat_ws(":", s["kind"], s["b"].cast("string"), s["end"].cast("string"))
    else:
        keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["rank"].alias("b"), s["end"].alias("end"), s["kind"].alias("kind")))
        name = lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(keyed), name), ",")


def of_kind(spans: Column, kind: str, rank: int) -> Column:
    """struct(kind, rank, start, end) of each span."""
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end")))
