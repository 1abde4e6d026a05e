"""Secret scan: known shapes, and sliding-window entropy over candidate strings.

DataFrame functions only, and no shuffle. Candidates are runs of 20 or more
characters of a class (hexadecimal of one case, base 64). A window of ``WINDOW`` characters moves
over each; the counts of its characters are updated by the one that enters and the
one that leaves, and with them the sum that gives its Shannon entropy. A candidate
whose best window reaches its class's threshold is a span, unless the allow-list
suppresses it: words, paths, identifiers of versions and of documents, sample keys.

The base kinds (assign, access, hex) stay whatever the entropy says.

Defined cases: null and empty texts have no spans; a null id is returned as it is;
repeated rows are searched alike; extra columns are not looked at; a candidate of any
length costs time in proportion to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import listed, locate, of_kind

WINDOW = 20
#: Contract patterns, ASCII letters in either case for the name of an assignment.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex", "entropy")
#: A candidate: no character of its alphabet beside it.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
_HEX_SYMBOLS = "0123456789abcdef"
_BASE64_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Least entropy in bits a character of a window of 20: at most log2(16) = 4 and log2(20) = 4.32.
_LEAST = {"hex": 2.9, "base64": 3.7}
#: Candidates that are known to be no secrets.
ALLOW = (
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|"  # UUID
    r"^[A-Za-z]+([_/=+-][A-Za-z]+)*[_/=+-]*$|"  # words, paths and identifiers without digits
    r"EXAMPLE|example|^[0-9+/_=-]+$|^[A-Za-z]*(.)\1{7}"
)


def _window_entropy(chars: Column, symbols: str) -> Column:
    """Highest entropy of ``WINDOW`` consecutive elements, in bits, by incremental counts.

    sum(c * log2 c) changes by the terms of one entering and one leaving character.
    """
    terms = F.array(*(F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(WINDOW + 2)))
    term = lambda c: F.element_at(terms, c + 1)
    codes = F.transform(chars, lambda c: F.position(c, F.lit(symbols)))
    zero = F.array_repeat(F.lit(0), len(symbols) + 1)
    start = F.struct(zero.alias("counts"), F.lit(0.0).alias("sum"), F.lit(99.0).alias("least"), F.lit(0).alias("at"))

    def step(a: Column, pair: Column) -> Column:
        enters, leaves = pair["enters"], pair["leaves"]
        own = F.element_at(a["counts"], enters + 1)
        # the leaving character is 0 until the window is full; position 0 is no symbol's
        left = F.when(leaves > 0, F.element_at(a["counts"], leaves + 1) + F.when(leaves == enters, 1).otherwise(0)).otherwise(F.lit(0))
        total = a["sum"] + term(own + 1) - term(own) + F.when(leaves > 0, term(left - 1) - term(left)).otherwise(F.lit(0.0))
        counts = F.transform(a["counts"], lambda c, i: c + F.when(i == enters, 1).otherwise(0) - F.when((i == leaves) & (leaves > 0), 1).otherwise(0))
        full = a["at"] + 1 >= WINDOW
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(full, F.least(a["least"], total)).otherwise(a["least"]).alias("least"), (a["at"] + 1).alias("at"))

    late = F.concat(F.array_repeat(F.lit(0), WINDOW), codes)
    pairs = F.transform(codes, lambda c, i: F.struct(c.alias("enters"), F.element_at(late, i + 1).alias("leaves")))
    return F.aggregate(pairs, start, step, lambda a: F.lit(math.log2(WINDOW)) - a["least"] / WINDOW)


def _entropic(span: Column) -> Column:
    word = span["word"]
    chars, lower = F.split(word, ""), F.split(F.lower(word), "")
    high = F.when(word.rlike("^([0-9a-f]+|[0-9A-F]+)$"), _window_entropy(lower, _HEX_SYMBOLS) >= _LEAST["hex"]).otherwise(_window_entropy(chars, _BASE64_SYMBOLS) >= _LEAST["base64"])
    return F.when(word.rlike(ALLOW), F.lit(False)).otherwise(high)


def located(df: DataFrame, text: str) -> DataFrame:
    """``df`` with a column of spans for each kind; ``text`` must hold no null."""
    body = F.col(text)
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE), strict=True))
    has = {"access": F.contains(body, F.lit("AKIA")), "assign": F.contains(body, F.lit("=")) | F.contains(body, F.lit(":"))}
    found = locate(df, text, patterns, has)
    value = lambda s: F.regexp_extract(s["word"], r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 1)
    return found.withColumns({"assign": F.filter("assign", lambda s: F.length(value(s)) >= 12), "entropy": F.filter("entropy", _entropic)})


def _rows(df: DataFrame, id_column: str, text: str) -> DataFrame:
    return located(df.select(F.col(id_column), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text__")), "text__")


def _named(kind: str) -> Column:
    return F.transform(F.col(kind), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["word"].alias("word")))


def find_secrets(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, found): an array of struct(kind, start, end, word) for each row."""
    return _rows(df, id_column, text).select(id_column, F.concat(*(_named(k) for k in KINDS)).alias("found"))


def secret_digest(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, digest of their spans, all spans."""
    base = KINDS[:3]
    ranked = {k: of_kind(F.col(k), k, i) for i, k in enumerate(KINDS)}
    return _rows(df, id_column, text).select(
        id_column,
        *(F.size(k).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(listed(F.concat(*(ranked[k] for k in base)), False), 256).alias("base_sha256"),
        listed(F.concat(*(ranked[k] for k in KINDS)), False).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"),
    )


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secret_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
