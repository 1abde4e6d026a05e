"""Personal data: expressions propose spans, checksums confirm them, context scores them.

DataFrame functions only, and no shuffle: each row is searched on its own. Every
proposed span has a base score; a checksum that holds raises it, words beside the
span raise or lower it, and spans that reach ``MIN_SCORE`` are kept. The four base
kinds are certain once their own test holds. Two kinds depend on the rest: ``iban``
needs its mod-97 remainder, ``ssn`` needs a word beside it that says what it is.

Expressions are written so that a failed start is not tried again inside the same
run of characters, so very long texts cost time in proportion to their length.

Defined cases: null and empty texts have no spans; a null id is returned as it is;
repeated rows are searched alike; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import listed, locate, of_kind

MIN_SCORE = 0.6

# The contract's expressions. A run that fails from its start fails from inside it
# too, so a match begins at the last match's end (\G) or where no run goes on.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
_CONTEXT = {
    "email": r"e-?mail|contact|mail",
    "ip": r"\bip\b|address|host",
    "card": r"card|visa|credit|payment",
    "phone": r"phone|call|tel\b|mobile",
    "iban": r"iban|bank|account|transfer",
    "ssn": r"ssn|social security",
}
_DOUBT = r"example|sample|version|isbn"


def digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(word: Column) -> Column:
    """Whether an IBAN's remainder is 1 (ISO 13616)."""
    plain = F.regexp_replace(word, " ", "")
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    step = lambda a, c: F.when(c.between("0", "9"), a * 10 + F.try_to_number(c, F.lit("9")).cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _ip_parts(word: Column) -> Column:
    return F.forall(F.split(word, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.regexp_extract(p, r"^0*([0-9]{1,3})$", 1).try_cast("int"), F.lit(999)) <= 255))


_TESTS = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: _ip_parts(s["word"]),
    "card": lambda s: F.length(digits(s["word"])).between(13, 19) & luhn(digits(s["word"])),
    "phone": lambda s: F.length(digits(s["word"])).between(9, 15),
    "iban": lambda s: mod97(s["word"]),
    "ssn": lambda s: ~s["word"].rlike("^(000|666|9)|-00-|-0000$"),
}
#: Score of a span that passed its kind's test, before context.
_SCORE = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.9, "ssn": 0.35}


def score(span: Column, kind: str) -> Column:
    """Score of a span that passed its test: words beside it add 0.3 or take 0.15."""
    beside = F.lower(F.concat(span["before"], F.lit(" "), span["after"]))
    return F.lit(_SCORE[kind]) + F.when(beside.rlike(_CONTEXT[kind]), 0.3).otherwise(0.0) - F.when(beside.rlike(_DOUBT), 0.15).otherwise(0.0)


def _passes(kind: str) -> Callable[[Column], Column]:
    """The kind's test; kinds beyond the base also need their score."""
    if kind in KINDS[:4]:
        return lambda s: _TESTS[kind](s)
    return lambda s: _TESTS[kind](s) & (score(s, kind) >= MIN_SCORE)


def _scored(kind: str) -> Column:
    return F.transform(F.col(kind), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["word"].alias("word"), F.least(F.lit(1.0), score(s, kind)).alias("score")))


def located(df: DataFrame, text: str) -> DataFrame:
    """``df`` with a column of spans for each kind; ``text`` must hold no null."""
    body = F.col(text)
    has = {"email": F.contains(body, F.lit("@")), "ip": F.contains(body, F.lit(".")), "phone": F.contains(body, F.lit("+")), "ssn": F.contains(body, F.lit("-"))}
    found = locate(df, text, dict(zip(KINDS, (EMAIL, IP, CARD, PHONE, IBAN, SSN), strict=True)), has)
    return found.withColumns({k: F.filter(k, _passes(k)) for k in KINDS})


def _rows(df: DataFrame, id_column: str, text: str) -> DataFrame:
    return located(df.select(F.col(id_column), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text__")), "text__")


def find_pii(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, found): an array of struct(kind, start, end, word, score) for each row."""
    return _rows(df, id_column, text).select(id_column, F.concat(*(_scored(k) for k in KINDS)).alias("found"))


def redact(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text): the text with each span replaced by its kind in angle brackets.

    Of overlapping spans the first one names the whole.
    """
    ranked = F.concat(*(of_kind(F.col(k), k, i) for i, k in enumerate(KINDS)))
    rows = _rows(df, id_column, text).withColumn("spans__", F.array_sort(F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    body = F.col("text__")

    def step(a: Column, s: Column) -> Column:
        grown = F.concat(a["out"], F.substring(body, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.when(s["start"] >= a["at"], grown).otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    return rows.select(id_column, F.aggregate("spans__", start, step, lambda a: F.concat(a["out"], F.substring(body, a["at"] + 1, F.length(body)))).alias(text))


def pii_digest(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, digest of their spans, all spans."""
    base, more = KINDS[:4], KINDS[4:]
    ranked = {k: of_kind(F.col(k), k, i) for i, k in enumerate(KINDS)}
    return _rows(df, id_column, text).select(
        id_column,
        *(F.size(k).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(listed(F.concat(*(ranked[k] for k in base)), True), 256).alias("base_sha256"),
        listed(F.concat(*(ranked[k] for k in KINDS)), True).alias("spans"),
        reduce(lambda a, b: a + b, (F.size(k) for k in more)).cast("long").alias("n_more"),
    )


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
