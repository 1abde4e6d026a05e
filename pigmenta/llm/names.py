"""Names and keys that do not clash with a caller's columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbatch import slices


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each lengthened until ``df`` has no column of that name, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(*names: str) -> list[str]:
    """Names as column references, whatever characters they hold."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields)


def row_key(df: DataFrame) -> Column:
    """A hash of all columns of a row; columns that hold maps, which Spark does not hash, as JSON."""
    parts = [F.to_json(F.struct(F.col(q))) if _has_map(f.dataType) else F.col(q) for f, q in zip(df.schema, quoted(*df.columns), strict=True)]
    return F.xxhash64(*parts)


def position(df: DataFrame, name: str) -> int:
    """Where the column of that name stands: the exact name, or else the only one that differs by case."""
    exact = [i for i, c in enumerate(df.columns) if c == name]
    found = exact or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} column {name!r} among {', '.join(df.columns)}")
    return found[0]


def column(df: DataFrame, name: str) -> Column:
    """The column of that plain name, which may hold dots and is found in any case."""
    return F.col(quoted(df.columns[position(df, name)])[0])


def keep_rows(df: DataFrame, good: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """The rows of ``df`` that ``good`` marks, with all their columns, whatever their names.

    Columns go to Python under their positions, since names with dots cannot be referred to there.
    """
    plain = [f"c{i}" for i in range(len(df.columns))]
    schema = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(plain, df.schema, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(good(batch), pa.bool_()))

    return df.toDF(*plain).mapInArrow(run, schema).toDF(*df.columns)
