"""Values as text, the way conformance scripts expect them."""

from __future__ import annotations

import datetime
import decimal

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def render(v) -> str:
    """NULL, 1/0 for booleans, N.0 for whole floats, ISO dates and times."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "1" if v else "0"
    if isinstance(v, float):
        return f"{v:.1f}" if v == v and abs(v) < 1e15 and v == int(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, datetime.date | decimal.Decimal):
        return v.isoformat() if isinstance(v, datetime.date) else format(v, "f")
    return str(v)


def rendered(df: DataFrame) -> list[list[str]]:
    return [[render(v) for v in row] for row in df.collect()]


def type_chars(schema: T.StructType) -> str:
    """I for integers, R for other numbers, T for the rest, by column."""
    kind = lambda t: "I" if isinstance(t, T.IntegralType | T.BooleanType) else "R" if isinstance(t, T.NumericType) else "T"
    return "".join(kind(f.dataType) for f in schema)
