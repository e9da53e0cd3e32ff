"""Object ids as pure expressions.

Literal types are one letter: s string, i integer, d double, b boolean, n null, t date or
time, m decimal.  Ids are readable strings in disjoint namespaces, so any task can compute them without
a shared counter: ``e:<kind>/<key>`` for entities, ``v:<type>:<literal>`` for values,
``c:...`` for claims and ``t:<seq>`` for transactions.  A long literal is replaced by
its digest (``v:s#<sha256>``) to keep join keys short.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG_LITERAL = 64


def entity_id(kind: str, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(f"e:{kind}/"), key.cast("string"))


def value_id(lit_type: Column | str, literal: Column) -> Column:
    """Interning: equal typed literals get equal ids on every machine."""
    kind = F.lit(lit_type) if isinstance(lit_type, str) else lit_type
    return F.when(
        F.length(literal) > LONG_LITERAL,
        F.concat(F.lit("v:"), kind, F.lit("#"), F.sha2(literal, 256)),
    ).otherwise(F.concat(F.lit("v:"), kind, F.lit(":"), literal))


def literal_type(dtype: T.DataType) -> str:
    """The literal type of a column; 1, 1.0, '1' and true stay apart."""
    if isinstance(dtype, T.BooleanType):
        return "b"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "i"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "d"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "t"
    if isinstance(dtype, T.DecimalType):
        return "m"
    if isinstance(dtype, T.StringType):
        return "s"
    raise TypeError(f"flatten {dtype.simpleString()} before loading it as claims")


def python_literal(value: object) -> tuple[str, str]:
    """``(lit_type, literal)`` of a Python constant."""
    if value is None:
        return "n", "null"
    if isinstance(value, bool):
        return "b", "true" if value else "false"
    if isinstance(value, int):
        return "i", str(value)
    if isinstance(value, float):
        return "d", double_text(value)
    if isinstance(value, str):
        return "s", value
    raise TypeError(f"not a literal: {value!r}")


def double_text(value: float) -> str:
    """The text that a column of doubles casts to, so that constants meet it."""
    from pyspark import SparkContext

    running = SparkContext._active_spark_context
    if running is not None:
        return running._jvm.java.lang.Double.toString(value)
    if value != value or value in (float("inf"), float("-inf")):
        return {"inf": "Infinity", "-inf": "-Infinity"}.get(repr(value), "NaN")
    if value == 0 or 1e-3 <= abs(value) < 1e7:
        return repr(value)
    sign, digits, exponent = Decimal(repr(value)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0")
    return f"{'-' if sign else ''}{text[0]}.{text[1:] or '0'}E{exponent + len(digits) - 1}"


def literal_id(value: object) -> str:
    """The value id of a Python constant, computed on the driver."""
    import hashlib

    kind, text = python_literal(value)
    if len(text) > LONG_LITERAL:
        return f"v:{kind}#{hashlib.sha256(text.encode()).hexdigest()}"
    return f"v:{kind}:{text}"


def is_value(column: Column) -> Column:
    return column.rlike(r"^v:[a-z][:#]")


def is_long_value(column: Column) -> Column:
    return column.rlike(r"^v:[a-z]#")


def long_text(value: Column, literal: Column) -> Column:
    """The literal where its id does not hold it: what travels beside a claim as ``lit``."""
    return F.when(is_long_value(value), literal)


def short_literal(column: Column) -> Column:
    """The literal held inside a short value id; NULL for anything else."""
    return F.when(column.rlike(r"^v:[a-z]:"), F.substr(column, F.lit(5)))


def short_literal_type(column: Column) -> Column:
    return F.when(is_value(column), F.substring(column, 3, 1))
