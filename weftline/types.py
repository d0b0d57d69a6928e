"""The six script types: how they are stored, and what stands for an empty value.

Tables hold no nulls. An empty value is the field's default or the zero of its type.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.errors import ScriptError

MONEY = "decimal(18,2)"
SPARK = {"string": "string", "int": "bigint", "float": "double", "bool": "boolean", "decimal2": MONEY, "datetime": "timestamp_ntz"}
ZERO_TIME = dt.datetime(1, 1, 1)
ZERO = {"string": "", "int": 0, "float": 0.0, "bool": False, "decimal2": Decimal("0.00"), "datetime": ZERO_TIME}
# What is read as a truth value.
TRUE = ["1", "t", "T", "TRUE", "true", "True"]
FALSE = ["0", "f", "F", "FALSE", "false", "False"]


def check_type(name: str) -> str:
    if name not in SPARK:
        raise ScriptError(f"unknown type {name!r}; expected one of {', '.join(SPARK)}")
    return name


def literal(value, kind: str) -> Column:
    if kind == "datetime":  # as SQL: early dates would be shifted on their way through the old calendar
        return F.expr(f"timestamp_ntz'{value.isoformat(sep=' ')}'")
    return F.lit(value).cast(SPARK[kind])


def zero(kind: str) -> Column:
    return literal(ZERO[kind], kind)


def default_value(text: str | None, kind: str) -> Column:
    """The value that a script's default names; the zero of the type if it names none."""
    if text is None or text == "":
        return zero(kind)
    text = str(text)
    try:
        if kind == "string":
            return literal(text, kind)
        if kind == "int":
            return literal(int(text), kind)
        if kind == "float":
            return literal(float(text), kind)
        if kind == "decimal2":
            return F.round(F.lit(Decimal(text)), 2).cast(MONEY)
        if kind == "bool":
            if text not in TRUE + FALSE:
                raise ValueError(text)
            return literal(text in TRUE, kind)
        return literal(utc(dt.datetime.fromisoformat(text)), kind)
    except (ValueError, ArithmeticError) as e:
        raise ScriptError(f"{text!r} is no default for type {kind}") from e


def utc(t: dt.datetime) -> dt.datetime:
    """The wall clock in UTC, without a zone, in whole milliseconds."""
    if t.tzinfo:
        t = t.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return t.replace(microsecond=t.microsecond // 1000 * 1000)


def whole_millis(t: Column) -> Column:
    """A time cut to milliseconds, in the type of tables."""
    return F.date_trunc("MILLISECOND", t).cast("timestamp_ntz")


def stored(value: Column, kind: str) -> Column:
    """A value of an expression as a table holds it: money rounded half away from zero, times in milliseconds, no nulls."""
    if kind == "decimal2":
        value = F.round(value, 2).cast(MONEY)
    elif kind == "datetime":
        value = whole_millis(value)
    else:
        value = value.cast(SPARK[kind])
    return F.coalesce(value, zero(kind))
