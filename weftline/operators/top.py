"""Sorted and limited output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.errors import ScriptError
from weftline.operators.keys import Part, parse_order, sort_column

MOST = 5_000_000


def order_columns(order: str | tuple[Part, ...], types: dict[str, str], strict_keys: bool = False) -> list[Column]:
    parts = parse_order(order) if isinstance(order, str) else order
    unknown = [p.field for p in parts if p.field not in types]
    if unknown:
        raise ScriptError(f"no columns {', '.join(unknown)} to order by")
    return [sort_column(p, F.col(f"`{p.field}`"), types[p.field], strict_keys) for p in parts]


def top(df: DataFrame, order: str, types: dict[str, str], limit: int | None = None, strict_keys: bool = False) -> DataFrame:
    """The first rows in this order; all, sorted, without a limit."""
    if limit is not None and not 0 < limit <= MOST:
        raise ScriptError(f"a limit is from 1 to {MOST}, not {limit}")
    out = df.orderBy(*order_columns(order, types, strict_keys))
    return out.limit(limit) if limit is not None else out
