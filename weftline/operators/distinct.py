"""One row for each key: the least one by all its columns.

The least row is an aggregate, so it is combined before the shuffle and a hot key never gathers its rows
in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.errors import ScriptError
from weftline.operators.keys import Index, key_column


def distinct(df: DataFrame, types: dict[str, str], index: Index, strict_keys: bool = False) -> DataFrame:
    if not index.unique:
        raise ScriptError("a distinct table needs a unique index")
    keys = [key_column(p, F.col(f"`{p.field}`"), types[p.field], strict_keys).alias(f"_key{i}") for i, p in enumerate(index.parts)]
    plain = not strict_keys and not any(p.ignore_case and types[p.field] == "string" for p in index.parts)
    if plain and set(index.fields) == set(df.columns):
        return df.dropDuplicates()
    least = df.groupBy(*keys).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("_row"))
    return least.select(*(F.col("_row")[c].alias(c) for c in df.columns))


def assert_unique(df: DataFrame, types: dict[str, str], name: str, index: Index, strict_keys: bool = False) -> None:
    """A unique index whose key comes twice is an error."""
    keys = [key_column(p, F.col(f"`{p.field}`"), types[p.field], strict_keys).alias(p.field) for p in index.parts]
    twice = df.select(*keys).groupBy(*index.fields).count().where("count > 1").drop("count").take(1)
    if twice:
        raise ScriptError(f"index {name} is unique, but there are several rows for {tuple(twice[0])}")
