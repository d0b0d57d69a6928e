"""Keyed inner and left lookups, with or without grouping.

A grouped lookup gives a row for each row of the left side. Where aggregates read the right side only,
that side is aggregated by key before the join: one row for each key is shuffled, and copies of left rows
stay apart by themselves. Where they read both sides, left rows that are equal in the columns that are
read are first counted, then joined and aggregated by these columns, and at last repeated as often as they
were there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.errors import ScriptError
from weftline.functions.aggregates import aggregate, is_aggregate
from weftline.functions.compile import Compiler, Typed, fields
from weftline.functions.parser import references
from weftline.operators.fields import Field, condition, keep, kinds
from weftline.operators.keys import Part, key_column
from weftline.types import SPARK, stored

MATCHED = "_matched"


@dataclass(frozen=True)
class Lookup:
    """on: pairs of a left field and the part of the right side's index that it equals."""

    on: tuple[tuple[str, Part], ...]
    join_type: str
    group: bool
    filter: str | None = None
    strict_keys: bool = False

    def __post_init__(self) -> None:
        if self.join_type not in ("inner", "left"):
            raise ScriptError(f"a lookup is inner or left, not {self.join_type!r}")


def lookup(left: DataFrame, left_kinds: dict[str, str], right: DataFrame, right_kinds: dict[str, str], how: Lookup, columns: list[Field], having: str | None = None) -> DataFrame:
    for mine, part in how.on:
        if mine not in left_kinds or part.field not in right_kinds:
            raise ScriptError(f"no field {mine} or {part.field} to join on")
        if left_kinds[mine] != right_kinds[part.field]:
            raise ScriptError(f"{mine} is {left_kinds[mine]}, {part.field} is {right_kinds[part.field]}")
    if how.filter:
        if any(n.alias not in ("l", "time", "") for n in references(Field("filter", how.filter, "bool").tree)):
            raise ScriptError(f"the filter {how.filter!r} may read l.* only")
        right = right.where(condition(how.filter, fields("l", right_kinds)))
    keys = [f"_key{i}" for i in range(len(how.on))]
    used = {n.field for f in columns for n in references(f.tree) if n.alias == "l"}
    read = {n.field for f in columns for n in references(f.tree) if n.alias == "r"}
    missing = used - set(right_kinds)
    if missing:
        raise ScriptError(f"the lookup table has no {', '.join(sorted(missing))}")
    r = left.select(*(key_column(p, F.col(f"`{m}`"), left_kinds[m], how.strict_keys).alias(k) for k, (m, p) in zip(keys, how.on, strict=True)), *(F.col(f"`{c}`").alias(f"r__{c}") for c in left_kinds if c in read))
    l = right.select(*(key_column(p, F.col(f"`{p.field}`"), right_kinds[p.field], how.strict_keys).alias(k) for k, (_, p) in zip(keys, how.on, strict=True)), *(F.col(f"`{c}`").alias(f"l__{c}") for c in right_kinds if c in used))  # noqa: E741
    scope = fields("r", {c: k for c, k in left_kinds.items() if c in read}, "r__") | fields("l", {c: k for c, k in right_kinds.items() if c in used}, "l__")
    make = _grouped if how.group else _flat
    return keep(make(r, l, keys, scope, how, columns), kinds(columns), having)


def grouped(df: DataFrame, keys: dict[str, Typed], columns: list[Field], having: str | None = None) -> DataFrame:
    """A row for each key of df, with aggregates over l.* (df's rows of that key) and expressions over r.* (keys)."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    back = {v: k for k, v in SPARK.items()}
    l_scope = {"l": {c: Typed(F.col(f"`{c}`"), back[t]) for c, t in types.items()}}
    summed = [f for f in columns if is_aggregate(f.tree)]
    for f in columns:
        if f not in summed and f.uses("l"):
            raise ScriptError(f"field {f.name} reads l.* without an aggregate in a grouped lookup")
    if any(f.uses("r") for f in summed):
        l_scope |= {"r": keys}
    made = [_named(f, aggregate(f.tree, Compiler(l_scope, rounded=True))) for f in summed]
    out = df.groupBy(*(k.column.alias(f"r__{n}") for n, k in keys.items())).agg(*(made or [F.count(F.lit(1)).alias("_n")])).withColumn(MATCHED, F.lit(True))
    scope = fields("r", {n: k.kind for n, k in keys.items()}, "r__")
    return keep(out.select(*(_result(f, summed, scope) for f in columns)), kinds(columns), having)


def _flat(r: DataFrame, l: DataFrame, keys: list[str], scope, how: Lookup, columns: list[Field]) -> DataFrame:  # noqa: E741
    joined = r.join(l.withColumn(MATCHED, F.lit(True)), keys, how.join_type)
    compiler, out = Compiler(scope, rounded=True), []
    for f in columns:
        if is_aggregate(f.tree):
            raise ScriptError(f"field {f.name} aggregates, but its lookup doesn't group")
        value = f.checked(compiler(f.tree))
        if how.join_type == "left" and f.uses("l"):
            value = F.when(F.col(MATCHED), value).otherwise(f.default_column())
        out.append(value.alias(f.name))
    return joined.select(*out)


def _grouped(r: DataFrame, l: DataFrame, keys: list[str], scope, how: Lookup, columns: list[Field]) -> DataFrame:  # noqa: E741
    summed = [f for f in columns if is_aggregate(f.tree)]
    for f in columns:
        if f not in summed and f.uses("l"):
            raise ScriptError(f"field {f.name} reads l.* without an aggregate in a grouped lookup")
    if any(f.uses("r") for f in summed):
        return _grouped_mixed(r, l, keys, scope, how, columns, summed)
    made = [_named(f, aggregate(f.tree, Compiler(scope, rounded=True))) for f in summed]
    right = l.groupBy(*keys).agg(*(made or [F.count(F.lit(1)).alias("_n")])).withColumn(MATCHED, F.lit(True))
    return r.join(right, keys, how.join_type).select(*(_result(f, summed, scope) for f in columns))


def _grouped_mixed(r, l, keys, scope, how: Lookup, columns: list[Field], summed: list[Field]) -> DataFrame:  # noqa: E741
    once = r.groupBy(*r.columns).agg(F.count(F.lit(1)).alias("_times"))
    joined = once.join(l.withColumn(MATCHED, F.lit(True)), keys, how.join_type)
    made = [_named(f, aggregate(f.tree, Compiler(scope, rounded=True), F.col(MATCHED))) for f in summed]
    grouped = joined.groupBy(*r.columns, "_times").agg(*made, F.max(MATCHED).alias(MATCHED))
    again = grouped.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))))
    return again.select(*(_result(f, summed, scope) for f in columns))


def _named(f: Field, made):
    if made.kind != f.kind:
        raise ScriptError(f"field {f.name} is declared {f.kind}, {f.expression!r} is {made.kind}")
    return stored(made.column, f.kind).alias(f"_agg_{f.name}")


def _result(f: Field, summed: list[Field], scope):
    if f not in summed:
        return f.checked(Compiler(scope)(f.tree)).alias(f.name)
    return F.when(F.col(MATCHED), F.col(f"_agg_{f.name}")).otherwise(f.default_column()).alias(f.name)
