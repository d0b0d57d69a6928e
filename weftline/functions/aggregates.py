"""The aggregate functions of grouped lookups and of selects.

An aggregate stands at the root of an expression. Each is given for rows of matches: `present` tells
which rows of an outer join are matches, so that others count for nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.errors import ScriptError
from weftline.functions.compile import NUMBERS, Compiler, Typed
from weftline.functions.parser import Call, Literal, walk
from weftline.types import MONEY, ZERO, literal

NAMES = {"sum": 1, "sum_if": 2, "count": 0, "count_if": 1, "avg": 1, "avg_if": 2, "min": 1, "min_if": 2, "max": 1, "max_if": 2, "string_agg": 2, "string_agg_if": 3}


def is_aggregate(tree) -> bool:
    """Whether an aggregate is the root; one below it is an error."""
    root = isinstance(tree, Call) and tree.name in NAMES
    for x in walk(tree):
        if x is not tree and isinstance(x, Call) and x.name in NAMES:
            raise ScriptError(f"{x.name} has to stand at the root of an expression")
    return root


@dataclass(frozen=True)
class Aggregate:
    column: Column
    kind: str


def aggregate(tree: Call, compiler: Compiler, present: Column | None = None) -> Aggregate:
    name, args = tree.name, list(tree.args)
    if len(args) != NAMES[name]:
        raise ScriptError(f"{name} takes {NAMES[name]} arguments, not {len(args)}")
    condition = present
    if name.endswith("_if"):
        wanted = compiler(args.pop())
        if wanted.kind != "bool":
            raise ScriptError(f"the condition of {name} is {wanted.kind}, not bool")
        condition = wanted.column if present is None else present & wanted.column
    base = name.removesuffix("_if")
    if base == "count":
        return Aggregate(F.count(F.lit(1)) if condition is None else F.count_if(F.coalesce(condition, F.lit(False))), "int")
    x = compiler(args[0])
    value = x.column if condition is None else F.when(condition, x.column)
    if base == "string_agg":
        return _joined(x, value, args[1])
    if base in ("sum", "avg") and x.kind not in NUMBERS or x.kind not in (*NUMBERS, "string"):
        raise ScriptError(f"{name} doesn't take {x.kind}")
    made = {"sum": _sum, "avg": _avg, "min": lambda x, v: _least(x, v, F.min), "max": lambda x, v: _least(x, v, F.max)}[base](x, value)
    return Aggregate(F.coalesce(made, literal(ZERO[x.kind], x.kind)), x.kind)


def _joined(x: Typed, value: Column, separator) -> Aggregate:
    """Sorted by value, so that the outcome is the same in every run."""
    if x.kind != "string":
        raise ScriptError(f"string_agg takes string, not {x.kind}")
    if not (isinstance(separator, Literal) and separator.kind == "string"):
        raise ScriptError("the separator of string_agg has to be a string literal")
    return Aggregate(F.array_join(F.array_sort(F.collect_list(value)), separator.value), "string")


def _sum(x: Typed, value: Column) -> Column:
    if x.kind == "decimal2":
        return F.sum(value).cast("decimal(38,2)")
    return F.sum(value)


def _avg(x: Typed, value: Column) -> Column:
    """Of int the floor of the mean; of decimal2 the exact mean rounded half away from zero."""
    n = F.count(value)
    if x.kind == "int":
        total = F.sum(value.cast("decimal(38,0)"))
        return F.when(n > 0, _floor(total, n))
    if x.kind == "decimal2":
        return F.when(n > 0, F.round(F.sum(value.cast("decimal(28,2)")).cast("decimal(28,2)") / n.cast("decimal(20,0)"), 2).cast(MONEY))
    return F.avg(value)


def _floor(total: Column, n: Column) -> Column:
    wide = F.when(n > 0, n).otherwise(F.lit(1)).cast("decimal(20,0)")
    return F.call_function("div", total - F.pmod(total, wide), wide).cast("bigint")


def _least(x: Typed, value: Column, pick) -> Column:
    """Of strings, empty ones count only where there are no others."""
    return pick(F.when(value != "", value)) if x.kind == "string" else pick(value)
