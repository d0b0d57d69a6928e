"""py_calc: fields that Python functions compute, in Arrow batches on the executors.

Expressions are calls of functions that the given sources define, of the allowed builtins, of r.<field>,
of other calculated fields p.<field>, and of literals. Times go in and come out as ISO 8601 texts with
milliseconds, money as float. A calculated field reaches other fields as the function returned it, before
any rounding.
"""

from __future__ import annotations

import ast
import datetime as dt
from decimal import ROUND_HALF_UP, Decimal
from graphlib import CycleError, TopologicalSorter

import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.errors import ScriptError
from weftline.functions.parser import Call, Literal, Name, Unary, parse, references
from weftline.types import SPARK, check_type, utc

BUILTINS = {"str": str, "int": int, "float": float, "round": round, "len": len, "bool": bool, "abs": abs}


def defined(source: str) -> dict[str, tuple[int, int]]:
    """The functions of a source, with the least and most number of arguments."""
    out = {}
    for node in ast.parse(source).body:
        if isinstance(node, ast.FunctionDef):
            a = node.args
            most = len(a.posonlyargs) + len(a.args)
            out[node.name] = (most - len(a.defaults), 10**6 if a.vararg else most)
    return out


def checked(trees: dict, types: dict[str, str], functions: dict[str, tuple[int, int]]) -> list[str]:
    """The fields in an order in which each comes behind those it reads."""

    def look(tree) -> None:
        if isinstance(tree, Call):
            if tree.name in functions:
                least, most = functions[tree.name]
                if not least <= len(tree.args) <= most:
                    raise ScriptError(f"{tree.name} doesn't take {len(tree.args)} arguments")
            elif tree.name not in BUILTINS:
                raise ScriptError(f"unknown Python function {tree.name}")
            for a in tree.args:
                look(a)
        elif isinstance(tree, Unary) and tree.op == "-":
            look(tree.arg)
        elif isinstance(tree, Name):
            known = {"r": types, "p": trees}.get(tree.alias, {})
            if tree.field not in known and str(tree) not in ("true", "false"):
                raise ScriptError(f"{tree} is unknown in a Python expression")
        elif not isinstance(tree, Literal):
            raise ScriptError("Python expressions are calls, fields and literals only")

    for tree in trees.values():
        look(tree)
    try:
        return list(TopologicalSorter({f: [n.field for n in references(t) if n.alias == "p"] for f, t in trees.items()}).static_order())
    except CycleError as e:
        raise ScriptError(f"calculated fields need each other: {' -> '.join(e.args[1])}") from e


def into_python(value, kind: str):
    if kind == "decimal2":
        return float(value)
    if kind == "datetime":
        return f"{value.isoformat(timespec='milliseconds')}+00:00"
    return value


def out_of_python(value, kind: str):
    if kind == "int":
        return int(value)
    if kind == "float":
        return float(value)
    if kind == "bool":
        return bool(value)
    if kind == "decimal2":
        return Decimal(str(value)).quantize(Decimal("0.01"), ROUND_HALF_UP)
    if kind == "datetime":
        return utc(value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(value))
    return str(value)


def _compiled(tree, names: dict):
    """The tree as a function of (r, p)."""
    if isinstance(tree, Literal):
        value = float(tree.value) if isinstance(tree.value, Decimal) else tree.value
        return lambda r, p: value
    if isinstance(tree, Unary):
        arg = _compiled(tree.arg, names)
        return lambda r, p: -arg(r, p)
    if isinstance(tree, Name):
        field = tree.field
        if not tree.alias:
            return lambda r, p: field == "true"
        return (lambda r, p: r[field]) if tree.alias == "r" else (lambda r, p: p[field])
    function, args = names[tree.name], [_compiled(a, names) for a in tree.args]
    return lambda r, p: function(*(a(r, p) for a in args))


def calculated(df: DataFrame, types: dict[str, str], sources: list[str], columns: dict[str, tuple[str, str]]) -> DataFrame:
    """df with a column p__<field> for each of columns: field -> (expression, type)."""
    source = "\n".join(sources)
    trees = {f: parse(text) for f, (text, _) in columns.items()}
    kinds = {f: check_type(kind) for f, (_, kind) in columns.items()}
    order = checked(trees, types, defined(source))
    read = sorted({n.field for t in trees.values() for n in references(t) if n.alias == "r"})
    arrow = {"string": pa.string(), "int": pa.int64(), "float": pa.float64(), "bool": pa.bool_(), "decimal2": pa.decimal128(18, 2), "datetime": pa.timestamp("us")}
    out_types = {f: arrow[k] for f, k in kinds.items()}

    def run(batches):
        names = dict(BUILTINS)
        exec(compile(source, "<py_calc>", "exec"), names)
        steps = [(f, _compiled(trees[f], names)) for f in order]
        for batch in batches:
            values = {c: [into_python(v, types[c]) for v in batch.column(batch.schema.get_field_index(c)).to_pylist()] for c in read}
            made = {f: [] for f in kinds}
            for i in range(batch.num_rows):
                r, p = {c: v[i] for c, v in values.items()}, {}
                for f, step in steps:
                    p[f] = step(r, p)
                for f, kind in kinds.items():
                    made[f].append(out_of_python(p[f], kind))
            arrays = [pa.array(made[f], out_types[f]) for f in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *(f"p__{f}" for f in kinds)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`p__{f}` {SPARK[k]}" for f, k in kinds.items())])
    return df.mapInArrow(run, schema)
