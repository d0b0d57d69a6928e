"""Compiles expressions to Spark columns, with static types.

There is no widening on assignment; operators promote int to decimal2 to float. Overflow of int is an
error (ANSI), as is a division by zero of int and decimal2; that of float gives infinity or NaN. With
`rounded`, each operation on decimal2 is rounded to two digits, half away from zero.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.errors import ScriptError
from weftline.functions import formats
from weftline.functions.parser import Binary, Call, Literal, Name, Unary, parse
from weftline.types import SPARK, whole_millis

NUMBERS = ["int", "decimal2", "float"]
WIDE = "decimal(38,18)"
#: Of operations within an expression; what a table holds is narrower.
WIDE_MONEY = "decimal(28,2)"
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


@dataclass(frozen=True)
class Zone:
    """A fixed zone; seconds east of UTC. It only occurs as an argument."""

    seconds: int


@dataclass(frozen=True)
class Typed:
    """A column with its script type; value: what it is if it is constant, else None."""

    column: Column
    kind: str
    value: object = None


Scope = dict[str, dict[str, Typed]]


def fields(alias: str, kinds: dict[str, str], prefix: str = "") -> Scope:
    """The scope of one alias whose fields are columns named prefix + field."""
    return {alias: {f: Typed(F.col(f"`{prefix}{f}`"), k) for f, k in kinds.items()}}


def constant(value, kind: str) -> Typed:
    if kind == "decimal2":
        return Typed(F.lit(value), kind, value)
    return Typed(F.lit(value).cast(SPARK[kind]), kind, value)


class Compiler:
    def __init__(self, scope: Scope, rounded: bool = False) -> None:
        self.scope, self.rounded = scope, rounded

    def __call__(self, tree) -> Typed:
        if isinstance(tree, str):
            tree = parse(tree)
        if isinstance(tree, Literal):
            return constant(tree.value, tree.kind)
        if isinstance(tree, Name):
            return self.name(tree)
        if isinstance(tree, Unary):
            return self.unary(tree.op, self(tree.arg))
        if isinstance(tree, Binary):
            return self.binary(tree.op, self(tree.left), self(tree.right))
        if isinstance(tree, Call):
            return self.call(tree)
        raise ScriptError(f"can't compile {tree!r}")

    def name(self, name: Name) -> Typed:
        if not name.alias and name.field in ("true", "false"):
            return constant(name.field == "true", "bool")
        if name.alias == "time" and name.field in MONTHS:
            return constant(MONTHS.index(name.field) + 1, "int")
        if str(name) == "time.UTC":
            return Typed(F.lit(0), "zone", Zone(0))
        try:
            return self.scope[name.alias][name.field]
        except KeyError:
            known = ", ".join(f"{a}.*" for a in self.scope)
            raise ScriptError(f"{name} is unknown here; there are {known or 'no fields'}") from None

    def unary(self, op: str, a: Typed) -> Typed:
        if op == "!":
            self.need(a, "bool", "!")
            return Typed(~a.column, "bool")
        if a.kind not in NUMBERS:
            raise ScriptError(f"- takes a number, not {a.kind}")
        if a.value is not None:
            return constant(-a.value, a.kind)
        return Typed(-a.column, a.kind)

    def binary(self, op: str, a: Typed, b: Typed) -> Typed:
        if op in ("&&", "||"):
            self.need(a, "bool", op)
            self.need(b, "bool", op)
            return Typed(a.column & b.column if op == "&&" else a.column | b.column, "bool")
        if op in ("==", "!=", "<", "<=", ">", ">="):
            return Typed(self.compared(op, a, b), "bool")
        if op == "+" and a.kind == b.kind == "string":
            return Typed(F.concat(a.column, b.column), "string")
        a, b, kind = self.promoted(a, b, op)
        return Typed(self.number(op, a, b, kind), kind)

    def compared(self, op: str, a: Typed, b: Typed) -> Column:
        if a.kind in NUMBERS and b.kind in NUMBERS:
            a, b, _ = self.promoted(a, b, op)
        elif a.kind != b.kind or a.kind not in ("string", "datetime", "bool"):
            raise ScriptError(f"can't compare {a.kind} with {b.kind}")
        elif a.kind == "bool" and op not in ("==", "!="):
            raise ScriptError(f"{op} doesn't take bool")
        x, y = a.column, b.column
        return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def promoted(self, a: Typed, b: Typed, op: str) -> tuple[Typed, Typed, str]:
        for x in (a, b):
            if x.kind not in NUMBERS:
                raise ScriptError(f"{op} takes numbers, not {x.kind}")
        kind = max(a.kind, b.kind, key=NUMBERS.index)
        return self.widened(a, kind), self.widened(b, kind), kind

    def widened(self, x: Typed, kind: str) -> Typed:
        if x.kind == kind:
            return x
        if kind == "float":
            return Typed(x.column.cast("double"), kind)
        return constant(Decimal(x.value), kind) if x.value is not None else Typed(x.column.cast("decimal(20,0)"), kind)

    def number(self, op: str, a: Typed, b: Typed, kind: str) -> Column:
        x, y = a.column, b.column
        if op == "%" and kind != "int":
            raise ScriptError("% takes int only")
        if kind == "int":
            return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "%": lambda: x % y, "/": lambda: F.call_function("div", x, y)}[op]()
        if kind == "float":
            if op == "/":
                none = F.when(x > 0, float("inf")).when(x < 0, float("-inf")).otherwise(float("nan"))
                return F.when(y == 0, none).otherwise(x / F.when(y == 0, F.lit(1.0)).otherwise(y))
            return {"+": x + y, "-": x - y, "*": x * y}[op]
        made = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y}[op]()
        return F.round(made, 2).cast(WIDE_MONEY) if self.rounded else made

    def need(self, x: Typed, kind: str, what: str) -> Typed:
        if x.kind != kind:
            raise ScriptError(f"{what} takes {kind}, not {x.kind}")
        return x

    def call(self, tree: Call) -> Typed:
        if tree.name not in FUNCTIONS:
            raise ScriptError(f"unknown function {tree.name}")
        counts, make = FUNCTIONS[tree.name]
        args = [self(a) for a in tree.args]
        if counts is not None and len(args) not in counts:
            raise ScriptError(f"{tree.name} takes {' or '.join(map(str, counts))} arguments, not {len(args)}")
        return make(self, tree.name, args)


def _iif(c: Compiler, name: str, args: list[Typed]) -> Typed:
    kind = {"time": "datetime"}.get(name.split(".")[0], name.split(".")[0])
    c.need(args[0], "bool", name)
    for x in args[1:]:
        c.need(x, kind, name)
    return Typed(F.when(args[0].column, args[1].column).otherwise(args[2].column), kind)


def _to_int(c: Compiler, name: str, args: list[Typed]) -> Typed:
    x = args[0]
    if x.kind == "string":
        fits = x.column.rlike("^[+-]?[0-9]+$")
        return Typed(F.when(fits, x.column.cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("no int: "), x.column)).cast("bigint")), "int")
    if x.kind in ("datetime", "zone"):
        raise ScriptError(f"int doesn't take {x.kind}")
    return Typed(x.column.cast("bigint"), "int")


def _to_float(c: Compiler, name: str, args: list[Typed]) -> Typed:
    x = args[0]
    if x.kind in ("datetime", "zone"):
        raise ScriptError(f"float doesn't take {x.kind}")
    return Typed(x.column.cast("int").cast("double") if x.kind == "bool" else x.column.cast("double"), "float")


def _to_decimal(c: Compiler, name: str, args: list[Typed]) -> Typed:
    x = args[0]
    if x.kind in ("datetime", "zone", "bool"):
        raise ScriptError(f"decimal2 doesn't take {x.kind}")
    if x.value is not None:
        return constant(Decimal(str(x.value)), "decimal2")
    if x.kind == "decimal2":
        return x
    return Typed(x.column.cast("decimal(20,0)" if x.kind == "int" else WIDE), "decimal2")


def _to_string(c: Compiler, name: str, args: list[Typed]) -> Typed:
    if args[0].kind == "zone":
        raise ScriptError("string doesn't take a zone")
    return Typed(formats.written(args[0].column, args[0].kind), "string")


def _math(c: Compiler, name: str, args: list[Typed]) -> Typed:
    if args[0].kind not in NUMBERS:
        raise ScriptError(f"{name} takes a number, not {args[0].kind}")
    x = args[0].column.cast("double")
    if name == "math.Sqrt":
        return Typed(F.sqrt(x), "float")
    return Typed(F.round(x), "float")


def _text(c: Compiler, args: list[Typed], name: str) -> list[Column]:
    return [c.need(x, "string", name).column for x in args]


def _literal_text(x: Typed, what: str) -> str:
    if x.kind != "string" or x.value is None:
        raise ScriptError(f"{what} has to be a string literal")
    return x.value


def _parse_time(c: Compiler, name: str, args: list[Typed]) -> Typed:
    layout = _literal_text(args[0], "the layout of time.Parse")
    return Typed(whole_millis(formats.parse_time(c.need(args[1], "string", name).column, layout)), "datetime")


def _format_time(c: Compiler, name: str, args: list[Typed]) -> Typed:
    return Typed(formats.format_time(c.need(args[0], "datetime", name).column, _literal_text(args[1], "the layout of time.Format")), "string")


def _zone(c: Compiler, name: str, args: list[Typed]) -> Typed:
    _literal_text(args[0], "the name of a zone")
    if not isinstance(args[1].value, int):
        raise ScriptError("the offset of a zone has to be an int literal (seconds)")
    return Typed(F.lit(args[1].value), "zone", Zone(args[1].value))


def _date(c: Compiler, name: str, args: list[Typed]) -> Typed:
    """Parts beyond their range go over into the next, and the zone's offset is taken off."""
    if args[7].kind != "zone":
        raise ScriptError("time.Date takes a zone last")
    year, month, day, hour, minute, second, nano = (c.need(x, "int", name).column for x in args[:7])
    months = year * 12 + month - 1
    first = F.make_date(F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1))
    days = F.date_add(first, (day - 1).cast("int")).cast("timestamp_ntz")
    seconds = hour * 3600 + minute * 60 + second - args[7].value.seconds
    return Typed(whole_millis(F.timestamp_add("MICROSECOND", seconds * 1_000_000 + F.call_function("div", nano, F.lit(1000)), days)), "datetime")


def _epoch_millis(t: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz"), t)


def _time_number(c: Compiler, name: str, args: list[Typed]) -> Typed:
    t = [c.need(x, "datetime", name).column for x in args]
    if name == "time.Unix":
        return Typed(F.floor(_epoch_millis(t[0]) / 1000).cast("bigint"), "int")
    if name == "time.UnixMilli":
        return Typed(_epoch_millis(t[0]), "int")
    if name == "time.DiffMilli":
        return Typed(F.timestamp_diff("MILLISECOND", t[1], t[0]), "int")
    return Typed(t[0] < t[1] if name == "time.Before" else t[0] > t[1], "bool")


def _replace(c: Compiler, name: str, args: list[Typed]) -> Typed:
    """An empty text to replace is found before and behind each character."""
    text, old, new = _text(c, args, name)
    between = F.concat(new, F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda x: F.concat(x, new)), ""))
    if args[1].value is not None:
        return Typed(F.replace(text, old, new) if args[1].value else between, "string")
    return Typed(F.when(old == "", between).otherwise(F.replace(text, old, new)), "string")


def _match(c: Compiler, name: str, args: list[Typed]) -> Typed:
    pattern = _literal_text(args[0], "the pattern of re.MatchString")
    return Typed(c.need(args[1], "string", name).column.rlike(pattern.replace("(?P<", "(?<")), "bool")


def _sprintf(c: Compiler, name: str, args: list[Typed]) -> Typed:
    if len(args) < 2:
        raise ScriptError("fmt.Sprintf takes a format and a value at least")
    return Typed(formats.sprintf(_literal_text(args[0], "the format of fmt.Sprintf"), [(x.column, x.kind) for x in args[1:]]), "string")


FUNCTIONS = {
    "math.Sqrt": ((1,), _math),
    "math.Round": ((1,), _math),
    "len": ((1,), lambda c, n, a: Typed(F.octet_length(*_text(c, a, n)).cast("bigint"), "int")),
    "string": ((1,), _to_string),
    "int": ((1,), _to_int),
    "float": ((1,), _to_float),
    "decimal2": ((1,), _to_decimal),
    **{f"{k}.iif": ((3,), _iif) for k in ("int", "float", "decimal2", "string", "time")},
    "time.Parse": ((2,), _parse_time),
    "time.Format": ((2,), _format_time),
    "time.Date": ((8,), _date),
    "time.Now": ((0,), lambda c, n, a: Typed(whole_millis(F.current_timestamp().cast("timestamp_ntz")), "datetime")),
    **{f"time.{k}": ((1,), _time_number) for k in ("Unix", "UnixMilli")},
    **{f"time.{k}": ((2,), _time_number) for k in ("DiffMilli", "Before", "After")},
    "time.FixedZone": ((2,), _zone),
    "re.MatchString": ((2,), _match),
    "strings.ReplaceAll": ((3,), _replace),
    "fmt.Sprintf": (None, _sprintf),
}
