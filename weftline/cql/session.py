"""Runs statements of the query dialect.

A table is a DataFrame with its key. Definitions and changes replace the DataFrame; inserted rows are kept on
the driver, beside it, as one relation. After MANY changes or inserted rows a table is written out, if there is
a folder that executors share, so that plans stay small. Comparisons with null are two-valued: null equals null and
nothing else, and is neither less nor greater than anything. DISTINCT and LIMIT take effect, and DELETE
removes the rows that its condition names.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.cql import parser as q
from weftline.cql import token
from weftline.cql.pages import Pages
from weftline.errors import ScriptError

# Column types, and how Spark holds them.
TYPES = {
    "ascii": "string", "text": "string", "varchar": "string", "uuid": "string", "timeuuid": "string", "bigint": "bigint", "int": "int", "smallint": "smallint", "tinyint": "tinyint",
    "counter": "bigint", "time": "bigint", "varint": "decimal(38,0)", "decimal": "decimal(38,18)", "double": "double", "float": "float", "boolean": "boolean", "blob": "binary", "date": "date", "timestamp": "timestamp_ntz",
}
AGGREGATES = {"count", "sum", "avg", "min", "max", "count_if", "sum_if", "avg_if", "min_if", "max_if", "string_agg", "string_agg_if"}
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Changes, and inserted rows, after which a table is written out.
MANY_CHANGES, MANY_ROWS = 20, 10_000
#: Selects of which the rows are kept between their pages.
MANY_PAGES = 8
#: Functions whose value is one for a statement.
TIMES = ("current_timestamp", "current_date", "current_time", "now")


@dataclass
class Table:
    columns: dict[str, str]
    partition: list[str]
    clustering: list[str]
    descending: dict[str, bool]
    base: DataFrame
    rows: list[tuple] = field(default_factory=list)  # inserted since base
    keys: set[tuple] | None = None  # of all rows, where the driver knows them
    changes: int = 0
    whole: DataFrame | None = None  # base and rows, once they have been asked for

    @property
    def key(self) -> list[str]:
        return self.partition + self.clustering

    def schema(self) -> str:
        return ", ".join(f"`{c}` {TYPES[k]}" for c, k in self.columns.items())


class Session:
    def __init__(self, spark: SparkSession, keyspace: str = "default") -> None:
        self.spark, self.keyspace = spark, keyspace
        self.keyspaces: dict[str, dict[str, Table]] = {keyspace: {}}
        self.paged: list[tuple[str, Table, DataFrame, int, Pages]] = []  # select, its table as it was

    def execute(self, text: str, *params) -> DataFrame | None:
        """Runs the statements; gives the last one's rows (of a select, or of a condition's outcome)."""
        out = None
        for s in q.parse(text, *params):
            out = getattr(self, f"_{s.kind}")(s)
        return out

    def register(self, name: str, df: DataFrame, key: list[str], types: dict[str, str] | None = None) -> None:
        """Makes a DataFrame a table."""
        back = {"string": "text", "bigint": "bigint", "int": "int", "smallint": "smallint", "tinyint": "tinyint", "double": "double", "float": "float", "boolean": "boolean", "date": "date", "binary": "blob"}
        kinds = {c: (types or {}).get(c) or back.get(k) or ("decimal" if k.startswith("decimal") else "timestamp") for c, k in df.dtypes}
        data = df.select(*(F.col(f"`{c}`").cast(TYPES[k]).alias(c) for c, k in kinds.items()))
        self.keyspaces[self.keyspace][name] = Table(kinds, key, [], {}, data)

    def pages(self, text: str, *params, size: int, state: int = 0) -> tuple[list[Row], int | None]:
        """At most `size` rows of a select behind the first `state` ones, and the state for the next page (None behind the last).

        The select runs for its first page and when its table has changed since; of other selects, the last MANY_PAGES are kept.
        """
        *before, s = q.parse(text, *params)
        for other in before:
            getattr(self, f"_{other.kind}")(other)
        if s.kind != "select":  # a condition's outcome, which is one row
            made = getattr(self, f"_{s.kind}")(s)
            return (made.collect() if made is not None else [])[state : state + size], None
        t, said = self._table(s), repr(s)
        kept = next((k for k in self.paged if k[0] == said and k[1] is t and k[2] is t.base and k[3] == len(t.rows)), None)
        if kept is None:
            kept = (said, t, t.base, len(t.rows), Pages(self._select(s)))
        self.paged = [*(k for k in self.paged if k is not kept), kept]
        page, end = kept[-1].page(state, size), state + size >= kept[-1].count
        for old in [kept] if end else self.paged[:-MANY_PAGES]:
            old[-1].drop()
        self.paged = [k for k in self.paged[-MANY_PAGES:] if k is not kept or not end]
        return page, None if end else state + size

    # names

    def _space(self, name: str | None) -> dict[str, Table]:
        name = name or self.keyspace
        if name not in self.keyspaces:
            raise ScriptError(f"no keyspace {name}")
        return self.keyspaces[name]

    def _table(self, s: q.Statement) -> Table:
        found = self._space(s.keyspace).get(s.table)
        if found is None:
            raise ScriptError(f"no table {s.table}")
        return found

    def _data(self, t: Table) -> DataFrame:
        if t.whole is None:
            t.whole = t.base.union(self.spark.createDataFrame(t.rows, t.schema())) if t.rows else t.base
        return t.whole

    def _changed(self, t: Table, data: DataFrame, keys: set[tuple] | None) -> None:
        """data takes the place of a table's rows."""
        t.base, t.rows, t.keys, t.whole, t.changes = data, [], keys, None, t.changes + 1
        self._written(t)

    def _written(self, t: Table) -> None:
        folder = self.spark.conf.get("spark.checkpoint.dir", None)
        if folder and (t.changes >= MANY_CHANGES or len(t.rows) >= MANY_ROWS):
            path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
            self._data(t).write.parquet(path)
            t.base, t.rows, t.whole, t.changes = self.spark.read.schema(t.schema()).parquet(path), [], None, 0

    # definitions

    def _create_keyspace(self, s: q.Statement) -> None:
        if s.keyspace in self.keyspaces and not s.if_not_exists:
            raise ScriptError(f"there is a keyspace {s.keyspace}")
        self.keyspaces.setdefault(s.keyspace, {})

    def _use(self, s: q.Statement) -> None:
        self._space(s.keyspace)
        self.keyspace = s.keyspace

    def _drop_keyspace(self, s: q.Statement) -> None:
        if s.keyspace not in self.keyspaces and not s.if_exists:
            raise ScriptError(f"no keyspace {s.keyspace}")
        self.keyspaces.pop(s.keyspace, None)

    def _create_table(self, s: q.Statement) -> None:
        space = self._space(s.keyspace)
        if s.table in space:
            if s.if_not_exists:
                return
            raise ScriptError(f"there is a table {s.table}")
        if unknown := [k for k in s.columns.values() if k not in TYPES]:
            raise ScriptError(f"unknown types {', '.join(unknown)}")
        order = [*s.partition, *s.clustering]
        columns = {c: s.columns[c] for c in [*order, *(c for c in s.columns if c not in order)]}
        t = Table(columns, s.partition, s.clustering, s.descending, None)
        t.base, t.keys = self.spark.createDataFrame([], t.schema()), set()
        space[s.table] = t

    def _drop_table(self, s: q.Statement) -> None:
        space = self._space(s.keyspace)
        if s.table not in space and not s.if_exists:
            raise ScriptError(f"no table {s.table}")
        space.pop(s.table, None)

    def _truncate(self, s: q.Statement) -> None:
        t = self._table(s)
        t.base, t.rows, t.keys, t.changes, t.whole = self.spark.createDataFrame([], t.schema()), [], set(), 0, None

    # changes

    def _applied(self, done: bool, rows: DataFrame | None = None) -> DataFrame:
        if rows is None:
            return self.spark.createDataFrame([(done,)], "`[applied]` boolean")
        return rows.select(F.lit(done).alias("[applied]"), "*")

    def _insert(self, s: q.Statement) -> DataFrame | None:
        t = self._table(s)
        if missing := [c for c in t.key if c not in s.values]:
            raise ScriptError(f"no values for the key columns {', '.join(missing)}")
        row = tuple(self._stored(s.values.get(c), k) for c, k in t.columns.items())
        made = dict(zip(t.columns, row, strict=True))
        key = tuple(made[c] for c in t.key)
        same = _all([F.col(f"`{c}`").eqNullSafe(F.lit(v)) for c, v in zip(t.key, key, strict=True)])
        old = key in t.keys if t.keys is not None else bool(self._data(t).where(same).take(1))
        if old and not s.if_not_exists:
            raise ScriptError(f"there is a row with the key {key}")
        if not old:
            t.rows.append(row)
            t.whole = None
            if t.keys is not None:
                t.keys.add(key)
            self._written(t)
        return self._applied(not old, self._data(t).where(same).limit(1) if old else None) if s.if_not_exists else None

    def _stored(self, tree, kind: str):
        """The Python value of a constant, in the column's type."""
        if tree is None:
            return 0 if kind == "counter" else None
        if not isinstance(tree, q.Value):
            made = self.spark.range(1).select(Compiler({}).column(tree)).first()[0]
            tree = q.Value(made)
        return _converted(tree.value, kind)

    def _update(self, s: q.Statement) -> DataFrame | None:
        t = self._table(s)
        data, compiler = self._data(t), Compiler(t.columns)
        where = compiler.truth(s.where)
        there = data.where(compiler.condition(s.where))
        old = there.take(1)
        values = {c: self._frozen(e) for c, e in s.values.items()}
        if s.if_exists or s.condition is not None:
            fits = bool(old) and (s.condition is None or bool(there.where(compiler.truth(s.condition)).take(1)))
            if not fits:
                return self._applied(False, there.limit(1) if old else None)
        if old:
            change = where if s.condition is None else where & compiler.truth(s.condition)
            changed = {c: compiler.column(e).cast(TYPES[t.columns[c]]) for c, e in values.items()}
            made = data.select(*(F.when(change, changed[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in changed else F.col(f"`{c}`") for c in t.columns))
            self._changed(t, made, t.keys if not set(changed) & set(t.key) else None)
        else:
            fixed = {c: v for c, v in _equalities(s.where)}
            if missing := [c for c in t.key if c not in fixed]:
                raise ScriptError(f"no values for the key columns {', '.join(missing)}")
            start = {c: Decimal(0) if k == "varint" else 0 if k == "counter" else None for c, k in t.columns.items()}
            row = self.spark.createDataFrame([tuple(_converted(fixed.get(c, q.Value(start[c])).value, k) for c, k in t.columns.items())], t.schema())
            made = row.select(*(Compiler(t.columns).column(values[c]).cast(TYPES[k]).alias(c) if c in values else F.col(f"`{c}`") for c, k in t.columns.items()))
            key = tuple(_converted(fixed[c].value, t.columns[c]) for c in t.key)
            self._changed(t, data.union(made), None if t.keys is None or set(values) & set(t.key) else t.keys | {key})
        return self._applied(True) if s.if_exists or s.condition is not None else None

    def _frozen(self, tree):
        """The expression with what the time functions in it say now; a stored value doesn't change with later reads."""
        if isinstance(tree, q.Function) and (tree.name in TIMES or tree.name == "totimestamp") and not _reads_columns(tree):
            return q.Value(self.spark.range(1).select(Compiler({}).column(tree)).first()[0])
        if isinstance(tree, (q.Function, q.Operation)):
            return replace(tree, args=tuple(map(self._frozen, tree.args)))
        return replace(tree, arg=self._frozen(tree.arg)) if isinstance(tree, (q.Cast, q.In)) else tree

    def _delete(self, s: q.Statement) -> DataFrame | None:
        t = self._table(s)
        data, compiler = self._data(t), Compiler(t.columns)
        where = compiler.truth(s.where)
        if s.if_exists or s.condition is not None:
            there = data.where(where)
            if not there.take(1) or s.condition is not None and not there.where(compiler.truth(s.condition)).take(1):
                return self._applied(False)
        if s.names:
            if keys := [c for c in s.names if c in t.key]:
                raise ScriptError(f"key columns can't be deleted: {', '.join(keys)}")
            self._changed(t, data.select(*(F.when(~where, F.col(f"`{c}`")).alias(c) if c in s.names else F.col(f"`{c}`") for c in t.columns)), t.keys)
        else:
            self._changed(t, data.where(~where), None)
        return self._applied(True) if s.if_exists or s.condition is not None else None

    # selects

    def _select(self, s: q.Statement) -> DataFrame:
        t = self._table(s)
        data, compiler = self._data(t), Compiler(t.columns)
        if s.where is not None:
            data = data.where(compiler.condition(s.where))
        out, names = [], []
        for tree, alias in s.expressions:
            if isinstance(tree, q.Star):
                out += [(q.Column(c), c) for c in t.columns]
            else:
                out.append((tree, alias or _title(tree)))
        names = [n for _, n in out]
        if any(_aggregates(e) for e, _ in out):
            made = self._aggregated(t, data, compiler, out)
        else:
            if unknown := [c for c, _ in s.order if c not in t.clustering + t.partition]:
                raise ScriptError(f"can't order by {', '.join(unknown)}: only key columns order rows")
            order = [F.col(f"`{c}`").desc() if d else F.col(f"`{c}`").asc() for c, d in s.order] or self._own_order(t, s.where)
            columns = [compiler.column(e).alias(n) for e, n in out]
            if s.distinct:
                made = data.select(*columns).distinct()
                order = [F.col(f"`{c}`").desc() if d else F.col(f"`{c}`") for c, d in s.order if c in names]
                made = made.orderBy(*order) if order else made
            else:
                made = data.orderBy(*order).select(*columns)
        return made.limit(s.limit) if s.limit is not None else made

    def _own_order(self, t: Table, where) -> list[Column]:
        """By key; by token of the partition key, if the condition speaks of tokens."""
        keys = [F.col(f"`{c}`").desc() if t.descending.get(c) else F.col(f"`{c}`").asc() for c in t.key]
        compiler = Compiler(t.columns)
        return [*(compiler.column(q.Function("token", (q.Column(c),))) for c in t.partition), *keys] if _mentions(where, "token") else keys

    def _aggregated(self, t: Table, data: DataFrame, compiler: Compiler, out: list) -> DataFrame:
        """One row; other expressions take the values of the first row."""
        sums = [(compiler.aggregate(e), n) for e, n in out if _aggregates(e)]
        made = data.agg(*(c.alias(n) for c, n in sums))
        others = [(e, n) for e, n in out if not _aggregates(e)]
        if others:
            first = data.orderBy(*self._own_order(t, None)).select(*(compiler.column(e).alias(n) for e, n in others)).limit(1)
            made = made.join(first, F.lit(True), "left")  # one row each
        return made.select(*(F.col(f"`{n}`") for _, n in out))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _title(tree) -> str:
    if isinstance(tree, q.Column):
        return tree.name
    if isinstance(tree, q.Function):
        return f"{tree.name}({', '.join('*' if isinstance(a, q.Star) else _title(a) for a in tree.args)})"
    if isinstance(tree, q.Cast):
        return f"cast({_title(tree.arg)} as {tree.kind})"
    if isinstance(tree, q.Operation):
        return f" {tree.op} ".join(_title(a) for a in tree.args)
    return str(getattr(tree, "value", "expression"))


def _children(tree) -> list:
    return list(tree.args) if isinstance(tree, (q.Function, q.Operation)) else [tree.arg, *getattr(tree, "values", ())] if isinstance(tree, (q.Cast, q.In)) else []


def _reads_columns(tree) -> bool:
    return isinstance(tree, q.Column) or any(map(_reads_columns, _children(tree)))


def _mentions(tree, name: str) -> bool:
    return tree is not None and (isinstance(tree, q.Function) and tree.name == name or any(_mentions(c, name) for c in _children(tree)))


def _aggregates(tree) -> bool:
    if isinstance(tree, q.Function) and tree.name in AGGREGATES:
        return True
    if any(_aggregates(c) for c in _children(tree)):
        raise ScriptError("an aggregate has to stand at the root of an expression")
    return False


def _equalities(tree):
    if isinstance(tree, q.Operation) and tree.op == "and":
        for a in tree.args:
            yield from _equalities(a)
    elif isinstance(tree, q.Operation) and tree.op == "=" and isinstance(tree.args[0], q.Column) and isinstance(tree.args[1], q.Value):
        yield tree.args[0].name, tree.args[1]


def _converted(value, kind: str):
    if value is None:
        return None
    if kind in ("decimal", "varint"):
        return Decimal(str(value))
    if kind in ("double", "float"):
        return float(value)
    if kind == "timestamp" and not isinstance(value, dt.datetime):
        return dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=value) if isinstance(value, int) else dt.datetime.fromisoformat(value).replace(tzinfo=None)
    if kind == "date" and not isinstance(value, dt.date):
        return dt.date(1970, 1, 1) + dt.timedelta(days=value) if isinstance(value, int) else dt.date.fromisoformat(value)
    if TYPES[kind] == "string" and not isinstance(value, str) or TYPES[kind] in ("bigint", "int", "smallint", "tinyint") and (isinstance(value, bool) or not isinstance(value, int)):
        raise ScriptError(f"{value!r} is no {kind}")
    return value


ORDERED = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


class Compiler:
    """Expressions over a table's columns."""

    def __init__(self, columns: dict[str, str]) -> None:
        self.columns = columns

    def truth(self, tree) -> Column:
        return F.coalesce(self.column(tree), F.lit(False))

    def condition(self, tree) -> Column:
        """What rows have to meet; null counts as false, so that comparisons stay as they are and can be pushed to the files."""
        if isinstance(tree, q.Operation) and tree.op in ("and", "or"):
            a, b = map(self.condition, tree.args)
            return a & b if tree.op == "and" else a | b
        if isinstance(tree, q.Operation) and tree.op in ORDERED:
            return ORDERED[tree.op](*map(self.column, tree.args))
        return self.column(tree)

    def kind(self, tree) -> str:
        """whole, decimal, real, text, or other: what decides how / works and what a cast takes."""
        if isinstance(tree, q.Value):
            v = tree.value
            return "other" if isinstance(v, bool) or v is None else "whole" if isinstance(v, int) else "real" if isinstance(v, float) else "decimal" if isinstance(v, Decimal) else "text" if isinstance(v, str) else "other"
        if isinstance(tree, (q.Column, q.Cast)):
            k = TYPES.get(self.columns.get(tree.name, "") if isinstance(tree, q.Column) else tree.kind, "")
            return "whole" if k.endswith("int") else "real" if k in ("double", "float") else "decimal" if k.startswith("decimal") else "text" if k == "string" else "boolean" if k == "boolean" else "other"
        if isinstance(tree, q.Operation) and tree.op in ("+", "-", "*", "/", "%", "neg"):
            kinds = [self.kind(a) for a in tree.args]
            return next((k for k in ("real", "decimal", "text") if k in kinds), "whole")
        if isinstance(tree, q.Function):
            return {"token": "whole", "exp": "real", "log": "real", "log10": "real", "now": "text"}.get(tree.name) or (self.kind(tree.args[0]) if tree.args else "whole")
        return "other"

    def column(self, tree) -> Column:
        if isinstance(tree, q.Value):
            return F.lit(tree.value)
        if isinstance(tree, q.Column):
            if tree.name not in self.columns:
                raise ScriptError(f"no column {tree.name}")
            return F.col(f"`{tree.name}`")
        if isinstance(tree, q.In):
            x = self.column(tree.arg)
            found = F.coalesce(x.isin([v.value for v in tree.values if v.value is not None]), F.lit(False)) if tree.values else F.lit(False)
            if any(v.value is None for v in tree.values):
                found = found | x.isNull()
            return ~found if tree.negated else found
        if isinstance(tree, q.Cast):
            return self.cast(tree)
        if isinstance(tree, q.Operation):
            return self.operation(tree)
        if isinstance(tree, q.Function):
            return self.function(tree)
        raise ScriptError("* can't stand in an expression")

    def operation(self, tree: q.Operation) -> Column:
        x = [self.column(a) for a in tree.args]
        if tree.op == "neg":
            return -x[0]
        a, b = x
        if tree.op in ("and", "or"):
            a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
            return a & b if tree.op == "and" else a | b
        if tree.op in ("=", "!="):
            return a.eqNullSafe(b) if tree.op == "=" else ~a.eqNullSafe(b)
        if tree.op in ("<", "<=", ">", ">="):
            return F.coalesce(ORDERED[tree.op](a, b), F.lit(False))
        kinds = {self.kind(t) for t in tree.args}
        if tree.op == "+" and kinds == {"text"}:
            return F.concat(a, b)
        if tree.op == "/" and kinds == {"whole"}:
            return F.call_function("div", a, b)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b}[tree.op]()

    def cast(self, tree: q.Cast) -> Column:
        if tree.kind not in TYPES:
            raise ScriptError(f"unknown type {tree.kind}")
        x, kind, target = self.column(tree.arg), self.kind(tree.arg), TYPES[tree.kind]
        if kind == "text" and target != "string":
            raise ScriptError(f"can't cast text to {tree.kind}")
        if kind == "boolean" and target == "string":
            return F.upper(x.cast("string"))
        return x.cast(target)

    def function(self, tree: q.Function) -> Column:
        name, args = tree.name, tree.args
        if name in AGGREGATES:
            raise ScriptError(f"{name} can't stand here")
        plain = {"abs": F.abs, "exp": F.exp, "log": F.ln, "log10": F.log10, "round": F.round}
        if name in plain and len(args) == 1:
            return self.column(args[0]) if name == "round" and self.kind(args[0]) == "whole" else plain[name](self.column(args[0]))
        now = F.current_timestamp()
        if name == "token" and len(args) == 1:
            x, kind = self.column(args[0]), self.kind(args[0])
            if kind in ("whole", "boolean"):
                return token.of_numbers(x.cast("int").cast("bigint") if kind == "boolean" else x.cast("bigint"))
            if kind in ("real", "decimal"):
                return token.of_reals(x.cast("double"))
            return token.of_texts(x.cast("string"))
        if name == "current_timestamp" and not args:
            return F.unix_millis(now)
        if name == "current_date" and not args:
            return F.unix_date(F.current_date()).cast("bigint")
        if name == "current_time" and not args:
            return (F.unix_micros(now) % 86_400_000_000) * 1000
        if name == "now" and not args:
            return F.expr("uuid()")
        if name == "totimestamp" and len(args) == 1:
            if isinstance(args[0], q.Function) and args[0].name == "now":
                return now.cast("timestamp_ntz")
            return F.timestamp_seconds(self.column(args[0]).cast("bigint") * 86_400).cast("timestamp_ntz")
        raise ScriptError(f"unknown function {name} of {len(args)} arguments")

    def aggregate(self, tree: q.Function) -> Column:
        name, args = tree.name, list(tree.args)
        base = name.removesuffix("_if")
        if base == "count" and name == "count":
            if not args or isinstance(args[0], q.Star):
                return F.count(F.lit(1))
            return F.count(self.column(args[0]))
        condition = self.truth(args.pop()) if name.endswith("_if") else None
        if name == "count_if":
            return F.count_if(condition)
        x, kind = self.column(args[0]), self.kind(args[0])
        value = x if condition is None else F.when(condition, x)
        if base == "string_agg":
            return F.array_join(F.array_sort(F.collect_list(value)), args[1].value)
        if base in ("sum", "avg") and kind not in ("whole", "real", "decimal"):
            raise ScriptError(f"{name} takes numbers")
        zero = F.lit("") if kind == "text" else F.lit(0)
        if base == "avg" and kind == "whole":
            total, n = F.sum(value.cast("decimal(38,0)")), F.count(value)
            some = F.when(n > 0, n).otherwise(F.lit(1)).cast("decimal(20,0)")
            return F.coalesce(F.call_function("div", total - F.pmod(total, some), some).cast("bigint"), F.lit(0).cast("bigint"))
        made = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[base](value)
        return F.coalesce(made, zero)
