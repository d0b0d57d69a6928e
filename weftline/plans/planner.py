"""Builds lazy DataFrames for the nodes of a script.

Nodes are fused: a table that one node writes and another reads is a DataFrame in the other's plan, so
Catalyst prunes columns and pushes filters through it. Tables with several readers can be kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.errors import ScriptError
from weftline.functions.compile import Compiler, Typed, fields
from weftline.functions.parser import Binary, Name, parse, references
from weftline.operators.distinct import distinct
from weftline.operators.fields import keep, kinds, project
from weftline.operators.lookup import grouped, lookup
from weftline.operators.pycalc import calculated
from weftline.operators.tags import tagged
from weftline.operators.top import top
from weftline.plans.script import Node, Script, read_text
from weftline.sources import sink
from weftline.sources.scan import scan
from weftline.sources.uris import readable

#: (df, its types, the node's settings, spark) -> df with columns p__*, and their types.
Processor = Callable[[DataFrame, dict[str, str], dict, SparkSession], tuple[DataFrame, dict[str, str]]]


def file_text(spark: SparkSession, uri: str) -> str:
    rows = spark.read.text(readable(spark, uri), wholetext=True).collect()
    return rows[0][0] if rows else ""


def tag_processor(df: DataFrame, types: dict[str, str], settings: dict, spark: SparkSession):
    inline, url = settings.get("tag_criteria"), settings.get("tag_criteria_url")
    if bool(inline) == bool(url):
        raise ScriptError("tag criteria come from tag_criteria or from tag_criteria_url, one of both")
    tag = settings.get("tag_field_name")
    if not tag:
        raise ScriptError("tag_field_name is missing")
    return tagged(df, types, tag, inline or read_text(file_text(spark, url))), {tag: "string"}


def python_processor(df: DataFrame, types: dict[str, str], settings: dict, spark: SparkSession):
    sources = [*settings.get("python_code", []), *(file_text(spark, u) for u in settings.get("python_code_urls", []))]
    columns = {f: (c["expression"], c["type"]) for f, c in (settings.get("calculated_fields") or {}).items()}
    if not sources or not columns:
        raise ScriptError("py_calc needs Python code and calculated_fields")
    return calculated(df, types, sources, columns), {f: k for f, (_, k) in columns.items()}


PROCESSORS: dict[str, Processor] = {"tag_and_denormalize": tag_processor, "py_calc": python_processor}


FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "=="}


def bounds(n: Node) -> list:
    """What a file node's `having` demands of columns of the file as they are.

    The defaults that stand for nulls keep Catalyst from pushing `having` to the file; these bounds can be
    pushed. They are the comparisons with constants that all have to hold, of fields that copy a column.
    """
    copies = {f.name: f.tree.field for f in n.fields if isinstance(f.tree, Name) and f.tree.alias == "r" and f.kind != "decimal2"}
    out, todo = [], [parse(n.having)] if n.having else []
    while todo:
        tree = todo.pop()
        if not isinstance(tree, Binary):
            continue
        if tree.op == "&&":
            todo += [tree.left, tree.right]
        for field, constant, op in ((tree.left, tree.right, tree.op), (tree.right, tree.left, FLIPPED.get(tree.op))):
            if op in FLIPPED and isinstance(field, Name) and field.alias == "w" and field.field in copies and not any(x.alias == "w" for x in references(constant)):
                value = Compiler({})(constant)
                if value.kind == n.kinds()[field.field]:
                    out.append((copies[field.field], op, value.column))
    return out


class Planner:
    """tables: DataFrames that stand for tables whatever the script says (of earlier runs, or given)."""

    def __init__(self, spark: SparkSession, script: Script, tables: dict[str, DataFrame] | None = None, cache: bool = False) -> None:
        self.spark, self.script, self.tables, self.cache = spark, script, dict(tables or {}), cache
        self.readers = [i for n in script.nodes.values() for i in script.inputs(n)]

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            node = self.script.writer_of(name)
            df = self.build(node)
            self.tables[name] = df.persist() if self.cache and self.readers.count(node.name) > 1 else df
        return self.tables[name]

    def release(self) -> None:
        for df in self.tables.values():
            if df.is_cached:
                df.unpersist()

    def kinds_of(self, table: str) -> dict[str, str]:
        return self.script.writer_of(table).kinds()

    def build(self, node: Node) -> DataFrame:
        """The rows of the node's table, or of its file."""
        try:
            return getattr(self, f"_{node.kind}")(node)
        except ScriptError as e:
            raise ScriptError(f"node {node.name}: {e}") from e

    def _file_table(self, n: Node) -> DataFrame:
        return project(scan(self.spark, n.reader, bounds(n)), fields("r", n.reader.kinds()), list(n.fields), n.having)

    def _source(self, n: Node) -> tuple[DataFrame, dict[str, str]]:
        return self.table(n.table), self.kinds_of(n.table)

    def _table_table(self, n: Node) -> DataFrame:
        df, types = self._source(n)
        return project(df, fields("r", types), list(n.fields), n.having)

    def _distinct_table(self, n: Node) -> DataFrame:
        df, types = self._source(n)
        made = project(df, fields("r", types), list(n.fields))
        return distinct(made, n.kinds(), next(i for i in n.indexes.values() if i.unique), n.strict_keys)

    def _table_lookup_table(self, n: Node) -> DataFrame:
        if (keys := self._own_groups(n)) is not None:
            return grouped(self.table(self.script.index(n.lookup_index)[0].output), keys, list(n.fields), n.having)
        df, types = self._source(n)
        right = self.script.index(n.lookup_index)[0]
        return lookup(df, types, self.table(right.output), right.kinds(), self.script.lookup(n), list(n.fields), n.having)

    def _own_groups(self, n: Node) -> dict[str, Typed] | None:
        """If a grouped lookup goes from the distinct keys of a table back to that table: its keys, in r's names.

        Each key then has the rows it came from, and no others, so the join only repeats a grouping. Keys have
        to be plain copies of the index's fields.
        """
        source = self.script.writer_of(n.table)
        right, index = self.script.index(n.lookup_index)
        if not n.group or n.filter or n.strict_keys or source.kind != "distinct_table" or source.table != right.output or n.table in self.tables or source.strict_keys:
            return None
        copies = {f.name: f.tree.field for f in source.fields if isinstance(f.tree, Name) and f.tree.alias == "r"}
        unique = next(i for i in source.indexes.values() if i.unique)
        parts = [*unique.parts, *index.parts]
        plain = len(copies) == len(source.fields) and set(unique.fields) == set(copies) == set(n.lookup_on) and not any(p.ignore_case for p in parts)
        if not plain or any(copies[mine] != p.field for mine, p in zip(n.lookup_on, index.parts, strict=True)):
            return None
        kinds_of = right.kinds()
        return {name: Typed(F.col(f"`{field}`"), kinds_of[field]) for name, field in copies.items()}

    def _table_custom_tfm_table(self, n: Node) -> DataFrame:
        df, types = self._source(n)
        if n.processor not in PROCESSORS:
            raise ScriptError(f"unknown processor {n.processor!r}; there are {', '.join(PROCESSORS)}")
        used = {x.field for f in n.fields for x in references(f.tree) if x.alias == "p"}
        out, made = PROCESSORS[n.processor](df, types, n.settings, self.spark)
        if used - set(made):
            raise ScriptError(f"the processor makes no {', '.join(sorted(used - set(made)))}")
        compiler = Compiler(fields("r", types) | fields("p", made, "p__"), rounded=True)
        # what Python returned is stored by its type first
        return keep(out.select(*(f.checked(compiler(f.tree)).alias(f.name) for f in n.fields)), kinds(list(n.fields)), n.having)

    def _table_file(self, n: Node) -> DataFrame:
        df, types = self._source(n)
        return sink.rows(df, fields("r", types), n.writer)

    def ordered(self, n: Node) -> DataFrame:
        """A file's rows as they are written: sorted, and limited."""
        made, w = self.build(n), n.writer
        return top(made, w.order, kinds([c.field for c in w.columns]), w.limit) if w.order else made
