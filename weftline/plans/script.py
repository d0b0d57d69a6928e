"""A script: a DAG of nodes, from JSON or YAML."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from weftline.errors import ScriptError
from weftline.functions.aggregates import is_aggregate
from weftline.functions.parser import parse, references
from weftline.operators.fields import Field
from weftline.operators.keys import Index, parse_index
from weftline.operators.lookup import Lookup
from weftline.plans.params import substitute
from weftline.sources.scan import FileColumn, FileReader
from weftline.sources.sink import FileColumnOut, FileWriter

TYPES = ("file_table", "table_table", "table_lookup_table", "table_file", "distinct_table", "table_custom_tfm_table")
LONGEST_NAME = 42
BATCHES, ROWSET, LOOKUP_BATCH = (1, 1_000_000), (1, 100_000), (1, 20_000)
DEFAULT_POLICY = "current_active_first_stopped_nogo"


@dataclass(frozen=True)
class Node:
    name: str
    kind: str
    start_policy: str = "auto"
    rerun_policy: str = "rerun"
    description: str = ""
    reader: FileReader | None = None
    table: str | None = None  # that it reads
    batches: int = 1
    lookup_index: str | None = None
    lookup_on: tuple[str, ...] = ()
    lookup_type: str = "inner"
    group: bool = False
    filter: str | None = None
    output: str | None = None  # the table that it writes
    fields: tuple[Field, ...] = ()
    having: str | None = None
    indexes: dict[str, Index] = field(default_factory=dict)
    writer: FileWriter | None = None
    processor: str | None = None
    settings: dict = field(default_factory=dict)
    policy: str = DEFAULT_POLICY
    strict_keys: bool = False
    max_seconds: float | None = None  # that a batch may take
    table_options: str = ""  # what a table's definition says at its end

    def kinds(self) -> dict[str, str]:
        return {f.name: f.kind for f in self.fields}


@dataclass(frozen=True)
class Script:
    nodes: dict[str, Node]
    policies: dict[str, dict]

    def writer_of(self, table: str) -> Node:
        for n in self.nodes.values():
            if n.output == table:
                return n
        raise ScriptError(f"no node writes table {table}")

    def index(self, name: str) -> tuple[Node, Index]:
        for n in self.nodes.values():
            if name in n.indexes:
                return n, n.indexes[name]
        raise ScriptError(f"no index {name}")

    def inputs(self, node: Node) -> list[str]:
        """The nodes whose tables it reads: the reader's, then the lookup's."""
        out = [self.writer_of(node.table).name] if node.table else []
        return out + ([self.index(node.lookup_index)[0].name] if node.lookup_index else [])

    def order(self) -> list[str]:
        """Nodes behind those that they read."""
        try:
            return list(TopologicalSorter({n: self.inputs(x) for n, x in self.nodes.items()}).static_order())
        except CycleError as e:
            raise ScriptError(f"nodes read each other: {' -> '.join(e.args[1])}") from e

    def lookup(self, node: Node) -> Lookup:
        _, index = self.index(node.lookup_index)
        if len(node.lookup_on) != len(index.parts):
            raise ScriptError(f"node {node.name} joins on {len(node.lookup_on)} fields, index {node.lookup_index} has {len(index.parts)}")
        return Lookup(tuple(zip(node.lookup_on, index.parts, strict=True)), node.lookup_type, node.group, node.filter, node.strict_keys)


def read_text(text: str) -> dict:
    """JSON, or YAML."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        try:
            made = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ScriptError(f"neither JSON nor YAML: {e}") from e
    if not isinstance(made, dict):
        raise ScriptError("a script is a map")
    return made


def load(text: str, params: dict | str | None = None) -> Script:
    """A checked script. params: a map, or its JSON or YAML."""
    if isinstance(params, str):
        params = read_text(params)
    return build(read_text(substitute(text, params or {})))


def build(raw: dict) -> Script:
    nodes = {name: _node(name, n) for name, n in (raw.get("nodes") or {}).items()}
    if not nodes:
        raise ScriptError("a script needs nodes")
    script = Script(nodes, dict(raw.get("dependency_policies") or {}))
    _check_names(script)
    for n in nodes.values():
        script.inputs(n)
        if n.lookup_index:
            script.lookup(n)
        _check_aliases(n)
    script.order()
    _check_index_use(script)
    return script


def _number(section: dict, name: str, bounds: tuple[int, int], default: int) -> int:
    value = section.get(name, default)
    if isinstance(value, str) and value.isdigit():
        value = int(value)
    if not isinstance(value, int) or not bounds[0] <= value <= bounds[1]:
        raise ScriptError(f"{name} is from {bounds[0]} to {bounds[1]}, not {value!r}")
    return value


def _text(value) -> str | None:
    return None if value is None else str(value)


def _node(name: str, n: dict) -> Node:
    kind = n.get("type")
    if kind not in TYPES:
        raise ScriptError(f"node {name}: unknown type {kind!r}; expected one of {', '.join(TYPES)}")
    r, w, look = n.get("r") or {}, n.get("w") or {}, n.get("l") or {}
    try:
        for key, allowed in (("start_policy", ("auto", "manual")), ("rerun_policy", ("rerun", "fail"))):
            if n.get(key) and n[key] not in allowed:
                raise ScriptError(f"{key} is {' or '.join(allowed)}, not {n[key]!r}")
        made = {"start_policy": n.get("start_policy") or "auto", "rerun_policy": n.get("rerun_policy") or "rerun", "description": n.get("desc") or "", "policy": n.get("dependency_policy") or DEFAULT_POLICY, "strict_keys": bool(n.get("strict_keys")), "max_seconds": (n.get("max_batch_processing_time") or 0) / 1000 or None}
        if kind == "file_table":
            made["reader"] = _reader(r)
        else:
            if not r.get("table"):
                raise ScriptError("r.table is missing")
            made |= {"table": r["table"], "batches": _number(r, "expected_batches_total", BATCHES, 1)}
            _number(r, "rowset_size", ROWSET, 1000)
        if kind == "table_lookup_table":
            for key in ("idx_read_batch_size", "right_lookup_read_batch_size"):
                _number(look, key, LOOKUP_BATCH, 3000)
            on = tuple(x.strip().removeprefix("r.") for x in str(look.get("join_on") or "").split(",") if x.strip())
            if look.get("join_type") not in ("inner", "left"):
                raise ScriptError(f"l.join_type is inner or left, not {look.get('join_type')!r}")
            made |= {"lookup_index": look.get("index_name"), "lookup_on": on, "lookup_type": look["join_type"], "group": bool(look.get("group")), "filter": look.get("filter") or None}
        if kind == "table_custom_tfm_table":
            made |= {"processor": n.get("custom_proc_type"), "settings": n.get("p") or {}}
        if kind == "table_file":
            made["writer"] = _writer(w)
        else:
            made |= _table(w)
        if kind == "distinct_table":
            if sum(i.unique for i in made["indexes"].values()) != 1:
                raise ScriptError("a distinct table has exactly one unique index")
            if n.get("rerun_policy") != "fail":
                raise ScriptError("a distinct table's rerun_policy is fail")
            if made["having"]:
                raise ScriptError("a distinct table has no having")
        return Node(name, kind, **made)
    except ScriptError as e:
        raise ScriptError(f"node {name}: {e}") from e


def _reader(r: dict) -> FileReader:
    if not r.get("urls"):
        raise ScriptError("r.urls is missing")
    settings = r.get("csv") or {}
    columns = []
    for name, c in (r.get("columns") or {}).items():
        own = c.get("csv") or {}
        parquet = (c.get("parquet") or {}).get("col_name")
        header, place = own.get("col_hdr"), own.get("col_idx")
        columns.append(FileColumn(name, c.get("col_type"), header or None, None if header else place, parquet, own.get("col_format"), _text(c.get("col_default_value"))))
    if not columns:
        raise ScriptError("r.columns is missing")
    if len({c.parquet is None for c in columns}) > 1:
        raise ScriptError("columns are either all of CSV or all of Parquet")
    header = settings.get("hdr_line_idx", -1)
    return FileReader(tuple(r["urls"]), tuple(columns), -1 if header is None else header, settings.get("first_data_line_idx") or 0, settings.get("separator") or ",", None if settings.get("multi_line") is None else bool(settings["multi_line"]))


def _table(w: dict) -> dict:
    fields = tuple(Field(n, f["expression"], f["type"], _text(f.get("default_value"))) for n, f in (w.get("fields") or {}).items())
    if not fields:
        raise ScriptError("w.fields is missing")
    indexes = {n: parse_index(x) for n, x in (w.get("indexes") or {}).items()}
    known = {f.name for f in fields}
    for n, index in indexes.items():
        if missing := [f for f in index.fields if f not in known]:
            raise ScriptError(f"index {n} has unknown fields {', '.join(missing)}")
    return {"output": w.get("name"), "fields": fields, "having": w.get("having") or None, "indexes": indexes, "table_options": w.get("table_options") or ""}


def _writer(w: dict) -> FileWriter:
    columns = []
    for c in w.get("columns") or []:
        own = c.get("csv") or {}
        columns.append(FileColumnOut(Field(c["name"], c["expression"], c["type"]), own.get("header", c["name"]), own.get("format"), (c.get("parquet") or {}).get("column_name")))
    if not columns or not w.get("url_template"):
        raise ScriptError("w.columns and w.url_template are needed")
    top = w.get("top") or {}
    return FileWriter(w["url_template"], tuple(columns), w.get("having") or None, top.get("order"), top.get("limit"), (w.get("csv") or {}).get("separator") or ",", (w.get("parquet") or {}).get("codec") or "gzip", bool(w.get("parts")), bool((w.get("csv") or {}).get("plain_quotes")))


def _check_names(script: Script) -> None:
    tables: set[str] = set()
    indexes: set[str] = set()
    for n in script.nodes.values():
        if n.output is None and n.kind == "table_file":
            continue
        name = n.output or ""
        if not re.fullmatch(r"[A-Za-z]\w*", name) or len(name) > LONGEST_NAME or re.match(r"(?:idx|wf|system)", name):
            raise ScriptError(f"node {n.name}: {name!r} is no table name")
        if name in tables:
            raise ScriptError(f"two nodes write table {name}")
        tables.add(name)
        for i in n.indexes:
            if not re.fullmatch(r"idx\w*", i) or len(i) > LONGEST_NAME:
                raise ScriptError(f"node {n.name}: {i!r} is no index name")
            if i in indexes:
                raise ScriptError(f"there are two indexes {i}")
            indexes.add(i)


def _check_aliases(n: Node) -> None:
    """Which of r, l, p, w an expression may read."""
    allowed = {"file_table": {"r"}, "table_lookup_table": {"r", "l"}, "table_custom_tfm_table": {"r", "p"}}.get(n.kind, {"r"})
    columns = n.fields or tuple(c.field for c in n.writer.columns)
    known = {c.name for c in columns}
    for f in columns:
        for name in references(f.tree):
            if name.alias and name.alias not in allowed | {"time"}:
                raise ScriptError(f"node {n.name}: field {f.name} may not read {name}")
        if is_aggregate(f.tree) and not n.group:
            raise ScriptError(f"node {n.name}: field {f.name} aggregates outside a grouped lookup")
    having = n.having or (n.writer.having if n.writer else None)
    for name in references(parse(having)) if having else []:
        if name.alias == "w" and name.field not in known or name.alias not in ("w", "time", ""):
            raise ScriptError(f"node {n.name}: having may not read {name}")
    for name in references(parse(n.filter)) if n.filter else []:
        if name.alias not in ("l", "time", ""):
            raise ScriptError(f"node {n.name}: the filter may not read {name}")


def _check_index_use(script: Script) -> None:
    used = {n.lookup_index for n in script.nodes.values()}
    for n in script.nodes.values():
        for name, index in n.indexes.items():
            needed = n.kind == "distinct_table" and index.unique or "to_check_uniq" in name
            if name not in used and not needed:
                raise ScriptError(f"node {n.name}: no lookup uses index {name}")
