"""CSV and Parquet scans to tables without nulls."""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import ScriptError
from weftline.functions.formats import parse_time
from weftline.sources.uris import filesystem, readable
from weftline.types import FALSE, MONEY, SPARK, TRUE, check_type, default_value, whole_millis


@dataclass(frozen=True)
class FileColumn:
    name: str
    kind: str
    header: str | None = None
    position: int | None = None
    parquet: str | None = None
    format: str | None = None
    default: str | None = None

    def __post_init__(self) -> None:
        check_type(self.kind)
        if self.parquet is None and (self.header is None) == (self.position is None):
            raise ScriptError(f"column {self.name} needs either a CSV header or a CSV position, or a Parquet name")
        if self.parquet is None and self.kind == "datetime" and not self.format:
            raise ScriptError(f"column {self.name} needs a time layout")
        if self.parquet is None and self.kind in ("string", "bool") and self.format:
            raise ScriptError(f"column {self.name} of type {self.kind} takes no format")


@dataclass(frozen=True)
class FileReader:
    urls: tuple[str, ...]
    columns: tuple[FileColumn, ...]
    header_line: int = -1
    first_line: int = 0
    separator: str = ","
    multi_line: bool | None = None  # whether quoted cells hold line feeds, which keeps a file in one task; None: large files tell by their quotes

    @property
    def is_parquet(self) -> bool:
        return any(c.parquet is not None for c in self.columns)

    def kinds(self) -> dict[str, str]:
        return {c.name: c.kind for c in self.columns}


#: (column of the reader, comparison, constant): what kept rows meet, as far as the file can tell.
Bound = tuple[str, str, Column]


def scan(spark: SparkSession, reader: FileReader, bounds: list[Bound] = ()) -> DataFrame:
    """All files, one after another, as one table. bounds may spare parts of Parquet files from being read."""
    paths = [readable(spark, u) for u in reader.urls]
    return _parquet(spark, reader, paths, bounds) if reader.is_parquet else _csv(spark, reader, paths)


#: Files up to this size (bytes) are read by one task without a look at their quotes.
SMALL = 64 << 20


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, size) of the files that a path, folder or pattern names."""
    fs, where = filesystem(spark, path)
    found = []
    for s in fs.globStatus(where) or []:
        inside = fs.listStatus(s.getPath()) if s.isDirectory() else [s]
        found += [(x.getPath().toString(), x.getLen()) for x in inside if not x.isDirectory() and x.getPath().getName()[0] not in "._"]
    if not found:
        raise ScriptError(f"there is no file {path}")
    return found


def head_lines(spark: SparkSession, path: str, number: int) -> list[str]:
    """The first lines of a file, which the driver reads by itself."""
    jvm = spark.sparkContext._jvm
    fs, where = filesystem(spark, path)
    stream = fs.open(where)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration()).getCodec(where)
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        out = []
        while len(out) < number and (line := lines.readLine()) is not None:
            out.append(line)
        return out
    finally:
        stream.close()


def split_line(line: str, separator: str) -> list[str]:
    return next(csv.reader(io.StringIO(line.lstrip("\ufeff").rstrip("\r")), delimiter=separator), [])


def places(reader: FileReader, path: str, lines: list[str]) -> tuple[int, ...]:
    """Where each column of the reader is in a file that begins with these lines."""
    header: list[str] = []
    if names := [c.header for c in reader.columns if c.header is not None]:
        if not 0 <= reader.header_line < len(lines):
            raise ScriptError(f"{path} has no header line {reader.header_line}")
        header = split_line(lines[reader.header_line], reader.separator)
        if missing := [n for n in names if n not in header]:
            raise ScriptError(f"{path} has no columns {', '.join(missing)}")
    return tuple(c.position if c.header is None else header.index(c.header) for c in reader.columns)


def _csv(spark: SparkSession, reader: FileReader, paths: list[str]) -> DataFrame:
    """Files with equal places of columns are one scan; each file's own header says where its columns are."""
    files = [f for p in paths for f in files_of(spark, p)]
    groups: dict[tuple, list[str]] = {}
    for path, _ in files:
        lines = head_lines(spark, path, max(reader.header_line, reader.first_line, 0) + 1)
        width = max([len(split_line(x, reader.separator)) for x in lines] + [1 + c.position for c in reader.columns if c.position is not None])
        head = sum(1 for x in lines[: reader.first_line] if x.strip("\r"))  # Spark passes over empty lines
        groups.setdefault((places(reader, path, lines), width, head if reader.first_line > 1 else 0), []).append(path)
    multi_line = _has_line_feeds(spark, [f for f, _ in files], sum(n for _, n in files)) if reader.multi_line is None else reader.multi_line
    out = None
    for (at, width, head), group in groups.items():
        raw = _read(spark, reader, group, width, head, multi_line)
        part = raw.select(*(parsed(_cell(i, width), c).alias(c.name) for i, c in zip(at, reader.columns, strict=True)))
        out = part if out is None else out.union(part)
    return out


def _has_line_feeds(spark: SparkSession, paths: list[str], size: int) -> bool:
    """Whether a quoted cell may hold a line feed: some line has an odd number of quotes. Of small files it is taken for granted."""
    if size <= SMALL:
        return True
    odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    return bool(spark.read.text(paths).where(odd).take(1))


def _read(spark: SparkSession, reader: FileReader, paths: list[str], width: int, head: int, multi_line: bool) -> DataFrame:
    """The cells as texts. head: rows before the data beyond a first line, which are the first ones of each file."""
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    options = {"sep": reader.separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "\0", "emptyValue": "", "multiLine": str(multi_line).lower(), "header": str(reader.first_line == 1).lower()}
    if multi_line:
        options["lineSep"] = "\n"  # else the first line's ending would be taken for all lines
    read = spark.read.options(**options).schema(schema)
    if not head:
        return read.csv(paths)
    out = None
    for p in paths:  # a file's tasks are in its order, so the first numbers are those of its first rows
        part = read.csv(p).withColumn("_row", F.monotonically_increasing_id()).where(F.col("_row") >= head).drop("_row")
        out = part if out is None else out.union(part)
    return out


def _cell(place: int, width: int) -> Column:
    """A cell's text; the last one of a line without the line's ending."""
    text = F.coalesce(F.col(f"_c{place}"), F.lit(""))
    return F.regexp_replace(text, "\r$", "") if place == width - 1 else text


def _scanned(text: Column, form: str | None) -> Column:
    """The number in a text that has the format's other characters around it."""
    if not form or form in ("%d", "%f"):
        return F.trim(text)
    m = re.fullmatch(r"(.*?)%[-+0 ]*\d*(?:\.\d+)?[df](.*)", form)
    if not m:
        raise ScriptError(f"{form!r} is no number format")
    return F.regexp_extract(F.trim(text), f"^{re.escape(m[1])}([-+]?[0-9.]+){re.escape(m[2])}$", 1)


def parsed(text: Column, c: FileColumn) -> Column:
    """A CSV cell as a value; blank ones take the default, wrong ones fail the job."""
    empty = default_value(c.default, c.kind)
    if c.kind == "string":
        return F.when(text == "", empty).otherwise(text)
    if c.kind == "bool":
        value = F.when(text.isin(TRUE), True).when(text.isin(FALSE), False).otherwise(F.raise_error(F.concat(F.lit(f"column {c.name}: no bool: "), text)).cast("boolean"))
    elif c.kind == "datetime":
        value = whole_millis(parse_time(text, c.format))
    elif c.kind == "int":
        digits = _scanned(text, c.format)
        value = F.when(digits.rlike("^[+-]?[0-9]+$"), digits.cast("bigint")).otherwise(F.raise_error(F.concat(F.lit(f"column {c.name}: no int: "), text)).cast("bigint"))
    elif c.kind == "decimal2":
        value = F.round(_scanned(text, c.format).cast("decimal(38,18)"), 2).cast(MONEY)
    else:
        value = _scanned(text, c.format).cast("double")
    return F.when(F.trim(text) == "", empty).otherwise(value)


# The script type of what a Parquet file holds.
PARQUET_KINDS = {T.StringType: "string", T.BooleanType: "bool", T.DoubleType: "float", T.FloatType: "float", T.DateType: "datetime", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.DecimalType: "decimal2"} | {t: "int" for t in (T.ByteType, T.ShortType, T.IntegerType, T.LongType)}


def _bounded(raw: DataFrame, reader: FileReader, types: dict, bounds: list[Bound]) -> DataFrame:
    """The rows that may meet the bounds. Nulls stay, as a default takes their place later; times are compared
    before they are cut to milliseconds, so theirs are bounds only from below and, a millisecond wider, from above."""
    names = {c.name: c for c in reader.columns}
    for name, op, constant in bounds:
        c = names[name]
        x = F.col(f"`{c.parquet}`")
        if c.kind == "datetime":
            if not isinstance(types[c.parquet], T.TimestampNTZType):
                continue
            if op in ("<", "<=", "=="):
                above = x < F.timestamp_add("MICROSECOND", F.lit(1000), constant).cast("timestamp_ntz")
                raw = raw.where(above | x.isNull())
            if op in (">", ">=", "=="):
                raw = raw.where((x >= constant) | x.isNull())
        else:
            raw = raw.where({"<": x < constant, "<=": x <= constant, ">": x > constant, ">=": x >= constant, "==": x == constant}[op] | x.isNull())
    return raw


def _parquet(spark: SparkSession, reader: FileReader, paths: list[str], bounds: list[Bound]) -> DataFrame:
    raw = spark.read.parquet(*paths)
    types, out = {f.name: f.dataType for f in raw.schema.fields}, []
    for c in reader.columns:
        if c.parquet not in types:
            raise ScriptError(f"{paths[0]} has no column {c.parquet!r}")
        actual = PARQUET_KINDS.get(type(types[c.parquet]))
        if actual != c.kind:
            raise ScriptError(f"column {c.parquet!r} is declared {c.kind}, the file has {types[c.parquet].simpleString()}")
        value = F.col(f"`{c.parquet}`")
        if c.kind == "decimal2":
            value = F.round(value, 2)
        value = whole_millis(value.cast("timestamp_ntz")) if c.kind == "datetime" else value.cast(SPARK[c.kind])
        out.append(F.coalesce(value, default_value(c.default, c.kind)).alias(c.name))
    return _bounded(raw, reader, types, bounds).select(*out)
