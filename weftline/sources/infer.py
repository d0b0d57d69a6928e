"""Guesses a file's columns, and writes them as the reader of a script."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from weftline.sources.scan import PARQUET_KINDS, files_of, head_lines, split_line
from weftline.sources.uris import readable
from weftline.types import FALSE, TRUE

SAMPLE = 100
# Fractions of seconds and offsets that time texts may have, with their part of a layout.
FRACTIONS = [("", ""), (r"\.\d{3}", ".000"), (r"\.\d{6}", ".000000")]
OFFSETS = [("", ""), (r"[+-]\d{4}", "-0700"), (r"[+-]\d{2}:\d{2}", "-07:00")]
#: Time texts that are recognised, and their layouts.
LAYOUTS = [
    *((rf"\d{{4}}-\d{{2}}-\d{{2}}{t}\d{{2}}:\d{{2}}:\d{{2}}{f}{z}", f"2006-01-02{t}15:04:05{fraction}{zone}") for t in " T" for f, fraction in FRACTIONS for z, zone in OFFSETS),
    (r"\d{4}-\d{2}-\d{2}", "2006-01-02"),
    (r"\d{2}/\d{2}/\d{4}", "01/02/2006"),
]
ORDER = ["int", "decimal2", "float"]


def guess(value: str) -> tuple[str, str | None]:
    """(type, layout of a time)"""
    text = value.strip()
    if re.fullmatch(r"[+-]?\d{1,18}", text):
        return "int", None
    if re.fullmatch(r"[+-]?\d+\.\d{2}", text):
        return "decimal2", None
    if re.fullmatch(r"[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?", text):
        return "float", None
    if text in TRUE + FALSE:
        return "bool", None
    for pattern, layout in LAYOUTS:
        if re.fullmatch(pattern, text):
            return "datetime", layout
    return "string", None


def general(guesses: list[tuple[str, str | None]]) -> tuple[str, str | None]:
    """The narrowest type that all values have."""
    found = set(guesses)
    if len(found) == 1:
        return found.pop()
    if found and all(k in ORDER for k, _ in found):
        return max((k for k, _ in found), key=ORDER.index), None
    return "string", None


def csv_reader(spark: SparkSession, path: str, header_line: int = 0, first_line: int = 1, separator: str = ",") -> dict:
    """The `r` section of a script for a CSV file, from at most SAMPLE of its lines."""
    lines = head_lines(spark, files_of(spark, readable(spark, path))[0][0], first_line + SAMPLE)
    rows = [split_line(x, separator) for x in lines[first_line:]]
    width = max((len(r) for r in rows), default=0)
    names = split_line(lines[header_line], separator) if header_line >= 0 else [f"column_{i}" for i in range(width)]
    columns = {}
    for i, name in enumerate(names):
        kind, layout = general([guess(r[i]) for r in rows if i < len(r) and r[i].strip()] or [("string", None)])
        form = layout or {"int": "%d", "float": "%f", "decimal2": "%f"}.get(kind)
        place = {"col_hdr": name} if header_line >= 0 else {"col_idx": i}
        columns["col_" + re.sub(r"\W", "_", name).strip("_").lower()] = {"csv": place | ({"col_format": form} if form else {}), "col_type": kind}
    return {"urls": [path], "csv": {"hdr_line_idx": header_line, "first_data_line_idx": first_line, "separator": separator}, "columns": columns}


def parquet_reader(spark: SparkSession, path: str) -> dict:
    """The `r` section of a script for a Parquet file, from its schema."""
    columns = {}
    for f in spark.read.parquet(path).schema.fields:
        kind = PARQUET_KINDS.get(type(f.dataType))
        if kind:
            columns["col_" + re.sub(r"\W", "_", f.name).strip("_").lower()] = {"parquet": {"col_name": f.name}, "col_type": kind}
    return {"urls": [path], "columns": columns}


def table_writer(reader: dict, table: str) -> dict:
    """The `w` section that copies a reader's columns."""
    fields = {name.removeprefix("col_"): {"expression": f"r.{name}", "type": c["col_type"]} for name, c in reader["columns"].items()}
    return {"name": table, "fields": fields}
