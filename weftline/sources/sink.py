"""CSV and Parquet sinks: one file, one for each batch if the target's name has {batch_idx}, or a folder of parts.

Tasks sort and write parts of a file, and the driver's JVM puts their bytes together, in order; only a Parquet file
without an order is one task's work. `parts` leaves the parts as they are.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.errors import ScriptError
from weftline.functions.formats import column_text
from weftline.operators.fields import Field, kinds, project
from weftline.operators.top import MOST, order_columns
from weftline.sources.uris import SENDERS, filesystem, move, scheme
from weftline.types import zero

CODECS = ("gzip", "snappy", "uncompressed")
#: Bytes that are copied at a time.
BLOCK = 1 << 20


@dataclass(frozen=True)
class FileColumnOut:
    field: Field
    header: str = ""
    format: str | None = None
    parquet: str | None = None


@dataclass(frozen=True)
class FileWriter:
    url: str
    columns: tuple[FileColumnOut, ...]
    having: str | None = None
    order: str | None = None
    limit: int | None = None
    separator: str = ","
    codec: str = "gzip"
    parts: bool = False  # the target is a folder
    plain_quotes: bool = False  # header ends in CRLF, and only values with a comma are quoted, nothing doubled

    def __post_init__(self) -> None:
        if self.codec not in CODECS:
            raise ScriptError(f"unknown codec {self.codec!r}; expected one of {', '.join(CODECS)}")
        if self.limit is not None and not 0 < self.limit <= MOST:
            raise ScriptError(f"a limit is from 1 to {MOST}")

    @property
    def is_parquet(self) -> bool:
        return any(c.parquet is not None for c in self.columns)


def rows(df: DataFrame, scope, w: FileWriter) -> DataFrame:
    """The file's columns, filtered, in no order yet."""
    return project(df, scope, [c.field for c in w.columns], w.having)


def write(made: DataFrame, w: FileWriter, run_id: int, batches: int = 1) -> list[str]:
    """Writes rows(); gives the files' names."""
    types = kinds([c.field for c in w.columns])
    order = order_columns(w.order, types) if w.order else []
    template = w.url.replace("{run_id|string}", "{run_id}").replace("{batch_idx|string}", "{batch_idx}").replace("{run_id}", f"{run_id:05d}")
    if w.parts:
        return [_parts(_sorted(made, order, made.columns) if order and w.limit is None else made.orderBy(*order) if order else made, w, template)]
    by_batch = "{batch_idx}" in template
    batches = batches if by_batch else 1
    limited = not by_batch and bool(order) and w.limit is not None
    if limited:
        made = made.orderBy(*order).limit(w.limit)
    rows = made.withColumn("_batch", F.pmod(F.xxhash64(*made.columns), F.lit(batches)).cast("int") if by_batch else F.lit(0))
    if by_batch:
        rows = _sorted(rows, [F.col("_batch"), *order], made.columns)
    elif order:
        rows = rows.sortWithinPartitions(*order) if limited else _sorted(rows, order, made.columns)
    elif w.is_parquet:
        rows = rows.repartition(1)
    out = rows.select(*(_parquet_value(c).alias(c.parquet or c.field.name) for c in w.columns), "_batch") if w.is_parquet else rows.select(_line(w).alias("line"), "_batch")
    folder = f"{template.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    files = {b: template.replace("{batch_idx}", f"{b:05d}") for b in range(batches)}
    local = {b: f if scheme(f) not in SENDERS else f"{folder}-sent/{b}" for b, f in files.items()}
    _save(out if by_batch else out.drop("_batch"), w, folder, ["_batch"] if by_batch else [])
    spark = made.sparkSession
    fs, where = filesystem(spark, folder)
    for b, name in local.items():
        parts = _part_files(spark, f"{folder}/_batch={b}" if by_batch else folder)
        if not parts and w.is_parquet:  # a batch without rows is a file without rows
            empty = f"{folder}/empty-{b}"
            _save(spark.createDataFrame([], out.drop("_batch").schema), w, empty, [])
            parts = _part_files(spark, empty)
        move(spark, _joined(spark, parts, w, f"{folder}/whole-{b}"), name)
        if scheme(files[b]) in SENDERS:
            SENDERS[scheme(files[b])](name, files[b])
    fs.delete(where, True)
    return list(files.values())


def _sorted(rows: DataFrame, order: list[Column], cells: list[str]) -> DataFrame:
    """In this order, by ranges in parallel; a hash of the cells parts rows that are equal in it, so that they share no task (unless they are copies)."""
    return rows.orderBy(*order, F.xxhash64(*cells))


def _save(df: DataFrame, w: FileWriter, folder: str, by: list[str]) -> None:
    """maxRecordsPerFile, whatever the session says, is unlimited: a file is one part."""
    writer = df.write.option("maxRecordsPerFile", 0).option("compression", w.codec if w.is_parquet else "none").partitionBy(*by)
    writer.parquet(folder) if w.is_parquet else writer.text(folder)


def _part_files(spark, folder: str) -> list[str]:
    """In the order of the tasks that wrote them."""
    fs, pattern = filesystem(spark, f"{folder}/part-*")
    return sorted((s.getPath().toString() for s in (fs.globStatus(pattern) or [])), key=lambda f: int(re.search(r"/part-(\d+)[^/]*$", f)[1]))


def _joined(spark, parts: list[str], w: FileWriter, name: str) -> str:
    """One file of the parts: row groups of Parquet, or lines behind a header. Bytes are copied as they are, and each part is deleted then."""
    if w.is_parquet and len(parts) == 1:
        return parts[0]
    jvm, conf, (fs, where) = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), filesystem(spark, name)
    paths = [filesystem(spark, p)[1] for p in parts]
    if not w.is_parquet:
        out = fs.create(where)
        try:
            out.write(bytearray((w.separator.join(c.header or c.field.name for c in w.columns) + ("\r\n" if w.plain_quotes else "\n")).encode()))
            for p in paths:
                part = fs.open(p)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, BLOCK, False)
                finally:
                    part.close()
                fs.delete(p, False)
        finally:
            out.close()
        return name
    hadoop = jvm.org.apache.parquet.hadoop
    files = [hadoop.util.HadoopInputFile.fromPath(p, conf) for p in paths]
    first = hadoop.ParquetFileReader.open(files[0])
    about = first.getFileMetaData()
    first.close()
    out = hadoop.ParquetFileWriter(hadoop.util.HadoopOutputFile.fromPath(where, conf), about.getSchema(), hadoop.ParquetFileWriter.Mode.CREATE, 128 << 20, 0)
    try:
        out.start()
        for p, file in zip(paths, files, strict=True):
            out.appendFile(file)
            fs.delete(p, False)
        out.end(about.getKeyValueMetaData())
    finally:
        out.close()
    return name


def _parts(made: DataFrame, w: FileWriter, folder: str) -> str:
    """A folder of files, as many as tasks write; if there is an order, their names are in it. Each CSV file has the header."""
    if w.limit is not None:
        made = made.limit(w.limit)
    if w.is_parquet:
        made.select(*(_parquet_value(c).alias(c.parquet or c.field.name) for c in w.columns)).write.mode("overwrite").option("compression", w.codec).parquet(folder)
    else:
        cells = [column_text(F.col(f"`{c.field.name}`"), c.field.kind, c.format).alias(c.header or c.field.name) for c in w.columns]
        made.select(*cells).write.mode("overwrite").options(header="true", sep=w.separator, quote='"', escape='"', emptyValue="").csv(folder)
    return folder


def _parquet_value(c: FileColumnOut) -> Column:
    """The zero time is written as null."""
    value = F.col(f"`{c.field.name}`")
    if c.field.kind == "datetime":
        return F.when(value != zero("datetime"), value)
    return value


def _line(w: FileWriter) -> Column:
    cells = []
    for c in w.columns:
        text = column_text(F.col(f"`{c.field.name}`"), c.field.kind, c.format)
        if w.plain_quotes:
            cells.append(F.when(F.contains(text, F.lit(",")), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text))
        else:
            special = F.contains(text, F.lit(w.separator)) | text.rlike('["\\r\\n]')
            cells.append(F.when(special, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text))
    return F.concat_ws(w.separator, *cells)
