"""What the operators of this subpackage share: tables, shared storage, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Characters of text that are turned into Python objects at one time.
TEXT_BLOCK = 4_000_000
#: Folders of sessions on one machine that name none, by application.
_OWN: dict[str, str] = {}
#: Paths that save() has written, for each temporary_tables() that is open.
_OPEN: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where all of Spark is one process (as in tests) may the session name none; a temporary folder takes its place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("no folder that driver and executors share; set spark.checkpoint.dir")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
        folder = _OWN[app]
    return folder.rstrip("/")


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def save(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back, which cuts its lineage.

    The files outlive any executor, and go when the driver's JVM ends or with drop().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _path(spark, path)
    fs.deleteOnExit(where)
    for record in _OPEN:
        record.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what save() wrote, once nothing reads it any more."""
    fs, where = _path(df.sparkSession, df._weftline_path)
    fs.delete(where, True)


@contextmanager
def temporary_tables(spark: SparkSession, keep: list[DataFrame]):
    """Deletes at its end what save() has written since, but for the frames in `keep`."""
    record: list[str] = []
    _OPEN.append(record)
    try:
        yield
    finally:
        _OPEN[:] = [r for r in _OPEN if r is not record]  # lists of nested ones may be equal
        for path in set(record) - {df._weftline_path for df in keep}:
            fs, where = _path(spark, path)
            fs.delete(where, True)


def text_blocks(batch: pa.RecordBatch, name: str = "text", block: int = TEXT_BLOCK) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a batch, in blocks of bounded size; a null text is an empty one.

    A block is at least one row: one text is never cut.
    """
    column = batch.column(batch.schema.get_field_index(name))
    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    first, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > block:
            yield first, [t or "" for t in column.slice(first, i - first).to_pylist()]
            first, size = i, 0
        size += n
    if first < len(lengths):
        yield first, [t or "" for t in column.slice(first).to_pylist()]


def map_rows(df: DataFrame, schema: str, per_text: Callable[[str], tuple], keys: list[str], names: list[str]) -> DataFrame:
    """keys of each row, followed by the columns `names` that per_text makes of its text."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for first, texts in text_blocks(batch):
                made = list(zip(*map(per_text, texts), strict=True))
                columns = [batch.column(batch.schema.get_field_index(k)).slice(first, len(texts)) for k in keys]
                columns += [pa.array(v, arrow.field(n).type) for n, v in zip(names, made, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([arrow.field(n) for n in [*keys, *names]]))

    return df.mapInArrow(run, schema)


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each low to before its high, and the places of these ranges, repeated with them."""
    size = np.maximum(high - low, 0)
    ends = np.cumsum(size)
    repeated = np.repeat(np.arange(len(size)), size)
    return np.arange(len(repeated)) - (ends - size)[repeated] + low[repeated], repeated
