"""Pages of a select.

The rows are sorted and written once, each with its task and its place in it; a count by task then says where a
page lies. Rows come to the driver in blocks of READ_AHEAD, each once, and pages are cut from the block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sources.uris import filesystem, scratch

#: Rows that come to the driver at once, or a page, if that is more.
READ_AHEAD = 4096


class Pages:
    """The rows as they were when they were first read."""

    def __init__(self, made: DataFrame) -> None:
        self.spark, self.folder, self.row = made.sparkSession, f"{scratch(made.sparkSession)}/pages", Row(*made.columns)
        # names may occur twice, or be none that files may have; a column of nulls has no type that files know
        named = made.toDF(*(f"c{k}" for k in range(len(made.columns))))
        cells = [F.col(f.name).cast("string") if isinstance(f.dataType, T.NullType) else F.col(f.name) for f in named.schema.fields]
        # number of the task, and of the row in it
        own = [F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")]
        placed = named.select(*cells, *own)
        placed.write.option("maxRecordsPerFile", 0).partitionBy("_part").parquet(self.folder)
        schema = T.StructType([f for f in placed.schema.fields if f.name != "_part"]).add("_part", T.IntegerType())
        self.rows = self.spark.read.schema(schema).parquet(self.folder)
        self.parts, self.count = [], 0  # task, its first place, the place behind it
        for part, n in sorted(map(tuple, self.rows.groupBy("_part").count().collect())):
            self.parts.append((part, self.count, self.count + n))
            self.count += n
        self.start, self.block = 0, []

    def page(self, first: int, size: int) -> list[Row]:
        """At most `size` rows from place `first` on."""
        last = max(first, min(first + size, self.count))
        if first < self.start or last > self.start + len(self.block):
            self.start, self.block = first, self._read(first, first + max(size, READ_AHEAD))
        return self.block[first - self.start : last - self.start]

    def _read(self, first: int, last: int) -> list[Row]:
        there = [(p, max(first, a) - a, min(last, b) - a) for p, a, b in self.parts if a < last and first < b]
        fits = F.lit(False)
        for part, a, b in there:
            fits = fits | (F.col("_part") == part) & (F.col("_row") >= a) & (F.col("_row") < b)
        found = self.rows.where(F.col("_part").isin([p for p, _, _ in there])).where(fits).collect()
        return [self.row(*r[:-2]) for r in sorted(found, key=lambda r: (r["_part"], r["_row"]))]

    def drop(self) -> None:
        fs, where = filesystem(self.spark, self.folder)
        fs.delete(where.getParent(), True)
