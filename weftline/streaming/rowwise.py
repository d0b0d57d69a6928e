"""Row-wise nodes over streams.

The nodes that look at one row at a time (table_table and tagging) hold for a streaming DataFrame as they
do for a table: files that come later give rows that are appended. Nodes that look at several rows run in
batches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.errors import ScriptError
from weftline.plans.planner import Planner
from weftline.plans.script import Script

ROWWISE = ("table_table", "table_custom_tfm_table")


def stream_table(spark: SparkSession, script: Script, source: str, stream: DataFrame, table: str) -> DataFrame:
    """Table `table` of the script as a stream, with `stream` for the rows of table `source`."""
    name = table
    while name != source:
        node = script.writer_of(name)
        if node.kind not in ROWWISE:
            raise ScriptError(f"node {node.name} ({node.kind}) isn't row-wise")
        name = node.table
    return Planner(spark, script, {source: stream}).table(table)
