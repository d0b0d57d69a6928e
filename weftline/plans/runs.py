"""Numbered runs of a script, with history.

A keyspace is a folder; a table of a run is the folder <table>/run_id=<number>, written aside, checked and put
in place whole, so a repeated node replaces what it wrote; until then the former one stays. Histories are appended event tables. A node reads
the table of the run that its dependency policy chooses.
"""

from __future__ import annotations

import datetime as dt
import json
import threading
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.errors import ScriptError
from weftline.operators.distinct import assert_unique
from weftline.plans import policies
from weftline.plans.planner import Planner
from weftline.plans.policies import COMPLETE, FAIL, START, STATUS_NAMES, STOP, SUCCESS
from weftline.plans.script import Script
from weftline.sources import sink
from weftline.sources.uris import filesystem
from weftline.types import SPARK

HISTORY = {
    "wf_run_history": "ts timestamp_ntz, run_id bigint, status int, comment string",
    "wf_node_history": "ts timestamp_ntz, run_id bigint, script_node string, status int, comment string",
    "wf_batch_history": "ts timestamp_ntz, run_id bigint, script_node string, batch_idx int, batches_total int, status int, comment string",
    "wf_run_properties": "run_id bigint, start_nodes string, affected_nodes string, script string, params string, run_description string",
}


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


@dataclass
class Engine:
    """Runs scripts in the keyspaces below a folder that driver and executors share."""

    spark: SparkSession
    root: str
    unique_checks: bool = True
    wait_seconds: float = 60.0  # how long a node waits for tables that other engines are still making
    poll_seconds: float = 1.0

    # folders and histories

    def _folder(self, keyspace: str, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), keyspace, *parts])

    def _exists(self, path: str) -> bool:
        fs, where = filesystem(self.spark, path)
        return fs.exists(where)

    def _append(self, keyspace: str, name: str, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, HISTORY[name]).coalesce(1).write.mode("append").parquet(self._folder(keyspace, name))

    def history(self, keyspace: str, name: str) -> DataFrame:
        """The events of one of HISTORY."""
        path = self._folder(keyspace, name)
        return self.spark.read.schema(HISTORY[name]).parquet(path) if self._exists(path) else self.spark.createDataFrame([], HISTORY[name])

    def keyspaces(self) -> list[str]:
        fs, where = filesystem(self.spark, self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()) if fs.exists(where) else []

    def drop_keyspace(self, keyspace: str) -> None:
        fs, where = filesystem(self.spark, self._folder(keyspace))
        fs.delete(where, True)

    def _new_run(self, keyspace: str) -> int:
        """The next free number. Creating the folder of a number is what takes it."""
        fs, _ = filesystem(self.spark, self._folder(keyspace, "wf_run_counter"))
        n = 1
        while True:
            where = filesystem(self.spark, self._folder(keyspace, "wf_run_counter", f"{n:05d}"))[1]
            if not fs.exists(where) and fs.createNewFile(where):
                return n
            n += 1

    # tables

    def table(self, keyspace: str, name: str, run_id: int) -> DataFrame:
        path = self._folder(keyspace, name, f"run_id={run_id:05d}")
        return self.spark.read.parquet(path if self._exists(path) else f"{path}.old")

    def _store(self, keyspace: str, name: str, run_id: int, df: DataFrame, check=None) -> None:
        """check: takes the written table, before it is in place. A crash leaves the table, its former state, or that as .old."""
        final = self._folder(keyspace, name, f"run_id={run_id:05d}")
        df.write.mode("overwrite").parquet(f"{final}.new")
        if check:
            check(self.spark.read.parquet(f"{final}.new"))
        fs, where = filesystem(self.spark, final)
        new, old = (filesystem(self.spark, f"{final}.{x}")[1] for x in ("new", "old"))
        if fs.exists(where):
            fs.delete(old, True)
            fs.rename(where, old)
        if not fs.rename(new, where):
            raise ScriptError(f"can't put {final} in place")
        fs.delete(old, True)

    def ddl(self, script: Script, table: str) -> str:
        node = script.writer_of(table)
        return f"CREATE TABLE {table} ({', '.join(f'{f} {SPARK[k].upper()}' for f, k in node.kinds().items())}) USING PARQUET{' ' + node.table_options if node.table_options else ''}"

    # runs

    def start_run(self, keyspace: str, script: Script, start_nodes: list[str], description: str = "", params: dict | None = None) -> int:
        """Runs the nodes that these start, in order. Nodes behind one that failed fail by their policies; others go on."""
        nodes = policies.affected(script, start_nodes)
        run_id = self._new_run(keyspace)
        self._append(keyspace, "wf_run_properties", [(run_id, ",".join(start_nodes), ",".join(nodes), "", json.dumps(params or {}), description)])
        self._append(keyspace, "wf_run_history", [(_now(), run_id, START, "")])
        failed = []
        for name in nodes:
            if self._stopped(keyspace, run_id):
                self._node_event(keyspace, run_id, name, STOP, "stop received")
            elif self.exec_node(keyspace, script, name, run_id) == FAIL:
                failed.append(name)
        if not self._stopped(keyspace, run_id):
            self._append(keyspace, "wf_run_history", [(_now(), run_id, COMPLETE, f"failed: {', '.join(failed)}" if failed else "")])
        return run_id

    def stop_run(self, keyspace: str, run_id: int, comment: str = "") -> None:
        self._append(keyspace, "wf_run_history", [(_now(), run_id, STOP, comment)])

    def _stopped(self, keyspace: str, run_id: int) -> bool:
        return bool(self.history(keyspace, "wf_run_history").where((F.col("run_id") == run_id) & (F.col("status") == STOP)).take(1))

    def _going(self, keyspace: str, run_id: int) -> bool:
        """Whether the run has begun and has neither ended nor been stopped."""
        said = {r["status"] for r in self.history(keyspace, "wf_run_history").where(F.col("run_id") == run_id).collect()}
        return said == {START}

    def _node_event(self, keyspace: str, run_id: int, node: str, status: int, comment: str = "") -> None:
        """A node is one batch here: its partitions are Spark's tasks, which are repeated one by one."""
        self._append(keyspace, "wf_batch_history", [(_now(), run_id, node, 0, 1, status, comment)])
        self._append(keyspace, "wf_node_history", [(_now(), run_id, node, status, comment)])

    def events(self, keyspace: str, node: str, run_id: int) -> list[policies.Event]:
        """What each run that covers the node says of it."""
        runs = {r["run_id"]: r["affected_nodes"].split(",") for r in self.history(keyspace, "wf_run_properties").collect()}
        first: dict[int, str] = {}
        status: dict[int, tuple] = {}
        for r in self.history(keyspace, "wf_run_history").orderBy("ts").collect():
            first.setdefault(r["run_id"], str(r["ts"]))
            status[r["run_id"]] = (r["status"], str(r["ts"]))
        own: dict[int, tuple] = {}
        for r in self.history(keyspace, "wf_node_history").where(F.col("script_node") == node).orderBy("ts").collect():
            own[r["run_id"]] = (r["status"], str(r["ts"]))
        return [policies.Event(i, i == run_id, first.get(i, ""), status.get(i, (policies.NONE, ""))[0], own.get(i, (policies.NONE, ""))[0], "", own.get(i, (0, ""))[1]) for i, nodes in runs.items() if node in nodes]

    def ready(self, keyspace: str, script: Script, name: str, run_id: int) -> tuple[str, dict[str, int]]:
        """go, wait or nogo for a node, and the run to read each of its tables from."""
        answers, runs = [], {}
        node = script.nodes[name]
        for source in script.inputs(node):
            answer, chosen = policies.decide(policies.of_script(script, node.policy), self.events(keyspace, source, run_id))
            answers.append(answer)
            if chosen is not None:
                runs[script.nodes[source].output] = chosen
        return policies.together(answers), runs

    def exec_node(self, keyspace: str, script: Script, name: str, run_id: int) -> int:
        """Runs one node; gives its status.

        A node that has begun in this run before and has not ended is begun anew once the time that a batch may take is
        over, or fails, as its rerun policy says. A node that has ended is run again.
        """
        node = script.nodes[name]
        begun = self._begun(keyspace, name, run_id)
        if begun and node.rerun_policy == "fail":
            return self._failed(keyspace, run_id, name, "has begun before and is not to be rerun")
        if begun and node.max_seconds:
            time.sleep(max(0.0, node.max_seconds - (_now() - begun).total_seconds()))
        until = time.monotonic() + self.wait_seconds
        answer, runs = self.ready(keyspace, script, name, run_id)
        while answer == "wait" and time.monotonic() < until and self._going(keyspace, run_id):
            time.sleep(self.poll_seconds)
            answer, runs = self.ready(keyspace, script, name, run_id)
        if answer != "go":
            return self._failed(keyspace, run_id, name, f"dependencies: {answer}")
        self._node_event(keyspace, run_id, name, START)
        planner = Planner(self.spark, script, {t: self.table(keyspace, t, r) for t, r in runs.items()})
        try:
            with self._limited(node.max_seconds):
                made = planner.build(node)
                if node.writer:
                    sink.write(made, node.writer, run_id, node.batches)
                else:
                    self._store(keyspace, node.output, run_id, made, lambda written: self._check(written, node))
        except Exception as e:  # recorded, whatever it is
            return self._failed(keyspace, run_id, name, f"{type(e).__name__}: {str(e)[:500]}")
        self._node_event(keyspace, run_id, name, SUCCESS)
        return SUCCESS

    def _failed(self, keyspace: str, run_id: int, name: str, comment: str) -> int:
        self._node_event(keyspace, run_id, name, FAIL, comment)
        return FAIL

    def _begun(self, keyspace: str, name: str, run_id: int) -> dt.datetime | None:
        """When the node began in the run, if it hasn't ended."""
        own = (F.col("script_node") == name) & (F.col("run_id") == run_id)
        last = self.history(keyspace, "wf_node_history").where(own).agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts")).first()
        return last["ts"] if last["status"] == START else None

    def _check(self, written: DataFrame, node) -> None:
        if self.unique_checks and node.kind != "distinct_table":
            for index, spec in node.indexes.items():
                if spec.unique:
                    assert_unique(written, node.kinds(), index, spec, node.strict_keys)

    @contextmanager
    def _limited(self, seconds: float | None):
        """Ends the Spark jobs of the block, so that it fails, after so many seconds."""
        if not seconds:
            yield
            return
        context, tag = self.spark.sparkContext, f"node-{uuid.uuid4().hex}"
        context.addJobTag(tag)
        timer = threading.Timer(seconds, context.cancelJobsWithTag, [tag])
        timer.start()
        try:
            yield
        finally:
            timer.cancel()
            context.removeJobTag(tag)


def node_statuses(batches: DataFrame) -> DataFrame:
    """(run_id, script_node, status) from batch events: of each batch the last, then fail before stop before success of all."""
    last = batches.groupBy("run_id", "script_node", "batch_idx", "batches_total").agg(F.max_by("status", "ts").alias("status"))
    n = lambda s: F.count_if(F.col("status") == s)
    status = F.when(n(FAIL) > 0, FAIL).when(n(STOP) > 0, STOP).when(n(SUCCESS) == F.max("batches_total"), SUCCESS).otherwise(START)
    return last.groupBy("run_id", "script_node").agg(status.alias("status"))


def run_statuses(nodes: DataFrame, properties: DataFrame) -> DataFrame:
    """(run_id, status): complete once all nodes that a run affects have ended."""
    total = properties.select("run_id", F.size(F.split("affected_nodes", ",")).alias("total"))
    ended = nodes.groupBy("run_id").agg(F.count_if(F.col("status").isin(SUCCESS, FAIL, STOP)).alias("ended"))
    return total.join(ended, "run_id", "left").select("run_id", F.when(F.coalesce("ended", F.lit(0)) == F.col("total"), COMPLETE).otherwise(START).alias("status"))


def diagram(script: Script, statuses: dict[str, int] | None = None) -> str:
    """The DAG as DOT; lookups are dashed, and nodes are coloured by status."""
    colours = {SUCCESS: "darkgreen", FAIL: "red", START: "blue", STOP: "orange"}
    out = ["digraph script {", "  rankdir=TD; node [fontname=arial shape=box];"]
    for n in script.nodes.values():
        status = (statuses or {}).get(n.name)
        style = f' color={colours[status]} xlabel="{STATUS_NAMES[status]}"' if status in colours else ""
        label = f"{n.name}\\n{n.kind}\\n{n.output or n.writer.url}".replace('"', "'")
        out.append(f'  "{n.name}" [label="{label}"{style}{" style=dotted" if n.start_policy == "manual" else ""}];')
        for k, source in enumerate(script.inputs(n)):
            out.append(f'  "{source}" -> "{n.name}"{" [style=dashed]" if k else ""};')
    return "\n".join([*out, "}"])
