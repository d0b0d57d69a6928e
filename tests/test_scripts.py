import json
import threading
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftline import cli, queries
from weftline.errors import ScriptError
from weftline.plans import policies
from weftline.plans.planner import Planner
from weftline.plans.params import substitute
from weftline.plans.policies import FAIL, START, STOP, SUCCESS, Event
from weftline.plans.runs import Engine, _now, diagram, node_statuses, run_statuses
from weftline.plans.script import build, load
from weftline.sources import sink
from weftline.sources.infer import csv_reader, general, guess, parquet_reader, table_writer
from weftline.streaming.rowwise import stream_table

SCRIPT = """
nodes:
  read:
    type: file_table
    r:
      urls: ["{dir}/in.csv"]
      csv: {hdr_line_idx: 0, first_data_line_idx: 1}
      columns:
        col_id: {csv: {col_hdr: id, col_format: "%d"}, col_type: int}
        col_price: {csv: {col_hdr: price, col_format: "$%f"}, col_default_value: "7.5", col_type: decimal2}
        col_name: {csv: {col_hdr: name}, col_default_value: none, col_type: string}
        col_when: {csv: {col_hdr: when, col_format: "2006-01-02"}, col_type: datetime}
        col_ok: {csv: {col_hdr: ok}, col_type: bool}
    w:
      name: items
      fields:
        id: {expression: r.col_id, type: int}
        price: {expression: r.col_price, type: decimal2}
        name: {expression: r.col_name, type: string}
        when: {expression: r.col_when, type: datetime}
        ok: {expression: r.col_ok, type: bool}
      indexes: {idx_items: "unique(id)"}
  twice:
    type: table_table
    start_policy: "{policy|string}"
    r: {table: items, expected_batches_total: "{batches|number}"}
    w:
      name: doubled
      having: "w.price > 3"
      fields:
        id: {expression: r.id, type: int}
        price: {expression: r.price * 2, type: decimal2}
  joined:
    type: table_lookup_table
    start_policy: "{policy|string}"
    r: {table: doubled}
    l: {index_name: idx_items, join_on: r.id, join_type: left, group: false}
    w:
      name: both
      fields:
        id: {expression: r.id, type: int}
        name: {expression: l.name, type: string}
        price: {expression: r.price, type: decimal2}
  out:
    type: table_file
    r: {table: both}
    w:
      top: {order: "price(desc),id(asc)", limit: 10}
      url_template: "{dir}/out_{run_id|string}.csv"
      columns:
        - {name: id, expression: r.id, type: int, csv: {header: id, format: "%03d"}}
        - {name: name, expression: r.name, type: string, csv: {header: name, format: "%s"}}
        - {name: price, expression: r.price, type: decimal2, csv: {header: price, format: "%s"}}
"""
LINES = 'id,price,name,when,ok\r\n1,$1.10,"a, ""b""",2020-01-02,T\n002,,,,0\n3,$2.345,he"llo,2020-01-03,\n'


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in.csv").write_text(LINES)
    return tmp_path


def script(folder, policy="auto"):
    return load(SCRIPT, {"dir": str(folder), "policy": policy, "batches": 4})


def test_whole_run(spark, folder):
    s, engine = script(folder), Engine(spark, f"file://{folder}/root")
    run = engine.start_run("ks", s, ["read"], "first")
    assert {r["script_node"]: r["status"] for r in node_statuses(engine.history("ks", "wf_batch_history")).collect()} == dict.fromkeys(s.nodes, SUCCESS)
    assert [tuple(r) for r in run_statuses(node_statuses(engine.history("ks", "wf_batch_history")), engine.history("ks", "wf_run_properties")).collect()] == [(run, policies.COMPLETE)]
    assert (folder / "out_00001.csv").read_text() == 'id,name,price\n002,none,15.00\n003,"he""llo",4.70\n'
    first = engine.table("ks", "items", run).orderBy("id").collect()
    assert first[0].name == 'a, "b"' and first[0].ok and first[0].price == Decimal("1.10")
    assert first[1].price == Decimal("7.50") and first[1].when.year == 1 and first[2].price == Decimal("2.35")
    assert engine.keyspaces() == ["ks"] and "id BIGINT" in engine.ddl(s, "items")
    engine.drop_keyspace("ks")
    assert engine.keyspaces() == []


def test_later_run_reads_an_earlier_runs_table(spark, folder):
    s, engine = script(folder, "manual"), Engine(spark, f"file://{folder}/root")
    assert policies.affected(s, ["read"]) == ["read"]
    assert engine.start_run("ks", s, ["read"]) == 1
    assert engine.start_run("ks", s, ["twice", "joined"]) == 2
    assert (folder / "out_00002.csv").exists()
    assert engine.table("ks", "doubled", 2).count() == 2


def test_failures_are_recorded(spark, folder):
    (folder / "in.csv").write_text(LINES + "1,$3.00,x,2020-01-01,1\n")  # the id comes twice
    s, engine = script(folder), Engine(spark, f"file://{folder}/root")
    engine.start_run("ks", s, ["read"])
    assert {r["script_node"]: r["status"] for r in node_statuses(engine.history("ks", "wf_batch_history")).collect()} == dict.fromkeys(s.nodes, FAIL)
    comments = {r["script_node"]: r["comment"] for r in engine.history("ks", "wf_node_history").where(f"status = {FAIL}").collect()}
    assert comments["twice"] == "dependencies: nogo" and "read" in engine.history("ks", "wf_run_history").orderBy(F.desc("ts")).first()["comment"]
    assert engine.exec_node("ks", s, "twice", 1) == FAIL  # the run has ended: nothing to wait for
    with pytest.raises(Exception):  # noqa: B017
        engine.table("ks", "items", 1).count()  # what breaks a unique index is never in place


def test_a_table_stays_until_the_next_is_in_place(spark, folder):
    engine = Engine(spark, f"file://{folder}/root")
    one, two = spark.range(3), spark.range(5)
    engine._store("ks", "t", 1, one)

    def refuse(df):
        raise ScriptError(str(df.count()))

    with pytest.raises(ScriptError, match="5"):
        engine._store("ks", "t", 1, two, refuse)
    assert engine.table("ks", "t", 1).count() == 3
    engine._store("ks", "t", 1, two)
    assert engine.table("ks", "t", 1).count() == 5
    (folder / "root/ks/t/run_id=00001").rename(folder / "root/ks/t/run_id=00001.old")  # a crash between the two renames
    assert engine.table("ks", "t", 1).count() == 5


def test_waiting_and_time_limits(spark, folder):
    s, engine = script(folder, "manual"), Engine(spark, f"file://{folder}/root", wait_seconds=30, poll_seconds=0.2)
    engine._append("ks", "wf_run_properties", [(1, "read", "read", "", "{}", "")])
    engine._append("ks", "wf_run_history", [(_now(), 1, START, "")])
    engine._node_event("ks", 1, "read", START)
    engine._new_run("ks")

    def finish():  # another engine that ends its node a little later
        other = Engine(spark, f"file://{folder}/root")
        other._store("ks", "items", 1, Planner(spark, s).build(s.nodes["read"]))
        other._node_event("ks", 1, "read", SUCCESS)

    later = threading.Timer(2, finish)
    later.start()
    run = engine.start_run("ks", s, ["twice"])
    later.join()
    assert engine.exec_node("ks", s, "twice", run) == SUCCESS
    slow = build({"nodes": {"n": queries.reader("x", "y", {"a": "int"}) | {"max_batch_processing_time": 1500}}})
    with pytest.raises(Exception), engine._limited(slow.nodes["n"].max_seconds):  # noqa: B017
        spark.range(40).repartition(4).selectExpr("reduce(sequence(1, 30000000), 0L, (a, x) -> a + x)").collect()
    assert spark.range(3).count() == 3


def test_each_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n2,1\n")
    columns = {c: {"csv": {"col_hdr": c}, "col_type": "int"} for c in "ab"}
    r = {"urls": [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"], "csv": {"hdr_line_idx": 0, "first_data_line_idx": 1}, "columns": columns}
    node = {"type": "file_table", "r": r, "w": queries.writer("t", {c: (f"r.{c}", "int") for c in "ab"})}
    assert [tuple(x) for x in Planner(spark, build({"nodes": {"n": node}})).table("t").collect()] == [(1, 2)] * 2
    (tmp_path / "b.csv").write_text("b,c\n2,1\n")
    with pytest.raises(ScriptError, match="no columns a"):
        Planner(spark, build({"nodes": {"n": node}})).table("t")


def test_large_files_tell_by_their_quotes(spark, tmp_path, monkeypatch):
    from weftline.sources import scan

    monkeypatch.setattr(scan, "SMALL", 0)
    plain, quoted = tmp_path / "plain.csv", tmp_path / "quoted.csv"
    plain.write_text("".join(f'{i},"x{i}"\n' for i in range(1000)))
    quoted.write_text("".join(f'{i},"x\n{i}"\n' for i in range(1000)))
    for path, feeds in ((plain, False), (quoted, True)):
        columns = {"k": {"csv": {"col_idx": 0}, "col_type": "int"}, "t": {"csv": {"col_idx": 1}, "col_type": "string"}}
        node = {"type": "file_table", "r": {"urls": [str(path)], "csv": {}, "columns": columns}, "w": queries.writer("t", {"k": ("r.k", "int"), "t": ("r.t", "string")})}
        df = Planner(spark, build({"nodes": {"n": node}})).table("t")
        assert scan._has_line_feeds(spark, [str(path)], 1) == feeds and df.count() == 1000 and df.where("k = 7").first()["t"] == ("x\n7" if feeds else "x7")


def test_a_file_has_all_rows_whatever_the_session_says(spark, tmp_path):
    types = {"n_nationkey": "int"}
    spark.range(1500).selectExpr("id as n_nationkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 100)
    try:
        for kind, target in (("parquet", "o.parquet"), ("csv", "o.csv"), ("parquet", "b_{batch_idx|string}.parquet")):
            columns = [{"name": "n_nationkey", "expression": "r.n_nationkey", "type": "int", kind: {"column_name": "k"} if kind == "parquet" else {"header": "k"}}]
            s = build({"nodes": {"r": queries.reader(str(tmp_path), "nation", types), "w": {"type": "table_file", "r": {"table": "t_nation", "expected_batches_total": 3}, "w": {"url_template": f"{tmp_path}/{target}", "columns": columns, "having": "w.n_nationkey < 1200"}}}})
            files = sink.write(Planner(spark, s).build(s.nodes["w"]), s.nodes["w"].writer, 1, 3)
            assert (spark.read.parquet(*files) if kind == "parquet" else spark.read.text(files).where("value <> 'k'")).count() == 1200
        s = build({"nodes": {"r": queries.reader(str(tmp_path), "nation", types), "w": {"type": "table_file", "r": {"table": "t_nation", "expected_batches_total": 4}, "w": {"url_template": f"{tmp_path}/e_{{batch_idx|string}}.parquet", "columns": [columns[0]], "having": "w.n_nationkey == 5"}}}})
        files = sink.write(Planner(spark, s).build(s.nodes["w"]), s.nodes["w"].writer, 1, 4)
        assert len(files) == 4 and sorted(spark.read.parquet(f).count() for f in files) == [0, 0, 0, 1]
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_fetched_files_come_in_blocks(spark, tmp_path):
    from weftline.sources import uris

    uris.FETCHERS["test"] = lambda uri: (f"{i},x{i}\n".encode() for i in range(1000))
    try:
        path = uris.readable(spark, "test://host/in.csv", f"file://{tmp_path}")
    finally:
        del uris.FETCHERS["test"]
    assert spark.read.text(path).count() == 1000


def test_stopped_runs(spark, folder):
    s, engine = script(folder), Engine(spark, f"file://{folder}/root")
    engine.stop_run("ks", 1)
    engine.start_run("ks", s, ["read"])
    assert {r["status"] for r in node_statuses(engine.history("ks", "wf_batch_history")).collect()} == {STOP}


@pytest.mark.parametrize(
    "text",
    ["id,price,name,when,ok\nx,$1,a,2020-01-01,1\n", "id,price,name,when,ok\n1,$1,a,01/02/2020,1\n", "id,price,name,when,ok\n1,$1,a,2020-01-01,maybe\n", "id,name\n1,a\n"],
)
def test_wrong_cells_fail(spark, folder, text):
    (folder / "in.csv").write_text(text)
    with pytest.raises(Exception):  # noqa: B017
        Planner(spark, script(folder)).table("items").collect()


def test_lines_before_the_data(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("about\nk\tv\nunits\n1\ta\n2\t\n")
    columns = {"k": {"csv": {"col_hdr": "k"}, "col_type": "int"}, "v": {"csv": {"col_hdr": "v"}, "col_type": "string"}}
    r = {"urls": [f"{tmp_path}/x.tsv"], "csv": {"hdr_line_idx": 1, "first_data_line_idx": 3, "separator": "\t"}, "columns": columns}
    s = build({"nodes": {"n": {"type": "file_table", "r": r, "w": queries.writer("t", {"k": ("r.k", "int"), "v": ("r.v", "string")})}}})
    assert sorted(map(tuple, Planner(spark, s).table("t").collect())) == [(1, "a"), (2, "")]


def test_files_by_batch_and_parquet(spark, tmp_path):
    types = {"n_nationkey": "int", "n_name": "string"}
    spark.createDataFrame([(i, f"n{i}") for i in range(20)], "n_nationkey bigint, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    for target, kind in ((f"{tmp_path}/b_{{batch_idx|string}}.csv", "csv"), (f"{tmp_path}/b_{{batch_idx|string}}.parquet", "parquet")):
        columns = [{"name": c, "expression": f"r.{c}", "type": t, kind: {"column_name": c} if kind == "parquet" else {"header": c}} for c, t in types.items()]
        s = build({"nodes": {"r": queries.reader(str(tmp_path), "nation", types), "w": {"type": "table_file", "r": {"table": "t_nation", "expected_batches_total": 2}, "w": {"url_template": target, "columns": columns, "top": {"order": "n_nationkey(desc)"}}}}})
        files = sink.write(Planner(spark, s).build(s.nodes["w"]), s.nodes["w"].writer, 1, 2)
        assert len(files) == 2
        if kind == "csv":
            parts = [open(f).read().splitlines() for f in files]
            assert all(p[0] == "n_nationkey,n_name" for p in parts)
            keys = [[int(x.split(",")[0]) for x in p[1:]] for p in parts]
            assert all(k == sorted(k, reverse=True) for k in keys) and sorted(keys[0] + keys[1]) == list(range(20))
        else:
            assert spark.read.parquet(*files).count() == 20


def test_params():
    assert substitute('{"a": "{n|number}", "b": "{x}", "c": "{l|stringlist}", "d": "{run_id|string}", "e": "{t|bool}"}', {"n": 5, "x": "y", "l": ["p", "q"], "t": True}) == '{"a": 5, "b": "y", "c": ["p", "q"], "d": "{run_id|string}", "e": true}'
    for text, params in (("{a}", {}), ("{a|number}", {"a": "x"}), ("{a|bool}", {"a": 1}), ("{a|stringlist}", {"a": "x"})):
        with pytest.raises(ScriptError):
            substitute(text, params)


def changed(folder, old, new):
    assert old in SCRIPT
    return load(SCRIPT.replace(old, new), {"dir": str(folder), "policy": "auto", "batches": 4})


@pytest.mark.parametrize(
    "old, new",
    [
        ("type: table_table", "type: table_tables"), ("name: doubled", "name: idx_doubled"), ("name: doubled", "name: items"), ("table: doubled", "table: nothing"), ("r.price * 2", "l.price * 2"), ("r.price * 2", "sum(r.price)"), ("w.price > 3", "r.price > 3"), ("w.price > 3", "w.none > 3"),
        ("join_type: left", "join_type: outer"), ("join_on: r.id", "join_on: 'r.id,r.price'"), ("index_name: idx_items", "index_name: idx_none"), ('idx_items: "unique(id)"', 'idx_items: "unique(id)", idx_more: "unique(name)"'), ('"unique(id)"', '"unique(none)"'), ("table: items", "table: both"),
        ("limit: 10", "limit: 5000001"), ('"{batches|number}"', "0"), ("{expression: r.col_id, type: int}", "{expression: r.col_id, type: integer}"), ("start_policy: \"{policy|string}\"\n    r: {table: items", "start_policy: later\n    r: {table: items"),
    ],
)
def test_scripts_that_are_wrong(folder, old, new):
    with pytest.raises(ScriptError):
        changed(folder, old, new)


def test_types_are_checked_when_planned(spark, folder):
    with pytest.raises(ScriptError, match="declared decimal2"):
        Planner(spark, changed(folder, "r.price * 2", "float(r.price) * 2")).table("doubled")


def test_json_and_yaml_twins(folder):
    import yaml

    twin = load(json.dumps(yaml.safe_load(SCRIPT.replace('"{batches|number}"', "4"))), {"dir": str(folder), "policy": "auto"})
    assert twin.order() == script(folder).order()
    with pytest.raises(ScriptError):
        load("nodes: {", {})


def test_policies():
    rules = policies.RULES[policies.DEFAULT_POLICY]
    policies.check_policy(rules)
    event = lambda run, now, node, status=START: Event(run, now, f"{run}", status, node)
    assert policies.decide(rules, []) == ("wait", None)
    assert policies.decide(rules, [event(1, False, SUCCESS, policies.COMPLETE), event(2, True, SUCCESS)]) == ("go", 2)
    assert policies.decide(rules, [event(1, False, SUCCESS, policies.COMPLETE), event(2, False, SUCCESS, policies.COMPLETE)]) == ("go", 2)
    assert policies.decide(rules, [event(2, True, FAIL)])[0] == "nogo"
    assert policies.decide(rules, [event(2, True, policies.NONE)])[0] == "wait"
    assert policies.together(["go", "wait", "nogo"]) == "nogo" and policies.together(["go", "wait"]) == "wait" and policies.together([]) == "go"
    assert policies.rolled_up([SUCCESS], 2) == START and policies.rolled_up([SUCCESS, FAIL], 2) == FAIL and policies.rolled_up([SUCCESS] * 2, 2) == SUCCESS
    assert policies.run_status([SUCCESS, FAIL], 2) == policies.COMPLETE and policies.run_status([SUCCESS], 2) == START
    with pytest.raises(ScriptError):
        policies.check_policy({"rules": [{"cmd": "stay", "expression": "true"}]})


def test_diagram_and_cli(folder, capsys):
    assert '"read" -> "twice"' in diagram(script(folder), {"read": SUCCESS}) and "style=dashed" in diagram(script(folder))
    (folder / "s.yaml").write_text(SCRIPT)
    (folder / "p.json").write_text(json.dumps({"dir": str(folder), "policy": "auto", "batches": 4}))
    assert cli.main(["validate_script", f"{folder}/s.yaml", "--params", f"{folder}/p.json"]) == 0
    assert "4 nodes" in capsys.readouterr().out
    assert cli.main(["get_diagram", f"{folder}/s.yaml", "--params", f"{folder}/p.json"]) == 0


def test_commands(spark, folder, capsys):
    (folder / "s.yaml").write_text(SCRIPT)
    (folder / "p.json").write_text(json.dumps({"dir": str(folder), "policy": "manual", "batches": 4}))
    root, script_of = f"file://{folder}/root", [f"{folder}/s.yaml", "--params", f"{folder}/p.json"]

    def said(*args):
        assert cli.main(list(args)) == 0
        return capsys.readouterr().out.strip()

    assert said("start_run", root, "ks", script_of[0], "read", *script_of[1:]) == "1"
    assert said("start_run", root, "ks", script_of[0], "twice,joined", *script_of[1:]) == "2"
    assert said("exec_node", root, "ks", script_of[0], "read", "2", *script_of[1:]) == str(SUCCESS)
    assert said("list_keyspaces", root) == "ks"
    assert len(said("get_run_history", root, "ks").splitlines()) == 4
    assert len(said("get_node_history", root, "ks").splitlines()) == 10 == len(said("get_batch_history", root, "ks").splitlines())
    assert "darkgreen" in said("get_diagram", *script_of, "--root", root, "--keyspace", "ks", "--run", "2")
    assert said("get_table_ddl", script_of[0], "doubled", *script_of[1:]) == "CREATE TABLE doubled (id BIGINT, price DECIMAL(18,2)) USING PARQUET"
    assert '"col_type": "int"' in said("proto_file_reader_creator", f"{folder}/in.csv", "things")
    said("stop_run", root, "ks", "2")
    said("drop_keyspace", root, "ks")
    assert said("list_keyspaces", root) == ""


def test_plain_quotes(spark, folder):
    s = changed(folder, "      url_template:", "      csv: {plain_quotes: true}\n      url_template:")
    sink.write(Planner(spark, s).build(s.nodes["out"]), s.nodes["out"].writer, 3)
    assert (folder / "out_00003.csv").read_bytes() == b'id,name,price\r\n002,none,15.00\n003,he"llo,4.70\n'


def test_guessing(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("id\tsku\tshipped\tprice\tweight\tgone\nab\t1\t2020-01-02 03:04:05\t1.50\t0.125\ttrue\ncd\t2\t2021-01-02 03:04:05\t22.75\t3.5\tfalse\n")
    r = csv_reader(spark, f"{tmp_path}/p.tsv", separator="\t")
    assert [c["col_type"] for c in r["columns"].values()] == ["string", "int", "datetime", "decimal2", "float", "bool"]
    made = build({"nodes": {"n": {"type": "file_table", "r": r, "w": table_writer(r, "products")}}})
    df = Planner(spark, made).table("products")
    assert df.count() == 2
    df.write.parquet(f"{tmp_path}/p.parquet")
    assert [c["col_type"] for c in parquet_reader(spark, f"{tmp_path}/p.parquet")["columns"].values()] == ["string", "int", "datetime", "decimal2", "float", "bool"]
    assert guess(" -5 ") == ("int", None) and general([("int", None), ("float", None)]) == ("float", None) and general([("int", None), ("bool", None)]) == ("string", None)


def test_rowwise_nodes_over_a_stream(spark, folder):
    s = script(folder)
    spark.createDataFrame([(1, Decimal("5.00")), (2, Decimal("1.00"))], "id bigint, price decimal(18,2)").write.parquet(f"{folder}/stream")
    stream = spark.readStream.schema("id bigint, price decimal(18,2)").parquet(f"{folder}/stream")
    q = stream_table(spark, s, "items", stream, "doubled").writeStream.format("memory").queryName("doubled").option("checkpointLocation", f"{folder}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("doubled").collect()] == [(1, Decimal("10.00"))]
    with pytest.raises(ScriptError):
        stream_table(spark, s, "items", stream, "both")


def _sunk(spark, tmp_path, kind, target, order=None, batches=1):
    """Writes 2,000 rows, of which 1,500 are equal in `tie`; gives the rows of each file, in its order."""
    types = {"k": "int", "tie": "string", "at": "datetime"}
    if not (tmp_path / "many.parquet").exists():
        spark.range(0, 2000, 1, 4).selectExpr("id * 7 % 2000 as k", "if(id < 1500, 'b', cast(id as string)) as tie", "timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, 0, id) as at").write.parquet(f"{tmp_path}/many.parquet")
    columns = [{"name": c, "expression": f"r.{c}", "type": t, kind: {"column_name": c} if kind == "parquet" else {"header": c.upper()}} for c, t in types.items()]
    w = {"url_template": f"{tmp_path}/{target}", "columns": columns} | ({"top": {"order": order}} if order else {})
    s = build({"nodes": {"r": queries.reader(str(tmp_path), "many", types), "w": {"type": "table_file", "r": {"table": "t_many", "expected_batches_total": batches}, "w": w}}})
    files = sink.write(Planner(spark, s).build(s.nodes["w"]), s.nodes["w"].writer, 1, batches)
    if kind == "parquet":
        assert spark.read.parquet(*files).where("at = timestamp_ntz'2020-01-01 00:00:07'").count() == 1
        return [[(r["k"], r["tie"]) for r in pq.ParquetFile(f).read().to_pylist()] for f in files]
    lines = [open(f, newline="").read().split("\n") for f in files]
    assert all(x[0] == "K,TIE,AT" and x[-1] == "" for x in lines)
    return [[(int(x.split(",")[0]), x.split(",")[1]) for x in found[1:-1]] for found in lines]


@pytest.mark.parametrize(("kind", "order", "batches"), [("parquet", "tie(desc)", 1), ("csv", "tie(desc)", 1), ("parquet", "tie(asc)", 3), ("csv", "tie(asc)", 3), ("csv", None, 1), ("csv", None, 3)])
def test_a_file_is_no_single_task(spark, tmp_path, monkeypatch, kind, order, batches):
    """Parts of a file are sorted and written by several tasks, even if most rows are equal in the order; all rows are in the file, in order."""
    found = []
    monkeypatch.setattr(sink, "_part_files", lambda *a, f=sink._part_files: found.append(f(*a)) or list(found[-1]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        files = _sunk(spark, tmp_path, kind, f"o_{{batch_idx|string}}.{kind}" if batches > 1 else f"o.{kind}", order, batches)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r for f in files for r in f) == sorted((k * 7 % 2000, "b" if k < 1500 else str(k)) for k in range(2000))
    for f in files:
        ties = [t for _, t in f]
        assert not order or ties == sorted(ties, reverse="desc" in order)
    assert max(map(len, found)) > 1 and len(found) == batches
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".") and p.is_dir()]
