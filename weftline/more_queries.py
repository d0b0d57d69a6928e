"""Queries for the rarer operators and settings, with the SQL that each is held against.

Those that need a file of some form write it to a scratch folder first, from the driver's tables.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.cql.session import Session
from weftline.errors import ScriptError
from weftline.plans import policies
from weftline.plans.planner import PROCESSORS, Planner
from weftline.plans.policies import COMPLETE, FAIL, NONE, START, SUCCESS, Event
from weftline.plans.runs import Engine, node_statuses, run_statuses
from weftline.plans.script import build, load
from weftline.queries import (
    BY_ORDER, ITEMS, MONEY, ORDERS, TAGGED_SQL, TAGS, P, _calculated, _tagged, items, lookup_node, node, orders, query, reader, scratch, some, table_of, writer,
)
from weftline.sources import sink

# CSV files


def csv_text(spark: SparkSession, lines: DataFrame, head: str | None = None) -> str:
    """A folder with lines (column `line`) as text files, each of which begins with `head`."""
    folder = f"{scratch(spark)}/text"
    # one task writes one file: the head sorts before its lines
    rows = lines.select("line", F.lit(1).alias("n"))
    if head is not None:
        rows = rows.union(spark.createDataFrame([(x, 0) for x in head.split("\n")], "line string, n int"))
    rows.coalesce(1).sortWithinPartitions("n").select("line").write.text(folder)
    return folder


def csv_node(urls: list[str], columns: dict[str, dict], csv: dict, name: str = "again") -> dict:
    fields = {c: (f"r.{c}", spec["col_type"]) for c, spec in columns.items()}
    return {"type": "file_table", "r": {"urls": urls, "csv": csv, "columns": columns}, "w": writer(name, fields)}


def column(kind: str, place: str | int, form: str | None = None, default: str | None = None) -> dict:
    at = {"col_hdr": place} if isinstance(place, str) else {"col_idx": place}
    return {"csv": at | ({"col_format": form} if form else {}), "col_type": kind} | ({"col_default_value": default} if default is not None else {})


HEADER = {"hdr_line_idx": 0, "first_data_line_idx": 1}


@query("select n_nationkey::bigint as k, n_name as name from nation")
def csv_two_headers(spark, sf_dir):
    """Two files with the same columns in another order: each has its own header."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    one = csv_text(spark, n.where("n_nationkey < 12").select(F.concat_ws(",", "n_nationkey", "n_name").alias("line")), "k,name")
    two = csv_text(spark, n.where("n_nationkey >= 12").select(F.concat_ws(",", "n_name", F.lit("spare"), "n_nationkey").alias("line")), "name,x,k")
    return table_of(spark, {"r": csv_node([one, two], {"k": column("int", "k", "%d"), "name": column("string", "name")}, HEADER)}, "again")


@query("""select s_suppkey::bigint as k, case when s_suppkey % 2 = 0 then 'none' else s_name end as name, case when s_suppkey % 3 = 0 then -1 else s_nationkey end::bigint as nation,
case when s_suppkey % 5 = 0 then 0.5 else s_suppkey / 4 end as quarter, case when s_suppkey % 7 = 0 then 0 else s_suppkey end::bigint as zero from supplier""")
def csv_defaults(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    cell = lambda n, value: F.when(F.col("s_suppkey") % n == 0, F.lit("")).otherwise(value.cast("string"))
    line = F.concat_ws(",", "s_suppkey", cell(2, F.col("s_name")), cell(3, F.col("s_nationkey")), cell(5, F.col("s_suppkey") / 4), cell(7, F.col("s_suppkey")))
    columns = {"k": column("int", 0), "name": column("string", 1, None, "none"), "nation": column("int", 2, "%d", "-1"), "quarter": column("float", 3, "%f", "0.5"), "zero": column("int", 4)}
    return table_of(spark, {"r": csv_node([csv_text(spark, s.select(line.alias("line")))], columns, {"hdr_line_idx": -1, "first_data_line_idx": 0})}, "again")


@query("""select p_partkey::bigint as k, cast(cast((p_partkey + 10) // 10 as decimal(16,0)) * cast(0.01 as decimal(3,2)) as decimal(18,2)) as money,
cast(-p_partkey as decimal(18,2)) as debt from part""")
def csv_decimal2(spark, sf_dir):
    """More than two digits are rounded half away from zero."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    value = (F.col("p_partkey").cast("decimal(18,3)") / 1000 + F.lit("0.005").cast("decimal(18,3)")).cast("decimal(18,3)")
    line = F.concat_ws(",", "p_partkey", F.concat(F.lit("$"), value.cast("string"), F.lit(" net")), (-F.col("p_partkey")).cast("string"))
    columns = {"k": column("int", "k"), "money": column("decimal2", "money", "$%f net"), "debt": column("decimal2", "debt")}
    return table_of(spark, {"r": csv_node([csv_text(spark, p.select(line.alias("line")), "k,money,debt")], columns, HEADER)}, "again")


@query("select n_nationkey::bigint as k, n_nationkey % 2 = 0 as ok from nation")
def csv_bools(spark, sf_dir):
    words = F.array(*map(F.lit, ["1", "0", "t", "f", "T", "F", "TRUE", "FALSE", "true", "false", "True", "False"]))
    line = F.concat_ws(",", "n_nationkey", F.element_at(words, (F.col("n_nationkey") % 12 + 1).cast("int")))
    folder = csv_text(spark, spark.read.parquet(f"{sf_dir}/nation.parquet").select(line.alias("line")))
    return table_of(spark, {"r": csv_node([folder], {"k": column("int", 0), "ok": column("bool", 1)}, {})}, "again")


@query("""select o_orderkey, date_trunc('day', o_orderdate) as day, date_trunc('second', o_orderdate) as second, date_trunc('second', o_orderdate) - interval 2 hour as utc from orders""")
def csv_time_layouts(spark, sf_dir):
    o, at = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderdate")
    line = F.concat_ws("\t", "o_orderkey", F.date_format(at, "dd/MM/yyyy"), F.date_format(at, "MMM dd, yyyy hh:mm:ss a"), F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    columns = {"o_orderkey": column("int", 0), "day": column("datetime", 1, "02/01/2006"), "second": column("datetime", 2, "Jan 02, 2006 03:04:05 PM"), "utc": column("datetime", 3, "2006-01-02T15:04:05-07:00")}
    return table_of(spark, {"r": csv_node([csv_text(spark, o.select(line.alias("line")))], columns, {"separator": "\t"})}, "again")


@query("select c_custkey::bigint as k, c_name as name from customer")
def csv_lines_before_data(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    folder = csv_text(spark, c.select(F.concat_ws(";", "c_name", "c_custkey").alias("line")), "a report\nname;k\nno units")
    csv = {"hdr_line_idx": 1, "first_data_line_idx": 3, "separator": ";", "multi_line": False}
    return table_of(spark, {"r": csv_node([folder], {"k": column("int", "k"), "name": column("string", "name")}, csv)}, "again")


@query("select n_nationkey::bigint as k, n_name || chr(10) || '\"' || n_regionkey || '\"' as text from nation")
def csv_quoted_line_feeds(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    text = F.concat(F.lit('"'), "n_name", F.lit('\n""'), "n_regionkey", F.lit('"""'))
    folder = csv_text(spark, n.select(F.concat_ws(",", "n_nationkey", text).alias("line")))
    return table_of(spark, {"r": csv_node([folder], {"k": column("int", 0), "text": column("string", 1)}, {})}, "again")


@query("select r_regionkey::bigint as k, r_name as name from region")
def file_uri_scan(spark, sf_dir):
    """A URI with a scheme."""
    path = sf_dir if "://" in sf_dir else f"file://{sf_dir}"
    return table_of(spark, {"r": reader(path, "region", {"r_regionkey": "int", "r_name": "string"}, {"k": ("r.r_regionkey", "int"), "name": ("r.r_name", "string")}, "names")}, "names")


@query(f"""select o_orderkey, o_custkey::bigint as small, cast(o_totalprice as decimal(18,2)) as wide, cast(cast(o_totalprice as decimal(18,2)) as decimal(18,2)) as narrow, date_trunc('day', o_orderdate) as day,
o_orderstatus = 'O' as open, (o_orderkey % 1000)::float::double as real from orders""")
def parquet_types(spark, sf_dir):
    """Decimals in fixed bytes and in whole numbers, short whole numbers, single floats, days."""
    folder = f"{scratch(spark)}/types.parquet"
    spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_orderkey", "cast(o_custkey as int) as small", "cast(cast(o_totalprice as decimal(18,2)) as decimal(30,2)) as wide", "cast(o_totalprice as decimal(9,2)) as narrow", "cast(o_orderdate as date) as day", "o_orderstatus = 'O' as open",
        "cast(o_orderkey % 1000 as float) as real",
    ).write.parquet(folder)
    kinds = {"o_orderkey": "int", "small": "int", "wide": "decimal2", "narrow": "decimal2", "day": "datetime", "open": "bool", "real": "float"}
    r = {"urls": [folder], "columns": {c: {"parquet": {"col_name": c}, "col_type": k} for c, k in kinds.items()}}
    return table_of(spark, {"r": {"type": "file_table", "r": r, "w": writer("again", {c: (f"r.{c}", k) for c, k in kinds.items()})}}, "again")


@query("select k, ok, file_type from (values (1, true, 'int'), (2, false, 'string')) t(k, ok, file_type)")
def parquet_declared_types(spark, sf_dir):
    """A column that the file holds in another type than declared is an error."""
    rows = []
    for k, (kind, declared) in enumerate((("int", "int"), ("string", "int")), 1):
        try:
            table_of(spark, {"r": reader(sf_dir, "nation", {"n_nationkey" if kind == "int" else "n_name": declared}, name="t")}, "t")
            rows.append((k, True, kind))
        except ScriptError:
            rows.append((k, False, kind))
    return spark.createDataFrame(rows, "k int, ok boolean, file_type string")


# sinks


def _written(spark: SparkSession, sf_dir: str, target: str, columns: list[dict], batches: int = 1, **more) -> list[str]:
    w = {"url_template": target, "columns": columns} | more
    script = build({"nodes": {"o": orders(sf_dir), "w": {"type": "table_file", "r": {"table": "orders", "expected_batches_total": batches}, "w": w}}})
    n = script.nodes["w"]
    return sink.write(Planner(spark, script).build(n), n.writer, 7, n.batches)


def _columns(kind: str) -> list[dict]:
    own = {"o_orderkey": ("int", "%06d"), "total": ("decimal2", "%s"), "status": ("string", "%s")}
    return [{"name": c, "expression": f"r.{c}", "type": t, kind: {"column_name": c} if kind == "parquet" else {"header": c.upper(), "format": f}} for c, (t, f) in own.items()]


@query("""select printf('%06d', o_orderkey) || ',' || cast(o_totalprice as decimal(18,2)) || ',' || o_orderstatus as line from orders union all select 'O_ORDERKEY,TOTAL,STATUS'""")
def csv_sink_formats(spark, sf_dir):
    (file,) = _written(spark, sf_dir, f"{scratch(spark)}/o_{{run_id|string}}.csv", _columns("csv"))
    return spark.read.text(file).withColumnRenamed("value", "line")


@query(f"select o_orderkey, {MONEY.format('o_totalprice')} as total, o_orderstatus as status, 5::bigint as files from orders")
def sink_files_by_batch(spark, sf_dir):
    files = _written(spark, sf_dir, f"{scratch(spark)}/o_{{run_id|string}}_{{batch_idx|string}}.parquet", _columns("parquet"), 5, top={"order": "o_orderkey(asc)"})
    return spark.read.parquet(*files).withColumn("files", F.lit(len(set(files))).cast("bigint"))


@query(f"select o_orderkey, {MONEY.format('o_totalprice')} as total, o_orderstatus as status from orders")
def sink_parts(spark, sf_dir):
    """A folder of parts, for more rows than one task should write."""
    (folder,) = _written(spark, sf_dir, f"{scratch(spark)}/parts", _columns("csv"), parts=True, top={"order": "o_orderkey(asc)"})
    columns = {"o_orderkey": column("int", "O_ORDERKEY"), "total": column("decimal2", "TOTAL"), "status": column("string", "STATUS")}
    return table_of(spark, {"r": csv_node([folder], columns, HEADER)}, "again")


@query("select o_orderkey, case when o_orderstatus = 'F' then null else o_orderdate end as ordered from orders")
def zero_time_sink(spark, sf_dir):
    """The zero time is null in a Parquet file."""
    zero = "time.Date(1, time.January, 1, 0, 0, 0, 0, time.UTC)"
    types = some(ORDERS, "o_orderkey", "o_orderstatus", "o_orderdate")
    first = reader(sf_dir, "orders", types, {"o_orderkey": ("r.o_orderkey", "int"), "ordered": (f'time.iif(r.o_orderstatus == "F", {zero}, r.o_orderdate)', "datetime")}, "orders")
    columns = [{"name": c, "expression": f"r.{c}", "type": t, "parquet": {"column_name": c}} for c, t in (("o_orderkey", "int"), ("ordered", "datetime"))]
    script = build({"nodes": {"o": first, "w": {"type": "table_file", "r": {"table": "orders"}, "w": {"url_template": f"{scratch(spark)}/o.parquet", "columns": columns}}}})
    (file,) = sink.write(Planner(spark, script).build(script.nodes["w"]), script.nodes["w"].writer, 1)
    return spark.read.parquet(file)


@query(f"select o_orderkey, {MONEY.format('o_totalprice')} as total, o_orderstatus as status from orders order by upper(o_orderstatus) desc, o_orderkey limit 50")
def top_modifiers(spark, sf_dir):
    """Descending, whatever the case, in the first characters."""
    (file,) = _written(spark, sf_dir, f"{scratch(spark)}/top.parquet", _columns("parquet"), top={"order": "status(desc,ignore_case,16),o_orderkey(asc)", "limit": 50})
    return spark.read.parquet(file)


@query(f"select o_orderkey, {MONEY.format('o_totalprice')} as total, o_orderstatus as status from orders")
def top_without_limit(spark, sf_dir):
    """An order without a limit sorts the whole file; the default limit is beyond these tables."""
    (file,) = _written(spark, sf_dir, f"{scratch(spark)}/all.parquet", _columns("parquet"), top={"order": "total(desc)"})
    return spark.read.parquet(file)


# expressions


@query("""select n_nationkey::bigint as k, round((n_nationkey - 12) * 0.5::double) as half, round(0.49999999999999994::double) as below, round(4503599627370497::double + n_nationkey) as large,
round(9.5e18::double * (n_nationkey + 1)) as beyond from nation""")
def math_round_edges(spark, sf_dir):
    fields = {
        "k": ("r.n_nationkey", "int"), "half": ("math.Round(float(r.n_nationkey - 12) * 0.5)", "float"), "below": ("math.Round(0.49999999999999994)", "float"), "large": ("math.Round(4503599627370497.0 + r.n_nationkey)", "float"),
        "beyond": ("math.Round(9500000000000000000.0 * (r.n_nationkey + 1))", "float"),
    }
    return table_of(spark, {"r": reader(sf_dir, "nation", {"n_nationkey": "int"}, fields, "rounded")}, "rounded")


@query("select p_partkey::bigint as k, '-' || array_to_string(list_transform(string_split(p_brand, ''), lambda x: x || '-'), '') as between from part")
def replace_nothing(spark, sf_dir):
    fields = {"k": ("r.p_partkey", "int"), "between": ('strings.ReplaceAll(r.p_brand, "", "-")', "string")}
    return table_of(spark, {"r": reader(sf_dir, "part", {"p_partkey": "int", "p_brand": "string"}, fields, "t")}, "t")


@query("select o_orderkey, 1::bigint as past, timestamp '2020-03-31 00:00:00' as last, true as fixed from orders")
def time_now_and_months(spark, sf_dir):
    """The present is known by its bounds only."""
    past = 'int.iif(time.After(time.Now(), r.o_orderdate) && time.After(time.Now(), time.Parse("2006-01-02", "2024-01-01")), 1, 0)'
    fields = {"o_orderkey": ("r.o_orderkey", "int"), "past": (past, "int"), "last": ("time.Date(2020, time.April, 0, 0, 0, 0, 0, time.UTC)", "datetime"), "fixed": ("time.DiffMilli(time.Now(), time.Now()) == 0", "bool")}
    return table_of(spark, {"r": reader(sf_dir, "orders", some(ORDERS, "o_orderkey", "o_orderdate"), fields, "t")}, "t")


# lookups and distinct rows


@query("select o_orderkey, avg(l_quantity) as mean, count(*) as n from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey")
def avg_of_float(spark, sf_dir):
    i = reader(sf_dir, "lineitem", some(ITEMS, "l_orderkey", "l_quantity"), name="items", indexes={"idx_items": "non_unique(l_orderkey)"})
    fields = {"o_orderkey": ("r.o_orderkey", "int"), "mean": ("avg(l.l_quantity)", "float"), "n": ("count()", "int")}
    return table_of(spark, {"o": orders(sf_dir), "i": i, "j": lookup_node("orders", "idx_items", "r.o_orderkey", writer("means", fields), group=True)}, "means")


@query("select a.p_partkey, count(*) as same from part a join part b on a.p_brand = b.p_brand group by a.p_partkey")
def lookup_strict_keys(spark, sf_dir):
    """Keys without accents, in their first characters, without trailing blanks."""
    types = {"p_partkey": "int", "p_brand": "string"}
    accents = 'strings.ReplaceAll(r.p_brand, "a", "ä") + "                ends"'
    first = reader(sf_dir, "part", types, {"p_partkey": ("r.p_partkey", "int"), "brand": (accents, "string")}, "first")
    second = reader(sf_dir, "part", types, {"brand": ('r.p_brand + "  "', "string")}, "second", indexes={"idx_second": "non_unique(brand(16))"})
    j = lookup_node("first", "idx_second", "r.brand", writer("same", {"p_partkey": ("r.p_partkey", "int"), "same": ("count()", "int")}), group=True)
    return table_of(spark, {"a": first, "b": second, "j": j | {"strict_keys": True}}, "same")


@query(f"select o_orderkey, l_linenumber::bigint as l_linenumber, {P} as price from orders join lineitem on o_orderkey = l_orderkey")
def lookup_knobs(spark, sf_dir):
    """Batch sizes are checked and change nothing."""
    j = lookup_node("orders", "idx_items", "r.o_orderkey", writer("joined", {"o_orderkey": ("r.o_orderkey", "int"), "l_linenumber": ("l.l_linenumber", "int"), "price": ("l.price", "decimal2")}))
    j["r"] |= {"rowset_size": 50, "expected_batches_total": 10}
    j["l"] |= {"idx_read_batch_size": 7, "right_lookup_read_batch_size": 20_000}
    return table_of(spark, {"o": orders(sf_dir), "i": items(sf_dir, BY_ORDER), "j": j}, "joined")


@query("select n_nationkey::bigint as k, n as suppliers from nation join (select s_nationkey, count(*) as n from (select distinct s_nationkey, s_suppkey from supplier) group by 1) on n_nationkey = s_nationkey")
def distinct_extra_index(spark, sf_dir):
    """A distinct table may have other indexes too, for lookups."""
    s = reader(sf_dir, "supplier", {"s_suppkey": "int", "s_nationkey": "int"}, name="suppliers")
    d = node("distinct_table", "suppliers", writer("pairs", {"s_nationkey": ("r.s_nationkey", "int"), "s_suppkey": ("r.s_suppkey", "int")}, indexes={"idx_pairs": "unique(s_nationkey,s_suppkey)", "idx_nation": "non_unique(s_nationkey)"}), rerun_policy="fail")
    n = reader(sf_dir, "nation", {"n_nationkey": "int"}, name="nations")
    return table_of(spark, {"s": s, "d": d, "n": n, "j": lookup_node("nations", "idx_nation", "r.n_nationkey", writer("counts", {"k": ("r.n_nationkey", "int"), "suppliers": ("count()", "int")}), group=True)}, "counts")


# custom processors


@query(TAGGED_SQL)
def tag_criteria_url(spark, sf_dir):
    folder = f"{scratch(spark)}/criteria"
    spark.createDataFrame([(json.dumps(TAGS),)], "line string").coalesce(1).write.text(folder)
    nodes = _tagged(sf_dir)
    nodes["t"]["p"] = {"tag_field_name": "tag", "tag_criteria_url": folder}
    return table_of(spark, nodes, "tagged")


def _words(df: DataFrame, types: dict[str, str], settings: dict, spark: SparkSession) -> tuple[DataFrame, dict[str, str]]:
    """A processor of one's own: a row for each word of a field, none for an empty one."""
    return df.withColumn("p__word", F.explode(F.split(F.col(settings["field"]), " "))).where("p__word <> ''"), {"word": "string"}


PROCESSORS["words"] = _words


@query("select p_partkey::bigint as k, word from (select p_partkey, unnest(string_split(p_name, ' ')) as word from part) where word not in ('', 'the') and length(word) > 3")
def custom_processor(spark, sf_dir):
    p = reader(sf_dir, "part", {"p_partkey": "int", "p_name": "string"}, name="parts")
    w = writer("words", {"k": ("r.p_partkey", "int"), "word": ("p.word", "string")}, 'len(w.word) > 3 && w.word != "the"')
    return table_of(spark, {"p": p, "t": node("table_custom_tfm_table", "parts", w, custom_proc_type="words", p={"field": "p_name"})}, "words")


@query("select o_orderkey, length(o_orderkey::varchar)::bigint as digits, abs(o_orderkey - 1000)::bigint as apart, (o_orderkey % 2 = 1) as odd from orders")
def py_calc_builtins(spark, sf_dir):
    columns = {"digits": ("len(str(r.o_orderkey))", "int"), "apart": ("abs(minus(r.o_orderkey, 1000))", "int"), "odd": ("bool(rest(r.o_orderkey))", "bool")}
    first = reader(sf_dir, "orders", some(ORDERS, "o_orderkey"), name="orders")
    p = {"python_code": ["def minus(a, b):\n    return a - b\n\ndef rest(n):\n    return n % 2\n"], "calculated_fields": {f: {"expression": e, "type": t} for f, (e, t) in columns.items()}}
    fields = {"o_orderkey": ("r.o_orderkey", "int")} | {f: (f"p.{f}", t) for f, (_, t) in columns.items()}
    return table_of(spark, {"o": first, "c": node("table_custom_tfm_table", "orders", writer("made", fields), custom_proc_type="py_calc", p=p)}, "made")


# the query dialect

VALUES = "from (values {}) t({})"


@query(f"select * {VALUES.format('(1, 2, chr(98)), (1, 1, chr(97)), (2, 1, null)', 'pk, ck, name')}")
def cql_definitions(spark, sf_dir):
    s = Session(spark)
    s.execute("CREATE KEYSPACE ks WITH REPLICATION = {'class': 'SimpleStrategy'}; CREATE KEYSPACE IF NOT EXISTS ks WITH REPLICATION = {'class': 'SimpleStrategy'}; USE ks")
    s.execute("CREATE TABLE t (name text, ck int, pk int, PRIMARY KEY ((pk), ck)) WITH CLUSTERING ORDER BY (ck DESC); CREATE TABLE IF NOT EXISTS t (a int PRIMARY KEY)")
    s.execute("INSERT INTO t (pk, ck, name) VALUES (9, 9, 'gone'); TRUNCATE t; CREATE TABLE u (a int PRIMARY KEY); DROP TABLE u; DROP TABLE IF EXISTS u; DROP KEYSPACE IF EXISTS other")
    for pk, ck, name in ((1, 1, "a"), (1, 2, "b"), (2, 1, None)):
        s.execute("INSERT INTO t (pk, ck, name) VALUES (?, ?, ?)", pk, ck, name)
    return s.execute("SELECT * FROM ks.t")


@query("select s_suppkey, exp(0) as one, round(ln(s_suppkey + 1), 9) as natural, log10(100) as two, round(s_suppkey / 8) as rounded, s_suppkey as same, timestamp '1970-01-02' as day, true as recent from supplier")
def cql_functions(spark, sf_dir):
    s = Session(spark)
    s.register("supplier", spark.read.parquet(f"{sf_dir}/supplier.parquet"), ["s_suppkey"])
    made = s.execute("SELECT s_suppkey, exp(0) AS one, log(s_suppkey + 1) AS natural, log10(100) AS two, round(CAST(s_suppkey AS double) / 8) AS rounded, round(s_suppkey) AS same, totimestamp(1) AS day, current_timestamp() AS now, current_date() AS today, current_time() AS clock, now() AS id FROM supplier")
    now, today = F.col("now") / 86_400_000, F.col("today")
    recent: Column = (F.col("now") > 1_700_000_000_000) & (F.floor(now) == today) & F.col("clock").between(0, 86_400 * 10**9) & (F.length("id") == 36)
    return made.select("s_suppkey", "one", F.round("natural", 9).alias("natural"), "two", "rounded", "same", "day", recent.alias("recent"))


# the first half of murmur3 (x64, seed 0) of the keys as eight little-endian bytes, by another implementation
@query("select * from (values (0::bigint, 2945182322382062539::bigint), (1, 19144387141682250), (2, -2447670524089286488), (3, 6574508035858270988), (4, -5469109305088493887)) t(r_regionkey, token)")
def cql_token(spark, sf_dir):
    s = Session(spark)
    s.register("region", spark.read.parquet(f"{sf_dir}/region.parquet"), ["r_regionkey"])
    return s.execute("SELECT r_regionkey, token(r_regionkey) AS token FROM region WHERE token(r_regionkey) != 0").select(F.col("r_regionkey").cast("bigint").alias("r_regionkey"), "token")


@query("select s_suppkey, s_name, row_number() over (order by s_suppkey) as place from supplier")
def cql_paging(spark, sf_dir):
    s = Session(spark)
    s.register("supplier", spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name"), ["s_suppkey"])
    rows, state = [], 0
    while state is not None:
        page, state = s.pages("SELECT s_suppkey, s_name FROM supplier", size=40, state=state)
        rows += [(*r, len(rows) + k) for k, r in enumerate(page, 1)]
    types = dict(s.execute("SELECT s_suppkey, s_name FROM supplier").dtypes)
    return spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in types.items()) + ", place bigint")


@query("select r_regionkey, true as recent, true as kept from region where r_regionkey < 2")
def cql_update_time(spark, sf_dir):
    """A time that was stored doesn't change with later reads."""
    s = Session(spark)
    s.register("region", spark.read.parquet(f"{sf_dir}/region.parquet").selectExpr("r_regionkey", "cast(null as bigint) as at", "cast(null as timestamp_ntz) as stamp"), ["r_regionkey"])
    s.execute("UPDATE region SET at = current_timestamp(), stamp = totimestamp(now()) WHERE r_regionkey < 2")
    first = {r["r_regionkey"]: (r["at"], r["stamp"]) for r in s.execute("SELECT * FROM region WHERE r_regionkey < 2").collect()}
    again = s.execute("SELECT * FROM region WHERE r_regionkey < 2").collect()
    key = s.execute("SELECT r_regionkey FROM region").schema[0].dataType.simpleString()
    return spark.createDataFrame([(r["r_regionkey"], r["at"] > 1_700_000_000_000 and r["stamp"].year > 2023, first[r["r_regionkey"]] == (r["at"], r["stamp"])) for r in again], f"r_regionkey {key}, recent boolean, kept boolean")


@query("select n as k, n * 2 as twice from range(60) t(n) where n % 7 <> 3")
def cql_many_changes(spark, sf_dir):
    """Inserted rows stay one relation, and a table is written out after many changes."""
    s = Session(spark)
    s.execute("CREATE TABLE t (k bigint PRIMARY KEY, twice bigint)")
    for k in range(60):
        s.execute("INSERT INTO t (k, twice) VALUES (?, ?)", k, k)
    for k in range(3, 60, 7):
        s.execute("DELETE FROM t WHERE k = ?", k)
    return s.execute("UPDATE t SET twice = k * 2 WHERE k >= 0; SELECT * FROM t")


# runs


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark, f"{scratch(spark)}/root", wait_seconds=0.0)


def _statuses(engine: Engine, keyspace: str = "ks") -> DataFrame:
    return node_statuses(engine.history(keyspace, "wf_batch_history"))


@query(f"select *, {COMPLETE} as run_status {VALUES.format(f'({FAIL}, chr(105)), ({SUCCESS}, chr(111)), ({FAIL}, chr(106)), ({SUCCESS}, chr(109))', 'status, script_node')}")
def run_branches(spark, sf_dir):
    """A broken unique index fails its node and those behind it; an independent branch goes on, and the run is complete."""
    nodes = {
        "i": items(sf_dir, "idx_items|unique(l_orderkey)"), "o": orders(sf_dir), "m": node("table_table", "orders", writer("copies", {"k": ("r.o_orderkey", "int")})),
        "j": lookup_node("orders", "idx_items", "r.o_orderkey", writer("joined", {"k": ("r.o_orderkey", "int"), "price": ("l.price", "decimal2")})),
    }
    engine = _engine(spark)
    engine.start_run("ks", build({"nodes": nodes}), ["i", "o"])
    nodes_of, runs = _statuses(engine), run_statuses(_statuses(engine), engine.history("ks", "wf_run_properties"))
    return nodes_of.join(runs.withColumnRenamed("status", "run_status"), "run_id").select("script_node", "status", "run_status")


@query(f"select o_orderkey, {MONEY.format('o_totalprice')} as total, 2::bigint as run from orders where cast(o_totalprice as decimal(18,2)) > 150000")
def run_with_params(spark, sf_dir):
    """A script with parameters; its second run reads the first one's table."""
    text = json.dumps({"nodes": {"o": orders("{folder}"), "m": node("table_table", "orders", writer("large", {"o_orderkey": ("r.o_orderkey", "int"), "total": ("r.total", "decimal2")}, "w.total > {least|number}"), start_policy="manual")}})
    script, engine = load(text.replace('"{least|number}"', "{least}"), {"folder": sf_dir, "least": 150000}), _engine(spark)
    engine.start_run("ks", script, ["o"])
    run = engine.start_run("ks", script, ["m"])
    return engine.table("ks", "large", run).withColumn("run", F.lit(run).cast("bigint"))


@query(f"select * {VALUES.format(f'(1, {SUCCESS}), (2, {SUCCESS}), (3, {FAIL})', 'k, status')}")
def run_rerun_policies(spark, sf_dir):
    """A node that has ended may be run again; one that has only begun is begun anew, or fails, as its policy says."""
    types = {"r_regionkey": "int"}
    nodes = {"a": reader(sf_dir, "region", types, name="a"), "b": reader(sf_dir, "region", types, name="b") | {"rerun_policy": "fail"}}
    engine, script = _engine(spark), build({"nodes": nodes})
    run = engine.start_run("ks", script, ["a"])
    found = [engine.exec_node("ks", script, "a", run)]
    for name in ("a", "b"):
        engine._node_event("ks", run, name, START)
        found.append(engine.exec_node("ks", script, name, run))
    return spark.createDataFrame(list(enumerate(found, 1)), "k int, status int")


def _decisions() -> list[tuple[str, str, int | None]]:
    rules = policies.RULES[policies.DEFAULT_POLICY]
    events = {
        "none": [], "this_run": [Event(1, False, "1", COMPLETE, SUCCESS), Event(2, True, "2", START, SUCCESS)], "latest": [Event(1, False, "1", COMPLETE, SUCCESS), Event(3, False, "3", COMPLETE, SUCCESS)],
        "failed": [Event(2, True, "2", START, FAIL)], "running": [Event(2, True, "2", START, NONE)],
    }
    return [(name, *policies.decide(rules, e)) for name, e in events.items()]


@query("select * from (values ('none', 'wait', null), ('this_run', 'go', 2), ('latest', 'go', 3), ('failed', 'nogo', null), ('running', 'wait', null)) t(events, answer, run)")
def run_dependency_policy(spark, sf_dir):
    return spark.createDataFrame(_decisions(), "events string, answer string, run int")


WRONG = {
    "having_reads_r": lambda d: d["d"]["w"].update(having="r.l_suppkey > 3"), "having_on_distinct": lambda d: d["d"]["w"].update(having="w.l_suppkey > 3"), "two_unique": lambda d: d["d"]["w"]["indexes"].update(idx_more="unique(flag)"),
    "rerun": lambda d: d["d"].update(rerun_policy="rerun"), "reads_l": lambda d: d["d"]["w"]["fields"]["flag"].update(expression="l.flag"), "aggregates": lambda d: d["d"]["w"]["fields"]["flag"].update(expression="max(r.flag)"),
    "too_many_batches": lambda d: d["d"]["r"].update(expected_batches_total=2_000_000), "right": lambda d: None,
}


@query(f"select name, name <> 'right' as refused from (values {', '.join(f'({n!r})' for n in WRONG)}) t(name)")
def script_checks(spark, sf_dir):
    """Which scripts are refused before anything runs."""
    rows = []
    for name, change in WRONG.items():
        w = writer("keys", {"l_suppkey": ("r.l_suppkey", "int"), "flag": ("r.flag", "string")}, indexes={"idx_keys": "unique(l_suppkey,flag)"})
        nodes = {"i": items(sf_dir), "d": node("distinct_table", "items", w, rerun_policy="fail")}
        change(nodes)
        try:
            build({"nodes": nodes})
            rows.append((name, False))
        except ScriptError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "name string, refused boolean")
