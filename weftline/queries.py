"""Queries over the driver's tables, one for each operator, with the SQL that each is held against.

Most are scripts: file nodes read the tables, further nodes apply the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.cql.session import Session
from weftline.plans import policies
from weftline.plans.planner import Planner
from weftline.plans.runs import node_statuses
from weftline.plans.script import build
from weftline.sources import sink
from weftline.sources.uris import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def reader(sf_dir: str | list[str], table: str, types: dict[str, str], fields: dict[str, tuple] | None = None, name: str | None = None, having: str | None = None, indexes: dict | None = None) -> dict:
    """A file node over a table's Parquet file. fields: name -> (expression, type); the columns themselves by default."""
    folders = [sf_dir] if isinstance(sf_dir, str) else sf_dir
    fields = fields or {c: (f"r.{c}", t) for c, t in types.items()}
    return {
        "type": "file_table",
        "r": {"urls": [f"{d}/{table}.parquet" for d in folders], "columns": {c: {"parquet": {"col_name": c}, "col_type": t} for c, t in types.items()}},
        "w": writer(name or f"t_{table}", fields, having, indexes),
    }


def writer(name: str, fields: dict[str, tuple], having: str | None = None, indexes: dict | None = None) -> dict:
    made = {f: {"expression": x[0], "type": x[1]} | ({"default_value": x[2]} if len(x) > 2 else {}) for f, x in fields.items()}
    return {"name": name, "fields": made, "having": having, "indexes": indexes or {}}


def node(kind: str, table: str, w: dict, **more) -> dict:
    return {"type": kind, "r": {"table": table}, "w": w} | more


def lookup_node(table: str, index: str, on: str, w: dict, join: str = "inner", group: bool = False, where: str | None = None) -> dict:
    return node("table_lookup_table", table, w, l={"index_name": index, "join_on": on, "join_type": join, "group": group, "filter": where})


def table_of(spark: SparkSession, nodes: dict, table: str) -> DataFrame:
    return Planner(spark, build({"nodes": nodes})).table(table)


ORDERS = {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "string", "o_totalprice": "float", "o_orderdate": "datetime", "o_orderpriority": "string"}
ITEMS = {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "l_returnflag": "string", "l_shipdate": "datetime"}
PRICE = {"l_orderkey": ("r.l_orderkey", "int"), "l_linenumber": ("r.l_linenumber", "int"), "l_suppkey": ("r.l_suppkey", "int"), "l_partkey": ("r.l_partkey", "int"), "l_quantity": ("int(r.l_quantity)", "int"), "price": ("decimal2(r.l_extendedprice)", "decimal2"), "flag": ("r.l_returnflag", "string"), "discount": ("r.l_discount", "float")}


def some(types: dict[str, str], *names: str) -> dict[str, str]:
    return {n: types[n] for n in names}


def items(sf_dir: str, index: str | None = None) -> dict:
    return reader(sf_dir, "lineitem", some(ITEMS, "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_discount"), PRICE, "items", indexes={index.split("|")[0]: index.split("|")[1]} if index else None)


def orders(sf_dir: str, **more) -> dict:
    return reader(sf_dir, "orders", some(ORDERS, "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), {"o_orderkey": ("r.o_orderkey", "int"), "o_custkey": ("r.o_custkey", "int"), "status": ("r.o_orderstatus", "string"), "total": ("decimal2(r.o_totalprice)", "decimal2")}, "orders", **more)


BY_ORDER = "idx_items|non_unique(l_orderkey)"
MONEY = "cast({} as decimal(18,2))"
P = "cast(l_extendedprice as decimal(18,2))"
# exact half-away division of cents n by d in DuckDB
HALF = "cast(cast(sign({n})*((2*abs({n})+{d})//(2*{d})) as decimal(18,0)) * cast(0.01 as decimal(3,2)) as decimal(18,2))"
AVG_P = HALF.format(n="cast(sum({p})*100 as hugeint)".format(p=P), d="cast(count(*) as hugeint)")


# scans and projections


@query(f"""select l_orderkey, l_linenumber::bigint as l_linenumber, cast(round({P} * cast('1.10' as decimal(18,2)), 2) as decimal(18,2)) as taxed, l_shipdate
from lineitem where l_shipdate >= timestamp '1996-01-01' and round({P} * cast('1.10' as decimal(18,2)), 2) > 1000""")
def file_table_project_having(spark, sf_dir):
    fields = {"l_orderkey": ("r.l_orderkey", "int"), "l_linenumber": ("r.l_linenumber", "int"), "taxed": ("decimal2(r.l_extendedprice) * decimal2(1.1)", "decimal2"), "l_shipdate": ("r.l_shipdate", "datetime")}
    having = 'w.l_shipdate >= time.Parse("2006-01-02", "1996-01-01") && w.taxed > 1000'
    return table_of(spark, {"read": reader(sf_dir, "lineitem", some(ITEMS, "l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"), fields, "taxed_items", having)}, "taxed_items")


@query("select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey, 'a,\"b\" ' || n_name as quoted from nation")
def csv_scan_roundtrip(spark, sf_dir):
    target = f"{scratch(spark)}/nation.csv"
    types = {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}
    columns = [{"name": c, "expression": f"r.{c}", "type": t, "csv": {"header": c, "format": "%05d" if t == "int" else "%s"}} for c, t in types.items()]
    columns.append({"name": "quoted", "expression": "`a,\"b\" ` + r.n_name", "type": "string", "csv": {"header": "quoted", "format": "%s"}})
    out = build({"nodes": {"read": reader(sf_dir, "nation", types), "write": {"type": "table_file", "r": {"table": "t_nation"}, "w": {"url_template": target, "columns": columns, "top": {"order": "n_nationkey(asc)"}}}}})
    n = out.nodes["write"]
    sink.write(Planner(spark, out).build(n), n.writer, 1)
    back = {c["name"]: {"csv": {"col_hdr": c["name"]} | ({"col_format": "%d"} if c["type"] == "int" else {}), "col_type": c["type"]} for c in columns}
    r = {"urls": [target], "csv": {"hdr_line_idx": 0, "first_data_line_idx": 1}, "columns": back}
    return table_of(spark, {"again": {"type": "file_table", "r": r, "w": writer("again", {c["name"]: (f"r.{c['name']}", c["type"]) for c in columns})}}, "again")


@query(f"select o_orderkey, {MONEY.format('o_totalprice')} as total, o_orderdate from orders")
def parquet_sink_roundtrip(spark, sf_dir):
    target = f"{scratch(spark)}/orders.parquet"
    types = {"o_orderkey": "int", "total": "decimal2", "o_orderdate": "datetime"}
    first = reader(sf_dir, "orders", some(ORDERS, "o_orderkey", "o_totalprice", "o_orderdate"), {"o_orderkey": ("r.o_orderkey", "int"), "total": ("decimal2(r.o_totalprice)", "decimal2"), "o_orderdate": ("r.o_orderdate", "datetime")}, "orders")
    columns = [{"name": c, "expression": f"r.{c}", "type": t, "parquet": {"column_name": c}} for c, t in types.items()]
    out = build({"nodes": {"read": first, "write": {"type": "table_file", "r": {"table": "orders"}, "w": {"url_template": target, "columns": columns, "parquet": {"codec": "snappy"}}}}})
    n = out.nodes["write"]
    sink.write(Planner(spark, out).build(n), n.writer, 1)
    r = {"urls": [target], "columns": {c: {"parquet": {"col_name": c}, "col_type": t} for c, t in types.items()}}
    return table_of(spark, {"again": {"type": "file_table", "r": r, "w": writer("again", {c: (f"r.{c}", t) for c, t in types.items()})}}, "again")


@query(f"""select l_orderkey, l_linenumber::bigint as l_linenumber, (l_partkey * 7 - l_suppkey)::bigint as i1, (l_partkey // 7)::bigint as i2, (-l_partkey % 7)::bigint as i3,
l_extendedprice * (1 - l_discount) as f1, case when l_discount = 0 then 'inf'::double else l_extendedprice / l_discount end as f2,
cast(round({P} * cast(0.5 as decimal(2,1)), 2) as decimal(18,2)) as d1, cast({P} - 3 as decimal(18,2)) as d2, case when l_quantity > 25 then 1 else 0 end::bigint as many from lineitem""")
def table_table_arith(spark, sf_dir):
    fields = {
        "l_orderkey": ("r.l_orderkey", "int"), "l_linenumber": ("r.l_linenumber", "int"), "i1": ("r.l_partkey * 7 - r.l_suppkey", "int"), "i2": ("r.l_partkey / 7", "int"), "i3": ("-r.l_partkey % 7", "int"),
        "f1": ("r.l_extendedprice * (1 - r.l_discount)", "float"), "f2": ("r.l_extendedprice / r.l_discount", "float"), "d1": ("decimal2(r.l_extendedprice) * decimal2(0.5)", "decimal2"),
        "d2": ("decimal2(r.l_extendedprice) - 3", "decimal2"), "many": ("int.iif(r.l_quantity > 25, 1, 0)", "int"),
    }
    nodes = {"read": reader(sf_dir, "lineitem", some(ITEMS, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")), "calc": node("table_table", "t_lineitem", writer("calc", fields))}
    return table_of(spark, nodes, "calc")


@query("""select p_partkey, strlen(p_name)::bigint as bytes, replace(p_type, 'A', 'aa') as swapped, regexp_matches(p_name, '^[a-m].*e') as early, printf('%05d/%10s/%s', p_partkey, p_brand, p_type) as label,
p_brand || '-' || p_partkey::varchar as joined, case when p_size > 25 then 'big' else 'small' end as class from part""")
def string_functions(spark, sf_dir):
    types = {"p_partkey": "int", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int"}
    fields = {
        "p_partkey": ("r.p_partkey", "int"), "bytes": ("int(len(r.p_name))", "int"), "swapped": ('strings.ReplaceAll(r.p_type, "A", "aa")', "string"), "early": ('re.MatchString("^[a-m].*e", r.p_name)', "bool"),
        "label": ('fmt.Sprintf("%05d/%10s/%s", r.p_partkey, r.p_brand, r.p_type)', "string"), "joined": ('r.p_brand + "-" + string(r.p_partkey)', "string"), "class": ('string.iif(r.p_size > 25, "big", "small")', "string"),
    }
    return table_of(spark, {"read": reader(sf_dir, "part", types, fields, "texts")}, "texts")


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') as iso, strftime(o_orderdate, '%a %b %d %I:%M %p') as spoken, epoch(o_orderdate)::bigint as seconds, epoch_ms(o_orderdate)::bigint as millis,
(epoch_ms(o_orderdate) - epoch_ms(timestamp '1995-01-01'))::bigint as apart, o_orderdate < timestamp '1995-01-01' as before, o_orderdate > timestamp '1995-01-01' as after,
case when o_orderdate < timestamp '1995-01-01' then o_orderdate else timestamp '1995-01-01' end as earlier, strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') as day,
timestamp '2021-02-02 22:30:00' as made from orders""")
def time_functions(spark, sf_dir):
    then = 'time.Parse("2006-01-02", "1995-01-01")'
    fields = {
        "o_orderkey": ("r.o_orderkey", "int"), "iso": ('time.Format(r.o_orderdate, "2006-01-02T15:04:05.000")', "string"), "spoken": ('time.Format(r.o_orderdate, "Mon Jan 02 03:04 PM")', "string"), "seconds": ("time.Unix(r.o_orderdate)", "int"),
        "millis": ("time.UnixMilli(r.o_orderdate)", "int"), "apart": (f"time.DiffMilli(r.o_orderdate, {then})", "int"), "before": (f"time.Before(r.o_orderdate, {then})", "bool"), "after": (f"time.After(r.o_orderdate, {then})", "bool"),
        "earlier": (f"time.iif(time.Before(r.o_orderdate, {then}), r.o_orderdate, {then})", "datetime"), "day": ('time.Parse("2006-01-02", time.Format(r.o_orderdate, "2006-01-02"))', "datetime"),
        "made": ('time.Date(2020, 14, 3, 0, -30, 0, 0, time.FixedZone("x", 3600))', "datetime"),
    }
    return table_of(spark, {"read": reader(sf_dir, "orders", some(ORDERS, "o_orderkey", "o_orderdate"), fields, "times")}, "times")


@query(f"""select l_orderkey, l_linenumber::bigint as l_linenumber, sqrt(l_extendedprice) as root, round(l_extendedprice) as whole, trunc(l_extendedprice)::bigint as cut, l_quantity::bigint::varchar as words,
l_partkey::double as wide, {P} as money, (l_quantity > 10)::int::bigint as flag, case when l_tax > 0.04 then l_tax else l_discount end as either, case when l_tax > 0.04 then {P} else cast(1 as decimal(18,2)) end as paid from lineitem""")
def math_convert(spark, sf_dir):
    fields = {
        "l_orderkey": ("r.l_orderkey", "int"), "l_linenumber": ("r.l_linenumber", "int"), "root": ("math.Sqrt(r.l_extendedprice)", "float"), "whole": ("math.Round(r.l_extendedprice)", "float"), "cut": ("int(r.l_extendedprice)", "int"),
        "words": ("string(int(r.l_quantity))", "string"), "wide": ("float(r.l_partkey)", "float"), "money": ("decimal2(r.l_extendedprice)", "decimal2"), "flag": ("int(r.l_quantity > 10)", "int"),
        "either": ("float.iif(r.l_tax > 0.04, r.l_tax, r.l_discount)", "float"), "paid": ("decimal2.iif(r.l_tax > 0.04, decimal2(r.l_extendedprice), decimal2(1))", "decimal2"),
    }
    return table_of(spark, {"read": reader(sf_dir, "lineitem", some(ITEMS, "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_partkey", "l_tax", "l_discount"), fields, "numbers")}, "numbers")


@query("select r_name as name from region union all select r_name from region")
def multi_file_union(spark, sf_dir):
    return table_of(spark, {"read": reader([sf_dir, sf_dir], "region", {"r_name": "string"}, {"name": ("r.r_name", "string")}, "names")}, "names")


# lookups

FLAT = {"o_orderkey": ("r.o_orderkey", "int"), "l_linenumber": ("l.l_linenumber", "int", "999"), "price": ("l.price", "decimal2", "999.00"), "both": ("r.total + l.price", "decimal2"), "flag": ("l.flag", "string", "none")}


@query(f"select o_orderkey, l_linenumber::bigint as l_linenumber, {P} as price, cast(cast(o_totalprice as decimal(18,2)) + {P} as decimal(18,2)) as both, l_returnflag as flag from orders join lineitem on o_orderkey = l_orderkey")
def lookup_inner(spark, sf_dir):
    return table_of(spark, {"o": orders(sf_dir), "i": items(sf_dir, BY_ORDER), "j": lookup_node("orders", "idx_items", "r.o_orderkey", writer("joined", FLAT))}, "joined")


@query(f"""select o_orderkey, coalesce(l_linenumber, 999)::bigint as l_linenumber, coalesce({P}, cast(999 as decimal(18,2))) as price,
coalesce(cast(cast(o_totalprice as decimal(18,2)) + {P} as decimal(18,2)), cast(0 as decimal(18,2))) as both, coalesce(l_returnflag, 'none') as flag from orders left join lineitem on o_orderkey = l_orderkey""")
def lookup_left(spark, sf_dir):
    return table_of(spark, {"o": orders(sf_dir), "i": items(sf_dir, BY_ORDER), "j": lookup_node("orders", "idx_items", "r.o_orderkey", writer("joined", FLAT), "left")}, "joined")


GROUPED = {"o_orderkey": ("r.o_orderkey", "int"), "status": ("r.status", "string"), "total_price": ("sum(l.price)", "decimal2"), "avg_price": ("avg(l.price)", "decimal2"), "min_price": ("min(l.price)", "decimal2"), "max_price": ("max(l.price)", "decimal2"), "min_flag": ("min(l.flag)", "string"), "max_flag": ("max(l.flag)", "string"), "avg_quantity": ("avg(l.l_quantity)", "int"), "item_count": ("count()", "int")}
GROUPED_SQL = f"""select o_orderkey, o_orderstatus as status, coalesce(cast(sum({P}) as decimal(18,2)), 0) as total_price, coalesce({AVG_P}, 0) as avg_price, coalesce(min({P}), 0) as min_price, coalesce(max({P}), 0) as max_price,
coalesce(min(l_returnflag), '') as min_flag, coalesce(max(l_returnflag), '') as max_flag, coalesce(floor(avg(l_quantity::bigint)), 0)::bigint as avg_quantity, count(l_orderkey) as item_count
from orders JOIN lineitem on o_orderkey = l_orderkey group by o_orderkey, o_orderstatus"""


@query(GROUPED_SQL.replace("JOIN", "join"))
def lookup_inner_grouped(spark, sf_dir):
    return table_of(spark, {"o": orders(sf_dir), "i": items(sf_dir, BY_ORDER), "j": lookup_node("orders", "idx_items", "r.o_orderkey", writer("grouped", GROUPED), group=True)}, "grouped")


@query(GROUPED_SQL.replace("JOIN", "left join"))
def lookup_left_grouped(spark, sf_dir):
    return table_of(spark, {"o": orders(sf_dir), "i": items(sf_dir, BY_ORDER), "j": lookup_node("orders", "idx_items", "r.o_orderkey", writer("grouped", GROUPED), "left", True)}, "grouped")


@query(f"""select o_orderkey, coalesce(cast(sum(round(cast(o_totalprice as decimal(18,2)) - {P}, 2)) as decimal(18,2)), 0) as rest, count(l_orderkey) filter ({P} * 2 > cast(o_totalprice as decimal(18,2))) as large
from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey""")
def lookup_grouped_both_sides(spark, sf_dir):
    fields = {"o_orderkey": ("r.o_orderkey", "int"), "rest": ("sum(r.total - l.price)", "decimal2"), "large": ("count_if(l.price * 2 > r.total)", "int")}
    return table_of(spark, {"o": orders(sf_dir), "i": items(sf_dir, BY_ORDER), "j": lookup_node("orders", "idx_items", "r.o_orderkey", writer("grouped", fields), "left", True)}, "grouped")


@query("""select c_custkey, count(o_orderkey) as big_orders, coalesce(max(cast(o_totalprice as decimal(18,2))), 0) as largest from customer
left join (select * from orders where cast(o_totalprice as decimal(18,2)) > 200000 and o_orderstatus <> 'F') on c_custkey = o_custkey group by c_custkey""")
def lookup_filter(spark, sf_dir):
    fields = {"c_custkey": ("r.c_custkey", "int"), "big_orders": ("count()", "int"), "largest": ("max(l.total)", "decimal2")}
    nodes = {"c": reader(sf_dir, "customer", {"c_custkey": "int"}, name="customers"), "o": orders(sf_dir, indexes={"idx_orders": "non_unique(o_custkey)"})}
    return table_of(spark, nodes | {"j": lookup_node("customers", "idx_orders", "r.c_custkey", writer("grouped", fields), "left", True, 'l.total > 200000 && l.status != "F"')}, "grouped")


@query(f"""select a.l_orderkey, a.l_linenumber::bigint as l_linenumber, n as pairs, total from lineitem a join (select l_partkey, l_suppkey, count(*) as n, cast(sum({P}) as decimal(18,2)) as total from lineitem group by all) b
on a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey""")
def lookup_multikey(spark, sf_dir):
    fields = {"l_orderkey": ("r.l_orderkey", "int"), "l_linenumber": ("r.l_linenumber", "int"), "pairs": ("count()", "int"), "total": ("sum(l.price)", "decimal2")}
    nodes = {"i": items(sf_dir, "idx_items|non_unique(l_partkey,l_suppkey)"), "j": lookup_node("items", "idx_items", "r.l_partkey,r.l_suppkey", writer("pairs", fields), group=True)}
    return table_of(spark, nodes, "pairs")


@query("select a.p_partkey, count(*) as same_brand from part a join part b on upper(a.p_brand) = upper(b.p_brand) group by a.p_partkey")
def lookup_ignore_case(spark, sf_dir):
    types = {"p_partkey": "int", "p_brand": "string"}
    lower = reader(sf_dir, "part", types, {"p_partkey": ("r.p_partkey", "int"), "brand": ('strings.ReplaceAll(r.p_brand, "Brand", "BRAND")', "string")}, "loud")
    plain = reader(sf_dir, "part", types, {"brand": ("r.p_brand", "string")}, "plain", indexes={"idx_plain": "non_unique(brand(ignore_case))"})
    return table_of(spark, {"a": lower, "b": plain, "j": lookup_node("loud", "idx_plain", "r.brand", writer("same", {"p_partkey": ("r.p_partkey", "int"), "same_brand": ("count()", "int")}), group=True)}, "same")


@query(f"""select o_orderkey, coalesce(cast(sum({P}) filter (l_returnflag = 'R') as decimal(18,2)), 0) as returned, count(*) filter (l_returnflag = 'R') as n_returned,
coalesce({HALF.format(n=f"cast(sum({P}) filter (l_returnflag = 'R')*100 as hugeint)", d="greatest(1, cast(count(*) filter (l_returnflag = 'R') as hugeint))")}, 0) as avg_returned,
coalesce(min({P}) filter (l_returnflag = 'R'), 0) as least, coalesce(max({P}) filter (l_returnflag = 'R'), 0) as most from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey""")
def agg_if_family(spark, sf_dir):
    c = 'l.flag == "R"'
    fields = {"o_orderkey": ("r.o_orderkey", "int"), "returned": (f"sum_if(l.price, {c})", "decimal2"), "n_returned": (f"count_if({c})", "int"), "avg_returned": (f"avg_if(l.price, {c})", "decimal2"), "least": (f"min_if(l.price, {c})", "decimal2"), "most": (f"max_if(l.price, {c})", "decimal2")}
    return table_of(spark, {"o": orders(sf_dir), "i": items(sf_dir, BY_ORDER), "j": lookup_node("orders", "idx_items", "r.o_orderkey", writer("grouped", fields), group=True)}, "grouped")


def _nations(sf_dir: str) -> dict:
    return {"r": reader(sf_dir, "region", {"r_regionkey": "int", "r_name": "string"}, name="regions"), "n": reader(sf_dir, "nation", {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}, name="nations", indexes={"idx_nations": "non_unique(n_regionkey)"})}


@query("select r_name, string_agg(n_name, ', ' order by n_name) as nations from region join nation on r_regionkey = n_regionkey group by r_name")
def string_agg(spark, sf_dir):
    fields = {"r_name": ("r.r_name", "string"), "nations": ('string_agg(l.n_name, ", ")', "string")}
    return table_of(spark, _nations(sf_dir) | {"j": lookup_node("regions", "idx_nations", "r.r_regionkey", writer("lists", fields), group=True)}, "lists")


@query("select r_name, coalesce(string_agg(n_name, '|' order by n_name) filter (n_nationkey % 2 = 0), '') as nations from region join nation on r_regionkey = n_regionkey group by r_name")
def string_agg_if(spark, sf_dir):
    fields = {"r_name": ("r.r_name", "string"), "nations": ('string_agg_if(l.n_name, "|", l.n_nationkey % 2 == 0)', "string")}
    return table_of(spark, _nations(sf_dir) | {"j": lookup_node("regions", "idx_nations", "r.r_regionkey", writer("lists", fields), group=True)}, "lists")


@query("""select o_orderkey, r_name, c_mktsegment as segment from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def chained_lookup(spark, sf_dir):
    nodes = {
        "o": orders(sf_dir), "c": reader(sf_dir, "customer", {"c_custkey": "int", "c_nationkey": "int", "c_mktsegment": "string"}, name="customers", indexes={"idx_customers": "unique(c_custkey)"}),
        "n": reader(sf_dir, "nation", {"n_nationkey": "int", "n_regionkey": "int"}, name="nations", indexes={"idx_nations": "unique(n_nationkey)"}), "r": reader(sf_dir, "region", {"r_regionkey": "int", "r_name": "string"}, name="regions", indexes={"idx_regions": "unique(r_regionkey)"}),
        "oc": lookup_node("orders", "idx_customers", "r.o_custkey", writer("oc", {"o_orderkey": ("r.o_orderkey", "int"), "segment": ("l.c_mktsegment", "string"), "nation": ("l.c_nationkey", "int")})),
        "on": lookup_node("oc", "idx_nations", "r.nation", writer("ocn", {"o_orderkey": ("r.o_orderkey", "int"), "segment": ("r.segment", "string"), "region": ("l.n_regionkey", "int")})),
        "or": lookup_node("ocn", "idx_regions", "r.region", writer("ocnr", {"o_orderkey": ("r.o_orderkey", "int"), "r_name": ("l.r_name", "string"), "segment": ("r.segment", "string")})),
    }
    return table_of(spark, nodes, "ocnr")


@query(f"select o_orderkey, cast(sum({P}) as decimal(18,2)) as total, count(*) as n from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey having count(*) >= 4 and sum({P}) > 100000")
def having_after_group(spark, sf_dir):
    fields = {"o_orderkey": ("r.o_orderkey", "int"), "total": ("sum(l.price)", "decimal2"), "n": ("count()", "int")}
    return table_of(spark, {"o": orders(sf_dir), "i": items(sf_dir, BY_ORDER), "j": lookup_node("orders", "idx_items", "r.o_orderkey", writer("grouped", fields, "w.n >= 4 && w.total > 100000"), group=True)}, "grouped")


# distinct rows


def _distinct(sf_dir: str, fields: dict, index: str) -> dict:
    return {"i": items(sf_dir), "d": node("distinct_table", "items", writer("keys", fields, indexes={"idx_keys": index}), rerun_policy="fail")}


@query("select distinct l_suppkey from lineitem")
def distinct_single(spark, sf_dir):
    return table_of(spark, _distinct(sf_dir, {"l_suppkey": ("r.l_suppkey", "int")}, "unique(l_suppkey)"), "keys")


@query(f"select l_suppkey, l_returnflag as flag, min((l_orderkey, l_linenumber))[1]::bigint as l_orderkey from lineitem group by l_suppkey, l_returnflag")
def distinct_multi(spark, sf_dir):
    return table_of(spark, _distinct(sf_dir, {"l_suppkey": ("r.l_suppkey", "int"), "flag": ("r.flag", "string"), "l_orderkey": ("r.l_orderkey", "int")}, "unique(l_suppkey,flag)"), "keys")


@query(f"select l_suppkey, count(*) as n, cast(sum({P}) as decimal(18,2)) as total from lineitem group by l_suppkey")
def distinct_then_group(spark, sf_dir):
    nodes = _distinct(sf_dir, {"l_suppkey": ("r.l_suppkey", "int")}, "unique(l_suppkey)")
    nodes["i"]["w"]["indexes"] = {"idx_items": "non_unique(l_suppkey)"}
    return table_of(spark, nodes | {"g": lookup_node("keys", "idx_items", "r.l_suppkey", writer("groups", {"l_suppkey": ("r.l_suppkey", "int"), "n": ("count()", "int"), "total": ("sum(l.price)", "decimal2")}), "left", True)}, "groups")


# files' rows


def _file(spark: SparkSession, sf_dir: str, order: str | None, limit: int | None, having: str | None = None) -> DataFrame:
    columns = [{"name": c, "expression": e, "type": t} for c, e, t in (("o_orderkey", "r.o_orderkey", "int"), ("total", "r.total", "decimal2"), ("status", "r.status", "string"))]
    w = {"url_template": "unwritten", "columns": columns, "having": having} | ({"top": {"order": order} | ({"limit": limit} if limit else {})} if order else {})
    script = build({"nodes": {"o": orders(sf_dir), "f": {"type": "table_file", "r": {"table": "orders"}, "w": w}}})
    return Planner(spark, script).ordered(script.nodes["f"])


FILE_SQL = "select o_orderkey, cast(o_totalprice as decimal(18,2)) as total, o_orderstatus as status from orders"


@query(f"{FILE_SQL} order by 3, 1 limit 100")
def top_k(spark, sf_dir):
    return _file(spark, sf_dir, "status(asc),o_orderkey(asc)", 100)


@query(f"{FILE_SQL} order by 2 desc, 1 limit 100")
def top_k_desc(spark, sf_dir):
    return _file(spark, sf_dir, "total(desc),o_orderkey(asc)", 100)


@query(f"{FILE_SQL} where length(o_orderstatus) = 1 and cast(o_totalprice as decimal(18,2)) >= 300000")
def file_having(spark, sf_dir):
    return _file(spark, sf_dir, None, None, "len(w.status) == 1 && w.total >= 300000")


# custom processors

TAGS = {"brass": 're.MatchString("BRASS", r.p_type)', "small": "r.p_size < 10", "dear": "r.price > 1500", "brand_1": 're.MatchString("^Brand#1", r.p_brand)'}
TAG_SQL = {"brass": "regexp_matches(p_type, 'BRASS')", "small": "p_size < 10", "dear": "cast(p_retailprice as decimal(18,2)) > 1500", "brand_1": "regexp_matches(p_brand, '^Brand#1')"}
TAGGED_SQL = " union all ".join(f"select '{t}' as tag, p_partkey, cast(p_retailprice as decimal(18,2)) as price from part where {c}" for t, c in TAG_SQL.items())


def _tagged(sf_dir: str, indexes: dict | None = None) -> dict:
    types = {"p_partkey": "int", "p_type": "string", "p_size": "int", "p_brand": "string", "p_retailprice": "float"}
    parts = reader(sf_dir, "part", types, {c: (f"r.{c}", t) for c, t in types.items() if c != "p_retailprice"} | {"price": ("decimal2(r.p_retailprice)", "decimal2")}, "parts")
    w = writer("tagged", {"tag": ("p.tag", "string"), "p_partkey": ("r.p_partkey", "int"), "price": ("r.price", "decimal2")}, indexes=indexes)
    return {"p": parts, "t": node("table_custom_tfm_table", "parts", w, custom_proc_type="tag_and_denormalize", p={"tag_field_name": "tag", "tag_criteria": TAGS})}


@query(TAGGED_SQL)
def tag_and_denormalize(spark, sf_dir):
    return table_of(spark, _tagged(sf_dir), "tagged")


@query(f"select tag, count(*) as n, cast(sum(price) as decimal(18,2)) as total, max(price) as most from ({TAGGED_SQL}) group by tag")
def tag_totals(spark, sf_dir):
    nodes = _tagged(sf_dir, {"idx_tagged": "non_unique(tag)"})
    nodes["d"] = node("distinct_table", "tagged", writer("tags", {"tag": ("r.tag", "string")}, indexes={"idx_tags": "unique(tag)"}), rerun_policy="fail")
    fields = {"tag": ("r.tag", "string"), "n": ("count()", "int"), "total": ("sum(l.price)", "decimal2"), "most": ("max(l.price)", "decimal2")}
    return table_of(spark, nodes | {"g": lookup_node("tags", "idx_tagged", "r.tag", writer("totals", fields), "left", True)}, "totals")


CODE = """
from datetime import datetime

def cents(price):
    return int(round(price * 100))

def parity(n):
    return "even" if n % 2 == 0 else "odd"

def year(ts):
    return datetime.fromisoformat(ts).year

def label(n, name):
    return f"{name}:{n}"
"""


def _calculated(spark: SparkSession, sf_dir: str, columns: dict, fields: dict) -> DataFrame:
    first = reader(sf_dir, "orders", some(ORDERS, "o_orderkey", "o_totalprice", "o_orderdate"), {"o_orderkey": ("r.o_orderkey", "int"), "total": ("decimal2(r.o_totalprice)", "decimal2"), "ordered": ("r.o_orderdate", "datetime")}, "orders")
    p = {"python_code": [CODE], "calculated_fields": {f: {"expression": e, "type": t} for f, (e, t) in columns.items()}}
    return table_of(spark, {"o": first, "c": node("table_custom_tfm_table", "orders", writer("made", fields), custom_proc_type="py_calc", p=p)}, "made")


@query("select o_orderkey, (cast(o_totalprice as decimal(18,2)) * 100)::bigint as cents, year(o_orderdate)::bigint as year from orders")
def py_calc_basic(spark, sf_dir):
    return _calculated(spark, sf_dir, {"cents": ("cents(r.total)", "int"), "year": ("year(r.ordered)", "int")}, {"o_orderkey": ("r.o_orderkey", "int"), "cents": ("p.cents", "int"), "year": ("p.year", "int")})


@query("""select o_orderkey, case when (cast(o_totalprice as decimal(18,2)) * 100)::bigint % 2 = 0 then 'even' else 'odd' end as parity,
case when (cast(o_totalprice as decimal(18,2)) * 100)::bigint % 2 = 0 then 'even:' else 'odd:' end || o_orderkey as label from orders""")
def py_calc_chained(spark, sf_dir):
    columns = {"label": ("label(r.o_orderkey, p.parity)", "string"), "parity": ("parity(p.cents)", "string"), "cents": ("cents(r.total)", "int")}
    return _calculated(spark, sf_dir, columns, {"o_orderkey": ("r.o_orderkey", "int"), "parity": ("p.parity", "string"), "label": ("p.label", "string")})


# the query dialect


def _session(spark: SparkSession, sf_dir: str, table: str, key: list[str]) -> Session:
    s = Session(spark)
    s.register(table, spark.read.parquet(f"{sf_dir}/{table}.parquet"), key)
    return s


@query("select c_custkey, c_name, c_acctbal * 2 as twice from customer where c_mktsegment = 'BUILDING' and (c_acctbal > 5000 or c_nationkey < 3)")
def cql_select_where(spark, sf_dir):
    return _session(spark, sf_dir, "customer", ["c_custkey"]).execute("SELECT c_custkey, c_name, c_acctbal * 2 AS twice FROM customer WHERE c_mktsegment = 'BUILDING' AND (c_acctbal > 5000 OR c_nationkey < ?)", 3)


@query("select count(*) as n, count(c_name) as names, floor(avg(c_custkey))::bigint as mean, min(c_name) as first, max(c_nationkey) as last, sum(c_custkey)::bigint as total, count(*) filter (c_acctbal < 0) as debts from customer")
def cql_agg(spark, sf_dir):
    return _session(spark, sf_dir, "customer", ["c_custkey"]).execute("SELECT count(*) AS n, count(c_name) AS names, avg(c_custkey) AS mean, min(c_name) AS first, max(c_nationkey) AS last, sum(c_custkey) AS total, count_if(c_acctbal < 0) AS debts FROM customer")


@query("select s_suppkey, s_name from supplier where s_nationkey in (1, 5, 7) and s_suppkey not in (3, 4)")
def cql_in(spark, sf_dir):
    return _session(spark, sf_dir, "supplier", ["s_suppkey"]).execute("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (1, 5, 7) AND s_suppkey NOT IN ?", (3, 4))


@query("select s_suppkey::varchar as key, trunc(s_acctbal)::bigint as whole, s_nationkey::double as wide from supplier where s_acctbal >= 0")
def cql_cast(spark, sf_dir):
    return _session(spark, sf_dir, "supplier", ["s_suppkey"]).execute("SELECT CAST(s_suppkey AS text) AS key, CAST(s_acctbal AS bigint) AS whole, CAST(s_nationkey AS double) AS wide FROM supplier WHERE s_acctbal >= 0")


@query("select s_suppkey, abs(s_acctbal) as balance from supplier order by s_suppkey desc limit 10")
def cql_order_limit(spark, sf_dir):
    return _session(spark, sf_dir, "supplier", ["s_suppkey"]).execute("SELECT s_suppkey, abs(s_acctbal) AS balance FROM supplier ORDER BY s_suppkey DESC LIMIT 10")


@query("select distinct c_mktsegment from customer")
def cql_distinct(spark, sf_dir):
    return _session(spark, sf_dir, "customer", ["c_custkey"]).execute("SELECT DISTINCT c_mktsegment FROM customer")


@query("select r_regionkey, case when r_regionkey = 2 then 'changed' else r_name end as r_name from region union all select 9, 'new'")
def cql_update(spark, sf_dir):
    return _session(spark, sf_dir, "region", ["r_regionkey"]).execute("UPDATE region SET r_name = 'changed' WHERE r_regionkey = 2; UPDATE region SET r_name = 'new' WHERE r_regionkey = 9; SELECT * FROM region")


@query("select r_regionkey, case when r_regionkey = 1 then null else r_name end as r_name from region where r_regionkey <> 3")
def cql_delete(spark, sf_dir):
    return _session(spark, sf_dir, "region", ["r_regionkey"]).execute("DELETE FROM region WHERE r_regionkey = 3; DELETE r_name FROM region WHERE r_regionkey = 1; SELECT * FROM region")


@query("select r_regionkey, r_name from region union all select 7, 'seven'")
def cql_insert(spark, sf_dir):
    return _session(spark, sf_dir, "region", ["r_regionkey"]).execute("INSERT INTO region (r_regionkey, r_name) VALUES (7, 'seven'); INSERT INTO region (r_regionkey, r_name) VALUES (7, 'again') IF NOT EXISTS; SELECT * FROM region")


# runs


@query("""select run_id, script_node, status from (select user_id as run_id, event_type as script_node, arg_max(case when value > 95 then 3 else 2 end, ts)::integer as status from events group by all)""")
def run_status_rollup(spark, sf_dir):
    """Batch events made of events: of each user a run, of each type a node."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    status = F.when(F.col("value") > 95, policies.FAIL).otherwise(policies.SUCCESS)
    batches = e.select("ts", F.col("user_id").alias("run_id"), F.col("event_type").alias("script_node"), F.lit(0).alias("batch_idx"), F.lit(1).alias("batches_total"), status.alias("status"))
    return node_statuses(batches)


@query("select 0::integer as place, 'o' as script_node union all select 1, 'j'")
def run_affected_nodes(spark, sf_dir):
    nodes = {"o": orders(sf_dir), "i": items(sf_dir, BY_ORDER), "j": lookup_node("orders", "idx_items", "r.o_orderkey", writer("joined", FLAT)), "m": node("table_table", "joined", writer("later", {"k": ("r.o_orderkey", "int")}), start_policy="manual")}
    found = policies.affected(build({"nodes": nodes}), ["o"])
    return spark.createDataFrame([(k, n) for k, n in enumerate(found)], "place int, script_node string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
