import datetime as dt
from decimal import Decimal

import pytest

from weftline.errors import ScriptError
from weftline.operators.distinct import assert_unique, distinct
from weftline.operators.fields import Field
from weftline.operators.keys import Part, bare, parse_index, parse_order
from weftline.operators.lookup import Lookup, lookup
from weftline.operators.pycalc import calculated
from weftline.operators.tags import tagged
from weftline.operators.top import top

LEFT, RIGHT = {"k": "int", "name": "string"}, {"k": "int", "v": "decimal2", "t": "string"}
ON = (("k", Part("k")),)


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c")], "k bigint, name string")
    right = spark.createDataFrame([(1, Decimal("1.00"), "x"), (1, Decimal("2.01"), ""), (2, Decimal("5.00"), "y"), (9, Decimal("7.00"), "z")], "k bigint, v decimal(18,2), t string")
    return left, right


def rows(df):
    return sorted(map(tuple, df.collect()))


def fields(**by_name):
    return [Field(n, *x) for n, x in by_name.items()]


def run(sides, how, columns, having=None):
    return rows(lookup(sides[0], LEFT, sides[1], RIGHT, how, columns, having))


def test_inner_and_left(sides):
    columns = fields(name=("r.name", "string"), v=("l.v * 2", "decimal2", "9.50"), t=("l.t", "string"))
    flat = [("a", Decimal("2.00"), "x"), ("a", Decimal("2.00"), "x"), ("a", Decimal("4.02"), ""), ("a", Decimal("4.02"), ""), ("b", Decimal("10.00"), "y")]
    assert run(sides, Lookup(ON, "inner", False), columns) == flat
    assert run(sides, Lookup(ON, "left", False), columns) == [*flat, ("c", Decimal("9.50"), "")]


def test_grouped_keeps_copies_of_left_rows(sides):
    columns = fields(name=("r.name", "string"), total=("sum(l.v)", "decimal2", "-1"), mean=("avg(l.v)", "decimal2"), n=("count()", "int"), least=("min(l.t)", "string"), all=('string_agg(l.t, "-")', "string"))
    inner = [("a", Decimal("3.01"), Decimal("1.51"), 2, "x", "-x")] * 2 + [("b", Decimal("5.00"), Decimal("5.00"), 1, "y", "y")]
    assert run(sides, Lookup(ON, "inner", True), columns) == inner
    assert run(sides, Lookup(ON, "left", True), columns) == [*inner, ("c", Decimal("-1.00"), Decimal("0.00"), 0, "", "")]


def test_grouped_over_both_sides(sides):
    columns = fields(name=("r.name", "string"), total=("sum(l.v + r.k)", "decimal2"), n=("count_if(l.v > r.k)", "int"))
    assert run(sides, Lookup(ON, "left", True), columns) == [("a", Decimal("5.01"), 1), ("a", Decimal("5.01"), 1), ("b", Decimal("7.00"), 1), ("c", Decimal("0.00"), 0)]


def test_filter_is_part_of_the_join(sides):
    columns = fields(name=("r.name", "string"), n=("count()", "int"))
    assert run(sides, Lookup(ON, "left", True, 'l.t != ""'), columns) == [("a", 1), ("a", 1), ("b", 1), ("c", 0)]
    assert run(sides, Lookup(ON, "left", True, 'l.t == "none"'), columns, "w.n == 0") == [("a", 0), ("a", 0), ("b", 0), ("c", 0)]


def test_int_mean_is_floored_and_no_rows_give_zero(spark):
    left = spark.createDataFrame([(1,)], "k bigint")
    right = spark.createDataFrame([(1, -3), (1, -4)], "k bigint, v bigint")
    columns = fields(m=("avg(l.v)", "int"), none=("sum_if(l.v, l.v > 0)", "int"), least=("min_if(l.v, l.v > 0)", "int"), mean=("avg_if(l.v, l.v > 0)", "int"))
    assert rows(lookup(left, {"k": "int"}, right, {"k": "int", "v": "int"}, Lookup(ON, "inner", True), columns)) == [(-4, 0, 0, 0)]


@pytest.mark.parametrize(
    "how, columns, having",
    [
        (Lookup(ON, "inner", True), fields(v=("l.v", "decimal2")), None), (Lookup(ON, "inner", False), fields(v=("sum(l.v)", "decimal2")), None), (Lookup(ON, "inner", True), fields(v=("sum(l.v) * 2", "decimal2")), None),
        (Lookup(ON, "inner", False, "r.k > 1"), fields(v=("l.v", "decimal2")), None), (Lookup(ON, "inner", False), fields(v=("l.v", "int")), None), (Lookup(ON, "inner", False), fields(v=("l.v", "decimal2")), "w.x > 1"), (Lookup((("name", Part("k")),), "inner", False), fields(v=("l.v", "decimal2")), None),
        (Lookup(ON, "inner", True), fields(v=("sum(l.t)", "string")), None), (Lookup(ON, "inner", True), fields(v=("string_agg(l.t, l.t)", "string")), None), (Lookup(ON, "inner", False), fields(v=("l.nothing", "int")), None),
    ],
)
def test_lookup_errors(sides, how, columns, having):
    with pytest.raises(ScriptError):
        run(sides, how, columns, having)


def test_strict_keys(spark):
    left = spark.createDataFrame([("Ábc ",), ("abd",)], "k string")
    right = spark.createDataFrame([("ABC", 1), ("x" * 70, 2)], "k string, v bigint")
    how = Lookup((("k", Part("k", ignore_case=True)),), "inner", False, strict_keys=True)
    assert rows(lookup(left, {"k": "string"}, right, {"k": "string", "v": "int"}, how, fields(k=("r.k", "string"), v=("l.v", "int")))) == [("Ábc ", 1)]
    assert bare("Áé") == "Ae"


def test_index_expressions():
    assert parse_index("unique(a, b(desc,ignore_case,32))").parts == (Part("a"), Part("b", True, True, 32))
    assert not parse_index("non_unique(a(case_sensitive))").unique
    for bad in ("a", "unique()", "unique(a(up))", "unique(a b)"):
        with pytest.raises(ScriptError):
            parse_index(bad)
    assert parse_order("a(5)")[0].length == 16


def test_distinct_takes_the_least_row(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k bigint, v string")
    assert rows(distinct(df, {"k": "int", "v": "string"}, parse_index("unique(k)"))) == [(1, "a"), (2, "c")]
    with pytest.raises(ScriptError):
        assert_unique(df, {"k": "int", "v": "string"}, "idx", parse_index("unique(k)"))
    assert_unique(df, {"k": "int", "v": "string"}, "idx", parse_index("unique(k,v)"))


def test_top(spark):
    df = spark.createDataFrame([(1, "b"), (2, "A"), (3, "c")], "k bigint, v string")
    types = {"k": "int", "v": "string"}
    assert [r.k for r in top(df, "v(desc,ignore_case)", types, 2).collect()] == [3, 1]
    assert [r.k for r in top(df, "v(asc)", types).collect()] == [2, 1, 3]
    assert "TakeOrderedAndProject" in top(df, "k(asc)", types, 2)._jdf.queryExecution().toString()
    for order, limit in (("x(asc)", 1), ("k(asc)", 0)):
        with pytest.raises(ScriptError):
            top(df, order, types, limit)


def test_tags(spark):
    df = spark.createDataFrame([(1, "red car"), (2, "blue"), (3, "red")], "k bigint, v string")
    criteria = {"red": 're.MatchString("red", r.v)', "one": "r.k == 1"} | {f"t{i}": f"r.k == {i + 1000}" for i in range(250)}
    assert rows(tagged(df, {"k": "int", "v": "string"}, "tag", criteria).select("k", "p__tag")) == [(1, "one"), (1, "red"), (3, "red")]
    for bad in ({}, {"x": "r.k"}):
        with pytest.raises(ScriptError):
            tagged(df, {"k": "int", "v": "string"}, "tag", bad)


CODE = """
def half(x):
    return x / 2
def later(ts, days=1):
    from datetime import datetime, timedelta
    return (datetime.fromisoformat(ts) + timedelta(days=days)).isoformat(timespec="milliseconds")
"""


def test_python_formulas(spark):
    df = spark.createDataFrame([(5, Decimal("1.05"), dt.datetime(2020, 1, 1, 2))], "k bigint, d decimal(18,2), t timestamp_ntz")
    types = {"k": "int", "d": "decimal2", "t": "datetime"}
    columns = {"q": ("half(p.h)", "float"), "h": ("half(r.k)", "int"), "m": ("half(r.d)", "decimal2"), "t2": ("later(r.t, 2)", "datetime"), "s": ("str(len(str(-r.k)))", "string"), "b": ("bool(r.k)", "bool")}
    made = calculated(df, types, [CODE], columns).first()
    assert (made.p__q, made.p__h, made.p__m, made.p__t2, made.p__s, made.p__b) == (1.25, 2, Decimal("0.53"), dt.datetime(2020, 1, 3, 2), "2", True)
    for bad in ("eval(r.k)", "half(r.k, 1)", "half(r.none)", "half(p.x)", "r.k + 1"):
        with pytest.raises(ScriptError):
            calculated(df, types, [CODE], {"x": (bad, "int")})
