import datetime as dt
import math
from decimal import Decimal

import pytest

from weftline.errors import ScriptError
from weftline.functions.compile import Compiler, fields
from weftline.functions.formats import pattern, sprintf
from weftline.functions.parser import Binary, parse, references
from weftline.types import stored

ROW = [("ab", 7, 2.5, True, Decimal("10.05"), dt.datetime(2020, 2, 3, 4, 5, 6, 789000))]
KINDS = {"s": "string", "i": "int", "f": "float", "b": "bool", "d": "decimal2", "t": "datetime"}


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame(ROW, "s string, i bigint, f double, b boolean, d decimal(18,2), t timestamp_ntz").cache()


def value(row, text, rounded=True):
    made = Compiler(fields("r", KINDS), rounded)(text)
    return made.kind, row.select(stored(made.column, made.kind)).first()[0]


@pytest.mark.parametrize(
    "text, kind, expected",
    [
        ("1 + 2 * 3", "int", 7), ("(1 + 2) * 3", "int", 9), ("-7 / 2", "int", -3), ("-7 % 2", "int", -1), ("r.i - 10", "int", -3), ("7 / 2.0", "float", 3.5), ("r.f * 2", "float", 5.0),
        ("r.d * 2", "decimal2", Decimal("20.10")), ("r.d / 3", "decimal2", Decimal("3.35")), ("r.d * decimal2(0.5)", "decimal2", Decimal("5.03")), ("-r.d * decimal2(0.5)", "decimal2", Decimal("-5.03")), ("r.i + r.d", "decimal2", Decimal("17.05")), ("r.d + 0.5", "float", 10.55),
        ('r.s + "c"', "string", "abc"), ("`a\"b`", "string", 'a"b'), (r'"a\nb"', "string", r"a\nb"), ("r.i > 6 && r.b", "bool", True), ("!r.b || r.i != 7", "bool", False), ('r.s < "b"', "bool", True), ("r.b == true", "bool", True),
        ("9223372036854775808 / 1000", "decimal2", Decimal("9223372036854775.81")),
        ("math.Sqrt(r.i + 2)", "float", 3.0), ("math.Round(-2.5)", "float", -3.0), ("math.Round(2.5)", "float", 3.0), ('len("é")', "int", 2), ("int(3.99)", "int", 3), ('int("-012")', "int", -12), ("int(r.b)", "int", 1), ('float("1.5")', "float", 1.5), ("decimal2(1.005)", "decimal2", Decimal("1.01")),
        ("string(r.d)", "string", "10.05"), ("string(decimal2(1.50))", "string", "1.5"), ("string(1.0)", "string", "1"), ("string(1000000.0 * 1000000.0 * 10000000000.0)", "string", "1e+22"), ("string(r.b)", "string", "true"), ("string(12345678.5)", "string", "12345678.5"),
        ("int.iif(r.b, 1, 2)", "int", 1), ('string.iif(r.i < 0, "x", "y")', "string", "y"), ("float.iif(r.b, 1.0, 2.0)", "float", 1.0), ("decimal2.iif(!r.b, r.d, decimal2(2))", "decimal2", Decimal("2.00")),
        ('time.Parse("2006-01-02 15:04:05", "2021-05-06 07:08:09")', "datetime", dt.datetime(2021, 5, 6, 7, 8, 9)), ('time.Parse("2006-01-02T15:04:05.000-07:00", "2021-05-06T07:08:09.123+02:00")', "datetime", dt.datetime(2021, 5, 6, 5, 8, 9, 123000)),
        ('time.Format(r.t, "Mon Jan 02 03:04 PM 2006")', "string", "Mon Feb 03 04:05 AM 2020"), ("time.Unix(r.t)", "int", 1580702706), ("time.UnixMilli(r.t)", "int", 1580702706789), ("time.Before(r.t, r.t)", "bool", False),
        ("time.DiffMilli(r.t, time.Date(2020, time.February, 3, 4, 5, 5, 0, time.UTC))", "int", 1789), ('time.Date(2020, 1, 31 + 1, 0, 0, 0, 0, time.FixedZone("x", 3600))', "datetime", dt.datetime(2020, 1, 31, 23)),
        ('re.MatchString("^a.$", r.s)', "bool", True), ('strings.ReplaceAll(r.s, "a", "xx")', "string", "xxb"), ('fmt.Sprintf("%05d|%s|%.1f|%t|%%", r.i, r.s, r.f, r.b)', "string", "00007|ab|2.5|true|%"), ('fmt.Sprintf("%v-%s", r.d, decimal2(1.50))', "string", "10.05-1.5"),
    ],
)
def test_values(row, text, kind, expected):
    assert value(row, text) == (kind, expected)


def test_division_of_floats_by_zero(row):
    assert value(row, "1.0 / 0")[1] == math.inf
    assert value(row, "-1.0 / 0")[1] == -math.inf
    assert math.isnan(value(row, "0.0 / 0")[1])


@pytest.mark.parametrize("text", ["1 / (r.i - 7)", "r.d / (r.i - 7)", 'int(r.s)', "r.i * 9223372036854775807", 'int(" 1")'])
def test_values_that_fail_the_job(row, text):
    with pytest.raises(Exception, match="DIVI|OVERFLOW|overflow|no int"):
        value(row, text)


@pytest.mark.parametrize(
    "text",
    ["r.x", "q.i", "r.s + 1", "r.b < true", "r.f % 2", "!r.i", "foo(1)", "1 +", "(1", "len(1)", "int.iif(r.b, 1, 2.0)", "1 2", 'time.Parse(r.s, r.s)', 'fmt.Sprintf("%d", r.s)', 'fmt.Sprintf("%d %d", 1)', "r.s == 1", 'time.Parse("15:04", "10:00")', "#"],
)
def test_errors(row, text):
    with pytest.raises(ScriptError):
        value(row, text)


def test_no_rounding_outside_of_fields(row):
    assert row.where(Compiler(fields("r", KINDS))("r.d * decimal2(0.333) > decimal2(3.346)").column).count() == 1
    assert row.where(Compiler(fields("r", KINDS), True)("r.d * decimal2(0.333) > decimal2(3.346)").column).count() == 1
    assert row.where(Compiler(fields("r", KINDS), True)("r.d * decimal2(0.3335) > decimal2(3.3501)").column).count() == 0


def test_parser():
    assert parse("a.b || c.d && e.f") == parse("a.b || (c.d && e.f)")
    assert parse("1 - 2 - 3") == Binary("-", parse("1 - 2"), parse("3"))
    assert [str(n) for n in references(parse('f(r.a, g.h(l.b) + 1) && w.c == "x.y"'))] == ["r.a", "l.b", "w.c"]


def test_layouts():
    assert pattern("2006-01-02T15:04:05.000-07:00") == "yyyy-MM-dd'T'HH:mm:ss.SSSxxx"
    with pytest.raises(ScriptError):
        pattern("2006 7")
    with pytest.raises(ScriptError):
        sprintf("%d", [])
