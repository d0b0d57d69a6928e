import datetime as dt
import struct

import numpy as np
import pytest

from weftline.cql import pages, session, token
from weftline.cql.session import Session
from weftline.errors import ScriptError


@pytest.fixture()
def s(spark):
    s = Session(spark)
    s.execute("CREATE KEYSPACE IF NOT EXISTS ks WITH REPLICATION = {'class': 'SimpleStrategy'}; USE ks")
    s.execute("CREATE TABLE t (pk int, ck int, name text, v double, n counter, ok boolean, PRIMARY KEY ((pk), ck)) WITH CLUSTERING ORDER BY (ck DESC)")
    for pk, ck, name, v in ((1, 1, "a", 1.5), (1, 2, "b", None), (2, 1, None, -3.0)):
        s.execute("INSERT INTO t (pk, ck, name, v) VALUES (?, ?, ?, ?)", pk, ck, name, v)
    return s


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_select(s):
    assert rows(s.execute("SELECT pk, ck, name FROM t")) == [(1, 2, "b"), (1, 1, "a"), (2, 1, None)]
    assert rows(s.execute("SELECT ck FROM t WHERE pk = 1 ORDER BY ck ASC")) == [(1,), (2,)]
    assert rows(s.execute("SELECT pk + ck * 2 AS x, ck / 2 FROM ks.t WHERE pk = 1 LIMIT 1")) == [(5, 1)]
    assert rows(s.execute("SELECT DISTINCT pk FROM t ORDER BY pk DESC")) == [(2,), (1,)]
    assert s.execute("SELECT *, pk AS again FROM t").columns == ["pk", "ck", "name", "v", "n", "ok", "again"]


def test_null_is_two_valued(s):
    assert rows(s.execute("SELECT pk FROM t WHERE name != 'a' AND ck = 1")) == [(2,)]
    assert rows(s.execute("SELECT pk FROM t WHERE name = NULL")) == [(2,)]
    assert rows(s.execute("SELECT pk FROM t WHERE v < 100 OR v >= 100")) == [(1,), (2,)]
    assert rows(s.execute("SELECT pk FROM t WHERE name NOT IN ('a', 'b')")) == [(2,)]
    assert rows(s.execute("SELECT ck FROM t WHERE name IN ?", ["a", "b"])) == [(2,), (1,)]


def test_aggregates(s):
    assert rows(s.execute("SELECT count(*), count(v), sum(v), avg(ck), min(name), max(v), pk FROM t")) == [(3, 2, -1.5, 1, "a", 1.5, 1)]
    assert rows(s.execute("SELECT count(*), sum(v), avg(ck), min(name) FROM t WHERE pk = 99")) == [(0, 0.0, 0, "")]
    assert rows(s.execute("SELECT count_if(v < 0), sum_if(ck, pk = 1), string_agg(name, '+') FROM t")) == [(1, 3, "a+b")]


def test_functions(s):
    assert rows(s.execute("SELECT abs(v), round(v), CAST(v AS int), CAST(ck AS text), CAST(ck > 0 AS text) FROM t WHERE v = -3.0")) == [(3.0, -3.0, -3, "1", "true")]
    got = s.execute("SELECT exp(0), log(1), log10(100), current_date(), current_timestamp(), token(pk), now(), totimestamp(1) FROM t WHERE pk = 2").first()
    assert got[:3] == (1.0, 0.0, 2.0) and got[7] == dt.datetime(1970, 1, 2) and len(got[6]) == 36
    assert len(rows(s.execute("SELECT pk FROM t WHERE token(pk) != 0"))) == 3


def test_changes(s):
    with pytest.raises(ScriptError):
        s.execute("INSERT INTO t (pk, ck) VALUES (1, 1)")
    assert rows(s.execute("INSERT INTO t (pk, ck) VALUES (1, 1) IF NOT EXISTS"))[0][:3] == (False, 1, 1)
    assert rows(s.execute("INSERT INTO t (pk, ck) VALUES (5, 5) IF NOT EXISTS")) == [(True,)]
    s.execute("UPDATE t SET name = 'z', v = v + 1 WHERE pk = 1 AND ck = 1")
    assert rows(s.execute("SELECT name, v FROM t WHERE pk = 1 AND ck = 1")) == [("z", 2.5)]
    s.execute("UPDATE t SET n = n + 2 WHERE pk = 8 AND ck = 1")
    s.execute("UPDATE t SET n = n + 2 WHERE pk = 8 AND ck = 1")
    assert rows(s.execute("SELECT n FROM t WHERE pk = 8")) == [(4,)]
    assert rows(s.execute("UPDATE t SET name = 'q' WHERE pk = 1 AND ck = 1 IF name = 'other'"))[0][0] is False
    assert rows(s.execute("UPDATE t SET name = 'q' WHERE pk = 1 AND ck = 1 IF name = 'z'")) == [(True,)]
    assert rows(s.execute("UPDATE t SET name = 'q' WHERE pk = 77 AND ck = 1 IF EXISTS")) == [(False,)]
    s.execute("DELETE name FROM t WHERE pk = 1 AND ck = 1; DELETE FROM t WHERE pk = 2")
    assert rows(s.execute("SELECT pk, ck, name FROM t WHERE pk < 5")) == [(1, 2, "b"), (1, 1, None)]
    s.execute("TRUNCATE t")
    assert rows(s.execute("SELECT count(*) FROM t")) == [(0,)]
    s.execute("DROP TABLE t; DROP TABLE IF EXISTS t; DROP KEYSPACE ks")
    with pytest.raises(ScriptError):
        s.execute("SELECT * FROM t")


def test_tokens_are_murmur3(spark, s):
    guava = spark.sparkContext._jvm.com.google.common.hash.Hashing.murmur3_128()
    for n in (0, 1, 7, 8, 9, 15, 16, 17, 31, 32, 100):
        data = bytes(range(100, 100 + n))
        assert token.murmur3(data) == guava.hashBytes(bytearray(data)).asLong()
    numbers = [0, 1, -1, 2**40, -(2**63), 2**63 - 1]
    assert token.of_eight_bytes(np.array(numbers)).tolist() == [guava.hashLong(n).asLong() for n in numbers]
    got = rows(s.execute("SELECT token(pk), token(name), token(v), token(ok) FROM t WHERE pk = 1 AND ck = 1"))[0]
    assert got == (guava.hashLong(1).asLong(), token.murmur3(b"a"), guava.hashBytes(bytearray(struct.pack("<d", 1.5))).asLong(), None)


def test_conditions_reach_the_files(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 1.5D as v", "cast(id as string) as name").write.parquet(f"{tmp_path}/t")
    s = Session(spark)
    s.register("t", spark.read.parquet(f"{tmp_path}/t"), ["id"])
    made = s.execute("SELECT id FROM t WHERE v > 3.0 AND (id < 9 OR name = '9')")
    plan = made._jdf.queryExecution().toString()
    assert "GreaterThan(v,3.0)" in plan and "Or(LessThan(id,9)" in plan and made.count() == 7


def test_inserted_rows_take_no_jobs(spark):
    s = Session(spark)
    s.execute("CREATE TABLE w (k int PRIMARY KEY, v int)")
    tracker = spark.sparkContext.statusTracker()
    before = max(tracker.getJobIdsForGroup(None), default=-1)
    for k in range(30):
        s.execute("INSERT INTO w (k, v) VALUES (?, ?)", k, k)
    assert max(tracker.getJobIdsForGroup(None), default=-1) == before
    made = s.execute("SELECT * FROM w")
    assert made.count() == 30 and made._jdf.queryExecution().analyzed().toString().count("Union") <= 1
    with pytest.raises(ScriptError):
        s.execute("INSERT INTO w (k, v) VALUES (3, 3)")
    s.execute("DELETE FROM w WHERE k = 3; INSERT INTO w (k, v) VALUES (3, 4); UPDATE w SET v = 9 WHERE k = 77")
    with pytest.raises(ScriptError):
        s.execute("INSERT INTO w (k, v) VALUES (77, 3)")
    assert rows(s.execute("SELECT v FROM w WHERE k IN (3, 77)")) == [(4,), (9,)]


def test_pages(s):
    assert s.pages("SELECT pk, ck FROM t", size=2) == ([(1, 2), (1, 1)], 2)
    assert s.pages("SELECT pk, ck FROM t", size=2, state=2) == ([(2, 1)], None)


def test_pages_read_each_row_once(spark, monkeypatch):
    """Few jobs, and as many rows at the driver as there are, whatever the number of pages and of tasks."""
    came = []
    monkeypatch.setattr(pages, "READ_AHEAD", 100)
    monkeypatch.setattr(pages.Pages, "_read", lambda self, a, b, f=pages.Pages._read: came.append(f(self, a, b)) or came[-1])
    monkeypatch.setattr(session, "MANY_PAGES", 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    s, got, state, tracker = Session(spark), [], 0, spark.sparkContext.statusTracker()
    s.register("t", spark.range(1000).selectExpr("999 - id as id", "if(id % 3 = 0, null, cast(id as string)) as name"), ["id"])
    before = max(tracker.getJobIdsForGroup(None), default=-1)
    try:
        while state is not None:
            page, state = s.pages("SELECT id, name, id, NULL FROM t", size=7, state=state)
            got += page
        assert [tuple(r) for r in got] == [(k, None if (999 - k) % 3 == 0 else str(999 - k), k, None) for k in range(1000)]
        assert len(got[0].__fields__) == 4 and sum(map(len, came)) < 1100 and not s.paged
        assert max(tracker.getJobIdsForGroup(None)) - before < 40
        assert len(s.pages("SELECT id FROM t", size=2, state=995)[0]) == 2 and s.pages("SELECT id FROM t", size=9, state=2000) == ([], None)
        s.pages("SELECT id FROM t", size=5)
        s.execute("DELETE FROM t WHERE id = 6; INSERT INTO t (id) VALUES (5000)")
        assert s.pages("SELECT id FROM t", size=5, state=5) == ([(5,), (7,), (8,), (9,), (10,)], 10)
        assert s.pages("SELECT id FROM t", size=50, state=990) == ([*((k,) for k in range(991, 1000)), (5000,)], None)
        for k in range(5):
            s.pages(f"SELECT id FROM t WHERE id > {k}", size=5)
        assert len(s.paged) == 2 and s.pages("SELECT id FROM t WHERE id > 0", size=1, state=5) == ([(7,)], 6)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(
    "text",
    ["SELECT JSON * FROM t", "SELECT pk FROM t GROUP BY pk", "SELECT pk FROM t LIMIT 1 OFFSET 2", "SELECT pk FROM t ALLOW FILTERING", "SELECT pk FROM t PER PARTITION LIMIT 1", "SELECT pk FROM t ORDER BY ck", "SELECT pk FROM t ORDER BY name ASC", "SELECT pk FROM t WHERE name ~ 'a'", "SELECT none FROM t", "SELECT count(*) + 1 FROM t",
     "SELECT CAST(name AS int) FROM t", "INSERT INTO t (pk) VALUES (1)", "INSERT INTO t (pk, ck) VALUES (1)", "INSERT INTO t (pk, ck) VALUES ('x', 1)", "CREATE TABLE t (a int PRIMARY KEY)", "CREATE TABLE u (a int)", "CREATE TABLE u (a strange PRIMARY KEY)", "USE nothing", "DELETE ck FROM t WHERE pk = 1", "GRANT x", "SELECT pk FROM t WHERE pk = ?", "UPDATE t SET name = 'x' WHERE pk = 99"],
)
def test_errors(s, text):
    with pytest.raises(ScriptError):
        s.execute(text)
