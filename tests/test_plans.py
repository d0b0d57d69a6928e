"""What plans look like."""

from weftline import queries


def plan(df):
    return df._jdf.queryExecution().toString()


def test_having_reaches_the_parquet_scan(spark, tmp_path):
    rows = [(1, 5.0, "a"), (2, None, "b"), (None, 7.0, None), (4, 9.0, "d")]
    spark.createDataFrame(rows, "k bigint, v double, s string").write.parquet(f"{tmp_path}/t.parquet")
    node = queries.reader(str(tmp_path), "t", {"k": "int", "v": "float", "s": "string"}, having='w.k < 3 && 0.0 <= w.v && w.s != "a"')
    df = queries.table_of(spark, {"r": node}, "t_t")
    assert "LessThan(k,3)" in plan(df) and "GreaterThanOrEqual(v,0.0)" in plan(df)
    assert sorted(map(tuple, df.collect())) == [(0, 7.0, ""), (2, 0.0, "b")]


def test_only_used_columns_are_read(spark):
    df = queries.QUERIES["distinct_single"](spark, "/root/testdata/sf0.001")
    assert "ReadSchema: struct<l_suppkey:bigint>" in plan(df)


def test_grouped_lookup_aggregates_before_the_join(spark):
    text = plan(queries.QUERIES["lookup_left_grouped"](spark, "/root/testdata/sf0.001")).split("== Physical Plan ==")[1]
    assert text.index("Join") < text.index("Aggregate") and text.count("Join") == 1 and "Python" not in text


def test_distinct_needs_no_window(spark):
    text = plan(queries.QUERIES["distinct_multi"](spark, "/root/testdata/sf0.001"))
    assert "Window" not in text and "partial_min" in text


def test_grouped_lookup_of_distinct_keys_is_one_grouping(spark):
    nodes = queries._distinct("/root/testdata/sf0.001", {"l_suppkey": ("r.l_suppkey", "int")}, "unique(l_suppkey)")
    nodes["i"]["w"]["indexes"] = {"idx_items": "non_unique(l_suppkey)"}
    look = lambda where: queries.lookup_node("keys", "idx_items", "r.l_suppkey", queries.writer("g", {"k": ("r.l_suppkey", "int"), "n": ("count()", "int"), "both": ("sum(l.l_orderkey + r.l_suppkey)", "int")}, "w.n > 1"), "inner", True, where)
    fused = queries.table_of(spark, nodes | {"g": look(None)}, "g")
    joined = queries.table_of(spark, nodes | {"g": look("l.l_orderkey >= 0")}, "g")
    assert "Join" not in plan(fused) and "Join" in plan(joined)
    assert sorted(map(tuple, fused.collect())) == sorted(map(tuple, joined.collect()))
