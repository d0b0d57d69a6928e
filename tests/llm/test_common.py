import pyarrow as pa
import pytest

from weftline.llm import common


def test_blocks_of_texts():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 30, "", "c"]})
    assert list(common.text_blocks(batch, block=12)) == [(0, ["a" * 10, ""]), (2, ["b" * 30]), (3, ["", "c"])]
    assert list(common.text_blocks(batch.slice(0, 0))) == []


def test_saved_tables(spark):
    df = common.save(spark.range(3).toDF("k"), "t")
    assert sorted(r.k for r in df.collect()) == [0, 1, 2] and common.shared_dir(spark) in df._weftline_path
    common.drop(df)
    fs, where = common._path(spark, df._weftline_path)
    assert not fs.exists(where)


def test_temporary_tables(spark):
    kept = []
    with common.temporary_tables(spark, kept):
        gone = common.save(spark.range(3), "a")
        kept.append(common.save(spark.range(4), "b"))
    there = [common._path(spark, df._weftline_path) for df in (gone, kept[0])]
    assert [fs.exists(where) for fs, where in there] == [False, True] and kept[0].count() == 4


def test_a_session_that_names_no_folder():
    class Conf:
        def get(self, key, default):
            return default

    def session(master):
        return type("S", (), {"conf": Conf(), "sparkContext": type("C", (), {"applicationId": "app-1", "master": master})})

    assert common.shared_dir(session("local[4]")) == common.shared_dir(session("local"))
    assert common.shared_dir(session("local[*]")).startswith("file:///")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            common.shared_dir(session(master))


def test_nested_temporary_tables(spark):
    """Equal lists of what they wrote are told apart."""
    with common.temporary_tables(spark, []):
        with common.temporary_tables(spark, []):
            inner = common.save(spark.range(2), "t")
        outer = common.save(spark.range(3), "t")
    for df in (inner, outer):
        fs, where = common._path(spark, df._weftline_path)
        assert not fs.exists(where)
    assert common._OPEN == []
