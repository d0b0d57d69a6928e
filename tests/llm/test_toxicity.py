import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from weftline.llm import toxicity as module
from weftline.llm.toxicity import FILTERS, Network, _pack, _unpack, calibrate, fit, mild, toxicity, train
from weftline.llm.words import hashed


@pytest.fixture(scope="module")
def tables(make, spark, prose):
    """Texts of which every fourth has a bad word; labels for most, and odd rows."""
    texts = [(i, prose(60, i) + (" such a vilewretch he is " if i % 4 == 0 else " ") + prose(30, i + 5000)) for i in range(600)]
    docs = make(*texts, (700, None), (701, ""), (None, "vilewretch"), (0, texts[0][1]))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(500)] + [(0, 1, 0), (None, 1, 1), (3, 1, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_documents(tables):
    rows = {r.doc_id: r for r in toxicity(*tables).collect()}
    assert len(rows) == 603 and all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items() if i is not None)
    held = [r for i, r in rows.items() if i is not None and i < 600 and r.held_out]
    assert len(held) > 100 and np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97
    assert all(r.predicted == (r.score >= 0.3) and r.flagged == (r.score >= r.lang_threshold) for r in rows.values())
    assert rows[700].score == rows[701].score and not rows[None].held_out


def test_filter(tables):
    docs, labels = tables
    kept = mild(docs, labels)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and 700 in ids
    assert np.mean([i % 4 != 0 for i in ids if i is not None and i < 600]) > 0.97 and sum(i is not None and i < 600 and i % 4 != 0 for i in ids) > 435


def test_same_outcome_twice_and_no_use_of_language_or_id(tables):
    docs, labels = tables
    net = fit(docs, labels)
    again = fit(docs.withColumn("source", docs["lang"]), labels)
    assert np.array_equal(net.scores(["such a vilewretch", "x"]), again.scores(["such a vilewretch", "x"]))
    other = {r.doc_id: r.score for r in toxicity(docs.selectExpr("doc_id", "text", "'zz' as lang"), labels).collect() if r.doc_id is not None}
    for r in toxicity(docs, labels).collect():
        assert r.doc_id is None or abs(other[r.doc_id] - r.score) < 1e-9


def test_without_labels(make, tables):
    docs, labels = tables
    (score,) = {r.score for r in toxicity(docs, labels.limit(0)).collect()}
    assert score == pytest.approx(1e-6, rel=0.1)
    assert toxicity(docs.limit(0), labels).collect() == []


def test_pooling_equals_a_plain_one():
    r = np.random.RandomState(1)
    net = Network.new()
    net.embed[:] = r.normal(0, 1, net.embed.shape)
    texts = ["a b c d e", "", "one", "x y " * 30]
    hashes, first = hashed(texts)
    got = net.pooled(hashes, first)
    rows = net.rows(hashes)
    for t in range(len(texts)):
        own = slice(first[t], first[t + 1])
        x = net.embed[0][rows[0][own]] + net.embed[1][rows[1][own]]
        x = np.concatenate([np.zeros((3, 8), np.float32), x, np.zeros((3, 8), np.float32)])
        for k, kernel in enumerate(net.kernels):
            w = len(kernel)
            z = [sum(x[i + j] @ kernel[j] for j in range(w)) for i in range(len(x) - 3)]
            assert np.allclose(got[t, FILTERS * k : FILTERS * (k + 1)], np.maximum(np.max(z, axis=0) + net.biases[k], 0), atol=1e-4)


def test_words():
    hashes, first = hashed(["Ab, ab-AB", "", "é x", "longerword longerthing"])
    assert first.tolist() == [0, 3, 3, 5, 7] and hashes[0] == hashes[1] == hashes[2] and hashes[5] >> np.uint64(32) == hashes[6] >> np.uint64(32) and hashes[5] != hashes[6]
    assert hashed([])[1].tolist() == [0] and hashed(["", " "])[1].tolist() == [0, 0, 0]


def test_one_class_trains_nothing():
    net = train(["a", "b"], np.array([0.0, 0.0], np.float32))
    calibrate(net, ["a"], np.array([0.0]), ["en"], 0.25)
    assert net.scores(["whatever"])[0] == pytest.approx(0.25)


def test_very_long_texts(make, tables, prose):
    """They are scored whole, wherever the word is, and never come to the driver to learn from."""
    docs, labels = tables
    long = make((800, prose(30_000, 1) + " such a vilewretch he is " + prose(30_000, 2)), (801, prose(60_000, 3)), (4, prose(60_000, 4)), (802, "x" * 500_000))
    rows = {r.doc_id: r for r in toxicity(docs.where("doc_id <> 4").union(long), labels).collect()}
    assert rows[800].predicted == 1 and rows[801].predicted == 0 and rows[802].predicted == 0


def test_scores_equal_the_network_by_itself(tables):
    docs, labels = tables
    net = fit(docs, labels)
    for r in toxicity(docs, labels).join(docs.select("doc_id", "text").distinct(), "doc_id").limit(40).collect():
        assert r.score == pytest.approx(net.scores([r.text or ""])[0], abs=1e-6)


def test_learns_from_every_labelled_row(make, spark, prose):
    """A word that stands only in rows beyond the first 2,500 toxic ones in the order of their hashes, and one only in texts over 20,000 characters."""
    ids = [r.id for r in spark.range(4200).where(F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2).orderBy(F.xxhash64("id", F.lit("sample")), "id").collect()]
    toxic, late, long = ids[:2900], set(ids[2500:2900]), range(10_000, 10_080)
    texts = [(i, f"{prose(6, i, 60)} {'latecurse' if i in late else 'vilewretch'} {prose(5, i + 1, 60)}") for i in toxic]
    texts += [(i, prose(12, i, 60)) for i in range(20_000, 20_400)]
    texts += [(i, f"{prose(4000, i, 60)} {'longcurse ' if i % 2 else ''}{prose(10, i + 1, 60)}") for i in long]
    labels = [(i, 1, 1) for i in toxic] + [(i, 1, 0) for i in range(20_000, 20_400)] + [(i, 1, i % 2) for i in long]
    assert all(len(t) > 20_000 for i, t in texts if i in long)
    net = fit(make(*texts, clash=False), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    plain, *bad = net.scores([prose(12, 1, 60), *(f"{prose(6, 2, 60)} {w} {prose(5, 3, 60)}" for w in ("vilewretch", "latecurse", "longcurse"))])
    assert min(bad[:2]) > 0.9 and bad[2] > plain + 0.2


def test_shards_and_scans(make, tables, spark, monkeypatch):
    """Many shards, blocks and scans of labels teach what one does, whatever the partitions of the input."""
    docs, labels = tables
    for name, value in (("SHARD_CHARS", 60_000), ("SHARD_DOCS", 40), ("LABELS", 200), ("BLOCK_WORDS", 3000), ("PART_WORDS", 500)):
        monkeypatch.setattr(module, name, value)
    net, again = fit(docs, labels), fit(docs.repartition(7, "text"), labels.repartition(3))
    assert np.array_equal(net.flat(), again.flat()) and (net.slope, net.shift, net.by_lang) == (again.slope, again.shift, again.by_lang)
    held = [r for r in docs.collect() if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean((net.scores([r.text for r in held]) >= 0.3) == [r.doc_id % 4 == 0 for r in held]) > 0.97


def test_packed_words():
    hashes = hashed(["Ab ab longerword", "", "é x y"])[0]
    assert np.array_equal(Network.new().rows(_unpack(_pack(hashes))), Network.new().rows(hashes)) and len(_unpack(_pack(hashes[:0]))) == 0
