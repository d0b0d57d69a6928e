import os
import random
import re

import corpus_pipeline as pipeline
import pytest
from test_decontamination import within
from test_secrets import plain as plain_secrets
from test_simhash import plain_components, plain_print

from weftline.llm import common, queries
from weftline.llm.decontamination import RATE, halves, normal, runs
from weftline.llm.pieces import Pieces
from weftline.llm.secrets import Scanner
from weftline.llm.sentencepieces import MODEL

SF = "/root/testdata/sf0.001"


def test_stages_and_their_order():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "sentencepiece"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in pipeline.STAGES:
        docs.append(stage(spark, docs[-1], SF).cache())
    return docs


def test_each_stage_against_its_plain_version(spark, stages):
    documents, mild, single, clean, redacted, encoded = stages
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in stages]
    assert all(d.columns == documents.columns for d in stages[:-1])
    scores = {r.doc_id: r for r in queries.op10_toxicity(spark, SF).collect()}
    assert ids[1] == {i for i, r in scores.items() if not r.flagged}
    rows = [(r.doc_id, r.text or "") for r in mild.collect()]
    assert ids[2] == set(plain_components([plain_print(t) for _, t in rows], [i for i, _ in rows]))
    bench = [normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in single.collect() if any(b in normal(r.text) for b in bench)}
    assert dirty <= ids[2] - ids[3] and len(ids[2] - ids[3]) <= len(dirty) + 2
    scanner = Scanner.of().ready()
    before = {r.doc_id: r.text for r in clean.collect()}
    after = {r.doc_id: r.text for r in redacted.collect()}
    assert ids[3] == ids[4] and all((before[i] == after[i]) == (not scanner.spans(before[i])) for i in before)
    pieces = Pieces.load(MODEL)
    assert {r.doc_id: pieces.decode(r.token_ids) for r in encoded.collect()} == after


def test_run_gives_the_last_stage_and_leaves_only_what_it_reads(spark, stages):
    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    got = {r.doc_id: r.token_ids for r in pipeline.run(spark, SF).collect()}
    assert got == {r.doc_id: r.token_ids for r in stages[-1].collect()}
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and next(iter(left)).startswith("pipeline-secrets-")


@pytest.fixture(scope="module")
def own(spark, tmp_path_factory, prose, make):
    """Tables with planted cases: (folder, rows (id, text))."""
    r = random.Random(9)
    item = prose(22, 4444)
    rows = [(i, prose(120, i) + (" such a vilewretch he is " if i % 4 == 0 else " ") + prose(40, i + 7000)) for i in range(400)]
    rows += [(1000 + i, rows[4 * i + 1][1]) for i in range(20)]  # exact copies
    rows += [(1100 + i, rows[4 * i + 2][1].rsplit(" ", 1)[0] + " other") for i in range(20)]  # near copies
    rows += [(1200 + i, f"{prose(60, 9000 + i)} {' '.join(item.split()[i : i + 16])} {prose(60, 9100 + i)}") for i in range(6)]  # passages of the benchmark
    rows += [(1300 + i, f"{prose(80, 9300 + i)} password = hunter{r.randint(10**6, 10**7)} {prose(80, 9400 + i)} AKIAABCDEFGHIJKL{i + 1000}") for i in range(10)]
    rows += [(1400, None), (1401, ""), (1402, " \n"), (None, None), (None, prose(90, 9500)), (None, prose(90, 9500)), (None, rows[1][1]), (3, rows[3][1]), (3, prose(90, 9501))]
    rows += [(1500, "".join(r.choices("abcdefghijklmnop", k=200_000))), (1501, prose(40_000, 9600)), (1502, prose(40_000, 9600) + " end")]
    folder = str(tmp_path_factory.mktemp("own"))
    make(*rows).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(330)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, item


def redacted(text):
    """Spans by the rules' regular expressions, overlapping ones as one, each replaced."""
    out, at = [], 0
    for s, e, _ in plain_secrets(text):
        if s >= at:
            out += [text[at:s], "[secret]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def plain_run(rows, item):
    """The pipeline row by row, for the planted tables: the toxic word tells a toxic text."""
    kept = [(i, t) for i, t in rows if "vilewretch" not in (t or "")]
    big = 1 << 62
    prints = [plain_print(t or "") for _, t in kept]
    label = plain_components(prints, [(big if i is None else i, p) for (i, _), p in zip(kept, prints, strict=True)])
    first = {}
    for (i, t), p, c in zip(kept, prints, label, strict=True):
        if (big if i is None else i, p) == c:
            first[c] = min(first.get(c, (i, t)), (i, t), key=lambda x: (x[1] is not None, x[1] or ""))
    flat = normal(item)
    windows = [flat[a:b] for a, b in {*halves(flat), *runs(flat)}]
    gone = lambda t: any(w in t for w in windows) or len(t) < 2000 and any(within(w, t) <= int(RATE * len(w)) for w in windows)
    return {(i, t if t is None else redacted(t)) for i, t in first.values() if not gone(normal(t))}


def test_run_against_plain_version(spark, own):
    folder, rows, item = own
    pieces = Pieces.load(MODEL)
    got = [(r.doc_id, pieces.decode(r.token_ids)) for r in pipeline.run(spark, folder).collect()]
    expected = plain_run(rows, item)
    assert len(got) == len(set(got)) and set(got) == {(i, t or "") for i, t in expected}
    ids = {i for i, _ in got}
    assert not ids & {*range(0, 400, 4), *range(1000, 1020), *range(1100, 1120), *range(1200, 1206), 1401, 1402, 1502}
    assert ids >= {*range(1300, 1310), 1400, 1500, 1501, 3, None} and all(re.search(r"\[secret\]", t) for i, t in got if i is not None and 1300 <= i < 1310)


def test_empty_tables(spark, own, tmp_path):
    folder, rows, _ = own
    for name, limit in (("documents", 0), ("labels", 10**6), ("benchmark", 10**6)):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(limit).write.parquet(f"{tmp_path}/a/{name}.parquet")
    assert pipeline.run(spark, f"{tmp_path}/a").collect() == []
    for name, limit in (("documents", 10**6), ("labels", 0), ("benchmark", 0)):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(limit).write.parquet(f"{tmp_path}/b/{name}.parquet")
    ids = {r.doc_id for r in pipeline.run(spark, f"{tmp_path}/b").select("doc_id").collect()}
    assert ids >= {0, 4, *range(1200, 1206)}
