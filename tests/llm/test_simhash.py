import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from weftline.llm import simhash
from weftline.llm.common import save
from weftline.llm.components import components
from weftline.llm.simhash import TABLE, block_links, distance_table, fingerprint, near_duplicates, one_of_each, packed_table, pivots


def plain_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \n", "One", "one TWO three", "É a B ß\x0bc d", "a b c d e f g " * 3])
def test_fingerprint(text):
    assert fingerprint(text) % (1 << 64) == plain_print(text)


def test_fingerprint_of_long_texts(prose):
    for n in (999, 1003, 5000):
        assert fingerprint(prose(n, n)) % (1 << 64) == plain_print(prose(n, n))


def plain_components(prints, ids):
    """Smallest id reachable, of each row."""
    label = dict(zip(range(len(ids)), ids))
    links = [(a, b) for a in range(len(ids)) for b in range(a) if (int(prints[a]) ^ int(prints[b])).bit_count() <= 4]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return [label[i] for i in range(len(ids))]


def test_components_of_texts(make, prose):
    base = [prose(400, i) for i in range(12)]
    texts = []
    for i, t in enumerate(base):
        texts.append((i * 10, t))
        for k in range(1, 4):
            words = t.split()
            for j in range(k):
                words[(j * 37 + i) % len(words)] = f"new{k}{j}"
            texts.append((i * 10 + k, " ".join(words)))
    texts += [(900, base[3]), (5, base[4]), (901, ""), (902, None), (903, " "), (904, "short"), (904, "short")]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(make(*texts)).collect())
    prints = [plain_print(t or "") for _, t in texts]
    expected = sorted((i, f"{p:016x}", c) for (i, _), p, c in zip(texts, prints, plain_components(prints, [i for i, _ in texts]), strict=True))
    assert got == expected


def nodes_of(spark, prints):
    """Nodes of fingerprints (unsigned), named by themselves."""
    signed = np.array(prints, np.uint64).view(np.int64)
    columns = [signed, signed, *packed_table(signed)]
    return spark.createDataFrame(pd.DataFrame(dict(zip(["least", "fp", *TABLE], columns, strict=True))))


@pytest.mark.parametrize("chunk", [4096, 150, 2])
def test_links_of_dense_clusters(spark, monkeypatch, chunk):
    """Many distinct fingerprints close to each other, also with hot blocks cut again and dealt into chunks."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    r = random.Random(5)
    prints = set()
    for _ in range(4):
        centre = r.getrandbits(64)
        for _ in range(120):
            x = centre
            for b in r.sample(range(64), r.randint(0, 5)):
                x ^= 1 << b
            prints.add(x)
    prints |= {r.getrandbits(64) for _ in range(300)}
    prints = sorted(prints)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    found = {x.node.fp: x.root.fp for x in components(simhash.links(nodes_of(spark, prints))).collect()}
    expected = plain_components(prints, signed)
    assert [found.get(p, p) for p in signed] == expected


def test_one_block_of_200_000_fingerprints(spark):
    """They agree in 27 bits, so 35 of them share a block; no task gets a block of more than CHUNK, and planted links are found."""
    r = np.random.RandomState(3)
    common = np.uint64(simhash.masks()[0])
    rest = ~common & np.uint64(0xFFFFFFFFFFFFFFFF)
    prints = np.unique((np.frombuffer(r.bytes(8 * 200_000), np.uint64) & rest) | (np.uint64(0x5A5A5A5A5A5A5A5A) & common))
    near = prints[::1000] ^ np.uint64(1 << 63) ^ np.uint64(1 << 40)
    nodes = nodes_of(spark, np.union1d(prints, near)).repartition(8)
    keyed = simhash.blocks(nodes)
    assert keyed.groupBy("key").count().agg({"count": "max"}).first()[0] <= 2 * simhash.CHUNK
    links = save(simhash.links(nodes), "links")
    pairs = {(x.u.fp, x.v.fp) for x in links.collect()}
    planted = list(zip(prints[::1000].view(np.int64).tolist(), near.view(np.int64).tolist(), strict=True))
    linked = {x.node.fp: x.root.fp for x in components(links).collect()}
    assert all(a == b or linked[a] == linked[b] for a, b in planted)
    assert all((np.uint64(a & (1 << 64) - 1) ^ np.uint64(b & (1 << 64) - 1)).bit_count() <= 4 for a, b in pairs)


def test_all_close_pairs_share_a_block():
    r = random.Random(8)
    for _ in range(2000):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), r.randint(0, 4)):
            y ^= 1 << b
        shared = [m for m in simhash.masks() if x & m == y & m]
        assert shared and all(any(x & f == y & f for f in simhash.further_masks(m)) for m in shared)


def test_pivots_never_discard_a_link_and_most_of_the_rest():
    r = np.random.RandomState(2)
    x = np.frombuffer(r.bytes(8 * 20_000), np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << r.randint(0, 64, len(x)).astype(np.uint64)
    table = lambda v: distance_table(v, pivots()).astype(int)
    assert (np.abs(table(x) - table(y)).max(axis=1) <= 4).all()
    other = (x & np.uint64((1 << 27) - 1)) | (np.roll(x, 1) & ~np.uint64((1 << 27) - 1))  # of one block
    assert (np.abs(table(x) - table(other)).max(axis=1) > 4).mean() > 0.99


def test_block_links_in_short_and_long_runs():
    r = random.Random(2)
    prints = np.array([r.getrandbits(3) | (i // 3) << 40 for i in range(200)], np.uint64)
    for keys in (np.zeros(200, np.int64), np.arange(200) // 5):
        links = block_links(keys, prints, distance_table(prints, pivots()))
        up = list(range(200))
        for a, b in links:
            assert keys[a] == keys[b] and int(prints[a] ^ prints[b]).bit_count() <= 4
            low = min(up[a], up[b])
            up = [low if x in (up[a], up[b]) else x for x in up]
        full = list(range(200))
        for a in range(200):
            for b in range(a):
                if keys[a] == keys[b] and int(prints[a] ^ prints[b]).bit_count() <= 4 and full[a] != full[b]:
                    low, high = sorted((full[a], full[b]))
                    full = [low if x == high else x for x in full]
        assert up == full and len(links) < 200


@pytest.mark.parametrize("few", [0, 300_000])
def test_components_of_a_chain(spark, monkeypatch, few):
    from weftline.llm import components as module

    monkeypatch.setattr(module, "FEW", few)
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1000), (500, 501), (501, 500)], "u long, v long")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_one_of_each(make, prose):
    docs = make((7, prose(100, 1)), (3, prose(100, 1)), (3, prose(100, 1)), (4, prose(100, 2)), (5, None), (6, ""))
    out = one_of_each(docs)
    assert sorted(r.doc_id for r in out.collect()) == [3, 4, 5] and out.columns == docs.columns
    assert near_duplicates(make().limit(0)).collect() == [] and one_of_each(make().limit(0)).collect() == []


def test_rows_of_one_id_are_judged_one_by_one(make, prose):
    a, b, near = prose(400, 1), prose(400, 2), prose(400, 1).rsplit(" ", 1)[0] + " end"
    docs = make((1, a), (3, a), (3, b), (3, b), (4, near), (5, prose(400, 3)), (5, prose(400, 4)), (None, b), (None, prose(400, 9)), (None, prose(400, 9)), (6, None), (6, " "))
    assert near_duplicates(make((1, a), (4, near))).where("component_id = 1").count() == 2
    rows = sorted(((r.doc_id, r.text) for r in one_of_each(docs).collect()), key=str)
    assert rows == sorted([(1, a), (3, b), (5, prose(400, 3)), (5, prose(400, 4)), (None, prose(400, 9)), (6, None)], key=str)
    got = {(r.doc_id, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {(1, 1), (3, 1), (3, 3), (4, 1), (5, 5), (None, 3), (None, None), (6, 6)}


def test_columns_of_any_name_and_order(make, prose):
    docs = make((2, prose(50, 1)), (2, prose(50, 2)), (7, prose(50, 1))).selectExpr("'x' as fp", "text", "1.5d as root", "doc_id", "'y' as c0", "'z' as _fp", "null as row")
    out = one_of_each(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 2]


def test_rows_without_an_id(make, prose):
    got = near_duplicates(make((None, prose(50, 1)), (None, prose(50, 2)), (8, prose(50, 1)))).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("8", "8"), ("None", "8"), ("None", "None")]
