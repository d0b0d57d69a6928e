"""SimHash near-duplicates, linked at a Hamming distance of at most 4.

Each text gets a 64-bit fingerprint of its shingles of four words. Equal fingerprints are one node of the
graph. Distinct ones are searched for links as follows.

Pivot distance tables: with a fingerprint, its Hamming distances to PIVOTS fixed reference fingerprints are
computed, once, and go with it as packed bytes. By the triangle inequality two fingerprints at distance d
have distances to any reference that differ by d at most; a pair whose largest coordinate difference exceeds
4 is discarded, and the survivors are verified by their own distance.

Blocks: distances to references bunch round 32, so they can't say which pairs to look at. The 64 bits are cut
into 7 parts. Two fingerprints that differ in 4 bits or fewer agree in at least 3 parts, so they share a block
in one of the 35 ways to choose 3 parts, and no link is lost. A block gives a spanning forest of its links,
not its pairs, so its output stays below its number of rows.

Hot blocks, of more than CHUNK rows at any size of the input, are cut again: their other bits make 6 parts of
which at least 2 agree, so each row goes to 15 smaller blocks. Those that are hot still (clusters that agree
in most bits) are dealt into chunks, and each pair of chunks is searched by itself, so that a block is never
in one task whole and every pair in it is still compared. Blocks are counted by key, with partial counts, and
only in hash cells (a fixed number) that hold more than CHUNK rows.

A node's name is the least doc_id of its fingerprint and the fingerprint, so that the least node of a
component gives the component_id.

Defined cases: a null text counts as an empty one; texts without words have fingerprint zero and are
linked like any other; repeated rows keep their rows; rows with a null doc_id get a fingerprint, and take
part as if their id were larger than all others; rows of one id with different texts are judged one by one;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import drop, save, text_blocks
from weftline.llm.components import components

SHINGLE = 4
SEED = 42
MOST_BITS = 4
#: Parts of the bits, and how many of them agree at least: of all, then of those that a hot block leaves.
PARTS, INTACT = 7, 3
FURTHER, FURTHER_INTACT = 6, 2
PIVOTS = 16
TABLE = [f"p{k}" for k in range(PIVOTS // 8)]
CELLS = 1 << 16
CHUNK = 4096
#: Rows of tables that are broadcast (up to 40 bytes each).
MOST_BROADCAST = 300_000
SHORT_RUN = 32
BUFFER = 200_000
#: Stands for a null id: larger than all others.
NO_ID = (1 << 63) - 1


def fingerprint(text: str) -> int:
    """As a signed 64-bit integer. A bit is set if it is in more than half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return int(np.uint64(digest(joined, SEED)).view(np.int64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(hashes) < 1000:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ bits for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % k, SEED) for k in range(count)], np.uint64)


def distance_table(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distances: a row for each fingerprint, a column for each reference."""
    return np.bitwise_count(prints[:, None] ^ references[None, :]).astype(np.int8)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parts(bits: list[int], number: int) -> list[int]:
    """The bits in so many parts of about one length, as masks."""
    cuts = [len(bits) * k // number for k in range(number + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:])]


def masks() -> list[int]:
    return [sum(c) for c in combinations(_parts(list(range(64)), PARTS), INTACT)]


def further_masks(mask: int) -> list[int]:
    """For the rows of a hot block of a mask: the mask with those of the other bits that agree."""
    rest = _parts([b for b in range(64) if not mask >> b & 1], FURTHER)
    return [mask | sum(c) for c in combinations(rest, FURTHER_INTACT)]


def block_links(keys: np.ndarray, prints: np.ndarray, table: np.ndarray, most: int = MOST_BITS) -> list[tuple[int, int]]:
    """A spanning forest (indices) of the links within blocks; keys are sorted, equal ones make a block; table: the distances to the references."""
    n = len(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    length = np.diff(np.append(first, n))
    pairs = []
    short = np.repeat(length <= SHORT_RUN, length)
    for step in range(1, min(SHORT_RUN, int(length.max(initial=1)))):
        a = np.flatnonzero((keys[:-step] == keys[step:]) & short[:-step])
        if not len(a):
            break
        a = a[(np.abs(table[a] - table[a + step]) <= most).all(axis=1)]
        a = a[np.bitwise_count(prints[a] ^ prints[a + step]) <= most]
        pairs += zip(a.tolist(), (a + step).tolist(), strict=True)
    out = _forest(pairs)
    for k in np.flatnonzero(length > SHORT_RUN).tolist():
        out += _grow(np.arange(first[k], first[k] + length[k]), prints, table, most)
    return out


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out = []
    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            up[y] = x
            out.append((a, b))
    return out


def _grow(rest: np.ndarray, prints: np.ndarray, table: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The forest of one block: from a row to those it links to, and on from them."""
    out = []
    while len(rest):
        reached, rest = [int(rest[0])], rest[1:]
        for a in reached:  # grows while it is read
            near = rest[(np.abs(table[rest] - table[a]) <= most).all(axis=1)]
            near = near[np.bitwise_count(prints[near] ^ prints[a]) <= most]
            if len(near):
                out += [(a, b) for b in near.tolist()]
                reached += near.tolist()
                rest = np.setdiff1d(rest, near, assume_unique=True)
    return out


def _search(batches):
    """Rows sorted by block come in batches; a block is searched once all its rows are there."""
    names = ["key", "least", "fp", *TABLE]
    held, parts = [np.empty(0, np.int64) for _ in names], []

    def gathered():
        return [np.concatenate([x, *y]) for x, y in zip(held, zip(*parts), strict=True)] if parts else held

    def found(key, least, fp, *table):
        packed = np.ascontiguousarray(np.stack(table, axis=1)).view(np.int8)
        links = block_links(key, fp.view(np.uint64), packed) if len(key) else []
        if links:
            a, b = np.array(links).T
            columns = [least[a], fp[a], least[b], fp[b]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["u_least", "u_fp", "v_least", "v_fp"])

    for batch in batches:
        parts.append([batch.column(k).to_numpy() for k in range(len(names))])
        if sum(len(p[0]) for p in parts) < BUFFER:
            continue
        held, parts = gathered(), []
        whole = np.searchsorted(held[0], held[0][-1])  # the last block may go on
        yield from found(*(x[:whole] for x in held))
        held = [x[whole:] for x in held]
    yield from found(*gathered())


def _key(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def _masked(mask: Column) -> Column:
    return F.col("fp").bitwiseAND(mask)


def hot_keys(keyed: DataFrame) -> DataFrame | None:
    """(key, n): the keys of more than CHUNK rows; None if there are none."""
    cell = F.pmod(F.col("key"), F.lit(CELLS)).cast("int")
    cells = [(r["cell"],) for r in keyed.groupBy(cell.alias("cell")).count().where(F.col("count") > CHUNK).select("cell").collect()]  # CELLS rows at most
    if not cells:
        return None
    full = F.broadcast(keyed.sparkSession.createDataFrame(cells, "cell int"))
    counted = keyed.select("key", cell.alias("cell")).join(full, "cell", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK)
    counted = save(counted, "hot")
    number = counted.count()
    if not number:
        return None
    return F.broadcast(counted) if number <= MOST_BROADCAST else counted


def blocks(nodes: DataFrame) -> DataFrame:
    """nodes with a key: all nodes that can be linked share one, and no key has many more than CHUNK of them."""
    own = nodes.columns
    first = masks()
    each = F.array(*(F.struct(F.lit(t).alias("t"), _key(F.lit(t), _masked(F.lit(signed(m)))).alias("key")) for t, m in enumerate(first)))
    keyed = nodes.select(F.explode(each).alias("b"), *own).select("b.t", "b.key", *own)
    hot = hot_keys(keyed)
    if hot is None:
        return keyed.select("key", *own)
    plain = keyed.join(hot, "key", "left_anti").select("key", *own)
    further = F.element_at(F.array(*(F.array(*(F.lit(signed(x)) for x in further_masks(m))) for m in first)), F.col("t") + 1)
    keyed = keyed.join(hot, "key", "left_semi").select(F.explode(F.transform(further, lambda m: _key(F.lit(-1), F.col("t"), m, _masked(m)))).alias("key"), *own)
    hot = hot_keys(keyed)
    if hot is None:
        return plain.union(keyed)
    plain = plain.union(keyed.join(hot, "key", "left_anti"))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda k: _key(F.col("key"), F.least(k, mine), F.greatest(k, mine)))
    return plain.union(keyed.join(hot, "key").select(F.explode(pairs).alias("key"), *own))


def links(nodes: DataFrame) -> DataFrame:
    """nodes (least, fp, TABLE): of distinct fp. Gives (u, v), structs of least and fp: links that connect all that is connected at MOST_BITS."""
    keyed = blocks(nodes.select("least", "fp", *TABLE)).select("key", "least", "fp", *TABLE)
    found = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_search, "u_least long, u_fp long, v_least long, v_fp long")
    node = lambda x: F.struct(F.col(f"{x}_least").alias("least"), F.col(f"{x}_fp").alias("fp")).alias(x)
    return found.select(node("u"), node("v"))


def packed_table(prints: np.ndarray) -> list[np.ndarray]:
    """The columns TABLE: distances to the references, eight to a number."""
    made = np.ascontiguousarray(distance_table(prints.view(np.uint64), pivots())).view(np.int64)
    return [np.ascontiguousarray(made[:, k]) for k in range(len(TABLE))]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp, and the distances to the references."""

    def run(batches):
        for batch in batches:
            for first, texts in text_blocks(batch):
                prints = np.fromiter(map(fingerprint, texts), np.int64, len(texts))
                ids = batch.column(0).slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(prints), *map(pa.array, packed_table(prints))], names=["doc_id", "fp", *TABLE])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, fp long, " + ", ".join(f"{c} long" for c in TABLE))


def rooted(docs: DataFrame) -> DataFrame:
    """doc_id, fp and root (least, fp) of each document: the least node of its component. NO_ID stands for null ids in nodes."""
    printed = save(fingerprints(docs), "fingerprints")
    least = F.coalesce(F.min("doc_id"), F.lit(NO_ID))
    nodes = save(printed.groupBy("fp").agg(least.alias("least"), *(F.first(c).alias(c) for c in TABLE)), "distinct")
    found = components(links(nodes)).select(F.col("node.fp").alias("fp"), "root")
    own = F.struct("least", "fp")
    named = save(nodes.join(found, "fp", "left").select("fp", F.coalesce("root", own).alias("root")), "named")  # written, so that a hot fp below can be split
    drop(nodes)
    return printed.join(named, "fp").select("doc_id", "fp", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the least doc_id reachable by links."""
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rooted(docs).select("doc_id", digits.alias("fingerprint"), F.nullif(F.col("root.least"), F.lit(NO_ID)).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without those that are linked to a lesser one; all columns kept.

    The least node of each component stays, with the least of its rows if there are several. Ids whose rows are all gone
    are taken out by an anti join. For ids that stay and have several rows, and for rows without an id, rows are judged
    one by one, by their own fingerprints.
    """
    found = save(rooted(docs), "components")
    stays = (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("root.least")) & (F.col("fp") == F.col("root.fp"))
    ids = save(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(stays).alias("stays")).where(~F.col("stays") | (F.col("rows") > 1) | F.col("doc_id").isNull()), "ids")
    special = ids.where("stays").select(F.col("doc_id").alias("_id"))
    id_of = docs["doc_id"].cast("long")
    kept = docs.join(ids.select(F.col("doc_id").alias("_id")).hint("merge"), id_of.eqNullSafe(F.col("_id")), "left_anti")  # alike at every size
    if not special.take(1):
        return kept
    several = docs.join(special, id_of.eqNullSafe(F.col("_id")), "left_semi")
    roots = found.where(stays).select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp")).distinct()
    named = [f"c{k}" for k in range(len(docs.columns))]  # whatever the columns are called
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for first, texts in text_blocks(batch, f"c{at}"):
                prints = pa.array(np.fromiter(map(fingerprint, texts), np.int64, len(texts)))
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, prints], names=[*named, "_fp"])

    renamed = several.toDF(*named)
    made = renamed.mapInArrow(run, T.StructType([*renamed.schema.fields, T.StructField("_fp", T.LongType())]))
    own = F.col(f"c{docs.columns.index('doc_id')}").cast("long")
    stay = made.join(roots.withColumnRenamed("_fp", "_root"), own.eqNullSafe(F.col("_id")) & (F.col("_fp") == F.col("_root")), "left_semi")
    one = stay.groupBy(own.alias("_id"), "_fp").agg(F.min(F.struct(*named)).alias("row"))
    return kept.union(one.select(*(F.col(f"row.{c}").alias(n) for c, n in zip(named, docs.columns, strict=True))))
