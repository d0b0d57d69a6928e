"""Toxicity, by a convolutional text classifier trained in numpy.

A word's embedding is the sum of two rows, one picked by the word's hash and one by that of its beginning.
Filters of several widths run over the words, each keeps its largest positive value (max pooling), and a
logistic unit gives the score. Rows that fewer than MIN_DOCS training documents use are and stay zero, so words that training has not seen
often are neutral. The score is then calibrated (slope and offset) on documents that training
has not used, and set right for the classes' shares in all labelled rows. From these documents come
thresholds by language too; the language is no input of the score.

Every labelled row that is not held out is learned from, with its whole text: four fifths (by a hash of the
id) train, the others calibrate. Texts are hashed once, beside a bounded number of labels at a time, and written
in shards by id; each round trains one network a shard from the last round's; the rounds' result is the mean of the shards' changes, where a row of the
embeddings counts by the steps that moved it. What fits one shard is trained in one round. Calibration sums
over all its rows in each of Newton's steps. The driver holds parameters and sums only, a worker one block of a shard.

Defined cases: a null text counts as an empty one and is scored by the offset alone; repeated rows are
scored alike; a null doc_id is not held out and never learned from; rows of labels without a label are
left out, and of several for one id the highest counts; repeated rows teach once; without labels every score is the share that the
labels show (0 if none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import save, temporary_tables, text_blocks
from weftline.llm.words import hashed

WIDTHS = (1, 2, 3)
FILTERS, DIM, ROWS = 16, 8, 1 << 17
EPOCHS, BATCH, RATE = 4, 32, 0.01
#: Small samples are gone through more often, for so many steps.
STEPS = 400
#: A shard has about so many characters, but not fewer documents than make STEPS steps in EPOCHS passes.
SHARD_CHARS, SHARD_DOCS = 24_000_000, STEPS * BATCH // EPOCHS
#: Words of a shard that a worker holds at one time, and those of which it holds the filters' values; one text at least.
BLOCK_WORDS, PART_WORDS = 12_000_000, 200_000
#: Labels that are broadcast at one time, each time for a scan of the texts; for more than so many scans Spark joins by a shuffle.
LABELS, SCANS = 1_000_000, 16
#: Rows of parameters whose changes are averaged together.
CHUNK = 8192
MIN_DOCS = 3
PREDICTED = 0.3
#: Languages with fewer positive documents to calibrate on, or that never reach the precision, take this threshold.
DEFAULT, PRECISION, LEAST = 0.3, 0.8, 10
GRID = np.linspace(0.1, 0.9, 81)


@dataclass
class Network:
    embed: np.ndarray  # (2, ROWS, DIM)
    kernels: list[np.ndarray]  # of each width (width, DIM, FILTERS)
    biases: list[np.ndarray]
    weights: np.ndarray
    offset: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    by_lang: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def new(seed: int = 7) -> Network:
        r = np.random.RandomState(seed)
        kernels = [r.normal(0, 1 / np.sqrt(DIM * w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        weights = r.normal(0, 0.5, FILTERS * len(WIDTHS)).astype(np.float32)
        return Network(np.zeros((2, ROWS, DIM), np.float32), kernels, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], weights)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        return np.stack([hashes % np.uint64(ROWS), (hashes >> np.uint64(32)) % np.uint64(ROWS)]).astype(np.int32)

    def pooled(self, hashes: np.ndarray, first: np.ndarray, places: bool = False):
        """(texts, filters) of pooled values; with `places` also where each was largest, and the embeddings.

        Texts are set apart by as many empty words as the widest filter has words.
        """
        n, pad = len(first) - 1, max(WIDTHS)
        rows = self.rows(hashes)
        text = np.repeat(np.arange(n), np.diff(first))
        at = np.arange(len(hashes)) + pad * (text + 1)
        x = np.zeros((len(hashes) + pad * (n + 2), DIM), np.float32)
        x[at] = self.embed[0][rows[0]] + self.embed[1][rows[1]]
        begins = first[:-1] + pad * np.arange(n)  # each text's span begins with empty words
        values, spots = [], []
        for kernel, bias in zip(self.kernels, self.biases, strict=True):
            z = x[: len(x) - pad] @ kernel[0]
            for j in range(1, len(kernel)):
                z += x[j : len(x) - pad + j] @ kernel[j]
            values.append(np.maximum(np.maximum.reduceat(z, begins, axis=0) + bias, 0))
            if places:
                ends = np.append(begins[1:], len(z))
                spots.append(np.stack([a + z[a:b].argmax(axis=0) for a, b in zip(begins, ends, strict=True)]))
        out = np.concatenate(values, axis=1)
        return (out, spots, x, at) if places else out

    def raw(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(hashes, first) @ self.weights + self.offset

    def flat(self) -> np.ndarray:
        """All that training changes, in rows of DIM: the embeddings' rows, then the others'."""
        rest = np.concatenate([*(k.ravel() for k in self.kernels), *self.biases, self.weights, [self.offset]]).astype(np.float32)
        return np.concatenate([self.embed.reshape(-1, DIM), np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)])

    def set_flat(self, rows: np.ndarray) -> None:
        self.embed, rest, at = rows[: 2 * ROWS].reshape(2, ROWS, DIM).copy(), rows[2 * ROWS :].ravel(), 0
        for group in (self.kernels, self.biases):
            for k, old in enumerate(group):
                group[k] = rest[at : at + old.size].reshape(old.shape).copy()
                at += old.size
        self.weights, self.offset = rest[at : at + self.weights.size].copy(), float(rest[at + self.weights.size])

    def start(self, live: np.ndarray, share: float, r: np.random.RandomState) -> None:
        """The values that training begins with."""
        for k in range(2):
            self.embed[k][live[k]] = r.normal(0, 0.1, (int(live[k].sum()), DIM))
        self.offset = float(np.log(share / (1 - share)))

    def scores(self, texts: list[str]) -> np.ndarray:
        hashes, first = hashed(texts)
        return sigmoid(self.slope * self.raw(hashes, first).astype(np.float64) + self.shift)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Adam:
    def __init__(self, shape):
        self.m, self.v, self.t = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0

    def step(self, grad, rows=None):
        """The change of the parameters; of some rows only, if named."""
        self.t += 1
        at = slice(None) if rows is None else rows
        self.m[at] = 0.9 * self.m[at] + 0.1 * grad
        self.v[at] = 0.99 * self.v[at] + 0.01 * grad * grad
        return RATE * (self.m[at] / (1 - 0.9**self.t)) / (np.sqrt(self.v[at] / (1 - 0.99**self.t)) + 1e-6)


def _words(text: str | np.ndarray) -> np.ndarray:
    return hashed([text])[0] if isinstance(text, str) else text


def _parts(docs: list[np.ndarray]):
    """(from, to) of neighbours of bounded size together."""
    first, size = 0, 0
    for i, d in enumerate(docs):
        if i > first and size + len(d) > PART_WORDS:
            yield first, i
            first, size = i, 0
        size += len(d)
    if docs:
        yield first, len(docs)


def _together(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(docs), np.cumsum([0, *map(len, docs)])


class _Learner:
    """Steps of training, and how many of them moved each row of the embeddings."""

    def __init__(self, net: Network, live: np.ndarray):
        self.net, self.live, self.moved = net, live, np.zeros((2, ROWS), np.int32)
        self.embed = [_Adam((ROWS, DIM)), _Adam((ROWS, DIM))]
        self.kernels, self.biases = [_Adam(k.shape) for k in net.kernels], [_Adam(b.shape) for b in net.biases]
        self.weights, self.offset = _Adam(net.weights.shape), _Adam(1)

    def learn(self, docs: list[np.ndarray], toxic: np.ndarray, passes: int, r: np.random.RandomState) -> None:
        for _ in range(passes):
            order = r.permutation(len(docs))
            for s in range(0, len(order), BATCH):
                part = order[s : s + BATCH]
                self.step([docs[i] for i in part], toxic[part])

    def grads(self, docs: list[np.ndarray], toxic: np.ndarray, number: int):
        """Of the dense parameters; for both tables of embeddings the rows that move and their gradients."""
        net = self.net
        words, first = _together(docs)
        values, spots, x, at = net.pooled(words, first, True)
        error = (sigmoid(values @ net.weights + net.offset) - toxic).astype(np.float32) / number
        back = error[:, None] * net.weights[None, :] * (values > 0)
        dx, kernels, biases = np.zeros_like(x), [], []
        for k, kernel in enumerate(net.kernels):
            g, spot = back[:, k * FILTERS : (k + 1) * FILTERS], spots[k]
            dk = np.zeros_like(kernel)
            for j in range(len(kernel)):
                dk[j] = np.einsum("tf,tfd->df", g, x[spot + j])  # (texts, filters, DIM) are taken
                np.add.at(dx, (spot + j).ravel(), (g[:, :, None] * kernel[j].T[None]).reshape(-1, DIM))
            kernels.append(dk)
            biases.append(g.sum(axis=0))
        moved = np.flatnonzero(np.abs(dx[at]).sum(axis=1))
        rows, embeds = net.rows(words[moved]), []
        for h in range(2):
            use = self.live[h, rows[h]]
            embeds.append((rows[h][use], dx[at[moved[use]]]))
        return [*kernels, *biases, values.T @ error, error.sum(keepdims=True)], embeds

    def step(self, docs: list[np.ndarray], toxic: np.ndarray) -> None:
        net, dense, embeds = self.net, None, []
        for a, b in _parts(docs):
            more, moves = self.grads(docs[a:b], toxic[a:b], len(docs))
            dense = more if dense is None else [x + y for x, y in zip(dense, more, strict=True)]
            embeds.append(moves)
        n = len(WIDTHS)
        for k in range(n):
            net.kernels[k] = net.kernels[k] - self.kernels[k].step(dense[k])
            net.biases[k] = net.biases[k] - self.biases[k].step(dense[n + k])
        net.weights = net.weights - self.weights.step(dense[2 * n])
        net.offset -= float(self.offset.step(dense[2 * n + 1])[0])
        for h in range(2):
            own, inverse = np.unique(np.concatenate([m[h][0] for m in embeds]), return_inverse=True)
            if len(own):
                grad = np.zeros((len(own), DIM), np.float32)
                np.add.at(grad, inverse, np.concatenate([m[h][1] for m in embeds]))
                net.embed[h][own] -= self.embed[h].step(grad + 1e-4 * net.embed[h][own], own)
                self.moved[h][own] += 1


def _usage(docs, net: Network) -> np.ndarray:
    """How many documents use each row of the embeddings."""
    usage = np.zeros((2, ROWS), np.int32)
    for d in docs:
        for k, r in enumerate(net.rows(d)):
            usage[k, np.unique(r)] += 1
    return usage


def _passes(docs: float) -> int:
    return max(EPOCHS, -(-STEPS * BATCH // max(1, int(docs))))


def train(texts: list[str] | list[np.ndarray], toxic: np.ndarray, seed: int = 7) -> Network:
    """texts: as such, or the hashes of their words."""
    net = Network.new(seed)
    if not len(texts) or toxic.min() == toxic.max():
        return net
    docs, r = [_words(t) for t in texts], np.random.RandomState(seed)
    live = _usage(docs, net) >= MIN_DOCS
    net.start(live, float(toxic.mean()), r)
    _Learner(net, live).learn(docs, toxic, _passes(len(docs)), r)
    return net


def _sums(raw: np.ndarray, toxic: np.ndarray, tries: list[np.ndarray]) -> np.ndarray:
    """For each slope and offset the loss, its two first and its three second derivatives, over all rows."""
    out = []
    for a, b in tries:
        z = a * raw + b
        p = sigmoid(z)
        e, w = p - toxic, p * (1 - p)
        out.append([np.logaddexp(0, z).sum() - (toxic * z).sum(), (e * raw).sum(), e.sum(), (w * raw * raw).sum(), (w * raw).sum(), w.sum()])
    return np.array(out)


def _calibrated(net: Network, own: float, share: float, sums: Callable[[list[np.ndarray]], np.ndarray]) -> bool:
    """Slope and offset by logistic regression, then the offset for `share` of positives. Whether there was anything to learn from."""
    if not 0 < own < 1 or not 0 < share < 1:
        net.slope, net.shift = 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return False
    base = np.array([1.0, 0.0])  # towards which the values are pulled weakly, as separable ones have no best slope
    fitted = base
    found = sums([fitted])[0]
    for _ in range(50):  # Newton's method, with steps halved until the loss falls
        pull = fitted - base
        step = np.linalg.solve(np.array([[found[3] + 1, found[4]], [found[4], found[5] + 1]]), found[1:3] + pull)
        now, best = found[0] + (pull**2).sum() / 2, None
        while best is None and np.abs(step).max() >= 1e-8:
            tries = [fitted - step / 2**k for k in range(8)]
            all_found = sums(tries)
            best = next((k for k in range(8) if all_found[k][0] + ((tries[k] - base) ** 2).sum() / 2 <= now), None)
            if best is None:
                step = step / 2**8
        if best is None:
            break
        fitted, found = tries[best], all_found[best]
    a, b = fitted
    net.slope, net.shift = float(a), float(b + np.log(share / (1 - share)) - np.log(own / (1 - own)))
    return True


def _limit(positive: np.ndarray, negative: np.ndarray, own: float, share: float) -> float | None:
    """The least of GRID that reaches the precision; both count a language's rows by how many of GRID their scores reach."""
    reach = lambda n: n[::-1].cumsum()[::-1][1:]
    p, n = reach(positive) * share / own, reach(negative) * (1 - share) / (1 - own)
    good = GRID[p >= PRECISION * np.maximum(p + n, 1e-12)]
    return round(float(min(max(good[0], DEFAULT), 0.6)), 4) if len(good) else None


def _reached(net: Network, raw: np.ndarray) -> np.ndarray:
    return np.searchsorted(GRID, sigmoid(net.slope * raw + net.shift), side="right")


def _raws(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(net.raw(*_together(docs[a:b])).astype(np.float64) for a, b in _parts(docs))])


def calibrate(net: Network, texts: list[str] | list[np.ndarray], toxic: np.ndarray, langs: list[str | None], share: float) -> None:
    """Slope and offset by logistic regression of the labels on the raw values, then the offset for `share` of positives; thresholds by language."""
    own, raw = float(toxic.mean()) if len(toxic) else 0.0, _raws(net, [_words(t) for t in texts])
    if not _calibrated(net, own, share, lambda tries: _sums(raw, toxic, tries)):
        return
    reached = _reached(net, raw)
    for lang in sorted({x for x in langs if x is not None}):
        mine = np.array([x == lang for x in langs])
        if (toxic[mine] > 0).sum() >= LEAST:
            limit = _limit(*(np.bincount(reached[mine & ((toxic > 0) == c)], minlength=len(GRID) + 1) for c in (True, False)), own, share)
            if limit is not None:
                net.by_lang[lang] = limit


def remainder(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4, F.lit(0))


def _pack(hashes: np.ndarray) -> bytes:
    """What Network.rows reads of hashes, two numbers of 17 bits each, in five bytes, compressed."""
    word, begin = hashes % np.uint64(ROWS), (hashes >> np.uint64(32)) % np.uint64(ROWS)
    return zlib.compress((word | begin << np.uint64(17)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    five = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(-1, 5)
    both = np.zeros((len(five), 8), np.uint8)
    both[:, :5] = five
    both = both.view("<u8").ravel()
    return (both % np.uint64(ROWS)) | (both >> np.uint64(17)) << np.uint64(32)


def _packed(batches):
    """The hashes of the words in the place of the text."""
    for batch in batches:
        for first, texts in text_blocks(batch):
            part = batch.slice(first, len(texts))
            words = pa.array([_pack(hashed([t])[0]) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], words], names=["id", "toxic", "lang", "words"])


def _blocks(batches):
    """(shard, first id, labels, hashes of words) of rows that follow each other in one shard, of bounded size."""
    shard, first, toxic, docs, size = None, None, [], [], 0
    for batch in batches:
        for s, i, t, w in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("shard", "id", "toxic", "words")), strict=True):
            doc = _unpack(w.as_py())
            if docs and (s.as_py() != shard or size + len(doc) > BLOCK_WORDS):
                yield shard, first, np.array(toxic, np.float32), docs
                toxic, docs, size = [], [], 0
            if not docs:
                shard, first = s.as_py(), i.as_py()
            toxic.append(t.as_py())
            docs.append(doc)
            size += len(doc)
    if docs:
        yield shard, first, np.array(toxic, np.float32), docs


def _live(rows: DataFrame) -> np.ndarray:
    """Which rows of the embeddings enough documents use."""

    def run(batches):
        net = Network.new()
        for _, _, _, docs in _blocks(batches):
            usage = _usage(docs, net).ravel()
            at = np.flatnonzero(usage)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(usage[at].astype(np.int64))], names=["at", "n"])

    counted = rows.select("shard", "id", "toxic", "words").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    live = np.zeros(2 * ROWS, bool)
    live[counted.where(F.col("n") >= MIN_DOCS).select("at").toArrow().column("at").to_numpy()] = True
    return live.reshape(2, ROWS)


def _mean(table: pa.Table) -> pa.Table:
    """The mean change of each row of parameters, by the numbers of steps or documents; added up in a fixed order."""
    table = table.sort_by([("shard", "ascending"), ("first", "ascending")])
    read = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    own, inverse = np.unique(read("rows", np.int32), return_inverse=True)
    n, change = np.zeros(len(own)), np.zeros((len(own), DIM))
    number = read("n", np.float32).astype(np.float64)
    np.add.at(n, inverse, number)
    np.add.at(change, inverse, read("change", np.float32).reshape(-1, DIM) * number[:, None])
    return pa.table({"rows": pa.array([own.tobytes()], pa.binary()), "change": pa.array([(change / n[:, None]).astype(np.float32).tobytes()], pa.binary())})


def _round(rows: DataFrame, net: Network, live: np.ndarray, passes: int, number: int) -> None:
    """Each shard trains a network from this one; the mean of their changes goes into it."""
    shared = rows.sparkSession.sparkContext.broadcast((net, live))

    def run(batches):
        for shard, blocks in groupby(_blocks(batches), key=lambda b: b[0]):
            learner, r = _Learner(copy.deepcopy(shared.value[0]), shared.value[1]), np.random.RandomState([7, number, shard])
            before, seen, first = learner.net.flat(), 0, None
            for _, at, toxic, docs in blocks:
                learner.learn(docs, toxic, passes, r)
                seen, first = seen + len(docs), at if first is None else first
            change = learner.net.flat() - before
            n = np.append(learner.moved.ravel(), np.full(len(change) - 2 * ROWS, seen)).astype(np.float32)
            moved = np.flatnonzero(n)
            for chunk in np.unique(moved // CHUNK):
                own = moved[moved // CHUNK == chunk]
                values = [chunk, shard, first, own.astype(np.int32).tobytes(), n[own].tobytes(), change[own].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3], strict=True)], names=["chunk", "shard", "first", "rows", "n", "change"])

    changes = rows.select("shard", "id", "toxic", "words").mapInArrow(run, "chunk int, shard int, first long, rows binary, n binary, change binary")
    flat = net.flat()
    for r in changes.groupBy("chunk").applyInArrow(_mean, "rows binary, change binary").collect():
        flat[np.frombuffer(r["rows"], np.int32)] += np.frombuffer(r["change"], np.float32).reshape(-1, DIM)
    net.set_flat(flat)
    shared.destroy()


def _calibrate_on(rows: DataFrame, net: Network, share: float) -> None:
    """calibrate(), over a table."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def raws(batches):
        for batch in batches:
            raw = np.array([_raws(shared.value, [_unpack(w.as_py())])[0] for w in batch.column(3)], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw)], names=["shard", "toxic", "lang", "raw"])

    table = save(rows.select("shard", "toxic", "lang", "words").mapInArrow(raws, "shard int, toxic int, lang string, raw double"), "toxicity-raw")
    seen = table.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    own = (seen["toxic"] or 0) / max(1, seen["n"])

    def sums(tries):
        def run(batches):
            columns = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
            if columns:
                shard, toxic, raw = (np.concatenate(c) for c in zip(*columns, strict=True))
                for s in np.unique(shard):
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([_sums(raw[shard == s], toxic[shard == s], tries).tobytes()], pa.binary())], names=["shard", "sums"])

        parts = sorted((r["shard"], bytes(r["sums"])) for r in table.select("shard", "toxic", "raw").mapInArrow(run, "shard int, sums binary").collect())
        return np.sum([np.frombuffer(x, np.float64).reshape(-1, 6) for _, x in parts], axis=0)

    if not _calibrated(net, own, share, sums):
        return

    slope, shift = net.slope, net.shift

    def reached(batches):
        line = Network.new()
        line.slope, line.shift = slope, shift
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_reached(line, b.column(2).to_numpy()).astype(np.int32))], names=["lang", "toxic", "reached"])

    counted = table.where("lang is not null").select("lang", "toxic", "raw").mapInArrow(reached, "lang string, toxic int, reached int").groupBy("lang", "reached").agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n"))
    by_lang = counted.groupBy("lang").agg(F.sum("p").alias("positive"), F.collect_list(F.struct("reached", "p", "n")).alias("counts"))
    for r in by_lang.where(F.col("positive") >= LEAST).collect():
        positive, negative = np.zeros(len(GRID) + 1), np.zeros(len(GRID) + 1)
        for at, p, n in r["counts"]:
            positive[at], negative[at] = p, n - p
        limit = _limit(positive, negative, own, share)
        if limit is not None:
            net.by_lang[r["lang"]] = limit


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """Learns from all labels whose id is not held out, and their whole texts."""
    with temporary_tables(docs.sparkSession, []):
        return _fitted(docs, labels)


def _fitted(docs: DataFrame, labels: DataFrame) -> Network:
    by_id = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where((remainder(F.col("id")) != 2) & F.col("toxic").isin(0, 1))
    number = {r["toxic"]: r["count"] for r in by_id.groupBy("toxic").count().collect()}
    share = number.get(1, 0) / max(1, number.get(0, 0) + number.get(1, 0))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("id").isNotNull() & (remainder(F.col("id")) != 2))
    size = texts.select("id", F.length("text").cast("long").alias("chars")).join(by_id, "id").agg(F.count(F.lit(1)).alias("docs"), F.sum("chars").alias("chars")).first()
    shards = max(1, min(size["docs"] // SHARD_DOCS, -(-(size["chars"] or 0) // SHARD_CHARS)))
    scans = -(-sum(number.values()) // LABELS)
    scans = scans if 1 <= scans <= SCANS else 1
    own = -(-shards // scans)  # shards of each scan
    shards = own * scans
    parts = []
    for k in range(scans):
        part = by_id.where(F.pmod(F.xxhash64("id", F.lit("scan")), F.lit(scans)) == k)
        found = texts.join(F.broadcast(part) if sum(number.values()) <= LABELS * SCANS else part, "id").select("id", "toxic", "lang", "text").mapInArrow(_packed, "id long, toxic int, lang string, words binary")
        dealt = found.repartition(own, "id").dropDuplicates().select("*", (F.spark_partition_id() + k * own).alias("shard"), (F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(5)) != 0).alias("trains"))
        parts.append(save(dealt.sortWithinPartitions(F.xxhash64("id", F.lit("order")), "id", "lang", "words"), "toxicity"))
    rows = reduce(DataFrame.union, parts)
    training, net = rows.where("trains"), Network.new()
    seen = training.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    if 0 < (seen["toxic"] or 0) < seen["n"]:
        live, passes = _live(training), _passes(seen["n"] / shards)
        net.start(live, seen["toxic"] / seen["n"], np.random.RandomState(7))
        rounds = 1 if shards == 1 and size["chars"] <= SHARD_CHARS else EPOCHS
        for k in range(rounds):
            _round(training, net, live, -(-passes // rounds), k)
    _calibrate_on(rows.where(~F.col("trains")), net, share)
    return net


def _scored(batches, net, block=300_000):
    for batch in batches:
        for first, texts in text_blocks(batch, block=block):
            part = batch.slice(first, len(texts))
            yield part, net.value.scores(texts)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (at PREDICTED); lang_threshold, and flagged: whether the score reaches it."""
    net = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for part, score in _scored(batches, net):
            limit = np.array([net.value.by_lang.get(x, DEFAULT) for x in part.column(3).to_pylist()])
            ints = lambda x: pa.array(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score), ints(score >= PREDICTED), pa.array(limit, pa.float64()), ints(score >= limit)], names=["doc_id", "held_out", "score", "predicted", "lang_threshold", "flagged"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (remainder(F.col("doc_id")) == 2).alias("held_out"), F.col("lang").cast("string").alias("lang"))
    return read.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, lang_threshold double, flagged int")


def mild(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those whose score reaches their language's threshold; all columns kept, nothing shuffled."""
    net = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for part, score in _scored(batches, net):
            langs = part.column(part.schema.get_field_index("lang")).to_pylist()
            limit = np.array([net.value.by_lang.get(x, DEFAULT) for x in langs])
            yield part.filter(pa.array(score < limit))

    return docs.mapInArrow(run, docs.schema)
