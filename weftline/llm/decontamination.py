"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are lower-cased, with runs of white space as one blank. Items are cut into
windows of at most WINDOW characters that overlap by half, and from each of their words on into windows of
WORDS words (WINDOW characters, if these are more); a text is held to contain a window if some passage of
it lies within the window's edit budget (RATE of its length). So a verbatim passage of WORDS whole words of
an item is found wherever it begins, as is one of WINDOW + Q characters, with or without blanks.

By the q-gram lemma, a passage within e edits of a window of m characters shares at least m + 1 - q - q e
of its q-grams, and on diagonals (place in the text minus place in the window) that differ by e at most.
Hits are counted in bands of 2 e + 1 diagonals that overlap by half, so that some band has all hits of the
passage; bands with too few hits are discarded, and the others verified by an alignment within the band.
Rolling hashes of the text's q-grams meet a bitmap first, then the index of the items' places; the windows
about a place follow from their beginnings and ends.

Windows for which that bound isn't positive have shorter grams, of a length for which it is; a window of less
than Q characters (a short item) has itself as its gram, and is in a text that has it as whole words.

The benchmark is the query set: it is held against all rows, in blocks of about BLOCK characters. Only one
block's index is broadcast at a time (some 20 bytes a character), whatever the benchmark's size: with several
blocks, what one finds is written before the next is made.

Defined cases: a null text counts as an empty one and contains nothing; items that are null or blank are
never reported; repeated rows, of either side, give repeated pairs' rows for the
documents and one pair for equal item_ids; an empty table of either side gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import ranges, save, text_blocks

Q = 12
WINDOW = 120
WORDS = 13
RATE = 0.06
#: Characters of the benchmark that are broadcast at one time, and of text that are searched at one time.
BLOCK, SEGMENT = 4_000_000, 400_000
#: Pairs of a place in the text and one in the items that are looked at together.
PAIRS = 200_000
#: Periods of the runs that are shortened in a text of many pairs.
PERIODS = 16
#: Texts (their digests) that are broadcast to be taken out.
MOST_BROADCAST = 100_000
_BASE = 0x9E3779B97F4A7C15
_BITS = 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def gram_length(length: int, rate: float) -> int:
    """Q, or for windows with which it could be that no gram of Q is shared the longest one of which some must be."""
    edits = int(length * rate)
    return Q if length + 1 - Q - Q * edits > 0 else max(1, min(Q - 1, length // (edits + 1)))


def gram_hashes(text: str, q: int = Q) -> np.ndarray:
    """Of each run of q characters; from runs of 1, 2, 4, 8 and so on."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < q:
        return np.zeros(0, np.uint64)
    made, width, power = points.astype(np.uint64), 1, _BASE
    kept = {}
    while width * 2 <= q:
        kept[width] = (made, power)
        made = made[:-width] * np.uint64(power) + made[width:]
        width, power = width * 2, power * power % (1 << 64)
    for w in sorted(kept, reverse=True):
        if width + w <= q:
            part, p = kept[w]
            made = made[: len(points) - width - w + 1] * np.uint64(p) + part[width : width + len(points) - width - w + 1]
            width += w
    return made ^ (made >> np.uint64(32))


def halves(flat: str) -> list[tuple[int, int]]:
    """(start, end) of the windows that overlap by half."""
    last = max(0, len(flat) - WINDOW)
    return [(i, min(len(flat), i + WINDOW)) for i in sorted({*range(0, max(1, last), WINDOW // 2), last})]


def runs(flat: str) -> list[tuple[int, int]]:
    """(start, end) of the windows of WORDS words from each word on, and from each Q characters on of long words."""
    starts = [0, *(i + 1 for i, c in enumerate(flat) if c == " ")]
    ends = [*(i - 1 for i in starts[1:]), len(flat)]
    out = []
    for k, (start, end) in enumerate(zip(starts, ends, strict=True)):
        whole = ends[k + WORDS - 1] if k + WORDS <= len(ends) else len(flat) + WINDOW
        out += [(i, min(whole, i + WINDOW)) for i in range(start, max(end, start + 1), Q) if min(whole, i + WINDOW) <= len(flat)]
    return out


@dataclass
class Windows:
    """The texts of the windows, cut from the items, which are put end to end."""

    flat: str
    starts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, w: int) -> str:
        return self.flat[self.starts[w] : self.ends[w]]


@dataclass
class Index:
    """The windows with their items, and where each distinct gram occurs in the items, which are put end to end (as one array cut by `first`).

    kinds: for the windows of halves and of runs their numbers, starts and ends, all ascending. Windows with shorter
    grams are in `small`: the length, and grams, first, windows and places in them.
    """

    items: np.ndarray
    texts: Windows
    numbers: np.ndarray
    budgets: np.ndarray
    lengths: np.ndarray
    kinds: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    small: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    grams: np.ndarray
    first: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray

    @staticmethod
    def of(benchmark: list[tuple[int, str]], rate: float = RATE) -> Index:
        items, flats, windows, hashes, places, offset = [], [], [], [], [], 0
        kinds: list[list[int]] = [[], []]
        for item, text in benchmark:
            flat = normal(text)
            if item is None or not flat:
                continue
            own = halves(flat)
            for kind, spans in zip(kinds, (own, sorted({*runs(flat)} - {*own})), strict=True):
                for start, end in spans:
                    if gram_length(end - start, rate) == Q:
                        kind.append(len(items))
                    items.append(item)
                    windows.append((offset + start, offset + end))
            flats.append(flat)
            hashes.append(gram_hashes(flat))
            places.append(np.arange(len(hashes[-1]), dtype=np.int32) + offset)
            offset += len(flat)
        starts, ends = np.array(windows, np.int32).reshape(-1, 2).T.copy()
        texts, numbers = Windows("".join(flats), starts, ends), (ends - starts).astype(np.int64)
        by_size = {n: gram_length(n, rate) for n in np.unique(numbers).tolist()}
        lengths = np.array([by_size[n] for n in numbers.tolist()], np.int8)
        small = []
        for q in sorted({*lengths.tolist()} - {Q}):
            these = np.flatnonzero(lengths == q).tolist()
            made = [gram_hashes(texts[w], q) for w in these]
            of_small, first_of_small, rows = _table(made, [np.arange(len(h)) + (w << 32) for w, h in zip(these, made, strict=True)])
            small.append((q, of_small, first_of_small, rows >> 32, rows & 0xFFFFFFFF))
        grams, first, place = _table(hashes, places)
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[grams >> np.uint64(64 - _BITS)] = True
        columns = [(w := np.array(kind, np.int32), starts[w], ends[w]) for kind in kinds]
        return Index(np.array(items, np.int64), texts, numbers, (numbers * rate).astype(np.int64), lengths, columns, small, grams, first, place, bitmap)

    def known(self, text: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """(place in the text, place in the table) of the grams that are in windows: of Q characters, then of the lengths of `small`."""
        hashes = gram_hashes(text)
        at = np.flatnonzero(self.bitmap[hashes >> np.uint64(64 - _BITS)])
        same, k = _known(self.grams, hashes[at])
        return [(at[same], k), *(_known(grams, gram_hashes(text, q)) for q, grams, _, _, _ in self.small)]

    def pairs(self, known: list[tuple[np.ndarray, np.ndarray]]) -> int:
        """How many pairs of a place in the text and one in the items `hits` goes through."""
        tables = [self.first, *(s[2] for s in self.small)]
        return sum(int((first[k + 1].astype(np.int64) - first[k]).sum()) for first, (_, k) in zip(tables, known, strict=True))

    def hits(self, known: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in the text, window, place in the window) of all grams shared with windows, in slices."""
        for at, rows in _expanded(*known[0], self.first):
            place = self.place[rows]
            for window, start, end in self.kinds:
                rows, repeated = ranges(np.searchsorted(end, place + Q), np.searchsorted(start, place, "right"))
                yield at[repeated], window[rows], place[repeated] - start[rows]
        for (_, _, first, window, place), found in zip(self.small, known[1:], strict=True):
            for at, rows in _expanded(*found, first):
                yield at, window[rows], place[rows]

    def touched(self, text: str) -> np.ndarray:
        """The places in the text of all shared grams."""
        return np.concatenate([at for at, _ in self.known(text)])

    def regions(self, text: str, known: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
        """(window, first diagonal of a band) where enough grams are shared. Hits are counted by band slice by slice."""
        shift = WINDOW  # room below for the band before the first
        wide = len(text) * 2 + 2 * shift
        found, number = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, size = [], 0
        for at, window, place in self.hits(known):
            # not negative, as no window is longer than Q + its place
            keys = window.astype(np.int64) * wide + (at - place + len(text)) // (self.budgets[window] + 1) + shift
            held.append(np.unique(np.concatenate([keys, keys - 1]), return_counts=True))
            size += len(held[-1][0])
            if size > 10 * PAIRS:
                found, number = _added([(found, number), *held])
                held, size = [], 0
        found, number = _added([(found, number), *held])
        w, b = found // wide, found % wide - shift
        least = self.numbers[w] + 1 - self.lengths[w] * (1 + self.budgets[w])
        keep = number >= np.maximum(1, least)
        return list(zip(w[keep].tolist(), (b[keep] * (self.budgets[w[keep]] + 1) - len(text)).tolist(), strict=True))

    def contained(self, text: str) -> dict[int, int]:
        """The least edits found for each window that the text (normal, a segment) contains."""
        out: dict[int, int] = {}
        known = self.known(text)
        if self.pairs(known) > 5 * PAIRS:
            text = squeezed(text)
            known = self.known(text)
        for w, low in self.regions(text, known):
            if len(self.texts[w]) < Q:
                if w not in out and re.search(rf"(?<!\w){re.escape(self.texts[w])}(?!\w)", text):
                    out[w] = 0
            elif out.get(w) != 0:
                edits = banded(self.texts[w], text, low, int(self.budgets[w]))
                if edits is not None:
                    out[w] = min(edits, out.get(w, edits))
        return out


def _table(hashes: list[np.ndarray], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct grams, where the places of each begin (and the last end), and the places."""
    gram = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    order = np.argsort(gram, kind="stable")
    grams, first = np.unique(gram[order], return_index=True)
    return grams, np.append(first, len(gram)).astype(np.int32), place[order]


def _known(grams: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among the hashes, place in the table) of the hashes that the table has."""
    if not len(hashes) or not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = np.minimum(np.searchsorted(grams, hashes), len(grams) - 1)
    same = np.flatnonzero(grams[k] == hashes)
    return same, k[same]


def _expanded(at: np.ndarray, k: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in the text, row) of all rows of the grams of a table, about PAIRS at a time."""
    low, high = first[k].astype(np.int64), first[k + 1].astype(np.int64)
    done = np.cumsum(high - low)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + PAIRS, "right")))
        rows, repeated = ranges(low[a:b], high[a:b])
        yield at[a:b][repeated], rows
        a = b


def squeezed(text: str) -> str:
    """The text without the middle of its long runs of a short period, which has the same passages of up to 2 WINDOW characters."""
    for period in range(1, PERIODS + 1):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = np.diff((points[period:] == points[:-period]).astype(np.int8), prepend=0, append=0)
        parts, at = [], 0
        for start, end in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            spare = (end + period - start - 4 * WINDOW) // period * period  # a run of equal phase stays
            if spare > 0 and start + 2 * WINDOW >= at:
                parts.append(text[at : start + 2 * WINDOW])
                at = start + 2 * WINDOW + spare
        text = "".join([*parts, text[at:]])
        if len(text) <= period:
            break
    return text


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their numbers."""
    keys, numbers = (np.concatenate(x) for x in zip(*parts, strict=True))
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, numbers, minlength=len(found)).astype(np.int64)


def banded(window: str, text: str, low: int, budget: int) -> int | None:
    """The least edits between the window and a passage of text on diagonals low to low + 2 budget; None beyond the budget."""
    high = low + 2 * budget
    if window in text[max(0, low) : max(0, high + len(window))]:
        return 0
    over, n = budget + 1, len(text)
    row = [0 if 0 <= d <= n else over for d in range(low, high + 1)] + [over]
    for i, c in enumerate(window):
        left, after = over, []
        for k in range(high - low + 1):
            j = i + low + k
            best = row[k] + (c != text[j]) if 0 <= j < n else over
            best = min(best, row[k + 1] + 1, left + 1)
            left = best
            after.append(best)
        if min(after) > budget:
            return None
        row = [*after, over]
    return min(row)


def segments(text: str) -> list[str]:
    """Overlapping parts, so that no passage is cut in all of them."""
    if len(text) <= SEGMENT:
        return [text]
    overlap = 2 * WINDOW
    return [text[i : i + SEGMENT] for i in range(0, len(text) - overlap, SEGMENT - overlap)]


def found_in(index: Index, texts: list[str]) -> list[dict[int, int]]:
    """The windows that each text contains. Short texts are hashed together: the line feeds between them are in no window."""
    out: list[dict[int, int]] = [{} for _ in texts]
    group, size = [], 0
    flat = [normal(t) for t in texts]

    def search(members: list[int]) -> None:
        joined = "\n".join(flat[m] for m in members)
        at = index.touched(joined)
        starts = np.cumsum([0, *(len(flat[m]) + 1 for m in members)])
        for k in np.unique(np.searchsorted(starts, at, "right") - 1).tolist():
            out[members[k]] = index.contained(flat[members[k]])

    for i, t in enumerate(flat):
        if len(t) > SEGMENT:
            for s in segments(t):
                for w, edits in index.contained(s).items():
                    out[i][w] = min(edits, out[i].get(w, edits))
            continue
        if group and size + len(t) > SEGMENT:
            search(group)
            group, size = [], 0
        group.append(i)
        size += len(t)
    if group:
        search(group)
    return out


def _indexes(benchmark: DataFrame, rate: float) -> tuple[int, Iterator]:
    """The number of blocks of the benchmark, of about BLOCK characters each, and their broadcast indexes, one after the other."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK) or 1
    spark = benchmark.sparkSession

    def made():
        for b in range(blocks):
            rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else items
            yield spark.sparkContext.broadcast(Index.of(sorted((r["item_id"], r["text"]) for r in rows.collect()), rate))

    return blocks, made()


def _by_block(benchmark: DataFrame, rate: float, part) -> DataFrame:
    """The rows of part(index), a lazy frame, of all blocks; those of several are written one after the other, so that one index is alive."""
    blocks, indexes = _indexes(benchmark, rate)
    out = None
    for index in indexes:
        found = part(index)
        if blocks > 1:
            found = save(found, "found")
            index.destroy()
        out = found if out is None else out.union(found)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, edits): the items of which a document contains windows, how many of how many, and the least edits."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "item_id", "n_windows", "item_windows", "edits"]

    def part(index):
        def run(batches):
            items, owned = index.value.items, dict(zip(*(x.tolist() for x in np.unique(index.value.items, return_counts=True)), strict=True))
            for batch in batches:
                rows = []
                for first, texts in text_blocks(batch):
                    ids = batch.column(0).slice(first, len(texts)).to_pylist()
                    for doc, windows in zip(ids, found_in(index.value, texts), strict=True):
                        by_item: dict[int, list[int]] = {}
                        for w, edits in windows.items():
                            by_item.setdefault(int(items[w]), []).append(edits)
                        rows += [(doc, item, len(e), owned[item], min(e)) for item, e in sorted(by_item.items())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        return read.mapInArrow(run, ", ".join(f"{n} long" for n in names))

    return _by_block(benchmark, rate, part)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """docs without those that contain a window of the benchmark; all columns kept.

    With one block nothing is shuffled. With several, the digests of texts to take out are written block by block.
    """
    blocks, indexes = _indexes(benchmark, rate)
    if blocks == 1:
        index = next(indexes)

        def run(batches):
            for batch in batches:
                for first, texts in text_blocks(batch):
                    keep = [not windows for windows in found_in(index.value, texts)]
                    yield batch.slice(first, len(texts)).filter(pa.array(keep, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    read, digest = docs.select(F.col("text").cast("string").alias("text")), F.sha2(F.col("text").cast("string"), 256)

    def part(index):
        def run(batches):
            for batch in batches:
                for _, texts in text_blocks(batch):
                    yield pa.RecordBatch.from_arrays([pa.array([t for t, w in zip(texts, found_in(index.value, texts), strict=True) if w], pa.string())], names=["text"])

        return read.mapInArrow(run, "text string").select(digest.alias("_digest")).distinct()

    gone = save(_by_block(benchmark, rate, part).distinct(), "gone")
    few = gone.count() <= MOST_BROADCAST
    return docs.join(F.broadcast(gone) if few else gone, digest.eqNullSafe(F.col("_digest")), "left_anti")
