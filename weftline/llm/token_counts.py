"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The model is estimated from the corpus: a piece's probability is its share in the merge encodings (without
dropout) of all texts, one added to each number, in whole millionths of its logarithm so that sums are
exact. A pre-token's count is that of its best segmentation (of equal ones, that with fewest tokens).

The distinct pre-tokens of a block of texts that aren't known yet are inserted in a trie, a character at a
time for all of them. Each node holds the forward score and token count of its prefix, worked out once from
the nodes before it, however many pre-tokens share the prefix: the pieces that end at a node are found by
walks through the pieces' own trie which its parent hands on. A pre-token's count is that of its last node,
and is kept. A document's count is the sum over its pre-tokens. Pre-tokens of more than LONG characters go
over their characters with the scores of the last few only, and are not kept, so that memory is bounded by
a block of texts.

Defined cases: a null or empty text has no tokens; characters outside the vocabulary count as their
bytes; repeated rows and null ids keep their rows; an empty table gives an empty result (and every piece
the same probability); other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import ranges, text_blocks
from weftline.llm.pieces import LITERAL, OTHER, Numbers, Pieces, Sampler, pretokens
from weftline.llm.sentencepieces import MODEL

#: Pre-tokens whose counts are kept; with more, they are begun anew. Results don't depend on it.
MOST_KNOWN = 1_000_000
LONG = 64
#: A score and the tokens that it took are one number, score * PACK - tokens, so that the largest has most score, then fewest tokens.
PACK = 1024
NONE = -(1 << 60)


def piece_counts(docs: DataFrame, model: str = MODEL) -> np.ndarray:
    """How often each piece is in the merge encodings of all texts. A row for each piece comes to the driver."""
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))

    def run(batches):
        sampler = Sampler.of(pieces.value, 0.0, 0)
        total = np.zeros(len(sampler.pieces.text), np.int64)
        for batch in batches:
            for _, texts in text_blocks(batch, block=600_000):
                total += sampler.number_of_pieces(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

    read = docs.select(F.col("text").cast("string").alias("text"))
    found = read.mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(pieces.value.text), np.int64)
    for r in found:
        out[r["piece"]] = r["n"]
    return out


def unigram_scores(pieces: Pieces, counts: np.ndarray) -> tuple[dict[str, int], int]:
    """(log-probabilities of the pieces, that of a byte) in millionths; counts: by id."""
    total = int(counts.sum()) + len(counts)
    score = lambda n: round(1e6 * (math.log(n + 1) - math.log(total)))
    octets = counts[pieces.octets : pieces.octets + 256]
    return {p: score(int(counts[i])) for p, i in pieces.ids.items()}, score(float(octets.mean()))


class Unigrams:
    """Counts of pre-tokens under the scores of pieces. The pieces' own trie is an array of transitions by state and character."""

    def __init__(self, scores: dict[str, int], octet: int) -> None:
        self.scores, self.octet, self.longest = scores, octet, max(map(len, scores))
        states, steps = {"": 0}, {0: NONE}
        for p in sorted(scores):
            for i in range(1, len(p) + 1):
                if p[:i] not in states:
                    states[p[:i]] = len(states)
                    steps[states[p[:i]]] = NONE
            steps[states[p]] = scores[p] * PACK - 1
        pairs = sorted((states[p[:-1]] << 21 | ord(p[-1]), k) for p, k in states.items() if p)
        self.keys, self.to = np.array([k for k, _ in pairs], np.int64), np.array([s for _, s in pairs], np.int64)
        self.step = np.array([steps[k] for k in range(len(states))], np.int64)
        ends: dict[str, set[int]] = {}
        for p in scores:
            ends.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {e: sorted(n for n in found if n > 1) for e, found in ends.items()}
        self.forget()  # known: the number of each pre-token; tokens: its count, by number

    def goto(self, state: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The states behind a character; -1 if no piece goes on so."""
        key = state << 21 | point
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def insert(self, words: list[str]) -> tuple[np.ndarray, int]:
        """(tokens of each word, nodes of the trie without its root); words are distinct, of LONG characters at most."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        wide = int(sizes[0]) if len(sizes) else 0
        points = np.zeros((len(words), wide), np.int64)
        points[np.arange(wide) < sizes[:, None]] = np.frombuffer("".join(words[i] for i in order.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        best = np.zeros(int(sizes.sum()) + 1, np.int64)  # of each node: score * PACK - tokens
        node, nodes, base = np.zeros(len(words), np.int64), 1, 0
        # walks through the pieces' trie: of each node of the last level where they are, the node each began at, and its state
        first, begun, state = np.zeros(2, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for depth in range(wide):
            n = int(np.searchsorted(-sizes, -depth))  # longer than `depth`
            keys, inverse = np.unique(node[:n] << 21 | points[:n, depth], return_inverse=True)
            parent, point = keys >> 21, keys & 0x1FFFFF
            rows, owner = ranges(first[parent - base], first[parent - base + 1])
            owner, begun, state = np.append(owner, np.arange(len(keys))), np.append(begun[rows], parent), np.append(state[rows], np.zeros(len(keys), np.int64))
            state = self.goto(state, point[owner])
            lone = np.zeros(len(keys), np.int64) + NONE
            own = state[len(rows) :]
            lone[own >= 0] = self.step[own[own >= 0]]
            alive = np.flatnonzero(state >= 0)
            alive = alive[np.argsort(owner[alive], kind="stable")]
            owner, begun, state = owner[alive], begun[alive], state[alive]
            octets = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
            value = np.where(lone == NONE, best[parent] + octets * (self.octet * PACK - 1), NONE)
            np.maximum.at(value, owner, np.where(self.step[state] == NONE, NONE, best[begun] + self.step[state]))
            best[nodes : nodes + len(keys)] = value
            node[:n] = nodes + inverse
            first = np.searchsorted(owner, np.arange(len(keys) + 1))
            base, nodes = nodes, nodes + len(keys)
        out = np.zeros(len(words), np.int64)
        out[order] = -best[node] % PACK
        return out, nodes - 1

    def plain(self, word: str) -> int:
        """The tokens of a long word: the same forward scores, of which only the last few are kept."""
        pack, scores = 1 << 40, self.scores
        last = [0] * (self.longest + 1)  # by end, modulo their number
        for end in range(1, len(word) + 1):
            c = word[end - 1]
            own = scores.get(c)
            step = own * pack - 1 if own is not None else len(c.encode("utf-8", "surrogatepass")) * (self.octet * pack - 1)
            best = last[(end - 1) % len(last)] + step
            for length in self.lengths.get(word[max(0, end - 2) : end], ()):
                if length > end:
                    break
                own = scores.get(word[end - length : end])
                if own is not None:
                    best = max(best, last[(end - length) % len(last)] + own * pack - 1)
            last[end % len(last)] = best
        return -last[len(word) % len(last)] % pack

    def counts(self, texts: list[list[str]]) -> list[int]:
        """The tokens of texts, given as their pre-tokens."""
        if len(self.known) > MOST_KNOWN:
            self.forget()
        self.known.fresh = []
        words = [w for own in texts for w in own]
        number = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
        fresh = self.known.fresh
        self.tokens = np.append(self.tokens, self.insert(fresh)[0].astype(np.int32))
        if LITERAL in fresh:
            self.tokens[self.known[LITERAL]] = -(3 * (self.octet * PACK - 1)) % PACK
        made, kept = np.zeros(len(words), np.int64), number != OTHER
        made[kept] = self.tokens[number[kept]]
        long: dict[str, int] = {}
        for i in np.flatnonzero(~kept).tolist():
            if words[i] not in long:
                long[words[i]] = self.plain(words[i])
            made[i] = long[words[i]]
        ends = np.cumsum([len(own) for own in texts], dtype=np.int64)
        return np.diff(np.append(0, np.cumsum(made))[np.append(0, ends)]).tolist()

    def forget(self) -> None:
        self.known, self.tokens = Numbers(LONG), np.zeros(0, np.int32)


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, n_chars (of the text), for each document."""
    unigrams = docs.sparkSession.sparkContext.broadcast(Unigrams(*unigram_scores(Pieces.load(model), piece_counts(docs, model))))
    names = ["doc_id", "n_tokens", "n_pretokens", "n_chars"]

    def run(batches):
        for batch in batches:
            for first, texts in text_blocks(batch, block=600_000):
                words = [pretokens(t) for t in texts]
                columns = unigrams.value.counts(words), [len(w) for w in words], [len(t) for t in texts]
                ids = batch.column(0).slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns)], names=names)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, ", ".join(f"{n} long" for n in names))
