"""A SentencePiece vocabulary of the merge (BPE) type, with byte fallback; its text form and its merges.

Blanks are written as ▁ and one is put before a text. No piece has a ▁ behind another character, nor a
line feed, so the merges of a text are those of its pre-tokens: runs of ▁ with the characters that
follow, and line feeds. A ▁ that is in the text itself is encoded as bytes, which keeps decoding lossless.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import xxhash

from weftline.llm.common import ranges

BLANK = "▁"
#: Stands for a ▁ of the text; no pre-token is like it, as a line feed is always by itself.
LITERAL = f"\n{BLANK}"
_RUNS = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")
_MASK = (1 << 64) - 1
NEVER = 1 << 60
#: Longer pre-tokens have a heap for an agenda.
SHORT_WORD = 32
#: Pre-tokens that are looked up together, and whose merges are made together.
SLICE, TOGETHER = 100_000, 4096


#: A gap of this many candidates only says that none of them is skipped. No pre-token that is kept has as many.
WIDEST = 128


def thresholds(drop: int) -> list[int]:
    """Ascending, of 2 ** 64: as many are above a hash as candidates stand before the next that is skipped."""
    keep, out, left = (1 << 32) - drop, [], 1 << 96
    for _ in range(WIDEST):
        left = left * keep >> 32
        out.append(min(left >> 32, _MASK))
    return out[::-1]


def mixed(key: int, draw: int) -> int:
    """A hash of a key, by its number; `mixed_all` gives it for arrays of keys."""
    x = (key + (draw + 1) * 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def mixed_all(keys: np.ndarray, draw: int) -> np.ndarray:
    x = keys + np.uint64((draw + 1) * 0x9E3779B97F4A7C15 & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def skips(key: int, limits: list[int], most: int) -> Iterator[int]:
    """The numbers, in the order of the agenda, of the candidates that are skipped: each is with the same probability, by itself.

    Ends with the first number that isn't below `most`.
    """
    at, draw = 0, 0
    while at < most:
        gap = WIDEST - bisect_right(limits, mixed(key, draw))
        at += gap
        draw += 1
        if gap < WIDEST:
            yield at
            at += 1
    yield at


def most_candidates(word: str) -> int:
    """Each merge makes two candidates at most."""
    return 3 * len(word)


def pretokens(text: str) -> list[str]:
    if not text:
        return []
    out: list[str] = []
    for k, part in enumerate(text.split(BLANK)):
        if k:
            out.append(LITERAL)
        written = (BLANK if k == 0 else "") + part.replace(" ", BLANK)
        if BLANK * 2 in written:
            out += _RUNS.findall(written)
        else:
            out += filter(None, written.replace(BLANK, f" {BLANK}").replace("\n", " \n ").split(" "))
    return out


@dataclass
class Pieces:
    """ids and ranks by piece (a rank of 0 merges first); text: the bytes of each id; octets: the id of byte 0."""

    ids: dict[str, int]
    ranks: dict[str, int]
    text: list[bytes]
    octets: int
    cache: dict = field(default_factory=dict)

    @staticmethod
    def load(path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(names)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if any(BLANK in names[i].lstrip(BLANK) or "\n" in names[i] for i in plain):
            raise ValueError("pre-tokens can't be told apart in this vocabulary")
        by_score = sorted({model.get_score(i) for i in plain}, reverse=True)
        rank = {s: k for k, s in enumerate(by_score)}
        octets = next(i for i in range(len(names)) if model.is_byte(i))
        text = [n.replace(BLANK, " ").encode() for n in names]
        text[octets : octets + 256] = [bytes([b]) for b in range(256)]
        return Pieces({names[i]: i for i in plain}, {names[i]: rank[model.get_score(i)] for i in plain}, text, octets)

    def fallback(self, symbol: str) -> list[int]:
        return [self.octets + b for b in symbol.encode("utf-8", "surrogatepass")]

    def merged(self, word: str, skipped: Iterator[int]) -> tuple[list[str], int]:
        """The symbols that the merges of a pre-token leave, best rank first, then leftmost, and how many candidates came up.

        The candidates of the numbers in `skipped`, which ascend, are skipped.
        The agenda of a short pre-token is a list of the ranks of neighbours, that of a long one a heap.
        """
        return self.by_list(word, skipped) if len(word) <= SHORT_WORD else self.by_heap(word, skipped)

    def merged_by_list(self, word: str, key: int = 0, drop: int = 0) -> list[str]:
        return self.by_list(word, skips(key, thresholds(drop), most_candidates(word)))[0]

    def merged_by_heap(self, word: str, key: int = 0, drop: int = 0) -> list[str]:
        return self.by_heap(word, skips(key, thresholds(drop), most_candidates(word)))[0]

    def by_list(self, word: str, skipped: Iterator[int]) -> tuple[list[str], int]:
        rank, symbols = self.ranks.get, list(word)
        agenda = [rank(word[i : i + 2], NEVER) for i in range(len(word) - 1)]
        number, skip = 0, next(skipped, NEVER)
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)
            number += 1
            if number > skip:
                agenda[i], skip = NEVER, next(skipped, NEVER)
                continue
            made = symbols[i] + symbols[i + 1]
            symbols[i] = made
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = rank(made + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + made, NEVER)
        return symbols, number

    def by_heap(self, word: str, skipped: Iterator[int]) -> tuple[list[str], int]:
        """The agenda's entries are whole numbers (rank, place, length), so a word of millions of characters takes some tens of bytes for each."""
        ranks, n = self.ranks, len(word)
        agenda = [ranks[p] << 48 | i << 8 | 2 for i in range(n - 1) if (p := word[i : i + 2]) in ranks]
        heapify(agenda)
        size = bytearray(b"\x01") * n  # of the symbol that begins at each place; 0 if none does
        before = array("i", range(-1, n - 1))
        number, skip = 0, next(skipped, NEVER)
        while agenda:
            entry = heappop(agenda)
            i, length = entry >> 8 & 0xFFFFFFFFFF, entry & 0xFF
            own = size[i]
            j = i + own
            if not own or j >= n or own + size[j] != length:
                continue  # one of the two has been merged meanwhile
            number += 1
            if number > skip:
                skip = next(skipped, NEVER)
                continue
            size[i], size[j] = length, 0
            k = i + length
            if k < n:
                before[k] = i
                if (r := ranks.get(word[i : k + size[k]])) is not None:
                    heappush(agenda, r << 48 | i << 8 | length + size[k])
            h = before[i]
            if h >= 0 and (r := ranks.get(word[h:k])) is not None:
                heappush(agenda, r << 48 | h << 8 | k - h)
        return [word[i : i + s] for i, s in enumerate(size) if s], number

    def encode_word(self, word: str, skipped: Iterator[int]) -> tuple[list[int], int]:
        """The ids, and how many candidates came up."""
        if word == LITERAL:
            return self.fallback(BLANK), 0
        symbols, number = self.merged(word, skipped)
        out = []
        for symbol in symbols:
            known = self.ids.get(symbol)
            if known is None:
                out += self.fallback(symbol)
            else:
                out.append(known)
        return out, number

    def decode(self, ids) -> str:
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


class Together:
    """The merges of many pre-tokens at a time, one candidate of each in a step, by arrays.

    Symbols are numbered: a piece by its id, other characters of pieces by numbers behind, all others by UNKNOWN. Pairs
    of symbols that make a piece are in one hash table of arrays.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.octets = pieces, len(pieces.text)
        symbols = dict(pieces.ids)
        for c in sorted({c for p in pieces.ids for c in p} - symbols.keys()):
            symbols[c] = self.octets + len(symbols)
        self.base = max([*symbols.values(), self.octets]) + 2
        self.unknown = self.base - 1
        self.of_point = np.full(0x110000, self.unknown, np.int32)
        for c, k in symbols.items():
            if len(c) == 1:
                self.of_point[ord(c)] = k
        pairs = {}
        for p, rank in pieces.ranks.items():
            for i in range(1, len(p)):
                if p[:i] in symbols and p[i:] in symbols:
                    pairs[symbols[p[:i]] * self.base + symbols[p[i:]]] = rank << 32 | pieces.ids[p]
        # a hash table with open addressing, a quarter full at most
        self.shift = 64 - (4 * len(pairs)).bit_length()
        self.slots, self.made = np.full(1 << 64 - self.shift, -1, np.int64), np.full(1 << 64 - self.shift, NEVER, np.int64)
        keys = np.array(list(pairs), np.int64)
        for key, value, at in zip(pairs, pairs.values(), self.home(keys).tolist(), strict=True):
            while self.slots[at] >= 0:
                at = (at + 1) % len(self.slots)
            self.slots[at], self.made[at] = key, value  # rank, then the piece

    def home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).view(np.int64)

    def candidates(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank and piece of each pair; NEVER if it makes none."""
        keys = (left.astype(np.int64) * self.base + right).ravel()
        at = self.home(keys)
        there = self.slots[at]
        out = self.made[at]
        out[there != keys] = NEVER
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.slots)
            there = self.slots[at[open_]]
            same = there == keys[open_]
            out[open_[same]] = self.made[at[open_[same]]]
            open_ = open_[~same & (there >= 0)]
        return out.reshape(left.shape)

    def encode(self, words: list[str], skipped: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, their number for each word, candidates that came up for each word); skipped: (words, numbers), whether a candidate is."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        lengths, numbers, ids = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [None] * len(words)
        flat, where = [], np.zeros(len(words), np.int64)
        at = 0
        for s in range(0, len(words), TOGETHER):
            part = order[s : s + TOGETHER]
            own, lengths[part], numbers[part] = self._some([words[i] for i in part.tolist()], sizes[part], skipped[part])
            where[part] = at + np.cumsum(lengths[part]) - lengths[part]
            at += len(own)
            flat.append(own)
        ids = np.concatenate([np.zeros(0, np.int32), *flat])
        ends = np.cumsum(lengths)
        return ids[np.repeat(where - (ends - lengths), lengths) + np.arange(at)], lengths, numbers

    def _some(self, words: list[str], sizes: np.ndarray, skipped: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, wide = len(words), int(sizes.max()) + 1
        inside = np.arange(wide) < sizes[:, None]
        symbols = np.full((n, wide), self.unknown, np.int32)
        symbols[inside] = self.of_point[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        plain = ~((symbols == self.unknown) & inside).any(axis=1) & np.fromiter((w != LITERAL for w in words), bool, n)
        agenda = np.full((n, wide), NEVER, np.int64)
        agenda[:, :-1] = self.candidates(symbols[:, :-1], symbols[:, 1:])
        alive, number = inside.copy(), np.zeros(n, np.int64)
        after, before = np.tile(np.arange(1, wide + 1), (n, 1)), np.tile(np.arange(-1, wide - 1), (n, 1))
        rows = np.flatnonzero(plain)
        while len(rows):
            i = agenda[rows].argmin(axis=1)
            best = agenda[rows, i]
            there = best < NEVER
            rows, i, best = rows[there], i[there], best[there]
            agenda[rows, i] = NEVER
            take = ~skipped[rows, number[rows]]
            number[rows] += 1
            r, i, made = rows[take], i[take], best[take].astype(np.int32)  # the lower half: the piece
            j = after[r, i]
            symbols[r, i], alive[r, j], agenda[r, j] = made, False, NEVER
            k, h = after[r, j], before[r, i]
            after[r, i] = k
            more = k < sizes[r]
            before[r[more], k[more]] = i[more]
            agenda[r[more], i[more]] = self.candidates(made[more], symbols[r[more], k[more]])
            less = h >= 0
            agenda[r[less], h[less]] = self.candidates(symbols[r[less], h[less]], made[less])
        odd = (symbols >= self.octets) & alive
        if not odd.any():
            return symbols[alive], alive.sum(axis=1), number
        out = [symbols[k, alive[k]].tolist() for k in range(n)]
        for k in np.flatnonzero(odd.any(axis=1)).tolist():
            out[k], number[k] = self.pieces.encode_word(words[k], iter(np.flatnonzero(skipped[k]).tolist()))
        return np.array([x for o in out for x in o], np.int32), np.array([len(o) for o in out]), number


class Numbers(dict):
    """Numbers of pre-tokens; OTHER for those of more than `longest` characters, which aren't kept. What isn't there yet gets the `next` number, and is in `fresh`."""

    def __init__(self, longest: int) -> None:
        self.longest, self.fresh, self.next = longest, [], 0

    def __missing__(self, word: str) -> int:
        if len(word) > self.longest:
            return OTHER
        self[word] = node = self.next
        self.next += 1
        self.fresh.append(word)
        return node


#: Of each node: its pre-token, its parent and its number there, the candidates that come up, where its children and its ids begin, the number of ids.
NODE = ("word", "parent", "own", "number", "children_at", "ids_at", "length")
OTHER = -1


def _grown(values: np.ndarray, size: int) -> np.ndarray:
    """`values` with room for `size` of them at least; what is new is OTHER."""
    if size <= len(values):
        return values
    out = np.full(max(size, len(values) * 3 // 2), OTHER, values.dtype)
    out[: len(values)] = values
    return out


class Sampler:
    """Encodes with merge dropout. Each candidate's skip follows from the seed, the document, the pre-token's place and
    the candidate's number in the agenda, so no two pre-tokens share their skips.

    Encodings that have come up are nodes of a tree: a root is a pre-token without skips, and a node's child at n is the
    encoding in which candidate n is skipped too. A node has room for as many children as candidates that come up: skips
    behind the last of them change nothing. All pre-tokens of a slice go down the tree together, one skip a step, until
    their next skip is behind the last candidate; the agenda makes the nodes that aren't there yet. The tree is begun
    anew once it has `most` nodes; results don't depend on it.
    """

    def __init__(self, pieces: Pieces, rate: float, seed: int, most: int = 500_000, longest: int = 40) -> None:
        self.pieces, self.rate, self.seed, self.most, self.longest = pieces, rate, seed, most, longest
        self.limits = thresholds(int(rate * (1 << 32)))
        self.ascending = np.array(self.limits, np.uint64)
        self.together = pieces.cache.setdefault("together", None) or Together(pieces)
        pieces.cache["together"] = self.together
        self.clear()

    def clear(self) -> None:
        self.roots, self.words = Numbers(self.longest), []
        self.nodes = self.n_children = self.n_ids = 0
        self.of_node = {name: np.full(1024, OTHER, np.int32) for name in NODE}
        self.children, self.ids = np.full(4096, OTHER, np.int32), np.full(4096, OTHER, np.int32)

    @staticmethod
    def of(pieces: Pieces, rate: float, seed: int) -> Sampler:
        """The one of these pieces, which an executor's worker keeps from task to task."""
        key = ("sampler", rate, seed)
        if key not in pieces.cache:
            pieces.cache[key] = Sampler(pieces, rate, seed)
        return pieces.cache[key]

    def add(self, word: np.ndarray, parent: np.ndarray, own: np.ndarray) -> None:
        """New nodes: of words by themselves (parent OTHER), or of parents whose candidate `own` is skipped too."""
        skipped, row, up = np.zeros((len(word), most_candidates("x" * self.longest)), bool), np.arange(len(word)), parent
        number = own
        while len(row := row[up >= 0]):
            number, up = number[up >= 0], up[up >= 0]
            skipped[row, number] = True
            number, up = self.of_node["own"][up], self.of_node["parent"][up]
        self._store(word, parent, own, *self.together.encode([self.words[w] for w in word.tolist()], skipped))

    def _store(self, word, parent, own, ids, lengths, numbers) -> None:
        a, b = self.nodes, self.nodes + len(lengths)
        self.of_node = {name: _grown(v, b) for name, v in self.of_node.items()}
        places = self.n_children + np.cumsum(numbers) - numbers, self.n_ids + np.cumsum(lengths) - lengths
        for name, values in zip(NODE, (word, parent, own, numbers, *places, lengths), strict=True):
            self.of_node[name][a:b] = values
        self.children = _grown(self.children, self.n_children + int(numbers.sum()))
        self.ids = _grown(self.ids, self.n_ids + len(ids))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.nodes, self.n_children, self.n_ids = b, self.n_children + int(numbers.sum()), self.n_ids + len(ids)

    def _rooted(self, words: list[str]) -> np.ndarray:
        """The nodes of pre-tokens without skips; OTHER for long ones."""
        if self.nodes >= self.most:
            self.clear()
        self.roots.next, self.roots.fresh = self.nodes, []
        node = np.fromiter(map(self.roots.__getitem__, words), np.int32, len(words))
        if fresh := self.roots.fresh:
            none = np.full(len(fresh), OTHER, np.int32)
            first = len(self.words)
            self.words += fresh
            self.add(np.arange(first, len(self.words)), none, none)
        return node

    def encode(self, text: str, document: int | None) -> list[int]:
        return self.packed([text], [document])[0].tolist()

    def packed(self, texts: list[str], documents: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and where each text's end (with a 0 before)."""
        made, sizes = [], [0]
        for text, document in zip(texts, documents, strict=True):
            words = pretokens(text)
            key = np.uint64(xxhash.xxh64_intdigest(str(document), self.seed))
            made.append((words, mixed_all(np.arange(len(words), dtype=np.uint64), 0) ^ key))
            sizes.append(len(words))
        words = [w for own, _ in made for w in own]
        keys = np.concatenate([np.zeros(0, np.uint64), *(k for _, k in made)])
        del made
        parts = [self._slice(words[i : i + SLICE], keys[i : i + SLICE]) for i in range(0, len(words), SLICE)]
        ids, lengths = (np.concatenate([np.zeros(0, np.int32), *p]) for p in (zip(*parts, strict=True) if parts else ((), ())))
        return ids, np.append(0, np.cumsum(lengths, dtype=np.int64))[np.cumsum(sizes)]

    def number_of_pieces(self, texts: list[str]) -> np.ndarray:
        """How often each id is in the encodings of the texts without dropout, by id."""
        words = [w for t in texts for w in pretokens(t)]
        out = np.zeros(len(self.pieces.text), np.int64)
        for i in range(0, len(words), SLICE):
            part = words[i : i + SLICE]
            node = self._rooted(part)
            for k in np.flatnonzero(node == OTHER).tolist():
                out += np.bincount(self.pieces.encode_word(part[k], iter(()))[0], minlength=len(out))
            number = np.bincount(node[node != OTHER], minlength=self.nodes)
            used = np.flatnonzero(number)
            length = self.of_node["length"][used]
            rows, owner = ranges(self.of_node["ids_at"][used].astype(np.int64), self.of_node["ids_at"][used] + length)
            out += np.bincount(self.ids[rows], number[used][owner], minlength=len(out)).astype(np.int64)
        return out

    def _slice(self, words: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens with their keys, and the number of ids of each."""
        node = self._rooted(words)
        of, long = self.of_node, np.flatnonzero(node == OTHER)
        active, at, draw = np.flatnonzero(node != OTHER), np.zeros(len(words), np.int64), 0
        while len(active):
            at[active] += WIDEST - np.searchsorted(self.ascending, mixed_all(keys[active], draw), "right")
            draw += 1
            active = active[at[active] < of["number"][node[active]]]
            slots = of["children_at"][node[active]] + at[active]
            absent = np.flatnonzero(self.children[slots] == OTHER)
            if len(absent):
                absent = absent[np.unique(slots[absent], return_index=True)[1]]
                self.children[slots[absent]] = self.nodes + np.arange(len(absent))
                parents = node[active[absent]]
                self.add(of["word"][parents], parents, at[active[absent]])
                of = self.of_node
            node[active] = self.children[slots]
            at[active] += 1
        whole = self.nodes, self.n_children, self.n_ids
        for i in long.tolist():
            ids, _ = self.pieces.encode_word(words[i], skips(int(keys[i]), self.limits, most_candidates(words[i])))
            node[i] = self.nodes
            self._store(OTHER, OTHER, OTHER, np.array(ids, np.int32), np.array([len(ids)]), np.array([0]))
        lengths = self.of_node["length"][node]
        ends = np.cumsum(lengths, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        out = self.ids[np.repeat(self.of_node["ids_at"][node] - (ends - lengths), lengths) + np.arange(total)]
        self.nodes, self.n_children, self.n_ids = whole
        return out, lengths
