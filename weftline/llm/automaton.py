"""Deterministic automata for sets of byte patterns.

Patterns are compiled to one nondeterministic automaton, made deterministic by subset construction and
minimised by refining partitions of its states; the outcome is an array of transitions by state and
class of bytes, and a bit set of matched patterns for each state.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from operator import getitem

import numpy as np



class _Nfa:
    """States with edges on sets of bytes, and empty edges."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, items, start: int) -> int:
        """Adds a parsed sequence from state `start`; gives the state where it ends."""
        for kind, value in items:
            if kind is op.LITERAL:
                start = self.step(start, frozenset([value]))
            elif kind is op.IN:
                start = self.step(start, _members(value))
            elif kind is op.SUBPATTERN:
                start = self.add(value[3], start)
            elif kind is op.BRANCH:
                end = self.state()
                for branch in value[1]:
                    self.empty[self.add(branch, start)].append(end)
                start = end
            elif kind is op.MAX_REPEAT:
                start = self.repeat(*value, start)
            else:
                raise ValueError(f"{kind} isn't supported in a rule")
        return start

    def step(self, start: int, members: frozenset) -> int:
        end = self.state()
        self.edges[start].append((members, end))
        return end

    def repeat(self, least: int, most: int, items, start: int) -> int:
        for _ in range(least):
            start = self.add(items, start)
        if most is op.MAXREPEAT:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(items, loop)].append(loop)
            return loop
        end = self.state()
        self.empty[start].append(end)
        for _ in range(most - least):
            start = self.add(items, start)
            self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        todo, found = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)


def _members(items) -> frozenset:
    out, negated = set(), False
    for kind, value in items:
        if kind is op.NEGATE:
            negated = True
        elif kind is op.LITERAL:
            out.add(value)
        elif kind is op.RANGE:
            out.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"{kind} isn't supported in a rule")
    return frozenset(range(256)) - out if negated else frozenset(out)


@dataclass(frozen=True)
class Automaton:
    """table[state, classes[byte]] is the next state; matched[state] has a bit for each pattern that ends there.

    State 0 is the start. dead is the state that leads nowhere, or -1.
    """

    table: np.ndarray
    classes: np.ndarray
    matched: np.ndarray
    dead: int

    @staticmethod
    def of(patterns: list[str], anywhere: bool) -> Automaton:
        """anywhere: a match may begin at any byte; else only where the scan begins."""
        nfa = _Nfa()
        start = nfa.state()
        ends = {}
        for i, p in enumerate(patterns):
            first = nfa.state()
            nfa.empty[start].append(first)
            ends[nfa.add(parser.parse(p), first)] = 1 << i
        classes = _byte_classes(nfa)
        samples = [int(np.flatnonzero(classes == c)[0]) for c in range(classes.max() + 1)]
        moves = [[[t for members, t in edges if b in members] for edges in nfa.edges] for b in samples]
        closures = [nfa.closure([s]) for s in range(len(nfa.edges))]
        begin = closures[start]
        names, rows, queue = {begin: 0}, [], [begin]
        for subset in queue:  # grows while it is read
            row = []
            for by_state in moves:
                after = frozenset().union(*(closures[t] for s in subset for t in by_state[s]), begin if anywhere else ())
                if after not in names:
                    names[after] = len(names)
                    queue.append(after)
                row.append(names[after])
            rows.append(row)
        matched = np.array([reduce(int.__or__, (ends.get(s, 0) for s in subset), 0) for subset in queue], np.int64)
        return _minimal(np.array(rows, np.int32), classes, matched)

    def rows(self, stop_at_match: bool) -> list:
        """The start's row of linked rows: row[byte] is the next row. For one lookup a byte, in C.

        stop_at_match: a state with a match is an empty row, so that going on from it raises IndexError.
        """
        made = [() if stop_at_match and m else [None] * 256 for m in self.matched]
        order = self.classes.tolist()
        for row, nexts in zip(made, self.table.tolist(), strict=True):
            if row != ():
                row[:] = [made[nexts[c]] for c in order]
        return made


def _byte_classes(nfa: _Nfa) -> np.ndarray:
    """Bytes that no edge tells apart share a class."""
    sets = {members for edges in nfa.edges for members, _ in edges}
    signature = np.array([[b in s for s in sets] for b in range(256)]).reshape(256, -1)
    return np.unique(signature, axis=0, return_inverse=True)[1].reshape(-1).astype(np.int32)


def _minimal(table: np.ndarray, classes: np.ndarray, matched: np.ndarray) -> Automaton:
    """Splits the blocks of equal matches until the states of a block go to equal blocks."""
    block = np.unique(matched, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    first = np.unique(block, return_index=True)[1]
    order = np.argsort(first, kind="stable")  # the start keeps number 0
    number = np.empty_like(order)
    number[order] = np.arange(len(order))
    keep = first[order]
    small = number[block[table[keep]]].astype(np.int32)
    match = matched[keep]
    dead = np.flatnonzero((small == np.arange(len(small))[:, None]).all(axis=1) & (match == 0))
    return Automaton(small, classes, match, int(dead[0]) if len(dead) else -1)


def finds(rows: list, data: bytes) -> bool:
    """Whether a match ends anywhere in data; rows: of an automaton, with stop_at_match."""
    try:
        return reduce(getitem, data, rows[0]) == ()
    except IndexError:
        return True
