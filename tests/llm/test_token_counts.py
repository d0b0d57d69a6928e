import math
import random
from collections import Counter

import numpy as np
import pytest

from weftline.llm import token_counts as module
from weftline.llm.pieces import BLANK, LITERAL, Pieces, pretokens
from weftline.llm.sentencepieces import MODEL
from weftline.llm.token_counts import Unigrams, piece_counts, token_counts, unigram_scores

TEXTS = ["", " ", "  ", "Hello world", " lead and trail ", "a  b   c    d", "line\nline\n\n  x\tz", "é日本語😀 ﬁ", "▁ in ▁▁ text▁", "the " * 50, "x" * 3000, "\n", "don't stop-me now 12345 3.14", " nbsp em"]


@pytest.fixture(scope="module")
def pieces():
    return Pieces.load(MODEL)


def plain_count(scores, octet, text):
    """The best segmentation of the whole text, character by character."""
    whole = "".join("\x00" if w == LITERAL else w for w in pretokens(text))
    best = [(0, 0)] + [None] * len(whole)
    for end in range(1, len(whole) + 1):
        choices = []
        for start in range(max(0, end - 16), end):
            s = scores.get(whole[start:end])
            if s is None and end - start == 1:
                n = 3 if whole[start] == "\x00" else len(whole[start].encode())
                choices.append((best[start][0] + n * octet, best[start][1] - n))
            elif s is not None:
                choices.append((best[start][0] + s, best[start][1] - 1))
        best[end] = max(choices)
    return -best[-1][1]


def plain_scores(pieces, texts):
    """Merges one pair at a time, best rank first, over whole pre-tokens; then logarithms of shares."""
    number = Counter()
    for t in texts:
        for w in pretokens(t or ""):
            symbols = [BLANK] if w == LITERAL else list(w)
            while w != LITERAL and (found := [(pieces.ranks[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in pieces.ranks]):
                i = min(found)[1]
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            for x in symbols:
                if x in pieces.ids and w != LITERAL:
                    number[pieces.ids[x]] += 1
                else:
                    number.update(pieces.octets + b for b in x.encode())
    total = sum(number.values()) + len(pieces.text)
    score = lambda n: round(1e6 * (math.log(n + 1) - math.log(total)))
    return {p: score(number[i]) for p, i in pieces.ids.items()}, score(sum(number[pieces.octets + b] for b in range(256)) / 256)


def test_counts_equal_plain_dynamic_programming(pieces, prose, monkeypatch):
    r = np.random.RandomState(1)
    for counts in (np.zeros(len(pieces.text), np.int64), r.zipf(1.3, len(pieces.text)) % 100_000):
        scores, octet = unigram_scores(pieces, counts)
        model = Unigrams(scores, octet)
        texts = [*TEXTS, *(prose(60, i) for i in range(10)), "".join(random.Random(3).choices("the ▁inga\n日é", k=4000))]
        expected = [plain_count(scores, octet, t) for t in texts]
        assert model.counts([pretokens(t) for t in texts]) == expected
        monkeypatch.setattr(module, "LONG", 3)
        assert Unigrams(scores, octet).counts([pretokens(t) for t in texts]) == expected
        monkeypatch.undo()
        monkeypatch.setattr(module, "MOST_KNOWN", 5)
        assert [model.counts([pretokens(t)])[0] for t in texts] == expected
        monkeypatch.undo()


def test_prefixes_are_shared(pieces):
    model = Unigrams(*unigram_scores(pieces, np.zeros(len(pieces.text), np.int64)))
    assert model.insert(["▁abcd", "▁abce", "▁abc"])[1] == 6
    assert model.insert([]) [1] == 0


def test_long_words_take_no_room(pieces):
    model = Unigrams(*unigram_scores(pieces, np.zeros(len(pieces.text), np.int64)))
    word = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=300_000))
    assert 0 < model.counts([[word]])[0] < len(word) and not model.known and not len(model.tokens)


def test_whole_query_against_plain_version(make, prose, pieces):
    texts = [*TEXTS, *(prose(80, i) for i in range(5)), None, "Hello world"]
    docs = make(*enumerate(texts))
    scores, octet = plain_scores(pieces, texts)
    assert (scores, octet) == unigram_scores(pieces, piece_counts(docs))
    got = {r.doc_id: (r.n_tokens, r.n_pretokens, r.n_chars) for r in token_counts(docs).collect()}
    assert got == {i: (plain_count(scores, octet, t or ""), len(pretokens(t or "")), len(t or "")) for i, t in enumerate(texts)}


def test_defined_cases(make):
    rows = sorted(token_counts(make((1, "Hello world"), (1, "Hello world"), (2, None), (None, ""))).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    assert [(r.n_tokens > 0, r.n_pretokens, r.n_chars) for r in rows] == [(False, 0, 0), (True, 2, 11), (True, 2, 11), (False, 0, 0)]
    assert token_counts(make().limit(0)).collect() == []
