import random

import numpy as np
import pytest
import sentencepiece
import xxhash

from weftline.llm.pieces import LITERAL, Pieces, Sampler, Together, mixed_all, pretokens, skips
from weftline.llm.sentencepieces import MODEL, decoded, encoded, encoding_report

TEXTS = ["", " ", "  ", "Hello world", " lead and trail ", "a  b   c    d", "line\nline\n\n  x\tz", "é日本語😀 ﬁ", "▁ in ▁▁ text▁", "the " * 50, "x" * 3000, "\n", "don't stop-me now 12345 3.14", " nbsp em"]


@pytest.fixture(scope="module")
def pieces():
    return Pieces.load(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_without_dropout_it_is_the_librarys_encoding(pieces, library, prose):
    sampler = Sampler(pieces, 0.0, 1)
    for t in [*TEXTS, *(prose(200, i) for i in range(20))]:
        if "▁" not in t:
            assert sampler.encode(t, 1) == library.encode(t), t


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_every_encoding_decodes(pieces, rate):
    sampler = Sampler(pieces, rate, 7)
    r = random.Random(1)
    random_texts = ["".join(r.choices("ab ▁\né😀the", k=r.randint(0, 40))) for _ in range(500)]
    for i, t in enumerate(TEXTS + random_texts):
        assert pieces.decode(sampler.encode(t, i)) == t


def test_dropout_varies_by_seed_and_repeats_for_equal_ones(pieces, prose):
    text = prose(300, 5)
    one, again, other = (Sampler(pieces, 0.2, s).encode(text, 3) for s in (1, 1, 2))
    assert one == again != other and len(one) > len(Sampler(pieces, 0.0, 1).encode(text, 3))
    assert len({tuple(Sampler(pieces, 0.2, 1).encode(text, d)) for d in range(40)}) == 40  # no two documents share skips
    assert len({tuple(Sampler(pieces, 0.5, 1).encode("▁", d)[1:]) for d in range(4)}) == 1
    words = " ".join(["then"] * 60)
    ids = [pieces.text[i] for i in Sampler(pieces, 0.5, 1).encode(words, 1)]
    assert len({p for p in ids if p.startswith(b" ")}) > 1  # one text has several segmentations of a word
    assert len(Sampler(pieces, 1.0, 1).encode("abc", 1)) == 4


def test_every_place_of_every_document_has_its_own_skips(pieces):
    word = "internationally"
    made = Sampler(pieces, 0.1, 42).encode(" ".join([word] * 4000), 1)
    text, seen, at = [], [], 0
    for i in made:
        text.append(i)
        at += len(pieces.text[i])
        if at == len(word) + 1:
            seen.append(tuple(text))
            text, at = [], 0
    assert len(seen) == 4000 and len(set(seen)) > 20
    limits = Sampler(pieces, 0.1, 42).limits
    skipped = [n for k in range(4000) for n in skips(k, limits, 50) if n < 50]
    assert all(abs(skipped.count(n) / 4000 - 0.1) < 0.025 for n in range(50))
    assert len({tuple(Sampler(pieces, 0.1, 42).encode(" ".join([word] * 20), d)) for d in range(200)}) == 200


def test_kept_encodings_are_those_of_the_agenda(pieces, prose):
    for rate in (0.0, 0.1, 0.6):
        sampler = Sampler(pieces, rate, 5, most=300)
        for d in range(20):
            text = prose(80, d % 3, 40) + " " + "longword" * 30
            n = len(pretokens(text))
            keys = mixed_all(np.arange(n, dtype=np.uint64), 0) ^ np.uint64(xxhash.xxh64_intdigest(str(d), 5))
            plain = [i for w, k in zip(pretokens(text), keys.tolist()) for i in pieces.encode_word(w, skips(k, sampler.limits, 3 * len(w)))[0]]
            assert sampler.encode(text, d) == plain


def test_what_is_kept_does_not_change_results(pieces, prose):
    texts = [prose(100, i) for i in range(30)]
    small, large = Sampler(pieces, 0.1, 3, most=50), Sampler(pieces, 0.1, 3)
    assert [small.encode(t, i) for i, t in enumerate(texts)] == [large.encode(t, i) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5])
def test_both_agendas_agree(pieces, prose, rate):
    r = random.Random(2)
    words = [w for t in [*TEXTS, prose(300, 1)] for w in pretokens(t)] + ["".join(r.choices("the▁inga", k=r.randint(1, 60))) for _ in range(2000)]
    for w in words:
        if len(w) < 500:
            assert pieces.merged_by_list(w, 12345, int(rate * 2**32)) == pieces.merged_by_heap(w, 12345, int(rate * 2**32)), w


def test_merges_of_many_words_are_those_of_each(pieces, prose):
    r = random.Random(4)
    words = [w for t in [*TEXTS, prose(200, 3)] for w in pretokens(t) if len(w) <= 40] + ["".join(r.choices("the▁ingaé日😀\ue000", k=r.randint(1, 40))) for _ in range(3000)]
    skipped = np.random.RandomState(1).rand(len(words), 120) < 0.15
    ids, lengths, numbers = Together(pieces).encode(words, skipped)
    ends = np.cumsum(lengths)
    for w, s, a, b, n in zip(words, skipped, ends - lengths, ends, numbers, strict=True):
        assert (ids[a:b].tolist(), n) == pieces.encode_word(w, iter(np.flatnonzero(s).tolist())), w


def test_long_texts_without_blanks(pieces, make):
    text = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=400_000))
    for rate in (0.0, 0.1):
        assert pieces.decode(Sampler(pieces, rate, 1).encode(text, 1)) == text
    assert [r.round_trip for r in encoding_report(make((1, text), (2, "日本語" * 50_000))).collect()] == [True, True]


def test_pretokens():
    assert pretokens("a b\nc  d") == ["▁a", "▁b", "\n", "c", "▁▁d"]
    assert pretokens("x▁y") == ["▁x", LITERAL, "y"]
    assert pretokens("") == []


def test_operators(make):
    docs = make(*TEXTS, (None, "no id"), (99, None), (3, "Hello world"))
    tokens = encoded(docs)
    texts = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in decoded(tokens).collect()))
    assert texts == sorted([*((False, i, t) for i, t in enumerate(TEXTS)), (True, 0, "no id"), (False, 99, ""), (False, 3, "Hello world")])
    rows = encoding_report(docs).collect()
    assert all(r.round_trip for r in rows) and len({r.ids_sha256 for r in rows if r.doc_id == 3}) == 1
    assert encoding_report(make().limit(0)).collect() == []
