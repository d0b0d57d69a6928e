import random
import re

import pytest

from weftline.llm import decontamination
from weftline.llm.decontamination import Index, banded, clean, contaminated, found_in, gram_hashes, normal, segments


@pytest.fixture(scope="module")
def items(prose):
    return [(i, prose(12 + 5 * i, 1000 + i)) for i in range(8)]


def edited(text, number, seed):
    r, c = random.Random(seed), list(text)
    for _ in range(number):
        p = r.randrange(len(c))
        kind = r.random()
        if kind < 0.4:
            c[p] = "#"
        elif kind < 0.7:
            del c[p]
        else:
            c.insert(p, "#")
    return "".join(c)


def within(window, text):
    """The least edits between the window and any passage of text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        after = [i]
        for j, d in enumerate(text, 1):
            after.append(min(row[j - 1] + (c != d), row[j] + 1, after[-1] + 1))
        row = after
    return min(row)


def test_equals_full_alignment(items, prose):
    """A window is found exactly if some passage lies within its budget."""
    index = Index.of(items)
    r = random.Random(1)
    for k in range(60):
        w = r.randrange(len(index.texts))
        text = f"{prose(20, k)} {edited(index.texts[w], k % 12, k)} {prose(20, k + 500)}"
        got = index.contained(normal(text))
        edits = within(index.texts[w], normal(text))
        assert (w in got) == (edits <= index.budgets[w])
        if w in got:
            assert got[w] == edits


def test_runs_of_words_are_found_at_any_offset(prose):
    item = prose(200, 7777)
    words, index = item.split(), Index.of([(1, item)])
    for start in range(0, 200 - 13):
        text = normal(f"{prose(30, start)} {' '.join(words[start : start + 13])} {prose(30, start + 500)}")
        assert index.contained(text), start
        assert not index.contained(normal(f"{prose(30, start)} {' '.join(words[start : start + 7])} {prose(30, start + 500)}"))
    joined = item.replace(" ", "")
    index = Index.of([(1, joined)])
    assert all(index.contained(prose(9, i) + joined[i : i + 132] + prose(9, i + 1)) for i in range(0, len(joined) - 132, 7))


@pytest.mark.parametrize("length", [12, 16, 17, 20, 23, 24, 33, 34, 35, 36, 50])
def test_short_items_are_found_within_their_budget(prose, length):
    item = prose(30, 900 + length)[: length - 1] + "z"
    index = Index.of([(1, item)])
    for k in range(40):
        text = normal(f"{prose(8, k)} {edited(item, k % 4, k)} {prose(8, k + 500)}")
        edits = within(item, text)
        assert index.contained(text) == ({0: edits} if edits <= int(0.06 * length) else {}), text
        assert found_in(index, ["", text])[1] == index.contained(text)


def test_items_shorter_than_a_gram_are_found_as_whole_words(prose):
    index = Index.of([(1, "x = 42"), (2, "Tiny"), (3, "été 1 2 3 4"), (4, prose(40, 1)), (5, " ")])
    found = [{index.items[w] for w in f} for f in found_in(index, ["say x =  42.", "max = 420, destiny", "TINY", "(été 1 2 3 4)", "tin y", ""])]
    assert found == [{1}, set(), {2}, {3}, set(), set()]
    assert found_in(Index.of([(1, "a")]), ["b", "b a"]) == [{}, {0: 0}]


def test_banded():
    assert banded("abcdef", "xxabcdefxx", 0, 1) == 0 and banded("abcdef", "xxabXdefxx", 1, 1) == 1 and banded("abcdef", "xxabdefxx", 1, 1) == 1
    assert banded("abcdef", "xxxxxx", 0, 1) is None and banded("abcdef", "bcdef", -1, 1) == 1 and banded("abc", "", 0, 1) is None


def test_operator(make, items, prose, spark):
    passage, other = items[7][1], items[6][1]
    docs = make(
        (1, prose(50, 1)), (2, f"{prose(30, 2)} {passage} {prose(30, 3)}"), (3, f"{prose(30, 4)} {passage.upper()}".replace(" ", "\n\t")), (4, f"{passage} {other}"), (5, None), (6, ""), (7, edited(passage, 3, 1)), (7, edited(passage, 3, 1)),
        (8, " ".join(passage.split()[:6])), (None, passage), (9, f"{prose(20, 9)} {' '.join(passage.split()[8:])}"),
    )
    bench = spark.createDataFrame([*items, (50, None), (51, "tiny"), (None, passage), items[7]], "item_id long, text string").selectExpr("*", "'q' as doc_id")
    rows = contaminated(docs, bench).collect()
    found = sorted(((r.doc_id, r.item_id) for r in rows), key=str)
    assert found == sorted([(2, 7), (3, 7), (4, 6), (4, 7), (7, 7), (7, 7), (9, 7), (None, 7)], key=str)
    assert {r.edits for r in rows if r.doc_id in (2, 3, 4)} == {0}
    kept = clean(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 6, 8] and kept.columns == docs.columns
    assert contaminated(docs, bench.limit(0)).collect() == [] and contaminated(docs.limit(0), bench).collect() == []
    assert clean(docs, bench.limit(0)).count() == docs.count()


def test_blocks_of_the_benchmark(make, items, spark, monkeypatch):
    docs = make(*(f"before {t} after" for _, t in items))
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK", 300)
    assert sorted(map(tuple, contaminated(docs, bench).collect())) == whole
    assert clean(docs, bench).count() == 0


def test_only_one_index_is_alive(make, items, spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK", 300)
    alive, most, kept = set(), [], decontamination.Index.of
    context = type(spark.sparkContext)
    broadcast = context.broadcast

    def counted(self, value):
        made = broadcast(self, value)
        if isinstance(value, Index):
            alive.add(id(made))
            most.append(len(alive))
            destroy = made.destroy
            made.destroy = lambda: (alive.discard(id(made)), destroy())
        return made

    monkeypatch.setattr(context, "broadcast", counted)
    docs = make(*(f"before {t} after" for _, t in items), "clean", None, (99, "clean"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(r.doc_id for r in clean(docs, bench).collect()) == [8, 9, 99] and kept
    assert contaminated(docs, bench).count() == len(items) and len(most) > 2 and max(most) == 1


def test_runs_of_a_short_period(prose):
    """89 places of an item times a segment of one character would be 35 million pairs; runs are shortened, and hits counted in slices."""
    index = Index.of([(1, "a" * 100 + " " + prose(30, 5)), (2, "b" * 60), (3, "-=" * 40)])
    text = f"{prose(5, 1)} {'a' * 390_000}"
    assert {int(index.items[w]) for w in found_in(index, [text])[0]} <= {1}
    assert {int(index.items[w]) for w in found_in(index, [f"{text} {'b' * 60}"])[0]} >= {2}
    assert {int(index.items[w]) for w in found_in(index, [f"{'=-' * 150_000} x"])[0]} == {3}


def test_shortened_texts_have_the_same_passages():
    r = random.Random(4)
    for _ in range(20):
        text = "".join(r.choices("abc", k=50)) + "".join(u * r.randint(1, 400) + r.choice(["", "x", "yz"]) for u in r.choices(["a", "ab", "abc", "-=-+", "é "], k=6))
        short = decontamination.squeezed(text)
        passages = lambda t: {t[i : i + 140] for i in range(len(t) - 139)}
        assert passages(short) == passages(text) and len(short) <= len(text)
    assert len(decontamination.squeezed("ab" * 100_000)) < 1000 and decontamination.squeezed("") == ""


def test_short_items_against_brute_force(prose, make, spark):
    """Items of 3 to 60 characters, also with edits: the whole report equals a search by full tables."""
    r = random.Random(11)
    words = prose(400, 77)
    bench = [(n, words[17 * n : 17 * n + n].strip().ljust(n, "z")) for n in range(3, 61, 3)]
    texts = [f"{prose(6, n)} {edited(t, r.choice((0, 0, 1, 2, 3)), n) if n >= 12 else t} {prose(6, n + 900)}" for n, t in bench for _ in range(3)]
    expected = set()
    for d, t in enumerate(texts):
        for n, item in bench:
            flat = normal(item)
            spans = [flat[a:b] for a, b in {*decontamination.halves(flat), *decontamination.runs(flat)}]
            for w in spans:
                whole = re.search(rf"(?<!\w){re.escape(w)}(?!\w)", normal(t))
                if whole if len(w) < 12 else within(w, normal(t)) <= int(0.06 * len(w)):
                    expected.add((d, n))
    got = {(x.doc_id, x.item_id) for x in contaminated(make(*texts), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == expected and len(got) > 30


def test_long_texts_are_searched_whole(items, prose, monkeypatch):
    index = Index.of(items)
    text = f"{prose(3000, 1)} {items[5][1]} {prose(3000, 2)} {items[3][1]}"
    whole = found_in(index, [text])[0]
    assert {index.items[w] for w in whole} == {5, 3}
    monkeypatch.setattr(decontamination, "SEGMENT", 1000)
    assert found_in(index, [text])[0] == whole
    assert all(any(normal(items[5][1])[:100] in s for s in segments(normal(text))) for _ in range(1))


def test_hashes_of_equal_grams_are_equal():
    text = "abcdefghijklmnopqrstuvwxyzabcdefghijklm"
    h = gram_hashes(text)
    assert len(h) == len(text) - 11 and h[0] == h[26] and len(set(h.tolist())) == 26 and len(gram_hashes("short")) == 0
