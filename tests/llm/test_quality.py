import re
from collections import Counter

import numpy as np
import pytest

from weftline.llm.quality import RULES, Limits, beta_priors, counts, host_quality

BLANK = "\x20\x09-\x0d"


def plain_counts(text):
    words = re.findall(f"[^{BLANK}]+", text)
    lines = [x for x in text.split("\n") if re.search(f"[^{BLANK}]", x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {p for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), len(lines)


CASES = ["", " \n\t", "a", "a b\x0bc\x0cd\xa0e f", "x " * 9, "x " * 8, "one two three four five six seven eight " * 3 + "end", "a\nb\na\n\n\na\n  \n", "é#ü|<>&&\n*$%", "a b c d e f g h i a b c d e f g h j a b c d e f g h", "w" * 100_000]


@pytest.mark.parametrize("text", CASES)
def test_counts(text):
    assert counts(text) == plain_counts(text)


def test_counts_of_texts_with_repeats(prose):
    for seed in range(30):
        text = prose(300, seed, vocabulary=3 + seed * 4)
        assert counts(text) == plain_counts(text)
    long = prose(30_000, 1, 40)
    assert counts(long)[4] == plain_counts(long)[4]


def test_verdicts(make, prose, spark):
    good = [prose(60, i) for i in range(120)]
    docs = make(*good, source="good").union(make(*[(1100 + i, " ".join(f"${j}#" for j in range(40)) + " " + prose(30, i)) for i in range(30)], (200, prose(60, 7)), (201, None), source="bad")).union(make((300, " ".join(f"${j}#" for j in range(40)) + " " + prose(30, 2)), source="small")).union(make((400, prose(60, 1)), source=None))
    rows = {r.doc_id: r for r in host_quality(docs).collect()}
    assert all(rows[i].kept and not rows[i].base_failed for i in range(120))
    assert not rows[1100].base_failed and rows[1100].host_rejected and not rows[1100].kept and not rows[200].kept
    assert rows[201].base_failed and not rows[201].kept and rows[201].n_words == 0
    assert not rows[300].host_rejected  # one failing document alone doesn't reject a host
    assert rows[400].kept and rows[400].host is None and rows[400].host_docs == 0


def test_empty_and_repeated_rows(make, prose):
    assert host_quality(make().limit(0)).collect() == []
    rows = host_quality(make((1, prose(50, 1)), (1, prose(50, 1)), (None, "x"))).collect()
    assert len(rows) == 3 and {r.host_docs for r in rows} == {3}


def test_many_hosts_join_without_broadcast(make, prose, monkeypatch):
    from weftline.llm import quality

    docs = make(*[prose(50, i) for i in range(6)])
    before = sorted(map(tuple, host_quality(docs).collect()))
    monkeypatch.setattr(quality, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, host_quality(docs, limits=Limits()).collect())) == before


def test_prior_is_that_of_the_hosts(spark):
    """Hosts of one true rate give a strong prior however few documents each has, hosts of many rates their own."""
    r = np.random.RandomState(5)
    for docs, a, b in ((3, None, None), (20, None, None), (3, 2.0, 6.0), (5, 1.0, 3.0), (200, 4.0, 16.0)):
        rates = np.full(4000, 0.3) if a is None else r.beta(a, b, 4000)
        rows = [(docs, *(int(r.binomial(docs, p)) for _ in RULES)) for p in rates]
        hosts = spark.createDataFrame(rows, ", ".join(f"host_{c} long" for c in ["docs", *RULES]))
        priors, number = beta_priors(hosts, Limits())
        assert number == 4000
        for first, strength in priors.values():
            if a is None:
                assert strength > 25 and abs(first / strength - 0.3) < 0.02
            else:
                assert 0.75 * (a + b) < strength < 1.35 * (a + b) and abs(first / strength - a / (a + b)) < 0.03
    single = spark.createDataFrame([(1, 1, 0, 1, 0)], ", ".join(f"host_{c} long" for c in ["docs", *RULES]))
    assert {s for _, s in beta_priors(single, Limits())[0].values()} == {Limits().max_strength}
