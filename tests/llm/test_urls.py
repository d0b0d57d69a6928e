import math
import zlib
from collections import Counter

import numpy as np
import pytest

from weftline.llm.urls import ORDER, SIZE, difference, grams, log_model, symbols, threshold, url_verdicts


def pages(spark, *urls):
    return spark.createDataFrame([(i, u, "h", "x", "y", 1.0) for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, verdict string, score double")


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?q#f", "https://net/", "https://xnet/a", "http://a.net", "http://b.example.com/de/1", "http://example.com/DE/", "ftp://x.org/fr/?a=/b", "http://a.org/de/fr/", "a://b://c/d", "http://é.ÉX.net/ü", "http://?x", "http://example.net/en/", "http://notexample.net/en/"]
    rows = {r.page_id: r for r in url_verdicts(pages(spark, *urls)).collect()}
    got = [(rows[i].host, rows[i].path, rows[i].rule) for i in range(len(urls))]
    assert got == [
        ("", "", None), ("", "", None), ("", "", None), ("a.example.net", "/en/x", "example.net/en/"), ("net", "/", "net/"), ("xnet", "/a", None), ("a.net", "", None), ("b.example.com", "/de/1", "example.com/de/"), ("example.com", "/DE/", None), ("x.org", "/fr/", "org/fr/"), ("a.org", "/de/fr/", None),
        ("b:", "//c/d", None), ("é.Éx.net", "/ü", "net/"), ("", "", None), ("example.net", "/en/", "example.net/en/"), ("notexample.net", "/en/", "net/"),
    ]
    assert {rows[i].verdict for i in (3, 9, 14)} == {"allow"} and {rows[i].verdict for i in (4, 7, 12, 15)} == {"block"}
    assert all(r.verdict in ("allow", "block") for r in rows.values())


def test_models_sum_to_one():
    counts = np.zeros(SIZE ** (ORDER + 1), np.int64)
    np.add.at(counts, grams(symbols("http://example.com/abc/abd")), 1)
    assert np.allclose(np.exp(log_model(counts)).reshape(-1, SIZE).sum(axis=1), 1, atol=1e-4)


def test_model_equals_a_plain_one():
    texts = ["x://abcab", "x://abd", "x://b"]
    counts = np.zeros(SIZE ** (ORDER + 1), np.int64)
    seen: dict[tuple, dict[int, int]] = {}
    for t in texts:
        s = symbols(t).tolist()
        np.add.at(counts, grams(np.array(s)), 1)
        for i in range(ORDER, len(s)):
            for k in range(ORDER + 1):
                row = seen.setdefault(tuple(s[i - k : i]), {})
                row[s[i]] = row.get(s[i], 0) + 1

    def p(context, c):
        shorter = p(context[1:], c) if context else 1 / SIZE
        row = seen.get(tuple(context))
        return shorter if not row else (row.get(c, 0) + len(row) * shorter) / (sum(row.values()) + len(row))

    model = log_model(counts)
    s = symbols("x://abcabd").tolist()
    for i in range(ORDER, len(s)):
        assert math.isclose(model[grams(np.array(s))[i - ORDER]], math.log(p(s[i - ORDER : i], s[i])), abs_tol=1e-4)
    assert difference(None, model) == 0.0 and difference("", model) == 0.0


def test_learned_verdicts(spark):
    urls = [f"http://good{i}.example.net/en/{i}" for i in range(200)] + [f"http://evil{i}.net/pills/{i}" for i in range(200)]
    rows = url_verdicts(pages(spark, *urls, "http://good7.example.biz/en/3", "http://evil9.biz/pills/4")).collect()
    assert {r.page_id: r.verdict for r in rows if r.page_id >= 400} == {400: "allow", 401: "block"}


def test_threshold():
    assert threshold([(5, "allow", 10), (-5, "block", 10)]) == 0.0
    assert threshold([(9, "allow", 10), (5, "block", 9), (9, "block", 1)]) == pytest.approx(6 * 0.005)
    assert threshold([]) == 0.0


def test_odd_tables(spark):
    assert url_verdicts(pages(spark).limit(0)).collect() == []
    only = url_verdicts(pages(spark, "http://a.com/", "http://a.com/")).collect()
    assert [r.verdict for r in only] == ["allow", "allow"]
    long = url_verdicts(pages(spark, "http://a.net/" + "x" * 100_000)).first()
    assert long.rule == "net/"


def plain_verdicts(urls):
    """The whole query, url by url: rules by hand, models as dictionaries, every edge of bins tried."""
    listed = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    rows = []
    for u in urls:
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = rest[: min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))]
            path = rest[len(host) :]
            path = path[: min([i for i, c in enumerate(path) if c in "?#"], default=len(path))]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(t), t, v) for t, v in listed if host and (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])]
        rows.append((host, path, *(max(fits)[1:] if fits else (None, None))))

    def coded(u):
        text = (u or "").partition("://")[2] or (u or "")
        marks = "/.-_?=&#:%+~"
        code = lambda b: 2 if 48 <= b <= 57 else 3 + b - 97 if 97 <= b <= 122 else 3 + b - 65 if 65 <= b <= 90 else 29 + marks.index(chr(b)) if b < 128 and chr(b) in marks else 1
        return [0, 0, 0, *map(code, text.encode()), 0] if text else []

    part = [zlib.crc32((u or "").encode()) % 5 for u in urls]
    seen = {"allow": {}, "block": {}}
    for u, p, (_, _, _, v) in zip(urls, part, rows, strict=True):
        s = coded(u)
        for i in range(3, len(s)) if v and p else ():
            for k in range(4):
                row = seen[v].setdefault(tuple(s[i - k : i]), Counter())
                row[s[i]] += 1

    def log_p(side, s):
        total = 0.0
        for i in range(3, len(s)):
            p = 1 / SIZE
            for k in range(4):
                row = seen[side].get(tuple(s[i - k : i]))
                p = (row[s[i]] + len(row) * p) / (sum(row.values()) + len(row)) if row else p
            total += math.log(p)
        return total

    score = [(log_p("allow", s) - log_p("block", s)) / (len(s) - 3) if (s := coded(u)) and all(seen.values()) else 0.0 for u in urls]
    held = [(math.floor(x / 0.005), r[3]) for x, p, r in zip(score, part, rows, strict=True) if r[3] and not p]

    def right(edge):
        share = lambda v, below: sum(x == v and (b < edge) == below for b, x in held) / max(1, sum(x == v for _, x in held))
        return round(share("block", True) + share("allow", False), 9)

    limit = min(range(-1600, 1601), key=lambda e: (-right(e), abs(e), e)) * 0.005
    return [(h, p, r, v or ("allow" if x >= limit else "block"), x) for (h, p, r, v), x in zip(rows, score, strict=True)]


def test_whole_query_against_plain_version(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    urls = {r.page_id: r.url for r in spark.read.parquet(path).collect()}
    expected = dict(zip(urls, plain_verdicts(list(urls.values())), strict=True))
    rows = url_verdicts(spark.read.parquet(path)).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict, score = expected[r.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict) and abs(r.score - score) < 1e-4, r
