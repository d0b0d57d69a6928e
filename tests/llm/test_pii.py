import hashlib
import re

from weftline.llm.pii import pii_report, pii_spans

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub(r"\D", "", m)
    return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def plain(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if valid(kind, m[0])]
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found))


TEXTS = [
    "", None, "a@b.c_d@e.f x@y", "@a.b a@b. c@d.e.f-g.", "1.2.3.4.5 256.1.1.1 001.02.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 0000000000000000 12", "+1 (415) 555-0100, +12 3 +49.30.1234567 +1 2", "é😀 mail me: a.b+c%d@ex-ample.co.uk 10.0.0.1 😀 +44 20 7946 0958",
    "4111111111111111 a@b.cc 4111 1111 1111 1111 a@b.cc", "1" * 5000 + "@" + "a" * 5000, "1 " * 3000, "a@b.c " * 400, "+" + "1-" * 2000, "." * 5000 + "@x.y", "x" * 200_000,
]


def test_base_spans_equal_plain_matching(make):
    rows = {r.doc_id: r for r in pii_report(make(*TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        expected = plain(text or "")
        base = ",".join(x for x in rows[i].spans.split(",") if x.split(":")[0] in PATTERNS)
        assert base == expected, i
        assert rows[i].base_sha256 == hashlib.sha256(expected.encode()).hexdigest()
        assert rows[i].n_email == expected.count("email:") and rows[i].n_ip == expected.count("ip:")


def test_added_spans_need_checksums_and_context(make):
    texts = ["my iban is DE89 3704 0044 0532 0130 00.", "DE88370400440532013000 fails", "pay GB82WEST12345698765432", "social security 078-05-1120", "part no. 078-05-1120", "ssn 000-12-3456"]
    rows = {r.doc_id: r for r in pii_report(make(*texts)).collect()}
    assert [(rows[i].n_iban, rows[i].n_ssn) for i in range(6)] == [(1, 0), (0, 0), (1, 0), (0, 1), (0, 0), (0, 0)]
    assert "iban:11:38" in rows[0].spans
    spans = {r.doc_id: [(s.kind, s.score) for s in r.spans] for r in pii_spans(make(*texts)).collect()}
    assert ("iban", 100) in spans[0] and ("iban", 70) in spans[2]


def test_words_of_context_are_whole_and_on_either_side(make):
    texts = ["recipe 10.0.0.1 shipped", "the ip 10.0.0.1", "10.0.0.1 is the host.", "hotel +49 30 1234567", "078-05-1120 (SSN)", f"ssn {'x' * 60} 078-05-1120", f"ssn{'x' * 50}078-05-1120", "sssn 078-05-1120"]
    spans = {r.doc_id: [(s.kind, s.score) for s in r.spans if s.kind != "card"] for r in pii_spans(make(*texts)).collect()}
    assert [spans[i] for i in range(8)] == [[("ip", 60)], [("ip", 90)], [("ip", 90)], [("phone", 60)], [("ssn", 70)], [], [], []]


def test_ibans_have_their_countrys_length(make):
    texts = ["BE68 5390 0754 7034 PAID TODAY", "pay BE68539007547034 now", "BE 68539007547034", "BE6853 9007547034", "iban BE6853 9007547034", "ZZ68539007547034", "NO93 8601 1117 947 OK"]
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("iban")] for r in pii_report(make(*texts)).collect()}
    assert [got[i] for i in range(7)] == [["iban:0:19"], ["iban:4:20"], [], [], ["iban:5:22"], [], ["iban:0:18"]]


def test_many_matches_in_one_text(make):
    """Time grows with the length, not with the square of the matches: 400,000 of them take seconds."""
    row = pii_report(make("1234 a@b.c; " * 400_000)).collect()[0]
    assert row.n_email == 400_000 and row.spans.endswith(f"email:{399_999 * 12 + 5}:{399_999 * 12 + 10}")


def test_native_plan_and_odd_rows(make):
    df = pii_report(make((1, "a@b.c"), (1, "a@b.c"), (None, "x")))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    assert [r.n_email for r in sorted(df.collect(), key=lambda r: r.n_email)] == [0, 1, 1]
    assert pii_report(make().limit(0)).collect() == []
