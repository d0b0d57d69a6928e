"""Personal data, by DataFrame functions only.

For each kind a regular expression proposes spans; checksums and number ranges confirm them; words of
context on either side of a span (whole words, at most CONTEXT characters away, no other match between)
raise its score. The spans of the kinds in BASE always stay once confirmed; those of the kinds that the
method adds need a score of at least THRESHOLD: IBANs (of their country's length, by mod 97) have it unless
their blanks are unusual, when they need a word of context, as US social security numbers (by range) always do.

Spark gives the matches of a pattern but not their places. They follow from the gaps between matches:
split() with the same pattern yields one more gap than there are matches, and the lengths of gaps and
matches add up to the places, counted in code points. The sums are taken in slices of SLICE matches and
then over the slices, as a fold copies what it has gathered at every step.

The patterns use possessive repeats and look at the character before, so that a very long run of
digits or letters costs one pass instead of one for each of its characters, and no stack. They match
what the plain forms in PLAIN match.

Defined cases: a null text counts as an empty one and has no spans; repeated rows and null ids keep
their rows; an empty table gives an empty result; other columns are ignored. Spans of different kinds
may overlap; those of one kind never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ["email", "ip", "card", "phone"]
ADDED = ["iban", "ssn"]
KINDS = BASE + ADDED
CONTEXT = 50
SLICE = 512

# The length of IBANs by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
# What each kind matches, in the plain form that any engine reads.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": "(?:" + "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
WORDS = {
    "email": "mail|email|e-mail|contact|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|kreditkarte|karte|carte|tarjeta",
    "phone": "phone|telephone|telefon|téléphone|teléfono|tel|call|fax|mobile|mobil",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social security|sozialversicherung|seguridad social|sécurité sociale",
}
_EDGE = "[^a-zà-ÿ]"
#: Percent for a confirmed span, and for a word of context; less for an IBAN that is written in neither of the usual ways.
SCORES = {"email": (80, 20), "ip": (60, 30), "card": (80, 20), "phone": (60, 30), "iban": (70, 30), "ssn": (30, 40)}
THRESHOLD, UNUSUAL = 70, 30
USUAL_IBAN = "^(?:[A-Z0-9]+|(?:[A-Z0-9]{4} )+[A-Z0-9]{1,4})$"

_FAST = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "iban": f"(?=[A-Z]{{2}}[0-9]{{2}}){PLAIN['iban']}",
}
_MARK = {"email": "@", "phone": "+"}


def _luhn(digits: Column) -> Column:
    """digits: 12 to 19 of them. Every other one from the right is doubled, its digits added."""
    back = F.reverse(digits)
    twice = F.translate(back, "0123456789", "0246813579")
    at = lambda i: F.when(i % 2 == 1, F.substr(back, i, F.lit(1))).otherwise(F.substr(twice, i, F.lit(1))).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + at(i)) % 10 == 0


def _mod97(code: Column) -> Column:
    """code: an IBAN without blanks. Its first four characters go last, letters count from 10."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        code = F.translate(match, " ", "")
        return F.when(F.length(code).between(15, 34), _mod97(code)).otherwise(False)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _before(sizes: Column) -> Column:
    """Of each element the sum of those before it. `sizes` is read for each slice, so it has to be a variable."""
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("sum"), none.alias("before"))
    fold = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["before"], F.array(a["sum"])).alias("before"))
    last = F.greatest(F.lit(0), F.floor((F.size(sizes) - 1) / SLICE).cast("int"))
    slices = F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(sizes, k * SLICE + 1, F.lit(SLICE)), start, fold))
    firsts = lambda made: F.aggregate(F.transform(made, lambda x: x["sum"]), start, fold, lambda a: a["before"])
    return _let(slices, lambda made: F.flatten(F.zip_with(made, firsts(made), lambda x, first: F.transform(x["before"], lambda b: b + first))))


def _score(kind: str, match: Column, before: Column, after: Column) -> Column:
    """before, after: the lower-cased context, with a blank at its edges that are no cut."""
    sure, more = SCORES[kind]
    words = f"{_EDGE}(?:{WORDS[kind]}){_EDGE}"
    score = F.lit(sure) + F.when(before.rlike(words) | after.rlike(words), more).otherwise(0)
    return score - F.when(match.rlike(USUAL_IBAN), 0).otherwise(UNUSUAL) if kind == "iban" else score


def kind_spans(text: Column, kind: str) -> Column:
    """array<struct<start, end, ord, kind, score>> of the confirmed spans of one kind, in order."""
    pattern = _FAST.get(kind, PLAIN[kind])
    blank = F.lit(" ")
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("gaps"))

    def spans(p: Column) -> Column:
        gap = lambda g: F.struct(
            F.length(g).alias("n"), F.lower(F.concat(F.right(F.concat(blank, g), F.lit(CONTEXT + 1)), blank)).alias("before"),
            F.lower(F.concat(blank, F.left(F.concat(g, blank), F.lit(CONTEXT + 1)))).alias("after"),
        )
        sizes = F.zip_with(F.slice(p["gaps"], F.lit(1), F.size(p["matches"])), p["matches"], lambda g, m: F.length(g) + F.length(m))
        found = F.zip_with(p["matches"], _let(sizes, _before), lambda m, at: F.struct(m.alias("match"), at.alias("at")))
        sides = lambda gaps: F.zip_with(F.slice(gaps, F.lit(1), F.size(p["matches"])), F.slice(gaps, F.lit(2), F.size(p["matches"])), lambda a, b: F.struct(a["n"].alias("n"), a["before"].alias("before"), b["after"].alias("after")))
        each = F.zip_with(found, _let(F.transform(p["gaps"], gap), sides), lambda x, g: F.struct(x["match"].alias("match"), (x["at"] + g["n"]).alias("start"), g["before"].alias("before"), g["after"].alias("after")))
        sure = F.filter(each, lambda x: confirmed(kind, x["match"]))
        span = lambda x: F.struct(
            x["start"].alias("start"), (x["start"] + F.length(x["match"])).alias("end"), F.lit(KINDS.index(kind)).alias("ord"), F.lit(kind).alias("kind"),
            _score(kind, x["match"], x["before"], x["after"]).alias("score"),
        )
        return F.filter(F.transform(sure, span), lambda x: (x["score"] >= THRESHOLD) | F.lit(kind in BASE))

    there = text.rlike(pattern)
    if kind in _MARK:
        there = F.contains(text, F.lit(_MARK[kind])) & there
    return F.when(there, _let(parts, spans)).otherwise(F.array().cast("array<struct<start:int,end:int,ord:int,kind:string,score:int>>"))


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array<struct<start, end, ord, kind, score>>, by start, then kind."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    each = read.select("doc_id", *(kind_spans(F.col("text"), k).alias(k) for k in KINDS))
    # by start, then kind: fields are compared in their order, so `ord` has to come before `end`
    keyed = F.transform(F.concat(*KINDS), lambda x: F.struct(*(x[c].alias(c) for c in ("start", "ord", "end", "kind", "score"))))
    return each.select("doc_id", F.array_sort(keyed).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """The counts, digest and list of the spans of each document."""
    number = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["ord"] < len(BASE))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["score"])
    return pii_spans(docs).select("doc_id", *map(number, BASE), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), *map(number, ADDED), total.alias("score_sum"))


def pii_sql() -> str:
    """The report in DuckDB's SQL, over the view documents."""
    valid = {
        "email": "true",
        "ip": f"regexp_full_match(m, '{OCTET}(?:\\.{OCTET}){{3}}')",
        "card": "length(d) between 12 and 19 and list_sum(list_transform(range(1, length(d) + 1), lambda i: case when i % 2 = 1 then substr(reverse(d), i, 1)::int else substr('0246813579', substr(reverse(d), i, 1)::int + 1, 1)::int end)) % 10 = 0",
        "phone": "length(d) between 9 and 15",
        "iban": "length(c) between 15 and 34 and list_reduce(list_prepend(0, list_transform(string_split(c[5:] || c[:4], ''), lambda x: case when x between '0' and '9' then ascii(x) - 48 else ascii(x) - 55 end)), lambda a, x: case when x < 10 then (a * 10 + x) % 97 else (a * 100 + x) % 97 end) = 1",
        "ssn": "not regexp_matches(m, '^(?:000|666|9)|-00-|-0000$')",
    }
    parts = []
    for k in KINDS:
        sure, more = SCORES[k]
        keep = "true" if k in BASE else f"score >= {THRESHOLD}"
        words = f"{_EDGE}(?:{WORDS[k]}){_EDGE}"
        unusual = f" - case when regexp_matches(m, '{USUAL_IBAN}') then 0 else {UNUSUAL} end" if k == "iban" else ""
        parts.append(f"""
  select doc_id, '{k}' as kind, {KINDS.index(k)} as ord, s as start, s + length(m) as "end", score from (
    select doc_id, m, regexp_replace(m, '[^0-9]', '', 'g') as d, replace(m, ' ', '') as c,
           list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0) as s,
           {sure} + case when regexp_matches(lower(right(' ' || gaps[i], {CONTEXT + 1}) || ' '), '{words}') or regexp_matches(lower(' ' || left(gaps[i + 1] || ' ', {CONTEXT + 1})), '{words}') then {more} else 0 end{unusual} as score
    from (select doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) as i, unnest(ms) as m from (
            select doc_id, regexp_extract_all(text, '{PLAIN[k]}') as ms, string_split_regex(text, '{PLAIN[k]}') as gaps from documents
            where regexp_matches(text, '{PLAIN[k]}'))))
  where ({valid[k]}) and {keep}""")
    spell = "kind || ':' || start::bigint || ':' || \"end\"::bigint, ',' order by start, ord"
    return f"""with spans as ({" union all ".join(parts)}),
found as (
  select doc_id, {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in KINDS)},
         string_agg({spell}) filter (ord < {len(BASE)}) as base, string_agg({spell}) as spans, sum(score)::bigint as score_sum
  from spans group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
       {", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k in ADDED)}, coalesce(score_sum, 0)::bigint as score_sum
from documents d left join found using (doc_id)"""
