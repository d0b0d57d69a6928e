"""Secret scans by one combined deterministic automaton.

All rules are compiled into one minimal automaton that reads each byte of a text once and tells which
rules match anywhere in it. Only for texts with a match, and only for the rules that do, the places
follow: the rule's own automaton runs from each byte where a match may begin, and gives the longest
match; the search goes on behind it, so spans of a rule never overlap.

Defined cases: a null text counts as an empty one and has no spans; repeated rows and null ids keep
their rows; an empty table gives an empty result; other columns are ignored. Spans of different rules
may overlap. Redaction replaces a private key from its BEGIN line to its END line.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.automaton import Automaton, finds
from weftline.llm.common import map_rows, text_blocks


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The rules. Least lengths are checked on the spans that are found, as counting them in the
# combined automaton would multiply its states; only runs of hexadecimal digits, which are everywhere, are
# counted there.
ASSIGNED = "|".join(map(either_case, ["password", "passwd", "secret", "token", "api_?key"]))
RULES = {
    "assign": rf"(?:{ASSIGNED})[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]+",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",
    "private_key": r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----",
    "github": r"gh[pousr]_[A-Za-z0-9]+",
    "slack": r"xox[abprs]-[A-Za-z0-9-]+",
    "jwt": r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
}
LEAST = {"access": 20, "github": 34, "slack": 15}
BASE = ["assign", "access", "hex"]
MIN_VALUE = 6
#: What follows the line of `private_key`: up to the END line, or without one the lines of headers and of base64.
_KEY = re.compile(
    r"(?:(?!-----BEGIN )[\s\S])*?-----END (?:[A-Z]+ )?PRIVATE KEY-----"
    r"|(?:(?:\\r|\\n|\s)+(?:(?:Proc-Type|DEK-Info): ?[^\n]*|[A-Za-z0-9+/=]{16,}|[A-Za-z0-9+/=]+(?=\r?\n|\Z|\\[rn])))*"
)
#: What precedes the value of an assignment.
_NAME = re.compile(rf"(?:{ASSIGNED})[\"']? *[:=] *[\"']?".encode())


@dataclass
class Scanner:
    """The automata of a set of rules, and the linked rows for the byte pass (made where it runs)."""

    names: list[str]
    whole: Automaton
    single: list[Automaton]

    @staticmethod
    def of(rules: dict[str, str] = RULES) -> Scanner:
        return Scanner(list(rules), Automaton.of(list(rules.values()), True), [Automaton.of([p], False) for p in rules.values()])

    def ready(self) -> Scanner:
        self.stopping, self.on = self.whole.rows(True), self.whole.rows(False)
        self.at = {id(r): m for r, m in zip(self.on, self.whole.matched.tolist(), strict=True) if m}
        self.each = []
        for a in self.single:
            rows = a.rows(False)
            self.each.append((rows, {id(r) for r, m in zip(rows, a.matched, strict=True) if m}, rows[a.dead] if a.dead >= 0 else None))
        return self

    def matching(self, data: bytes) -> int:
        """The bits of the rules that match somewhere in data."""
        if not finds(self.stopping, data):
            return 0
        row, found, at = self.on[0], 0, self.at
        for b in data:
            row = row[b]
            if id(row) in at:
                found |= at[id(row)]
        return found

    def places(self, rule: int, data: bytes) -> list[tuple[int, int]]:
        """(start, end) of the rule's matches, leftmost and longest, without overlap."""
        rows, accepting, dead = self.each[rule]
        out, i, n, first = [], 0, len(data), rows[0]
        while i < n:
            if first[data[i]] is dead:
                i += 1
                continue
            row, end, j = first, -1, i
            while j < n and (row := row[data[j]]) is not dead:
                j += 1
                if id(row) in accepting:
                    end = j
            if end < 0:
                i += 1
                continue
            out.append((i, end))
            i = end
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, rule) in code points, by start, then in the order of the rules."""
        data = text.encode("utf-8", "surrogatepass")
        bits = self.matching(data)
        found = []
        for k, name in enumerate(self.names):
            if bits >> k & 1:
                found += [(s, k, e, name) for s, e in self.places(k, data) if _long_enough(name, data[s:e])]
        found.sort()
        if found and len(data) != len(text):
            at = _code_points(data, sorted({p for s, _, e, _ in found for p in (s, e)}))
            found = [(at[s], k, at[e], name) for s, k, e, name in found]
        return [(s, e, name) for s, k, e, name in found]


def _long_enough(name: str, match: bytes) -> bool:
    if name == "assign":
        return len(match) - _NAME.match(match).end() >= MIN_VALUE
    return len(match) >= LEAST.get(name, 0)


def _code_points(data: bytes, places: list[int]) -> dict[int, int]:
    """The code points before each of the ascending places: every byte is read once, whatever their number."""
    out, before, last = {}, 0, 0
    for p in places:
        before += len(data[last:p].decode("utf-8", "surrogatepass"))
        out[p] = before
        last = p
    return out


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{name}:{s}:{e}" for s, e, name in spans)


def secret_report(docs: DataFrame) -> DataFrame:
    """The counts, digest and list of the spans of each document."""
    scanner, made = Scanner.of(), []
    names = [*(f"n_{k}" for k in BASE), "base_sha256", "spans", *(f"n_{k}" for k in RULES if k not in BASE)]

    def report(text: str) -> tuple:
        if not made:
            made.append(scanner.ready())
        spans = made[0].spans(text)
        base = _written([x for x in spans if x[2] in BASE])
        number = lambda k: sum(x[2] == k for x in spans)
        return *map(number, BASE), hashlib.sha256(base.encode()).hexdigest(), _written(spans), *(number(k) for k in RULES if k not in BASE)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in names)
    return map_rows(read, schema, report, ["doc_id"], names)


def with_keys(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans, those of `private_key` with the key itself. The report keeps to the line, as its SQL does."""
    return [(s, _KEY.match(text, e).end() if name == "private_key" else e, name) for s, e, name in spans]


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with their secrets replaced, all columns and rows kept; n_chars, where there is one, follows the text."""
    scanner, made = Scanner.of(), []
    counted = "n_chars" if dict(docs.dtypes).get("n_chars") in ("bigint", "int") else None

    def run(batches):
        if not made:
            made.append(scanner.ready())
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for first, texts in text_blocks(batch):
                part = batch.slice(first, len(texts))
                spans = [made[0].spans(t) for t in texts]
                if not any(spans):
                    yield part
                    continue
                new = [redact(t, with_keys(t, s)) if s else t for t, s in zip(texts, spans, strict=True)]
                null = part.column(at).is_null()
                columns = part.columns
                columns[at] = pc.if_else(null, None, pa.array(new, part.schema.field(at).type))
                if counted:
                    k = part.schema.get_field_index(counted)
                    lengths = pa.array([len(t) if s else n for t, s, n in zip(new, spans, columns[k].to_pylist(), strict=True)], columns[k].type)
                    columns[k] = lengths
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def secret_sql() -> str:
    """The report in DuckDB's SQL, over the view documents."""
    q = lambda s: s.replace("'", "''")
    parts = []
    for i, (k, p) in enumerate(RULES.items()):
        name = rf"^(?:{ASSIGNED})[\"']? *[:=] *[\"']?"
        keep = f"length(m) - length(regexp_extract(m, '{q(name)}')) >= {MIN_VALUE}" if k == "assign" else f"length(m) >= {LEAST.get(k, 0)}"
        parts.append(f"""
  select doc_id, '{k}' as kind, {i} as ord, s as start, s + length(m) as "end" from (
    select doc_id, m, list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0) as s
    from (select doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) as i, unnest(ms) as m from (
            select doc_id, regexp_extract_all(text, '{q(p)}') as ms, string_split_regex(text, '{q(p)}') as gaps from documents
            where regexp_matches(text, '{q(p)}'))))
  where {keep}""")
    spell = "kind || ':' || start::bigint || ':' || \"end\"::bigint, ',' order by start, ord"
    added = [k for k in RULES if k not in BASE]
    return f"""with spans as ({" union all ".join(parts)}),
found as (
  select doc_id, {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in RULES)},
         string_agg({spell}) filter (ord < {len(BASE)}) as base, string_agg({spell}) as spans
  from spans group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
       {", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k in added)}
from documents d left join found using (doc_id)"""
