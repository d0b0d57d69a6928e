"""Index and order expressions, and the columns that compare keys.

A key's strings are compared without accents, in their first `length` characters and without trailing
blanks. The plain way compares whole strings as they are, which is the same for ASCII of that length and
needs no Python; the strict way normalises them first.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.errors import ScriptError

LENGTHS = (16, 1024)
_PART = re.compile(r"\s*([A-Za-z_]\w*)\s*(?:\(([^()]*)\))?\s*(?:,|$)")


@dataclass(frozen=True)
class Part:
    field: str
    descending: bool = False
    ignore_case: bool = False
    length: int = 64


@dataclass(frozen=True)
class Index:
    unique: bool
    parts: tuple[Part, ...]

    @property
    def fields(self) -> list[str]:
        return [p.field for p in self.parts]


def parse_order(text: str) -> tuple[Part, ...]:
    """`a(desc,ignore_case),b(32)`"""
    out, at = [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m or m.end() == at:
            raise ScriptError(f"can't read {text[at:]!r} in the order {text!r}")
        out.append(_part(m[1], [x.strip() for x in (m[2] or "").split(",") if x.strip()]))
        at = m.end()
    if not out:
        raise ScriptError("an order needs a field")
    return tuple(out)


def _part(name: str, modifiers: list[str]) -> Part:
    descending = ignore_case = False
    length = 64
    for m in modifiers:
        if m in ("asc", "desc"):
            descending = m == "desc"
        elif m in ("case_sensitive", "ignore_case"):
            ignore_case = m == "ignore_case"
        elif m.isdigit():
            length = min(LENGTHS[1], max(LENGTHS[0], int(m)))
        else:
            raise ScriptError(f"unknown modifier {m!r} of {name}")
    return Part(name, descending, ignore_case, length)


def parse_index(text: str) -> Index:
    m = re.fullmatch(r"\s*(unique|non_unique)\s*\((.*)\)\s*", text, re.S)
    if not m:
        raise ScriptError(f"{text!r} is no index; expected unique(...) or non_unique(...)")
    return Index(m[1] == "unique", parse_order(m[2]))


def bare(text: str) -> str:
    """Without combining marks."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"))


@F.pandas_udf(StringType())
def _bare(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else bare(t))


def key_column(part: Part, column: Column, kind: str, strict: bool = False) -> Column:
    if kind != "string":
        return column
    if strict:
        column = F.rtrim(F.substring(_bare(column), 1, part.length))
    return F.upper(column) if part.ignore_case else column


def sort_column(part: Part, column: Column, kind: str, strict: bool = False) -> Column:
    key = key_column(part, column, kind, strict)
    return key.desc() if part.descending else key.asc()
