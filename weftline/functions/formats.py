"""Time layouts and number formats as scripts write them, for Spark."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.errors import ScriptError
from weftline.types import MONEY

# Pieces of a layout, and Spark's patterns for them.
PIECES = {
    "2006": "yyyy", "06": "yy", "01": "MM", "January": "MMMM", "Jan": "MMM", "02": "dd", "_2": "ppd", "Monday": "EEEE", "Mon": "EEE", "15": "HH", "03": "hh",
    "04": "mm", "05": "ss", "PM": "a", "Z07:00": "XXX", "-07:00": "xxx", "-0700": "xx", "Z0700": "XX", "MST": "z",
}
_PIECE = re.compile("|".join([r"[.,][09]+(?!\d)", *map(re.escape, sorted(PIECES, key=len, reverse=True)), r"[A-Za-z]+", r"\d+", "."]), re.S)
_ZONES = {"XXX", "xxx", "xx", "XX", "z"}


def pattern(layout: str) -> str:
    """Spark's datetime pattern for a layout; layouts with pieces that it can't say are errors."""
    out = []
    for piece in _PIECE.findall(layout):
        if piece in PIECES:
            out.append(PIECES[piece])
        elif re.fullmatch(r"[.,]0+", piece):
            out.append(piece[0] + "S" * (len(piece) - 1))
        elif re.fullmatch(r"[.,]9+", piece):
            out.append(f"[{piece[0]}{'S' * (len(piece) - 1)}]")
        elif piece.isdigit():
            raise ScriptError(f"can't say {piece!r} of the time layout {layout!r}")
        elif piece.isalpha() or piece in "[]{}#'":
            out.append("''" if piece == "'" else f"'{piece}'")
        else:
            out.append(piece)
    return "".join(out)


def has_date(layout: str) -> bool:
    found = set(_PIECE.findall(layout))
    return bool(found & {"2006", "06"})


def parse_time(text: Column, layout: str) -> Column:
    """The time of a text, as UTC wall clock; texts that don't fit are an error."""
    p = pattern(layout)
    if not has_date(layout):
        raise ScriptError(f"the time layout {layout!r} has no year")
    if any(z in _PIECE.findall(layout) for z, s in PIECES.items() if s in _ZONES):
        return F.to_timestamp(text, p).cast("timestamp_ntz")
    return F.to_timestamp_ntz(text, F.lit(p)) if hasattr(F, "to_timestamp_ntz") else F.to_timestamp(text, p).cast("timestamp_ntz")


def format_time(time: Column, layout: str) -> Column:
    return F.date_format(time, pattern(layout))


def short_decimal(value: Column) -> Column:
    """Without trailing zeros behind the point."""
    text = value.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def short_float(value: Column) -> Column:
    """The shortest digits that give the number back; with an exponent from 1e21 on and below 1e-4."""
    text = value.cast("string")
    digits = F.regexp_replace(text, r"\.0(?=E|$)", "")
    scientific = F.regexp_replace(F.regexp_replace(digits, r"E(\d)", "e+$1"), r"E-(\d)", "e-$1")
    scientific = F.regexp_replace(scientific, r"e([+-])(\d)$", "e$10$2")
    plain = F.regexp_replace(F.format_string("%s", value.cast("decimal(38,17)").cast("string")), r"\.?0+$", "")
    size = F.abs(value)
    return (
        F.when(F.isnan(value), "NaN").when(value == float("inf"), "+Inf").when(value == float("-inf"), "-Inf").when(value == 0, "0")
        .when((size >= 1e21) | (size < 1e-4), scientific).when(F.contains(text, F.lit("E")), plain).otherwise(digits)
    )


def written(value: Column, kind: str) -> Column:
    """A value as text, the way of `%v`."""
    if kind == "float":
        return short_float(value)
    if kind == "decimal2":
        return short_decimal(value)
    if kind == "datetime":
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSS '+0000 UTC'")
    return value.cast("string")


_VERB = re.compile(r"%(%|[-+ 0#]*\d*(?:\.\d+)?[a-zA-Z])")


def sprintf(form: str, args: list[tuple[Column, str]]) -> Column:
    """fmt.Sprintf: verbs d, s, f, t, v and q-less widths and flags; each takes the next value."""
    verbs = [v for v in _VERB.findall(form) if v != "%"]
    if len(verbs) != len(args):
        raise ScriptError(f"the format {form!r} takes {len(verbs)} values, {len(args)} are given")
    values, parts = [], []
    for verb, (value, kind) in zip(verbs, args, strict=True):
        flags, letter = verb[:-1], verb[-1]
        if letter == "d" and kind == "int":
            values.append(value)
        elif letter == "f" and kind in ("float", "decimal2"):
            values.append(value.cast("double") if kind == "float" else value)
        elif letter == "t" and kind == "bool":
            letter, flags = "s", flags
            values.append(value.cast("string"))
        elif letter in "sv":
            letter = "s"
            values.append(written(value, kind))
        else:
            raise ScriptError(f"%{verb} can't format a value of type {kind}")
        parts.append(f"%{flags}{letter}")
    made = iter(parts)
    java = _VERB.sub(lambda m: "%%" if m[1] == "%" else next(made), form)
    return F.format_string(java, *values) if values else F.lit(form.replace("%%", "%"))


def column_text(value: Column, kind: str, form: str | None) -> Column:
    """A value of a CSV file's column, by its format: a layout for times, else a verb."""
    if kind == "datetime":
        return format_time(value, form or "2006-01-02T15:04:05.000-07:00")
    if kind == "decimal2":
        fixed = value.cast(MONEY).cast("string")
        if form and form.rstrip()[-1:] == "f":
            return sprintf(form, [(value, kind)])
        return sprintf(form, [(fixed, "string")]) if form else fixed
    return sprintf(form, [(value, kind)]) if form else written(value, kind)
