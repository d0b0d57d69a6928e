"""Parameters of a script: {name} or {name|string}, {name|number}, {name|bool}, {name|stringlist} in its text."""

from __future__ import annotations

import json
import re

from weftline.errors import ScriptError

LATER = ("run_id", "batch_idx")  # known only when files are written
_PARAM = re.compile(r"\{([A-Za-z_]\w*)(?:\|(string|number|bool|stringlist))?\}")


def substitute(text: str, params: dict) -> str:
    """The text with all parameters put in. A quoted number, bool or list parameter loses its quotes."""
    unknown: list[str] = []

    def put(m: re.Match) -> str:
        name, kind = m[1], m[2] or "string"
        if name in LATER:
            return m[0]
        if name not in params:
            unknown.append(name)
            return m[0]
        return rendered(name, params[name], kind)

    for kind in ("number", "bool", "stringlist"):
        text = re.sub(rf"([\"'])(\{{[A-Za-z_]\w*\|{kind}\}})\1", r"\2", text)
    out = _PARAM.sub(put, text)
    if unknown:
        raise ScriptError(f"parameters without a value: {', '.join(sorted(set(unknown)))}")
    return out


def rendered(name: str, value, kind: str) -> str:
    if kind == "number":
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ScriptError(f"parameter {name} is no number: {value!r}")
        return f"{value:g}" if isinstance(value, float) else str(value)
    if kind == "bool":
        if not isinstance(value, bool):
            raise ScriptError(f"parameter {name} is no bool: {value!r}")
        return str(value).lower()
    if kind == "stringlist":
        if not isinstance(value, list):
            raise ScriptError(f"parameter {name} is no list: {value!r}")
        return json.dumps([str(v) for v in value])
    if isinstance(value, (list, dict)):
        raise ScriptError(f"parameter {name} is no string: {value!r}")
    return str(value).lower() if isinstance(value, bool) else str(value)
