"""Computed fields of a node's output."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame

from weftline.errors import ScriptError
from weftline.functions.compile import Compiler, Scope, Typed, fields
from weftline.functions.parser import parse, references
from weftline.types import check_type, default_value, stored


@dataclass(frozen=True)
class Field:
    name: str
    expression: str
    kind: str
    default: str | None = None

    def __post_init__(self) -> None:
        check_type(self.kind)

    @cached_property
    def tree(self):
        return parse(self.expression)

    def uses(self, alias: str) -> bool:
        return any(n.alias == alias for n in references(self.tree))

    def default_column(self) -> Column:
        return default_value(self.default, self.kind)

    def checked(self, typed: Typed | object) -> Column:
        """The column as the table holds it; an expression of another type is an error."""
        if typed.kind != self.kind:
            raise ScriptError(f"field {self.name} is declared {self.kind}, its expression {self.expression!r} is {typed.kind}")
        return stored(typed.column, self.kind)


def kinds(columns: list[Field]) -> dict[str, str]:
    return {f.name: f.kind for f in columns}


def project(df: DataFrame, scope: Scope, columns: list[Field], having: str | None = None) -> DataFrame:
    """The computed fields, money rounded after each operation; then the rows that `having` keeps."""
    compiler = Compiler(scope, rounded=True)
    return keep(df.select(*(f.checked(compiler(f.tree)).alias(f.name) for f in columns)), kinds(columns), having)


def keep(df: DataFrame, types: dict[str, str], having: str | None, alias: str = "w") -> DataFrame:
    return df.where(condition(having, fields(alias, types))) if having else df


def condition(text: str, scope: Scope) -> Column:
    made = Compiler(scope)(text)
    if made.kind != "bool":
        raise ScriptError(f"{text!r} is {made.kind}, not bool")
    return made.column
