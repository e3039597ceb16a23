"""Scopes: where compiled texts are evaluated, and how intermediate results get names.

A contract's texts name what several others use, so nothing is ever repeated
and the size of a plan is linear in that of the contract.  In a table, names are
columns of projections, one projection for each step of dependence.  In the
elements of a list they are members of structs, one ``transform`` for each step.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipule.functions import sql

Function = Callable[..., Column]


class Scope:
    """Base of all scopes."""

    #: Lists around this scope.
    depth = 0

    def keep(self, text: str) -> str:
        """A text for the result of ``text`` that may be used many times."""
        raise NotImplementedError

    def apply(self, make: Function, *names: str, key: str = "") -> str:
        """The result of a function of Columns, applied to kept names; once for each ``key``."""
        raise NotImplementedError

    def index(self) -> str:
        """The places of this scope's element in the lists around it."""
        return ""


class Inline(Scope):
    """Nothing is named: for short texts within a Column."""

    def keep(self, text: str) -> str:
        return f"({text})"

    def apply(self, make: Function, *names: str, key: str = "") -> str:
        raise TypeError("functions of Columns cannot be part of a text")


class Table(Scope):
    """Names are columns of a table's rows."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self.prefix = df, "_s"
        while any(c.lower().startswith(self.prefix) for c in df.columns):
            self.prefix += "_"
        self.levels: list[list[tuple[str, str | Column]]] = []
        self.level_of: dict[str, int] = {}
        self.known: dict[str, str] = {}
        self.variables = count()
        self._mention = re.compile(rf"\b{self.prefix}\d+\b")

    def variable(self) -> str:
        """A name for a lambda's argument that no other has."""
        return f"x{next(self.variables)}"

    def _add(self, made: str | Column, level: int) -> str:
        name = f"{self.prefix}{len(self.level_of)}"
        self.level_of[name] = level
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, made))
        return name

    def _level(self, *texts: str) -> int:
        return 1 + max((self.level_of.get(n, -1) for t in texts for n in self._mention.findall(t)), default=-1)

    def keep(self, text: str) -> str:
        if text not in self.known:
            self.known[text] = self._add(text, self._level(text))
        return self.known[text]

    def apply(self, make: Function, *names: str, key: str = "") -> str:
        if key and key in self.known:
            return self.known[key]
        out = self._add(make(*[F.col(n) for n in names]), self._level(*names))
        if key:
            self.known[key] = out
        return out

    def selected(self, out: Mapping[str, str | Column]) -> DataFrame:
        """The table with the columns ``out`` added or replaced."""
        df = self.df
        column = lambda c: F.expr(c) if isinstance(c, str) else c
        for level in self.levels:
            df = df.select("*", *[column(c).alias(n) for n, c in level])
        made = {n.lower(): (n, c) for n, c in out.items()}
        old = [column(made.pop(c.lower())[1]).alias(c) if c.lower() in made else F.col(sql.name(c)) for c in self.df.columns]
        return df.select(*old, *[column(c).alias(n) for n, c in made.values()])


class Elements(Scope):
    """Names are members of the struct that stands for an element of a list.

    The structs are held in a column of the table, as an array for each list
    around them.  ``x`` is the element itself.
    """

    def __init__(self, outer: Table | Elements, elements: str) -> None:
        self.table = outer if isinstance(outer, Table) else outer.table
        self.depth = outer.depth + 1
        self.outer, self.var, self.at = outer, f"e{self.depth}", f"i{self.depth}"
        first = f"transform({elements}, {self.var} -> named_struct('x', {self.var}))"
        self.base = self.table.keep(first if isinstance(outer, Table) else outer.wrapped(outer.base, first))
        self.members: list[tuple[str, str | tuple[Function, tuple[str, ...]], int]] = []
        self.level_of: dict[str, int] = {"x": -1}
        self.known: dict[str, str] = {}
        self._mention = re.compile(rf"\b{self.var}\.(\w+)")

    def variable(self) -> str:
        return self.table.variable()

    @property
    def element(self) -> str:
        return f"{self.var}.x"

    def index(self) -> str:
        return f"{self.outer.index()}[{self.at}]"

    def wrapped(self, column: str, body: str) -> str:
        """``body`` for each element of the lists in ``column``."""
        scope: Scope = self
        while isinstance(scope, Elements):
            inner, outer = scope, scope.outer
            held = column if isinstance(outer, Table) else inner.outer.var
            body = f"transform({held}, ({inner.var}, {inner.at}) -> {body})"
            scope = outer
        return body

    def _add(self, made: str | tuple, level: int) -> str:
        name = f"n{len(self.members)}"
        self.level_of[name] = level
        self.members.append((name, made, level))
        return f"{self.var}.{name}"

    def _level(self, *texts: str) -> int:
        return 1 + max((self.level_of.get(n, -1) for t in texts for n in self._mention.findall(t)), default=-1)

    def keep(self, text: str) -> str:
        if text not in self.known:
            self.known[text] = self._add(text, self._level(text))
        return self.known[text]

    def apply(self, make: Function, *names: str, key: str = "") -> str:
        # Functions come after the texts of their level.
        if key and key in self.known:
            return self.known[key]
        out = self._add((make, tuple(n.removeprefix(f"{self.var}.") for n in names)), self._level(*names))
        if key:
            self.known[key] = out
        return out

    def closed(self, out: Mapping[str, str]) -> str:
        """The column of arrays of structs with the members ``out``."""
        column, have = self.base, ["x"]
        for level in range(max((lv for *_, lv in self.members), default=-1) + 1):
            here = [(n, m) for n, m, lv in self.members if lv == level]
            texts, made = [(n, m) for n, m in here if isinstance(m, str)], [(n, m) for n, m in here if not isinstance(m, str)]
            if texts:
                column = self.table.keep(self.wrapped(column, sql.struct([*((h, f"{self.var}.{h}") for h in have), *texts])))
                have += [n for n, _ in texts]
            if made:
                held = list(have)
                column = self.table.apply(lambda c, held=held, made=made: _each(c, self.depth, lambda e: F.struct(*[e[h].alias(h) for h in held], *[f(*[e[a] for a in args]).alias(n) for n, (f, args) in made])), column)
                have += [n for n, _ in made]
        return self.table.keep(self.wrapped(column, sql.struct(out.items())))


def _each(c: Column, depth: int, make: Function) -> Column:
    return F.transform(c, lambda e: make(e) if depth == 1 else _each(e, depth - 1, make))
