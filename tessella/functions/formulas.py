"""Constraint formulas over versions, variables and packages.

Grammar, from loose to tight: ``|``, ``&``, ``!`` and ``?``, comparison, atom. A version formula
compares the version at hand (``>= "1.2"``) or reads variables (``build``, ``os = "linux"``); a
package formula has atoms ``"name"`` or ``"name" {version formula}``. Logic is Kleene's with
null for undefined, as in SQL, so formulas compile to Columns that Catalyst can fold and push
down; ``simplify`` does the same for known values ahead of time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .versions import compare

_TOKEN = re.compile(r'\s*(?:"((?:[^"\\]|\\.)*)"|(!=|<=|>=|=|<|>)|([&|!?(){}])|([A-Za-z0-9_][\w+:.-]*))')
_OPS: dict[str, Callable] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
Values = Mapping[str, object]


class ParseError(ValueError):
    """A formula that does not follow the grammar."""


def sort_key(version: str) -> list[tuple[list[int], int]]:
    """Plain counterpart of ``version_key``."""

    def rank(c: str) -> int:
        return -1 if c == "~" else ord(c) if c.isalpha() else 0x200 + ord(c)

    parts = re.findall(r"([^0-9]*)([0-9]*)", version)
    return [([*map(rank, s), 0], int(n or 0)) for s, n in parts]


def _relate(op: str, a: object, b: object) -> bool:
    return _OPS[op](sort_key(str(a)), sort_key(str(b)))


def _and(a: bool | None, b: bool | None) -> bool | None:
    return False if a is False or b is False else None if a is None or b is None else True


def _or(a: bool | None, b: bool | None) -> bool | None:
    return True if a is True or b is True else None if a is None or b is None else False


class Formula:
    """A node of a formula."""

    def variables(self) -> set[str]:
        return set()

    def value(self, at: object, variables: Values) -> bool | None:
        """Truth for a version (or a map of packages to versions); None if undefined."""
        raise NotImplementedError

    def column(self, at: Column, variables: Mapping[str, Column]) -> Column:
        raise NotImplementedError

    def simplify(self, at: object, variables: Values) -> Formula | bool:
        """What is left when all that is known has been put in."""
        raise NotImplementedError

    def satisfied(self, at: object, variables: Values | None = None) -> bool:
        return self.value(at, variables or {}) is True


@dataclass(frozen=True)
class Relation(Formula):
    """Version compared with a literal."""

    op: str
    version: str

    def value(self, at, variables):
        return None if at is None else _relate(self.op, at, self.version)

    def column(self, at, variables):
        return compare(at, self.op, F.lit(self.version))

    def simplify(self, at, variables):
        return self if at is None else self.value(at, variables)

    def __str__(self):
        return f'{self.op} "{self.version}"'


@dataclass(frozen=True)
class VariableTest(Formula):
    """A variable's truth, or a comparison of it with a literal."""

    name: str
    op: str = ""
    literal: str = ""

    def variables(self):
        return {self.name}

    def value(self, at, variables):
        found = variables.get(self.name)
        if found is None:
            return None
        if self.op:
            return _relate(self.op, str(found).lower() if isinstance(found, bool) else found, self.literal)
        return found if isinstance(found, bool) else {"true": True, "false": False}.get(str(found))

    def column(self, at, variables):
        found = variables.get(self.name, F.lit(None).cast("string"))
        if self.op:
            return compare(found.cast("string"), self.op, F.lit(self.literal))
        return F.when(found.cast("string") == "true", True).when(found.cast("string") == "false", False)

    def simplify(self, at, variables):
        found = self.value(at, variables)
        return self if found is None else found

    def __str__(self):
        return f'{self.name} {self.op} "{self.literal}"' if self.op else self.name


@dataclass(frozen=True)
class Defined(Formula):
    """Whether a variable is defined."""

    name: str

    def variables(self):
        return {self.name}

    def value(self, at, variables):
        return variables.get(self.name) is not None

    def column(self, at, variables):
        return variables[self.name].isNotNull() if self.name in variables else F.lit(False)

    def simplify(self, at, variables):
        return True if self.value(at, variables) else self

    def __str__(self):
        return f"?{self.name}"


@dataclass(frozen=True)
class Not(Formula):
    inner: Formula

    def variables(self):
        return self.inner.variables()

    def value(self, at, variables):
        found = self.inner.value(at, variables)
        return None if found is None else not found

    def column(self, at, variables):
        return ~self.inner.column(at, variables)

    def simplify(self, at, variables):
        found = self.inner.simplify(at, variables)
        return not found if isinstance(found, bool) else Not(found)

    def __str__(self):
        return f"!({self.inner})"


@dataclass(frozen=True)
class Logic(Formula):
    """Conjunction (``&``) or disjunction (``|``)."""

    op: str
    parts: tuple[Formula, ...]

    def variables(self):
        return set().union(*(p.variables() for p in self.parts))

    def value(self, at, variables):
        return reduce(_and if self.op == "&" else _or, (p.value(at, variables) for p in self.parts))

    def column(self, at, variables):
        both = (lambda a, b: a & b) if self.op == "&" else (lambda a, b: a | b)
        return reduce(both, (p.column(at, variables) for p in self.parts))

    def simplify(self, at, variables):
        absorbing = self.op == "|"
        found = [p.simplify(at, variables) for p in self.parts]
        if any(f is absorbing for f in found):
            return absorbing
        rest = tuple(f for f in found if not isinstance(f, bool))
        return (not absorbing) if not rest else rest[0] if len(rest) == 1 else Logic(self.op, rest)

    def __str__(self):
        inner = (f"({p})" if isinstance(p, Logic) and p.op == "|" else str(p) for p in self.parts)
        return f" {self.op} ".join(inner)


@dataclass(frozen=True)
class Package(Formula):
    """A package that must be there, with a version formula or without."""

    name: str
    constraint: Formula | None = None

    def variables(self):
        return self.constraint.variables() if self.constraint else set()

    def _needed(self, variables: Values) -> Formula | bool:
        """The version formula once its filters are evaluated, undefined ones as false."""
        if self.constraint is None:
            return True
        given = {v: False for v in self.constraint.variables()} | {k: v for k, v in variables.items() if v is not None}
        return self.constraint.simplify(None, given)

    def value(self, at, variables):
        rest = self._needed(variables)
        if rest is False:
            return True  # filtered out: not required
        if self.name not in at:
            return False
        return True if rest is True else rest.value(at[self.name], variables) is True

    def column(self, at, variables):
        version = F.element_at(at, self.name)
        here = F.map_contains_key(at, self.name)
        if self.constraint is None:
            return here
        if any(True for _ in self.constraint.variables()):
            given = {v: F.coalesce(variables[v].cast("string"), F.lit("false")) if v in variables else F.lit("false") for v in self.constraint.variables()}
            possible = F.coalesce(_open(self.constraint, given), F.lit(True))
            return ~possible | (here & F.coalesce(self.constraint.column(version, given), F.lit(False)))
        return here & F.coalesce(self.constraint.column(version, {}), F.lit(False))

    def simplify(self, at, variables):
        rest = self._needed(variables)
        if rest is False:
            return True
        if self.name in at:
            return True if rest is True else rest.value(at[self.name], variables) is True
        return Package(self.name, None if rest is True else rest)

    def __str__(self):
        return f'"{self.name}"' + (f" {{{self.constraint}}}" if self.constraint else "")


def _open(formula: Formula, variables: Mapping[str, Column]) -> Column:
    """Formula with comparisons of the version left undefined."""
    if isinstance(formula, Relation):
        return F.lit(None).cast("boolean")
    if isinstance(formula, Not):
        return ~_open(formula.inner, variables)
    if isinstance(formula, Logic):
        both = (lambda a, b: a & b) if formula.op == "&" else (lambda a, b: a | b)
        return reduce(both, (_open(p, variables) for p in formula.parts))
    return formula.column(F.lit(None).cast("string"), variables)


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ParseError(f"unexpected text at {at}: {text[at : at + 20]!r}")
            kind = ("string", "op", "sign", "word")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, kind: str, text: str | None = None) -> str:
        k, t = self.peek()
        if k != kind or (text is not None and t != text):
            raise ParseError(f"expected {text or kind}, found {t or 'the end'!r}")
        self.at += 1
        return t

    def joined(self, sign: str, part: Callable[[], Formula]) -> Formula:
        parts = [part()]
        while self.peek() == ("sign", sign):
            self.at += 1
            parts.append(part())
        return parts[0] if len(parts) == 1 else Logic(sign, tuple(parts))

    def formula(self, atom: Callable[[], Formula]) -> Formula:
        def tight() -> Formula:
            if self.peek() == ("sign", "!"):
                self.at += 1
                return Not(tight())
            if self.peek() == ("sign", "("):
                self.at += 1
                inner = self.formula(atom)
                self.take("sign", ")")
                return inner
            return atom()

        return self.joined("|", lambda: self.joined("&", tight))

    def version_atom(self) -> Formula:
        kind, text = self.peek()
        if kind == "op":
            self.at += 1
            k, v = self.peek()
            if k not in ("string", "word"):
                raise ParseError("a comparison needs a version")
            self.at += 1
            return Relation(text, v)
        if (kind, text) == ("sign", "?"):
            self.at += 1
            return Defined(self.take("word"))
        name = self.take("word")
        if self.peek()[0] == "op":
            op = self.take("op")
            k, v = self.peek()
            if k not in ("string", "word"):
                raise ParseError("a comparison needs a value")
            self.at += 1
            return VariableTest(name, op, v)
        return VariableTest(name)

    def package_atom(self) -> Formula:
        name = self.take("string")
        if self.peek() != ("sign", "{"):
            return Package(name)
        self.at += 1
        inner = self.formula(self.version_atom)
        self.take("sign", "}")
        return Package(name, inner)



class VersionFormula:
    """A parsed version formula."""

    def __init__(self, root: Formula) -> None:
        self.root = root

    def satisfied(self, version: str, variables: Values | None = None) -> bool:
        return self.root.satisfied(version, variables)

    def column(self, version: Column, variables: Mapping[str, Column] | None = None) -> Column:
        """Predicate on a version column; undefined counts as false."""
        return F.coalesce(self.root.column(version, variables or {}), F.lit(False))

    def simplify(self, version: str | None, variables: Values | None = None) -> Formula | bool:
        return self.root.simplify(version, variables or {})

    def filter(self, versions: list[str], variables: Values | None = None) -> list[str]:
        return [v for v in versions if self.satisfied(v, variables)]

    def __str__(self) -> str:
        return str(self.root)


def _end(parser: _Parser, found: Formula) -> Formula:
    if parser.at != len(parser.tokens):
        raise ParseError(f"text after the formula: {parser.peek()[1]!r}")
    return found


def parse_version_formula(text: str) -> VersionFormula:
    p = _Parser(text)
    return VersionFormula(_end(p, p.formula(p.version_atom)))


def parse_package_formula(text: str) -> Formula:
    """``at`` of the result's methods is a map of package names to versions."""
    p = _Parser(text)
    return _end(p, p.formula(p.package_atom))


def packages(formula: Formula | bool) -> set[str]:
    if isinstance(formula, Package):
        return {formula.name}
    return set().union(*(packages(p) for p in formula.parts)) if isinstance(formula, Logic) else set()


def size(formula: Formula | bool) -> int:
    """Least number of package constraints that must hold."""
    if isinstance(formula, bool):
        return 0
    if isinstance(formula, Logic):
        return (sum if formula.op == "&" else min)(size(p) for p in formula.parts)
    return 1


def map_packages(formula: Formula, f: Callable[[Package], Formula]) -> Formula:
    if isinstance(formula, Package):
        return f(formula)
    return Logic(formula.op, tuple(map_packages(p, f) for p in formula.parts)) if isinstance(formula, Logic) else formula


def popularity(versions: DataFrame, version: str, formulas: list[str]) -> DataFrame:
    """How many of the formulas admit each version; those that none admits are left out."""
    parsed = [parse_version_formula(f) for f in formulas]
    hits = reduce(lambda a, b: a + b, [p.column(F.col(version)).cast("long") for p in parsed])
    return versions.select(version, hits.alias("n")).filter("n > 0")


def closest(switches: list[tuple[str, Mapping[str, str]]], formula: Formula, variables: Values | None = None) -> str | None:
    """Name of the environment that leaves least of the formula; the first of several, at once if nothing is left."""
    best, least = None, None
    for name, installed in switches:
        left = size(formula.simplify(installed, variables or {}))
        if least is None or left < least:
            best, least = name, left
            if left == 0:
                break
    return best
