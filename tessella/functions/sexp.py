"""S-expressions: parsing, printing, measures and rewriting, as plain functions and vectorised UDFs.

A node is a string (an atom) or a list of nodes. All walks keep their own stack, so depth is
bounded by memory only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKENS = re.compile(r'\s*(?:([()])|("(?:[^"\\]|\\.)*")|([^\s()"]+))', re.S)
Node = str | list


def parse_all(text: str) -> list[Node]:
    """All expressions of a text; unbalanced parentheses or quotes are an error."""
    stack: list[list] = [[]]
    at, end = 0, len(text.rstrip())
    while at < end:
        m = _TOKENS.match(text, at)
        if not m:
            raise ValueError(f"unreadable expression at {at}")
        if m[1] == "(":
            stack.append([])
        elif m[1] == ")":
            if len(stack) == 1:
                raise ValueError(f"unbalanced ) at {at}")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(m[2] or m[3])
        at = m.end()
    if len(stack) > 1:
        raise ValueError("unbalanced (")
    return stack[0]


def parse(text: str) -> Node:
    found = parse_all(text)
    if len(found) != 1:
        raise ValueError(f"{len(found)} expressions where one is expected")
    return found[0]


def dump(node: Node) -> str:
    """Text with single blanks between the items of a list."""
    out: list[str] = []
    todo: list = [node]
    glued = True
    while todo:
        x = todo.pop()
        if x is None:
            out.append(")")
            glued = False
            continue
        if not glued:
            out.append(" ")
        if isinstance(x, list):
            out.append("(")
            todo.append(None)
            todo.extend(reversed(x))
            glued = True
        else:
            out.append(x)
            glued = False
    return "".join(out)


def forward(node: Node) -> Iterator[tuple[Node, int]]:
    """Depth first, parents before children, with depths."""
    todo = [(node, 0)]
    while todo:
        x, depth = todo.pop()
        yield x, depth
        if isinstance(x, list):
            todo.extend((c, depth + 1) for c in reversed(x))


def backward(node: Node) -> Iterator[tuple[Node, int]]:
    """Depth first, children before parents."""
    return iter(_post(node))


def _post(node: Node) -> list[tuple[Node, int]]:
    out, todo = [], [(node, 0)]
    while todo:
        x, depth = todo.pop()
        out.append((x, depth))
        if isinstance(x, list):
            todo.extend((c, depth + 1) for c in x)
    return out[::-1]


def metrics(node: Node) -> tuple[int, int, int]:
    """Height, number of nodes and of leaves; an atom is one of each, at height 0."""
    height = nodes = leaves = 0
    for x, depth in forward(node):
        height = max(height, depth)
        nodes += 1
        leaves += not isinstance(x, list) or not x
    return height, nodes, leaves


def flatten(node: Node) -> list[str]:
    """Atoms from left to right."""
    return [x for x, _ in forward(node) if isinstance(x, str)]


def contains(node: Node, atoms: set[str]) -> bool:
    return any(isinstance(x, str) and x in atoms for x, _ in forward(node))


def modify(node: Node, f: Callable[[Node], Node | None], into: Callable[[Node], bool] | None = None) -> Node:
    """Rebuild a tree from the leaves up; ``f`` gives a replacement or None, ``into`` says where to go on."""
    root: list = []
    todo: list[tuple[Node, list, bool]] = [(node, root, False)]
    made: dict[int, list] = {}
    while todo:
        x, parent, ready = todo.pop()
        if isinstance(x, list) and not ready and (into is None or into(x)):
            made[id(x)] = children = []
            todo.append((x, parent, True))
            todo.extend((c, children, False) for c in reversed(x))
            continue
        new = made.pop(id(x)) if ready else x
        got = f(new)
        parent.append(new if got is None else got)
    return root[0]


def pretty(node: Node, indent: int = 1) -> str:
    """One atom or empty list per line, indented by depth."""
    return "\n".join(" " * (indent * d) + (x if isinstance(x, str) else "()" if not x else "(") for x, d in forward(node))


def sexp_metrics(text: Column) -> Column:
    """Struct of a text's measures, with an error message where it can't be read."""

    @F.pandas_udf("height long, nodes long, leaves long, error string")
    def measured(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append((None, None, None, None) if t is None else (*metrics(parse(t)), None))
            except ValueError as e:
                rows.append((None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["height", "nodes", "leaves", "error"])

    return measured(text)


def sexp_atoms(text: Column) -> Column:
    """Atoms of all expressions in a text."""

    @F.pandas_udf("array<string>")
    def atoms(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else flatten(parse_all(t)))

    return atoms(text)


def paren_height(text: Column) -> Column:
    """Height without parsing, for texts whose atoms hold no parentheses: in the JVM."""
    steps = F.filter(F.split(text, ""), lambda c: c.isin("(", ")"))
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("top")),
        lambda s, c: F.struct(
            (s["d"] + F.when(c == "(", 1).otherwise(-1)).alias("d"), F.greatest(s["top"], s["d"] + F.when(c == "(", 1).otherwise(-1)).alias("top")
        ),
    )
    return walked["top"]
