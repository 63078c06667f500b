"""Identifiers and source locations in serialised syntax trees.

Trees are s-expressions. A qualified identifier is ``(Ser_Qualid (DirPath ((Id A) (Id B))) (Id x))``,
named after the ``CRef`` or ``CPatAtom`` around it if there is one; a declared one is ``(v (Id x))`` or
``(v (Name (Id x)))`` followed by a location. A location is
``(loc (((fname f) (line_nb 1) (bol_pos 0) (line_nb_last 1) (bol_pos_last 0) (bp 0) (ep 9))))``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .sexp import Node, dump, modify, parse_all

# Names of a location's fields in a tree, and of a span's.
LOC_FIELDS = {
    "line_nb": "lineno",
    "bol_pos": "bol_pos",
    "line_nb_last": "lineno_last",
    "bol_pos_last": "bol_pos_last",
    "bp": "beg_charno",
    "ep": "end_charno",
}


def _is(node: Node, head: str, size: int | None = None) -> bool:
    return isinstance(node, list) and bool(node) and node[0] == head and (size is None or len(node) == size)


def _plain(atom: Node) -> str:
    return atom[1:-1].replace('\\"', '"') if isinstance(atom, str) and atom[:1] == '"' else str(atom)


def _qualified(node: Node) -> str | None:
    """Dotted name of a qualified identifier."""
    if not _is(node, "Ser_Qualid", 3) or not _is(node[1], "DirPath", 2) or not _is(node[2], "Id", 2):
        return None
    if not isinstance(node[1][1], list) or not all(_is(d, "Id", 2) for d in node[1][1]):
        return None
    return ".".join([*(_plain(d[1]) for d in node[1][1]), _plain(node[2][1])])


def identifiers(tree: Node) -> Iterator[tuple[str, str]]:
    """(type, name) of all identifiers, from left to right."""
    todo: list[tuple[Node, str, bool]] = [(tree, "Ser_Qualid", False)]
    while todo:
        node, around, located = todo.pop()
        if not isinstance(node, list):
            continue
        if (name := _qualified(node)) is not None:
            yield around, name
            continue
        if located and _is(node, "v", 2):
            if _is(node[1], "Id", 2):
                yield "lident", _plain(node[1][1])
            elif _is(node[1], "Name", 2) and _is(node[1][1], "Id", 2):
                yield "lname", _plain(node[1][1][1])
        head = node[0] if node and isinstance(node[0], str) else ""
        # the kind of a reference holds down to its own identifier: (CRef ((v (Ser_Qualid ...)) ...) ...)
        passed = head if head in ("CRef", "CPatAtom") else around if head in ("", "v") else "Ser_Qualid"
        for i in range(len(node) - 1, -1, -1):
            follows = i + 1 < len(node) and _is(node[i + 1], "loc")
            first = i <= 1 if head in ("CRef", "CPatAtom") else True
            todo.append((node[i], passed if first else "Ser_Qualid", follows))


def qualify(tree: Node, names: Mapping[str, str]) -> Node:
    """Tree with identifiers replaced by qualified names."""

    def change(node: Node) -> Node | None:
        new = names.get(_qualified(node) or "") if isinstance(node, list) else None
        if not new:
            return None
        *path, last = new.split(".")
        return ["Ser_Qualid", ["DirPath", [["Id", p] for p in path]], ["Id", last]]

    return modify(tree, change)


def shift_locations(tree: Node, chars: int, lines: int) -> Node:
    """Tree with its locations moved; where lines begin is left alone."""
    by = {"line_nb": lines, "line_nb_last": lines, "bp": chars, "ep": chars}

    def change(node: Node) -> Node | None:
        if isinstance(node, list) and len(node) == 2 and isinstance(node[0], str) and node[0] in by and isinstance(node[1], str) and node[1].lstrip("-").isdigit():
            return [node[0], str(int(node[1]) + by[node[0]])]
        return None

    return modify(tree, change)


def identifiers_of(text: Column) -> Column:
    """Array of (type, name) of a serialised tree."""

    @F.pandas_udf("array<struct<type:string,name:string>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"type": k, "name": n} for x in parse_all(t) for k, n in identifiers(x)])

    return found(text)


def referenced(text: Column) -> Column:
    """Distinct names of a serialised tree, sorted."""
    return F.array_sort(F.array_distinct(F.transform(identifiers_of(text), lambda x: x["name"])))


def shifted(text: Column, chars: Column, lines: Column) -> Column:
    """Serialised tree with its locations moved."""

    @F.pandas_udf("string")
    def moved(texts: pd.Series, c: pd.Series, n: pd.Series) -> pd.Series:
        rows = zip(texts, c, n, strict=True)
        return pd.Series([None if t is None else " ".join(dump(shift_locations(x, int(a), int(b))) for x in parse_all(t)) for t, a, b in rows])

    return moved(text, chars, lines)


def locations(text: Column) -> Column:
    """Array of spans of all locations in a serialised tree; regular, so it runs in the JVM."""
    fields = r"\s*".join(rf"\(\s*{name}\s+(\d+)\s*\)" for name in LOC_FIELDS)
    pattern = rf'\(\s*fname\s*\(?\s*(?:InFile\s+)?"?([^()"\s]+)"?\s*\)?\s*\)\s*{fields}'
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k + 1)) for k in range(len(LOC_FIELDS) + 1)]
    zipped = F.arrays_zip(*[p.alias(f"p{k}") for k, p in enumerate(parts)])
    names = list(LOC_FIELDS.values())
    return F.transform(
        zipped, lambda z: F.struct(z["p0"].alias("filename"), *[z[f"p{k + 1}"].cast("int").alias(n) for k, n in enumerate(names)])
    )


def vernac_kind(text: Column) -> Column:
    """Kind of the command in a serialised tree, such as ``VernacDefinition``."""
    return F.nullif(F.regexp_extract(text, r"\(\s*(Vernac[A-Z]\w*)", 1), F.lit(""))
