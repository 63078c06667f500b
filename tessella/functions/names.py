"""Kernel names: identifiers between their shortest and full forms, and printed paths.

Paths are s-expressions. A library is ``(DirPath ((Id B) (Id A)))``, innermost part first. A module
path is ``(MPfile library)``, ``(MPdot path (Label (Id x)))`` or, for a bound module,
``(MPbound (MBId n (Id x) library))`` with any items before the last two. A kernel name is
``(KerName path (Id x))``; older versions put a library before the identifier, and the oldest a
number before the path, which the number of items tells.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .sexp import Node, parse


def interpolated(short: Column, full: Column) -> Column:
    """Names from the short form to the full one, a part longer each; an error if they aren't related.

    Null if either is; the name alone if both are the same.
    """
    parts = F.split(F.left(full, F.length(full) - F.length(short) - 1), "\\.")
    longer = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws(".", F.slice(parts, F.size(parts) - n + 1, n), F.array(short))
    )
    found = F.when(full == short, F.array(short)).when(F.endswith(full, short), F.concat(F.array(short), longer))
    error = F.raise_error(F.concat(F.lit("not related: "), short, F.lit(", "), full)).cast("array<string>")
    return F.when(short.isNotNull() & full.isNotNull(), F.coalesce(found, error))


def library(path: Node) -> str:
    """Dotted name of a library."""
    return ".".join(name for _, name in reversed(path[1]))


def library_of(path: Node) -> str:
    """Dotted name of the library that a module path lies in."""
    while path[0] == "MPdot":
        path = path[1]
    if path[0] not in ("MPfile", "MPbound"):
        raise ValueError(f"no module path: {path[0]}")
    return library(path[1] if path[0] == "MPfile" else path[1][-1])


def module(path: Node) -> str:
    """Dotted name of a module path."""
    labels: list[str] = []
    while path[0] == "MPdot":
        labels.append(path[2][1][1] if isinstance(path[2][1], list) else path[2][1])
        path = path[1]
    if path[0] == "MPbound":
        labels.append(path[1][-2][1])
    return ".".join(filter(None, [library_of(path), *reversed(labels)]))


def kernel_name(node: Node) -> str:
    """Printed kernel name: ``path.x``, or ``path#library#x`` inside a section."""
    if node[0] != "KerName" or not 3 <= len(node) <= 5:
        raise ValueError("no kernel name")
    path = node[2] if len(node) == 5 else node[1]
    section = library(node[-2]) if len(node) > 3 else ""
    return module(path) + (f"#{section}#" if section else ".") + node[-1][1]


_PRINTERS = {"DirPath": library, "MPdot": module, "MPfile": module, "MPbound": module, "KerName": kernel_name}


def printed(text: Column) -> Column:
    """Dotted name of a serialised library, module path or kernel name; null for null."""

    @F.pandas_udf("string")
    def name(texts: pd.Series) -> pd.Series:
        nodes = [None if t is None else parse(t) for t in texts]
        return pd.Series([None if x is None else _PRINTERS[x[0]](x) for x in nodes], dtype="object")

    return name(text)
