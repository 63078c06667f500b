"""Source spans: structs of line and character bounds, and predicates on them.

A span has ``filename, lineno, bol_pos, lineno_last, bol_pos_last, beg_charno, end_charno``;
characters are half open.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("filename", "lineno", "bol_pos", "lineno_last", "bol_pos_last", "beg_charno", "end_charno")
SCHEMA = "filename string, lineno int, bol_pos int, lineno_last int, bol_pos_last int, beg_charno int, end_charno int"


def contains(a: Column, b: Column) -> Column:
    """Whether span ``a`` holds all of span ``b``."""
    return (a["filename"] == b["filename"]) & (a["beg_charno"] <= b["beg_charno"]) & (a["end_charno"] >= b["end_charno"])


def contains_char(a: Column, charno: Column) -> Column:
    return (a["beg_charno"] <= charno) & (charno < a["end_charno"])


def contains_line(a: Column, lineno: Column) -> Column:
    return (a["lineno"] <= lineno) & (lineno <= a["lineno_last"])


def contains_char_range(a: Column, beg: Column, end: Column) -> Column:
    return (a["beg_charno"] <= beg) & (end <= a["end_charno"])


def intersects(a: Column, b: Column, by_line: bool = False) -> Column:
    """Whether spans share a character; by lines, whether an end line of ``b`` lies in ``a``.

    The line form is not symmetric: a span strictly around ``a`` is missed.
    """
    if by_line:
        return (a["filename"] == b["filename"]) & (contains_line(a, b["lineno"]) | contains_line(a, b["lineno_last"]))
    return (a["filename"] == b["filename"]) & (a["beg_charno"] < b["end_charno"]) & (b["beg_charno"] < a["end_charno"])


def shifted(a: Column, chars: Column, lines: Column) -> Column:
    """Span moved by characters and lines; where its lines begin is left alone."""
    return (
        a.withField("beg_charno", a["beg_charno"] + chars)
        .withField("end_charno", a["end_charno"] + chars)
        .withField("lineno", a["lineno"] + lines)
        .withField("lineno_last", a["lineno_last"] + lines)
    )


def renamed(a: Column, filename: Column) -> Column:
    return a.withField("filename", filename)


def num_chars(a: Column) -> Column:
    return a["end_charno"] - a["beg_charno"]


def num_lines(a: Column) -> Column:
    return a["lineno_last"] - a["lineno"] + 1


def columns(a: Column) -> tuple[Column, Column]:
    """First and last column."""
    return a["beg_charno"] - a["bol_pos"], a["end_charno"] - a["bol_pos_last"]


def sort_key(a: Column) -> Column:
    """Source order of spans that are nested or disjoint: inner before outer."""
    return F.struct(a["filename"], a["end_charno"], (-a["beg_charno"]).alias("inner"))


def difference(a: Column, b: Column) -> Column:
    """What must be added to ``a`` to get ``b``."""
    return F.struct(*[(b[f] - a[f]).alias(f) for f in FIELDS[1:]])


def patched(a: Column, diff: Column) -> Column:
    """Inverse of ``difference``."""
    out = a
    for f in FIELDS[1:]:
        out = out.withField(f, a[f] + diff[f])
    return out


def union_span(a: Column) -> Column:
    """Aggregate: the least span around all."""
    first, last = F.min_by(a, a["beg_charno"]), F.max_by(a, a["end_charno"])
    return F.struct(
        first["filename"].alias("filename"),
        first["lineno"].alias("lineno"),
        first["bol_pos"].alias("bol_pos"),
        last["lineno_last"].alias("lineno_last"),
        last["bol_pos_last"].alias("bol_pos_last"),
        first["beg_charno"].alias("beg_charno"),
        last["end_charno"].alias("end_charno"),
    )


def in_hunk(a: Column, start: Column, end: Column) -> Column:
    """Whether a span (lines from 0) meets a hunk's lines ``[start, end)`` (from 1).

    An empty hunk lies before line ``start`` and touches a span that goes on past it.
    """
    first, last = a["lineno"] + 1, a["lineno_last"] + 1
    touched = F.when(start < end, (first < end) & (start <= last))
    return touched.otherwise((first <= start) & (start < last))
