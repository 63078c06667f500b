"""Unified diffs (without context) as tables of hunks."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

_HEAD = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
HUNK = (
    "before_file string, after_file string, before_start int, before_end int, after_start int, after_end int, "
    "removed array<string>, added array<string>"
)


def _name(text: str) -> str | None:
    """File of a ``---`` or ``+++`` line; None for the null device."""
    name = text[4:].split("\t")[0].strip()
    return None if name == "/dev/null" else name[2:] if name[:2] in ("a/", "b/") else name


def lines_of(text: str) -> list[str]:
    """Lines as git counts them: line feeds alone end one."""
    lines = text.split("\n")
    return lines if lines[-1] else lines[:-1]


def parse_diff(text: str) -> Iterator[tuple]:
    """Hunks as rows of ``HUNK``; lines are half-open ranges, a count left out is 1, a pure rename has none."""
    before = after = None
    rename: list[str | None] = [None, None]
    hunk: list | None = None
    pending = False
    for line in lines_of(text):
        if hunk is not None and line[:1] in ("-", "+", "\\") and (len(hunk[6]) < hunk[3] - hunk[2] or len(hunk[7]) < hunk[5] - hunk[4] or line[0] == "\\"):
            if line[0] == "-":
                hunk[6].append(line[1:])
            elif line[0] == "+":
                hunk[7].append(line[1:])
            continue
        if hunk is not None:
            yield tuple(hunk)
            hunk = None
        if line.startswith("diff --git"):
            if pending:
                yield (*rename, 0, 0, 0, 0, [], [])
            before = after = None
            rename, pending = [None, None], False
        elif line.startswith("rename from "):
            rename[0] = line[12:]
        elif line.startswith("rename to "):
            rename[1], pending = line[10:], True
        elif line.startswith("--- "):
            before = _name(line)
        elif line.startswith("+++ "):
            after, pending = _name(line), False
        elif m := _HEAD.match(line):
            a, n, b, k = int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)
            if m[2] is not None:
                n = int(m[2])
            if m[4] is not None:
                k = int(m[4])
            hunk = [before, after, a, a + n, b, b + k, [], []]
    if hunk is not None:
        yield tuple(hunk)
    if pending:
        yield (*rename, 0, 0, 0, 0, [], [])


@udtf(returnType=HUNK, useArrow=True)
class DiffHunks:
    """Table function: hunks of a diff."""

    def eval(self, text: str) -> Iterator[tuple]:
        if text:
            yield from parse_diff(text)


def hunks_of(df: DataFrame, text: str) -> DataFrame:
    """Rows with each of their diff's hunks."""
    spark = df.sparkSession
    spark.udtf.register("diff_hunks", DiffHunks)
    return spark.sql(f"SELECT s.*, h.* FROM {{df}} s, LATERAL diff_hunks(s.`{text}`) h", df=df)


def is_rename(before: Column, after: Column) -> Column:
    return before.isNotNull() & after.isNotNull() & (before != after)


def is_pure_rename(h: DataFrame) -> Column:
    return is_rename(h["before_file"], h["after_file"]) & (F.size(h["removed"]) == 0) & (F.size(h["added"]) == 0)


def renames(h: DataFrame, by: list[str]) -> DataFrame:
    """Map of old to new names."""
    some = h.filter(is_rename(h["before_file"], h["after_file"])).select(*by, "before_file", "after_file").distinct()
    return some.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("before_file", "after_file"))).alias("renames"))


def unified(a: str, b: str, name: str) -> str:
    """Diff of two texts without context lines."""
    lines = difflib.unified_diff(lines_of(a), lines_of(b), f"a/{name}", f"b/{name}", n=0, lineterm="")
    return "\n".join(lines)
