"""Version strings as sortable keys.

The order of package versions: runs of non-digits alternate with numbers; within a run ``~``
sorts before the end, the end before letters, and letters before everything else.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_END, _TILDE = "\x02", "\x01"
_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "~")
_SHIFTED = "".join(chr(0x200 + ord(c)) for c in _SIGNS)


def version_key(v: Column) -> Column:
    """Key that sorts as package versions do: array of (run, number); a last empty pair ends it."""
    runs = F.regexp_extract_all(v, F.lit(r"([^0-9]*)([0-9]*)"), F.lit(1))
    numbers = F.regexp_extract_all(v, F.lit(r"([^0-9]*)([0-9]*)"), F.lit(2))
    run = F.transform(runs, lambda s: F.concat(F.translate(s, "~" + _SIGNS, _TILDE + _SHIFTED), F.lit(_END)))
    number = F.transform(numbers, lambda n: F.coalesce(F.try_to_number(F.nullif(n, F.lit("")), F.lit("9" * 18)).cast("long"), F.lit(0).cast("long")))
    pairs = F.zip_with(run, number, lambda s, n: F.struct(s.alias("s"), n.alias("n")))
    return F.when(v.isNotNull(), pairs)


def ocaml_key(v: Column) -> Column:
    """Key of compiler versions: major, minor, patch, extra, prerelease; absent parts rank as the compiler's do."""
    pattern = r"^(\d+)\.(\d+)(?:\.(\d+))?(?:\+([^~]*))?(?:~(.*))?$"

    def part(k: int) -> Column:
        return F.nullif(F.regexp_extract(v, pattern, k), F.lit(""))

    return F.when(
        v.rlike(pattern),
        F.struct(
            part(1).cast("int").alias("major"),
            part(2).cast("int").alias("minor"),
            F.coalesce(part(3).cast("int"), F.lit(-1)).alias("patch"),
            F.coalesce(part(4), F.lit("")).alias("extra"),
            F.coalesce(part(5), F.lit("\U0010ffff")).alias("prerelease"),
        ),
    )


def compare(a: Column, op: str, b: Column) -> Column:
    """Compare two version strings."""
    x, y = version_key(a), version_key(b)
    return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def same_minor(v: Column, version: str) -> Column:
    """Whether a version lies from ``major.minor`` on and before the next minor one's prereleases."""
    major, minor = (int(x) for x in version.split(".")[:2])
    return compare(v, ">=", F.lit(f"{major}.{minor}")) & compare(v, "<", F.lit(f"{major}.{minor + 1}~"))


def max_version(v: Column, mode: str = "lexical") -> Column:
    """Aggregate: the greatest version, as plain text (``lexical``) or as packages order it (``opam``)."""
    if mode == "lexical":
        return F.max(v)
    if mode == "opam":
        return F.max_by(v, version_key(v))
    raise ValueError(f"unknown mode {mode!r}")
