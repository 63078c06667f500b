"""Load paths, option settings, traced commands and version tables."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .versions import version_key

# ----- load paths: -I dir, -Q dir name, -R dir name


def flags(args: Column, flag: str) -> Column:
    """Values of a load-path flag in an array of arguments: dirs of ``I``, (dir, name) of ``Q`` and ``R``."""
    n = F.size(args)
    places = F.filter(
        F.transform(args, lambda a, i: F.when(a == f"-{flag}", i + 1)),
        lambda i: i.isNotNull() & (i + (1 if flag == "I" else 2) <= n),
    )
    if flag == "I":
        return F.array_distinct(F.transform(places, lambda i: F.get(args, i)))
    return F.array_distinct(F.transform(places, lambda i: F.struct(F.get(args, i).alias("dir"), F.get(args, i + 1).alias("name"))))


def load_path(args: Column) -> Column:
    """Struct of all three."""
    return F.struct(flags(args, "I").alias("I"), flags(args, "Q").alias("Q"), flags(args, "R").alias("R"))


def merged(a: Column, b: Column) -> Column:
    """Union of two load paths."""
    return F.struct(*[F.array_union(a[k], b[k]).alias(k) for k in "IQR"])


def relocated(path: Column, old: Column, new: Column) -> Column:
    """Load path with directories below ``old`` moved below ``new``."""

    def moved(d: Column) -> Column:
        inside = (d == old) | F.startswith(d, F.concat(old, F.lit("/")))
        return F.when(inside, F.concat(new, F.substring(d, F.length(old) + 1, F.length(d)))).otherwise(d)

    pairs = [F.transform(path[k], lambda p: F.struct(moved(p["dir"]).alias("dir"), p["name"].alias("name"))).alias(k) for k in "QR"]
    return F.struct(F.transform(path["I"], moved).alias("I"), *pairs)


def logical_name(path: Column, file: Column) -> Column:
    """Logical name of a file by the longest bound directory above it; null if there is none.

    ``Q`` and ``R`` bind directories alike here; a file in no bound directory has no name.
    """
    bound = F.concat(path["Q"], path["R"])
    fits = F.filter(bound, lambda p: F.startswith(file, F.concat(p["dir"], F.lit("/"))))
    best = F.array_max(F.transform(fits, lambda p: F.struct(F.length(p["dir"]).alias("n"), p["dir"].alias("dir"), p["name"].alias("name"))))
    rest = F.replace(F.regexp_replace(F.substring(file, best["n"] + 2, F.length(file)), r"\.v$", ""), F.lit("/"), F.lit("."))
    return F.when(best.isNotNull(), F.when(best["name"] == "", rest).otherwise(F.concat_ws(".", best["name"], rest)))


# ----- settings


def settings_map(table: Column) -> Column:
    """Map of a printed options table: lines ``Name: value``, with ``on``/``off`` as true/false."""
    lines = F.filter(F.split(table, "\n"), lambda s: s.rlike(r"^\s*[^:]+:\s*\S"))
    name = F.transform(lines, lambda s: F.trim(F.regexp_extract(s, r"^\s*([^:]+):", 1)))
    value = F.transform(lines, lambda s: F.trim(F.regexp_extract(s, r"^\s*[^:]+:\s*(.*)$", 1)))
    plain = F.transform(value, lambda v: F.when(v == "on", "true").when(v == "off", "false").otherwise(v))
    return F.map_from_arrays(name, plain)


def merge_settings(a: Column, b: Column) -> Column:
    """Settings of which the later ones win."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x))


def setting_command(name: Column, value: Column) -> Column:
    """Command that sets an option."""
    return (
        F.when(value == "true", F.concat(F.lit("Set "), name, F.lit(".")))
        .when(value == "false", F.concat(F.lit("Unset "), name, F.lit(".")))
        .when(value.rlike(r"^-?\d+$"), F.concat(F.lit("Set "), name, F.lit(" "), value, F.lit(".")))
        .otherwise(F.concat(F.lit("Set "), name, F.lit(' "'), value, F.lit('".')))
    )


def warnings_map(names: Column) -> Column:
    """Map of warning names to enabled, disabled (``-``) or error (``+``); the last mention wins."""
    entries = F.transform(
        F.split(names, ","),
        lambda w: F.struct(
            F.regexp_replace(F.trim(w), "^[-+]", "").alias("key"),
            F.when(F.trim(w).startswith("-"), "disabled").when(F.trim(w).startswith("+"), "error").otherwise("enabled").alias("value"),
        ),
    )
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


# ----- traced commands

_EXEC = r'execve\("((?:[^"\\]|\\.)*)", \[(.*?)\](?:, \[(.*?)\])?\)\s*= 0'


def traced(lines: DataFrame, line: str, target: str) -> DataFrame:
    """(executable, args, env, pwd, target) of successful ``execve`` lines with an argument that matches a pattern.

    Strings are octal or hex escaped; they are decoded as UTF-8.
    """
    decode = F.udf(_unescape, "array<string>")
    found = lines.withColumn("_exe", F.regexp_extract(line, _EXEC, 1)).filter("_exe <> ''")
    found = found.withColumn("args", decode(F.regexp_extract(line, _EXEC, 2))).withColumn("_env", decode(F.regexp_extract(line, _EXEC, 3)))
    pairs = F.transform(
        F.filter("_env", lambda e: e.contains("=")),
        lambda e: F.struct(F.regexp_extract(e, "^([^=]*)=", 1).alias("key"), F.regexp_extract(e, "(?s)^[^=]*=(.*)$", 1).alias("value")),
    )
    env = F.map_from_entries(pairs)
    hits = F.filter("args", lambda a: a.rlike(f"^(?:{target})$"))
    return found.select(
        F.col("_exe").alias("executable"), "args", env.alias("env"), F.element_at(env, "PWD").alias("pwd"), F.explode(hits).alias("target")
    )


def _unescape(text: str | None) -> list[str]:
    """Quoted strings of an argument list."""
    out = []
    for s in re.findall(r'"((?:[^"\\]|\\.)*)"', text or ""):
        out.append(ast.literal_eval('b"' + s.encode("ascii", "backslashreplace").decode() + '"').decode("utf-8", "replace"))
    return out


# ----- compatibility of versions: tables (coq, other) of pairs that work together


def compatible(probes: DataFrame, table: DataFrame, other: str) -> DataFrame:
    """Whether the versions of each probe (coq, other) work together; a null one works with all."""
    t = table.select(F.col("coq").alias("_c"), F.col(other).alias("_o"), F.lit(True).alias("_ok")).distinct()
    both = probes.join(t, (F.col("coq") == F.col("_c")) & (F.col(other) == F.col("_o")), "left")
    ok = F.col("coq").isNull() | F.col(other).isNull() | F.coalesce("_ok", F.lit(False))
    return both.withColumn("compatible", ok).drop("_c", "_o", "_ok")


def latest_compatible(table: DataFrame, other: str) -> DataFrame:
    """Newest version that works with each coq version."""
    return table.groupBy("coq").agg(F.max_by(other, version_key(F.col(other))).alias(other))
