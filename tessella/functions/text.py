"""String functions as Column builders; all run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMS = ("max", "product", "tanimoto")


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in code points."""
    return F.levenshtein(a, b)


def norm_distance(d: Column, a: Column, b: Column, norm: str = "tanimoto") -> Column:
    """Normalise distance ``d`` of things with norms ``a`` and ``b``; 0 if both norms are 0.

    ``product`` of two equal strings is 0.5, and null if exactly one norm is 0.
    """
    a, b, d = a.cast("double"), b.cast("double"), d.cast("double")
    if norm == "max":
        value = d / F.greatest(a, b)
    elif norm == "product":
        value = F.when(a * b != 0, F.lit(1.0) - (a + b - d) / (F.lit(4.0) * F.sqrt(a * b)))
    elif norm == "tanimoto":
        value = F.lit(2.0) * d / (a + b + d)
    else:
        raise ValueError(f"unknown norm {norm!r}")
    return F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(value)


def norm_edit_distance(a: Column, b: Column, norm: str = "tanimoto") -> Column:
    return norm_distance(edit_distance(a, b), F.length(a), F.length(b), norm)


def clipped(distance: Column, threshold: float = 0.4) -> Column:
    """Distance with an upper limit; a negative limit is an error."""
    if threshold < 0:
        raise ValueError(f"the threshold must not be negative: {threshold}")
    return F.least(distance, F.lit(float(threshold)))


def within(a: Column, b: Column, threshold: float = 0.4) -> Column:
    """Whether the Tanimoto edit distance is under the threshold, without the whole matrix.

    ``2d / (a + b + d) < t`` means ``d < t (a + b) / (2 - t)``, so lengths that differ by that much
    are out, and Spark's bounded distance may stop early (-1).
    """
    la, lb = F.length(a), F.length(b)
    limit = (la + lb) * F.lit(threshold / (2 - threshold))
    return (F.abs(la - lb) < limit) & (clipped(norm_edit_distance(a, b), threshold) < threshold)


def normalize_spaces(s: Column) -> Column:
    """Runs of white space become one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(s, r"[ \t\n\r\f\x0B]+", " "))


def token_count(s: Column) -> Column:
    """Number of runs between white space; 0 for blank text."""
    t = normalize_spaces(s)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def escape(s: Column, chars: str = "\"\\", mark: str = "\\") -> Column:
    """Put ``mark`` before each of ``chars``."""
    inside = "".join("\\" + c for c in chars)
    return F.regexp_replace(s, f"([{inside}])", (mark.replace("\\", "\\\\")) + "$1")


def quote_escape(s: Column, chars: str = "\"\\") -> Column:
    """Escaped and quoted, unless there is nothing to escape."""
    inside = "".join("\\" + c for c in chars)
    return F.when(s.rlike(f"[{inside}]"), F.concat(F.lit('"'), escape(s, chars), F.lit('"'))).otherwise(s)


def unquote(s: Column) -> Column:
    """Without a pair of double quotes around it."""
    paired = (F.length(s) >= 2) & s.startswith('"') & s.endswith('"')
    return F.when(paired, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)


def any_of(options: list[str], start: bool = True, end: bool = False) -> str:
    """Regular expression for one of several patterns, anchored at word bounds as asked."""
    return ("^" if start else "") + "(?:" + "|".join(options) + ")" + ("$" if end else "")


def canonical_url(url: Column) -> Column:
    """Repository address without a trailing ``.git`` or slash."""
    return F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", "")


def version_to_path(v: Column) -> Column:
    return F.replace(v, F.lit("."), F.lit("_"))


def path_to_version(p: Column) -> Column:
    return F.replace(p, F.lit("_"), F.lit("."))


def change_suffix(path: Column, suffix: str) -> Column:
    """Path with its last extension replaced."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(suffix))


def without_suffixes(path: Column) -> Column:
    """Path without any extension of its last part."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^/]*$", "")


def relative_to(path: Column, root: Column) -> Column:
    """Path below a root; null if it isn't."""
    base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path)))


def record_file_name(*parts: Column, suffix: str = ".git.json") -> Column:
    """Canonical name of a record's file: parts joined by dashes."""
    return F.concat(F.concat_ws("-", *parts), F.lit(suffix))


def selection_string(pairs: Column) -> Column:
    """Array of (file, idx) as sorted ``file idx`` terms joined by blanks."""
    terms = F.transform(F.array_sort(pairs), lambda p: F.concat_ws(" ", p["file"], p["idx"].cast("string")))
    return F.array_join(terms, " ")


def split_label(s: Column) -> tuple[Column, Column]:
    """``message, LABEL`` at the last comma."""
    rest = F.regexp_extract(s, r"(?s)^(.*),([^,]*)$", 1)
    found = F.regexp_extract(s, r"(?s)^(.*),([^,]*)$", 2)
    has = F.contains(s, F.lit(","))
    return F.when(has, F.trim(rest)).otherwise(s), F.when(has, F.trim(found))


def camel_case(s: Column) -> Column:
    """Title case of the parts between ``-`` and ``_``, put together."""
    parts = F.filter(F.split(s, "[-_]"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def name_variants(name: Column, tag: str = "coq") -> Column:
    """Spellings of a project's name: as it is, lower case, without the tag, with ``_`` and ``-`` exchanged, camel case."""
    stems = F.array(
        name,
        F.regexp_replace(name, f"^{tag}-", ""),
        F.regexp_replace(name, f"-{tag}$", ""),
        F.regexp_replace(name, f"-{tag}-", "-"),
    )
    forms = F.transform(
        stems,
        lambda s: F.array(s, F.lower(s), F.translate(s, "-", "_"), F.translate(s, "_", "-"), F.regexp_replace(s, "[-_]", ""), camel_case(s)),
    )
    return F.array_sort(F.array_distinct(F.filter(F.flatten(forms), lambda s: s != "")))


def logical_parts(name: Column) -> Column:
    """Parts of a dotted name; none for the empty one."""
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.split(name, r"\."))


def logical_parents(name: Column) -> Column:
    """All proper prefixes, the nearest first."""
    parts = logical_parts(name)
    n = F.size(parts)
    cuts = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.transform(cuts, lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))


def logical_short_names(name: Column) -> Column:
    """All suffixes by parts, the shortest first."""
    parts = logical_parts(name)
    n = F.size(parts)
    cuts = F.when(n > 0, F.sequence(n, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.transform(cuts, lambda k: F.array_join(F.slice(parts, k, n - k + 1), "."))


def logical_stem(name: Column) -> Column:
    return F.element_at(logical_parts(name), -1)


def is_relative_to(name: Column, root: Column) -> Column:
    """Whether the name's first parts are the root's."""
    return F.slice(logical_parts(name), F.lit(1), F.size(logical_parts(root))) == logical_parts(root)


def logical_from_path(path: Column) -> Column:
    """Dotted name of a source path."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), "^/+", ""), F.lit("/"), F.lit("."))


def criteria(*predicates: Column, how: str = "all") -> Column:
    """Predicates put together by ``all`` or ``any``; without any, true or false."""
    if how == "all":
        return reduce(lambda a, b: a & b, predicates, F.lit(True))
    if how == "any":
        return reduce(lambda a, b: a | b, predicates, F.lit(False))
    raise ValueError(f"unknown reduction {how!r}")


def byte_offset(s: Column, char_offset: Column) -> Column:
    """Byte offset (UTF-8) of a character offset."""
    return F.octet_length(F.substring(s, F.lit(1), char_offset))


def strip_span(s: Column, start: Column) -> Column:
    """Stripped text with where it begins and ends, given where ``s`` begins."""
    left = F.length(s) - F.length(F.regexp_replace(s, r"^[ \t\n\r\f]+", ""))
    bare = F.regexp_replace(F.regexp_replace(s, r"^[ \t\n\r\f]+", ""), r"[ \t\n\r\f]+$", "")
    return F.struct(bare.alias("text"), (start + left).alias("start"), (start + left + F.length(bare)).alias("end"))
