"""Layered metadata: records keyed by (project, url, sha, coq, ocaml), null meaning any.

A probe gets each field from the most specific record that matches it and sets the field.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the levels of precedence.
LEVELS = {"coq_version": 1, "ocaml_version": 2, "project_url": 4, "commit_sha": 8}
KEY = ["project_name", "project_url", "commit_sha", "coq_version", "ocaml_version"]


def level(prefix: str = "") -> Column:
    """Specificity of a record."""
    return reduce(lambda a, b: a + b, [F.when(F.col(prefix + k).isNotNull(), v).otherwise(0) for k, v in LEVELS.items()])


def fallback(probes: DataFrame, records: DataFrame, fields: list[str], inclusive: bool = True) -> DataFrame:
    """Fields of each probe, inherited from the most specific records that match.

    A probe asks once per level for the record that sets just the level's fields, so the join has
    equal keys throughout, however many records a project has. ``inclusive=False`` leaves out the
    record of exactly the probe's context: its defaults.
    """
    r = records.select(*[F.col(k).alias(f"r_{k}") for k in KEY], *[F.col(f).alias(f"r_{f}") for f in fields])
    p = probes.select(*KEY).distinct()
    full = level()
    asked = p.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(sum(LEVELS.values())))))
    # a level that takes in a null field says no more than the one without it
    asked = asked.filter(F.col("_level").bitwiseAND(full) == F.col("_level"))
    if not inclusive:
        asked = asked.filter(F.col("_level") != full)
    for k, bit in LEVELS.items():
        asked = asked.withColumn(f"_{k}", F.when(F.col("_level").bitwiseAND(bit) != 0, F.col(k)))
    match = [F.col("project_name") == F.col("r_project_name"), *[F.col(f"_{k}").eqNullSafe(F.col(f"r_{k}")) for k in LEVELS]]
    values = [F.max_by(f"r_{f}", F.when(F.col(f"r_{f}").isNotNull(), F.col("_level"))).alias(f) for f in fields]
    origins = [F.max(F.when(F.col(f"r_{f}").isNotNull(), F.col("_level"))).alias(f"{f}_level") for f in fields]
    return asked.join(r, match).groupBy(*KEY).agg(*values, *origins)


def with_defaults(found: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    return found.withColumns({k: F.coalesce(F.col(k), v) for k, v in defaults.items()})


def insert(records: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """Add records, storing only what differs from what they would inherit; a known context is an error."""
    known = records.select(*[F.col(k).alias(f"k_{k}") for k in KEY], F.lit(True).alias("_known"))
    inherited = fallback(new, records, fields, inclusive=False)
    both = new.alias("n").join(inherited.alias("i"), [F.col(f"n.{k}").eqNullSafe(F.col(f"i.{k}")) for k in KEY], "left")
    both = both.join(known, [F.col(f"n.{k}").eqNullSafe(F.col(f"k_{k}")) for k in KEY], "left")
    own = [F.when(~F.col(f"n.{f}").eqNullSafe(F.col(f"i.{f}")), F.col(f"n.{f}")).alias(f) for f in fields]
    clash = F.raise_error(F.lit("the context is there already")).cast("string")
    name = F.when(F.col("_known"), clash).otherwise(F.col(f"n.{KEY[0]}"))
    added = both.select(name.alias(KEY[0]), *[F.col(f"n.{k}").alias(k) for k in KEY[1:]], *own)
    return records.select(*KEY, *fields).unionByName(added)


def remove(records: DataFrame, contexts: DataFrame) -> DataFrame:
    """Without the records of exactly these contexts."""
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in KEY]
    return records.alias("r").join(contexts.select(*KEY).alias("c"), same, "left_anti")


def update(records: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """Set fields of contexts; values equal to the inherited ones are removed rather than stored."""
    rest = remove(records, changes)
    old = records.alias("r").join(changes.alias("c"), [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in KEY], "right")
    new = old.select(*[F.col(f"c.{k}").alias(k) for k in KEY], *[F.coalesce(F.col(f"c.{f}"), F.col(f"r.{f}")).alias(f) for f in fields])
    return insert(rest, new, fields)


def remove_field(records: DataFrame, contexts: DataFrame, field: str) -> DataFrame:
    hit = contexts.select(*[F.col(k).alias(f"c_{k}") for k in KEY], F.lit(True).alias("_hit"))
    both = records.join(hit, [F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in KEY], "left")
    return both.withColumn(field, F.when(F.col("_hit").isNull(), F.col(field))).select(*records.columns)


def union_first(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of tables in which, for each key, the first table that has it wins."""
    tagged = [p.withColumn("_from", F.lit(i)) for i, p in enumerate(parts)]
    both = reduce(lambda a, b: a.unionByName(b), tagged)
    columns = parts[0].columns
    best = F.min_by(F.struct(*columns), F.col("_from"))
    return both.groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg(best.alias("r")).select("r.*")


def revisions(records: DataFrame, project: str) -> DataFrame:
    return records.filter(F.col("project_name") == project).select("commit_sha").filter("commit_sha is not null").distinct()


def sources(records: DataFrame, project: str) -> DataFrame:
    return records.filter(F.col("project_name") == project).select("project_url").filter("project_url is not null").distinct()


def coq_versions(records: DataFrame, project: str, commit_sha: str | None = None) -> DataFrame:
    """Versions of a project; without a commit those of contexts that have none."""
    mine = records.filter(F.col("project_name") == project)
    mine = mine.filter(F.col("commit_sha").eqNullSafe(F.lit(commit_sha)))
    return mine.select("coq_version").filter("coq_version is not null").distinct()
