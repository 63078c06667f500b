"""Goal states along a proof: carried forward from diffs, or compressed to them, per ordered group."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import goals


def _state(text: str | None) -> dict | None:
    """Plain state or diff of its JSON text."""
    if text is None:
        return None
    got = json.loads(text)
    if "added" in got:
        return got | {k: [(g, tuple(p)) for g, p in got[k]] for k in ("added", "removed")} | {"moved": [(g, tuple(a), tuple(b)) for g, a, b in got["moved"]]}
    return got | {"background": [tuple(p) for p in got["background"]]}


def _walked(df: DataFrame, by: list[str], order: list[str], column: str, walk) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        states = [_state(t) for t in rows[column]]
        return rows.assign(**{column: [None if s is None else json.dumps(s) for s in walk(states)]})

    return df.groupBy(*by).applyInPandas(run, df.schema)


def carried(df: DataFrame, by: list[str], order: list[str], column: str = "goals") -> DataFrame:
    """Full states (JSON) of a proof's sentences, whose first is a state and whose others are diffs or null."""
    return _walked(df, by, order, column, goals.carry)


def compressed(df: DataFrame, by: list[str], order: list[str], column: str = "goals") -> DataFrame:
    """States as diffs against the sentence before; the inverse of ``carried``."""
    return _walked(df, by, order, column, lambda states: goals.compress([s for s in states]))


def facts(df: DataFrame, column: str = "goals") -> DataFrame:
    """Sentence facts: rows with the number of goals of each kind and in all."""
    state = F.from_json(column, goals.SCHEMA.replace("struct<l:array<string>,r:array<string>>", "array<array<string>>"))
    pairs = F.transform(state["background"], lambda p: F.struct(p[0].alias("l"), p[1].alias("r")))
    counts: dict[str, Column] = goals.counts(state.withField("background", pairs))
    out = df.withColumns(counts)
    return out.withColumn("n_goals", sum((F.col(c) for c in counts), F.lit(0)))
