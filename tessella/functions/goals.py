"""Goal states: counts, locations, diffs and patches.

A state is a struct of ``foreground``, ``background`` (pairs of left and right lists, the
innermost first), ``shelved`` and ``abandoned``; goals are strings here, any value in Python.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "foreground array<string>, background array<struct<l:array<string>,r:array<string>>>, shelved array<string>, abandoned array<string>"


def counts(goals: Column) -> dict[str, Column]:
    """Number of goals of each kind."""
    sides = F.aggregate(goals["background"], F.lit(0), lambda n, p: n + F.size(p["l"]) + F.size(p["r"]))
    return {
        "n_foreground": F.size(goals["foreground"]),
        "n_background": sides,
        "n_shelved": F.size(goals["shelved"]),
        "n_abandoned": F.size(goals["abandoned"]),
    }


def is_empty(goals: Column) -> Column:
    c = counts(goals)
    return (c["n_foreground"] + c["n_background"] + c["n_shelved"] + c["n_abandoned"]) == 0


def located(goals: Column) -> Column:
    """Array of (goal, kind, depth, side, index), for ``inline``."""
    kind = "struct<goal:string,kind:string,depth:int,side:string,idx:int>"

    def row(goal, name, depth, side, i):
        return F.struct(goal.alias("goal"), F.lit(name).alias("kind"), depth.alias("depth"), F.lit(side).alias("side"), i.alias("idx")).cast(kind)

    none = F.lit(None).cast("int")
    flat = [F.transform(goals[k], lambda g, i, k=k: row(g, k, none, "", i)) for k in ("foreground", "shelved", "abandoned")]
    back = F.flatten(
        F.transform(
            goals["background"],
            lambda p, d: F.concat(
                F.transform(p["l"], lambda g, i: row(g, "background", d, "left", i)),
                F.transform(p["r"], lambda g, i: row(g, "background", d, "right", i)),
            ),
        )
    )
    return F.concat(*flat, back)


State = dict
Place = tuple[str, int, str, int]


def places(state: State) -> Iterator[tuple[object, Place]]:
    """Goals of a state with where they are."""
    for kind in ("foreground", "shelved", "abandoned"):
        for i, g in enumerate(state[kind]):
            yield g, (kind, -1, "", i)
    for depth, (left, right) in enumerate(state["background"]):
        for side, goals in (("left", left), ("right", right)):
            for i, g in enumerate(goals):
                yield g, ("background", depth, side, i)


def compute_diff(a: State, b: State) -> dict:
    """What turns ``a`` into ``b``: goals added, removed and moved with their places, and the change of depth."""
    before, after = list(places(a)), list(places(b))
    gone, new = Counter(before) - Counter(after), Counter(after) - Counter(before)
    moved = []
    for (goal, src) in list(gone):
        target = next((x for x in new if x[0] == goal), None)
        if target is not None:
            moved.append((goal, src, target[1]))
            gone -= Counter([(goal, src)])
            new -= Counter([target])
    return {
        "added": sorted(new.elements(), key=str),
        "removed": sorted(gone.elements(), key=str),
        "moved": sorted(moved, key=str),
        "depth_change": len(b["background"]) - len(a["background"]),
    }


def patch(a: State, diff: dict) -> State:
    """Apply a diff: removals from the back, then additions from the front."""
    at = dict((place, goal) for goal, place in places(a))
    for _, place in diff["removed"]:
        del at[place]
    for _, src, _ in diff["moved"]:
        del at[src]
    for goal, place in diff["added"]:
        at[place] = goal
    for goal, _, dst in diff["moved"]:
        at[dst] = goal
    depth = len(a["background"]) + diff["depth_change"]
    out: State = {"foreground": [], "shelved": [], "abandoned": [], "background": [([], []) for _ in range(depth)]}
    for (kind, d, side, _), goal in sorted(at.items(), key=lambda x: x[0]):
        (out["background"][d][side == "right"] if kind == "background" else out[kind]).append(goal)
    return out


def carry(states: list[dict | None]) -> Iterator[State | None]:
    """Full states from a first state and the diffs that follow; None repeats the state before."""
    now: State | None = None
    for s in states:
        if s is not None:
            now = patch(now, s) if "added" in s else s
        yield now


def compress(states: list[State]) -> Iterator[dict]:
    """First state, then diffs: the inverse of ``carry``."""
    last = None
    for s in states:
        yield s if last is None else compute_diff(last, s)
        last = s
