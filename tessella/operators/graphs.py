"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sequences import numbered
from .storage import stored


def levels(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 10_000) -> DataFrame:
    """(node, level): the longest path from a node without predecessors; edges run (src -> dst).

    A level's nodes are those whose predecessors all have lower ones. A cycle is an error.
    """
    edges = edges.select("src", "dst").distinct()
    every = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    if nodes is not None:
        every = every.union(nodes.select("node"))
    left = stored(every.distinct())
    todo, out, level = edges, None, 0
    n = left.count()
    while n:
        ready = left.join(todo.select(F.col("dst").alias("node")), "node", "left_anti")
        ready = stored(ready.withColumn("level", F.lit(level)))
        k = ready.count()
        if not k or level > max_rounds:
            raise ValueError("the graph has a cycle")
        out = ready if out is None else out.unionByName(ready)
        left = stored(left.join(ready.select("node"), "node", "left_anti"))
        todo = stored(todo.join(ready.select(F.col("node").alias("src")), "src", "left_anti"))
        n, level = n - k, level + 1
    return out if out is not None else left.withColumn("level", F.lit(0))


def topological(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, level, place): an order in which edges run forward; names decide within a level."""
    found = levels(edges, nodes)
    return numbered(found, ["level", "node"], "place").select("node", "level", "place")


def order_violations(order: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that an order (node, place) doesn't keep; none for a topological one."""
    a = order.select(F.col("node").alias("src"), F.col("place").alias("src_place"))
    b = order.select(F.col("node").alias("dst"), F.col("place").alias("dst_place"))
    return edges.join(a, "src").join(b, "dst").filter("src_place >= dst_place")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) by the least node of each component; edges have no direction.

    Labels of neighbours are taken over and then followed to their own label, so the number of
    rounds grows with the logarithm of a component's diameter.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = stored(both.union(both.select("b", "a")).distinct())
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        new = label.join(near, "node").select("node", F.least("label", "seen").alias("label"))
        jump = new.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = stored(new.join(jump, "label").select("node", F.least("label", "further").alias("label")))
        changed = new.alias("n").join(label.alias("o"), "node").filter("n.label <> o.label")
        label, done = new, changed.isEmpty()
        if done:
            return label.select("node", F.col("label").alias("component"))


def reachable(spark: SparkSession, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) of all nodes that roots reach, themselves included: a recursive query."""
    return spark.sql(
        """WITH RECURSIVE r(root, node) AS (SELECT node, node FROM {roots} UNION ALL
        SELECT r.root, e.dst FROM r JOIN {edges} e ON e.src = r.node) SELECT DISTINCT root, node FROM r""",
        edges=edges.select("src", "dst"),
        roots=roots.select("node"),
    )


def neighbours(edges: DataFrame, nodes: DataFrame, kinds: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """Children (or parents) of nodes, along edges of some kinds."""
    if kinds is not None:
        edges = edges.filter(F.col("type").isin(kinds))
    here, there = ("dst", "src") if reverse else ("src", "dst")
    return nodes.select(F.col("node").alias(here)).join(edges, here).select(F.col(here).alias("node"), F.col(there).alias("other")).distinct()


def dependency_split(uses: DataFrame, owned: DataFrame) -> DataFrame:
    """Uses (project, name) of libraries as local, cross or unknown, by who owns (project, name) them."""
    own = owned.groupBy("name").agg(F.collect_set("project").alias("owners"))
    both = uses.join(own, "name", "left")
    kind = F.when(F.col("owners").isNull(), "unknown").when(F.array_contains("owners", F.col("project")), "local").otherwise("cross")
    return both.select("project", "name", kind.alias("kind"))


def guess_packages(libraries: DataFrame, mappings: DataFrame, strict: bool = False) -> DataFrame:
    """Packages whose name pattern (physical, logical prefix) fits a library; a prefix may end inside a part unless ``strict``."""
    every = F.transform(F.sequence(F.lit(0), F.length("library")), lambda n: F.left("library", n))
    begins = libraries.select("library", F.explode(every).alias("logical"))  # an equal join instead of a pattern per pair
    if strict:
        after = F.substring("library", F.length("logical") + 1, F.lit(1))
        begins = begins.filter(after.isin("", "."))
    return begins.join(mappings, "logical").select("library", "package").distinct()
