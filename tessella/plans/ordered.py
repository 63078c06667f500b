"""Ordered-sequence queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sequences as S
from ..sources.tables import load
from .registry import query


@query(
    """SELECT user_id, event_id, next_event_id, next_event_type FROM (SELECT user_id, event_id, ts,
    lead(event_id) OVER w AS next_event_id, lead(event_type) OVER w AS next_event_type FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE next_event_id IS NOT NULL"""
)
def consecutive_pairs(spark: SparkSession, d: str) -> DataFrame:
    out = S.consecutive(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type"])
    return out.select("user_id", "event_id", "next_event_id", "next_event_type")


@query(
    """WITH ok AS (SELECT event_id FROM events WHERE event_type <> 'error'),
    p AS (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event_id FROM events)
    SELECT user_id, event_id, next_event_id FROM p WHERE event_id IN (FROM ok) AND next_event_id IN (FROM ok)"""
)
def allow_listed_pairs(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    ok = events.filter("event_type <> 'error'").select("event_id")
    out = S.allowed_pairs(events.select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], "event_id", ok)
    return out.select("user_id", "event_id", "next_event_id")


@query(
    """WITH c AS (SELECT o_custkey AS project, o_orderkey AS sha, o_orderdate AS authored FROM orders),
    p AS (SELECT project, sha, lead(sha) OVER (PARTITION BY project ORDER BY authored, sha) AS next_sha FROM c),
    l AS (SELECT DISTINCT l_orderkey AS sha, l_partkey AS item FROM lineitem)
    SELECT p.project, p.sha, p.next_sha, a.item AS a_item, b.item AS b_item
    FROM p JOIN l a ON a.sha = p.sha JOIN l b ON b.sha = p.next_sha"""
)
def label_pairs(spark: SparkSession, d: str) -> DataFrame:
    commits = load(spark, d, "orders").select(
        F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("authored")
    )
    items = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("item")).distinct()
    labels = items.join(commits.select("sha", "project"), "sha")
    return S.label_pairs(labels, commits).select("project", "sha", "next_sha", "a_item", "b_item")


@query(
    """SELECT conv_id, turn, text, next_text FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text,
    lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations) WHERE next_turn IS NOT NULL"""
)
def adjacent_turns(spark: SparkSession, d: str) -> DataFrame:
    out = S.consecutive(load(spark, d, "conversations"), ["conv_id"], ["turn"], ["text"])
    return out.select("conv_id", "turn", "text", "next_text")


@query(
    """SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    WHERE before IS NULL OR before <> event_type"""
)
def changed_state_islands(spark: SparkSession, d: str) -> DataFrame:
    out = S.changes_only(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return out.select("user_id", "event_id", "event_type")


@query(
    """WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS fresh FROM events),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS island FROM a)
    SELECT user_id, island::BIGINT AS island, min(event_type) AS event_type, count(*) AS n, string_agg(event_id::VARCHAR, ' ' ORDER BY ts, event_id) AS ids
    FROM b GROUP BY user_id, island"""
)
def glommed_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = S.islands(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    items = F.array_sort(F.collect_list(F.struct("ts", "event_id")))
    return runs.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(
        F.min("event_type").alias("event_type"),
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(items, lambda x: x["event_id"].cast("string")), " ").alias("ids"),
    )


@query(
    """SELECT user_id, event_id, coalesce(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS depth FROM events"""
)
def running_depth(spark: SparkSession, d: str) -> DataFrame:
    step = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", -1).otherwise(0)
    return S.running_before(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], step, "depth").select(
        "user_id", "event_id", F.col("depth").cast("long").alias("depth")
    )


@query(
    """SELECT o_custkey, o_orderkey, coalesce(sum(o_orderkey % 97) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at FROM orders"""
)
def prefix_offsets(spark: SparkSession, d: str) -> DataFrame:
    out = S.running_before(load(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderkey") % 97, "start_at")
    return out.select("o_custkey", "o_orderkey", "start_at")


@query(
    """SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events"""
)
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events").withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("value")))
    return S.carried(events, ["user_id"], ["ts", "event_id"], "bought", "carried").select("user_id", "event_id", "carried")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rank FROM orders")
def record_rank(spark: SparkSession, d: str) -> DataFrame:
    return S.ranked(load(spark, d, "orders"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "rank")


@query(
    """SELECT conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS command_index FROM conversations"""
)
def canonical_index(spark: SparkSession, d: str) -> DataFrame:
    out = S.ranked(load(spark, d, "conversations"), ["role"], ["conv_id", "turn"], "command_index")
    return out.select("conv_id", "turn", "command_index")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1"""
)
def uniquify(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return S.first_of(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])


@query("SELECT o_orderkey, o_orderstatus, ntile(7) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS chunk FROM orders")
def chunk_ntile(spark: SparkSession, d: str) -> DataFrame:
    return S.chunks(load(spark, d, "orders"), 7, ["o_orderstatus"], ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "chunk")


_CENTRED = """WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS n, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), c AS (SELECT *, n - (m + 1) // 2 AS d FROM n)"""


def _walk(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    orders = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    n = S.ranked(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "n")
    from pyspark.sql import Window

    n = n.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("o_custkey")))
    start = F.col("n") + 1 == F.floor((F.col("m") + 1) / 2)
    out = S.traversal(n, ["o_custkey"], ["o_orderdate", "o_orderkey"], start, strategy)
    return out.select("o_custkey", "o_orderkey", "step")


_STEP = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {key}) - 1 AS step FROM c"


@query(f"{_CENTRED} {_STEP.format(key='CASE WHEN d = 0 THEN 0 ELSE abs(d) * 2 - CASE WHEN d > 0 THEN 1 ELSE 0 END END')}")
def curlicue_order(spark: SparkSession, d: str) -> DataFrame:
    return _walk(spark, d, "curlicue_new")


@query(f"{_CENTRED} {_STEP.format(key='CASE WHEN d = 0 THEN 0 ELSE abs(d) * 2 - CASE WHEN d < 0 THEN 1 ELSE 0 END END')}")
def curlicue_old_order(spark: SparkSession, d: str) -> DataFrame:
    return _walk(spark, d, "curlicue_old")


@query(f"{_CENTRED} {_STEP.format(key='-d')} WHERE d <= 0")
def new_first_order(spark: SparkSession, d: str) -> DataFrame:
    return _walk(spark, d, "new_first")


@query(f"{_CENTRED} {_STEP.format(key='d')} WHERE d >= 0")
def old_first_order(spark: SparkSession, d: str) -> DataFrame:
    return _walk(spark, d, "old_first")


@query(
    """SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders
    WHERE o_orderdate >= TIMESTAMP '1995-01-01') WHERE n <= 3"""
)
def limited_commits(spark: SparkSession, d: str) -> DataFrame:
    recent = load(spark, d, "orders").filter("o_orderdate >= timestamp'1995-01-01'")
    out = S.first_n(recent, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3)
    return out.select("o_custkey", "o_orderkey")


@query("SELECT arg_min(user_id, (last_ts, user_id)) AS user_id FROM (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY 1)")
def lru_victim(spark: SparkSession, d: str) -> DataFrame:
    used = load(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    return S.least_recently_used(used, "user_id", "last_ts")
