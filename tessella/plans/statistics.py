"""Corpus statistics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..sources.tables import load
from .registry import query


@query(
    """SELECT c.s AS o_orderstatus, count(o_orderkey) AS n
    FROM (VALUES ('F'), ('O'), ('P'), ('X')) c(s) LEFT JOIN orders ON o_orderstatus = c.s GROUP BY c.s"""
)
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    classes = spark.sql("SELECT * FROM VALUES ('F'), ('O'), ('P'), ('X') AS c(o_orderstatus)")
    return A.status_counts(load(spark, d, "orders"), "o_orderstatus", classes)


@query("SELECT o_orderstatus || ': ' || count(*) AS message FROM orders GROUP BY o_orderstatus")
def status_message(spark: SparkSession, d: str) -> DataFrame:
    counts = load(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return A.status_message(counts, "o_orderstatus")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def status_success_only(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'")
def status_failed_only(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").filter("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey")


@query("SELECT p_type, p_size, max(p_brand) AS p_brand FROM part GROUP BY ALL")
def max_version_lexical(spark: SparkSession, d: str) -> DataFrame:
    return A.max_versions(load(spark, d, "part"), ["p_type", "p_size"], "p_brand")


@query(
    """SELECT user_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id"""
)
def latest_status(spark: SparkSession, d: str) -> DataFrame:
    return A.latest(load(spark, d, "events"), ["user_id"], "event_type", "ts", F.col("event_id"))


@query(
    """WITH e AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'cache' WHEN 'view' THEN 'build' WHEN 'signup' THEN 'success' ELSE 'misc' END AS kind,
      date_trunc('hour', ts) AS ts FROM events),
    r AS (SELECT user_id, kind, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CASE kind WHEN 'cache' THEN 0 WHEN 'build' THEN 1 ELSE 2 END) AS n,
      max(CASE WHEN kind = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS ok FROM e)
    SELECT user_id, CASE WHEN ok = 1 THEN 'success' ELSE kind END AS status FROM r WHERE n = 1"""
)
def latest_error_or_success(spark: SparkSession, d: str) -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "purchase", "cache")
        .when(F.col("event_type") == "view", "build")
        .when(F.col("event_type") == "signup", "success")
        .otherwise("misc")
    )
    events = load(spark, d, "events").select("user_id", kind.alias("kind"), F.date_trunc("hour", "ts").alias("ts"))
    return A.latest_status(events, ["user_id"], "kind", "ts", "success")


@query(
    """SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT l_partkey) AS n_parts,
    count(DISTINCT (l_orderkey, l_linenumber)) AS n_lines FROM lineitem"""
)
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.distinct_counts(
        load(spark, d, "lineitem"), n_orders=["l_orderkey"], n_parts=["l_partkey"], n_lines=["l_orderkey", "l_linenumber"]
    )


@query("SELECT max(l_quantity + l_linenumber) AS most FROM lineitem")
def max_of_derived(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").agg(F.max(F.col("l_quantity") + F.col("l_linenumber")).alias("most"))


_DESCRIBE = """count(n) AS "count", round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS "min",
    quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, max(n) AS "max" """


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(
    f"""WITH u AS (SELECT c_mktsegment, o_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    SELECT c_mktsegment, {_DESCRIBE} FROM u GROUP BY c_mktsegment"""
)
def describe_by_group(spark: SparkSession, d: str) -> DataFrame:
    both = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return _rounded(A.describe_counts(both, ["c_mktsegment"], ["o_custkey"]))


@query(
    f"""WITH u AS (SELECT o_orderpriority, l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT o_orderpriority, {_DESCRIBE} FROM u GROUP BY o_orderpriority"""
)
def describe_distinct(spark: SparkSession, d: str) -> DataFrame:
    both = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return _rounded(A.describe_counts(both, ["o_orderpriority"], ["l_orderkey"], ["l_suppkey"]))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def type_frequency(spark: SparkSession, d: str) -> DataFrame:
    return A.frequency(load(spark, d, "events"), ["event_type"])


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 15")
def type_frequency_topk(spark: SparkSession, d: str) -> DataFrame:
    return A.frequency(load(spark, d, "part"), ["p_type"], top=15)


@query("SELECT p_brand, p_type, count(*) AS n FROM part WHERE p_size > 10 GROUP BY ALL")
def type_frequency_by_project(spark: SparkSession, d: str) -> DataFrame:
    return A.frequency(load(spark, d, "part").filter("p_size > 10"), ["p_brand", "p_type"])


@query("SELECT l_quantity AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS proportion FROM lineitem GROUP BY l_quantity")
def histogram_prop(spark: SparkSession, d: str) -> DataFrame:
    return A.histogram(load(spark, d, "lineitem"), "l_quantity").withColumn("proportion", F.round("proportion", 9))


@query(
    """SELECT floor(l_quantity / 10)::BIGINT AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS proportion
    FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 200 GROUP BY 1"""
)
def histogram_bins(spark: SparkSession, d: str) -> DataFrame:
    return A.histogram(load(spark, d, "lineitem"), "l_quantity", 10, 0, 200).withColumn("proportion", F.round("proportion", 9))


@query(
    """WITH c AS (SELECT c_nationkey, c_custkey, count(DISTINCT o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
    m AS (SELECT c_nationkey, max(n) AS n FROM c GROUP BY 1) SELECT sum(n)::BIGINT AS total FROM m"""
)
def sum_of_max(spark: SparkSession, d: str) -> DataFrame:
    both = load(spark, d, "customer").join(load(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    return A.sum_of_max(both, ["c_nationkey"], ["c_custkey"], ["o_orderkey"])


def _regional(spark: SparkSession, d: str) -> DataFrame:
    both = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    both = both.join(F.broadcast(load(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.join(F.broadcast(load(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))


_REGIONAL = """orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


@query(
    f"""SELECT r_name, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM {_REGIONAL} GROUP BY r_name"""
)
def percent_of_total(spark: SparkSession, d: str) -> DataFrame:
    counts = _regional(spark, d).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))
    return A.share(counts, "n").withColumn("percent", F.round("percent", 6))


@query(
    f"""SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM {_REGIONAL} GROUP BY ROLLUP (r_name, n_name)"""
)
def rollup_totals(spark: SparkSession, d: str) -> DataFrame:
    out = A.totals(_regional(spark, d), ["r_name", "n_name"], n=F.count(F.lit(1)), price=F.sum("o_totalprice"))
    return out.withColumn("price", F.round("price", 2))


@query(
    """SELECT r_name, c_mktsegment, count(*) AS n FROM %s GROUP BY CUBE (r_name, c_mktsegment)""" % _REGIONAL
)
def cube_totals(spark: SparkSession, d: str) -> DataFrame:
    return _regional(spark, d).cube("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT p_brand, count(*) AS n, sum(p_size)::BIGINT AS sizes FROM part GROUP BY p_brand"""
)
def per_version_report(spark: SparkSession, d: str) -> DataFrame:
    return A.per_version(load(spark, d, "part"), "p_brand", sizes=F.sum("p_size"))


@query(
    r"""SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')) AS n_tokens, length(text) AS n_length FROM documents"""
)
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return docs.select("doc_id", T.token_count(F.col("text")).alias("n_tokens"), F.length("text").alias("n_length"))


@query(
    rf"""WITH u AS (SELECT source, lang, len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')) AS n FROM documents)
    SELECT source, lang, {_DESCRIBE} FROM u GROUP BY source, lang"""
)
def sentence_facts(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("source", "lang", T.token_count(F.col("text")).alias("n"))
    return _rounded(A.describe(docs, ["source", "lang"], "n"))


@query(
    """SELECT pat AS label, count(DISTINCT doc_id) AS n FROM documents, (VALUES ('license'), ('token'), ('email'), ('password')) p(pat)
    WHERE regexp_matches(lower(text), pat) GROUP BY pat"""
)
def error_grep(spark: SparkSession, d: str) -> DataFrame:
    patterns = spark.sql("SELECT * FROM VALUES ('license'), ('token'), ('email'), ('password') AS p(label)")
    docs = load(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    hits = docs.withColumn("label", F.explode(F.array(*[F.lit(r["label"]) for r in patterns.collect()])))
    return hits.filter(F.expr("text RLIKE label")).groupBy("label").agg(F.countDistinct("doc_id").alias("n"))


@query("SELECT source, sum(octet_length(encode(text))) ::BIGINT AS bytes FROM documents GROUP BY source")
def size_weights(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@query(
    """SELECT o_custkey, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date, count(*) AS n FROM orders GROUP BY 1"""
)
def union_spans(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"), F.count(F.lit(1)).alias("n")
    )
