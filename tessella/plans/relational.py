"""Joins, set operations and scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..functions import versions as V
from ..operators import metadata as M
from ..operators import sequences as S
from ..operators import snapshots as P
from ..sources.tables import load
from .registry import query

@query()
def adjacent_distance(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance, in code points, of the whole texts of all adjacent turns; null where a text is."""
    pairs = S.consecutive(load(spark, d, "conversations"), ["conv_id"], ["turn"], ["text"])
    distance = T.edit_distance(F.col("text"), F.col("next_text"))
    tanimoto = T.norm_distance(F.col("distance"), F.length("text"), F.length("next_text"))
    pairs = pairs.withColumn("distance", distance.cast("long"))
    return pairs.select("conv_id", "turn", "distance", F.round(tanimoto, 9).alias("tanimoto"))


_HALVES = """b AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
    a AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)"""
_KIND = """CASE WHEN b.o_custkey IS NULL THEN 'added' WHEN a.o_custkey IS NULL THEN 'dropped' WHEN a.n <> b.n THEN 'changed'
    WHEN a.price <> b.price THEN 'affected' ELSE 'unchanged' END"""


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = load(spark, d, "orders")

    def half(k: int) -> DataFrame:
        some = orders.filter(F.col("o_orderkey") % 2 == k)
        return some.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))

    return half(0), half(1)


@query(
    f"""WITH {_HALVES} SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, b.n AS before_n, b.price AS before_price, a.n AS after_n, a.price AS after_price,
    {_KIND} AS kind FROM b FULL JOIN a USING (o_custkey)"""
)
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    before, after = _halves(spark, d)
    return P.snapshot_diff(before, after, ["o_custkey"], "n", ["price"])


@query(f"WITH {_HALVES} SELECT kind, count(*) AS n FROM (SELECT {_KIND} AS kind FROM b FULL JOIN a USING (o_custkey)) GROUP BY kind")
def change_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_diff(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_HALVES} SELECT o_custkey, n, price FROM a")
def patch_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    before, after = _halves(spark, d)
    diff = P.snapshot_diff(before, after, ["o_custkey"], "n", ["price"])
    return P.apply_diff(before, diff, ["o_custkey"], ["n", "price"])


_WINDOWS = """e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS lo, floor(epoch(ts))::BIGINT + 1800 AS hi FROM events),
    w AS (SELECT DISTINCT user_id, floor(epoch(ts))::BIGINT // 86400 * 86400 AS w_lo, floor(epoch(ts))::BIGINT // 86400 * 86400 + 3600 AS w_hi FROM events)"""


def _windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = load(spark, d, "events").withColumn("lo", F.col("ts").cast("timestamp").cast("long"))
    e = events.select("user_id", "event_id", "lo", (F.col("lo") + 1800).alias("hi"))
    day = F.floor(F.col("lo") / 86400) * 86400
    return e, events.select("user_id", day.alias("w_lo"), (day + 3600).alias("w_hi")).distinct()


@query(f"WITH {_WINDOWS} SELECT user_id, event_id, lo, hi, w_lo, w_hi FROM e JOIN w USING (user_id) WHERE lo < w_hi AND w_lo < hi")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    e, w = _windows(spark, d)
    return P.range_join(e, w, ["user_id"], ("lo", "hi"), ("w_lo", "w_hi"), 3600)


@query(f"WITH {_WINDOWS} SELECT * FROM e WHERE EXISTS (FROM w WHERE w.user_id = e.user_id AND lo < w_hi AND w_lo < hi)")
def interval_semi_join(spark: SparkSession, d: str) -> DataFrame:
    e, w = _windows(spark, d)
    return P.range_join(e, w, ["user_id"], ("lo", "hi"), ("w_lo", "w_hi"), 3600, "semi")


@query(f"WITH {_WINDOWS} SELECT * FROM e WHERE NOT EXISTS (FROM w WHERE w.user_id = e.user_id AND lo < w_hi AND w_lo < hi)")
def interval_anti_join(spark: SparkSession, d: str) -> DataFrame:
    e, w = _windows(spark, d)
    return P.range_join(e, w, ["user_id"], ("lo", "hi"), ("w_lo", "w_hi"), 3600, "anti")


_SPANS = """s AS (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY ALL)"""


@query(
    f"""WITH {_SPANS} SELECT x.o_custkey, x.o_orderstatus, x.lo, x.hi, y.o_orderstatus AS in_status, y.lo AS in_lo, y.hi AS in_hi
    FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.lo <= y.lo AND x.hi >= y.hi"""
)
def containment_cover(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    inner = s.select("o_custkey", F.col("o_orderstatus").alias("in_status"), F.col("lo").alias("in_lo"), F.col("hi").alias("in_hi"))
    return P.covering(s, inner, ["o_custkey"], ("lo", "hi"), ("in_lo", "in_hi"))


@query(
    """WITH s AS (SELECT o_custkey, o_orderkey, o_orderkey % 50 AS cmd, o_orderkey * 10 AS beg, o_orderkey * 10 + 5 AS fin FROM orders),
    o AS (SELECT o_custkey, o_orderkey % 50 AS cmd, o_orderkey * 10 AS beg, o_orderkey * 10 + 5 AS fin, o_orderkey % 7 AS excess FROM orders WHERE o_orderpriority LIKE '1%')
    SELECT s.o_custkey, s.o_orderkey, coalesce(sum(o.excess), 0)::BIGINT AS shift FROM s LEFT JOIN o
    ON s.o_custkey = o.o_custkey AND s.cmd <> o.cmd AND o.fin <= s.beg GROUP BY ALL"""
)
def location_offsets(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders")
    k = F.col("o_orderkey")
    base = [F.col("o_custkey"), (k % 50).alias("cmd"), (k * 10).alias("beg"), (k * 10 + 5).alias("end")]
    spans = orders.select("o_orderkey", *base)
    offsets = orders.filter(F.col("o_orderpriority").startswith("1")).select(*base, (k % 7).alias("excess"))
    return P.shifted_by_offsets(spans, offsets, ["o_custkey"]).select("o_custkey", "o_orderkey", F.col("shift").cast("long").alias("shift"))


@query(
    """WITH l AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
    r1 AS (SELECT l_partkey, l_suppkey, max(l_discount) AS v FROM lineitem WHERE l_discount > 0.05 GROUP BY ALL),
    r2 AS (SELECT l_partkey, max(l_tax) AS v FROM lineitem WHERE l_tax > 0.04 GROUP BY ALL),
    r3 AS (SELECT max(l_tax) AS v FROM lineitem)
    SELECT l.l_partkey, l.l_suppkey, coalesce(r1.v, r2.v, r3.v) AS v,
    CASE WHEN r1.v IS NOT NULL THEN 12 WHEN r2.v IS NOT NULL THEN 4 ELSE 0 END AS v_level
    FROM l LEFT JOIN r1 USING (l_partkey, l_suppkey) LEFT JOIN r2 USING (l_partkey) CROSS JOIN r3"""
)
def fallback_lookup(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem")
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    none = F.lit(None).cast("string")
    name = F.lit("all").alias("project_name")

    def keyed(df: DataFrame, url, sha, v) -> DataFrame:
        key = [name, url.alias("project_url"), sha.alias("commit_sha")]
        return df.groupBy(*key).agg(F.max(v).alias("v")).withColumns({"coq_version": none, "ocaml_version": none})

    records = keyed(lines.filter("l_discount > 0.05"), part, supp, "l_discount")
    records = records.unionByName(keyed(lines.filter("l_tax > 0.04"), part, none, "l_tax"))
    records = records.unionByName(keyed(lines, none, none, "l_tax"))
    probes = lines.select(name, part.alias("project_url"), supp.alias("commit_sha"), none.alias("coq_version"), none.alias("ocaml_version"))
    found = M.fallback(probes, records, ["v"])
    return found.select(F.col("project_url").cast("long").alias("l_partkey"), F.col("commit_sha").cast("long").alias("l_suppkey"), "v", "v_level")


@query(
    """SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS n
    FROM customer JOIN supplier ON c_nationkey = s_nationkey) WHERE n = 1"""
)
def nearest_match(spark: SparkSession, d: str) -> DataFrame:
    left = load(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    right = load(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    return P.nearest(left, right, ["nation"], "c_acctbal", "s_acctbal", "s_suppkey").select("c_custkey", "s_suppkey")


def _bought(year: int) -> str:
    return f"""(SELECT l_partkey::VARCHAR AS package, max(l_quantity)::BIGINT::VARCHAR AS version FROM lineitem WHERE year(l_shipdate) = {year} GROUP BY 1)"""


@query(
    f"""SELECT package, b.version AS before_version, a.version AS after_version, CASE WHEN b.version IS NULL THEN 'new' WHEN a.version IS NULL THEN 'dropped'
    WHEN a.version <> b.version THEN 'updated' END AS kind FROM {_bought(1995)} b FULL JOIN {_bought(1996)} a USING (package)
    WHERE b.version IS NULL OR a.version IS NULL OR a.version <> b.version"""
)
def set_diff_env(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem")

    def bought(year: int) -> DataFrame:
        some = lines.filter(F.year("l_shipdate") == year).groupBy(F.col("l_partkey").cast("string").alias("package"))
        return some.agg(F.max("l_quantity").cast("long").cast("string").alias("version"))

    return P.package_diff(bought(1995), bought(1996), "package", "version")


@query(
    """WITH a AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey, upper(c_name) AS c_name FROM customer WHERE c_custkey % 2 = 0)
    SELECT * FROM a UNION ALL SELECT * FROM b WHERE c_custkey NOT IN (SELECT c_custkey FROM a)"""
)
def union_first_wins(spark: SparkSession, d: str) -> DataFrame:
    customers = load(spark, d, "customer")
    a = customers.filter("c_custkey % 3 <> 0").select("c_custkey", "c_name")
    b = customers.filter("c_custkey % 2 = 0").select("c_custkey", F.upper("c_name").alias("c_name"))
    return M.union_first([a, b], ["c_custkey"])


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def drop_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_custkey", "o_orderstatus").dropDuplicates()


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def requested_minus_found(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def membership(spark: SparkSession, d: str) -> DataFrame:
    some = load(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").select("c_custkey").join(some, "c_custkey", "left_semi")


@query(
    """SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0
    EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity < 1"""
)
def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem")
    some = lines.filter("l_returnflag = 'R'").select("l_suppkey")
    rich = load(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return some.intersect(rich).subtract(lines.filter("l_quantity < 1").select("l_suppkey"))


_PAIRS = """p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_name AS x, b.p_name AS y FROM part a JOIN part b
    ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey),
    q AS (SELECT a, b, levenshtein(x, y)::DOUBLE AS d, length(x)::DOUBLE AS m, length(y)::DOUBLE AS n FROM p)"""


def _part_pairs(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_name")
    left = part.select(F.col("p_partkey").alias("a"), "p_brand", "p_type", "p_size", F.col("p_name").alias("x"))
    right = part.select(F.col("p_partkey").alias("b"), "p_brand", "p_type", "p_size", F.col("p_name").alias("y"))
    return left.join(right, ["p_brand", "p_type", "p_size"]).filter("a < b").select("a", "b", "x", "y")


def _norm(spark: SparkSession, d: str, norm: str) -> DataFrame:
    return _part_pairs(spark, d).select("a", "b", F.round(T.norm_edit_distance(F.col("x"), F.col("y"), norm), 9).alias("distance"))


@query(f"WITH {_PAIRS} SELECT a, b, round(d / greatest(m, n), 9) AS distance FROM q")
def norm_edit_distance_max(spark: SparkSession, d: str) -> DataFrame:
    return _norm(spark, d, "max")


@query(f"WITH {_PAIRS} SELECT a, b, round(1 - (m + n - d) / (4 * sqrt(m * n)), 9) AS distance FROM q")
def norm_edit_distance_product(spark: SparkSession, d: str) -> DataFrame:
    return _norm(spark, d, "product")


@query(f"WITH {_PAIRS} SELECT a, b, round(2 * d / (m + n + d), 9) AS distance FROM q")
def norm_edit_distance_tanimoto(spark: SparkSession, d: str) -> DataFrame:
    return _norm(spark, d, "tanimoto")


@query(f"WITH {_PAIRS} SELECT a, b FROM q WHERE 2 * d / (m + n + d) < 0.4")
def thresholded_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _part_pairs(spark, d).filter(T.within(F.col("x"), F.col("y"), 0.4)).select("a", "b")


@query(
    r"""SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')) AS text FROM documents"""
)
def normalize_spaces(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", T.normalize_spaces(F.col("text")).alias("text"))


@query(
    """SELECT conv_id, turn, CASE WHEN regexp_matches(text, '["\\\\]') THEN '"' || regexp_replace(text, '(["\\\\])', '\\\\\\1', 'g') || '"' ELSE text END AS quoted FROM conversations"""
)
def quote_escape(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").select("conv_id", "turn", T.quote_escape(F.col("text")).alias("quoted"))


@query(
    """SELECT p_partkey, p_brand || '-' || p_size || '-' || p_partkey || '.git.json' AS file_name FROM part"""
)
def file_names(spark: SparkSession, d: str) -> DataFrame:
    name = T.record_file_name(F.col("p_brand"), F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))
    return load(spark, d, "part").select("p_partkey", name.alias("file_name"))


@query(
    """WITH n AS (SELECT p_partkey, lower(replace(p_type, ' ', '-')) AS s FROM part)
    SELECT p_partkey, s AS name, replace(s, '-', '_') AS snake, replace(s, '-', '') AS plain FROM n"""
)
def name_forms(spark: SparkSession, d: str) -> DataFrame:
    s = F.lower(F.replace(F.col("p_type"), F.lit(" "), F.lit("-")))
    named = load(spark, d, "part").select("p_partkey", s.alias("name"))
    v = T.name_variants(F.col("name"))
    snake, plain = F.translate("name", "-", "_"), F.regexp_replace("name", "-", "")
    return named.filter(F.array_contains(v, snake) & F.array_contains(v, plain)).select("p_partkey", "name", snake.alias("snake"), plain.alias("plain"))


@query("SELECT p_partkey, string_split(p_type, ' ')[-1] AS stem, len(string_split(p_type, ' ')) - 1 AS n_parents FROM part")
def logical_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.replace(F.col("p_type"), F.lit(" "), F.lit("."))
    return load(spark, d, "part").select(
        "p_partkey", T.logical_stem(name).alias("stem"), F.size(T.logical_parents(name)).cast("long").alias("n_parents")
    )


_VERSIONS = """(SELECT DISTINCT (p_size % 3) || '.' || (p_partkey % 25) || '.' || (p_size % 4) AS v, p_size % 3 AS x, p_partkey % 25 AS y, p_size % 4 AS z FROM part)"""


def _versions(spark: SparkSession, d: str) -> DataFrame:
    v = F.concat_ws(".", *[c.cast("string") for c in (F.col("p_size") % 3, F.col("p_partkey") % 25, F.col("p_size") % 4)])
    return load(spark, d, "part").select(v.alias("v")).distinct()


@query(f"SELECT v, row_number() OVER (ORDER BY x, y, z) AS place FROM {_VERSIONS}")
def version_key_sort(spark: SparkSession, d: str) -> DataFrame:
    keyed = _versions(spark, d).withColumn("key", V.version_key(F.col("v")))
    return S.numbered(keyed, ["key"], "place", start=1).drop("key")


@query(f"SELECT x::VARCHAR AS major, arg_max(v, (y, z)) AS v FROM {_VERSIONS} GROUP BY x")
def max_version_opam(spark: SparkSession, d: str) -> DataFrame:
    major = F.substring_index("v", ".", 1).alias("major")
    return _versions(spark, d).groupBy(major).agg(V.max_version(F.col("v"), "opam").alias("v"))


@query(f"SELECT v FROM {_VERSIONS} WHERE x * 1000000 + y * 1000 + z >= 1010000 AND x * 1000000 + y * 1000 + z < 1011000")
def version_interval(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d).filter(V.same_minor(F.col("v"), "1.10"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    """SELECT user_id, event_id, coalesce(props->>'$.diff', props->>'$.repair.diff', props->>'$.k') AS diff FROM events"""
)
def json_fallback(spark: SparkSession, d: str) -> DataFrame:
    paths = [F.get_json_object("props", p) for p in ("$.diff", "$.repair.diff", "$.k")]
    return load(spark, d, "events").select("user_id", "event_id", F.coalesce(*paths).alias("diff"))


@query(
    r"""SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')) AS token FROM documents) GROUP BY token"""
)
def explode_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = load(spark, d, "documents").select("doc_id", F.explode(F.split(T.normalize_spaces(F.col("text")), " ")).alias("token"))
    return tokens.filter("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(
    """SELECT o_custkey, string_agg(o_orderstatus || ' ' || (o_orderkey % 100), ' ' ORDER BY o_orderstatus, o_orderkey % 100, o_orderkey) AS selection FROM orders GROUP BY 1"""
)
def selection_string(spark: SparkSession, d: str) -> DataFrame:
    pair = F.struct(F.col("o_orderstatus").alias("file"), (F.col("o_orderkey") % 100).alias("idx"))
    return load(spark, d, "orders").groupBy("o_custkey").agg(T.selection_string(F.collect_list(pair)).alias("selection"))


@query(
    """SELECT x.o_custkey, x.o_orderkey, list_sort([k FOR k IN list(y.o_orderkey) IF k <> x.o_orderkey]) AS others
    FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey GROUP BY x.o_custkey, x.o_orderkey"""
)
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return P.leave_one_out(load(spark, d, "orders"), ["o_custkey"], "o_orderkey")


@query(
    """SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE list_has_any([lang, source, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END], ['de', 'src3', 'toxic'])"""
)
def tag_any_match(spark: SparkSession, d: str) -> DataFrame:
    both = load(spark, d, "documents").select("doc_id", "lang", "source").join(load(spark, d, "labels"), "doc_id")
    tags = F.array("lang", "source", F.when(F.col("toxic") == 1, "toxic").otherwise("clean"))
    return both.filter(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in ("de", "src3", "toxic")]))).select("doc_id")


@query(
    """SELECT doc_id, ['error:' || lang, 'repair:' || CASE WHEN quality = 1 THEN 'specification' ELSE 'proof' END] AS tags FROM documents JOIN labels USING (doc_id)"""
)
def repair_tags(spark: SparkSession, d: str) -> DataFrame:
    both = load(spark, d, "documents").select("doc_id", "lang").join(load(spark, d, "labels"), "doc_id")
    good = F.col("quality") == 1
    return both.select("doc_id", P.repair_tags(good, ~good, F.array("lang")).alias("tags"))


@query(
    """SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS statuses FROM orders GROUP BY 1"""
)
def collected_sets(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("statuses"))


@query("SELECT p_partkey, p_size FROM part WHERE (p_size >= 10 AND p_size < 20 AND p_size <> 15) OR p_size = 42")
def formula_filter(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.formulas import parse_version_formula

    formula = parse_version_formula('>= "10" & < "20" & != "15" | = "42"')
    part = load(spark, d, "part").select("p_partkey", "p_size")
    return part.filter(formula.column(F.col("p_size").cast("string")))


@query(
    f"""SELECT v, count(*) AS n FROM (SELECT v, x, y FROM {_VERSIONS}) JOIN (VALUES (0, 5), (1, 10), (2, 0)) f(a, b) ON (x, y) >= (a, b) GROUP BY v"""
)
def version_popularity(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.formulas import popularity

    return popularity(_versions(spark, d), "v", ['>= "0.5"', '>= "1.10"', '>= "2.0"'])


@query(
    """WITH l AS (SELECT p_partkey, string_split(p_name, ' ') AS l FROM part)
    SELECT p_partkey, list_aggregate(list_transform(range(1, len(l) + 1), lambda n: list_aggregate(list_slice(l, len(l) - n + 1, len(l)), 'string_agg', '.')),
      'string_agg', ' ') AS names FROM l"""
)
def interpolated_names(spark: SparkSession, d: str) -> DataFrame:
    """Part names as dotted identifiers, from the last part alone to the whole name."""
    full = F.replace("p_name", F.lit(" "), F.lit("."))
    found = N.interpolated(F.element_at(F.split("p_name", " "), -1), full)
    return load(spark, d, "part").select("p_partkey", F.concat_ws(" ", found).alias("names"))
