"""Queries that need more than relational operators: alignments, parsers, graphs, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formulas, grammar, hunks, options, sexp, spans
from ..operators import alignment, graphs, metadata, projects, records, repairs, sampling, sequences
from ..operators import goals as goal_states
from ..operators import snapshots as P
from ..sources.tables import load
from .registry import query

@query()
def lineitem_components(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and parts connected by any row of lineitem."""
    name = [F.concat(F.lit(k), F.col(c).cast("string")).alias(n) for k, c, n in (("s", "l_suppkey", "src"), ("p", "l_partkey", "dst"))]
    return graphs.connected(load(spark, d, "lineitem").select(*name).distinct())


_TREE = """e AS (SELECT DISTINCT r_name AS src, n_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION SELECT DISTINCT n_name, 'supplier ' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def _tree(spark: SparkSession, d: str) -> DataFrame:
    nation = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = load(spark, d, "supplier").join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string"))
    top = nation.select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"))
    return top.union(supplier.select(F.col("n_name"), name)).distinct()


@query(
    f"""WITH RECURSIVE {_TREE}, r AS (SELECT src AS node, 0 AS level FROM e WHERE src NOT IN (SELECT dst FROM e)
    UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.node) SELECT node, max(level)::INTEGER AS level FROM r GROUP BY node"""
)
def toposort_levels(spark: SparkSession, d: str) -> DataFrame:
    return graphs.levels(_tree(spark, d))


@query(
    f"""WITH RECURSIVE {_TREE}, r AS (SELECT src AS node, 0 AS level FROM e WHERE src NOT IN (SELECT dst FROM e)
    UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.node), m AS (SELECT node, max(level)::INTEGER AS level FROM r GROUP BY node)
    SELECT node, level, row_number() OVER (ORDER BY level, node) - 1 AS place FROM m"""
)
def toposort(spark: SparkSession, d: str) -> DataFrame:
    return graphs.topological(_tree(spark, d))


@query("SELECT 'x' AS src, 'x' AS dst, 0::BIGINT AS src_place, 0::BIGINT AS dst_place WHERE false")
def toposort_violations(spark: SparkSession, d: str) -> DataFrame:
    edges = _tree(spark, d)
    return graphs.order_violations(graphs.topological(edges), edges)


@query(
    f"""WITH RECURSIVE {_TREE}, r AS (SELECT r_name AS root, r_name AS node FROM region UNION SELECT r.root, e.dst FROM r JOIN e ON e.src = r.node)
    SELECT root, node FROM r"""
)
def reachable_nodes(spark: SparkSession, d: str) -> DataFrame:
    roots = load(spark, d, "region").select(F.col("r_name").alias("node"))
    return graphs.reachable(spark, _tree(spark, d), roots)


@query(f"WITH {_TREE} SELECT DISTINCT dst AS node, src AS other FROM e")
def parents(spark: SparkSession, d: str) -> DataFrame:
    edges = _tree(spark, d)
    return graphs.neighbours(edges, edges.select(F.col("dst").alias("node")).distinct(), reverse=True)


@query(
    """WITH u AS (SELECT DISTINCT o_custkey % 20 AS project, o_orderkey % 60 AS name FROM orders), o AS (SELECT DISTINCT o_custkey % 20 AS project, o_orderkey % 60 AS name FROM orders WHERE o_orderstatus = 'P')
    SELECT u.project, u.name, CASE WHEN NOT EXISTS (FROM o WHERE o.name = u.name) THEN 'unknown' WHEN EXISTS (FROM o WHERE o.name = u.name AND o.project = u.project) THEN 'local' ELSE 'cross' END AS kind FROM u"""
)
def dependency_split(spark: SparkSession, d: str) -> DataFrame:
    keyed = load(spark, d, "orders").select((F.col("o_custkey") % 20).alias("project"), (F.col("o_orderkey") % 60).alias("name"), "o_orderstatus")
    return graphs.dependency_split(keyed.select("project", "name").distinct(), keyed.filter("o_orderstatus = 'P'").select("project", "name").distinct())


@query(
    """SELECT DISTINCT p_type AS library, m.package FROM part JOIN (VALUES ('SMALL', 'small'), ('PROMO', 'promo'), ('STANDARD', 'standard'), ('S', 's')) m(logical, package)
    ON starts_with(p_type, m.logical)"""
)
def guess_packages(spark: SparkSession, d: str) -> DataFrame:
    mappings = spark.sql("SELECT * FROM VALUES ('SMALL', 'small'), ('PROMO', 'promo'), ('STANDARD', 'standard'), ('S', 's') AS m(logical, package)")
    return graphs.guess_packages(load(spark, d, "part").select(F.col("p_type").alias("library")).distinct(), mappings)


_FILES = """f AS (SELECT DISTINCT p_brand AS project, replace(p_type, ' ', '/') || '/part' || p_partkey || '.v' AS path FROM part),
    u AS (SELECT project, string_split(path, '/') AS parts, unnest(range(1, len(parts) + 1)) AS n FROM f),
    l AS (SELECT DISTINCT project, array_to_string(parts[:n], '/') AS path, replace(regexp_replace(path, '[.]v$', ''), '/', '.') AS library FROM u),
    a AS (SELECT project, CASE WHEN starts_with(library, 'PROMO.') THEN 'Sale' || substr(library, 6) ELSE 'Sale' END AS alias, library FROM l WHERE library = 'PROMO' OR starts_with(library, 'PROMO.')
    UNION SELECT project, 'All.' || library, library FROM l)"""


def _project_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as files of their brand, in folders by type, and two load paths for each."""
    path = F.concat(F.replace(F.col("p_type"), F.lit(" "), F.lit("/")), F.lit("/part"), F.col("p_partkey").cast("string"), F.lit(".v"))
    files = load(spark, d, "part").select(F.col("p_brand").alias("project"), path.alias("path"))
    paths = spark.sql("SELECT * FROM VALUES ('PROMO', 'Sale'), ('.', 'All') AS m(folder, name)")
    return files, files.select("project").distinct().join(F.broadcast(paths), F.lit(True))


@query(
    f"""WITH {_FILES} SELECT DISTINCT project, array_to_string(parts[:n - 1], '/') AS src, array_to_string(parts[:n], '/') AS dst, 'ParentToChild' AS type FROM u"""
)
def project_files(spark: SparkSession, d: str) -> DataFrame:
    return projects.add_files(_project_files(spark, d)[0])


@query(f"WITH {_FILES} SELECT project, alias, library FROM a")
def project_aliases(spark: SparkSession, d: str) -> DataFrame:
    files, paths = _project_files(spark, d)
    return projects.add_aliases(projects.libraries(files), paths)


@query(
    f"""WITH {_FILES}, r AS (SELECT DISTINCT p_brand AS project, 'size' || p_size AS library, 'Sale.' || replace(p_type, ' ', '.') AS requirement FROM part),
    s AS (SELECT DISTINCT project, requirement, string_split(requirement, '.') AS parts, unnest(range(1, len(parts) + 1)) AS n FROM r),
    k AS (SELECT library AS known, project, library FROM l UNION SELECT alias, project, library FROM a)
    SELECT project, requirement AS src, library AS dst, 'DependencyToRequirement' AS type FROM r
    UNION SELECT s.project, s.requirement, k.project || ':' || k.library, 'DependencyToLibrary' FROM s JOIN k ON k.known = array_to_string(s.parts[s.n:], '.')"""
)
def project_dependencies(spark: SparkSession, d: str) -> DataFrame:
    files, paths = _project_files(spark, d)
    found = projects.libraries(files)
    text = F.concat(F.lit("From Sale Require Import "), F.replace(F.col("p_type"), F.lit(" "), F.lit(".")), F.lit("."))
    sentences = load(spark, d, "part").select(F.col("p_brand").alias("project"), F.concat(F.lit("size"), F.col("p_size").cast("string")).alias("library"), text.alias("text"))
    return projects.add_dependencies(projects.add_requirements(sentences), found, projects.add_aliases(found, paths))


def _conversation_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A conversation's turns, and a later revision: some turns gone, the others shorter."""
    turns = load(spark, d, "conversations").select("conv_id", "turn", "text")
    after = turns.filter("(conv_id + turn) % 5 <> 0").select("conv_id", "turn", F.left("text", F.length("text") - 6).alias("text"))
    return turns, after


@query()
def assign_min_cost(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation assigned to those of its revision."""
    return alignment.align_by_assignment(*_conversation_pairs(spark, d), ["conv_id"], "turn", "text")


@query()
def nw_align(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation aligned in order with those of its revision."""
    return alignment.align_by_order(*_conversation_pairs(spark, d), ["conv_id"], "turn", "text")


@query()
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return grammar.sentences_of(load(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "idx", "sentence", "start", "end", "kind")


@query()
def diff_hunks(spark: SparkSession, d: str) -> DataFrame:
    """Hunks between adjacent turns."""

    @F.udf("string")
    def diffed(a: str, b: str) -> str:
        return hunks.unified(a or "", b or "", "turn")

    pairs = sequences.consecutive(load(spark, d, "conversations"), ["conv_id"], ["turn"], ["text"])
    diffs = pairs.select("conv_id", "turn", diffed("text", "next_text").alias("diff"))
    return hunks.hunks_of(diffs, "diff").drop("diff")


@query(
    """SELECT event_id, 2::BIGINT AS height, 5::BIGINT AS nodes, 3::BIGINT AS leaves, NULL::VARCHAR AS error FROM events"""
)
def sexp_metrics(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("("), F.col("event_type"), F.lit(" ("), F.get_json_object("props", "$.k"), F.lit(" x))"))
    found = load(spark, d, "events").select("event_id", sexp.sexp_metrics(text).alias("m"))
    return found.select("event_id", "m.*")


@query("SELECT event_id, 2::BIGINT AS height FROM events")
def sexp_height(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("("), F.col("event_type"), F.lit(" ("), F.get_json_object("props", "$.k"), F.lit(" x))"))
    return load(spark, d, "events").select("event_id", sexp.paren_height(text).cast("long").alias("height"))


@query(
    r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=')) AS links FROM pages"""
)
def html_facts(spark: SparkSession, d: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return load(spark, d, "pages").select(
        "page_id", title.alias("title"), F.size(F.regexp_extract_all("html", F.lit("<a href="), F.lit(0))).cast("long").alias("links")
    )


_PACKAGES = """(SELECT user_id, max(CASE event_type WHEN 'view' THEN (props->>'$.k')::INT END) AS a, max(CASE event_type WHEN 'click' THEN (props->>'$.k')::INT END) AS b FROM events GROUP BY user_id)"""


@query(f"SELECT user_id FROM {_PACKAGES} WHERE (a >= 50 AND a < 90) OR b >= 95")
def package_formula(spark: SparkSession, d: str) -> DataFrame:
    """Users whose packages (kinds of events, with the greatest k as version) satisfy a formula."""
    formula = formulas.parse_package_formula('"view" {>= "50" & < "90"} | "click" {>= "95"} | "error" {with-test}& "never"')
    k = F.get_json_object("props", "$.k").cast("int")
    newest = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(k).cast("string").alias("v"))
    entries = F.map_from_entries(F.collect_list(F.struct("event_type", "v")))
    installed = newest.groupBy("user_id").agg(entries.alias("packages"))
    return installed.filter(formula.column(F.col("packages"), {})).select("user_id")


_RECORD = """r AS (SELECT DISTINCT 'p' || (l_suppkey % 5) AS project_name, 'i' || (l_partkey % 7) AS initial_commit_sha, 'r' || (l_linenumber % 4) AS repaired_commit_sha,
    '8.10.2' AS initial_coq_version, '8.11.2' AS repaired_coq_version, 'a ' || (l_orderkey % 3) AS added_commands, 'b' AS affected_commands, 'c' AS changed_commands, 'd' AS dropped_commands FROM lineitem)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    def tag(prefix: str, column: str, n: int):
        return F.concat(F.lit(prefix), (F.col(column) % n).cast("string"))

    return load(spark, d, "lineitem").select(
        tag("p", "l_suppkey", 5).alias("project_name"),
        tag("i", "l_partkey", 7).alias("initial_commit_sha"),
        tag("r", "l_linenumber", 4).alias("repaired_commit_sha"),
        F.lit("8.10.2").alias("initial_coq_version"),
        F.lit("8.11.2").alias("repaired_coq_version"),
        tag("a ", "l_orderkey", 3).alias("added_commands"),
        F.lit("b").alias("affected_commands"),
        F.lit("c").alias("changed_commands"),
        F.lit("d").alias("dropped_commands"),
    )


@query(
    f"""WITH {_RECORD} SELECT row_number() OVER (ORDER BY project_name, initial_commit_sha, repaired_commit_sha, added_commands) AS id, *,
    project_name || '-' || initial_commit_sha || '-' || repaired_commit_sha || '-8_10_2-8_11_2-' ||
    (row_number() OVER (PARTITION BY project_name, initial_commit_sha, repaired_commit_sha ORDER BY added_commands) - 1) || '.json' AS file_name FROM r"""
)
def record_index(spark: SparkSession, d: str) -> DataFrame:
    empty = spark.createDataFrame([], records.SCHEMA)
    return records.insert(empty, _records(spark, d))


@query(
    f"""WITH {_RECORD} SELECT project_name, initial_commit_sha, repaired_commit_sha, count(*) AS n FROM r GROUP BY ALL"""
)
def record_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping indexes merged: each natural key once."""
    rows = _records(spark, d)
    empty = spark.createDataFrame([], records.SCHEMA)
    a = records.insert(empty, rows.filter("project_name <> 'p0'"))
    b = records.insert(empty, rows.filter("project_name <> 'p1'"))
    return records.merge([a, b]).groupBy(*records.PAIR[:3]).agg(F.count(F.lit(1)).alias("n"))


@query()
def weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.weighted_sample(load(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", F.col("n_chars"), 100, seed=2)


@query()
def group_split(spark: SparkSession, d: str) -> DataFrame:
    sizes = load(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars"))
    return sampling.split(sizes, "source", "chars", {"train": 0.8, "validation": 0.1, "test": 0.1})


@query()
def random_adjacent_pair(spark: SparkSession, d: str) -> DataFrame:
    return sampling.random_pair(load(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "turn", seed=3)


@query(
    """WITH s AS (SELECT o_custkey AS f, o_orderkey * 10 AS lo, o_orderkey * 10 + (o_orderkey % 13) AS hi FROM orders)
    SELECT f, min(lo) AS lo, max(hi) AS hi, count(*) AS n, sum(hi - lo)::BIGINT AS chars FROM s GROUP BY f"""
)
def span_unions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    zero = F.lit(0)
    span = F.struct(
        F.col("o_custkey").cast("string").alias("filename"), zero.alias("lineno"), zero.alias("bol_pos"), zero.alias("lineno_last"),
        zero.alias("bol_pos_last"), (k * 10).alias("beg_charno"), (k * 10 + k % 13).alias("end_charno"),
    )
    rows = load(spark, d, "orders").select(F.col("o_custkey").alias("f"), span.alias("s"))
    found = rows.groupBy("f").agg(spans.union_span(F.col("s")).alias("u"), F.count(F.lit(1)).alias("n"), F.sum(spans.num_chars(F.col("s"))).alias("chars"))
    return found.select("f", F.col("u.beg_charno").alias("lo"), F.col("u.end_charno").alias("hi"), "n", "chars")


@query(
    """WITH m AS (SELECT user_id, event_type AS f, max(value) AS before FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
    n AS (SELECT user_id, event_type AS f, max(value) AS after FROM events WHERE event_id % 2 = 1 GROUP BY ALL),
    u AS (SELECT user_id FROM m INTERSECT SELECT user_id FROM n)
    SELECT user_id, coalesce(m.f, n.f) AS flag, before, after FROM m FULL JOIN n USING (user_id, f) WHERE user_id IN (FROM u) AND before IS DISTINCT FROM after"""
)
def flag_diff(spark: SparkSession, d: str) -> DataFrame:
    def flags(k: int) -> DataFrame:
        some = load(spark, d, "events").filter(F.col("event_id") % 2 == k).groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
        return some.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias(f"m{k}"))

    both = flags(0).join(flags(1), "user_id")
    changes = both.select("user_id", F.explode(P.map_diff(F.col("m0"), F.col("m1"))).alias("flag", "x"))
    return changes.select("user_id", "flag", "x.before", "x.after")


@query(
    """WITH m AS (SELECT c_nationkey AS k, max(c_acctbal) AS v FROM customer GROUP BY 1)
    SELECT k::VARCHAR AS project_name, v FROM m WHERE k % 2 = 0 UNION ALL SELECT k::VARCHAR, -1.0 FROM m WHERE k % 2 = 1"""
)
def metadata_update(spark: SparkSession, d: str) -> DataFrame:
    """Records of the metadata store, some of which are updated."""
    none = F.lit(None).cast("string")
    key = {k: none for k in metadata.KEY[1:]}
    base = load(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("project_name")).agg(F.max("c_acctbal").alias("v"))
    store = base.withColumns(key).select(*metadata.KEY, "v")
    changes = store.filter("cast(project_name as int) % 2 = 1").withColumn("v", F.lit(-1.0))
    return metadata.update(store, changes, ["v"]).select("project_name", "v")


_COMMANDS = """WITH b AS (SELECT o_custkey AS pair, o_orderpriority AS file, o_orderkey % 13 AS idx, min(o_orderstatus) AS text, min(o_totalprice)::VARCHAR AS proof FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL),
    a AS (SELECT o_custkey AS pair, o_orderpriority AS file, o_orderkey % 13 AS idx, min(o_orderstatus) AS text, min(o_totalprice)::VARCHAR AS proof FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL),
    d AS (SELECT pair, file, idx, CASE WHEN b.text IS NULL THEN 'added' WHEN a.text IS NULL THEN 'dropped' WHEN a.text <> b.text THEN 'changed' WHEN a.proof <> b.proof THEN 'affected' ELSE 'unchanged' END AS kind,
      b.text AS before_text, a.text AS after_text FROM b FULL JOIN a USING (pair, file, idx))"""


def _commands(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = load(spark, d, "orders")

    def side(k: int) -> DataFrame:
        some = orders.filter(F.col("o_orderkey") % 2 == k)
        key = [F.col("o_custkey").alias("pair"), F.col("o_orderpriority").alias("file"), (F.col("o_orderkey") % 13).alias("idx")]
        return some.groupBy(*key).agg(F.min("o_orderstatus").alias("text"), F.min("o_totalprice").cast("string").alias("proof"))

    return side(0), side(1)


@query(
    f"""{_COMMANDS} SELECT pair, count(*) FILTER (kind = 'added') AS n_added, count(*) FILTER (kind = 'changed') - 1 AS n_changed, count(*) FILTER (kind = 'dropped') AS n_dropped,
    count(*) FILTER (kind = 'changed') AS n_sets FROM d GROUP BY pair HAVING count(*) FILTER (kind = 'changed') > 0"""
)
def changesets(spark: SparkSession, d: str) -> DataFrame:
    sets = repairs.changesets(repairs.changes(*_commands(spark, d)))
    sizes = [F.max(F.size(k)).cast("long").alias(f"n_{k}") for k in ("added", "changed", "dropped")]
    return sets.groupBy("pair").agg(*sizes, F.count(F.lit(1)).alias("n_sets"))


@query(
    f"""{_COMMANDS}, s AS (SELECT pair, file AS b_file, idx AS b_idx, before_text AS old FROM d WHERE kind = 'changed')
    SELECT s.pair, s.b_file, s.b_idx, d.file, d.idx, CASE WHEN d.file = s.b_file AND d.idx = s.b_idx THEN s.old ELSE d.after_text END AS text,
    d.file = s.b_file AND d.idx = s.b_idx AS broken FROM s JOIN d ON d.pair = s.pair WHERE d.kind <> 'dropped'"""
)
def broken_states(spark: SparkSession, d: str) -> DataFrame:
    before, after = _commands(spark, d)
    diff = repairs.changes(before, after)
    return repairs.broken_states(before, diff, repairs.changesets(diff)).drop("proof")


@query(
    f"""{_COMMANDS} SELECT pair, file, idx, before_text AS broken_text, after_text AS repaired_text FROM d WHERE kind = 'changed'"""
)
def mined_repairs(spark: SparkSession, d: str) -> DataFrame:
    found = repairs.filtered(repairs.repairs(*_commands(spark, d)), ["repair:specification"])
    return found.select("pair", "file", "idx", "broken_text", "repaired_text")


@query(
    """WITH t(coq, serapi) AS (VALUES ('8.9.1', '8.9.0+0.6.1'), ('8.10.2', '8.10.0+0.7.0'), ('8.10.2', '8.10.0+0.7.2'), ('8.10.2', '8.10.0+0.7.10')) SELECT coq, CASE coq WHEN '8.9.1' THEN '8.9.0+0.6.1' ELSE '8.10.0+0.7.10' END AS serapi FROM t GROUP BY coq"""
)
def latest_compatible(spark: SparkSession, d: str) -> DataFrame:
    table = spark.sql(
        "SELECT * FROM VALUES ('8.9.1', '8.9.0+0.6.1'), ('8.10.2', '8.10.0+0.7.0'), ('8.10.2', '8.10.0+0.7.2'), ('8.10.2', '8.10.0+0.7.10') AS t(coq, serapi)"
    )
    return options.latest_compatible(table, "serapi")


@query(
    """SELECT p_partkey, 'lib/' || p_size AS dir, p_brand || '.' || p_partkey AS name FROM part"""
)
def load_paths(spark: SparkSession, d: str) -> DataFrame:
    """Directories and logical names by load-path flags."""
    size = F.col("p_size").cast("string")
    args = F.array(F.lit("-R"), F.concat(F.lit("lib/"), size), F.col("p_brand"), F.lit("-I"), F.lit("ml"))
    file = F.concat(F.lit("lib/"), size, F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".v"))
    path = options.load_path(args)
    return load(spark, d, "part").select("p_partkey", path["R"][0]["dir"].alias("dir"), options.logical_name(path, file).alias("name"))


@query(
    """SELECT conv_id, turn, turn + 1 AS n_foreground, 1 AS n_shelved, turn + 2 AS n_goals FROM conversations"""
)
def carried_goals(spark: SparkSession, d: str) -> DataFrame:
    """States of a proof with one goal more per step, compressed to diffs, carried forward and counted."""
    numbers = F.transform(F.sequence(F.lit(0), F.col("turn")), lambda i: F.concat(F.lit('"g'), i.cast("string"), F.lit('"')))
    state = F.concat(F.lit('{"foreground": ['), F.array_join(numbers, ","), F.lit('], "background": [], "shelved": ["s"], "abandoned": []}'))
    turns = load(spark, d, "conversations").select("conv_id", "turn", state.alias("goals"))
    small = goal_states.compressed(turns, ["conv_id"], ["turn"])
    full = goal_states.facts(goal_states.carried(small, ["conv_id"], ["turn"]))
    return full.select("conv_id", "turn", *[F.col(c).cast("long").alias(c) for c in ("n_foreground", "n_shelved", "n_goals")])
