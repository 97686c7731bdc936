"""Queries that write the library's text formats from the driver's tables, read them back through its readers, operators, sinks and command line, and the SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..functions.support import min_count
from ..operators import itemsets, keystats, kmeans, pagerank
from ..operators.components import connected_components
from ..sources import readers, writers
from ..storage import materialize, new_path
from .catalog import _ALL, _ORDERED, HIGH, K, LLOYD_ROUNDS, LOW, ROUNDS, _brands, _kmeans_sql, _pagerank_sql, _sets, _suppliers, _table, _told, _trade_edges

Query = Callable[[SparkSession, str], DataFrame]


def _file(lines: DataFrame, column: Column) -> str:
    """Path of text files with a line for each row."""
    path = new_path(lines.sparkSession, "lines")
    writers.write_lines(lines.select(column.alias("value")), path)
    return path


def _spaced(*columns: str) -> Column:
    return F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))


def _listed(items: str) -> Column:
    return F.array_join(F.col(items).cast("array<string>"), " ")


# ---- sources


def read_lines(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_lines(spark, _file(_table(spark, d, "events"), _spaced("event_id", "event_type")))


def read_lines_hinted(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_lines(spark, _file(_table(spark, d, "events"), _spaced("event_id", "event_type")), partitions=3)


def _noisy_baskets(spark: SparkSession, d: str) -> str:
    baskets = _suppliers(spark, d).withColumn("items", F.array_sort("items"))
    return _file(baskets, F.concat(F.lit("x1  "), _listed("items"), F.lit(" 99999999999 1.5")))


def read_transactions(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.read_transactions(spark, _noisy_baskets(spark, d))
    return rows.groupBy(F.array_join("items", ",").alias("items")).agg(F.count("*").alias("n"))


def transaction_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.read_transactions(spark, _noisy_baskets(spark, d), partitions=4)
    return rows.agg(F.count("*").alias("n"), F.countDistinct("tid").alias("ids"), F.sum(F.size("items")).alias("items"))


def parsing_issues(spark: SparkSession, d: str) -> DataFrame:
    return readers.parsing_issues(spark, _noisy_baskets(spark, d))


def read_edges(spark: SparkSession, d: str) -> DataFrame:
    lines = _table(spark, d, "lineitem").select(F.explode(F.array(F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.lit("rest")), F.lit("# note"), F.lit(""))).alias("line"))
    return readers.read_edges(spark, _file(lines, F.col("line"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


def _adjacency(spark: SparkSession, d: str) -> str:
    rows = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("parts"))
    return _file(rows, F.concat(F.col("l_orderkey").cast("string"), F.lit(" "), _listed("parts")))


def read_adjacency_edges(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_graph(spark, _adjacency(spark, d), "adjLists", 3).groupBy("src", "dst").agg(F.count("*").alias("n"))


def read_adjacency_rows(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_adjacency_rows(spark, _adjacency(spark, d)).select("src", F.array_join("dsts", ",").alias("dsts"))


def _points(spark: SparkSession, d: str) -> str:
    return _file(_table(spark, d, "embeddings"), F.concat(F.col("label").cast("string"), F.lit(" "), F.array_join(F.transform("embedding", lambda v: v.cast("double").cast("string")), " ")))


def read_points(spark: SparkSession, d: str) -> DataFrame:
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return readers.read_points(spark, _points(spark, d)).select(F.size("x").alias("n"), F.round(F.col("x")[0], 6).alias("first"), F.round(total, 6).alias("total"))


def _key_tree(spark: SparkSession, d: str) -> str:
    """A directory for each event type, twice: the same keys in ``d0`` and ``d1``."""
    root = new_path(spark, "keydist")
    events = _table(spark, d, "events")
    for (kind,) in events.select("event_type").distinct().orderBy("event_type").collect():  # a directory each
        for dep in ("d0", "d1"):
            writers.write_lines(events.where(F.col("event_type") == kind).select(F.col("user_id").cast("string").alias("value")), f"{root}/{kind}/s{len(kind)}/{dep}")
    return root


def read_key_tree(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_key_tree(spark, _key_tree(spark, d)).groupBy("app", "stage", "dep").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


def key_sort_tree(spark: SparkSession, d: str) -> DataFrame:
    return keystats.sorted_key_counts(readers.read_key_tree(spark, _key_tree(spark, d), skip_equal_sizes=True), by=("app", "stage", "dep"))


def _key_bytes(spark: SparkSession, d: str) -> list[str]:
    """Two files: ``event type, user, bytes``."""
    events = _table(spark, d, "events").withColumn("bytes", F.length("props"))
    return [_file(events, _spaced("event_type", "user_id", "bytes")), _file(events, _spaced("user_id", "bytes"))]


def key_bytes_files(spark: SparkSession, d: str) -> DataFrame:
    return keystats.bytes_per_key(readers.read_key_bytes(spark, ";".join(_key_bytes(spark, d))))


def key_bytes_by_file(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.read_key_bytes(spark, _key_bytes(spark, d), "|").withColumn("two", F.col("key").contains("|"))
    return keystats.key_counts(rows, "key", ("two",))


# ---- sinks


def _written(spark: SparkSession, write: Callable[[str], None], end: str = "") -> DataFrame:
    path = new_path(spark, "sink")
    write(path)
    return spark.read.text(path + end)


def write_itemset_levels(spark: SparkSession, d: str) -> DataFrame:
    sets = itemsets.eclat(materialize(_brands(spark, d), "baskets"), HIGH)
    return _written(spark, lambda path: writers.write_itemset_levels(sets, path)).select("level", "value")


def write_itemsets(spark: SparkSession, d: str) -> DataFrame:
    sets = itemsets.twidd(materialize(_brands(spark, d), "baskets"), HIGH)
    return _written(spark, lambda path: writers.write_itemsets(sets, path))


def write_itemset_sets(spark: SparkSession, d: str) -> DataFrame:
    sets = itemsets.pfp(materialize(_brands(spark, d), "baskets"), HIGH, strict=True)
    return _written(spark, lambda path: writers.write_itemset_sets(sets, path))


def pfp_counts(spark: SparkSession, d: str) -> DataFrame:
    """Only how many sets there are, and how many tokens were dropped."""
    path = _noisy_baskets(spark, d)
    distinct = readers.read_transactions(spark, path).withColumn("items", F.array_distinct("items"))
    sets = itemsets.pfp(distinct, 0.04, strict=True).agg(F.count("*").alias("n"))
    return sets.join(readers.parsing_issues(spark, path).select("issues"))


def write_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = keystats.hash_sample(_table(spark, d, "documents"), F.col("doc_id"), 10).select(_spaced("doc_id", "source").alias("value"))
    return _written(spark, lambda path: writers.write_lines(rows, writers.sample_path(path, 0.1, 1)), "-0.1-1.sample")


def write_key_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = keystats.key_counts(_table(spark, d, "events"), "user_id")
    return _written(spark, lambda path: writers.write_key_counts(counts, path))


def write_key_bytes(spark: SparkSession, d: str) -> DataFrame:
    stats = keystats.bytes_per_key(_table(spark, d, "events").select(F.col("event_type").alias("key"), F.length("props").alias("bytes")))
    return _written(spark, lambda path: writers.write_key_bytes(stats, path + "*"), ".agg")


def sets_in_order(spark: SparkSession, d: str) -> DataFrame:
    sets = itemsets.in_order(itemsets.eclat(materialize(_brands(spark, d), "baskets"), HIGH)).coalesce(1)
    return sets.select(F.monotonically_increasing_id().alias("place"), F.array_join("items", ",").alias("items"))


# ---- command line


def _command(*arguments: str, of: Callable[[SparkSession, str], str], then: Callable[[DataFrame], DataFrame] = lambda df: df) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return then(cli.run(spark, [arguments[0], of(spark, d), *arguments[1:]]))

    return query


def _brand_lines(spark: SparkSession, d: str) -> str:
    return _file(_brands(spark, d), F.array_join(F.col("items").cast("array<string>"), ","))


def _trade_lines(spark: SparkSession, d: str) -> str:
    return _file(_trade_edges(spark, d).groupBy("src").agg(F.collect_list("dst").alias("dsts")), F.concat(F.col("src").cast("string"), F.lit(" "), _listed("dsts")))


def _trade_edge_lines(spark: SparkSession, d: str) -> str:
    return _file(_trade_edges(spark, d), _spaced("src", "dst"))


def _homes(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers with their nations."""
    customers = _table(spark, d, "customer").select((F.col("c_custkey") * 3).alias("src"), (F.col("c_nationkey").cast("long") * 3 + 2).alias("dst"))
    return customers.union(_table(spark, d, "supplier").select((F.col("s_suppkey") * 3 + 1).alias("src"), (F.col("s_nationkey").cast("long") * 3 + 2).alias("dst")))


def _home_lines(spark: SparkSession, d: str) -> str:
    return _file(_homes(spark, d), _spaced("src", "dst"))


def components_homes(spark: SparkSession, d: str) -> DataFrame:
    """Components of all customers, suppliers and nations."""
    return connected_components(_homes(spark, d))


def cli_sample(spark: SparkSession, d: str) -> DataFrame:
    path = _file(_table(spark, d, "events"), _spaced("event_id", "event_type"))
    cli.run(spark, ["sample", path, "--fraction", "1.0", "--seed", "3"])
    return spark.read.text(f"{path}-1.0-3.sample")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("rank", 6).alias("rank"))


def _mean(df: DataFrame) -> DataFrame:
    return df.select("cluster", F.posexplode("center").alias("i", "v")).select("cluster", "i", F.round("v", 6).alias("v"))


# ---- clusters


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def kmeans_reduce_partitions(spark: SparkSession, d: str) -> DataFrame:
    """The rounds of ``kmeans_assign`` with sums reduced in three partitions."""
    points = _vectors(spark, d)
    first = [r["x"] for r in points.orderBy("vec_id").limit(K).collect()]
    model = kmeans.kmeans(points, K, LLOYD_ROUNDS, initial=first, epsilon=0.0, partitions=3)
    return kmeans.assign(points, model.centers).select("vec_id", "cluster", F.round("distance2", 6).alias("distance2"))


def kmeans_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidate centers of k-means|| after two steps, and how many points are nearest to each."""
    found = kmeans.parallel_candidates(_vectors(spark, d), K, 2, 7, F.col("vec_id"))
    return found.select(F.round(F.col("center")[0], 6).alias("first"), "weight")


def _no_worse(mode: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        """Facts about a model that depends on chance: all points assigned, k clusters at most, no costlier than its initial centers, one cluster for each in the best of two runs."""
        points = _vectors(spark, d)
        one, two = (kmeans.kmeans(points, K, 3, mode, seed=7, runs=r) for r in (1, 2))
        rows = kmeans.assign(points, one.centers).agg(F.count("*").alias("n"), F.max("cluster").alias("most"))
        return rows.select("n", (F.col("most") < K).alias("k_clusters"), F.lit(one.cost <= kmeans.kmeans(points, K, 0, mode, seed=7).cost + 1e-9).alias("improved"), F.lit(two.cost <= one.cost + 1e-9).alias("best_run"))

    return query


def sample_facts(spark: SparkSession, d: str) -> DataFrame:
    """A Bernoulli sample is a part of its table, within six standard deviations of its share, and the same for the same seed."""
    docs = materialize(_table(spark, d, "events").select("event_id"), "events")
    one, two = keystats.bernoulli_sample(docs, 0.1, 1), keystats.bernoulli_sample(docs, 0.1, 1)
    n, again, known, size = one.count(), one.join(two, "event_id").count(), one.join(docs, "event_id", "left_semi").count(), docs.count()
    return spark.createDataFrame([(size, abs(n - 0.1 * size) <= 6 * (0.09 * size) ** 0.5, n == known, n == again)], "n long, in_bounds boolean, is_part boolean, repeatable boolean")


# ---- itemsets, graphs


def _twidd(**options: int) -> Query:
    return lambda spark, d: _told(itemsets.twidd(materialize(_brands(spark, d), "baskets"), HIGH, **options))


def tree_statistics(spark: SparkSession, d: str) -> DataFrame:
    t = materialize(_brands(spark, d), "baskets")
    return itemsets.tree_statistics(itemsets.by_frequency(t, itemsets.frequent_items(t, min_count(HIGH, t.count()))))


def pair_intersections_multiset(spark: SparkSession, d: str) -> DataFrame:
    """Ids in the TID lists of two event types, as often as in both (users are the ids)."""
    rows = _table(spark, d, "events").groupBy(F.col("user_id").alias("tid")).agg(F.collect_list("event_type").alias("items"))
    return itemsets.pair_intersections(rows, multiset=True)


def pagerank_by_line(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.read_adjacency_rows(spark, _trade_lines(spark, d))
    return _rounded(pagerank.adjacency_pagerank_by_line(rows, ROUNDS))


def pagerank_kept_sources(spark: SparkSession, d: str) -> DataFrame:
    """Customers link to nations: nothing links to a customer, so each keeps the share of a vertex without links to it."""
    return _rounded(pagerank.adjacency_pagerank(materialize(_homes(spark, d), "edges"), 1, keep_sources=True))


QUERIES: dict[str, Query] = {
    "read_lines": read_lines,
    "read_lines_hinted": read_lines_hinted,
    "read_transactions": read_transactions,
    "transaction_ids": transaction_ids,
    "parsing_issues": parsing_issues,
    "read_edges": read_edges,
    "read_adjacency_edges": read_adjacency_edges,
    "read_adjacency_rows": read_adjacency_rows,
    "read_points": read_points,
    "read_key_tree": read_key_tree,
    "key_sort_tree": key_sort_tree,
    "key_bytes_files": key_bytes_files,
    "key_bytes_by_file": key_bytes_by_file,
    "write_itemset_levels": write_itemset_levels,
    "write_itemsets": write_itemsets,
    "write_itemset_sets": write_itemset_sets,
    "pfp_counts": pfp_counts,
    "write_sample": write_sample,
    "write_key_counts": write_key_counts,
    "write_key_bytes": write_key_bytes,
    "sets_in_order": sets_in_order,
    "cli_eclat": _command("eclat", "--separator", ",", "--min-support", str(LOW), of=_brand_lines, then=_told),
    "cli_twidd": _command("twidd", "--separator", ",", "--min-support", str(HIGH), "--mu", "3", "--rho", "1", of=_brand_lines, then=_told),
    "cli_pfp": _command("pfp", "--separator", ",", "--min-support", str(HIGH), "--strict", of=_brand_lines, then=_told),
    "cli_pagerank": _command("pagerank", "--rounds", str(ROUNDS), of=_trade_lines, then=_rounded),
    "cli_pagerank_edges": _command("pagerank", "--kind", "edges", "--rounds", str(ROUNDS), of=_trade_edge_lines, then=_rounded),
    "cli_components": _command("components", "--kind", "edges", of=_home_lines),
    "cli_kmeans": _command("kmeans", "--k", "1", "--rounds", "3", of=_points, then=_mean),
    "cli_sample": cli_sample,
    "cli_key_sort": _command("key-sort", "--skip-equal-sizes", of=_key_tree),
    "cli_key_bytes": _command("key-bytes", of=lambda spark, d: _key_bytes(spark, d)[0]),
    "components_homes": components_homes,
    "kmeans_reduce_partitions": kmeans_reduce_partitions,
    "kmeans_candidates": kmeans_candidates,
    "kmeans_random_facts": _no_worse("random"),
    "kmeans_parallel_facts": _no_worse("k-means||"),
    "sample_facts": sample_facts,
    "twidd_partitions": _twidd(mu=2, partitions=5),
    "twidd_rho_3": _twidd(mu=0, rho=3),
    "tree_statistics": tree_statistics,
    "pair_intersections_multiset": pair_intersections_multiset,
    "pagerank_by_line": pagerank_by_line,
    "pagerank_kept_sources": pagerank_kept_sources,
}

_EVENT_LINES = "SELECT event_id || ' ' || event_type AS value FROM events"
_SUPPLIED = "SELECT string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) AS items FROM lineitem GROUP BY l_orderkey"
_PARTS = "SELECT l_orderkey AS src, l_partkey AS dst, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey"
_SETS = _sets(HIGH, [1, 2, 3])
_KEYED = "SELECT event_type || user_id AS key, length(props) AS b FROM events"
_TREE = "SELECT event_type AS app, 's' || length(event_type) AS stage, 'd0' AS dep, CAST(user_id AS VARCHAR) AS key, count(*) AS n FROM events GROUP BY event_type, user_id"
_HOMES = "WITH e AS (SELECT c_custkey * 3 AS src, CAST(c_nationkey AS BIGINT) * 3 + 2 AS dst FROM customer UNION ALL SELECT s_suppkey * 3 + 1, CAST(s_nationkey AS BIGINT) * 3 + 2 FROM supplier)"
_COMPONENTS = f"{_HOMES}, c AS (SELECT dst, least(dst, min(src)) AS component FROM e GROUP BY dst) SELECT DISTINCT src AS id, component FROM e JOIN c ON e.dst = c.dst UNION ALL SELECT dst, component FROM c"


def _candidates_sql() -> str:
    """Numbers from 0 to 1 are the first eight hexadecimal digits of a seeded MD5."""
    chance = lambda step: f"CAST('0x' || substr(md5('7:{step}:' || vec_id), 1, 8) AS BIGINT) / 4294967296.0"
    parts = ["x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)", f"s0 AS (SELECT vec_id, x, 0 AS step FROM x ORDER BY {chance(0)}, vec_id LIMIT 1)"]
    for step in (1, 2):
        parts.append(f"d{step} AS (SELECT x.vec_id, any_value(x.x) AS x, min(list_sum(list_transform(range(1, len(x.x) + 1), lambda j: (x.x[j] - s.x[j]) * (x.x[j] - s.x[j])))) AS cost FROM x, s{step - 1} s GROUP BY x.vec_id)")
        parts.append(f"s{step} AS (SELECT * FROM s{step - 1} UNION ALL SELECT vec_id, x, {step} FROM d{step} WHERE {chance(step)} < {2 * K} * cost / (SELECT sum(cost) FROM d{step}))")
    near = "n AS (SELECT x.vec_id, arg_min(s.vec_id, (list_sum(list_transform(range(1, len(x.x) + 1), lambda j: (x.x[j] - s.x[j]) * (x.x[j] - s.x[j]))), s.step, s.vec_id)) AS c FROM x, s2 s GROUP BY x.vec_id)"
    return f"WITH {', '.join(parts)}, {near} SELECT round(s2.x[1], 6) AS first, count(n.c) AS weight FROM s2 LEFT JOIN n ON n.c = s2.vec_id GROUP BY s2.vec_id, s2.x"


ORACLES: dict[str, str] = {
    "read_lines": _EVENT_LINES,
    "read_lines_hinted": _EVENT_LINES,
    "read_transactions": f"SELECT items, count(*) AS n FROM ({_SUPPLIED}) GROUP BY items",
    "transaction_ids": "SELECT count(DISTINCT l_orderkey) AS n, count(DISTINCT l_orderkey) AS ids, count(*) AS items FROM lineitem",
    "parsing_issues": "SELECT count(DISTINCT l_orderkey) AS lines, 3 * count(DISTINCT l_orderkey) AS issues FROM lineitem",
    "read_edges": _PARTS,
    "read_adjacency_edges": _PARTS,
    "read_adjacency_rows": "SELECT CAST(l_orderkey AS INTEGER) AS src, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS dsts FROM lineitem GROUP BY l_orderkey",
    "read_points": "SELECT CAST(len(embedding) AS INTEGER) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings",
    "read_key_tree": "SELECT event_type AS app, 's' || length(event_type) AS stage, dep, count(*) AS n, count(DISTINCT user_id) AS keys FROM events, (VALUES ('d0'), ('d1')) v(dep) GROUP BY event_type, dep",
    "key_sort_tree": _TREE,
    "key_bytes_files": f"SELECT key, count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes FROM ({_KEYED} UNION ALL SELECT CAST(user_id AS VARCHAR), length(props) FROM events) GROUP BY key",
    "key_bytes_by_file": "SELECT true AS two, event_type || '|' || user_id AS key, count(*) AS n FROM events GROUP BY event_type, user_id UNION ALL SELECT false, CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY user_id",
    "write_itemset_levels": f"SELECT k AS level, items || ' ' || support AS value FROM ({_SETS})",
    "write_itemsets": f"SELECT items || ' ' || support AS value FROM ({_SETS})",
    "write_itemset_sets": f"SELECT '{{' || items || '}}: ' || support AS value FROM ({_SETS})",
    "pfp_counts": "WITH s AS (SELECT DISTINCT l_orderkey AS t, l_suppkey AS i FROM lineitem), m AS (SELECT CAST(floor(CAST(0.04 AS DOUBLE) * count(DISTINCT t)) AS BIGINT) AS m, 3 * count(DISTINCT t) AS issues FROM s), one AS (SELECT i FROM s GROUP BY i HAVING count(*) > (SELECT m FROM m)), two AS (SELECT a.i FROM s a JOIN s b ON a.t = b.t AND a.i < b.i GROUP BY a.i, b.i HAVING count(*) > (SELECT m FROM m)), three AS (SELECT a.i FROM s a JOIN s b ON a.t = b.t AND a.i < b.i JOIN s c ON a.t = c.t AND b.i < c.i GROUP BY a.i, b.i, c.i HAVING count(*) > (SELECT m FROM m)) SELECT (SELECT count(*) FROM one) + (SELECT count(*) FROM two) + (SELECT count(*) FROM three) AS n, (SELECT issues FROM m) AS issues",
    "write_sample": "SELECT doc_id || ' ' || source AS value FROM documents WHERE CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 6) AS BIGINT) % 100 < 10",
    "write_key_counts": "SELECT user_id || ' ' || count(*) AS value FROM events GROUP BY user_id",
    "write_key_bytes": "SELECT event_type || chr(9) || count(*) || chr(9) || CAST(sum(length(props)) AS BIGINT) AS value FROM events GROUP BY event_type",
    "sets_in_order": f"SELECT row_number() OVER (ORDER BY k, CAST(string_split(items, ',') AS INTEGER[])) - 1 AS place, items FROM ({_SETS})",
    "cli_eclat": _ALL,
    "cli_twidd": _SETS,
    "cli_pfp": _SETS,
    "cli_pagerank": _pagerank_sql(False),
    "cli_pagerank_edges": _pagerank_sql(True),
    "cli_components": _COMPONENTS,
    "cli_kmeans": "SELECT CAST(0 AS INTEGER) AS cluster, CAST(i AS INTEGER) AS i, round(avg(v), 6) AS v FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY i",
    "cli_sample": _EVENT_LINES,
    "cli_key_sort": _TREE,
    "cli_key_bytes": f"SELECT key, count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes FROM ({_KEYED}) GROUP BY key",
    "components_homes": _COMPONENTS,
    "kmeans_reduce_partitions": _kmeans_sql(f"SELECT vec_id, cluster, round(d, 6) AS distance2 FROM n{LLOYD_ROUNDS}"),
    "kmeans_candidates": _candidates_sql(),
    "kmeans_random_facts": "SELECT count(*) AS n, true AS k_clusters, true AS improved, true AS best_run FROM embeddings",
    "kmeans_parallel_facts": "SELECT count(*) AS n, true AS k_clusters, true AS improved, true AS best_run FROM embeddings",
    "sample_facts": "SELECT count(*) AS n, true AS in_bounds, true AS is_part, true AS repeatable FROM events",
    "twidd_partitions": _SETS,
    "twidd_rho_3": _SETS,
    "tree_statistics": f"{_ORDERED}, p AS (SELECT list(i ORDER BY s DESC, i) AS path FROM o GROUP BY t), n AS (SELECT DISTINCT path[1:k] AS node FROM (SELECT path, unnest(range(1, len(path) + 1)) AS k FROM p)) SELECT count(*) AS nodes, CAST(max(len(node)) AS INTEGER) AS depth FROM n",
    "pair_intersections_multiset": "WITH c AS (SELECT user_id AS t, event_type AS i, count(*) AS q FROM events GROUP BY user_id, event_type), i AS (SELECT DISTINCT i FROM c), p AS (SELECT a.i AS x, b.i AS y, CAST(sum(least(a.q, b.q)) AS BIGINT) AS n FROM c a JOIN c b ON a.t = b.t AND a.i < b.i GROUP BY a.i, b.i) SELECT a.i AS item_a, b.i AS item_b, coalesce(p.n, 0) AS n FROM i a JOIN i b ON a.i < b.i LEFT JOIN p ON p.x = a.i AND p.y = b.i",
    "pagerank_by_line": _pagerank_sql(False),
    "pagerank_kept_sources": f"{_HOMES}, u AS (SELECT src, count(*) AS deg FROM e GROUP BY src) SELECT dst AS id, round(0.15 + 0.85 * sum(CAST(1 AS DOUBLE) / deg), 6) AS rank FROM e JOIN u ON e.src = u.src GROUP BY dst UNION ALL SELECT src, round(CAST(0.15 AS DOUBLE), 6) FROM u",
}
