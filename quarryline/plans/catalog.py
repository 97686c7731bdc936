"""Queries by name over the driver's tables, and for each the SQL that gives the same rows.

Itemsets are told as text (``1,2``), doubles are rounded to 6 digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.skew import correlation, skewness
from ..functions.support import min_count
from ..functions.vectors import norm
from ..operators import itemsets, keystats, kmeans, pagerank
from ..operators.components import connected_components
from ..storage import materialize

LOW, HIGH = 0.004, 0.01
"""Minimum supports: many sets of three items, and hardly any."""
ROUNDS, K, LLOYD_ROUNDS = 3, 5, 2


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- inputs


def _brand_pairs(spark: SparkSession, d: str) -> DataFrame:
    part = _table(spark, d, "part").select("p_partkey", F.substring("p_brand", 7, 100).cast("int").alias("item"))
    return _table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("tid"), "item").distinct()


def _brands(spark: SparkSession, d: str) -> DataFrame:
    return itemsets.baskets(_brand_pairs(spark, d))


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return itemsets.baskets(_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tid"), F.col("l_suppkey").alias("item")), distinct=False)


def _trade_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every customer links to its suppliers, and a supplier back to the customers whose partly fulfilled orders it serves: customers without such orders have no in-links."""
    orders = _table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "P").alias("partly"))
    lines = orders.join(_table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = lines.groupBy(F.col("o_custkey").alias("c"), F.col("l_suppkey").alias("s")).agg(F.bool_or("partly").alias("partly"))
    there, back = ((F.col("c") * 2).alias("src"), (F.col("s") * 2 + 1).alias("dst")), ((F.col("s") * 2 + 1).alias("src"), (F.col("c") * 2).alias("dst"))
    return pairs.select(*there).union(pairs.where("partly").select(*back))


def _order_part_edges(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "lineitem").select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).distinct()


def _told(sets: DataFrame) -> DataFrame:
    return sets.select(F.array_join("items", ",").alias("items"), F.size("items").alias("k"), F.col("support").cast("long").alias("support"))


# ---- itemsets


def item_support(spark: SparkSession, d: str) -> DataFrame:
    return itemsets.item_support(_brands(spark, d))


def frequent_items(spark: SparkSession, d: str) -> DataFrame:
    t = materialize(_suppliers(spark, d), "baskets")
    return itemsets.frequent_items(t, min_count(0.04, t.count()))


def _eclat(min_support: float, max_level: int | None = None, level: int | None = None, **options) -> Callable:
    def query(spark: SparkSession, d: str) -> DataFrame:
        brands = _suppliers(spark, d) if options.get("multiset") else _brands(spark, d)
        found = itemsets.eclat(materialize(brands, "baskets"), min_support, max_level=max_level, **options)
        return _told(found if level is None else found.where(F.size("items") == level))

    return query


def pfp_all(spark: SparkSession, d: str) -> DataFrame:
    return _told(itemsets.pfp(materialize(_brands(spark, d), "baskets"), LOW, strict=True))


def pfp_library_rule(spark: SparkSession, d: str) -> DataFrame:
    return _told(itemsets.pfp(materialize(_brands(spark, d), "baskets"), HIGH))


def twidd_all(spark: SparkSession, d: str) -> DataFrame:
    return _told(itemsets.twidd(materialize(_brands(spark, d), "baskets"), LOW))


def twidd_mu_loss(spark: SparkSession, d: str) -> DataFrame:
    return _told(itemsets.twidd(materialize(_brands(spark, d), "baskets"), HIGH, mu=3, compat_mu_loss=True))


def tid_lists(spark: SparkSession, d: str) -> DataFrame:
    lists = itemsets.tid_lists(_brands(spark, d), chunk=1_000)
    total = F.aggregate("tids", F.lit(0).cast("long"), lambda a, x: a + x)
    return lists.groupBy("item").agg(F.sum(F.size("tids")).alias("n"), F.sum(total).alias("sum_tids"), F.min(F.col("tids")[0]).alias("first_tid"))


def tid_list_intersections(spark: SparkSession, d: str) -> DataFrame:
    return itemsets.pair_intersections(_brands(spark, d))


def prefix_selfjoin(spark: SparkSession, d: str) -> DataFrame:
    pairs = itemsets.eclat(materialize(_suppliers(spark, d).withColumn("items", F.array_distinct("items")), "baskets"), 0.0022, max_level=2)
    return itemsets.prefix_self_join(pairs.where(F.size("items") == 2)).select(F.array_join("items", ",").alias("items"))


def ordered_transactions(spark: SparkSession, d: str) -> DataFrame:
    t = materialize(_brands(spark, d), "baskets")
    return itemsets.by_frequency(t, itemsets.frequent_items(t, min_count(HIGH, t.count()))).select(F.array_join("items", ",").alias("items"), F.col("w").alias("n"))


def conditional_paths(spark: SparkSession, d: str) -> DataFrame:
    t = materialize(_brands(spark, d), "baskets")
    rows = itemsets.by_frequency(t, itemsets.frequent_items(t, min_count(HIGH, t.count())))
    projected = itemsets.project(rows.select(F.array().cast("array<int>").alias("items"), F.col("items").alias("path"), "w"))
    return projected.groupBy(F.col("items")[0].alias("item")).agg(F.sum("w").alias("support"), F.countDistinct(F.array_join("path", ",")).alias("paths"))


_B = "b AS (SELECT DISTINCT l_orderkey AS t, CAST(substr(p_brand, 7) AS INTEGER) AS i FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _m(min_support: float, source: str = "b") -> str:
    return f"m AS (SELECT CAST(floor(CAST({min_support} AS DOUBLE) * count(DISTINCT t)) AS BIGINT) AS m FROM {source})"


def _level(k: int, having: str, source: str = "b") -> str:
    names = [f"a{j}" for j in range(k)]
    joins = f"{source} a0" + "".join(f" JOIN {source} {b} ON a0.t = {b}.t AND {a}.i < {b}.i" for a, b in zip(names, names[1:], strict=False))
    items = " || ',' || ".join(f"CAST({n}.i AS VARCHAR)" for n in names)
    return f"SELECT {items} AS items, CAST({k} AS INTEGER) AS k, count(*) AS support FROM {joins} GROUP BY {', '.join(f'{n}.i' for n in names)} HAVING {having}"


def _sets(min_support: float, levels: list[int], having: str = "count(*) > (SELECT m FROM m)", more: str = "", source: str = "b") -> str:
    return f"WITH {_B}, {_m(min_support)}{more} " + " UNION ALL ".join(_level(k, having, source) for k in levels)


_ALL = _sets(LOW, [1, 2, 3, 4])
_ORDERED = f"WITH {_B}, {_m(HIGH)}, f AS (SELECT i, count(*) AS s FROM b GROUP BY i HAVING count(*) > (SELECT m FROM m)), o AS (SELECT t, b.i, f.s FROM b JOIN f ON b.i = f.i)"


# ---- graphs


def pagerank_adj_n(spark: SparkSession, d: str) -> DataFrame:
    return pagerank.adjacency_pagerank(materialize(_trade_edges(spark, d), "edges"), ROUNDS).select("id", F.round("rank", 6).alias("rank"))


def pagerank_graph_n(spark: SparkSession, d: str) -> DataFrame:
    return pagerank.graph_pagerank(materialize(_trade_edges(spark, d), "edges"), ROUNDS).select("id", F.round("rank", 6).alias("rank"))


def inner_join_links(spark: SparkSession, d: str) -> DataFrame:
    edges = materialize(_trade_edges(spark, d), "edges")
    ranks = edges.select("src").distinct().withColumn("rank", F.lit(1.0))
    deg = edges.groupBy("src").agg(F.count("*").alias("deg"))
    sent = edges.join(deg, "src").join(ranks, "src").select("dst", (F.col("rank") / F.col("deg")).alias("part"))
    return sent.groupBy("dst").agg(F.count("*").alias("n"), F.round(F.sum("part"), 6).alias("received"))


def components(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(materialize(_order_part_edges(spark, d), "edges"))


def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return components(spark, d).groupBy("component").agg(F.count("*").alias("n"))


def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return components(spark, d).agg(F.count("*").alias("n_vertices"), F.countDistinct("component").alias("n_components"))


_TRADE = """p AS (SELECT o_custkey AS c, l_suppkey AS s, bool_or(o_orderstatus = 'P') AS partly FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_suppkey),
e AS (SELECT c * 2 AS src, s * 2 + 1 AS dst FROM p UNION ALL SELECT s * 2 + 1, c * 2 FROM p WHERE partly),
g AS (SELECT src, count(*) AS deg FROM e GROUP BY src)"""


def _pagerank_sql(graph: bool) -> str:
    steps = ["v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)", f"r0 AS (SELECT {'id' if graph else 'DISTINCT src AS id'}, CAST(1.0 AS DOUBLE) AS rank FROM {'v' if graph else 'e'})"]
    for k in range(1, ROUNDS + 1):
        got = f"SELECT e.dst AS id, sum(r.rank / g.deg) AS s FROM e JOIN g ON e.src = g.src JOIN r{k - 1} r ON r.id = e.src GROUP BY e.dst"
        steps.append(f"r{k} AS (SELECT v.id, CAST(0.15 AS DOUBLE) + CAST(0.85 AS DOUBLE) * coalesce(x.s, 0) AS rank FROM v {'LEFT ' if graph else ''}JOIN ({got}) x ON v.id = x.id)")
    return f"WITH {_TRADE}, {', '.join(steps)} SELECT id, round(rank, 6) AS rank FROM r{ROUNDS}"


#: One row for each vertex, whose label falls until no neighbour has a smaller one.
_COMPONENTS = """WITH RECURSIVE d AS (SELECT DISTINCT l_orderkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem),
e AS (SELECT a, b FROM d UNION SELECT b, a FROM d),
c(id, component) USING KEY (id) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, min(c.component) FROM c JOIN e ON e.a = c.id JOIN recurring.c k ON k.id = e.b WHERE c.component < k.component GROUP BY e.b)"""


# ---- clusters


def _lloyd(spark: SparkSession, d: str) -> tuple[DataFrame, kmeans.KMeansResult]:
    points = _table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    initial = [r["x"] for r in points.orderBy("vec_id").limit(K).collect()]
    return points, kmeans.kmeans(points, K, LLOYD_ROUNDS, initial=initial, epsilon=0.0)


def kmeans_assign(spark: SparkSession, d: str) -> DataFrame:
    points, model = _lloyd(spark, d)
    return kmeans.assign(points, model.centers).select("vec_id", "cluster", F.round("distance2", 6).alias("distance2"))


def kmeans_sse(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(round(_lloyd(spark, d)[1].cost, 6),)], "sse double")


def kmeans_centers(spark: SparkSession, d: str) -> DataFrame:
    return kmeans.model_frame(_lloyd(spark, d)[1], spark).select("cluster", F.posexplode("center").alias("i", "v")).select("cluster", "i", F.round("v", 6).alias("v"))


def kmeans_random(spark: SparkSession, d: str) -> DataFrame:
    points = _table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return kmeans.assign(points, kmeans.kmeans(points, 10, 10, "random", seed=7).centers).groupBy("cluster").agg(F.count("*").alias("n"))


def kmeans_parallel(spark: SparkSession, d: str) -> DataFrame:
    points = _table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return kmeans.assign(points, kmeans.kmeans(points, 10, 10, "k-means||", seed=7).centers).groupBy("cluster").agg(F.count("*").alias("n"))


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


def _kmeans_sql(select: str) -> str:
    steps = ["x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)", f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS cluster, x AS c FROM (SELECT * FROM x ORDER BY vec_id LIMIT {K}))"]
    for r in range(LLOYD_ROUNDS + 1):
        steps.append(f"d{r} AS (SELECT vec_id, x, cluster, list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - c[j]) * (x[j] - c[j]))) AS d FROM x, c{r})")
        steps.append(f"n{r} AS (SELECT vec_id, any_value(x) AS x, CAST(arg_min(cluster, (d, cluster)) AS INTEGER) AS cluster, min(d) AS d FROM d{r} GROUP BY vec_id)")
        steps.append(f"u{r} AS (SELECT cluster, i, avg(v) AS v FROM (SELECT cluster, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM n{r}) GROUP BY cluster, i)")
        steps.append(f"c{r + 1} AS (SELECT cluster, list(v ORDER BY i) AS c FROM u{r} GROUP BY cluster)")
    return f"WITH {', '.join(steps)} {select}"


# ---- keys, samples, skew


def key_sort(spark: SparkSession, d: str) -> DataFrame:
    return keystats.sorted_key_counts(_table(spark, d, "events"), "event_type")


def byte_count_per_key(spark: SparkSession, d: str) -> DataFrame:
    events = _table(spark, d, "events").select(F.col("event_type").alias("key"), F.length("props").alias("bytes"))
    return keystats.bytes_per_key(events)


def sample_hash(spark: SparkSession, d: str) -> DataFrame:
    return keystats.hash_sample(_table(spark, d, "documents").select("doc_id", "source"), F.col("doc_id"), 10)


def sample_fraction(spark: SparkSession, d: str) -> DataFrame:
    return keystats.bernoulli_sample(_table(spark, d, "documents").select("doc_id", "source"), 0.1, 1)


def task_skewness(spark: SparkSession, d: str) -> DataFrame:
    per_user = _table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return per_user.groupBy("event_type").agg(F.round(skewness(F.col("n")), 6).alias("skew"))


def task_correlation(spark: SparkSession, d: str) -> DataFrame:
    per_user = _table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.sum(F.length("props")).alias("bytes"))
    return per_user.groupBy("event_type").agg(F.round(correlation(F.col("n"), F.col("bytes")), 6).alias("corr"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "item_support": item_support,
    "frequent_items": frequent_items,
    "eclat_k2": _eclat(HIGH, 2, 2),
    "eclat_k3": _eclat(LOW, 3, 3),
    "eclat_all": _eclat(LOW),
    "eclat_multiset_k2": _eclat(0.002, 2, 2, multiset=True),
    "pfp_all": pfp_all,
    "pfp_library_rule": pfp_library_rule,
    "twidd_all": twidd_all,
    "twidd_mu_loss": twidd_mu_loss,
    "tid_lists": tid_lists,
    "tid_list_intersections": tid_list_intersections,
    "prefix_selfjoin": prefix_selfjoin,
    "ordered_transactions": ordered_transactions,
    "conditional_paths": conditional_paths,
    "pagerank_adj_n": pagerank_adj_n,
    "pagerank_graph_n": pagerank_graph_n,
    "inner_join_links": inner_join_links,
    "components": components,
    "component_sizes": component_sizes,
    "graph_counts": graph_counts,
    "kmeans_assign": kmeans_assign,
    "kmeans_sse": kmeans_sse,
    "kmeans_centers": kmeans_centers,
    "kmeans_random": kmeans_random,
    "kmeans_parallel": kmeans_parallel,
    "vector_norms": vector_norms,
    "key_sort": key_sort,
    "byte_count_per_key": byte_count_per_key,
    "sample_hash": sample_hash,
    "sample_fraction": sample_fraction,
    "task_skewness": task_skewness,
    "task_correlation": task_correlation,
}

_S = "s AS (SELECT l_orderkey AS t, l_suppkey AS i, count(*) AS q FROM lineitem GROUP BY l_orderkey, l_suppkey)"

ORACLES: dict[str, str] = {
    "item_support": f"WITH {_B} SELECT i AS item, count(*) AS support FROM b GROUP BY i",
    "frequent_items": f"WITH {_S}, {_m(0.04, 's')} SELECT CAST(i AS INTEGER) AS item, count(*) AS support FROM s GROUP BY i HAVING count(*) > (SELECT m FROM m)",
    "eclat_k2": _sets(HIGH, [2]),
    "eclat_k3": _sets(LOW, [3]),
    "eclat_all": _ALL,
    "eclat_multiset_k2": f"WITH {_S}, {_m(0.002, 's')}, f AS (SELECT i FROM s GROUP BY i HAVING sum(q) > (SELECT m FROM m)), g AS (SELECT s.* FROM s JOIN f ON s.i = f.i) SELECT CAST(a.i AS VARCHAR) || ',' || CAST(b.i AS VARCHAR) AS items, CAST(2 AS INTEGER) AS k, CAST(sum(least(a.q, b.q)) AS BIGINT) AS support FROM g a JOIN g b ON a.t = b.t AND a.i < b.i GROUP BY a.i, b.i HAVING sum(least(a.q, b.q)) > (SELECT m FROM m)",
    "pfp_all": _ALL,
    "pfp_library_rule": _sets(HIGH, [1, 2, 3], f"count(*) >= (SELECT CAST(ceil(CAST({HIGH} AS DOUBLE) * count(DISTINCT t)) AS BIGINT) FROM b)"),
    "twidd_all": _ALL,
    "twidd_mu_loss": _sets(HIGH, [1, 2, 3], more=", f AS (SELECT i FROM b GROUP BY i HAVING count(*) > (SELECT m FROM m)), z AS (SELECT b.t, b.i FROM b JOIN f ON b.i = f.i), y AS (SELECT t, i FROM z WHERE t IN (SELECT t FROM z GROUP BY t HAVING count(*) >= 3))", source="y"),
    "tid_lists": f"WITH {_B} SELECT i AS item, count(*) AS n, CAST(sum(t) AS BIGINT) AS sum_tids, min(t) AS first_tid FROM b GROUP BY i",
    "tid_list_intersections": f"WITH {_B}, i AS (SELECT DISTINCT i FROM b), p AS (SELECT x.i AS item_a, y.i AS item_b, count(*) AS n FROM b x JOIN b y ON x.t = y.t AND x.i < y.i GROUP BY x.i, y.i) SELECT x.i AS item_a, y.i AS item_b, coalesce(p.n, 0) AS n FROM i x JOIN i y ON x.i < y.i LEFT JOIN p ON p.item_a = x.i AND p.item_b = y.i",
    "prefix_selfjoin": f"WITH {_S}, {_m(0.0022, 's')}, p AS (SELECT a.i AS x, b.i AS y FROM s a JOIN s b ON a.t = b.t AND a.i < b.i GROUP BY a.i, b.i HAVING count(*) > (SELECT m FROM m)) SELECT CAST(a.x AS VARCHAR) || ',' || CAST(a.y AS VARCHAR) || ',' || CAST(b.y AS VARCHAR) AS items FROM p a JOIN p b ON a.x = b.x AND a.y < b.y",
    "ordered_transactions": f"{_ORDERED} SELECT items, count(*) AS n FROM (SELECT t, string_agg(CAST(i AS VARCHAR), ',' ORDER BY s DESC, i) AS items FROM o GROUP BY t) GROUP BY items",
    "conditional_paths": f"{_ORDERED}, q AS (SELECT a.t, a.i, coalesce(string_agg(CAST(b.i AS VARCHAR), ',' ORDER BY b.s DESC, b.i), '') AS path FROM o a LEFT JOIN o b ON a.t = b.t AND (b.s > a.s OR b.s = a.s AND b.i < a.i) GROUP BY a.t, a.i) SELECT i AS item, count(*) AS support, count(DISTINCT path) AS paths FROM q GROUP BY i",
    "pagerank_adj_n": _pagerank_sql(False),
    "pagerank_graph_n": _pagerank_sql(True),
    "inner_join_links": f"WITH {_TRADE} SELECT e.dst, count(*) AS n, round(sum(CAST(1.0 AS DOUBLE) / g.deg), 6) AS received FROM e JOIN g ON e.src = g.src GROUP BY e.dst",
    "components": f"{_COMPONENTS} SELECT id, component FROM c",
    "component_sizes": f"{_COMPONENTS} SELECT component, count(*) AS n FROM c GROUP BY component",
    "graph_counts": f"{_COMPONENTS} SELECT count(*) AS n_vertices, count(DISTINCT component) AS n_components FROM c",
    "kmeans_assign": _kmeans_sql(f"SELECT vec_id, cluster, round(d, 6) AS distance2 FROM n{LLOYD_ROUNDS}"),
    "kmeans_sse": _kmeans_sql(f"SELECT round(sum(d), 6) AS sse FROM n{LLOYD_ROUNDS}"),
    "kmeans_centers": _kmeans_sql(f"SELECT cluster, CAST(i - 1 AS INTEGER) AS i, round(v, 6) AS v FROM u{LLOYD_ROUNDS - 1}"),
    "vector_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * v))), 6) AS norm FROM embeddings",
    "key_sort": "SELECT event_type AS key, count(*) AS n FROM events GROUP BY event_type ORDER BY event_type",
    "byte_count_per_key": "SELECT event_type AS key, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS bytes FROM events GROUP BY event_type",
    "sample_hash": "SELECT doc_id, source FROM documents WHERE CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 6) AS BIGINT) % 100 < 10",
    "task_skewness": "SELECT event_type, round(CASE WHEN avg(n) = 0 THEN 1 ELSE max(n) / avg(n) END, 6) AS skew FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY event_type, user_id) GROUP BY event_type",
    "task_correlation": "SELECT event_type, round(coalesce(corr(n, bytes), 0), 6) AS corr FROM (SELECT event_type, user_id, count(*) AS n, sum(length(props)) AS bytes FROM events GROUP BY event_type, user_id) GROUP BY event_type",
}
