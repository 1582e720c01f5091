"""Graph, tree, catalogue, sequence and audit queries on the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from stemma.functions import text as T
from stemma.operators import catalog, graph, tables, tree

SQL: dict[str, str] = {}
NOT_QUERIES = ("hierarchy",)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Catalogue


def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.facets(_read(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


SQL["facet_counts"] = """SELECT CASE WHEN grouping(p_brand) = 0 THEN 'p_brand' WHEN grouping(p_type) = 0 THEN 'p_type' ELSE 'p_size' END AS facet,
  coalesce(CASE WHEN grouping(p_brand) = 0 THEN p_brand WHEN grouping(p_type) = 0 THEN p_type ELSE p_size::VARCHAR END, '(none)') AS value, count(*) AS n
FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), (p_size))"""


def catalog_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (_read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return catalog.rollup(rows, ["r_name", "n_name", "c_mktsegment"], {"n": F.count("*"), "balance": F.round(F.sum("c_acctbal"), 2)}).withColumn("depth", F.col("depth").cast("int"))


SQL["catalog_rollup"] = """SELECT r_name, n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance, (3 - grouping(r_name) - grouping(n_name) - grouping(c_mktsegment))::INT AS depth
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)"""


def filter_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part").where((F.col("p_type") == "ECONOMY") & F.contains("p_name", F.lit("ring")))
    return catalog.page(rows, [F.col("p_retailprice").desc(), F.col("p_partkey")], 3, 5).select("p_partkey", "p_name", "rank", "total", "has_more")


SQL["filter_paged"] = """WITH f AS (SELECT * FROM part WHERE p_type = 'ECONOMY' AND contains(p_name, 'ring')), r AS (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey)::INT AS rank, count(*) OVER () AS total FROM f)
SELECT p_partkey, p_name, rank, total, total > 8 AS has_more FROM r WHERE rank > 3 AND rank <= 8"""


def range_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part").where(F.col("p_size").between(5, 9))
    order = W.partitionBy("p_size").orderBy(T.natural_key(F.col("p_brand")), "p_partkey")
    return rows.select("p_partkey", "p_brand", "p_size", F.row_number().over(order).alias("nth"))


SQL["range_articles"] = "SELECT p_partkey, p_brand, p_size, row_number() OVER (PARTITION BY p_size ORDER BY regexp_extract(p_brand, '[0-9]+')::INT, p_partkey)::INT AS nth FROM part WHERE p_size BETWEEN 5 AND 9"


def batch_lookup_with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame(list(enumerate([7, 3, -1, 99, 7, 123456789])), "nth long, p_partkey long")
    return catalog.batch(asked, _read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")


SQL["batch_lookup_with_missing"] = "SELECT nth::BIGINT AS nth, k::BIGINT AS p_partkey, p_name, p_name IS NOT NULL AS found FROM (VALUES (0, 7), (1, 3), (2, -1), (3, 99), (4, 7), (5, 123456789)) AS a(nth, k) LEFT JOIN part ON p_partkey = k"


# Edges


def citation_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"), F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("first_supplier"))


SQL["citation_aggregate"] = "SELECT l_orderkey, l_partkey, sum(l_quantity) AS quantity, count(*) AS n, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS first_supplier FROM lineitem GROUP BY l_orderkey, l_partkey"


def cited_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    counts = rows.groupBy("l_partkey").agg(F.count("*").alias("lines"), F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("o_custkey").alias("customers"))
    return counts.orderBy(F.col("orders").desc(), F.col("lines").desc(), "l_partkey").limit(20)


SQL["cited_by_rank"] = "SELECT l_partkey, count(*) AS lines, count(DISTINCT l_orderkey) AS orders, count(DISTINCT o_custkey) AS customers FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey ORDER BY orders DESC, lines DESC, l_partkey LIMIT 20"


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _read(spark, sf_dir, "lineitem")
    return l.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("lawref").alias("type"), F.lit(0.5).alias("weight"), F.struct("l_linenumber", "l_suppkey", "l_quantity").alias("seq"))


def edges_lawref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dedupe(_citations(spark, sf_dir)).groupBy("src", "type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


SQL["edges_lawref"] = "SELECT 'o' || l_orderkey AS src, 'lawref' AS type, count(DISTINCT l_partkey) AS n, count(DISTINCT l_partkey) * 0.5::DOUBLE AS weight FROM lineitem GROUP BY l_orderkey"


def edge_dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier and part of a line in either direction by parity; the first line of an order keeps the pair."""
    l = _read(spark, sf_dir, "lineitem")
    a, b = F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey")
    turned = F.col("l_orderkey") % 2 == 0
    rows = l.select(F.when(turned, a).otherwise(b).alias("src"), F.when(turned, b).otherwise(a).alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_quantity").alias("weight"), F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").alias("seq"))
    return graph.dedupe(rows)


SQL["edge_dedupe_first_wins"] = """SELECT CASE WHEN l_orderkey % 2 = 0 THEN 's' || l_suppkey ELSE 'p' || l_partkey END AS src, CASE WHEN l_orderkey % 2 = 0 THEN 'p' || l_partkey ELSE 's' || l_suppkey END AS dst, l_returnflag AS type, l_quantity AS weight
FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) = 1"""


def edges_colaw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pairs_within(_read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey").where("share >= 2")


_PAIRS = """g AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), s AS (SELECT l_orderkey FROM g GROUP BY 1 HAVING count(*) BETWEEN 2 AND 6), m AS (SELECT g.* FROM g SEMI JOIN s USING (l_orderkey)),
pairs AS (SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS share FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY ALL)"""
SQL["edges_colaw_pairs"] = f"WITH {_PAIRS} SELECT * FROM pairs WHERE share >= 2"


def term_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = graph.pairs_within(_read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")
    return pairs.groupBy("share").agg(F.count("*").alias("pairs"))


SQL["term_cooccurrence"] = f"WITH {_PAIRS} SELECT share, count(*) AS pairs FROM pairs GROUP BY share"


def cooccurrence_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _read(spark, sf_dir, "lineitem")
    df = l.groupBy(F.col("l_partkey").alias("id")).agg(F.count_distinct("l_orderkey").alias("df"))
    return graph.quota(graph.pairs_within(l, "l_orderkey", "l_partkey"), df)


SQL["cooccurrence_quota"] = f"""WITH {_PAIRS}, df AS (SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS df FROM lineitem GROUP BY 1),
sides AS (SELECT a AS own, b AS other, share FROM pairs UNION ALL SELECT b, a, share FROM pairs),
r AS (SELECT own, other, share, row_number() OVER (PARTITION BY own ORDER BY share DESC, df DESC, other) AS rank, max(share) OVER (PARTITION BY own) AS top FROM sides JOIN df ON other = id)
SELECT DISTINCT least(own, other) AS a, greatest(own, other) AS b, share, round(least(share, 5) / 5.0::DOUBLE * 0.7::DOUBLE, 3) AS weight FROM r WHERE (share >= 2 AND rank <= 8) OR (top < 2 AND rank = 1)"""


def termref_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.sum("l_quantity").alias("weight"))
    return graph.top_per_key(rows, "l_partkey", [F.col("weight").desc(), F.col("l_orderkey")], 5)


SQL["termref_topn"] = "WITH s AS (SELECT l_partkey, l_orderkey, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL) SELECT *, CAST(row_number() OVER w AS INT) AS rank FROM s WINDOW w AS (PARTITION BY l_partkey ORDER BY weight DESC, l_orderkey) QUALIFY rank <= 5"


# Trees


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent, id of region > nation > customer > order."""
    n, c, o = (_read(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    key = lambda p, x: F.concat(F.lit(p), F.col(x))
    return n.select(key("r", "n_regionkey").alias("parent"), key("n", "n_nationkey").alias("id")).unionByName(c.select(key("n", "c_nationkey").alias("parent"), key("c", "c_custkey").alias("id"))).unionByName(o.select(key("c", "o_custkey").alias("parent"), key("o", "o_orderkey").alias("id")))


_TREE = "h AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"


def tree_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hierarchy(spark, sf_dir)
    return tree.descendants(h, spark.createDataFrame([("r0",), ("n7",)], "id string"), 3)


SQL["tree_descendants"] = f"WITH RECURSIVE {_TREE}, d(id, depth, path) AS (SELECT * FROM (VALUES ('r0', 0, 'r0'), ('n7', 0, 'n7')) UNION ALL SELECT h.id, depth + 1, path || '/' || h.id FROM d JOIN h ON h.parent = d.id WHERE depth < 3) SELECT id, depth::INT AS depth, path FROM d"


def tree_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.ancestors(hierarchy(spark, sf_dir), 3).select("id", F.array_join("chain", " › ").alias("breadcrumb"))


SQL["tree_ancestors"] = f"WITH RECURSIVE {_TREE}, d(id, top, crumb) AS (SELECT id, parent, parent FROM h UNION ALL SELECT d.id, h.parent, h.parent || ' › ' || crumb FROM d JOIN h ON h.id = d.top) SELECT id, crumb AS breadcrumb FROM d WHERE starts_with(top, 'r')"


def tree_children_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.children_in_order(hierarchy(spark, sf_dir)).select("parent", F.array_join("children", ",").alias("children"))


SQL["tree_children_ordered"] = f"WITH {_TREE} SELECT parent, string_agg(id, ',' ORDER BY substr(id, 2)::BIGINT) AS children FROM h GROUP BY parent"


def leaf_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.leaves(hierarchy(spark, sf_dir))


SQL["leaf_inner"] = f"WITH {_TREE} SELECT DISTINCT id, id NOT IN (SELECT parent FROM h) AS is_leaf FROM h"


def degree_and_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = hierarchy(spark, sf_dir).select(F.col("parent").alias("src"), F.col("id").alias("dst"))
    hubs = graph.degree(edges).withColumn("size", F.round(F.least(F.lit(13.0), 4 + 0.3 * F.sqrt("degree")), 6))
    return hubs.orderBy(F.col("degree").desc(), "id").limit(120)


SQL["degree_and_hub"] = f"WITH {_TREE}, e AS (SELECT parent AS id FROM h UNION ALL SELECT id FROM h) SELECT id, count(*) AS degree, round(least(13.0, 4 + 0.3 * sqrt(count(*))), 6) AS size FROM e GROUP BY id ORDER BY degree DESC, id LIMIT 120"


def khop_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = hierarchy(spark, sf_dir).select(F.col("parent").alias("src"), F.col("id").alias("dst"))
    return graph.neighbourhood(edges, F.lit("n3"), 3)


SQL["khop_neighbourhood"] = f"""WITH RECURSIVE {_TREE}, e AS (SELECT parent AS s, id AS d FROM h), b AS (SELECT s, d FROM e UNION SELECT d, s FROM e),
k(id, depth) AS (SELECT 'n3', 0 UNION SELECT d, depth + 1 FROM k JOIN b ON s = id WHERE depth < 3) SELECT id, min(depth)::INT AS depth FROM k GROUP BY id"""


def merge_chain_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part merges into the part of the next number, hundred by hundred; 3 and 7 into each other."""
    p = _read(spark, sf_dir, "part").where("p_partkey % 100 <> 99").select(F.col("p_partkey").alias("src"), F.expr("CASE p_partkey WHEN 3 THEN 7 WHEN 7 THEN 3 ELSE p_partkey + 1 END").alias("dst"))
    return graph.chains(p)


SQL["merge_chain_resolution"] = """WITH RECURSIVE m AS (SELECT p_partkey AS src, CASE p_partkey WHEN 3 THEN 7 WHEN 7 THEN 3 ELSE p_partkey + 1 END AS dst FROM part WHERE p_partkey % 100 <> 99),
c(src, dst, n) AS (SELECT src, dst, 1 FROM m UNION ALL SELECT c.src, m.dst, n + 1 FROM c JOIN m ON m.src = c.dst WHERE n < 120)
SELECT src, dst::BIGINT AS dst FROM c WHERE dst NOT IN (SELECT src FROM m)"""


# Sequences


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations")


def reading_prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).groupBy("role", "conv_id").agg(F.count("*").alias("turns"))
    return tree.neighbours(rows, "conv_id", [F.col("turns").desc(), F.col("conv_id")], ["role"])


SQL["reading_prev_next"] = "WITH r AS (SELECT role, conv_id, count(*) AS turns FROM conversations GROUP BY ALL) SELECT *, lag(conv_id) OVER w AS prev_id, lead(conv_id) OVER w AS next_id FROM r WINDOW w AS (PARTITION BY role ORDER BY turns DESC, conv_id)"


def prev_next_same_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).select("conv_id", "turn", "role")
    return tree.neighbours(rows, "turn", [F.col("turn")], ["conv_id"], book="role")


SQL["prev_next_same_group"] = "SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w = role THEN lag(turn) OVER w END AS prev_id, CASE WHEN lead(role) OVER w = role THEN lead(turn) OVER w END AS next_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"


def span_own_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).select("conv_id", "turn", F.expr("CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END").alias("level"))
    return tree.spans(rows, "conv_id", "turn", "level", 3)


SQL["span_own_full"] = """WITH r AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level FROM conversations)
SELECT conv_id, turn, level, (SELECT min(turn) FROM r y WHERE y.conv_id = x.conv_id AND y.turn > x.turn) AS own_end, (SELECT min(turn) FROM r y WHERE y.conv_id = x.conv_id AND y.turn > x.turn AND y.level <= x.level) AS full_end FROM r x"""


def sequence_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.gaps(_turns(spark, sf_dir), "conv_id", "turn", 0)


SQL["sequence_continuity"] = "SELECT conv_id, count(*) AS n, count(DISTINCT turn) = count(*) AND min(turn) = 0 AND max(turn) = count(*) - 1 AS contiguous FROM conversations GROUP BY conv_id"


def forward_fill_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir)
    return tables.filled(rows, "conv_id", "turn", F.when(F.col("role") == "user", F.length("text")), "asked").select("conv_id", "turn", F.col("asked").cast("long").alias("asked"))


SQL["forward_fill_role"] = "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations"


def sliding_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.best_window(_turns(spark, sf_dir), "conv_id", "turn", F.length("text"), 3)


SQL["sliding_argmax"] = "WITH s AS (SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS BIGINT) AS total FROM conversations) SELECT conv_id, turn AS start, total FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY total DESC, turn DESC) = 1"


# Pages


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("dst"))


_LINKS = "links AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dst FROM pages)"


def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir)


SQL["link_extract"] = f"WITH {_LINKS} SELECT page_id, dst FROM links"


def backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).groupBy("dst").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


SQL["backlinks"] = f"WITH {_LINKS} SELECT dst, count(*) AS n, min(page_id) AS first_page FROM links GROUP BY dst"

_PATH = r"^[a-z]+://[^/?#]*(/[^?#]*)"


def dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to paths of which no page has the first segment."""
    first = F.regexp_extract("url", r"^[a-z]+://[^/?#]*/([^/?#]*)", 1)
    there = _read(spark, sf_dir, "pages").select(F.concat(F.lit("/"), first).alias("dst")).distinct()
    return _links(spark, sf_dir).join(there, "dst", "left_anti").groupBy("page_id").agg(F.count("*").alias("n"), F.min("dst").alias("sample"))


SQL["dangling_links"] = f"WITH {_LINKS}, t AS (SELECT DISTINCT '/' || regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]*)', 1) AS dst FROM pages) SELECT page_id, count(*) AS n, min(dst) AS sample FROM links ANTI JOIN t USING (dst) GROUP BY page_id"


def url_prefix_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "")
    return tree.by_prefix(_read(spark, sf_dir, "pages").select(bare.alias("path")), "path")


SQL["url_prefix_folders"] = r"WITH p AS (SELECT string_split(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '/') AS s FROM pages) SELECT array_to_string(s[1:i], '/') AS folder, count(*) AS n FROM p, unnest(range(1, greatest(len(s), 2))) AS t(i) GROUP BY folder"


def slugify_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


SQL["slugify_urls"] = r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '\s', '-', 'g'), '&', '-and-', 'g'), '%', '-percent', 'g'), '[?#]', '', 'g'), '^/+|/+$', '', 'g') AS slug FROM pages"


def html_entities_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemma.functions import python

    return _read(spark, sf_dir, "pages").select("page_id", python.decode_entities_udf()(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("title"))


# the ampersand last, so that what it makes isn't decoded again
SQL["html_entities_titles"] = "SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS title FROM pages"


# Vectors


def similar_missing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    pairs = tables.similar_pairs(e, "vec_id", "embedding", 0.35)
    label = lambda c: e.select(F.col("vec_id").alias(c), F.col("label").alias(f"label_{c}"))
    return pairs.join(label("a"), "a").join(label("b"), "b").where("label_a <> label_b").select("a", "b", F.round("cosine", 4).alias("cosine"))


_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, sqrt(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))) AS n FROM embeddings)"
SQL["similar_missing_links"] = f"WITH {_UNIT} SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.v, y.v) / (x.n * y.n), 4) AS cosine FROM u x JOIN u y ON x.vec_id < y.vec_id AND x.label <> y.label WHERE list_dot_product(x.v, y.v) / (x.n * y.n) >= 0.35"


def similarity_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the cosine of neighbouring vectors, by whether their labels agree."""
    e = _read(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("other_label"))
    unit = lambda a, b: T.cosine(F.col(a), F.col(b)) / F.sqrt(T.cosine(F.col(a), F.col(a)) * T.cosine(F.col(b), F.col(b)))
    rows = e.join(nxt, "vec_id").select((F.col("label") == F.col("other_label")).alias("same"), F.round(unit("embedding", "other"), 5).alias("cosine"))
    return tables.quantiles(rows, "same", "cosine", [0.1, 0.5, 0.9])


SQL["similarity_quantiles"] = f"""WITH {_UNIT}, c AS (SELECT x.label = y.label AS same, round(list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v)), 5) AS cosine FROM u x JOIN u y ON y.vec_id = x.vec_id + 1),
r AS (SELECT *, row_number() OVER (PARTITION BY same ORDER BY cosine) - 1 AS i, count(*) OVER (PARTITION BY same) AS n FROM c)
SELECT same, any_value(n) AS n, max(CASE WHEN i = least(n - 1, floor(n * 0.1)) THEN cosine END) AS p10, max(CASE WHEN i = least(n - 1, floor(n * 0.5)) THEN cosine END) AS p50, max(CASE WHEN i = least(n - 1, floor(n * 0.9)) THEN cosine END) AS p90 FROM r GROUP BY same"""


def representatives_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_per_key(_read(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 2).select("c_nationkey", "c_mktsegment", "c_custkey", "rank")


SQL["representatives_per_group"] = "SELECT c_nationkey, c_mktsegment, c_custkey, CAST(row_number() OVER w AS INT) AS rank FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) QUALIFY rank <= 2"


# Votes, updates, samples


def majority_vote_tie_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.majority(_read(spark, sf_dir, "events"), "user_id", "event_type")


SQL["majority_vote_tie_null"] = "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT user_id, max(n) AS votes FROM c GROUP BY user_id) SELECT user_id, CASE WHEN count(*) = 1 THEN any_value(event_type) END AS winner, votes FROM c JOIN m USING (user_id) WHERE n = votes GROUP BY user_id, votes"


def mode_and_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.heaviest(_read(spark, sf_dir, "events"), "user_id", "event_type", F.round(F.sum("value"), 4))


SQL["mode_and_argmax"] = "WITH s AS (SELECT user_id, event_type, round(sum(value), 4) AS weight FROM events GROUP BY ALL) SELECT user_id, event_type, weight FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, event_type) = 1"


def last_writer_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    old = tables.first_of(e.where("event_id % 2 = 0"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()])
    new = tables.first_of(e.where("event_id % 2 = 1"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()])
    return tables.upsert(old, new, ["user_id", "event_type"], "ts", F.col("value") > 0).select("user_id", "event_type", "event_id", "value")


SQL["last_writer_wins"] = """WITH n AS (SELECT *, event_id % 2 AS new FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, event_id % 2 ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, event_type, event_id, value FROM n WHERE new = 0 OR value > 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, new) = 1"""


def json_prop_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return _read(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


SQL["json_prop_project"] = "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n, CAST(sum(round(value * 100)) AS BIGINT) AS cents FROM events GROUP BY 1"


def verdict_conflict_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, lang) pairs: their verdicts; black only if all agree on bad."""
    rows = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents"), "doc_id")
    got = rows.groupBy("source", "lang").agg(F.array_sort(F.collect_set("quality")).alias("v"), F.sum("toxic").alias("toxic"))
    return got.select("source", "lang", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("verdicts"), "toxic", (F.col("v") == F.array(F.lit(0))).alias("black"))


SQL["verdict_conflict_blacklist"] = "SELECT source, lang, string_agg(DISTINCT quality::VARCHAR, ',' ORDER BY quality::VARCHAR) AS verdicts, sum(toxic)::BIGINT AS toxic, max(quality) = 0 AS black FROM labels JOIN documents USING (doc_id) GROUP BY source, lang"


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.every(_read(spark, sf_dir, "documents"), "lang", "doc_id", 10, ["es"]).select("doc_id", "lang")


SQL["stratified_sample"] = "SELECT doc_id, lang FROM documents QUALIFY lang = 'es' OR (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 10 = 0"


def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.round_robin(_read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 50)


SQL["round_robin_sample"] = "SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS turn FROM documents ORDER BY turn, source LIMIT 50"


def anti_join_superset(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"))
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))
    return tables.difference(c, o, ["custkey"])


SQL["anti_join_superset"] = "SELECT c_custkey AS custkey, 'lost' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'added' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"


def unique_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").select("c_custkey", F.array(F.concat("c_mktsegment", F.lit(" "), F.round("c_acctbal", 0).cast("long").cast("string"))).alias("aliases"))
    return tables.unique_values(rows, "c_custkey", "aliases")


SQL["unique_aliases"] = "SELECT any_value(c_custkey) AS c_custkey, c_mktsegment || ' ' || round(c_acctbal, 0)::BIGINT AS value FROM customer GROUP BY value HAVING count(*) = 1"


def field_overlap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers none of whose parts' types is wanted are hidden."""
    rows = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sets = rows.groupBy("l_suppkey").agg(F.array_sort(F.collect_set("p_brand")).alias("fields"))
    return sets.select("l_suppkey", F.size("fields").cast("long").alias("n"), F.coalesce(F.arrays_overlap("fields", F.array(F.lit("Brand#1"), F.lit("Brand#2"))), F.lit(False)).alias("visible"))


SQL["field_overlap_filter"] = "SELECT l_suppkey, count(DISTINCT p_brand) AS n, list_has_any(list(DISTINCT p_brand), ['Brand#1', 'Brand#2']) AS visible FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey"
