"""References, cascades, edges, browsing and articles on the driver tables and on literal rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stemma.functions import text as T
from stemma.operators import articles, browse, graph, linking

SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _values(rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


PREFIXES = [("red", "colour"), ("red w", "red things"), ("red widget", "red widgets"), ("old", "age"), ("hot", "heat"), ("hot r", "hot things"), ("small", "size")]


def longest_prefix_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.longest_prefix(_read(spark, sf_dir, "part"), "p_name", spark.createDataFrame(PREFIXES, "prefix string, value string"), "p_partkey")


SQL["longest_prefix_topic"] = f"SELECT p_partkey AS id, value FROM part JOIN ({_values(PREFIXES)}) AS m(prefix, value) ON starts_with(p_name, prefix) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC) = 1"


def cascade_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's only order of status P, else the only urgent one, else the only one at all."""
    o = _read(spark, sf_dir, "orders")
    pick = lambda cond: o.where(cond).select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("target"))
    return linking.cascade(_read(spark, sf_dir, "customer"), "c_custkey", [pick("o_orderstatus = 'P'"), pick("o_orderpriority = '1-URGENT'"), pick("true")])


SQL["cascade_resolution"] = """WITH s AS (SELECT o_custkey AS id, o_orderkey AS target, 0 AS step FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_custkey, o_orderkey, 2 FROM orders),
u AS (SELECT id, step, min(target) AS target FROM s GROUP BY id, step HAVING count(DISTINCT target) = 1), b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY step) = 1)
SELECT c_custkey AS id, target, coalesce(step, -1) AS step FROM customer LEFT JOIN b ON c_custkey = id"""


def truncated_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as codes: an order refers to the only customer-day, month or year node of its date, or to that of its status."""
    o = _read(spark, sf_dir, "orders")
    code = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 1000
    nodes = o.where("o_orderkey % 1000 < 3").select(F.col("o_orderkey").alias("id"), F.when(k == 0, code("yyyy")).when(k == 1, code("yyyy.MM")).otherwise(code("yyyy.MM.dd")).alias("code"), F.col("o_orderstatus").alias("label"))
    refs = o.select(F.col("o_orderkey").alias("ref"), code("yyyy.MM.dd").alias("code"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("label"))
    return linking.truncated(refs, nodes)


SQL["truncated_code"] = """WITH n AS (SELECT o_orderkey AS id, left(strftime(o_orderdate, '%Y.%m.%d'), CASE o_orderkey % 1000 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 10 END) AS code, o_orderstatus AS label FROM orders WHERE o_orderkey % 1000 < 3),
r AS (SELECT o_orderkey AS ref, i, left(strftime(o_orderdate, '%Y.%m.%d'), CASE i WHEN 1 THEN 4 WHEN 2 THEN 7 ELSE 10 END) AS code, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS label FROM orders, (VALUES (1), (2), (3)) AS t(i)),
a AS (SELECT code, min(id) AS node FROM n GROUP BY code HAVING count(*) = 1), b AS (SELECT code, label, min(id) AS node FROM n GROUP BY code, label HAVING count(*) = 1)
SELECT ref, r.code, coalesce(a.node, b.node) AS node FROM r LEFT JOIN a ON r.code = a.code LEFT JOIN b ON r.code = b.code AND r.label = b.label WHERE coalesce(a.node, b.node) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ref ORDER BY i DESC) = 1"""


def scoped_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The only part of a size within brand and type, else within the brand, else of all."""
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("number"), F.concat_ws("/", "p_brand", "p_type").alias("chapter"), F.col("p_brand").alias("part"), F.lit("all").alias("domain"))
    return linking.scoped(p.withColumnRenamed("id", "ref"), p, ["chapter", "part", "domain"])


SQL["scoped_reference"] = """WITH p AS (SELECT p_partkey AS ref, min(p_partkey) OVER a AS na, count(*) OVER a AS ka, min(p_partkey) OVER b AS nb, count(*) OVER b AS kb, min(p_partkey) OVER c AS nc, count(*) OVER c AS kc FROM part
  WINDOW a AS (PARTITION BY p_brand, p_type, p_size), b AS (PARTITION BY p_brand, p_size), c AS (PARTITION BY p_size))
SELECT ref, CASE WHEN ka = 1 THEN na WHEN kb = 1 THEN nb ELSE nc END AS node, CASE WHEN ka = 1 THEN 0 WHEN kb = 1 THEN 1 ELSE 2 END AS scope FROM p WHERE ka = 1 OR kb = 1 OR kc = 1"""


def own_law_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers occur in orders; the parts of those orders that are of the supplier's own class."""
    l = _read(spark, sf_dir, "lineitem")
    occurrences = l.select(F.col("l_suppkey").alias("term"), F.col("l_orderkey").alias("node"))
    citations = l.select(F.col("l_orderkey").alias("node"), (F.col("l_partkey") % 10).alias("law"), F.col("l_partkey").alias("cite"))
    laws = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("term"), (F.col("s_suppkey") % 10).alias("law"))
    return linking.own_citations(occurrences, citations, laws).select("term", "node", F.array_join(F.transform("cites", lambda x: x.cast("string")), ",").alias("cites"))


SQL["own_law_citations"] = """WITH x AS (SELECT DISTINCT o.l_suppkey AS term, o.l_orderkey AS node, c.l_partkey AS cite FROM lineitem o JOIN lineitem c USING (l_orderkey) WHERE c.l_partkey % 10 = o.l_suppkey % 10 AND o.l_suppkey IN (SELECT s_suppkey FROM supplier))
SELECT term, node, string_agg(cite::VARCHAR, ',' ORDER BY cite) AS cites FROM x GROUP BY ALL"""


def peers_of_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    degree = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("degree"))
    members = c.join(degree, "c_custkey", "left").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("domain"), F.array("c_mktsegment").alias("topics"), F.coalesce("degree", F.lit(0)).alias("degree"))
    return linking.topic_peers(members, c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") + 7).alias("peer")))


SQL["peers_of_topic"] = """WITH m AS (SELECT c_custkey AS id, c_nationkey AS domain, c_mktsegment AS topic, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS degree FROM customer),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY topic, domain ORDER BY degree DESC, id) <= 2),
p AS (SELECT m.id, b.id AS peer, b.degree FROM m JOIN b ON m.topic = b.topic AND m.domain <> b.domain WHERE b.id <> m.id + 7)
SELECT id, peer, CAST(row_number() OVER w AS INT) AS rank FROM p WINDOW w AS (PARTITION BY id ORDER BY degree DESC, peer) QUALIFY rank <= 24"""

REFERRING = [("a", 2, "参见本部分第三章第2.1.3节和第四部分第十二章"), ("b", 1, "见第二部分第一章的3.2节。第三章"), ("c", 1, "第五条不是引用"), ("d", 3, "")]
REFERRED = [("a", 2, 3, "2.1.3"), ("a", 4, 12, None), ("b", 2, 1, "3.2"), ("b", 1, 3, None)]


def cross_references_cn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.cross_references(spark.createDataFrame(REFERRING, "id string, part int, text string"))


SQL["cross_references_cn"] = f"SELECT src, part, chapter, code FROM ({_values(REFERRED)}) AS t(src, part, chapter, code)"


def xref_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts refer by brand, size and a code to sections of the code, the one above or the chapter."""
    p = _read(spark, sf_dir, "part")
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    code = F.when(F.col("p_partkey") % 4 > 0, F.concat_ws(".", (F.col("p_partkey") % 4).cast("string"), (F.col("p_partkey") % 3).cast("string")))
    refs = p.select(F.concat(F.lit("p"), "p_partkey").alias("src"), number.alias("part"), (F.col("p_size") % 5).alias("chapter"), code.alias("code"))
    grid = spark.range(1, 26).select(F.col("id").cast("int").alias("part")).crossJoin(spark.range(5).select(F.col("id").cast("int").alias("chapter")))  # 125 chapters
    nodes = grid.select("part", "chapter", F.explode(F.array(F.lit(None).cast("string"), F.lit("1"), F.lit("2.1"), F.lit("2.2"))).alias("code")).select(F.concat_ws("-", F.lit("n"), "part", "chapter", "code").alias("id"), "part", "chapter", "code")
    hierarchy = p.where("p_partkey % 11 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("src"), F.concat_ws("-", F.lit("n"), number, F.col("p_size") % 5).alias("dst"))
    return linking.reference_edges(refs, nodes, hierarchy)


SQL["xref_edges"] = """WITH r AS (SELECT 'p' || p_partkey AS src, regexp_extract(p_brand, '([0-9]+)', 1) AS part, p_size % 5 AS chapter, p_partkey % 4 AS a, p_partkey % 3 AS b, p_partkey FROM part),
e AS (SELECT src, p_partkey, 'n-' || part || '-' || chapter AS chap, CASE WHEN a = 1 THEN '-1' WHEN a = 2 AND b IN (1, 2) THEN '-2.' || b END AS sec FROM r)
SELECT src, chap || coalesce(sec, '') AS dst, 'xref' AS type, CASE WHEN sec IS NULL THEN 0.45 ELSE 0.6 END::DOUBLE AS weight FROM e WHERE sec IS NOT NULL OR p_partkey % 11 <> 0"""


def edges_all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchy of nations and customers, references of customers to parts they buy, parts that are bought together."""
    c, o, l = (_read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    key = lambda p, x: F.concat(F.lit(p), F.col(x))
    tree = c.select(key("n", "c_nationkey").alias("parent"), key("c", "c_custkey").alias("id"))
    bought = o.join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    terms = linking.term_edges(bought.select(key("p", "l_partkey").alias("term"), key("c", "o_custkey").alias("node"), (F.col("l_quantity") > 40).alias("defined")), graph.degree(tree.select(F.col("parent").alias("src"), F.col("id").alias("dst"))), 5)
    pairs = graph.pairs_within(l, "l_orderkey", "l_partkey").where("share >= 2").select(key("p", "a").alias("src"), key("p", "b").alias("dst"))
    nodes = tree.select("id").unionByName(c.select(key("n", "c_nationkey").alias("id")).distinct()).unionByName(_read(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(key("p", "p_partkey").alias("id")))
    edges = linking.all_edges([linking.hierarchy_edges(tree), terms, linking.typed(pairs, "colaw", 0.3)], nodes)
    return edges.groupBy("type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


SQL["edges_all_types"] = """WITH g AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), s AS (SELECT l_orderkey FROM g GROUP BY 1 HAVING count(*) BETWEEN 2 AND 6), m AS (SELECT g.* FROM g SEMI JOIN s USING (l_orderkey)),
pairs AS (SELECT x.l_partkey AS a, y.l_partkey AS b FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY ALL HAVING count(*) >= 2),
d AS (SELECT 'c' || c_custkey AS id FROM customer),
t AS (SELECT l_partkey, o_custkey, CASE WHEN max(l_quantity) > 40 THEN 1.0 ELSE 0.6 END AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY weight DESC, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN 1 ELSE 0 END DESC, 'c' || o_custkey) <= 5)
SELECT 'hierarchy' AS type, count(*) AS n, round(count(*)::DOUBLE, 4) AS weight FROM customer
UNION ALL SELECT 'termref', count(*), round(sum(weight)::DOUBLE, 4) FROM k WHERE l_partkey % 5 <> 0 AND l_partkey IN (SELECT p_partkey FROM part) AND o_custkey IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'colaw', count(*), round(count(*) * 0.3::DOUBLE, 4) FROM pairs WHERE a % 5 <> 0 AND b % 5 <> 0 AND a IN (SELECT p_partkey FROM part) AND b IN (SELECT p_partkey FROM part)"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("term"), F.col("event_type").alias("node"), F.when(v > 90, "defined").otherwise("used").alias("role"), F.when(v > 60, "high").when(v > 20, "mid").otherwise("low").alias("confidence"), F.concat(F.lit("e"), "event_id", "props").alias("text"), F.date_format("ts", "yyyy-MM-dd").alias("chunk"))


_EVIDENCE = "e AS (SELECT user_id AS term, event_type AS node, CASE WHEN value > 90 THEN 'defined' ELSE 'used' END AS role, CASE WHEN value > 60 THEN 'high' WHEN value > 20 THEN 'mid' ELSE 'low' END AS confidence, CASE WHEN value > 60 THEN 0 WHEN value > 20 THEN 1 ELSE 2 END AS rank, 'e' || event_id || props AS text, strftime(ts, '%Y-%m-%d') AS chunk FROM events)"


def evidence_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.best_evidence(_evidence(spark, sf_dir))


SQL["evidence_pick"] = f"WITH {_EVIDENCE} SELECT term, node, role, confidence, text FROM e QUALIFY row_number() OVER (PARTITION BY term, node ORDER BY role <> 'defined', rank, length(text) DESC, text) = 1"


def definition_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evidence(spark, sf_dir).where("role = 'defined'").select("*", F.col("node").alias("field"), F.lit("purchase").alias("main_field"), F.lit("click").alias("preferred"))
    best = rows.groupBy("term", "chunk", "confidence", "field", "main_field", "node", "preferred").agg(F.min("text").alias("text"))
    return linking.best_definition(best.where("chunk <> ''")).select("term", "chunk", F.length("text").cast("long").alias("size"))


SQL["definition_pick"] = f"""WITH {_EVIDENCE}, d AS (SELECT term, chunk, node, rank, min(text) AS text FROM e WHERE role = 'defined' GROUP BY ALL)
SELECT term, chunk, length(text) AS size FROM d QUALIFY row_number() OVER (PARTITION BY term ORDER BY rank, node <> 'purchase', node <> 'click', length(text) DESC, chunk) = 1"""


def _supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_returnflag").alias("type"))


def top_polluters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _supply(spark, sf_dir)
    return linking.polluters(e, e.where("type = 'R'"))


SQL["top_polluters"] = """WITH e AS (SELECT 's' || l_suppkey AS id, l_returnflag AS f FROM lineitem UNION ALL SELECT 'p' || l_partkey, l_returnflag FROM lineitem)
SELECT id, count(*) FILTER (f = 'R') AS bad, count(*) AS degree, round(count(*) FILTER (f = 'R') / count(*)::DOUBLE, 4) AS share FROM e GROUP BY id ORDER BY bad DESC, share DESC, id LIMIT 25"""


def degree_without_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _supply(spark, sf_dir)
    black = e.where("type = 'R'").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return linking.without(e, black)[1]


SQL["degree_without_blacklist"] = """WITH k AS (SELECT * FROM lineitem x WHERE NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_suppkey = x.l_suppkey AND y.l_partkey = x.l_partkey AND y.l_returnflag = 'R'))
SELECT id, count(*) AS degree FROM (SELECT 's' || l_suppkey AS id FROM k UNION ALL SELECT 'p' || l_partkey FROM k) GROUP BY id"""


def faulty_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("src"), (F.col("o_orderkey") % 50).alias("dst"), F.col("o_orderstatus").alias("type"))
    return linking.faulty(rows)


SQL["faulty_edges"] = """SELECT least(o_custkey % 50, o_orderkey % 50) AS a, greatest(o_custkey % 50, o_orderkey % 50) AS b, o_orderstatus AS type, count(*) AS n, CASE WHEN a = b THEN 'loop' ELSE 'repeated' END AS fault
FROM orders GROUP BY a, b, o_orderstatus HAVING a = b OR n > 1"""


def carry_over_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a segment of their own take that of the supplier of their number."""
    new = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("label"), F.col("c_nationkey").alias("nation"))
    old = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("label"))
    return linking.carried_over(new, old, "k", ["label"])


SQL["carry_over_fields"] = "SELECT c_custkey AS k, c_nationkey AS nation, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, s_name) AS label FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey"


def review_sheet_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _supply(spark, sf_dir).select("src", "dst").distinct()
    judged = e.where(F.col("dst").endswith("7")).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return linking.review_sheets(e, judged, 20).select("center", "sheet", F.array_join("neighbours", " ").alias("neighbours"))


SQL["review_sheet_neighbours"] = """WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_partkey % 10 <> 7), b AS (SELECT 's' || s AS center, 'p' || p AS other, p AS n FROM e UNION ALL SELECT 'p' || p, 's' || s, s FROM e),
r AS (SELECT *, CAST((row_number() OVER (PARTITION BY center ORDER BY n) - 1) // 20 + 1 AS INT) AS sheet FROM b) SELECT center, sheet, string_agg(other, ' ' ORDER BY n) AS neighbours FROM r GROUP BY ALL"""


def remapped_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    return linking.remapped(_read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", n.where("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("old"), (F.col("n_nationkey") + 100).alias("new")))


SQL["remapped_ids"] = "SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 AND c_nationkey IN (SELECT n_nationkey FROM nation) THEN c_nationkey + 100 ELSE c_nationkey END::INT AS c_nationkey FROM customer"


# Browsing


def local_graph_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _supply(spark, sf_dir).select("src", "dst").distinct()
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumns({"book": F.right("id", F.lit(1)), "is_term": F.col("id").endswith("3")})
    return browse.local_graph(e, nodes, "s1")[0]


SQL["local_graph_members"] = """WITH e AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS p FROM lineitem), d AS (SELECT p AS id, count(*) AS degree FROM e GROUP BY p)
SELECT id, degree FROM d WHERE id IN (SELECT p FROM e WHERE s = 's1') ORDER BY right(id, 1) <> '1', ends_with(id, '3'), degree, id LIMIT 120"""


def induced_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _supply(spark, sf_dir).select("src", "dst").distinct()
    members = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().where(~F.col("id").rlike("[02468]$"))
    return browse.induced(e, members)


SQL["induced_radius"] = """WITH e AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS p FROM lineitem WHERE l_suppkey % 2 = 1 AND l_partkey % 2 = 1), b AS (SELECT s AS id FROM e UNION ALL SELECT p FROM e)
SELECT id, count(*) AS degree, round(least(13.0, 4 + 0.3 * sqrt(count(*))), 6) AS radius FROM b GROUP BY id"""


def _slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "customer")
    book = F.concat(F.lit("r"), "n_regionkey")
    chapter = F.concat_ws("/", book, F.concat(F.lit("n"), "n_nationkey"))
    rows = n.select(book.alias("slug")).distinct().unionByName(n.where("n_nationkey % 5 <> 0").select(chapter.alias("slug")))
    return rows.unionByName(c.join(n, c.c_nationkey == n.n_nationkey).select(F.concat_ws("/", chapter, F.concat(F.lit("c"), "c_custkey")).alias("slug"))).withColumn("title", F.col("slug"))


_CHAPTERS = "SELECT 'r' || n_regionkey AS book, count(DISTINCT n_nationkey) FILTER (n_nationkey % 5 <> 0) AS chapters, count(c_custkey) FILTER (n_nationkey % 5 <> 0) AS sections FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"


def contents_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = _read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("book"), F.col("r_name").alias("field"))
    return browse.contents_tree(_slugs(spark, sf_dir), fields)


SQL["contents_tree"] = f"SELECT r_name AS field, book, chapters, sections FROM ({_CHAPTERS}) JOIN region ON book = 'r' || r_regionkey"


def contents_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.contents_counts(contents_tree(spark, sf_dir))


SQL["contents_counts"] = f"SELECT count(*) AS books, sum(chapters)::BIGINT AS chapters, sum(sections)::BIGINT AS sections FROM ({_CHAPTERS})"


def path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.segments(_read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("path")), "path")


SQL["path_segments"] = "SELECT 1 AS depth, count(DISTINCT strftime(o_orderdate, '%Y')) AS n FROM orders UNION ALL SELECT 2, count(DISTINCT strftime(o_orderdate, '%Y-%m')) FROM orders UNION ALL SELECT 3, count(DISTINCT strftime(o_orderdate, '%Y-%m-%d')) FROM orders"


def legend_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = browse.legend(_read(spark, sf_dir, "part").select(F.col("p_type").alias("field"), F.col("p_brand").alias("doc_type"), F.col("p_name").alias("book")))
    return rows.select("field", F.array_join(F.transform("groups", lambda g: F.concat(g.doc_type, F.lit(":"), F.array_join(g.books, "+"))), ",").alias("groups"))


SQL["legend_groups"] = """WITH t AS (SELECT p_type, p_brand, string_agg(DISTINCT p_name, '+' ORDER BY p_name) AS books FROM part GROUP BY ALL) SELECT p_type AS field, string_agg(p_brand || ':' || books, ',' ORDER BY p_brand) AS groups FROM t GROUP BY p_type"""


def point_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = browse.bounds(_read(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y")))
    return rows.select(*[F.round(c, 4).alias(c) for c in rows.columns])


SQL["point_bounds"] = "SELECT round(min(c_acctbal), 4) AS min_x, round(max(c_acctbal), 4) AS max_x, round(avg(c_acctbal), 4) AS mean_x, round(min(c_nationkey), 4)::DOUBLE AS min_y, round(max(c_nationkey), 4)::DOUBLE AS max_y, round(avg(c_nationkey), 4) AS mean_y FROM customer"


def shown_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.shown(_slugs(spark, sf_dir).withColumn("is_term", F.col("slug").endswith("3")), ["r1/", "r2", "r3/"], ["r1/n1/", "r3/n3"], False).select("slug")


SQL["shown_slugs"] = """WITH s AS (SELECT DISTINCT 'r' || n_regionkey AS slug FROM nation UNION ALL SELECT 'r' || n_regionkey || '/n' || n_nationkey FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT 'r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey)
SELECT slug FROM s WHERE (starts_with(slug, 'r1/') OR slug = 'r2' OR starts_with(slug, 'r3/')) AND NOT (starts_with(slug, 'r1/n1/') OR slug = 'r3/n3') AND NOT ends_with(slug, '3')"""


def section_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.concat_ws("/", F.lit("book"), F.concat_ws("-", F.col("p_size").cast("string"), "p_name"))
    return _read(spark, sf_dir, "part").select("p_partkey", browse.section_group(slug, {"one": (1, 9), "two": (10, 29), "three": (25, 40)}).alias("group"))


SQL["section_groups"] = "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 9 THEN 'one' WHEN p_size BETWEEN 10 AND 29 THEN 'two' WHEN p_size BETWEEN 25 AND 40 THEN 'three' END AS \"group\" FROM part"


def related_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _read(spark, sf_dir, "lineitem")
    ends = l.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("type"), F.struct("l_linenumber", "l_quantity", "l_extendedprice").alias("seq"))
    return browse.related(ends, ["R", "A", "N"], 3).select("src", "dst", "type", "rank")


SQL["related_targets"] = """WITH s AS (SELECT *, strpos('RAN', l_returnflag) AS kind FROM lineitem), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY kind, l_linenumber, l_quantity, l_extendedprice) = 1)
SELECT l_orderkey AS src, l_partkey AS dst, l_returnflag AS type, CAST(row_number() OVER w AS INT) AS rank FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY kind, l_linenumber, l_quantity, l_extendedprice) QUALIFY rank <= 3"""


def recent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("slug"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("date"), "o_orderstatus")
    return browse.recent(rows, F.col("o_orderstatus") == "F", 15).select("slug", "title", "remaining")


SQL["recent_orders"] = "SELECT o_orderkey::VARCHAR AS slug, o_orderpriority AS title, greatest(0, count(*) OVER () - 15) AS remaining FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, lower(title), slug LIMIT 15"


def moved_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's nations with nation 7 put in second place."""
    keys = _read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))).alias("keys"))
    return keys.select("n_regionkey", F.array_join(browse.moved(F.col("keys"), "07", 1), ",").alias("keys"))


SQL["moved_keys"] = """WITH k AS (SELECT n_regionkey, list_sort(list(lpad(n_nationkey::VARCHAR, 2, '0'))) AS k FROM nation WHERE n_nationkey <> 7 GROUP BY 1) SELECT n_regionkey, array_to_string(list_concat(list_concat(k[1:1], ['07']), k[2:]), ',') AS keys FROM k"""


def derived_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("slug"), F.col("p_type").alias("book"), F.split("p_name", " ").alias("topics"))
    books = spark.createDataFrame([("ECONOMY", "eco"), ("SMALL", "s"), ("LARGE", None)], "book string, short string")
    topics = spark.createDataFrame([("red", "colour"), ("blue", "colour"), ("ring", "round"), ("small", "s")], "topic string, group string")
    return browse.tags(pages, books, topics).select("slug", F.array_join("tags", ",").alias("tags"))


SQL["derived_tags"] = """WITH g AS (SELECT p_partkey, list_sort(list_distinct(list_filter(list_transform(string_split(p_name, ' '), lambda x: CASE WHEN x IN ('red', 'blue') THEN 'colour' WHEN x = 'ring' THEN 'round' WHEN x = 'small' THEN 's' END), lambda x: x IS NOT NULL))) AS g,
  CASE p_type WHEN 'ECONOMY' THEN 'eco' WHEN 'SMALL' THEN 's' END AS b FROM part) SELECT p_partkey AS slug, concat_ws(',', b, nullif(array_to_string(list_filter(g, lambda x: b IS NULL OR x <> b), ','), '')) AS tags FROM g"""


def zero_hit_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([("ring", ["a"]), ("blue", ["a", "b"]), ("purple", ["b", "a"]), ("pink", ["a", "b"]), ("vast", ["c"])], "term string, origins array<string>")
    return browse.zero_hits(terms, _read(spark, sf_dir, "part").select(F.col("p_name").alias("text"))).select("origins", F.array_join("terms", ",").alias("terms"))


SQL["zero_hit_terms"] = "WITH t(term, origins) AS (VALUES ('ring', 'a'), ('blue', 'a,b'), ('purple', 'a,b'), ('pink', 'a,b'), ('vast', 'c')) SELECT origins, string_agg(term, ',' ORDER BY term) AS terms FROM t WHERE NOT EXISTS (SELECT 1 FROM part WHERE contains(lower(p_name), term)) GROUP BY origins"


def name_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", browse.occurrences(F.lower("text"), F.lit("tion")).alias("n"), browse.occurrences(F.lower("text"), F.lit("aa")).alias("n_aa"))


SQL["name_occurrences"] = "SELECT doc_id, len(string_split(lower(text), 'tion')) - 1 AS n, len(string_split(lower(text), 'aa')) - 1 AS n_aa FROM documents"


def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page to a page's last segment: the page's slug where only one has it, and the way there."""
    slugs = _slugs(spark, sf_dir).select("slug")
    links = _read(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("src"), F.concat(F.lit("x/n"), F.col("n_nationkey") + 1).alias("link"))
    return browse.shortest(links, slugs).select("src", "dst", browse.relative(F.col("src"), F.col("dst")).alias("path"))


SQL["relative_paths"] = """WITH l AS (SELECT 'r' || n_regionkey || '/n' || n_nationkey AS src, n_nationkey + 1 AS k FROM nation), d AS (SELECT src, coalesce((SELECT 'r' || n_regionkey || '/n' || n_nationkey FROM nation WHERE n_nationkey = k AND n_nationkey % 5 <> 0), 'x/n' || k) AS dst FROM l)
SELECT src, dst, '../' || dst AS path FROM d"""


def numerals_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    label = F.concat(F.lit("第"), T.cn_numeral(F.col("p_size")), F.lit("章"))
    size = T.node_size(F.when(F.col("p_partkey") % 2 == 0, "term").otherwise("part"), F.col("p_size"), {"part": 9})
    return p.select("p_partkey", T.arabic_label(label).alias("label"), T.cn_number(T.cn_numeral(F.col("p_size"))).alias("number"), F.round(size, 6).alias("node_size"), T.congruential(F.col("p_partkey")).alias("next"))


SQL["numerals_and_sizes"] = """SELECT p_partkey, '第' || p_size || '章' AS label, p_size AS number, round(CASE WHEN p_partkey % 2 = 0 THEN least(14.0, 6 + sqrt(p_size)) ELSE 9 + least(4.0, sqrt(p_size)) END, 6) AS node_size, (p_partkey * 1664525 + 1013904223) % 4294967296 AS next FROM part"""


# Articles

BOOKS = [{"domain": "patent", "law_name": "专利法", "law_alias": None, "short": "专利"}, {"domain": "rules", "law_name": "专利法实施细则", "law_alias": "实施细则", "short": "细则"}, {"domain": "mark", "law_name": "商标法", "law_alias": None, "short": None}, {"domain": "guide", "law_name": None, "law_alias": None, "short": "指南"}]
ARTICLES = [("专利法", 26, "law-03-01", 0), ("专利法", 8, "law-01-08", 0), ("商标法", 8, "mark-08", 2), ("专利法实施细则", 26, "rules-26", 1)]
NODES = [("law-03-01", "第二十六条 · 申请文件", "说明书应当清楚", "patent"), ("law-01-08", "第八条 · 合作", "两个以上单位合作", "patent"), ("mark-08", "第八条 · 标志", "能够区别的标志", "mark"), ("rules-26", "第二十六条 · 遗传", "遗传资源", "rules"), ("g-1", "说明书的撰写", "依照专利法第26条撰写说明书", "guide"), ("g-2", "第八条的说明", "专利法第26条与第八条", "guide")]
CITATIONS = [("g-1", "专利法", 26)]


def article_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What arguments of an exact look-up stand for."""
    names, known = articles.registry(BOOKS), {(law, n): node for law, n, node, _ in ARTICLES}
    asked = ["专利法第26条", "law-03-01", "《实施细则》第二十六条", "商标法第9条", "刑法第8条", "第八条", "说明书"]
    found = [(a, (r := articles.resolve(a, names, known)).kind, r.law, r.number, r.node) for a in asked]
    return spark.createDataFrame(found, "asked string, kind string, law string, number int, node string")


_RESOLVED = [("专利法第26条", "key", "专利法", 26, "law-03-01"), ("law-03-01", "node", "专利法", 26, "law-03-01"), ("《实施细则》第二十六条", "key", "专利法实施细则", 26, "rules-26"), ("商标法第9条", "no such article", "商标法", 9, None), ("刑法第8条", "unknown law", None, 8, None), ("第八条", "candidates", None, 8, None), ("说明书", "nothing", None, None, None)]
SQL["article_resolution"] = f"SELECT * FROM ({_values(_RESOLVED)}) AS t(asked, kind, law, number, node)"


def search_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked answers to queries that name an article: the article first, what cites it next, other articles damped."""
    names, known = articles.registry(BOOKS), {(law, n) for law, n, _, _ in ARTICLES}
    corpus = spark.createDataFrame(NODES, "id string, title string, body string, domain string")
    listed = spark.createDataFrame(ARTICLES, "law string, number int, node_id string, seq int")
    cited = spark.createDataFrame(CITATIONS, "node_id string, law string, article int")
    default = next(n for n in names if n.law == "专利法")
    out = None
    for query in ("专利法第26条", "商标法第8条", "第八条", "刑法第8条"):
        asked = articles.parse(query, names, known, default)
        best = articles.ranked(corpus, query, asked, listed, cited, [b["domain"] for b in BOOKS if b["law_name"]], 3).select(F.lit(query).alias("query"), "id", "via", F.round("score", 4).alias("score"))
        out = best if out is None else out.unionByName(best)
    return out


#: By hand: the shares of a query's pairs, 300 in the title and 150 in the body; 1000 and 500 for the whole query; 2400, or 1200 for a
#: number alone, for the article, 250 for what cites it; a quarter for titles of other articles or, if a law is named, of another law.
SEARCHED = [
    ("专利法第26条", "law-03-01", "law", 2400.0), ("专利法第26条", "g-1", "body", 900.0), ("专利法第26条", "g-2", "body", 162.5),
    ("商标法第8条", "mark-08", "law", 2400.0), ("商标法第8条", "g-1", "fuzzy", 30.0), ("商标法第8条", "g-2", "fuzzy", 30.0),
    ("第八条", "law-01-08", "law", 2500.0), ("第八条", "g-2", "title", 1950.0), ("第八条", "mark-08", "title", 1300.0),
    ("刑法第8条", "g-1", "fuzzy", 37.5), ("刑法第8条", "g-2", "fuzzy", 37.5),
]
SQL["search_articles"] = f"SELECT * FROM ({_values(SEARCHED)}) AS t(query, id, via, score)"


def chinese_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(NODES, "id string, title string, body string, domain string").select("id", articles.chinese_form("专利法", F.col("title")).alias("form"))


SQL["chinese_forms"] = f"SELECT id, '专利法' || nullif(regexp_extract(title, '^(第[一二三四五六七八九十百零]+条)', 1), '') AS form FROM ({_values([n[:2] for n in NODES])}) AS t(id, title)"


def article_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(ARTICLES, "law string, number int, node_id string, seq int")
    rows = [articles.candidates(listed, n, ["专利法", "专利法实施细则"]).withColumn("place", F.monotonically_increasing_id()) for n in (26, 8)]
    return rows[0].unionByName(rows[1]).select("number", "law", "node_id")


SQL["article_candidates"] = f"SELECT number, law, node_id FROM ({_values(ARTICLES)}) AS t(law, number, node_id, seq)"


def entry_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as containers: the first customer with a high balance, else the first order of one that has a high price."""
    n, c, o = (_read(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    key = lambda p, x: F.concat(F.lit(p), F.col(x))
    children = c.select(key("n", "c_nationkey").alias("parent"), key("c", "c_custkey").alias("id")).unionByName(o.select(key("c", "o_custkey").alias("parent"), key("o", "o_orderkey").alias("id")))
    bodies = c.where("c_acctbal > 9950").select(key("c", "c_custkey").alias("id"), F.lit("text").alias("own")).unionByName(o.select(key("o", "o_orderkey").alias("id"), F.when(F.col("o_totalprice") > 400000, "text").otherwise(" ").alias("own")))
    return articles.entries(children, bodies, n.select(key("n", "n_nationkey").alias("id")))


SQL["entry_children"] = """WITH h AS (SELECT 'n' || c_nationkey AS container, 'c' || c_custkey AS entry, 1 AS d, c_custkey AS c, 0 AS o FROM customer WHERE c_acctbal > 9950
UNION ALL SELECT 'n' || c_nationkey, 'o' || o_orderkey, 2, c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 400000)
SELECT container, entry FROM h WHERE container IN (SELECT 'n' || n_nationkey FROM nation) QUALIFY row_number() OVER (PARTITION BY container ORDER BY d, c, o) = 1"""
