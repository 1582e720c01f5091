"""Site, catalogue, audit and tool queries on the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stemma.functions import law, text as T
from stemma.operators import audit, catalog, graph, lexicon, site, tables, tree
from stemma.operators.tools import KnowledgeBase
from stemma.plans.linking import _values
from stemma.sources import sinks

SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def without_empty_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    rows = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"), F.filter(F.array("c_name"), lambda x: F.col("c_custkey") % 2 == 0).alias("names"))
    return sinks.without_empty(rows).select("c_custkey", "segment", F.col("names")[0].alias("name"))


SQL["without_empty_cells"] = "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name FROM customer"


def referential_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _read(spark, sf_dir, "lineitem")
    edges = l.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), "l_linenumber")
    nodes = _read(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id")).unionByName(_read(spark, sf_dir, "part").where("p_size > 10").select(F.concat(F.lit("p"), "p_partkey").alias("id")))
    return graph.closed(edges, nodes).groupBy("src").agg(F.count("*").alias("n"), F.count_distinct("dst").alias("parts"))


SQL["referential_closure"] = "SELECT 's' || l_suppkey AS src, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE s_nationkey % 2 = 0 AND p_size > 10 GROUP BY 1"


def published_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "True").when(F.col("o_orderstatus") == "F", "false").alias("draft"), F.when(F.col("o_orderkey") % 7 == 0, "true").alias("publish"))
    return site.published(o).select("o_orderkey", F.lit("drafts").alias("rule")).unionByName(site.published(o, True).select("o_orderkey", F.lit("explicit").alias("rule")))


SQL["published_pages"] = "SELECT o_orderkey, 'drafts' AS rule FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT o_orderkey, 'explicit' FROM orders WHERE o_orderkey % 7 = 0"


def taxonomy_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = catalog.taxonomy(_read(spark, sf_dir, "part").dropDuplicates(["p_type", "p_brand", "p_name"]).withColumn("kind", F.left("p_name", F.lit(1))), ("p_type", "p_brand", "kind"), "p_name")
    return got.select("p_type", F.array_join(F.transform("below", lambda b: F.concat(b.p_brand, F.lit("["), F.array_join(F.transform(b.below, lambda k: F.concat(k.kind, F.lit(":"), F.array_join(k.leaves, "+"))), ";"), F.lit("]"))), ",").alias("tree"))


SQL["taxonomy_tree"] = """WITH a AS (SELECT p_type, p_brand, left(p_name, 1) AS kind, string_agg(DISTINCT p_name, '+' ORDER BY p_name) AS leaves FROM part GROUP BY ALL), b AS (SELECT p_type, p_brand, string_agg(kind || ':' || leaves, ';' ORDER BY kind) AS below FROM a GROUP BY ALL)
SELECT p_type, string_agg(p_brand || '[' || below || ']', ',' ORDER BY p_brand) AS tree FROM b GROUP BY p_type"""


def tag_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slug"), F.array(F.date_format("o_orderdate", "yyyy/MM"), F.date_format("o_orderdate", "yyyy/MM/dd"), F.col("o_orderpriority")).alias("tags"))
    return site.tag_pages(pages)


SQL["tag_expansion"] = """WITH t AS (SELECT o_orderkey, unnest([strftime(o_orderdate, '%Y'), strftime(o_orderdate, '%Y/%m'), strftime(o_orderdate, '%Y/%m/%d'), o_orderpriority]) AS tag FROM orders), c AS (SELECT tag, count(*) AS n FROM t GROUP BY tag)
SELECT * FROM c UNION ALL SELECT 'index', count(*) FROM c"""


def hit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.neighbours_of_hits(_read(spark, sf_dir, "documents").select(F.lower("text").alias("text")), "tion")


SQL["hit_neighbours"] = """WITH p AS (SELECT string_split(lower(text), 'tion') AS p FROM documents WHERE contains(lower(text), 'tion')), i AS (SELECT p, unnest(range(1, len(p))) AS i FROM p),
s AS (SELECT 'left' AS side, CASE WHEN p[i] <> '' THEN right(p[i], 1) WHEN i > 1 THEN 'n' ELSE '' END AS character FROM i UNION ALL SELECT 'right', CASE WHEN p[i + 1] <> '' THEN left(p[i + 1], 1) WHEN i < len(p) - 1 THEN 't' ELSE '' END FROM i),
c AS (SELECT side, character, count(*) AS n FROM s GROUP BY ALL) SELECT side, character, n FROM c QUALIFY row_number() OVER (PARTITION BY side ORDER BY n DESC, character) <= 5"""


def law_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' parts that were returned in large lots come first, then those of many lines."""
    l = _read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.lpad(F.col("l_partkey").cast("string"), 8, "0").alias("dst"), "l_quantity", "l_returnflag")
    return graph.mixed_quota(l.where("l_quantity > 49 AND l_returnflag = 'R'").select("src", "dst"), l.groupBy("src", "dst").agg(F.count("*").alias("n")), 8)


SQL["law_quota"] = """WITH l AS (SELECT 's' || l_suppkey AS src, lpad(l_partkey::VARCHAR, 8, '0') AS dst, count(*) AS n, bool_or(l_quantity > 49 AND l_returnflag = 'R') AS direct FROM lineitem GROUP BY ALL)
SELECT src, dst, CASE WHEN direct THEN 0.7 ELSE 0.4 END::DOUBLE AS weight FROM l WHERE direct OR n >= 2 QUALIFY row_number() OVER (PARTITION BY src ORDER BY NOT direct, CASE WHEN direct THEN 0 ELSE -n END, dst) <= 8"""


def sheet_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.sheets(_read(spark, sf_dir, "orders"), [F.col("o_orderkey")], 100, ["o_orderstatus"]).groupBy("o_orderstatus", "sheet").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


SQL["sheet_numbers"] = "WITH r AS (SELECT *, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 100 + 1 AS INT) AS sheet FROM orders) SELECT o_orderstatus, sheet, count(*) AS n, min(o_orderkey) AS first FROM r GROUP BY ALL"


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, more = catalog.text_page(F.col("text"), 200, 300)
    return _read(spark, sf_dir, "documents").select("doc_id", page.alias("page"), more.alias("more"))


SQL["text_pages"] = "SELECT doc_id, substr(text, 201, 300) AS page, length(text) > 500 AS more FROM documents"


def overlay_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = spark.createDataFrame([(0, ["NATION_10", "NATION_5", "none", "NATION_10"]), (3, ["NATION_8"])], "parent int, keys array<string>")
    return tree.overlay(_read(spark, sf_dir, "nation"), order, "n_regionkey", "n_name", [F.col("n_nationkey")]).select("n_nationkey", "position")


SQL["overlay_order"] = "SELECT n_nationkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY CASE WHEN n_regionkey = 0 AND n_name = 'NATION_10' THEN 0 WHEN n_regionkey = 0 AND n_name = 'NATION_5' THEN 1 WHEN n_regionkey = 3 AND n_name = 'NATION_8' THEN 0 ELSE 9 END, n_nationkey) AS INT) AS position FROM nation"


def site_search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("title"), F.lower("p_type").alias("content"), F.array("p_brand").alias("tags"), F.col("p_partkey").alias("seq"))
    found = [site.site_search(p, q).withColumn("query", F.lit(q)) for q in ("red r", "econ", "#Brand#1", "#Brand#7 ring", "brand#25")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("query", "slug", "priority")


SQL["site_search_hits"] = """WITH q(query, w, tag) AS (VALUES ('red r', 'red r', ''), ('econ', 'econ', ''), ('#Brand#1', '', 'Brand#1'), ('#Brand#7 ring', 'ring', 'Brand#7'), ('brand#25', 'brand#25', '')),
h AS (SELECT query, p_partkey AS slug, CASE WHEN tag <> '' AND w = '' THEN CASE WHEN starts_with(p_brand, tag) THEN 2 END WHEN contains(lower(p_name), w) THEN 0 WHEN contains(lower(p_type), w) THEN 1 WHEN contains(lower(p_brand), w) THEN 2 END AS priority FROM q JOIN part ON tag = '' OR w = '' OR p_brand = tag)
SELECT query, slug, priority FROM h WHERE priority IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query ORDER BY priority, slug) <= 8"""


def highlighted_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", site.highlighted(F.col("p_name"), "red ring", ("<", ">")).alias("title"))


SQL["highlighted_titles"] = "SELECT p_partkey, CASE WHEN contains(p_name, 'red ring') THEN replace(p_name, 'red ring', '<red ring>') ELSE replace(replace(p_name, 'red', '<red>'), 'ring', '<ring>') END AS title FROM part"


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    first = F.substring_index("text", "\n", 1)
    return d.select("doc_id", T.term_key(first).alias("key"), T.lead_summary(first).alias("lead"), site.reading_minutes(F.col("text")).alias("minutes"))


SQL["text_keys"] = r"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS f FROM documents), l AS (SELECT *, regexp_extract(trim(regexp_replace(f, '^[>#\s]+', '')), '^([^。！？.!?\n]*[。！？.!?]?)', 1) AS s FROM d)
SELECT doc_id, regexp_replace(lower(f), '[ ·\-—_、，,.。]', '', 'g') AS key, CASE WHEN length(s) > 70 THEN substr(s, 1, 68) || '…' ELSE s END AS lead, ceil(len(regexp_extract_all(text, '\S+')) / 200.0)::INT AS minutes FROM l"""

_STATUSES = [("现行有效", "in_force"), ("已废止", "repealed"), ("尚未生效", "not_yet"), ("部分失效", "partial"), ("征求意见稿", "draft"), ("其他", "unknown"), ("", None)]


def status_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s,) for s, _ in _STATUSES], "status string").select("status", law.status_code(F.col("status")).alias("code"))


SQL["status_codes"] = f"SELECT * FROM ({_values(_STATUSES)}) AS t(status, code)"


def law_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffixes and tails of made titles, and the order of versions."""
    o = _read(spark, sf_dir, "orders")
    year = F.date_format("o_orderdate", "yyyy")
    title = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Law "), year, F.lit(" · part"))).otherwise("Law · two · three")
    suffix = law.title_suffix(title, F.when(F.col("o_orderkey") % 2 == 0, F.concat(year, F.lit("-01"))), year)
    return o.select("o_orderkey", suffix.alias("suffix"), law.article_title(title).alias("tail"), (law.version_key(F.concat(F.lit("v1."), F.col("o_orderkey").cast("string"))) < law.version_key(F.lit("1.500"))).alias("older"))


SQL["law_titles"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN '（' || strftime(o_orderdate, '%Y') || '年施行）' ELSE '（' || strftime(o_orderdate, '%Y') || '年发布）' END AS suffix,
  CASE WHEN o_orderkey % 3 = 0 THEN 'part' ELSE 'two · three' END AS tail, o_orderkey < 500 AS older FROM orders"""


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    topic = F.concat_ws("/", "c_mktsegment", (F.col("c_nationkey") % 3).cast("string"))
    return graph.star(c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 == 0, topic).otherwise(F.col("c_name")).alias("label"), topic.alias("topic"))).groupBy("dst").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))


SQL["star_edges"] = """WITH m AS (SELECT c_custkey AS id, c_mktsegment || '/' || (c_nationkey % 3) AS topic FROM customer), l AS (SELECT topic, min(id) AS dst FROM m WHERE id % 10 = 0 GROUP BY topic) SELECT dst, count(*) AS n, 0.8::DOUBLE AS weight FROM m JOIN l USING (topic) WHERE id <> dst GROUP BY dst"""


def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("term"), F.expr("CASE event_id % 11 WHEN 0 THEN 'keep' WHEN 1 THEN 'merge-into: ' || (user_id % 7) WHEN 2 THEN CASE WHEN user_id % 5 = 0 THEN 'drop' ELSE 'what' END WHEN 3 THEN 'merge-into:' ELSE ' keep ' END").alias("note"))
    return lexicon.decisions(e)


SQL["review_decisions"] = """WITH e AS (SELECT event_id AS seq, user_id::VARCHAR AS term, CASE event_id % 11 WHEN 1 THEN CASE WHEN user_id % 7 <> user_id THEN 'merge' END WHEN 2 THEN CASE WHEN user_id % 5 = 0 THEN 'drop' END WHEN 3 THEN NULL ELSE 'keep' END AS action, (user_id % 7)::VARCHAR AS t FROM events)
SELECT term, action, CASE WHEN action = 'merge' THEN t END AS target FROM e WHERE action IS NOT NULL QUALIFY row_number() OVER (PARTITION BY term ORDER BY action = 'drop' DESC, seq DESC) = 1"""


def edge_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = l.select(audit.is_hub(F.col("p_name"), F.array_repeat(F.lit("t"), F.col("p_size") % 10), F.when(F.col("l_linenumber") == 7, "law").otherwise("node"), "^red").alias("hub_src"), F.lit(False).alias("hub_dst"), audit.keyword_strength(F.col("p_name"), ["ring", "red", "old"]).alias("strength"), F.when(F.col("l_quantity") < 45, F.col("l_quantity") / 50).alias("cosine"))
    return audit.classified(rows).groupBy("level", "advice").agg(F.count("*").alias("n"))


SQL["edge_audit"] = """WITH r AS (SELECT l_linenumber <> 7 AND (starts_with(p_name, 'red') OR p_size % 10 >= 8) AS hub, contains(p_name, 'ring')::INT + contains(p_name, 'red')::INT + contains(p_name, 'old')::INT AS s, CASE WHEN l_quantity < 45 THEN l_quantity / 50 END AS c FROM lineitem JOIN part ON l_partkey = p_partkey),
x AS (SELECT CASE WHEN hub AND s <= 1 THEN 'red' WHEN c < 0.4 THEN 'red' WHEN c >= 0.62 THEN 'green' WHEN s <= 1 THEN 'yellow' ELSE 'green' END AS level FROM r)
SELECT level, CASE level WHEN 'red' THEN 'drop' WHEN 'yellow' THEN 'review' ELSE 'keep' END AS advice, count(*) AS n FROM x GROUP BY level"""


def ambiguous_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    words = p.select(F.explode(F.split("p_name", " ")).alias("name"), "p_size").groupBy("name").agg((F.count("*") / 20).cast("int").alias("pages"), F.avg((F.col("p_size") > 5).cast("int")).alias("embedded"))
    return audit.ambiguous(words).select("name", F.array_join("reasons", ",").alias("reasons"))


SQL["ambiguous_terms"] = """WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS name, p_size FROM part), t AS (SELECT name, count(*) // 20 AS pages, avg((p_size > 5)::INT) AS e FROM w GROUP BY name),
r AS (SELECT name, concat_ws(',', CASE WHEN length(name) <= 2 THEN 'short' END, CASE WHEN length(name) = 3 AND pages >= 3 THEN 'three' END, CASE WHEN length(name) = 4 AND pages >= 8 AND e >= 0.8 THEN 'embedded' END, CASE WHEN pages >= 40 THEN 'common' END) AS reasons FROM t) SELECT * FROM r WHERE reasons <> ''"""


def term_field_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    fields = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 5, F.col("p_type")).alias("field"))
    return site.term_fields(l, fields).select("src", F.array_join("fields", ",").alias("fields"))


SQL["term_field_sets"] = "SELECT l_suppkey AS src, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS fields FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 5 GROUP BY 1"


def navigation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("parent"), F.when(F.col("n_nationkey") % 4 == 1, F.concat(F.lit("x"), F.char(F.col("n_nationkey") + 65))).otherwise(F.concat((50 - F.col("n_nationkey")).cast("string"), F.lit(" name"))).alias("name"), (F.col("n_nationkey") % 3 == 0).alias("is_folder"))
    return site.navigation(n).select("parent", "name", "position")


SQL["navigation_order"] = """WITH n AS (SELECT n_regionkey AS parent, n_nationkey AS k, CASE WHEN n_nationkey % 4 = 1 THEN 'x' || chr(n_nationkey + 65) ELSE (50 - n_nationkey) || ' name' END AS name FROM nation)
SELECT parent, name, CAST(row_number() OVER (PARTITION BY parent ORDER BY k % 3 = 0 DESC, CASE WHEN k % 4 <> 1 THEN 50 - k END NULLS LAST, name) AS INT) AS position FROM n"""


def regrouped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("domain"), F.when(F.col("p_size") > 3, F.col("p_type")).alias("country"), F.when(F.col("p_size") % 5 > 0, F.col("p_brand")).otherwise("").alias("field"))
    return site.regrouped(p, ["country", "field"]).select("domain", "path")


SQL["regrouped_paths"] = "SELECT p_partkey::VARCHAR AS domain, CASE WHEN p_size > 3 AND p_size % 5 > 0 THEN p_type || '/' || p_brand || '/' || p_partkey ELSE p_partkey::VARCHAR END AS path FROM part"


def folder_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select(F.concat_ws("/", "o_orderpriority", "o_orderstatus", F.col("o_orderkey").cast("string")).alias("slug"), F.col("o_orderdate").alias("date"))
    return site.folders(o).select("folder", "n", F.date_format("date", "yyyy-MM-dd").alias("date"))


SQL["folder_dates"] = "SELECT o_orderpriority || '/' || o_orderstatus AS folder, count(*) AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS date FROM orders GROUP BY 1 UNION ALL SELECT DISTINCT o_orderpriority, 0, NULL FROM orders"


def keyword_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").where(F.contains("text", F.lit("tion")))
    return d.select("doc_id", site.in_context(F.col("text"), F.instr("text", "tion") - 1, F.lit(4), 10).alias("line"))


SQL["keyword_in_context"] = """WITH d AS (SELECT doc_id, text, strpos(text, 'tion') - 1 AS at_ FROM documents WHERE contains(text, 'tion'))
SELECT doc_id, replace(CASE WHEN at_ > 10 THEN '…' ELSE '' END || substr(text, greatest(at_ - 9, 1), least(at_, 10)) || '【tion】' || substr(text, at_ + 5, 10) || CASE WHEN length(text) > at_ + 14 THEN '…' ELSE '' END, chr(10), '⏎') AS line FROM d"""


def undecided_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select((F.col("o_custkey") % 400).alias("center"), (F.col("o_orderkey") % 40).alias("neighbour"), F.when(F.col("o_orderkey") % 9 < 5, "unsure").otherwise("bad").alias("verdict"))
    return audit.undecided(o).withColumn("kind", F.lit("unsure")).unionByName(audit.blacklist(o).withColumn("kind", F.lit("bad")))


SQL["undecided_pairs"] = """WITH v AS (SELECT least(o_custkey % 400, o_orderkey % 40) AS a, greatest(o_custkey % 400, o_orderkey % 40) AS b, o_orderkey % 9 < 5 AS unsure FROM orders)
SELECT a, b, CASE WHEN bool_and(unsure) THEN 'unsure' ELSE 'bad' END AS kind FROM v GROUP BY a, b HAVING bool_and(unsure) OR NOT bool_or(unsure)"""


def verdict_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("center"), (F.col("l_partkey") % 50).alias("neighbour"), F.col("l_returnflag").alias("relation"), F.col("l_linestatus").alias("verdict"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("seq"))
    return audit.verdicts(l)


SQL["verdict_tallies"] = "WITH v AS (SELECT l_returnflag AS relation, l_linestatus AS verdict FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey % 50 ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) = 1) SELECT relation, verdict, count(*) AS n FROM v GROUP BY ALL"


def graph_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders link to the next and to the tenth after; the projection holds links to orders that are there."""
    k = F.col("o_orderkey")
    pages = _read(spark, sf_dir, "orders").where("o_orderkey % 4 <> 1").select(k.cast("string").alias("slug"), F.col("o_orderstatus").alias("title"), F.array((k + 1).cast("string"), (k + 10).cast("string")).alias("links"), F.array("o_orderpriority").alias("tags"), F.lit("").alias("content"))
    _, lean, dangling = sinks.content_index(pages)
    return lean.select("slug", F.array_join("links", ",").alias("links")).join(dangling.groupBy("slug").agg(F.count("*").alias("dangling")), "slug", "left").select("slug", "links", F.coalesce("dangling", F.lit(0)).alias("dangling"))


SQL["graph_projection"] = """WITH p AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 <> 1), l AS (SELECT p.k, j, (p.k + j) IN (SELECT k FROM p) AS there FROM p, (VALUES (1), (10)) AS t(j))
SELECT k::VARCHAR AS slug, coalesce(string_agg((k + j)::VARCHAR, ',' ORDER BY j) FILTER (there), '') AS links, count(*) FILTER (NOT there) AS dangling FROM l GROUP BY k"""


def alias_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select(F.col("c_name").alias("slug"), F.array(F.col("c_name"), F.concat(F.lit(" a:b?"), "c_custkey"), F.concat(F.lit("ab"), "c_custkey"), F.lit("*")).alias("aliases"))
    return sinks.redirects(c)


SQL["alias_redirects"] = "SELECT 'ab' || c_custkey AS alias, c_name AS slug FROM customer"


def feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select(F.format_string("%010d", F.col("o_orderkey")).alias("title"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("date"))
    return sinks.feed(o, 12).select("title", sinks.sitemap_entry("https://x", F.col("title"), F.col("date")).alias("entry"))


SQL["feed_rows"] = "SELECT lpad(o_orderkey::VARCHAR, 10, '0') AS title, '<url><loc>https://x/' || title || '</loc><lastmod>' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '</lastmod></url>' AS entry FROM orders WHERE o_orderkey % 2 = 0 ORDER BY o_orderdate DESC, title LIMIT 12"


def sheet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    odd = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(', "x"'))).when(F.col("c_custkey") % 3 == 1, F.col("c_name"))
    return c.select("c_custkey", sinks.sheet_line([F.col("c_custkey"), odd, F.col("c_mktsegment")]).alias("line"))


SQL["sheet_lines"] = """SELECT c_custkey, c_custkey || ',' || CASE c_custkey % 3 WHEN 0 THEN '"' || c_name || ', ""x""' || '"' WHEN 1 THEN c_name ELSE '' END || ',' || c_mktsegment AS line FROM customer"""


def heading_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr("CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END").alias("depth")).where("turn > 0")
    return site.contents(rows, "conv_id", "depth", "turn", 3)


SQL["heading_contents"] = "WITH r AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS depth FROM conversations WHERE turn > 0) SELECT conv_id, turn, depth - min(depth) OVER (PARTITION BY conv_id) AS depth FROM r"

_CELLS = [("甲、乙/丙", "甲|乙|丙", ""), ("甲（乙）、1/2比例", "甲|1/2比例", "乙"), ("“甲、乙”丙／丁", "“甲、乙”丙|丁", ""), ("甲（第3条）", "甲", ""), ("甲、甲", "甲", "")]


def cell_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c, *_ in _CELLS], "cell string").select("cell", F.array_join(lexicon.variants(F.col("cell")), "|").alias("names"), F.array_join(lexicon.bracketed(F.col("cell")), "|").alias("aliases"))


SQL["cell_variants"] = f"SELECT * FROM ({_values(_CELLS)}) AS t(cell, names, aliases)"


# The query interface


def _base(spark: SparkSession, sf_dir: str) -> KnowledgeBase:
    """Regions as books, their nations as chapters, customers as sections; suppliers as laws whose articles are parts."""
    n, c, r, l, o = (_read(spark, sf_dir, t) for t in ("nation", "customer", "region", "lineitem", "orders"))
    key = lambda p, x: F.concat(F.lit(p), F.col(x))
    cust = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    nodes = n.select(key("n", "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit("chapter").alias("level"), key("r", "n_regionkey").alias("domain"), F.array().cast("array<string>").alias("breadcrumb"), F.lit("").alias("summary"))
    nodes = nodes.unionByName(cust.select(key("c", "c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit("section").alias("level"), key("r", "n_regionkey").alias("domain"), F.array("n_name").alias("breadcrumb"), F.col("c_mktsegment").alias("summary")))
    bodies = c.select(key("c", "c_custkey").alias("id"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("own"), F.lit("").alias("full"))
    edges = c.select(key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("dst"), F.lit("hierarchy").alias("type"), F.lit(1.0).alias("weight"))
    edges = edges.unionByName(c.where("c_custkey % 5 = 0").select(key("c", "c_custkey").alias("src"), F.concat(F.lit("c"), F.col("c_custkey") + 1).alias("dst"), F.lit("xref").alias("type"), F.lit(0.6).alias("weight")))
    books = r.select(key("r", "r_regionkey").alias("domain"), F.col("r_name").alias("title"), F.lower("r_name").alias("short"), F.lit("CN").alias("country"), F.when(F.col("r_regionkey") < 2, "a").otherwise("b").alias("field"), F.lit("t").alias("doc_type"), F.when(F.col("r_regionkey") == 1, "law").alias("law_name"), F.when(F.col("r_regionkey") == 2, "已废止").otherwise("现行").alias("status"), F.lit(1).alias("chars"))
    articles = l.groupBy(key("s", "l_suppkey").alias("law"), (F.col("l_partkey") % 100).cast("int").alias("number")).agg(F.concat(F.lit("c"), F.min("l_partkey")).alias("node_id"))
    citations = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(key("c", "o_custkey").alias("node_id"), key("s", "l_suppkey").alias("law"), (F.col("l_partkey") % 100).alias("article")).agg(F.count("*").alias("n"))
    terms = spark.createDataFrame([], "id string, label string, aliases array<string>, definition string")
    return KnowledgeBase(nodes, bodies, edges, books, articles, citations, terms)


def kb_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(spark, sf_dir).related("n7", None, 12).select("id", "type", "total", "rank", "path")


SQL["kb_related"] = "SELECT 'c' || c_custkey AS id, 'hierarchy' AS type, count(*) OVER () AS total, CAST(row_number() OVER (ORDER BY c_custkey) AS INT) AS rank, n_name || ' › ' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey = 7 QUALIFY rank <= 12"


def kb_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(spark, sf_dir).list_articles("s3", 20, 60, 5, 10).select("number", "node_id", "rank", "total", "has_more")


SQL["kb_articles"] = """WITH a AS (SELECT l_partkey % 100 AS number, min(l_partkey) AS k FROM lineitem WHERE l_suppkey = 3 GROUP BY 1), f AS (SELECT number::INT AS number, 'c' || k AS node_id, CAST(row_number() OVER (ORDER BY number) AS INT) AS rank, count(*) OVER () AS total FROM a WHERE number BETWEEN 20 AND 60)
SELECT *, total > 15 AS has_more FROM f WHERE rank > 5 AND rank <= 15"""


def kb_citing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(spark, sf_dir).citing_sections("s3", ["r1", "r3"])


SQL["kb_citing"] = """WITH x AS (SELECT l_partkey % 100 AS article, c_custkey, n_regionkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_suppkey = 3 AND n_regionkey IN (1, 3) GROUP BY ALL)
SELECT article, count(*) AS sections, count(DISTINCT n_regionkey) AS books, sum(n)::BIGINT AS total FROM x GROUP BY article"""


def kb_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(spark, sf_dir).briefs(root="n4", depth=1, limit=30).select("id", "depth", "label", "book", "summary")


SQL["kb_briefs"] = """WITH x AS (SELECT 'n4' AS id, 0 AS depth, n_name AS label, r_name AS book, '' AS summary, -1 AS k FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 4
UNION ALL SELECT 'c' || c_custkey, 1, c_name, r_name, c_mktsegment, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 4) SELECT id, depth, label, book, summary FROM x ORDER BY depth, k LIMIT 30"""


def kb_effectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(spark, sf_dir).effectivity()


SQL["kb_effectivity"] = "SELECT 'r' || r_regionkey AS domain, r_name AS title, CASE WHEN r_regionkey = 2 THEN 'repealed' ELSE 'in_force' END AS code, CASE WHEN r_regionkey = 2 THEN 'no longer in force' END AS warning FROM region"


def kb_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = _base(spark, sf_dir)
    found = kb.filter_books("CN", "b", None, False, "r")
    return found.select("domain", F.lit("book").alias("kind")).unionByName(kb.facets(kb.filter_books(field_="a")).select(F.concat_ws("=", "facet", "value").alias("domain"), F.concat(F.lit("n"), "n").alias("kind")))


SQL["kb_books"] = """SELECT 'r' || r_regionkey AS domain, 'book' AS kind FROM region WHERE r_regionkey >= 2 UNION ALL
SELECT unnest(['country=CN', 'field=a', 'doc_type=t', 'status=现行']), 'n' || (SELECT count(*) FROM region WHERE r_regionkey < 2)"""


def kb_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's text and its most frequent citations, and a nation's children."""
    kb = _base(spark, sf_dir)
    one = kb.read_node("c11").select("id", "text", "has_more", F.array_join(F.transform("citations", lambda c: F.concat_ws("/", c.law, c.article.cast("string"))), ",").alias("listed"))
    return one.unionByName(kb.read_node("n3").select("id", "text", "has_more", F.array_join("children", ",").alias("listed")))


SQL["kb_node"] = """WITH k AS (SELECT 's' || l_suppkey AS law, l_partkey % 100 AS article, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 11 GROUP BY ALL ORDER BY n DESC, law, article LIMIT 50)
SELECT 'c11' AS id, c_name || ' ' || c_mktsegment AS text, false AS has_more, (SELECT string_agg(law || '/' || article, ',' ORDER BY n DESC, law, article) FROM k) AS listed FROM customer WHERE c_custkey = 11
UNION ALL SELECT 'n3', '', false, string_agg('c' || c_custkey, ',' ORDER BY c_custkey) FROM customer WHERE c_nationkey = 3"""


# Checks and sets


def coverage_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against the orders that name them."""
    expected = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    found = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") + F.when(F.col("c_custkey") > 100, 2).otherwise(1)).alias("n"), "c_acctbal")
    return tables.coverage(expected, found, "key", "n", "^[0-9]{1,3}$", F.col("c_acctbal") > 0)


SQL["coverage_checks"] = """SELECT 'coverage' AS "check", count(DISTINCT o_custkey) AS faults FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'count', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'continuity', CASE WHEN max(c_custkey) > 100 THEN 1 ELSE 0 END FROM customer UNION ALL SELECT 'format', count(*) FROM customer WHERE c_custkey > 999 UNION ALL SELECT 'sentinel', count(*) FROM customer WHERE c_acctbal <= 0"""


def taxonomy_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    theirs = p.where("p_partkey % 10 <> 3").select((F.col("p_partkey") + F.when(F.col("p_partkey") % 100 == 99, 10**9).otherwise(0)).alias("p_partkey"), F.when(F.col("p_size") > 40, "other").otherwise(F.col("p_brand")).alias("p_brand"), F.when(F.col("p_size") > 45, "other").otherwise(F.col("p_type")).alias("p_type"))
    return tables.cross_check(p.select("p_partkey", "p_brand", "p_type"), theirs, "p_partkey", ["p_brand", "p_type"])


SQL["taxonomy_cross_check"] = """SELECT p_partkey, CASE WHEN p_partkey % 10 = 3 OR p_partkey % 100 = 99 THEN 'only ours' WHEN p_size > 45 THEN 'p_brand,p_type' ELSE 'p_brand' END AS fault FROM part WHERE p_partkey % 10 = 3 OR p_partkey % 100 = 99 OR p_size > 40
UNION ALL SELECT p_partkey + 1000000000, 'only theirs' FROM part WHERE p_partkey % 100 = 99"""


def replaced_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of region 2 are replaced by suppliers; doing it twice is the same."""
    n = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.col("n_regionkey").cast("string").alias("level"), F.col("n_nationkey").alias("k"))
    s = _read(spark, sf_dir, "supplier").select(F.col("s_name").alias("id"), F.lit("2").alias("level"))
    return tables.replaced(tables.replaced(n, s, "level", "2"), s, "level", "2")


SQL["replaced_union"] = "SELECT n_name AS id, n_regionkey::VARCHAR AS level, n_nationkey AS k FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT s_name, '2', NULL FROM supplier"


def shared_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that a supplier delivers both returned and unreturned."""
    l = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sets = l.groupBy("l_suppkey").agg(F.collect_set(F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40), F.col("p_brand"))).alias("a"), F.collect_set(F.when((F.col("l_returnflag") == "A") & (F.col("l_quantity") < 10), F.col("p_brand"))).alias("b"))
    return tables.shared(sets, "a", "b").select("l_suppkey", F.array_join("shared", ",").alias("shared"))


SQL["shared_items"] = """WITH s AS (SELECT l_suppkey, p_brand, bool_or(l_returnflag = 'R' AND l_quantity > 40) AS a, bool_or(l_returnflag = 'A' AND l_quantity < 10) AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT l_suppkey, coalesce(string_agg(p_brand, ',' ORDER BY p_brand) FILTER (a AND b), '') AS shared FROM s GROUP BY l_suppkey"""


def hub_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    return graph.hubs(l, spark.createDataFrame([("p1",), ("p2",), ("none",)], "id string"), 30)


SQL["hub_seeds"] = """WITH b AS (SELECT 's' || l_suppkey AS id FROM lineitem UNION ALL SELECT 'p' || l_partkey FROM lineitem), d AS (SELECT id, count(*) AS degree FROM b GROUP BY id)
SELECT * FROM (SELECT * FROM d ORDER BY degree DESC, id LIMIT 30) UNION SELECT id, degree FROM d WHERE id IN ('p1', 'p2') UNION SELECT 'none', 0"""

_MARKED = [("> [!Note]+ A title\n> text ==one== and #tag/sub #12 %%hid ==x==%%", "note:A title", "one|x", "tag/sub", "one"), ("plain", "", "", "", ""), ("#top\n> [!tip]\n==a== ==b==", "tip:", "a|b", "top", "a|b")]


def page_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(m[0],) for m in _MARKED], "text string")
    t = F.col("text")
    return rows.select("text", F.array_join(F.transform(site.callouts(t), lambda c: F.concat_ws(":", c.kind, c.title)), "|").alias("callouts"), F.array_join(site.marks(t), "|").alias("marks"), F.array_join(site.inline_tags(t), "|").alias("tags"), F.array_join(site.marks(site.without_comments(t)), "|").alias("seen"))


SQL["page_marks"] = f"SELECT * FROM ({_values(_MARKED)}) AS t(text, callouts, marks, tags, seen)"

_LISTS = [('["a", b, a]', "a|b"), ("a, 'b c'", "a|b c"), ("\n- x\n- y", "x|y"), ("", ""), ("one", "one")]


def front_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v, _ in _LISTS], "value string").select("value", F.array_join(site.front_list(F.col("value")), "|").alias("items"))


SQL["front_lists"] = "SELECT * FROM (VALUES " + ", ".join("('" + v.replace("'", "''") + f"', '{i}')" for v, i in _LISTS) + ") AS t(value, items)"


def unique_page_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.array(F.concat_ws(" ", "c_mktsegment", F.round("c_acctbal", -1).cast("long")), F.col("c_name"), F.concat(F.lit("a/"), "c_custkey")).alias("aliases"))
    return tables.unique_values(c, "c_custkey", "aliases", "c_name")


SQL["unique_page_aliases"] = "SELECT any_value(c_custkey) AS c_custkey, c_mktsegment || ' ' || round(c_acctbal, -1)::BIGINT AS value FROM customer GROUP BY value HAVING count(*) = 1"
