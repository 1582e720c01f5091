"""Extraction, lexicon and incremental queries on the driver tables and on literal rows, with SQL where it can say them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from stemma.functions import cite, outline, text as T
from stemma.operators import lexicon
from stemma.streaming import changes

SQL: dict[str, str] = {}

LAWS = {"专利法": "专利法", "中华人民共和国专利法": "专利法", "商标法": "商标法", "专利法实施细则": "专利法实施细则", "实施细则": "专利法实施细则"}
#: Texts and the keys of their citations.
CITED = [
    ("违反商标法第十条、第十一条的规定", "商标法第10条,商标法第11条"),
    ("专利法第二十二条第二款、第三款", "专利法第22条第2款,专利法第22条第3款"),
    ("专利法第1条至第200条", "专利法第1条,专利法第200条"),
    ("商标法第10条～第12条", "商标法第10条,商标法第11条,商标法第12条"),
    ("依照商标法（2013）第五条", "商标法第5条"),
    ("《中华人民共和国专利法》（以下简称专利法）第三十四条", "专利法第34条"),
    ("专利法实施细则第五十七条", "专利法实施细则第57条"),
    ("构成犯罪的，依照刑法第二百一十三条", ""),
    ("依照细则第五条", ""),
    ("不符合专利合作条约实施细则第46条的规定", ""),
    ("依照实施细则第46条的规定", "专利法实施细则第46条"),
    ("商标法2026第8条", "商标法第8条"),
]


def cite_extract_cn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(t,) for t, _ in CITED], "text string")
    found = rows.select("text", cite.citations_udf(LAWS)("text").alias("c"))
    return found.select("text", F.array_join(F.transform("c", lambda x: x.key), ",").alias("keys"))


SQL["cite_extract_cn"] = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{k}')" for t, k in CITED) + ") AS t(text, keys)"


def outline_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: a system or user turn is a heading of level one, an answer one of level two."""
    turn = F.struct("turn", F.concat(F.when(F.col("role") == "assistant", "## ").otherwise("# "), "role", F.lit("\n"), F.regexp_replace("text", "#", "")).alias("t"))
    docs = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x.t), "\n").alias("text"))
    nodes = docs.select("conv_id", F.explode(outline.nodes_udf()(F.concat(F.lit("c"), "conv_id"), "text")).alias("n"))
    return nodes.select("conv_id", "n.id", "n.level", "n.label", F.array_join("n.breadcrumb", "/").alias("breadcrumb"))


SQL["outline_nodes"] = """WITH r AS (SELECT *, role <> 'assistant' AS top, count(*) FILTER (role <> 'assistant') OVER w AS tops FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, tops, top ORDER BY turn) AS k, last_value(CASE WHEN top THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS head FROM r)
SELECT conv_id, 'c' || conv_id || CASE WHEN top OR tops = 0 THEN '-' || lpad(CASE WHEN top THEN tops ELSE k END::VARCHAR, 2, '0') ELSE '-' || lpad(tops::VARCHAR, 2, '0') || '-' || lpad(k::VARCHAR, 2, '0') END AS id,
  CASE WHEN top OR tops = 0 THEN 1 ELSE 2 END AS level, role AS label, CASE WHEN top OR tops = 0 THEN '' ELSE head END AS breadcrumb FROM s"""


def lexicon_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types and users as terms of the days they occur on: claims, frequencies, tiers."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.date_format("ts", "yyyy-MM-dd")
    records = e.select(F.col("event_id").alias("seq"), day.alias("chunk"), F.col("event_type").alias("domain"), F.concat(F.lit("User "), F.col("user_id")).alias("name"), F.array(F.concat(F.lit("user-"), F.col("user_id") % 7)).alias("aliases"),
                       F.when(F.col("value") > 90, "defined").otherwise("used").alias("role"), F.when(F.col("value") > 50, "high").otherwise("mid").alias("confidence"), F.col("event_type").alias("evidence"))
    chunks = e.groupBy(day.alias("chunk")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), " ").alias("text"))
    seeds = spark.createDataFrame([("User 3",)], "term string")
    tiers = lexicon.admitted(lexicon.merged(records, chunks), seeds, [])
    return tiers.select("term", "df", "domains", "defined_high", "tier")


SQL["lexicon_tiers"] = """WITH e AS (SELECT 'User ' || user_id AS term, strftime(ts, '%Y-%m-%d') AS chunk, event_type AS domain, value > 90 AS d FROM events)
SELECT term, count(DISTINCT chunk) AS df, count(DISTINCT domain) AS domains, bool_or(d) AS defined_high,
  CASE WHEN term = 'User 3' THEN 'seed' WHEN bool_or(d) AND count(DISTINCT chunk) >= 2 THEN 'high' WHEN count(DISTINCT chunk) >= 2 OR count(DISTINCT domain) >= 2 OR bool_or(d) THEN 'mid' END AS tier FROM e GROUP BY term"""


def term_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments by nation get ids after those that are registered."""
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat_ws(" ", "c_mktsegment", "c_nationkey").alias("name"))
    return lexicon.registered(names, spark.createDataFrame([("MACHINERY 1", "term-0007"), ("gone", "term-0003")], "name string, id string"))


SQL["term_ids"] = """WITH n AS (SELECT DISTINCT c_mktsegment || ' ' || c_nationkey AS name FROM customer), r(name, id) AS (VALUES ('MACHINERY 1', 'term-0007'), ('gone', 'term-0003'))
SELECT name, 'term-' || lpad((7 + row_number() OVER (ORDER BY name))::VARCHAR, 4, '0') AS id FROM n ANTI JOIN r USING (name) UNION ALL SELECT * FROM r"""


def dictionary_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest names of a fixed lexicon, each target once a document: t2 where its name stands alone, or in a longer one that is linked already."""
    names = [("ation", "t1"), ("tion", "t2"), ("qu", "t3"), ("ung", "t5"), ("ung", "t6"), (" ", "t7")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lower("text").alias("text"))
    found = docs.select("doc_id", outline.links_udf(spark, names)("text", F.lit("t3")).alias("l"))
    return found.select("doc_id", F.array_join(F.array_sort(F.transform("l", lambda x: x.target)), ",").alias("targets"))


SQL["dictionary_links"] = """WITH n AS (SELECT doc_id, (length(text) - length(replace(lower(text), 'ation', ''))) / 5 AS a, (length(text) - length(replace(lower(text), 'tion', ''))) / 4 AS t FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN a > 0 THEN 't1' END, CASE WHEN t > a OR a > 1 THEN 't2' END) AS targets FROM n"""


def topic_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select("p_partkey", lexicon.topic(F.col("p_name"), {"round": ["ring", "wheel"], "small part": ["small ring", "widget"], "colour": ["red"]}).alias("topic"))


SQL["topic_of_lines"] = """SELECT p_partkey, CASE WHEN lower(p_name) IN ('ring', 'wheel') THEN 'round' WHEN lower(p_name) IN ('small ring', 'widget') THEN 'small part' WHEN lower(p_name) = 'red' THEN 'colour'
  WHEN contains(lower(p_name), 'small ring') THEN 'small part' WHEN contains(lower(p_name), 'widget') THEN 'small part' WHEN contains(lower(p_name), 'wheel') THEN 'round' WHEN contains(lower(p_name), 'ring') THEN 'round' WHEN contains(lower(p_name), 'red') THEN 'colour' END AS topic FROM part"""


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("user_id", "event_id", "ts", F.expr("CASE event_id % 5 WHEN 0 THEN 'add' WHEN 4 THEN 'delete' ELSE 'change' END").alias("change"))


def change_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.coalesced(_feed(spark, sf_dir), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "change")


SQL["change_coalesce"] = """WITH f AS (SELECT user_id, event_id, ts, CASE event_id % 5 WHEN 0 THEN 'add' WHEN 4 THEN 'delete' ELSE 'change' END AS change FROM events),
r AS (SELECT *, first_value(change) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM f)
SELECT user_id, event_id, change FROM r WHERE n = 1 AND NOT (first = 'add' AND change = 'delete')"""


def anchor_after_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A marked "the" of each document's fortieth character on, found again after a line was put before it.

    Marks carry 64 characters of context, as eight don't tell repeats apart that are shorter than the line. Only a "the" before
    the fortieth character can lie nearer than the moved one, and then the mark's whole text before it is among the 64.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.locate("the", "text", 41) > 0)
    at, context = F.locate("the", "text", 41) - 1, 64
    prefix, suffix = F.right(F.left("text", at), F.lit(context)), F.substring(F.col("text"), at + 4, F.lit(context))
    rows = docs.select("doc_id", F.concat(F.lit("New.\n"), "text").alias("now"), at.alias("start"), prefix.alias("prefix"), suffix.alias("suffix"))
    found = changes.anchored(F.col("now"), F.lit("the"), F.col("prefix"), F.col("suffix"), F.col("start"), context)
    return rows.select("doc_id", "start", found.cast("int").alias("found")).withColumn("kept", F.col("found") == F.col("start") + 5)


SQL["anchor_after_edit"] = "SELECT doc_id, strpos(substr(text, 41), 'the')::INT + 39 AS start, strpos(substr(text, 41), 'the')::INT + 44 AS found, true AS kept FROM documents WHERE strpos(substr(text, 41), 'the') > 0"


def stream_tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of the event stream, in one availableNow run; an extension."""
    from stemma.sources.shared import shared_dir

    folder = f"{shared_dir(spark)}/stream/{uuid.uuid4().hex}"
    windows = changes.tumbling(changes.event_stream(spark, sf_dir), "1 day", "1 hour")
    changes.run_once(windows, lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out"), f"{folder}/checkpoint", "complete")
    return spark.read.parquet(f"{folder}/out")


SQL["stream_tumbling_events"] = "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
