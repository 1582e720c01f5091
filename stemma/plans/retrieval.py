"""Retrieval and text queries on the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stemma.functions import text as T
from stemma.operators import catalog, graph, retrieve, tables

QUERY = "of the thing"
GRAMS = T.bigrams(QUERY)
SQL: dict[str, str] = {}
NOT_QUERIES = ("corpus",)


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents, dealt to all cores if they have fewer splits than those: then they are at most cores * maxPartitionBytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select(*columns) if columns else docs
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, "doc_id", "text", "lang").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), F.col("lang").alias("domain"))


_CORPUS = "corpus AS (SELECT doc_id AS id, string_split(text, chr(10))[1] AS title, text AS body, lang AS domain FROM documents)"
_HITS = {c: " + ".join(f"CAST(contains(lower({c}), '{g}') AS INT)" for g in GRAMS) for c in ("title", "body")}
_SCORED = f"""{_CORPUS},
sig AS (SELECT *, ({_HITS['title']}) / {len(GRAMS)}.0::DOUBLE AS ct, ({_HITS['body']}) / {len(GRAMS)}.0::DOUBLE AS cb,
  contains(lower(title), '{QUERY}') OR contains(lower(title), '{T.squeezed(QUERY)}') AS it, contains(lower(body), '{QUERY}') OR contains(lower(body), '{T.squeezed(QUERY)}') AS ib,
  CASE WHEN len(list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '(?:\\.{{3,}}|…+)[ \\t]*[0-9]+[ \\t]*$'))) >= 20 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS damp FROM corpus),
scored AS (SELECT *, CASE WHEN it THEN 1000.0::DOUBLE ELSE 0.0::DOUBLE END + 300 * ct + damp * (CASE WHEN ib THEN 500.0::DOUBLE ELSE 0.0::DOUBLE END + 150 * cb) AS score,
  CASE WHEN it THEN 'title' WHEN ib THEN 'body' ELSE 'fuzzy' END AS via FROM sig WHERE ct > 0 OR cb > 0)"""


def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieve.top(retrieve.scored(corpus(spark, sf_dir), QUERY), 8)
    return best.select("id", F.round("score", 6).alias("score"), "via", T.excerpt(F.col("body"), QUERY, 120).alias("excerpt"))


_EXCERPT = f"""flat AS (SELECT *, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS f FROM {{src}}),
placed AS (SELECT *, coalesce({', '.join(f"nullif(strpos(lower(f), '{w}'), 0)" for w in dict.fromkeys([QUERY, T.squeezed(QUERY), *GRAMS]))}, 1) AS p FROM flat),
started AS (SELECT *, greatest(1, least(p - 60, length(f) - 119)) AS s FROM placed)"""
_CUT = "CASE WHEN length(f) <= 120 THEN f ELSE (CASE WHEN s > 1 THEN '…' ELSE '' END) || substr(f, s, 120) || (CASE WHEN s + 119 < length(f) THEN '…' ELSE '' END) END AS excerpt"
SQL["search_ranked"] = f"WITH {_SCORED}, best AS (SELECT * FROM scored ORDER BY score DESC, id LIMIT 8), {_EXCERPT.format(src='best')} SELECT id, round(score, 6) AS score, via, {_CUT} FROM started"


def search_domain_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieve.top(retrieve.scored(corpus(spark, sf_dir).where(F.col("domain").isin("de", "es")), QUERY), 8)
    return best.select("id", "domain", F.round("score", 6).alias("score"))


SQL["search_domain_filtered"] = f"WITH {_SCORED} SELECT id, domain, round(score, 6) AS score FROM (SELECT * FROM scored WHERE domain IN ('de', 'es') ORDER BY score DESC, id LIMIT 8)"


def search_via_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.scored(corpus(spark, sf_dir), QUERY).groupBy("domain", "via").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"))


SQL["search_via_label"] = f"WITH {_SCORED} SELECT domain, via, count(*) AS n, round(max(score), 6) AS best FROM scored GROUP BY ALL"


def search_and_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.scored(corpus(spark, sf_dir), QUERY, mode="and").select("id", "via")


SQL["search_and_mode"] = f"WITH {_SCORED} SELECT id, via FROM scored WHERE " + " AND ".join(f"(contains(lower(title), '{w}') OR contains(lower(body), '{w}'))" for w in QUERY.split())


def search_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of three generators: text signals, token postings, names in titles."""
    own = corpus(spark, sf_dir)
    text = retrieve.scored(own, QUERY).select("id", "score", "via")
    listed = retrieve.postings(own).where("token = 'thing'").groupBy("id").agg((F.sum("times") * 10.0).alias("score")).withColumn("via", F.lit("token"))
    titled = own.where(F.contains(F.lower("title"), F.lit("the"))).select("id", F.lit(5.0).alias("score"), F.lit("name").alias("via"))
    return retrieve.fuse(text, listed, titled).select("id", F.round("score", 6).alias("score"), F.array_join("via", ",").alias("via"))


_TOKEN_RE = r"([\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]|(?:[^\s\p{P}\p{S}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]|[-._''])+)"
SQL["search_fused"] = f"""WITH {_SCORED}, t AS (SELECT id, unnest(list_concat(regexp_extract_all(lower(title), '{_TOKEN_RE}'), regexp_extract_all(lower(body), '{_TOKEN_RE}'))) AS token FROM corpus),
c AS (SELECT id, score, 0 AS r, via FROM scored UNION ALL SELECT id, count(*) * 10.0::DOUBLE, 1, 'token' FROM t WHERE token = 'thing' GROUP BY id UNION ALL SELECT id, 5.0::DOUBLE, 2, 'name' FROM corpus WHERE contains(lower(title), 'the'))
SELECT id, round(sum(score), 6) AS score, string_agg(via, ',' ORDER BY r) AS via FROM c GROUP BY id"""


def excerpt_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("id", T.excerpt(F.col("body"), QUERY, 120).alias("excerpt"))


SQL["excerpt_window"] = f"WITH {_CORPUS}, {_EXCERPT.format(src='corpus')} SELECT id, {_CUT} FROM started"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.posexplode(F.split(F.lower("text"), r"[^a-z]+")).alias("pos", "name"))
    return words.where("length(name) >= 6").select("name", (F.col("item_id") * 10000 + F.col("pos")).alias("seq"))


_NAMES = "names AS (SELECT string_split_regex(lower(text), '[^a-z]+')[i + 1] AS name, item_id * 10000 + i AS seq FROM benchmark, unnest(range(len(string_split_regex(lower(text), '[^a-z]+')))) AS t(i) WHERE length(string_split_regex(lower(text), '[^a-z]+')[i + 1]) >= 6)"


def term_containment_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _names(spark, sf_dir).select("name").distinct().withColumn("weight", F.when(F.length("name") > 8, 1.0).otherwise(0.5))
    return retrieve.contained_names(corpus(spark, sf_dir).select("id", F.col("title").alias("text")), names, 5)


SQL["term_containment_confidence"] = f"""WITH {_CORPUS}, {_NAMES}, n AS (SELECT DISTINCT name, CASE WHEN length(name) > 8 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM names),
f AS (SELECT id, name, least(1.0::DOUBLE, length(name)::DOUBLE / length(title)) * weight AS confidence FROM corpus JOIN n ON contains(lower(title), name))
SELECT id, name, round(confidence, 6) AS confidence FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence DESC, name) <= 5"""


def term_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.suggestions(_names(spark, sf_dir), "tion", 10)


SQL["term_suggestions"] = f"WITH {_NAMES} SELECT name, min(seq)::BIGINT AS seq FROM names WHERE contains(name, 'tion') OR contains('tion', name) GROUP BY name ORDER BY seq LIMIT 10"


def tokens_and_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.frequencies(corpus(spark, sf_dir).withColumn("title", F.lit("")))


SQL["tokens_and_df"] = f"SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_TOKEN_RE}')) AS token FROM documents) GROUP BY token"


def prefix_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = retrieve.postings(corpus(spark, sf_dir)).where(F.col("token").startswith("thin"))
    return hit.groupBy("id").agg(F.count_distinct("token").alias("tokens"), F.sum("times").alias("times"))


SQL["prefix_postings"] = f"""WITH {_CORPUS} SELECT id, count(DISTINCT token) AS tokens, count(*) AS times FROM (SELECT id, unnest(list_concat(regexp_extract_all(lower(title), '{_TOKEN_RE}'), regexp_extract_all(lower(body), '{_TOKEN_RE}'))) AS token FROM corpus) WHERE starts_with(token, 'thin') GROUP BY id"""


def estimate_tokens_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth text has its word ends as full-width commas, which count as a token each."""
    text = F.when(F.col("doc_id") % 5 == 0, F.replace("text", F.lit(" "), F.lit("，"))).otherwise(F.col("text"))
    rows = _documents(spark, sf_dir, "doc_id", "source", "text").select("doc_id", "source", T.estimate_tokens(text).alias("tokens"))
    return catalog.budget(rows, "tokens", [F.col("doc_id")], catalog.budget_cap(), ["source"]).select("doc_id", "source", "tokens", F.col("spent").cast("long").alias("spent"))


SQL["estimate_tokens_budget"] = """WITH t AS (SELECT doc_id, source, CAST(floor(w + (length(text) - w) / 4.0 + 0.5) AS BIGINT) AS tokens FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN length(text) - length(replace(text, ' ', '')) ELSE 0 END AS w FROM documents)),
s AS (SELECT *, CAST(sum(tokens + 2) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS spent, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM t)
SELECT doc_id, source, tokens, spent FROM s WHERE spent <= 11000 OR nth = 1"""

TOPICS = {"motion": ["tion", "ation"], "place": ["in the", "where"], "being": ["is", "are"], "langue": ["eau", "eux"], "amt": ["keit", "ung"]}


def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic whose contained keywords are longest in all, with a margin of two over the next, else null."""
    low = F.lower("text")
    scores = [sum((F.when(F.contains(low, F.lit(k)), len(k)).otherwise(0) for k in kws), F.lit(0)) for kws in TOPICS.values()]
    ranked = F.sort_array(F.array(*[F.struct(s.alias("s"), F.lit(t).alias("t")) for s, t in zip(scores, TOPICS)]), False)
    rows = _documents(spark, sf_dir).select("doc_id", ranked.alias("r"))
    return rows.select("doc_id", F.when((F.col("r")[0].s > 0) & (F.col("r")[0].s - F.col("r")[1].s >= 2), F.col("r")[0].t).alias("topic"))


_TOPIC_ROWS = " UNION ALL ".join(f"SELECT doc_id, '{t}' AS t, " + " + ".join(f"CASE WHEN contains(lower(text), '{k}') THEN {len(k)} ELSE 0 END" for k in kws) + " AS s FROM documents" for t, kws in TOPICS.items())
SQL["classify_documents"] = f"WITH s AS ({_TOPIC_ROWS}), r AS (SELECT *, row_number() OVER w AS n, lead(s) OVER w AS next FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY s DESC, t DESC)) SELECT doc_id, CASE WHEN s > 0 AND s - next >= 2 THEN t END AS topic FROM r WHERE n = 1"


def reject_reason_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    words = F.size(T.tokens(F.col("text")))
    rules = {"short": words < 50, "shouting": F.contains("text", F.lit("!!")), "foreign": ~F.col("lang").isin("en", "de"), "symbols": F.contains("text", F.lit("%%%"))}
    return tables.rejects(docs, rules).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


SQL["reject_reason_gates"] = f"""SELECT doc_id, concat_ws(',', CASE WHEN len(regexp_extract_all(lower(text), '{_TOKEN_RE}')) < 50 THEN 'short' END, CASE WHEN contains(text, '!!') THEN 'shouting' END,
  CASE WHEN lang NOT IN ('en', 'de') THEN 'foreign' END, CASE WHEN contains(text, '%%%') THEN 'symbols' END) AS reasons FROM documents"""


def doc_containment_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document without those that its first line contains or repeats, white space aside."""
    tight = lambda c: F.regexp_replace(c, r"\s", "")
    rows = _documents(spark, sf_dir).select("doc_id", tight(F.substring_index("text", "\n", 1)).alias("head"), F.split("text", "\n").alias("lines"))
    kept = F.filter(F.slice("lines", 2, F.size("lines")), lambda x: (tight(x) != "") & ~F.contains(F.col("head"), tight(x)))
    return rows.select("doc_id", (F.size("lines") - 1).cast("long").alias("n_lines"), F.size(kept).cast("long").alias("n_kept"))


SQL["doc_containment_dedupe"] = r"""WITH r AS (SELECT doc_id, regexp_replace(string_split(text, chr(10))[1], '\s', '', 'g') AS head, string_split(text, chr(10)) AS lines FROM documents)
SELECT doc_id, len(lines) - 1 AS n_lines, len(list_filter(lines[2:], lambda x: regexp_replace(x, '\s', '', 'g') <> '' AND NOT contains(head, regexp_replace(x, '\s', '', 'g')))) AS n_kept FROM r"""


def locate_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("slug"), F.col("p_name").alias("title"), F.col("p_partkey").alias("seq"))
    needles = spark.createDataFrame([("small",), ("ring",), ("econ",), ("nowhere",)], "needle string")
    return retrieve.located(part, needles)


SQL["locate_tiered"] = """WITH n(needle) AS (VALUES ('small'), ('ring'), ('econ'), ('nowhere')),
h AS (SELECT needle, CASE WHEN starts_with(lower(p_name), needle) THEN 1 WHEN contains(lower(p_name), needle) THEN 2 ELSE 3 END AS tier, p_type AS slug, p_partkey AS seq FROM part JOIN n ON contains(lower(p_name), needle) OR contains(lower(p_type), needle))
SELECT needle, tier::INT AS tier, slug FROM h QUALIFY row_number() OVER (PARTITION BY needle ORDER BY tier, seq, slug) = 1"""


def status_and_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    label = F.concat(F.lit("issued "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    code = F.when(F.col("o_orderstatus").startswith("F"), "final").when(F.col("o_orderstatus").startswith("O"), "open").otherwise("partial")
    return o.groupBy(T.first_year(label).alias("year"), code.alias("status")).agg(F.count("*").alias("n"))


SQL["status_and_year"] = "SELECT nullif(regexp_extract('issued ' || strftime(o_orderdate, '%Y-%m-%d'), '((?:19|20)[0-9]{2})', 1), '') AS year, CASE WHEN starts_with(o_orderstatus, 'F') THEN 'final' WHEN starts_with(o_orderstatus, 'O') THEN 'open' ELSE 'partial' END AS status, count(*) AS n FROM orders GROUP BY ALL"

_NUMERALS = [("一百四十九", 149), ("十一", 11), ("零", None), ("二〇", None), ("二千零三十", 2030), ("12", 12), ("千五百", 1500), ("", None)]


def cn_numeral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n, _ in _NUMERALS], "numeral string").select("numeral", T.cn_number(F.col("numeral")).alias("value"))


SQL["cn_numeral"] = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {'NULL' if v is None else v}::INT)" for n, v in _NUMERALS) + ") AS t(numeral, value)"


def hash_fnv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", T.fnv1a(F.col("n_name")).alias("fnv"), F.substring(F.md5("n_name"), 1, 12).alias("short"))


SQL["hash_fnv"] = """WITH RECURSIVE h(n_name, i, v) AS (SELECT n_name, 0, 2166136261::BIGINT FROM nation UNION ALL SELECT n_name, i + 1, (xor(v, ascii(substr(n_name, i + 1, 1))::BIGINT) * 16777619::BIGINT) % 4294967296 FROM h WHERE i < length(n_name))
SELECT n_name, v::BIGINT AS fnv, substr(md5(n_name), 1, 12) AS short FROM h WHERE i = length(n_name)"""
