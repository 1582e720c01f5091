"""Queries of the training-data operators, their parameters and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stemma.llm import decontaminate as _decontaminate, hmm as _hmm, hosts as _hosts, html as _html, licenses as _licenses, neardup as _neardup, packing as _packing, quality as _quality, toxicity as _toxicity, warc as _warc


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return _decontaminate.digest(_decontaminate.decontaminate(docs, bench))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def vocabulary() -> _packing.Vocabulary:
    import public_tokenizers

    return _packing.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP6_SQL = """
WITH p AS (SELECT row_number() OVER () AS row_id, page_id, coalesce(html, '') AS html FROM pages),
x AS (SELECT *, sha1(html) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', c) - 3, 4)), '') AS bits FROM x),
d AS (SELECT page_id, row_id, octet_length(encode(html)) AS size,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(bits, CAST(5 * i + 1 AS INT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INT), 1) AS INT) + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INT), 1) AS INT)
      + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INT), 1) AS INT) + CAST(substr(bits, CAST(5 * i + 5 AS INT), 1) AS INT), 1)), '') AS digest FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY page_id DESC NULLS LAST, row_id) AS nth, first_value(page_id) OVER (PARTITION BY digest ORDER BY page_id DESC NULLS LAST, row_id) AS best FROM d)
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN best END AS refers_to FROM r
"""


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neardup.classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", *_quality.BASE, "base_failed", "kept", "distance")


def fold(parts: int) -> Column:
    """crc32 of the id as text, modulo parts; an id that is null is in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % parts, F.lit(0))


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hmm.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold(5) == 1)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = fold(4) == 2
    model = _toxicity.train(docs.where(~held), labels.where(~held))
    scored = _toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= _toxicity.THRESHOLD).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


RULES = [_hosts.Rule("block", "net", "/"), _hosts.Rule("allow", "example.net", "/en/"), _hosts.Rule("block", "example.com", "/de/"), _hosts.Rule("allow", "org", "/fr/")]


def op10_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page outcomes are the labels of equal id: good if of quality and not toxic."""
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return _hosts.judge(pages, outcomes, RULES)


OP10_SQL = r"""
WITH p AS MATERIALIZED (
  SELECT page_id,
    translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
o AS (SELECT doc_id AS page_id, min(CAST(quality = 1 AND toxic = 0 AS INT)) AS good FROM labels GROUP BY doc_id),
bare AS (SELECT DISTINCT host, regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), '([^:]):[0-9]*$', '\1'), '\.$', '') AS b FROM p),
lv AS MATERIALIZED (SELECT host, b, string_split(b, '.') AS w, regexp_matches(b, '^[0-9]+(\.[0-9]+){3}$|^\[') AS address, array_to_string(list_slice(string_split(b, '.'), -2, -1), '.') IN (SUFFIXES) AS double FROM bare),
h AS MATERIALIZED (
  SELECT host, any_value(CASE WHEN address THEN '' WHEN double THEN array_to_string(list_slice(w, -2, -1), '.') ELSE w[-1] END) AS suffix,
    any_value(CASE WHEN address THEN b WHEN double THEN array_to_string(list_slice(w, -3, -1), '.') ELSE array_to_string(list_slice(w, -2, -1), '.') END) AS domain,
    count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS good FROM p JOIN lv USING (host) LEFT JOIN o USING (page_id) GROUP BY host),
t AS (SELECT (sum(good) + 1) / (sum(n) + 1) AS top FROM h),
s0 AS MATERIALIZED (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT top FROM t) AS prior FROM h GROUP BY suffix),
m0 AS (SELECT sum(n) AS n, sum(n * (good / n - prior) ** 2) AS between_, sum(prior * (1 - prior) * n) AS within_, count(*) AS k FROM s0 WHERE n > 1),
f0 AS (SELECT CASE WHEN coalesce(n, 0) = 0 OR coalesce(within_, 0) = 0 THEN 10.0 WHEN between_ - within_ / n * k > 0 THEN least(1000.0, greatest(2.0, (within_ / n) / ((between_ - within_ / n * k) / greatest(n - k, 1)) - 1)) ELSE 1000.0 END AS s FROM m0),
d0 AS MATERIALIZED (SELECT suffix, domain, sum(h.n) AS n, sum(h.good) AS good, any_value((s0.good + s * prior) / (s0.n + s)) AS prior FROM h JOIN s0 USING (suffix), f0 GROUP BY suffix, domain),
m1 AS (SELECT sum(n) AS n, sum(n * (good / n - prior) ** 2) AS between_, sum(prior * (1 - prior) * n) AS within_, count(*) AS k FROM d0 WHERE n > 1),
f1 AS (SELECT CASE WHEN coalesce(n, 0) = 0 OR coalesce(within_, 0) = 0 THEN 10.0 WHEN between_ - within_ / n * k > 0 THEN least(1000.0, greatest(2.0, (within_ / n) / ((between_ - within_ / n * k) / greatest(n - k, 1)) - 1)) ELSE 1000.0 END AS s FROM m1),
h0 AS MATERIALIZED (SELECT host, h.n, h.good, (d0.good + s * prior) / (d0.n + s) AS prior FROM h JOIN d0 USING (suffix, domain), f1),
m2 AS (SELECT sum(n) AS n, sum(n * (good / n - prior) ** 2) AS between_, sum(prior * (1 - prior) * n) AS within_, count(*) AS k FROM h0 WHERE n > 1),
f2 AS (SELECT CASE WHEN coalesce(n, 0) = 0 OR coalesce(within_, 0) = 0 THEN 10.0 WHEN between_ - within_ / n * k > 0 THEN least(1000.0, greatest(2.0, (within_ / n) / ((between_ - within_ / n * k) / greatest(n - k, 1)) - 1)) ELSE 1000.0 END AS s FROM m2),
r AS MATERIALIZED (SELECT host, greatest(good + s * prior, 1e-9) AS a, greatest(n - good + s * (1 - prior), 1e-9) AS b FROM h0, f2),
-- the distribution function at 0.5 by Simpson's rule after x = t^m / 2, which has a bounded integrand for any a
z AS (SELECT host, sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * CASE WHEN i = 0 THEN 0 ELSE exp(lgamma(a + b) - lgamma(a) - lgamma(b) + (a - 1) * ln(0.5 * pow(i / 4000.0, m)) + (b - 1) * ln(1 - 0.5 * pow(i / 4000.0, m)) + ln(0.5 * m) + (m - 1) * ln(i / 4000.0)) END) / 12000 AS below
  FROM (SELECT *, greatest(1, ceil(4 / a)) AS m FROM r), unnest(range(4001)) AS t(i) GROUP BY host),
ru(rule, v, rh, rp) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
w AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
  FROM (SELECT *, row_number() OVER () AS row_id FROM p) q LEFT JOIN ru ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, host, path, row_id)
SELECT page_id, host, path, rule,
  coalesce(v, CASE WHEN below > 0.95 THEN 'block' ELSE 'allow' END) AS verdict,
  round(a / (a + b), 6) AS reputation
FROM w JOIN r USING (host) JOIN z USING (host)
""".replace("SUFFIXES", ", ".join(f"'{x}'" for x in _hosts.SUFFIXES))


OP1_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS MATERIALIZED (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (
  SELECT uid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM d, (SELECT DISTINCT n FROM bw) AS l, unnest(range(1, len(w) - n + 2)) AS t(i)),
h AS MATERIALIZED (SELECT uid, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hit AS (SELECT uid, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + n)) AS t(p) GROUP BY uid),
its AS (SELECT uid, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h WHERE item_id IS NOT NULL GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (uid) LEFT JOIN its USING (uid)
"""


# The columns that SQL can express of operators whose others it can't.


def licence_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_licenses(spark, sf_dir).select("doc_id", "n_base", "first_word", "last_word", "base_labels")


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_quality(spark, sf_dir).select("doc_id", *_quality.BASE, "base_failed")


def unigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_hmm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


LICENCE_PLACES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p(label, words) AS (VALUES ('mit', ['under', 'the', 'mit', 'license']), ('apache-2', ['apache', 'license', 'version', '2']), ('cc-by-nc', ['cc', 'by', 'nc'])),
h AS (SELECT uid, label, i - 1 AS place FROM d, p, unnest(range(1, len(w) - len(words) + 2)) AS t(i) WHERE list_slice(w, i, i + len(words) - 1) = words),
g AS (SELECT uid, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY uid)
SELECT doc_id, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g USING (uid)
"""

TEXT_STATISTICS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
g AS (SELECT uid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS t(i)),
c AS (SELECT *, count(*) OVER (PARTITION BY uid, g) AS k FROM g),
r AS (SELECT uid, count(DISTINCT i + j) AS n FROM c, (VALUES (0), (1), (2)) AS o(j) WHERE k > 1 GROUP BY uid),
l AS (SELECT uid, count(*) - count(DISTINCT x) AS n FROM (SELECT uid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^ 	-
]') GROUP BY uid),
s AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN l USING (uid) LEFT JOIN r USING (uid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
"""

UNIGRAM_SCORES_SQL = r"""
WITH RECURSIVE ids AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL),
-- crc32 bit by bit
c(doc_id, s, i, bit, v) AS (SELECT doc_id, s, 1, 0, xor(4294967295::BIGINT, ascii(s[1])::BIGINT) FROM ids
  UNION ALL SELECT doc_id, s, i + bit // 7, (bit + 1) % 8, xor(CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, CASE WHEN bit = 7 AND i < length(s) THEN ascii(s[i + 1])::BIGINT ELSE 0 END) FROM c WHERE i <= length(s)),
f AS (SELECT doc_id, xor(v, 4294967295::BIGINT) % 5 = 1 AS held_out FROM c WHERE i = length(s) + 1),
d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(held_out, false) AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+'), ' ') AS w FROM documents LEFT JOIN f USING (doc_id)),
t AS (SELECT uid, unnest(w) AS x FROM d), n AS (SELECT x, count(*) AS c FROM t JOIN d USING (uid) WHERE NOT held_out GROUP BY x), a AS (SELECT sum(c) AS n, count(*) AS v FROM n),
p AS (SELECT uid, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.5::DOUBLE) / (a.n + 0.5::DOUBLE * (a.v + 1)))) AS base FROM t LEFT JOIN n USING (x), a GROUP BY uid)
SELECT doc_id, held_out, n_tokens, n_known, (SELECT n FROM a)::BIGINT AS train_tokens, round(base, 4) AS base_score FROM d JOIN p USING (uid)
"""

_BASES = ("licence_places", "text_statistics", "unigram_scores")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if (k.startswith("op") or k == "pipeline" or k in _BASES) and callable(v)}


def oracle_sql() -> dict[str, str]:
    own = {k.split("_")[0] if k.startswith("op") else k: k for k in queries()}
    return {own[k.removesuffix("_SQL").lower()]: v for k, v in globals().items() if k.endswith("_SQL") and k.removesuffix("_SQL").lower() in own}
