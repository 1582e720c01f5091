"""Ranked retrieval over a corpus (id, title, body, domain): signals, relevance floor, labels, excerpts, name matching."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stemma.functions import text as T


@dataclass(frozen=True)
class Weights:
    """Points of each signal."""

    exact_title: float = 1000
    exact_body: float = 500
    cover_title: float = 300
    cover_body: float = 150
    term_page: float = 400
    term_source: float = 100
    contents_factor: float = 0.1
    article: float = 2400
    article_weak: float = 1200
    cited: float = 250
    clash: float = 0.25


def contents_factor(body: Column, w: Weights) -> Column:
    """Damping of bodies that are a table of contents: twenty or more lines of dots and a number."""
    lines = F.regexp_count(body, F.lit(r"(?m)(?:\.{3,}|…+)[ \t]*[0-9]+[ \t]*$"))
    return F.when(lines >= 20, w.contents_factor).otherwise(1.0)


def scored(corpus: DataFrame, query: str, w: Weights = Weights(), mode: str = "or") -> DataFrame:
    """corpus with score, via and the coverages, above the floor: some bigram (mode "and": every word) in title or body.

    A query without bigrams has no floor.
    """
    grams, raw, tight = T.bigrams(query), query.lower().strip(), T.squeezed(query)
    low_title, low_body = F.lower("title"), F.lower("body")
    exact = lambda c: F.contains(c, F.lit(raw)) | F.contains(c, F.lit(tight))
    rows = corpus.withColumns({"cover_title": T.coverage(low_title, grams), "cover_body": T.coverage(low_body, grams), "in_title": exact(low_title), "in_body": exact(low_body), "damp": contents_factor(F.col("body"), w)})
    if grams:
        rows = rows.where((F.col("cover_title") > 0) | (F.col("cover_body") > 0))
    if mode == "and":
        for word in raw.split():
            rows = rows.where(F.contains(low_title, F.lit(word)) | F.contains(low_body, F.lit(word)))
    points = F.when(F.col("in_title"), w.exact_title).otherwise(0.0) + w.cover_title * F.col("cover_title") + F.col("damp") * (F.when(F.col("in_body"), w.exact_body).otherwise(0.0) + w.cover_body * F.col("cover_body"))
    via = F.when(F.col("in_title"), "title").when(F.col("in_body"), "body").otherwise("fuzzy")
    return rows.withColumns({"score": points, "via": via})


def top(rows: DataFrame, limit: int) -> DataFrame:
    """Best score first, then ids by natural order; planned as a bounded heap a task, not as a sort."""
    return rows.orderBy(F.col("score").desc(), T.natural_key(F.col("id").cast("string"))).limit(limit)


def fuse(*candidates: DataFrame) -> DataFrame:
    """Candidates (id, score, via) of several generators: points add up, labels in generator order."""
    rows = [c.select("id", "score", F.lit(i).alias("rank"), "via") for i, c in enumerate(candidates)]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    labels = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "via"))), lambda x: x.via))
    return both.groupBy("id").agg(F.sum("score").alias("score"), labels.alias("via"))


def contained_names(texts: DataFrame, names: DataFrame, most: int, anchor: int = 4) -> DataFrame:
    """id, name, confidence of the ``most`` surest names (of two characters or more) contained in each text.

    texts: id, text; names: name, weight. Instead of testing all pairs, every ``anchor`` characters of a text look up the
    names that begin with them, and the rest of the name is compared in place; shorter names are looked up whole. A name
    longer than ``near`` is first compared as far as that, and then with the whole texts of the few that are left.
    """
    near = 64
    low = texts.select("id", F.lower("text").alias("text"))
    own = names.where("length(name) >= 2").withColumn("key", F.substring("name", 1, anchor))
    at = low.where("length(text) >= 2").select("id", "text", F.explode(F.sequence(F.lit(1), F.length("text") - 1)).alias("at"))
    rest = at.select("id", F.length("text").alias("size"), F.substring("text", F.col("at"), F.lit(near)).alias("rest"))
    keys = F.array_distinct(F.array(*[F.substring("rest", 1, n) for n in range(2, anchor + 1)]))
    hit = rest.select("*", F.explode(keys).alias("key")).join(own, "key").where(F.col("rest").startswith(F.left("name", F.lit(near)))).select("id", "size", "name", "weight").distinct()
    long = hit.where(F.length("name") > near).join(low, "id").where(F.contains("text", F.col("name"))).select("id", "size", "name", "weight")
    found = hit.where(F.length("name") <= near).unionByName(long.distinct())
    found = found.select("id", "name", (F.least(F.lit(1.0), F.length("name") / F.col("size")) * F.col("weight")).alias("confidence"))
    order = W.partitionBy("id").orderBy(F.col("confidence").desc(), "name")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("id", "name", F.round("confidence", 6).alias("confidence"))


def suggestions(names: DataFrame, query: str, most: int = 10) -> DataFrame:
    """Names that contain the query or are contained in it, in order of registration (seq)."""
    q = query.lower()
    near = F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lit(q), F.lower("name"))
    return names.where(near).groupBy("name").agg(F.min("seq").alias("seq")).orderBy("seq").limit(most)


def postings(corpus: DataFrame) -> DataFrame:
    """id, field, token, times."""
    fields = F.array(F.struct(F.lit("title").alias("field"), T.tokens(F.col("title")).alias("tokens")), F.struct(F.lit("body").alias("field"), T.tokens(F.col("body")).alias("tokens")))
    rows = corpus.select("id", F.inline(fields)).select("id", "field", F.explode("tokens").alias("token"))
    return rows.groupBy("id", "field", "token").agg(F.count("*").alias("times"))


def frequencies(corpus: DataFrame) -> DataFrame:
    """token, df (rows that hold it), cf (how often it occurs) of title and body.

    Counts are added up by row and token first; sorting a row's tokens in place instead, for one shuffle, took twice the time.
    """
    rows = corpus.select("id", F.explode(F.concat(T.tokens(F.col("title")), T.tokens(F.col("body")))).alias("token"))
    return rows.groupBy("id", "token").agg(F.count("*").alias("times")).groupBy("token").agg(F.count("*").alias("df"), F.sum("times").alias("cf"))


def located(rows: DataFrame, needles: DataFrame, most: int = 100_000) -> DataFrame:
    """For each needle the first row (seq) by tier: title prefix, title substring, slug substring.

    rows: slug, title, seq; needles: needle, a stated set that is broadcast if it is measured to be below ``most`` rows.
    """
    n, low = F.lower("needle"), F.lower("title")
    tier = F.when(low.startswith(n), 1).when(F.contains(low, n), 2).when(F.contains(F.lower("slug"), n), 3)
    asked = F.broadcast(needles) if needles.limit(most + 1).count() <= most else needles
    hit = rows.join(asked, F.contains(low, n) | F.contains(F.lower("slug"), n)).withColumn("tier", tier)
    best = hit.groupBy("needle").agg(F.min(F.struct("tier", "seq", "slug")).alias("b"))
    return best.select("needle", F.col("b.tier").alias("tier"), F.col("b.slug").alias("slug"))
