"""Queries that name an article of law: registry of names, exact look-up, clashes, candidates, entries of containers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stemma.functions import law as L, text as T
from stemma.operators import retrieve


@dataclass(frozen=True)
class Name:
    alias: str
    law: str
    domain: str
    kind: str  # full, alias, short or legacy


def registry(books: list[dict], legacy: dict[str, str] | None = None) -> list[Name]:
    """Names of the laws that books are, the longest first; the first book that has a name keeps it.

    books: domain, law_name, law_alias, short; legacy: alias -> domain.
    """
    names: dict[str, Name] = {}
    by_domain = {b["domain"]: b["law_name"] for b in books if b.get("law_name")}
    for kind, field in (("full", "law_name"), ("alias", "law_alias"), ("short", "short")):
        for b in books:
            if b.get("law_name") and b.get(field):
                names.setdefault(L.normal_name(b[field]), Name(b[field], b["law_name"], b["domain"], kind))
    for alias, domain in (legacy or {}).items():
        if domain in by_domain:
            names.setdefault(L.normal_name(alias), Name(alias, by_domain[domain], domain, "legacy"))
    return sorted(names.values(), key=lambda n: (-len(L.normal_name(n.alias)), n.alias))


@dataclass(frozen=True)
class Asked:
    """What a query that names an article means."""

    law: str
    domain: str
    number: int
    explicit: bool
    missing: bool


def parse(query: str, names: list[Name], articles: set[tuple[str, int]], default: Name | None = None) -> Asked | None:
    """The article that a query names; None if it names none, or a law that isn't known; a bare number is the default law's."""
    m = L._ARTICLE.search(query)
    number = L.number(m[1]) if m else None
    if not number:
        return None
    left = L.normal_name(query[: m.start()])
    named = next((n for n in names if left.endswith(L.normal_name(n.alias))), None)
    if named is None and (re.search(r"[法例则定约]$", left) or default is None):
        return None
    law = named or default
    return Asked(law.law, law.domain, number, named is not None, (law.law, number) not in articles)


@dataclass(frozen=True)
class Resolved:
    kind: str  # node, key, unknown law, no such article, candidates, nothing
    law: str | None = None
    number: int | None = None
    node: str | None = None


def resolve(text: str, names: list[Name], articles: dict[tuple[str, int], str]) -> Resolved:
    """What an argument of an exact look-up stands for. articles: (law, number) -> node id."""
    text = text.strip()
    if text in set(articles.values()):
        law, number = next(k for k, v in articles.items() if v == text)
        return Resolved("node", law, number, text)
    m = L._ARTICLE.search(text)
    number = L.number(m[1]) if m else None
    if not number:
        return Resolved("nothing")
    left = L.normal_name(text[: m.start()])
    if not left:
        return Resolved("candidates", None, number)
    named = next((n for n in names if left.endswith(L.normal_name(n.alias))), None)
    if named is None:
        return Resolved("unknown law", None, number)
    node = articles.get((named.law, number))
    return Resolved("key" if node else "no such article", named.law, number, node)


def candidates(articles: DataFrame, number: int, first: list[str], most: int = 20) -> DataFrame:
    """Articles of that number: those of the laws in ``first`` in that order, then the others by book. articles: law, number, node_id, seq."""
    at = F.nullif(F.array_position(F.array(*map(F.lit, first)), F.col("law")), F.lit(0)) if first else F.lit(None)
    return articles.where(F.col("number") == number).orderBy(at.asc_nulls_last(), "seq", "law").limit(most)


def title_numbers(title: Column) -> Column:
    """The article numbers that a title names."""
    found = F.regexp_extract_all(title, F.lit(r"第\s*([0-9]+|[一二三四五六七八九十百千零]+)\s*条"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, T.cn_number), lambda x: x.isNotNull()))


def clashes(rows: DataFrame, asked: Asked, law_domains: list[str], w: retrieve.Weights = retrieve.Weights()) -> DataFrame:
    """rows with the score damped where the title names other articles only, or, if the query names the law, where the row is of
    another law; the article itself and what cites it are exempt.

    rows: id, title, domain, score, via (array).
    """
    numbers = title_numbers(F.col("title"))
    other_number = (F.size(numbers) > 0) & ~F.array_contains(numbers, asked.number)
    other_law = F.lit(asked.explicit) & (F.col("domain") != asked.domain) & F.col("domain").isin(law_domains)
    exempt = F.arrays_overlap("via", F.array(F.lit("law"), F.lit("cited")))
    return rows.withColumn("score", F.when(~exempt & (other_number | other_law), F.col("score") * w.clash).otherwise(F.col("score")))


def chinese_form(law: str, label: Column) -> Column:
    """The asked article as the node's label writes it: the law's name and 第…条 in Chinese numerals; null for other labels."""
    return F.nullif(F.concat(F.lit(law), F.regexp_extract(label, r"^(第[一二三四五六七八九十百零]+条)", 1)), F.lit(law))


def entries(children: DataFrame, bodies: DataFrame, containers: DataFrame, depth: int = 3) -> DataFrame:
    """container, entry: the first child with own text; if no child has any, the first below the children, child by child.

    children: parent, id; bodies: id, own; containers: id.
    """
    texts = bodies.where(F.trim(F.coalesce("own", F.lit(""))) != "").select("id", F.lit(True).alias("filled"))
    layer = containers.select(F.col("id").alias("container"), "id", F.lit("").alias("path"))
    found = None
    for d in range(1, depth + 1):
        layer = layer.withColumnRenamed("id", "parent").join(children, "parent").select("container", "id", F.concat("path", F.lit("/"), T.natural_key(F.col("id"))).alias("path"))
        hit = layer.join(texts, "id").select("container", "id", F.struct(F.lit(min(d, 2)).alias("direct"), "path").alias("order"))
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy("container").agg(F.min_by("id", "order").alias("entry"))


def ranked(corpus: DataFrame, query: str, asked: Asked | None, articles: DataFrame, citations: DataFrame, law_domains: list[str], limit: int, w: retrieve.Weights = retrieve.Weights()) -> DataFrame:
    """id, score, via of a query: text signals, the named article and what cites it, clashes damped, labels by rank.

    corpus: id, title, body, domain; articles: law, number, node_id; citations: node_id, law, article.
    """
    parts = [retrieve.scored(corpus, query, w).select("id", "score", "via")]
    if asked and not asked.missing:
        points = w.article if asked.explicit else w.article_weak
        own = articles.where((F.col("law") == asked.law) & (F.col("number") == asked.number)).select(F.col("node_id").alias("id"), F.lit(points).alias("score"), F.lit("law").alias("via"))
        citing = citations.where((F.col("law") == asked.law) & (F.col("article") == asked.number)).select(F.col("node_id").alias("id"), F.lit(w.cited).alias("score"), F.lit("cited").alias("via")).distinct()
        parts += [own, citing]
    rows = retrieve.fuse(*parts).join(corpus.select("id", "title", "domain"), "id")
    rows = clashes(rows, asked, law_domains, w) if asked else rows
    label = F.when(F.array_contains("via", "law"), "law").when(F.array_contains("via", "title"), "title").when(F.array_contains("via", "body"), "body").otherwise(F.coalesce(F.try_element_at("via", F.lit(1)), F.lit("fuzzy")))
    return retrieve.top(rows.withColumn("via", label), limit).select("id", "score", "via")
