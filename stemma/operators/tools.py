"""The query interface of a knowledge base: thirteen read-only calls, each returning a DataFrame.

Arguments are clamped on the driver; answers are bounded by their limits and by an output budget in estimated tokens.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stemma.functions import law as L, text as T
from stemma.operators import articles as A, catalog, graph, retrieve, tree

#: The order in which related nodes' types are shown where groups are of one size.
TYPES = ("hierarchy", "xref", "colaw", "lawref", "termref", "termlaw", "termrel", "termco")


def clamp(value: float | None, low: int, high: int, default: int) -> int:
    return default if value is None or not math.isfinite(value) else int(min(high, max(low, value)))


@dataclass
class KnowledgeBase:
    """nodes: id, label, level, domain, breadcrumb, summary; bodies: id, own, full; edges: src, dst, type, weight;
    books: domain, title, short, country, field, doc_type, law_name, status, chars; articles: law, number, node_id;
    citations: node_id, law, article, n; terms: id, label, aliases, definition. Tables may be of any size.
    """

    nodes: DataFrame
    bodies: DataFrame
    edges: DataFrame
    books: DataFrame
    articles: DataFrame
    citations: DataFrame
    terms: DataFrame
    laws: dict[str, str] = field(default_factory=dict)
    #: The law that a number alone is read as; the laws whose articles come first among candidates.
    default_law: str | None = None
    first_laws: tuple[str, ...] = ()

    def opened(self, domains: list[str]) -> "KnowledgeBase":
        """The part of the base in these domains, terms kept; whatever refers to a closed node goes with it."""
        nodes = self.nodes.where(F.col("domain").isin(domains) | (F.col("level") == "term"))
        ids = nodes.select(F.col("id").alias("node_id"))
        semi = lambda df: df.join(ids, "node_id", "left_semi")
        bodies = self.bodies.join(nodes.select("id"), "id", "left_semi")
        return KnowledgeBase(nodes, bodies, graph.closed(self.edges, nodes), self.books.where(F.col("domain").isin(domains)), semi(self.articles), semi(self.citations), self.terms, self.laws, self.default_law, self.first_laws)

    def asked(self, query: str) -> A.Asked | None:
        """The article that a query names, and whether there is one of that number."""
        read = L.parse_article_query(query, self.laws, {}, self.default_law)
        if read is None:
            return None
        book = self.books.where(F.col("law_name") == read.law).select("domain").first()
        there = self.articles.where((F.col("law") == read.law) & (F.col("number") == read.article)).limit(1).count()
        return A.Asked(read.law, book["domain"] if book else "", read.article, read.explicit, not there)

    def _children(self) -> DataFrame:
        return self.edges.where("type = 'hierarchy'").select(F.col("src").alias("parent"), F.col("dst").alias("id"))

    def _briefs(self) -> DataFrame:
        path = F.array_join(F.concat(F.coalesce("breadcrumb", F.array().cast("array<string>")), F.array("label")), " › ")
        books = self.books.select(F.col("domain").alias("_d"), F.col("title").alias("book"))
        return self.nodes.join(books, F.col("domain") == F.col("_d"), "left").select("id", "label", "level", "domain", F.coalesce("book", "domain").alias("book"), path.alias("path"), "summary")

    def corpus(self, domains: list[str] | None = None, terms: bool = True) -> DataFrame:
        text = F.coalesce(F.nullif("own", F.lit("")), F.col("summary"), F.lit(""))
        rows = self.nodes.join(self.bodies.select("id", "own"), "id", "left").where((F.col("level") != "term") if not terms else F.lit(True))
        return (rows.where(F.col("domain").isin(domains) | (F.col("level") == "term")) if domains else rows).select("id", F.col("label").alias("title"), text.alias("body"), "domain")

    def search(self, query: str, domains: list[str] | None = None, limit: float | None = 8, context: float | None = 200, terms: bool = True) -> DataFrame:
        """Text signals, the named article and those that cite it, and terms that the query contains, fused and ranked.

        A hit whose title names another article, or that is of another law than the named one, is damped.
        """
        limit, context = clamp(limit, 1, 30, 8), clamp(context, 40, 600, 200)
        w, corpus = retrieve.Weights(), self.corpus(domains, terms)
        text = retrieve.scored(corpus, query, w).select("id", "score", "via")
        parts = [text]
        asked = self.asked(query)
        if asked and not asked.missing:
            points = w.article if asked.explicit else w.article_weak
            own = self.articles.where((F.col("law") == asked.law) & (F.col("number") == asked.number)).select(F.col("node_id").alias("id"), F.lit(points).alias("score"), F.lit("law").alias("via"))
            citing = self.citations.where((F.col("law") == asked.law) & (F.col("article") == asked.number)).select(F.col("node_id").alias("id"), F.lit(w.cited).alias("score"), F.lit("cited").alias("via")).distinct()
            parts += [own, citing]
        if terms:
            low, key = query.lower(), F.lower("label")
            hit = self.terms.where((F.length("label") >= 2) & F.contains(F.lit(low), key))
            parts.append(hit.select("id", (w.term_page * F.least(F.lit(1.0), F.length("label") / float(max(1, len(low))))).alias("score"), F.lit("term").alias("via")))
        rows = retrieve.fuse(*parts).join(corpus, "id")
        if asked:
            domains = [r[0] for r in self.books.where("coalesce(law_name, '') <> ''").select("domain").collect()]  # one row a book
            rows = A.clashes(rows, asked, domains, w)
        best = retrieve.top(rows, limit)
        return best.join(self._briefs().select("id", "book", "path"), "id", "left").select("id", F.col("title").alias("label"), "book", "path", "score", "via", T.excerpt(F.col("body"), query, context).alias("excerpt")).orderBy(F.col("score").desc(), T.natural_key(F.col("id")))

    def read_node(self, id_: str, mode: str = "own", offset: int = 0, limit: float | None = 4000) -> DataFrame:
        """One page of a node's text, with whether more follows, its children in order and its 50 most frequent citations."""
        limit = clamp(limit, 200, 8000, 4000)
        text = F.coalesce(F.nullif("full", F.lit("")), F.col("own")) if mode == "full" else F.col("own")
        page, more = catalog.text_page(F.coalesce(text, F.lit("")), offset, limit)
        kids = tree.children_in_order(self._children().where(F.col("parent") == id_)).withColumnRenamed("parent", "id")
        cited = self.citations.where(F.col("node_id") == id_).groupBy(F.col("node_id").alias("id"), "law", "article").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "law", "article").limit(50)
        cited = cited.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "law", "article"))).alias("citations"))
        one = self._briefs().where(F.col("id") == id_).join(self.bodies, "id", "left")
        return one.join(kids, "id", "left").join(cited, "id", "left").select("id", "label", "path", page.alias("text"), more.alias("has_more"), "children", "citations")

    def browse(self, root: str | None, depth: float | None = 2, budget: float = catalog.budget_cap()) -> DataFrame:
        """Nodes below the root (or below all roots) in reading order, as far as the budget goes."""
        children = self._children()
        seeds = self.nodes.where(F.col("id") == root).select("id") if root else self.nodes.where("level <> 'term'").join(children.select("id"), "id", "left_anti").select("id")
        found = tree.descendants(children, seeds, clamp(depth, 0, 8, 2)).join(self.nodes.select("id", "label"), "id").withColumn("cost", T.estimate_tokens(F.concat("id", "label")))
        order = T.natural_key(F.col("path"))
        return catalog.budget(found.withColumn("all", F.lit(0)), "cost", [order], budget, ["all"]).select("id", "label", "depth", "path").orderBy(order)

    def lookup_term(self, name: str) -> DataFrame:
        """The term of that name, a canonical name before an alias; else none (then suggest_terms)."""
        key, asked = T.term_key(F.col("label")), T.term_key(F.lit(name))
        rank = F.when(key == asked, 0).when(F.exists("aliases", lambda a: T.term_key(a) == asked), 1)
        return self.terms.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", "id").limit(1).drop("rank")

    def suggest_terms(self, name: str, most: int = 10) -> DataFrame:
        names = self.terms.select(F.col("label").alias("name"), F.col("id").alias("seq")).unionByName(self.terms.select(F.explode("aliases").alias("name"), F.col("id").alias("seq")))
        return retrieve.suggestions(names, name, most)

    def find_law(self, query: str, limit: float | None = 60) -> DataFrame:
        """The article's text and, by count, who cites it; a bare number gives up to 20 candidate articles."""
        asked = L.parse_article_query(query, self.laws, {}, None)
        text = self.bodies.select(F.col("id").alias("node_id"), "own")
        if asked is None:
            n = L.parse_article_query(query, {}, {}, "any")
            number = n.article if n else -1
            return self.articles.where(F.col("number") == number).join(text, "node_id", "left").orderBy("law").limit(20).select("law", "number", "node_id", F.col("own").alias("text"), F.lit(None).cast("array<struct<n:bigint,id:string>>").alias("cited_by"))
        own = self.articles.where((F.col("law") == asked.law) & (F.col("number") == asked.article))
        citing = self.citations.where((F.col("law") == asked.law) & (F.col("article") == asked.article)).groupBy("law", F.col("article").alias("number"), "node_id").agg(F.sum("n").alias("n"))
        top = citing.orderBy(F.col("n").desc(), "node_id").limit(clamp(limit, 5, 200, 60)).groupBy("law", "number").agg(F.reverse(F.array_sort(F.collect_list(F.struct("n", F.col("node_id").alias("id"))))).alias("cited_by"))
        return own.join(text, "node_id", "left").join(top, ["law", "number"], "left").select("law", "number", "node_id", F.col("own").alias("text"), "cited_by")

    def law_answer(self, query: str) -> tuple[str, DataFrame]:
        """What find_law means by a query, and its answer: an article, that there is none of the number, or candidates."""
        asked = self.asked(query)
        if asked and asked.explicit:
            return ("no such article" if asked.missing else "article"), self.find_law(query)
        bare = L.parse_article_query(query, {}, {}, "any")
        if bare is None:
            return "unknown law" if L._ARTICLE.search(query) else "nothing", self.find_law(query).limit(0)
        rows = self.articles.withColumn("seq", F.lit(0))
        return "candidates", A.candidates(rows, bare.article, list(self.first_laws)).drop("seq")

    def occurrences(self, term: str, most: int = 40) -> DataFrame:
        """Where a term is defined or used, defined first, with the citations of each place."""
        ends = self.edges.where((F.col("type") == "termref") & (F.col("src") == term)).select(F.col("dst").alias("id"), "weight")
        cited = self.citations.groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_set(F.concat("law", F.lit("第"), F.col("article").cast("string"), F.lit("条")))).alias("cites"))
        top = ends.orderBy(F.col("weight").desc(), T.natural_key(F.col("id"))).limit(most)
        return top.join(self._briefs().select("id", "label", "path"), "id").join(cited, "id", "left")

    def browse_summary(self, group: str = "domain") -> DataFrame:
        """Nodes by level for each value of a book's column."""
        return self.nodes.join(self.books.select("domain", *([group] if group != "domain" else [])), "domain").groupBy(group, "level").agg(F.count("*").alias("n"))

    def closed_books(self, every: DataFrame) -> DataFrame:
        """Books of a larger base that this one doesn't open."""
        return every.join(self.books.select("domain"), "domain", "left_anti")

    def citing(self, law: str, article: int, domains: list[str] | None = None, limit: float | None = 50) -> DataFrame:
        """The sections that cite an article, by how often, then by id."""
        rows = self.citations.where((F.col("law") == law) & (F.col("article") == article)).groupBy(F.col("node_id").alias("id")).agg(F.sum("n").alias("n")).join(self._briefs(), "id")
        rows = rows.where(F.col("domain").isin(domains)) if domains else rows
        return rows.orderBy(F.col("n").desc(), T.natural_key(F.col("id"))).limit(clamp(limit, 1, 200, 50)).select("id", "label", "book", "path", "n")

    def resource(self, uri: str) -> DataFrame:
        """The node of kb://node/ID; the scheme is not looked at."""
        kind, _, id_ = uri.partition("://")[2].partition("/")
        if kind != "node" or not id_:
            raise ValueError(f"no resource {uri}")
        return self.read_node(id_, "full")

    def entry(self, ids: list[str]) -> DataFrame:
        """For containers, the node below that a reader starts with."""
        asked = self.nodes.sparkSession.createDataFrame([(i,) for i in ids], "id string")
        return A.entries(self._children(), self.bodies, asked)

    def related(self, id_: str, types: list[str] | None = None, limit: float | None = 20) -> DataFrame:
        """Neighbours by type, larger groups first; total is the group's size before the limit."""
        ends = self.edges.where(F.col("src") == id_).select(F.col("dst").alias("id"), "type", "weight").unionByName(self.edges.where(F.col("dst") == id_).select(F.col("src").alias("id"), "type", "weight"))
        rows = ends.where(F.col("type").isin(types)) if types else ends
        w = W.partitionBy("type")
        ranked = rows.withColumns({"total": F.count("*").over(w), "rank": F.row_number().over(w.orderBy(F.col("weight").desc(), T.natural_key(F.col("id"))))})
        kept = ranked.where(F.col("rank") <= clamp(limit, 1, 100, 20)).join(self._briefs().select("id", "label", "path"), "id", "left")
        return kept.orderBy(F.col("total").desc(), F.array_position(F.array(*map(F.lit, TYPES)), F.col("type")), "rank")

    def list_books(self, offset: int = 0, limit: float | None = 20, detail: str = "full") -> DataFrame:
        """Books by domain; brief: what names them only."""
        books = self.books.select("domain", "title", "status") if detail == "brief" else self.books
        return catalog.page(books, [F.col("domain")], max(0, offset), clamp(limit, 1, 100, 20))

    def catalogue(self) -> DataFrame:
        return catalog.rollup(self.books, ["country", "field", "doc_type"], {"n": F.count("*"), "chars": F.sum("chars")})

    def filter_books(self, country: str | None = None, field_: str | None = None, doc_type: str | None = None, has_law: bool | None = None, text: str | None = None) -> DataFrame:
        """Books that meet all given conditions; facets() of the result counts the whole match."""
        rows = self.books
        for column, value in (("country", country), ("field", field_), ("doc_type", doc_type)):
            rows = rows.where(F.col(column) == value) if value is not None else rows
        if has_law is not None:
            rows = rows.where((F.coalesce("law_name", F.lit("")) != "") == has_law)
        return rows.where(F.contains(F.concat_ws(" ", "title", "short", "domain", "law_name"), F.lit(text))) if text else rows

    def facets(self, books: DataFrame) -> DataFrame:
        return catalog.facets(books, ["country", "field", "doc_type", "status"])

    def list_articles(self, law: str, first: int | None = None, last: int | None = None, offset: int = 0, limit: float | None = 50) -> DataFrame:
        rows = self.articles.where((F.col("law") == law) & (F.col("number") >= (first or 0)) & (F.col("number") <= (last if last is not None else 2**31 - 1)))
        rows = rows.join(self.nodes.select(F.col("id").alias("node_id"), L.article_title(F.col("label")).alias("title")), "node_id", "left")
        return catalog.page(rows, [F.col("number")], offset, clamp(limit, 1, 200, 50))

    def compare_articles(self, asked: list[str], chars: float | None = 1500) -> DataFrame:
        """Up to ten articles in the asked order: text, or why there is none."""
        chars, spark = clamp(chars, 100, 4000, 1500), self.nodes.sparkSession
        read = [(i, q, L.parse_article_query(q, self.laws, {}, None)) for i, q in enumerate(asked[:10])]
        keys = spark.createDataFrame([(i, q, a.law if a else None, a.article if a else None) for i, q, a in read], "nth int, asked string, law string, number int")
        have = self.articles.join(self.bodies.select(F.col("id").alias("node_id"), "own"), "node_id", "left")
        reason = F.when(F.col("law").isNull(), "unknown law").when(F.col("node_id").isNull(), "no such article")
        return F.broadcast(keys).join(have, ["law", "number"], "left").select("nth", "asked", F.substring("own", 1, chars).alias("text"), F.greatest(F.length("own") - chars, F.lit(0)).alias("overflow"), reason.alias("not_found"))

    def batch_read(self, ids: list[str], mode: str = "own", chars: float | None = None) -> DataFrame:
        chars = clamp(chars, 100, 4000, 1200 if mode == "full" else 400)
        keys = self.nodes.sparkSession.createDataFrame(list(enumerate(ids[:20])), "nth int, id string")
        text = F.coalesce(F.nullif("full", F.lit("")), F.col("own")) if mode == "full" else F.col("own")
        return catalog.batch(keys, self.nodes.select("id", "label").join(self.bodies.select("id", F.substring(text, 1, chars).alias("text")), "id", "left"), "id")

    def citing_sections(self, law: str, domains: list[str] | None = None) -> DataFrame:
        """For each cited article: how many sections and books cite it, how often, and which."""
        rows = self.citations.where(F.col("law") == law).join(self.nodes.select(F.col("id").alias("node_id"), "domain"), "node_id")
        rows = rows.where(F.col("domain").isin(domains)) if domains else rows
        per = rows.groupBy("article", "node_id", "domain").agg(F.sum("n").alias("n"))
        got = per.groupBy("article").agg(F.count("*").alias("sections"), F.count_distinct("domain").alias("books"), F.sum("n").alias("total"))
        return got.orderBy(F.col("sections").desc(), "article")

    def briefs(self, ids: list[str] | None = None, root: str | None = None, depth: float | None = 1, limit: float | None = 50) -> DataFrame:
        """The given nodes, or the layers below a root, nearest first."""
        limit, spark = clamp(limit, 1, 100, 50), self.nodes.sparkSession
        seeds = spark.createDataFrame([(i,) for i in (ids or [root])], "id string")
        found = tree.descendants(self._children(), seeds, 0 if ids else clamp(depth, 0, 8, 1))
        return found.join(self._briefs(), "id").orderBy("depth", T.natural_key(found["path"])).limit(limit).select("id", "depth", "label", "book", "summary")

    def effectivity(self) -> DataFrame:
        """Each book's status code and, unless it is in force, a warning."""
        code = L.status_code(F.col("status"))
        warning = F.when(code == "repealed", "no longer in force").when(code == "not_yet", "not yet in force")
        return self.books.select("domain", "title", code.alias("code"), warning.alias("warning"))


def fused(answer: DataFrame, columns: list[str], cap: float) -> tuple[bool, int]:
    """Whether an answer's estimated tokens stay within the cap, and how many they are."""
    cost: Column = T.estimate_tokens(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    total = answer.agg(F.sum(cost)).first()[0] or 0
    return total <= cap, int(total)
