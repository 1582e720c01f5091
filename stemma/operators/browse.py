"""Browsing the graph and the site: contents, legend, local graphs, related pages, orders, tags, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stemma.functions import text as T
from stemma.operators import graph


def local_graph(edges: DataFrame, nodes: DataFrame, centre: str, most: int = 120) -> tuple[DataFrame, DataFrame]:
    """The centre with at most ``most`` neighbours and the edges between them.

    Neighbours of the same book come first, then those that are no terms, then by degree, lowest first, then by id.
    nodes: id, book, is_term; edges: src, dst.
    """
    own = nodes.where(F.col("id") == centre).select(F.col("book").alias("own"))
    near = graph.both_ways(edges).where(F.col("src") == centre).select(F.col("dst").alias("id")).distinct().where(F.col("id") != centre)
    rows = near.join(nodes, "id").join(graph.degree(edges), "id").join(F.broadcast(own.limit(1)))
    kept = rows.orderBy(F.col("book") != F.col("own"), "is_term", "degree", "id").limit(most).select("id", "degree")
    members = kept.select("id").unionByName(nodes.where(F.col("id") == centre).select("id"))
    return kept, graph.closed(edges, members)


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """id, degree, radius over the edges between members; 4 + 0.3 times the root of the degree, 13 at most."""
    return graph.degree(graph.closed(edges, members)).withColumn("radius", F.round(F.least(F.lit(13.0), 4 + 0.3 * F.sqrt("degree")), 6))


def contents_tree(pages: DataFrame, fields: DataFrame) -> DataFrame:
    """field, book, chapters: of index pages of two to four segments, in order; pages whose parent is missing are left out.

    pages: slug, title; fields: book, field. A book is the first segment, a chapter the second, a section the third.
    """
    parts = F.split("slug", "/")
    rows = pages.withColumn("depth", F.size(parts)).where("depth BETWEEN 1 AND 4")
    parent = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    rows = rows.withColumn("parent", F.when(F.col("depth") > 1, parent))
    rows = rows.where("depth = 1").unionByName(rows.where("depth > 1").join(rows.select(F.col("slug").alias("parent")), "parent", "left_semi").select(rows.columns))
    counts = rows.withColumn("book", parts[0]).groupBy("book").agg(F.sum((F.col("depth") == 2).cast("int")).alias("chapters"), F.sum((F.col("depth") == 3).cast("int")).alias("sections"))
    return counts.join(fields, "book", "left").select("field", "book", "chapters", "sections")


def contents_counts(toc: DataFrame) -> DataFrame:
    return toc.agg(F.count("*").alias("books"), F.sum("chapters").alias("chapters"), F.sum("sections").alias("sections"))


def contents_order(pages: DataFrame) -> DataFrame:
    """position under the parent: by leading number (none last), then title, then slug. pages: parent, title, slug."""
    n = F.regexp_extract("title", r"^\s*(\d+)", 1).try_cast("int")
    return pages.withColumn("position", F.row_number().over(W.partitionBy("parent").orderBy(n.asc_nulls_last(), "title", "slug")))


def segments(rows: DataFrame, path: str, separator: str = "-") -> DataFrame:
    """depth, n: distinct prefixes of paths by their number of segments."""
    parts = F.split(F.col(path), separator)
    every = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), separator).alias("prefix"))))
    return rows.select(every.alias("p")).select("p.depth", "p.prefix").distinct().groupBy("depth").agg(F.count("*").alias("n"))


def legend(books: DataFrame) -> DataFrame:
    """field, groups: of each field its document types with their books, all in order of name."""
    types = books.groupBy("field", "doc_type").agg(F.array_sort(F.collect_set("book")).alias("books"))
    return types.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("doc_type", "books"))).alias("groups"))


def bounds(points: DataFrame) -> DataFrame:
    return points.agg(*[f(c).alias(f"{k}_{c}") for c in ("x", "y") for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


def shown(pages: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, terms: bool = True) -> DataFrame:
    """Pages by slug: of the included slugs or prefixes (those that end with a slash), none of the excluded ones. pages: slug, is_term."""
    def of(names: list[str]) -> Column:
        fits = F.lit(False)
        for n in names:
            fits = fits | (F.col("slug").startswith(n) if n.endswith("/") else F.col("slug") == n)
        return fits

    rows = pages.where(of(include)) if include else pages
    rows = rows.where(~of(exclude)) if exclude else rows
    return rows if terms else rows.where(~F.col("is_term"))


def in_reading_chain(slug: Column) -> Column:
    """Neither the root, nor tag and index pages, are part of the reading order."""
    return (slug != "") & (slug != "index") & ~slug.startswith("tags/") & ~slug.endswith("/index")


def section_group(slug: Column, groups: dict[str, tuple[int, int]]) -> Column:
    """The group whose range holds the number that the slug's last segment begins with; null outside all."""
    n = F.regexp_extract(slug, r"(?:^|/)(\d+)[^/]*$", 1).try_cast("int")
    return F.coalesce(*[F.when(n.between(low, high), F.lit(name)) for name, (low, high) in groups.items()], F.lit(None).cast("string"))


def groups_of_fields(books: DataFrame, fields: list[str]) -> DataFrame:
    return books.where(F.col("field").isin(fields)).groupBy("field").agg(F.array_sort(F.collect_set("group")).alias("groups"))


def related(ends: DataFrame, priority: list[str], most: int = 12) -> DataFrame:
    """src, dst, type, rank: by type, then by arrival (seq), each target once. ends: src, dst, type, seq."""
    at = F.array_position(F.array(*map(F.lit, priority)), F.col("type"))
    best = ends.groupBy("src", "dst").agg(F.min_by("type", F.struct(at, "seq")).alias("type"), F.min(F.struct(at.alias("at"), "seq")).alias("o"))
    return graph.top_per_key(best, "src", [F.col("o.at"), F.col("o.seq")], most).drop("o")


def recent(pages: DataFrame, keep: Column, most: int) -> DataFrame:
    """The latest kept pages by date, then title, and how many more there are. pages: slug, title, date."""
    kept = pages.where(keep)
    return kept.orderBy(F.col("date").desc_nulls_last(), F.lower("title"), "slug").limit(most).withColumn("remaining", F.lit(max(0, kept.count() - most)).cast("long"))


def by_date(pages: DataFrame, folders_first: bool = False) -> list[Column]:
    order = [F.col("date").desc_nulls_last(), F.lower("title")]
    return [F.col("is_folder").desc(), *order] if folders_first else order


def moved(keys: Column, key: str, to: int) -> Column:
    """The order with one key moved to a place (from 0); unknown keys are put in."""
    rest = F.array_remove(keys, key)
    at = F.least(F.greatest(F.lit(to), F.lit(0)), F.size(rest))
    return F.concat(F.slice(rest, 1, at), F.array(F.lit(key)), F.slice(rest, at + 1, F.size(rest)))


def breadcrumbs(chain: Column, label: Column, last: bool = False) -> Column:
    return F.concat(chain, F.array(label)) if last else chain


def tags(pages: DataFrame, books: DataFrame, topics: DataFrame) -> DataFrame:
    """slug, tags: the book's short name and the names of the page's topics' groups, each once.

    pages: slug, book, topics; books: book, short; topics: topic, group.
    """
    flat = pages.select("slug", F.explode_outer("topics").alias("topic")).join(F.broadcast(topics), "topic", "left")
    groups = flat.groupBy("slug").agg(F.array_sort(F.collect_set("group")).alias("groups"))
    rows = pages.join(books, "book", "left").join(groups, "slug", "left")
    return rows.select("slug", F.array_distinct(F.filter(F.concat(F.array("short"), F.coalesce("groups", F.array().cast("array<string>"))), lambda x: x.isNotNull())).alias("tags"))


def allowed(aliases: DataFrame, wanted: list[str]) -> DataFrame:
    """The aliases on the list; one that no page has is an error. aliases: slug, alias."""
    spark = aliases.sparkSession
    asked = spark.createDataFrame([(w,) for w in wanted], "alias string")
    unknown = [r[0] for r in asked.join(aliases, "alias", "left_anti").limit(10).collect()]
    if unknown:
        raise ValueError(f"no page has the alias {', '.join(sorted(unknown))}")
    return aliases.join(F.broadcast(asked), "alias", "left_semi").select(aliases.columns)


def zero_hits(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """origins, terms: of the terms that no text holds, by the set of where they come from. terms: term, origins; texts: text.

    Terms are a lexicon that is broadcast if it is small; the join tests containment.
    """
    hit = texts.select(F.lower("text").alias("text")).join(F.broadcast(terms.select("term")), F.contains("text", F.lower("term"))).select("term").distinct()
    missed = terms.join(hit, "term", "left_anti")
    return missed.groupBy(F.array_join(F.array_sort("origins"), ",").alias("origins")).agg(F.array_sort(F.collect_list("term")).alias("terms"))


def near_misses(term: Column) -> Column:
    """Variants of a term that a text may hold: without spaces, and with 的 before its last two characters."""
    tight = F.regexp_replace(term, r"\s", "")
    n = F.length(term)
    put = F.when(n >= 4, F.concat(F.substring(term, F.lit(1), n - 2), F.lit("的"), F.substring(term, n - 1, F.lit(2))))
    return F.filter(F.array_distinct(F.array(tight, put)), lambda x: x.isNotNull() & (x != term))


def occurrences(text: Column, name: Column) -> Column:
    """How often a name stands in a text, without overlaps."""
    return F.when(F.length(name) > 0, ((F.length(text) - F.length(F.replace(text, name, F.lit("")))) / F.length(name)).cast("long")).otherwise(F.lit(0).cast("long"))


def path_to_root(slug: Column) -> Column:
    """. for a page at the root, else a .. for each folder above."""
    depth = F.size(F.split(slug, "/")) - 1
    return F.when(depth <= 0, ".").otherwise(F.array_join(F.array_repeat(F.lit(".."), depth), "/"))


def relative(source: Column, target: Column) -> Column:
    return F.concat(path_to_root(source), F.lit("/"), target)


def shortest(links: DataFrame, pages: DataFrame) -> DataFrame:
    """src, link, dst: a link by its last segment, if one page only has that; else as it stands. links: src, link; pages: slug."""
    name = F.element_at(F.split("slug", "/"), -1)
    unique = pages.groupBy(name.alias("name")).agg(F.min("slug").alias("slug"), F.count("*").alias("k")).where("k = 1")
    return links.withColumn("name", F.element_at(F.split("link", "/"), -1)).join(unique, "name", "left").select("src", "link", F.coalesce("slug", "link").alias("dst"))


def parents(slugs: DataFrame) -> DataFrame:
    """Every proper prefix of every slug."""
    return slugs.select(F.explode(T.prefixes(F.col("slug"))).alias("folder")).distinct()
