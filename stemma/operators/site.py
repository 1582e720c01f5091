"""Pages of the published site: search, descriptions, contents, tags, folders, dates, navigation, locating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stemma.functions import text as T
from stemma.operators import retrieve


def site_search(pages: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """slug by priority: hits in the title, then in the content, then in tags; "#tag words" searches within the tag.

    pages: slug, title, content, tags, seq.
    """
    tag, _, words = query.strip()[1:].partition(" ") if query.strip().startswith("#") else ("", "", query.strip())
    rows = pages.where(F.array_contains("tags", tag)) if tag and words else pages
    low = words.lower()
    if tag and not words:
        priority = F.when(F.exists("tags", lambda t: t.startswith(tag)), 2)
    else:
        priority = F.when(F.contains(F.lower("title"), F.lit(low)), 0).when(F.contains(F.lower("content"), F.lit(low)), 1).when(F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(low))), 2)
    return rows.withColumn("priority", priority).where("priority IS NOT NULL").orderBy("priority", "seq").limit(limit).select("slug", "title", "priority")


def highlighted(text: Column, query: str, mark: tuple[str, str] = ("<mark>", "</mark>")) -> Column:
    """The text with each occurrence of the query's words, and of its leading phrases, marked; longer ones first."""
    words = query.split()
    wanted = sorted({*words, *(" ".join(words[:i]) for i in range(2, len(words) + 1))}, key=lambda w: (-len(w), w))
    quoted = "|".join(f"\\Q{w}\\E" for w in wanted)
    return F.regexp_replace(text, f"(?iu)({quoted})", f"{mark[0]}$1{mark[1]}") if wanted else text


def best_words(text: Column, query: str, width: int = 30) -> Column:
    """The window of ``width`` words that holds most words of the query, the last one on ties."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    asked = [w for w in query.lower().split()]
    hit = F.transform(words, lambda w: F.when(F.greatest(*[F.contains(F.lower(w), F.lit(a)) for a in [*asked, asked[0]]]), 1).otherwise(0)) if asked else F.transform(words, lambda w: F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - width + 1, F.lit(1)))
    scored = F.transform(starts, lambda i: F.struct(F.aggregate(F.slice(hit, i, width), F.lit(0), lambda a, x: a + x).alias("n"), i.alias("i")))
    return F.array_join(F.slice(words, F.array_max(scored).i, width), " ")


def description(text: Column, length: int = 150) -> Column:
    """Whole sentences up to the length, at least one."""
    sentences = F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), r"(?<=[.。!！?？])\s*"), lambda s: s != "")
    return F.aggregate(sentences, F.lit(""), lambda a, s: F.when(a == "", s).when((F.length(a) + F.length(s) + 1 <= length) & (F.length(a) > 0), F.concat(a, F.lit(" "), s)).otherwise(F.when(F.length(a) > 0, F.concat(a, F.lit("\u0000"))).otherwise(a)), lambda a: F.substring_index(a, "\u0000", 1))


def contents(headings: DataFrame, page: str, depth: str, order: str, most: int = 3) -> DataFrame:
    """Headings down to ``most`` with their depth counted from the page's highest."""
    return headings.where(F.col(depth) <= most).withColumn(depth, F.col(depth) - F.min(depth).over(W.partitionBy(page)))


def tag_pages(pages: DataFrame) -> DataFrame:
    """tag, n for every tag and every tag above it, and the index of all tags."""
    parts = lambda t: F.split(t, "/")
    above = F.flatten(F.transform("tags", lambda t: F.transform(F.sequence(F.lit(1), F.size(parts(t))), lambda i: F.array_join(F.slice(parts(t), 1, i), "/"))))
    got = pages.select("slug", F.explode(F.array_distinct(above)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return got.unionByName(got.agg(F.lit("index").alias("tag"), F.count("*").alias("n")))


def folders(pages: DataFrame) -> DataFrame:
    """folder, number of direct children, latest date of a direct child, for every folder above a page."""
    direct = pages.select(F.regexp_extract("slug", r"^(.*)/[^/]*$", 1).alias("folder"), "date").where("folder <> ''")
    every = pages.select(F.explode(F.filter(T.prefixes(F.col("slug")), lambda p: p != F.col("slug"))).alias("folder")).distinct()
    return every.join(direct.groupBy("folder").agg(F.count("*").alias("n"), F.max("date").alias("date")), "folder", "left").select("folder", F.coalesce("n", F.lit(0)).alias("n"), "date")


def page_date(sources: list[Column]) -> Column:
    """The first date that is there, in order of trust."""
    return F.coalesce(*sources)


def reading_minutes(text: Column, per_minute: int = 200) -> Column:
    return F.ceil(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) / float(per_minute)).cast("int")


def navigation(entries: DataFrame) -> DataFrame:
    """Folders first, then by leading number (none last), then by name in Chinese order; position under the parent.

    entries: parent, name, is_folder.
    """
    n = F.regexp_extract("name", r"^(\d+)", 1).try_cast("int")
    order = W.partitionBy("parent").orderBy(F.col("is_folder").desc(), n.asc_nulls_last(), F.collate(F.col("name"), "zh"), "name")
    return entries.withColumn("position", F.row_number().over(order))


def preferred(values: DataFrame, column: str, first: list[str], seq: str) -> DataFrame:
    """Listed values in listed order, then the others in order of arrival."""
    at = F.nullif(F.array_position(F.array(*map(F.lit, first)), F.col(column)), F.lit(0))
    return values.orderBy(at.asc_nulls_last(), seq)


def regrouped(books: DataFrame, levels: list[str]) -> DataFrame:
    """path of each book under its levels' values; a book that lacks one stays at the top."""
    whole = F.forall(F.array(*levels), lambda x: F.coalesce(x, F.lit("")) != "")
    return books.withColumn("path", F.when(whole, F.array_join(F.array(*levels, "domain"), "/")).otherwise(F.col("domain")))


def term_fields(links: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields of what a term's outgoing links lead to, terms aside. links: src, dst; fields: id, field (null for terms)."""
    return links.join(fields.where("field IS NOT NULL"), F.col("dst") == F.col("id")).groupBy("src").agg(F.array_sort(F.collect_set("field")).alias("fields"))


def published(pages: DataFrame, explicit: bool = False) -> DataFrame:
    """Without drafts; with explicit, only what says publish. draft, publish: strings or null."""
    flag = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "true"
    return pages.where(flag("publish")) if explicit else pages.where(~flag("draft"))


def backlinks(pages: DataFrame) -> DataFrame:
    """dst, src, title of the linking pages; titles that repeat for one page get the book's name."""
    ref = pages.select(F.explode(F.array_distinct("links")).alias("dst"), F.col("slug").alias("src"), "title", F.substring_index("slug", "/", 1).alias("book")).join(pages.select(F.col("slug").alias("dst")), "dst", "left_semi").where("src <> dst")
    twice = F.count("*").over(W.partitionBy("dst", "title")) > 1
    return ref.select("dst", "src", F.when(twice, F.concat("title", F.lit(" ("), "book", F.lit(")"))).otherwise(F.col("title")).alias("title"))


def wiki_links(text: Column) -> Column:
    """Array of (target, heading, label) of [[target#heading|label]]."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!!)\[\[([^\[\]]+)\]\]"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^#|]*)", 1)).alias("target"), F.regexp_extract(x, r"#([^|]*)", 1).alias("heading"), F.nullif(F.regexp_extract(x, r"\|(.*)$", 1), F.lit("")).alias("label")))


def dead_links(pages: DataFrame) -> DataFrame:
    """slug, target of wiki links to nowhere."""
    flat = pages.select("slug", F.explode(wiki_links(F.col("content"))).alias("l")).select("slug", F.col("l.target").alias("target")).where("target <> ''")
    return flat.join(pages.select(F.col("slug").alias("target")), "target", "left_anti").select("slug", "target").distinct()


def in_context(text: Column, at: Column, length: Column, around: int = 30) -> Column:
    """…left【hit】right…, line breaks as ⏎."""
    left = F.substring(text, F.greatest(at - around + 1, F.lit(1)), F.least(at, F.lit(around)))
    return F.replace(F.concat(F.when(at > around, "…").otherwise(""), left, F.lit("【"), F.substring(text, at + 1, length), F.lit("】"), F.substring(text, at + length + 1, F.lit(around)), F.when(F.length(text) > at + length + around, "…").otherwise("")), F.lit("\n"), F.lit("⏎"))


def located(pages: DataFrame, needles: DataFrame) -> DataFrame:
    return retrieve.located(pages, needles)


def callouts(text: Column) -> Column:
    """Array of (kind, title) of > [!kind] title."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^>[ \t]*(\[![^\]\n]+\][+-]?[^\n]*)$"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.lower(F.regexp_extract(x, r"\[!([^\]]+)\]", 1)).alias("kind"), F.trim(F.regexp_extract(x, r"\][+-]?(.*)$", 1)).alias("title")))


def marks(text: Column) -> Column:
    """Texts between == and ==."""
    return F.regexp_extract_all(text, F.lit(r"==([^=\n]+)=="), F.lit(1))


def inline_tags(text: Column) -> Column:
    """Tags #a/b that follow white space or begin a line; numbers alone are none."""
    found = F.regexp_extract_all(text, F.lit(r"(?:^|\s)#([\p{L}\p{N}_/-]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: ~x.rlike("^[0-9]+$")))


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)%%.*?%%", "")


def front_list(value: Column) -> Column:
    """A front-matter value as a list: [a, "b"], lines of - a, or a, b; without quotes, empties or repeats."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(value), r"^\[|\]$", ""), r"(?m)^\s*-\s+", ",")
    parts = F.transform(F.split(bare, r"[,\n]"), lambda x: F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", ""))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))
