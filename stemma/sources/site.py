"""Emitting the site: pages as Markdown, feeds, annotations, chunks, image manifests; partial and resumed runs; the plugin chain."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stemma.functions import text as T


def rendered(pages: DataFrame) -> DataFrame:
    """path, content of each page: front matter, heading, text, its citations by count. pages: slug, title, tags, aliases, text, citations (law, article, n)."""
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"'))), ", "), F.lit("]"))
    matter = F.concat_ws("\n", F.lit("---"), F.concat(F.lit('title: "'), F.replace("title", F.lit('"'), F.lit('\\"')), F.lit('"')), F.concat(F.lit("tags: "), listed(F.col("tags"))), F.concat(F.lit("aliases: "), listed(F.col("aliases"))), F.lit("---"))
    ordered = F.array_sort(F.transform("citations", lambda c: F.struct((-c.n).alias("order"), F.concat(c.law, F.lit("第"), c.article.cast("string"), F.lit("条")).alias("key"), c.n.alias("n"))))
    cited = F.array_join(F.transform(ordered, lambda c: F.concat(F.lit("- "), c.key, F.lit(" ×"), c.n.cast("string"))), "\n")
    parts = F.array(matter, F.concat(F.lit("# "), T.escaped(F.col("title"))), F.col("text"), F.when(F.size("citations") > 0, F.concat(F.lit("## 引用\n"), cited)))
    return pages.select(F.concat("slug", F.lit(".md")).alias("path"), F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n\n").alias("content"))


def write_site(pages: DataFrame, folder: str) -> None:
    """One file of rows a top folder, replaced as a whole, so that a repeated run gives the same site and nothing stale stays."""
    rendered(pages).withColumn("top", F.substring_index("path", "/", 1)).write.mode("overwrite").partitionBy("top").json(folder)


def feed_document(pages: DataFrame, base: str, title: str, most: int) -> DataFrame:
    """One row: an RSS document of the latest pages. pages: slug, title, description, date."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    item = F.concat(F.lit("<item><title>"), safe(F.col("title")), F.lit(f"</title><link>{base}/"), F.col("slug"), F.lit("</link><description>"), safe(F.coalesce("description", F.lit(""))), F.lit("</description></item>"))
    latest = pages.orderBy(F.col("date").desc_nulls_last(), "title").limit(most)
    order = F.struct(F.col("date").isNull().alias("undated"), (-F.unix_timestamp("date")).alias("age"), "title", item.alias("item"))
    return latest.agg(F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{title}</title>'), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["item"]), ""), F.lit("</channel></rss>")).alias("document"))


#: Kinds and colours of annotations.
KINDS, COLOURS = ("highlight", "note", "underline"), ("yellow", "green", "blue", "pink")


def valid_annotation() -> Column:
    """Whether an annotation is whole: an id of at most 64 safe characters, known kind and colour, a passage with sane bounds.

    Columns: id, slug, kind, colour, start, end, exact.
    """
    good = F.col("id").rlike(r"^[A-Za-z0-9_-]{1,64}$") & (F.length("slug") > 0) & F.col("kind").isin(*KINDS) & F.col("colour").isin(*COLOURS)
    return F.coalesce(good & (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.length("exact") > 0), F.lit(False))


def merged_annotations(existing: DataFrame, incoming: DataFrame, most: int = 5000) -> tuple[DataFrame, dict[str, int]]:
    """Annotations by id, the newer (updated) wins, the existing one on ties; at most ``most``, the latest; and what was done.

    The cap is the store's: what is beyond it is counted as dropped.
    """
    fine = incoming.where(valid_annotation())
    both = existing.withColumn("_new", F.lit(0)).unionByName(fine.withColumn("_new", F.lit(1)))
    best = both.withColumn("_nth", F.row_number().over(W.partitionBy("id").orderBy(F.col("updated").desc(), "_new"))).where("_nth = 1")
    known = existing.select("id")
    counts = {"invalid": incoming.count() - fine.count(), "added": best.where("_new = 1").join(known, "id", "left_anti").count(), "updated": best.where("_new = 1").join(known, "id", "left_semi").count(), "dropped": max(0, best.count() - most)}
    return best.orderBy(F.col("updated").desc(), "id").limit(most).drop("_new", "_nth"), counts


def annotation_export(annotations: DataFrame, exported_at: str) -> DataFrame:
    """One row: the export's envelope as JSON."""
    rows = F.array_sort(F.collect_list(F.struct(*annotations.columns)))
    return annotations.agg(F.to_json(F.struct(F.lit("annotations").alias("format"), F.lit(1).alias("version"), F.lit(exported_at).alias("exportedAt"), rows.alias("annotations"))).alias("envelope"))


def annotation_pages(annotations: DataFrame, headings: DataFrame) -> DataFrame:
    """path, content: annotations by the nearest heading at or before them; those before any heading are left out.

    annotations: slug, start, exact, note; headings: slug, at, title.
    """
    near = annotations.join(headings, "slug").where("at <= start").groupBy("slug", "start", "exact", "note").agg(F.max_by("title", "at").alias("title"), F.max("at").alias("at"))
    line = F.concat(F.lit("> "), "exact", F.coalesce(F.concat(F.lit("\n\n"), F.nullif("note", F.lit(""))), F.lit("")))
    rows = near.groupBy("slug", "at", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("body"))
    return rows.select(F.concat(F.substring_index("slug", "/", 1), F.lit("/"), T.file_name(F.col("title")), F.lit(".md")).alias("path"), F.concat(F.lit("# "), "title", F.lit("\n\n"), "body").alias("content"))


def resliced(nodes: DataFrame) -> DataFrame:
    """path, text of each leaf's chunk. nodes: id, parent, own. Ids must be unique, parents known, and no text lost or empty twice over."""
    leaves = nodes.join(nodes.select(F.col("parent").alias("id")).where("id IS NOT NULL").distinct(), "id", "left_anti")
    checks = {
        "ids occur twice": nodes.groupBy("id").count().where("count > 1"),
        "parents are unknown": nodes.where("parent IS NOT NULL").join(nodes.select(F.col("id").alias("parent")), "parent", "left_anti"),
        "nodes are their own parents": nodes.where("id = parent"),
        "leaves have no id": leaves.where("id IS NULL OR id = ''"),
    }
    wrong = [k for k, df in checks.items() if df.limit(1).count()]
    if wrong:
        raise ValueError("; ".join(wrong))
    return leaves.select(F.concat(F.replace("id", F.lit("-"), F.lit("/")), F.lit(".md")).alias("path"), F.coalesce("own", F.lit("")).alias("text"))


def image_manifest(pages: DataFrame, files: DataFrame) -> DataFrame:
    """image, state: copied if pages refer to it, missing if there is no such file, orphan if no page does. pages: content; files: image."""
    refs = pages.select(F.explode(F.regexp_extract_all("content", F.lit(r"!\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))).alias("image")).distinct().withColumn("wanted", F.lit(True))
    both = refs.join(files.select("image").distinct().withColumn("there", F.lit(True)), "image", "full")
    return both.select("image", F.when(F.col("wanted") & F.col("there"), "copied").when(F.col("wanted"), "missing").otherwise("orphan").alias("state"))


def linked_laws(text: Column, cite: Column, key: Column) -> Column:
    """The text with the first occurrence of a citation as a link."""
    at = F.instr(text, cite)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit("[["), key, F.lit("|"), cite, F.lit("]]"), F.substring(text, at + F.length(cite), F.length(text)))).otherwise(text)


# Plugins: a transformer maps pages to pages, a filter says what is published, an emitter writes.

Transformer = Callable[[DataFrame], DataFrame]
Filter = Callable[[], Column]
Emitter = Callable[[DataFrame], None]


@dataclass
class Build:
    """A site's build: transformers in order, then filters, of which all must hold, then every emitter.

    On a change, emitters with a partial form get the changed pages only; the others get all.
    """

    transformers: list[Transformer] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    emitters: list[Emitter] = field(default_factory=list)
    partial: dict[int, Callable[[DataFrame, DataFrame], None]] = field(default_factory=dict)

    def content(self, pages: DataFrame) -> DataFrame:
        out = reduce(lambda p, t: t(p), self.transformers, pages)
        return reduce(lambda p, f: p.where(F.coalesce(f(), F.lit(False))), self.filters, out)

    def run(self, pages: DataFrame) -> None:
        own = self.content(pages)
        for emit in self.emitters:
            emit(own)

    def rerun(self, pages: DataFrame, changes: DataFrame) -> None:
        """changes: slug, change (add, change or delete)."""
        own = self.content(pages)
        touched = own.join(changes.where("change <> 'delete'").select("slug"), "slug", "left_semi")
        for i, emit in enumerate(self.emitters):
            if i in self.partial:
                self.partial[i](touched, changes)
            else:
                emit(own)


def pending(chunks: DataFrame, done: DataFrame, key: str = "chunk") -> DataFrame:
    """What a resumed run has still to do."""
    return chunks.join(done.select(key).distinct(), key, "left_anti")
