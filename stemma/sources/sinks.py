"""Writers of the knowledge base: tables, pack, entity files, sheets, site indexes, redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def without_empty(df: DataFrame) -> DataFrame:
    """Empty strings and arrays as nulls, which JSON writers leave out."""
    kinds = dict(df.dtypes)
    return df.select(*[F.nullif(c, F.lit("")).alias(c) if kinds[c] == "string" else F.when(F.size(c) > 0, F.col(c)).alias(c) if kinds[c].startswith(("array", "map")) else F.col(c) for c in df.columns])


def write_pack(tables: dict[str, DataFrame], path: str) -> None:
    """The tables as gzipped JSON lines below one folder."""
    for name, df in tables.items():
        without_empty(df).write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")


def write_entities(df: DataFrame, id_: str, path: str) -> None:
    """One folder of JSON for each entity."""
    df.withColumn("_entity", F.col(id_)).write.mode("overwrite").partitionBy("_entity").json(path)


def sheet_line(columns: list[Column]) -> Column:
    """A comma-separated line, quoted only where needed."""
    cell = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.concat_ws(",", *[cell(F.coalesce(c.cast("string"), F.lit(""))) for c in columns])


def write_sheet(df: DataFrame, path: str) -> None:
    """Comma-separated text with a byte-order mark before the header of each part."""
    head = F.lit("﻿" + ",".join(df.columns))
    lines = df.select(sheet_line([F.col(c) for c in df.columns]).alias("line"))
    parts = lines.groupBy(F.spark_partition_id().alias("part")).agg(F.concat_ws("\n", head, F.array_join(F.collect_list("line"), "\n")).alias("value"))
    parts.select("value").write.mode("overwrite").text(path)


def content_index(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The full index, its four-column graph projection without dangling links, and the dangling links.

    pages: slug, title, links, tags, content.
    """
    slugs = pages.select(F.col("slug").alias("link"))
    flat = pages.select("slug", F.posexplode("links").alias("at", "link"))
    live = flat.join(slugs, "link", "left_semi").groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "link"))), lambda x: x.link).alias("links"))
    graph = pages.select("slug", "title", "tags").join(live, "slug", "left").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))
    return pages, graph, flat.join(slugs, "link", "left_anti").select("slug", "link")


def sitemap_entry(base: str, slug: Column, date: Column) -> Column:
    return F.concat(F.lit(f"<url><loc>{base}/"), slug, F.lit("</loc><lastmod>"), F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</lastmod></url>"))


def feed(pages: DataFrame, limit: int) -> DataFrame:
    """The latest pages, dated ones first."""
    return pages.orderBy(F.col("date").desc_nulls_last(), "title").limit(limit)


def redirects(pages: DataFrame) -> DataFrame:
    """alias, slug: one row a page and alias, characters that paths can't have removed; a page's own slug is no alias."""
    alias = F.regexp_replace(F.trim("alias"), r'[\\:*?"<>|]', "")
    return pages.select("slug", F.explode("aliases").alias("alias")).select(alias.alias("alias"), "slug").where("alias <> '' AND alias <> slug").distinct()
