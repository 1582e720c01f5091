"""Reading a knowledge base: the pack that sinks.write_pack writes, single JSON tables, chunks and domains of a Markdown tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from stemma.operators.tools import KnowledgeBase

#: The pack's tables.
SCHEMAS = {
    "nodes": "id string, label string, level string, domain string, breadcrumb array<string>, summary string",
    "bodies": "id string, own string, full string",
    "edges": "src string, dst string, type string, weight double",
    "books": "domain string, title string, short string, country string, field string, doc_type string, law_name string, law_alias string, status string, chars long",
    "articles": "law string, number int, node_id string",
    "citations": "node_id string, law string, article int, n long",
    "terms": "id string, label string, aliases array<string>, definition string",
}


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def locate(spark: SparkSession, candidates: list[str]) -> str:
    """The first folder that is there; an error that names all if none is."""
    for path in candidates:
        if _exists(spark, path):
            return path
    raise FileNotFoundError(f"no pack in {' or '.join(candidates)}")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array, one object, or JSON lines; fields that the writer left out are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_pack(spark: SparkSession, path: str, domains: list[str] | None = None) -> KnowledgeBase:
    """The knowledge base of a pack, or the part of it in these domains; tables that the pack lacks are empty."""
    read = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}") if _exists(spark, f"{path}/{name}") else spark.createDataFrame([], schema)
    tables = {name: read(name, schema) for name, schema in SCHEMAS.items()}
    names = tables["books"].where("law_name IS NOT NULL").select("law_name", "law_alias", "short").collect()  # one row a book
    laws = {alias: r["law_name"] for field in ("short", "law_alias", "law_name") for r in names if (alias := r[field])}
    whole = KnowledgeBase(**tables, laws=laws)
    return whole.opened(domains) if domains else whole


def known_domains(wanted: str | None, books: DataFrame) -> tuple[list[str], list[str]]:
    """The open domains of a comma-separated list and the names in it that no book has; nothing named opens all."""
    every = [r[0] for r in books.select("domain").distinct().orderBy("domain").collect()]
    asked = [w.strip() for w in (wanted or "").split(",") if w.strip()]
    return [d for d in every if d in asked] or every, [a for a in asked if a not in every]


def split_details(details: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Details of terms, and of the other nodes, from one read. details: id and fields."""
    return details.where(F.col("id").startswith("term-")), details.where(~F.col("id").startswith("term-"))


def chunk_texts(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """chunk, text: the chunk's file, else all files below the folder of its name, in order of path. files: path, text."""
    own = files.select(F.regexp_replace("path", r"\.md$", "").alias("chunk"), F.col("text").alias("own"))
    below = files.select("text", "path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))).alias("chunk"))
    joined = below.join(chunks.select("chunk").distinct(), "chunk", "left_semi").groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x.text), "\n\n").alias("folder"))
    return chunks.select("chunk").distinct().join(own, "chunk", "left").join(joined, "chunk", "left").select("chunk", F.coalesce("own", "folder").alias("text"))


def discover(files: DataFrame, registered: list[str]) -> DataFrame:
    """domain, position: folders with an index and another Markdown file; registered ones first in their order, then by name."""
    parts = F.split("path", "/")
    named = files.where(F.size(parts) == 2).select(parts[0].alias("domain"), (parts[1] == "_index.md").alias("is_index"))
    good = named.groupBy("domain").agg(F.max(F.col("is_index").cast("int")).alias("has"), F.max((~F.col("is_index")).cast("int")).alias("main")).where("has = 1 AND main = 1")
    at = F.nullif(F.array_position(F.array(*map(F.lit, registered)), F.col("domain")), F.lit(0)) if registered else F.lit(None).cast("bigint")
    return good.select("domain", F.row_number().over(W.orderBy(at.asc_nulls_last(), "domain")).alias("position"))  # one row a domain


def grouped_titles(text: Column, block: str) -> Column:
    """Array of (key, title) of the article titles below one level-two heading, with the number of the chapter they stand in."""
    body = F.regexp_extract(text, rf"(?ms)^##[ \t]+{block}[ \t]*$(.*?)(?=^##[ \t]|\z)", 1)
    chapters = F.regexp_extract_all(body, F.lit(r"(?ms)(^###.*?(?=^###|\z))"), F.lit(1))

    def titles(chapter: Column) -> Column:
        number = F.regexp_extract(chapter, r"^###[^0-9\n]*([0-9]+)", 1)
        lines = F.regexp_extract_all(chapter, F.lit(r"(\*\*第[^条\n]+条\*\*（[^）\n]*）)"), F.lit(1))
        return F.transform(lines, lambda x: F.struct(F.concat(number, F.lit(":第"), F.regexp_extract(x, r"第([^条]+)条", 1), F.lit("条")).alias("key"), F.regexp_extract(x, r"（([^）]*)）", 1).alias("title")))

    return F.flatten(F.transform(chapters, titles))
