"""Readers of extraction records, Markdown, front matter and review sheets; all through Spark's file sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RECORD = "chunk string, anchorNode string, terms array<struct<name:string,aliases:array<string>,role:string,confidence:string,evidence:string>>, laws array<string>, extractedAt string, model string"
#: Canonical front-matter keys.
KEYS = ("title", "short", "order", "country", "field", "docType", "lawName", "lawAlias", "effectiveDate", "adoptedDate", "documentNo", "status", "statusNote")


def _name() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)


def read_extractions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records by file name, and the names of corrupt files.

    The chunk is the record's, else the file name's with __ for /; unknown roles count as used, unknown confidence as low.
    """
    texts = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(_name().alias("file"), "value")
    bad = texts.where(F.try_parse_json("value").isNull()).select("file")
    rows = texts.where(F.try_parse_json("value").isNotNull()).select("file", F.from_json("value", RECORD).alias("r")).select("file", "r.*")
    chunk = F.coalesce(F.nullif("chunk", F.lit("")), F.replace("file", F.lit("__"), F.lit("/")))
    terms = F.transform("terms", lambda t: F.struct(t["name"].alias("name"), F.coalesce(t.aliases, F.array().cast("array<string>")).alias("aliases"), F.when(t.role == "defined", "defined").otherwise("used").alias("role"), F.when(t.confidence.isin("high", "mid"), t.confidence).otherwise("low").alias("confidence"), t.evidence.alias("evidence")))
    good = rows.select("file", chunk.alias("chunk"), "anchorNode", F.coalesce(terms, F.array().cast(terms_type())).alias("terms"), F.coalesce("laws", F.array().cast("array<string>")).alias("laws"))
    return good, bad


def terms_type() -> str:
    return "array<struct<name:string,aliases:array<string>,role:string,confidence:string,evidence:string>>"


def occurrences(records: DataFrame) -> DataFrame:
    """seq, chunk, domain and the fields of each term, in order of file and place."""
    flat = records.select("file", "chunk", F.posexplode("terms").alias("at", "t"))
    return flat.select(F.struct("file", "at").alias("seq"), "chunk", F.substring_index("chunk", "/", 1).alias("domain"), "t.*")


def read_markdown(spark: SparkSession, path: str, skip: tuple[str, ...] = ("_preamble.md",)) -> DataFrame:
    """path and text of every Markdown file below a folder."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text")).where(~F.col("name").isin(*skip))


def front_matter(text: Column) -> Column:
    """Map of the canonical keys: value after the first colon, quotes off, snake case as camel case, missing ones empty."""
    block = F.regexp_extract(text, r"(?s)^\x{FEFF}?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_]+[ \t]*:"))

    def camel(key: Column) -> Column:
        parts = F.split(key, "_")
        return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), F.initcap), ""))

    pairs = F.transform(lines, lambda x: F.struct(camel(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.regexp_replace(F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))), r"^([\"'])(.*)\1$", "$2").alias("value")))
    value = lambda k: F.coalesce(F.element_at(F.filter(pairs, lambda p: p.key == k), -1).value, F.lit(""))
    return F.create_map(*[x for k in KEYS for x in (F.lit(k), F.when(F.size(F.filter(pairs, lambda p: p.key == k)) > 0, value(k)).otherwise(""))])


def article_titles(text: Column) -> Column:
    """Array of (number, title) of lines such as **第N条**（title）, the first of each number."""
    lines = F.regexp_extract_all(text, F.lit(r"(\*\*第[^条\n]+条\*\*（[^）\n]*）)"), F.lit(1))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"第([^条]+)条", 1).alias("number"), F.regexp_extract(x, r"（([^）]*)）", 1).alias("title")))


def table_rows(text: Column) -> Column:
    """Cells of each row of a pipe table, without the rule line."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(r"^\s*\|") & ~x.rlike(r"^\s*\|[\s:|-]+\|?\s*$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A review sheet: comma-separated, quotes doubled, line breaks in cells, a byte-order mark and empty rows ignored."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True).csv(path).dropna("all")
