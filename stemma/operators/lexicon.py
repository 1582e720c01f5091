"""Term lexicon: extraction records to merged terms with tiers, topics and stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stemma.functions import text as T


def claims(records: DataFrame) -> DataFrame:
    """key, term: the first record (seq) that names a key owns it; an alias never takes a key that a name has.

    records: seq, name, aliases.
    """
    own = records.select("seq", F.col("name").alias("term"), F.lit(0).alias("kind"), T.term_key(F.col("name")).alias("key"))
    other = records.select("seq", F.col("name").alias("term"), F.lit(1).alias("kind"), F.explode("aliases").alias("alias")).select("seq", "term", "kind", T.term_key(F.col("alias")).alias("key"))
    best = own.unionByName(other).where("key <> ''").groupBy("key").agg(F.min_by("term", F.struct("kind", "seq")).alias("term"))
    return best.select("key", "term")


def merged(records: DataFrame, chunks: DataFrame, samples: int = 3) -> DataFrame:
    """One row a term: df (distinct chunks), domains, defined with high confidence, best definition, first evidences.

    records: seq, chunk, domain, name, aliases, role, confidence, evidence; chunks: chunk, text. Evidence that doesn't stand in
    its chunk makes the confidence low.
    """
    owner = claims(records)
    rows = records.withColumn("key", T.term_key(F.col("name"))).join(owner, "key").join(chunks, "chunk", "left")
    rows = rows.withColumn("confidence", F.when(F.coalesce(F.contains("text", F.col("evidence")), F.lit(False)), F.col("confidence")).otherwise("low"))
    defined = (F.col("role") == "defined") & (F.col("confidence") == "high")
    listed = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk", "evidence"))), lambda x: F.struct(x.chunk.alias("chunk"), x.evidence.alias("text"))), 1, samples)
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "mid", 1).otherwise(2)
    definition = F.min_by(F.when(F.col("role") == "defined", F.col("evidence")), F.when(F.col("role") == "defined", F.struct(rank, -F.length("evidence"), "seq")))
    return rows.groupBy("term").agg(F.count_distinct("chunk").alias("df"), F.count_distinct("domain").alias("domains"), F.bool_or(defined).alias("defined_high"), definition.alias("definition"), listed.alias("evidence"), F.min("seq").alias("seq"))


def admitted(terms: DataFrame, seeds: DataFrame, whitelist: list[str]) -> DataFrame:
    """tier: seed, high or mid; null for candidates that no rule admits. seeds: term."""
    known = terms.join(seeds.select("term").distinct().withColumn("is_seed", F.lit(True)), "term", "left")
    tier = F.when(F.col("is_seed"), "seed").when(F.col("defined_high") & (F.col("df") >= 2), "high").when((F.col("df") >= 2) | (F.col("domains") >= 2) | F.col("defined_high") | F.col("term").isin(whitelist), "mid")
    return known.withColumn("tier", tier).drop("is_seed")


def topic(text: Column, topics: dict[str, list[str]], margin: int = 2) -> Column:
    """By exact keyword, else by the longest contained keyword, else by summed lengths with a margin; null where none leads."""
    low = F.lower(text)
    exact = F.coalesce(*[F.when(low.isin([k.lower() for k in ks]), F.lit(t)) for t, ks in topics.items()])
    longest = F.array_max(F.array(*[F.struct(F.when(F.contains(low, F.lit(k.lower())), len(k)).otherwise(0).alias("n"), F.lit(t).alias("t")) for t, ks in topics.items() for k in ks]))
    return F.coalesce(exact, F.when(longest.n >= margin, longest.t))


def registered(names: DataFrame, registry: DataFrame, prefix: str = "term-", digits: int = 4) -> DataFrame:
    """registry (name, id) with the next ids, in order of name, for names it lacks; ids are never reused.

    New names are ranked by range partitions with offsets, not in one task.
    """
    used = registry.agg(F.max(F.regexp_extract("id", r"(\d+)$", 1).cast("long"))).first()[0] or 0
    new = names.select("name").distinct().join(registry, "name", "left_anti").repartitionByRange("name").sortWithinPartitions("name")
    parts = new.withColumn("part", F.spark_partition_id()).withColumn("nth", F.row_number().over(W.partitionBy("part").orderBy("name")))
    counts = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()}
    start, before = used, {}
    for p in sorted(counts):
        before[p], start = start, start + counts[p]
    offset = F.lit(used)
    if before:
        offset = F.element_at(F.create_map(*[F.lit(x) for p, b in before.items() for x in (p, b)]), F.col("part"))
    added = parts.select("name", F.concat(F.lit(prefix), F.lpad((offset + F.col("nth")).cast("string"), digits, "0")).alias("id"))
    return registry.select("name", "id").unionByName(added)


def decisions(rows: DataFrame) -> DataFrame:
    """term, action (keep, drop, merge), target from review notes; later notes win, but drop beats merge at any time.

    rows: seq, term, note such as keep, drop or merge-into:X.
    """
    target = F.trim(F.regexp_extract("note", r"^\s*merge-into:(.*)$", 1))
    action = F.when(F.trim("note").isin("keep", "drop"), F.trim("note")).when((target != "") & (target != F.col("term")), "merge")
    valid = rows.withColumns({"action": action, "target": F.nullif(target, F.lit(""))}).where("action IS NOT NULL")
    best = valid.groupBy("term").agg(F.max_by(F.struct("action", "target"), F.struct(F.col("action") == "drop", "seq")).alias("d"))
    return best.select("term", "d.action", "d.target")


def variants(cell: Column) -> Column:
    """Names in a cell: split at 、 / ／ but not within quotes, numbers such as 1/2 or brackets; brackets are left out."""
    bare = F.regexp_replace(cell, r"（[^（）]*）|\([^()]*\)", "")
    masked = F.regexp_replace(F.regexp_replace(bare, r"(?<=\d)[/／](?=\d)", "\u0001"), r"(“[^”]*)[、/／]([^”]*”)", "$1\u0002$2")
    parts = F.transform(F.split(masked, r"[、/／]"), lambda x: F.trim(F.replace(F.replace(x, F.lit("\u0001"), F.lit("/")), F.lit("\u0002"), F.lit("、"))))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def bracketed(cell: Column) -> Column:
    """What stands in a cell's brackets: candidates for aliases, without notes on laws or amounts."""
    inner = F.regexp_extract_all(cell, F.lit(r"[（(]([^（）()]*)[）)]"), F.lit(1))
    return F.array_distinct(F.filter(inner, lambda x: (x != "") & ~x.rlike(r"第.+条|[法例则]$|^\d+[个项种类]?$")))
