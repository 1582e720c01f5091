"""Audits of edges and terms: classification, blacklists, ambiguous names, layout arithmetic, ranking differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stemma.functions import text as T


def keyword_strength(text: Column, keywords: list[str], most: int = 4000) -> Column:
    return T.hits(F.substring(F.lower(text), 1, most), [k.lower() for k in keywords])


def is_hub(label: Column, topics: Column, level: Column, pattern: str = r"^(总则|附则|一般规定|概述)$", many: int = 8) -> Column:
    """A node of general content; articles of law are exempt."""
    return (level != "law") & (label.rlike(pattern) | (F.size(topics) >= many))


def classified(edges: DataFrame, low: float = 0.4, high: float = 0.62) -> DataFrame:
    """level (red, yellow, green) and advice of an edge by hubs at its ends, shared strength and similarity.

    edges: hub_src, hub_dst, strength, cosine (null without vectors).
    """
    weak = F.col("strength") <= 1
    level = F.when((F.col("hub_src") | F.col("hub_dst")) & weak, "red").when(F.col("cosine") < low, "red").when(F.col("cosine") >= high, "green").when(weak, "yellow").otherwise("green")
    return edges.withColumns({"level": level, "advice": F.when(level == "red", "drop").when(level == "yellow", "review").otherwise("keep")})


def verdicts(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """The last verdict of each (center, neighbour), tallied by relation."""
    last = rows.groupBy("center", "neighbour").agg(F.max_by(F.struct("relation", "verdict"), seq).alias("v"))
    return last.groupBy("v.relation", "v.verdict").agg(F.count("*").alias("n"))


def blacklist(rows: DataFrame, bad: str = "bad") -> DataFrame:
    """Undirected pairs all of whose verdicts are bad; a conflict keeps the pair."""
    pair = rows.select(F.least("center", "neighbour").alias("a"), F.greatest("center", "neighbour").alias("b"), "verdict")
    return pair.groupBy("a", "b").agg(F.bool_and(F.col("verdict") == bad).alias("black")).where("black").select("a", "b")


def undecided(rows: DataFrame, unsure: str = "unsure") -> DataFrame:
    pair = rows.select(F.least("center", "neighbour").alias("a"), F.greatest("center", "neighbour").alias("b"), "verdict")
    return pair.groupBy("a", "b").agg(F.collect_set("verdict").alias("v")).where(F.col("v") == F.array(F.lit(unsure))).select("a", "b")


def ambiguous(terms: DataFrame) -> DataFrame:
    """reasons why a name may be ambiguous. terms: name, pages (that hold it), embedded (share of hits inside longer words)."""
    n, pages = F.length("name"), F.col("pages")
    rules = {"short": n <= 2, "three": (n == 3) & (pages >= 3), "embedded": (n == 4) & (pages >= 8) & (F.col("embedded") >= 0.8), "common": pages >= 40}
    return terms.withColumn("reasons", F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())).where(F.size("reasons") > 0)


def neighbours_of_hits(texts: DataFrame, name: str, most: int = 5) -> DataFrame:
    """side, character, n: the characters most often next to a name, overlapping hits included; "" at a text's ends. texts: text."""
    here = f"(?=\\Q{name}\\E)"
    left = F.regexp_extract_all("text", F.lit(rf"(?s)(?:(?<=(.))|^){here}"), F.lit(1))
    right = F.regexp_extract_all("text", F.lit(rf"(?s)(?=\Q{name}\E(.?))"), F.lit(1))
    named = lambda side: lambda x: F.struct(F.lit(side).alias("side"), x.alias("character"))
    sides = F.concat(F.transform(left, named("left")), F.transform(right, named("right")))
    counts = texts.where(F.contains("text", F.lit(name))).select(F.inline(sides)).groupBy("side", "character").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("side").orderBy(F.col("n").desc(), "character"))).where(F.col("rank") <= most).drop("rank")


def placed(new: DataFrame, edges: DataFrame, fixed: DataFrame, jitter: float = 12.0, ring: float = 1000.0) -> DataFrame:
    """x, y of new nodes: the weighted centre of their placed neighbours plus a jitter from the id's hash; others on a ring.

    new: id; edges: src, dst, weight; fixed: id, x, y.
    """
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "weight").unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "weight"))
    centre = both.join(new, "id", "left_semi").join(fixed.withColumnRenamed("id", "other"), "other").groupBy("id").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("cx"), (F.sum(F.col("y") * F.col("weight")) / F.sum("weight")).alias("cy"))
    turn = T.fnv1a(F.col("id")) % 3600 / 3600.0 * 6.283185307179586
    far = F.when(F.col("cx").isNull(), ring).otherwise(jitter)
    rows = new.join(centre, "id", "left")
    return rows.select("id", F.round(F.coalesce("cx", F.lit(0.0)) + far * F.cos(turn), 2).alias("x"), F.round(F.coalesce("cy", F.lit(0.0)) + far * F.sin(turn), 2).alias("y"))


def layout_key(nodes: DataFrame, edges: DataFrame, flags: dict[str, str]) -> str:
    """A fingerprint by which a stored layout is known to be stale."""
    return f"n{nodes.count()}-e{edges.count()}-" + "-".join(f"{k}={v}" for k, v in sorted(flags.items()))


def ranking_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """query, lost, added, same_top3 between two rankings (query, ids in order)."""
    both = before.select("query", F.col("ids").alias("old")).join(after.select("query", F.col("ids").alias("new")), "query", "full")
    old, new = (F.coalesce(c, F.array().cast("array<string>")) for c in ("old", "new"))
    return both.select("query", F.array_except(old, new).alias("lost"), F.array_except(new, old).alias("added"), (F.slice(old, 1, 3) == F.slice(new, 1, 3)).alias("same_top3"))


def expectations(checks: dict[str, tuple[DataFrame, int]]) -> None:
    """Counts that must hold; all failures are named at once."""
    wrong = {k: (n, want) for k, (df, want) in checks.items() if (n := df.count()) != want}
    if wrong:
        raise ValueError("; ".join(f"{k}: {n} rows, not {want}" for k, (n, want) in sorted(wrong.items())))
