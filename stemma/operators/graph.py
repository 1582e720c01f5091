"""Typed, weighted, undirected edges: building, first-wins union, degree, quotas, neighbourhoods, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stemma.sources.shared import cut


def dedupe(edges: DataFrame, seq: str = "seq") -> DataFrame:
    """One edge for each pair and type, the first by seq; loops dropped. edges: src, dst, type, weight, seq."""
    rows = edges.where("src <> dst").withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    best = rows.groupBy("a", "b", "type").agg(F.min_by(F.struct("src", "dst", "weight"), seq).alias("e"))  # partial aggregation, no sort
    return best.select("e.src", "e.dst", "type", "e.weight")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def closed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both ends of which are nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)


def pairs_within(members: DataFrame, group: str, item: str, least: int = 2, most: int = 6) -> DataFrame:
    """a < b and how many groups of least..most distinct items hold both. The size bound keeps a group's pairs bounded."""
    own = members.groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("items")).where(F.size("items").between(least, most))
    pair = F.explode(F.flatten(F.transform("items", lambda x, i: F.transform(F.slice(F.col("items"), i + 2, F.size("items")), lambda y: F.struct(x.alias("a"), y.alias("b"))))))
    return own.select(pair.alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("share")).select("a", "b", "share")


def quota(pairs: DataFrame, frequency: DataFrame, most: int = 8, least_share: int = 2) -> DataFrame:
    """Edges that either end picks: each picks its ``most`` best partners of enough share; who has none picks its one best.

    pairs: a, b, share; frequency: id, df.
    """
    df = frequency.select(F.col("id").alias("other"), "df")
    sides = pairs.select(F.col("a").alias("own"), F.col("b").alias("other"), "share").unionByName(pairs.select(F.col("b").alias("own"), F.col("a").alias("other"), "share"))
    best = [F.col("share").desc(), F.col("df").desc(), F.col("other")]
    ranked = sides.join(df, "other").withColumns({"rank": F.row_number().over(W.partitionBy("own").orderBy(*best)), "top": F.max("share").over(W.partitionBy("own"))})
    picked = ranked.where(((F.col("share") >= least_share) & (F.col("rank") <= most)) | ((F.col("top") < least_share) & (F.col("rank") == 1)))
    out = picked.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "share").distinct()
    return out.withColumn("weight", F.round(F.least(F.col("share"), F.lit(5)) / 5.0 * 0.7, 3))


def top_per_key(rows: DataFrame, key: str | list[str], order: list[Column], most: int) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def neighbourhood(edges: DataFrame, centre: Column, hops: int) -> DataFrame:
    """id and distance of everything within so many hops; one join and one aggregate a hop."""
    step = both_ways(edges).distinct()
    seen = edges.sparkSession.range(1).select(centre.alias("id"), F.lit(0).alias("depth"))
    for d in range(1, hops + 1):
        near = seen.where(F.col("depth") == d - 1).join(step, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.lit(d).alias("depth"))
        seen = seen.unionByName(near).groupBy("id").agg(F.min("depth").alias("depth"))
    return seen


def chains(merges: DataFrame) -> DataFrame:
    """src, dst of a merge map followed to its end; entries that lead into a cycle are left out.

    merges: src (unique), dst. Pointer doubling: a round halves what is left of every chain, and while there is a chain that
    hasn't ended, some entry ends in the next round; so the rounds stop once no entry does. Each round is written.
    """
    ends = merges.select(F.col("src").alias("dst"))
    now, open_ = merges.select("src", "dst"), -1
    while True:
        far = now.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
        now = cut(now.join(far, "dst", "left").select("src", F.coalesce("next", "dst").alias("dst")))
        left = now.join(ends, "dst", "left_semi").count()
        if left in (0, open_):
            return now.join(ends, "dst", "left_anti").select("src", "dst")
        open_ = left


def mixed_quota(direct: DataFrame, indirect: DataFrame, most: int = 8, least: int = 2) -> DataFrame:
    """src, dst, weight: direct targets in order of name, then indirect ones by count, each target once, up to ``most``.

    direct: src, dst; indirect: src, dst, n, of which only counts from ``least`` on are taken. The cap counts what is kept.
    """
    first = direct.select("src", "dst", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n")).distinct()
    second = indirect.where(F.col("n") >= least).select("src", "dst", F.lit(1).alias("kind"), F.col("n").cast("long").alias("n"))
    best = first.unionByName(second).groupBy("src", "dst").agg(F.min(F.struct("kind", (-F.col("n")).alias("order"))).alias("b"))
    order = W.partitionBy("src").orderBy("b.kind", "b.order", "dst")
    kept = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return kept.select("src", "dst", F.when(F.col("b.kind") == 0, 0.7).otherwise(0.4).alias("weight"))


def star(members: DataFrame) -> DataFrame:
    """Edges from each member of a topic to its leader, the member whose label is the topic's name; none without a leader.

    members: id, label, topic.
    """
    leader = members.where(F.col("label") == F.col("topic")).groupBy("topic").agg(F.min("id").alias("dst"))
    return members.join(leader, "topic").where(F.col("id") != F.col("dst")).select(F.col("id").alias("src"), "dst", F.lit("termrel").alias("type"), F.lit(0.8).alias("weight"))


def hubs(edges: DataFrame, seeds: DataFrame, most: int = 120) -> DataFrame:
    """id, degree of the nodes of highest degree and of the seeds, whatever their degree. seeds: id."""
    rows = degree(edges).join(seeds.select("id").distinct().withColumn("seed", F.lit(True)), "id", "full")
    rows = rows.select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("seed", F.lit(False)).alias("seed"))
    top = rows.orderBy(F.col("degree").desc(), "id").limit(most)
    return top.unionByName(rows.where("seed")).select("id", "degree").distinct()
