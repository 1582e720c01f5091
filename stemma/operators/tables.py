"""Votes, sequences, samples, updates, differences and checks over keyed tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stemma.operators import ranking


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, null on a tie."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.max("n").alias("votes"), F.max_by(value, "n").alias("winner"), F.collect_list("n").alias("all"))
    tie = F.size(F.filter("all", lambda x: x == F.col("votes"))) > 1
    return best.select(key, F.when(~tie, F.col("winner")).alias("winner"), "votes")


def heaviest(rows: DataFrame, key: str, value: str, weight: Column) -> DataFrame:
    """The value of the largest summed weight, the smaller name on ties."""
    sums = rows.groupBy(key, value).agg(weight.alias("weight"))
    best = sums.groupBy(key).agg(F.min(F.struct((-F.col("weight")).alias("w"), F.col(value).alias("v"))).alias("b"))
    return best.select(key, F.col("b.v").alias(value), (-F.col("b.w")).alias("weight"))


def first_of(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_nth = 1").drop("_nth")


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], time: str, valid: Column) -> DataFrame:
    """Rows by key, the later time wins, the existing row on equal times; invalid incoming rows are skipped."""
    rows = existing.withColumn("_new", F.lit(0)).unionByName(incoming.where(valid).withColumn("_new", F.lit(1)))
    others = [c for c in rows.columns if c not in (*key, "_new")]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(time, -F.col("_new"))).alias("r"))
    return best.select(*key, *[F.col(f"r.{c}").alias(c) for c in others])


def gaps(rows: DataFrame, key: str, number: str, start: int = 1) -> DataFrame:
    """Each key's count and whether its numbers are exactly start..start+n-1, each once."""
    got = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(number).alias("d"), F.min(number).alias("lo"), F.max(number).alias("hi"))
    return got.select(key, "n", ((F.col("d") == F.col("n")) & (F.col("lo") == start) & (F.col("hi") == F.col("n") + start - 1)).alias("contiguous"))


def filled(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """The last value seen so far."""
    return rows.withColumn(name, F.last(value, True).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def best_window(rows: DataFrame, key: str, order: str, measure: Column, width: int) -> DataFrame:
    """Start of the window of ``width`` rows with the largest sum, the last one on ties; windows may end short."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(0, width - 1)
    sums = rows.withColumn("_sum", F.sum(measure).over(w))
    best = sums.groupBy(key).agg(F.max(F.struct("_sum", order)).alias("b"))
    return best.select(key, F.col(f"b.{order}").alias("start"), F.col("b._sum").alias("total"))


def every(rows: DataFrame, stratum: str, order: str, step: int, whole: list[str]) -> DataFrame:
    """Every step-th row of each stratum by order, and all rows of the strata in whole."""
    return ranking.running(rows, [stratum], [F.col(order)]).where(((F.col("nth") - 1) % step == 0) | F.col(stratum).isin(whole)).drop("nth")


def round_robin(rows: DataFrame, stratum: str, order: str, limit: int) -> DataFrame:
    """The first of each stratum, then the second of each, up to the limit."""
    first = rows.withColumn("turn", F.row_number().over(W.partitionBy(stratum).orderBy(order))).where(F.col("turn") <= limit)  # a bounded heap a group
    return first.orderBy("turn", stratum).limit(limit)


def quantiles(rows: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """The element at min(n - 1, floor(n * p)) of each key's sorted values; nothing is interpolated."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).withColumnRenamed(key, "_k")
    ranked = ranking.running(rows.select(key, value), [key], [F.col(value)]).withColumn("_i", F.col("nth") - 1)
    ranked = ranked.join(sizes, F.col(key).eqNullSafe(F.col("_k")))
    at = lambda p: F.least(F.col("_n") - 1, F.floor(F.col("_n") * p))
    return ranked.groupBy(key).agg(F.count("*").alias("n"), *[F.max(F.when(F.col("_i") == at(p), F.col(value))).alias(f"p{round(100 * p)}") for p in shares])


def difference(ours: DataFrame, theirs: DataFrame, key: list[str]) -> DataFrame:
    """Keys on one side only, with the side."""
    a, b = ours.select(*key).distinct(), theirs.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("lost")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("added")))


def rejects(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """reasons: the names of the rules that a row breaks; a null condition counts as kept."""
    marks = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()])
    return rows.withColumn("reasons", F.filter(marks, lambda x: x.isNotNull()))


def unique_values(rows: DataFrame, key: str, values: str, title: str | None = None) -> DataFrame:
    """key and those of its values that no other row has; a value that occurs twice has no winner.

    With a title column, values that a path can't hold and a row's own title are left out as well.
    """
    own = [] if title is None else [title]
    flat = rows.select(key, *own, F.explode(F.array_distinct(values)).alias("value"))
    once = flat.groupBy("value").agg(F.count("*").alias("n"), F.first(key).alias(key), *[F.first(t).alias("_title") for t in own]).where("n = 1")
    fine = once if title is None else once.where(~F.col("value").rlike(r'[\\/:*?"<>|#^\[\]]') & (F.trim("value") != "") & (F.col("value") != F.col("_title")))
    return fine.select(key, "value")


def hashed_pairs(vectors: DataFrame, id_: str, vector: str, least: float, size: int, tables: int = 48, planes: int = 6, seed: int = 7, bucket: int = 2000) -> DataFrame:
    """Pairs a < b whose cosine is at least ``least``, among those that share a bucket of random hyperplanes; cosines are exact.

    size: the vectors' length. Buckets of more than ``bucket`` vectors are split by further planes, so no bucket is quadratic
    in the table. Two vectors at an angle t share a bucket of a table with probability (1 - t / pi) ** planes.
    """
    count = vectors.count()
    planes = max(planes, int(np.ceil(np.log2(max(2, count / bucket * 2)))))  # expected sizes stay below the bucket's
    normal = np.random.default_rng(seed).normal(size=(size, tables * planes)).astype(np.float32)
    own = vectors.select(F.col(id_).alias("id"), F.col(vector).cast("array<float>").alias("v"))
    weights = 1 << np.arange(planes, dtype=np.int64)

    @F.pandas_udf("array<long>")
    def signed(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        side = (np.stack(v.to_numpy()) @ normal > 0).reshape(len(v), tables, planes)
        return pd.Series(list(side @ weights))

    spread = own.select("id", "v", F.posexplode(signed("v")).alias("t", "h"))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        p = np.stack(rows["v"].to_numpy()).astype(float)
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
        ids, out = rows["id"].to_numpy(), []
        for lo in range(0, len(ids), 1024):
            s = p[lo : lo + 1024] @ p.T
            i, j = np.nonzero(s >= least)
            a, b = ids[lo + i], ids[j]
            out.append(pd.DataFrame({"a": a, "b": b, "cosine": s[i, j]})[a < b])
        return pd.concat(out)

    return spread.groupBy("t", "h").applyInPandas(meet, "a long, b long, cosine double").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def similar_pairs(vectors: DataFrame, id_: str, vector: str, least: float, block: int = 2048) -> DataFrame:
    """All pairs a < b whose cosine is at least ``least``, exactly, as matrix products of blocks.

    The work is quadratic, as the exact join is; a block is sent to each block that it meets, never row to row. For tables
    of which that is too much, hashed_pairs() compares candidates only.
    """
    n = max(1, math.ceil(vectors.count() / block))
    own = vectors.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(id_), F.lit(n)).cast("int").alias("k"))
    left = own.withColumn("o", F.explode(F.sequence(F.col("k"), F.lit(n - 1))))
    right = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k")))).select("id", "v", F.col("o").alias("k"), F.col("k").alias("o"))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        p, q = (np.stack(d["v"].to_numpy()) for d in (x, y))
        p, q = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (p, q))
        s = p @ q.T
        i, j = np.nonzero(s >= least)
        a, b = x["id"].to_numpy()[i], y["id"].to_numpy()[j]
        once = a < b if x["k"].iloc[0] == x["o"].iloc[0] else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[once], "b": np.maximum(a, b)[once], "cosine": s[i, j][once]})

    return left.groupBy("k", "o").cogroup(right.groupBy("k", "o")).applyInPandas(meet, "a long, b long, cosine double")


def replaced(base: DataFrame, part: DataFrame, owner: str, value: str) -> DataFrame:
    """base with all rows of one owner replaced by part; missing columns are null. Repeating it changes nothing."""
    return base.where(~F.col(owner).eqNullSafe(F.lit(value))).unionByName(part, allowMissingColumns=True)


def shared(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.withColumn("shared", F.array_sort(F.array_distinct(F.array_intersect(a, b))))


def unique(rows: DataFrame, columns: list[str]) -> None:
    """An error that names the columns whose values occur more than once, nulls aside, with a sample."""
    wrong = {c: r[c] for c in columns if (r := rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).where("n > 1").orderBy(c).first())}
    if wrong:
        raise ValueError("; ".join(f"{c}: {v!r} occurs twice" for c, v in wrong.items()))


def coverage(expected: DataFrame, found: DataFrame, key: str, number: str, pattern: str, sentinel: Column) -> DataFrame:
    """check, faults: keys that are missing, keys too many, numbers that aren't 1..n, keys of another form, rows without the sentinel."""
    faults = lambda name, df: df.agg(F.lit(name).alias("check"), F.count("*").alias("faults"))
    numbers = gaps(found.withColumn("_all", F.lit(0)), "_all", number).where("NOT contiguous")
    rows = [
        faults("coverage", expected.select(key).distinct().join(found, key, "left_anti")),
        faults("count", found.join(expected.select(key), key, "left_anti")),
        faults("continuity", numbers),
        faults("format", found.where(~F.col(key).cast("string").rlike(pattern))),
        faults("sentinel", found.where(~F.coalesce(sentinel, F.lit(False)))),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def cross_check(ours: DataFrame, theirs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, fault of what two sources of one table don't agree on: a side that lacks the key, or fields that differ."""
    b = theirs.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    both = ours.join(b, F.col(key) == F.col("_k"), "full")
    differ = F.array_join(F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull()), ",")
    fault = F.when(F.col("_k").isNull(), "only ours").when(F.col(key).isNull(), "only theirs").otherwise(F.nullif(differ, F.lit("")))
    return both.select(F.coalesce(key, "_k").alias(key), fault.alias("fault")).where("fault IS NOT NULL")
