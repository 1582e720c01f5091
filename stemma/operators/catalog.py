"""Catalogue queries: filters, facets, roll-ups, paging, output budgets, batches of look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stemma.operators import ranking

UNLABELLED = "(none)"


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, n over all rows, in one pass; missing values are labelled."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(UNLABELLED)).alias("value")) for c in columns])
    return rows.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count("*").alias("n"))


def rollup(rows: DataFrame, levels: list[str], measures: dict[str, Column]) -> DataFrame:
    """Totals of every prefix of the levels; rows that lack a level are skipped."""
    full = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in levels))
    return full.rollup(*levels).agg(*[v.alias(k) for k, v in measures.items()], F.grouping_id().alias("gid")).withColumn("depth", F.lit(len(levels)) - F.length(F.regexp_replace(F.bin("gid"), "0", ""))).drop("gid")


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset..offset+limit of the order, with total and has_more.

    Only the first offset + limit rows are ordered (a heap a task); the total is a count beside it.
    """
    total = rows.count()
    first = rows.orderBy(*order).limit(offset + limit)
    own = first.withColumn("rank", F.row_number().over(W.orderBy(*order))).where(F.col("rank") > offset)  # of offset + limit rows
    return own.withColumns({"total": F.lit(total).cast("long"), "has_more": F.lit(total > offset + limit)})


def budget(rows: DataFrame, cost: str, order: list[Column], cap: float, within: list[str], base: float = 0, extra: int = 2) -> DataFrame:
    """The longest prefix of each group whose running cost fits; if nothing is charged yet, the first row always fits."""
    out = ranking.running(rows, within, order, {"spent": F.col(cost) + extra}).withColumn("spent", F.col("spent") + base)
    fits = F.col("spent") <= cap
    return out.where(fits | (F.col("nth") == 1) if base == 0 else fits)


def budget_cap(safe: float = 12_000) -> float:
    """Tokens for an answer: the safe size, within bounds, less a tenth or a thousand."""
    safe = min(100_000, max(1000, safe))
    return safe - min(1000, round(0.1 * safe))


def batch(keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Each asked key in the asked order (nth), with the row or found = false. keys: nth, key."""
    have = rows.withColumn("found", F.lit(True))
    return keys.join(have, keys[key] == have[key], "left").drop(have[key]).withColumn("found", F.coalesce("found", F.lit(False)))


def text_page(text: Column, offset: int, limit: int) -> tuple[Column, Column]:
    """The characters offset..offset+limit and whether more follow."""
    return F.substring(text, offset + 1, limit), F.length(text) > offset + limit


def taxonomy(rows: DataFrame, levels: tuple[str, str, str], leaf: str) -> DataFrame:
    """One row a value of the first level: nested lists of the second, the third and their leaves, each in order of name."""
    a, b, c = levels
    third = rows.dropna(subset=list(levels)).groupBy(a, b, c).agg(F.array_sort(F.collect_list(leaf)).alias("leaves"))
    second = third.groupBy(a, b).agg(F.array_sort(F.collect_list(F.struct(c, "leaves"))).alias("below"))
    return second.groupBy(a).agg(F.array_sort(F.collect_list(F.struct(b, "below"))).alias("below"))


def sheets(rows: DataFrame, order: list[Column], size: int, within: list[str]) -> DataFrame:
    """sheet: rows of each group dealt in order into sheets of ``size``, counted from 1."""
    return ranking.running(rows, within, order).withColumn("sheet", (F.floor((F.col("nth") - 1) / size) + 1).cast("int")).drop("nth")
