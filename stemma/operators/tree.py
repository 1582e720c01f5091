"""Hierarchies by parent links, path identifiers and reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stemma.functions import text as T


def descendants(children: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """id, depth, path of the seeds and what is below them. children: parent, id; seeds: id.

    A bounded loop of joins, each layer from the last; layers grow only by what hangs below the seeds.
    """
    layer = seeds.select("id", F.lit(0).alias("depth"), F.col("id").alias("path"))
    out = layer
    for d in range(1, depth + 1):
        layer = layer.select(F.col("id").alias("parent"), "path").join(children, "parent").select("id", F.lit(d).alias("depth"), F.concat_ws("/", "path", "id").alias("path"))
        out = out.unionByName(layer)
    return out


def ancestors(children: DataFrame, depth: int) -> DataFrame:
    """id and its chain of ancestors, outermost first."""
    out = children.select("id", F.col("parent").alias("top"), F.array("parent").alias("chain"))
    up = children.select(F.col("id").alias("top"), F.col("parent").alias("next"))
    for _ in range(depth - 1):
        out = out.join(up, "top", "left").select("id", F.coalesce("next", "top").alias("top"), F.when(F.col("next").isNotNull(), F.concat(F.array("next"), "chain")).otherwise(F.col("chain")).alias("chain"))
    return out.select("id", "chain")


def children_in_order(children: DataFrame) -> DataFrame:
    """parent and its children by natural order."""
    listed = F.array_sort(F.collect_list(F.struct(T.natural_key(F.col("id")).alias("k"), "id")))
    return children.groupBy("parent").agg(F.transform(listed, lambda x: x.id).alias("children"))


def leaves(children: DataFrame) -> DataFrame:
    """id, whether nothing hangs below it."""
    inner = children.select(F.col("parent").alias("id")).distinct().withColumn("inner", F.lit(True))
    return children.select("id").distinct().join(inner, "id", "left").select("id", F.col("inner").isNull().alias("is_leaf"))


def by_prefix(rows: DataFrame, path: str, separator: str = "/") -> DataFrame:
    """folder and its rows below, for every proper prefix of every path."""
    return rows.select(F.explode(T.prefixes(F.col(path), separator)).alias("folder")).groupBy("folder").agg(F.count("*").alias("n"))


def neighbours(rows: DataFrame, id_: str, order: list[Column], within: list[str] | None = None, book: str | None = None) -> DataFrame:
    """prev_id and next_id in reading order; with book, a neighbour of another book is hidden, not skipped."""
    w = W.partitionBy(*(within or [])).orderBy(*order)
    out = rows.withColumns({"prev_id": F.lag(id_).over(w), "next_id": F.lead(id_).over(w)})
    if book:
        out = out.withColumns({"prev_id": F.when(F.lag(book).over(w) == F.col(book), F.col("prev_id")), "next_id": F.when(F.lead(book).over(w) == F.col(book), F.col("next_id"))})
    return out


def spans(rows: DataFrame, document: str, line: str, level: str, levels: int) -> DataFrame:
    """own_end: the next heading's line; full_end: the next heading's of this level or above; null at the end.

    rows are headings. For each level the nearest later heading at or above it is a running minimum from the end.
    """
    w = W.partitionBy(document).orderBy(line)
    after = w.rowsBetween(1, W.unboundedFollowing)
    ends = [F.min(F.when(F.col(level) <= k, F.col(line))).over(after) for k in range(1, levels + 1)]
    full = F.element_at(F.array(*ends), F.col(level))
    return rows.withColumns({"own_end": F.lead(line).over(w), "full_end": full})


def overlay(rows: DataFrame, order: DataFrame, parent: str, key: str, default: list[Column]) -> DataFrame:
    """position of each row under its parent: listed keys first in listed order, then the others by default.

    order: parent, keys (array); unknown keys are ignored, of repeated ones the first counts.
    """
    listed = order.select(F.col("parent").alias("_p"), F.posexplode("keys").alias("_at", "_k")).groupBy("_p", "_k").agg(F.min("_at").alias("_at"))
    joined = rows.join(listed, (F.col(parent) == F.col("_p")) & (F.col(key) == F.col("_k")), "left")
    return joined.withColumn("position", F.row_number().over(W.partitionBy(parent).orderBy(F.col("_at").asc_nulls_last(), *default))).drop("_p", "_k", "_at")
