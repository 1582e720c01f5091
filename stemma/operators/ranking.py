"""Row numbers and running sums within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stemma.sources.shared import cut

#: Rows of a group that one task orders; where a group has more, groups are dealt in ranges.
GROUP = 2_000_000


def running(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column] | None = None, group: int = GROUP) -> DataFrame:
    """rows with nth (from 1, in order) and, by name, the running sums of columns, within each group.

    If the largest group is measured to be beyond ``group`` rows, rows are dealt by ranges of (keys, order) over all tasks and
    written, numbered within each range, and moved up by the totals of the ranges before, of which there is one row a range
    and group. The numbers are the same either way, up to rows that are equal in keys and order.
    """
    sums = sums or {}
    largest = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    upto = lambda w: {"nth": F.row_number().over(w), **{k: F.sum(c).over(w.rowsBetween(W.unboundedPreceding, 0)) for k, c in sums.items()}}
    if largest <= group:
        return rows.withColumns(upto(W.partitionBy(*keys).orderBy(*order)))
    own = [F.col(k) for k in keys]
    dealt = cut(rows.withColumns({f"_sum_{k}": c for k, c in sums.items()}).repartitionByRange(*own, *order).withColumn("_part", F.spark_partition_id()))
    here = W.partitionBy("_part", *keys).orderBy(*order)
    numbered = dealt.withColumns({"nth": F.row_number().over(here), **{k: F.sum(f"_sum_{k}").over(here.rowsBetween(W.unboundedPreceding, 0)) for k in sums}})
    totals = dealt.groupBy("_part", *keys).agg(F.count("*").alias("_n"), *[F.sum(f"_sum_{k}").alias(f"_t_{k}") for k in sums])
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = totals.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], zero("_n").alias("_n"), *[zero(f"_t_{k}").alias(f"_o_{k}") for k in sums])
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    moved = numbered.join(offsets, same)
    return moved.select(*rows.columns, (F.col("nth") + F.col("_n")).cast("int" if largest < 2**31 else "long").alias("nth"), *[(F.col(k) + F.col(f"_o_{k}")).alias(k) for k in sums])
