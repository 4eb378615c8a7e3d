"""Running sums, ranks and medians of groups of any size: rows are dealt by range, so that a group lies in adjacent partitions.

Sums are taken within each partition and shifted by those of the group's earlier partitions, of which there are no more than
partitions and groups. No task holds a group, and no window lacks a key but those over a row for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def spread(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """rows, stored, with _piece: the partition that holds them, rising with (by, order)."""
    return stored(rows.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_piece", F.spark_partition_id()))


def _with_pieces(rows: DataFrame, pieces: DataFrame, by: list[str]) -> DataFrame:
    keys = [*by, "_piece"]
    other = pieces.select(*[F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)], *[c for c in pieces.columns if c not in keys])
    return rows.join(other, [F.col(k).eqNullSafe(F.col(f"_of{i}")) for i, k in enumerate(keys)]).drop(*[f"_of{i}" for i in range(len(keys))])


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows of spread() with, for each name of sums, its running sum by order (up to the row) and, as <name>_all, its sum over the group."""
    totals = rows.groupBy(*by, "_piece").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before, whole = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    made = [c for n in sums for c in (F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}"), F.sum(f"_t_{n}").over(whole).alias(f"{n}_all"))]
    upto = Window.partitionBy(*by, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumns({f"_w_{n}": F.sum(c).over(upto) for n, c in sums.items()})
    joined = _with_pieces(within, totals.select(*by, "_piece", *made), by)
    joined = joined.withColumns({n: F.col(f"_w_{n}") + F.col(f"_b_{n}") for n in sums})
    return joined.drop(*[f"_{k}_{n}" for n in sums for k in "wb"])


def least_after(rows: DataFrame, value: str, order: Column) -> DataFrame:
    """rows of spread() by no key with value replaced by its least from the row on, by order."""
    after = Window.orderBy("_piece").rowsBetween(1, Window.unboundedFollowing)
    pieces = rows.groupBy("_piece").agg(F.min(value).alias("_m")).select("_piece", F.min("_m").over(after).alias("_after"))
    within = Window.partitionBy("_piece").orderBy(order.desc()).rowsBetween(Window.unboundedPreceding, 0)
    joined = _with_pieces(rows.withColumn("_near", F.min(value).over(within)), pieces, [])
    return joined.withColumn(value, F.least("_near", "_after")).drop("_near", "_after")


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with their 0-based rank within by, by an order that tells them apart."""
    return running(spread(rows, by, order), by, order, {name: F.lit(1)}).withColumn(name, F.col(name) - 1).drop("_piece", f"{name}_all")


def median(rows: DataFrame, by: list[str], value: str, name: str = "med") -> DataFrame:
    """The exact median of each group, from counts of distinct values; nulls are left out."""
    each = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    at = running(spread(each, by, [F.col(value)]), by, [F.col(value)], {"_upto": F.col("_n")})
    holds = lambda place: F.max(F.when((F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto")), F.col(value)))
    low, high = F.floor((F.col("_upto_all") - 1) / 2), F.floor(F.col("_upto_all") / 2)
    return at.groupBy(*by).agg(((holds(low) + holds(high)) / 2).alias(name))
