"""Consecutive numbers for rows, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactmill.session import cut_lineage


def number_rows(df: DataFrame, order: list, name: str = "row_no", start: int = 0) -> DataFrame:
    """Number all rows in a global order: ``start + 1, start + 2, ...``.

    Rows are range-sorted and written once to the shared folder, so both
    passes see the same partitions. One count per partition (their number is
    bounded by the shuffle width) gives each partition its offset.
    """
    ordered = cut_lineage(
        df.orderBy(*order).withColumns(
            {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}
        )
    )
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    offsets = sizes.select("_part", "_first", before.alias("_before"))
    number = F.lit(start) + F.col("_before") + F.col("_at") - F.col("_first") + 1
    return ordered.join(F.broadcast(offsets), "_part").withColumn(name, number).drop(
        "_part", "_at", "_first", "_before"
    )


# Up to this many rows are kept and sorted by one task.
SMALL_PAGE = 10_000


def page_of(df: DataFrame, order: list, limit: int, offset: int, key: str = "id") -> DataFrame:
    """Rows ``offset + 1`` to ``offset + limit`` in a total order; ``key`` names a row.

    The first pages are a plain top-k. A deeper one would keep all rows before it in one task: instead the sort columns
    are range-sorted, the rows of each range counted, and only the ranges that hold the page are looked into; the
    whole rows, ``limit`` at most, are then fetched by their key.
    """
    if offset + limit <= SMALL_PAGE:
        return df.orderBy(*order).offset(offset).limit(limit)
    sort_key = df.orderBy(*order).select(key)
    ranged = cut_lineage(sort_key.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    along = Window.orderBy("_part")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(along) - F.col("_n"))
    holding = sizes.where((F.col("_before") < offset + limit) & (F.col("_before") + F.col("_n") > offset))
    placed = ranged.join(F.broadcast(holding.drop("_n")), "_part").withColumn("_place", F.col("_before") + F.col("_at") - F.col("_first"))
    page = placed.where((F.col("_place") >= offset) & (F.col("_place") < offset + limit)).select(F.col(key).alias("_key"), "_place")
    return df.join(page, F.col(key) == F.col("_key")).orderBy("_place").drop("_key", "_place")


def next_surrogate_ids(existing: DataFrame, new_rows: DataFrame, order: list) -> DataFrame:
    """Give new rows ids after the largest stored one, in arrival order."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    numbered = number_rows(new_rows, order, "_no")
    return numbered.withColumn("id", F.col("_no") + top).drop("_no")


def stable_uuid(kind: str, *parts: Column) -> Column:
    """The same UUID text for the same key, on every run and every executor."""
    h = F.md5(F.concat_ws("|", F.lit(kind), *[p.cast("string") for p in parts]))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in cuts])
