"""Orders, unions and differences that reports share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.sources.tables import Tables


def nocase(column: str, *ties: str) -> list[Column]:
    """By text without regard to case, for all letters."""
    return [F.lower(column), *map(F.col, ties)]


def nulls_last(column: str, *ties: str) -> list[Column]:
    """Ascending, rows without a value at the end."""
    return [F.asc_nulls_last(column), *map(F.col, ties)]


def desc_nulls_last(column: str, *ties: str) -> list[Column]:
    """Descending, rows without a value at the end."""
    return [F.desc_nulls_last(column), *map(F.col, ties)]


def open_items(t: Tables) -> DataFrame:
    """``lead_id, due_date, item_type``: open tasks and open interactions, all of them, repeated rows too."""
    def part(df: DataFrame, date: str, kind: str) -> DataFrame:
        return df.filter(F.col("status") == "open").select("lead_id", F.col(date).alias("due_date"), F.lit(kind).alias("item_type"))

    return part(t.tasks, "due_date", "task").unionByName(part(t.interactions, "deadline", "interaction"))


def dedupe_first_seen(items: Column) -> Column:
    """Each value of an array once, where it first stands."""
    return F.array_distinct(items)


def id_difference(ids: DataFrame, taken: DataFrame, column: str) -> DataFrame:
    """The ``id`` rows that no row of ``taken`` names in ``column``."""
    return ids.select("id").join(taken.select(F.col(column).alias("_taken")), F.col("id") == F.col("_taken"), "left_anti")
