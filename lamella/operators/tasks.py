"""How rows are dealt to tasks where Spark's own estimates go wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def dealt(rows: DataFrame) -> DataFrame:
    """A side of a join that grows with the tables: dealt out by its keys on both sides and never broadcast.

    Spark takes an exploded table for as large as what it was exploded from, and a compressed file or shuffle for as large
    as its bytes. Pixels and cells of thousands of circles thereby pass for a few MB and would go through the driver.
    """
    return rows.hint("merge")


def spread(rows: DataFrame, n: int, each: int, *by: str | Column) -> DataFrame:
    """Rows dealt out by columns into tasks that hold about ``each`` of ``n`` units of work, and at least a stage's usual number.

    Adaptive execution merges shuffle partitions by their compressed bytes, however much a row grows to or costs later; a
    number that is given is left as it is.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-n // each)), *by)
