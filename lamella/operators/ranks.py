"""Places and running sums in an order, without a task that sees a whole section or the whole table.

Rows are range-partitioned and sorted once and kept in the shared folder. A row's place in its partition comes for free
with the sort; what lies before a partition is added up over one row for each partition and section.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.session import checkpointed

#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
_ROWS = 33


def _sorted(rows: DataFrame, order: list, partition: list[str], parts: int | None) -> DataFrame:
    """Rows with the number of their range partition (_part) and their place in it (_at)."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, *partition, *order).sortWithinPartitions(*partition, *order)
    id_ = F.monotonically_increasing_id()
    return checkpointed(ordered.withColumn("_id", id_).withColumn("_part", F.shiftright("_id", _ROWS).cast("int")).withColumn("_at", F.col("_id").bitwiseAND((1 << _ROWS) - 1)).drop("_id"))


def ranked(rows: DataFrame, order: list, partition: list[str] | None = None, name: str = "rank", parts: int | None = None) -> DataFrame:
    """Rows with their place from 0 in ``order``, over everything or within each ``partition``; ties come in any order.

    Two passes over the sorted rows: one row for each range partition and section gives the offsets, whose running sum
    sees no more rows than there are range partitions (fewer than 2^20) in a section.
    """
    partition = partition or []
    at = _sorted(rows, order, partition, parts)
    size = at.groupBy(*partition, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*(partition or [F.shiftright("_part", 20)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = size.select(*partition, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    out = _met(at, offset, partition)
    return out.select(*rows.columns, (F.col("_at") + F.col("_offset")).alias(name))


def running(rows: DataFrame, value: str, order: list, partition: list[str] | None = None, name: str = "start", parts: int | None = None) -> DataFrame:
    """Rows with the sum of ``value`` over all rows before them in ``order``, over everything or within each ``partition``."""
    partition = partition or []
    at = _sorted(rows, order, partition, parts)
    inside = Window.partitionBy(*partition, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("_upto", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    size = at.groupBy(*partition, "_part").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*(partition or [F.shiftright("_part", 20)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = size.select(*partition, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    out = _met(at, offset, partition)
    return out.select(*rows.columns, (F.col("_upto") + F.col("_offset")).alias(name))


def _met(at: DataFrame, offset: DataFrame, partition: list[str]) -> DataFrame:
    """Null sections meet too."""
    o = offset.select(F.col("_part").alias("_p"), "_offset", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(partition)])
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(partition):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return at.join(o, same)
