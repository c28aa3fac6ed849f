"""Roll-ups, panel alignment and checks of sparse counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators.geometry import down
from lamella.operators.ranks import running


def checked(counts: DataFrame, value: str = "umi", where: str = "true") -> DataFrame:
    """Counts, or a failure while they are read if one is negative, fractional, not finite or beyond 2**63 - 1."""
    v = F.col(value)
    bad = F.expr(where) & (v.isNull() | (v < 0) | (v.cast("double") != F.rint(v.cast("double"))))
    if dict(counts.dtypes)[value] in ("double", "float"):
        bad = bad | F.isnan(v) | (v >= float(2**63))
    ok = F.when(~F.coalesce(bad, F.lit(True)), v).otherwise(F.raise_error(F.concat(F.lit("not a raw count: "), F.coalesce(v.cast("string"), F.lit("null")))).cast(counts.schema[value].dataType))
    return counts.withColumn(value, ok.cast("long"))


def faults(counts: DataFrame, rows: int, cols: int) -> DataFrame:
    """One row of tallies: rows, negative, outside the capture, beyond 16 bits, repeated keys."""
    inside = F.col("y").between(0, rows - 1) & F.col("x").between(0, cols - 1)
    tallies = counts.agg(F.count("*").alias("n"), F.count_if(F.col("umi") < 0).alias("negative"), F.count_if(~inside).alias("outside"), F.count_if(F.col("umi") > 65535).alias("beyond_uint16"), F.max("umi").alias("max_umi"))
    repeats = repeated(counts, ["section_id", "y", "x", "gene_id"]).agg(F.count("*").alias("repeated"))
    return tallies.crossJoin(repeats)  # one row each


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once; empty for a table whose key is unique."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def squares(counts: DataFrame, step: int, names: tuple[str, str] = ("qy", "qx")) -> DataFrame:
    """Counts summed over squares of ``step`` pixels: 4 for 8 um, 8 for 16 um, 16 for 32 um."""
    keyed = counts.select("section_id", down("y", step).alias(names[0]), down("x", step).alias(names[1]), "gene_id", "umi")
    return keyed.groupBy("section_id", *names, "gene_id").agg(F.sum("umi").alias("umi"))


def at_cells(counts8: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """Counts of requested cells and genes; zero where none was measured."""
    asked = cells.crossJoin(F.broadcast(genes))
    return asked.join(counts8, ["section_id", "qy", "qx", "gene_id"], "left").withColumn("umi", F.coalesce("umi", F.lit(0)))


def owned(counts: DataFrame, owners: DataFrame) -> DataFrame:
    """Counts of the parents that own the pixels; pixels without an owner count nowhere."""
    joined = counts.join(owners, ["section_id", "y", "x"])
    return joined.groupBy("section_id", "parent_id", "gene_id").agg(F.sum("umi").alias("umi"))


def dual_rollup(counts: DataFrame, owners: DataFrame, output: DataFrame) -> DataFrame:
    """Parent totals over covered pixels, and 8 um totals over all pixels of output genes, in one table (kind).

    Both come from one pass: a count goes to its parent and to its cell.
    """
    placed = counts.join(owners, ["section_id", "y", "x"], "left").join(F.broadcast(output.select("gene_id", F.lit(True).alias("out"))), "gene_id", "left")
    goes = F.array(
        F.struct(F.lit("parent").alias("kind"), F.col("parent_id").alias("a"), F.lit(0).cast("long").alias("b"), F.col("parent_id").isNotNull().alias("use")),
        F.struct(F.lit("cell").alias("kind"), down("y", 4).alias("a"), down("x", 4).alias("b"), F.coalesce("out", F.lit(False)).alias("use")),
    )
    each = placed.select("section_id", "gene_id", "umi", F.explode(F.filter(goes, lambda g: g["use"])).alias("g"))
    return each.groupBy("section_id", F.col("g.kind").alias("kind"), F.col("g.a").alias("a"), F.col("g.b").alias("b"), "gene_id").agg(F.sum("umi").alias("umi"))


def in_panel(counts: DataFrame, panel: DataFrame) -> DataFrame:
    """Counts of panel genes with their position; genes outside the panel go."""
    return counts.join(F.broadcast(panel), "gene_id")


def availability(counts: DataFrame, panel: DataFrame) -> DataFrame:
    """(section_id, gene_id, pos, available) of every panel gene. A gene is available if it was measured at all."""
    measured = counts.select("section_id", "gene_id").distinct()
    asked = measured.select("section_id").distinct().crossJoin(F.broadcast(panel))
    return asked.join(measured.withColumn("available", F.lit(True)), ["section_id", "gene_id"], "left").withColumn("available", F.coalesce("available", F.lit(False)))


def masked(counts: DataFrame, parents: DataFrame, available: DataFrame) -> DataFrame:
    """Counts with ``usable``; those of invalid parents or unavailable genes become 0 instead of being dropped."""
    joined = counts.join(parents.select("section_id", "parent_id", "valid"), ["section_id", "parent_id"]).join(available.select("section_id", "gene_id", "available"), ["section_id", "gene_id"], "left")
    ok = F.col("valid") & F.coalesce("available", F.lit(False))
    return joined.select("section_id", "parent_id", "gene_id", F.when(ok, F.col("umi")).otherwise(0).alias("umi"), ok.alias("usable"))


def observed_groups(counts16: DataFrame, observed: DataFrame) -> DataFrame:
    """16 um counts of observed parents summed to 32 um, with the number of observed members of each group."""
    members = observed.withColumn("gy", down("py", 2)).withColumn("gx", down("px", 2))
    size = members.groupBy("section_id", "gy", "gx").agg(F.count("*").alias("members"))
    sums = counts16.join(members, ["section_id", "py", "px"]).groupBy("section_id", "gy", "gx", "gene_id").agg(F.sum("umi").alias("umi"))
    return sums.join(size, ["section_id", "gy", "gx"])


def paired_members(members: DataFrame, least: int = 2) -> DataFrame:
    """Observed 16 um members of 32 um groups that hold ``least`` or more of them, with their number."""
    from pyspark.sql import Window

    group = Window.partitionBy("section_id", down("py", 2), down("px", 2))
    return members.withColumn("members", F.count("*").over(group)).where(F.col("members") >= least)


def merged_parents(owned_counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts after the second parent of each pair (section_id, first, second) was merged into the first."""
    names = pairs.select("section_id", F.col("second").alias("parent_id"), "first")
    out = owned_counts.join(names, ["section_id", "parent_id"], "left").withColumn("parent_id", F.coalesce("first", "parent_id"))
    return out.groupBy("section_id", "parent_id", "gene_id").agg(F.sum("umi").alias("umi"))


def block_layout(counts: DataFrame, blocks: DataFrame, side: int = 256) -> DataFrame:
    """Stored entries of listed blocks: number and running start of each, in (block_y, block_x) order."""
    keyed = counts.withColumn("block_y", down("y", side)).withColumn("block_x", down("x", side))
    size = keyed.groupBy("section_id", "block_y", "block_x").agg(F.count("*").alias("nnz")).join(blocks, ["section_id", "block_y", "block_x"], "right").withColumn("nnz", F.coalesce("nnz", F.lit(0)))
    return running(size, "nnz", ["block_y", "block_x"], ["section_id"]).withColumn("stop", F.col("start") + F.col("nnz"))
