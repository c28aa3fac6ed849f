"""Checks of what was written: conservation of sections and spots, complete circles, and means over anchors' fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.geometry import circle_pixels, down
from lamella.operators.tasks import dealt


def spot_weights(centers: DataFrame, diameter: float, rows: int, cols: int) -> DataFrame:
    """(spot_id, qy, qx, weight): share of each 8 um cell that a circle covers, in sixteenths."""
    at = circle_pixels(centers, diameter, rows, cols).groupBy("spot_id", down("y", 4).alias("qy"), down("x", 4).alias("qx"))
    return at.agg((F.count("*") / F.lit(16.0)).alias("weight"))


def spot_support(weights: DataFrame, cells: DataFrame) -> DataFrame:
    """Spots by how many of their cells were exported: full, partial or empty, with the covered share of their weight."""
    known = F.col("_known").isNotNull()
    met = weights.join(cells.select("section_id", "qy", "qx", F.lit(True).alias("_known")), ["section_id", "qy", "qx"], "left")
    m = met.groupBy("section_id", "spot_id").agg(F.count("*").alias("cells"), F.count_if(known).alias("exported"), (F.sum(F.when(known, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("share"))
    kind = F.when(F.col("exported") == F.col("cells"), "full").when(F.col("exported") == 0, "empty").otherwise("partial")
    return m.select("section_id", "spot_id", "cells", "exported", "share", kind.alias("support"))


def spot_sums(weights: DataFrame, values: DataFrame) -> DataFrame:
    """Cell values summed into spots by their weights."""
    return values.join(dealt(weights), ["section_id", "qy", "qx"]).groupBy("section_id", "spot_id", "gene_id").agg(F.sum(F.col("mass") * F.col("weight")).alias("p"))


def homogeneous_cells(owners: DataFrame, valid: DataFrame) -> DataFrame:
    """8 um cells whose valid pixels have one owner (a gap counts as one): only for them is re-aggregation exact."""
    placed = valid.join(owners, ["section_id", "y", "x"], "left").withColumn("who", F.coalesce("parent_id", F.lit(-1)))
    return placed.groupBy("section_id", down("y", 4).alias("qy"), down("x", 4).alias("qx")).agg((F.min("who") == F.max("who")).alias("homogeneous"), F.count("*").alias("valid_px"))


def field_grid(segments: DataFrame, cells: DataFrame) -> DataFrame:
    """Parents re-aggregated from an 8 um grid: each cell gives a parent its value by the share of its valid pixels.

    ``segments``: (section_id, parent_id, qy, qx, area_px); ``cells``: (section_id, qy, qx, gene_id, mass).
    """
    share = F.col("area_px") / F.sum("area_px").over(Window.partitionBy("section_id", "qy", "qx"))
    met = segments.withColumn("share", share).where("parent_id >= 0").join(cells, ["section_id", "qy", "qx"])
    return met.groupBy("section_id", "parent_id", "gene_id").agg(F.sum(F.col("mass") * F.col("share")).alias("p"))


def complete_in_core(pixels: DataFrame, core: int = 96) -> DataFrame:
    """Anchors whose whole circle lies in the central core of their field (``ly``, ``lx`` are field-local pixels of 128)."""
    low = (128 - core) // 2
    inside = F.col("ly").between(low, 127 - low) & F.col("lx").between(low, 127 - low)
    return pixels.groupBy("section_id", "spot_id", "y0", "x0").agg(F.count("*").alias("n"), F.count_if(inside).alias("inside")).withColumn("complete", F.col("n") == F.col("inside"))


def anchor_means(fields: DataFrame, value, core_cells: int = 20) -> DataFrame:
    """Mean and number of the fields whose central core covers each 8 um cell. ``value``: column over (qy, qx, y0, x0)."""
    n = F.sequence(F.lit(0).cast("long"), F.lit(core_cells - 1).cast("long"))
    margin = (32 - core_cells) // 2
    at = fields.withColumn("_i", F.explode(n)).withColumn("_j", F.explode(n))
    at = at.withColumn("qy", down("y0", 4) + margin + F.col("_i")).withColumn("qx", down("x0", 4) + margin + F.col("_j"))
    return at.groupBy("section_id", "qy", "qx").agg(F.avg(value).alias("value"), F.count("*").alias("coverage"))


def same_owners(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels whose owners differ between two tables; empty if they are the same."""
    key = ["section_id", "y", "x"]
    both = a.join(b.withColumnRenamed("parent_id", "other"), key, "full")
    return both.where(~F.col("parent_id").eqNullSafe(F.col("other")))


def eligible_fields(fields: DataFrame, parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """Fields with an active 16 um parent in their core (kind hd16), or with two or more neighbour pairs (kind spot55)."""
    active = parents.where("active AND in_core").select("section_id", "field_id").distinct().withColumn("has", F.lit(True))
    n = pairs.groupBy("section_id", "field_id").agg(F.count("*").alias("pairs"))
    out = fields.join(active, ["section_id", "field_id"], "left").join(n, ["section_id", "field_id"], "left")
    return out.where((F.col("kind") == "hd16") & F.col("has") | (F.col("kind") == "spot55") & (F.col("pairs") >= 2)).drop("has", "pairs")
