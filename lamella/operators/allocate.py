"""Conserving allocation of parent counts to segments, and what is summed from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARENT = ("section_id", "parent_id", "gene_id")


def allocate(weights: DataFrame, counts: DataFrame, parent: tuple[str, ...] = PARENT) -> DataFrame:
    """Mass of every (segment, gene): a covered parent's count in proportion to its weights; a gap's weight as it is.

    ``weights``: (section_id, parent_id, qy, qx, gene_id, weight, ..), parent_id -1 for gaps; other columns are kept.
    ``counts``: (section_id, parent_id, gene_id, umi). ``parent``: what names a parent, where one of ``counts`` is
    allocated several times, as in overlapping fields. A positive count whose parent has no weight fails; mass over a
    parent adds up to its count.
    """
    # Gaps have no total: they stay where they are, so that a section's gaps never meet under one key. The window is bounded
    # by a parent's segments and needs no other exchange than the join.
    kept = [c for c in weights.columns if c != "weight"]
    keys = [c for c in parent if c in counts.columns]
    joined = weights.where("parent_id >= 0").join(counts.select(*keys, "umi"), keys, "left").withColumn("total", F.sum("weight").over(Window.partitionBy(*parent)))
    share = F.when(F.col("total") > 0, F.col("weight") * F.col("umi") / F.col("total")).otherwise(F.raise_error(F.lit("a count has no support")).cast("double"))
    mass = F.when(F.coalesce("umi", F.lit(0)) > 0, share).otherwise(0.0)
    gaps = weights.where("parent_id < 0").select(*kept, F.col("weight").alias("mass"))
    return joined.select(*kept, mass.alias("mass")).unionByName(gaps)


def softmax_weights(logits: DataFrame) -> DataFrame:
    """Weights area * exp(logit), shifted by the largest of the parent, from (.., area_px, logit)."""
    z = F.col("logit") + F.log(F.col("area_px").cast("double"))
    top = F.max(z).over(Window.partitionBy(*PARENT))
    return logits.withColumn("weight", F.exp(z - top)).drop("logit")


def residuals(mass: DataFrame, counts: DataFrame) -> DataFrame:
    """Allocated minus observed of every parent and gene, plain and scaled by 1 + |count|."""
    sums = mass.where("parent_id >= 0").groupBy(*PARENT).agg(F.sum("mass").alias("mass"))
    both = counts.join(sums, list(PARENT), "full").select(*PARENT, F.coalesce("mass", F.lit(0.0)).alias("mass"), F.coalesce("umi", F.lit(0)).alias("umi"))
    d = F.col("mass") - F.col("umi")
    return both.withColumn("residual", d).withColumn("scaled", F.abs(d) / (1 + F.abs("umi")))


def to_cells(mass: DataFrame) -> DataFrame:
    """Segments summed to 8 um cells."""
    return mass.groupBy("section_id", "qy", "qx", "gene_id").agg(F.sum("mass").alias("mass"))


def to_pixels(mass: DataFrame, segments: DataFrame, pixels: DataFrame) -> DataFrame:
    """Segment mass spread evenly over the segment's pixels (section_id, parent_id, qy, qx, y, x)."""
    key = ["section_id", "parent_id", "qy", "qx"]
    each = mass.join(segments.select(*key, "area_px"), key).join(pixels, key)
    return each.select("section_id", "y", "x", "gene_id", (F.col("mass") / F.col("area_px")).alias("mass"))


def area_baseline(segments: DataFrame, counts: DataFrame) -> DataFrame:
    """Mass by area alone: a parent's density in its segments; in gaps the density over all parents."""
    area = segments.where("parent_id >= 0").groupBy("section_id", "parent_id").agg(F.sum("area_px").alias("area"))
    total_area = area.groupBy("section_id").agg(F.sum("area").alias("all_area"))
    totals = counts.groupBy("section_id", "gene_id").agg(F.sum("umi").alias("all_umi")).join(total_area, "section_id")
    covered = segments.join(area, ["section_id", "parent_id"]).join(counts, ["section_id", "parent_id"])
    covered = covered.select("section_id", "parent_id", "qy", "qx", "gene_id", (F.col("umi") / F.col("area") * F.col("area_px")).alias("mass"))
    gaps = segments.where("parent_id < 0").join(totals.select("section_id", "gene_id", (F.col("all_umi") / F.col("all_area")).alias("density")), "section_id")
    return covered.unionByName(gaps.select("section_id", "parent_id", "qy", "qx", "gene_id", (F.col("density") * F.col("area_px")).alias("mass")))


def weighted_gaps(neighbours: DataFrame, values: DataFrame, power: float = 2.0, epsilon: float = 1.0) -> DataFrame:
    """Inverse-distance mean of parent values at each query, and the plain mean, from a neighbour table.

    ``neighbours``: (section_id, qy, qx, parent_id, d2); ``values``: (section_id, parent_id, gene_id, value).
    """
    w = F.pow(F.greatest("d2", F.lit(epsilon**2)), F.lit(-power / 2))
    joined = neighbours.withColumn("w", w).join(values, ["section_id", "parent_id"])
    return joined.groupBy("section_id", "qy", "qx", "gene_id").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("idw"), F.avg("value").alias("mean"))


def gap_density(neighbours: DataFrame, values: DataFrame, queries: DataFrame, overall: DataFrame, power: float = 2.0, epsilon: float = 1.0) -> DataFrame:
    """Interpolated density at every query and gene, and the section's overall density where no neighbour supports one.

    ``queries``: (section_id, qy, qx); ``overall``: (section_id, gene_id, density).
    """
    near = weighted_gaps(neighbours, values, power, epsilon).select("section_id", "qy", "qx", "gene_id", "idw")
    asked = queries.join(overall, "section_id")
    out = asked.join(near, ["section_id", "qy", "qx", "gene_id"], "left")
    return out.select("section_id", "qy", "qx", "gene_id", F.coalesce("idw", "density").alias("density"), F.col("idw").isNotNull().alias("supported"))


def prior_mass(density: Column, residual: Column, usable: Column, bound: float = 2.0, least: float = 1e-10) -> Column:
    """A density of ``least`` or more times exp of a residual bounded by ``bound`` * tanh; 0 where it is not usable."""
    return F.when(usable, F.greatest(density, F.lit(least)) * F.exp(bound * F.tanh(residual / bound))).otherwise(0.0)


def pooled_segments(pixels: DataFrame, value: str) -> DataFrame:
    """Sum, mean, deviation and largest pixel value of every segment (section_id, parent_id, qy, qx)."""
    v = F.col(value).cast("double")
    m = pixels.groupBy("section_id", "parent_id", "qy", "qx").agg(F.sum(v).alias("total"), F.avg(v).alias("mean"), F.avg(v * v).alias("square"), F.max(v).alias("top"))
    spread = F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)) + 1e-6)
    return m.withColumn("deviation", spread).drop("square")


def restored(mass: DataFrame, original: DataFrame) -> DataFrame:
    """Mass of the parents before a merge. Every segment must lie in one of them; ``original``: segment to parent."""
    key = ["section_id", "qy", "qx", "part"]
    one = original.groupBy(*key).agg(F.min("parent_id").alias("parent_id"), F.max("parent_id").alias("top"))
    one = one.withColumn("parent_id", F.when(F.col("parent_id") == F.col("top"), F.col("parent_id")).otherwise(F.raise_error(F.lit("a segment lies in several parents")).cast("long"))).drop("top")
    return mass.join(one, key).groupBy("section_id", "parent_id", "gene_id").agg(F.sum("mass").alias("mass"))


def scored_weights(segments: DataFrame, score: Callable, columns: list[str]) -> DataFrame:
    """Hook for a user's model: ``score(pandas frame of one field) -> log residual per row``; weight is prior * exp(it).

    The field's segments come as one frame with ``columns``; conservation is left to ``allocate``.
    """
    schema = segments.select(*columns).schema.add("weight", "double")

    def run(frame):
        import numpy as np

        frame = frame[columns]
        return frame.assign(weight=frame["prior"] * np.exp(score(frame)))

    return segments.groupBy("section_id", "field_id").applyInPandas(run, schema)
