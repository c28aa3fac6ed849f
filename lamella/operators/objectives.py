"""Objectives over allocated counts that compose other operators: coarse self-supervision, area divergence, weights, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.operators import allocate, counts, metrics
from lamella.operators.geometry import down


def loss(p: Column, y: Column) -> Column:
    """Poisson loss of one prediction: p - y ln max(p, 1e-12)."""
    return p - y * F.log(F.greatest(p, F.lit(1e-12)))


def coarse_nll(cells: DataFrame, observed: DataFrame, *keys: str) -> DataFrame:
    """Loss per count of 8 um cells summed to 16 um, over observed parents of 32 um groups that hold two or more of them.

    ``cells``: (section_id, qy, qx, gene_id, p); ``observed``: (section_id, py, px, gene_id, umi), zeros as rows or absent.
    """
    sums = cells.groupBy("section_id", down("qy", 2).alias("py"), down("qx", 2).alias("px"), "gene_id").agg(F.sum("p").alias("p"))
    members = counts.paired_members(observed.select("section_id", "py", "px").distinct()).select("section_id", "py", "px")
    at = ["section_id", "py", "px"]
    pairs = sums.join(members, at, "left_semi").join(observed, [*at, "gene_id"], "left").withColumn("y", F.coalesce("umi", F.lit(0)))
    return metrics.poisson_nll(pairs, *keys)


def area_divergence(mass: DataFrame, segments: DataFrame, counts_: DataFrame, inside: DataFrame, *keys: str) -> DataFrame:
    """Sum of C u ln(u / share) over the segments of parents that lie wholly inside the core.

    u is a segment's share of its parent's area, share its share of the parent's count C; parents without counts add 0.
    """
    at = ["section_id", "parent_id"]
    u = segments.where("parent_id >= 0").join(inside.select(*at, "area"), at).select(*at, "qy", "qx", (F.col("area_px") / F.col("area")).alias("u"))
    met = u.join(mass.where("parent_id >= 0"), [*at, "qy", "qx"]).join(counts_.where("umi > 0"), [*at, "gene_id"])
    term = F.col("umi") * F.col("u") * (F.log("u") - F.log(F.greatest(F.col("mass") / F.col("umi"), F.lit(2.0**-1022))))
    return met.groupBy(*keys).agg(F.greatest(F.sum(term), F.lit(0.0)).alias("divergence"), F.count("*").alias("terms"))


def field_weights(fields: DataFrame, floor: float) -> DataFrame:
    """``fields`` (.., umi) with a weight that grows with the counts up to ``floor`` of them: min(umi / floor, 1)."""
    weight = F.lit(1.0) if floor == 0 else F.col("umi") / F.greatest(F.col("umi").cast("double"), F.lit(float(floor)))
    return fields.withColumn("weight", weight)


def weighted_objective(fields: DataFrame, coefficient: float) -> DataFrame:
    """One row: weighted loss, weighted penalty, their sum, mean weight and share of fields below 1, from (nll, penalty, weight)."""
    data, penalty = F.col("weight") * F.col("nll"), F.col("weight") * F.col("penalty")
    return fields.agg(F.avg(data).alias("data"), F.avg(penalty).alias("penalty"), F.avg(data + coefficient * penalty).alias("total"), F.avg("weight").alias("mean_weight"), F.avg((F.col("weight") < 1).cast("double")).alias("downweighted"))


def pair_nll(restored: DataFrame, counts_: DataFrame, pairs: DataFrame, *keys: str) -> DataFrame:
    """Loss per count of the two parents of each chosen pair (section_id, first, second), after a merged allocation."""
    chosen = pairs.select("section_id", F.explode(F.array("first", "second")).alias("parent_id")).distinct()
    both = restored.withColumnRenamed("mass", "p").join(counts_.withColumnRenamed("umi", "y"), ["section_id", "parent_id", "gene_id"], "full")
    both = both.join(chosen, ["section_id", "parent_id"], "left_semi").fillna(0, ["p", "y"])
    return metrics.poisson_nll(both, *keys)


def merged_pair_nll(weights: DataFrame, counts_: DataFrame, pairs: DataFrame, *keys: str) -> DataFrame:
    """Loss of chosen pairs of parents (section_id, first, second) whose counts were merged, allocated together and restored.

    ``weights``: (section_id, parent_id, qy, qx, gene_id, weight) of segments. A merged segment that lies in both parents
    fails, as its mass belongs to neither alone.
    """
    chosen = pairs.select("section_id", F.explode(F.array(F.struct(F.col("first").alias("parent_id"), "first"), F.struct(F.col("second").alias("parent_id"), "first"))).alias("c")).select("section_id", "c.parent_id", F.col("c.first").alias("merged"))
    both = weights.join(chosen, ["section_id", "parent_id"])
    known = counts_.join(chosen, ["section_id", "parent_id"], "left_semi")
    merged = counts.merged_parents(known, pairs)
    segment = ["section_id", "qy", "qx", "part"]
    original = both.select("section_id", "qy", "qx", F.col("merged").alias("part"), "parent_id").distinct()
    summed = both.groupBy("section_id", F.col("merged").alias("parent_id"), "qy", "qx", "gene_id").agg(F.sum("weight").alias("weight"))
    mass = allocate.allocate(summed, merged).withColumnRenamed("parent_id", "part").select(*segment, "gene_id", "mass")
    return pair_nll(allocate.restored(mass, original), known, pairs, *keys)


def gain_over_baseline(pairs: DataFrame, *keys: str) -> DataFrame:
    """Loss per count of a baseline b less that of a prediction p."""
    p, b, y = (F.col(v).cast("double") for v in "pby")
    m = pairs.groupBy(*keys).agg(F.sum(loss(b, y) - loss(p, y)).alias("gain"), F.sum(y).alias("umi"))
    return m.select(*keys, (F.col("gain") / F.greatest("umi", F.lit(1.0))).alias("gain"))
