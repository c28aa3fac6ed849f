"""Ownership of pixels by parents: geometry, segments, classes, rules and connectivity.

``owners`` tables are (section_id, y, x, parent_id) with a row per owned pixel; gaps have no row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators.geometry import down

STEPS = ((-1, 0), (1, 0), (0, -1), (0, 1))


def parent_geometry(owners: DataFrame) -> DataFrame:
    """Area, centroid, box, perimeter edges, compactness and fill of every parent.

    A pixel's edge counts if the pixel beyond it belongs to another parent, to none, or lies outside the grid.
    """
    beyond = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in STEPS])).alias("s")
    looks = owners.select("section_id", "parent_id", beyond, "y", "x").select("section_id", "parent_id", (F.col("y") + F.col("s.a")).alias("y"), (F.col("x") + F.col("s.b")).alias("x"))
    other = owners.withColumnRenamed("parent_id", "other")
    edges = looks.join(other, ["section_id", "y", "x"], "left").where("other IS NULL OR other <> parent_id").groupBy("section_id", "parent_id").agg(F.count("*").alias("perimeter"))
    box = owners.groupBy("section_id", "parent_id").agg(
        F.count("*").alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), (F.max("y") - F.min("y") + 1).alias("height"), (F.max("x") - F.min("x") + 1).alias("width")
    )
    out = box.join(edges, ["section_id", "parent_id"])
    return out.withColumn("compactness", 4 * math.pi * F.col("area") / (F.col("perimeter") * F.col("perimeter"))).withColumn("fill", F.col("area") / (F.col("height") * F.col("width")))


def parent_features(geometry: DataFrame, rows: int, columns: int) -> DataFrame:
    """Seven features of each parent of a field: centre from -1 to 1, logs of area, height and width, compactness and fill.

    ``geometry``: what ``parent_geometry`` gives, in pixels of a field of ``rows`` by ``columns``.
    """
    at = lambda c, n: (2 * (F.col(c) + 0.5) - n) / n
    logs = [F.log(c).alias(f"log_{c}") for c in ("area", "height", "width")]
    return geometry.select("section_id", "parent_id", at("cy", rows).alias("at_y"), at("cx", columns).alias("at_x"), *logs, "compactness", "fill")


def relative_positions(pixels: DataFrame, owners: DataFrame, pitch_um: float = 2.0) -> DataFrame:
    """(section_id, y, x, at_y, at_x): where a pixel lies in its parent, -1 to 1 over the parent's box about its centroid; 0 in gaps.

    A side shorter than a pixel counts as one.
    """
    box = parent_geometry(owners).select("section_id", "parent_id", "cy", "cx", "height", "width")
    placed = pixels.join(owners, ["section_id", "y", "x"], "left").join(box, ["section_id", "parent_id"], "left")
    at = lambda v, c, n: F.coalesce(2 * pitch_um * (F.col(v) - F.col(c)) / F.greatest(F.col(n) * pitch_um, F.lit(pitch_um)), F.lit(0.0))
    return placed.select("section_id", "y", "x", at("y", "cy", "height").alias("at_y"), at("x", "cx", "width").alias("at_x"))


def gathered(pixels: DataFrame, owners: DataFrame, values: DataFrame, **default: float) -> DataFrame:
    """Every pixel with the columns of ``values`` (section_id, parent_id, ...) that its parent has.

    Pixels of gaps, and of parents without a row, get the ``default`` of a column, or null where none is named.
    """
    placed = pixels.join(owners, ["section_id", "y", "x"], "left").join(values, ["section_id", "parent_id"], "left")
    return placed.fillna(default) if default else placed


def segments(owners: DataFrame, valid: DataFrame) -> DataFrame:
    """Pixels of each (owner, 8 um cell) intersection; parent_id -1 is the gap. ``valid``: (section_id, y, x)."""
    placed = valid.join(owners, ["section_id", "y", "x"], "left")
    key = [F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), down("y", 4).alias("qy"), down("x", 4).alias("qx")]
    return placed.groupBy("section_id", *key).agg(F.count("*").alias("area_px"), F.avg(F.col("y") - down("y", 4) * 4 - 1.5).alias("off_y"), F.avg(F.col("x") - down("x", 4) * 4 - 1.5).alias("off_x"))


def segment_features(segments: DataFrame, parents: DataFrame) -> DataFrame:
    """Geometry vector of each segment: log area, share of the cell, centroid in the cell, place in the 16 um group, gap flag, share of the parent."""
    joined = segments.join(parents.select("section_id", "parent_id", F.col("area").alias("parent_area")), ["section_id", "parent_id"], "left")
    a = F.col("area_px")
    return joined.select(
        "section_id", "parent_id", "qy", "qx", F.log1p(a.cast("double")).alias("log_area"), (a / 16.0).alias("cell_share"), (F.col("off_y") / 4).alias("at_y"), (F.col("off_x") / 4).alias("at_x"),
        (F.col("qy") % 2).alias("group_y"), (F.col("qx") % 2).alias("group_x"), (F.col("parent_id") < 0).alias("gap"), F.coalesce(a / F.col("parent_area"), F.lit(0.0)).alias("parent_share"),
    )


def cell_classes(owners: DataFrame, valid: DataFrame) -> DataFrame:
    """8 um cells by who owns their valid pixels: invalid (not all 16 valid), gap, single, boundary (one and gap) or multi."""
    placed = valid.join(owners, ["section_id", "y", "x"], "left")
    m = placed.groupBy("section_id", down("y", 4).alias("qy"), down("x", 4).alias("qx")).agg(F.count("*").alias("n"), F.count("parent_id").alias("owned"), F.min("parent_id").alias("low"), F.max("parent_id").alias("high"))
    kind = F.when(F.col("n") < 16, "invalid").when(F.col("owned") == 0, "gap").when(F.col("low") != F.col("high"), "multi").when(F.col("owned") < F.col("n"), "boundary").otherwise("single")
    return m.select("section_id", "qy", "qx", kind.alias("kind"))


def region_classes(segments: DataFrame) -> DataFrame:
    """8 um cells as covered (no gap), gap (only gap) or mixed."""
    m = segments.groupBy("section_id", "qy", "qx").agg(F.bool_and(F.col("parent_id") >= 0).alias("covered"), F.bool_and(F.col("parent_id") < 0).alias("gap"))
    return m.select("section_id", "qy", "qx", F.when(F.col("covered"), "covered").when(F.col("gap"), "gap").otherwise("mixed").alias("region"))


def inside_core(owners: DataFrame, low: int, high: int) -> DataFrame:
    """Parents all of whose pixels lie within low..high-1 on both axes."""
    core = F.col("y").between(low, high - 1) & F.col("x").between(low, high - 1)
    return owners.groupBy("section_id", "parent_id").agg(F.count("*").alias("area"), F.count_if(core).alias("in_core")).where("area = in_core").select("section_id", "parent_id", "area")


def rule_faults(owners: DataFrame, parents: DataFrame, valid: DataFrame) -> DataFrame:
    """Breaches by rule: unknown parents, owned invalid pixels, valid parents without pixels, padded parents with some."""
    known = parents.select("section_id", "parent_id", F.col("valid").alias("real"))
    pixels = owners.join(valid.select("section_id", "y", "x", F.lit(True).alias("ok")), ["section_id", "y", "x"], "left").join(known, ["section_id", "parent_id"], "left")
    by_pixel = pixels.agg(F.count_if(F.col("real").isNull()).alias("unknown_parent"), F.count_if(F.col("ok").isNull()).alias("invalid_pixel"))
    held = known.join(owners.select("section_id", "parent_id").distinct().withColumn("has", F.lit(True)), ["section_id", "parent_id"], "left")
    by_parent = held.agg(F.count_if(F.col("real") & F.col("has").isNull()).alias("empty_parent"), F.count_if(~F.col("real") & F.col("has").isNotNull()).alias("padded_parent"))
    return by_pixel.crossJoin(by_parent)  # one row each


def parts(owners: DataFrame, rounds: int = 60) -> DataFrame:
    """Number of 4-connected parts of every parent.

    Pixels are first joined into horizontal runs, so that labels travel over runs that touch, not over pixels; labels
    spread by their minimum and by pointer jumping until nothing changes, with a checkpoint a round.
    """
    from pyspark.sql import Window

    line = Window.partitionBy("section_id", "parent_id", "y").orderBy("x")
    runs = owners.withColumn("g", F.col("x") - F.row_number().over(line)).groupBy("section_id", "parent_id", "y", "g").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    runs = runs.withColumn("id", F.struct("y", "a")).select("section_id", "parent_id", "id", "y", "a", "b")
    low = runs.select("section_id", "parent_id", (F.col("y") + 1).alias("y"), F.col("id").alias("up"), F.col("a").alias("ua"), F.col("b").alias("ub"))
    touch = runs.join(low, ["section_id", "parent_id", "y"]).where("a <= ub AND ua <= b").select("section_id", "parent_id", "id", "up")
    links = _kept(touch.unionByName(touch.select("section_id", "parent_id", F.col("up").alias("id"), F.col("id").alias("up"))))
    labels = _kept(runs.select("section_id", "parent_id", "id", F.col("id").alias("label")))
    key = ["section_id", "parent_id"]
    for _ in range(rounds):
        near = links.join(labels.select(*key, F.col("id").alias("up"), F.col("label").alias("l")), [*key, "up"]).groupBy(*key, "id").agg(F.min("l").alias("l"))
        step = labels.join(near, [*key, "id"], "left").select(*key, "id", F.col("label").alias("old"), F.least("label", F.coalesce("l", "label")).alias("label"))
        jump = step.select(*key, F.col("id").alias("label"), F.col("label").alias("root"))
        after = _kept(step.join(jump, [*key, "label"]).select(*key, "id", "old", F.least("label", "root").alias("label")))
        moved = after.where("old <> label").limit(1).count()
        labels = after.drop("old")
        if not moved:
            break
    else:
        raise RuntimeError(f"labels still move after {rounds} rounds")
    return labels.groupBy(*key).agg(F.count_distinct("label").alias("parts"))


def _kept(df: DataFrame) -> DataFrame:
    from lamella.session import checkpointed

    return checkpointed(df)
