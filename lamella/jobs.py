"""Workflows: benchmark preparation, user training sets, prediction by fields, gap filling and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.operators import allocate, anchors, checks, counts, geometry, image, metrics, ranks, sampling
from lamella.operators.tasks import dealt
from lamella.sources import tables


def prepare_squares(native: DataFrame, flagged: DataFrame, transform: list[list[float]], capture: tuple[int, int], picture: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(observed, truth): 16 um counts of tissue parents inside capture and image, and their measured 8 um counts.

    ``flagged``: (section_id, py, px) of parents in tissue; repeated or incomplete ones fail. The truth carries its role and
    never leads to a model input.
    """
    whole = tables.tissue_parents(flagged.withColumn("flag", F.lit(True)), *capture)
    parents = image.full_support(whole, transform, *picture, size_um=16.0, y="py", x="px")
    fine = counts.squares(native, 4).withColumn("py", geometry.down("qy", 2)).withColumn("px", geometry.down("qx", 2)).join(parents, ["section_id", "py", "px"], "left_semi")
    observed = fine.groupBy("section_id", "py", "px", "gene_id").agg(F.sum("umi").alias("umi"))
    return observed, fine.select("section_id", "qy", "qx", "gene_id", "umi", F.lit("evaluation_only_measured_8um").alias("role"))


def prepare_circles(native: DataFrame, flagged: DataFrame, origins: DataFrame, origin_y: Column, origin_x: Column, transform: list[list[float]], capture: tuple[int, int], picture: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(observed, truth) of pseudo-spots: 55 um circles on a hexagonal lattice whose centre lies in tissue and whose 56 um
    square lies inside the image; the truth is what was measured in the 8 um cells wholly inside them."""
    at = geometry.lattice(origins.select("section_id", origin_y.alias("oy"), origin_x.alias("ox")), *capture, F.col("oy"), F.col("ox"))
    at = at.withColumn("py", F.floor(F.col("cy") / 16.0).cast("long")).withColumn("px", F.floor(F.col("cx") / 16.0).cast("long")).join(flagged.distinct(), ["section_id", "py", "px"], "left_semi")
    at = image.full_support(at.withColumn("sy", F.col("cy") / 56.0 - 0.5).withColumn("sx", F.col("cx") / 56.0 - 0.5), transform, *picture, size_um=56.0, y="sy", x="sx")
    at = at.select("section_id", "array_row", "array_col", "cy", "cx")
    key = ["section_id", "array_row", "array_col"]
    observed = native.join(geometry.circle_pixels(at, 55.0, *capture).select(*key, "y", "x"), ["section_id", "y", "x"]).groupBy(*key, "gene_id").agg(F.sum("umi").alias("umi"))
    inside = geometry.interior_cells(at, 55.0).select(*key, "qy", "qx")
    truth = counts.squares(native, 4).join(inside, ["section_id", "qy", "qx"])
    return observed, truth.withColumn("role", F.lit("evaluation_only_measured_8um"))


def supported_owners(owners: DataFrame, valid: DataFrame) -> DataFrame:
    """Owners of parents all of whose pixels are valid, numbered from 0 in each section (``slot``); others own nothing."""
    return owners.join(dealt(supported_parents(owners, valid)), ["section_id", "parent_id"])


def supported_parents(owners: DataFrame, valid: DataFrame) -> DataFrame:
    """(section_id, parent_id, slot): parents all of whose pixels are valid, numbered from 0 in each section.

    Pixels of a square of 8 x 8 are the bits of one number, on both sides: squares meet, pixels are never dealt out.
    """
    own = _bits(owners, "section_id", "parent_id")
    met = own.join(dealt(_bits(valid, "section_id").withColumnRenamed("_bits", "_valid")), ["section_id", "_ty", "_tx"], "left")
    # A pixel without a place is no bit, and none of its square is valid.
    fine = F.coalesce(F.col("_bits").bitwiseAND(F.bitwise_not("_valid")) == 0, F.lit(False))
    kept = met.groupBy("section_id", "parent_id").agg(F.bool_and(fine).alias("whole")).where("whole").drop("whole")
    return ranks.ranked(kept, ["parent_id"], ["section_id"], "slot")


def _bits(pixels: DataFrame, *key: str) -> DataFrame:
    """(.. key, _ty, _tx, _bits): pixels (y, x) by square of 8 x 8; repeated ones count once."""
    bit = F.expr("bit_or(shiftleft(1L, CAST(pmod(y, 8) * 8 + pmod(x, 8) AS INT)))")
    return pixels.groupBy(*key, geometry.down("y", 8).alias("_ty"), geometry.down("x", 8).alias("_tx")).agg(bit.alias("_bits"))


def predict(weights: DataFrame, observed: DataFrame, cover: DataFrame) -> DataFrame:
    """8 um prediction (section_id, qy, qx, gene_id, value): every field allocates its parents, overlapping fields are averaged.

    ``weights``: (section_id, field_id, parent_id, qy, qx, gene_id, weight) with parents numbered apart in every field;
    ``observed``: (section_id, parent_id, gene_id, umi); ``cover``: (section_id, qy, qx, field_id, weight), weights of a
    cell adding up to 1.
    """
    mass = allocate.allocate(weights, observed)
    share = cover.withColumnRenamed("weight", "share")
    met = mass.join(share, ["section_id", "qy", "qx", "field_id"]).groupBy("section_id", "qy", "qx", "gene_id").agg(F.sum(F.col("mass") * F.col("share")).alias("value"), F.sum("share").alias("shares"))
    value = checks.guarded(F.col("value"), F.abs(F.col("shares") - 1) < 1e-9, "weights of a cell do not add up to 1", "double")
    return met.select("section_id", "qy", "qx", "gene_id", value.alias("value"))


def filled(direct: DataFrame, sources: DataFrame) -> DataFrame:
    """Direct cell values (source 1), and values from ``sources`` (section_id, qy, qx, sy, sx, weight) where they are missing (source 2)."""
    from_ = direct.select("section_id", F.col("qy").alias("sy"), F.col("qx").alias("sx"), "gene_id", "value")
    made = sources.join(from_, ["section_id", "sy", "sx"]).groupBy("section_id", "qy", "qx", "gene_id").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
    return direct.select("section_id", "qy", "qx", "gene_id", "value", F.lit(1).alias("source")).unionByName(made.withColumn("source", F.lit(2)))


def source_labels(tissue: DataFrame, direct: DataFrame, sources: DataFrame) -> DataFrame:
    """Every tissue cell with its source: 1 has a direct value, 2 takes it from ``sources``, 0 has neither."""
    at = ["section_id", "qy", "qx"]
    made = sources.select(*at, F.lit(2).alias("source"))
    marks = direct.select(*at, F.lit(1).alias("source")).unionByName(made).groupBy(*at).agg(F.min("source").alias("source"))
    return tissue.select(*at).join(marks, at, "left").select(*at, F.coalesce("source", F.lit(0)).alias("source"))


def user_fields(blocks: DataFrame, side: int = 256, fov: int = 128) -> DataFrame:
    """Four fields of each listed block (section_id, by, bx, monitor), held out where they overlap a monitor block."""
    step = F.explode(F.array(F.lit(0), F.lit(fov)))
    fields = blocks.select("section_id", "by", "bx", step.alias("dy")).select("*", step.alias("dx")).select("section_id", (F.col("by") + F.col("dy")).cast("long").alias("y0"), (F.col("bx") + F.col("dx")).cast("long").alias("x0"))
    train = sampling.outside_blocks(fields, blocks.where("monitor"), side, fov).withColumn("role", F.lit("train"))
    return fields.join(train, ["section_id", "y0", "x0"], "left").withColumn("role", F.coalesce("role", F.lit("monitor")))


def eligible_squares(observed: DataFrame, core: int = 10, margin: int = 3, least: int = 2) -> DataFrame:
    """Fields (section_id, y0, x0) with something to learn from: an observed 16 um parent (py, px) of their core whose
    32 um group, counted from the field's corner, has ``least`` or more observed members.

    Fields stand ``core`` parents apart and reach ``margin`` beyond their core, so that a parent may lie in several.
    """
    side = core + 2 * margin
    out = observed.select("section_id", "py", "px").distinct()
    for p, k, at in (("py", "ky", "ly"), ("px", "kx", "lx")):
        steps = F.sequence(F.floor((F.col(p) + margin - side) / core).cast("long") + 1, F.floor((F.col(p) + margin) / core).cast("long"))
        out = out.withColumn(k, F.explode(steps)).withColumn(at, F.col(p) - F.col(k) * core + margin)
    inside = F.col("ly").between(margin, margin + core - 1) & F.col("lx").between(margin, margin + core - 1)
    groups = out.groupBy("section_id", "ky", "kx", geometry.down("ly", 2).alias("gy"), geometry.down("lx", 2).alias("gx")).agg(F.count("*").alias("n"), F.bool_or(inside).alias("inside"))
    start = lambda k: ((F.col(k) * core - margin) * 8).cast("long")
    return groups.where((F.col("n") >= least) & F.col("inside")).select("section_id", start("ky").alias("y0"), start("kx").alias("x0")).distinct()


def fine_tuning_fields(eligible: DataFrame, boundary: int, least: int = 64, fov: int = 128) -> DataFrame:
    """Fields by side of ``boundary``; fails where a section has fewer than ``least`` on the left or none on the right."""
    split = sampling.sides(eligible, boundary, fov)
    each = eligible.select("section_id").distinct().join(dealt(split.groupBy("section_id").agg(F.count_if(F.col("side") == "support").alias("_a"), F.count_if(F.col("side") == "selection").alias("_b"))), "section_id", "left")
    enough = (F.coalesce("_a", F.lit(0)) >= least) & (F.coalesce("_b", F.lit(0)) > 0)
    held = each.select("section_id", checks.guarded(F.lit(True), enough, "a side of the boundary holds too few fields", "boolean").alias("_ok"))
    return held.join(dealt(split), "section_id", "left").where("_ok AND side IS NOT NULL").select("section_id", "y0", "x0", "side")


def evaluation_pairs(prediction: DataFrame, reference: DataFrame, genes: DataFrame) -> DataFrame:
    """(section_id, qy, qx, gene_id, p, y): every measured position and available gene; a position without prediction fails."""
    at = ["section_id", "qy", "qx"]
    known = prediction.select(*at).distinct().withColumn("_ok", F.lit(True))
    asked = reference.select(*at).distinct().join(known, at, "left")
    asked = asked.withColumn("qy", checks.guarded(F.col("qy"), F.col("_ok").isNotNull(), "a measured position was not predicted", "long")).drop("_ok")
    each = asked.join(F.broadcast(genes.select("section_id", "gene_id")), "section_id")  # a panel is a bounded list of genes
    both = each.join(prediction, [*at, "gene_id"], "left").join(reference, [*at, "gene_id"], "left")
    return both.select(*at, "gene_id", F.coalesce("value", F.lit(0.0)).alias("p"), F.coalesce("umi", F.lit(0)).cast("double").alias("y"))


def evaluate(prediction: DataFrame, reference: DataFrame, genes: DataFrame, common: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(by gene, summary): scores of a prediction against what was measured.

    ``genes``: (section_id, gene_id, predicted, measured): genes available on both sides are scored, and a gene available
    on one only fails. ``common``: positions that position-wise scores are limited to. Means go over defined scores.
    """
    same = F.col("predicted") == F.col("measured")
    genes = genes.withColumn("gene_id", checks.guarded(F.col("gene_id"), same, "gene availability differs", "long")).where("measured")
    pairs = evaluation_pairs(prediction, reference, genes)
    by_gene = metrics.gene_scores(pairs.groupBy("section_id", "gene_id").agg(*metrics.moments()), "section_id", "gene_id")
    at = ["section_id", "qy", "qx"]
    by_position = metrics.position_scores(pairs, *at)
    if common is not None:
        by_position = by_position.join(common.select(*at).distinct(), at, "left_semi")
    g = by_gene.groupBy("section_id").agg(F.count("*").alias("genes"), F.count("pcc").alias("defined_genes"), F.avg("pcc").alias("gene_pcc"), F.avg("nrmse").alias("gene_nrmse"))
    p = by_position.groupBy("section_id").agg(F.count("pcc").alias("pcc_positions"), F.avg("pcc").alias("position_pcc"), F.count("*").alias("positions"), F.avg("bray_curtis").alias("bray_curtis"))
    return by_gene, g.join(p, "section_id", "left")


def prepare_anchors(centers: DataFrame, capture: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(fields, queries) of anchored sections from the centres (section_id, spot_id, cy, cx in um) of 100 um circles.

    Nine fields lie around each centre; one outside the capture fails. Queries are the 8 um cells that any field's core
    holds, with the number of such cores and the circle that claims each.
    """
    fields = anchors.anchored_fields(centers, *capture)
    return fields, anchors.query_cells(centers, fields, *capture)


def predict_anchors(centers: DataFrame, observed: DataFrame, prior: Column, capture: tuple[int, int]) -> DataFrame:
    """(section_id, qy, qx, gene_id, value, coverage) of anchored sections: means over the cores of all fields.

    ``observed``: (section_id, spot_id, gene_id, umi). A cell that lacks a contribution of a core that holds it fails.
    """
    fields = anchors.anchored_fields(centers, *capture)
    return anchors.stitched(anchors.field_values(fields, observed, prior, *capture), anchors.coverage(fields), fields.count())


def anchor_conservation(fields: DataFrame, observed: DataFrame, prior: Column, capture: tuple[int, int]) -> DataFrame:
    """By section: circles allocated in single fields, and the largest scaled error of what a field gives back of its anchor."""
    sums = anchors.field_sums(fields, observed, prior, *capture)
    return metrics.error_report(sums, "section_id").select("section_id", "n", "max_scaled")
