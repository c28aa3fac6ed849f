"""Workflows around training sets: batches of an epoch, subsets with new numbers, and scores of all diagnostics in one pass."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators import checks, metrics, sampling
from lamella.operators.geometry import down
from lamella.operators.ranks import ranked
from lamella.operators.tasks import spread


def batches(items: DataFrame, seed: int, epoch: int, size: int, key: list[str]) -> DataFrame:
    """Items of an epoch in a global seeded order, with batch and slot from 0; only the last batch may be short."""
    placed = sampling.epoch_order(items, seed, epoch, key)
    return placed.withColumn("batch", F.floor(F.col("place") / size)).withColumn("slot", F.col("place") % size).drop("place")


def batch_counts(counts: DataFrame, items: DataFrame, available: DataFrame, output: DataFrame, stride: int = 64, fov: int = 128) -> DataFrame:
    """Counts of every batch: (batch, slot, section_id, field_id, kind, a, b, gene_id, umi), parents and 8 um cells in one pass.

    ``items``: (batch, slot, section_id, field_id, y0, x0); ``available``: (section_id, gene_id) that inputs may hold;
    ``output``: (gene_id) of the cells. kind "parent": a is the 16 um parent's slot in its field (b is 0), over all available
    genes; kind "cell": (a, b) is the field's 8 um cell, of output genes alone. A pixel may feed several fields.

    Counts meet fields under the origins that they may belong to, so that a crowded block spreads over its fields. One
    exchange then brings a batch, and nothing but it, to one task, where it is summed; its size is bounded by the fields of a
    batch.
    """
    kept = counts.join(available.select("section_id", "gene_id"), ["section_id", "gene_id"])
    met = sampling.crops(kept, items, fov, stride)
    wanted = met.join(F.broadcast(output.select("gene_id", F.lit(True).alias("_out"))), "gene_id", "left")  # a panel is a bounded list of genes
    side = fov // 8
    goes = F.array(
        F.struct(F.lit("parent").alias("kind"), (down("ly", 8) * side + down("lx", 8)).alias("a"), F.lit(0).cast("long").alias("b"), F.lit(True).alias("use")),
        F.struct(F.lit("cell").alias("kind"), down("ly", 4).alias("a"), down("lx", 4).alias("b"), F.coalesce("_out", F.lit(False)).alias("use")),
    )
    each = spread(wanted, items.count(), 2000, "batch").select("batch", "slot", "section_id", "field_id", "gene_id", "umi", F.explode(F.filter(goes, lambda g: g["use"])).alias("g"))
    return each.groupBy("batch", "slot", "section_id", "field_id", F.col("g.kind").alias("kind"), F.col("g.a").alias("a"), F.col("g.b").alias("b"), "gene_id").agg(F.sum("umi").alias("umi"))


class Subset(NamedTuple):
    """Tables of a subset under new numbers from 0 in each section; ``source`` columns hold the old ones."""

    fields: DataFrame
    blocks: DataFrame
    training: DataFrame
    monitors: DataFrame


def subset(fields: DataFrame, blocks: DataFrame, training: DataFrame, monitors: DataFrame) -> Subset:
    """Cuts a training set down to chosen fields and renumbers fields and blocks without gaps, in their old order.

    ``fields``: (section_id, field_id, block_slot, y0, x0); ``blocks``: (section_id, block_slot, by, bx); ``training`` and
    ``monitors``: (section_id, field_id). Blocks that no chosen field uses go. A chosen field that does not exist, a field
    whose block does not exist or does not hold it, and a field that is both trained on and monitored fail.
    """
    at = ["section_id", "field_id"]
    roles = training.select(*at, F.lit(1).alias("_train")).unionByName(monitors.select(*at, F.lit(0).alias("_train")))
    chosen = roles.groupBy(*at).agg(F.min("_train").alias("_low"), F.max("_train").alias("_train"))
    met = chosen.join(fields, at, "left").join(blocks, ["section_id", "block_slot"], "left")
    inside = (F.col("y0") >= F.col("by")) & (F.col("y0") + 128 <= F.col("by") + 256) & (F.col("x0") >= F.col("bx")) & (F.col("x0") + 128 <= F.col("bx") + 256)
    one = checks.guarded(F.col("field_id"), F.col("_low") == F.col("_train"), "a field is trained on and monitored", "long")
    met = met.withColumn("field_id", checks.guarded(one, F.coalesce(inside, F.lit(False)), "a chosen field or its block does not exist", "long"))
    used = met.select("section_id", "block_slot", "by", "bx").distinct()
    new_blocks = ranked(used.withColumnRenamed("block_slot", "source"), ["source"], ["section_id"], "block_slot")
    new_fields = ranked(met.select(*at, "block_slot", "y0", "x0", "_train").withColumnRenamed("field_id", "source").withColumnRenamed("block_slot", "_old"), ["source"], ["section_id"], "field_id")
    linked = new_fields.join(new_blocks.select("section_id", F.col("source").alias("_old"), "block_slot"), ["section_id", "_old"])
    out = linked.select("section_id", "field_id", "source", "block_slot", "y0", "x0", "_train")
    return Subset(out.drop("_train"), new_blocks, out.where("_train = 1").select("section_id", "field_id", "source"), out.where("_train = 0").select("section_id", "field_id", "source"))


def field_scores(pairs: DataFrame) -> DataFrame:
    """All diagnostics of every field from one pass over its pairs: (section_id, field_id, kind, level, ..).

    ``pairs``: (section_id, field_id, qy, qx, gene_id, p, b, y, c, region, gene_group), a row for each 8 um cell and gene: a
    prediction p, a baseline b, what was measured y, and the parent's count c. kind "all" has one level, null; "region",
    "stratum" (of c) and "gene_group" have theirs. nll and base_nll are per count of the level, share and base_share per count
    of the field, gain is what p saves; pcc and rms_ratio are of residuals against c / 4. Sums that merge are made for all
    grouping sets at once: pairs are read once, summed before the one exchange and never joined.
    """
    p, b, y, c = (F.col(v).cast("double") for v in "pbyc")
    loss = lambda v: v - y * F.log(F.greatest(v, F.lit(1e-12)))
    each = pairs.select("section_id", "field_id", "region", metrics.stratum(c).alias("stratum"), "gene_group", loss(p).alias("_loss"), loss(b).alias("_base"), y.alias("_umi"), (p - c / 4).alias("p"), (y - c / 4).alias("y"))
    field = [F.col("section_id"), F.col("field_id")]
    kinds = ("region", "stratum", "gene_group")
    sets = [field, *[[*field, F.col(k)] for k in kinds]]
    sums = each.groupingSets(sets, *field, *[F.col(k) for k in kinds]).agg(
        *[F.grouping(k).alias(f"_g_{k}") for k in kinds], F.sum("_loss").alias("loss"), F.sum("_base").alias("base"), F.sum("_umi").alias("umi"), *metrics.energies()
    )
    kind, level = F.lit("all"), F.lit(None).cast("string")
    for k in kinds:
        kind, level = F.when(F.col(f"_g_{k}") == 0, k).otherwise(kind), F.when(F.col(f"_g_{k}") == 0, F.col(k).cast("string")).otherwise(level)
    least = F.lit(1.0)
    whole = F.greatest(F.sum(F.when(F.col("kind") == "all", F.col("umi"))).over(Window.partitionBy("section_id", "field_id")), least)
    own = F.greatest(F.col("umi"), least)
    out = sums.withColumn("kind", kind).withColumn("level", level)
    return out.select(
        "section_id", "field_id", "kind", "level", "n", "umi", (F.col("loss") / own).alias("nll"), (F.col("base") / own).alias("base_nll"), ((F.col("base") - F.col("loss")) / own).alias("gain"),
        (F.col("loss") / whole).alias("share"), (F.col("base") / whole).alias("base_share"), F.when(F.col("n") >= 2, metrics.correlation(1e-20)).alias("pcc"), metrics.rms_ratio(1e-20).alias("rms_ratio"),
    )


def section_scores(scores: DataFrame, sections: DataFrame) -> DataFrame:
    """Means of fields by section and of sections by protocol, with the defined ones counted: (protocol_id, section_id, kind, level, ..).

    ``scores``: what ``field_scores`` gives; ``sections``: (section_id, protocol_id). section_id is null for a protocol's mean.
    """
    values = ("nll", "base_nll", "gain", "share", "pcc", "rms_ratio")
    each = scores.groupBy("section_id", "kind", "level").agg(F.count("*").alias("fields"), F.avg("umi").alias("umi"), *[F.avg(v).alias(v) for v in values], F.count("pcc").alias("defined_fields"))
    named = each.join(sections, "section_id")
    # A section's mean over its own row is that row: both levels come from one pass.
    both = [["protocol_id", "kind", "level", "section_id"], ["protocol_id", "kind", "level"]]
    over = named.groupingSets(both, "protocol_id", "kind", "level", "section_id").agg(F.sum("fields").alias("fields"), F.avg("umi").alias("umi"), *[F.avg(v).alias(v) for v in values], F.sum("defined_fields").alias("defined_fields"))
    return over.select("protocol_id", "section_id", "kind", "level", "fields", "umi", *values, "defined_fields")


class UserSet(NamedTuple):
    """A user's training set: ``fields`` (section_id, y0, x0, role) and ``budgets`` (section_id, protocol_id, retained, budget)."""

    fields: DataFrame
    budgets: DataFrame


def user_set(manifest: DataFrame, blocks: DataFrame, reserved: DataFrame, rows: int, cols: int, quota: int = 100, strict: bool = False) -> UserSet:
    """Checks a user's manifest and lays out its fields, four to each listed block.

    ``manifest``: (section_id, sample_id, role, protocol_id); ``blocks``: (section_id, by, bx, monitor); ``reserved``: (sample_id)
    of fixed test sections. Sample ids are safe file names, unique and not reserved; the role is "train", the protocol 0 or 1.
    Blocks are aligned to 256 pixels, whole, listed once, exactly two of them monitors and more than two in all. Anything else
    fails. Fields that overlap a monitor block are held out. A section shows ``quota`` fields an epoch, or all that it
    retains; with ``strict`` a section that retains fewer fails.
    """
    from lamella import jobs

    named = manifest.groupBy("sample_id").agg(F.count("*").alias("_n"))
    taken = reserved.select("sample_id").distinct().withColumn("_taken", F.lit(True))
    met = manifest.join(named, "sample_id").join(taken, "sample_id", "left").join(checks.block_faults(blocks, rows, cols), "section_id", "left")
    safe = F.col("sample_id").rlike("^[A-Za-z0-9_.-]+$") & ~F.col("sample_id").isin(".", "..") & (F.col("_n") == 1)
    role = F.coalesce((F.col("role") == "train") & F.col("protocol_id").isin(0, 1), F.lit(False))
    listed = F.coalesce((F.col("unaligned") == 0) & (F.col("repeated") == 0) & ~F.col("not_two_monitors") & ~F.col("no_training_block"), F.lit(False))
    kind = dict(manifest.dtypes)["section_id"]
    section = F.col("section_id")
    for ok, message in ((listed, "blocks are not aligned, whole, unique, two monitors and more"), (role, "a section is not for training or of an unknown protocol"), (F.col("_taken").isNull(), "a fixed test section cannot be trained on"), (safe, "a sample id is not safe or not unique")):
        section = checks.guarded(section, ok, message, kind)
    known = met.select(section.alias("section_id"), "protocol_id")
    fields = jobs.user_fields(blocks).join(known.select("section_id"), "section_id", "left_semi")
    kept = fields.groupBy("section_id").agg(F.count_if(F.col("role") == "train").alias("retained"))
    budgets = known.join(kept, "section_id").select("section_id", "protocol_id", "retained", F.least(F.col("retained"), F.lit(quota)).alias("budget"))
    if strict:
        budgets = budgets.withColumn("budget", checks.guarded(F.col("budget"), F.col("retained") >= quota, "a quota exceeds the retained fields", "long"))
    return UserSet(fields, budgets)
