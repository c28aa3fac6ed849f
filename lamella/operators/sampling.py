"""Seeded sampling, quotas, spatial holdouts and split checks. Orders come from hashes, so that they never depend on rows' places."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.ranks import ranked
from lamella.operators.tasks import dealt


def stable_seed(*values) -> int:
    """First 8 bytes (little-endian) of the SHA-256 of a compact JSON list, modulo 2^63 - 1."""
    digest = hashlib.sha256(json.dumps(list(values), separators=(",", ":")).encode()).digest()
    return int.from_bytes(digest[:8], "little") % (2**63 - 1)


def retry_seed(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a text, modulo 2^63 - 1."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(2**63 - 1).cast("decimal(20,0)")).cast("long")


def shuffled(items: DataFrame, seed: int, partition: list[str], item: str, position: str = "position") -> DataFrame:
    """Items numbered from 0 in a seeded order of each partition: by SHA-256, ties by the item."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in partition], F.col(item).cast("string")), 256)
    return items.withColumn(position, F.row_number().over(Window.partitionBy(*partition).orderBy(key, item)).cast("long") - 1)


def seed_column(json_list: Column) -> Column:
    """``stable_seed`` of the compact JSON text of a list, as a column."""
    digest = F.sha2(json_list, 256)
    swapped = F.concat(*[F.substring(digest, 15 - 2 * i, 2) for i in range(8)])
    return (F.conv(swapped, 16, 10).cast("decimal(20,0)") % F.lit(2**63 - 1).cast("decimal(20,0)")).cast("long")


MODES = ("fresh", "shuffled_cycles", "fresh_then_shuffled_cycles")


def epoch_draw(items: DataFrame, seed: int, epoch: int, quota: int, partition: list[str], item: str, mode: str = "shuffled_cycles") -> DataFrame:
    """Draws [(epoch-1)q, epoch q) of each partition: (.., cycle, position, draw, item).

    "shuffled_cycles": cycles over all items, a new order for each. "fresh": items in their own order, none twice; a pool
    that does not last to the end of the epoch fails. "fresh_then_shuffled_cycles": the first cycle is fresh, the others are
    shuffled. A draw is its cycle and position, so that no earlier epoch has to be replayed.
    """
    if mode not in MODES or epoch < 1 or quota < 1:
        raise ValueError("a known mode, and an epoch and a quota from 1 on")
    size = items.groupBy(*partition).agg(F.count("*").alias("size"))
    if mode == "fresh":
        lasts = F.col("size") >= epoch * quota
        size = size.withColumn("size", F.when(lasts, F.col("size")).otherwise(F.raise_error(F.lit("a pool of fresh items is exhausted")).cast("long")))
    # A draw is a cycle and a position and the other way round: items in the cycles that the epoch touches number the draws
    # themselves, and no table of draws meets them.
    first, last = (epoch - 1) * quota, epoch * quota - 1
    cycles = F.explode(F.sequence(F.floor(F.lit(first) / F.col("size")).cast("long"), F.floor(F.lit(last) / F.col("size")).cast("long")))
    own = items.join(dealt(size), partition).withColumn("cycle", cycles)
    parts = []
    if mode != "shuffled_cycles":
        parts.append(ranked(own.where("cycle = 0"), [item], partition, "position"))
        own = own.where("cycle > 0")
    if mode != "fresh":
        parts.append(shuffled(own, seed, [*partition, "cycle"], item))
    ordered = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    drawn = ordered.withColumn("draw", F.col("cycle") * F.col("size") + F.col("position")).where(F.col("draw").between(first, last))
    return drawn.select(*partition, "cycle", "position", "draw", *[c for c in items.columns if c not in partition])


def epoch_order(items: DataFrame, seed: int, epoch: int, key: list[str], name: str = "place") -> DataFrame:
    """Items of an epoch with their place in one seeded order over everything, by range partitions of the hash."""
    text = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), *[F.col(c).cast("string") for c in key]), 256)
    return ranked(items.withColumn("_order", text), ["_order", *key], None, name).drop("_order")


def quota(epoch: Column, per_epoch: float | Column) -> Column:
    """Whole items due in an epoch so that the running total stays rounded: differences of floor(e q + 1/2)."""
    upto = lambda e: F.floor(e * per_epoch + 0.5 + 1e-9)
    return (upto(epoch) - upto(epoch - 1)).cast("long")


def phase_views(items: DataFrame, presentations: int, order: str, partition: list[str], seed: int = 0, mode: str = "strata") -> DataFrame:
    """Views of items in one of four grid phases. Mode "strata": the first view shows the phase of the item's rank; two
    presentations add a partner at a seeded offset of 1 to 3 (XOR), four run through all phases. "fixed": every view shows
    the rank's phase; "canonical": every view shows phase 0."""
    if presentations not in (1, 2, 4) or mode not in ("strata", "fixed", "canonical"):
        raise ValueError("one, two or four presentations of a known mode")
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(order)) - 1
    out = items.withColumn("stratum", rank % 4).withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(presentations - 1))))
    offset = (retry_seed(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*partition, order)])) % 3 + 1).cast("int")
    phase = F.col("stratum") if mode == "fixed" else F.lit(0) if mode == "canonical" else F.when(F.col("view") > 0, F.col("stratum").bitwiseXOR(offset)).otherwise(F.col("stratum")) if presentations == 2 else (F.col("stratum") + F.col("view")) % 4
    return out.withColumn("phase", phase.cast("int"))


def exposure_plan(fields: DataFrame, budgets: DataFrame, batch: int, epochs: int) -> DataFrame:
    """Fields an epoch, steps an epoch, steps in all and size of the last batch.

    ``budgets``: (section_id, budget, floor), one row for every section of ``fields`` and for no other. A budget below its
    floor or beyond its section's fields fails; none is lowered.
    """
    pool = fields.groupBy("section_id").agg(F.count("*").alias("_pool"))
    each = pool.join(budgets, "section_id", "full")
    fine = F.coalesce((F.col("budget") >= F.col("floor")) & (F.col("floor") > 0) & (F.col("budget") <= F.col("_pool")), F.lit(False))
    each = each.withColumn("n", F.when(fine, F.col("budget")).otherwise(F.raise_error(F.lit("a section's budget misses its floor or its fields")).cast("long")))
    total = each.agg(F.sum("n").alias("fields_per_epoch"))
    steps = F.ceil(F.col("fields_per_epoch") / batch)
    return total.select("fields_per_epoch", steps.alias("steps_per_epoch"), (steps * epochs).alias("steps"), ((F.col("fields_per_epoch") - 1) % batch + 1).alias("last_batch"))


def epoch_sample(items: DataFrame, seed: int, epoch: int, n: int, partition: list[str], item: str) -> DataFrame:
    """The first n items of each partition in an order seeded by the epoch."""
    return shuffled(items.withColumn("_epoch", F.lit(epoch)), seed, [*partition, "_epoch"], item).where(F.col("position") < n).drop("_epoch")


def chosen_pair(pairs: DataFrame, seed: int, field: list[str], first: str = "first", second: str = "second", view: int = 0) -> DataFrame:
    """One neighbour pair of each field: the ``view``-th in a seeded order of the field's pairs."""
    key = F.concat_ws("-", F.col(first).cast("string"), F.col(second).cast("string"))
    return shuffled(pairs.withColumn("_pair", key), seed, field, "_pair").where(F.col("position") == view).drop("_pair", "position")


def interleaved(items: DataFrame, kind: str, order: str, n: int) -> DataFrame:
    """The first n of each kind, alternating by rank: kind 0 at even places, kind 1 at odd ones."""
    rank = F.row_number().over(Window.partitionBy(kind).orderBy(order))
    return items.withColumn("rank", rank).where(F.col("rank") <= n).withColumn("place", 2 * (F.col("rank") - 1) + F.col(kind)).drop("rank")


def first_of_each(items: DataFrame, n: int, partition: list[str], *order: str) -> DataFrame:
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("rank") <= n)


def coverage_epochs(fields: DataFrame, per_epoch: int, interval: int) -> DataFrame:
    """Epochs until every section's fields were drawn, rounded up to the validation interval."""
    need = fields.groupBy("section_id").agg(F.ceil(F.count("*") / F.lit(per_epoch)).alias("epochs"))
    return need.agg((F.ceil(F.max("epochs") / F.lit(interval)) * interval).cast("long").alias("epochs"))


def variable_genes(counts: DataFrame, markers: DataFrame, n: int) -> DataFrame:
    """Panel of all markers, filled up to n genes by the mean over sections of each gene's percentile rank of dispersion."""
    m = counts.groupBy("section_id", "gene_id").agg(F.avg("umi").alias("m"), F.var_samp("umi").alias("v"))
    rank = F.percent_rank().over(Window.partitionBy("section_id").orderBy(F.round(F.col("v") / F.col("m"), 9)))
    ranked = m.where("m > 0 AND v IS NOT NULL").withColumn("r", rank).groupBy("gene_id").agg(F.avg("r").alias("score"))
    marked = ranked.join(F.broadcast(markers.withColumn("marker", F.lit(True))), "gene_id", "left").withColumn("marker", F.coalesce("marker", F.lit(False)))
    return marked.orderBy(F.desc("marker"), F.desc(F.round("score", 9)), "gene_id").limit(n)


def early_stopping(runs: DataFrame, tasks: list[str], bounds: dict[str, float], patience: int, minimum: int, gains: dict[str, float] | None = None) -> DataFrame:
    """Epoch kept and epoch stopped of every run of ordered validations (run, epoch, one loss per task).

    An epoch is accepted if no task is worse than the best or the first by its bound or more (with a bound of 0: by
    more than nothing) and at least one improves on the best by more than its gain. A run stops after ``patience`` validations without acceptance, not
    before ``minimum`` epochs. A run's validations are few; they fold in order inside one expression.
    """
    items = F.array_sort(F.collect_list(F.struct("epoch", *tasks)))
    losses = lambda s: [s[t] for t in tasks]
    zero = F.struct(F.lit(-1).cast("long").alias("best_epoch"), F.lit(0).alias("stale"), F.lit(-1).cast("long").alias("stopped"), *[F.lit(None).cast("double").alias(f"best_{t}") for t in tasks], *[F.lit(None).cast("double").alias(f"first_{t}") for t in tasks])

    def step(s, x):
        fine, better = F.lit(True), F.lit(False)
        for t in tasks:
            worse = x[t] - F.least(s[f"best_{t}"], s[f"first_{t}"])
            fine = fine & ((worse < bounds[t]) if bounds[t] > 0 else (worse <= 0))
            better = better | (s[f"best_{t}"] - x[t] > (gains or {}).get(t, 0.0))
        fresh = s["best_epoch"] < 0
        ok = (fresh | (fine & better)) & (s["stopped"] < 0)
        stale = F.when(ok, 0).otherwise(s["stale"] + 1)
        stop = F.when((s["stopped"] < 0) & (stale >= patience) & (x["epoch"] >= minimum), x["epoch"]).otherwise(s["stopped"])
        kept = [F.when(ok, v).otherwise(s[f"best_{t}"]).alias(f"best_{t}") for t, v in zip(tasks, losses(x), strict=True)]
        first = [F.when(fresh, v).otherwise(s[f"first_{t}"]).alias(f"first_{t}") for t, v in zip(tasks, losses(x), strict=True)]
        return F.struct(F.when(ok, x["epoch"]).otherwise(s["best_epoch"]).alias("best_epoch"), stale.cast("int").alias("stale"), stop.alias("stopped"), *kept, *first)

    folded = runs.groupBy("run").agg(F.aggregate(items, zero, step).alias("s"))
    return folded.select("run", F.col("s.best_epoch").alias("best_epoch"), F.col("s.stopped").alias("stopped"))


def running_best(runs: DataFrame, value: str) -> DataFrame:
    """Validations that beat all before them, strictly."""
    before = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("best", F.min(value).over(before)).where(F.col("best").isNull() | (F.col(value) < F.col("best"))).drop("best")


def outside_blocks(fields: DataFrame, blocks: DataFrame, side: int = 256, fov: int = 128) -> DataFrame:
    """Fields that overlap none of the monitor blocks. Fields meet blocks by the grid cells both touch."""
    return fields.join(_touching(fields, blocks, side, fov).select("section_id", "y0", "x0").distinct(), ["section_id", "y0", "x0"], "left_anti")


def inside_blocks(fields: DataFrame, blocks: DataFrame, side: int = 256, fov: int = 128) -> DataFrame:
    """Fields that lie wholly inside one of the blocks."""
    whole = (F.col("y0") >= F.col("by")) & (F.col("y0") + fov <= F.col("by") + side) & (F.col("x0") >= F.col("bx")) & (F.col("x0") + fov <= F.col("bx") + side)
    return fields.join(_touching(fields, blocks, side, fov).where(whole).select("section_id", "y0", "x0").distinct(), ["section_id", "y0", "x0"], "left_semi")


def _touching(fields: DataFrame, blocks: DataFrame, side: int, fov: int) -> DataFrame:
    def cells(df, y, x, size):
        for v, c in ((y, "_cy"), (x, "_cx")):
            first, last = F.floor(F.col(v) / float(side)).cast("long"), F.floor((F.col(v) + size - 1) / float(side)).cast("long")
            df = df.withColumn(c, F.explode(F.sequence(first, last)))
        return df

    held = cells(blocks.select("section_id", "by", "bx"), "by", "bx", side)
    met = cells(fields.select("section_id", "y0", "x0"), "y0", "x0", fov).join(held, ["section_id", "_cy", "_cx"])
    return met.where((F.col("y0") < F.col("by") + side) & (F.col("y0") + fov > F.col("by")) & (F.col("x0") < F.col("bx") + side) & (F.col("x0") + fov > F.col("bx")))


def crops(counts: DataFrame, fields: DataFrame, fov: int = 128, stride: int = 64) -> DataFrame:
    """Counts of every field that covers their pixel, at field-local (ly, lx); one count may serve many fields.

    ``fields``: (section_id, y0, x0), origins on multiples of ``stride``.
    """
    reach = -(-fov // stride)
    out = counts
    for v, o in (("y", "y0"), ("x", "x0")):
        base = F.floor(F.col(v) / float(stride)).cast("long")
        out = out.withColumn("_o", F.explode(F.sequence(base - reach, base))).withColumn(o, F.col("_o") * stride).where((F.col(v) >= F.col(o)) & (F.col(v) < F.col(o) + fov)).drop("_o")
    return out.join(fields, ["section_id", "y0", "x0"]).withColumn("ly", F.col("y") - F.col("y0")).withColumn("lx", F.col("x") - F.col("x0"))


def sides(fields: DataFrame, boundary: int, fov: int = 128) -> DataFrame:
    """Fields left of a boundary as support, right of it as selection; straddlers go."""
    side = F.when(F.col("x0") + fov <= boundary, "support").when(F.col("x0") >= boundary, "selection")
    return fields.withColumn("side", side).where("side IS NOT NULL")


def split_faults(sections: DataFrame) -> DataFrame:
    """Breaches of a split (section_id, role, fold): sections of two roles, tested sections in folds, folds that miss any."""
    roles = sections.select("section_id", "role").distinct()
    two = roles.groupBy("section_id").count().where("count > 1")
    tested = sections.where("role = 'test'").select("section_id").intersect(sections.where("fold IS NOT NULL").select("section_id"))
    missed = sections.where("role = 'dev'").select("section_id").exceptAll(sections.where("role = 'dev' AND fold IS NOT NULL").select("section_id"))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(two, "two_roles").crossJoin(n(tested, "tested_in_fold")).crossJoin(n(missed, "without_fold"))  # one row each


def learning_rate(step: Column, top: float, floor: float, warm: int, steps: int) -> Column:
    """Rate of the update after ``step`` others: linear warm-up to ``top`` over ``warm`` updates, then a half cosine to ``floor``."""
    done = step.cast("double") + 1
    progress = F.least(F.lit(1.0), (done - warm) / float(max(1, steps - warm)))
    cosine = floor + (top - floor) * (1 + F.cos(F.lit(3.141592653589793) * progress)) / 2
    return F.when(done <= warm, top * done / max(1, warm)).otherwise(cosine)
