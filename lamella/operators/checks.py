"""Checks of identities, roles and manifests. A failing check raises while its rows are read; tallies come as one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.ranks import ranked
from lamella.operators.tasks import dealt


def guarded(value: Column, ok: Column, message: str, kind: str) -> Column:
    """``value`` where ``ok`` holds; fails otherwise."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast(kind))


def authorized(requested: DataFrame, allowed: DataFrame, key: list[str]) -> DataFrame:
    """The requested rows, all of whose identities must be among the allowed ones."""
    met = requested.join(allowed.select(*key).distinct().withColumn("_ok", F.lit(True)), key, "left")
    first = key[0]
    return met.withColumn(first, guarded(F.col(first), F.col("_ok").isNotNull(), "a field is not authorized", dict(requested.dtypes)[first])).select(*requested.columns)


def gene_ids(features: DataFrame, column: str = "gene_id") -> DataFrame:
    """Trimmed gene ids; empty or repeated ones fail."""
    trimmed = features.withColumn(column, F.trim(column))
    n = F.count("*").over(Window.partitionBy(column))
    return trimmed.withColumn(column, guarded(F.col(column), (F.length(column) > 0) & (n == 1), "a gene id is empty or repeated", "string"))


def coordinates(points: DataFrame, *axes: str) -> DataFrame:
    """Points whose coordinates are finite, not negative and unique; others fail."""
    n = F.count("*").over(Window.partitionBy("section_id", *axes))
    ok = n == 1
    for a in axes:
        v = F.col(a).cast("double")
        ok = ok & F.coalesce((v >= 0) & (v < float("inf")), F.lit(False))
    return points.withColumn(axes[0], guarded(F.col(axes[0]), ok, "a coordinate is negative, not finite or repeated", dict(points.dtypes)[axes[0]]))


def narrowed(counts: DataFrame, panel: DataFrame) -> DataFrame:
    """Counts of the genes of a panel, each of which the counts' sections must all have measured."""
    sections = counts.select("section_id").distinct()
    measured = counts.select("section_id", "gene_id").distinct().withColumn("_has", F.lit(True))
    asked = sections.crossJoin(F.broadcast(panel.select("gene_id"))).join(measured, ["section_id", "gene_id"], "left")  # a panel is a bounded list of genes
    asked = asked.withColumn("gene_id", guarded(F.col("gene_id"), F.col("_has").isNotNull(), "a cache lacks a gene of the panel", "long"))
    return counts.join(asked.select("section_id", "gene_id"), ["section_id", "gene_id"])


def reusable(cached: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: fields only in the cache, fields only wanted; both 0 where a feature cache may be used again."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(cached.exceptAll(wanted), "only_cached").crossJoin(n(wanted.exceptAll(cached), "only_wanted"))  # one row each


def density_faults(cells: DataFrame) -> DataFrame:
    """One row of tallies over (od, h, e, area, valid): bad values, values without area, valid cells without full area."""
    v = [F.col(c) for c in ("od", "h", "e")]
    bad, some = F.lit(False), F.lit(False)
    for c in v:
        bad, some = bad | c.isNull() | F.isnan(c) | (c < 0) | (c == float("inf")), some | (c != 0)
    return cells.agg(F.count_if(bad).alias("bad"), F.count_if(some & (F.col("area") == 0)).alias("without_area"), F.count_if(F.col("valid") & (F.col("area") < 1)).alias("valid_in_part"))


def block_faults(blocks: DataFrame, rows: int, cols: int, side: int = 256) -> DataFrame:
    """Sections whose manifest breaks a rule, by rule: ``blocks`` (section_id, by, bx, monitor), one row a listed block."""
    aligned = (F.col("by") >= 0) & (F.col("bx") >= 0) & (F.col("by") % side == 0) & (F.col("bx") % side == 0) & (F.col("by") + side <= rows) & (F.col("bx") + side <= cols)
    m = blocks.groupBy("section_id").agg(
        F.count_if(~aligned).alias("unaligned"), (F.count("*") - F.count_distinct("by", "bx")).alias("repeated"), F.count_if("monitor").alias("monitors"), F.count("*").alias("n")
    )
    return m.select("section_id", "unaligned", "repeated", (F.col("monitors") != 2).alias("not_two_monitors"), (F.col("n") <= 2).alias("no_training_block"))


def overlapping_sides(support: DataFrame, selection: DataFrame, side: int = 256) -> DataFrame:
    """Pairs of support and selection fields less than ``side`` apart on both axes; they meet by the grid cells around them."""
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    cell = lambda c: F.floor(F.col(c) / float(side))
    a = support.select("section_id", "y0", "x0", near.alias("i")).select("*", near.alias("j")).select("section_id", "y0", "x0", (cell("y0") + F.col("i")).alias("cy"), (cell("x0") + F.col("j")).alias("cx"))
    b = selection.select("section_id", F.col("y0").alias("y1"), F.col("x0").alias("x1"), cell("y0").alias("cy"), cell("x0").alias("cx"))
    return a.join(dealt(b), ["section_id", "cy", "cx"]).where((F.abs(F.col("y0") - F.col("y1")) < side) & (F.abs(F.col("x0") - F.col("x1")) < side)).select("section_id", "y0", "x0", "y1", "x1")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of each section with their place in lexicographic order."""
    return ranked(rows, list(order), ["section_id"], "place")


def same_task(prediction: DataFrame, reference: DataFrame) -> DataFrame:
    """Sections (section_id, sample_id, task) that may be scored.

    ``prediction``: (section_id, sample_id, task); ``reference``: (section_id, sample_id, task, role, used_for_fitting). Every
    section of the reference must have been predicted for the same sample and task, and the reference must be a measured one
    for evaluation only that no model was fitted on. Anything else fails.
    """
    p = prediction.select("section_id", F.col("sample_id").alias("_sample"), F.col("task").alias("_task"))
    met = reference.join(p, "section_id", "left")
    kind = dict(reference.dtypes)["section_id"]
    role = (F.col("role") == "evaluation_only_measured_8um") & ~F.coalesce("used_for_fitting", F.lit(True))
    same = (F.col("sample_id") == F.col("_sample")) & (F.col("task") == F.col("_task"))
    checked = guarded(F.col("section_id"), F.coalesce(role, F.lit(False)), "a reference is not for evaluation only", kind)
    met = met.withColumn("section_id", guarded(checked, F.coalesce(same, F.lit(False)), "a reference's sample or task differs from the prediction", kind))
    return met.select("section_id", "sample_id", "task")


def same_genes(prediction: DataFrame, reference: DataFrame) -> DataFrame:
    """Genes (section_id, gene_id, pos, available) on which prediction and reference agree, in order and availability.

    Both are (section_id, pos, gene_id, available). A gene at another place, on one side only or available on one side only
    fails, and so does a section without any available gene.
    """
    r = reference.select("section_id", "pos", F.col("gene_id").alias("_gene"), F.col("available").alias("_available"))
    met = prediction.join(r, ["section_id", "pos"], "full")
    kind = dict(prediction.dtypes)["gene_id"]
    some = F.max("available").over(Window.partitionBy("section_id"))  # a panel is a bounded list of genes
    gene = guarded(F.col("gene_id"), F.coalesce(some, F.lit(False)), "a section has no available gene", kind)
    gene = guarded(gene, F.coalesce(F.col("available") == F.col("_available"), F.lit(False)), "a gene is available on one side only", kind)
    gene = guarded(gene, F.coalesce(F.col("gene_id") == F.col("_gene"), F.lit(False)), "the gene order of prediction and reference differs", kind)
    return met.select("section_id", gene.alias("gene_id"), "pos", "available")


def preprocessing_faults(panel: DataFrame, reference: DataFrame, fitted: DataFrame, training: DataFrame) -> DataFrame:
    """One row of tallies for fitted preprocessing that is used again: places whose gene differs from the reference panel's
    (pos, gene_id), training sections that the fit did not see, and sections that it saw beyond them; all 0 where it may be used."""
    r = reference.select("pos", F.col("gene_id").alias("_gene"))
    genes = panel.join(r, "pos", "full").agg(F.count_if(~F.col("gene_id").eqNullSafe(F.col("_gene"))).alias("genes_differ"))
    a, b = (df.select("section_id").distinct() for df in (fitted, training))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return genes.crossJoin(n(b.join(a, "section_id", "left_anti"), "not_fitted")).crossJoin(n(a.join(b, "section_id", "left_anti"), "beyond_training"))  # one row each


def disjoint_sides(split: DataFrame, side: int = 256) -> DataFrame:
    """Fields (section_id, y0, x0, side) no support field of which lies within ``side`` of a selection field on both axes; others fail."""
    close = overlapping_sides(split.where("side = 'support'"), split.where("side = 'selection'"), side).select("section_id", "y0", "x0").distinct().withColumn("_close", F.lit(True))
    met = split.join(dealt(close), ["section_id", "y0", "x0"], "left")
    return met.withColumn("side", guarded(F.col("side"), F.col("_close").isNull(), "support and selection fields overlap", "string")).drop("_close")


def replayed(prediction: DataFrame, reference: DataFrame, key: list[str], group: str = "section_id", absolute: float = 1e-6, relative: float = 1e-5) -> DataFrame:
    """Per group: n, passed and max_absolute_error of predicted values against those of an earlier run.

    Both tables hold ``key`` and ``value``; both must hold the same keys, each once. A value passes within
    ``absolute`` plus ``relative`` times the reference; values that are no numbers never pass, equal infinities do.
    """
    value = F.col("value").cast("double")
    side = lambda df, n: df.select(*key, value.alias("_value"), F.lit(n).alias("_side"))
    of = lambda n: F.max(F.when(F.col("_side") == n, F.col("_value")))
    many = lambda n: F.count_if(F.col("_side") == n)
    both = side(prediction, 0).unionByName(side(reference, 1)).groupBy(*key).agg(of(0).alias("_p"), of(1).alias("_y"), many(0).alias("_in_p"), many(1).alias("_in_y"))
    once = (F.col("_in_p") == 1) & (F.col("_in_y") == 1)
    met = both.select(group, guarded(F.col("_p"), once, "prediction and reference differ in their rows", "double").alias("_p"), "_y")
    p, y = F.col("_p"), F.col("_y")
    gap = F.when(p == y, 0.0).otherwise(F.abs(p - y))
    close = ~F.isnan(p) & ~F.isnan(y) & ((p == y) | ((gap <= absolute + relative * F.abs(y)) & (F.abs(y) < float("inf"))))
    return met.groupBy(group).agg(F.count("*").alias("n"), F.every(F.coalesce(close, F.lit(False))).alias("passed"), F.max(gap).alias("max_absolute_error"))


def reused(cached: DataFrame, wanted: DataFrame, features: DataFrame, cells: int) -> DataFrame:
    """Per wanted field (section_id, field_id, y0, x0): the mean ``density`` of its cached ``features``.

    Fails unless the cached fields are the wanted ones with the same numbers and origins, each field has cells 0 to
    ``cells`` - 1 once and none besides, and every density is finite and not negative.
    """
    key = ["section_id", "field_id", "y0", "x0"]
    side = lambda df, n: df.select(*key, F.lit(n).alias("side"))
    lists = side(cached, 0).unionByName(side(wanted, 1)).groupBy(*key).agg(F.count_if(F.col("side") == 0).alias("n_cached"), F.count_if(F.col("side") == 1).alias("n_wanted"))
    density = F.col("density").cast("double")
    bad = density.isNull() | F.isnan(density) | (density < 0) | (density == float("inf"))
    inside = F.coalesce((F.col("cell") >= 0) & (F.col("cell") < cells), F.lit(False))
    held = features.groupBy("section_id", "field_id").agg(
        F.count("*").alias("rows"), F.count_distinct(F.when(inside, F.col("cell"))).alias("held"), F.count_if(bad).alias("bad"), F.avg(density).alias("density")
    )
    met = lists.join(held, ["section_id", "field_id"], "full")
    y0 = guarded(F.col("y0"), F.coalesce((F.col("n_cached") == 1) & (F.col("n_wanted") == 1), F.lit(False)), "the cache holds other fields", "long")
    whole = guarded(F.col("density"), F.coalesce((F.col("rows") == cells) & (F.col("held") == cells), F.lit(False)), "the cache lacks or repeats cells of a field", "double")
    sound = guarded(F.col("density"), F.col("bad") == 0, "a cached density is no finite number from 0 on", "double")
    return met.withColumn("y0", y0).withColumn("density", whole).withColumn("density", sound).select(*key, "density")
