"""Scores of predictions against measured counts, from sums that merge over blocks, streams and partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(p: str = "p", y: str = "y") -> list[Column]:
    """Sums that gene scores need; they add up over blocks (minima and maxima merge)."""
    a, b = F.col(p).cast("double"), F.col(y).cast("double")
    return [F.count("*").alias("n"), F.sum(a).alias("sp"), F.sum(b).alias("sy"), F.sum(a * a).alias("spp"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("spy"),
            F.sum(F.abs(a - b)).alias("sad"), F.sum((a - b) * (a - b)).alias("ssd"), F.min(a).alias("pmin"), F.max(a).alias("pmax"), F.min(b).alias("ymin"), F.max(b).alias("ymax")]


def merge_moments(m: DataFrame, *keys: str) -> DataFrame:
    """Moments of blocks to moments of the whole."""
    sums = [F.sum(c).alias(c) for c in ("n", "sp", "sy", "spp", "syy", "spy", "sad", "ssd")]
    return m.groupBy(*keys).agg(*sums, *[F.min(c).alias(c) for c in ("pmin", "ymin")], *[F.max(c).alias(c) for c in ("pmax", "ymax")])


def safe(num: Column, den: Column) -> Column:
    """num / den, and 0 where den is 0."""
    return F.when(den != 0, num / F.when(den != 0, den)).otherwise(0.0)


def gene_scores(m: DataFrame, *keys: str) -> DataFrame:
    """PCC (null without range or variance), nRMSE and MAE, from moments.

    nRMSE is the RMS difference after prediction and measurement were each scaled by their own least value and range (a
    side without range counts as 0).
    """
    n = F.col("n").cast("double")
    vp, vy = F.col("spp") - F.col("sp") ** 2 / n, F.col("syy") - F.col("sy") ** 2 / n
    cov = F.col("spy") - F.col("sp") * F.col("sy") / n
    a, b = (safe(F.lit(1.0), F.col(f"{s}max") - F.col(f"{s}min")) for s in "py")
    defined = (a > 0) & (b > 0) & (vp > 0) & (vy > 0)
    shift = (F.col("sp") / n - F.col("pmin")) * a - (F.col("sy") / n - F.col("ymin")) * b
    square = F.greatest(vp, F.lit(0.0)) / n * a * a + F.greatest(vy, F.lit(0.0)) / n * b * b - 2 * cov / n * a * b + shift * shift
    nrmse = F.sqrt(F.greatest(square, F.lit(0.0)))
    return m.select(*keys, F.when(defined, cov / F.sqrt(F.when(defined, vp * vy))).alias("pcc"), nrmse.alias("nrmse"), (F.col("sad") / n).alias("mae"))


def centred(p: Column, y: Column) -> list[Column]:
    """(vp, vy, cov): energies and product of p and y less their means, by aggregates that merge without cancellation."""
    n = F.count(p)
    return [(F.var_pop(p) * n).alias("vp"), (F.var_pop(y) * n).alias("vy"), (F.covar_pop(p, y) * n).alias("cov")]


def correlation(least: float) -> Column:
    """PCC of ``centred`` columns: null unless both energies exceed ``least``, clamped to +-1."""
    ok = (F.col("vp") > least) & (F.col("vy") > least)
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cov") / F.sqrt("vp") / F.sqrt("vy"))))


def position_scores(pairs: DataFrame, *position: str) -> DataFrame:
    """PCC across genes and Bray-Curtis distance of compositions of each position with a measured count.

    PCC needs variance on both sides, however small.
    """
    p, y = F.col("p").cast("double"), F.col("y").cast("double")
    w = Window.partitionBy(*position)
    each = pairs.select(*position, p.alias("p"), y.alias("y"), F.sum(p).over(w).alias("tp"), F.sum(y).over(w).alias("ty"))
    gap = F.abs(safe(F.col("p"), F.col("tp")) - safe(F.col("y"), F.col("ty")))
    m = each.groupBy(*position, "tp", "ty").agg(*centred(F.col("p"), F.col("y")), F.sum(gap).alias("gap"))
    return m.where("ty > 0").select(*position, correlation(0.0).alias("pcc"), F.when(F.col("tp") == 0, 1.0).otherwise(F.col("gap") / 2).alias("bray_curtis"))


def error_report(pairs: DataFrame, *keys: str, atol: float = 1e-5, rtol: float = 1e-5) -> DataFrame:
    """Largest absolute, scaled and relative error, and whether all lie within atol + rtol * |y|; null if none."""
    p, y = F.col("p").cast("double"), F.col("y").cast("double")
    d = F.abs(p - y)
    grouped = pairs.groupBy(*keys) if keys else pairs.groupBy()
    return grouped.agg(F.count("*").alias("n"), F.max(d).alias("max_abs"), F.max(d / (1 + F.abs(y))).alias("max_scaled"), F.max(F.when(y != 0, d / F.abs(F.when(y != 0, y)))).alias("max_relative"), F.bool_and(d <= atol + rtol * F.abs(y)).alias("within"))


def poisson_nll(pairs: DataFrame, *keys: str) -> DataFrame:
    """Poisson loss per count: sum(p - y ln max(p, 1e-12)) / max(sum y, 1)."""
    p, y = F.col("p").cast("double"), F.col("y").cast("double")
    out = pairs.groupBy(*keys).agg(F.sum(p - y * F.log(F.greatest(p, F.lit(1e-12)))).alias("loss"), F.sum(y).alias("umi"))
    return out.select(*keys, "umi", (F.col("loss") / F.greatest("umi", F.lit(1.0))).alias("nll"))


def region_nll(pairs: DataFrame, field: str = "field_id", region: str = "region") -> DataFrame:
    """Shares of each region in a field's Poisson loss per count."""
    p, y = F.col("p").cast("double"), F.col("y").cast("double")
    part = pairs.groupBy(field, region).agg(F.sum(p - y * F.log(F.greatest(p, F.lit(1e-12)))).alias("loss"), F.sum(y).alias("umi"))
    total = F.greatest(F.sum("umi").over(Window.partitionBy(field)), F.lit(1.0))
    return part.select(field, region, (F.col("loss") / total).alias("nll"))


def poisson_divergence(p: Column, y: Column) -> Column:
    """y ln(y / p) + p - y, by its series where p and y are nearly equal; 0 ln 0 is 0."""
    d = (p - y) / F.when(y > 0, y)
    series = y * (d * d / 2 - d * d * d / 3)
    exact = y * F.log(F.when(y > 0, y) / F.greatest(p, F.lit(1e-300))) + p - y
    return F.when(y <= 0, p).when(F.abs(d) < 1e-4, series).otherwise(exact)


def allocation_kl(pairs: DataFrame, *keys: str) -> DataFrame:
    """Generalised KL of measured q against allocated p per count: q ln(q / p) + p - q."""
    p, q = F.col("p").cast("double"), F.col("y").cast("double")
    out = pairs.groupBy(*keys).agg(F.sum(poisson_divergence(F.greatest(p, F.lit(1e-12)), q)).alias("kl"), F.sum(q).alias("umi"))
    return out.select(*keys, (F.col("kl") / F.greatest("umi", F.lit(1.0))).alias("kl"))


def gain_split(pairs: DataFrame, field: list[str], child: list[str]) -> DataFrame:
    """Gain of p over a quarter of the parent's count c, per count, split into totals of children and their composition.

    ``pairs``: (.., p, y, c), a row for each child and gene; the totals run over the genes of each child. full_gain is
    total_gain + composition_gain.
    """
    p, y, c = (F.col(v).cast("double") for v in "pyc")
    log = lambda v: F.log(F.greatest(v, F.lit(1e-12)))
    m = pairs.groupBy(*field, *child).agg(
        F.sum(c / 4 - p + y * (log(p) - log(c / 4))).alias("full"), F.sum(y * (log(p) - log(c))).alias("shares"), *[F.sum(v).alias(n) for n, v in (("tp", p), ("ty", y), ("tc", c))]
    )
    m = m.withColumn("total", F.col("tc") / 4 - F.col("tp") + F.col("ty") * (log(F.col("tp")) - log(F.col("tc") / 4)))
    m = m.withColumn("composition", F.col("shares") - F.col("ty") * (log(F.col("tp")) - log(F.col("tc"))))
    out = m.groupBy(*field).agg(*[F.sum(v).alias(v) for v in ("full", "total", "composition", "ty")]).where("ty > 0")
    return out.select(*field, *[(F.col(v) / F.col("ty")).alias(f"{v}_gain") for v in ("full", "total", "composition")])


def energies() -> list[Column]:
    """Sums that PCC and RMS ratio of residuals p and y need."""
    p, y = F.col("p").cast("double"), F.col("y").cast("double")
    return [F.count("*").alias("n"), *centred(p, y), F.sum(p * p).alias("spp"), F.sum(y * y).alias("syy")]


def rms_ratio(least: float) -> Column:
    return F.when(F.col("syy") > least, F.sqrt(F.col("spp") / F.when(F.col("syy") > least, F.col("syy"))))


def flat_scores(pairs: DataFrame, *keys: str, least: float = 1e-20) -> DataFrame:
    """PCC of residuals, null under two values or at energies up to 1e-20, and their RMS ratio, null at a true energy up to ``least``."""
    m = (pairs.groupBy(*keys) if keys else pairs.groupBy()).agg(*energies())
    return m.select(*keys, "n", F.when(F.col("n") >= 2, correlation(1e-20)).alias("pcc"), rms_ratio(least).alias("rms_ratio"))


def gain_residuals(pairs: DataFrame, field: list[str], child: list[str]) -> DataFrame:
    """PCC and RMS ratio of three residuals of each field: genes, totals and compositions of children.

    ``pairs``: (.., p, y, c), a row for each child and gene. Genes: against c / 4. Totals: sums over genes against a quarter of
    theirs. Compositions: against the child's total dealt as the parent's counts are.
    """
    p, y, c = (F.col(v).cast("double") for v in "pyc")
    w = Window.partitionBy(*field, *child)
    each = pairs.select(*field, *child, p.alias("p"), y.alias("y"), c.alias("c"), *[F.sum(v).over(w).alias(n) for n, v in (("tp", p), ("ty", y), ("tc", c))], F.row_number().over(w.orderBy(F.lit(0))).alias("_first"))
    share = F.col("c") / F.greatest(F.col("tc"), F.lit(1.0))
    of = lambda kind, a, b, use=None: F.struct(F.lit(kind).alias("kind"), a.alias("p"), b.alias("y"), (F.lit(True) if use is None else use).alias("use"))
    goes = F.array(
        of("gene", F.col("p") - F.col("c") / 4, F.col("y") - F.col("c") / 4),
        of("total", F.col("tp") - F.col("tc") / 4, F.col("ty") - F.col("tc") / 4, F.col("_first") == 1),
        of("composition", F.col("p") - share * F.col("tp"), F.col("y") - share * F.col("ty")),
    )
    parts = each.select(*field, F.explode(F.filter(goes, lambda g: g["use"])).alias("g")).select(*field, "g.kind", "g.p", "g.y")
    scores = flat_scores(parts, *field, "kind", least=0.0)
    kinds = ("gene", "total", "composition")
    picked = lambda k, v: F.max(F.when(F.col("kind") == k, F.col(v))).alias(f"{k}_residual_{v}")
    return scores.groupBy(*field).agg(*[picked(k, v) for k in kinds for v in ("pcc", "rms_ratio")])


def stratum_scores(pairs: DataFrame, *keys: str) -> DataFrame:
    """By count stratum of the parent: pairs of parents and genes and their share of all, counts, conditional loss per count,
    its gain over ln 4, and PCC and RMS ratio of residuals against a quarter. ``pairs``: (.., p, y, c), four children a parent.

    Pairs without a count make a stratum of their own, of which only number and share are defined.
    """
    p, y, c = (F.col(v).cast("double") for v in "pyc")
    at = pairs.select(*keys, stratum(c).alias("stratum"), (p - c / 4).alias("p"), (y - c / 4).alias("y"), y.alias("_y"), F.when(c > 0, -y * (F.log(F.greatest(p, F.lit(1e-12))) - F.log(F.when(c > 0, c)))).alias("_loss"))
    m = at.groupBy(*keys, "stratum").agg((F.count("*") / 4).cast("long").alias("parent_gene_pairs"), F.sum("_y").alias("umis"), F.sum("_loss").alias("loss"), *energies())
    share = F.col("parent_gene_pairs") / F.sum("parent_gene_pairs").over(Window.partitionBy(*keys))
    some = F.col("stratum") != "0"
    nll = F.when(some, F.col("loss") / F.when(some, F.col("umis")))
    return m.select(*keys, "stratum", "parent_gene_pairs", share.alias("share"), "umis", nll.alias("nll"), (F.lit(math.log(4)) - nll).alias("gain"), F.when(some, correlation(1e-20)).alias("pcc"), F.when(some, rms_ratio(1e-20)).alias("rms_ratio"))


def stratum(c: Column) -> Column:
    """Count strata of parents: 0, 1, 2-4, 5 and more."""
    return F.when(c == 0, "0").when(c == 1, "1").when(c <= 4, "2-4").otherwise("5+")


def rolled_up(scores: DataFrame, value: str, *levels: str) -> DataFrame:
    """Mean of means through nested levels (innermost last), with the number of defined values at each."""
    out = scores
    for i in range(len(levels) - 1, -1, -1):
        keys = levels[:i]
        out = (out.groupBy(*keys) if keys else out.groupBy()).agg(F.avg(value).alias(value), F.count(value).alias("defined"))
        if i:
            out = out.select(*keys, value)
    return out
