"""Neighbour searches by grid buckets: candidates come from the 3 x 3 buckets around a point, never from all pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.tasks import dealt, spread

#: Pairs, or places of buckets, that one task takes in ``nearest_any``.
EACH = 1_000_000


def _bucket(c: str, size: float) -> Column:
    return F.floor(F.col(c) / F.lit(float(size))).cast("long")


def _beside(rows: DataFrame) -> DataFrame:
    """Rows of a bucket (_by, _bx) in each of the 3 x 3 buckets around it."""
    near = F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long"))
    out = rows.withColumn("_a", F.explode(near)).withColumn("_b", F.explode(near))
    return out.withColumn("_by", F.col("_by") + F.col("_a")).withColumn("_bx", F.col("_bx") + F.col("_b")).drop("_a", "_b")


def _around(points: DataFrame, size: float) -> DataFrame:
    return _beside(points.withColumn("_by", _bucket("cy", size)).withColumn("_bx", _bucket("cx", size)))


def _wide(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """Rows dealt out by columns if ``n`` units of work are more than one task should take."""
    return spread(rows, n, EACH, *by) if n > EACH else rows


def within(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """Points (section_id, cy, cx, ..) with each of the others (section_id, other, oy, ox) at most ``radius`` away, and d2."""
    held = others.withColumn("_by", _bucket("oy", radius)).withColumn("_bx", _bucket("ox", radius))
    met = _around(points, radius).join(dealt(held), ["section_id", "_by", "_bx"]).drop("_by", "_bx")
    d2 = (F.col("cy") - F.col("oy")) ** 2 + (F.col("cx") - F.col("ox")) ** 2
    return met.withColumn("d2", d2).where(F.col("d2") <= radius * radius)


def pairs(points: DataFrame, radius: float = 110.0) -> DataFrame:
    """Pairs of different points (first < second) more than 0 and at most ``radius`` apart."""
    others = points.select("section_id", F.col("id").alias("other"), F.col("cy").alias("oy"), F.col("cx").alias("ox"))
    return within(points.select("section_id", "id", "cy", "cx"), others, radius).where("d2 > 0 AND id < other").select("section_id", F.col("id").alias("first"), F.col("other").alias("second"), "d2")


def nearest(points: DataFrame, others: DataFrame, k: int, radius: float, key: list[str], include_self: bool = True, tie: str = "other") -> DataFrame:
    """The k nearest of the others within ``radius`` of each point; ties go to the smaller ``tie`` column."""
    met = within(points, others, radius)
    if not include_self:
        met = met.where("id <> other")
    w = Window.partitionBy("section_id", *key).orderBy("d2", tie)
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_any(points: DataFrame, others: DataFrame, k: int, key: list[str], size: float, tie: str = "other", growth: float = 4.0) -> DataFrame:
    """The k nearest of the others at any distance, exactly; ties go to the smaller ``tie`` column. Fewer where fewer exist.

    ``points``: (section_id, *key, cy, cx), one row each; ``others``: (section_id, other, oy, ox, ..). Buckets start at
    ``size`` and grow by ``growth``. A point looks into its 3 x 3 buckets once their numbers say that these hold k others; it is done
    when the k-th lies no further away than a bucket is wide, as nothing nearer can lie outside. If it lies further, the
    buckets of that width are sure to hold all k. Only open points go on, and none compares with others more than twice.

    Of points and others the fewer go to nine buckets. Where these are the others, all candidates of a point lie in one
    bucket, and are ranked where they were met. The numbers say how many pairs will be formed, and so into how many tasks
    they are dealt out.
    """
    from lamella.session import checkpointed

    at, bucket = ["section_id", *key], ["section_id", "_by", "_bx"]
    total = others.groupBy("section_id").agg(F.count("*").alias("_all"))
    held_n = total.agg(F.sum("_all")).first()[0] or 0
    open_ = checkpointed(points.join(total, "section_id").select(*points.columns, "_all", F.lit(0).alias("_level"), F.lit(False).alias("_sure")))
    pool, found, columns = open_.columns, [], None
    while (next_ := open_.groupBy("_level").count().orderBy("_level").first()) is not None:
        level, n = next_
        if level > 64:
            raise RuntimeError("points are further apart than 64 widths of buckets")
        s = size * growth**level
        held = others.withColumn("_by", _bucket("oy", s)).withColumn("_bx", _bucket("ox", s))
        load = _beside(held.groupBy(*bucket).agg(F.count("*").alias("_c"))).groupBy(*bucket).agg(F.sum("_c").alias("_n"))
        todo = open_.where(F.col("_level") == level).withColumn("_by", _bucket("cy", s)).withColumn("_bx", _bucket("cx", s))
        todo = checkpointed(_wide(todo, n, *bucket).join(dealt(load), bucket, "left").withColumn("_n", F.coalesce("_n", F.lit(0))))
        enough = F.col("_sure") | (F.col("_n") >= F.least(F.lit(k), F.col("_all")))
        pairs_n = todo.where(enough).agg(F.sum("_n")).first()[0] or 0
        met, few = todo.where(enough).select(*points.columns, "_by", "_bx"), n < held_n
        if few:
            met = _wide(_beside(met), max(pairs_n, 9 * n), *bucket).join(dealt(held), bucket)
            met = _wide(met, pairs_n, *at)
        else:
            met = _wide(met, max(pairs_n, 9 * held_n), *bucket).join(dealt(_beside(held)), bucket)
        d2 = (F.col("cy") - F.col("oy")) ** 2 + (F.col("cx") - F.col("ox")) ** 2
        w = Window.partitionBy(*at, *([] if few else ["_by", "_bx"])).orderBy("d2", tie)
        top = checkpointed(met.withColumn("d2", d2).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_by", "_bx"))
        columns = top.columns
        judged = _wide(todo.where(enough), n, *at).join(dealt(top.groupBy(*at).agg(F.max("d2").alias("_d2"))), at)
        done = (F.col("_n") == F.col("_all")) | (F.col("_d2") <= s * s)
        found.append(top.join(dealt(judged.where(done).select(*at)), at, "left_semi"))
        wider = F.greatest(F.lit(level + 1), F.ceil(F.log(F.sqrt("_d2") / size) / math.log(growth)).cast("int"))
        again = judged.where(~done).withColumn("_level", wider).withColumn("_sure", F.lit(True)).select(*pool)
        later = todo.where(~enough).withColumn("_level", F.lit(level + 1)).select(*pool)
        open_ = checkpointed(open_.where(F.col("_level") > level).unionByName(again).unionByName(later))
    if not found:
        return points.join(others, "section_id").withColumn("d2", F.lit(0.0)).withColumn("rank", F.lit(0)).where("false")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(*columns)


def within_any(cells: DataFrame, centers: DataFrame, radius: float) -> DataFrame:
    """Cells (section_id, cy, cx, ..) with a centre (section_id, oy, ox) at most ``radius`` away, once each."""
    met = within(cells, centers.withColumn("other", F.lit(0)), radius)
    return met.select(*cells.columns).distinct()


def support(found: DataFrame, points: DataFrame, k: int, scale: float, key: list[str]) -> DataFrame:
    """For each point: share of k neighbours found, distance of the nearest by scale (1 if none), and whether any was."""
    m = found.groupBy("section_id", *key).agg(F.count("*").alias("n"), F.min("d2").alias("d2"))
    out = points.select("section_id", *key).join(m, ["section_id", *key], "left")
    return out.select("section_id", *key, F.coalesce(F.col("n") / float(k), F.lit(0.0)).alias("share"), F.coalesce(F.sqrt("d2") / scale, F.lit(1.0)).alias("nearest"), F.col("n").isNotNull().alias("any"))


def gap_sources(missing: DataFrame, direct: DataFrame, tissue: DataFrame, k: int = 4, radius: float = 32.0, cell: float = 8.0) -> DataFrame:
    """Sources for tissue cells without a direct value: the k nearest direct tissue cells, cut at ``radius`` um, whose path stays in tissue.

    The k nearest are taken first and the cut and the test of the path at a quarter, half and three quarters follow.
    Weights are 1 / max(d, 1)^2 in um, normalised over what is left. All tables are (section_id, qy, qx).
    """
    center = lambda q: (F.col(q) * cell + cell / 2)
    at = missing.select("section_id", "qy", "qx", center("qy").alias("cy"), center("qx").alias("cx"))
    source = direct.join(tissue, ["section_id", "qy", "qx"], "left_semi")
    # Of the k nearest only those within the radius matter, and the k nearest within it are the nearest of them.
    source = source.select("section_id", F.struct("qy", "qx").alias("other"), center("qy").alias("oy"), center("qx").alias("ox"))
    found = nearest(at, source, k, radius, ["qy", "qx"]).select("section_id", "qy", "qx", F.col("other.qy").alias("sy"), F.col("other.qx").alias("sx"), "d2")
    # The three points of a path meet the tissue in one join; a path stays if all three are met.
    point = lambda a, b, f: F.rint(F.col(a) + (F.col(b) - F.col(a)) * f).cast("long")
    path = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), point("qy", "sy", f).alias("y"), point("qx", "sx", f).alias("x")) for i, f in enumerate((0.25, 0.5, 0.75))]))
    at = found.withColumn("p", path).select("*", F.col("p.y").alias("_py"), F.col("p.x").alias("_px"))
    met = at.join(tissue.select("section_id", F.col("qy").alias("_py"), F.col("qx").alias("_px")), ["section_id", "_py", "_px"], "left_semi")
    found = met.groupBy("section_id", "qy", "qx", "sy", "sx", "d2").agg(F.count("*").alias("n")).where("n = 3").drop("n")
    w = 1.0 / F.greatest(F.col("d2"), F.lit(1.0))
    return found.withColumn("w", w).withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy("section_id", "qy", "qx"))).drop("w")
