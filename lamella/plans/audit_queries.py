"""Queries that audit allocations and spots."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.operators import allocate, audit, geometry, metrics
from lamella.plans.count_queries import F4, OWNED
from lamella.plans.fixture import GRID, SPOTS_SQL, native_counts, owners, spots, with_tables
from lamella.plans.owner_queries import O, WEIGHTED, _counts, _mass, _segments, _valid
from lamella.plans.registry import query, r6

WEIGHTS = f"wt AS (SELECT spot_id, {F4.format('y')} AS qy, {F4.format('x')} AS qx, count(*) / 16.0::DOUBLE AS weight FROM circle GROUP BY 1,2,3)"
CELLS = f"ex AS (SELECT DISTINCT section_id, {F4.format('y')} AS qy, {F4.format('x')} AS qx FROM native_counts WHERE {F4.format('y')} % 7 < 5 OR {F4.format('x')} > 40)"


def _weights(spark, sf_dir):
    w = audit.spot_weights(spots(spark, sf_dir), 55.0, GRID, GRID)
    return native_counts(spark, sf_dir).select("section_id").distinct().crossJoin(F.broadcast(w))


@query(
    OWNED.rstrip()
    + f",\n{WEIGHTS}, {CELLS}"
    + """ SELECT s.section_id, spot_id, count(*) AS cells, count(e.qy) AS exported, round(sum(CASE WHEN e.qy IS NULL THEN 0 ELSE weight END)/sum(weight), 6) + 0.0 AS share,
      CASE WHEN count(e.qy) = count(*) THEN 'full' WHEN count(e.qy) = 0 THEN 'empty' ELSE 'partial' END AS support
      FROM sections s CROSS JOIN wt LEFT JOIN ex e ON e.section_id = s.section_id AND e.qy = wt.qy AND e.qx = wt.qx GROUP BY 1,2"""
)
def spot_support(spark, sf_dir):
    cells = native_counts(spark, sf_dir).select("section_id", geometry.down("y", 4).alias("qy"), geometry.down("x", 4).alias("qx")).distinct().where("qy % 7 < 5 OR qx > 40")
    return audit.spot_support(_weights(spark, sf_dir), cells).withColumn("share", r6("share"))


@query(
    WEIGHTED.rstrip()
    + f""",\n{WEIGHTS}, g AS (SELECT section_id, qy, qx, gene_id, sum(mass) AS mass FROM mass GROUP BY 1,2,3,4), s AS (SELECT section_id, spot_id, gene_id, sum(mass*weight) AS p FROM g JOIN wt USING (qy, qx) GROUP BY 1,2,3)
    SELECT s.section_id, count(*) AS n, round(max(abs(p - coalesce(umi, 0))), 5) + 0.0 AS max_abs FROM s LEFT JOIN cnt c ON c.section_id = s.section_id AND c.parent_id = s.spot_id AND c.gene_id = s.gene_id GROUP BY 1"""
)
def spot_section_check(spark, sf_dir):
    """Spots re-aggregated from 8 um cells: boundary cells mix owners and gaps, so counts do not come back exactly."""
    p = audit.spot_sums(_weights(spark, sf_dir), allocate.to_cells(_mass(spark, sf_dir)))
    y = _counts(spark, sf_dir).withColumnRenamed("parent_id", "spot_id").withColumnRenamed("umi", "y")
    pairs = p.join(y, ["section_id", "spot_id", "gene_id"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    return metrics.error_report(pairs, "section_id").select("section_id", "n", (F.round("max_abs", 5) + F.lit(0.0)).alias("max_abs"))


@query(O + f"SELECT section_id, {F4.format('y')} AS qy, {F4.format('x')} AS qx, min(coalesce(parent_id, -1)) = max(coalesce(parent_id, -1)) AS homogeneous, count(*) AS valid_px FROM valid LEFT JOIN owners USING (section_id, y, x) GROUP BY 1,2,3")
def homogeneous_cells(spark, sf_dir):
    return audit.homogeneous_cells(owners(spark, sf_dir), _valid(spark, sf_dir))


@query(
    WEIGHTED
    + """, g AS (SELECT section_id, qy, qx, gene_id, sum(mass) AS mass FROM mass GROUP BY 1,2,3,4), sh AS (SELECT *, area_px::DOUBLE/sum(area_px) OVER (PARTITION BY section_id, qy, qx) AS share FROM seg)
    SELECT section_id, parent_id, gene_id, round(sum(mass*share) + 1e-9, 5) AS p FROM sh JOIN g USING (section_id, qy, qx) WHERE parent_id >= 0 GROUP BY 1,2,3"""
)
def field_grid(spark, sf_dir):
    out = audit.field_grid(_segments(spark, sf_dir), allocate.to_cells(_mass(spark, sf_dir)))
    return out.withColumn("p", F.round(F.col("p") + 1e-9, 5))


ANCHOR = "an AS (SELECT spot_id, CAST((floor(cy/8.0+0.5)*8-128)/2 AS BIGINT) + dy AS y0, CAST((floor(cx/8.0+0.5)*8-128)/2 AS BIGINT) + dx AS x0, cy, cx FROM spots, (SELECT unnest([-12,0,12]) AS dy), (SELECT unnest([-12,0,12]) AS dx))"


@query(
    with_tables(SPOTS_SQL, ANCHOR)
    + """, p AS (SELECT spot_id, y0, x0, y - y0 AS ly, x - x0 AS lx FROM an, (SELECT unnest(range(0, 256)) AS y), (SELECT unnest(range(0, 256)) AS x) WHERE (2*y+1-cy)*(2*y+1-cy) + (2*x+1-cx)*(2*x+1-cx) <= 2500)
    SELECT spot_id, y0, x0, count(*) AS n, count(*) FILTER (WHERE ly BETWEEN 16 AND 111 AND lx BETWEEN 16 AND 111) AS inside, bool_and(ly BETWEEN 16 AND 111 AND lx BETWEEN 16 AND 111) AS complete FROM p GROUP BY 1,2,3"""
)
def anchor_completeness(spark, sf_dir):
    fields = geometry.anchor_fields(spots(spark, sf_dir))
    p = geometry.circle_pixels(fields, 100.0, GRID, GRID).withColumn("section_id", F.lit(0)).withColumn("ly", F.col("y") - F.col("y0")).withColumn("lx", F.col("x") - F.col("x0"))
    return audit.complete_in_core(p).drop("section_id")


@query(
    with_tables(SPOTS_SQL, ANCHOR)
    + """SELECT CAST(floor(y0/4.0) AS BIGINT) + 6 + i AS qy, CAST(floor(x0/4.0) AS BIGINT) + 6 + j AS qx, round(avg(CAST((y0*3 + x0) % 17 AS DOUBLE)), 6) + 0.0 AS value, count(*) AS coverage
    FROM an, (SELECT unnest(range(0, 20)) AS i), (SELECT unnest(range(0, 20)) AS j) GROUP BY 1,2"""
)
def anchor_means(spark, sf_dir):
    fields = geometry.anchor_fields(spots(spark, sf_dir)).withColumn("section_id", F.lit(0))
    return audit.anchor_means(fields, F.expr("CAST((y0 * 3 + x0) % 17 AS DOUBLE)")).select("qy", "qx", r6("value").alias("value"), "coverage")


@query(OWNED + "SELECT section_id, y, x, parent_id FROM owners WHERE (y + x) % 50 = 0")
def owner_differences(spark, sf_dir):
    """Stored owners lack some pixels; the differences from recomputed ones are exactly those."""
    o = owners(spark, sf_dir)
    return audit.same_owners(o, o.where("(y + x) % 50 <> 0")).select("section_id", "y", "x", "parent_id")
