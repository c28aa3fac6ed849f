"""Queries over anchored sections; sections, anchors and fields grow with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella import jobs
from lamella.operators import anchors, neighbors
from lamella.operators.tasks import dealt
from lamella.plans.count_queries import F4
from lamella.plans.fixture import ANCHORS_SQL, WIDE, WIDE_SQL, wide_counts, with_tables
from lamella.plans.fixture import anchors as centers
from lamella.plans.registry import query, r6

FIELD = """fields AS (SELECT section_id, spot_id, cy, cx, CAST((floor(cy/8.0::DOUBLE + 0.5)*8 - 128)/2 AS BIGINT) + dy AS y0, CAST((floor(cx/8.0::DOUBLE + 0.5)*8 - 128)/2 AS BIGINT) + dx AS x0
  FROM anchors, (SELECT unnest([-12, 0, 12]) AS dy), (SELECT unnest([-12, 0, 12]) AS dx))"""
CORE = """core AS (SELECT section_id, spot_id, y0, x0, CAST(floor(y0/4.0::DOUBLE) AS BIGINT) + 6 + i AS qy, CAST(floor(x0/4.0::DOUBLE) AS BIGINT) + 6 + j AS qx
  FROM fields, (SELECT unnest(range(0, 20)) AS i), (SELECT unnest(range(0, 20)) AS j))"""
CIRCLE = f"""disc AS (SELECT section_id, spot_id, y, x FROM (SELECT *, unnest(range(CAST(floor((cy - 52)/2.0) AS BIGINT), CAST(floor((cy + 52)/2.0) AS BIGINT))) AS y FROM anchors),
    (SELECT unnest(range(0, {WIDE})) AS x) WHERE x BETWEEN cx/2 - 27 AND cx/2 + 27 AND (2*y+1-cy)*(2*y+1-cy) + (2*x+1-cx)*(2*x+1-cx) <= 2500),
  area AS (SELECT section_id, spot_id, {F4.format('y')} AS qy, {F4.format('x')} AS qx, count(*) AS area_px FROM disc GROUP BY 1, 2, 3, 4)"""
BASE = with_tables(ANCHORS_SQL, WIDE_SQL, FIELD, CORE, CIRCLE).rstrip()


@query(with_tables(ANCHORS_SQL, FIELD) + "SELECT section_id, spot_id, y0, x0 FROM fields")
def anchored_fields(spark, sf_dir):
    """Nine fields around every anchor."""
    return anchors.anchored_fields(centers(spark, sf_dir), WIDE, WIDE).select("section_id", "spot_id", "y0", "x0")


@query(
    BASE
    + """, cov AS (SELECT section_id, qy, qx, count(*) AS coverage FROM core GROUP BY 1, 2, 3),
    cl AS (SELECT section_id, qy, qx, CASE WHEN min(spot_id) = max(spot_id) THEN min(spot_id) ELSE -2 END AS spot_id, CASE WHEN min(spot_id) = max(spot_id) THEN CAST(sum(area_px) AS BIGINT) ELSE 0 END AS area_px FROM area GROUP BY 1, 2, 3)
    SELECT section_id, qy, qx, coverage, coalesce(spot_id, -1) AS spot_id, coalesce(area_px, 0) AS area_px FROM cov LEFT JOIN cl USING (section_id, qy, qx)"""
)
def anchor_coverage(spark, sf_dir):
    """Exported cells: how many cores hold each, and the anchor that claims it."""
    return jobs.prepare_anchors(centers(spark, sf_dir), (WIDE, WIDE))[1]


OBSERVED = """genes AS (SELECT DISTINCT section_id, gene_id FROM wide_counts),
  obs AS (SELECT a.section_id, a.spot_id, g.gene_id, CAST(coalesce(umi, 0) AS BIGINT) AS umi FROM anchors a JOIN genes g USING (section_id)
    LEFT JOIN (SELECT section_id, spot_id, gene_id, sum(umi) AS umi FROM disc JOIN wide_counts USING (section_id, y, x) GROUP BY 1, 2, 3) s USING (section_id, spot_id, gene_id))"""
VALUES = (
    BASE
    + f""", {OBSERVED},
  w AS (SELECT c.section_id, c.spot_id, y0, x0, c.qy, c.qx, gene_id, umi, coalesce(area_px, 0) AS a, CAST(1 + (c.qy*3 + c.qx*5 + gene_id + y0 + 3*x0) % 4 AS DOUBLE) AS p
    FROM core c JOIN obs USING (section_id, spot_id) LEFT JOIN area r ON r.section_id = c.section_id AND r.spot_id = c.spot_id AND r.qy = c.qy AND r.qx = c.qx),
  m AS (SELECT *, sum(a*p) OVER f AS total, sum(a) OVER f AS whole FROM w WINDOW f AS (PARTITION BY section_id, spot_id, y0, x0, gene_id)),
  v AS (SELECT section_id, qy, qx, gene_id, umi*a*p/total + umi*(16 - a)*p/whole AS value FROM m),
  grid AS (SELECT section_id, qy, qx, gene_id, avg(value) AS value, count(*) AS coverage FROM v GROUP BY 1, 2, 3, 4)"""
)


def _observed(spark, sf_dir):
    """Counts of the anchors' circles, zeros included for the genes that their section measured."""
    c, at = wide_counts(spark, sf_dir), centers(spark, sf_dir)
    # Counts meet circles by the grid cells around each, so that a count is dealt out once and no circle as its pixels.
    pixels = c.select("section_id", (2 * F.col("y") + 1).alias("oy"), (2 * F.col("x") + 1).alias("ox"), "gene_id", "umi")
    found = neighbors.within(at, pixels, anchors.DIAMETER / 2).groupBy("section_id", "spot_id", "gene_id").agg(F.sum("umi").alias("umi"))
    asked = at.select("section_id", "spot_id").join(dealt(c.select("section_id", "gene_id").distinct()), "section_id")
    return asked.join(dealt(found), ["section_id", "spot_id", "gene_id"], "left").withColumn("umi", F.coalesce("umi", F.lit(0)))


def _section(spark, sf_dir):
    prior = (1 + (F.col("qy") * 3 + F.col("qx") * 5 + F.col("gene_id") + F.col("y0") + 3 * F.col("x0")) % 4).cast("double")
    at, known = centers(spark, sf_dir), _observed(spark, sf_dir)
    measured = at.join(known.select("section_id").distinct(), "section_id", "left_semi")
    return measured, known, jobs.predict_anchors(measured, known, prior, (WIDE, WIDE))


@query(VALUES + " SELECT section_id, qy, qx, gene_id, round(value + 1e-9, 5) AS value, coverage FROM grid")
def anchored_section(spark, sf_dir):
    """Every field allocates its anchor's counts; cells take the mean of all cores that hold them."""
    return _section(spark, sf_dir)[2].withColumn("value", F.round(F.col("value") + 1e-9, 5))


@query(
    VALUES
    + """, s AS (SELECT section_id, spot_id, gene_id, sum(area_px/16.0::DOUBLE*value) AS p FROM area JOIN grid USING (section_id, qy, qx) GROUP BY 1, 2, 3)
    SELECT section_id, count(*) AS n, round(max(abs(p - umi)), 4) + 0.0 AS max_abs, round(max(abs(p - umi)/(1 + umi)), 5) + 0.0 AS max_scaled, round(max(CASE WHEN umi > 0 THEN abs(p - umi)/umi END), 5) + 0.0 AS max_relative,
      bool_and(abs(p - umi) <= 1e-5 + 1e-5*umi) AS within, count(DISTINCT spot_id) AS spots FROM obs JOIN s USING (section_id, spot_id, gene_id) GROUP BY 1"""
)
def saved_grid_check(spark, sf_dir):
    """Circles summed up again from the grid against what was observed."""
    at, known, grid = _section(spark, sf_dir)
    r = anchors.saved_grid_report(at, grid, known, WIDE, WIDE)
    return r.withColumn("max_abs", F.round("max_abs", 4) + F.lit(0.0)).withColumn("max_scaled", F.round("max_scaled", 5) + F.lit(0.0)).withColumn("max_relative", F.round("max_relative", 5) + F.lit(0.0))


@query(VALUES + ", c AS (SELECT section_id, spot_id, y0, x0, gene_id, sum(umi*a*p/total) AS p, any_value(umi) AS y FROM m GROUP BY 1, 2, 3, 4, 5) SELECT section_id, count(*) AS n, round(max(abs(p - y)/(1 + y)), 6) + 0.0 AS max_scaled FROM c GROUP BY 1")
def anchor_conservation(spark, sf_dir):
    """What every single field gives back of its anchor's counts."""
    prior = (1 + (F.col("qy") * 3 + F.col("qx") * 5 + F.col("gene_id") + F.col("y0") + 3 * F.col("x0")) % 4).cast("double")
    at, known = centers(spark, sf_dir), _observed(spark, sf_dir)
    fields = jobs.prepare_anchors(at.join(known.select("section_id").distinct(), "section_id", "left_semi"), (WIDE, WIDE))[0]
    return jobs.anchor_conservation(fields, known, prior, (WIDE, WIDE)).withColumn("max_scaled", r6("max_scaled"))
