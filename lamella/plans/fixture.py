"""Spatial tables derived from the given tables by integer arithmetic, and the same derivations as SQL text.

``lineitem`` becomes sparse counts on a 2 um pixel grid of four sections; ``supplier`` becomes spots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators.tasks import spread

GRID = 256  # pixels a side
GENES = 16
#: Panel order: genes 13 to 0, and two that no section measures. Genes 14 and 15 are measured but outside of it.
PANEL = [*range(13, -1, -1), 16, 17]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def native_counts(spark: SparkSession, sf_dir: str, grid: int = GRID) -> DataFrame:
    """(section_id, y, x, gene_id, umi) from line items."""
    key = lambda e, n: F.expr(f"CAST({e} AS BIGINT)").alias(n)
    rows = table(spark, sf_dir, "lineitem").select(
        key("l_suppkey % 4", "section_id"),
        key(f"(l_orderkey * 7 + l_linenumber * 13) % {grid}", "y"),
        key(f"(l_partkey * 11 + l_suppkey * 3) % {grid}", "x"),
        key(f"l_partkey % {GENES}", "gene_id"),
        key("l_quantity", "umi"),
    )
    return rows.groupBy("section_id", "y", "x", "gene_id").agg(F.sum("umi").alias("umi"))


def panel(spark: SparkSession) -> DataFrame:
    """(gene_id, pos): the ordered gene panel."""
    return spark.createDataFrame([(g, i) for i, g in enumerate(PANEL)], "gene_id long, pos int")


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spot_id, cy, cx): spot centres in um on a square lattice of pitch 100, from suppliers."""
    r, k = F.expr("s_suppkey % 5"), F.expr("CAST(floor(s_suppkey / 5.0) AS BIGINT) % 5")
    at = table(spark, sf_dir, "supplier").select((r * 5 + k).cast("long").alias("spot_id"), (56 + 100 * r).cast("long").alias("cy"), (56 + 100 * k).cast("long").alias("cx"))
    return at.distinct()


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section_id, y, x, parent_id): pixels of circular parents (55 um spots); pixels outside have no row."""
    from lamella.operators import geometry

    # A projection of the lines, not of their counts: no aggregate is needed to know the sections.
    sections = table(spark, sf_dir, "lineitem").select(F.expr("CAST(l_suppkey % 4 AS BIGINT)").alias("section_id")).distinct()
    pixels = geometry.circle_pixels(spots(spark, sf_dir), 55.0, GRID, GRID)
    return sections.crossJoin(F.broadcast(pixels)).select("section_id", "y", "x", F.col("spot_id").alias("parent_id"))


WIDE = 768  # pixels a side of sections whose number grows with the table
WIDE_GENES = 4


def wide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section_id, y, x, gene_id, umi) of 768-pixel sections, one for every nine suppliers, not yet summed by pixel."""
    key = lambda e, n: F.expr(f"CAST({e} AS BIGINT)").alias(n)
    return table(spark, sf_dir, "lineitem").select(
        key("floor(l_suppkey / 9.0D)", "section_id"),
        key(f"(l_orderkey * 7 + l_linenumber * 13) % {WIDE}", "y"),
        key(f"(l_partkey * 11 + l_orderkey * 3) % {WIDE}", "x"),
        key(f"l_partkey % {WIDE_GENES}", "gene_id"),
        key("l_quantity", "umi"),
    )


def wide_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section_id, y, x, gene_id, umi) of 768-pixel sections, one for every nine suppliers."""
    rows = wide_lines(spark, sf_dir)
    # Lines hardly ever share a pixel and gene: they are dealt out at once, into tasks that stay small as the table grows.
    rows = spread(rows, rows.count(), 250_000, "section_id", "y", "x")
    return rows.groupBy("section_id", "y", "x", "gene_id").agg(F.sum("umi").alias("umi"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section_id, spot_id, cy, cx): one 100 um anchor for every supplier, nine a section at a pitch of about 150 um."""
    at = lambda e, n: F.expr(f"CAST({e} AS BIGINT)").alias(n)
    return table(spark, sf_dir, "supplier").select(
        at("floor(s_suppkey / 9.0D)", "section_id"), at("s_suppkey", "spot_id"), at("300 + 150 * floor((s_suppkey % 9) / 3.0D) + s_suppkey * 7 % 5", "cy"), at("300 + 150 * (s_suppkey % 3) + s_suppkey * 5 % 7", "cx")
    )


WIDE_SQL = f"""wide_counts AS (
  SELECT CAST(floor(l_suppkey / 9.0::DOUBLE) AS BIGINT) AS section_id, CAST((l_orderkey * 7 + l_linenumber * 13) % {WIDE} AS BIGINT) AS y,
         CAST((l_partkey * 11 + l_orderkey * 3) % {WIDE} AS BIGINT) AS x, CAST(l_partkey % {WIDE_GENES} AS BIGINT) AS gene_id,
         CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS umi
  FROM lineitem GROUP BY 1, 2, 3, 4)"""
ANCHORS_SQL = """anchors AS (
  SELECT CAST(floor(s_suppkey / 9.0::DOUBLE) AS BIGINT) AS section_id, CAST(s_suppkey AS BIGINT) AS spot_id,
         CAST(300 + 150 * floor((s_suppkey % 9) / 3.0::DOUBLE) + s_suppkey * 7 % 5 AS BIGINT) AS cy, CAST(300 + 150 * (s_suppkey % 3) + s_suppkey * 5 % 7 AS BIGINT) AS cx FROM supplier)"""

NATIVE_SQL = f"""native_counts AS (
  SELECT CAST(l_suppkey % 4 AS BIGINT) AS section_id, CAST((l_orderkey * 7 + l_linenumber * 13) % {GRID} AS BIGINT) AS y,
         CAST((l_partkey * 11 + l_suppkey * 3) % {GRID} AS BIGINT) AS x, CAST(l_partkey % {GENES} AS BIGINT) AS gene_id,
         CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS umi
  FROM lineitem GROUP BY 1, 2, 3, 4)"""
PANEL_SQL = "panel AS (SELECT CAST(g AS BIGINT) AS gene_id, CAST(i - 1 AS INTEGER) AS pos FROM (SELECT unnest(" + str(PANEL) + ") AS g, unnest(range(1, 17)) AS i))"
SPOTS_SQL = """spots AS (
  SELECT DISTINCT CAST(r * 5 + k AS BIGINT) AS spot_id, CAST(56 + 100 * r AS BIGINT) AS cy, CAST(56 + 100 * k AS BIGINT) AS cx
  FROM (SELECT s_suppkey % 5 AS r, CAST(floor(s_suppkey / 5.0) AS BIGINT) % 5 AS k FROM supplier))"""
PIXELS_SQL = f"pixels AS (SELECT y, x FROM (SELECT unnest(range(0, {GRID})) AS y), (SELECT unnest(range(0, {GRID})) AS x))"
CIRCLE_SQL = "circle AS (SELECT spot_id, y, x FROM spots JOIN pixels ON (2*y+1-cy)*(2*y+1-cy) + (2*x+1-cx)*(2*x+1-cx) <= 756.25)"
SECTIONS_SQL = "sections AS (SELECT DISTINCT section_id FROM native_counts)"
OWNERS_SQL = "owners AS (SELECT section_id, y, x, spot_id AS parent_id FROM sections, circle)"


def with_tables(*ctes: str) -> str:
    """WITH clause of the derived tables named, in order."""
    return "WITH " + ",\n".join(ctes) + "\n"
