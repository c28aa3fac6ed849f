"""Queries over image tables. Pixels come from line items: colours from prices, places from keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lamella.operators import geometry, image
from lamella.plans.count_queries import F4, F8, N, OWNED
from lamella.plans.fixture import GRID, PIXELS_SQL, native_counts, owners, table, with_tables
from lamella.plans.registry import query, r6

SIDE = 128
IMG = f"""img AS (SELECT CAST(l_suppkey % 4 AS BIGINT) AS section_id, CAST((l_orderkey * 5 + l_linenumber) % {SIDE} AS BIGINT) AS py, CAST((l_partkey * 3 + l_linenumber * 7) % {SIDE} AS BIGINT) AS px,
  CAST(max(l_quantity * 5) AS INTEGER) AS r, CAST(min(l_quantity * 4 + 40) AS INTEGER) AS g, CAST(max(l_linenumber * 30) AS INTEGER) AS b FROM lineitem GROUP BY 1,2,3)"""
I = with_tables(IMG)
# The inverse of the published stain matrix, by numpy and from its own literal values.
_ROWS = np.array([[0.650, 0.704, 0.286], [0.072, 0.990, 0.105], [0.268, 0.570, 0.776]])
MATRIX = np.linalg.inv(_ROWS / np.linalg.norm(_ROWS, axis=1, keepdims=True)).tolist()
OD = [f"(-ln(({c} + 1.0::DOUBLE)/256))" for c in "rgb"]
DENS = f"""dens AS (SELECT section_id, py, px, ({OD[0]} + {OD[1]} + {OD[2]})/3 AS od,
  greatest({' + '.join(f'{OD[i]}*({MATRIX[i][0]!r}::DOUBLE)' for i in range(3))}, 0) AS h, greatest({' + '.join(f'{OD[i]}*({MATRIX[i][1]!r}::DOUBLE)' for i in range(3))}, 0) AS e FROM img)"""
D = with_tables(IMG, DENS)


def _pixels(spark, sf_dir):
    key = lambda e, n: F.expr(f"CAST({e} AS BIGINT)").alias(n)
    rows = table(spark, sf_dir, "lineitem").select(key("l_suppkey % 4", "section_id"), key(f"(l_orderkey * 5 + l_linenumber) % {SIDE}", "py"), key(f"(l_partkey * 3 + l_linenumber * 7) % {SIDE}", "px"), "l_quantity", "l_linenumber")
    return rows.groupBy("section_id", "py", "px").agg(F.max(F.col("l_quantity") * 5).cast("int").alias("r"), F.min(F.col("l_quantity") * 4 + 40).cast("int").alias("g"), F.max(F.col("l_linenumber") * 30).cast("int").alias("b"))


def _density(spark, sf_dir):
    return _pixels(spark, sf_dir).select("section_id", "py", "px", *image.stain_density(F.col("r"), F.col("g"), F.col("b")))


@query(D + "SELECT section_id, py, px, round(od, 6) + 0.0 AS od, round(h, 6) + 0.0 AS h, round(e, 6) + 0.0 AS e FROM dens")
def stain_density(spark, sf_dir):
    return _density(spark, sf_dir).select("section_id", "py", "px", r6("od").alias("od"), r6("h").alias("h"), r6("e").alias("e"))


@query(I + f"SELECT s.section_id, y AS py, x AS px, coalesce(r, 255) AS r, coalesce(g, 255) AS g, coalesce(b, 255) AS b FROM (SELECT DISTINCT section_id FROM img) s, (SELECT unnest(range(-4, 60)) AS y), (SELECT unnest(range(100, 140)) AS x) LEFT JOIN img i ON i.section_id = s.section_id AND i.py = y AND i.px = x")
def padded_region(spark, sf_dir):
    pixels = _pixels(spark, sf_dir)
    long = lambda v: F.lit(v).cast("long")
    grid = pixels.select("section_id").distinct().withColumn("py", geometry.span(long(-4), long(60))).withColumn("px", geometry.span(long(100), long(140)))
    return image.region(pixels, grid).select("section_id", "py", "px", "r", "g", "b")


T = [[0.45, 0.02, 1.5], [-0.01, 0.47, 3.25], [0.0, 0.0, 1.0]]
CELLS = f"cells AS (SELECT DISTINCT section_id, {F4.format('y')} AS qy, {F4.format('x')} AS qx FROM native_counts)"


def _cells(spark, sf_dir):
    return native_counts(spark, sf_dir).select("section_id", geometry.down("y", 4).alias("qy"), geometry.down("x", 4).alias("qx")).distinct()


def _x(x, y):
    return f"({T[0][0]}::DOUBLE*({x}) + {T[0][1]}::DOUBLE*({y}) + {T[0][2]}::DOUBLE)"


def _y(x, y):
    return f"({T[1][0]}::DOUBLE*({x}) + {T[1][1]}::DOUBLE*({y}) + {T[1][2]}::DOUBLE)"


ENDS = [(f"(qx+{b})*8.0::DOUBLE", f"(qy+{a})*8.0::DOUBLE") for a in (0, 1) for b in (0, 1)]


@query(N.rstrip() + ",\n" + CELLS + " SELECT * FROM cells WHERE " + " AND ".join(f"{f(*e)} >= -0.5 AND {f(*e)} < 127.5" for e in ENDS for f in (_x, _y)))
def image_supported_cells(spark, sf_dir):
    return image.full_support(_cells(spark, sf_dir), T, SIDE, SIDE)


@query(N.rstrip() + ",\n" + CELLS + " SELECT section_id, qy, qx, " + ", ".join(f"round({g}({', '.join(f(*e) for e in ENDS)}), 6) + 0.0 AS \"{n}\"" for n, g, f in (("top", "least", _y), ("bottom", "greatest", _y), ("left", "least", _x), ("right", "greatest", _x))) + " FROM cells")
def mapped_bounds(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    box = image.mapped_bounds(T, F.col("qy") * 8.0, F.col("qx") * 8.0, 8.0)
    return cells.select("section_id", "qy", "qx", *box).select("section_id", "qy", "qx", *[r6(c).alias(c) for c in ("top", "bottom", "left", "right")])


@query(with_tables(PIXELS_SQL) + "SELECT y, x, round((y*2+1 - 1.5::DOUBLE)/4, 6) + 0.0 AS cy, round((x*2+1 - 1.5::DOUBLE)/4, 6) + 0.0 AS cx FROM pixels JOIN (SELECT DISTINCT CAST((l_orderkey * 7 + l_linenumber * 13) % 256 AS BIGINT) AS y FROM lineitem) USING (y)")
def unprojected_pixels(spark, sf_dir):
    """Image positions back to the capture through the inverse registration."""
    inverse = geometry.invert([[4.0, 0.0, 1.5], [0.0, 4.0, 1.5], [0.0, 0.0, 1.0]])
    rows = native_counts(spark, sf_dir).select("y").distinct().withColumn("x", geometry.span(F.lit(0).cast("long"), F.lit(GRID).cast("long")))
    cx, cy = geometry.project(inverse, F.col("x") * 2.0 + 1, F.col("y") * 2.0 + 1)
    return rows.select("y", "x", r6(cy).alias("cy"), r6(cx).alias("cx"))


S = "(SELECT unnest(range(0, 8)) AS i), (SELECT unnest(range(0, 8)) AS j)"
DENSITY = (
    N.rstrip()
    + ",\n"
    + IMG
    + ",\n"
    + DENS
    + ",\n"
    + CELLS
    + f""", smp AS (SELECT section_id, qy, qx, {_y('(qx+(j+0.5)/8)*8', '(qy+(i+0.5)/8)*8')} AS v, {_x('(qx+(j+0.5)/8)*8', '(qy+(i+0.5)/8)*8')} AS u FROM cells, {S}),
    ins AS (SELECT section_id, qy, qx, greatest(0, least(v, 127)) AS v, greatest(0, least(u, 127)) AS u FROM smp WHERE v >= -0.5 AND v < 127.5 AND u >= -0.5 AND u < 127.5),
    cor AS (SELECT section_id, qy, qx, CAST(floor(v) AS BIGINT) + a AS py, CAST(floor(u) AS BIGINT) + b AS px, (CASE WHEN a = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END)*(CASE WHEN b = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) AS w
      FROM ins, (SELECT unnest([0,1]) AS a), (SELECT unnest([0,1]) AS b)),
    agg AS (SELECT section_id, qy, qx, sum(w) AS n, sum(od*w) AS od, sum(h*w) AS h, sum(e*w) AS e FROM cor JOIN dens USING (section_id, py, px) WHERE w > 0 GROUP BY 1,2,3),
    cd AS (SELECT c.section_id, c.qy, c.qx, coalesce(n, 0)/64 AS area, coalesce(od/n, 0) AS od, coalesce(h/n, 0) AS h, coalesce(e/n, 0) AS e FROM cells c LEFT JOIN agg a ON a.section_id = c.section_id AND a.qy = c.qy AND a.qx = c.qx)
    """
)


def _cell_density(spark, sf_dir):
    return image.cell_density(_cells(spark, sf_dir), _density(spark, sf_dir), T, SIDE, SIDE)


@query(DENSITY + "SELECT section_id, qy, qx, round(area + 1e-9, 6) AS area, round(od + 1e-9, 6) AS od, round(h + 1e-9, 6) AS h, round(e + 1e-9, 6) AS e FROM cd")
def cell_density(spark, sf_dir):
    return _cell_density(spark, sf_dir).select("section_id", "qy", "qx", *[r6(F.col(c) + 1e-9).alias(c) for c in ("area", "od", "h", "e")])


@query(DENSITY + "SELECT section_id, qy, qx, CAST(round_even(round(area, 9)*65535, 0) AS INTEGER) AS area FROM cd")
def quantized_area(spark, sf_dir):
    return _cell_density(spark, sf_dir).select("section_id", "qy", "qx", image.quantized(F.round("area", 9)).alias("area"))


CH = ", ".join(
    f"round(CASE WHEN f THEN ln(1+{v}) ELSE 0 END, 5) + 0.0 AS log_{v}, round(CASE WHEN f THEN greatest(-5, least(5, ln(({v}+1e-6)/(sum({v}*area) OVER w/greatest(sum(area) OVER w, 1e-12)+1e-6)))) ELSE 0 END, 5) + 0.0 AS ratio_{v}" for v in ("od", "h", "e")
)


@query(DENSITY + f", q AS (SELECT *, area > 0.35 AS f0 FROM cd), z AS (SELECT section_id, qy, qx, od, h, e, CASE WHEN f0 THEN 1.0::DOUBLE ELSE 0 END AS area, f0 AS f FROM q) SELECT section_id, qy, qx, {CH} FROM z WINDOW w AS (PARTITION BY section_id)")
def image_channels(spark, sf_dir):
    d = _cell_density(spark, sf_dir).withColumn("area", (F.col("area") > 0.35).cast("double"))
    c = image.channels(d, ["section_id"])
    return c.select("section_id", "qy", "qx", *[(F.round(n, 5) + F.lit(0.0)).alias(n) for v in ("od", "h", "e") for n in (f"log_{v}", f"ratio_{v}")])


VAL = "val AS (SELECT section_id, y, x, CAST(sum(umi) AS DOUBLE) AS v, bool_and(umi % 7 <> 0) AS valid FROM native_counts GROUP BY 1,2,3)"


def _values(spark, sf_dir):
    return native_counts(spark, sf_dir).groupBy("section_id", "y", "x").agg(F.sum("umi").cast("double").alias("v"), F.bool_and(F.col("umi") % 7 != 0).alias("valid"))


@query(N.rstrip() + ",\n" + VAL + f" SELECT section_id, {F4.format('y')} AS y, {F4.format('x')} AS x, round(coalesce(avg(v) FILTER (WHERE valid), -1), 6) + 0.0 AS v, bool_and(valid) AND count(*) = 16 AS valid FROM val GROUP BY 1,2,3")
def masked_pooling(spark, sf_dir):
    return image.pooled(_values(spark, sf_dir), 4, "v", "valid").withColumn("v", r6(F.coalesce("v", F.lit(-1.0))))


@query(N.rstrip() + ",\n" + VAL + ", b AS (SELECT section_id, y + a AS y, x + b AS x, v FROM val, (SELECT unnest(range(-1, 2)) AS a), (SELECT unnest(range(-1, 2)) AS b)) SELECT section_id, y, x, round(sum(v)/9, 6) + 0.0 AS v FROM b WHERE y BETWEEN 0 AND 255 AND x BETWEEN 0 AND 255 GROUP BY 1,2,3")
def box_means(spark, sf_dir):
    return image.box_mean(_values(spark, sf_dir), "v", 3, GRID, GRID).withColumn("v", r6("v"))


@query(OWNED.rstrip() + ",\n" + VAL + " SELECT section_id, y, x, parent_id, round(avg(v) OVER (PARTITION BY section_id, parent_id), 6) + 0.0 AS mean, round(v - avg(v) OVER (PARTITION BY section_id, parent_id), 6) + 0.0 AS centred FROM val JOIN owners USING (section_id, y, x)")
def parent_centring(spark, sf_dir):
    out = image.parent_means(_values(spark, sf_dir), owners(spark, sf_dir), "v")
    return out.select("section_id", "y", "x", "parent_id", r6("mean").alias("mean"), r6("centred").alias("centred"))


@query(N.rstrip() + ",\n" + f"t AS (SELECT DISTINCT section_id, y, x FROM native_counts) SELECT section_id, {F4.format('y')} AS qy, {F4.format('x')} AS qx FROM t GROUP BY 1,2,3 HAVING count(*) >= 8")
def tissue_majority(spark, sf_dir):
    return image.tissue_majority(native_counts(spark, sf_dir).select("section_id", "y", "x").distinct())


@query(OWNED + f"SELECT section_id, {F8.format('y')} AS py, {F8.format('x')} AS px FROM owners GROUP BY 1,2,3 HAVING count(*) = 64")
def complete_squares(spark, sf_dir):
    return image.complete(owners(spark, sf_dir), 8, ("py", "px"))


COARSE = f"coarse AS (SELECT section_id, {F8.format('y')} AS cy, {F8.format('x')} AS cx, avg(v) AS v, bool_or(valid) AS valid FROM val GROUP BY 1,2,3)"


@query(
    N.rstrip()
    + ",\n"
    + VAL
    + ",\n"
    + COARSE
    + """, c AS (SELECT section_id, y, x, (y+0.5::DOUBLE)/8-0.5 AS p, (x+0.5::DOUBLE)/8-0.5 AS q FROM val),
    k AS (SELECT section_id, y, x, CAST(floor(p) AS BIGINT)+a AS cy, CAST(floor(q) AS BIGINT)+b AS cx, (CASE WHEN a=1 THEN p-floor(p) ELSE 1-(p-floor(p)) END)*(CASE WHEN b=1 THEN q-floor(q) ELSE 1-(q-floor(q)) END) AS w FROM c, (SELECT unnest([0,1]) AS a), (SELECT unnest([0,1]) AS b))
    SELECT section_id, y, x, round(sum(w*v)/sum(w) + 1e-9, 6) AS v FROM k JOIN coarse USING (section_id, cy, cx) WHERE valid GROUP BY 1,2,3"""
)
def masked_resize(spark, sf_dir):
    v = _values(spark, sf_dir)
    coarse = v.groupBy("section_id", geometry.down("y", 8).alias("cy"), geometry.down("x", 8).alias("cx")).agg(F.avg("v").alias("v"), F.bool_or("valid").alias("valid"))
    return image.resized(coarse, v.select("section_id", "y", "x"), 8, "v", "valid").withColumn("v", r6(F.col("v") + 1e-9))


@query(I + "SELECT section_id, CAST(floor(py/32.0)*100 + floor(px/32.0) AS BIGINT) AS field_id, round(avg(CAST(r AS DOUBLE)), 6) + 0.0 AS mean, count(*) > 100 AS valid FROM img GROUP BY 1,2")
def user_embedding(spark, sf_dir):
    """A user's encoder over fields of 32 x 32 pixels: here the mean of the red channel."""
    p = _pixels(spark, sf_dir).withColumn("field_id", geometry.down("py", 32) * 100 + geometry.down("px", 32))
    fields = p.groupBy("section_id", "field_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("py", "px", "r"))), lambda s: s["r"]).alias("values"))
    return image.embedded(fields, lambda v: (v.map(lambda x: [float(x.mean())]), v.map(len) > 100)).select("section_id", "field_id", r6(F.col("features")[0]).alias("mean"), "valid")
