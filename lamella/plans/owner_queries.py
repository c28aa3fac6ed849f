"""Queries over ownership, segments, allocation and neighbours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamella import jobs
from lamella.operators import allocate, counts, geometry, metrics, neighbors
from lamella.operators import owners as own
from lamella.plans.count_queries import F4, N, OWNED, SUM
from lamella.plans.fixture import GRID, PIXELS_SQL, native_counts, owners, spots, with_tables  # noqa: F401
from lamella.plans.registry import query, r6

#: Pixels with a measured count anywhere in the section's column and row pattern count as valid tissue.
VALID = "valid AS (SELECT section_id, y, x FROM sections, pixels WHERE (y * 31 + x * 17 + section_id * 7) % 97 <> 0)"
SEG = f"""seg AS (SELECT section_id, coalesce(parent_id, -1) AS parent_id, {F4.format('y')} AS qy, {F4.format('x')} AS qx, count(*) AS area_px,
  avg(y - {F4.format('y')}*4 - 1.5) AS off_y, avg(x - {F4.format('x')}*4 - 1.5) AS off_x FROM valid LEFT JOIN owners USING (section_id, y, x) GROUP BY 1,2,3,4)"""
O = OWNED.rstrip() + ",\n" + VALID + ",\n" + SEG + "\n"


def _valid(spark, sf_dir):
    sections = native_counts(spark, sf_dir).select("section_id").distinct()
    pixels = spark.range(GRID * GRID).select(F.floor(F.col("id") / GRID).cast("long").alias("y"), (F.col("id") % GRID).alias("x"))
    return sections.join(F.broadcast(pixels), F.expr("(y * 31 + x * 17 + section_id * 7) % 97 <> 0"))


def _segments(spark, sf_dir):
    return own.segments(owners(spark, sf_dir), _valid(spark, sf_dir))


def _counts(spark, sf_dir):
    return counts.owned(native_counts(spark, sf_dir), owners(spark, sf_dir))


GEOMETRY = OWNED + """, e AS (SELECT o.section_id, o.parent_id, count(*) AS perimeter FROM owners o, (SELECT unnest([-1,1,0,0]) AS a, unnest([0,0,-1,1]) AS b) s
           WHERE NOT EXISTS (SELECT 1 FROM owners n WHERE n.section_id = o.section_id AND n.y = o.y + s.a AND n.x = o.x + s.b AND n.parent_id = o.parent_id) GROUP BY 1,2),
         b AS (SELECT section_id, parent_id, count(*) AS area, avg(y) AS cy, avg(x) AS cx, max(y)-min(y)+1 AS height, max(x)-min(x)+1 AS width FROM owners GROUP BY 1,2)"""


@query(
    GEOMETRY
    + """ SELECT section_id, parent_id, area, round(cy, 6) + 0.0 AS cy, round(cx, 6) + 0.0 AS cx, height, width, perimeter, round(4*pi()*area/(perimeter*perimeter), 6) + 0.0 AS compactness, round(area/(height*width), 6) + 0.0 AS fill FROM b JOIN e USING (section_id, parent_id)"""
)
def parent_geometry(spark, sf_dir):
    g = own.parent_geometry(owners(spark, sf_dir))
    return g.select("section_id", "parent_id", "area", r6("cy").alias("cy"), r6("cx").alias("cx"), "height", "width", "perimeter", r6("compactness").alias("compactness"), r6("fill").alias("fill"))


@query(
    GEOMETRY
    + f""" SELECT section_id, parent_id, round(((cy + 0.5)*2 - {GRID})/{GRID}, 6) + 0.0 AS at_y, round(((cx + 0.5)*2 - {GRID})/{GRID}, 6) + 0.0 AS at_x, round(ln(area), 6) + 0.0 AS log_area,
         round(ln(height), 6) + 0.0 AS log_height, round(ln(width), 6) + 0.0 AS log_width, round(4*pi()*area/(perimeter*perimeter), 6) + 0.0 AS compactness, round(area/(height*width), 6) + 0.0 AS fill FROM b JOIN e USING (section_id, parent_id)"""
)
def parent_features(spark, sf_dir):
    f = own.parent_features(own.parent_geometry(owners(spark, sf_dir)), GRID, GRID)
    return f.select("section_id", "parent_id", *[r6(c).alias(c) for c in f.columns[2:]])


@query(O + "SELECT section_id, parent_id, qy, qx, area_px FROM seg")
def segment_layout(spark, sf_dir):
    return _segments(spark, sf_dir).select("section_id", "parent_id", "qy", "qx", "area_px")


@query(
    O
    + """SELECT s.section_id, s.parent_id, qy, qx, round(ln(1 + s.area_px), 6) + 0.0 AS log_area, round(s.area_px/16.0::DOUBLE, 6) AS cell_share, round(off_y/4, 6) + 0.0 AS at_y, round(off_x/4, 6) + 0.0 AS at_x, qy % 2 AS group_y, qx % 2 AS group_x,
         s.parent_id < 0 AS gap, round(coalesce(s.area_px::DOUBLE/a.area, 0), 6) + 0.0 AS parent_share FROM seg s LEFT JOIN (SELECT section_id, parent_id, count(*) AS area FROM owners GROUP BY 1,2) a ON a.section_id = s.section_id AND a.parent_id = s.parent_id"""
)
def segment_features(spark, sf_dir):
    area = owners(spark, sf_dir).groupBy("section_id", "parent_id").agg(F.count("*").alias("area"))
    f = own.segment_features(_segments(spark, sf_dir), area)
    return f.select("section_id", "parent_id", "qy", "qx", *[r6(c).alias(c) for c in ("log_area", "cell_share", "at_y", "at_x", "parent_share")], "group_y", "group_x", "gap")


@query(
    O
    + f"""SELECT section_id, {F4.format('y')} AS qy, {F4.format('x')} AS qx, CASE WHEN count(*) < 16 THEN 'invalid' WHEN count(parent_id) = 0 THEN 'gap' WHEN min(parent_id) <> max(parent_id) THEN 'multi' WHEN count(parent_id) < count(*) THEN 'boundary' ELSE 'single' END AS kind
          FROM valid LEFT JOIN owners USING (section_id, y, x) GROUP BY 1,2,3"""
)
def cell_classes(spark, sf_dir):
    return own.cell_classes(owners(spark, sf_dir), _valid(spark, sf_dir))


@query(O + "SELECT section_id, qy, qx, CASE WHEN min(parent_id) >= 0 THEN 'covered' WHEN max(parent_id) < 0 THEN 'gap' ELSE 'mixed' END AS region FROM seg GROUP BY 1,2,3")
def region_classes(spark, sf_dir):
    return own.region_classes(_segments(spark, sf_dir))


@query(OWNED + "SELECT section_id, parent_id, count(*) AS area FROM owners GROUP BY 1,2 HAVING bool_and(y BETWEEN 32 AND 223 AND x BETWEEN 32 AND 223)")
def parents_inside_core(spark, sf_dir):
    return own.inside_core(owners(spark, sf_dir), 32, 224)


@query(
    O
    + """SELECT (SELECT count(*) FROM owners WHERE parent_id >= 24) AS unknown_parent,
         (SELECT count(*) FROM owners ANTI JOIN valid USING (section_id, y, x)) AS invalid_pixel,
         CAST((SELECT count(*) FROM sections) AS BIGINT) AS empty_parent, (SELECT count(DISTINCT (section_id, parent_id)) FROM owners WHERE parent_id = 3) AS padded_parent"""
)
def owner_rule_faults(spark, sf_dir):
    """Parents 0-23 are listed, 3 as padding, and a parent 99 without pixels as valid."""
    o = owners(spark, sf_dir)
    listed = o.select("section_id", "parent_id").distinct().where("parent_id < 24").withColumn("valid", F.col("parent_id") != 3)
    extra = o.select("section_id").distinct().select("section_id", F.lit(99).cast("long").alias("parent_id"), F.lit(True).alias("valid"))
    return own.rule_faults(o, listed.unionByName(extra), _valid(spark, sf_dir))


SPLIT = "split AS (SELECT section_id, y, x, parent_id FROM owners WHERE (2*y+1 - 56) % 100 <> 5 OR section_id % 2 = 0)"


@query(
    OWNED.replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + ",\n"
    + SPLIT
    + """, g AS (SELECT *, x - row_number() OVER (PARTITION BY section_id, parent_id, y ORDER BY x) AS g FROM split),
    runs AS (SELECT section_id, parent_id, y, min(x) AS a, max(x) AS b FROM g GROUP BY section_id, parent_id, y, g),
    e AS (SELECT p.section_id, p.parent_id, p.y AS y1, p.a AS a1, q.y AS y2, q.a AS a2 FROM runs p JOIN runs q ON p.section_id = q.section_id AND p.parent_id = q.parent_id AND abs(p.y - q.y) = 1 AND p.a <= q.b AND q.a <= p.b),
    r AS (SELECT section_id, parent_id, y, a, y*1000 + a AS l FROM runs UNION SELECT e.section_id, e.parent_id, e.y2, e.a2, r.l FROM r JOIN e ON e.section_id = r.section_id AND e.parent_id = r.parent_id AND e.y1 = r.y AND e.a1 = r.a),
    c AS (SELECT section_id, parent_id, y, a, min(l) AS l FROM r GROUP BY 1,2,3,4) SELECT section_id, parent_id, count(DISTINCT l) AS parts FROM c GROUP BY 1,2"""
)
def connected_parts(spark, sf_dir):
    """Parents of odd sections lose a row of pixels and fall into two parts."""
    cut = owners(spark, sf_dir).where("(2 * y + 1 - 56) % 100 <> 5 OR section_id % 2 = 0")
    return own.parts(cut)


WEIGHTED = O + f""", cnt AS (SELECT section_id, parent_id, gene_id, SUM(umi) AS umi FROM native_counts JOIN owners USING (section_id, y, x) GROUP BY 1,2,3),
genes AS (SELECT DISTINCT gene_id FROM native_counts),
w AS (SELECT section_id, parent_id, qy, qx, gene_id, CAST(area_px * (1 + (qy*3 + qx*5 + gene_id) % 4) AS DOUBLE) AS weight FROM seg, genes),
mass AS (SELECT w.section_id, w.parent_id, qy, qx, w.gene_id, CASE WHEN w.parent_id < 0 THEN weight WHEN coalesce(c.umi, 0) > 0 THEN weight*c.umi/sum(weight) OVER (PARTITION BY w.section_id, w.parent_id, w.gene_id) ELSE 0 END AS mass
  FROM w LEFT JOIN cnt c ON c.section_id = w.section_id AND c.parent_id = w.parent_id AND c.gene_id = w.gene_id)
"""


def _weights(spark, sf_dir):
    genes = native_counts(spark, sf_dir).select("gene_id").distinct()
    w = (F.col("area_px") * (1 + (F.col("qy") * 3 + F.col("qx") * 5 + F.col("gene_id")) % 4)).cast("double")
    return _segments(spark, sf_dir).crossJoin(F.broadcast(genes)).select("section_id", "parent_id", "qy", "qx", "gene_id", w.alias("weight"))


def _mass(spark, sf_dir):
    return allocate.allocate(_weights(spark, sf_dir), _counts(spark, sf_dir))


@query(WEIGHTED + "SELECT section_id, parent_id, qy, qx, gene_id, round(mass, 6) + 0.0 AS mass FROM mass")
def conserving_allocation(spark, sf_dir):
    return _mass(spark, sf_dir).withColumn("mass", r6("mass"))


@query(WEIGHTED + "SELECT section_id, count(*) AS n, bool_and(abs(m - umi)/(1+umi) <= 5e-6) AS conserved FROM (SELECT section_id, parent_id, gene_id, sum(mass) AS m FROM mass WHERE parent_id >= 0 GROUP BY 1,2,3) JOIN cnt USING (section_id, parent_id, gene_id) GROUP BY 1")
def conservation(spark, sf_dir):
    """Every observed parent and gene keeps its count, within the published tolerance of single precision."""
    r = allocate.residuals(_mass(spark, sf_dir), _counts(spark, sf_dir)).where("umi > 0")
    return r.groupBy("section_id").agg(F.count("*").alias("n"), F.bool_and(F.col("scaled") <= 5e-6).alias("conserved"))


@query(WEIGHTED + "SELECT section_id, qy, qx, gene_id, round(sum(mass), 6) + 0.0 AS mass FROM mass GROUP BY 1,2,3,4")
def segments_to_cells(spark, sf_dir):
    return allocate.to_cells(_mass(spark, sf_dir)).withColumn("mass", r6("mass"))


@query(WEIGHTED + f"SELECT section_id, gene_id, round(sum(m), 4) + 0.0 AS mass, count(*) AS n FROM (SELECT v.section_id, v.y, v.x, m.gene_id, m.mass/s.area_px AS m FROM (SELECT section_id, y, x, coalesce(parent_id, -1) AS parent_id, {F4.format('y')} AS qy, {F4.format('x')} AS qx FROM valid LEFT JOIN owners USING (section_id, y, x)) v JOIN seg s USING (section_id, parent_id, qy, qx) JOIN mass m USING (section_id, parent_id, qy, qx)) GROUP BY 1,2")
def pixel_spread(spark, sf_dir):
    """Segment mass spread over pixels, and what it adds up to."""
    pixels = _valid(spark, sf_dir).join(owners(spark, sf_dir), ["section_id", "y", "x"], "left")
    pixels = pixels.select("section_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), geometry.down("y", 4).alias("qy"), geometry.down("x", 4).alias("qx"), "y", "x")
    out = allocate.to_pixels(_mass(spark, sf_dir), _segments(spark, sf_dir), pixels)
    return out.groupBy("section_id", "gene_id").agg((F.round(F.sum("mass"), 4) + F.lit(0.0)).alias("mass"), F.count("*").alias("n"))


@query(O + """, l AS (SELECT section_id, parent_id, qy, qx, gene_id, ln(area_px) + ((qy + 2*qx + gene_id) % 7) / 7.0::DOUBLE AS z FROM seg, (SELECT DISTINCT gene_id FROM native_counts) WHERE parent_id >= 0)
  SELECT section_id, parent_id, qy, qx, gene_id, round(exp(z - max(z) OVER (PARTITION BY section_id, parent_id, gene_id)), 6) + 0.0 AS weight FROM l""")
def softmax_weights(spark, sf_dir):
    genes = native_counts(spark, sf_dir).select("gene_id").distinct()
    logits = _segments(spark, sf_dir).where("parent_id >= 0").crossJoin(F.broadcast(genes)).withColumn("logit", ((F.col("qy") + 2 * F.col("qx") + F.col("gene_id")) % 7) / 7.0)
    return allocate.softmax_weights(logits).select("section_id", "parent_id", "qy", "qx", "gene_id", r6("weight").alias("weight"))


@query(
    WEIGHTED
    + """, area AS (SELECT section_id, parent_id, sum(area_px) AS area FROM seg WHERE parent_id >= 0 GROUP BY 1,2), ta AS (SELECT section_id, sum(area) AS a FROM area GROUP BY 1),
    tc AS (SELECT section_id, gene_id, sum(umi) AS u FROM cnt GROUP BY 1,2)
    SELECT section_id, parent_id, qy, qx, gene_id, round(umi::DOUBLE/area*area_px, 6) + 0.0 AS mass FROM seg JOIN area USING (section_id, parent_id) JOIN cnt USING (section_id, parent_id)
    UNION ALL SELECT section_id, parent_id, qy, qx, gene_id, round(u::DOUBLE/a*area_px, 6) + 0.0 FROM seg JOIN ta USING (section_id) JOIN tc USING (section_id) WHERE parent_id < 0"""
)
def area_baseline(spark, sf_dir):
    return allocate.area_baseline(_segments(spark, sf_dir), _counts(spark, sf_dir)).withColumn("mass", r6("mass"))


@query(
    WEIGHTED
    + """, t AS (SELECT section_id, gene_id, sum(mass) AS m FROM mass WHERE parent_id >= 0 GROUP BY 1,2), c AS (SELECT section_id, gene_id, sum(umi) AS u FROM cnt GROUP BY 1,2)
    SELECT section_id, gene_id, round(m, 4) + 0.0 AS mass, CAST(u AS BIGINT) AS umi FROM t JOIN c USING (section_id, gene_id)"""
)
def merge_and_restore(spark, sf_dir):
    """Parents merged in pairs are allocated as one and taken apart again by their segments; totals stay."""
    pair = (F.floor(F.col("parent_id") / 2.0) * 2).cast("long")
    seg = _segments(spark, sf_dir).where("parent_id >= 0").withColumn("part", F.col("parent_id")).withColumn("pair", pair)
    genes = native_counts(spark, sf_dir).select("gene_id").distinct()
    w = seg.crossJoin(F.broadcast(genes)).select("section_id", F.col("pair").alias("parent_id"), "qy", "qx", "part", "gene_id", F.col("area_px").cast("double").alias("weight"))
    merged = _counts(spark, sf_dir).withColumn("parent_id", pair).groupBy("section_id", "parent_id", "gene_id").agg(F.sum("umi").alias("umi"))
    total = F.sum("weight").over(Window.partitionBy("section_id", "parent_id", "gene_id"))
    mass = w.withColumn("total", total).join(merged, ["section_id", "parent_id", "gene_id"], "left")
    mass = mass.select("section_id", "qy", "qx", "part", "gene_id", (F.col("weight") * F.coalesce("umi", F.lit(0)) / F.col("total")).alias("mass"))
    back = allocate.restored(mass, seg.select("section_id", "qy", "qx", "part", F.col("part").alias("parent_id")))
    sums = back.groupBy("section_id", "gene_id").agg((F.round(F.sum("mass"), 4) + F.lit(0.0)).alias("mass"))
    return sums.join(_counts(spark, sf_dir).groupBy("section_id", "gene_id").agg(F.sum("umi").alias("umi")), ["section_id", "gene_id"])


CENTERS = "centers AS (SELECT section_id, spot_id AS id, CAST(cy + (spot_id * 13 + section_id * 5) % 31 AS DOUBLE) AS cy, CAST(cx + (spot_id * 7 + section_id * 3) % 29 AS DOUBLE) AS cx FROM sections, spots)"
K = OWNED.rstrip() + ",\n" + CENTERS + "\n"
CELLS = f"cells AS (SELECT DISTINCT section_id, {F4.format('y')} AS qy, {F4.format('x')} AS qx FROM native_counts)"


def _centers(spark, sf_dir):
    sections = native_counts(spark, sf_dir).select("section_id").distinct()
    at = sections.crossJoin(F.broadcast(spots(spark, sf_dir)))
    return at.select("section_id", F.col("spot_id").alias("id"), F.expr("CAST(cy + (spot_id * 13 + section_id * 5) % 31 AS DOUBLE)").alias("cy"), F.expr("CAST(cx + (spot_id * 7 + section_id * 3) % 29 AS DOUBLE)").alias("cx"))


def _queries8(spark, sf_dir):
    cells = native_counts(spark, sf_dir).select("section_id", geometry.down("y", 4).alias("qy"), geometry.down("x", 4).alias("qx")).distinct()
    return cells.withColumn("cy", F.col("qy") * 8.0 + 4).withColumn("cx", F.col("qx") * 8.0 + 4)


def _others(spark, sf_dir):
    return _centers(spark, sf_dir).select("section_id", F.col("id").alias("other"), F.col("cy").alias("oy"), F.col("cx").alias("ox"))


@query(K + "SELECT a.section_id, a.id AS first, b.id AS second, (a.cy-b.cy)*(a.cy-b.cy) + (a.cx-b.cx)*(a.cx-b.cx) AS d2 FROM centers a JOIN centers b ON a.section_id = b.section_id AND a.id < b.id WHERE (a.cy-b.cy)*(a.cy-b.cy) + (a.cx-b.cx)*(a.cx-b.cx) BETWEEN 1e-9 AND 12100")
def neighbour_pairs(spark, sf_dir):
    return neighbors.pairs(_centers(spark, sf_dir))


KNN = K.rstrip() + ",\n" + CELLS + """, knn AS (SELECT * FROM (SELECT c.section_id, qy, qx, p.id AS parent_id, (8*qy+4-cy)*(8*qy+4-cy) + (8*qx+4-cx)*(8*qx+4-cx) AS d2,
  row_number() OVER (PARTITION BY c.section_id, qy, qx ORDER BY (8*qy+4-cy)*(8*qy+4-cy) + (8*qx+4-cx)*(8*qx+4-cx), p.id) AS rank FROM cells c JOIN centers p USING (section_id)
  WHERE (8*qy+4-cy)*(8*qy+4-cy) + (8*qx+4-cx)*(8*qx+4-cx) <= 22500) WHERE rank <= 8)
"""


def _knn(spark, sf_dir):
    return neighbors.nearest(_queries8(spark, sf_dir), _others(spark, sf_dir), 8, 150.0, ["qy", "qx"])


@query(KNN + "SELECT section_id, qy, qx, parent_id, d2, CAST(rank AS INTEGER) AS rank FROM knn")
def nearest_parents(spark, sf_dir):
    return _knn(spark, sf_dir).select("section_id", "qy", "qx", F.col("other").alias("parent_id"), "d2", "rank")


@query(KNN + "SELECT c.section_id, c.qy, c.qx, coalesce(count(k.rank)/8.0::DOUBLE, 0) AS share, round(coalesce(sqrt(min(d2))/100, 1), 6) + 0.0 AS nearest, count(k.rank) > 0 AS any FROM cells c LEFT JOIN knn k ON k.section_id = c.section_id AND k.qy = c.qy AND k.qx = c.qx GROUP BY 1,2,3")
def neighbour_support(spark, sf_dir):
    s = neighbors.support(_knn(spark, sf_dir), _queries8(spark, sf_dir), 8, 100.0, ["qy", "qx"])
    return s.withColumn("nearest", r6("nearest"))


@query(
    KNN
    + """, v AS (SELECT section_id, parent_id, gene_id, SUM(umi)::DOUBLE AS value FROM native_counts JOIN owners USING (section_id, y, x) WHERE gene_id < 2 GROUP BY 1,2,3)
    SELECT section_id, qy, qx, gene_id, round(sum(value/greatest(d2, 1))/sum(1/greatest(d2, 1)), 4) + 0.0 AS idw, round(avg(value), 4) + 0.0 AS mean FROM knn JOIN v USING (section_id, parent_id) GROUP BY 1,2,3,4"""
)
def interpolated_gaps(spark, sf_dir):
    v = _counts(spark, sf_dir).where("gene_id < 2").withColumn("value", F.col("umi").cast("double"))
    near = _knn(spark, sf_dir).withColumnRenamed("other", "parent_id")
    out = allocate.weighted_gaps(near, v)
    return out.select("section_id", "qy", "qx", "gene_id", (F.round("idw", 4) + F.lit(0.0)).alias("idw"), (F.round("mean", 4) + F.lit(0.0)).alias("mean"))


@query(
    K
    + """SELECT section_id, id, other FROM (SELECT a.section_id, a.id, b.id AS other, row_number() OVER (PARTITION BY a.section_id, a.id ORDER BY (a.cy-b.cy)*(a.cy-b.cy) + (a.cx-b.cx)*(a.cx-b.cx), b.id) AS k
         FROM centers a JOIN centers b ON a.section_id = b.section_id AND a.id <> b.id WHERE (a.cy-b.cy)*(a.cy-b.cy) + (a.cx-b.cx)*(a.cx-b.cx) <= 22500) WHERE k <= 6"""
)
def parent_graph(spark, sf_dir):
    return neighbors.nearest(_centers(spark, sf_dir), _others(spark, sf_dir), 6, 150.0, ["id"], include_self=False).select("section_id", "id", "other")


GAP = N.rstrip() + f""",
tissue AS (SELECT DISTINCT section_id, {F4.format('y')} AS qy, {F4.format('x')} AS qx FROM native_counts WHERE {F4.format('x')} % 9 <> 5),
direct AS (SELECT * FROM tissue WHERE (qy * 3 + qx) % 6 = 0),
missing AS (SELECT * FROM tissue ANTI JOIN direct USING (section_id, qy, qx)),
near AS (SELECT * FROM (SELECT m.section_id, m.qy, m.qx, d.qy AS sy, d.qx AS sx, 64.0::DOUBLE*((m.qy-d.qy)*(m.qy-d.qy) + (m.qx-d.qx)*(m.qx-d.qx)) AS d2,
  row_number() OVER (PARTITION BY m.section_id, m.qy, m.qx ORDER BY (m.qy-d.qy)*(m.qy-d.qy) + (m.qx-d.qx)*(m.qx-d.qx), d.qy, d.qx) AS k
  FROM missing m JOIN direct d ON d.section_id = m.section_id AND abs(d.qy - m.qy) <= 12 AND abs(d.qx - m.qx) <= 12) WHERE k <= 4 AND d2 <= 1024),
path AS (SELECT n.* FROM near n WHERE (SELECT count(*) FROM (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS f) WHERE EXISTS (
  SELECT 1 FROM tissue t WHERE t.section_id = n.section_id AND t.qy = round_even(n.qy + (n.sy-n.qy)*f, 0) AND t.qx = round_even(n.qx + (n.sx-n.qx)*f, 0))) = 3)
"""


def _gaps(spark, sf_dir):
    """Tissue columns with a remainder of 5 are missing: they are the barriers that no path may cross."""
    tissue = _queries8(spark, sf_dir).select("section_id", "qy", "qx").where("qx % 9 <> 5")
    direct = tissue.where("(qy * 3 + qx) % 6 = 0")
    missing = tissue.join(direct, ["section_id", "qy", "qx"], "left_anti")
    return tissue, direct, neighbors.gap_sources(missing, direct, tissue)


@query(GAP + "SELECT section_id, qy, qx, sy, sx, round((1/greatest(d2, 1)) / sum(1/greatest(d2, 1)) OVER (PARTITION BY section_id, qy, qx), 6) + 0.0 AS weight FROM path")
def gap_sources(spark, sf_dir):
    return _gaps(spark, sf_dir)[2].select("section_id", "qy", "qx", "sy", "sx", r6("weight").alias("weight"))


@query(
    WEIGHTED
    + """, u AS (SELECT section_id, parent_id, qy, qx, gene_id, area_px*exp(sin(qy + qx + gene_id)) AS weight FROM seg, genes WHERE parent_id >= 0),
    um AS (SELECT u.section_id, u.parent_id, u.gene_id, CASE WHEN coalesce(c.umi, 0) > 0 THEN weight*c.umi/sum(weight) OVER (PARTITION BY u.section_id, u.parent_id, u.gene_id) ELSE 0 END AS mass, coalesce(c.umi, 0) AS umi
      FROM u LEFT JOIN cnt c ON c.section_id = u.section_id AND c.parent_id = u.parent_id AND c.gene_id = u.gene_id),
    us AS (SELECT section_id, parent_id, gene_id, sum(mass) AS m, any_value(umi) AS umi FROM um GROUP BY 1,2,3)
    SELECT section_id, count(*) AS n, bool_and(abs(m - umi)/(1 + umi) <= 5e-6) AS conserved FROM us GROUP BY 1"""
)
def user_scored_allocation(spark, sf_dir):
    """A user's model scores segments in pandas, field by field; the allocation conserves whatever it says."""
    import numpy as np

    seg = _segments(spark, sf_dir).withColumn("field_id", geometry.down("qy", 16) * 100 + geometry.down("qx", 16))
    genes = native_counts(spark, sf_dir).select("gene_id").distinct()
    each = seg.crossJoin(F.broadcast(genes)).withColumn("prior", F.col("area_px").cast("double"))
    weights = allocate.scored_weights(each, lambda f: np.sin(f["qy"] + f["qx"] + f["gene_id"]), ["section_id", "field_id", "parent_id", "qy", "qx", "gene_id", "prior"])
    mass = allocate.allocate(weights.drop("field_id", "prior"), _counts(spark, sf_dir))
    r = allocate.residuals(mass, _counts(spark, sf_dir))
    return r.groupBy("section_id").agg(F.count("*").alias("n"), F.bool_and(F.col("scaled") <= 5e-6).alias("conserved"))


CELL_VALUES = f"""{GAP.rstrip()}, v AS (SELECT section_id, {F4.format('y')} AS qy, {F4.format('x')} AS qx, gene_id, SUM(umi)::DOUBLE AS value FROM native_counts GROUP BY 1,2,3,4),
w AS (SELECT section_id, qy, qx, sy, sx, (1/greatest(d2, 1)) / sum(1/greatest(d2, 1)) OVER (PARTITION BY section_id, qy, qx) AS weight FROM path)
"""


@query(
    CELL_VALUES
    + """SELECT section_id, qy, qx, gene_id, value, 1 AS source FROM v SEMI JOIN direct USING (section_id, qy, qx)
    UNION ALL SELECT w.section_id, w.qy, w.qx, gene_id, round(sum(weight*value), 6) + 0.0, 2 FROM w JOIN v ON v.section_id = w.section_id AND v.qy = w.sy AND v.qx = w.sx GROUP BY 1,2,3,4"""
)
def filled_section(spark, sf_dir):
    """Direct values of a sixth of the tissue, and values from their neighbours along tissue for the rest."""
    _, direct, sources = _gaps(spark, sf_dir)
    values = counts.squares(native_counts(spark, sf_dir), 4).withColumn("value", F.col("umi").cast("double")).join(direct, ["section_id", "qy", "qx"], "left_semi")
    return jobs.filled(values, sources).withColumn("value", r6("value"))


@query(
    CELL_VALUES
    + """SELECT section_id, qy, qx, CASE WHEN d.qy IS NOT NULL THEN 1 WHEN p.qy IS NOT NULL THEN 2 ELSE 0 END AS source FROM tissue t
    LEFT JOIN direct d USING (section_id, qy, qx) LEFT JOIN (SELECT DISTINCT section_id, qy, qx FROM path) p USING (section_id, qy, qx)"""
)
def source_labels(spark, sf_dir):
    return jobs.source_labels(*_gaps(spark, sf_dir))


@query(
    O
    + """, b AS (SELECT section_id, parent_id, avg(y) AS cy, avg(x) AS cx, max(y)-min(y)+1 AS h, max(x)-min(x)+1 AS w FROM owners GROUP BY 1,2)
    SELECT v.section_id, v.y, v.x, round(coalesce(2*(v.y - cy)/h, 0), 6) + 0.0 AS at_y, round(coalesce(2*(v.x - cx)/w, 0), 6) + 0.0 AS at_x FROM valid v LEFT JOIN owners o ON o.section_id = v.section_id AND o.y = v.y AND o.x = v.x LEFT JOIN b ON b.section_id = o.section_id AND b.parent_id = o.parent_id WHERE (v.y + v.x) % 5 = 0"""
)
def relative_positions(spark, sf_dir):
    """Where pixels lie in their parents."""
    r = own.relative_positions(_valid(spark, sf_dir).where("(y + x) % 5 = 0"), owners(spark, sf_dir))
    return r.select("section_id", "y", "x", r6("at_y").alias("at_y"), r6("at_x").alias("at_x"))


@query(
    OWNED.rstrip()
    + f""", v AS (SELECT section_id, parent_id, {SUM} AS umi FROM native_counts JOIN owners USING (section_id, y, x) GROUP BY 1, 2),
      px AS (SELECT DISTINCT section_id, y, x FROM native_counts)
      SELECT section_id, y, x, CASE WHEN v.umi IS NULL THEN -1 ELSE v.umi END AS umi FROM px LEFT JOIN owners USING (section_id, y, x) LEFT JOIN v USING (section_id, parent_id)"""
)
def gathered_totals(spark, sf_dir):
    """Every measured pixel with the total of its parent, -1 in gaps."""
    n, o = native_counts(spark, sf_dir), owners(spark, sf_dir)
    pixels = n.select("section_id", "y", "x").distinct()
    return own.gathered(pixels, o, counts.owned(n, o).groupBy("section_id", "parent_id").agg(F.sum("umi").alias("umi")), umi=-1).select("section_id", "y", "x", "umi")
