"""Queries over the workflows, objectives and identity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella import jobs
from lamella.operators import allocate, audit, checks, counts, geometry, image, metrics, neighbors, objectives, owners
from lamella.plans.count_queries import C, F4, F8, N, TILTED, _covered, _tilted_pairs
from lamella.plans.fixture import GRID, native_counts, spots, table
from lamella.plans.fixture import owners as owned_pixels
from lamella.plans.image_queries import SIDE, T, _cell_density, _x, _y
from lamella.plans.image_queries import DENSITY
from lamella.plans.owner_queries import KNN, O, WEIGHTED, _counts, _knn, _mass, _queries8, _segments, _valid, _weights
from lamella.plans.registry import query, r6
from lamella.plans.sampling_queries import BLOCKS, FIELDS, _blocks, _fields

FLAGGED = f"flagged AS (SELECT DISTINCT section_id, {F8.format('y')} AS py, {F8.format('x')} AS px FROM native_counts WHERE ({F8.format('y')} + 2*{F8.format('x')}) % 5 <> 0)"


def _flagged(spark, sf_dir):
    return native_counts(spark, sf_dir).select("section_id", geometry.down("y", 8).alias("py"), geometry.down("x", 8).alias("px")).distinct().where("(py + 2 * px) % 5 <> 0")


def support_sql(left: str, top: str, size: float) -> str:
    ends = [(f"({left} + {b}*{size}::DOUBLE)", f"({top} + {a}*{size}::DOUBLE)") for a in (0, 1) for b in (0, 1)]
    return " AND ".join(f"{f(*e)} >= -0.5 AND {f(*e)} < {SIDE - 0.5}" for e in ends for f in (_x, _y))


KEPT = N.rstrip() + f",\n{FLAGGED}, kept AS (SELECT * FROM flagged WHERE (py+1)*8 <= {GRID} AND (px+1)*8 <= {GRID} AND {support_sql('px*16.0::DOUBLE', 'py*16.0::DOUBLE', 16.0)})"


@query(KEPT + f" SELECT section_id, py, px, gene_id, CAST(sum(umi) AS BIGINT) AS umi FROM (SELECT *, {F8.format('y')} AS py, {F8.format('x')} AS px FROM native_counts) JOIN kept USING (section_id, py, px) GROUP BY 1,2,3,4")
def benchmark_squares(spark, sf_dir):
    """Observed 16 um counts of the benchmark."""
    return jobs.prepare_squares(native_counts(spark, sf_dir), _flagged(spark, sf_dir), T, (GRID, GRID), (SIDE, SIDE))[0]


@query(KEPT + f" SELECT section_id, qy, qx, gene_id, CAST(sum(umi) AS BIGINT) AS umi, 'evaluation_only_measured_8um' AS role FROM (SELECT *, {F8.format('y')} AS py, {F8.format('x')} AS px, {F4.format('y')} AS qy, {F4.format('x')} AS qx FROM native_counts) JOIN kept USING (section_id, py, px) GROUP BY 1,2,3,4")
def benchmark_squares_truth(spark, sf_dir):
    return jobs.prepare_squares(native_counts(spark, sf_dir), _flagged(spark, sf_dir), T, (GRID, GRID), (SIDE, SIDE))[1]


LATTICE = (
    N.rstrip()
    + f""",\n{FLAGGED}, lat AS (SELECT section_id, r AS array_row, 2*k + r % 2 AS array_col, oy + r*50*sqrt(3) AS cy, ox + k*100 + (r % 2)*50 AS cx
      FROM (SELECT section_id, CAST(sum(umi) % 80 AS DOUBLE) AS oy, CAST(sum(umi) % 90 AS DOUBLE) AS ox FROM native_counts GROUP BY 1), (SELECT unnest(range(0, 7)) AS r), (SELECT unnest(range(-1, 7)) AS k)),
    sp AS (SELECT l.* FROM lat l JOIN flagged f ON f.section_id = l.section_id AND f.py = floor(cy/16) AND f.px = floor(cx/16)
      WHERE cy BETWEEN 28 AND 484 AND cx BETWEEN 28 AND 484 AND {support_sql('(cx-28)', '(cy-28)', 56.0)})"""
)


def _circles(spark, sf_dir):
    native = native_counts(spark, sf_dir)
    total = native.groupBy("section_id").agg(F.sum("umi").alias("t"))
    return jobs.prepare_circles(native, _flagged(spark, sf_dir), total, (F.col("t") % 80).cast("double"), (F.col("t") % 90).cast("double"), T, (GRID, GRID), (SIDE, SIDE))


@query(LATTICE + " SELECT section_id, array_row, array_col, gene_id, CAST(sum(umi) AS BIGINT) AS umi FROM native_counts JOIN sp USING (section_id) WHERE (2*y+1-cy)*(2*y+1-cy) + (2*x+1-cx)*(2*x+1-cx) <= 756.25 GROUP BY 1,2,3,4")
def benchmark_circles(spark, sf_dir):
    """Pseudo-spots of the benchmark."""
    return _circles(spark, sf_dir)[0]


@query(LATTICE + f", c8 AS (SELECT section_id, {F4.format('y')} AS qy, {F4.format('x')} AS qx, gene_id, CAST(sum(umi) AS BIGINT) AS umi FROM native_counts GROUP BY 1,2,3,4) SELECT section_id, array_row, array_col, qy, qx, gene_id, umi, 'evaluation_only_measured_8um' AS role FROM c8 JOIN sp USING (section_id) WHERE (abs(8*qy+4-cy)+4)*(abs(8*qy+4-cy)+4) + (abs(8*qx+4-cx)+4)*(abs(8*qx+4-cx)+4) <= 756.25")
def benchmark_circles_truth(spark, sf_dir):
    return _circles(spark, sf_dir)[1]


PREDICTED = C.rstrip() + f""", genes AS (SELECT DISTINCT gene_id FROM native_counts),
cnt AS (SELECT section_id, {F8.format('y')} AS py, {F8.format('x')} AS px, gene_id, CAST(sum(umi) AS DOUBLE) AS umi FROM native_counts GROUP BY 1,2,3,4),
w AS (SELECT section_id, field_id, qy, qx, CAST(floor(qy/2.0) AS BIGINT) AS py, CAST(floor(qx/2.0) AS BIGINT) AS px, gene_id, weight AS share, CAST(1 + (qy*3 + qx*5 + gene_id + y0 + 3*x0 + 400) % 4 AS DOUBLE) AS weight FROM cover, genes),
m AS (SELECT w.section_id, qy, qx, w.gene_id, share*CASE WHEN umi > 0 THEN weight*umi/sum(weight) OVER (PARTITION BY w.section_id, field_id, w.py, w.px, w.gene_id) ELSE 0 END AS v
  FROM w LEFT JOIN cnt ON cnt.section_id = w.section_id AND cnt.py = w.py AND cnt.px = w.px AND cnt.gene_id = w.gene_id),
pred AS (SELECT section_id, qy, qx, gene_id, sum(v) AS value FROM m GROUP BY 1,2,3,4)"""


def _prediction(spark, sf_dir):
    cover = _covered(spark, sf_dir)
    native = native_counts(spark, sf_dir)
    genes = native.select("gene_id").distinct()
    # A field's parents: the field's number and the place of the parent's 16 um square.
    parent = (F.col("field_id") + 1_000_000) * 1_000_000 + geometry.down("qy", 2) * 1000 + geometry.down("qx", 2)
    weight = (1 + (F.col("qy") * 3 + F.col("qx") * 5 + F.col("gene_id") + F.col("y0") + 3 * F.col("x0") + 400) % 4).cast("double")
    weights = cover.withColumn("parent_id", parent).crossJoin(F.broadcast(genes)).select("section_id", "field_id", "parent_id", "qy", "qx", "gene_id", weight.alias("weight"))  # 16 genes
    c16 = counts.squares(native, 8, ("py", "px"))
    parents = cover.select("section_id", parent.alias("parent_id"), geometry.down("qy", 2).alias("py"), geometry.down("qx", 2).alias("px")).distinct()
    observed = parents.join(c16, ["section_id", "py", "px"]).select("section_id", "parent_id", "gene_id", "umi")
    return jobs.predict(weights, observed, cover.select("section_id", "qy", "qx", "field_id", "weight"))


@query(PREDICTED + " SELECT section_id, qy, qx, gene_id, round(value + 1e-9, 5) AS value FROM pred")
def section_prediction(spark, sf_dir):
    """Every field allocates its parents; overlapping fields are averaged."""
    return _prediction(spark, sf_dir).withColumn("value", F.round(F.col("value") + 1e-9, 5))


EVALUATED = (
    TILTED
    + """, asked AS (SELECT DISTINCT section_id, qy, qx FROM c8 WHERE (qy*3 + qx) % 2 = 0), genes AS (SELECT DISTINCT section_id, gene_id FROM c8 WHERE gene_id < 14),
    e AS (SELECT a.section_id, a.qy, a.qx, g.gene_id, coalesce(t.p, 0) AS p, CAST(coalesce(c.umi, 0) AS DOUBLE) AS y FROM asked a JOIN genes g USING (section_id)
      LEFT JOIN tilted t ON t.section_id = a.section_id AND t.qy = a.qy AND t.qx = a.qx AND t.gene_id = g.gene_id LEFT JOIN c8 c ON c.section_id = a.section_id AND c.qy = a.qy AND c.qx = a.qx AND c.gene_id = g.gene_id),
    r AS (SELECT *, min(p) OVER w AS p0, max(p) OVER w AS p1, min(y) OVER w AS y0, max(y) OVER w AS y1 FROM e WINDOW w AS (PARTITION BY section_id, gene_id)),
    d AS (SELECT *, CASE WHEN p1 > p0 THEN (p-p0)/(p1-p0) ELSE 0 END - CASE WHEN y1 > y0 THEN (y-y0)/(y1-y0) ELSE 0 END AS d FROM r),
    g AS (SELECT section_id, gene_id, CASE WHEN max(y) > min(y) AND max(p) > min(p) THEN corr(p, y) END AS pcc, sqrt(avg(d*d)) AS nrmse, avg(abs(p-y)) AS mae FROM d GROUP BY 1, 2),
    s AS (SELECT *, sum(p) OVER w AS tp, sum(y) OVER w AS ty FROM e WINDOW w AS (PARTITION BY section_id, qy, qx)),
    q AS (SELECT section_id, qy, qx, CASE WHEN var_pop(p) > 0 AND var_pop(y) > 0 THEN corr(p, y) END AS pcc,
      CASE WHEN any_value(tp) = 0 THEN 1 ELSE sum(abs(CASE WHEN tp <> 0 THEN p/tp ELSE 0 END - y/ty))/2 END AS bc FROM s WHERE ty > 0 GROUP BY 1,2,3)"""
)


def _evaluated(spark, sf_dir):
    pairs = _tilted_pairs(spark, sf_dir)
    prediction = pairs.select("section_id", "qy", "qx", "gene_id", F.col("p").alias("value"))
    reference = counts.squares(native_counts(spark, sf_dir), 4)
    asked = reference.where("(qy * 3 + qx) % 2 = 0")
    genes = reference.select("section_id", "gene_id").distinct().select("*", (F.col("gene_id") < 14).alias("predicted"), (F.col("gene_id") < 14).alias("measured"))
    return jobs.evaluate(prediction, asked, genes, asked.where("qy % 3 <> 1"))


@query(EVALUATED + " SELECT section_id, gene_id, round(pcc, 6) + 0.0 AS pcc, round(nrmse, 6) + 0.0 AS nrmse, round(mae, 6) + 0.0 AS mae FROM g")
def evaluation_by_gene(spark, sf_dir):
    g = _evaluated(spark, sf_dir)[0]
    return g.select("section_id", "gene_id", r6("pcc").alias("pcc"), r6("nrmse").alias("nrmse"), r6("mae").alias("mae"))


@query(
    EVALUATED
    + """, a AS (SELECT section_id, count(*) AS genes, count(pcc) AS defined_genes, avg(pcc) AS gp, avg(nrmse) AS gn FROM g GROUP BY 1), b AS (SELECT section_id, count(pcc) AS pcc_positions, avg(pcc) AS pp, count(*) AS positions, avg(bc) AS bc FROM q WHERE qy % 3 <> 1 GROUP BY 1)
    SELECT section_id, genes, defined_genes, round(gp, 5) + 0.0 AS gene_pcc, round(gn, 5) + 0.0 AS gene_nrmse, pcc_positions, round(pp, 5) + 0.0 AS position_pcc, positions, round(bc, 5) + 0.0 AS bray_curtis FROM a JOIN b USING (section_id)"""
)
def evaluation(spark, sf_dir):
    """Scores of a prediction on measured positions, limited to common ones by position; summary of each section."""
    s = _evaluated(spark, sf_dir)[1]
    return s.select("section_id", "genes", "defined_genes", "pcc_positions", "positions", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("gene_pcc", "gene_nrmse", "position_pcc", "bray_curtis")])


@query(f"WITH {BLOCKS}, b AS (SELECT section_id, oy, ox - 100 AS ox, row_number() OVER (PARTITION BY section_id ORDER BY oy, ox) <= 2 AS mon FROM blocks), f AS (SELECT section_id, oy + dy AS y0, ox + dx AS x0 FROM b, (SELECT unnest([0, 128]) AS dy), (SELECT unnest([0, 128]) AS dx)) SELECT f.*, CASE WHEN EXISTS (SELECT 1 FROM b WHERE mon AND b.section_id = f.section_id AND y0 < oy + 256 AND y0 + 128 > oy AND x0 < ox + 256 AND x0 + 128 > ox) THEN 'monitor' ELSE 'train' END AS role FROM f")
def user_training_fields(spark, sf_dir):
    """Fields of a user's blocks; the first two blocks of a section are held out."""
    return jobs.user_fields(_manifest(spark, sf_dir))


def _manifest(spark, sf_dir):
    from pyspark.sql import Window

    b = _blocks(spark, sf_dir).withColumn("bx", F.col("bx") - 100)
    return b.withColumn("monitor", F.row_number().over(Window.partitionBy("section_id").orderBy("by", "bx")) <= 2)


@query(f"WITH {BLOCKS}, b AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY oy, ox) <= 2 + section_id % 2 AS mon FROM blocks) SELECT section_id, count(*) FILTER (WHERE ox % 256 <> 0 OR oy % 256 <> 0 OR oy + 256 > 1024 OR ox + 256 > 512) AS unaligned, CAST(0 AS BIGINT) AS repeated, count(*) FILTER (WHERE mon) <> 2 AS not_two_monitors, count(*) <= 2 AS no_training_block FROM b GROUP BY 1")
def manifest_faults(spark, sf_dir):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("section_id").orderBy("by", "bx"))
    return checks.block_faults(_blocks(spark, sf_dir).withColumn("monitor", rank <= 2 + F.col("section_id") % 2), 1024, 512)


@query(f"WITH {FIELDS} SELECT a.section_id, a.y0, a.x0, b.y0 AS y1, b.x0 AS x1 FROM fields a JOIN fields b ON a.section_id = b.section_id AND abs(a.y0 - b.y0) < 256 AND abs(a.x0 - b.x0) < 256 WHERE a.x0 < 200 AND a.y0 < 300 AND b.x0 >= 300 AND b.y0 < 300")
def overlapping_sides(spark, sf_dir):
    """Support and selection fields that come too close to each other."""
    f = _fields(spark, sf_dir).where("y0 < 300")
    return checks.overlapping_sides(f.where("x0 < 200"), f.where("x0 >= 300"))


@query(f"WITH {FIELDS} SELECT * FROM fields WHERE y0 % 64 = 0")
def authorized_fields(spark, sf_dir):
    f = _fields(spark, sf_dir)
    return checks.authorized(f.where("y0 % 64 = 0"), f, ["section_id", "y0", "x0"])


@query(f"WITH {FIELDS} SELECT (SELECT count(*) FROM fields WHERE y0 % 96 = 0) AS only_cached, (SELECT count(*) FROM fields WHERE x0 % 160 = 32) AS only_wanted FROM (SELECT 1) WHERE true".replace("WHERE y0 % 96 = 0", "WHERE y0 % 96 = 0 AND x0 % 160 <> 32").replace("WHERE x0 % 160 = 32", "WHERE x0 % 160 = 32 AND y0 % 96 <> 0"))
def reusable_cache(spark, sf_dir):
    """A feature cache lacks some fields and holds others."""
    f = _fields(spark, sf_dir)
    return checks.reusable(f.where("x0 % 160 <> 32"), f.where("y0 % 96 <> 0"))


@query("SELECT p_partkey, 'g' || p_partkey AS gene_id FROM part")
def trimmed_genes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" g"), F.col("p_partkey").cast("string"), F.lit("  ")).alias("gene_id"))
    return checks.gene_ids(p)


@query(N + f"SELECT DISTINCT section_id, {F4.format('y')} AS qy, {F4.format('x')} AS qx FROM native_counts")
def unique_coordinates(spark, sf_dir):
    return checks.coordinates(_queries8(spark, sf_dir).select("section_id", "qy", "qx"), "qy", "qx")


@query(N + "SELECT section_id, gene_id, CAST(sum(umi) AS BIGINT) AS umi FROM native_counts WHERE gene_id IN (2, 3, 5, 7) GROUP BY 1, 2")
def narrowed_panel(spark, sf_dir):
    native = native_counts(spark, sf_dir)
    return checks.narrowed(native, native.select("gene_id").distinct().where("gene_id IN (2, 3, 5, 7)")).groupBy("section_id", "gene_id").agg(F.sum("umi").alias("umi"))


@query(N + f"SELECT section_id, py, px, row_number() OVER (PARTITION BY section_id ORDER BY py, px) - 1 AS place FROM (SELECT DISTINCT section_id, {F8.format('y')} AS py, {F8.format('x')} AS px FROM native_counts)")
def ordered_parents(spark, sf_dir):
    p = native_counts(spark, sf_dir).select("section_id", geometry.down("y", 8).alias("py"), geometry.down("x", 8).alias("px")).distinct()
    return checks.numbered(p, "py", "px")


@query(DENSITY + "SELECT CAST(0 AS BIGINT) AS bad, count(*) FILTER (WHERE area = 0 AND od + h + e > 0) AS without_area, count(*) FILTER (WHERE od > 0.5 AND round(area, 9) < 1) AS valid_in_part FROM cd")
def density_faults(spark, sf_dir):
    return checks.density_faults(_cell_density(spark, sf_dir).withColumn("area", F.round("area", 9)).withColumn("valid", F.col("od") > 0.5))


@query(O + ", bad AS (SELECT DISTINCT section_id, parent_id FROM owners ANTI JOIN (SELECT * FROM valid WHERE (y*31 + x*17) % 4001 <> 7) USING (section_id, y, x)), ok AS (SELECT section_id, parent_id, row_number() OVER (PARTITION BY section_id ORDER BY parent_id) - 1 AS slot FROM (SELECT DISTINCT section_id, parent_id FROM owners) ANTI JOIN bad USING (section_id, parent_id)) SELECT section_id, parent_id, slot, count(*) AS n FROM owners JOIN ok USING (section_id, parent_id) GROUP BY 1,2,3".replace("(SELECT * FROM valid WHERE (y*31 + x*17) % 4001 <> 7)", "(SELECT section_id, y, x FROM sections, pixels WHERE (y*31 + x*17 + section_id) % 4001 <> 7)"))
def supported_parents(spark, sf_dir):
    """Parents with an invalid pixel own nothing; the others are numbered."""
    pixels = spark.range(GRID * GRID).select(F.floor(F.col("id") / GRID).cast("long").alias("y"), (F.col("id") % GRID).alias("x"))
    sections = native_counts(spark, sf_dir).select("section_id").distinct()
    valid = sections.crossJoin(pixels).where("(y * 31 + x * 17 + section_id) % 4001 <> 7")  # sections times one capture's pixels
    return jobs.supported_owners(owned_pixels(spark, sf_dir), valid).groupBy("section_id", "parent_id", "slot").agg(F.count("*").alias("n"))


@query(N + f", p AS (SELECT DISTINCT section_id, {F8.format('y')} AS py, {F8.format('x')} AS px FROM native_counts), s AS (SELECT *, (SELECT arg_min(a, abs(py*8+4-a-64)*1000 + a) FROM (SELECT unnest([0,96,128]) AS a)) AS y0, (SELECT arg_min(a, abs(px*8+4-a-64)*1000 + a) FROM (SELECT unnest([0,96,128]) AS a)) AS x0 FROM p) SELECT section_id, py, px, CAST(y0 AS BIGINT) AS y0, CAST(x0 AS BIGINT) AS x0 FROM s WHERE py*8 >= y0 AND py*8+8 <= y0+128 AND px*8 >= x0 AND px*8+8 <= x0+128")
def nearest_tiles(spark, sf_dir):
    p = native_counts(spark, sf_dir).select("section_id", geometry.down("y", 8).alias("py"), geometry.down("x", 8).alias("px")).distinct()
    return geometry.nearest_tiles(p, GRID, GRID)


CELL = f"c AS (SELECT DISTINCT section_id, {F4.format('y')} AS qy, {F4.format('x')} AS qx FROM native_counts)"


@query(N.rstrip() + f",\n{CELL}, s AS (SELECT *, CAST(greatest(0, least(128, floor(qy/24.0)*96-16)) AS BIGINT) AS y0, CAST(greatest(0, least(128, floor(qx/24.0)*96-16)) AS BIGINT) AS x0 FROM c) SELECT *, qy - CAST(floor(y0/4.0) AS BIGINT) AS ly, qx - CAST(floor(x0/4.0) AS BIGINT) AS lx FROM s")
def clipped_cores(spark, sf_dir):
    return geometry.single_cores(_queries8(spark, sf_dir).select("section_id", "qy", "qx"), GRID, GRID)


@query(N.rstrip() + f",\n{CELL}, s AS (SELECT *, CAST(floor(qy/18.0)*72-28 AS BIGINT) AS y0, CAST(floor(qx/18.0)*72-28 AS BIGINT) AS x0 FROM c) SELECT *, qy - CAST(floor(y0/4.0) AS BIGINT) AS ly, qx - CAST(floor(x0/4.0) AS BIGINT) AS lx FROM s")
def padded_cores(spark, sf_dir):
    return geometry.single_cores(_queries8(spark, sf_dir).select("section_id", "qy", "qx"), GRID, GRID, 144, 56)


MEMBERS = ", o AS (SELECT DISTINCT section_id, py, px FROM c16 WHERE (py*5 + px*3) % 7 < 4), mem AS (SELECT section_id, py, px FROM (SELECT *, count(*) OVER (PARTITION BY section_id, CAST(floor(py/2.0) AS BIGINT), CAST(floor(px/2.0) AS BIGINT)) AS k FROM o) WHERE k >= 2)"


@query(TILTED + MEMBERS + ", s AS (SELECT section_id, py, px, gene_id, sum(p) AS p FROM tilted GROUP BY 1,2,3,4) SELECT section_id, round(sum(p - coalesce(umi, 0)*ln(greatest(p, 1e-12)))/greatest(sum(coalesce(umi, 0)), 1), 6) + 0.0 AS nll, CAST(sum(coalesce(umi, 0)) AS DOUBLE) AS umi FROM s JOIN mem USING (section_id, py, px) LEFT JOIN c16 USING (section_id, py, px, gene_id) GROUP BY 1")
def coarse_nll(spark, sf_dir):
    """Loss at 16 um over observed parents of groups with two or more of them."""
    observed = counts.squares(native_counts(spark, sf_dir), 8, ("py", "px")).where("(py * 5 + px * 3) % 7 < 4")
    s = objectives.coarse_nll(_tilted_pairs(spark, sf_dir).select("section_id", "qy", "qx", "gene_id", "p"), observed, "section_id")
    return s.select("section_id", r6("nll").alias("nll"), "umi")


INSIDE = ", ins AS (SELECT section_id, parent_id, count(*) AS area FROM valid JOIN owners USING (section_id, y, x) GROUP BY 1,2 HAVING bool_and(y BETWEEN 32 AND 223 AND x BETWEEN 32 AND 223))"
DIVERGENCE = WEIGHTED.rstrip() + INSIDE + ", k AS (SELECT section_id, CAST(umi AS DOUBLE) AS c, area_px::DOUBLE/area AS u, mass FROM seg JOIN ins USING (section_id, parent_id) JOIN mass USING (section_id, parent_id, qy, qx) JOIN cnt USING (section_id, parent_id, gene_id) WHERE umi > 0)"


def _inside(spark, sf_dir):
    met = _valid(spark, sf_dir).join(owned_pixels(spark, sf_dir), ["section_id", "y", "x"])
    return owners.inside_core(met, 32, 224)


@query(DIVERGENCE + " SELECT section_id, round(greatest(sum(c*u*(ln(u) - ln(mass/c))), 0), 4) + 0.0 AS divergence, count(*) AS terms FROM k GROUP BY 1")
def area_divergence(spark, sf_dir):
    d = objectives.area_divergence(_mass(spark, sf_dir), _segments(spark, sf_dir), _counts(spark, sf_dir), _inside(spark, sf_dir), "section_id")
    return d.withColumn("divergence", F.round("divergence", 4) + F.lit(0.0))


@query(TILTED + ", f AS (SELECT section_id, gene_id, sum(p - y*ln(greatest(p, 1e-12)))/greatest(sum(y), 1) AS nll, sum(y) AS umi FROM tilted GROUP BY 1,2), w AS (SELECT *, umi/greatest(umi, 30000.0::DOUBLE) AS weight, gene_id/10.0::DOUBLE AS penalty FROM f) SELECT round(avg(weight*nll), 5) + 0.0 AS data, round(avg(weight*penalty), 5) + 0.0 AS penalty, round(avg(weight*nll + 0.5*weight*penalty), 5) + 0.0 AS total, round(avg(weight), 6) AS mean_weight, round(avg(CAST(weight < 1 AS INT)), 6) AS downweighted FROM w")
def weighted_objective(spark, sf_dir):
    """Fields with few counts weigh less."""
    f = metrics.poisson_nll(_tilted_pairs(spark, sf_dir), "section_id", "gene_id").withColumn("penalty", F.col("gene_id") / 10.0)
    o = objectives.weighted_objective(objectives.field_weights(f, 30000.0), 0.5)
    return o.select(*[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("data", "penalty", "total")], F.round("mean_weight", 6).alias("mean_weight"), F.round("downweighted", 6).alias("downweighted"))


@query(TILTED + "SELECT section_id, round(sum(c/4 - y*ln(greatest(c/4, 1e-12)) - (p - y*ln(greatest(p, 1e-12))))/greatest(sum(y), 1), 6) + 0.0 AS gain FROM tilted GROUP BY 1")
def gain_over_baseline(spark, sf_dir):
    """Gain of an allocation over one by area alone."""
    g = objectives.gain_over_baseline(_tilted_pairs(spark, sf_dir).withColumn("b", F.col("c") / 4), "section_id")
    return g.withColumn("gain", r6("gain"))


@query(
    WEIGHTED
    + """, one AS (SELECT *, CASE WHEN parent_id IN (1, 7) THEN parent_id - 1 ELSE parent_id END AS merged FROM w WHERE parent_id IN (0, 1, 6, 7)),
    two AS (SELECT section_id, CASE WHEN parent_id IN (1, 7) THEN parent_id - 1 ELSE parent_id END AS merged, gene_id, sum(umi) AS umi FROM cnt WHERE parent_id IN (0, 1, 6, 7) GROUP BY 1, 2, 3),
    m AS (SELECT one.section_id, one.parent_id, one.gene_id, weight*umi/sum(weight) OVER (PARTITION BY one.section_id, one.merged, one.gene_id) AS mass FROM one JOIN two ON two.section_id = one.section_id AND two.merged = one.merged AND two.gene_id = one.gene_id),
    b AS (SELECT section_id, parent_id, gene_id, sum(mass) AS p FROM m GROUP BY 1, 2, 3),
    f AS (SELECT section_id, coalesce(p, 0) AS p, CAST(coalesce(umi, 0) AS DOUBLE) AS y FROM b FULL JOIN (SELECT * FROM cnt WHERE parent_id IN (0, 1, 6, 7)) USING (section_id, parent_id, gene_id))
    SELECT section_id, round(sum(p - y*ln(greatest(p, 1e-12)))/greatest(sum(y), 1), 6) + 0.0 AS nll, sum(y) AS umi FROM f GROUP BY 1"""
)
def pair_nll(spark, sf_dir):
    """Chosen pairs of parents are merged, allocated as one and scored apart again."""
    pairs = owned_pixels(spark, sf_dir).select("section_id", F.col("parent_id").alias("first")).distinct().where("first IN (0, 6)").withColumn("second", F.col("first") + 1)
    s = objectives.merged_pair_nll(_weights(spark, sf_dir), _counts(spark, sf_dir), pairs, "section_id")
    return s.select("section_id", r6("nll").alias("nll"), "umi")


@query(O + ", px AS (SELECT section_id, parent_id, " + f"{F4.format('y')} AS qy, {F4.format('x')} AS qx, CAST(v.umi AS DOUBLE) AS v FROM owners JOIN (SELECT section_id, y, x, sum(umi) AS umi FROM native_counts GROUP BY 1,2,3) v USING (section_id, y, x)) SELECT section_id, parent_id, qy, qx, sum(v) AS total, round(avg(v), 6) AS mean, max(v) AS top, round(sqrt(greatest(avg(v*v) - avg(v)*avg(v), 0) + 1e-6), 6) AS deviation FROM px GROUP BY 1,2,3,4")
def pooled_segments(spark, sf_dir):
    v = native_counts(spark, sf_dir).groupBy("section_id", "y", "x").agg(F.sum("umi").cast("double").alias("v"))
    px = v.join(owned_pixels(spark, sf_dir), ["section_id", "y", "x"]).withColumn("qy", geometry.down("y", 4)).withColumn("qx", geometry.down("x", 4))
    return allocate.pooled_segments(px, "v").withColumn("mean", F.round("mean", 6)).withColumn("deviation", F.round("deviation", 6))


@query(
    KNN
    + """, v AS (SELECT section_id, parent_id, gene_id, SUM(umi)::DOUBLE AS value FROM native_counts JOIN owners USING (section_id, y, x) WHERE gene_id < 2 AND parent_id % 3 = 0 GROUP BY 1,2,3),
    ov AS (SELECT section_id, gene_id, avg(value) AS density FROM v GROUP BY 1,2),
    i AS (SELECT section_id, qy, qx, gene_id, sum(value/greatest(d2, 1))/sum(1/greatest(d2, 1)) AS idw FROM (SELECT * FROM knn WHERE rank <= 2) JOIN v USING (section_id, parent_id) GROUP BY 1,2,3,4)
    SELECT c.section_id, c.qy, c.qx, o.gene_id, round(coalesce(idw, density), 4) + 0.0 AS density, idw IS NOT NULL AS supported,
      round(CASE WHEN (c.qy + c.qx) % 5 > 0 THEN greatest(coalesce(idw, density), 1e-10)*exp(2*tanh((c.qy - c.qx)/40.0::DOUBLE/2)) ELSE 0 END, 3) + 0.0 AS prior
    FROM cells c JOIN ov o USING (section_id) LEFT JOIN i ON i.section_id = c.section_id AND i.qy = c.qy AND i.qx = c.qx AND i.gene_id = o.gene_id"""
)
def gap_prior(spark, sf_dir):
    """Density of gaps from their two nearest parents, or the section's where none is measured, and the prior mass from it."""
    v = _counts(spark, sf_dir).where("gene_id < 2 AND parent_id % 3 = 0").withColumn("value", F.col("umi").cast("double"))
    near = _knn(spark, sf_dir).where("rank <= 2").withColumnRenamed("other", "parent_id")
    overall = v.groupBy("section_id", "gene_id").agg(F.avg("value").alias("density"))
    d = allocate.gap_density(near, v, _queries8(spark, sf_dir).select("section_id", "qy", "qx"), overall)
    prior = allocate.prior_mass(F.col("density"), (F.col("qy") - F.col("qx")) / 40.0, (F.col("qy") + F.col("qx")) % 5 > 0)
    return d.select("section_id", "qy", "qx", "gene_id", (F.round("density", 4) + F.lit(0.0)).alias("density"), "supported", (F.round(prior, 3) + F.lit(0.0)).alias("prior"))


SPARSE = f"thin AS (SELECT DISTINCT section_id, {F8.format('y')} AS py, {F8.format('x')} AS px FROM native_counts WHERE ({F8.format('y')}*7 + {F8.format('x')}*3 + {F8.format('y')}*{F8.format('x')}) % 61 < 12)"


@query(
    N.rstrip()
    + f""", {SPARSE},
    a AS (SELECT *, unnest(range(CAST(floor((py - 13)/10.0) AS BIGINT) + 1, CAST(floor((py + 3)/10.0) AS BIGINT) + 1)) AS ky FROM thin),
    b AS (SELECT *, unnest(range(CAST(floor((px - 13)/10.0) AS BIGINT) + 1, CAST(floor((px + 3)/10.0) AS BIGINT) + 1)) AS kx FROM a),
    g AS (SELECT section_id, ky, kx, count(*) AS n, bool_or(py >= 10*ky AND py < 10*ky + 10 AND px >= 10*kx AND px < 10*kx + 10) AS core FROM b GROUP BY section_id, ky, kx, (py - 10*ky + 3)//2, (px - 10*kx + 3)//2),
    f AS (SELECT DISTINCT section_id, 80*ky - 24 AS y0, 80*kx - 24 AS x0 FROM g WHERE n >= 2 AND core)
    SELECT section_id, y0, x0, CASE WHEN x0 + 128 <= 110 THEN 'support' ELSE 'selection' END AS side FROM f WHERE x0 + 128 <= 110 OR x0 >= 110"""
)
def fine_tuning_fields(spark, sf_dir):
    """Sparse observed parents, so that some fields hold no group of two."""
    thin = native_counts(spark, sf_dir).select("section_id", geometry.down("y", 8).alias("py"), geometry.down("x", 8).alias("px")).distinct().where("(py * 7 + px * 3 + py * px) % 61 < 12")
    return jobs.fine_tuning_fields(jobs.eligible_squares(thin), 110, least=1)
