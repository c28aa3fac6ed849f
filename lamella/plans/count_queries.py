"""Queries over counts, geometry and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.operators import counts, geometry, metrics
from lamella.plans.fixture import CIRCLE_SQL, GRID, NATIVE_SQL, OWNERS_SQL, PANEL_SQL, PIXELS_SQL, SECTIONS_SQL, SPOTS_SQL, native_counts, owners, panel, spots, with_tables
from lamella.plans.registry import query, r6

N = with_tables(NATIVE_SQL)
F4, F8, F16 = "CAST(floor({0}/4.0) AS BIGINT)", "CAST(floor({0}/8.0) AS BIGINT)", "CAST(floor({0}/16.0) AS BIGINT)"
SUM = "CAST(SUM(umi) AS BIGINT)"


def squares_sql(step: int, names=("qy", "qx")) -> str:
    return f"SELECT section_id, CAST(floor(y/{step}.0) AS BIGINT) AS {names[0]}, CAST(floor(x/{step}.0) AS BIGINT) AS {names[1]}, gene_id, {SUM} AS umi FROM native_counts GROUP BY 1,2,3,4"


@query(N + squares_sql(4))
def counts_8um(spark, sf_dir):
    return counts.squares(native_counts(spark, sf_dir), 4)


@query(N + squares_sql(8, ("py", "px")))
def counts_16um(spark, sf_dir):
    return counts.squares(native_counts(spark, sf_dir), 8, ("py", "px"))


@query(N + squares_sql(16, ("gy", "gx")))
def counts_32um(spark, sf_dir):
    return counts.squares(native_counts(spark, sf_dir), 16, ("gy", "gx"))


@query(N + f"SELECT section_id, coalesce({F8.format('y')}, -1) AS py, coalesce({F4.format('y')}, -1) AS qy, {SUM} AS umi FROM native_counts GROUP BY GROUPING SETS ((section_id), (section_id, {F8.format('y')}), (section_id, {F8.format('y')}, {F4.format('y')}))")
def row_hierarchy(spark, sf_dir):
    rows = native_counts(spark, sf_dir).select("section_id", geometry.down("y", 8).alias("py"), geometry.down("y", 4).alias("qy"), "umi")
    sums = rows.rollup("section_id", "py", "qy").agg(F.sum("umi").alias("umi")).where("section_id IS NOT NULL")
    return sums.fillna(-1, ["py", "qy"])


@query(
    N
    + """SELECT count(*) AS n, count(*) FILTER (WHERE umi < 0) AS negative, count(*) FILTER (WHERE y NOT BETWEEN 0 AND 255 OR x NOT BETWEEN 0 AND 255) AS outside,
         count(*) FILTER (WHERE umi > 65535) AS beyond_uint16, max(umi) AS max_umi,
         (SELECT count(*) FROM (SELECT 1 FROM native_counts GROUP BY section_id, y, x, gene_id HAVING count(*) > 1)) AS repeated FROM native_counts"""
)
def count_faults(spark, sf_dir):
    return counts.faults(native_counts(spark, sf_dir), GRID, GRID)


@query("SELECT l_suppkey % 4 AS section_id, CAST(SUM(l_quantity) AS BIGINT) AS umi FROM lineitem GROUP BY 1")
def checked_total(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_suppkey") % 4).alias("section_id"), F.col("l_quantity").cast("double").alias("umi"))
    return counts.checked(rows).groupBy("section_id").agg(F.sum("umi").alias("umi"))


@query(with_tables(NATIVE_SQL, PANEL_SQL) + f"SELECT section_id, pos, gene_id, {SUM} AS umi FROM native_counts JOIN panel USING (gene_id) GROUP BY 1,2,3")
def panel_alignment(spark, sf_dir):
    return counts.in_panel(native_counts(spark, sf_dir), panel(spark)).groupBy("section_id", "pos", "gene_id").agg(F.sum("umi").alias("umi"))


@query(
    with_tables(NATIVE_SQL, PANEL_SQL)
    + "SELECT s.section_id, p.gene_id, p.pos, EXISTS (SELECT 1 FROM native_counts n WHERE n.section_id = s.section_id AND n.gene_id = p.gene_id) AS available FROM (SELECT DISTINCT section_id FROM native_counts) s, panel p"
)
def gene_availability(spark, sf_dir):
    return counts.availability(native_counts(spark, sf_dir), panel(spark)).select("section_id", "gene_id", "pos", "available")


CIRCLES = with_tables(NATIVE_SQL, SPOTS_SQL, PIXELS_SQL, CIRCLE_SQL)


@query(CIRCLES + f"SELECT section_id, spot_id, gene_id, {SUM} AS umi FROM native_counts JOIN circle USING (y, x) GROUP BY 1,2,3")
def circle_counts(spark, sf_dir):
    circle = geometry.circle_pixels(spots(spark, sf_dir), 55.0, GRID, GRID).select("spot_id", "y", "x")
    return native_counts(spark, sf_dir).join(F.broadcast(circle), ["y", "x"]).groupBy("section_id", "spot_id", "gene_id").agg(F.sum("umi").alias("umi"))


@query(CIRCLES + f"SELECT spot_id, {F4.format('y')} AS qy, {F4.format('x')} AS qx, count(*) / 16.0 AS weight FROM circle GROUP BY 1,2,3".replace("count(*) / 16.0", "CAST(count(*) AS DOUBLE) / 16"))
def spot_weights(spark, sf_dir):
    circle = geometry.circle_pixels(spots(spark, sf_dir), 55.0, GRID, GRID)
    return circle.groupBy("spot_id", geometry.down("y", 4).alias("qy"), geometry.down("x", 4).alias("qx")).agg((F.count("*") / F.lit(16.0)).alias("weight"))


@query(
    with_tables(SPOTS_SQL)
    + """SELECT spot_id, qy, qx FROM spots, (SELECT unnest(range(0, 80)) AS qy), (SELECT unnest(range(0, 80)) AS qx)
         WHERE (abs(8*qy+4-cy)+4)*(abs(8*qy+4-cy)+4) + (abs(8*qx+4-cx)+4)*(abs(8*qx+4-cx)+4) <= 756.25"""
)
def interior_cells(spark, sf_dir):
    return geometry.interior_cells(spots(spark, sf_dir), 55.0).select("spot_id", "qy", "qx")


@query(
    with_tables(SPOTS_SQL, "wide AS (SELECT spot_id, y, x FROM spots, (SELECT unnest(range(0, 256)) AS y), (SELECT unnest(range(0, 256)) AS x) WHERE (2*y+1-cy)*(2*y+1-cy) + (2*x+1-cx)*(2*x+1-cx) <= 3600)")
    + "SELECT y, x, count(*) AS n FROM wide GROUP BY 1,2 HAVING count(*) > 1"
)
def overlapping_pixels(spark, sf_dir):
    """Circles of 120 um at a pitch of 100 um: the pixels claimed more than once."""
    return counts.repeated(geometry.circle_pixels(spots(spark, sf_dir), 120.0, GRID, GRID), ["y", "x"])


@query(
    N
    + """SELECT section_id, r AS array_row, 2*k + r % 2 AS array_col, round(oy + r * 50 * sqrt(3), 6) AS cy, round(ox + k * 100 + (r % 2) * 50, 6) AS cx
         FROM (SELECT section_id, CAST(sum(umi) % 80 AS DOUBLE) AS oy, CAST(sum(umi) % 90 AS DOUBLE) AS ox FROM native_counts GROUP BY 1),
              (SELECT unnest(range(0, 7)) AS r), (SELECT unnest(range(-1, 7)) AS k)
         WHERE oy + r * 50 * sqrt(3) BETWEEN 28 AND 484 AND ox + k * 100 + (r % 2) * 50 BETWEEN 28 AND 484"""
)
def hex_lattice(spark, sf_dir):
    """Lattice of each section; the phase comes from its total count."""
    total = native_counts(spark, sf_dir).groupBy("section_id").agg(F.sum("umi").alias("t"))
    at = geometry.lattice(total, GRID, GRID, (F.col("t") % 80).cast("double"), (F.col("t") % 90).cast("double"))
    return at.select("section_id", "array_row", "array_col", F.round("cy", 6).alias("cy"), F.round("cx", 6).alias("cx"))


OWNED = with_tables(NATIVE_SQL, SPOTS_SQL, PIXELS_SQL, CIRCLE_SQL, SECTIONS_SQL, OWNERS_SQL)


@query(
    OWNED
    + f"""SELECT section_id, 'parent' AS kind, parent_id AS a, CAST(0 AS BIGINT) AS b, gene_id, {SUM} AS umi FROM native_counts JOIN owners USING (section_id, y, x) GROUP BY 1,2,3,4,5
          UNION ALL SELECT section_id, 'cell', {F4.format("y")}, {F4.format("x")}, gene_id, {SUM} FROM native_counts WHERE gene_id IN (1, 2, 3, 16) GROUP BY 1,2,3,4,5"""
)
def dual_rollup(spark, sf_dir):
    output = panel(spark).where("gene_id IN (1, 2, 3, 16)")
    return counts.dual_rollup(native_counts(spark, sf_dir), owners(spark, sf_dir), output)


@query(
    N
    + f""", p AS (SELECT section_id, {F8.format("y")} AS py, {F8.format("x")} AS px, gene_id, {SUM} AS umi FROM native_counts GROUP BY 1,2,3,4),
        o AS (SELECT DISTINCT section_id, py, px FROM p WHERE (py + px) % 3 <> 0),
        g AS (SELECT section_id, CAST(floor(py/2.0) AS BIGINT) AS gy, CAST(floor(px/2.0) AS BIGINT) AS gx, count(*) AS members FROM o GROUP BY 1,2,3)
        SELECT section_id, gy, gx, gene_id, {SUM} AS umi, any_value(members) AS members
        FROM (SELECT p.*, CAST(floor(py/2.0) AS BIGINT) AS gy, CAST(floor(px/2.0) AS BIGINT) AS gx FROM p JOIN o USING (section_id, py, px)) JOIN g USING (section_id, gy, gx) GROUP BY 1,2,3,4"""
)
def observed_32um(spark, sf_dir):
    c16 = counts.squares(native_counts(spark, sf_dir), 8, ("py", "px"))
    observed = c16.where("(py + px) % 3 <> 0").select("section_id", "py", "px").distinct()
    return counts.observed_groups(c16, observed)


@query(
    OWNED
    + f"""SELECT section_id, CASE WHEN parent_id % 2 = 1 THEN parent_id - 1 ELSE parent_id END AS parent_id, gene_id, {SUM} AS umi FROM native_counts JOIN owners USING (section_id, y, x) GROUP BY 1,2,3"""
)
def merged_parents(spark, sf_dir):
    own = owners(spark, sf_dir)
    pairs = own.select("section_id", F.col("parent_id").alias("second")).distinct().where("second % 2 = 1").withColumn("first", F.col("second") - 1)
    return counts.merged_parents(counts.owned(native_counts(spark, sf_dir), own), pairs)


@query(
    N
    + f""", b AS (SELECT DISTINCT section_id, CAST(floor(y/64.0) AS BIGINT) AS block_y, CAST(floor(x/64.0) AS BIGINT) AS block_x FROM native_counts WHERE (CAST(floor(y/64.0) AS BIGINT) + section_id) % 2 = 0),
          n AS (SELECT section_id, block_y, block_x, count(*) AS nnz FROM (SELECT *, CAST(floor(y/64.0) AS BIGINT) AS block_y, CAST(floor(x/64.0) AS BIGINT) AS block_x FROM native_counts) JOIN b USING (section_id, block_y, block_x) GROUP BY 1,2,3)
          SELECT *, CAST(sum(nnz) OVER w AS BIGINT) AS stop, CAST(sum(nnz) OVER w AS BIGINT) - nnz AS start FROM n WINDOW w AS (PARTITION BY section_id ORDER BY block_y, block_x)"""
)
def block_layout(spark, sf_dir):
    native = native_counts(spark, sf_dir)
    blocks = native.select("section_id", geometry.down("y", 64).alias("block_y"), geometry.down("x", 64).alias("block_x")).distinct().where("(block_y + section_id) % 2 = 0")
    return counts.block_layout(native, blocks, 64)


def _uniform_pairs(spark, sf_dir):
    """Uniform allocation of 16 um parents to their four cells, next to the measured 8 um counts."""
    native = native_counts(spark, sf_dir)
    children = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a in (0, 1) for b in (0, 1)]))
    parents = counts.squares(native, 8, ("py", "px")).withColumn("c", children)
    split = parents.select("section_id", (F.col("py") * 2 + F.col("c.a")).alias("qy"), (F.col("px") * 2 + F.col("c.b")).alias("qx"), "gene_id", (F.col("umi") / 4.0).alias("p"))
    truth = counts.squares(native, 4).withColumnRenamed("umi", "y")
    return split.join(truth, ["section_id", "qy", "qx", "gene_id"], "left").withColumn("y", F.coalesce("y", F.lit(0)).cast("double"))


PAIRS = (
    N
    + f""", c8 AS (SELECT section_id, {F4.format("y")} AS qy, {F4.format("x")} AS qx, gene_id, SUM(umi) AS umi FROM native_counts GROUP BY 1,2,3,4),
    c16 AS (SELECT section_id, {F8.format("y")} AS py, {F8.format("x")} AS px, gene_id, SUM(umi) AS umi FROM native_counts GROUP BY 1,2,3,4),
    pairs AS (SELECT s.section_id, s.qy, s.qx, s.gene_id, s.p, CAST(coalesce(c8.umi, 0) AS DOUBLE) AS y
      FROM (SELECT section_id, py*2+a AS qy, px*2+b AS qx, gene_id, CAST(umi AS DOUBLE)/4 AS p FROM c16, (SELECT unnest([0,1]) AS a), (SELECT unnest([0,1]) AS b)) s
      LEFT JOIN c8 ON c8.section_id = s.section_id AND c8.qy = s.qy AND c8.qx = s.qx AND c8.gene_id = s.gene_id)
    """
)
R = "round({0}, 6) + 0.0"


@query(
    PAIRS
    + """, r AS (SELECT *, min(p) OVER w AS p0, max(p) OVER w AS p1, min(y) OVER w AS y0, max(y) OVER w AS y1 FROM pairs WINDOW w AS (PARTITION BY section_id, gene_id)),
         d AS (SELECT *, CASE WHEN p1 > p0 THEN (p-p0)/(p1-p0) ELSE 0 END - CASE WHEN y1 > y0 THEN (y-y0)/(y1-y0) ELSE 0 END AS d FROM r)
         SELECT section_id, gene_id, round(CASE WHEN max(y) > min(y) AND max(p) > min(p) THEN corr(p, y) END, 6) + 0.0 AS pcc,
         round(sqrt(avg(d*d)), 6) + 0.0 AS nrmse, round(avg(abs(p-y)), 6) + 0.0 AS mae FROM d GROUP BY 1, 2"""
)
def spatial_gene_pcc(spark, sf_dir):
    """How well does uniform allocation rebuild the measured 8 um counts, by section and gene?"""
    m = _uniform_pairs(spark, sf_dir).groupBy("section_id", "gene_id").agg(*metrics.moments())
    return metrics.gene_scores(m, "section_id", "gene_id").select("section_id", "gene_id", r6("pcc").alias("pcc"), r6("nrmse").alias("nrmse"), r6("mae").alias("mae"))


@query(
    PAIRS
    + """, t AS (SELECT *, sum(p) OVER (PARTITION BY section_id, qy, qx) AS tp, sum(y) OVER (PARTITION BY section_id, qy, qx) AS ty FROM pairs)
    SELECT section_id, qy, qx, round(CASE WHEN var_pop(p) > 0 AND var_pop(y) > 0 THEN corr(p, y) END, 5) + 0.0 AS pcc,
      round(CASE WHEN any_value(tp) = 0 THEN 1 ELSE sum(abs(CASE WHEN tp <> 0 THEN p/tp ELSE 0 END - y/ty))/2 END + 1e-9, 6) + 0.0 AS bray_curtis FROM t WHERE ty > 0 GROUP BY 1,2,3"""
)
def position_scores(spark, sf_dir):
    s = metrics.position_scores(_uniform_pairs(spark, sf_dir), "section_id", "qy", "qx")
    return s.select("section_id", "qy", "qx", (F.round("pcc", 5) + F.lit(0.0)).alias("pcc"), r6(F.col("bray_curtis") + 1e-9).alias("bray_curtis"))


@query(PAIRS + """SELECT section_id, count(*) AS n, round(max(abs(p-y)), 6) + 0.0 AS max_abs, round(max(abs(p-y)/(1+abs(y))), 6) + 0.0 AS max_scaled,
  round(max(CASE WHEN y <> 0 THEN abs(p-y)/abs(y) END), 6) + 0.0 AS max_relative, bool_and(abs(p-y) <= 1e-5 + 1e-5*abs(y)) AS within FROM pairs GROUP BY 1""")
def error_report(spark, sf_dir):
    e = metrics.error_report(_uniform_pairs(spark, sf_dir), "section_id")
    return e.select("section_id", "n", r6("max_abs").alias("max_abs"), r6("max_scaled").alias("max_scaled"), r6("max_relative").alias("max_relative"), "within")


@query(
    PAIRS
    + f""", back AS (SELECT section_id, CAST(floor(qy/2.0) AS BIGINT) AS py, CAST(floor(qx/2.0) AS BIGINT) AS px, gene_id, sum(p) AS p FROM pairs GROUP BY 1,2,3,4)
    SELECT b.section_id, count(*) AS n, max(abs(b.p - c.umi)) AS max_abs, bool_and(abs(b.p - c.umi) <= 1e-5) AS within FROM back b JOIN c16 c USING (section_id, py, px, gene_id) GROUP BY 1"""
)
def children_sum_to_parents(spark, sf_dir):
    """Re-aggregates an allocation and compares it with the parents it came from."""
    pairs = _uniform_pairs(spark, sf_dir)
    back = pairs.groupBy("section_id", geometry.down("qy", 2).alias("py"), geometry.down("qx", 2).alias("px"), "gene_id").agg(F.sum("p").alias("p"))
    parents = counts.squares(native_counts(spark, sf_dir), 8, ("py", "px")).withColumnRenamed("umi", "y")
    return metrics.error_report(back.join(parents, ["section_id", "py", "px", "gene_id"]), "section_id").select("section_id", "n", "max_abs", "within")


NLL = "sum(p - y*ln(greatest(p, 1e-12)))"


@query(PAIRS + f"SELECT section_id, gene_id, round({NLL} / greatest(sum(y), 1), 6) + 0.0 AS nll FROM pairs GROUP BY 1,2")
def poisson_nll(spark, sf_dir):
    return metrics.poisson_nll(_uniform_pairs(spark, sf_dir), "section_id", "gene_id").select("section_id", "gene_id", r6("nll").alias("nll"))


REGION = "CASE WHEN (qy + qx) % 3 = 0 THEN 'gap' WHEN qy % 5 = 0 THEN 'mixed' ELSE 'covered' END"


@query(PAIRS + f", g AS (SELECT *, {REGION} AS region FROM pairs), t AS (SELECT section_id, greatest(sum(y), 1) AS total FROM g GROUP BY 1) SELECT section_id, region, round({NLL} / any_value(total), 6) + 0.0 AS nll FROM g JOIN t USING (section_id) GROUP BY 1,2")
def region_nll(spark, sf_dir):
    pairs = _uniform_pairs(spark, sf_dir).withColumn("region", F.expr(REGION))
    return metrics.region_nll(pairs, "section_id").select("section_id", "region", r6("nll").alias("nll"))


@query(PAIRS + "SELECT section_id, round(sum(CASE WHEN y > 0 THEN y*ln(y/greatest(p, 1e-12)) ELSE 0 END + p - y) / greatest(sum(y), 1), 5) + 0.0 AS kl FROM pairs GROUP BY 1")
def allocation_kl(spark, sf_dir):
    return metrics.allocation_kl(_uniform_pairs(spark, sf_dir), "section_id").select("section_id", (F.round("kl", 5) + F.lit(0.0)).alias("kl"))


def _tilted_pairs(spark, sf_dir):
    """An allocation of 16 um parents to their four cells that differs by gene, next to the measured 8 um counts and the
    parent's count c."""
    native = native_counts(spark, sf_dir)
    children = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a in (0, 1) for b in (0, 1)]))
    truth = counts.squares(native, 4).withColumnRenamed("umi", "y")
    parents = truth.groupBy("section_id", geometry.down("qy", 2).alias("py"), geometry.down("qx", 2).alias("px"), "gene_id").agg(F.sum("y").alias("c")).withColumn("k", children)
    share = ((F.col("k.a") * 2 + F.col("k.b") + F.col("gene_id")) % 4 + 1) / 10.0
    split = parents.select("section_id", "py", "px", (F.col("py") * 2 + F.col("k.a")).alias("qy"), (F.col("px") * 2 + F.col("k.b")).alias("qx"), "gene_id", (F.col("c") * share).alias("p"), F.col("c").cast("double").alias("c"))
    return split.join(truth, ["section_id", "qy", "qx", "gene_id"], "left").withColumn("y", F.coalesce("y", F.lit(0)).cast("double"))


TILTED = PAIRS.rstrip() + """, tilted AS (SELECT s.section_id, s.py, s.px, s.qy, s.qx, s.gene_id, s.c*((s.i + s.gene_id) % 4 + 1)/10 AS p, s.c, CAST(coalesce(c8.umi, 0) AS DOUBLE) AS y
  FROM (SELECT section_id, py, px, py*2+a AS qy, px*2+b AS qx, a*2+b AS i, gene_id, CAST(umi AS DOUBLE) AS c FROM c16, (SELECT unnest([0,1]) AS a), (SELECT unnest([0,1]) AS b)) s
  LEFT JOIN c8 ON c8.section_id = s.section_id AND c8.qy = s.qy AND c8.qx = s.qx AND c8.gene_id = s.gene_id)
"""


@query(
    TILTED
    + """, m AS (SELECT section_id, qy, qx, sum(c/4 - p + y*(ln(greatest(p, 1e-12)) - ln(c/4))) AS f, sum(y*(ln(greatest(p, 1e-12)) - ln(c))) AS s, sum(p) AS tp, sum(y) AS ty, sum(c) AS tc FROM tilted GROUP BY 1,2,3)
    SELECT section_id, round(sum(f)/sum(ty), 6) + 0.0 AS full_gain, round(sum(tc/4 - tp + ty*(ln(tp) - ln(tc/4)))/sum(ty), 6) + 0.0 AS total_gain, round(sum(s - ty*(ln(tp) - ln(tc)))/sum(ty), 6) + 0.0 AS composition_gain FROM m GROUP BY 1"""
)
def gain_split(spark, sf_dir):
    """Gain of an allocation over a quarter of its parents: what totals of cells add, and what their composition adds."""
    g = metrics.gain_split(_tilted_pairs(spark, sf_dir), ["section_id"], ["qy", "qx"])
    return g.select("section_id", *[r6(c).alias(c) for c in ("full_gain", "total_gain", "composition_gain")])


RESIDUALS = ", s AS (SELECT *, CASE WHEN c = 1 THEN '1' WHEN c <= 4 THEN '2-4' ELSE '5+' END AS stratum, p - c/4 AS rp, y - c/4 AS ry FROM tilted WHERE c > 0)"


@query(
    TILTED
    + RESIDUALS
    + """, allp AS (SELECT section_id, (SELECT count(DISTINCT gene_id) FROM native_counts)*count(DISTINCT (py, px)) AS n FROM tilted GROUP BY 1),
    k AS (SELECT section_id, stratum, CAST(count(*)/4 AS BIGINT) AS parent_gene_pairs, sum(y) AS umis, round(-sum(y*(ln(greatest(p, 1e-12)) - ln(c)))/sum(y), 6) + 0.0 AS nll,
    round(ln(4) + sum(y*(ln(greatest(p, 1e-12)) - ln(c)))/sum(y), 6) + 0.0 AS gain, round(corr(rp, ry), 5) + 0.0 AS pcc, round(sqrt(sum(rp*rp)/sum(ry*ry)), 6) + 0.0 AS rms_ratio FROM s GROUP BY 1,2
    UNION ALL SELECT section_id, '0', n - (SELECT count(*)/4 FROM tilted t WHERE t.section_id = allp.section_id), 0, NULL, NULL, NULL, NULL FROM allp WHERE n > (SELECT count(*)/4 FROM tilted t WHERE t.section_id = allp.section_id))
    SELECT section_id, stratum, CAST(parent_gene_pairs AS BIGINT) AS parent_gene_pairs, round(parent_gene_pairs/n, 6) AS share, umis, nll, gain, pcc, rms_ratio FROM k JOIN allp USING (section_id)"""
)
def stratum_residuals(spark, sf_dir):
    """Residuals against a quarter of the parent, by parent count; parents without a gene's counts are a stratum too."""
    pairs = _tilted_pairs(spark, sf_dir).select("section_id", "py", "px", "qy", "qx", "gene_id", "p", "y", "c")
    genes = native_counts(spark, sf_dir).select("gene_id").distinct()
    cells = pairs.select("section_id", "py", "px", "qy", "qx").distinct().crossJoin(F.broadcast(genes))  # 16 genes
    zero = cells.join(pairs, ["section_id", "py", "px", "qy", "qx", "gene_id"], "left_anti").select("*", *[F.lit(0.0).alias(c) for c in "pyc"])
    s = metrics.stratum_scores(pairs.unionByName(zero), "section_id")
    return s.select("section_id", "stratum", "parent_gene_pairs", F.round("share", 6).alias("share"), "umis", r6("nll").alias("nll"), r6("gain").alias("gain"), (F.round("pcc", 5) + F.lit(0.0)).alias("pcc"), r6("rms_ratio").alias("rms_ratio"))


@query(
    TILTED
    + """, t AS (SELECT *, sum(p) OVER w AS tp, sum(y) OVER w AS ty, sum(c) OVER w AS tc, row_number() OVER (PARTITION BY section_id, qy, qx) AS k FROM tilted WINDOW w AS (PARTITION BY section_id, qy, qx)),
    r AS (SELECT section_id, 'gene' AS kind, p - c/4 AS a, y - c/4 AS b FROM t UNION ALL SELECT section_id, 'total', tp - tc/4, ty - tc/4 FROM t WHERE k = 1
      UNION ALL SELECT section_id, 'composition', p - c/greatest(tc, 1)*tp, y - c/greatest(tc, 1)*ty FROM t),
    m AS (SELECT section_id, kind, corr(a, b) AS pcc, sqrt(sum(a*a)/sum(b*b)) AS ratio FROM r GROUP BY 1, 2)
    SELECT section_id, """
    + ", ".join(f"round(max(pcc) FILTER (WHERE kind = '{k}'), 5) + 0.0 AS {k}_residual_pcc, round(max(ratio) FILTER (WHERE kind = '{k}'), 6) + 0.0 AS {k}_residual_rms_ratio" for k in ("gene", "total", "composition"))
    + " FROM m GROUP BY 1"
)
def gain_residuals(spark, sf_dir):
    """Residuals of genes, totals of cells and compositions."""
    g = metrics.gain_residuals(_tilted_pairs(spark, sf_dir), ["section_id"], ["qy", "qx"])
    return g.select("section_id", *[(F.round(c, 5 if c.endswith("pcc") else 6) + F.lit(0.0)).alias(c) for c in g.columns if c != "section_id"])


@query(TILTED + RESIDUALS + "SELECT section_id, gene_id % 3 AS gene_group, count(*) AS n, round(corr(rp, ry), 5) + 0.0 AS pcc, round(sqrt(sum(rp*rp)/sum(ry*ry)), 6) + 0.0 AS rms_ratio FROM s GROUP BY 1,2")
def gene_group_residuals(spark, sf_dir):
    """Parent residuals by groups of genes."""
    pairs = _tilted_pairs(spark, sf_dir)
    groups = pairs.select("gene_id").distinct().withColumn("gene_group", F.col("gene_id") % 3)
    rest = pairs.join(groups, "gene_id").select("section_id", "gene_group", (F.col("p") - F.col("c") / 4).alias("p"), (F.col("y") - F.col("c") / 4).alias("y"))
    s = metrics.flat_scores(rest, "section_id", "gene_group")
    return s.select("section_id", "gene_group", "n", (F.round("pcc", 5) + F.lit(0.0)).alias("pcc"), r6("rms_ratio").alias("rms_ratio"))


@query(
    PAIRS
    + f""", f AS (SELECT section_id, gene_id, {NLL} / greatest(sum(y), 1) AS nll FROM pairs GROUP BY 1,2), s AS (SELECT section_id, avg(nll) AS nll FROM f GROUP BY 1),
    p AS (SELECT section_id % 2 AS protocol_id, avg(nll) AS nll FROM s GROUP BY 1) SELECT round(avg(nll), 6) + 0.0 AS nll, count(nll) AS defined FROM p"""
)
def nested_means(spark, sf_dir):
    """Field to section to protocol to overall: a mean of means."""
    s = metrics.poisson_nll(_uniform_pairs(spark, sf_dir), "section_id", "gene_id").withColumn("protocol_id", F.col("section_id") % 2)
    return metrics.rolled_up(s, "nll", "protocol_id", "section_id", "gene_id").select(r6("nll").alias("nll"), "defined")


P16 = f"p16 AS (SELECT DISTINCT section_id, {F8.format('y')} AS py, {F8.format('x')} AS px FROM native_counts)"
TILED = "tiled AS (SELECT *, CAST(floor(py/12.0) AS BIGINT)*96 - 16 AS y0, CAST(floor(px/12.0) AS BIGINT)*96 - 16 AS x0 FROM p16)"
FIELDS = "fields AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY y0, x0) - 1 AS field_id FROM (SELECT DISTINCT section_id, y0, x0 FROM tiled))"
T = with_tables(NATIVE_SQL, P16, TILED, FIELDS)


def _parents16(spark, sf_dir):
    return counts.squares(native_counts(spark, sf_dir), 8, ("py", "px")).select("section_id", "py", "px").distinct()


@query(T + "SELECT section_id, py, px, y0, x0, field_id, CAST((py - floor(y0/8.0))*16 + (px - floor(x0/8.0)) AS BIGINT) AS slot FROM tiled JOIN fields USING (section_id, y0, x0)")
def core_tiling(spark, sf_dir):
    tiled = geometry.core_tiles(_parents16(spark, sf_dir))
    return tiled.join(F.broadcast(geometry.field_ids(tiled)), ["section_id", "y0", "x0"]).select("section_id", "py", "px", "y0", "x0", "field_id", "slot")


@query(
    T
    + """SELECT f.section_id, f.field_id, sy, sx, coalesce(p.py*1000 + p.px, -1) AS parent_id FROM (SELECT *, CAST(floor(y0/8.0) AS BIGINT) + sy AS gy, CAST(floor(x0/8.0) AS BIGINT) + sx AS gx FROM fields, (SELECT unnest(range(0, 16)) AS sy), (SELECT unnest(range(0, 16)) AS sx)) f
         LEFT JOIN p16 p ON p.section_id = f.section_id AND p.py = f.gy AND p.px = f.gx"""
)
def field_slots(spark, sf_dir):
    parents = _parents16(spark, sf_dir).withColumn("parent_id", F.col("py") * 1000 + F.col("px"))
    fields = geometry.field_ids(geometry.core_tiles(parents))
    return geometry.field_slots(fields, parents).select("section_id", "field_id", "sy", "sx", "parent_id").fillna(-1, ["parent_id"])


COVER = f"""cells AS (SELECT DISTINCT section_id, {F4.format('y')} AS qy, {F4.format('x')} AS qx FROM native_counts),
fs AS (SELECT section_id, y0, x0, (y0+16)*1000 + x0 + 16 AS field_id FROM sections, (SELECT unnest(range(-1, 4))*64 - 16 AS y0), (SELECT unnest(range(-1, 4))*64 - 16 AS x0)),
cover AS (SELECT c.*, y0, x0, field_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY c.section_id, qy, qx) AS weight FROM cells c JOIN fs ON fs.section_id = c.section_id
  AND qy*4 >= y0+16 AND qy*4+4 <= y0+16+96 AND qx*4 >= x0+16 AND qx*4+4 <= x0+16+96)"""
C = with_tables(NATIVE_SQL, SECTIONS_SQL, COVER)


def _covered(spark, sf_dir):
    native = native_counts(spark, sf_dir)
    cells = native.select("section_id", geometry.down("y", 4).alias("qy"), geometry.down("x", 4).alias("qx")).distinct()
    at = F.sequence(F.lit(-1).cast("long"), F.lit(3).cast("long"))
    fields = native.select("section_id").distinct().withColumn("a", F.explode(at)).withColumn("b", F.explode(at))
    fields = fields.select("section_id", (F.col("a") * 64 - 16).alias("y0"), (F.col("b") * 64 - 16).alias("x0"), (F.col("a") * 64000 + F.col("b") * 64).alias("field_id"))
    return geometry.covering_fields(cells, fields)


@query(C + "SELECT section_id, qy, qx, field_id, weight FROM cover")
def overlapping_cores(spark, sf_dir):
    return _covered(spark, sf_dir).select("section_id", "qy", "qx", "field_id", "weight")


@query(C + "SELECT section_id, qy, qx, round(sum(weight * ((field_id * 7 + qy * 3 + qx) % 11)), 6) + 0.0 AS value, round(sum(weight), 6) AS weights FROM cover GROUP BY 1,2,3")
def stitched_mean(spark, sf_dir):
    """Weighted mean of what overlapping fields say about a cell; weights add up to 1."""
    value = F.expr("CAST((field_id * 7 + qy * 3 + qx) % 11 AS DOUBLE)")
    out = _covered(spark, sf_dir).groupBy("section_id", "qy", "qx").agg(F.sum(F.col("weight") * value).alias("value"), F.sum("weight").alias("weights"))
    return out.select("section_id", "qy", "qx", r6("value").alias("value"), F.round("weights", 6).alias("weights"))


@query(
    N
    + """SELECT section_id, CAST(floor((y*2+1-8)/16.0) AS BIGINT) AS py, CAST(floor((x*2+1)/16.0) AS BIGINT) AS px, gene_id, CAST(sum(umi) AS BIGINT) AS umi FROM native_counts
         WHERE floor((y*2+1-8)/16.0) >= 0 AND floor((y*2+1-8)/16.0)*16 + 24 <= 512 GROUP BY 1,2,3,4"""
)
def shifted_parents(spark, sf_dir):
    at = geometry.shifted_parents(native_counts(spark, sf_dir), 8, 0, GRID)
    return at.groupBy("section_id", "py", "px", "gene_id").agg(F.sum("umi").alias("umi"))


@query(
    with_tables(SPOTS_SQL)
    + "SELECT spot_id, CAST((floor(cy/8.0+0.5)*8-128)/2 AS BIGINT) + dy AS y0, CAST((floor(cx/8.0+0.5)*8-128)/2 AS BIGINT) + dx AS x0 FROM spots, (SELECT unnest([-12,0,12]) AS dy), (SELECT unnest([-12,0,12]) AS dx)"
)
def anchor_fields(spark, sf_dir):
    return geometry.anchor_fields(spots(spark, sf_dir)).select("spot_id", "y0", "x0")


@query(
    with_tables(SPOTS_SQL, PIXELS_SQL, "wide AS (SELECT spot_id, y, x FROM spots JOIN pixels ON (2*y+1-cy)*(2*y+1-cy) + (2*x+1-cx)*(2*x+1-cx) <= 3600)")
    + f"SELECT {F4.format('y')} AS qy, {F4.format('x')} AS qx, CAST(CASE WHEN min(spot_id) = max(spot_id) THEN min(spot_id) ELSE -2 END AS BIGINT) AS spot_id, CAST(CASE WHEN min(spot_id) = max(spot_id) THEN count(*) ELSE 0 END AS BIGINT) AS area_px FROM wide GROUP BY 1,2"
)
def cell_claims(spark, sf_dir):
    claims = geometry.circle_pixels(spots(spark, sf_dir), 120.0, GRID, GRID).withColumn("section_id", F.lit(0))
    return geometry.cell_claims(claims).drop("section_id")
