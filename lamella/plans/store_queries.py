"""Queries over stores by block, feature parts, frozen layouts, exact neighbours and registered colours; all grow with the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lamella.operators import checks, geometry, image, neighbors
from lamella.operators.tasks import dealt
from lamella.plans.fixture import PANEL_SQL, WIDE, WIDE_SQL, panel, table, wide_counts, with_tables
from lamella.plans.image_queries import SIDE, T, _x, _y
from lamella.plans.registry import query, r6
from lamella.session import shared_folder
from lamella.sources import blocks
from lamella.sources.tables import write_new

N = WIDE // 64 - 1  # fields a side, 64 pixels apart
FIELDS = f"""sections AS (SELECT DISTINCT CAST(floor(s_suppkey / 9.0::DOUBLE) AS BIGINT) AS section_id FROM supplier),
  fields AS (SELECT section_id, CAST(i*{N} + j AS BIGINT) AS field_id, CAST(64*i AS BIGINT) AS y0, CAST(64*j AS BIGINT) AS x0 FROM sections, (SELECT unnest(range(0, {N})) AS i), (SELECT unnest(range(0, {N})) AS j))"""


def sections(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.expr("CAST(floor(s_suppkey / 9.0D) AS BIGINT)").alias("section_id")).distinct()


def fields(spark, sf_dir):
    """(section_id, field_id, y0, x0): 121 fields of every section, 64 pixels apart."""
    n = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(N - 1).cast("long")))
    at = sections(spark, sf_dir).withColumn("i", n).withColumn("j", n)
    return at.select("section_id", (F.col("i") * N + F.col("j")).alias("field_id"), (64 * F.col("i")).alias("y0"), (64 * F.col("j")).alias("x0"))


def folder(spark) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


CORNERS = "(y0 <= 128 OR y0 >= 512) AND (x0 <= 128 OR x0 >= 512)"


def _cache(spark, sf_dir):
    """The native cache of all blocks but the one in the middle."""
    path, n = folder(spark), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))
    listed = sections(spark, sf_dir).withColumn("block_y", n).withColumn("block_x", n).where("block_y <> 1 OR block_x <> 1")
    blocks.write_counts(wide_counts(spark, sf_dir), panel(spark), listed, path)
    return path


@query(
    with_tables(WIDE_SQL, PANEL_SQL, FIELDS)
    + f"""SELECT f.section_id, f.field_id, f.y0, f.x0, y - y0 AS ly, x - x0 AS lx, CAST(pos AS INTEGER) AS gene_index, CAST(umi AS INTEGER) AS count FROM fields f JOIN wide_counts c ON c.section_id = f.section_id AND y BETWEEN y0 AND y0 + 127 AND x BETWEEN x0 AND x0 + 127
    JOIN panel USING (gene_id) WHERE {CORNERS} AND (field_id + f.section_id) % 3 = 0"""
)
def native_cache(spark, sf_dir):
    """Counts of fields from a store by block, written and read back; fields open their own blocks only."""
    return blocks.field_counts(spark, _cache(spark, sf_dir), fields(spark, sf_dir).where(f"{CORNERS} AND (field_id + section_id) % 3 = 0"))


@query(
    with_tables(WIDE_SQL, PANEL_SQL, FIELDS)
    + """, b AS (SELECT section_id, CAST(i AS BIGINT) AS block_y, CAST(j AS BIGINT) AS block_x FROM sections, (SELECT unnest([0,1,2]) AS i), (SELECT unnest([0,1,2]) AS j) WHERE i <> 1 OR j <> 1),
    n AS (SELECT section_id, CAST(floor(y/256.0) AS BIGINT) AS block_y, CAST(floor(x/256.0) AS BIGINT) AS block_x, count(*) AS nnz FROM wide_counts JOIN panel USING (gene_id) GROUP BY 1, 2, 3)
    SELECT b.*, coalesce(nnz, 0) AS nnz, CAST(sum(coalesce(nnz, 0)) OVER w - coalesce(nnz, 0) AS BIGINT) AS start, CAST(sum(coalesce(nnz, 0)) OVER w AS BIGINT) AS stop
    FROM b LEFT JOIN n USING (section_id, block_y, block_x) WINDOW w AS (PARTITION BY section_id ORDER BY block_y, block_x)"""
)
def native_cache_index(spark, sf_dir):
    """Entries of every stored block and where they start."""
    return spark.read.parquet(f"{_cache(spark, sf_dir)}/index").select("section_id", "block_y", "block_x", "nnz", "start", "stop")


TOTALS = "totals AS (SELECT f.section_id, field_id, y0, x0, CAST(sum(umi) AS BIGINT) AS umi, count(DISTINCT gene_id) AS genes FROM fields f JOIN wide_counts c ON c.section_id = f.section_id AND y BETWEEN y0 AND y0 + 127 AND x BETWEEN x0 AND x0 + 127 GROUP BY 1, 2, 3, 4)"


def totals(spark, sf_dir):
    """(section_id, field_id, y0, x0, umi, genes) of fields that hold any count."""
    from lamella.operators.sampling import crops

    # Fields start on 64 pixels and are 128 wide: they take squares of 64 whole, so that these are summed first.
    corner = lambda c: (geometry.down(c, 64) * 64).alias(c)
    squares = wide_counts(spark, sf_dir).groupBy("section_id", corner("y"), corner("x"), "gene_id").agg(F.sum("umi").alias("umi"))
    met = crops(squares, fields(spark, sf_dir))
    each = met.groupBy("section_id", "field_id", "y0", "x0", "gene_id").agg(F.sum("umi").alias("umi"))
    return each.groupBy("section_id", "field_id", "y0", "x0").agg(F.sum("umi").alias("umi"), F.count("*").alias("genes"))


@query(with_tables(WIDE_SQL, FIELDS, TOTALS) + "SELECT section_id, field_id, 'train' AS role, section_id % 2 AS protocol_id, umi FROM totals WHERE section_id % 3 > 0 AND field_id % 5 = 0")
def gated_store(spark, sf_dir):
    """A store opened for training fields alone; sections of other roles are not read."""
    path = folder(spark)
    write_new(totals(spark, sf_dir).select("section_id", "field_id", "umi").repartition("section_id"), path, "section_id")
    role = F.when(F.col("section_id") % 3 == 0, "validation").otherwise("train")
    manifest = sections(spark, sf_dir).select("section_id", role.alias("role"), (F.col("section_id") % 2).alias("protocol_id"), F.lit(N * N).alias("fields"))
    asked = fields(spark, sf_dir).where("section_id % 3 > 0 AND field_id % 5 = 0").select("section_id", F.lit("train").alias("role"), (F.col("section_id") % 2).alias("protocol_id"), "field_id")
    return blocks.gated(spark.read.parquet(path), asked, manifest).select("section_id", "field_id", "role", "protocol_id", "umi")


@query(with_tables(WIDE_SQL, FIELDS, TOTALS) + "SELECT f.*, coalesce(umi, 0) AS umi, coalesce(genes, 0) AS genes FROM fields f LEFT JOIN totals USING (section_id, field_id, y0, x0) WHERE field_id % 6 = 1")
def feature_rows(spark, sf_dir):
    """Feature rows of fields from two parts of their section, the first 40 fields and the rest."""
    all_ = fields(spark, sf_dir).join(totals(spark, sf_dir), ["section_id", "field_id", "y0", "x0"], "left").fillna(0, ["umi", "genes"])
    part = (F.col("field_id") >= 40).cast("int")
    rows = all_.select("section_id", part.alias("part_id"), (F.col("field_id") - part * 40).alias("local"), F.col("y0").alias("py0"), F.col("x0").alias("px0"), "umi", "genes")
    own = sections(spark, sf_dir)
    parts = own.select("section_id", F.explode(F.array(*[F.struct(F.lit(i).alias("part_id"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("stop")) for i, a, b in ((0, 0, 40), (1, 40, N * N))])).alias("p")).select("section_id", "p.*")
    return blocks.feature_rows(fields(spark, sf_dir).where("field_id % 6 = 1"), parts, rows, own.withColumn("fields", F.lit(N * N)))


LATTICE = f"""lat AS (SELECT f.*, r AS lattice_row, k AS lattice_col, (section_id % 40) + r*50*sqrt(3) AS cy, (section_id % 30)*1.5::DOUBLE + r*50 + k*100 AS cx
  FROM fields f, (SELECT unnest(range(-2, {2 * WIDE // 86 + 3})) AS r), (SELECT unnest(range(-12, {2 * WIDE // 100 + 3})) AS k)),
  spots55 AS (SELECT section_id, field_id, y0, x0, lattice_row, lattice_col, cy, cx FROM lat WHERE cy - 27.5 >= 2*y0 AND cy + 27.5 <= 2*y0 + 256 AND cx - 27.5 >= 2*x0 AND cx + 27.5 <= 2*x0 + 256)"""


def lattice(at):
    return geometry.field_lattice(at, (F.col("section_id") % 40).cast("double"), (F.col("section_id") % 30) * 1.5)


@query(with_tables(FIELDS, LATTICE) + "SELECT section_id, field_id, y0, x0, lattice_row, lattice_col, round(cy, 6) AS cy, round(cx, 6) AS cx FROM spots55")
def lattice_crops(spark, sf_dir):
    """Complete spots of every field on its section's lattice."""
    return lattice(fields(spark, sf_dir)).select("section_id", "field_id", "y0", "x0", "lattice_row", "lattice_col", r6("cy").alias("cy"), r6("cx").alias("cx"))


@query(
    with_tables(FIELDS, LATTICE)
    + """, v AS (SELECT * FROM fields WHERE section_id % 3 = 0 AND field_id % 30 = 7), g AS (SELECT unnest(range(0, 128)) AS i),
    own AS (SELECT section_id, field_id, 'Spot55' AS task, s.i AS ly, t.i AS lx, 1000*lattice_row + lattice_col AS parent_id FROM spots55, g s, g t WHERE section_id % 3 = 0 AND field_id % 30 = 7 AND field_id % 2 = 1
        AND (2*(y0 + s.i) + 1 - cy)*(2*(y0 + s.i) + 1 - cy) + (2*(x0 + t.i) + 1 - cx)*(2*(x0 + t.i) + 1 - cx) <= 756.25
      UNION ALL SELECT section_id, field_id, 'HD16', s.i, t.i, (s.i//8)*16 + t.i//8 FROM v, g s, g t WHERE field_id % 2 = 0)
    SELECT section_id, field_id, task, count(*) AS pixels, count(DISTINCT parent_id) AS parents, CAST(sum(parent_id*(ly + 2*lx)) AS BIGINT) AS mark FROM own GROUP BY 1, 2, 3"""
)
def frozen_layouts(spark, sf_dir):
    """Owner maps of validation fields: squares are computed, circles come from the store if their digest still holds."""
    at = fields(spark, sf_dir).where("section_id % 3 = 0 AND field_id % 30 = 7")
    circle = geometry.circle_pixels(lattice(at), 55.0, WIDE, WIDE)
    owners = circle.select("section_id", "field_id", (F.col("y") - F.col("y0")).alias("ly"), (F.col("x") - F.col("x0")).alias("lx"), (1000 * F.col("lattice_row") + F.col("lattice_col")).alias("parent_id"))
    path = folder(spark)
    write_new(owners, f"{path}/owners")
    owners = spark.read.parquet(f"{path}/owners")
    write_new(at.join(dealt(blocks.layout_digest(owners, "section_id", "field_id")), ["section_id", "field_id"]).withColumn("role", F.lit("validation")), f"{path}/layouts")
    asked = at.withColumn("task", F.when(F.col("field_id") % 2 == 0, "HD16").otherwise("Spot55"))
    found = blocks.frozen_owners(asked, spark.read.parquet(f"{path}/layouts"), owners)
    return found.groupBy("section_id", "field_id", "task").agg(F.count("*").alias("pixels"), F.count_distinct("parent_id").alias("parents"), F.sum(F.col("parent_id") * (F.col("ly") + 2 * F.col("lx"))).alias("mark"))


#: Customers in dense clusters, and one in fifty far away.
PLACES = """places AS (SELECT CAST(floor(c_custkey / 100.0::DOUBLE) AS BIGINT) AS section_id, CAST(c_custkey AS BIGINT) AS id,
  CAST(CASE WHEN c_custkey % 50 = 0 THEN 5000 + c_custkey % 700 ELSE c_custkey*37 % 41 END AS BIGINT) AS cy, CAST(CASE WHEN c_custkey % 50 = 0 THEN c_custkey*3 % 9000 ELSE c_custkey*61 % 53 END AS BIGINT) AS cx FROM customer)"""


@query(
    with_tables(PLACES)
    + """, d AS (SELECT a.section_id, a.id, b.id AS other, (a.cy-b.cy)*(a.cy-b.cy) + (a.cx-b.cx)*(a.cx-b.cx) AS d2 FROM places a JOIN places b USING (section_id) WHERE b.id % 3 > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY section_id, id ORDER BY d2, other) AS rank FROM d) SELECT section_id, id, other, CAST(d2 AS DOUBLE) AS d2, rank FROM r WHERE rank <= 8"""
)
def nearest_anywhere(spark, sf_dir):
    """Eight nearest others of clustered and of lonely points, at any distance."""
    key = lambda e, n: F.expr(f"CAST({e} AS BIGINT)").alias(n)
    at = table(spark, sf_dir, "customer").select(
        key("floor(c_custkey / 100.0D)", "section_id"), key("c_custkey", "id"), key("CASE WHEN c_custkey % 50 = 0 THEN 5000 + c_custkey % 700 ELSE c_custkey * 37 % 41 END", "cy"), key("CASE WHEN c_custkey % 50 = 0 THEN c_custkey * 3 % 9000 ELSE c_custkey * 61 % 53 END", "cx")
    )
    others = at.where("id % 3 > 0").select("section_id", F.col("id").alias("other"), F.col("cy").alias("oy"), F.col("cx").alias("ox"))
    return neighbors.nearest_any(at, others, 8, ["id"], 16.0).select("section_id", "id", "other", "d2", "rank")


IMG = f"""img AS (SELECT CAST(floor(l_suppkey / 9.0::DOUBLE) AS BIGINT) AS section_id, CAST((l_orderkey * 5 + l_linenumber) % {SIDE} AS BIGINT) AS py, CAST((l_partkey * 3 + l_linenumber * 7) % {SIDE} AS BIGINT) AS px,
  CAST(max(l_quantity * 5) AS INTEGER) AS r, CAST(min(l_quantity * 4 + 40) AS INTEGER) AS g, CAST(max(l_linenumber * 30) AS INTEGER) AS b FROM lineitem GROUP BY 1,2,3)"""
SAMPLES = 28
AT_X, AT_Y = f"(2.0::DOUBLE*x0 + (j + 0.5::DOUBLE)*256/{SAMPLES})", f"(2.0::DOUBLE*y0 + (i + 0.5::DOUBLE)*256/{SAMPLES})"


@query(
    with_tables(IMG, FIELDS)
    + f""", f AS (SELECT * FROM fields WHERE y0 IN (0, 64, 192) AND x0 IN (0, 128, 192)),
    s AS (SELECT section_id, field_id, i, j, {_x(AT_X, AT_Y)} AS u, {_y(AT_X, AT_Y)} AS v FROM f, (SELECT unnest(range(0, {SAMPLES})) AS i), (SELECT unnest(range(0, {SAMPLES})) AS j)),
    c AS (SELECT *, u >= -0.5 AND u < {SIDE - 0.5} AND v >= -0.5 AND v < {SIDE - 0.5} AS valid, greatest(0, least({SIDE - 1}, u)) AS cu, greatest(0, least({SIDE - 1}, v)) AS cv FROM s),
    k AS (SELECT section_id, field_id, i, j, least({SIDE - 1}, CAST(floor(cv) AS BIGINT) + a) AS py, least({SIDE - 1}, CAST(floor(cu) AS BIGINT) + b) AS px, (CASE WHEN a = 1 THEN cv - floor(cv) ELSE 1 - cv + floor(cv) END)*(CASE WHEN b = 1 THEN cu - floor(cu) ELSE 1 - cu + floor(cu) END) AS w
      FROM c, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b) WHERE valid),
    m AS (SELECT k.section_id, field_id, i, j, sum(w*coalesce(r, 255))/255 AS r, sum(w*coalesce(g, 255))/255 AS g, sum(w*coalesce(b, 255))/255 AS b FROM k LEFT JOIN img ON img.section_id = k.section_id AND img.py = k.py AND img.px = k.px GROUP BY 1, 2, 3, 4)
    SELECT section_id, field_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(coalesce(m.r, 1) + 1e-9, 6) AS r, round(coalesce(m.g, 1) + 1e-9, 6) AS g, round(coalesce(m.b, 1) + 1e-9, 6) AS b, valid FROM c LEFT JOIN m USING (section_id, field_id, i, j)"""
)
def registered_colours(spark, sf_dir):
    """Colours of fields pulled through the registration; fields at the edge reach beyond the image."""
    key = lambda e, n: F.expr(f"CAST({e} AS BIGINT)").alias(n)
    rows = table(spark, sf_dir, "lineitem").select(key("floor(l_suppkey / 9.0D)", "section_id"), key(f"(l_orderkey * 5 + l_linenumber) % {SIDE}", "py"), key(f"(l_partkey * 3 + l_linenumber * 7) % {SIDE}", "px"), "l_quantity", "l_linenumber")
    pixels = rows.groupBy("section_id", "py", "px").agg(F.max(F.col("l_quantity") * 5).cast("int").alias("r"), F.min(F.col("l_quantity") * 4 + 40).cast("int").alias("g"), F.max(F.col("l_linenumber") * 30).cast("int").alias("b"))
    at = fields(spark, sf_dir).where("y0 IN (0, 64, 192) AND x0 IN (0, 128, 192)")
    out = image.registered_colours(at, pixels, T, SIDE, SIDE, SAMPLES)
    return out.select("section_id", "field_id", "i", "j", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in "rgb"], "valid")


RUNS = """runs AS (SELECT section_id, y, x, gene_id, CAST(umi AS DOUBLE) + CASE WHEN section_id % 3 = 0 AND gene_id = 3 THEN 0.5 ELSE 0.0 END AS p, CAST(umi AS DOUBLE) AS y_ FROM wide_counts)"""


@query(with_tables(WIDE_SQL, RUNS) + "SELECT section_id, count(*) AS n, bool_and(abs(p - y_) <= 1e-6 + 1e-5 * y_) AS passed, max(abs(p - y_)) AS max_absolute_error FROM runs GROUP BY 1")
def replay_comparison(spark, sf_dir):
    """Two runs, one of which is off by a half for one gene in every third section."""
    earlier = wide_counts(spark, sf_dir).withColumnRenamed("umi", "value")
    off = F.when((F.col("section_id") % 3 == 0) & (F.col("gene_id") == 3), 0.5).otherwise(0.0)
    return checks.replayed(earlier.withColumn("value", F.col("value") + off), earlier, ["section_id", "y", "x", "gene_id"])


REUSED = """blocks AS (SELECT section_id, CAST(floor(y / 64.0) AS BIGINT) AS i, CAST(floor(x / 64.0) AS BIGINT) AS j, CAST(sum(umi) AS DOUBLE) AS total FROM wide_counts GROUP BY 1, 2, 3)"""


@query(
    with_tables(WIDE_SQL, FIELDS, REUSED)
    + """SELECT f.section_id, field_id, y0, x0, coalesce(sum(total), 0.0) / 4 AS density FROM fields f LEFT JOIN blocks b
      ON b.section_id = f.section_id AND i BETWEEN y0 // 64 AND y0 // 64 + 1 AND j BETWEEN x0 // 64 AND x0 // 64 + 1 GROUP BY 1, 2, 3, 4"""
)
def reused_features(spark, sf_dir):
    """Features of a cache that holds just the wanted fields: four blocks of 64 pixels a field."""
    at = lambda c: geometry.down(c, 64)
    blocks_ = wide_counts(spark, sf_dir).groupBy("section_id", at("y").alias("i"), at("x").alias("j")).agg(F.sum("umi").cast("double").alias("total"))
    f = fields(spark, sf_dir)
    cell = f.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("section_id", "field_id", "cell", (at("y0") + F.floor(F.col("cell") / 2)).alias("i"), (at("x0") + F.col("cell") % 2).alias("j"))
    features = cell.join(blocks_, ["section_id", "i", "j"], "left").select("section_id", "field_id", "cell", F.coalesce("total", F.lit(0.0)).alias("density"))
    return checks.reused(f, f, features, 4)
