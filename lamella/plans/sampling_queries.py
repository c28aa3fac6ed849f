"""Queries over sampling, splits and validation series."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.operators import sampling
from lamella.plans.count_queries import N
from lamella.plans.fixture import native_counts, table
from lamella.plans.registry import query, r6

#: Sections of about 50 customers, so that their number grows with the table.
ITEMS = "items AS (SELECT CAST(floor(o_custkey / 50.0) AS BIGINT) AS section_id, o_orderkey AS field FROM orders)"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 50.0).cast("long").alias("section_id"), F.col("o_orderkey").alias("field"))


def order_sql(seed: int, keys: str, item: str = "field") -> str:
    return f"row_number() OVER (PARTITION BY {keys} ORDER BY sha256(concat_ws(':', '{seed}', {', '.join(f'CAST({k.strip()} AS VARCHAR)' for k in keys.split(','))}, CAST({item} AS VARCHAR))), {item}) - 1"


@query(f"WITH {ITEMS} SELECT section_id, field, {order_sql(11, 'section_id')} AS position FROM items")
def shuffled_fields(spark, sf_dir):
    return sampling.shuffled(_items(spark, sf_dir), 11, ["section_id"], "field")


@query(
    f"""WITH {ITEMS}, s AS (SELECT section_id, count(*) AS size FROM items GROUP BY 1),
    d AS (SELECT section_id, draw, CAST(floor(draw / (size * 1.0::DOUBLE)) AS BIGINT) AS cycle, draw % size AS position FROM s, (SELECT unnest(range(10000, 15000)) AS draw)),
    o AS (SELECT section_id, cycle, field, {order_sql(7, 'section_id, cycle')} AS position FROM items JOIN (SELECT DISTINCT section_id, cycle FROM d) USING (section_id))
    SELECT section_id, draw, cycle, field FROM d JOIN o USING (section_id, cycle, position)"""
)
def epoch_draw(spark, sf_dir):
    """Third epoch of 5,000 draws a section from shuffled cycles."""
    return sampling.epoch_draw(_items(spark, sf_dir), 7, 3, 5000, ["section_id"], "field").select("section_id", F.col("draw").cast("long").alias("draw"), "cycle", "field")


@query(f"WITH {ITEMS}, q AS (SELECT section_id, count(*)/7.0::DOUBLE AS q FROM items GROUP BY 1) SELECT section_id, e AS epoch, CAST(floor(e*q + 0.5 + 1e-9) - floor((e-1)*q + 0.5 + 1e-9) AS BIGINT) AS due FROM q, (SELECT unnest(range(1, 61)) AS e)")
def cumulative_quota(spark, sf_dir):
    """What every section owes in each of 60 epochs at a seventh of its fields an epoch."""
    per_epoch = _items(spark, sf_dir).groupBy("section_id").agg((F.count("*") / 7.0).alias("q"))
    each = per_epoch.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(60).cast("long"))))
    return each.select("section_id", "epoch", sampling.quota(F.col("epoch").cast("double"), F.col("q")).alias("due"))


VIEWS = f"""{ITEMS}, o AS (SELECT *, CAST((row_number() OVER (PARTITION BY section_id ORDER BY field) - 1) % 4 AS INTEGER) AS s,
  CAST(CAST('0x' || substr(sha256(concat_ws(':', '9', CAST(section_id AS VARCHAR), CAST(field AS VARCHAR))), 1, 16) AS UBIGINT) % 9223372036854775807 % 3 + 1 AS INTEGER) AS k FROM items),
  views AS (SELECT section_id, field, s AS stratum, CAST(v AS INTEGER) AS view, CASE WHEN v = 0 THEN s ELSE xor(s, k) END AS phase FROM o, (SELECT unnest([0, 1]) AS v))"""


@query(f"WITH {VIEWS} SELECT * FROM views")
def phase_views(spark, sf_dir):
    return sampling.phase_views(_items(spark, sf_dir), 2, "field", ["section_id"], seed=9).select("section_id", "field", F.col("stratum").cast("int").alias("stratum"), "view", "phase")


@query(f"WITH {VIEWS} SELECT section_id, field, stratum, CAST(v AS INTEGER) AS view, CAST((stratum + v) % 4 AS INTEGER) AS phase FROM views, (SELECT unnest(range(0, 4)) AS v) WHERE view = 0")
def four_phase_views(spark, sf_dir):
    return sampling.phase_views(_items(spark, sf_dir), 4, "field", ["section_id"]).select("section_id", "field", F.col("stratum").cast("int").alias("stratum"), "view", "phase")


@query(f"WITH {VIEWS} SELECT section_id, phase, count(*) AS n FROM views GROUP BY 1, 2")
def phase_balance(spark, sf_dir):
    views = sampling.phase_views(_items(spark, sf_dir), 2, "field", ["section_id"], seed=9)
    return views.groupBy("section_id", "phase").agg(F.count("*").alias("n"))


@query(f"WITH {ITEMS}, e AS (SELECT section_id, CAST(ceil(count(*)/3.0) AS BIGINT) AS n FROM items GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS fields_per_epoch, CAST(ceil(sum(n)/16.0) AS BIGINT) AS steps_per_epoch, CAST(ceil(sum(n)/16.0)*240 AS BIGINT) AS steps, CAST((sum(n)-1) % 16 + 1 AS BIGINT) AS last_batch FROM e")
def exposure_plan(spark, sf_dir):
    """A third of every section's fields an epoch."""
    items = _items(spark, sf_dir)
    budgets = items.groupBy("section_id").agg(F.ceil(F.count("*") / 3).alias("budget"), F.lit(1).alias("floor"))
    return sampling.exposure_plan(items, budgets, 16, 240)


#: Sections of 50 customers that have 12 orders or more, of which an epoch takes four.
LARGE = f"{ITEMS}, pool AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY field) - 1 AS k FROM items WHERE section_id IN (SELECT section_id FROM items GROUP BY 1 HAVING count(*) >= 12))"


def _large(spark, sf_dir):
    items = _items(spark, sf_dir)
    return items.join(items.groupBy("section_id").count().where("count >= 12").select("section_id"), "section_id", "left_semi")


@query(f"WITH {LARGE} SELECT section_id, k AS draw, field FROM pool WHERE k BETWEEN 8 AND 11")
def fresh_draw(spark, sf_dir):
    """Third epoch of four fresh items a section: none comes twice."""
    return sampling.epoch_draw(_large(spark, sf_dir), 7, 3, 4, ["section_id"], "field", "fresh").select("section_id", F.col("draw").cast("long").alias("draw"), "field")


@query(
    f"""WITH {LARGE}, s AS (SELECT section_id, count(*) AS size FROM pool GROUP BY 1),
    d AS (SELECT section_id, draw, CAST(floor(draw/(size*1.0::DOUBLE)) AS BIGINT) AS cycle, draw % size AS position FROM s, (SELECT unnest(range(60, 120)) AS draw)),
    o AS (SELECT section_id, cycle, field, CASE WHEN cycle = 0 THEN k ELSE {order_sql(7, 'section_id, cycle')} END AS position FROM pool JOIN (SELECT DISTINCT section_id, cycle FROM d) USING (section_id))
    SELECT section_id, draw, cycle, field FROM d JOIN o USING (section_id, cycle, position)"""
)
def fresh_then_cycles(spark, sf_dir):
    """Second epoch of 60: in their own order as long as they last, shuffled afterwards."""
    drawn = sampling.epoch_draw(_large(spark, sf_dir), 7, 2, 60, ["section_id"], "field", "fresh_then_shuffled_cycles")
    return drawn.select("section_id", F.col("draw").cast("long").alias("draw"), "cycle", "field")


@query(f"WITH {ITEMS} SELECT section_id, field, row_number() OVER (ORDER BY sha256(concat_ws(':', '3', '5', CAST(section_id AS VARCHAR), CAST(field AS VARCHAR))), section_id, field) - 1 AS place FROM items")
def global_epoch_order(spark, sf_dir):
    """All items in one order, although no task sees more than its range of it."""
    return sampling.epoch_order(_items(spark, sf_dir), 3, 5, ["section_id", "field"])


@query(
    f"""WITH {ITEMS}, j AS (SELECT section_id, field, sha256('[5,' || section_id || ',' || field || ',"random_owner"]') AS h FROM items)
    SELECT section_id, field, CAST(CAST('0x' || array_to_string([substr(h, 15 - 2*i, 2) FOR i IN range(0, 8)], '') AS UBIGINT) % 9223372036854775807 AS BIGINT) AS seed FROM j"""
)
def mask_seeds(spark, sf_dir):
    """Seed of every item's random owners: little-endian hash of a compact JSON list."""
    text = F.concat(F.lit("[5,"), F.col("section_id"), F.lit(","), F.col("field"), F.lit(',"random_owner"]'))
    return _items(spark, sf_dir).withColumn("seed", sampling.seed_column(text))


@query(f"WITH {ITEMS} SELECT section_id, field, p AS position FROM (SELECT section_id, field, {order_sql(13, 'section_id, epoch')} AS p FROM (SELECT *, 5 AS epoch FROM items)) WHERE p < 64")
def epoch_sample(spark, sf_dir):
    return sampling.epoch_sample(_items(spark, sf_dir), 13, 5, 64, ["section_id"], "field")


@query(f"WITH {ITEMS}, p AS (SELECT section_id, field AS a, field + 1 + field % 3 AS b FROM items) SELECT section_id, a, b FROM (SELECT section_id, a, b, row_number() OVER (PARTITION BY section_id ORDER BY sha256(concat_ws(':', '17', CAST(section_id AS VARCHAR), concat_ws('-', CAST(a AS VARCHAR), CAST(b AS VARCHAR)))), concat_ws('-', CAST(a AS VARCHAR), CAST(b AS VARCHAR))) AS k FROM p) WHERE k = 1")
def chosen_pairs(spark, sf_dir):
    pairs = _items(spark, sf_dir).select("section_id", F.col("field").alias("a"), (F.col("field") + 1 + F.col("field") % 3).alias("b"))
    return sampling.chosen_pair(pairs, 17, ["section_id"], "a", "b")


@query("SELECT o_orderkey, round(CASE WHEN d <= 100 THEN 3e-4*d/100 ELSE 1e-5 + (3e-4 - 1e-5)*0.5*(1 + cos(pi()*least(1.0::DOUBLE, (d - 100)/900.0::DOUBLE))) END, 9) + 0.0 AS rate FROM (SELECT o_orderkey, CAST(o_orderkey % 1200 + 1 AS DOUBLE) AS d FROM orders)")
def learning_rates(spark, sf_dir):
    step = F.col("o_orderkey") % 1200
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.round(sampling.learning_rate(step, 3e-4, 1e-5, 100, 1000), 9) + F.lit(0.0)).alias("rate"))


@query(f"WITH {ITEMS} SELECT protocol, field, CAST(2*(k-1) + protocol AS BIGINT) AS place FROM (SELECT field, section_id % 2 AS protocol, row_number() OVER (PARTITION BY section_id % 2 ORDER BY field) AS k FROM items) WHERE k <= 500")
def alternating_protocols(spark, sf_dir):
    items = _items(spark, sf_dir).select("field", (F.col("section_id") % 2).alias("protocol"))
    return sampling.interleaved(items, "protocol", "field", 500).select("protocol", "field", F.col("place").cast("long").alias("place"))


@query(f"WITH {ITEMS} SELECT section_id, field FROM (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY field) AS k FROM items) WHERE k <= 8")
def monitor_fields(spark, sf_dir):
    return sampling.first_of_each(_items(spark, sf_dir), 8, ["section_id"], "field").select("section_id", "field")


@query(f"WITH {ITEMS} SELECT CAST(ceil(max(e)/5.0)*5 AS BIGINT) AS epochs FROM (SELECT ceil(count(*)/100.0) AS e FROM items GROUP BY section_id)")
def coverage_epochs(spark, sf_dir):
    return sampling.coverage_epochs(_items(spark, sf_dir), 100, 5)


@query(
    N
    + """, m AS (SELECT section_id, gene_id, avg(umi) AS m, var_samp(umi) AS v FROM native_counts GROUP BY 1,2),
    r AS (SELECT gene_id, avg(r) AS score FROM (SELECT gene_id, percent_rank() OVER (PARTITION BY section_id ORDER BY round(v/m, 9)) AS r FROM m WHERE m > 0 AND v IS NOT NULL) GROUP BY 1)
    SELECT gene_id, gene_id IN (3, 5) AS marker, round(score, 6) + 0.0 AS score FROM r ORDER BY gene_id IN (3, 5) DESC, round(score, 9) DESC, gene_id LIMIT 8"""
)
def variable_genes(spark, sf_dir):
    """A panel of eight genes, two of them markers: the limit is the size of the panel."""
    native = native_counts(spark, sf_dir)
    markers = native.select("gene_id").distinct().where("gene_id IN (3, 5)")
    return sampling.variable_genes(native, markers, 8).select("gene_id", "marker", r6("score").alias("score"))


#: A run a customer: a handful of validations each, however many orders there are.
RUNS = "runs AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS epoch, CAST(o_totalprice AS DOUBLE) AS hd16, CAST(o_orderkey % 101 AS DOUBLE) AS spot55 FROM orders)"


def _runs(spark, sf_dir):
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), "o_orderkey", F.col("o_totalprice").cast("double").alias("hd16"), (F.col("o_orderkey") % 101).cast("double").alias("spot55"))
    return o.withColumn("epoch", F.row_number().over(Window.partitionBy("run").orderBy("o_orderkey")).cast("long")).drop("o_orderkey")


@query(f"WITH {RUNS} SELECT run, epoch, hd16 FROM (SELECT *, min(hd16) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM runs) WHERE b IS NULL OR hd16 < b")
def running_best(spark, sf_dir):
    return sampling.running_best(_runs(spark, sf_dir), "hd16").select("run", "epoch", "hd16")


def stopping_sql(runs: str) -> str:
    """Early stopping over runs (run, epoch from 1, hd16, spot55): bounds 20000 and 0, gains 5000 and 10, patience 3, not before 4."""
    return f"""WITH RECURSIVE {runs}, f AS (
      SELECT run, epoch, epoch AS best_epoch, 0 AS stale, CAST(-1 AS BIGINT) AS stopped, hd16 AS bh, spot55 AS bs, hd16 AS fh, spot55 AS fs FROM runs WHERE epoch = 1
      UNION ALL
      SELECT run, epoch, CASE WHEN ok THEN epoch ELSE best_epoch END, st, CASE WHEN stopped < 0 AND st >= 3 AND epoch >= 4 THEN epoch ELSE stopped END, CASE WHEN ok THEN hd16 ELSE bh END, CASE WHEN ok THEN spot55 ELSE bs END, fh, fs
      FROM (SELECT *, CASE WHEN ok THEN 0 ELSE stale + 1 END AS st FROM (
        SELECT r.run, r.epoch, r.hd16, r.spot55, f.best_epoch, f.stale, f.stopped, f.bh, f.bs, f.fh, f.fs,
          f.stopped < 0 AND r.hd16 - least(bh, fh) < 20000 AND r.spot55 - least(bs, fs) <= 0 AND (bh - r.hd16 > 5000 OR bs - r.spot55 > 10) AS ok
        FROM f JOIN runs r ON r.run = f.run AND r.epoch = f.epoch + 1)))
    SELECT run, best_epoch, stopped FROM f JOIN (SELECT run, max(epoch) AS epoch FROM runs GROUP BY 1) USING (run, epoch)"""


POLICY = {"bounds": {"hd16": 20000.0, "spot55": 0.0}, "patience": 3, "minimum": 4, "gains": {"hd16": 5000.0, "spot55": 10.0}}


@query(stopping_sql(RUNS))
def early_stopping(spark, sf_dir):
    return sampling.early_stopping(_runs(spark, sf_dir), ["hd16", "spot55"], **POLICY)


FIELDS = "fields AS (SELECT DISTINCT l_suppkey % 4 AS section_id, CAST((l_orderkey % 40) * 32 AS BIGINT) AS y0, CAST((l_partkey % 40) * 32 AS BIGINT) AS x0 FROM lineitem)"
BLOCKS = "blocks AS (SELECT DISTINCT s_suppkey % 4 AS section_id, CAST((s_suppkey % 3) * 512 AS BIGINT) AS oy, CAST((s_nationkey % 2) * 512 + 100 AS BIGINT) AS ox FROM supplier)"
OVERLAP = "b.section_id = f.section_id AND y0 < oy + 256 AND y0 + 128 > oy AND x0 < ox + 256 AND x0 + 128 > ox"


def _fields(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).alias("section_id"), ((F.col("l_orderkey") % 40) * 32).cast("long").alias("y0"), ((F.col("l_partkey") % 40) * 32).cast("long").alias("x0")).distinct()


def _blocks(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 4).alias("section_id"), ((F.col("s_suppkey") % 3) * 512).cast("long").alias("by"), ((F.col("s_nationkey") % 2) * 512 + 100).cast("long").alias("bx")).distinct()


@query(f"WITH {FIELDS}, {BLOCKS} SELECT * FROM fields f WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE {OVERLAP})")
def fields_outside_blocks(spark, sf_dir):
    return sampling.outside_blocks(_fields(spark, sf_dir), _blocks(spark, sf_dir))


@query(f"WITH {FIELDS}, {BLOCKS} SELECT * FROM fields f WHERE EXISTS (SELECT 1 FROM blocks b WHERE b.section_id = f.section_id AND y0 >= oy AND y0 + 128 <= oy + 256 AND x0 >= ox AND x0 + 128 <= ox + 256)")
def fields_inside_blocks(spark, sf_dir):
    return sampling.inside_blocks(_fields(spark, sf_dir), _blocks(spark, sf_dir))


@query(f"WITH {FIELDS} SELECT section_id, y0, x0, CASE WHEN x0 + 128 <= 640 THEN 'support' ELSE 'selection' END AS side FROM fields WHERE x0 + 128 <= 640 OR x0 >= 640")
def support_and_selection(spark, sf_dir):
    return sampling.sides(_fields(spark, sf_dir), 640)


@query(
    N
    + """, f AS (SELECT DISTINCT section_id, CAST(floor(y/64.0)*64 AS BIGINT) - 64 AS y0, CAST(floor(x/64.0)*64 AS BIGINT) AS x0 FROM native_counts WHERE gene_id <> 3)
    SELECT section_id, y0, x0, gene_id, count(*) AS n, CAST(sum(umi) AS BIGINT) AS umi, CAST(sum((y-y0)*128 + x - x0) AS BIGINT) AS place FROM native_counts JOIN f USING (section_id) WHERE y >= y0 AND y < y0+128 AND x >= x0 AND x < x0+128 GROUP BY 1,2,3,4"""
)
def field_crops(spark, sf_dir):
    """Counts of overlapping fields of 128 pixels at a stride of 64."""
    native = native_counts(spark, sf_dir)
    at = lambda v: F.floor(F.col(v) / 64.0).cast("long") * 64
    fields = native.where("gene_id <> 3").select("section_id", (at("y") - 64).alias("y0"), at("x").alias("x0")).distinct()
    return sampling.crops(native, fields).groupBy("section_id", "y0", "x0", "gene_id").agg(F.count("*").alias("n"), F.sum("umi").alias("umi"), F.sum(F.col("ly") * 128 + F.col("lx")).alias("place"))


SPLIT = "s AS (SELECT s_suppkey AS section_id, CASE WHEN s_suppkey % 7 = 0 THEN 'test' ELSE 'dev' END AS role, CASE WHEN s_suppkey % 7 = 0 AND s_suppkey % 2 = 0 THEN NULL WHEN s_suppkey % 11 = 3 THEN NULL ELSE s_suppkey % 5 END AS fold FROM supplier UNION ALL SELECT s_suppkey, 'test', NULL FROM supplier WHERE s_suppkey % 13 = 0)"


@query(
    f"""WITH {SPLIT} SELECT (SELECT count(*) FROM (SELECT section_id FROM s GROUP BY 1 HAVING count(DISTINCT role) > 1)) AS two_roles,
    (SELECT count(*) FROM (SELECT section_id FROM s WHERE role = 'test' INTERSECT SELECT section_id FROM s WHERE fold IS NOT NULL)) AS tested_in_fold,
    (SELECT count(*) FROM (SELECT section_id FROM s WHERE role = 'dev' EXCEPT ALL SELECT section_id FROM s WHERE role = 'dev' AND fold IS NOT NULL)) AS without_fold"""
)
def split_faults(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("section_id"), F.expr("CASE WHEN s_suppkey % 7 = 0 THEN 'test' ELSE 'dev' END").alias("role"),
        F.expr("CASE WHEN s_suppkey % 7 = 0 AND s_suppkey % 2 = 0 THEN NULL WHEN s_suppkey % 11 = 3 THEN NULL ELSE s_suppkey % 5 END").alias("fold"),
    )
    again = s.where("section_id % 13 = 0").select("section_id", F.lit("test").alias("role"), F.lit(None).cast("long").alias("fold"))
    return sampling.split_faults(s.withColumn("fold", F.col("fold").cast("long")).unionByName(again))


@query("SELECT o_orderkey, CAST(CAST('0x' || substr(sha256(concat_ws(':', '5', CAST(o_orderkey AS VARCHAR))), 1, 16) AS UBIGINT) % 9223372036854775807 AS BIGINT) AS seed FROM orders")
def retry_seeds(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", sampling.retry_seed(F.concat_ws(":", F.lit("5"), F.col("o_orderkey").cast("string"))).alias("seed"))


@query("WITH g AS (SELECT o_custkey % 9 AS test_group, o_custkey % 40 AS section_id, avg(o_totalprice) AS score FROM orders GROUP BY 1, 2) SELECT round(avg(m), 4) AS score, count(*) AS groups FROM (SELECT test_group, avg(score) AS m FROM g GROUP BY 1)")
def held_out_groups(spark, sf_dir):
    """Sections of one group count once: the mean of group means."""
    g = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 9).alias("test_group"), (F.col("o_custkey") % 40).alias("section_id")).agg(F.avg("o_totalprice").alias("score"))
    return g.groupBy("test_group").agg(F.avg("score").alias("m")).agg(F.round(F.avg("m"), 4).alias("score"), F.count("*").alias("groups"))
