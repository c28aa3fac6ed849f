"""Literal cases, failing cases and plans of the section workflows, stores and ranks."""

import math
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella import jobs, sections, training
from lamella.operators import anchors, checks, geometry, image, metrics, neighbors, objectives, owners, ranks, sampling
from lamella.sources import blocks


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def fails(df, message):
    with pytest.raises(Exception, match=message):
        df.collect()


def plan(df):
    return df._jdf.queryExecution().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_anchor_fields_and_coverage(spark):
    at = spark.createDataFrame([(0, 0, 256.0, 256.0), (0, 1, 256.0, 406.0)], "section_id long, spot_id long, cy double, cx double")
    fields, cells = jobs.prepare_anchors(at, (400, 400))
    got = fields.collect()
    assert len(got) == 18 and {(r.y0, r.x0) for r in got if r.spot_id == 0} == {(64 + a, 64 + b) for a in (-12, 0, 12) for b in (-12, 0, 12)}
    want = {}
    for r in got:
        for i in range(20):
            for j in range(20):
                q = r.y0 // 4 + 6 + i, r.x0 // 4 + 6 + j
                want[q] = want.get(q, 0) + 1
    assert {(r.qy, r.qx): r.coverage for r in cells.collect()} == want
    for tile in (7, 64, 1000):
        assert {(r.qy, r.qx): r.coverage for r in anchors.coverage(fields, tile).collect()} == want
    area = {r.spot_id: r.n for r in anchors.circle_areas(at, 400, 400).groupBy("spot_id").agg(F.sum("area_px").alias("n")).collect()}
    assert area == {0: 1976, 1: 1976}
    fails(anchors.anchored_fields(at, 130, 400), "leaves the capture")


def test_anchor_prediction(spark):
    """One anchor: 676 cells; with an even prior every cell holds the anchor's density, and circles come back from single fields."""
    at = spark.createDataFrame([(0, 5, 256.0, 256.0)], "section_id long, spot_id long, cy double, cx double")
    seen = spark.createDataFrame([(0, 5, 0, 19), (0, 5, 1, 37)], "section_id long, spot_id long, gene_id long, umi long")
    grid = jobs.predict_anchors(at, seen, F.lit(1.0), (256, 256)).collect()
    assert len(grid) == 2 * 676 and all(abs(r.value - 16 * (19, 37)[r.gene_id] / 1976) < 1e-12 for r in grid)
    tilted = (1 + (F.col("qy") + F.col("y0")) % 3).cast("double")
    fields = anchors.anchored_fields(at, 256, 256)
    assert jobs.anchor_conservation(fields, seen, tilted, (256, 256)).first()["max_scaled"] < 1e-12
    values = anchors.field_values(fields, seen, tilted, 256, 256)
    report = anchors.saved_grid_report(at, anchors.stitched(values, anchors.coverage(fields)), seen, 256, 256).first()
    assert report.spots == 1 and report.n == 2 and not report.within
    fails(anchors.stitched(values.where("NOT (y0 = 52 AND qy = 20 AND qx = 20)"), anchors.coverage(fields)), "lacks a core")
    fails(anchors.circle_sums(at, values.where("qy < 30").groupBy("section_id", "qy", "qx", "gene_id").agg(F.avg("value").alias("value")), 256, 256), "not exported")
    fails(anchors.field_values(fields, seen.where("spot_id = 0"), F.lit(1.0), 256, 256), "no counts")


def test_ranks(spark):
    data = [(None if i % 7 == 0 else 1 if i % 3 else i % 5, i * 37 % 101, i) for i in range(400)]
    frame = spark.createDataFrame(data, "s long, v long, i long").repartition(3)
    for keys in ([], ["s"]):
        got = ranks.ranked(frame, ["v", "i"], keys, "r")
        order = sorted(data, key=lambda d: (d[0] is None, d[0] or 0) if keys else 0)
        want, count = {}, {}
        for s, _, i in sorted(order, key=lambda d: (d[1], d[2])):
            k = s if keys else 0
            want[i] = count.get(k, 0)
            count[k] = want[i] + 1
        assert {r.i: r.r for r in got.collect()} == want
        assert "SinglePartition" not in plan(got)
        total = ranks.running(frame, "v", ["v", "i"], keys, "t").collect()
        for r in total:
            assert r.t == sum(v for s, v, i in data if (not keys or s == r.s) and (v, i) < (r.v, r.i))
    assert ranks.ranked(frame.limit(0), ["v"], ["s"]).collect() == []


def test_ranks_spread_a_single_section(spark):
    at = ranks.ranked(spark.range(10_000).withColumn("s", F.lit(1)), [F.col("id").desc()], ["s"], "r", parts=4)
    assert at.withColumn("p", F.spark_partition_id()).groupBy("p").count().count() > 1
    assert at.where("r + id <> 9999").isEmpty()


def test_nearest_at_any_distance(spark):
    rng = np.random.default_rng(0)
    near = [(0, i, float(y), float(x)) for i, (y, x) in enumerate(rng.integers(0, 30, (150, 2)))]
    near += [(0, 200, 9000.0, 3.0), (0, 201, -700.0, 90.0), (1, 202, 1.0, 1.0), (1, 203, 500.0, 1.0), (2, 204, 0.0, 0.0)]
    others = [r for r in near if r[1] % 4 and r[0] < 2] + [(0, 300 + i, 5.0, 5.0) for i in range(20)]
    points = spark.createDataFrame(near, "section_id long, id long, cy double, cx double")
    held = spark.createDataFrame(others, "section_id long, other long, oy double, ox double")
    want = []
    for s, i, y, x in near:
        d = sorted(((y - b) ** 2 + (x - c) ** 2, o) for t, o, b, c in others if t == s)[:5]
        want += [(s, i, o, d2, k + 1) for k, (d2, o) in enumerate(d)]
    for size in (1.0, 50.0, 1e5):
        got = neighbors.nearest_any(points, held, 5, ["id"], size).select("section_id", "id", "other", "d2", "rank")
        assert rows(got) == sorted(want, key=str)
    assert neighbors.nearest_any(points, held.limit(0), 5, ["id"], 4.0).collect() == []


def test_registered_colours(spark):
    """A grey ramp stays one; samples beyond the image are white and not valid, missing pixels white and valid."""
    pixels = spark.range(32 * 32).selectExpr("0L AS section_id", "id DIV 32 AS py", "id % 32 AS px", "CAST(id % 32 AS INT) AS r", "CAST(id DIV 32 AS INT) AS g", "0 AS b").where("NOT (py = 3 AND px = 3)")
    half = [[0.25, 0.0, -0.5], [0.0, 0.25, -0.5], [0.0, 0.0, 1.0]]  # 8 um an image pixel, pixel centres at 4, 12, ..
    fields = spark.createDataFrame([(0, 1, 0, 0), (0, 2, 0, 64)], "section_id long, field_id long, y0 long, x0 long")
    scaled = [[v / 2 for v in r[:2]] + [r[2]] for r in half[:2]] + [half[2]]
    got = {(r.field_id, r.i, r.j): r for r in image.registered_colours(fields, pixels, scaled, 32, 32, 32).collect()}
    assert len(got) == 2 * 1024 and all(r.valid for k, r in got.items() if k[0] == 1)
    assert all(abs(r.r * 255 - k[2]) < 1e-9 and abs(r.g * 255 - k[1]) < 1e-9 for k, r in got.items() if k[0] == 1 and k[1:] != (3, 3))
    assert got[1, 3, 3].r == 1 and got[2, 0, 31].r == 1 and not got[2, 0, 31].valid and got[2, 0, 0].valid and abs(got[2, 0, 0].r * 255 - 16) < 1e-9


def _store(spark, path, most=9):
    c = spark.range(3000).selectExpr("id % 2 AS section_id", "(id * 7) % 600 AS y", "(id * 11) % 700 AS x", "id % 3 AS gene_id", f"id % {most} AS umi").groupBy("section_id", "y", "x", "gene_id").agg(F.max("umi").alias("umi"))
    panel = spark.createDataFrame([(2, 0), (0, 1)], "gene_id long, pos int")
    listed = spark.createDataFrame([(s, a, b) for s in (0, 1) for a in range(3) for b in range(3) if (a, b) != (1, 1)], "section_id long, block_y long, block_x long")
    blocks.write_counts(c, panel, listed, path)
    return c


def test_counts_by_block(spark, path):
    c = _store(spark, path)
    back = blocks.read_counts(spark, path, spark.read.parquet(f"{path}/index").where("block_x <> 1"))
    want = c.where("gene_id <> 1 AND NOT (x >= 256 AND x < 512)").selectExpr("section_id", "y", "x", "CASE gene_id WHEN 2 THEN 0 ELSE 1 END AS gene_index", "umi AS count")
    assert rows(back) == rows(want)
    text = plan(blocks.read_counts(spark, path, spark.createDataFrame([(0, 0, 0)], "section_id long, block_y long, block_x long").where("block_y = 0")))
    assert re.search(r"PartitionFilters: \[[^\]]*dynamicpruning", text)
    index = spark.read.parquet(f"{path}/index")
    assert index.where("stop - start <> nnz").isEmpty() and index.count() == 16
    fails(blocks.read_counts(spark, path, spark.createDataFrame([(0, 1, 1)], "section_id long, block_y long, block_x long")), "not in the store")
    with pytest.raises(Exception, match="(?i)exists"):
        _store(spark, path)


def test_counts_beyond_16_bits(spark, path):
    with pytest.raises(Exception, match="16 bits"):
        c = spark.createDataFrame([(0, 1, 1, 0, 65536)], "section_id long, y long, x long, gene_id long, umi long")
        blocks.write_counts(c, spark.createDataFrame([(0, 0)], "gene_id long, pos int"), spark.createDataFrame([(0, 0, 0)], "section_id long, block_y long, block_x long"), path)


def test_role_gate(spark, path):
    spark.range(40).selectExpr("id % 4 AS section_id", "id DIV 4 AS field_id", "id AS v").write.partitionBy("section_id").parquet(path)
    manifest = spark.createDataFrame([(s, "train" if s else "test", 0, 10) for s in range(4)], "section_id long, role string, protocol_id int, fields long")
    ask = lambda *r: spark.createDataFrame(r, "section_id long, role string, protocol_id int, field_id long")
    store = spark.read.parquet(path)
    fine = blocks.gated(store, ask((1, "train", 0, 3), (2, "train", 0, 9)).where("section_id > 0"), manifest)
    assert {r.v for r in fine.collect()} == {13, 38} and "dynamicpruning" in plan(fine)
    for bad in ((0, "train", 0, 1), (1, "train", 1, 1), (1, "train", 0, 10), (1, "train", 0, -1), (9, "train", 0, 0)):
        fails(blocks.gated(store, ask(bad), manifest), "role or protocol")


def test_feature_parts(spark):
    fields = spark.range(10).selectExpr("0L AS section_id", "id AS field_id", "id * 8 AS y0", "0L AS x0")
    part = "CASE WHEN field_id >= 4 THEN 1 ELSE 0 END"
    held = fields.selectExpr("section_id", f"{part} AS part_id", f"field_id - 4 * ({part}) AS local", "y0 AS py0", "x0 AS px0", "field_id * 2 AS v")
    parts = lambda *r: spark.createDataFrame([(0, i, a, b) for i, (a, b) in enumerate(r)], "section_id long, part_id int, start long, stop long")
    pools = spark.createDataFrame([(0, 10)], "section_id long, fields long")
    good = parts((0, 4), (4, 10))
    assert {r.field_id: r.v for r in blocks.feature_rows(fields.where("field_id % 3 = 1"), good, held, pools).collect()} == {1: 2, 4: 8, 7: 14}
    for bad in (parts((0, 4), (5, 10)), parts((0, 5), (4, 10)), parts((1, 4), (4, 10)), parts((0, 4), (4, 9))):
        fails(blocks.feature_rows(fields, bad, held, pools), "gap, overlap or end|outside all parts")
    fails(blocks.feature_rows(fields.withColumn("field_id", F.col("field_id") + 5), good, held, pools), "outside all parts|origin")
    fails(blocks.feature_rows(fields.withColumn("x0", F.lit(8).cast("long")), good, held, pools), "another origin")


def test_frozen_layouts(spark):
    fields = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 64, 8)], "section_id long, field_id long, y0 long, x0 long")
    owners = spark.range(300).selectExpr("0L AS section_id", "1L AS field_id", "id % 128 AS ly", "id DIV 128 AS lx", "id % 3 AS parent_id")
    kept = fields.join(blocks.layout_digest(owners, "section_id", "field_id").drop("pixels"), ["section_id", "field_id"], "left").withColumn("role", F.lit("validation"))
    ask = fields.withColumn("task", F.when(F.col("field_id") == 0, "HD16").otherwise("Spot55"))
    got = blocks.frozen_owners(ask, kept, owners)
    assert got.where("task = 'Spot55'").count() == 300 and got.where("task = 'HD16'").agg(F.count_distinct("parent_id")).first()[0] == 256
    assert got.where("task = 'HD16' AND ly = 9 AND lx = 127").first().parent_id == 31
    fails(blocks.frozen_owners(ask.withColumn("y0", F.col("y0") + 8), kept, owners), "not this field's")
    fails(blocks.frozen_owners(ask, kept.withColumn("role", F.lit("train")), owners), "not this field's")
    fails(blocks.frozen_owners(ask.withColumn("task", F.lit("random")), kept, owners), "not this field's")
    fails(blocks.frozen_owners(ask, kept, owners.where("ly <> 5")), "has changed")


def test_spot_matrix(spark):
    """Barcodes b and a keep their matrix order; positions (80, 80) and (130, 130) become centres 161 and 261."""
    identity = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    data = spark.createDataFrame([(0, 0, 2), (1, 1, 5), (2, 0, 3), (3, 1, 7)], "k long, row long, value long")
    indptr = spark.createDataFrame([(0, 0), (1, 2), (2, 4)], "col long, start long")
    barcodes = spark.createDataFrame([(0, 0, "b"), (0, 1, "a")], "section_id long, col long, barcode string")
    genes = spark.createDataFrame([(0, "B"), (1, "A")], "row long, gene_id string")
    positions = spark.createDataFrame([(0, "a", 1, 1, 130.0, 130.0), (0, "b", 1, 1, 80.0, 80.0), (0, "c", 0, 1, 1.0, 1.0)], "section_id long, barcode string, in_tissue int, qc_pass int, pxl_row double, pxl_col double")
    made = sections.spot_matrix(data, indptr, barcodes, genes, positions, identity, (256, 256))
    assert [tuple(r) for r in made.spots.orderBy("spot_id").collect()] == [(0, 0, "b", 161.0, 161.0), (0, 1, "a", 261.0, 261.0)]
    assert rows(made.counts) == [(0, 0, "A", 5), (0, 0, "B", 2), (0, 1, "A", 7), (0, 1, "B", 3)]
    cells = {(r.qy, r.qx) for r in made.queries.collect()}
    assert cells == {(y, x) for y in range(64) for x in range(64) if min((8 * y + 4 - c) ** 2 + (8 * x + 4 - c) ** 2 for c in (161, 261)) <= 10_000}
    centres = lambda p=positions, b=barcodes, t=identity, c=(256, 256): sections.spot_centres(b, p, t, c)
    failing = lambda f, m: pytest.raises(Exception, match=m)
    for make, message in (
        (lambda: centres(positions.where("barcode <> 'a'")), "no position"),
        (lambda: centres(positions.unionByName(positions.where("barcode = 'a'"))), "repeated"),
        (lambda: centres(positions.withColumn("qc_pass", F.lit(2))), "neither 0 nor 1"),
        (lambda: centres(c=(130, 256)), "leaves the capture"),
        (lambda: centres(positions.withColumn("pxl_row", F.lit(80.0)).withColumn("pxl_col", F.lit(80.0))), "centre is repeated"),
        (lambda: centres(t=[[1.0, 1.0, 0.0], [1.0, 1.0, 0.0], [0.0, 0.0, 1.0]]), "invertible"),
        (lambda: sections.spot_matrix(data.withColumn("value", F.lit(-1)), indptr, barcodes, genes, positions, identity, (256, 256)).counts, "not a raw count"),
    ):
        with failing(make, message):
            make().collect()


def test_prepared_spots(spark):
    """Whole spots only, and pairs in every field that holds both circles."""
    spots = spark.createDataFrame([(0, 0, "a", 100.0, 100.0), (0, 1, "b", 100.0, 160.0), (0, 2, "c", 400.0, 400.0)], "section_id long, spot_id long, barcode string, cy double, cx double")
    seen = spark.createDataFrame([(0, 0, 7, 3), (0, 1, 8, 5)], "section_id long, spot_id long, gene_id long, umi long")
    section = sections.SpotSection(spots, seen, sections.spot_support(spots, (256, 256)))
    valid = spark.range(256 * 256).selectExpr("0L AS section_id", "id DIV 256 AS y", "id % 256 AS x").where("NOT (y = 200 AND x = 200)")
    made = sections.prepare_spots(section, spark.createDataFrame([(8, 0), (9, 1)], "gene_id long, pos int"), valid, (256, 256))
    assert {(r.parent_id, r.slot) for r in made.owners.select("parent_id", "slot").distinct().collect()} == {(0, 0), (1, 1)}
    assert rows(made.available.select("gene_id", "available")) == [(8, True), (9, False)] and made.counts.count() == 1
    at = {r.field_id: (r.y0, r.x0) for r in made.fields.collect()}
    inside = {f for f, (y, x) in at.items() if 2 * y <= 72.5 and 127.5 <= 2 * y + 256 and 2 * x <= 72.5 and 187.5 <= 2 * x + 256}
    assert {r.field_id for r in made.pairs.where("first = 0 AND second = 1").collect()} == inside and inside


def test_written_predictions(spark, path):
    seen = spark.createDataFrame([(0, 0, 0, 0, 10), (0, 0, 9, 0, 4), (0, 10, 10, 1, 7)], "section_id long, py long, px long, gene_id long, umi long")
    made = sections.prepare_squares(seen, spark.createDataFrame([(0, 0), (5, 1)], "gene_id long, pos int"))
    weights = made.cover.join(seen, (F.col("py") == F.floor(F.col("qy") / 2)) & (F.col("px") == F.floor(F.col("qx") / 2))).select(made.cover["section_id"], "field_id", "py", "px", "qy", "qx", "gene_id", (F.col("qy") % 2 + 1.0).alias("weight"))
    report = sections.predict_section(weights, seen, made.cover, path).collect()
    assert [(r.section_id, r.n, r.within) for r in report] == [(0, 3, True)]
    grid = {(r.qy, r.qx, r.gene_id): r.value for r in spark.read.parquet(f"{path}/prediction").collect()}
    assert abs(grid[0, 0, 0] - 10 / 6) < 1e-12 and abs(grid[1, 1, 0] - 20 / 6) < 1e-12
    with pytest.raises(Exception, match="(?i)exists"):
        sections.predict_section(weights, seen, made.cover, path)
    changed = spark.read.parquet(f"{path}/prediction").withColumn("value", F.col("value") * 1.1)
    assert not sections.square_report(changed, seen).first()["within"]
    fails(sections.prepare_squares(seen.withColumn("umi", F.col("umi") + 0.5), made.available.select("gene_id", "pos")).counts, "not a raw count")


def test_identity(spark):
    p = spark.createDataFrame([(0, "s", "HD16")], "section_id long, sample_id string, task string")
    r = p.withColumn("role", F.lit("evaluation_only_measured_8um")).withColumn("used_for_fitting", F.lit(False))
    assert rows(checks.same_task(p, r)) == [(0, "s", "HD16")]
    fails(checks.same_task(p.withColumn("sample_id", F.lit("t")), r), "sample or task")
    fails(checks.same_task(p.withColumn("task", F.lit("Spot55")), r), "sample or task")
    fails(checks.same_task(p, r.withColumn("role", F.lit("train"))), "evaluation only")
    fails(checks.same_task(p, r.withColumn("used_for_fitting", F.lit(True))), "evaluation only")
    genes = spark.createDataFrame([(0, 0, "A", True), (0, 1, "B", False)], "section_id long, pos int, gene_id string, available boolean")
    assert checks.same_genes(genes, genes).count() == 2
    fails(checks.same_genes(genes.withColumn("pos", 1 - F.col("pos")), genes), "gene order")
    fails(checks.same_genes(genes, genes.withColumn("available", F.lit(True))), "one side only")
    fails(checks.same_genes(genes.where("pos = 0"), genes), "gene order")
    fails(checks.same_genes(genes.withColumn("available", F.lit(False)), genes.withColumn("available", F.lit(False))), "no available gene")


def test_batches(spark):
    items = spark.range(37).selectExpr("id % 2 AS section_id", "id AS field_id", "0L AS y0", "0L AS x0")
    made = training.batches(items, 1, 1, 16, ["section_id", "field_id"])
    assert sorted(r["count"] for r in made.groupBy("batch").count().collect()) == [5, 16, 16]
    assert rows(made) != rows(training.batches(items, 1, 2, 16, ["section_id", "field_id"]))
    counts = spark.createDataFrame([(0, 0, 0, 1, 5), (0, 0, 7, 1, 2), (0, 9, 9, 2, 3), (0, 200, 0, 1, 9), (1, 3, 3, 9, 4)], "section_id long, y long, x long, gene_id long, umi long")
    known = spark.createDataFrame([(0, 1), (0, 2), (1, 1)], "section_id long, gene_id long")
    found = training.batch_counts(counts, made, known, spark.createDataFrame([(1,)], "gene_id long"))
    got = {tuple(r) for r in found.where("field_id = 4").select("kind", "a", "b", "gene_id", "umi").collect()}
    assert got == {("parent", 0, 0, 1, 7), ("parent", 17, 0, 2, 3), ("cell", 0, 0, 1, 5), ("cell", 0, 1, 1, 2)}
    # All counts lie in one block, whose fields are in three batches: they do not meet in one task.
    parts = found.withColumn("p", F.spark_partition_id()).groupBy("batch").agg(F.count_distinct("p").alias("n")).collect()
    assert len(parts) == 3 and {r.n for r in parts} == {1}


def test_subset(spark):
    fields = spark.createDataFrame([(0, i, b, 256 * b, 0) for i, b in ((3, 2), (5, 0), (8, 2), (9, 4))], "section_id long, field_id long, block_slot long, y0 long, x0 long")
    held = spark.createDataFrame([(0, b, 256 * b, 0) for b in (0, 2, 4)], "section_id long, block_slot long, by long, bx long")
    pick = lambda *f: spark.createDataFrame([(0, i) for i in f], "section_id long, field_id long")
    made = training.subset(fields, held, pick(3, 8), pick(5))
    assert rows(made.fields.select("field_id", "source", "block_slot")) == [(0, 3, 1), (1, 5, 0), (2, 8, 1)]
    assert rows(made.blocks.select("block_slot", "source", "by")) == [(0, 0, 0), (1, 2, 512)]
    assert rows(made.training.select("field_id", "source")) == [(0, 3), (2, 8)] and rows(made.monitors.select("field_id", "source")) == [(1, 5)]
    for bad, message in ((lambda: training.subset(fields, held, pick(3, 4), pick(5)), "does not exist"), (lambda: training.subset(fields, held.where("block_slot > 0"), pick(3), pick(5)), "does not exist"), (lambda: training.subset(fields, held, pick(3), pick(3)), "trained on and monitored")):
        with pytest.raises(Exception, match=message):
            bad().fields.collect()


def test_scores_in_one_pass(spark):
    rng = np.random.default_rng(2)
    data = [(0, f, q, 0, g, float(p), float(b), float(y), float(c), "gap" if q % 3 else "covered", g % 2) for f in range(3) for q in range(8) for g in range(4) for p, b, y, c in [rng.integers(0, 6, 4)]]
    pairs = spark.createDataFrame(data, "section_id long, field_id long, qy long, qx long, gene_id long, p double, b double, y double, c double, region string, gene_group long")
    made = training.field_scores(pairs)
    got = {(r.field_id, r.kind, r.level): r for r in made.collect()}
    plain = metrics.poisson_nll(pairs, "field_id", "region").collect()
    assert all(abs(got[r.field_id, "region", r.region].nll - r.nll) < 1e-9 for r in plain)
    flat = metrics.flat_scores(pairs.select("field_id", "gene_group", (F.col("p") - F.col("c") / 4).alias("p"), (F.col("y") - F.col("c") / 4).alias("y")), "field_id", "gene_group").collect()
    assert all(abs(got[r.field_id, "gene_group", str(r.gene_group)].pcc - r.pcc) < 1e-9 and abs(got[r.field_id, "gene_group", str(r.gene_group)].rms_ratio - r.rms_ratio) < 1e-9 for r in flat)
    gain = objectives.gain_over_baseline(pairs, "field_id").collect()
    assert all(abs(got[r.field_id, "all", None].gain - r.gain) < 1e-9 for r in gain)
    # Pairs take part in one exchange, of sums; the other one moves those to their fields.
    made.collect()
    executed = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert executed.count("Exchange hashpartitioning") == 2 and "Expand" in executed and executed.count("Scan ExistingRDD") == 1


def test_seeds_by_known_value(spark):
    # The first 8 bytes of sha256('[5,1,"random_owner"]'), little-endian, by another tool.
    want = int.from_bytes(bytes.fromhex("d5d52ac0242f9c61"), "little") % (2**63 - 1)
    assert sampling.stable_seed(5, 1, "random_owner") == want
    assert spark.range(1).select(sampling.seed_column(F.lit('[5,1,"random_owner"]'))).first()[0] == want


def test_learning_rate_and_exposure(spark):
    rate = lambda *a: [r[0] for r in spark.range(a[0]).select(sampling.learning_rate(F.col("id"), *a[1:])).collect()]
    got = rate(12, 1.0, 0.1, 4, 10)
    assert [round(v, 12) for v in got[:4]] == [0.25, 0.5, 0.75, 1.0]
    assert all(abs(v - (0.1 + 0.9 * 0.5 * (1 + math.cos(math.pi * k / 6)))) < 1e-12 for k, v in enumerate(got[4:10], 1)) and got[9] == got[11] == 0.1
    assert rate(3, 1.0, 0.0, 2, 2)[1:] == [1.0, 0.0] and rate(1, 1.0, 0.0, 0, 2)[0] == pytest.approx(0.5)
    fields = spark.range(30).selectExpr("id % 2 AS section_id", "id AS field")
    plan_ = lambda *b: sampling.exposure_plan(fields, spark.createDataFrame(b, "section_id long, budget long, floor long"), 4, 3)
    assert tuple(plan_((0, 10, 5), (1, 3, 3)).first()) == (13, 4, 12, 1)
    for bad in (((0, 10, 5), (1, 2, 3)), ((0, 16, 5), (1, 3, 3)), ((0, 10, 5),), ((0, 10, 5), (1, 3, 3), (2, 1, 1))):
        fails(plan_(*bad), "misses its floor")


def test_draw_modes(spark):
    items = spark.range(5).selectExpr("0L AS s", "10 - id AS item")
    draw = lambda epoch, quota, mode: [r.item for r in sampling.epoch_draw(items, 3, epoch, quota, ["s"], "item", mode).orderBy("draw").collect()]
    assert draw(1, 2, "fresh") == [6, 7] and draw(2, 2, "fresh") == [8, 9]
    with pytest.raises(Exception, match="exhausted"):
        draw(3, 2, "fresh")
    both = draw(1, 10, "fresh_then_shuffled_cycles")
    assert both[:5] == [6, 7, 8, 9, 10] and sorted(both[5:]) == both[:5]
    assert both[5:] == draw(1, 10, "shuffled_cycles")[5:] and sorted(draw(1, 5, "shuffled_cycles")) == both[:5]
    with pytest.raises(ValueError):
        draw(1, 2, "other")


def test_small_energies_are_defined(spark):
    tiny = spark.createDataFrame([(1e-11, 2e-11), (2e-11, 4e-11), (3e-11, 6e-11)], "p double, y double")
    got = metrics.flat_scores(tiny).first()
    assert got.pcc is None and got.rms_ratio is None  # energies of 2e-22 and 8e-22
    less = metrics.flat_scores(tiny.select((F.col("p") * 100).alias("p"), (F.col("y") * 100).alias("y"))).first()
    assert abs(less.pcc - 1) < 1e-9 and abs(less.rms_ratio - 0.5) < 1e-12
    one = metrics.flat_scores(spark.createDataFrame([(1.0, 2.0)], "p double, y double"), least=0.0).first()
    assert one.pcc is None and one.rms_ratio == 0.5
    at = spark.createDataFrame([(0, p, y) for p, y in ((1e-8, 1.0), (2e-8, 3.0), (1e-8, 1.0))], "k long, p double, y double")
    assert abs(metrics.position_scores(at, "k").first().pcc - 1) < 1e-6
    strata = {r.stratum: r for r in metrics.stratum_scores(spark.createDataFrame([(0, 0.0, 0.0, 0.0)] * 4 + [(0, 0.25, float(i == 0), 1.0) for i in range(4)], "k long, p double, y double, c double"), "k").collect()}
    assert strata["0"].parent_gene_pairs == 1 and strata["0"].share == 0.5 and strata["0"].nll is None
    assert strata["1"].parent_gene_pairs == 1 and abs(strata["1"].nll - math.log(4)) < 1e-12 and strata["1"].pcc is None and strata["1"].rms_ratio == 0


def test_merged_pairs(spark):
    """Two parents of one cell each: merged they share 9 counts by weight 1 to 2, whatever each had."""
    weights = spark.createDataFrame([(0, 1, 0, 0, 7, 1.0), (0, 2, 5, 5, 7, 2.0), (0, 3, 9, 9, 7, 4.0)], "section_id long, parent_id long, qy long, qx long, gene_id long, weight double")
    seen = spark.createDataFrame([(0, 1, 7, 6), (0, 2, 7, 3), (0, 3, 7, 50)], "section_id long, parent_id long, gene_id long, umi long")
    pair = spark.createDataFrame([(0, 1, 2)], "section_id long, first long, second long")
    got = objectives.merged_pair_nll(weights, seen, pair, "section_id").first()
    assert got.umi == 9 and abs(got.nll - (9 - 6 * math.log(3) - 3 * math.log(6)) / 9) < 1e-12
    both = weights.unionByName(spark.createDataFrame([(0, 2, 0, 0, 7, 1.0)], weights.schema))
    fails(objectives.merged_pair_nll(both, seen, pair, "section_id"), "lies in several parents")
    assert geometry.field_lattice(spark.createDataFrame([(0, 0, 0, 0)], "section_id long, field_id long, y0 long, x0 long"), F.lit(50.0), F.lit(50.0)).where("cy = 50 AND cx IN (50, 150)").count() == 2
    fails(geometry.field_lattice(spark.createDataFrame([(0, 0, 4, 0)], "section_id long, field_id long, y0 long, x0 long"), F.lit(0.0), F.lit(0.0)), "start on 16 um")


def test_replay(spark):
    def run(*values):
        return spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "section_id long, cell long, value double")

    key = ["section_id", "cell"]
    nan, inf = math.nan, math.inf
    assert rows(checks.replayed(run(1.0, 100.0), run(1.0000109, 100.0009), key)) == [(0, 2, True, pytest.approx(9e-4))]
    assert rows(checks.replayed(run(1.0), run(1.000012), key))[0][2] is False
    assert rows(checks.replayed(run(inf, -inf), run(inf, -inf), key)) == [(0, 2, True, 0.0)]
    assert [rows(checks.replayed(run(a), run(b), key))[0][2] for a, b in ((nan, nan), (1.0, inf), (inf, 1.0), (-inf, inf), (None, 1.0), (None, None))] == [False] * 6
    fails(checks.replayed(run(1.0), run(1.0, 2.0), key), "differ")
    fails(checks.replayed(run(1.0).union(run(1.0)), run(1.0), key), "differ")


def test_reused_features(spark):
    f = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 0, 64)], "section_id long, field_id long, y0 long, x0 long")

    def features(*values, cells=(0, 1, 0, 1)):
        return spark.createDataFrame([(0, i // 2, c, v) for i, (c, v) in enumerate(zip(cells, values, strict=True))], "section_id long, field_id long, cell int, density double")

    good = features(1.0, 2.0, 0.0, 4.0)
    assert rows(checks.reused(f, f, good, 2)) == [(0, 0, 0, 0, 1.5), (0, 1, 0, 64, 2.0)]
    for other in (f.limit(1), f.withColumn("field_id", 1 - F.col("field_id")), f.withColumn("y0", F.col("y0") + 1), f.union(f)):
        fails(checks.reused(other, f, good, 2), "other fields")
    for cells in ((0, 0, 0, 1), (0, 2, 0, 1), (0, None, 0, 1)):
        fails(checks.reused(f, f, features(1.0, 2.0, 0.0, 4.0, cells=cells), 2), "lacks or repeats")
    for v in (-1.0, math.nan, math.inf, None):
        fails(checks.reused(f, f, features(1.0, v, 0.0, 4.0), 2), "finite")


def test_gathered(spark):
    pixels = spark.createDataFrame([(0, 0, 0), (0, 0, 1), (0, 0, 2)], "section_id long, y long, x long")
    owned = spark.createDataFrame([(0, 0, 0, 7), (0, 0, 1, 8)], "section_id long, y long, x long, parent_id long")
    values = spark.createDataFrame([(0, 7, 2.5, 3.5)], "section_id long, parent_id long, a double, b double")
    got = owners.gathered(pixels, owned, values, a=-1.0)
    assert rows(got.select("x", "parent_id", "a", "b")) == [(0, 7, 2.5, 3.5), (1, 8, -1.0, None), (2, None, -1.0, None)]
