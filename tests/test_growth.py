"""Plans and results that must hold as tables grow: nothing that grows is broadcast, small tables give the same rows."""

import pytest
from pyspark.sql import functions as F

from lamella import jobs, sections, training
from lamella.operators import anchors, geometry, image, neighbors, sampling, tasks
from lamella.plans import fixture, section_queries
from lamella.sources import blocks


def broadcasts(df) -> int:
    """Broadcasts of a finished plan."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("BroadcastExchange")


def centres(spark, n=2):
    return spark.range(n).select(F.lit(0).cast("long").alias("section_id"), F.col("id").alias("spot_id"), (300 + 150 * F.col("id")).alias("cy"), F.lit(300).cast("long").alias("cx"))


def test_cells_of_circles_are_not_broadcast(spark):
    assert broadcasts(jobs.prepare_anchors(centres(spark), (768, 768))[1]) == 0


def test_allocation_over_anchors_broadcasts_nothing_that_grows(spark):
    at = centres(spark)
    known = at.select("section_id", "spot_id", F.lit(0).cast("long").alias("gene_id"), (F.col("spot_id") + 5).alias("umi"))
    prior = (1 + F.col("qy") % 3).cast("double")
    assert broadcasts(jobs.predict_anchors(at, known, prior, (768, 768))) == 0
    fields = jobs.prepare_anchors(at, (768, 768))[0]
    report = jobs.anchor_conservation(fields, known, prior, (768, 768))
    assert broadcasts(report) == 0
    assert report.first()["n"] == 18 and report.first()["max_scaled"] < 1e-9


def test_pixels_of_a_cell_follow_from_its_place(spark):
    at = centres(spark).withColumn("cy", F.col("cy") + 0.5)
    for rows in (768, 148):  # the second one cuts circles off
        joined = {(r.spot_id, r.qy, r.qx): r.area_px for r in anchors.circle_areas(at, rows, 768).collect()}
        cells = at.withColumn("qy", F.explode(F.sequence(F.lit(0), F.lit(80)))).withColumn("qx", F.explode(F.sequence(F.lit(0), F.lit(80))))
        found = {(r.spot_id, r.qy, r.qx): r.a for r in cells.withColumn("a", anchors.cell_area(rows, 768)).where("a > 0").collect()}
        assert found == joined


def test_draws_of_an_epoch_broadcast_nothing(spark):
    items = spark.range(40).select((F.col("id") % 3).alias("section_id"), F.col("id").alias("field"))
    drawn = sampling.epoch_draw(items, 7, 3, 30, ["section_id"], "field")
    assert broadcasts(drawn) == 0
    rows = drawn.collect()
    assert sorted((r.section_id, r.draw) for r in rows) == [(s, d) for s in range(3) for d in range(60, 90)]
    assert len({(r.section_id, r.cycle, r.field) for r in rows}) == len(rows) == len({(r.section_id, r.cycle, r.position) for r in rows})


def test_stored_owners_are_not_broadcast(spark):
    at = spark.createDataFrame([(0, 7, "Spot55", 0, 0)], "section_id long, field_id long, task string, y0 long, x0 long")
    owners = blocks.square_owners(at.select("section_id", "field_id"))
    layouts = at.drop("task").withColumn("role", F.lit("validation")).join(blocks.layout_digest(owners, "section_id", "field_id"), ["section_id", "field_id"])
    plan = blocks.frozen_owners(at, layouts, owners)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == 2  # the digests and the pixels


def test_support_in_tissue_is_not_broadcast(spark):
    spots = spark.createDataFrame([(0, 100.0, 100.0)], "section_id long, cy double, cx double")
    n = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long")))
    mask = spark.range(1).select(F.lit(0).cast("long").alias("section_id"), n.alias("y")).withColumn("x", n)
    assert broadcasts(sections.spot_support(spots, (100, 100), mask)) == 0


def test_exported_cells_without_genes_count_as_support(spark):
    spots = spark.createDataFrame([(0, 0, 101.0, 101.0), (0, 1, 101.0, 201.0)], "section_id long, spot_id long, cy double, cx double")
    cells = geometry.circle_pixels(spots, 55.0, 200, 200).select("section_id", "spot_id", geometry.down("y", 4).alias("qy"), geometry.down("x", 4).alias("qx")).distinct()
    grid = cells.where("spot_id = 0").select("section_id", "qy", "qx", F.lit("g0").alias("gene_id"), F.lit(1.0).alias("value"))
    observed = spark.createDataFrame([(0, 0, "g0", 3)], "section_id long, spot_id long, gene_id string, umi long")
    r = sections.spot_report(grid, spots, observed, (200, 200), cells).first()
    assert (r["full"], r["partial"], r["empty"], r["n"]) == (2, 0, 0, 1)


def test_means_of_sections_and_protocols_come_from_one_pass(spark):
    columns = "section_id long, field_id long, kind string, level string, n long, umi double, nll double, base_nll double, gain double, share double, base_share double, pcc double, rms_ratio double"
    scores = spark.createDataFrame([(s, f, "all", None, 1, 2.0 * s, 1.0, 1.0, 0.0, 0.5, 0.5, None, 1.0) for s in (0, 1) for f in range(s + 1)], columns)
    means = training.section_scores(scores, spark.createDataFrame([(0, 0), (1, 0)], "section_id long, protocol_id long"))
    assert "Union" not in means._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.section_id, r.fields, r.umi, r.defined_fields) for r in means.collect() if r.section_id is not None) == [(0, 1, 0.0, 0), (1, 2, 2.0, 0)]
    assert [(r.fields, r.umi) for r in means.where("section_id IS NULL").collect()] == [(3, 1.0)]


def test_pairs_of_a_field_are_formed_without_a_join(spark):
    plan = section_queries._pairs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_counts_are_dealt_out_by_a_number_that_grows(spark):
    plan = fixture.wide_counts(spark, "/root/testdata/sf0.1")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    assert tasks.spread(spark.range(1), 1000, 10, "id").rdd.getNumPartitions() == 100


def test_neighbours_at_any_distance_are_met_in_tasks_of_bounded_size(spark, monkeypatch):
    """Four hundred points in one heap and one far off: as pairs grow, tasks do, whichever side goes to nine buckets."""
    heap = spark.range(401).selectExpr("id % 2 AS section_id", "id", "CASE WHEN id = 400 THEN 90.0D ELSE id % 20 + 0.0D END AS cy", "id DIV 20 + 0.0D AS cx")
    others = heap.where("id % 3 > 0").selectExpr("section_id", "id AS other", "cy AS oy", "cx AS ox")
    want = sorted(tuple(r) for r in neighbors.nearest_any(heap, others, 4, ["id"], 4.0).select("id", "other", "d2", "rank").collect())
    asked = []
    monkeypatch.setattr(neighbors, "EACH", 500)
    monkeypatch.setattr(neighbors, "spread", lambda rows, n, each, *by: asked.append((-(-n // each), by)) or tasks.spread(rows, n, each, *by))
    for points in (heap, heap.where("id % 2 = 0")):  # more points than others, and fewer
        got = neighbors.nearest_any(points, others, 4, ["id"], 4.0).select("id", "other", "d2", "rank")
        assert broadcasts(got) == 0
        assert sorted(tuple(r) for r in got.collect()) == [r for r in want if points is heap or r[0] % 2 == 0]
        assert any(n > 10 and by == ("section_id", "_by", "_bx") for n, by in asked)
        assert any(by == ("section_id", "id") for n, by in asked) == (points is not heap)
        asked.clear()


def test_folders_of_a_store_are_bounded(spark, tmp_path, monkeypatch):
    """Forty rows of blocks of twenty sections share few folders and are read back whole, or by block."""
    monkeypatch.setattr(blocks, "FOLDERS", 6)
    counts = spark.range(400).selectExpr("id % 20 AS section_id", "(id * 7) % 512 AS y", "(id * 11) % 256 AS x", "0L AS gene_id", "id % 9 AS umi")
    listed = spark.range(40).selectExpr("id % 20 AS section_id", "id DIV 20 AS block_y", "0L AS block_x")
    path = str(tmp_path / "store")
    blocks.write_counts(counts, spark.createDataFrame([(0, 0)], "gene_id long, pos int"), listed, path)
    assert 1 < len(list((tmp_path / "store" / "counts").glob("*=*"))) <= 6
    read = lambda at: sorted(tuple(r) for r in blocks.read_counts(spark, path, at).select("section_id", "y", "x", "count").collect())
    want = sorted(tuple(r) for r in counts.select("section_id", "y", "x", "umi").collect())
    assert read(listed) == want
    assert read(listed.where("section_id = 3 AND block_y = 1")) == [r for r in want if r[0] == 3 and r[1] >= 256]


def test_samples_of_colours_are_made_where_their_pixels_are(spark):
    """No sample is dealt out: the plan joins nothing, and tiles of any size give the same colours."""
    pixels = spark.range(900).selectExpr("0L AS section_id", "id DIV 30 AS py", "id % 30 AS px", "CAST(id % 251 AS INT) AS r", "CAST(id % 7 AS INT) AS g", "CAST(id % 31 AS INT) AS b").where("r % 5 > 0")
    fields = spark.createDataFrame([(0, 1, 0, 0), (0, 2, 40, 64), (1, 3, -64, 0)], "section_id long, field_id long, y0 long, x0 long")
    turned = [[0.1, 0.01, -0.4], [-0.01, 0.11, 0.3], [0.0, 0.0, 1.0]]
    found = [image.registered_colours(fields, pixels, turned, 30, 30, 16, tile) for tile in (8, 5, 64)]
    assert "Join" not in found[0]._jdf.queryExecution().optimizedPlan().toString()
    rows = [{(r.field_id, r.i, r.j): r for r in f.collect()} for f in found]
    assert len(rows[0]) == 3 * 256 and rows[0] == rows[1] == rows[2]
    assert {r.valid for r in rows[0].values()} == {True, False} and any(0 < r.r < 1 for r in rows[0].values())


def test_cells_of_a_prediction_are_dealt_out_by_parent(spark, tmp_path, monkeypatch):
    """Two overlapping fields of twenty sections: weights that carry counts and shares are dealt out once, four cells a row; folders are bounded."""
    monkeypatch.setattr(sections, "FOLDERS", 6)
    seen = spark.range(20).selectExpr("id AS section_id", "-1L AS py", "3L AS px", "id % 2 AS gene_id", "id AS umi")
    cells = sections.children(seen.drop("umi")).withColumn("field_id", F.explode(F.array(F.lit(0), F.lit(1))))
    weights = cells.withColumn("weight", F.when(F.col("field_id") == 0, 1.0).otherwise((F.pmod("qy", F.lit(2)) * 2 + F.pmod("qx", F.lit(2))).cast("double")))
    cover = cells.select("section_id", "qy", "qx", "field_id", F.lit(0.5).alias("weight"))
    want = {(s, -2 + a, 6 + b, s % 2): s * (0.125 + (2 * a + b) / 12) for s in range(20) for a in (0, 1) for b in (0, 1)}
    carried = weights.join(seen, ["section_id", "py", "px", "gene_id"]).withColumn("share", F.lit(0.5))
    for name, w in (("joined", weights), ("carried", carried)):
        report = sections.predict_section(w, seen, cover, str(tmp_path / name)).collect()
        assert sorted((r.section_id, r.n, r.within) for r in report) == [(s, 1, True) for s in range(20)]
        assert 1 < len(list((tmp_path / name / "prediction").glob("*=*"))) <= 6
        got = {(r.section_id, r.qy, r.qx, r.gene_id): r.value for r in spark.read.parquet(str(tmp_path / name / "prediction")).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    stored = spark.read.parquet(str(tmp_path / "carried" / "prediction")).where(F.col("folder") != F.pmod(F.xxhash64("section_id"), F.lit(6)))
    assert stored.isEmpty()
    flat = spark.createDataFrame(carried.collect(), carried.schema)
    assert sections.predicted(flat, 20)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # by field and by part
    bad = (
        (carried.unionByName(carried), "do not add up to 1"),
        (carried.where("field_id = 0"), "do not add up to 1"),
        (carried.withColumn("weight", F.lit(0.0)), "has no support"),
        (carried.withColumn("qx", F.col("qx") + 2), "outside its parent"),
    )
    for rows, message in bad:
        with pytest.raises(Exception, match=message):
            sections.predicted(rows, 20).collect()


def test_fields_meet_parents_and_not_their_cells(spark):
    seen = spark.range(300).selectExpr("id % 2 AS section_id", "id % 23 - 3 AS py", "id % 17 AS px", "id % 3 AS gene_id", "1L AS umi").dropDuplicates(["section_id", "py", "px", "gene_id"])
    made = sections.prepare_squares(seen, spark.createDataFrame([(0, 0)], "gene_id long, pos int"), n=300)
    at = ["section_id", "qy", "qx", "field_id", "weight"]
    cells = sections.children(seen.select("section_id", "py", "px").distinct())
    want = geometry.covering_fields(cells, made.fields, 160, stride_um=160).select(*at)
    assert made.cover._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1  # of the fields' numbers
    assert sorted(map(tuple, made.cover.select(*at).collect())) == sorted(map(tuple, want.collect()))
    both = made.placed.select("section_id", "py", "px", "gene_id", "umi")
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, seen.collect()))


def test_pixels_of_whole_spots_meet_as_bits_of_squares(spark):
    """No pixel is dealt out before it is a bit of its square; repeated valid pixels, missing places and negative squares count as before."""
    n = F.explode(F.sequence(F.lit(0), F.lit(11)))
    owners = spark.range(6).selectExpr("id % 2 AS section_id", "id AS parent_id", "12 * id - 30 AS _y").withColumn("a", n).withColumn("b", n).select("section_id", "parent_id", (F.col("_y") + F.col("a")).alias("y"), (F.col("b") - 5).alias("x"))
    lost = owners.where("parent_id = 4").limit(1).withColumn("y", F.lit(None).cast("long"))
    valid = owners.drop("parent_id").where("NOT (y = -29 AND x = -5)")  # a pixel of parent 0 is not valid
    got = jobs.supported_parents(owners.unionByName(lost), valid.unionByName(valid))
    assert sorted(map(tuple, got.select("section_id", "parent_id", "slot").collect())) == [(0, 2, 0), (1, 1, 0), (1, 3, 1), (1, 5, 2)]
    whole = jobs.supported_owners(owners, valid)
    assert whole.count() == 5 * 144 and whole.where("parent_id = 0").isEmpty()
    squares = jobs._bits(owners, "section_id", "parent_id")
    assert squares.count() == owners.select("parent_id", F.floor(F.col("y") / 8), F.floor(F.col("x") / 8)).distinct().count()
    assert squares.agg(F.sum(F.expr("bit_count(_bits)"))).first()[0] == owners.count()


def test_cells_of_a_mask_meet_spots_once_for_each_bucket(spark):
    """Support in a mask is what enumeration around spots gives, and cells of spots are not dealt out for the mask."""
    spots = spark.createDataFrame([(0, 100.0, 100.0), (0, 150.0, 260.0), (1, 395.0, 5.0)], "section_id long, cy double, cx double")
    n = F.explode(F.sequence(F.lit(-8).cast("long"), F.lit(240).cast("long")))
    mask = spark.range(2).select(F.col("id").alias("section_id"), n.alias("y")).withColumn("x", n).where("(y + 2 * x) % 9 < 6")
    held = sections.spot_support(spots, (190, 202), mask)
    every = sections.spot_support(spots, (190, 202)).join(image.tissue_majority(mask), sections.CELL, "left_semi")
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, every.select(*sections.CELL).collect())) and not held.isEmpty()
    assert "LeftSemi" not in held._jdf.queryExecution().optimizedPlan().toString()


def test_spots_are_dealt_out_before_they_become_pixels(spark):
    spots = spark.range(400).selectExpr("0L AS section_id", "id AS spot_id", "100.0 * (id DIV 20) + 40 AS cy", "100.0 * (id % 20) + 40 AS cx")
    dealt = sections.around(spots.coalesce(1))
    assert dealt.rdd.getNumPartitions() > 1 and dealt.select(F.spark_partition_id()).distinct().count() > 1


def test_sides_of_fine_tuning_form_pairs_once(spark):
    """The checks of the sides read fields that are settled; nothing that grows is broadcast."""
    seen = spark.sparkContext.accumulator(0)

    def tallied(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    at = "section_id long, field_id long, y0 long, x0 long"
    fields = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 0, 250), (0, 2, 0, 330), (0, 3, 0, 60)], at)
    pairs = spark.createDataFrame([(0, f, i, i + 1, 4.0) for f in (0, 1, 2) for i in range(2)] + [(0, 3, 0, 1, 4.0)], "section_id long, field_id long, first long, second long, d2 double")
    made = sections.PreparedSpots(None, None, fields, None, pairs.mapInPandas(tallied, pairs.schema))
    sides = sections.spot_fine_tuning_fields(made, 330, least=1)
    assert broadcasts(sides) == 0
    assert sorted(map(tuple, sides.select("x0", "side").collect())) == [(0, "support"), (330, "selection")]
    assert seen.value == 7
