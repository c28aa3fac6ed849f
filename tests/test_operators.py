"""Published literal cases and failures."""

import math

import pytest
from pyspark.sql import functions as F

from lamella import jobs
from lamella.operators import allocate, audit, counts, geometry, metrics, neighbors, owners, sampling
from lamella.sources import tables
from lamella.streaming import accumulate


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_circle_of_100_um_has_1976_pixels(spark):
    c = frame(spark, [(1, 256, 256)], "spot_id long, cy long, cx long")
    assert geometry.circle_pixels(c, 100.0, 256, 256).count() == 1976


def test_anchor_has_676_cells(spark):
    a = frame(spark, [(0, 1, 256, 256)], "section_id long, spot_id long, cy long, cx long")
    cells = audit.anchor_means(geometry.anchor_fields(a), F.lit(1.0))
    assert cells.count() == 676 and cells.agg(F.max("coverage")).first()[0] == 9


def test_panel_keeps_measured_genes_and_drops_unknown_ones(spark):
    panel = frame(spark, [("A", 0), ("B", 1), ("C", 2)], "gene_id string, pos int")
    c = frame(spark, [(1, "B", 11), (1, "A", 0), (1, "outside", 5)], "section_id long, gene_id string, umi long")
    assert sorted(map(tuple, counts.in_panel(c, panel).select("gene_id", "umi").collect())) == [("A", 0), ("B", 11)]
    assert {r.gene_id: r.available for r in counts.availability(c, panel).collect()} == {"A": True, "B": True, "C": False}


def test_gene_scores(spark):
    p, y = [[1, 4, 0], [3, 2, 0], [2, 1, 0], [8, 7, 0]], [[2, 5, 0], [4, 3, 0], [1, 2, 0], [9, 8, 0]]
    rows = [(g, float(p[i][g]), float(y[i][g]), i // 2) for i in range(4) for g in range(3)]
    m = frame(spark, rows, "gene long, p double, y double, block long").groupBy("gene", "block").agg(*metrics.moments())
    s = {r.gene: r for r in metrics.gene_scores(metrics.merge_moments(m, "gene"), "gene").collect()}
    assert s[2].pcc is None and s[2].nrmse == 0 and s[0].mae == 1 and abs(s[1].pcc - 1) < 1e-12 and abs(s[0].nrmse - ((1 / 64 + (2 / 7 - 3 / 8) ** 2 + 1 / 49) / 4) ** 0.5) < 1e-12


def test_counterexample_of_the_grid_residual(spark):
    """One owned pixel in a 4 x 4 cell, prior [15, 1], count 10: the grid holds 25, and 8.4375 is missing again."""
    segments = frame(spark, [(0, -1, 0, 0, 15), (0, 7, 0, 0, 1)], "section_id long, parent_id long, qy long, qx long, area_px long")
    weights = segments.withColumn("gene_id", F.lit(1).cast("long")).withColumn("weight", F.col("area_px").cast("double"))
    mass = allocate.allocate(weights, frame(spark, [(0, 7, 1, 10)], "section_id long, parent_id long, gene_id long, umi long"))
    cells = allocate.to_cells(mass)
    assert cells.first()["mass"] == 25
    assert 10 - audit.field_grid(segments, cells).first()["p"] == 8.4375


def test_a_count_without_support_fails(spark):
    w = frame(spark, [(0, 7, 0, 0, 1, 0.0)], "section_id long, parent_id long, qy long, qx long, gene_id long, weight double")
    with pytest.raises(Exception, match="no support"):
        allocate.allocate(w, frame(spark, [(0, 7, 1, 10)], "section_id long, parent_id long, gene_id long, umi long")).collect()


def test_raw_counts(spark):
    assert counts.checked(frame(spark, [(2**53 + 1,)], "umi long")).first()["umi"] == 2**53 + 1
    for bad in (0.5, float("nan"), -1.0, 1e30):
        with pytest.raises(Exception, match="not a raw count"):
            counts.checked(frame(spark, [(bad,)], "umi double")).collect()


def test_registration():
    with pytest.raises(ValueError):
        geometry.check_registration([[1, 0, 0], [2, 0, 0], [0, 0, 1]])
    assert geometry.invert([[4.0, 0.0, 1.5], [0.0, 4.0, 1.5], [0.0, 0.0, 1.0]]) == [[0.25, 0.0, -0.375], [0.0, 0.25, -0.375], [0.0, 0.0, 1.0]]


def test_barrier_stops_interpolation(spark):
    tissue = [(0, y, x) for y in range(8) for x in range(8) if x != 5]
    schema = "section_id long, qy long, qx long"
    found = neighbors.gap_sources(frame(spark, [t for t in tissue if t[1:] != (2, 2)], schema), frame(spark, [(0, 2, 2)], schema), frame(spark, tissue, schema)).collect()
    assert found and all(r.qx < 5 and r.weight == 1 for r in found)
    assert neighbors.gap_sources(frame(spark, [], schema), frame(spark, [(0, 2, 2)], schema), frame(spark, [], schema)).collect() == []


def test_connected_parts(spark):
    snake = [(0, y, x, 1) for y in range(12) for x in range(12) if y % 2 == 0 or x == (11 if y % 4 == 1 else 0)]
    rows = snake + [(0, 20, 0, 2), (0, 21, 1, 2), (0, 30, 5, 3)]
    assert {r.parent_id: r.parts for r in owners.parts(frame(spark, rows, "section_id long, y long, x long, parent_id long")).collect()} == {1: 1, 2: 2, 3: 1}


def test_seeds():
    assert 0 <= sampling.stable_seed("a", 1) < 2**63 - 1 and sampling.stable_seed("a", 1) != sampling.stable_seed("a", 2)


def test_writers_do_not_overwrite(spark, tmp_path):
    a, b = frame(spark, [(1,)], "v long"), frame(spark, [(2,)], "v long")
    tables.write_new(a, str(tmp_path / "t"))
    with pytest.raises(Exception, match="exist"):
        tables.write_new(a, str(tmp_path / "t"))
    assert tables.write_equal(a, str(tmp_path / "t")) and not tables.write_equal(b, str(tmp_path / "t")) and tables.write_equal(b, str(tmp_path / "u"))


def test_sources(spark, tmp_path):
    (tmp_path / "p.csv").write_text("barcode,in_tissue,pxl_row_in_fullres,pxl_col_in_fullres\nb,1,80,80\na,1,130,130\nc,0,1,1\n")
    assert sorted(r.barcode for r in tables.positions(spark, str(tmp_path / "p.csv")).collect()) == ["a", "b"]
    (tmp_path / "q.csv").write_text("barcode,in_tissue,pxl_row_in_fullres,pxl_col_in_fullres\nb,2,80,80\n")
    with pytest.raises(Exception, match="neither"):
        tables.positions(spark, str(tmp_path / "q.csv")).collect()
    data = frame(spark, [(0, 0, 2), (1, 1, 5), (2, 0, 3), (3, 1, 7)], "k long, row long, value long")
    starts = frame(spark, [(0, 0), (1, 2), (2, 2), (3, 4)], "col long, start long")
    assert sorted(map(tuple, tables.csc_matrix(data, starts).collect())) == [(0, 0, 2), (0, 2, 3), (1, 0, 5), (1, 2, 7)]
    with pytest.raises(Exception, match="no position"):
        tables.matched(frame(spark, [("z",)], "barcode string"), frame(spark, [("a",)], "barcode string")).collect()


def test_streams_equal_batches(spark, tmp_path):
    rows = [(r, e, float((r * 7919 + e * 104729) % 1000)) for r in range(3) for e in range(1, 31)]
    runs = frame(spark, rows, "run long, epoch long, loss double")
    for i in range(3):
        runs.where(f"epoch > {i * 10} AND epoch <= {i * 10 + 10}").coalesce(1).write.mode("append").parquet(str(tmp_path / "runs"))
    batch = {tuple(r) for r in sampling.early_stopping(runs, ["loss"], {"loss": 50.0}, 5, 8).collect()}
    whole = accumulate.streamed(spark, str(tmp_path / "runs"), runs.schema, files=100)
    out = accumulate.drained(accumulate.early_stopping(whole, ["loss"], {"loss": 50.0}, 5, 8), "update")
    assert {tuple(r) for r in out.drop("trigger").collect()} == batch
    pairs = runs.select("run", F.col("loss").alias("p"), (F.col("loss") * 2 + F.col("epoch") % 3).alias("y"))
    want = {r.run: r.pcc for r in metrics.gene_scores(pairs.groupBy("run").agg(*metrics.moments()), "run").collect()}
    stream = accumulate.streamed(spark, str(tmp_path / "runs"), runs.schema).select("run", F.col("loss").alias("p"), (F.col("loss") * 2 + F.col("epoch") % 3).alias("y"))
    got = {r.run: r.pcc for r in accumulate.drained(accumulate.gene_scores(stream, "run"), "complete").collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_stopping_asks_for_a_gain_of_one_task(spark):
    runs = frame(spark, [(1, 1, 10.0), (1, 2, 9.5), (1, 3, 8.0), (1, 4, 7.5)], "run long, epoch long, loss double")
    stop = lambda gain: sampling.early_stopping(runs, ["loss"], {"loss": 5.0}, 9, 0, {"loss": gain}).first()["best_epoch"]
    assert (stop(0.0), stop(1.0), stop(3.0)) == (4, 3, 1)


def test_an_uncovered_cell_fails(spark):
    cells = frame(spark, [(0, 5, 5), (0, 500, 500)], "section_id long, qy long, qx long")
    fields = frame(spark, [(0, -16, -16, 1)], "section_id long, y0 long, x0 long, field_id long")
    assert geometry.covering_fields(cells.where("qy = 5"), fields).first()["weight"] == 1.0
    with pytest.raises(Exception, match="no field covers"):
        geometry.covering_fields(cells, fields).collect()


def test_fine_tuning_fields(spark):
    """A lone parent makes no field eligible, two of a group do where one lies in the core; too few fields fail."""
    schema = "section_id long, py long, px long"
    lone = jobs.eligible_squares(frame(spark, [(0, 5, 5), (0, 30, 30)], schema))
    assert lone.collect() == []
    # Field 0 starts at parent -3, so that (5, 5) and (6, 6) share a group there; in field 1, from parent 7 on, neither lies.
    both = jobs.eligible_squares(frame(spark, [(0, 5, 5), (0, 6, 6), (0, 5, 5)], schema))
    assert [tuple(r) for r in both.collect()] == [(0, -24, -24)]
    fields = frame(spark, [(0, 0, 0), (0, 0, 100), (0, 0, 300)], "section_id long, y0 long, x0 long")
    got = jobs.fine_tuning_fields(fields, 200, least=1).collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, 0, "support"), (0, 0, 300, "selection")]
    with pytest.raises(Exception, match="too few fields"):
        jobs.fine_tuning_fields(fields, 200, least=2).collect()


def test_source_labels(spark):
    schema = "section_id long, qy long, qx long"
    tissue, direct, made = [(0, 0, 0), (0, 0, 1), (0, 9, 9)], [(0, 0, 0)], [(0, 0, 1), (0, 0, 1)]
    got = jobs.source_labels(frame(spark, tissue, schema), frame(spark, direct, schema), frame(spark, made, schema)).collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, 0, 1), (0, 0, 1, 2), (0, 9, 9, 0)]


def test_parent_features(spark):
    """A parent that fills its field: centre 0, compactness pi/4, fill 1."""
    own_ = owners.parent_geometry(frame(spark, [(0, y, x, 1) for y in range(4) for x in range(4)], "section_id long, y long, x long, parent_id long"))
    (r,) = owners.parent_features(own_, 4, 4).collect()
    assert [round(v, 9) for v in r[2:]] == [round(v, 9) for v in (0.0, 0.0, math.log(16), math.log(4), math.log(4), math.pi / 4, 1.0)]
