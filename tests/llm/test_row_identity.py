"""Near-duplicate rows with missing or reused ids: every group keeps one row."""

from pyspark.sql import functions as F

import corpus_pipeline
from lamella.llm import resemblance

SF = "/root/testdata/sf0.001"

A, B = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))


def test_null_and_reused_ids(spark):
    rows = [(None, A), (None, A + " x"), (3, B), (None, B), (5, "one text here"), (5, "other text there"), (5, "one text here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()]
    assert len(got) == 4 and sum(t.startswith(A) for _, t in got) == 1
    assert {(3, B), (5, "one text here"), (5, "other text there")} <= set(got)


def test_equal_halves_of_identities_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "doc_id long, text string")
    rows = docs.select("doc_id", resemblance.row_identity().alias("row"), F.expr("CASE WHEN doc_id = 4 THEN 8L ELSE 7L END").alias("set"), F.expr("doc_id % 2").alias("other"))
    comp = spark.createDataFrame([(7, 7), (8, 7)], "node long, component long")
    # 2 and 4 are one group; 1 and 3 only share the first half with 2.
    assert sorted(r.doc_id for r in resemblance._least(docs, rows, comp).collect()) == [1, 2]
    assert rows.select("row").distinct().count() == 4 and len(rows.first()["row"]) == 16


def test_null_and_marks_are_different_rows(spark):
    rows = [(None, ""), (None, None), (1, ""), (1, None), (1, "."), (1, ":"), (11, ":"), (-1, ".")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert frame.select(resemblance.row_identity().alias("r")).distinct().count() == len(rows)


def test_extra_columns_of_clashing_names(spark):
    names = ["_row", "_Language_score", "_pii_spans", "__pii_spans_text", "row", "key", "set", "component", "end", "match", "found"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs.select(*docs.columns, *[F.col("source").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES:
        plain, more = stage(spark, docs, SF), stage(spark, wide, SF)
        if name == "packing":
            assert plain.groupBy("doc_id").agg(F.sum("length")).exceptAll(more.groupBy("doc_id").agg(F.sum("length"))).count() == 0
            continue
        assert more.columns == wide.columns
        kept = sorted(map(tuple, more.select(*docs.columns).collect()), key=str)
        assert kept == sorted(map(tuple, plain.collect()), key=str) and kept
        assert more.where(" OR ".join(f"NOT (`{n}` <=> source)" for n in names)).count() == 0
