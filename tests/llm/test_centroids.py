"""Centroid clustering against plain rounds over whole vectors."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import centroids


def plain(rows, k, rounds, dim, seed=3):
    good = lambda v: v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)
    kept = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in v]) for i, v in rows if good(v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cs = [q for _, q in first]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(cs))

    for _ in range(rounds):
        where = [nearest(q)[1] for _, q in kept]
        for j in range(len(cs)):
            own = [q for (_, q), w in zip(kept, where, strict=True) if w == j]
            if own:
                cs[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, nearest(q)[1], nearest(q)[0]) for i, q in kept], cs


def test_clusters(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=10) + 2 * (i % 3)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(i, rows[4][1]) for i in range(200, 240)] + [(3, rows[3][1]), (3, rows[5][1]), (None, rows[9][1]), (None, rows[9][1])]
    rows += [(900, None), (901, []), (902, [None] * 10), (903, [float("nan")] * 10), (904, [float("inf")] * 10), (905, [1.0] * 9), (906, [0.0] * 10), (907, [-0.0003] * 10)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS q", "'x' AS cluster", "2 AS distance").repartition(3)
    want, cs = plain(rows, 4, 3, 10)
    for width, block in ((4, 32), (16, 4096)):
        found, got = centroids.clustered(frame, k=4, rounds=3, dim=10, width=width, block=block)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
        assert got.tolist() == cs
    out = centroids.report(frame, k=4, rounds=3, dim=10).collect()
    assert len(out) == len(want) and {r.inertia for r in out} == {sum(d for *_, d in want)}
    assert {(r.cluster, r.cluster_inertia, r.centroid_sha256) for r in out} == {(c, sum(d for _, w, d in want if w == c), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for _, c, _ in want}


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert centroids.report(spark.createDataFrame([], schema)).collect() == []
    few = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0]), (5, [4.0, 1.0])], schema)
    got = {r.vec_id: r.distance for r in centroids.clustered(few, k=8, rounds=2, dim=2)[0].collect()}
    assert got == {1: 0, 2: 0, 5: 0}
    with pytest.raises(Exception, match="too large"):
        centroids.clustered(few.withColumn("embedding", F.array(F.lit(1e9), F.lit(0.0))), dim=2)


def test_blocks_stay_in_place(spark):
    """A round joins assignments to column blocks without moving the blocks."""
    place = centroids._place(2)
    blocks = spark.sparkContext.parallelize([((s, (0, b)), s) for s in range(2) for b in range(9)], 3).partitionBy(6, place)
    best = spark.sparkContext.parallelize([((s, (0, b)), b) for s in range(2) for b in range(9)], 2).partitionBy(6, place)
    met = centroids._met(blocks, best, 6, place)
    assert met.getNumPartitions() == 6 and sorted(met.collect()) == [((s, (0, b)), [s, b]) for s in range(2) for b in range(9)]
    assert met._jrdd.rdd().toDebugString().count("ShuffledRDD") == 2  # one for each side, none for the join
