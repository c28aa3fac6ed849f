"""Centroid clustering: Lloyd's rounds over vectors that are sharded by dimension."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.graph import cut
from lamella.session import shared_folder

#: Vectors of one block. A column block holds this many rows of one shard's dimensions.
BLOCK = 4096
#: Dimensions of a shard.
WIDTH = 16
#: Largest magnitude of an integer component: squared distances over 64 dimensions stay within 64 bits.
MOST = 1 << 27


def usable(x: Column, dim: int) -> Column:
    """Does an array hold exactly ``dim`` numbers, none null or non-finite?"""
    return F.coalesce((F.size(x) == dim) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))), F.lit(False))


def whole_numbers(x: Column, scale: int) -> Column:
    """Components as integers floor(scale * x), x as double; one beyond 2^27 fails, as its distances would not fit a long."""
    whole = lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))
    fits = lambda c: F.abs(F.lit(float(scale)) * c.cast("double")) < float(MOST)
    return F.transform(x, lambda c: F.when(fits(c), whole(c)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long")))


def _first(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ``<seed>:<vec_id>`` has the smallest SHA-256; equal hashes by components, null ids last."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.when(F.col("vec_id").isNotNull(), F.col("vec_id").cast("string"))), 256)
    rows = kept.orderBy(F.col("vec_id").isNull(), key, "q").limit(k).select("q").collect()
    return np.array([r["q"] for r in rows], np.int64)


def _blocks(size: int):
    """Packs Arrow batches of (vec_id, q) into blocks of rows: (task, at, vec_ids, q as 64-bit numbers)."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, at = TaskContext.get().partitionId(), 0
        for b in batches:
            for s in range(0, len(b), size):
                part = b.slice(s, size)
                ids, q = part.column(0), part.column(1).flatten().to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([at]), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([q.tobytes()])], names=["task", "at", "vec_ids", "q"])
                at += 1

    return run


def _sharded(dim: int, width: int):
    """The column blocks of a block by (shard, block), and its ids under shard -1."""

    def run(row):
        q, block = np.frombuffer(row["q"], np.int64).reshape(-1, dim), (row["task"], row["at"])
        kind = np.int16 if np.abs(q).max() < 1 << 15 else np.int32
        for s in range(0, dim, width):
            yield (s // width, block), np.ascontiguousarray(q[:, s : s + width], kind)
        yield (-1, block), row["vec_ids"]

    return run


def _place(per_shard: int):
    """Partition of a (shard, block): a shard's blocks stay in partitions of its own."""

    def run(key):
        shard, (task, at) = key
        return (shard + 1) * per_shard + (task * 31 + at) % per_shard

    return run


def _partial(slices: dict[int, np.ndarray]):
    """Exact squared distances of a column block to the shard's slice of every centroid: (block, rows x centroids)."""

    def run(item):
        (shard, block), q = item
        q = q.astype(np.int64)
        return block, np.stack([((q - c) ** 2).sum(1) for c in slices[shard]], 1)

    return run


def _nearest(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller at ties, and its squared distance."""
    best = d.argmin(1)
    return best, d[np.arange(len(d)), best]


def _members(k: int):
    """A column block's sums and numbers of members by centroid, in whole numbers of any size."""

    def run(item):
        (shard, _), (q, best) = item
        sums = np.zeros((k, q.shape[1]), np.int64)
        np.add.at(sums, best, q.astype(np.int64))
        return shard, (sums.astype(object), np.bincount(best, minlength=k).astype(object))

    return run


def _moved(slices: dict[int, np.ndarray]):
    """A shard's new slice: floor(sum / count) of every centroid that has members, the old one elsewhere."""

    def run(item):
        shard, (sums, n) = item
        new = [[int(s) // int(m) for s in row] if m else old.tolist() for row, m, old in zip(sums, n, slices[shard], strict=True)]
        return shard, np.array(new, np.int64)

    return run


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, width: int = WIDTH, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every usable row of ``vectors`` (vec_id, embedding), final centroids).

    Usable rows hold exactly ``dim`` numbers, none null or non-finite; all others are left out. Components become integers
    floor(scale * x); all that follows is exact. Centroids start as the k usable vectors with the smallest SHA-256 of
    ``<seed>:<vec_id>`` (repeated ids by components, null ids last), or as many as there are. A round takes every vector to
    its nearest centroid (ties: smaller number) and replaces centroids with members by floor(sum / count); after the rounds
    vectors are assigned once more. Repeated rows count as often as they come; an empty table gives no rows.

    Column blocks of ``width`` dimensions lie in partitions of their shard for all rounds, in the shared folder. A round
    moves partial distances (added by ``reduceByKey``) and block assignments, never components; a task needs its own
    shard's slice of the centroids alone, and each shard updates its slice. The driver sees centroids: k x dim integers.
    """
    spark = vectors.sparkSession
    kept = vectors.select("vec_id", "embedding").where(usable(F.col("embedding"), dim)).select("vec_id", whole_numbers(F.col("embedding"), scale).alias("q"))
    start = _first(kept, k, seed)
    schema = f"vec_id {dict(vectors.dtypes)['vec_id']}, cluster int, distance long"
    if not len(start):
        return spark.createDataFrame([], schema), np.zeros((0, dim), np.int64)
    k, shards = len(start), -(-dim // width)
    per_shard = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // (shards + 1))
    parts, place = per_shard * (shards + 1), _place(per_shard)
    packed = kept.mapInArrow(_blocks(block), f"task long, at long, vec_ids array<{dict(vectors.dtypes)['vec_id']}>, q binary")
    held = _checkpointed(packed.rdd.flatMap(_sharded(dim, width)).partitionBy(parts, place))
    blocks, ids = held.filter(lambda x: x[0][0] >= 0), held.filter(lambda x: x[0][0] < 0)
    slices = {s: start[:, s * width : (s + 1) * width] for s in range(shards)}

    def assigned():
        total = blocks.map(_partial(slices)).reduceByKey(lambda a, b: a + b, parts)
        return total.mapValues(_nearest)

    def to_shards(found, numbers):
        keyed = found.flatMap(lambda x: [((s, x[0]), x[1]) for s in numbers])
        return keyed.partitionBy(parts, place)

    for _ in range(rounds):
        best = to_shards(assigned().mapValues(lambda x: x[0].astype(np.int32)), range(shards))
        sums = _met(blocks, best, parts, place).map(_members(k)).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), shards)
        slices = dict(sums.map(_moved(slices)).collect())
    named = _met(ids, to_shards(assigned(), [-1]), parts, place)
    rows = named.flatMap(lambda x: zip(x[1][0], x[1][1][0].tolist(), x[1][1][1].tolist(), strict=True))
    return cut(spark.createDataFrame(rows, schema)), np.concatenate([slices[s] for s in range(shards)], 1)


def _met(blocks, found, parts: int, place):
    """(key, (block, found)) of RDDs partitioned alike: nothing moves. (``join`` deals by another function, and so anew.)"""
    both = blocks.mapValues(lambda x: (0, x)).union(found.mapValues(lambda x: (1, x)))
    return both.groupByKey(parts, place).mapValues(lambda xs: [x for _, x in sorted(xs, key=lambda x: x[0])])


def _checkpointed(rdd):
    """A keyed RDD written to the shared folder, its partitioning kept."""
    context = rdd.context
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(SparkSession.getActiveSession()))
    rdd.checkpoint()
    rdd.count()
    return rdd


def report(vectors: DataFrame, **settings) -> DataFrame:
    """``clustered`` with cluster_inertia and inertia (squared distances added over the cluster and over all) and centroid_sha256."""
    found, centroids = clustered(vectors, **settings)
    spark = vectors.sparkSession
    digest = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    each = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = each.agg(F.sum("cluster_inertia").alias("inertia"))
    # One row a centroid, and one row: bounded by k.
    names = each.crossJoin(F.broadcast(total)).join(F.broadcast(spark.createDataFrame(digest, "cluster int, centroid_sha256 string")), "cluster")
    return found.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
