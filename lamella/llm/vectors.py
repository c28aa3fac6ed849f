"""Near-duplicate vectors: binary codes of a random rotation bound cosines and decide which pairs are recomputed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from lamella.llm.graph import connected_components, cut

#: Vectors of one label are compared in blocks of about this many. A vector goes to as many tasks as its label has
#: blocks, so that larger blocks move less; two of them are a few seconds' work.
CHUNK = 16384
#: For rounding in single precision.
MARGIN = 1e-3


def rotation(dim: int, seed: int = 17) -> np.ndarray:
    """Random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated units, packed sign bits, correction factors) of unit vectors.

    The code of o is the corner c = sign(o) / sqrt(dim) of the rotated cube; its factor is <c, o>.
    """
    rotated = units @ turn
    factor = np.abs(rotated).sum(1) / np.sqrt(units.shape[1])
    return rotated.astype(np.float32), np.packbits(rotated > 0, axis=1), factor


def candidates(query: np.ndarray, codes: np.ndarray, factor: np.ndarray, least: float) -> np.ndarray:
    """Boolean (query, code) matrix: may the cosine reach ``least``?

    <c, q> / <c, o> estimates <o, q> without bias under the random rotation. With k = sqrt(1 - f^2) / f for factor f it
    is off by k * sqrt(1 - <o, q>^2) at most, by Cauchy-Schwarz on what c and q have beside o; so a cosine of ``least``
    shows an estimate of at least - k * sqrt(1 - least^2) or more. No such pair is lost.
    """
    dim = query.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    estimate = query @ signs.T
    estimate *= (1 / (np.sqrt(dim) * factor)).astype(np.float32)
    k = np.sqrt(np.maximum(0, 1 - factor**2)) / factor
    return estimate >= (least - k * np.sqrt(1 - least**2) - MARGIN).astype(np.float32)


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy().astype(np.float64).reshape(len(flat), -1)


def _coded(batches):
    """Adds the binary code and the correction factor of every vector of an Arrow batch; ``dim`` is its length."""
    import pyarrow as pa

    for b in batches:
        names = b.schema.names
        dims, vectors = b.column(names.index("dim")).to_numpy(), b.column(names.index("embedding"))
        code, factor = np.empty(len(b), object), np.zeros(len(b))
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            v = _matrix(vectors.take(pa.array(at)))
            _, bits, factor[at] = encode(v / np.sqrt((v * v).sum(1))[:, None], rotation(dim))
            code[at] = [row.tobytes() for row in bits]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code.tolist(), pa.binary()), pa.array(factor)], [*names, "code", "factor"])


def _compare(least: float):
    """Links inside one block, or between two: partners counted per vector, and links of a spanning forest."""

    def run(table):
        import pyarrow as pa

        node, (copies, side, factor) = table.column("node").combine_chunks(), (table.column(c).to_numpy() for c in ("copies", "side", "factor"))
        v = _matrix(table.column("embedding"))
        norm = np.sqrt((v * v).sum(1))
        rotated = (v / norm[:, None] @ rotation(v.shape[1])).astype(np.float32)
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(v), -1)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        inside = not len(right)
        if inside:
            right = left
        found_a, found_b = [], []
        for at in range(0, len(left), 512):
            q = left[at : at + 512]
            a, b = np.nonzero(candidates(rotated[q], codes[right], factor[right], least))
            a, b = q[a], right[b]
            if inside:
                a, b = a[a < b], b[a < b]
            for s in range(0, len(a), 65536):
                x, y = a[s : s + 65536], b[s : s + 65536]
                ok = (v[x] * v[y]).sum(1) / (norm[x] * norm[y]) >= least
                found_a.append(x[ok])
                found_b.append(y[ok])
        a = np.concatenate(found_a) if found_a else np.zeros(0, int)
        b = np.concatenate(found_b) if found_b else np.zeros(0, int)
        n = len(node)
        partners = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
        root = _components(n, a, b)
        some = np.flatnonzero(partners > 0)
        return pa.table([node.take(pa.array(some)), pa.array(partners[some].astype(np.int64)), node.take(pa.array(root[some]))], names=["node", "partners", "root"])

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of ``vectors`` (vec_id, embedding, label).

    Rows of one label that is not null link at a cosine of ``least`` or more, in double precision. A vector that is
    null, empty or zero, or that holds null or non-finite numbers, links with nothing, as do vectors of different
    lengths. Copies are compared once and counted as often as they come. component_id is the smallest vec_id reachable,
    a row's own if it has no link. Rows of null vec_id are kept and count as partners; their id is never the smallest.

    The blocks of a label meet pair by pair in separate tasks, so that a large label is spread over the cluster.
    """
    x = F.col("embedding")
    usable = F.coalesce(F.col("label").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))) & F.exists(x, lambda c: c != 0), F.lit(False))
    # 128 bits tell unlike vectors apart at any size of the table.
    half = lambda *salt: F.lpad(F.hex(F.xxhash64(*salt, F.col("label"), x, F.size(x))), 16, "0")
    node = F.when(usable, F.unhex(F.concat(half(), half(F.lit("second")))))
    rows = vectors.select("vec_id", "label", "embedding").withColumn("node", node)
    known = rows.where("node IS NOT NULL")
    groups = known.groupBy("node").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    groups = cut(groups.mapInArrow(_coded, StructType([*groups.schema, StructField("code", BinaryType()), StructField("factor", DoubleType())])))
    parts = groups.groupBy("label", "dim").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts"))
    dealt = groups.join(parts, ["label", "dim"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = F.xxhash64("label", "dim", F.least("part", "other"), F.greatest("part", "other")).alias("key")
    meet = dealt.select(key, "node", "copies", "embedding", "code", "factor", (F.col("part") > F.col("other")).cast("int").alias("side"))
    found = cut(meet.groupBy("key").applyInArrow(_compare(least), "node binary, partners long, root binary"))
    links = found.groupBy("node").agg(F.sum("partners").alias("partners"))
    comp = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    group = groups.select("node", "low", "copies").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = group.groupBy("component").agg(F.min("low").alias("component_id"))
    named = group.join(least_id, "component").join(links, "node", "left")
    named = named.select("node", "component_id", (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"))
    return rows.select("vec_id", "node").join(named, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
