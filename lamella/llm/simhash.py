"""SimHash fingerprints and near-duplicate components with pivot distance tables."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.graph import bounded_batches, connected_components, cut, whole_keys

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of a text, repeats included; 0 where it has no word.

    Bytes A-Z are lower-cased, words end at 0x20 and 0x09-0x0D, and a text of fewer words is one shingle.
    """
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return 0
    buf = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    spans = zip(starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist(), strict=True)
    return majority(np.fromiter((xxh64_intdigest(buf[a:b], seed) for a, b in spans), np.uint64, n))


def majority(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes: a bit is 1 if set in over half of them; 0 if there are none."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        bits = np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(0, dtype=np.uint32)
    return int(sum(1 << b for b in np.flatnonzero(2 * set_bits > len(h)).tolist()))


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): a signed 64-bit fingerprint of every row; null texts count as empty."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            seen: dict[str | None, int] = {}
            out = []
            for t in b.column(1).to_pylist():
                if (f := seen.get(t)) is None:
                    f = seen[t] = fingerprint(t, words, seed)
                out.append(f)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = 16, seed: int = 11) -> np.ndarray:
    """Reference fingerprints. Random words lie near distance 32 of each other, where distances spread most evenly."""
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)


def near_forest(key: np.ndarray, fp: np.ndarray, refs: np.ndarray, most: int, held: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints, and for each the index of its component's smallest, by pairs of equal key within ``most`` bits.

    Rows are walked in the order of their distance to the first pivot, so that partners further than ``most`` in that
    coordinate are never met; the other coordinates then discard by the triangle inequality; the rest are verified.
    Pairs that are connected already are passed over, and links are merged when ``held`` of them have come together.
    """
    value, ids = np.unique(fp, return_inverse=True)
    root = np.arange(len(value))
    first = np.bitwise_count(value ^ refs[0]).astype(np.int8)
    order = np.lexsort((first[ids], key))
    key, ids = key[order], ids[order]
    table = np.stack([np.bitwise_count(value ^ p).astype(np.int8) for p in refs])
    left, right, n = [], [], 0
    alive, step = np.arange(len(key)), 1
    while len(alive):
        alive = alive[alive + step < len(key)]
        x, y = ids[alive], ids[alive + step]
        near = (key[alive] == key[alive + step]) & (first[y] - first[x] <= most)
        alive, x, y = alive[near], x[near], y[near]
        for t in [None, *table[1:]]:
            ok = root[x] != root[y] if t is None else np.abs(t[x] - t[y]) <= most
            x, y = x[ok], y[ok]
        ok = np.bitwise_count(value[x] ^ value[y]) <= most
        left.append(x[ok])
        right.append(y[ok])
        n += len(left[-1])
        if n > held:
            root, left, right, n = _merged(root, left, right), [], [], 0
        step += 1
    return value, _merged(root, left, right)


def _merged(root: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Components after more links; every root is the smallest index of its component."""
    if not left:
        return root
    left, right = np.concatenate(left), np.concatenate(right)
    while len(left):
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[left] != root[right]
        left, right = left[open_], right[open_]
    return root


def links(distinct: DataFrame, most: int = 4, blocks: int = 6, refs: int = 16, chunk: int = 4096) -> DataFrame:
    """Links (u, v) that connect every pair of distinct fingerprints within ``most`` bits, as a spanning forest per bucket.

    Of ``blocks`` bit groups, two fingerprints within ``most`` bits agree on blocks - most at least, so that a join on
    every choice of as many groups meets every such pair. A bucket of more than ``chunk`` rows is dealt out as pairs of
    its parts; no bucket is cut or skipped.
    """
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    masks = []
    for group in combinations(range(blocks), blocks - most):
        masks.append(sum(((1 << int(edges[g + 1] - edges[g])) - 1) << int(edges[g]) for g in group))
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(signed)])).alias("k"))
    keyed = keyed.select("fp", F.xxhash64("k.i", F.col("fp").bitwiseAND(F.col("k.m"))).alias("key"))
    large = keyed.groupBy("key").count().where(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).cast("int").alias("parts"))
    keyed = keyed.join(large, "key", "left")
    part = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1)))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    keyed = keyed.select("fp", "key", part.alias("part"), other.alias("other"))
    pair = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    dealt = keyed.select("fp", pair.alias("key")).repartition("key").sortWithinPartitions("key")
    points = pivots(refs)

    def run(batches):
        import pyarrow as pa

        for part in whole_keys(batches, 1):
            fp = np.concatenate([b.column(0).to_numpy() for b in part]).view(np.uint64)
            key = np.concatenate([b.column(1).to_numpy() for b in part])
            value, root = near_forest(key, fp, points, most)
            tip = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(value[tip].view(np.int64)), pa.array(value[root[tip]].view(np.int64))], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4, most: int = 4, blocks: int = 6, refs: int = 16) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    Rows are first grouped by fingerprint, so that copies cost one row; links are searched between distinct
    fingerprints. component_id is the smallest doc_id reachable by links of at most ``most`` bits. Null and empty
    texts have fingerprint 0 and link like any other. Rows of null doc_id are kept; such an id is never the smallest.
    """
    prints = cut(fingerprints(docs, words))
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    comp = connected_components(links(groups.select("fp"), most, blocks, refs))
    group = groups.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    least = group.groupBy("component").agg(F.min("low").alias("component_id"))
    named = group.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
