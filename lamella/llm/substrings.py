"""Removal of repeated word windows behind a count-min prefilter."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.graph import bounded_batches, cut, whole_keys
from lamella.llm.tokens import WordHasher, grams, mix, random_words, separators, sliding, text_batches

#: A window is looked up in the sketch by its least gram of this many words (the whole window if it is shorter).
GRAM = 12
ROWS = 2
#: Counters of one slice of a row, at most: slices are merged one by one, so that more counters mean more tasks.
SLICE = 1 << 20
#: Counters a row: four or more for each value counted, within these powers of two (the sketch that tasks get has a bit
#: for each: 64 MB at most). With more values than counters, more windows pass; none is lost.
LEAST, MOST = 20, 28
#: Values or windows that a task holds before it hands them on.
HELD = 2_000_000
#: Bytes of text a bucket is meant to hold; a bucket's windows and texts are one task's share.
BUCKET = 4_000_000
#: Most partitions of the exact pass. Beyond it a partition holds several buckets, sorted, and goes through them in turn.
MOST_PARTITIONS = 16_384
#: Repeated rows are known by 12 bytes each; up to this many are broadcast, more are joined.
BROADCAST = 1_000_000


def anchors(h: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, least gram of each window, all positions' least grams that some window chose).

    Two equal windows choose the same gram at the same offset, so that a window that occurs twice has a gram that is
    chosen at two places: counts of chosen grams are never below counts of windows.
    """
    k = min(GRAM, window)
    w = window - k + 1
    g = grams(h, k, 3)
    low = sliding(np.minimum, g, w)
    inside = np.arange(len(low)) + window <= ends[: len(low)]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return starts, g[:0], g[:0]
    pad = np.zeros(w - 1, np.uint64)
    high = sliding(np.maximum, np.concatenate([pad, np.where(inside, low, np.uint64(0)), pad]), w)
    return starts, low[starts], g[(high == g) & (high > 0)]


def _cells(value: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(value ^ seed) >> np.uint64(64 - bits)).astype(np.int64) for seed in random_words(ROWS, 99)]


def _hashed(batches, column: int, window: int):
    """Word hashes of Arrow batches: (batch, first row, word offsets, word hashes, ends)."""
    hasher = WordHasher(separators(), seed=31)
    for b in batches:
        for row, buf, bounds in text_batches(b.column(column)):
            _, _, h, offsets = hasher(buf, bounds)
            yield b, row, offsets, h, np.repeat(offsets[1:], np.diff(offsets))


def sketch(docs: DataFrame, window: int, bits: int) -> list[bytes]:
    """Count-min sketch of the chosen grams, as ROWS rows of bit sets, slice by slice: is the counter two or more?

    Every task counts its partition; counters are added slice by slice on the executors.
    """
    slices_ = max(16, (1 << bits) // SLICE)
    width = (1 << bits) // slices_

    def part(batches):
        import pyarrow as pa

        def rows(held):
            value = np.concatenate(held)
            slices, once, twice = [], [], []
            for r, cell in enumerate(_cells(value, bits)):
                cell, n = np.unique(cell, return_counts=True)
                cuts = np.searchsorted(cell, np.arange(slices_ + 1) * width)
                for s in range(slices_):
                    c, m = cell[cuts[s] : cuts[s + 1]] - s * width, n[cuts[s] : cuts[s + 1]]
                    slices.append(r * slices_ + s)
                    once.append(zlib.compress(np.diff(c[m == 1], prepend=0).astype(np.uint32).tobytes(), 1))
                    twice.append(zlib.compress(np.diff(c[m > 1], prepend=0).astype(np.uint32).tobytes(), 1))
            return pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["slice", "once", "twice"])

        held, n = [], 0
        for _, _, _, h, ends in _hashed(batches, 0, window):
            held.append(anchors(h, ends, window)[2])
            n += len(held[-1])
            if n > HELD:
                yield rows(held)
                held, n = [], 0
        if n:
            yield rows(held)

    def merge(batches):
        import pyarrow as pa

        counts: dict[int, np.ndarray] = {}
        for b in batches:
            for s, once, twice in zip(*(c.to_pylist() for c in b.columns), strict=True):
                counter = counts.setdefault(s, np.zeros(width, np.uint8))
                for packed, add in ((once, 1), (twice, 2)):
                    cell = np.cumsum(np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.int64))
                    counter[cell] = np.minimum(counter[cell] + add, 2)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array([np.packbits(c > 1).tobytes() for c in counts.values()], pa.binary())], ["slice", "bits"])

    merged = docs.select("text").mapInArrow(part, "slice int, once binary, twice binary").repartition(min(ROWS * slices_, max(8, docs.sparkSession.sparkContext.defaultParallelism * 4)), "slice").mapInArrow(merge, "slice int, bits binary")
    out = [bytes(width // 8)] * (ROWS * slices_)
    for s, bits_ in merged.collect():  # of fixed size: ROWS * 2 ** bits / 8 bytes
        out[s] = bytes(bits_)
    return out


#: A row's identity: 96 bits of (doc_id, text).
RID = np.dtype([("a", "<i8"), ("b", "<i4")])


def _rids(h1, h2) -> np.ndarray:
    out = np.empty(len(h1), RID)
    out["a"], out["b"] = h1.to_numpy(), h2.to_numpy()
    return out


def _identified(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with a column id (h1, h2): two hashes, nulls apart from all values."""
    parts = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text").isNull(), F.col("text")]
    return docs.select("doc_id", "text", F.xxhash64(*parts).alias("h1"), F.hash(*parts).alias("h2"))


def _copied(docs: DataFrame) -> DataFrame:
    """Identified rows with ``copied``: does the same row come more than once?"""
    many = cut(docs.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2", F.lit(True).alias("copied")))
    n = many.count()
    if not n:
        return docs.withColumn("copied", F.lit(False))
    return docs.join(F.broadcast(many) if n <= BROADCAST else many, ["h1", "h2"], "left").withColumn("copied", F.coalesce("copied", F.lit(False)))


def repeated_windows(docs: DataFrame, window: int, buckets: int, bits: int) -> DataFrame:
    """(bucket, rid, pos): packed word positions (12 and 4 bytes each) at which repeated windows of row rid start.

    ``docs``: (h1, h2, copied, text). Windows of copied rows count, but no positions are given for them. Only windows whose
    count the sketch puts at two or more are handed on, by hash; each task first groups its own, so that the most
    frequent window comes once from each task. Windows are then grouped exactly, by a 96-bit hash.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sketch(docs, window, bits))

    def candidates(batches):
        import pyarrow as pa

        n = len(shared.value) // ROWS
        sets = [np.frombuffer(b"".join(shared.value[r * n : (r + 1) * n]), np.uint8) for r in range(ROWS)]

        def packed(held):
            h1, h2, rid, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((h2, h1))
            s1, s2 = h1[order], h2[order]
            new = np.concatenate([[True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])])
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            local = np.zeros(len(h1), bool)
            local[order] = many
            local |= pos < 0
            first = np.zeros(len(h1), bool)
            first[order] = new
            keep = np.flatnonzero(first | ~local)
            yield pack((h1[keep] % np.uint64(buckets)).astype(np.int64), h1[keep], h2[keep], rid[keep], np.where(local[keep], -1, pos[keep]).astype(np.int32))
            own = np.flatnonzero(local & (pos >= 0))
            if len(own):
                yield pack(rid["a"][own] % buckets, h1[:0], h2[:0], rid[own], pos[own])

        def pack(bucket, h1, h2, rid, pos):
            order = np.argsort(bucket, kind="stable")
            at, n = np.unique(bucket, return_counts=True)
            cuts = np.concatenate([[0], np.cumsum(n)])
            return pa.RecordBatch.from_arrays([pa.array(at), *(_blobs(x[order] if len(x) else x, cuts if len(x) else cuts * 0) for x in (h1, h2, rid, pos))], ["bucket", "h1", "h2", "rid", "pos"])

        held, total = [], 0
        for b, row, offsets, h, ends in _hashed(batches, 3, window):
            starts, low, _ = anchors(h, ends, window)
            if not len(starts):
                continue
            keep = np.ones(len(starts), bool)
            for bits_, cell in zip(sets, _cells(low, bits), strict=True):
                keep &= (bits_[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
            starts = starts[keep]
            rids, copied = _rids(b.column(0), b.column(1))[row:], b.column(2).to_numpy(zero_copy_only=False)[row:]
            text = np.searchsorted(offsets, starts, "right") - 1
            h2 = (grams(h, window, 17)[starts] >> np.uint64(32)).astype(np.uint32)
            held.append((grams(h, window, 13)[starts], h2, rids[text], np.where(copied[text], -1, starts - offsets[text]).astype(np.int32)))
            total += len(starts)
            if total > HELD:
                yield from packed(held)
                held, total = [], 0
        if total:
            yield from packed(held)

    def exact(batches):
        for part in whole_keys(batches):
            yield grouped([unpacked(b) for b in part])

    def unpacked(b):
        h1, h2, rid, pos = (_joined(b.column(i), t) for i, t in enumerate((np.uint64, np.uint32, RID, np.int32), 1))
        # Rows of positions that their own task found to be repeated hold no hashes.
        sizes = [np.diff(np.frombuffer(b.column(i).buffers()[1], np.int32)[b.column(i).offset :][: len(b) + 1]) for i in (1, 3)]
        asked = np.repeat(sizes[0] > 0, sizes[1] // 12)
        return h1, h2, rid[asked], pos[asked], rid[~asked], pos[~asked]

    def grouped(held):
        import pyarrow as pa

        h1, h2, rid, pos, known_rid, known_pos = (np.concatenate(x) for x in zip(*held, strict=True))
        done = [(known_rid, known_pos)]
        if len(h1):
            order = np.lexsort((h2, h1))
            h1, h2, rid, pos = h1[order], h2[order], rid[order], pos[order]
            new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            group = np.cumsum(new) - 1
            ask = np.bincount(group, np.where(pos < 0, 2, 1))[group] > 1
            ask &= pos >= 0
            done.append((rid[ask], pos[ask]))
        rid, pos = (np.concatenate(x) for x in zip(*done, strict=True))
        bucket = rid["a"] % buckets
        order = np.argsort(bucket, kind="stable")
        at, n = np.unique(bucket, return_counts=True)
        cuts = np.concatenate([[0], np.cumsum(n)])
        return pa.RecordBatch.from_arrays([pa.array(at), _blobs(rid[order], cuts), _blobs(pos[order], cuts)], ["bucket", "rid", "pos"])

    packed = docs.select("h1", "h2", "copied", "text").mapInArrow(candidates, "bucket long, h1 binary, h2 binary, rid binary, pos binary")
    dealt = packed.repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(exact, "bucket long, rid binary, pos binary")


def _blobs(x: np.ndarray, cuts: np.ndarray):
    import pyarrow as pa

    offsets = (cuts * x.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    Words end at 0x20 and 0x09-0x0D and are compared unchanged. A word goes if a window of ``window`` words that covers
    it starts anywhere else too, in the same text or another. Null texts have no words; texts of fewer words than a
    window stay whole; of repeated rows with a window nothing stays, so that their positions are never looked up.
    """
    docs = _identified(bounded_batches(docs.select("doc_id", "text")))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    chosen = total // 6 * 2 // max(2, window - GRAM + 2)
    bits = min(MOST, max(LEAST, int(4 * chosen).bit_length()))
    buckets = max(32, total // BUCKET)
    docs = _copied(docs).withColumn("bucket", F.pmod("h1", F.lit(buckets)))
    marks = repeated_windows(docs, window, buckets, bits)
    none = np.zeros(0, np.int32)

    def apply(left, right):
        rid, pos = _joined(right.column("rid"), RID), _joined(right.column("pos"), np.int32)
        order = np.lexsort((rid["b"], rid["a"]))
        rid, pos = rid[order], pos[order]
        cuts = np.flatnonzero(np.concatenate([[True], rid[1:] != rid[:-1]])).tolist() if len(rid) else []
        place = {rid[a].tobytes(): pos[a:z] for a, z in zip(cuts, [*cuts[1:], len(rid)], strict=False)}
        ids = _rids(left.column("h1"), left.column("h2"))
        return _kept(left.column("doc_id"), (_without(t, place.get(i.tobytes(), none), window) for i, t in zip(ids, left.column("text").to_pylist(), strict=True)))

    def copies(batches):
        for b in batches:
            yield from _kept(b.column(0), (_without(t, np.arange(len((t or "").encode().split()) - window + 1), window) for t in b.column(1).to_pylist())).to_batches()

    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    single = docs.where("NOT copied").select("bucket", "h1", "h2", "doc_id", "text").groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(apply, schema)
    return single.unionByName(docs.where("copied").select("doc_id", "text").mapInArrow(copies, schema))


def _without(text: str | None, pos: np.ndarray, window: int) -> tuple[int, int, str]:
    """(words, words removed, words kept) of a text in which the windows that start at ``pos`` go."""
    words = (text or "").encode().split()
    if not len(pos):
        return len(words), 0, b" ".join(words).decode()
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, pos, 1)
    np.add.at(edge, pos + window, -1)
    kept = [w for w, n in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not n]
    return len(words), len(words) - len(kept), b" ".join(kept).decode()


def _kept(ids, rows):
    import pyarrow as pa

    n_words, n_removed, kept = zip(*rows, strict=True) if len(ids) else ((), (), ())
    return pa.table([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])
