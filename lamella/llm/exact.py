"""Exact duplicates through an extendible-hash index on shared files."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lamella.llm.graph import bounded_batches
from lamella.llm.tokens import separators, text_batches
from lamella.session import shared_folder

#: Hash bits that the directory may use at most, so that it never has more than 65,536 slots.
DEPTH = 16
#: A bucket holds 1 / 2^13 of all rows, or this many if that is more.
BUCKETS, LEAST = 1 << 13, 64
#: Rows or bytes of text that an owner task hands on at a time.
ROWS, BYTES = 4096, 4 << 20


def _typed(ddl: str):
    """Arrow schema of a table of that DDL."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def _batch(rows: list[tuple], schema):
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _entries(texts):
    """(row, 64-bit hash, text without blanks, code points of the original) of every text of an Arrow array."""
    import xxhash

    blank = separators()
    for row, buf, bounds in text_batches(texts):
        solid = ~blank[buf]
        ends = np.concatenate([[0], np.cumsum(solid)])[bounds].tolist()
        chars = np.diff(np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[bounds]).tolist()
        data = buf[solid].tobytes()
        for i in range(len(chars)):
            text = data[ends[i] : ends[i + 1]]
            yield row + i, xxhash.xxh3_64_intdigest(text), text, chars[i]


def _tallied(batches):
    """Rows of each of the 2^DEPTH smallest key ranges."""
    import pyarrow as pa

    n = np.zeros(1 << DEPTH, np.int64)
    for b in batches:
        slots = np.fromiter((h >> (64 - DEPTH) for _, h, _, _ in _entries(b.column(0))), np.int64)
        n += np.bincount(slots, minlength=len(n))
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["slot", "n"])


def directory(tally: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every directory slot, pages of every bucket) for rows counted by key range.

    Starts with one slot and one bucket. An overfull bucket is split by its next hash bit; the directory doubles where the
    bucket has a slot of its own already. A bucket that no bit of the directory splits, as it holds one text over and over,
    becomes a chain of pages of ``capacity`` rows.
    """
    bits = len(tally).bit_length() - 1
    before = np.concatenate([[0], np.cumsum(tally)])
    held = lambda first, local: int(before[(first + 1) << (bits - local)] - before[first << (bits - local)])
    slots, depth, buckets, full = np.zeros(1, np.int32), 0, [(0, 0)], [0]
    while full:
        b = full.pop()
        first, local = buckets[b]
        if held(first, local) <= capacity or local == bits:
            continue
        if local == depth:
            slots, depth = np.repeat(slots, 2), depth + 1
        buckets[b] = (2 * first, local + 1)
        buckets.append((2 * first + 1, local + 1))
        step = 1 << (depth - local - 1)
        slots[(2 * first + 1) * step : (2 * first + 2) * step] = len(buckets) - 1
        full += [b, len(buckets) - 1]
    return slots, np.array([max(1, -(-held(*b) // capacity)) for b in buckets], np.int32)


def _keyed(slots: np.ndarray, pages: np.ndarray, kind: str):
    """Rows (text, doc_id) of Arrow batches to entries: one for each text that differs from all before it in the batch."""
    shift = 64 - (len(slots).bit_length() - 1)
    ddl = f"bucket int, page int, hash long, text binary, ids array<{kind}>, chars long"
    schema = _typed(ddl)

    def run(batches):
        from pyspark import TaskContext

        dealt = TaskContext.get().partitionId()
        for b in batches:
            ids, chains = b.column(1).to_pylist(), {}
            for row, h, text, chars in _entries(b.column(0)):
                chain = chains.setdefault(h, [])
                node = next((x for x in chain if x[0] == text), None)
                if node is None:
                    chain.append(node := (text, []))
                node[1].append((chars, ids[row]))
            out = []
            for h, chain in chains.items():
                at = int(slots[h >> shift]) if shift < 64 else 0
                for text, rows in chain:
                    rows.sort(key=_first)
                    dealt += 1
                    out.append((at, dealt % int(pages[at]), h - (1 << 63), text, [i for _, i in rows], rows[0][0]))
            yield _batch(out, schema)

    return run, ddl


def _first(row):
    """Order of equal texts' rows: most code points, then the smallest doc_id, null last."""
    return -row[0], row[1] is None, 0 if row[1] is None else row[1]


def _chained(batches, keys: list[str]):
    """Runs of rows of equal ``keys``, as chains: [(text, rows)] of texts compared byte by byte. Rows come sorted by the keys."""
    now, chain = None, []
    for b in batches:
        names = b.schema.names
        held = list(zip(*(b.column(names.index(k)).to_pylist() for k in keys), strict=True))
        text = b.column(names.index("text"))
        rest = b.drop_columns(["text"])
        for i, key in enumerate(held):
            if key != now:
                if chain:
                    yield now, chain
                now, chain = key, []
            t = text[i].as_py()
            node = next((x for x in chain if x[0] == t), None)
            if node is None:
                chain.append(node := (t, []))
            node[1].append(rest.slice(i, 1).to_pylist()[0])
    if chain:
        yield now, chain


def _owned(paged: frozenset, kind: str):
    """Owner task: chains the entries of its buckets page by page, and elects a row for every text of a page."""
    ddl = f"bucket int, page int, hash long, node int, ids array<{kind}>, best boolean, best_id {kind}, best_chars long, n long, sha string, text binary"
    schema = _typed(ddl)

    def run(batches):
        out, size = [], 0
        for (bucket, page, h), chain in _chained(batches, ["bucket", "page", "hash"]):
            for number, (text, entries) in enumerate(chain):
                best = min(range(len(entries)), key=lambda i: _first((entries[i]["chars"], entries[i]["ids"][0])))
                low, n, sha = entries[best], sum(len(e["ids"]) for e in entries), hashlib.sha256(text).hexdigest()
                for i, e in enumerate(entries):
                    whole = text if i == best and bucket in paged else None
                    out.append((bucket, page, h, number, e["ids"], i == best, low["ids"][0], low["chars"], n, sha, whole))
                    size += len(whole or b"") + 8 * len(e["ids"])
            if len(out) >= ROWS or size >= BYTES:
                yield _batch(out, schema)
                out, size = [], 0
        yield _batch(out, schema)

    return run, ddl


def _merged(kind: str):
    """Chains the texts of a bucket's pages, so that every page's text learns the row that stays and the size of the group."""

    ddl = f"bucket int, page int, hash long, node int, keep_id {kind}, size long, wins boolean"
    schema = _typed(ddl)

    def run(batches):
        for (bucket, h), chain in _chained(batches, ["bucket", "hash"]):
            for _, found in chain:
                best = min(range(len(found)), key=lambda i: _first((found[i]["best_chars"], found[i]["best_id"])))
                n = sum(f["n"] for f in found)
                yield _batch([(bucket, f["page"], h, f["node"], found[best]["best_id"], n, i == best) for i, f in enumerate(found)], schema)

    return run, ddl


def build(docs: DataFrame, path: str, capacity: int | None = None) -> None:
    """Writes the index of ``docs`` (doc_id, text) under ``path``: ``directory`` (slot, bucket, pages) and ``buckets``.

    The first pass counts rows by key range, from which the directory is doubled until its buckets fit. The second sends
    every batch's distinct texts to the owner of their bucket's page, which chains equal hashes, compares bytes and writes
    entries (document ids, row elected, group size) in key order. Texts are not stored, but for those of paged buckets.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    rows = bounded_batches(docs.select("text", "doc_id"))
    counts = rows.select("text").mapInArrow(_tallied, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    tally = np.zeros(1 << DEPTH, np.int64)
    for r in counts:
        tally[r["slot"]] = r["n"]
    slots, pages = directory(tally, capacity or max(LEAST, int(tally.sum()) // BUCKETS))
    table = [(i, b, int(pages[b])) for i, b in enumerate(slots.tolist())]
    spark.createDataFrame(table, "slot int, bucket int, pages int").write.parquet(f"{path}/directory")
    entries = rows.mapInArrow(*_keyed(slots, pages, kind))
    dealt = entries.repartition("bucket", "page").sortWithinPartitions("bucket", "page", "hash")
    dealt.mapInArrow(*_owned(frozenset(np.flatnonzero(pages > 1).tolist()), kind)).write.parquet(f"{path}/buckets")


def resolved(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of an index."""
    found = spark.read.parquet(f"{path}/buckets")
    pages = spark.read.parquet(f"{path}/directory").where("pages > 1").select("bucket").distinct()
    key = ["bucket", "page", "hash", "node"]
    kind = dict(found.dtypes)["best_id"]
    nodes = found.where("text IS NOT NULL").select(*key, "text", "best_chars", "best_id", "n")
    merged = nodes.repartition("bucket").sortWithinPartitions("bucket", "hash").mapInArrow(*_merged(kind))
    entries = found.drop("text", "best_chars")
    one = entries.join(F.broadcast(pages), "bucket", "left_anti").select("ids", "sha", F.col("best_id").alias("keep_id"), F.col("n").alias("group_size"), "best")
    several = entries.join(F.broadcast(pages), "bucket", "left_semi").join(merged, key)  # a directory has 65,536 slots at most
    both = one.unionByName(several.select("ids", "sha", "keep_id", F.col("size").alias("group_size"), (F.col("best") & F.col("wins")).alias("best")))
    each = both.select(F.posexplode("ids").alias("at", "doc_id"), "keep_id", "group_size", "best", "sha")
    return each.select("doc_id", "keep_id", "group_size", (F.col("best") & (F.col("at") == 0)).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_duplicates(docs: DataFrame, capacity: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs`` (doc_id, text).

    Texts are equal when they are identical without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty. Of equal
    texts the row with the most code points in its original text stays, then the smallest doc_id (null last); of rows that
    are equal in both, one. Repeated rows all come back. An empty table gives no rows; other columns are not looked at.

    A text that fills a third of the table is one entry for each Arrow batch; its entries are dealt over pages of
    ``capacity`` rows, which separate tasks chain, and only their elected rows meet again.
    """
    path = f"{shared_folder(docs.sparkSession)}/exact-{uuid.uuid4().hex}"
    build(docs, path, capacity)
    return resolved(docs.sparkSession, path)
