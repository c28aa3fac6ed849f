"""Near-duplicate groups by the verified Jaccard similarity of word shingles: fingerprints first, shared keys for the rest.

Fingerprints of five-word shingles that lie within a few bits are found by the pivot tables of ``simhash``. Documents of
similarity 0.8 lie ten bits apart on average and up to 20, where every pivot coordinate of unrelated ones agrees as well
and no table discards anything; such pairs are found by shared keys of least hashes. Every pair is verified in whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.graph import bounded_batches, connected_components, cut, unused
from lamella.llm.simhash import links as near_prints
from lamella.llm.simhash import majority
from lamella.llm.tokens import WordHasher, case_fold, grams, mix, random_words, separators, text_batches

#: Words of a shingle, and the least similarity of a pair as a fraction.
WORDS, LEAST = 5, (4, 5)
#: Keys of a document and least hashes a key holds. A pair of similarity s shares no key with probability
#: (1 - s^4)^24: 0.000003 at 0.8, less above.
KEYS, ROWS = 24, 4
FACTORS, TERMS = random_words(KEYS * ROWS, 21) | np.uint64(1), random_words(KEYS * ROWS, 22)
#: Shingles of the sets that one task compares, for each of two sides.
BLOCK = 1 << 20
#: Most bits of the set of documents whose shingles are compared; a fuller set only lets more documents through.
MOST_BITS = 29


def shingle_sets(batch_texts, words: int = WORDS):
    """The sorted distinct shingle hashes of every text of an Arrow string array, one by one.

    Bytes A-Z are lower-cased, words end at 0x20 and 0x09-0x0D, a text of fewer words is one shingle, and one without
    any word (or null) has none.
    """
    hasher = WordHasher(separators(), case_fold())
    for _, buf, bounds in text_batches(batch_texts):
        _, _, h, at = hasher(buf, bounds)
        for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield np.unique(grams(h[a:z], min(words, z - a), 5)) if z > a else h[:0]


def set_id(found: np.ndarray, salt: int = 0x5851F42D4C957F2D) -> int:
    """Signed 64-bit identity of a set of hashes."""
    return int(mix(mix(found ^ np.uint64(salt)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(found))).view(np.int64)[0])


#: A second identity, by which sets of equal ``set_id`` that differ are told apart.
CHECK = 0x14057B7EF767814F


def band_keys(found: np.ndarray) -> np.ndarray:
    """Signed keys of a set: each hashes its number and the least values of the set under ROWS further hashes."""
    least = np.full(KEYS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(found), 1024):
        least = np.minimum(least, (found[at : at + 1024, None] * FACTORS + TERMS).min(0))
    out = np.arange(1, KEYS + 1, dtype=np.uint64)
    for column in least.reshape(KEYS, ROWS).T:
        out = mix(out ^ column)
    return out.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, row, set, other, n, fp, keys) of every row: its identity by doc_id and text, and its shingle set with two
    identities, its size, fingerprint and keys."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, others, sizes, prints, keys = [], [], [], [], []
            for found in shingle_sets(b.column(2)):
                ids.append(set_id(found))
                others.append(set_id(found, CHECK))
                sizes.append(len(found))
                prints.append(majority(found))
                keys.append(band_keys(found))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * KEYS, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), lists], ["doc_id", "row", "set", "other", "n", "fp", "keys"])

    rows = docs.select("doc_id", row_identity().alias("row"), "text")
    return bounded_batches(rows).mapInArrow(run, "doc_id long, row binary, set long, other long, n long, fp long, keys array<long>")


def row_identity():
    """128-bit hash of doc_id and text, nulls apart from all values."""
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    return F.unhex(F.md5(F.concat(number, F.when(F.col("text").isNull(), ".").otherwise(F.concat(F.lit(":"), "text")))))


def compared_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set, shingles) of the ``wanted`` sets, shingled again. A broadcast set of bits keeps most other sets from moving."""
    bits = min(MOST_BITS, max(15, (16 * wanted.count()).bit_length()))
    mask = (1 << bits) - 1
    spot = F.col("set").bitwiseAND(F.lit(mask)) + 1
    filled = wanted.groupBy(F.bitmap_bucket_number(spot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("m"))
    marks = np.zeros(1 << (bits - 3), np.uint8)
    for r in filled.collect():
        marks[4096 * (r["b"] - 1) : 4096 * r["b"]] = np.frombuffer(r["m"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches):
        import pyarrow as pa

        held, seen = shared.value, set()
        for b in batches:
            ids, others, sets = [], [], []
            for found in shingle_sets(b.column(0)):
                i = set_id(found)
                at = i & mask
                if held[at >> 3] >> (at & 7) & 1 and (i, other := set_id(found, CHECK)) not in seen:
                    seen.add((i, other))
                    ids.append(i)
                    others.append(other)
                    sets.append(found.view(np.int64))
            if ids:
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64()), lists], ["set", "other", "shingles"])

    found = bounded_batches(docs.select("text")).mapInArrow(run, "set long, other long, shingles array<long>")
    return found.join(wanted, "set", "left_semi").groupBy("set").agg(F.min_by("shingles", "other").alias("shingles"))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of sets whose Jaccard similarity is LEAST or more, compared in whole."""
    part, whole = LEAST
    left = sets.select(F.col("set").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("set").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(left, "u").join(right, "v").where((part + whole) * both >= part * (F.size("a") + F.size("b"))).select("u", "v")


def links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified pairs (u, v) that connect all similar pairs among ``sets`` (set, n, fp, keys) that share a key.

    First sets of near fingerprints are compared, and the members of a key with one of them; then the components that
    this left beside each other under a key are compared in tasks of bounded size. A crowd of near copies costs few
    comparisons, no pair is passed over, and no group's pairs are ever written down.
    """
    keyed = cut(sets.select("set", "n", F.explode("keys").alias("key")))
    # The member met first changes with the key, so that one unlucky choice does not part a crowd.
    shared = keyed.groupBy("key").agg(F.count("*").alias("count"), F.min_by("set", F.xxhash64("set", F.pmod("key", F.lit(4)))).alias("first")).where("count > 1")
    members = cut(keyed.join(shared.select("key", "first"), "key"))
    close = cut(_close(sets))
    asked = members.select("set").unionByName(close.select(F.col("u").alias("set"))).unionByName(close.select(F.col("v").alias("set")))
    whole_sets = cut(compared_sets(docs, asked.distinct()))
    ends = F.greatest("set", "first").alias("u"), F.least("set", "first").alias("v")
    met = cut(members.where(F.col("set") != F.col("first")).select(*ends).unionByName(close).distinct())
    found = cut(similar(met, whole_sets))
    comp = connected_components(found)
    placed = members.join(comp.withColumnRenamed("node", "set"), "set", "left").select("key", "set", "n", F.coalesce("component", "set").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum("n").alias("size")).where("low <> high")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = cut(placed.join(mixed.select("key", parts.alias("parts")), "key"))
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("set"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    meet = dealt.select(pair.alias("pair"), "set", "component", (F.col("part") > F.col("other")).alias("side")).join(whole_sets, "set")
    return found.unionByName(meet.groupBy("pair").applyInArrow(_joined, "u long, v long"))


def _joined(table):
    """Similar pairs (u, v) that join the components of one group of sets, or of its two sides.

    All sets outside the largest component are compared with the sets of all other components, as far as their sizes
    allow the similarity; components merge as pairs are found, so that no more pairs than components come out.
    """
    import pyarrow as pa

    part, whole = LEAST
    ids, side = table.column("set").to_numpy(), table.column("side").to_numpy()
    lists = table.column("shingles").combine_chunks()
    flat, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    starts = np.cumsum(size) - size
    _, group, count = np.unique(table.column("component").to_numpy(), return_inverse=True, return_counts=True)
    root, largest = np.arange(len(count)), count.argmax()
    u, v = [], []
    for i in np.flatnonzero(group != largest).tolist():
        mine = root[group[i]]
        if mine == root[largest]:
            continue
        open_ = (root[group] != mine) & (whole * np.minimum(size, size[i]) >= part * np.maximum(size, size[i]))
        if side.any():
            open_ &= side != side[i]
        if not open_.any():
            continue
        own = np.sort(flat[starts[i] : starts[i] + size[i]])
        place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = np.add.reduceat(own[place] == flat, starts, dtype=np.int64)
        for j in np.flatnonzero(open_ & ((part + whole) * both >= part * (size + size[i]))).tolist():
            if root[group[j]] != root[group[i]]:
                root[root == root[group[j]]] = root[group[i]]
                u.append(max(ids[i], ids[j]))
                v.append(min(ids[i], ids[j]))
    return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _close(sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets that connect those of equal fingerprints, and of fingerprints within four bits."""
    first = cut(sets.groupBy("fp").agg(F.min("set").alias("first")))
    same = sets.join(first, "fp").where("set <> first").select(F.col("set").alias("u"), F.col("first").alias("v"))
    far = near_prints(first.select("fp"))
    a, b = first.select(F.col("fp").alias("u"), F.col("first").alias("a")), first.select(F.col("fp").alias("v"), F.col("first").alias("b"))
    far = far.join(a, "u").join(b, "v").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return same.unionByName(far).distinct()


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, of one document of each near-duplicate group: that of the least doc_id.

    Documents of equal shingle sets are one group, and so are groups joined by a pair of similarity 0.8 or more. A row
    without doc_id is kept only where its group has none with; of rows equal in doc_id and text one stays. Null texts
    and those without words are one group. Identities have 128 bits: of sets that only share the 64 bits of ``set``, one
    is compared with others and the rest form groups of their own.
    """
    rows = cut(signatures(docs))
    least = F.min_by(F.struct("n", "fp", "keys"), "other").alias("s")
    comp = connected_components(links(docs, rows.groupBy("set").agg(least).select("set", "s.*")))
    return _least(docs, rows, comp)


def _least(docs: DataFrame, rows: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of ``docs`` that come first in their group, by the components (node, component) of sets."""
    known = rows.groupBy("set").agg(F.min("other").alias("own")).join(comp.withColumnRenamed("node", "set"), "set", "left")
    apart = F.when(F.col("other") != F.col("own"), F.col("other"))
    placed = rows.join(known, "set").select("doc_id", "row", F.coalesce("component", "set").alias("component"), apart.alias("apart"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = placed.groupBy("component", "apart").agg(F.min(order).alias("k")).select(F.col("k.row").alias("row"))
    kept = cut(first.join(rows.groupBy("row").count(), "row"))
    at = unused(docs.columns, "_row")
    named = docs.withColumn(at, row_identity())
    single = named.join(kept.where("count = 1").select(F.col("row").alias(at)), at, "left_semi")
    several = named.join(kept.where("count > 1").select(F.col("row").alias(at)), at, "left_semi").dropDuplicates([at])
    return single.unionByName(several).drop(at)
