"""Benchmark decontamination by winnowing: fingerprints of both sides meet in a join and are extended there."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.graph import bounded_batches, cut
from lamella.llm.tokens import WordHasher, case_fold, grams, separators, sliding, text_batches

#: Most bits of the filter that spares documents' fingerprints the join; a full filter only lets more of them through.
FILTER_BITS = 1 << 27
#: Hashes of contaminated texts are broadcast up to this number (16 bytes each), beyond it they are joined by shuffle.
BROADCAST_TEXTS = 500_000

#: Positions whose words around are laid out at once.
BLOCK = 100_000

_FOUND = "array<struct<n: long, value: long, around: array<long>, at: array<long>>>"


def _hasher() -> WordHasher:
    word = lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80
    return WordHasher(separators(word), case_fold(), seed=23)


def winnowed(h: np.ndarray, ends: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are the minimum of some run of window-k+1 grams of one text.

    ``ends``: for every word, where its text ends. Two texts that share ``window`` words select the same gram there.
    """
    w = window - k + 1
    g = grams(h, k, 5)
    low = sliding(np.minimum, g, w)
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = np.where(np.arange(len(low)) + window <= ends[: len(low)], low, np.uint64(0))
    pad = np.zeros(w - 1, np.uint64)
    high = sliding(np.maximum, np.concatenate([pad, low, pad]), w)
    at = np.flatnonzero((high == g) & (high > 0))
    return at, g[at]


def fingerprints(h, offsets, window: int, k: int, sizes, passes=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (text, n, value, words around) by text, how often each occurs, and its positions in its text, row by row.

    Equal rows are one within ``BLOCK`` positions, so that a text of one repeated word stays small.

    n = 0: a winnowed gram; around it stand window-k words on either side, nearest first, 0 beyond the text. A window
    shared by two texts holds a gram that both select, and lies within the words around it: nothing else is needed to
    extend the hit over that window. n > 0: a run of n words, for n in ``sizes``, with these words themselves; where
    ``passes`` is None, only whole texts of n words. ``passes``: predicate over values.
    """
    size = np.diff(offsets)
    owner = np.repeat(np.arange(len(size)), size)
    first, ends = np.repeat(offsets[:-1], size), np.repeat(offsets[1:], size)
    side, width = window - k, max(2 * (window - k), window - 1)
    grow = np.concatenate([-1 - np.arange(side), k + np.arange(side)])
    rows, counts, places = [np.zeros((0, 3 + width), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in [0, *sizes]:
        if n == 0:
            at, value = winnowed(h, ends, window, k)
        else:
            g = grams(h, n, 5)
            at = offsets[:-1][size == n] if passes is None else np.flatnonzero(np.arange(len(g)) + n <= ends[: len(g)])
            value = g[at]
        if passes is not None:
            some = passes(value)
            at, value = at[some], value[some]
        for s in range(0, len(at), BLOCK):
            a, v = at[s : s + BLOCK], value[s : s + BLOCK]
            m = np.zeros((len(a), 3 + width), np.int64)
            m[:, 0], m[:, 1], m[:, 2] = owner[a], n, v.view(np.int64)
            near = a[:, None] + (grow if n == 0 else np.arange(n))
            inside = (near >= first[a][:, None]) & (near < ends[a][:, None])
            m[:, 3 : 3 + near.shape[1]] = np.where(inside, h[np.clip(near, 0, len(h) - 1)].view(np.int64), 0)
            row, which, count = np.unique(m, axis=0, return_inverse=True, return_counts=True)
            rows.append(row)
            counts.append(count)
            places.append((a - first[a])[np.argsort(which.ravel(), kind="stable")])
    row, count, place = np.concatenate(rows), np.concatenate(counts), np.concatenate(places)
    order = np.argsort(row[:, 0], kind="stable")
    start = np.cumsum(count) - count
    row, count, start = row[order], count[order], start[order]
    return row, count, place[np.repeat(start - np.cumsum(count) + count, count) + np.arange(len(place))]


def _printer(window: int, k: int, sizes, bits=None):
    """Arrow task: the columns before the text, the text's number of words, and its fingerprints."""

    def run(batches):
        import pyarrow as pa

        hasher = _hasher()
        if bits is None:
            passes = None
        else:
            table = bits.value
            low, six = np.uint64(64 * len(table) - 1), np.uint64(6)
            passes = lambda v: (table[(v & low) >> six] >> (v & np.uint64(63))) & np.uint64(1) > 0
        for b in batches:
            for start, buf, bounds in text_batches(b.column(b.num_columns - 1)):
                _, _, h, offsets = hasher(buf, bounds)
                n = len(offsets) - 1
                row, count, place = fingerprints(h, offsets, window, k, sizes, passes)
                width = row.shape[1] - 3
                lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
                around = lists(np.arange(len(row) + 1) * width, pa.array(row[:, 3:].ravel()))
                at = lists(np.concatenate([[0], np.cumsum(count)]), pa.array(place))
                found = pa.StructArray.from_arrays([pa.array(row[:, 1]), pa.array(row[:, 2]), around, at], ["n", "value", "around", "at"])
                found = lists(np.searchsorted(row[:, 0], np.arange(n + 1)), found)
                before = [b.column(i).slice(start, n) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*before, pa.array(np.diff(offsets)), found], names=[*b.schema.names[:-1], "n_words", "found"])

    return run


def _benchmark(benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """(item_id, n, value, around) of all items, each once."""
    items = bounded_batches(benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text"))
    found = items.mapInArrow(_printer(window, k, range(1, window)), f"item_id string, n_words long, found {_FOUND}")
    return cut(found.select("item_id", F.inline("found")).select("item_id", "n", "value", "around").distinct())


def _prints(texts: DataFrame, keys: str, marks: DataFrame, window: int, k: int, most_bits: int) -> DataFrame:
    """``texts`` (keys and text) with n_words and those fingerprints that may be among ``marks``."""
    sizes = sorted(r.n for r in marks.where("n > 0").select("n").distinct().collect())
    count = marks.select("value").distinct().count()
    bits = min(most_bits, 1 << max(6, (16 * count).bit_length()))
    place = F.col("value").bitwiseAND(bits - 1)
    filled = marks.select(F.shiftright(place, 6).alias("slot"), F.expr("shiftleft(1L, cast(value & 63 AS int))").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[filled["slot"].to_numpy()] = filled["bit"].to_numpy().view(np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast(table)
    return bounded_batches(texts).mapInArrow(_printer(window, k, sizes, shared), f"{keys}, n_words long, found {_FOUND}")


def _reach(start: int, side: int) -> Column:
    """How many of ``side`` words from ``start`` on agree one after another."""
    agree = lambda i: (F.col("c.around")[i] == F.col("b.around")[i]) & (F.col("c.around")[i] != 0)
    out = F.lit(side)
    for i in reversed(range(side)):
        out = F.when(~agree(start + i), i).otherwise(out)
    return out


def _agree(window: int, k: int) -> Column:
    """Same fingerprint (c: of a document, b: of an item) inside a window that agrees word by word."""
    side = window - k
    gram = (F.col("c.n") == 0) & (_reach(0, side) + _reach(side, side) >= side)
    return (F.col("c.value") == F.col("b.value")) & (F.col("c.n") == F.col("b.n")) & (gram | ((F.col("c.n") > 0) & (F.col("c.around") == F.col("b.around"))))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, most_bits: int = FILTER_BITS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (array of item ids as strings, sorted).

    A word is hit if it lies inside an occurrence of ``window`` consecutive words of one item, or of a whole item of
    fewer words. Null texts have no words; items of null id or without words match nothing; repeated items count once.
    Rows are told apart by a number of their own, so that repeated rows and null ids each get their result.
    """
    side = window - k
    marks = _benchmark(benchmark, window, k)
    rows = cut(_prints(docs.select("doc_id", "text"), "doc_id long", marks, window, k, most_bits).withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", F.posexplode("found").alias("no", "f")).select("row", "no", "f.*")
    met = each.alias("c").join(marks.alias("b"), _agree(window, k))
    gram = F.col("c.n") == 0
    back, ahead = F.when(gram, _reach(0, side)).otherwise(0), F.when(gram, _reach(side, side) + k).otherwise(F.col("c.n"))
    met = met.select("row", "no", "item_id", "at", back.alias("back"), ahead.alias("ahead"))
    grown = met.groupBy("row", "no").agg(F.first("at").alias("at"), F.max("back").alias("back"), F.max("ahead").alias("ahead"), F.collect_set("item_id").alias("items"))
    spans = F.transform("at", lambda p: F.struct((p - F.col("back")).alias("a"), (p + F.col("ahead")).alias("b")))
    hits = grown.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), _covered(F.flatten(F.collect_list(spans))).alias("n_hit"))
    out = rows.select("row", "doc_id", "n_words").join(hits, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, most_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no word is hit; see ``contamination``. Null texts stay."""
    marks = _benchmark(benchmark, window, k)
    key = F.unhex(F.md5("text"))
    found = _prints(docs.select(key.alias("key"), "text"), "key binary", marks, window, k, most_bits)
    each = found.select("key", F.inline("found"))
    hit = cut(each.alias("c").join(marks.select("n", "value", "around").distinct().alias("b"), _agree(window, k), "left_semi").select("key").distinct())
    if hit.count() <= BROADCAST_TEXTS:
        hit = F.broadcast(hit)
    return docs.join(hit, F.unhex(F.md5(docs["text"])) == hit["key"], "left_anti")


def _covered(spans: Column) -> Column:
    """Number of integers in an array of ranges (a, b)."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(s["end"], r["a"]))).alias("n"), F.greatest(s["end"], r["b"]).alias("end"))
    return F.aggregate(F.array_sort(spans), start, step)["n"]
