"""Packing: ids by the tokenizer itself, places by their rules, and the search against exhaustive packings."""

import random
import time
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np

from lamella.llm import packing


def test_ids_and_places(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(-1, None), (-2, ""), (-2, ""), (-3, "<|endoftext|>x a<|startoftext|> B's don't 12 ab³ H̱ ẖ ΣΑΣ.  q ́x\x1cy"), (-4, "A " * 4095), (-5, "A " * 4096), (None, "word!!! ...")]
    expected = {}
    for d, t in docs:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            expected[d, p] = (s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS piece", "2 AS length").repartition(3)
    got = packing.packed_documents(frame).collect()
    assert Counter((r.doc_id, r.piece) for r in got) == Counter(list(expected)) + Counter([(-2, 0)])
    assert all(expected[r.doc_id, r.piece] == (r.start, r.length, r.ids_crc32) for r in got)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for rows in places.values():
        rows.sort()
        assert [o for o, _ in rows] == [sum(n for _, n in rows[:i]) for i in range(len(rows))] and sum(n for _, n in rows) <= 4096
    assert len(places) <= -(-sum(r.length for r in got) // 4096) + 1
    whole = packing.sequences(frame.where("doc_id < -2")).collect()
    assert sorted(x for r in whole for x in r.ids) == sorted(x for d, t in docs if d is not None and d < -2 for x in [*model.encode(t, add_special_tokens=False).ids, 1])


def test_empty_table(spark):
    assert packing.packed_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_rows_spread_over_groups(spark):
    piece = spark.range(100_000).selectExpr("7L AS doc_id", "0 AS piece", "0L AS start", "1000L AS length", "5L AS ids_crc32")
    start = time.time()
    rows = packing.pack(piece).groupBy("sequence_id").agg({"offset": "max", "*": "count"}).collect()
    assert time.time() - start < 60
    # Every group numbers its own sequences: the group is in the bits above.
    assert len({r.sequence_id >> 24 for r in rows}) > 50
    assert sum(r["count(1)"] for r in rows) == 100_000 and len(rows) == 25_000
    assert all(r["max(offset)"] == 1000 * (r["count(1)"] - 1) for r in rows)


def least_bins(items, capacity):
    @cache
    def go(rest, rooms):
        if not rest:
            return 0
        x, rest = rest[0], rest[1:]
        options = [1 + go(rest, tuple(sorted((*rooms, capacity - x))))]
        for room in set(rooms):
            if room >= x:
                left = list(rooms)
                left.remove(room)
                options.append(go(rest, tuple(sorted((*left, room - x)))))
        return min(options)

    return go(tuple(sorted(items, reverse=True)), ())


def test_search_is_valid_and_close_to_exact():
    rng = random.Random(1)
    better = worse = 0
    for _ in range(120):
        items = [rng.randint(8, 60) for _ in range(rng.randint(1, 11))]
        bins = packing.bin_completion(items, 100)
        assert Counter(x for b in bins for x in b) == Counter(items) and all(sum(b) <= 100 for b in bins)
        exact, greedy = least_bins(items, 100), len(packing.best_fit(sorted(items, reverse=True), 100))
        better += len(bins) < greedy
        worse += len(bins) > exact
    assert better > 0 and worse == 0
