"""Exact duplicates against a plain dictionary of whole texts."""

import hashlib
import random
import re

import numpy as np
import pytest

from lamella.llm import exact


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for n, own in groups.items():
        own.sort(key=lambda r: r[:3])
        out += [(i, own[0][3], len(own), k == 0, hashlib.sha256(n.encode()).hexdigest()) for k, (*_, i) in enumerate(own)]
    return out


@pytest.mark.parametrize("capacity", [None, 3])
def test_groups(spark, capacity):
    rng = random.Random(1)
    base = ["".join(rng.choice("abc \té　😀\n") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(base)] + [(1000 + i, " " + base[i] + "\x0b") for i in range(0, 300, 3)]
    rows += [(2000 + i, "the hot text") for i in range(250)] + [(2500, "the  hot text ")] * 2 + [(i, None) for i in range(3000, 3040)] + [(3100, ""), (3101, " \t\n"), (None, "null id"), (None, "null id"), (7, "null id ")]
    rows += [(4000, "x " * 200_000), (4001, "x" * 200_000), (4002, "x "), (4003, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bucket", "'p' AS page", "2 AS hash").repartition(5)
    got = exact.exact_duplicates(frame, capacity)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(rows), key=str)


def test_empty_and_names(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert exact.exact_duplicates(frame).collect() == []
    named = spark.createDataFrame([("b", "x"), ("a", "x "), ("c", "x ")], "doc_id string, text string")
    for capacity in (None, 1):
        assert sorted(map(tuple, exact.exact_duplicates(named, capacity).select("doc_id", "keep_id", "group_size", "kept").collect())) == [("a", "a", 3, True), ("b", "a", 3, False), ("c", "a", 3, False)]


def test_equal_hashes_are_compared_by_bytes(spark, monkeypatch):
    """Texts that share a hash are chained and told apart."""
    rows = [(0, "aa"), (1, "ab"), (2, "a a"), (3, "ac"), (4, "ab")]
    import pyarrow as pa

    table = pa.record_batch({"bucket": [0] * 5, "page": [0] * 5, "hash": [9] * 5, "text": [t.replace(" ", "").encode() for _, t in rows], "ids": [[i] for i, _ in rows], "chars": [len(t) for _, t in rows]})
    run, _ = exact._owned(frozenset(), "bigint")
    got = {i: (r["node"], r["best_id"], r["n"]) for b in run([table.slice(0, 2), table.slice(2)]) for r in b.to_pylist() for i in r["ids"]}
    assert got == {0: (0, 2, 2), 2: (0, 2, 2), 1: (1, 1, 2), 4: (1, 1, 2), 3: (2, 3, 1)}


def test_directory_doubles():
    tally = np.zeros(16, np.int64)
    tally[3], tally[4], tally[5], tally[12] = 40, 5, 5, 2
    slots, pages = exact.directory(tally, 10)
    assert len(slots) == 16 and len(set(slots.tolist())) == len(pages)
    full = {b: int(tally[slots == b].sum()) for b in set(slots.tolist())}
    assert max(n for b, n in full.items() if b != slots[3]) <= 10 and pages[slots[3]] == 4 and sum(pages > 1) == 1
    assert slots[4] == slots[5] and (np.diff(np.flatnonzero(slots == slots[12])) == 1).all()
    assert [x.tolist() for x in exact.directory(np.zeros(16, np.int64), 10)] == [[0], [1]]
