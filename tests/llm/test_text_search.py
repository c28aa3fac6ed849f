"""Decontamination and repeated windows against brute force."""

import random
import re
from collections import Counter

import pytest

from lamella.llm import decontam, substrings

HOSTILE = [(900001, None), (900002, ""), (900003, " \t\n"), (900004, "x"), (900005, "É" * 5000), (900006, "a b c d " * 40), (900006, "a b c d " * 40), (900007, "one two three\x00four")]
SCHEMA = "doc_id long, text string"


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(5)
    words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(300)]
    rows += [(910000 + i, " ".join(words[rng.randint(0, 100) : rng.randint(120, 300)])) for i in range(30)]
    return rows + HOSTILE


def brute_hits(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    windows = {}
    for i, t in items:
        w = split(t)
        if w and i is not None:
            n = min(window, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


@pytest.mark.parametrize("most_bits", [decontam.FILTER_BITS, 64])
def test_contamination(spark, docs, most_bits):
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    items += [(70, "A"), (71, "one two"), (72, None), (73, ""), (None, "x"), (74, docs[-9][1]), (75, "the of the of the of the of the of the of"), (75, "é"), (76, "a b c d a b c d a b c d a b c d")]
    bench = spark.createDataFrame(items + items[:3], "item_id long, text string")
    got = decontam.contamination(spark.createDataFrame(docs, SCHEMA), bench, most_bits=most_bits).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == brute_hits(docs, items)


def test_contamination_of_empty_tables(spark):
    some = spark.createDataFrame([(1, "a b")], SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontam.contamination(some, none).collect()] == [(1, 2, 0, [])]
    assert decontam.contamination(some.limit(0), none).collect() == []
    assert decontam.uncontaminated(some, none).collect() == some.collect()


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_uncontaminated_keeps_every_other_row(spark, docs, monkeypatch, broadcast):
    """Rows without a hit stay, nulls and repeated rows among them, whatever other columns are called."""
    monkeypatch.setattr(decontam, "BROADCAST_TEXTS", broadcast)
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    clean = {d for d, _, n, _ in brute_hits(docs, items) if not n}
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3).selectExpr("*", "1 AS key", "2 AS found", "3 AS n", "4 AS row")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 AS doc_id", "6 AS value")
    got = decontam.uncontaminated(frame, bench)
    assert got.columns == frame.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((d, t) for d, t in docs if d in clean)
    assert 0 < len(clean) < len({d for d, _ in docs})


def test_contamination_with_clashing_columns(spark, docs):
    frame = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 AS row", "2 AS no", "3 AS item_id", "4 AS items")
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string").selectExpr("*", "5 AS doc_id", "6 AS value")
    got = decontam.contamination(frame, bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == brute_hits(docs, [(1, "one two")])


def test_contamination_of_very_long_and_repeated_texts(spark):
    """A text of one repeated word, and 2,000 equal rows that hold an item of one word and a passage of many items."""
    passage = " ".join(f"w{i}" for i in range(40))
    items = [(1, "the"), (2, "The " * 12)] + [(10 + i, f"{passage} end{i}") for i in range(50)]
    rows = [(1, "the " * 300_000)] + [(2, f"so the {passage} was")] * 2000
    bench, frame = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontam.contamination(frame, bench).collect())
    many = tuple(sorted(["1", *[str(10 + i) for i in range(50)]]))
    assert got == Counter({(1, 300_000, 300_000, ("1", "2")): 1, (2, 43, 41, many): 2000})
    assert decontam.uncontaminated(frame, bench).collect() == []


@pytest.mark.parametrize("window", [35, 9])
def test_repeated_windows(spark, docs, window):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    count = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    expected = []
    for d, w in split:
        gone = {k + j for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1 for j in range(window)}
        expected.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3).selectExpr("*", "1 AS bucket", "2 AS rid", "3 AS h1", "true AS copied")
    got = substrings.without_repeats(frame, window).collect()
    assert sum(e[2] for e in expected) > 100
    assert Counter(map(tuple, got)) == Counter(expected)


def test_repeated_windows_of_many_small_buckets(spark, docs, monkeypatch):
    frame = spark.createDataFrame(docs, SCHEMA)
    expected = Counter(map(tuple, substrings.without_repeats(frame, 7).collect()))
    monkeypatch.setattr(substrings, "BUCKET", 500)
    monkeypatch.setattr(substrings, "MOST_PARTITIONS", 3)
    buckets = substrings.repeated_windows(substrings._copied(substrings._identified(frame)), 7, 900, 20)
    assert buckets.rdd.getNumPartitions() == 3 and buckets.select("bucket").distinct().count() > 100
    assert Counter(map(tuple, substrings.without_repeats(frame, 7).collect())) == expected


def test_repeated_windows_of_an_empty_table(spark):
    assert substrings.without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_repeated_rows_take_time_in_proportion(spark):
    """4,000 equal rows of 400 words, one of another id with the same text, and a very long text of one repeated word."""
    import time

    text = " ".join(f"w{i}" for i in range(400))
    rows = [(1, text)] * 4000 + [(2, text + " end"), (3, "x " * 200_000), (4, text[:80]), (4, text[:80])]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    frame.count()
    start = time.time()
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.without_repeats(frame).collect())
    assert got == Counter({(1, 400, 400, ""): 4000, (2, 401, 400, "end"): 1, (3, 200_000, 200_000, ""): 1, (4, len(text[:80].split()), 0, text[:80]): 2})
    assert time.time() - start < 60
