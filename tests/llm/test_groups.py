"""SimHash, vector and chat operators against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from lamella.llm import chat, graph, simhash, vectors
from lamella.llm.graph import connected_components

ODD = [(-1, None), (-2, ""), (-3, " \t"), (-4, "a"), (-5, "A"), (-6, "x " * 30_000), (-6, "x " * 30_000), (None, "a b c"), (7_000_001, "tie tie tie tie")]


def classes(ids, linked):
    """Smallest id reachable, by repeated minimum over linked pairs."""
    low = dict(zip(range(len(ids)), ids, strict=True))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return [low[i] for i in range(len(ids))]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)] + [(2000, i) for i in range(2001, 2300)]
    frame = spark.createDataFrame(edges + [(None, 1)] + edges[:5], "u long, v long")
    got = {r.node: r.component for r in connected_components(frame).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {n: i for i, n in enumerate(nodes)}
    assert got == dict(zip(nodes, classes(nodes, [(at[a], at[b]) for a, b in edges if a != b]), strict=True))
    assert connected_components(frame.limit(0)).collect() == []


def brute_print(t):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(500_000 + i, t + " tail") for i, t in docs[:60] if len(t) > 2000] + ODD
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component").repartition(3)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame).collect()), key=str)
    prints = [brute_print(t) for _, t in docs]
    ids = [10**9 if d is None else d for d, _ in docs]
    linked = [(a, b) for a in range(len(docs)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    low = classes(ids, linked)
    expected = [(d, f"{f:016x}", None if c == 10**9 else c) for (d, _), f, c in zip(docs, prints, low, strict=True)]
    assert got == sorted(expected, key=str)
    assert simhash.near_duplicates(frame.limit(0)).collect() == []


def test_simhash_links_of_crowded_buckets(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 8, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (8, 150, 3), dtype=np.uint64), axis=2)
    fp = np.unique(base[:, None] ^ flips)
    frame = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    near = np.argwhere(np.bitwise_count(fp[:, None] ^ fp[None]) <= 4)
    want = classes(fp.view(np.int64).tolist(), near.tolist())
    for chunk in (4096, 50):
        got = {r.node: r.component for r in connected_components(simhash.links(frame, chunk=chunk)).collect()}
        assert [got.get(x, x) for x in fp.view(np.int64).tolist()] == want


def test_codes_lose_no_pair():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 48))
    y = x + rng.normal(size=x.shape) * rng.uniform(0, 0.4, (300, 1))
    v = np.concatenate([x, y])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rotated, codes, factor = vectors.encode(v, vectors.rotation(48))
    may, true = vectors.candidates(rotated, codes, factor, 0.98), v @ v.T >= 0.98
    assert not (true & ~may).any() and true.sum() > 700 and may.mean() < 0.02


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    rows = []
    for i in range(600):
        v = base[rng.integers(0, 40)] + rng.normal(size=16) * rng.uniform(0, 0.15)
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(0, 3)) if i % 50 else None))
    rows += [(1000 + i, rows[7][1], rows[7][2]) for i in range(20)] + [(7, rows[7][1], rows[7][2])]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, [None] * 16, 1), (2005, [float("inf")] * 16, 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (None, rows[8][1], rows[8][2])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node", "1 AS low").repartition(3)
    ids = [10**9 if r[0] is None else r[0] for r in rows]

    def good(r):
        return r[2] is not None and r[1] and all(c is not None and np.isfinite(c) for c in r[1]) and any(r[1])

    linked = []
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a], rows[b]
            if good(x) and good(y) and x[2] == y[2] and len(x[1]) == len(y[1]):
                p, q = np.array(x[1]), np.array(y[1])
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.98:
                    linked.append((a, b))
    n = np.bincount(np.array(linked).ravel(), minlength=len(rows))
    want = sorted(((r[0], int(k), None if c == 10**9 else c) for r, k, c in zip(rows, n, classes(ids, linked), strict=True)), key=str)
    for chunk in (2048, 30):
        got = sorted(((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(frame, chunk=chunk).collect()), key=str)
        assert got == want
    assert vectors.near_duplicates(frame.limit(0)).collect() == []


def test_chat(spark, monkeypatch):
    rng = random.Random(3)
    talks = {}
    for i in range(120):
        old = rng.choice(list(talks.values())) if talks and rng.random() < 0.7 else []
        talks[i] = old[: rng.randint(0, len(old))] + [(rng.choice(["user", None, " Assistant "]), rng.choice(["a", "b", None, "", "<|im_end|>"])) for _ in range(rng.randint(0, 7))]
    talks[500], talks[501] = [("user", "z")] * 40, [("user", "z")] * 41
    rows = [(c, t * 2 - 1 if c % 2 else t, r, x) for c, turns in talks.items() for t, (r, x) in enumerate(turns)]
    frame = spark.createDataFrame(rows + rows[:9] + [(None, 1, "user", "x")], "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS run", "2 AS position").repartition(3)
    lists = {c: tuple(t) for c, t in talks.items() if t}
    keep = {c for c, t in lists.items() if not any(o != c and u[: len(t)] == t and (len(u) > len(t) or o < c) for o, u in lists.items())}
    show = lambda r, x: "<|im_start|>" + (r or "unknown").strip().lower() + "\n" + (x or "").replace("<|", "< |") + "<|im_end|>\n"
    for run in (256, 3):
        monkeypatch.setattr(chat, "RUN", run)
        got = {r.conv_id: (r.n_turns, r.rendered) for r in chat.format_conversations(frame).collect()}
        assert got == {c: (len(lists[c]), "".join(show(*t) for t in lists[c])) for c in keep}
    assert chat.format_turns(frame.limit(0)).collect() == []


def test_lists_of_batches_never_end_inside_a_key():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    keys = np.sort(np.concatenate([rng.integers(-20, 20, 300), np.full(500, 3)]))
    cuts = np.sort(rng.integers(0, len(keys), 40))
    batches = [pa.RecordBatch.from_arrays([pa.array(k), pa.array(k * 2)], ["key", "x"]) for k in np.split(keys, cuts)]
    lists = [np.concatenate([b.column(0).to_numpy() for b in part]) for part in graph.whole_keys(batches, 0, 400)]
    assert np.array_equal(np.concatenate(lists), keys) and len(lists) > 3
    assert all(16 * len(x) > 400 for x in lists[:-1])
    assert all(a[-1] < b[0] for a, b in zip(lists, lists[1:], strict=False))
    assert list(graph.whole_keys(iter(()))) == []
