"""Near-duplicates by shingle similarity against brute force over all pairs."""

from lamella.llm import resemblance
from tests.llm.test_groups import classes


def shingles(text):
    words = [w.lower() for w in (text or "").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def numbered(a, z):
    return " ".join(f"w{i}" for i in range(a, z))


def test_groups_by_brute_force(spark):
    docs = [(r.doc_id, " ".join((r.text or "").split())) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs = [(d, t) for d, t in docs if t.isascii()]
    docs += [(10_000, numbered(0, 104)), (10_001, numbered(10, 114)), (10_002, numbered(20, 124)), (10_003, numbered(60, 164)), (10_004, "a B c"), (10_005, "A b c"), (10_006, ""), (10_007, None)]
    docs += [(11_000 + i, numbered(500, 600) + f" z{i} " + numbered(600, 700)) for i in range(40)]
    sets = [shingles(t) for _, t in docs]
    linked = [(a, b) for a in range(len(docs)) for b in range(a) if similarity(sets[a], sets[b]) >= 0.8]
    low = classes([d for d, _ in docs], linked)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in resemblance.one_of_each(frame).collect())
    assert got == sorted(d for (d, _), c in zip(docs, low, strict=True) if d == c)
    assert {1, 10_000, 10_003, 10_004, 11_000} <= set(got) and not {177, 10_001, 10_002, 10_005, 11_001} & set(got)
    assert resemblance.one_of_each(frame.limit(0)).collect() == []


def test_pipeline_stage_reaches_near_copies_far_in_bits(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id IN (1, 177, 2)")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 2]  # 1 and 177: similarity 0.83, 9 bits apart


def test_crowds_in_tasks_of_bounded_size(spark, monkeypatch):
    """Sets that share keys but lie at 0.7 to 0.85 of each other, with blocks of a few sets: the same groups as by brute force."""
    import random

    monkeypatch.setattr(resemblance, "BLOCK", 1500)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(150):
        t = list(words)
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(120)] = f"z{i}x{rng.randrange(99)}"
        docs.append((i, " ".join(t)))
    sets = [shingles(t) for _, t in docs]
    linked = [(a, b) for a in range(len(docs)) for b in range(a) if similarity(sets[a], sets[b]) >= 0.8]
    low = classes([d for d, _ in docs], linked)
    got = sorted(r.doc_id for r in resemblance.one_of_each(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect())
    assert got == sorted(d for (d, _), c in zip(docs, low, strict=True) if d == c) and len(got) > 3
