"""Personal data against Python's regular expressions."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lamella.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10 == 0
    return kind != "phone" or 10 <= len(d) <= 15


def brute(text):
    out = [(m.start(), r, m.end(), k) for r, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if passes(k, m[0])]
    return sorted(out)


def test_base_spans(spark):
    rng = random.Random(3)
    alphabet = ["1", "22", "255", "256", ".", ".", "+", "@", "a", "Zé", "-", " ", "(", "_", "4111111111111111", "4111 1111 1111 1111", "\x01", "\x02", "\n", "\U0001f600"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(1500)]
    texts += [None, "", "a@b.c_d@e.f", "a@b.c..d@e.f", "x@y z@w.q", "9" * 8_000, "a" * 8_000 + "@", "a@" + "b." * 8_000, "1." * 8_000, "+1" + " " * 8_000, "1 " * 8_000]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("entities", F.lit("clash"))
    got = {r.doc_id: [(s.start, s.rank, s.end, s.kind) for s in r.entities if s.kind in pii.BASE] for r in pii.find(docs).collect()}
    assert sum(map(len, got.values())) > 500
    for i, t in enumerate(texts):
        assert got[i] == brute(t), (t or "")[:200]


def test_added_kinds_and_redaction(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 ok"), (2, "DE88370400440532013000"), (3, "call 0171 2345678 now"), (4, "0171 2345678"), (5, None), (5, "mail a@b.cc, +49 171 2345678"), (6, "é 1.2.3.4 é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r.doc_id, s.kind, s.match, s.score) for r in pii.find(docs).collect() for s in r.entities)
    assert found == Counter([(1, "iban", "DE89 3704 0044 0532 0130 00", 1.0), (3, "tel", "0171 2345678", 0.4), (5, "email", "a@b.cc", 1.0), (5, "phone", "+49 171 2345678", 0.7), (6, "ip", "1.2.3.4", 0.6)])
    texts = sorted(map(tuple, pii.redact(docs).collect()), key=str)
    assert texts == sorted([(1, "IBAN <IBAN> ok"), (2, rows[1][1]), (3, "call <TEL> now"), (4, rows[3][1]), (5, None), (5, "mail <EMAIL>, <PHONE>"), (6, "é <IP> é")], key=str)


def test_empty_table(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_texts_take_time_in_proportion(spark):
    """100,000 matches in one text are found and replaced; so are addresses at every part's edge."""
    import time

    numbers = "1.2.3.4 é " * 100_000
    edges = "".join("x" * (4096 * i - 4 - 13 * (i - 1) - 4083 * (i - 1)) + "a@b.cc, é 1.1.1.1"[:13] for i in range(1, 2)) + "é" * 5000 + " a@b.cc" * 3000
    docs = spark.createDataFrame([(1, numbers), (2, edges)], "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: [(s.start, s.rank, s.end, s.kind) for s in r.entities if s.kind in pii.BASE] for r in pii.find(docs).collect()}
    assert got[1] == brute(numbers) and got[2] == brute(edges)
    texts = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert texts[1] == "<IP> é " * 100_000 and texts[2].count("<EMAIL>") == 3001 and "@" not in texts[2]
    assert time.time() - start < 120
