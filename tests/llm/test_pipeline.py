"""The pipeline's stages by brute force on a small table."""

import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_groups import classes
from tests.llm.test_pii import brute
from tests.llm.test_resemblance import shingles, similarity
from tests.llm.test_text_search import brute_hits

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = docs.schema
    extra = [(900001, None, None, None, None), (900002, "12 34", "en", "s", 5), (900003, "", "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, schema))
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, SF)
        got = [r.asDict() for r in out.collect()]
        texts = {r["doc_id"]: r["text"] for r in rows}
        ids = [r["doc_id"] for r in got]
        if name != "packing":
            assert out.columns == docs.columns
        if name == "language":
            assert not {900001, 900002, 900003} & set(ids) and len(ids) > 0.97 * (len(rows) - 3)
        elif name == "near_duplicates":
            keys = sorted(texts)
            sets = [shingles(" ".join(re.split("[ \t-\r]+", texts[k] or ""))) for k in keys]
            linked = [(a, b) for a in range(len(keys)) for b in range(a) if similarity(sets[a], sets[b]) >= 0.8]
            assert sorted(ids) == [k for k, c in zip(keys, classes(keys, linked), strict=True) if k == c] and len(ids) < len(rows)
        elif name == "decontamination":
            assert sorted(ids) == sorted(r[0] for r in brute_hits(list(texts.items()), bench) if r[2] == 0) and len(ids) < len(rows)
        elif name == "personal_data":
            assert sorted(ids) == sorted(texts)
            for r in got:
                assert r["n_chars"] == len(r["text"])
                if not brute(texts[r["doc_id"]]) and "<" not in r["text"]:
                    assert r["text"] == texts[r["doc_id"]]
                assert not brute(r["text"])
            assert any(re.search("<EMAIL>", r["text"]) for r in got)
        else:
            model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            size = Counter()
            for r in got:
                size[r["doc_id"]] += r["length"]
            assert size == Counter({d: len(model.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items()})
        if name != "packing":
            docs = spark.createDataFrame([tuple(r[c] for c in schema.names) for r in got], schema)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []
