"""Toxicity: character n-gram embeddings averaged over a text, under a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm import drawn
from lamella.llm.graph import bounded_batches
from lamella.llm.tokens import grams, random_words, text_batches

#: n-grams of 3 to 5 bytes, hashed to this many embeddings.
SIZES, BUCKETS = (3, 4, 5), 1 << 18
#: Most labelled rows and bytes of text that training reads (on average: rows are drawn by a hash of their id).
ROWS, BYTES = 4000, 12_000_000
#: A small sample is read more often than EPOCHS times, until there were about STEPS steps.
DIM, EPOCHS, STEPS, BATCH, RATE, SCALE = 4, 6, 200, 64, 0.3, 100.0


def _letters() -> np.ndarray:
    """Byte table: letters and all bytes beyond ASCII keep a value, everything else is one separator."""
    table = random_words(256, 61)
    keep = np.zeros(256, bool)
    keep[97:123] = keep[65:91] = keep[128:] = True
    table[65:91] = table[97:123]
    table[~keep] = table[32]
    return table


LETTERS = _letters()
SEPARATOR = LETTERS[32]


def ngrams(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts' words, and the text of each, in no order.

    An n-gram lies in one word, or holds one separator before or after it (the text's ends count as separators).
    """
    n = len(bounds) - 1
    h = np.full(len(buf) + 2 * n, SEPARATOR)
    shift = np.repeat(2 * np.arange(n) + 1, np.diff(bounds))
    h[np.arange(len(buf)) + shift] = LETTERS[buf]
    ends = bounds[1:] + 2 * np.arange(1, n + 1)
    owner = np.repeat(np.arange(n), np.diff(np.concatenate([[0], ends])))
    inner = h != SEPARATOR
    solid = np.concatenate([[0], np.cumsum(inner)])
    ids, texts = [], []
    for size in SIZES:
        g = grams(h, size, 41)
        at = np.arange(len(g))
        ok = (solid[at + size - 1] - solid[at + 1] == size - 2) & (owner[at] == owner[at + size - 1])
        ids.append((g[ok] >> np.uint64(64 - 18)).astype(np.int32))
        texts.append(owner[: len(g)][ok])
    return np.concatenate(ids), np.concatenate(texts)


@dataclass
class Model:
    weight: np.ndarray  # of each n-gram: its embedding times the difference of the two output rows
    bias: float

    def scores(self, texts) -> np.ndarray:
        """Probability of label 1 for an Arrow array of texts; a null counts as empty."""
        import pyarrow.compute as pc

        out = []
        for _, buf, bounds in text_batches(pc.utf8_lower(texts), 1_000_000):
            ids, owner = ngrams(buf, bounds)
            n = len(bounds) - 1
            total = np.bincount(owner, self.weight[ids], n)
            mean = total / np.maximum(np.bincount(owner, minlength=n), 1)
            out.append(1 / (1 + np.exp(-np.clip(SCALE * mean + self.bias, -50, 50))))
        return np.concatenate(out) if out else np.zeros(0)


def fit(texts: list[str], labels: list[int], prior: float | None = None, seed: int = 0) -> Model:
    """Trains embeddings and softmax by AdaGrad on the cross-entropy of whole texts.

    ``prior``: share of label 1 where the sample was drawn, if the sample has another one.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    y = np.array(labels, np.int64)
    if len(np.unique(y)) < 2:  # nothing to tell apart: the share of label 1, smoothed
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    bags, size = [], []
    for t in texts:
        for _, buf, bounds in text_batches(pc.utf8_lower(pa.array([t], pa.string()))):
            ids, count = np.unique(ngrams(buf, bounds)[0], return_counts=True)
            bags.append((ids, (SCALE * count / max(1, count.sum())).astype(np.float32)))
            size.append(len(ids))
    rng = np.random.default_rng(seed)
    table = np.zeros((BUCKETS, DIM), np.float32)
    out = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
    seen_table, seen_out, seen_bias = np.full(BUCKETS, 1e-6, np.float32), np.full_like(out, 1e-6), np.full_like(bias, 1e-6)
    epochs = max(EPOCHS, min(40, STEPS * BATCH // len(y)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            ids = np.concatenate([bags[r][0] for r in rows])
            w = np.concatenate([bags[r][1] for r in rows])
            doc = np.repeat(np.arange(len(rows)), [size[r] for r in rows])
            e = table[ids] * w[:, None]
            v = np.stack([np.bincount(doc, e[:, d], len(rows)) for d in range(DIM)], 1)
            z = v @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            g_out, g_bias, g_v = v.T @ p / len(rows), p.mean(0), p @ out.T / len(rows)
            g = np.stack([np.bincount(ids, w * g_v[doc, d], BUCKETS) for d in range(DIM)], 1).astype(np.float32)
            seen_table += (g**2).mean(1)
            table -= rate * g / np.sqrt(seen_table)[:, None]
            seen_out += g_out**2
            out -= (rate * 0.1 * g_out / np.sqrt(seen_out)).astype(np.float32)
            seen_bias += g_bias**2
            bias -= (rate * 0.1 * g_bias / np.sqrt(seen_bias)).astype(np.float32)
    drawn = y.mean()
    shift = 0.0 if prior is None else np.log(prior / (1 - prior)) - np.log(drawn / (1 - drawn))
    return Model(table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0] + shift))


def train(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = ROWS, size: int = BYTES) -> Model:
    """Fits a model on rows of ``docs`` (doc_id, text) that ``learn`` admits and ``labels`` (doc_id, toxic) marks.

    The sample is drawn by a hash of doc_id, from each label at a rate at which half of ``rows`` and of ``size`` bytes
    are expected at most; the labels' true shares are put back into the bias. Null labels and rows of null doc_id are
    left out; a row that is marked twice counts twice.
    """
    marks = labels.where("toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = docs.where(learn).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = known.select("doc_id", F.octet_length("text").cast("long").alias("size")).join(marks, "doc_id")
    found = {y: (n, total) for y, n, total in sizes.groupBy("toxic").agg(F.count("*"), F.sum("size")).collect()}
    chosen = F.lit(False)
    for y, (n, total) in found.items():
        chosen = chosen | ((F.col("toxic") == y) & drawn.admitted("doc_id", "toxicity", drawn.share(2 * n, 2 * total, rows, size)))
    # Marks of documents that exist, about ``rows`` of them; they go to the texts, which stay where they are.
    admitted = sizes.where(chosen).select("doc_id", "toxic")
    sample = known.join(F.broadcast(admitted), "doc_id")
    few = sorted((r.doc_id, r.text, r.toxic) for r in sample.collect())
    prior = found[1][0] / (found[0][0] + found[1][0]) if len(found) == 2 else None
    return fit([t for _, t, _ in few], [y for *_, y in few], prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of ``docs``: the probability that label 1 fits its whole text.

    Null and empty texts have no n-gram: they score as the bias alone says. Rows come back as often as they come.
    """
    # Arrays and numbers, as workers unpickle a broadcast by reference and may not have this package.
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))

    def run(batches):
        import pyarrow as pa

        model = Model(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1)))], ["doc_id", "score"])

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, score double")
