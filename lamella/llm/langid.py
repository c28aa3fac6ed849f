"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from lamella.llm import drawn
from lamella.llm.graph import bounded_batches

#: A text is read as one stream of letters and single blanks, in rows of CORE bytes with MARGIN bytes of what stands
#: before and after them; label probabilities are taken from the core, where both directions have seen some context.
CORE, MARGIN = 112, 8
WIDTH = CORE + 2 * MARGIN
EMBED, HIDDEN = 8, 8
#: Most texts of a language that training draws, and bytes of them (on average, by a hash of doc_id); they are read whole.
TEXTS, BYTES = 300, 130_000
#: A small sample is read more often than EPOCHS times, until there were about STEPS steps.
EPOCHS, STEPS, BATCH, RATE = 2, 120, 64, 0.02
#: Rows that a task runs through the network at once.
ROWS = 512
#: What is no letter of any script, but for numerals that are no decimal digits.
OTHER = re.compile(r"[\W\d_]+")
#: Those: fractions, superscripts, Roman and circled numbers.
NUMERALS = frozenset(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_BLANKED = dict.fromkeys(map(ord, NUMERALS), " ")


def stream(text: str | None) -> bytes:
    """The letters of a text in lower case, in UTF-8; everything else is one blank."""
    letters = OTHER.sub(" ", (text or "").lower())
    if not letters.isascii() and not NUMERALS.isdisjoint(letters):
        letters = " ".join(letters.translate(_BLANKED).split())
    return letters.strip().encode("utf-8", "surrogatepass")


def rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(byte matrix, text of each row): every text in rows of WIDTH bytes, blanks before its start and after its end."""
    n = np.array([-(-len(t) // CORE) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), n)
    padded = [b" " * MARGIN + t + b" " * (-len(t) % CORE + MARGIN) for t in texts if t]
    flat = np.frombuffer(b"".join(padded), np.uint8)
    start = np.repeat(np.cumsum(np.array([len(t) for t in padded], np.int64)) - np.array([len(t) for t in padded], np.int64), n[n > 0])
    start += CORE * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
    return flat[start[:, None] + np.arange(WIDTH)], owner


def letters(x: np.ndarray) -> np.ndarray:
    """Boolean (row, CORE): the core positions that hold a letter's byte."""
    return x[:, MARGIN : MARGIN + CORE] != 32


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def start(labels: int, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(0, 0.5, (256, EMBED))}
    for d in "fb":
        p[f"in_{d}"] = rng.normal(0, EMBED**-0.5, (EMBED, 3 * HIDDEN))
        p[f"rec_{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN))
        p[f"bias_{d}"] = np.zeros(3 * HIDDEN)
    p["out"] = rng.normal(0, (2 * HIDDEN) ** -0.5, (2 * HIDDEN, labels))
    p["bias"] = np.zeros(labels)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _run(p: dict, d: str, x: np.ndarray, keep: bool):
    """States (time, row, HIDDEN) of one direction, and what backpropagation needs."""
    table = p["embed"] @ p[f"in_{d}"] + p[f"bias_{d}"]
    rec, n = p[f"rec_{d}"], HIDDEN
    h = np.zeros((len(x), n), table.dtype)
    x = np.ascontiguousarray(x.T)
    states, tape = np.empty((*x.shape, n), table.dtype), []
    for t in range(len(x)):
        a, u = table[x[t]], h @ rec
        g = _sigmoid(a[:, : 2 * n] + u[:, : 2 * n])
        z, r = g[:, :n], g[:, n:]
        c = np.tanh(a[:, 2 * n :] + r * u[:, 2 * n :])
        if keep:
            tape.append((h, z, r, c, u[:, 2 * n :]))
        h = c + z * (h - c)
        states[t] = h
    return states, tape


def _back(p: dict, d: str, x: np.ndarray, tape: list, grad: np.ndarray, out: dict):
    """Backpropagation through time; adds the gradients of one direction to ``out``."""
    rec, n = p[f"rec_{d}"], HIDDEN
    dh = np.zeros((len(x), n), np.float32)
    d_in = np.empty((*x.shape, 3 * n), np.float32)
    d_rec = np.zeros_like(rec)
    for t in range(x.shape[1] - 1, -1, -1):
        h, z, r, c, u = tape[t]
        dh = dh + grad[:, t]
        dc = dh * (1 - z) * (1 - c**2)
        dz = dh * (h - c) * z * (1 - z)
        dr = dc * u * r * (1 - r)
        du = np.concatenate([dz, dr, dc * r], 1)
        d_in[:, t] = np.concatenate([dz, dr, dc], 1)
        d_rec += h.T @ du
        dh = dh * z + du @ rec.T
    flat = d_in.reshape(-1, 3 * n)
    by_byte = np.stack([np.bincount(x.ravel(), flat[:, j], 256) for j in range(3 * n)], 1).astype(np.float32)
    out["embed"] += by_byte @ p[f"in_{d}"].T
    out[f"in_{d}"] += p["embed"].T @ by_byte
    out[f"bias_{d}"] += flat.sum(0)
    out[f"rec_{d}"] += d_rec


def positions(p: dict, x: np.ndarray, keep: bool = False):
    """Label probabilities (row, CORE, label) of the core positions, and the state of the run."""
    forward, tape_f = _run(p, "f", x, keep)
    backward, tape_b = _run(p, "b", x[:, ::-1], keep)
    core = slice(MARGIN, MARGIN + CORE)
    h = np.concatenate([forward[core], backward[::-1][core]], 2).transpose(1, 0, 2)
    z = h @ p["out"] + p["bias"]
    e = np.exp(z - z.max(2, keepdims=True))
    return e / e.sum(2, keepdims=True), (h, tape_f, tape_b)


def gradients(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over all letter positions of rows with labels y, and its gradients."""
    prob, (h, tape_f, tape_b) = positions(p, x, keep=True)
    letter = letters(x).astype(np.float32)
    total = letter.sum()
    at = np.arange(len(x))
    loss = -(np.log(prob[at, :, y] + 1e-12) * letter).sum() / total
    d = prob.copy()
    d[at, :, y] -= 1
    d *= (letter / total)[:, :, None]
    out = {k: np.zeros_like(v) for k, v in p.items()}
    out["out"] = np.einsum("rth,rtl->hl", h, d, optimize=True)
    out["bias"] = d.sum((0, 1))
    dh = np.zeros((*x.shape, 2 * HIDDEN), np.float32)
    dh[:, MARGIN : MARGIN + CORE] = d @ p["out"].T
    _back(p, "f", x, tape_f, dh[:, :, :HIDDEN], out)
    _back(p, "b", x[:, ::-1], tape_b, dh[:, ::-1, HIDDEN:], out)
    return float(loss), out


def _states(p: dict, d: str, x: np.ndarray) -> np.ndarray:
    """States (time, HIDDEN, row) of one direction over bytes (time, row), as _run gives them; nothing is kept."""
    n = HIDDEN
    turned = np.repeat(np.float32([-1, -1, -2]), n)  # sigmoids are 1 / (1 + exp(-x)), tanh x is 2 sigmoid(2x) - 1
    table = ((p["embed"] @ p[f"in_{d}"] + p[f"bias_{d}"]) * turned).astype(np.float32)
    rec = np.ascontiguousarray((p[f"rec_{d}"] * turned).T)
    out = np.empty((len(x), n, x.shape[1]), np.float32)
    h = np.zeros((n, x.shape[1]), np.float32)
    for t in range(len(x)):
        a, u = np.ascontiguousarray(table.take(x[t], 0).T), rec @ h
        g, c = a[: 2 * n], a[2 * n :]
        g += u[: 2 * n]
        np.exp(np.minimum(g, 80, g), g)
        g += 1
        np.divide(1, g, g)
        c += np.multiply(u[2 * n :], g[n:], u[2 * n :])
        np.exp(np.minimum(c, 80, c), c)
        c += 1
        np.divide(2, c, c)
        c -= 1
        h = np.subtract(h, c, out[t])
        h *= g[:n]
        h += c
    return out


def _sums(p: dict, x: np.ndarray) -> np.ndarray:
    """(row, label): label probabilities of the core positions, as ``positions`` gives them, summed over letters."""
    x = np.ascontiguousarray(x.T)
    core = slice(MARGIN, MARGIN + CORE)
    w = np.ascontiguousarray(p["out"].T)
    z = w[:, :HIDDEN] @ _states(p, "f", x)[core]
    z += w[:, HIDDEN:] @ _states(p, "b", x[::-1])[::-1][core]
    z += p["bias"][:, None]
    z -= z.max(1, keepdims=True)
    np.exp(z, z)
    z *= ((x[core] != 32) / z.sum(1)).astype(np.float32)[:, None]
    return z.sum(0, dtype=np.float64).T


@dataclass
class Model:
    labels: list[str]
    weights: dict[str, np.ndarray]

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """For each stream: position probabilities summed over its letters, and in the last column their number."""
        out = np.zeros((len(texts), len(self.labels) + 1))
        x, owner = rows(texts)
        for at in range(0, len(x), ROWS):
            part = x[at : at + ROWS]
            np.add.at(out, (owner[at : at + ROWS], slice(None, -1)), _sums(self.weights, part))
            np.add.at(out[:, -1], owner[at : at + ROWS], letters(part).sum(1))
        return out

    def label_positions(self, text: str) -> tuple[bytes, list[str]]:
        """The stream of a text and the likeliest label of each of its bytes."""
        t = stream(text)
        best = positions(self.weights, rows([t])[0])[0].argmax(2).ravel()[: len(t)]
        return t, [self.labels[b] for b in best]


def fit(samples: list[tuple[str, bytes]], seed: int = 0) -> Model:
    """Trains on (label, stream) pairs with Adam; every letter's position should show its text's label."""
    labels = sorted({lang for lang, _ in samples})
    rng = np.random.default_rng(seed)
    p = start(len(labels), seed)
    x, owner = rows([t for _, t in samples])
    y = np.array([labels.index(lang) for lang, _ in samples], np.int64)[owner]
    if len(labels) < 2 or not len(x):
        return Model(labels, p)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    epochs = max(EPOCHS, min(40, STEPS * BATCH // len(x)))
    batches = [b for _ in range(epochs) for b in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH))]
    for step, chosen in enumerate(batches, 1):
        _, g = gradients(p, x[chosen], y[chosen])
        rate = RATE * (1 - step / (len(batches) + 1))
        for k in p:
            first[k] += 0.1 * (g[k] - first[k])
            second[k] += 0.01 * (g[k] ** 2 - second[k])
            p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(labels, p)


def train(docs: DataFrame, learn: Column, texts: int = TEXTS, size: int = BYTES) -> Model:
    """Fits a model on rows of ``docs`` (doc_id, text, lang) that ``learn`` admits and that have text and language.

    At most ``texts`` rows and ``size`` bytes a language are expected to be drawn, by a hash of doc_id; a drawn text is
    read whole.
    """
    known = docs.where(learn).where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    found = known.groupBy("lang").agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).collect()
    chosen = F.lit(False)
    for lang, n, total in found:
        chosen = chosen | ((F.col("lang") == lang) & drawn.admitted("doc_id", "language", drawn.share(n, total, texts, size)))
    return fit(sorted((r.lang, stream(r.text)) for r in known.where(chosen).collect()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, n_positions) of every row of ``docs`` from its whole text; see ``labelled``."""
    return labelled(docs.select("doc_id", "text"), model).drop("text")


#: What ``labelled`` adds.
COLUMNS = ("lang_pred", "score", "n_positions")


def labelled(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """``docs`` with all its columns, and lang_pred, score and n_positions of its text.

    Every letter position of the text has label probabilities; a document's are their mean. ``und`` with score 0: the
    text is null or has no letter, or the model knows no language.
    """
    # Names and arrays, as workers unpickle a broadcast by reference and may not have this package.
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights))
    names, text_at = [f"{prefix}{n}" for n in COLUMNS], docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        model = Model(*shared.value)
        for b in batches:
            pred, score, n = [], [], []
            texts, at = b.column(text_at).to_pylist(), 0
            while at < len(texts):
                to, size, held = at, 0, []
                while to < len(texts) and (to == at or size < 1_000_000):
                    held.append(stream(texts[to]))
                    size += len(held[-1])
                    to += 1
                at = to
                for total in model.sums(held) if len(model.labels) else np.zeros((len(held), 1)):
                    known = total[-1] > 0
                    k = int(total[:-1].argmax()) if known else -1
                    pred.append(model.labels[k] if known else "und")
                    score.append(min(1.0, float(total[k] / total[-1])) if known else 0.0)
                    n.append(int(total[-1]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64())], [*b.schema.names, *names])

    return bounded_batches(docs).mapInArrow(run, StructType([*docs.schema, StructField(names[0], StringType()), StructField(names[1], DoubleType()), StructField(names[2], LongType())]))
