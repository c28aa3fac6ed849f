"""Vectorised word splitting and hashing, used inside Arrow tasks.

All functions work on one flat byte buffer that holds many texts, so that no Python code runs per word.
"""

from __future__ import annotations

import numpy as np

#: Words end at these bytes: space and 0x09-0x0D.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])


#: ASCII letters and digits.
SOLID = np.zeros(256, bool)
SOLID[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def separators(kept=None, blanks: bytes = BLANKS) -> np.ndarray:
    """Boolean table over bytes: True where a byte ends a word. ``kept``: predicate of bytes inside words instead."""
    table = np.zeros(256, bool)
    if kept is None:
        table[list(blanks)] = True
    else:
        table[[b for b in range(256) if not kept(b)]] = True
    return table


def case_fold() -> np.ndarray:
    """Byte table that lower-cases A-Z only."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def random_words(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every bit of the input reaches every bit of the output."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """64-bit hash of every word of a batch of texts; equal words have equal hashes in every task and run."""

    def __init__(self, sep: np.ndarray, fold: np.ndarray | None = None, seed: int = 7):
        self.sep, self.table = sep, random_words(256, seed)
        if fold is not None:
            self.table = self.table[fold]
        self.base = int(random_words(1, seed + 1)[0]) | 1
        self.powers = np.ones(1, np.uint64)

    def _upto(self, n: int) -> np.ndarray:
        while len(self.powers) < n:
            step = np.uint64(pow(self.base, len(self.powers), 2**64))
            self.powers = np.concatenate([self.powers, self.powers * step])
        return self.powers

    def __call__(self, buf: np.ndarray, bounds: np.ndarray, marks: np.ndarray | None = None):
        """``buf``: bytes of texts in a row; ``bounds``: n+1 offsets of the texts.

        Returns word starts, word ends (byte offsets), hashes, and n+1 offsets of the texts' words. ``marks``: table of
        bytes that form a word of their own at the end of one, where an ASCII letter or digit stands before them.
        """
        inside = ~self.sep[buf]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = bounds[:-1][(bounds[:-1] > 0) & (bounds[:-1] < len(buf))]
        first[cuts] = inside[cuts]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[cuts - 1] = inside[cuts - 1]
        if marks is not None:
            head, at = np.flatnonzero(first), np.flatnonzero(last)
            go = marks[buf[at]]
            while go.any():  # once per mark of the longest run
                head, at = head[go], at[go] - 1
                on = at >= head
                head, at = head[on], at[on]
                go = marks[buf[at]]
                stop = at[~go & SOLID[buf[at]]]
                last[stop] = first[stop + 1] = True
        starts = np.flatnonzero(first)
        ends = np.flatnonzero(last) + 1
        if not len(starts):
            return starts, ends, np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
        size = ends - starts
        at = np.flatnonzero(inside)
        heads = np.cumsum(size) - size
        offset = np.arange(len(at)) - np.repeat(heads, size)
        powers = self._upto(int(size.max()))
        h = np.add.reduceat(self.table[buf[at]] * powers[offset], heads)
        return starts, ends, mix(h + size.astype(np.uint64)), np.searchsorted(starts, bounds)


def grams(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of every run of k consecutive items: len(h)-k+1 values, by doubling."""
    base = int(random_words(1, seed)[0]) | 1
    out, have, power, width = None, 0, h, 1
    rest = k
    while rest:
        if rest & 1:
            if out is None:
                out, have = power, width
            else:
                n = len(h) - have - width + 1
                if n <= 0:
                    return np.zeros(0, np.uint64)
                out = out[:n] * np.uint64(pow(base, width, 2**64)) + power[have : have + n]
                have += width
        rest >>= 1
        if rest:
            n = len(power) - width
            if n <= 0:
                return np.zeros(0, np.uint64)
            power = power[:n] * np.uint64(pow(base, width, 2**64)) + power[width:]
            width *= 2
    return mix(out)


def sliding(op, x: np.ndarray, w: int) -> np.ndarray:
    """op (np.minimum or np.maximum) over every run of w values: len(x)-w+1 values."""
    width, out = 1, x
    while width * 2 <= w:
        if len(out) <= width:
            return out[:0]
        out = op(out[:-width], out[width:])
        width *= 2
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    return op(out[:n], out[w - width : w - width + n])


def text_batches(texts, most: int = 1_000_000):
    """Arrow string array -> (first row, buffer, bounds) over runs of rows of about ``most`` bytes; nulls are empty.

    A text is never cut: one that is longer than ``most`` comes alone.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to
