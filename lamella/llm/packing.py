"""Tokenised documents packed into sequences of fixed length by bin completion."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.graph import bounded_batches, cut
from lamella.llm.tokens import WordHasher, case_fold, separators

CAPACITY = 4096
#: Sequences a group is meant to fill: groups are packed one by one, whole ones in one task each.
GROUP = 256
#: Most words whose ids a task remembers; it forgets all of them beyond that.
REMEMBERED = 1_000_000
#: Marks that are cut off a word's end where a letter or digit stands before them.
MARKS = np.zeros(256, bool)
MARKS[list(b".,!?*$#%&;:)\"'")] = True
#: Steps of the search in one group, and fillings tried for one sequence. They bound time; every piece is always placed.
STEPS, WIDTH = 4000, 6


def tokenizer_text(path: str | None = None) -> str:
    """The tokenizer's file, which the driver reads and sends to the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


class WordIds:
    """Ids of texts, encoded once per distinct word. For tokenizers that drop white space and never join across it.

    Words are told apart by 64-bit hashes, among the few hundred thousand that a task remembers. Letters A-Z count as
    a-z, which the tokenizer folds as well; a text that may hold a special token goes to the tokenizer whole.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(spec)
        self.hasher = WordHasher(separators(), case_fold(), seed=57)
        self.special = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self):
        self.known, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and the entry of each
        self.data, self.offset, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, ``end`` after each, and the offsets of the texts."""
        raw = [t.encode() for t in texts]
        whole = [i for i, t in enumerate(raw) if any(s in t for s in self.special)]
        if whole:
            given, raw = raw, [b"" if i in set(whole) else t for i, t in enumerate(raw)]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in raw], dtype=np.int64)])
        data = b"".join(raw)
        # The tokenizer takes a run of symbols as one piece, so that marks after a letter or digit are pieces of their own.
        starts, ends, h, at = self.hasher(np.frombuffer(data, np.uint8), bounds, MARKS)
        unit = self._entries(data, h, starts, ends)
        size = self.size[unit]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.data[np.repeat(self.offset[unit] - total[:-1], size) + np.arange(total[-1])]
        ids, offsets = np.insert(ids, total[at[1:]], end), total[at] + np.arange(len(texts) + 1)
        if whole:
            parts = np.split(ids, offsets[1:-1])
            for i in whole:
                parts[i] = np.array([*self.model.encode(given[i].decode(), add_special_tokens=False).ids, end], np.uint32)
            ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, offsets

    def _entries(self, data: bytes, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of every unit, after the ids of new ones were added."""
        if len(self.known) > REMEMBERED:
            self.forget()
        place = np.searchsorted(self.known, h)
        old = np.flatnonzero(place < len(self.known))
        old = old[self.known[place[old]] == h[old]]
        out = np.full(len(h), -1)
        out[old] = self.entry[place[old]]
        new = np.flatnonzero(out < 0)
        if len(new):
            fresh, first, which = np.unique(h[new], return_index=True, return_inverse=True)
            first = new[first]
            words = [data[a:z] for a, z in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            ids, size = zip(*(self._ids(words[i : i + 1024]) for i in range(0, len(words), 1024)), strict=True)
            ids, size = np.concatenate(ids), np.concatenate(size)
            entries = len(self.size) + np.arange(len(fresh))
            self.offset = np.concatenate([self.offset, len(self.data) + np.cumsum(size) - size])
            self.size, self.data = np.concatenate([self.size, size]), np.concatenate([self.data, ids])
            spots = np.searchsorted(self.known, fresh)
            self.known, self.entry = np.insert(self.known, spots, fresh), np.insert(self.entry, spots, entries)
            out[new] = entries[which]
        return out

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and how many each has."""
        text = b"\n".join(words).decode()
        heads = np.concatenate([[0], np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1])
        found = self.model.encode(text, add_special_tokens=False)
        owner = np.searchsorted(heads, np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0], "right") - 1
        return np.array(found.ids, np.uint32), np.bincount(owner, minlength=len(words))


def pieces(docs: DataFrame, spec: str, capacity: int = CAPACITY, end: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row, and its ids if asked for.

    A document is its ids followed by ``end``; only longer ones than ``capacity`` are cut, and the last piece may be
    shorter. A null text is empty: one piece of one id. Repeated rows are packed as often as they come.
    """
    # What a worker learned stays with its copy of the broadcast, so that its next task need not learn it again.
    shared = docs.sparkSession.sparkContext.broadcast({"spec": spec})

    def run(batches):
        import pyarrow as pa

        held = shared.value
        words = held["words"] = held.get("words") or WordIds(held["spec"])
        for b in batches:
            texts = b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, n = at, 0
                while to < len(texts) and (to == at or n < 2_000_000):
                    n += len(texts[to] or "")
                    to += 1
                ids, offsets = words.encode([t or "" for t in texts[at:to]], end)
                doc, piece, start, length, crc, out = [], [], [], [], [], []
                for d, a, z in zip(b.column(0).slice(at, to - at).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    for p, s in enumerate(range(a, z, capacity)):
                        part = ids[s : min(s + capacity, z)]
                        doc.append(d)
                        piece.append(p)
                        start.append(s - a)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.astype("<u4").tobytes()))
                        if with_ids:
                            out.append(part)
                columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in out], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                at = to

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each length goes where the least room is left; ``lengths`` come in descending order."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for x in lengths:
        fit = rooms >> x
        if fit:
            room = x + (fit & -fit).bit_length() - 1
            i = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[i].append(x)
        else:
            i, room = len(bins), capacity
            bins.append([x])
        left = room - x
        if not by_room.setdefault(left, []):
            rooms |= 1 << left
        by_room[left].append(i)
    return bins


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Sequences that any packing needs: by total length, and by lengths of which no two fit together."""
    halves = sum(2 * x > capacity for x in lengths)
    return max(-(-sum(lengths) // capacity), halves)


class Pool:
    """Lengths that are still to be placed."""

    def __init__(self, lengths: list[int]):
        self.count: dict[int, int] = {}
        for x in lengths:
            self.count[x] = self.count.get(x, 0) + 1
        self.sizes = sorted(self.count)

    def take(self, items, n: int = -1):
        for x in items:
            was = self.count.get(x, 0)
            self.count[x] = was + n
            if was == 0:
                self.sizes.insert(bisect_left(self.sizes, x), x)
            elif was + n == 0:
                self.sizes.pop(bisect_left(self.sizes, x))

    def above(self, low: int, high: int, used: tuple[int, ...]) -> bool:
        """Is there a length over ``low`` and up to ``high`` besides those in ``used``?"""
        i = bisect_right(self.sizes, low)
        while i < len(self.sizes) and self.sizes[i] <= high:
            if self.count[self.sizes[i]] > used.count(self.sizes[i]):
                return True
            i += 1
        return False


def fillings(pool: Pool, room: int, slack: int) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room`` with at most ``slack`` waste, least waste first, WIDTH of them at most.

    A filling is dominated if some of its items could be swapped for one larger item that still fits.
    """
    found: list[tuple[int, ...]] = []
    budget = 300

    def walk(chosen: tuple[int, ...], left: int):
        nonlocal budget
        budget -= 1
        if left <= slack:
            found.append(chosen)
        if budget < 0 or len(found) >= 4 * WIDTH or (found and found[-1] is chosen and left == 0):
            return
        most = min(left, chosen[-1] if chosen else left)
        for i in range(bisect_right(pool.sizes, most) - 1, -1, -1):
            x = pool.sizes[i]
            if pool.count[x] > chosen.count(x):
                walk((*chosen, x), left - x)
                if budget < 0 or len(found) >= 4 * WIDTH:
                    return

    walk((), room)

    def dominated(f: tuple[int, ...]) -> bool:
        waste = room - sum(f)
        return waste > 0 and any(pool.above(sum(t), sum(t) + waste, f) for n in range(0, min(len(f), 3) + 1) for t in combinations(f, n))

    kept = [f for f in dict.fromkeys(found) if not dominated(f)]
    return sorted(kept, key=lambda f: (room - sum(f), len(f)))[:WIDTH]


def bin_completion(lengths: list[int], capacity: int) -> list[list[int]]:
    """A packing into as few bins as the search finds: never more than best-fit decreasing.

    Branch and bound over fillings around the largest remaining length. A branch ends when the waste so far leaves no
    packing better than the incumbent, and the whole search when the incumbent meets the lower bound.
    """
    lengths = sorted(lengths, reverse=True)
    best = best_fit(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    if len(best) == bound:
        return best
    total = sum(lengths)
    pool, placed, waste, steps = Pool(lengths), [], 0, 0
    stack: list[list] = []
    while True:
        spare = (len(best) - 1) * capacity - total - waste
        if spare >= 0 and not pool.sizes:
            best = [list(b) for b in placed]
            if len(best) == bound:
                return best
            spare = -1
        if spare >= 0:
            largest = pool.sizes[-1]
            pool.take((largest,))
            options = fillings(pool, capacity - largest, min(spare, capacity))
            pool.take((largest,), 1)
            stack.append([[(largest, *f) for f in reversed(options)], None])
        else:
            stack.append([[], None])
        while stack:
            options, applied = stack[-1]
            if applied is not None:
                pool.take(applied, 1)
                placed.pop()
                waste -= capacity - sum(applied)
                stack[-1][1] = None
            if options and steps < STEPS + len(best):
                steps += 1
                chosen = options.pop()
                stack[-1][1] = chosen
                pool.take(chosen)
                placed.append(chosen)
                waste += capacity - sum(chosen)
                break
            stack.pop()
        if not stack:
            return best


def _packed(level: int, capacity: int):
    """Places the pieces of one group. Pieces of sequences that are less than 31/32 full are marked loose."""

    def place(table):
        import pyarrow as pa

        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        lengths = table.column("length").to_pylist()
        group = table.column("group")[0].as_py()
        rows: dict[int, list[int]] = {}
        for i in range(len(lengths) - 1, -1, -1):
            rows.setdefault(lengths[i], []).append(i)
        sequence, offset, loose = [0] * len(lengths), [0] * len(lengths), [False] * len(lengths)
        whole = len(rows.get(capacity, ()))
        bins = [[capacity]] * whole + bin_completion(lengths[whole:], capacity)
        for n, content in enumerate(bins):
            at = 0
            open_ = 32 * sum(content) < 31 * capacity
            for x in content:
                i = rows[x].pop()
                sequence[i], offset[i], loose[i] = (level << 60) + (group << 24) + n, at, open_
                at += x
        names = [c for c in table.column_names if c != "group"]
        return pa.table([*(table.column(c) for c in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(loose)], names=[*names, "sequence_id", "offset", "loose"])

    return place


def _numbered(parts: DataFrame) -> DataFrame:
    """``parts`` with a number ``row`` of its own for each, written down so that it stays whatever is read again."""
    return cut(parts.withColumn("row", F.monotonically_increasing_id()))


def _placed(parts: DataFrame, capacity: int, group: int) -> DataFrame:
    """Numbered pieces with sequence_id and offset.

    Pieces are dealt by their numbers, so that equal ones spread over all groups like any others.
    """
    parts = parts.select("row", "doc_id", "piece", "start", "length", "ids_crc32")
    total = parts.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, -(-total // (capacity * group)))
    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, loose boolean"
    dealt = parts.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    first = cut(dealt.groupBy("group").applyInArrow(_packed(0, capacity), schema))
    again = first.where("loose").drop("sequence_id", "offset", "loose")
    again = again.withColumn("group", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(-(-groups // group))))
    second = again.groupBy("group").applyInArrow(_packed(1, capacity), schema)
    return first.where("NOT loose").unionByName(second).drop("loose")


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Pieces are dealt into groups of about ``group`` sequences and packed group by group; then the pieces of the few
    sequences that stayed open in each group are packed again, in groups of groups.
    """
    return _placed(_numbered(parts.select("doc_id", "piece", "start", "length", "ids_crc32")), capacity, group).drop("row")


def packed_documents(docs: DataFrame, spec: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every row of ``docs`` with their sequence and place in it."""
    return pack(pieces(docs, spec or tokenizer_text(), capacity), capacity)


def sequences(docs: DataFrame, spec: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, doc_ids, ids): the ids of every packed sequence, its documents end to end."""
    parts = _numbered(pieces(docs, spec or tokenizer_text(), capacity, with_ids=True))
    rows = _placed(parts, capacity, GROUP).join(parts.select("row", "ids"), "row").select("doc_id", "sequence_id", "offset", "ids")
    ordered = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return ordered.select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.flatten("p.ids").alias("ids"))
