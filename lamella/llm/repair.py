"""Repair of conversation structure by a parallel Viterbi search over chunks of turns."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.exact import _batch, _typed
from lamella.llm.graph import bounded_batches
from lamella.session import shared_folder

#: Distinct rows, or bytes of text, of a chunk at most (a text is never cut).
ROWS, BYTES = 1024, 4 << 20
#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the roles so far: none, after s, after u, after a. A finished conversation is in the first or the last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after one more u or a, whichever the state asks for, and the role of it.
NEXT, ROLE = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")
#: Costs of finishing from every state after the last row, by inserted turns alone.
END = (0, 2 * INSERT, INSERT, 0)
BLANKS = " \t\n\x0b\f\r"
_KINDS = {"s": 1, "u": 2, "a": 3}


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies): rows after damage, for tests of the repair; nulls read as one space.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it next to
    itself, 4 makes it a user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    out = conversations.select(named("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(hit == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(hit == 3, 2).otherwise(1).alias("copies"), hit.alias("_hit"))
    return out.where("_hit <> 0").drop("_hit")


def named(conv_id: str) -> Column:
    """Text that tells conversations apart, null from all others."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def faulty(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, m, again, blank, cut): distinct rows with their number, and what is wrong with the first of each.

    ``again``: role and text were seen in an earlier turn. All copies but the first are repeats, whatever the first is.
    """
    h = [F.xxhash64("role", "text"), F.xxhash64(F.lit("second"), "role", "text")]
    each = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("m")).withColumn("h1", h[0]).withColumn("h2", h[1])
    first = each.groupBy("conv", "h1", "h2").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    tail = F.rtrim("text", F.lit(BLANKS))
    out = each.join(first, ["conv", "h1", "h2"])
    return out.select("conv", "turn", "role", "text", "m", (~F.col("first.turn").eqNullSafe(F.col("turn"))).alias("again"), (tail == "").alias("blank"), (~F.substring(tail, -1, 1).isin(".", "!", "?")).alias("cut"))


def _kind(role: str, cut: bool, gone: bool) -> int:
    """A row in one number: 16 must go; else the initial of its role (0 for any other letter), 4 more if it is truncated."""
    return 16 if gone else _KINDS.get(role[:1], 0) + 4 * cut


class Costs:
    """Backward costs of one row: vectors of the cost from each state, less their minimum, looked up once computed."""

    def __init__(self):
        self.seen, self.moves = {}, {}

    def before(self, after: tuple, kind: int) -> tuple[tuple, int]:
        """(vector before a row, what was taken off it) from the vector after it."""
        if (found := self.seen.get((after, kind))) is None:
            if kind == 16:
                raw = [DELETE + w for w in after]
            else:
                initial, extra = kind & 3, TRUNCATED * (kind >> 2)
                raw = [min(DELETE + after[q], REROLE + extra + after[NEXT[q]], extra + after[k] if (k := _kept(q, initial)) is not None else 99) for q in range(4)]
                u, a = raw[USER], raw[ASSISTANT]
                raw[USER], raw[ASSISTANT] = min(u, INSERT + a), min(a, INSERT + u)
                raw[START], raw[SYSTEM] = min(raw[START], INSERT + raw[USER]), min(raw[SYSTEM], INSERT + raw[USER])
            low = min(raw)
            found = self.seen[after, kind] = tuple(w - low for w in raw), low
        return found

    def edits(self, after: tuple, kind: int, state: int) -> tuple[str, int]:
        """(least edits up to and with a row, state after it) among the cheapest ones."""
        key = after, kind, state
        if (found := self.moves.get(key)) is None:
            vector, low = self.before(after, kind)
            initial, extra, done = kind & 3, TRUNCATED * (kind >> 2), ""
            while True:
                rest = vector[state] + low
                if DELETE + after[state] == rest:
                    found = done + "D", state
                elif INSERT + vector[NEXT[state]] + low == rest:
                    done, state = done + "I", NEXT[state]
                    continue
                elif (k := _kept(state, initial)) is not None and extra + after[k] == rest:
                    found = done + "K", k
                else:
                    found = done + "R", NEXT[state]
                break
            self.moves[key] = found
        return found


def _kept(state: int, initial: int) -> int | None:
    """State after a kept row, None where its role does not fit."""
    if initial == 1:
        return SYSTEM if state == START else None
    if initial == 2:
        return USER if state != USER else None
    return ASSISTANT if initial == 3 and state == USER else None


def _swept(costs: Costs, kinds: bytes, end: tuple) -> tuple[tuple, int]:
    """(vector at a chunk's start, sum of what was taken off) from the vector at its end."""
    total = 0
    for kind in reversed(kinds):
        end, low = costs.before(end, kind)
        total += low
    return end, total


def _chunks(batches):
    """Cuts sorted rows into chunks and sweeps each back from a guess; what a chunk has is listed in ``_CHUNK``.

    The guess is the vector after a last row, so that a conversation of one chunk is done at once.
    """
    from pyspark import TaskContext

    task, at, costs, held, size, now, tally = TaskContext.get().partitionId(), 0, Costs(), [], 0, None, None

    def chunk():
        kinds = bytes(k for k, *_ in held)
        out, _ = _swept(costs, kinds, END)
        return (now, task, at, kinds, [n for _, n, *_ in held], [r for *_, r, _ in held], [t for *_, t in held], *tally, list(END), list(out))

    done, bytes_ = [], 0
    for b in batches:
        for conv, turn, role, text, m, again, blank, cut in zip(*(b.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "m", "again", "blank", "cut")), strict=True):
            if held and (conv != now or len(held) >= ROWS or size >= BYTES):
                done.append(chunk())
                at, held, bytes_, size = at + 1, [], bytes_ + size, 0
                if len(done) >= 1024 or bytes_ >= BYTES:
                    yield done
                    done, bytes_ = [], 0
            if not held:
                tally = [None, None, 0, 0, 0, 0]
            now, gone = conv, blank or again
            if turn is not None:
                tally[0] = turn if tally[0] is None else tally[0]
                tally[2] += turn != tally[1]
                tally[1] = turn
            tally[3] += m if blank else 0
            tally[4] += 0 if blank else m if again else m - 1
            tally[5] += cut and not gone
            held.append((_kind(role, cut, gone), m if gone else 1, role, None if gone else text))
            size += len(role) + (0 if gone else len(text))
            if m > 1 and not gone:
                held.append((16, m - 1, role, None))
    if held:
        done.append(chunk())
    yield done


#: Chunk ``at`` of a task: kinds of its rows, copies of each, roles, texts (null where the row must go), first and last turn
#: and how many there are, faults, and the vectors at its end (used) and start (out).
_CHUNK = "conv string, task int, at int, kinds binary, times array<long>, roles array<string>, texts array<string>, low long, high long, turns long, blank long, duplicate long, truncated long, used array<int>, out array<int>"
_STATE = "conv string, task int, at int, used array<int>, out array<int>"


def _cut(ddl: str):
    schema = _typed(ddl)

    def run(batches):
        for done in _chunks(batches):
            yield _batch(done, schema)

    return run, ddl


def _fixed(ddl: str):
    """Fix-up pass over spans of chunks, last one first: a chunk is swept again if the vector after it is another one."""
    schema = _typed(ddl)

    def run(batches):
        costs, span, carry = Costs(), None, None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                end = carry if span == (r["conv"], r["span"]) else tuple(r["after"])
                used, out = tuple(r["used"]), tuple(r["out"])
                if end != used:
                    used, (out, _) = end, _swept(costs, r["kinds"], end)
                span, carry = (r["conv"], r["span"]), out
                rows.append((r["conv"], r["task"], r["at"], list(used), list(out)))
            yield _batch(rows, schema)

    return run, ddl


def _stitched(spark, path: str, growth: int, span: int, most: int) -> DataFrame:
    """(conv, task, at, used): the vector after every chunk of conversations of several chunks, right up to a constant.

    A pass sweeps all chunks again whose successor gives another vector than they started from. As soon as a chunk's
    vectors differ only by a constant, nothing before it changes. Chunks of a span follow each other in one task, and
    spans grow from pass to pass, so that passes are few even where vectors never meet.
    """
    from pyspark.sql import Window

    chunks = spark.read.parquet(f"{path}/chunks")
    several = chunks.groupBy("conv").agg(F.count("*").alias("chunks")).where("chunks > 1").select("conv")
    states = chunks.select("conv", "task", "at", "used", "out").join(several, "conv", "left_semi")
    order = Window.partitionBy("conv").orderBy(F.desc("task"), F.desc("at"))
    for p in range(1000):
        states.write.parquet(f"{path}/states-{p}")
        states = spark.read.parquet(f"{path}/states-{p}")
        follow = states.withColumn("n", F.row_number().over(order) - 1).withColumn("after", F.coalesce(F.lag("out").over(order), F.array(*map(F.lit, END))))
        open_ = follow.where("after <> used").select("conv").distinct()
        if open_.isEmpty():
            return states.select("conv", "task", "at", "used")
        again = follow.join(open_, "conv", "left_semi").withColumn("span", F.floor(F.col("n") / span))
        again = again.join(chunks.select("conv", "task", "at", "kinds"), ["conv", "task", "at"])
        swept = again.repartition("conv", "span").sortWithinPartitions("conv", "span", "n").mapInArrow(*_fixed(_STATE))
        states = swept.unionByName(states.join(open_, "conv", "left_anti"))
        span = min(span * growth, most)
    raise RuntimeError("chunks still change")


_DONE = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURN = "conv string, position long, role string, text string"


class _Talk:
    """One conversation while its chunks go by."""

    def __init__(self):
        self.audit, self.state, self.cost, self.illegal, self.last, self.hash, self.turns = [], START, 0, 0, None, hashlib.sha256(), 0
        self.low, self.high, self.numbers, self.faults = None, None, 0, [0, 0, 0]

    def count(self, chunk: dict) -> None:
        if chunk["low"] is not None:
            self.numbers += chunk["turns"] - (self.high == chunk["low"])
            self.low, self.high = chunk["low"] if self.low is None else self.low, chunk["high"]
        self.faults = [a + chunk[c] for a, c in zip(self.faults, ("blank", "duplicate", "truncated"), strict=True)]

    def write(self, role: str, text: str) -> tuple[int, str, str]:
        line = f"{role}:{text}"
        self.hash.update(("\n" + line if self.turns else line).encode())
        self.turns += 1
        return self.turns - 1, role, text

    def insert(self) -> tuple[int, str, str]:
        turn = self.write(ROLE[self.state], "")
        self.cost, self.state = self.cost + INSERT, NEXT[self.state]
        return turn

    def row(self, costs: Costs, after: tuple, kind: int, n: int, role: str, text: str):
        """Edits up to and with a row of n copies; gives the turns written."""
        self.illegal += (self.last is not None and self.last + role[:1] not in ("su", "ua", "au")) + n - 1
        self.last = role[:1]
        letters, state = costs.edits(after, kind, self.state)
        for _ in letters[:-1]:
            yield self.insert()
        if letters[-1] == "D":
            self.cost += DELETE * n
        else:
            self.cost += TRUNCATED * (kind >> 2) + REROLE * (letters[-1] == "R")
            yield self.write(ROLE[self.state] if letters[-1] == "R" else role, text)
        self.audit.append(letters[:-1] + letters[-1] * (n if letters[-1] == "D" else 1))
        self.state = state

    def end(self):
        while END[self.state]:
            self.audit.append("I")
            yield self.insert()

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.numbers
        return gaps, *self.faults, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def _traced(turns: bool):
    """Follows the cheapest edits through the chunks of each conversation in order: its report, or its repaired turns."""
    ddl = _TURN if turns else _DONE
    schema = _typed(ddl)

    def run(batches):
        costs, now, talk = Costs(), None, None

        def ended():
            last = [(now, *t) for t in talk.end()]
            return last if turns else [(now, *talk.report())]

        for b in batches:
            done = []
            for r in b.to_pylist():
                if talk is None or r["conv"] != now:
                    done += ended() if talk else []
                    now, talk = r["conv"], _Talk()
                talk.count(r)
                ends, end = [], tuple(r["used"])
                for kind in reversed(r["kinds"]):
                    ends.append(end)
                    end, _ = costs.before(end, kind)
                for kind, after, *row in zip(r["kinds"], reversed(ends), r["times"], r["roles"], r["texts"], strict=True):
                    written = [(now, *t) for t in talk.row(costs, after, kind, *row)]
                    done += written if turns else []
            yield _batch(done, schema)
        if talk:
            yield _batch(ended(), schema)

    return run, ddl


def repaired(rows: DataFrame, turns: bool = False, growth: int = 16, most: int = 1 << 14) -> DataFrame:
    """Cheapest repair of the conversations of ``rows`` (conv, turn, role, text, copies), none of whose columns but turn is null.

    (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), or with ``turns`` the repaired turns
    (conv, position, role, text). Rows go by turn (null first), then role and text. The first fault of a row counts: blank
    text, a duplicate of an earlier row, or a truncated text. The cheapest edits (keep 0, rerole 3, delete 4, insert 3, and 3
    for a truncated row that is not deleted; blank and duplicate rows must go) give role initials ``(s?(ua)+)?``; ``audit`` is
    the least of them as text. A conversation without rows is not returned.

    Equal rows of a turn are one row with a number. Rows are range-partitioned by (conv, turn, ..), so that a conversation
    of any length spreads over tasks, and cut into chunks of at most 1,024 rows or some 4 MB of text. Chunks are swept
    backwards from a guessed cost vector; fix-up passes sweep those again whose successor gives another vector, until all
    differ by constants only. The trace then runs over chunks in order, one task a conversation, as the hash of a whole
    conversation asks for; it holds one batch of chunks and the audit.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/repair-{uuid.uuid4().hex}"
    each = faulty(bounded_batches(rows))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds reach the driver: long texts take part by their start only. Nothing is cut between rows that share it.
    start = [F.substring("role", 1, 16), F.substring("text", 1, 64)]
    ordered = each.repartitionByRange(parts, "conv", "turn", *start).sortWithinPartitions("conv", "turn", "role", "text")
    ordered.mapInArrow(*_cut(_CHUNK)).write.parquet(f"{path}/chunks")
    stitched = _stitched(spark, path, growth, growth, most).withColumnRenamed("used", "right")
    chunks = spark.read.parquet(f"{path}/chunks").drop("out").join(stitched, ["conv", "task", "at"], "left").withColumn("used", F.coalesce("right", "used")).drop("right")
    return chunks.repartition("conv").sortWithinPartitions("conv", "task", "at").mapInArrow(*_traced(turns))


def audited(conversations: DataFrame) -> DataFrame:
    """One row for every conv_id of ``conversations`` (conv_id, turn, role, text), null included: what damage did and its repair.

    Conversations that lost all rows give zeros, an empty audit and the hash of an empty string. Very long texts, repeated
    rows and turns, null turns (before all others) and nulls in role or text (one space, and so blank) are allowed.
    """
    ids = conversations.select("conv_id").distinct().withColumn("conv", named("conv_id"))
    found = ids.join(repaired(damaged(conversations)), "conv", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
