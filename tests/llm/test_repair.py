"""Conversation repair against a search over all states in order, one conversation at a time."""

import hashlib
import random
import zlib

import pytest

from lamella.llm import repair

BLANK = " \t\n\x0b\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def plain(ids, rows):
    """Forward search: (cost, audit, turns) of the best edits by last initial."""
    out = []
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        best, seen, n = {"": (0, "", ())}, set(), [0, 0, 0, 0]

        def follows(q, c):
            return (q, c) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

        def inserted(best):
            for _ in range(3):
                for q, c in (("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                    if q in best:
                        cost, audit, turns = best[q]
                        new = cost + 3, audit + "I", (*turns, ("user:" if c == "u" else "assistant:"))
                        best[c] = min(best.get(c, new), new)
            return best

        best = inserted(best)
        for k, (_, _, role, text) in enumerate(own):
            tail = text.rstrip(BLANK)
            blank, again = not tail, bool(tail) and (role, text) in seen
            cut = bool(tail) and not again and tail[-1] not in ".!?"
            n = [a + b for a, b in zip(n, (blank, again, cut, k > 0 and own[k - 1][2][:1] + role[:1] not in ("su", "ua", "au")), strict=True)]
            seen.add((role, text))
            new = {}
            for q, (cost, audit, turns) in best.items():
                ways = [(q, (cost + 4, audit + "D", turns))]
                if not blank and not again:
                    if role[:1] in tuple("sua") and follows(q, role[:1]):
                        ways.append((role[:1], (cost + 3 * cut, audit + "K", (*turns, f"{role}:{text}"))))
                    ways += [(c, (cost + 3 + 3 * cut, audit + "R", (*turns, f"{w}:{text}"))) for c, w in (("u", "user"), ("a", "assistant")) if follows(q, c)]
                for c, way in ways:
                    new[c] = min(new.get(c, way), way)
            best = inserted(new)
        cost, audit, turns = min(best[q] for q in ("", "a") if q in best)
        numbers = [r[1] for r in own if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out.append((conv, gaps, *n, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()))
    return out


def talks(seed, n, long=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(0, 9) if c or not long else long):
            role = rng.choice(["user", "assistant"] * 3 + ["system", "tool", "", None, "User"]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            rows.append((c, rng.choice([t, t * 3, None]) if rng.random() < 0.2 else t, role, rng.choice(["Yes.", "no", "What?", " \n", "", None, f"turn {t}.", f"turn {t}", "ok!  "])))
    return rows


def test_repairs(spark, monkeypatch):
    rows = talks(1, 150) + [(None, 1, "user", "null id."), (None, 2, "assistant", "x " * 100_000 + ".")]
    rows += [(900, 5, "user", "same.")] * 40 + [(901, None, "user", "b."), (901, None, "assistant", "a.")]
    rows += [(next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0), 0, "user", "dropped.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS conv", "'x' AS copies", "2 AS m").repartition(3)
    want = sorted(plain(list(dict.fromkeys(r[0] for r in rows)), damaged(rows)), key=str)
    assert any(r[7] == "" for r in want) and {x for r in want for x in r[7]} == set("DIKR")
    for rows_, bytes_ in ((1024, 4 << 20), (1, 1)):
        monkeypatch.setattr(repair, "ROWS", rows_)
        monkeypatch.setattr(repair, "BYTES", bytes_)
        got = repair.audited(frame)
        assert sorted(map(tuple, got.collect()), key=str) == want


@pytest.mark.parametrize("kind", ["mixed", "blank"])
def test_long_conversation_over_chunks(spark, monkeypatch, kind):
    """Chunks in the middle start from a guess; where all rows must go, no pass but the last one meets."""
    monkeypatch.setattr(repair, "ROWS", 7)
    rows = talks(3, 3, long=700) if kind == "mixed" else [(0, t, "user", "" if t < 399 else "end.") for t in range(400)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    want = sorted(plain(sorted({r[0] for r in rows}), damaged(rows)), key=str)
    assert sorted(map(tuple, repair.audited(frame).collect()), key=str) == want


def test_turns_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair.audited(spark.createDataFrame([], schema)).collect() == []
    rows = spark.createDataFrame([("a", 1, "assistant", "Hi.", 1), ("a", 2, "user", "Hm", 1), ("a", 3, "user", "", 1)], "conv string, turn long, role string, text string, copies int")
    got = sorted(tuple(r)[1:] for r in repair.repaired(rows, turns=True).collect())
    assert got == [(0, "user", ""), (1, "assistant", "Hi.")]
    assert repair.repaired(rows).first()["audit"] == "IKDD"


def test_costs_meet():
    """Different vectors after the same rows soon differ by a constant only."""
    costs, rng = repair.Costs(), random.Random(0)
    kinds = bytes(rng.choice([1, 2, 3, 2, 3, 6, 7, 16]) for _ in range(60))
    starts = [(0, 6, 3, 0), (0, 0, 0, 3), (3, 3, 0, 3), (0, 3, 3, 0)]
    assert len({repair._swept(costs, kinds, v)[0] for v in starts}) == 1
