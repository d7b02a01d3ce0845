"""Repairs against every sequence of edits, and whole tables against a plain version."""

import functools
import hashlib
import itertools
import random
import re
import zlib

from legalspark.llm.conversations import damage, derive, repair, reported

GOOD = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """rows: (role, text) in order. A letter for each: B, D, T or a point."""
    out, seen = [], set()
    for role, text in rows:
        t = text.rstrip("\t\n\x0b\x0c\r ")
        out.append("B" if not t else "D" if (role, text) in seen else "." if t[-1] in ".!?" else "T")
        seen.add((role, text))
    return out


def every_repair(rows):
    """(cost, audit, roles) of the best of all sequences of edits, for few rows."""
    best = None
    more = [()] + [(x,) for x in "ua"] + [(x, y) for x in "ua" for y in "ua"]
    choices = []
    for (role, _), f in zip(rows, faults(rows), strict=True):
        extra = 3 if f == "T" else 0
        own = [("D", 4, "")]
        if f not in "BD":
            own += [("K", extra, role[:1]), ("R", 3 + extra, "u"), ("R", 3 + extra, "a")]
        choices.append(own)
    for gaps in itertools.product(more, repeat=len(rows) + 1):
        base = 3 * sum(map(len, gaps))
        if best and base > best[0]:
            continue
        for edits in itertools.product(*choices):
            cost = base + sum(e[1] for e in edits)
            if best and cost > best[0]:
                continue
            roles = "".join("".join(g) + e[2] for g, e in zip(gaps, (*edits, ("", 0, "")), strict=True))
            if GOOD.fullmatch(roles):
                audit = "".join("I" * len(g) + e[0] for g, e in zip(gaps, (*edits, ("", 0, "")), strict=True))
                best = min(best or (cost, audit, roles), (cost, audit, roles))
    return best


def best_repair(rows):
    """(cost, audit, lines) by recursion over suffixes: the best way on from a state is the same whatever came before."""
    fault = faults(rows)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    full = {"u": "user", "a": "assistant"}

    @functools.lru_cache(None)
    def on(i, state, inserted=0):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            for x in "ua":
                if (state, x) in step:
                    c, a, lines = on(i, x, inserted + 1)
                    ways.append((c + 3, "I" + a, (f"{full[x]}:", *lines)))
        if i < len(rows):
            (role, text), f = rows[i], fault[i]
            c, a, lines = on(i + 1, state)
            ways.append((c + 4, "D" + a, lines))
            if f not in "BD":
                extra = 3 if f == "T" else 0
                for letter, cost, x, r in (("K", 0, role[:1], role), ("R", 3, "u", "user"), ("R", 3, "a", "assistant")):
                    if (state, x) in step:
                        c, a, lines = on(i + 1, step[state, x])
                        ways.append((c + cost + extra, letter + a, (f"{r}:{text}", *lines)))
        return min(ways, default=(10**9, "", ()))

    return on(0, "")


def plain(rows):
    """The result of the query from rows of (conv_id, turn, role, text)."""
    by = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        group = by.setdefault(conv, [])
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            group += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = []
    for conv, group in by.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, own = [t for t, _, _ in group if t is not None], [r[1:] for r in group]
        f = faults(own)
        cost, audit, lines = best_repair(tuple(own))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, f.count("B"), f.count("D"), f.count("T"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def talk(rng, conv, n):
    texts = ["Hi.", "So?", "and then", "", " \t", "Yes!", "ok. ", "no", "Well. \x85", "x.\x1c"]
    return [(conv, rng.choice([k, k, k, k + rng.randint(0, 2), None]) if rng.random() < 0.3 else k, rng.choice(["system", "tool", "", None, "ultra", "s"]) if rng.random() < 0.2 else ("user", "assistant")[k % 2], rng.choice(texts) if rng.random() < 0.4 else f"Text {k} of {conv}.") for k in range(n)]


def test_agenda_against_every_sequence_of_edits():
    rng = random.Random(1)
    for _ in range(60):
        rows = tuple((rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["A.", "B", "", "C!"])) for _ in range(rng.randint(0, 3)))
        marks = "".join("D" if f in "BD" else (r[:1] if r[0] in "sua" else "x").upper() if f == "T" else (r[:1] if r[0] in "sua" else "x") for (r, _), f in zip(rows, faults(rows), strict=True))
        cost, audit, _ = every_repair(rows)
        assert derive(marks) == (cost, audit) == best_repair(rows)[:2], rows


def conversations():
    rng = random.Random(7)
    rows = [r for conv in range(120) for r in talk(rng, conv, rng.randint(1, 9))]
    rows += talk(rng, None, 6) + talk(rng, 500, 150) + talk(rng, 501, 41)
    rows += [(600, k, "user", "the very same.") for k in range(60)] + [(601, None, "assistant", "same row.")] * 30 + [(602, k, "system", "a" * k) for k in range(30)]
    return rows + rows[:5]


def found(spark, rows, **named):
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(5)
    return sorted((tuple(r) for r in reported(table, *repair(damage(table), **named)).collect()), key=str)


def test_whole_conversations(spark):
    rows = conversations()
    assert found(spark, rows) == plain(rows)


def test_conversations_by_blocks(spark, monkeypatch):
    """The same result when all conversations of more than three turns are cut to blocks, in several levels."""
    monkeypatch.setattr("legalspark.llm.conversations.FAN", 3)
    rows = conversations()
    assert found(spark, rows, most=3, block=4) == plain(rows)


def test_one_long_conversation(spark):
    rng = random.Random(3)
    rows = [(1, k, ("user", "assistant")[k % 2] if rng.random() < 0.9 else "tool", rng.choice(["Yes.", "no", f"Turn {k}."])) for k in range(5000)]
    (r,) = found(spark, rows)
    by, long = [], {t: x for _, t, *x in rows}
    for t in range(5000):
        fate = zlib.crc32(f"1:{t}".encode()) % 20
        role, text = long[t]
        by += [("user" if fate == 4 else role, "" if fate == 1 else text.replace(".", "") if fate == 2 else text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    f = faults(by)
    marks = "".join("D" if x in "BD" else ("x" if role[0] == "t" else role[0]).upper() if x == "T" else ("x" if role[0] == "t" else role[0]) for (role, _), x in zip(by, f, strict=True))
    assert (r[6], r[7]) == derive(marks) and r[2:5] == (f.count("B"), f.count("D"), f.count("T"))


def test_repaired_turns(spark):
    table = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Again."), (2, 0, "user", "Why?")], "conv_id long, turn long, role string, text string")
    report, turns = repair(table)
    assert sorted((r["conv_id"], r["place"], r["edit"], r["role"], r["text"]) for r in turns.collect()) == [(1, 0, "R", "user", "Hello."), (1, 1, "K", "assistant", "Again."), (2, 0, "K", "user", "Why?"), (2, 1, "I", "assistant", "")]
    assert sorted((r["conv_id"], r["cost"], r["audit"], r["illegal"]) for r in report.collect()) == [(1, 3, "RK", 1), (2, 3, "KI", 0)]
    assert reported(table.limit(0), *repair(table.limit(0))).count() == 0
