"""Repair of the structure of conversations by lightest derivations.

A conversation should be nothing, or turns of a user and an assistant in pairs, after a system turn if there is one. Turns are
kept, given another role, deleted or inserted. What can be derived are items (i, state): the first i turns are done and the
output is in that state. A deduction takes an item and the fact that turn i is there to an item of the next turn (keep, re-role,
delete), or an item to one of the same turn (insert). An item's weight is (cost, audit), the audit being the letters of the edits; each
deduction adds to both, so that its weight is not below that of its items and grows with theirs: costs add up, a longer audit
comes after its beginning, and two audits of equal cost for one item are never one the beginning of the other, since what
is more in the longer one would be insertions, which cost. So the agenda pops items by weight, each is final when it is first
popped, and the goal's first pop is the answer (Knuth's generalisation of Dijkstra's algorithm).

Short conversations are solved whole in a task. Long ones are cut to blocks: an agenda for each state before a block gives its
lightest derivation to each state after it; spans of blocks are joined level by level, (p, r) and (r, q) to (p, q), by cost and
by the rank of their audits, until one span is left; the states chosen go down again to the blocks. No task holds a long
conversation.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, attach, materialise, operator, tidy

#: Fixed costs of the edits; an undeleted truncated turn costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the output: 0 nothing, 1 after a system turn, 2 after a user's, 3 after an assistant's; steps by the role's initial.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: The role that a new or re-roled turn has in a state, and the insertions that close a conversation from a state.
NEXT, CLOSING = ("user", "user", "assistant", "user"), ("", "II", "I", "")
#: A conversation with more turns or bytes is a long one; turns of a block of it; spans that are joined at once.
TURNS, BYTES, BLOCK, FAN = 1_000, 32 << 20, 256, 64
#: White space of a text.
SPACE = "\t\n\x0b\x0c\r "

_REPORT = "conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit"


def _edits(mark: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after it) of what can be done with a turn. mark: B or D for one that must go, else the initial of
    its role (x for a strange one), in upper case if it is truncated."""
    out = [("D", DELETE, state)]
    if mark not in "BD":
        more, to = TRUNCATED * mark.isupper(), STEPS[state, NEXT[state][0]]
        out.append(("R", REROLE + more, to))
        if (state, mark.lower()) in STEPS:
            out.append(("K", more, STEPS[state, mark.lower()]))
    return out


def derive(marks: str, start: int = 0, whole: bool = True):
    """whole: (cost, audit) of the lightest derivation of the goal. Else a dict of them by the state after the last turn, without
    insertions behind it, from the state start."""
    agenda, final, n = [(0, "", 0, start)], {}, len(marks)
    while agenda:
        cost, audit, i, state = heapq.heappop(agenda)
        if i > n:
            return cost, audit
        if (i, state) in final:
            continue
        final[i, state] = cost, audit
        if i == n and whole and state in (0, 3):
            heapq.heappush(agenda, (cost, audit, n + 1, state))
        if i < n or whole:
            heapq.heappush(agenda, (cost + INSERT, audit + "I", i, STEPS[state, NEXT[state][0]]))
        if i < n:
            for letter, more, to in _edits(marks[i], state):
                heapq.heappush(agenda, (cost + more, audit + letter, i + 1, to))
    return {state: found for (i, state), found in final.items() if i == n}


@functools.lru_cache(50_000)
def _known(marks: str) -> tuple[int, str]:
    """Short conversations have few forms."""
    return derive(marks)


class Output:
    """The turns that edits make of turns, from a state on."""

    def __init__(self, state: int = 0):
        self.state = state

    def insert(self) -> tuple[str, str, str]:
        role = NEXT[self.state]
        self.state = STEPS[self.state, role[0]]
        return "I", role, ""

    def edit(self, letter: str, role: str, text: str) -> tuple[str, str, str]:
        role = role if letter == "K" else NEXT[self.state]
        self.state = STEPS[self.state, role[0]]
        return letter, role, text


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations with faults put in, by crc32(`conv_id:turn`) % 20: 0 drops the turn, 1 empties
    its text, 2 takes `[.!?]` out of it, 3 repeats it, 4 makes it the user's. Nulls are one space in what is hashed and read."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    copies = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"))
    return rows.drop("copy")


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("k"), c.cast("string")), F.lit("n"))


def _marked(turns: DataFrame) -> DataFrame:
    """key, conv_id, turn, role, text and mark: B for a blank text, else as in _edits, where duplicates are not known yet."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(_key(F.col("conv_id")).alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    own = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    return rows.withColumn("mark", F.when(end == "", "B").when(F.right(end, F.lit(1)).isin(".", "!", "?"), own).otherwise(F.upper(own)))


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def _counted(marks: str) -> tuple[int, int, int]:
    return marks.count("B"), marks.count("D"), sum(m.isupper() for m in marks) - marks.count("B") - marks.count("D")


def _turn_stats(turns: list[int | None]) -> tuple[int | None, int | None, int]:
    known = {t for t in turns if t is not None}
    return (min(known), max(known), len(known)) if known else (None, None, 0)


_TURNS = "place long, edit string, made string, made_text string"


def _short(rows: DataFrame, kind: str) -> DataFrame:
    """Of each conversation a row for its report, and one for each turn that it has afterwards (place is null in the report)."""
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, {_TURNS}"
    names, size = [f.split()[0] for f in schema.split(", ")], len(schema.split(", "))

    def solved(turns: list[tuple]) -> Iterator[tuple]:
        seen, marks = set(), ""
        for _, _, role, text, mark in turns:
            marks += mark if mark == "B" or (role, text) not in seen else "D"
            seen.add((role, text))
        cost, audit = (_known if len(marks) < 64 else derive)(marks)
        low, high, distinct = _turn_stats([t[1] for t in turns])
        illegal = sum(_illegal(a[2][:1], b[2][:1]) for a, b in zip(turns, turns[1:], strict=False))
        conv = turns[0][0]
        yield (conv, high - low + 1 - distinct if distinct else 0, *_counted(marks), illegal, cost, audit, None, None, None, None)
        out, at, place = Output(), 0, 0
        for letter in audit:
            if letter == "I":
                made = out.insert()
            else:
                made = None if letter == "D" else out.edit(letter, turns[at][2], turns[at][3])
                at += 1
            if made:
                yield (conv, *[None] * 7, place, *made)
                place += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        types = None

        def flushed() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

        def conversations() -> Iterator[list[tuple]]:
            nonlocal types
            key, group = None, []
            for b in batches:
                types = types or [b.schema.field("conv_id").type] + [pa.int64()] * 6 + [pa.string(), pa.int64()] + [pa.string()] * (size - 9)
                for k, *row in zip(*[b.column(c).to_pylist() for c in ("key", "conv_id", "turn", "role", "text", "mark")], strict=True):
                    if k != key and group:
                        yield group
                        group = []
                    key = k
                    group.append(tuple(row))
            if group:
                yield group

        for turns in conversations():
            for row in solved(turns):
                held.append(row)
                chars += len(row[-1] or "") + 50
            if chars > 4 << 20:
                yield flushed()
                held, chars = [], 0
        if held:
            yield flushed()
        tidy()

    order = ["key", "turn", "role", "text"]
    return rows.select(*order, "conv_id", "mark").repartition("key").sortWithinPartitions(*order).mapInArrow(run, schema)


def _span(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for a block of turns: counts, its ends, and cost, rank of the audit and audit by (state before, state after)."""
    pdf = pdf.sort_values("pos")
    marks = "".join("D" if d and m != "B" else m for m, d in zip(pdf["mark"], pdf["again"], strict=True))
    turns = [None if pd.isna(t) else int(t) for t in pdf["turn"]]
    found = {(p, q): v for p in range(4) for q, v in derive(marks, p, False).items()}
    ranks = {a: k for k, a in enumerate(sorted({a for _, a in found.values()}))}
    each = [found.get((p, q)) for p in range(4) for q in range(4)]
    firsts, known = pdf["initial"].tolist(), [t for t in turns if t is not None]
    low, high, distinct = _turn_stats(turns)
    blank, again, cut = _counted(marks)
    row = {"key": pdf["key"].iloc[0], "conv_id": pdf["conv_id"].iloc[0], "at": pdf["pos"].iloc[0], "blank": blank, "duplicate": again, "truncated": cut,
           "illegal": sum(_illegal(a, b) for a, b in zip(firsts, firsts[1:], strict=False)), "first": firsts[0], "last": firsts[-1], "low": low, "high": high, "distinct": distinct,
           "first_turn": known[0] if known else None, "last_turn": turns[-1], "costs": [-1 if f is None else f[0] for f in each], "ranks": [-1 if f is None else ranks[f[1]] for f in each], "audits": ["" if f is None else f[1] for f in each]}
    return pd.DataFrame([row]).astype({c: "Int64" for c in ("low", "high", "first_turn", "last_turn")})


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring spans as one: the lightest way for each (state before, state after), and the states between the spans."""
    pdf = pdf.sort_values("idx")
    best = {(p, p): (0, (), str(p)) for p in range(4)}
    for costs, ranks in zip(pdf["costs"], pdf["ranks"], strict=True):
        now = {}
        for (p, r), (cost, path, states) in best.items():
            for q in range(4):
                if costs[r * 4 + q] >= 0:
                    way = (cost + int(costs[r * 4 + q]), (*path, int(ranks[r * 4 + q])), states + str(q))
                    now[p, q] = min(now.get((p, q), way), way)
        best = now
    order = {path: k for k, path in enumerate(sorted({w[1] for w in best.values()}))}
    each = [best.get((p, q)) for p in range(4) for q in range(4)]
    row = {"key": pdf["key"].iloc[0], "idx": pdf["up"].iloc[0], "costs": [-1 if w is None else w[0] for w in each], "ranks": [-1 if w is None else order[w[1]] for w in each], "paths": ["" if w is None else w[2] for w in each]}
    return pd.DataFrame([row])


def _closed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state after the last turn of each conversation, by the lightest derivation with its closing insertions."""
    for pdf in batches:
        out = []
        for key, costs, ranks in zip(pdf["key"], pdf["costs"], pdf["ranks"], strict=True):
            ends = [(int(costs[q]) + INSERT * len(CLOSING[q]), int(ranks[q]), CLOSING[q], q) for q in range(4) if costs[q] >= 0]
            cost, _, closing, q = min(ends)
            out.append((key, cost, closing, q))
        yield pd.DataFrame(out, columns=["key", "cost", "closing", "q"])


def _long(rows: DataFrame, kind: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Report and turns of long conversations."""
    order = ["key", "turn", "role", "text"]
    own = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()))
    piece = [F.shiftright("pos", 33).alias("part"), F.floor(F.col("pos").bitwiseAND(F.lit((1 << 33) - 1)) / block).alias("block")]
    digest = F.unhex(F.md5(F.concat(F.md5("role"), F.md5("text"), F.col("key"))))
    narrow = materialise(own.select("key", "conv_id", "pos", *piece, "turn", "mark", F.substring("role", 1, 1).alias("initial"), digest.alias("digest")))
    firsts = materialise(narrow.groupBy("digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1"))
    flagged = attach(narrow, firsts, "digest", "n", narrow.count()).withColumn("again", F.coalesce(F.col("pos") > F.col("first"), F.lit(False)))
    schema = f"key string, conv_id {kind}, at long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, distinct long, first_turn long, last_turn long, costs array<long>, ranks array<int>, audits array<string>"
    spans = materialise(flagged.select("key", "conv_id", "pos", "part", "block", "turn", "mark", "initial", "again").groupBy("key", "part", "block").applyInPandas(_span, schema))
    w = Window.partitionBy("key").orderBy("at")
    pair = F.concat(F.lag("last").over(w), F.col("first"))
    spans = materialise(spans.withColumns({"idx": F.row_number().over(w) - 1, "bad": F.coalesce((~pair.isin("su", "ua", "au")).cast("int"), F.lit(0)), "same": F.coalesce((F.lag("last_turn").over(w) == F.col("first_turn")).cast("int"), F.lit(0))}))
    level, levels = spans.select("key", "idx", "costs", "ranks"), []
    while not level.where("idx > 0").isEmpty():
        level = materialise(level.withColumn("up", F.floor(F.col("idx") / FAN)).groupBy("key", "up").applyInPandas(_joined, "key string, idx long, costs array<long>, ranks array<int>, paths array<string>"))
        levels.append(level)
    roots = materialise(level.mapInPandas(_closed, "key string, cost long, closing string, q int"))
    chosen = roots.select("key", F.lit(0).alias("idx"), F.lit(0).alias("p"), "q")
    for level in reversed(levels):
        path = level.join(chosen, ["key", "idx"]).select("key", "idx", F.get("paths", F.col("p") * 4 + F.col("q")).alias("path"))
        steps = path.select("key", "idx", "path", F.explode(F.sequence(F.lit(1), F.length("path") - 1)).alias("k"))
        state = lambda k: F.substr("path", k, F.lit(1)).cast("int")
        chosen = materialise(steps.select("key", (F.col("idx") * FAN + F.col("k") - 1).alias("idx"), state(F.col("k")).alias("p"), state(F.col("k") + 1).alias("q")))
    done = spans.join(chosen, ["key", "idx"]).withColumn("audit", F.get("audits", F.col("p") * 4 + F.col("q"))).drop("costs", "ranks", "audits")
    made = F.length(F.replace("audit", F.lit("D"), F.lit("")))
    done = materialise(done.withColumn("to", F.sum(made).over(Window.partitionBy("key").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("to") - made))
    total = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "audit"))), lambda s: s["audit"]), "")
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("distinct") + F.sum("same"), F.lit(0)).alias("gaps")
    report = done.groupBy("key").agg(F.first("conv_id").alias("conv_id"), gaps, *total, F.sum(F.col("illegal") + F.col("bad")).alias("illegal"), letters.alias("letters"), F.max("to").alias("to")).join(roots, "key")
    report = materialise(report.withColumn("audit", F.concat("letters", "closing")))

    none = lambda t: F.lit(None).cast(t)
    heads = done.select("key", "conv_id", F.shiftright("at", 33).alias("part"), F.floor(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) / block).alias("block"), F.lit(0).alias("kind"), F.col("at").alias("pos"), F.col("p").alias("state"), "start", F.col("audit").alias("role"), none("string").alias("text"))
    bodies = own.select("key", "conv_id", *piece, F.lit(1).alias("kind"), "pos", none("int").alias("state"), none("long").alias("start"), "role", "text")

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, out, place = iter(""), Output(), 0
        for b in batches:
            held = []
            for conv, head, state, start, role, text in zip(*[b.column(c).to_pylist() for c in ("conv_id", "kind", "state", "start", "role", "text")], strict=True):
                if head == 0:
                    letters, out, place = iter(role), Output(state), start
                    continue
                for letter in letters:
                    if letter == "D":
                        break
                    held.append((conv, place, *(out.insert() if letter == "I" else out.edit(letter, role, text))))
                    place += 1
                    if letter != "I":
                        break
            if held:
                types = [b.schema.field("conv_id").type, pa.int64(), *[pa.string()] * 3]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=["conv_id", "place", "edit", "role", "text"])
        tidy()

    by = ["key", "part", "block"]
    turns = heads.unionByName(bodies).repartition(*by).sortWithinPartitions(*by, "kind", "pos").mapInArrow(replayed, f"conv_id {kind}, place long, edit string, role string, text string")
    ends = report.where("closing <> ''").select("conv_id", F.col("to").alias("at"), F.posexplode(F.when(F.length("closing") == 2, F.array(F.lit("user"), F.lit("assistant"))).otherwise(F.array(F.lit("assistant")))).alias("k", "role"))
    turns = turns.unionByName(ends.select("conv_id", (F.col("at") + F.col("k")).alias("place"), F.lit("I").alias("edit"), "role", F.lit("").alias("text")))
    return report.select(*_REPORT.split(", ")), turns


@operator
def repair(turns: DataFrame, most: int = TURNS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(report, repaired) of turns (conv_id, turn, role, text).

    report has a row per conversation: gaps in its turn numbers, turns whose first fault is to be blank, a duplicate (of role and
    text) or truncated, neighbours whose roles' initials are out of order, the least cost of a repair and its audit (of equal
    cost the ASCII-least). repaired has a row per turn that there is afterwards: conv_id, place from 0, edit (K, R or I), role,
    text.

    Turns are in the order of turn (nulls first), then of role and text, so the result does not hang on the order of rows that
    share a turn; a null role or text is one space, and rows without conv_id are one conversation. An empty text is blank; a
    role with no first letter, or another one than s, u and a, can't be kept. An empty table has no conversations. Other columns
    are not read. A conversation with more than `most` turns, or very long texts, goes by blocks.
    """
    rows, kind = _marked(turns), turns.schema["conv_id"].dataType.simpleString()
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    long = materialise(sizes.where((F.col("n") > most) | (F.col("bytes") > BYTES)).select("key"))
    few = long.count()
    if not few:
        found = materialise(_short(rows, kind))
        more = None
    else:
        keys = F.broadcast(long) if few <= BROADCAST_ROWS else long
        found = materialise(_short(rows.join(keys, "key", "left_anti"), kind))
        more = _long(rows.join(keys, "key", "left_semi"), kind, block)
    report = found.where("place is null").select(*_REPORT.split(", "))
    repaired = found.where("place is not null").select("conv_id", "place", "edit", F.col("made").alias("role"), F.col("made_text").alias("text"))
    return (report.unionByName(more[0]), repaired.unionByName(more[1])) if more else (report, repaired)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, of the lines `role:text` of each conversation. A task walks over the sorted turns and keeps
    only the state of the hash; that of one conversation can't be taken in parts."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, conv, state = None, None, None
        for b in batches:
            ends = []
            for k, c, line in zip(*[b.column(x).to_pylist() for x in ("key", "conv_id", "line")], strict=True):
                if state is None or k != key:
                    if state is not None:
                        ends.append((conv, state.hexdigest()))
                    key, conv, state = k, c, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            last = b.schema.field("conv_id").type
            if ends:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*ends, strict=True), (last, pa.string()), strict=True)], names=["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.record_batch([pa.array([conv], last), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])
        tidy()

    lines = repaired.select(_key(F.col("conv_id")).alias("key"), "conv_id", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("key").sortWithinPartitions("key", "place").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def reported(conversations: DataFrame, report: DataFrame, repaired: DataFrame) -> DataFrame:
    """The report for every conv_id of conversations, with repaired_sha256; one that has no turns left has zeros, no audit and
    the hash of an empty string."""
    every = conversations.select("conv_id").distinct().select("conv_id", _key(F.col("conv_id")).alias("key"))
    own = report.withColumn("key", _key(F.col("conv_id"))).drop("conv_id")
    sums = digests(repaired).withColumn("key", _key(F.col("conv_id"))).drop("conv_id")
    out = every.join(own, "key", "left").join(sums, "key", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
