"""Operator 11, conversation structure repair: error-correcting Earley parsing of the sequence of roles.

The grammar of a sound conversation (a system turn at most, then user and assistant in turns) gets error productions:
a row may be deleted or get another role, a row may be inserted, each at a price. An item of the chart is a rule with
what is left of it, and keeps the least (cost, audit) that leads to it; the audit has an initial for each edit, in
order. The completed chart gives the cheapest repair, ties to the ASCII-least audit. Of two audits of one cost and
place none begins the other (the one that went on would cost more), so the lesser stays so whatever follows.

Nonterminals stand at the left end of rules only, so that every item begins in column 0: the chart needs no column but
the last one, and is read off rows as they stream by in order. Rows are dealt by ranges of (conversation, turn), which
splits a conversation of any size; only the first and the last of a task can go on in others. Such parts are parsed
from every item that may stand where they begin, and put together afterwards as maps from items to items.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import runtime

#: Rules of a dialogue D and its turns T; small letters are initials of roles.
GRAMMAR = (("D", ""), ("D", "T"), ("T", "sua"), ("T", "ua"), ("T", "Tua"))
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: From any item, two insertions and another four (a system turn deleted instead of kept) are as good as any other item.
SLACK = 2 * INSERT + DELETE
BLANK = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
#: Rows and characters of a conversation a task holds; a longer one is written in blocks.
BLOCK_ROWS, BLOCK_CHARS = 1_000, 4_000_000

Item = tuple[str, str]
Column = dict[Item, tuple[int, str]]


def _predicted(grammar: tuple[tuple[str, str], ...]) -> tuple[list[Item], dict[str, list[Item]], list[Item]]:
    """Items of column 0, items that a completed nonterminal leads to, and all items that a column can hold."""
    found = [r for r in grammar if r[0] == grammar[0][0]]
    for _, left in found:
        found += [r for r in grammar if left[:1].isupper() and r[0] == left[0] and r not in found]
    waiting: dict[str, list[Item]] = {}
    for lhs, left in found:
        if left[:1].isupper():
            waiting.setdefault(left[0], []).append((lhs, left[1:]))
    start = [i for i in found if not i[1][:1].isupper()]
    every = sorted({(lhs, left[k:]) for lhs, left in found for k in range(len(left) + 1)} - {i for i in found if i not in start})
    return start, waiting, every


START, WAITING, ITEMS = _predicted(GRAMMAR)


class Chart:
    """The last column of a chart, and what all its audits begin with."""

    def __init__(self, items: Iterable[Item]):
        self.settled: list[str] = []
        self.column = self._closed({i: (0, "") for i in items})

    @staticmethod
    def _closed(items: Column) -> Column:
        """With what completion and insertion add. Items that can't be part of a cheapest repair are left out."""
        heap = [(cost, audit, item) for item, (cost, audit) in items.items()]
        heapq.heapify(heap)
        done: Column = {}
        most = heap[0][0] + SLACK if heap else 0
        while heap and heap[0][0] <= most:
            cost, audit, item = heapq.heappop(heap)
            if item in done:
                continue
            done[item] = cost, audit
            lhs, left = item
            if left[:1] in NAMES:
                heapq.heappush(heap, (cost + INSERT, audit + "I", (lhs, left[1:])))
            for other in WAITING.get(lhs, ()) if not left else ():
                heapq.heappush(heap, (cost, audit, other))
        return done

    def take(self, column: Column) -> None:
        self.column = self._closed(column)
        common = os.path.commonprefix([audit for _, audit in self.column.values()])
        if len(common) >= 64:
            self.settled.append(common)
            self.column = {i: (cost, audit[len(common) :]) for i, (cost, audit) in self.column.items()}

    def scan(self, initial: str, sound: bool, price: int) -> None:
        """The next row. sound: it may stay, for price."""
        into: Column = {}
        for (lhs, left), (cost, audit) in self.column.items():
            ways = [((lhs, left), (cost + DELETE, audit + "D"))]
            if sound and left[:1] == initial and left:
                ways.append(((lhs, left[1:]), (cost + price, audit + "K")))
            elif sound and left[:1] in NAMES:
                ways.append(((lhs, left[1:]), (cost + REROLE + price, audit + "R")))
            for item, value in ways:
                into[item] = min(value, into.get(item, value))
        self.take(into)

    def delete(self, n: int) -> None:
        """The next n rows, none of which may stay."""
        self.take({i: (cost + DELETE * n, audit + "D" * n) for i, (cost, audit) in self.column.items()})

    def follow(self, maps: dict[Item, tuple[str, Column]]) -> None:
        """A part that was parsed from each item by itself."""
        into: Column = {}
        for item, (cost, audit) in self.column.items():
            begin, column = maps[item]
            for out, (more, end) in column.items():
                value = cost + more, audit + begin + end
                into[out] = min(value, into.get(out, value))
        self.take(into)

    def best(self) -> tuple[int, str]:
        cost, audit = self.column[GRAMMAR[0][0], ""]
        return cost, "".join(self.settled) + audit


def edited(rows: list[dict], audit: str, odd: bool, at: int = 0) -> list[dict]:
    """Rows (role, text, n) after the edits: role, text, edit. odd: the whole has a system turn; at: messages before."""
    out = []
    edits = iter(audit)
    name = lambda: "assistant" if (at + len(out) - odd) % 2 else "user"
    for row in rows:
        for _ in range(row["n"]):
            while (edit := next(edits)) == "I":
                out.append({"role": name(), "text": "", "edit": "I"})
            if edit != "D":
                out.append({"role": row["role"] if edit == "K" else name(), "text": row["text"], "edit": edit})
    return out + [{"role": "user" if (at + len(out) + k - odd) % 2 == 0 else "assistant", "text": "", "edit": "I"} for k, _ in enumerate(edits)]


def kept(audit: str) -> int:
    return len(audit) - audit.count("D")


_STATS = ["blank", "duplicate", "truncated", "illegal", "turns"]
_ENDS = [("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first", pa.string()), ("last", pa.string())]
_ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("n", pa.int64())]))
_MESSAGES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))
_PARSED = pa.schema(
    [("kind", pa.string()), ("conv_id", pa.int64()), ("piece", pa.int32()), ("seq", pa.int32()), ("n", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("charts", pa.string())]
    + [(x, pa.int64()) for x in _STATS]
    + _ENDS
    + [("rows", _ROWS), ("messages", _MESSAGES)]
)
PARSED = (
    "kind string, conv_id long, piece int, seq int, n long, cost long, audit string, charts string, blank long, duplicate long, truncated long, illegal long, turns long, "
    "first_turn long, last_turn long, first string, last string, rows array<struct<role string, text string, n long>>, messages array<struct<role string, text string, edit string>>"
)


class _Part:
    """Consecutive rows of one conversation in one task."""

    def __init__(self, conv_id: int | None, piece: int, is_first: bool):
        self.conv_id, self.piece, self.is_first = conv_id, piece, is_first
        self.charts = {i: Chart([i]) for i in ITEMS} if is_first else {None: Chart(START)}
        self.stats = dict.fromkeys(_STATS, 0) | {name: None for name, _ in _ENDS}
        self.rows: list[dict] = []
        self.chars = self.seq = 0

    def row(self, turn: int | None, role: str, text: str, n: int, seen: bool) -> Iterator[dict]:
        """seen: role and text occur in an earlier row. n: copies of the row; the second is a duplicate of the first."""
        s, bare, initial = self.stats, text.strip(BLANK), role[:1]
        blank, cut = not bare, bool(bare) and bare[-1] not in ".!?"
        s["blank"] += n if blank else 0
        s["duplicate"] += 0 if blank else n if seen else n - 1
        s["truncated"] += not blank and not seen and cut
        s["illegal"] += (s["last"] is not None and s["last"] + initial not in LEGAL) + n - 1
        if turn is not None:
            s["turns"] += turn != s["last_turn"]
            s["first_turn"] = turn if s["first_turn"] is None else s["first_turn"]
            s["last_turn"] = turn
        s["first"] = initial if s["first"] is None else s["first"]
        s["last"] = initial
        for chart in self.charts.values():
            if not blank and not seen:
                chart.scan(initial, True, TRUNCATED * cut)
            if (gone := n if blank or seen else n - 1) > 0:
                chart.delete(gone)
        self.rows.append({"role": role, "text": text, "n": n})
        self.chars += len(text)
        if len(self.rows) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS:
            yield self.block()

    def block(self) -> dict:
        out = {"kind": "block", "conv_id": self.conv_id, "piece": self.piece, "seq": self.seq, "n": sum(r["n"] for r in self.rows), "rows": self.rows}
        self.rows, self.chars, self.seq = [], 0, self.seq + 1
        return out

    def close(self, is_last: bool) -> Iterator[dict]:
        if self.is_first or is_last or self.seq:
            if self.rows:
                yield self.block()
            charts = [[item, "".join(c.settled), list(c.column.items())] for item, c in self.charts.items()]
            yield {"kind": "part", "conv_id": self.conv_id, "piece": self.piece, "charts": json.dumps(charts)} | self.stats
        else:
            cost, audit = self.charts[None].best()
            yield {"kind": "whole", "conv_id": self.conv_id, "cost": cost, "audit": audit, "messages": edited(self.rows, audit, kept(audit) % 2 == 1)} | self.stats


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    piece = TaskContext.get().partitionId()
    part: _Part | None = None
    out: list[dict] = []
    for batch in batches:
        for conv_id, turn, role, text, n, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part is None or conv_id != part.conv_id:
                out += part.close(False) if part else ()
                part = _Part(conv_id, piece, part is None)
            out += part.row(turn, role, text, n, seen)
            if len(out) >= 200 or out and out[-1]["kind"] == "block":
                yield pa.RecordBatch.from_pylist(out, _PARSED)
                out = []
    if part:
        out += part.close(True)
        yield pa.RecordBatch.from_pylist(out, _PARSED)


def _parsed(conversations: DataFrame) -> DataFrame:
    """Whole conversations with their repair; of those that go on in other tasks, parts and blocks of rows."""
    runtime.small_batches(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    again = rows.groupBy("conv_id", "role", "text").agg(F.min(place).alias("first"), F.count("*").alias("places")).filter("places > 1").drop("places")
    same = F.col("r.conv_id").eqNullSafe(F.col("a.conv_id")) & (F.col("r.role") == F.col("a.role")) & (F.col("r.text") == F.col("a.text"))
    seen = F.coalesce(F.struct(F.col("r.turn").isNotNull(), F.col("r.turn")) > F.col("a.first"), F.lit(False))
    rows = rows.alias("r").join(again.alias("a"), same, "left").select("r.*", seen.alias("seen"))
    order = ["conv_id", "turn", "role", "text"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream, PARSED)


_SOLVED = "conv_id long, cost long, audit string, blank long, duplicate long, truncated long, illegal long, gaps long, piece int, seq int, segment string, odd boolean, at long"


def _solve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The parts of a conversation in order: its row, and the edits of each of its blocks."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["piece"], r["kind"] == "part", r["seq"] or 0))
    whole = Chart(START)
    stats = dict.fromkeys(_STATS, 0)
    least = last_turn = last = None
    for r in (r for r in rows if r["kind"] == "part"):
        maps = {tuple(item) if item else None: (settled, {tuple(i): (cost, audit) for i, (cost, audit) in column}) for item, settled, column in json.loads(r["charts"])}
        if None in maps:
            whole.settled, (begin, column) = [], maps[None]
            whole.take({i: (cost, begin + audit) for i, (cost, audit) in column.items()})
        else:
            whole.follow(maps)
        for name in _STATS:
            stats[name] += r[name]
        stats["illegal"] += last is not None and last + r["first"] not in LEGAL
        stats["turns"] -= last_turn is not None and last_turn == r["first_turn"]
        least = r["first_turn"] if least is None else least
        last, last_turn = r["last"], last_turn if r["last_turn"] is None else r["last_turn"]
    cost, audit = whole.best()
    odd, at, begin = kept(audit) % 2 == 1, 0, 0
    gaps = last_turn - least + 1 - stats.pop("turns") if least is not None else 0
    stats.pop("turns", None)
    out = [{"conv_id": key[0].as_py(), "cost": cost, "audit": audit, "gaps": gaps} | stats]
    blocks = [r for r in rows if r["kind"] == "block"]
    for nth, r in enumerate(blocks):
        end, left = begin, r["n"]
        while left or nth == len(blocks) - 1 and end < len(audit):
            left -= audit[end] != "I"
            end += 1
        segment = audit[begin:end]
        out.append({"conv_id": key[0].as_py(), "piece": r["piece"], "seq": r["seq"], "segment": segment, "odd": odd, "at": at})
        at, begin = at + kept(segment), end
    return pa.Table.from_pylist(out, pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[f.split()[1]]) for f in _SOLVED.split(", ")]))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("messages", _MESSAGES)])
    for batch in batches:
        for r in batch.to_pylist():
            messages = edited(r["rows"], r["segment"], r["odd"], r["at"])
            yield pa.RecordBatch.from_pylist([{"conv_id": r["conv_id"], "at": r["at"], "messages": messages}], schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages in order of their conversations; a hash goes through one conversation from its begin to its end."""
    now, begun, digest = None, False, hashlib.sha256()
    out = []
    for batch in batches:
        for r in batch.to_pylist():
            if begun and r["conv_id"] != now:
                out.append({"conv_id": now, "repaired_sha256": digest.hexdigest()})
                digest = hashlib.sha256()
            now, begun = r["conv_id"], True
            for k, m in enumerate(r["messages"], r["at"]):
                digest.update((("\n" if k else "") + f"{m['role']}:{m['text']}").encode())
    if begun:
        out.append({"conv_id": now, "repaired_sha256": digest.hexdigest()})
    yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))


def _solutions(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of conversations in parts: their rows, and (conv_id, at, messages) by blocks."""
    heads = parsed.filter("kind <> 'whole'").drop("rows", "messages")
    solved = runtime.written(heads.groupBy("conv_id").applyInArrow(_solve, _SOLVED), "repaired-parts")
    blocks = parsed.filter("kind = 'block'").alias("b").join(solved.filter("piece is not null").alias("s"), F.expr("b.conv_id <=> s.conv_id and b.piece = s.piece and b.seq = s.seq"))
    applied = blocks.select("b.conv_id", "b.rows", "s.segment", "s.odd", "s.at").mapInArrow(_apply, "conv_id long, at long, messages array<struct<role string, text string, edit string>>")
    return solved.filter("piece is null"), applied


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn (nulls first), ties by role and text. A row's first fault counts: blank, duplicate (role and
    text seen earlier), truncated. The audit has K, R, D for each row kept, given another role or deleted, and I for each
    inserted row, in order. repaired_sha256 is that of `role:text` lines.

    Null roles and texts are a space (such a row is blank). A null conv_id is a conversation of its own. Null turns make
    no gaps. Equal rows are duplicates of the first one. An empty table gives an empty result. Other columns are
    ignored, whatever their names.

    A conversation's digest is one hash over its texts in order: for a conversation in parts one task reads them as a
    stream, holding a block at a time (and the audit, a byte a row).
    """
    parsed = runtime.written(_parsed(conversations), "repair")
    rows, applied = _solutions(parsed)
    digests = applied.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_digest, "conv_id long, repaired_sha256 string")
    counts = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    gaps = F.when(F.col("last_turn").isNull(), F.lit(0).cast("long")).otherwise(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"))
    whole = parsed.filter("kind = 'whole'").withColumn("gaps", gaps).select(*counts, F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    parts = rows.alias("r").join(digests.alias("d"), F.expr("r.conv_id <=> d.conv_id")).select(*[f"r.{c}" for c in counts], "d.repaired_sha256")
    return whole.unionByName(parts)


def repaired_messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, edit) of what is left or inserted; cases as in repair()."""
    parsed = runtime.written(_parsed(conversations), "repair")
    whole = parsed.filter("kind = 'whole'").select("conv_id", F.lit(0).cast("long").alias("at"), "messages")
    blocks = whole.unionByName(_solutions(parsed)[1])
    each = blocks.select("conv_id", "at", F.posexplode("messages").alias("k", "m"))
    return each.select("conv_id", (F.col("at") + F.col("k")).alias("position"), "m.role", "m.text", "m.edit")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults planted by the checksum of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes
    its full stops, 3 repeats it, 4 makes it a user's. Nulls are a space."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), given("role").alias("role"), given("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("copy")).drop("copy")
