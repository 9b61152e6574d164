"""Repair of the turn structure of conversations.

The roles of a conversation should read ``(s?(ua)+)?``: an optional system turn, then user and assistant in turn. Its turns
are aligned by Wagner-Fischer to each feasible length of that alternating string. Keeping a turn costs 0, another role 3,
deleting 4 (blank turns and duplicates must go), an empty turn put in 3, and a truncated turn that stays 3 more. A simple
alignment on the diagonal gives the incumbent cost; only lengths and cells that can still match it are looked at (Ukkonen's
band). Strings that end alike are suffixes of one another, so one table of costs from each cell to the end serves every
length. Each length of least cost is traced, and the least of the audits (one letter per edit: D, I, K, R) wins.

A conversation may hold any share of all turns, so turns are sorted over all tasks and aligned in blocks of at most 32
distinct turns, once for each state the string may be in before and after the block. A block never ends with an insertion,
so that of its audits none begins another one, and the cheapest chain of blocks with the least audit is found from the
blocks' costs and the order of their audits alone: 32 numbers for each block, which is all that meets in one task. Blocks
are then repaired where they are. Only the digest of a whole conversation reads its repaired blocks in order, as a stream.

Cases: null roles and texts are one space; turns are ordered by turn (null first), then role and text; repeated rows are
duplicates of the first; a null conv_id is a conversation of its own; a role whose first letter is not s, u or a never fits;
an empty table gives no row. Other columns are not looked at. Equal rows are counted before they meet in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyform.llm.shared import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
WHITE = " \t\n\x0b\f\r"
BLOCK_ROWS, BLOCK_BYTES = 32, 1 << 20
INF = 1 << 60

#: States of the string so far: nothing, the system turn, a user turn last, an assistant turn last.
START, SYSTEM, USER, ASSISTANT = range(4)
_ROLE = ("user", "user", "assistant", "user")
_AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: What is still to be put in at the end of a conversation.
_CLOSING = ("", "II", "I", "")


def _least(rows_over: int) -> int:
    """Cost at least, where so many more rows than symbols are left (fewer, if negative)."""
    return DELETE * rows_over if rows_over > 0 else -INSERT * rows_over


class Block:
    """Alignments of a run of turns: (first letter of the role, must go, truncated, copies) each."""

    def __init__(self, rows: list[tuple[str, bool, bool, int]]):
        self.rows = rows
        self.fixed = DELETE * sum(copies - 1 for *_, copies in rows)
        self.tables: dict[int, tuple[int, list[dict[int, int]]]] = {}

    @staticmethod
    def symbol(end: int, left: int) -> str:
        """The symbol with which ``left`` symbols begin that end with a user's (USER) or an assistant's (ASSISTANT)."""
        return "u" if (left % 2 == 1) == (end == USER) else "a"

    def lengths(self, start: int, end: int) -> range:
        """Feasible numbers of user and assistant symbols between two states."""
        odd = (start == USER) == (end == ASSISTANT)
        least = 1 if odd else 0 if start == end else 2
        return range(least, 3 * len(self.rows) + 4, 2)

    def _turn(self, row: tuple, symbol: str) -> int:
        return (TRUNCATED if row[2] else 0) + (KEEP if row[0] == symbol else REROLE)

    def incumbent(self, start: int, end: int) -> int:
        """Cost of keeping every turn that may stay, in its place or with another role, behind as few insertions as fit."""
        stay = [row for row in self.rows if not row[1]]
        n = next(n for n in self.lengths(start, end) if n >= len(stay))
        cost = INSERT * (n - len(stay)) + DELETE * (len(self.rows) - len(stay))
        return cost + sum(self._turn(row, self.symbol(end, len(stay) - k)) for k, row in enumerate(stay))

    def table(self, end: int, bound: int) -> list[dict[int, int]]:
        """table[i][k]: least cost of rows i and later against the last k symbols, the last edit being that of a row. Only
        cells from which ``bound`` can be met."""
        known = self.tables.get(end)
        if known and known[0] >= bound:
            return known[1]
        rows, n = self.rows, len(self.rows)
        table: list[dict[int, int]] = [{} for _ in range(n + 1)]
        table[n][0] = 0
        for i in range(n - 1, -1, -1):
            here, below, left, row = table[i], table[i + 1], n - i, rows[i]
            match = (TRUNCATED if row[2] else 0) + KEEP
            for k in range(max(0, left - bound // DELETE), left + bound // INSERT + 1):
                best = below.get(k, INF) + DELETE
                if k:
                    best = min(best, here.get(k - 1, INF) + INSERT)
                    if not row[1]:
                        best = min(best, below.get(k - 1, INF) + match + (0 if row[0] == self.symbol(end, k) else REROLE))
                if best < INF:
                    here[k] = best
        self.tables[end] = (bound, table)
        return table

    def trace(self, end: int, bound: int, i: int, k: int) -> str:
        """The least audit of the cheapest alignments of rows i and later with the last k symbols."""
        table, out = self.table(end, bound), []
        while i < len(self.rows):
            now, row = table[i][k], self.rows[i]
            if now == table[i + 1].get(k, INF) + DELETE:
                out.append("D")
                i += 1
            elif k and now == table[i].get(k - 1, INF) + INSERT:
                out.append("I")
                k -= 1
            else:
                out.append("K" if row[0] == self.symbol(end, k) else "R")
                i, k = i + 1, k - 1
        return "".join(out)

    def best(self, start: int, end: int) -> tuple[int, str] | None:
        """Cheapest alignment between two states and its least audit."""
        n = len(self.rows)
        if end == START:
            return (self.fixed + DELETE * n, "D" * n) if start == START else None
        if end == SYSTEM:
            if start == SYSTEM:
                return self.fixed + DELETE * n, "D" * n
            kept = [((TRUNCATED if r[2] else 0), -i) for i, r in enumerate(self.rows) if r[0] == "s" and not r[1]]
            if start != START or not kept:
                return None
            cost, i = min(kept)
            return self.fixed + DELETE * (n - 1) + KEEP + cost, "D" * -i + "K" + "D" * (n + i - 1)
        bound = self.incumbent(start, end)
        table = self.table(end, bound)
        found: list[tuple[int, int, int]] = []
        for k in self.lengths(start, end):
            if min(_least(n - k), _least(n - k - (start == START))) > bound:
                continue
            found.append((table[0].get(k, INF), 0, k))
            if start == START:
                # the system turn is kept, and all before it deleted
                for i, row in enumerate(self.rows):
                    if row[0] == "s" and not row[1]:
                        cost = DELETE * i + (TRUNCATED if row[2] else 0) + KEEP + table[i + 1].get(k, INF)
                        found.append((cost, i + 1, k))
        least = min(cost for cost, _, _ in found)
        audits = ["D" * (i - 1) + "K" * (i > 0) + self.trace(end, bound, i, k) for cost, i, k in found if cost == least]
        return self.fixed + least, min(audits)

    def solve(self, starts: tuple[int, ...]) -> tuple[list[int], list[int], list[str]]:
        """Cost, rank among the audits from the same state, and audit, for each state before (4) and after (4)."""
        costs, ranks, audits = [INF] * 16, [0] * 16, [""] * 16
        for start in starts:
            found = [(x, end) for end in range(4) if (x := self.best(start, end))]
            for rank, ((cost, audit), end) in enumerate(sorted(found, key=lambda x: x[0][1])):
                costs[4 * start + end], ranks[4 * start + end], audits[4 * start + end] = cost, rank, audit
        return costs, ranks, audits


def chain(costs: np.ndarray, ranks: np.ndarray) -> tuple[int, list[int]]:
    """Least cost of blocks one behind the other (costs and ranks: blocks x 4 x 4), and the state after each block."""
    closing = np.array([INSERT * len(c) for c in _CLOSING], dtype=np.int64)
    togo = np.zeros((len(costs) + 1, 4), dtype=np.int64)
    togo[-1] = closing
    for k in range(len(costs) - 1, -1, -1):
        togo[k] = np.minimum((costs[k] + togo[k + 1]).min(axis=1), INF)
    states, now = [], START
    for k in range(len(costs)):
        total = costs[k, now] + togo[k + 1]
        now = int(np.where(total == total.min(), ranks[k, now], 99).argmin())
        states.append(now)
    return int(togo[0, START]), states


def render(audit: str, start: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts that an audit (a letter per insertion or distinct turn) leaves."""
    at, state, out_roles, out_texts = 0, start, [], []
    for edit in audit:
        if edit in "RI":
            out_roles.append(_ROLE[state])
            out_texts.append("" if edit == "I" else texts[at])
        elif edit == "K":
            out_roles.append(roles[at])
            out_texts.append(texts[at])
        if edit != "D":
            state = _AFTER[out_roles[-1][0]]
        at += edit != "I"
    return out_roles, out_texts


def inspect(turns: DataFrame) -> DataFrame:
    """Distinct turns (conv_id, turn, role, text) with copies, blank, first (none like it before) and cut (truncated)."""
    said = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    rows = said.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("digest", F.sha2("text", 256))
    same = said.groupBy("conv_id", "role", F.sha2("text", 256).alias("digest"))
    first = same.agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))).alias("x"))
    first = first.select(
        F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest"),
        F.col("x.turn").alias("f_turn"), F.lit(True).alias("first"),
    )
    # each key is there once on both sides: the turn is part of it
    on = (
        F.col("conv_id").eqNullSafe(F.col("f_conv")) & F.col("turn").eqNullSafe(F.col("f_turn"))
        & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest"))
    )
    end = F.rtrim("text", F.lit(WHITE))
    return rows.join(first, on, "left").select(
        "conv_id", "turn", "role", "text", "copies", (end == "").alias("blank"),
        F.coalesce("first", F.lit(False)).alias("first"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )


_REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
_COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
_LEGAL = ("su", "ua", "au")


def _block(conv_id, number: int, rows: list[dict], starts: tuple[int, ...]) -> dict:
    initials = [r["role"][:1] for r in rows]
    go = [r["blank"] or not r["first"] for r in rows]
    cut = [not g and r["cut"] for r, g in zip(rows, go, strict=True)]
    costs, ranks, audits = Block([(i, g, c, r["copies"]) for i, g, c, r in zip(initials, go, cut, rows, strict=True)]).solve(starts)
    known = [r["turn"] for r in rows if r["turn"] is not None]
    return {
        "conv_id": conv_id, "block": number, "costs": costs, "ranks": ranks, "audits": audits,
        "roles": [r["role"] for r in rows], "texts": [r["text"] for r in rows], "copies": [r["copies"] for r in rows],
        "blank": sum(r["copies"] for r in rows if r["blank"]),
        "duplicate": sum(r["copies"] - (1 if r["first"] else 0) for r in rows if not r["blank"]),
        "truncated": sum(cut),
        "illegal": sum(r["copies"] - 1 for r in rows) + sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        "turns": len(set(known)), "low": known[0] if known else None, "high": known[-1] if known else None,
        "head": initials[0], "tail": initials[-1],
    }


def align(turns: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of turns in order, with the alignments of each: written once, since two passes read them."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    order = turns.schema["turn"].dataType.simpleString()
    ddl = (
        f"conv_id {kind}, block bigint, costs array<bigint>, ranks array<int>, audits array<string>, roles array<string>, texts array<string>, "
        f"copies array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low {order}, high {order}, head string, tail string"
    )
    names = [f.split()[0] for f in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        types: dict[str, pa.DataType] = {}
        now, rows, size, seen, sure = None, [], 0, False, False
        done: list[dict] = []
        weight = 0

        def close() -> None:
            nonlocal number, rows, size, sure, weight
            # the conversation of a task's first rows may have begun in another task
            done.append(_block(now, number, rows, (START,) if sure else (START, SYSTEM, USER, ASSISTANT)))
            number, rows, weight, size, sure = number + 1, [], weight + size, 0, False

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], types[c]) for c in names], names=names)

        for batch in batches:
            if not types:
                ints, strings = pa.list_(pa.int64()), pa.list_(pa.string())
                types = {c: pa.int64() for c in names} | {"costs": ints, "copies": ints, "ranks": pa.list_(pa.int32())}
                types |= {"audits": strings, "roles": strings, "texts": strings, "head": pa.string(), "tail": pa.string()}
                types |= {"conv_id": batch["conv_id"].type, "low": batch["turn"].type, "high": batch["turn"].type}
            for row in batch.to_pylist():
                if not seen or row["conv_id"] != now:
                    if rows:
                        close()
                    sure, now, seen = seen, row["conv_id"], True
                rows.append(row)
                size += len(row["text"])
                if len(rows) >= block_rows or size >= block_bytes:
                    close()
            if weight > 4 * BLOCK_BYTES or len(done) > 2000:
                yield batch_of()
                done, weight = [], 0
        if rows:
            close()
        if done:
            yield batch_of()

    # texts are compared in full inside a task; their beginnings are enough to deal turns out
    keys: list[Column] = [F.col("conv_id"), F.col("turn"), F.col("role")]
    placed = inspect(turns).repartitionByRange(*keys, F.substring("text", 1, 32)).sortWithinPartitions(*keys, "text")
    return stage(placed.mapInArrow(run, ddl), "aligned-blocks")


def choose(blocks: DataFrame) -> DataFrame:
    """For each block the states before and after it in the cheapest chain, and for a conversation's last its report."""
    numbers = ["block", "costs", "ranks", *_COUNTS, "low", "high", "head", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def close() -> None:
            # rows are kept as arrays: a conversation of many blocks takes 200 bytes for each
            cost, states = chain(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            total = dict.fromkeys(_COUNTS, 0)
            low = high = last = None
            for _, _, rows in held:
                for r in rows:
                    for c in _COUNTS:
                        total[c] += r[c]
                    if last is not None:
                        total["illegal"] += last["tail"] + r["head"] not in _LEGAL
                    if r["low"] is not None:
                        low, total["turns"] = r["low"] if low is None else low, total["turns"] - (high == r["low"])
                        high = r["high"]
                    last = r
            gaps = 0 if low is None else high - low + 1 - total["turns"]
            report = {"gaps": gaps, **{c: total[c] for c in _COUNTS[:-1]}, "cost": cost}
            numbers_of = [r["block"] for _, _, rows in held for r in rows]
            before = [START, *states[:-1]]
            out.extend(
                {"block": b, "before": p, "after": q, "report": report if k + 1 == len(states) else None}
                for k, (b, p, q) in enumerate(zip(numbers_of, before, states, strict=True))
            )

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, schema)

        fields = [(f.split()[0], pa.int64()) for f in _REPORT.split(", ")]
        schema = pa.schema([("block", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("report", pa.struct(fields))])
        small = [c for c in numbers if c not in ("costs", "ranks")]
        for batch in batches:
            costs = np.asarray(batch["costs"].flatten(), dtype=np.int64).reshape(-1, 4, 4)
            ranks = np.asarray(batch["ranks"].flatten(), dtype=np.int8).reshape(-1, 4, 4)
            ids, rows = batch["conv_id"].to_pylist(), batch.select(small).to_pylist()
            edges = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if held and ids[a] != now:
                    close()
                    held = []
                now = ids[a]
                held.append((costs[a:b].copy(), ranks[a:b].copy(), rows[a:b]))
            if len(out) > 10_000:
                yield batch_of()
                out = []
        if held:
            close()
        if out:
            yield batch_of()

    placed = blocks.select("conv_id", *numbers).repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return placed.mapInArrow(run, f"block bigint, before int, after int, report struct<{', '.join(f.replace(' ', ':') for f in _REPORT.split(', '))}>")


def repair(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, block (in order), audit, roles and texts of the turns after repair; the last block of a conversation has
    its report (gaps, blank, duplicate, truncated, illegal, cost), others null."""
    blocks = align(turns, block_rows)
    kind = turns.schema["conv_id"].dataType.simpleString()
    report = "struct<" + ", ".join(f.replace(" ", ":") for f in _REPORT.split(", ")) + ">"
    names = ["conv_id", "block", "audit", "roles", "texts", "report"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            parts = [batch[c].to_pylist() for c in ("audit", "before", "after", "roles", "texts", "copies")]
            for audit, before, after, roles, texts, copies, last in zip(*parts, batch["report"].is_valid().to_pylist(), strict=True):
                new_roles, new_texts = render(audit, before, roles, texts)
                shown, more = [], iter(copies)
                for edit in audit:
                    shown.append(edit if edit == "I" else edit + "D" * (next(more) - 1))
                if last:
                    shown.append(_CLOSING[after])
                    for _ in _CLOSING[after]:
                        new_roles.append(_ROLE[after])
                        new_texts.append("")
                        after = _AFTER[new_roles[-1][0]]
                for column, value in zip(out, ("".join(shown), new_roles, new_texts), strict=True):
                    column.append(value)
            strings = pa.list_(pa.string())
            made = [pa.array(out[0], pa.string()), pa.array(out[1], strings), pa.array(out[2], strings)]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["block"], *made, batch["report"]], names=names)

    kept = blocks.select("conv_id", "block", "audits", "roles", "texts", "copies").join(choose(blocks), "block")
    audit = F.element_at("audits", 4 * F.col("before") + F.col("after") + 1)
    kept = kept.select("conv_id", "block", audit.alias("audit"), "before", "after", "roles", "texts", "copies", "report")
    return kept.mapInArrow(run, f"conv_id {kind}, block bigint, audit string, roles array<string>, texts array<string>, report {report}")


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """conv_id, block, place (in the block), role, text: a row for each turn after repair."""
    both = F.arrays_zip(F.col("roles").alias("role"), F.col("texts").alias("text"))
    return repaired.select("conv_id", "block", F.posexplode(both).alias("place", "x")).select("conv_id", "block", "place", "x.role", "x.text")


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, the report's columns, audit, repaired_sha256 (``role:text`` of every turn, joined by newlines)."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    numbers = [f.split()[0] for f in _REPORT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, lines, audit, out = hashlib.sha256(), 0, [], []
        types = None
        for batch in batches:
            types = types or [batch["conv_id"].type, *[pa.int64()] * len(numbers), pa.string(), pa.string()]
            columns = [batch[c].to_pylist() for c in ("conv_id", "audit", "roles", "texts", "report")]
            for conv_id, edits, roles, texts, report in zip(*columns, strict=True):
                audit.append(edits)
                for role, text in zip(roles, texts, strict=True):
                    digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                    lines += 1
                if report:
                    out.append((conv_id, *(report[c] for c in numbers), "".join(audit), digest.hexdigest()))
                    digest, lines, audit = hashlib.sha256(), 0, []
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    names = ["conv_id", *numbers, "audit", "repaired_sha256"]
    placed = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return placed.mapInArrow(run, f"conv_id {kind}, {_REPORT}, audit string, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Turns with faults put in by a checksum of conversation and turn: dropped, emptied, without stops, repeated, as user."""
    text = F.coalesce("text", F.lit(" "))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(name.cast("binary")) % 20
    said = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return conversations.filter(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"), said.alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Every conversation, damaged and repaired: the report's columns, audit, repaired_sha256. One with no turn left has
    zeros, an empty audit and the digest of the empty text."""
    done = digests(repair(damage(conversations)))
    every = conversations.select(F.col("conv_id").alias("id")).distinct()
    filled = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in (f.split()[0] for f in _REPORT.split(", "))}
    nothing = hashlib.sha256().hexdigest()
    return every.join(done, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *filled.values(), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
