"""Records of one file, read by many tasks, where a record may hold the character that separates records.

A file is cut into pieces at a character (line ends of delimited text, ``}`` of JSON), and its pieces are dealt to tasks by
byte range, as Spark does with lines. Whether a piece's end is the end of a record depends on all that precedes it: is a
quoted value open, how deep is the nesting. What a range does to that state is a small table, made without knowing the state
it begins in (one row per possible one). The tables of all ranges, a row each, are composed in file order, which gives the
state each range begins in. A second pass cuts records. Those that cross a range border come out as fragments, at most two
for each range, and are put together by a group of their own.

Both passes read the file itself: no text is staged, and none is shuffled but the fragments (and, beyond
``BROADCAST_RANGES`` ranges, the pieces by range). A record is one value of one task; nothing else has to fit into one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import stage

#: Ranges whose states are sent to every task: some 30 MB at most. 200,000 ranges of 128 MB are 25 TB.
BROADCAST_RANGES = 200_000

#: Rows that a pass hands over at once, and characters of them.
_ROWS, _CHARS = 5000, 4 << 20


def pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    """file, block (byte at which its range begins), size (of the file), place (order in the scan), value: the file without its
    ``end`` characters."""
    text = spark.read.option("lineSep", end).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("place"), "value",
    )


def _runs(batches: Iterator[pa.RecordBatch], extra: tuple[str, ...] = ()) -> Iterator[tuple[tuple, pa.Array]]:
    """((file, block, extra...), values) of consecutive pieces of one range; a range may come in several runs."""
    for batch in batches:
        if not len(batch):
            continue
        file, block = batch["file"], batch["block"]
        other = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1]))
        starts = [0, *(k + 1 for k in pc.indices_nonzero(other).to_pylist())]
        for at, stop in zip(starts, [*starts[1:], len(batch)], strict=True):
            yield tuple(batch[c][at].as_py() for c in ("file", "block", *extra)), batch["value"].slice(at, stop - at)


def _chunks(values: pa.Array, end: str) -> Iterator[str]:
    """Consecutive pieces as text, ``end`` behind each; no more of them at once than a task holds with ease."""
    chunk = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False) + 1) // _CHARS
    cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(values)]
    for text in pc.binary_join(pa.ListArray.from_arrays(cuts, values), end):
        yield text.as_py() + end


def _few(rows: DataFrame) -> DataFrame:
    """Rows to join with, one per range or file: sent to every task unless they are many."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_RANGES else rows


def _with_state(found: DataFrame, states: DataFrame) -> DataFrame:
    """Pieces in order, with the state of their range."""
    if states.count() <= BROADCAST_RANGES:
        return found.join(F.broadcast(states), ["file", "block"])
    return found.join(states, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "place")


_ORDER = ("block", "place", "opens")


def whole(parts: DataFrame) -> DataFrame:
    """Fragments (file, block, place, opens, text, ...) put together: a record from each that ``opens`` up to the next one,
    with the other columns of its first. There are at most two fragments for each range."""
    before = Window.partitionBy("file").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    numbered = parts.withColumn("record", F.sum(F.col("opens").cast("int")).over(before))
    bits = F.sort_array(F.collect_list(F.struct(*_ORDER, "text")))
    first = [F.min_by(c, F.struct(*_ORDER)).alias(c) for c in parts.columns if c not in ("file", "text")]
    return numbered.groupBy("file", "record").agg(*first, F.array_join(F.transform(bits, lambda b: b["text"]), "").alias("text")).drop("record")


def _in_file_order(tables: DataFrame) -> DataFrame:
    """One row per range, brought together; the ranges themselves are read by as many tasks as there are."""
    return tables.repartition(1).sortWithinPartitions("file", "block")


def _flush(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


# -- delimited text ---------------------------------------------------------------------------------------------------


def ends_inside(line: str, inside: bool, sep: str, quote: str = '"') -> bool:
    """Whether a quoted value is open at the end of a line, given whether one was at its beginning.

    A quote opens a value only where the value begins; doubled, it stands for itself; behind a closing quote the value runs
    on to the separator.
    """
    at, opening = 0, sep + quote
    if not inside:
        if line.startswith(quote):
            at = 1
        else:
            k = line.find(opening)
            if k < 0:
                return False
            at = k + 2
    while True:
        k = line.find(quote, at)
        if k < 0:
            return True
        if line.startswith(quote, k + 1):
            at = k + 2
            continue
        # closed: the next value that begins with a quote, if any
        k = line.find(opening, k + 1)
        if k < 0:
            return False
        at = k + 2


def _line_states(values: pa.Array, states: tuple[bool, ...], sep: str) -> Iterator[tuple[int, int, tuple[bool, ...]]]:
    """(first line, line behind the last, states before each of them), and at the end the states behind all (no lines)."""
    at = 0
    for k in pc.indices_nonzero(pc.match_substring(values, '"')).to_pylist():
        yield at, k + 1, states
        line = values[k].as_py()
        states, at = tuple(ends_inside(line, s, sep) for s in states), k + 1
    if at < len(values):
        yield at, len(values), states
    yield len(values), len(values), states


def line_states(found: DataFrame, sep: str, header: bool) -> DataFrame:
    """file, block, inside (a quoted value is open where the range begins), first (position of its first record), skip (1 if
    that record is the file's header, which has no position)."""

    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("inside", pa.bool_()), ("first", pa.int64()), ("skip", pa.int32())])

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each range does: from outside (0) and from inside (1), the state behind it and the records that begin in it."""
        now, states, counts = None, (False, True), [0, 0]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": now[0], "block": now[1], **{f"to{s}": states[s] for s in (0, 1)}, **{f"n{s}": counts[s] for s in (0, 1)}}])

        for key, values in _runs(batches):
            if key != now:
                if now:
                    yield row()
                now, states, counts = key, (False, True), [0, 0]
            filled = pc.not_equal(pc.utf8_rtrim(values, "\r"), "")
            for a, b, states in _line_states(values, states, sep):
                some = pc.sum(filled.slice(a, b - a)).as_py() or 0
                for s in (0, 1):
                    counts[s] += 0 if states[s] else some
        if now:
            yield row()

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, inside, position = None, False, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["file"] != file:
                    file, inside, skipped = r["file"], False, not header
                n = r[f"n{int(inside)}"]
                skip = int(n > 0 and not skipped)
                out.append((file, r["block"], inside, position, skip))
                position, skipped = position + n - skip, skipped or n > 0
                inside = r[f"to{int(inside)}"]
            if out:
                yield _flush(out, schema)

    tables = found.select("file", "block", "value").mapInArrow(table, "file string, block bigint, to0 boolean, to1 boolean, n0 bigint, n1 bigint")
    return _in_file_order(tables).mapInArrow(compose, "file string, block bigint, inside boolean, first bigint, skip int")


def cut_lines(found: DataFrame, states: DataFrame, sep: str) -> DataFrame:
    """file, block, place (records that began in the range before it), opens, closed, first, skip, text: records, and
    fragments of those that cross a border (not ``opens``: goes on from the range before; not ``closed``: goes on in the next)."""
    names = ["file", "block", "place", "opens", "closed", "first", "skip", "text"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int32(), pa.string()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, held, opens, place = None, False, [], False, 0
        out: list[tuple] = []
        size = 0

        def emit(closed: bool) -> None:
            nonlocal held, place, size
            text = "\n".join(held) + ("" if closed else "\n")
            if not (opens and closed) or text.rstrip("\r"):
                out.append((now[0], now[1], place, opens, closed, now[3], now[4], text))
                size += len(text)
                place += opens
            held = []

        for key, values in _runs(batches, ("inside", "first", "skip")):
            if now is None or key[:2] != now[:2]:
                if held:
                    emit(not inside)
                now, inside, place = key, key[2], 0
                opens = not inside
            for a, b, (before,) in _line_states(values, (inside,), sep):
                # every line from a to b begins in the state ``before``
                for line in values.slice(a, b - a).to_pylist():
                    if not before and held:
                        emit(True)
                        opens = True
                    held.append(line)
                inside = before
                if len(out) >= _ROWS or size >= _CHARS:
                    yield _flush(out, schema)
                    out, size = [], 0
        if held:
            emit(not inside)
        if out:
            yield _flush(out, schema)

    ready = _with_state(found, states).select("file", "block", "inside", "first", "skip", "value")
    return ready.mapInArrow(run, "file string, block bigint, place bigint, opens boolean, closed boolean, first bigint, skip int, text string")


def text_records(spark: SparkSession, path: str, sep: str, header: bool = True) -> DataFrame:
    """position (in file order, from 0), record: delimited text as records, whatever line ends its quoted values hold.

    The first record of each file is its header and left out; so are empty lines between records.
    """
    found = pieces(spark, path, "\n")
    cut = cut_lines(found, stage(line_states(found, sep, header), "ranges"), sep)
    crossing = whole(cut.filter("NOT (opens AND closed)").drop("closed"))
    names = ["block", "place", "first", "skip", "text"]
    records = cut.filter("opens AND closed").select(*names).unionByName(crossing.select(*names))
    return records.filter("NOT (skip = 1 AND place = 0)").select(
        (F.col("first") + F.col("place") - F.col("skip")).alias("position"), F.col("text").alias("record")
    )


# -- one JSON document ------------------------------------------------------------------------------------------------

_MARK = re.compile(r'"(?:[^"\\]|\\.)*+("?)|[{}\[\]]', re.S)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*+("?)', re.S)
_STRING = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"?', re.S)
_NO_BRACKET = bytes(c for c in range(256) if c not in b"{}[]")
_IS_MARK = np.isin(np.arange(256), list(b'"{}[]'))
#: Pairs of brackets are struck out from within; what is nested deeper than this is counted one by one.
_NESTED = 64
_KEY = re.compile(r'"((?:[^"\\]|\\.)*+)"\s*:\s*\Z', re.S)


class _Scan:
    """State of a document: whether a string is open, and the brackets that are. A range read by itself begins without any;
    ``under`` counts those it closes that were open before it."""

    __slots__ = ("string", "stack", "under")

    def __init__(self, string: bool, stack: str):
        self.string, self.stack, self.under = string, list(stack), 0

    def _close(self) -> None:
        if self.stack:
            self.stack.pop()
        else:
            self.under += 1

    def piece(self, text: str, base: int = 0) -> tuple[int | None, bool, list[str]]:
        """Read a piece and the ``}`` behind it: where a record begins in it, whether one ends with it, and keys of lists
        that begin in it right under a top-level object. Records are ``base`` brackets deep: 1 in an array, 2 in such lists."""
        at, begins, keys, stack = 0, None, [], self.stack
        if self.string:
            end = _STRING_END.match(text)
            at, self.string = end.end(), not end[1]
        if not self.string:
            for mark in _MARK.finditer(text, at):
                c = text[mark.start()]
                if c == '"':
                    self.string = not mark[1]
                elif c in "{[":
                    if len(stack) == base and c == "{" and stack[-1:] == ["["]:
                        begins = mark.start()
                    elif base == 2 and c == "[" and len(stack) == 1:
                        found = _KEY.search(text, 0, mark.start())
                        keys.append(found[1] if found else "")
                    stack.append(c)
                else:
                    self._close()
        inside = self.in_record(base)
        if not self.string:
            self._close()
        return begins, inside and not self.string and len(stack) == base, keys

    def in_record(self, base: int) -> bool:
        return len(self.stack) > base and self.stack[base - 1 : base + 1] == ["[", "{"]

    def pass_over(self, text: str) -> None:
        """Read pieces, each with the ``}`` behind it, for the state behind them only."""
        at = 0
        if self.string:
            end = _STRING_END.match(text)
            at, self.string = end.end(), not end[1]
        if self.string:
            return
        # the quote added closes a string that is open, and the bracket behind it shows that; else both are a string
        marks = _STRING.sub("", text[at:] + '"[').encode().translate(None, _NO_BRACKET)
        if marks.endswith(b"["):
            self.string, marks = True, marks[:-1]
        for _ in range(_NESTED):
            left = len(marks)
            for pair in (b"{}", b"[]", b"{]", b"[}"):
                marks = marks.replace(pair, b"")
            if len(marks) == left:
                break
        for c in marks.decode():
            if c in "{[":
                self.stack.append(c)
            else:
                self._close()

    def events(self, data: bytes, base: int) -> list[tuple[int, int]] | None:
        """Read pieces, each with the ``}`` behind it: (place, kind) where a record begins (0), may end (1), or a list
        of records begins under a top-level object (2), in order. None, and nothing is read, if escapes stand outside of strings."""
        plain = data.replace(b"\\\\", b"..").replace(b'\\"', b"..") if b"\\" in data else data
        here = np.flatnonzero(_IS_MARK[np.frombuffer(plain, np.uint8)])
        c = np.frombuffer(plain, np.uint8)[here]
        inside = (np.cumsum(c == 34) + self.string) % 2 == 1
        if plain is not data:
            escapes = np.flatnonzero(np.frombuffer(data, np.uint8) == 92)
            k = np.searchsorted(here, escapes) - 1
            if not np.where(k < 0, self.string, inside[k]).all():
                return None
        bare = (c != 34) & ~inside
        here, c = here[bare], c[bare]
        opens = (c == 123) | (c == 91)
        depth = len(self.stack) + np.cumsum(np.where(opens, 1, -1))
        if len(depth) and depth[:-1].min(initial=0) < 0:
            return None
        order = np.arange(len(c))

        def around(level: int) -> np.ndarray:
            """For each bracket the one that stands open at this level when it comes (0: none does)."""
            made = np.flatnonzero(opens & (depth == level))
            last = np.searchsorted(made, order) - 1
            held = ord(self.stack[level - 1]) if len(self.stack) >= level else 0
            return np.where(last < 0, held, c[made[last]] if len(made) else 0)

        in_list = around(base) == 91
        begins = (c == 123) & (depth == base + 1) & in_list
        ends = (c == 125) & (depth == base) & in_list & (around(base + 1) == 123)
        lists = (c == 91) & (depth == 2) if base == 2 else np.zeros(len(c), bool)
        told = np.flatnonzero(begins | ends | lists)
        kinds = np.where(begins, 0, np.where(ends, 1, 2))[told]
        found = list(zip(here[told].tolist(), kinds.tolist(), strict=True))
        # the brackets that stay open: the last one made at each level
        final = int(depth[-1]) if len(depth) else len(self.stack)
        lowest = min(len(self.stack), int(depth.min(initial=len(self.stack))))
        stack = self.stack[: max(0, lowest)]
        for level in range(len(stack) + 1, final + 1):
            stack.append(chr(c[np.flatnonzero(opens & (depth == level))[-1]]))
        self.stack = stack
        self.string ^= bool(np.count_nonzero(np.frombuffer(plain, np.uint8) == 34) % 2)
        return found


def document_states(found: DataFrame) -> DataFrame:
    """file, block, string, stack, base: the state in which each range of a JSON file begins."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("string", pa.bool_()), ("stack", pa.string()), ("base", pa.int32())])

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From outside of a string (0) and from inside (1): the state behind the range, brackets it closes and leaves open."""
        now, scans, start, size = None, [], "", 0

        def row() -> pa.RecordBatch:
            one = {"file": now[0], "block": now[1], "start": start, "bytes": size, "size": now[2]}
            for s, scan in enumerate(scans):
                one |= {f"to{s}": scan.string, f"under{s}": scan.under, f"stack{s}": "".join(scan.stack)}
            return pa.RecordBatch.from_pylist([one])

        for key, values in _runs(batches, ("size",)):
            if now is None or key[:2] != now[:2]:
                if now:
                    yield row()
                now, scans, start, size = key, [_Scan(False, ""), _Scan(True, "")], "", 0
            size += len(values) + (pc.sum(pc.binary_length(values)).as_py() or 0)
            for text in _chunks(values, "}"):
                start = start or text.lstrip(_BLANK + "}")[:1]
                for scan in scans:
                    scan.pass_over(text)
        if now:
            yield row()

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, string, stack, base, over, size, read = None, False, "", 0, 0, 0, 0

        def finished() -> None:
            # the scan puts a } behind the last piece, too; the file's size tells whether there is one
            if file is not None and (string or stack or over != read - size):
                raise ValueError(f"not a JSON document: {file} ends inside of a value, or closes more than it opens")

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["file"] != file:
                    finished()
                    file, string, stack, base, over, size, read = r["file"], False, "", {"[": 1, "{": 2}.get(r["start"], 0), 0, r["size"], 0
                    if not base:
                        raise ValueError(f"not a JSON document: {file} begins with {r['start']!r}")
                out.append((file, r["block"], string, stack, base))
                s = int(string)
                string, under, opened, read = r[f"to{s}"], r[f"under{s}"], r[f"stack{s}"], read + r["bytes"]
                over += max(0, under - len(stack))
                stack = stack[: max(0, len(stack) - under)] + opened
            if out:
                yield _flush(out, schema)
        finished()

    ddl = "file string, block bigint, start string, bytes bigint, size bigint, to0 boolean, under0 bigint, stack0 string, to1 boolean, under1 bigint, stack1 string"
    tables = found.select("file", "block", "size", "value").mapInArrow(table, ddl)
    return _in_file_order(tables).mapInArrow(compose, "file string, block bigint, string boolean, stack string, base int")


_BLANK = " \t\r\n\ufeff"


def cut_document(found: DataFrame, states: DataFrame) -> DataFrame:
    """file, block, place, kind, opens, closed, key, text. Kind ``record``: a record or a fragment of one, and the key of its
    list if that began in the range (empty in an array). Kind ``list``: a list begins, with its key."""
    names = ["file", "block", "place", "kind", "opens", "closed", "key", "text"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scan, held, opens, place, label = None, None, None, True, 0, None
        out: list[tuple] = []
        size = 0

        def emit(closed: bool) -> None:
            nonlocal held, place, size
            text = "".join(held)
            out.append((now[0], now[1], place, "record", opens, closed, label, text))
            held, place, size = None, place + 1, size + len(text)

        def begin_list(name: str) -> None:
            nonlocal label, place
            label = name
            out.append((now[0], now[1], place, "list", True, True, name, None))
            place += 1

        def one_by_one(pieces: list[str]) -> None:
            nonlocal held, opens
            for text in pieces:
                begins, ends, lists = scan.piece(text, base)
                for name in lists:
                    begin_list(name)
                if held is None and begins is not None:
                    held, opens, text = [], True, text[begins:]
                if held is not None:
                    held += (text, "}")
                    if ends:
                        emit(True)

        def several(data: bytes, events: list[tuple[int, int]]) -> None:
            nonlocal held, opens
            begun = 0
            for at, kind in events:
                if kind == 2:
                    found = _KEY.search(data[data.rfind(b"}", 0, at) + 1 : at].decode())
                    begin_list(found[1] if found else "")
                elif kind == 0 and held is None:
                    held, opens, begun = [], True, at
                elif kind == 1 and held is not None:
                    held.append(data[begun : at + 1].decode())
                    emit(True)
            if held is not None:
                held.append(data[begun:].decode())

        for key, values in _runs(batches, ("string", "stack", "base")):
            if now is None or key[:2] != now[:2]:
                if held:
                    emit(False)
                now, base, scan, place = key, key[4], _Scan(key[2], key[3]), 0
                label = "" if base == 1 else None
                held, opens = ([], False) if scan.in_record(base) else (None, True)
                if base == 1 and not key[3]:
                    out.append((now[0], now[1], -1, "list", True, True, "", None))
            for text in _chunks(values, "}"):
                data = text.encode()
                events = scan.events(data, base)
                if events is None:
                    one_by_one(text.split("}")[:-1])
                else:
                    several(data, events)
                if len(out) >= _ROWS or size >= _CHARS:
                    yield _flush(out, schema)
                    out, size = [], 0
        if held:
            emit(False)
        if out:
            yield _flush(out, schema)

    ready = _with_state(found, states).select("file", "block", "string", "stack", "base", "value")
    return ready.mapInArrow(run, "file string, block bigint, place bigint, kind string, opens boolean, closed boolean, key string, text string")


def document_records(spark: SparkSession, path: str, wrappers: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """The records (file, text) of files that are one JSON document each, and the files that hold no list of records.

    The records are the objects in a top-level array, or in the list of a top-level object whose key comes first among
    ``wrappers``. What else stands in those lists is left out.
    """
    found = pieces(spark, path, "}")
    states = stage(document_states(found), "ranges")
    cut = stage(cut_document(found, states), "cut-document")
    lists = cut.filter("kind = 'list'").select("file", "block", "place", "key")
    # records whose list began in an earlier range have the key of the last list before them: a row per list and range
    keyless = cut.filter("kind = 'record' AND key IS NULL").select("file", "block", F.lit(-1).cast("bigint").alias("place"), F.lit(None).cast("string").alias("key"))
    before = Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, 0)
    carried = keyless.distinct().unionByName(lists).withColumn("last", F.last("key", ignorenulls=True).over(before))
    carried = carried.filter("key IS NULL").select("file", "block", "last")
    rank = F.array_position(F.array(F.lit(""), *map(F.lit, wrappers)), F.col("key"))
    chosen = lists.withColumn("rank", rank).filter("rank > 0").groupBy("file").agg(F.min_by("key", "rank").alias("chosen"))
    parts = cut.filter("kind = 'record'").drop("kind").join(_few(carried), ["file", "block"], "left")
    parts = parts.withColumn("key", F.coalesce("key", "last")).drop("last")
    crossing = whole(parts.filter("NOT (opens AND closed)").drop("closed"))
    records = parts.filter("opens AND closed").select("file", "key", "text").unionByName(crossing.select("file", "key", "text"))
    records = records.join(_few(chosen), "file").filter(F.col("key") == F.col("chosen")).select("file", "text")
    bare = states.select("file").distinct().join(chosen, "file", "left_anti")
    return records, [r["file"] for r in bare.collect()]
