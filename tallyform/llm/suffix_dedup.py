"""Removal of byte strings that occur more than once, by suffix arrays of shards.

Every byte covered by a ``length``-byte string that also starts anywhere else goes. Equal strings must meet in one shard, so
text is dealt by content: each ``length``-byte window has an anchor, the 32-byte gram in it of least hash (the first of
equals), which depends on the window's bytes alone. Windows that follow each other with one anchor make a stretch. A stretch
whose anchor occurs once in the corpus cannot repeat and goes no further; equal stretches are counted once, with their number.
What is left, distinct stretches that share an anchor, is gathered by anchor into shards of bounded size. A shard's suffix
array is refined by doubling, only unsorted groups being sorted again (Larsson and Sadakane), its common prefixes come from
Kasai's walk, run along all stretches at once, and a window whose neighbour in the array agrees with it for ``length`` bytes
repeats. An anchor with very many stretches is salted over several shards. Such a shard publishes the digests of its distinct
windows as a sorted run, cut at fixed digests into pieces; the pieces of one anchor and range are merged by binary search, so
that windows of different shards meet as well. There are the more ranges the more shards, so what is merged at once is bounded.

Cases: null or empty texts have no bytes and lose none; texts under ``length`` bytes lose none; repeated rows are repeats like
any other, so long ones lose everything; strings that overlap each other in one text count; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyform.llm.shared import mix, row_key, stage, text_passes

LENGTH = 200
GRAM = 32
#: Windows that one numpy pass looks at; a longer text takes several.
SPAN = 1 << 21
#: Stretches of one anchor that a shard takes before the anchor is salted.
PER_SALT = 2000
#: Bytes of a shard's text, beyond which the next anchor begins a new one.
SHARD_BYTES = 1 << 20
#: Ranges of digests for each salt of an anchor.
RANGES = 8

_rng = np.random.Generator(np.random.PCG64(32))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = [int(x) | 1 for x in _rng.integers(1, 2**63, 6, dtype=np.uint64)]
_BASE = int(_rng.integers(1, 2**62)) * 8 + 5
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            factors = np.full(n, base, dtype=np.uint64)
            factors[0] = 1
            _POWERS[i] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def _prefix_hash(data: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return total


def _range_hash(total: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    _, down = _powers(len(total))
    return mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on (places too near the end are left out)."""
    h, width = _BYTE[data], 1
    for step in _STEP[: GRAM.bit_length() - 1]:
        h = h[:-width] * np.uint64(step) + h[width:]
        width *= 2
    return mix(h)


def _leading_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` places that follow each other."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """text, lo, hi (first and last window start, in the text), anchor, content of every stretch of a run of texts."""
    out: list[tuple[np.ndarray, ...]] = []
    mask = np.uint64((1 << 40) - 1 << 24)
    for base in range(0, max(len(data) - length + 1, 0), SPAN):
        part = data[base : base + SPAN + length - 1]
        n = len(part) - length + 1
        grams = _gram_hashes(part)
        key = (grams & mask) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_leading_minimum(key, length - GRAM + 1)[:n] & np.uint64((1 << 24) - 1)).astype(np.int64)
        # A window belongs to the text that it starts in, if it ends there too.
        text = np.searchsorted(offsets, np.arange(base, base + n, 4096), side="right") - 1
        first, last = int(text[0]) if len(text) else 0, int(np.searchsorted(offsets, base + n - 1, side="right")) - 1
        good = np.zeros(n + 1, dtype=np.int8)
        starts = np.clip(offsets[first : last + 1] - base, 0, n)
        ends = np.clip(offsets[first + 1 : last + 2] - length + 1 - base, 0, n)
        some = ends > starts
        np.add.at(good, starts[some], 1)
        np.add.at(good, ends[some], -1)
        valid = np.cumsum(good[:n]) > 0
        new = valid.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        new[np.clip(starts[some], 0, n - 1)] = True
        lo = np.flatnonzero(new & valid)
        if not len(lo):
            continue
        # A stretch ends before the next one, or where its text has no more windows.
        nxt = np.append(lo[1:], n)
        of = np.searchsorted(offsets, lo + base, side="right") - 1
        hi = np.minimum(nxt, offsets[of + 1] - length + 1 - base) - 1
        total = _prefix_hash(part)
        content = mix(_range_hash(total, lo, hi + length) + (anchor[lo] - lo).astype(np.uint64))
        out.append((of, lo + base - offsets[of], hi + base - offsets[of], grams[anchor[lo]].view(np.int64), content.view(np.int64)))
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def anchored(docs: DataFrame, length: int) -> DataFrame:
    """doc (its key), anchor, content, place (first window start and number of windows, as lo << 16 | n) of all stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in text_passes(batch["text"]):
                of, lo, hi, anchor, content = stretches(data, offsets, length)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc"].take(pa.array(of + a)), pa.array(anchor), pa.array(content), pa.array(lo << 16 | (hi - lo + 1))], names=["doc", "anchor", "content", "place"]
                )

    keyed = docs.select(row_key("doc_id", "text").alias("doc"), "text").where(F.octet_length("text") >= length)
    return keyed.mapInArrow(run, "doc long, anchor long, content long, place long")


# -- one shard --------------------------------------------------------------------------------------------------------


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``data`` in order, and the place of each: refinement by doubling, in which only groups that are not yet
    apart are sorted again. Kasai's walk needs them wholly sorted."""
    n = len(data)
    padded = np.zeros(n + 8, dtype=np.uint64)
    padded[:n] = data
    key = padded[:n].copy()
    for k in range(1, 8):
        key = key << np.uint64(8) | padded[k : n + k]
    order = np.argsort(key, kind="stable")
    key = key[order]
    slot = np.arange(n)
    head = np.zeros(n, dtype=bool)
    head[:1] = True
    head[1:] = key[1:] != key[:-1]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(head, slot, 0))
    alone = head & np.append(head[1:], True)
    open_slots = np.flatnonzero(~alone)
    reach = 8
    while len(open_slots):
        some = order[open_slots]
        both = rank[some] << 32 | (rank[np.minimum(some + reach, n)] + 1)
        by = np.argsort(both, kind="stable")
        some, both = some[by], both[by]
        order[open_slots] = some
        new = np.ones(len(some), dtype=bool)
        new[1:] = both[1:] != both[:-1]
        rank[some] = np.maximum.accumulate(np.where(new, open_slots, 0))
        open_slots = open_slots[~(new & np.append(new[1:], True))]
        reach *= 2
    place = np.empty(n, dtype=np.int64)
    place[order] = slot
    return order, place


def common_prefixes(data: np.ndarray, order: np.ndarray, place: np.ndarray, heads: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """Bytes (up to ``depth``) that the suffix in each slot shares with the one before it. Kasai's walk goes along all parts
    (``heads``, ``sizes``) at once: from one place to the next the shared prefix shrinks by one byte at most."""
    n = len(data)
    out = np.zeros(n, dtype=np.int32)
    padded = np.append(data, np.zeros(depth + 1, dtype=np.uint8))
    by = np.argsort(-sizes, kind="stable")
    heads, sizes = heads[by], sizes[by]
    shared = np.zeros(len(heads), dtype=np.int64)
    for t in range(int(sizes.max()) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -t, side="left"))
        at = heads[:live] + t
        slot = place[at]
        before = order[np.maximum(slot - 1, 0)]
        h = np.where(slot > 0, np.maximum(shared[:live] - 1, 0), 0)
        grow = np.flatnonzero((slot > 0) & (h < depth))
        while len(grow):
            g = h[grow]
            same = (padded[at[grow] + g] == padded[before[grow] + g]) & (before[grow] + g < n) & (at[grow] + g < n)
            grow = grow[same]
            h[grow] += 1
            grow = grow[h[grow] < depth]
        shared[:live] = h
        out[slot] = h
    return out


def shard_repeats(texts: list[bytes], counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the distinct ``texts`` of a shard: text, start, whether it repeats, and whether it is the first of its
    equals in suffix order. A text of count over 1 repeats as a whole."""
    sizes = np.array([len(t) for t in texts])
    # 0xFF is in no UTF-8 text: what runs over the end of a text matches no window.
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8)
    heads = np.cumsum(sizes + 1) - sizes - 1
    order, place = suffix_array(data)
    lcp = common_prefixes(data, order, place, heads, sizes - length + 1, length)
    windows = sizes - length + 1
    text = np.repeat(np.arange(len(texts)), windows)
    start = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    slot = place[heads[text] + start]
    as_before = lcp[slot] >= length
    window_at = np.full(len(data) + 1, -1, dtype=np.int64)
    window_at[slot] = np.arange(len(slot))
    after = window_at[np.minimum(slot + 1, len(data))]
    as_after = (after >= 0) & as_before[np.maximum(after, 0)]
    repeats = as_before | as_after | (counts[text] > 1)
    return text, start, repeats, ~as_before


# -- all shards -------------------------------------------------------------------------------------------------------


_RUNS = pa.schema([("doc", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
_PIECES = pa.struct([("w1", pa.list_(pa.int64())), ("w2", pa.list_(pa.int64())), ("doc", pa.list_(pa.int64())), ("lo", pa.list_(pa.int64())), ("single", pa.list_(pa.bool_()))])
_FOUND = pa.schema([*_RUNS, ("anchor", pa.int64()), ("range", pa.int32()), ("piece", _PIECES)])
_FOUND_DDL = "doc long, lo long, hi long, anchor long, `range` int, piece struct<w1:array<long>,w2:array<long>,doc:array<long>,lo:array<long>,single:array<boolean>>"


def _solved(rows: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    """Runs, and pieces of sorted digests, of a shard's (anchor, salts, doc, lo, count, bytes)."""
    texts, counts = [r[5] for r in rows], np.array([r[4] for r in rows])
    anchors, salts, docs, los = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(4))
    text, start, repeats, first = shard_repeats(texts, counts, length)
    hit = repeats & (counts[text] == 1)
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    # a run that goes on from the last window of one text to the first of the next is two runs
    marks = np.flatnonzero((start == 0) & hit & np.append(False, hit[:-1]))
    begin, end = np.union1d(begin, marks), np.union1d(end, marks - 1)
    own = text[begin]
    empty = [pa.nulls(len(own), f.type) for f in list(_FOUND)[3:]]
    yield pa.RecordBatch.from_arrays([pa.array(docs[own]), pa.array(los[own] + start[begin]), pa.array(los[own] + start[end]), *empty], schema=_FOUND)
    some = np.flatnonzero((salts[text] > 1) & first)
    if not len(some):
        return
    data = np.frombuffer(b"\xff".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    at = (np.cumsum(sizes) - sizes)[text[some]] + start[some]
    w1, w2 = (_range_hash(_prefix_hash(d), at, at + length) for d in (data, _SECOND[data]))
    own = text[some]
    part = ((w1 >> np.uint64(40)).astype(np.int64) * (salts[own] * RANGES)) >> 24
    by = np.lexsort((w2, w1, part, anchors[own]))
    some, own, part, w1, w2 = some[by], own[by], part[by], w1[by], w2[by]
    heads = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (anchors[own][1:] != anchors[own][:-1])))
    edges = pa.array(np.append(heads, len(some)), pa.int32())
    lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (w1.view(np.int64), w2.view(np.int64), docs[own], los[own] + start[some], ~repeats[some])]
    none = pa.nulls(len(heads), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [none, none, none, pa.array(anchors[own][heads]), pa.array(part[heads], pa.int32()), pa.StructArray.from_arrays(lists, names=[f.name for f in _PIECES])], schema=_FOUND
    )


def _shards(work: DataFrame, length: int) -> DataFrame:
    """Rows of two kinds from (anchor, salt, salts, doc, lo, count, bytes): runs of repeating windows of stretches that do not
    repeat as a whole (doc, lo, hi), and for salted anchors pieces of sorted digests (anchor, range, piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, now = 0, None
        for batch in batches:
            for key in zip(*(batch[c].to_pylist() for c in ("anchor", "salt", "salts", "doc", "lo", "count", "bytes")), strict=True):
                if held >= SHARD_BYTES and key[:2] != now:
                    yield from _solved(rows, length)
                    rows, held = [], 0
                now = key[:2]
                rows.append((key[0], *key[2:]))
                held += len(key[6])
        if rows:
            yield from _solved(rows, length)

    dealt = work.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    return dealt.mapInArrow(run, _FOUND_DDL)


_SECOND = np.random.Generator(np.random.PCG64(33)).permutation(256).astype(np.uint8)


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Of sorted runs of digests (w1, w2), which ones are in another run as well: each run is looked up in the others by
    binary search."""
    kind = np.dtype([("w1", "<i8"), ("w2", "<i8")])
    whole = []
    for w1, w2 in runs:
        one = np.empty(len(w1), dtype=kind)
        one["w1"], one["w2"] = w1, w2
        whole.append(one)
    every = np.sort(np.concatenate(whole), order=("w1", "w2"))
    w1 = every["w1"]
    out = []
    for one in whole:
        left, right = np.searchsorted(w1, one["w1"], "left"), np.searchsorted(w1, one["w1"], "right")
        many = np.zeros(len(one), dtype=bool)
        for i in np.flatnonzero(right - left > 1):
            many[i] = int((every["w2"][left[i] : right[i]] == one["w2"][i]).sum()) > 1
        out.append(many)
    return out


def _merged(pieces: DataFrame) -> DataFrame:
    """doc, lo, hi: windows that are single in their shard and occur in another one."""

    def solve(held: list[dict]) -> pa.RecordBatch:
        docs, los = [], []
        for piece, many in zip(held, merge_runs([(np.array(p["w1"]), np.array(p["w2"])) for p in held]), strict=True):
            hit = many & np.array(piece["single"], dtype=bool)
            docs.append(np.array(piece["doc"], dtype=np.int64)[hit])
            los.append(np.array(piece["lo"], dtype=np.int64)[hit])
        lo = pa.array(np.concatenate(los))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), lo, lo], schema=_RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for k in range(len(batch)):
                key = (batch["anchor"][k].as_py(), batch["range"][k].as_py())
                if key != now and held:
                    yield solve(held)
                    held = []
                now = key
                held.append(batch["piece"][k].as_py())
        if held:
            yield solve(held)

    return pieces.repartition("anchor", "range").sortWithinPartitions("anchor", "range").mapInArrow(run, "doc long, lo long, hi long")


def _cut_out(docs: DataFrame, work: DataFrame, length: int) -> DataFrame:
    """``work`` (anchor, content, salt, salts, doc, place, count) with lo and the bytes of its stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for text, items, doc in zip(part["text"].to_pylist(), part["items"].to_pylist(), part["doc"].to_pylist(), strict=True):
                    raw = text.encode()
                    for item in items:
                        lo, n = item["place"] >> 16, item["place"] & 0xFFFF
                        rows.append((item["anchor"], item["salt"], item["salts"], doc, lo, item["count"], raw[lo : lo + n - 1 + length]))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 7
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "salt", "salts", "doc", "lo", "count", "bytes"])

    wanted = work.groupBy("doc").agg(F.collect_list(F.struct("anchor", "salt", "salts", "place", "count")).alias("items"))
    keyed = docs.select(row_key("doc_id", "text").alias("doc"), "text").where(F.octet_length("text") >= length)
    # rows with one key are one text: one of them is enough to cut from
    return keyed.join(wanted, "doc").dropDuplicates(["doc"]).mapInArrow(run, "anchor long, salt int, salts int, doc long, lo long, count long, bytes binary")


def repeated_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc (row_key of its id and text), runs array<bigint>: window starts that repeat, as lo << 32 | hi, both included."""
    every = anchored(docs, length)
    often = every.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    held = stage(every.join(often, "anchor", "left_semi"), "suffix-stretches")
    kinds = stage(held.groupBy("anchor", "content").agg(F.count("*").alias("count"), F.first("doc").alias("doc"), F.first("place").alias("place")), "suffix-kinds")
    whole = held.join(kinds.where("count > 1").select("anchor", "content"), ["anchor", "content"], "left_semi")
    lo, n = F.shiftright("place", 16), F.col("place").bitwiseAND(0xFFFF)
    runs = whole.select("doc", lo.alias("lo"), (lo + n - 1).alias("hi"))
    groups = kinds.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").withColumn("salts", F.ceil(F.col("k") / PER_SALT).cast("int"))
    work = kinds.join(groups, "anchor").select("anchor", F.pmod("content", F.col("salts")).cast("int").alias("salt"), "salts", "doc", "place", "count")
    found = stage(_shards(_cut_out(docs, work, length), length), "suffix-found")
    runs = runs.unionAll(found.where("piece is null").select("doc", "lo", "hi")).unionAll(_merged(found.where("piece is not null").select("anchor", "range", "piece")))
    return runs.groupBy("doc").agg(F.collect_list(F.shiftleft("lo", 32).bitwiseOR(F.col("hi"))).alias("runs"))


def _spans(runs: np.ndarray, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte ranges that the windows of ``runs`` cover."""
    runs = np.sort(runs)
    lo, stop = runs >> 32, np.maximum.accumulate((runs & 0xFFFFFFFF) + length)
    new = np.append(True, lo[1:] > stop[:-1])
    begin = lo[new]
    end = np.append(stop[:-1][new[1:]], stop[-1:])
    return begin, np.minimum(end, size)


def _removed(docs: DataFrame, length: int) -> DataFrame:
    runs = repeated_runs(docs, length).withColumnRenamed("doc", "__doc")
    keyed = docs.withColumn("__key", row_key("doc_id", "text"))
    return keyed.join(runs, keyed["__key"] == runs["__doc"], "left").drop("__key", "__doc").withColumnRenamed("runs", "__runs")


def removal_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, runs in zip(batch["text"], batch["__runs"], strict=True):
                raw = (text.as_py() or "").encode()
                digest, gone, spans, at = hashlib.sha256(), 0, 0, 0
                if runs.is_valid:
                    begin, end = _spans(runs.values.to_numpy(), len(raw), length)
                    spans, gone = len(begin), int((end - begin).sum())
                    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                        digest.update(raw[at:a])
                        at = b
                digest.update(raw[at:])
                rows.append((len(raw), gone, spans, digest.hexdigest()))
            n, gone, spans, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _removed(docs.select("doc_id", "text"), length).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text`` (and ``n_chars``, where it is a column, counted anew). Cuts move to
    the nearest character boundary that keeps the cut character."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, runs in zip(batch["text"], batch["__runs"], strict=True):
                whole = text.as_py()
                if runs.is_valid:
                    raw = whole.encode()
                    begin, end = _spans(runs.values.to_numpy(), len(raw), length)
                    parts, at = [], 0
                    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                        while a < b and raw[a] & 0xC0 == 0x80:
                            a += 1
                        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                            b -= 1
                        parts.append(raw[at:a])
                        at = b
                    whole = b"".join([*parts, raw[at:]]).decode()
                texts.append(whole)
            columns = []
            for name in names:
                if name == "text":
                    columns.append(pa.array(texts, pa.string()))
                elif name == "n_chars":
                    columns.append(pa.array([None if t is None else len(t) for t in texts]).cast(batch["n_chars"].type))
                else:
                    columns.append(batch[name])
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _removed(docs, length).mapInArrow(run, docs.schema)
