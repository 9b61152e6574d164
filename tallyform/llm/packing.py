"""Harmonic packing of tokenised documents into training sequences.

Lengths fall into reciprocal-capacity classes: a bin of class j takes exactly j pieces, each of a j-th of the capacity. A
document gives a piece of class 1 (a whole sequence) for every full capacity; what is left goes to class j, j being the
least number whose j-th part of the capacity still fits in it, and what is then left likewise. A rest of at most
1 / ``classes`` of the capacity goes to the class of rests, which is filled one behind the other and cut where a bin is full.
The j places of a bin differ by a token at most and add up to the capacity, so full bins have no padding.

Every task packs its own documents and needs no other. At its end the pieces of its open bins (fewer than ``classes``
squared) are laid one behind the other into full sequences; the last one is cut at powers of two, which need no padding.
A sequence id is the task's number and a count inside it, so a task that is repeated gives the same rows.

Ids are those of the ``tokenizers`` library. Text is lower-cased and split where that library's own pattern always
splits (white space, and between an ASCII letter and another ASCII character but the apostrophe), each distinct part is
encoded once, and a worker remembers them. Strings of control tokens in a text are ordinary text.

Cases: null and empty texts give the end id alone; repeated rows and ids are documents of their own; an empty table gives
no sequence. Other columns are not looked at.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyform.llm.shared import LOWER, grown, text_passes

CAPACITY, CLASSES = 4096, 8

#: Distinct parts that a worker remembers; beyond, it begins anew. Results do not depend on it.
REMEMBERED = 800_000

_SPACE, _LETTER, _OTHER, _GLUE = range(4)
_KIND = np.full(256, _GLUE, dtype=np.uint8)
_KIND[:128] = _OTHER
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = _LETTER
_KIND[ord("'")] = _GLUE

#: Whether a part begins between bytes of two kinds (first kind * 4 + second).
_SPLITS = np.zeros(16, dtype=bool)
_SPLITS[[_SPACE * 4 + k for k in range(4)] + [_LETTER * 4 + _OTHER, _OTHER * 4 + _LETTER]] = True

#: Letters of one code point that nothing composes with inside a run of them, and their lower case.
_LATIN = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
_WORD = re.compile(f"[{_LATIN}]+")


class Encoder:
    """Ids of texts, part by distinct part."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelled = {ord(c): spell(c)[0][0] for c in _LATIN if c == c.lower()}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.sizes = np.zeros(1 << 20, dtype=np.uint32), np.zeros(1 << 18, dtype=np.int64)
        self.begin, self.used = np.zeros(1 << 18, dtype=np.int64), 0

    def _learn(self, new: list[str]) -> None:
        one, spelled, word = self.tokenizer.model.tokenize, self.spelled, _WORD.fullmatch
        # a run of letters that have one form only is one word of the model; anything else takes the library's whole way
        found = [[t.id for t in one(p.lower().translate(spelled))] if word(p) else None for p in new]
        rest = [k for k, ids in enumerate(found) if ids is None]
        for k, coded in zip(rest, self.tokenizer.encode_batch_fast([new[k] for k in rest], add_special_tokens=False), strict=True):
            found[k] = coded.ids
        k, size = len(self.known), np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        more = int(size.sum())
        self.flat = grown(self.flat, self.used + more)
        self.begin, self.sizes = grown(self.begin, k + len(new)), grown(self.sizes, k + len(new))
        self.flat[self.used : self.used + more] = np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=more)
        self.begin[k : k + len(new)] = self.used + np.cumsum(size) - size
        self.sizes[k : k + len(new)] = size
        self.used += more
        self.known.update(zip(new, range(k, k + len(new)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of texts, and where each text's ids begin (one entry more)."""
        kind = _KIND[data]
        inside = kind != _SPACE
        starts = inside.copy()
        starts[1:] &= _SPLITS[kind[:-1] * 4 + kind[1:]]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        starts[heads] = inside[heads]
        part_at = np.flatnonzero(starts)
        first = np.searchsorted(part_at, offsets)
        if not len(part_at):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        kept = LOWER[data[inside]]
        edges = np.append(part_at - np.searchsorted(np.flatnonzero(~inside), part_at), len(kept))
        parts = pa.LargeStringArray.from_buffers(len(part_at), pa.py_buffer(edges), pa.py_buffer(kept)).dictionary_encode()
        distinct = parts.dictionary.to_pylist()
        if len(self.known) + len(distinct) > REMEMBERED and self.known:
            self._forget()
        self._learn([p for p in distinct if p not in self.known])
        known = self.known
        place = np.fromiter((known[p] for p in distinct), dtype=np.int64, count=len(distinct))[parts.indices.to_numpy()]
        begin, size = self.begin[place], self.sizes[place]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(begin - ends + size, size)]
        return ids, np.append(0, ends)[first]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The vocabulary at ``path``, read once by each worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Harmonic:
    """Bins of one task. Pieces are (document, start, ids, document's length); a bin is closed when it is full."""

    def __init__(self, number: int, capacity: int = CAPACITY, classes: int = CLASSES):
        if not 1 < classes <= capacity:
            raise ValueError("two classes at least, and a token for each place of a bin")
        self.capacity, self.classes = capacity, classes
        self.next_id = number << 40
        self.bins: dict[int, list[tuple]] = {j: [] for j in range(2, classes + 1)}
        self.rest, self.room = [], capacity
        self.closed: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.closed.append((doc, start, ids, total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc, ids: np.ndarray) -> None:
        at, n, c = 0, len(ids), self.capacity
        while n - at >= c:
            self._close([(doc, at, ids[at : at + c], n)])
            at += c
        while (n - at) * self.classes > c:
            j = -(-c // (n - at))
            held = self.bins[j]
            k = len(held)
            size = c * (k + 1) // j - c * k // j
            held.append((doc, at, ids[at : at + size], n))
            at += size
            if k + 1 == j:
                self._close(held)
                self.bins[j] = []
        while at < n:
            size = min(n - at, self.room)
            self.rest.append((doc, at, ids[at : at + size], n))
            at += size
            self.room -= size
            if not self.room:
                self._close(self.rest)
                self.rest, self.room = [], c

    def finish(self) -> None:
        """Lay out what open bins hold: full sequences, then powers of two."""
        left = [p for j in sorted(self.bins) for p in self.bins[j]] + self.rest
        self.bins, self.rest, todo, now, room = {}, [], sum(len(p[2]) for p in left), [], 0
        for doc, start, ids, total in left:
            at = 0
            while at < len(ids):
                if not room:
                    if now:
                        self._close(now)
                    now, room = [], min(self.capacity, 1 << todo.bit_length() - 1)
                    todo -= room
                size = min(len(ids) - at, room)
                now.append((doc, start + at, ids[at : at + size], total))
                at += size
                room -= size
        if now:
            self._close(now)

    def take(self) -> list[tuple]:
        done, self.closed = self.closed, []
        return done


def pack(
    docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, classes: int = CLASSES,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Pieces: the id, start, ids (little-endian unsigned 32-bit), doc_tokens (end id counted), sequence_id, offset.

    The capacity is a power of two, or the last sequence of a task may be one short of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, bins = encoder(path), Harmonic(TaskContext.get().partitionId(), capacity, classes)

        def rows(kind: pa.DataType) -> pa.RecordBatch:
            doc, start, ids, total, sequence, offset = zip(*bins.take(), strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, kind), pa.array(start, pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=["id", "start", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        kind = None
        for batch in batches:
            kind = batch["id"].type
            for first, stop, data, offsets in text_passes(batch["text"]):
                ids, begin = coder.encode(data, offsets)
                for doc, a, b in zip(batch["id"].slice(first, stop - first).to_pylist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    bins.add(doc, np.append(ids[a:b], np.uint32(end_id)).astype("<u4"))
                if bins.closed:
                    yield rows(kind)
        bins.finish()
        if bins.closed:
            yield rows(kind)

    kind = docs.schema[id_column].dataType.simpleString()
    done = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        run, f"id {kind}, start long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
    return done.withColumnRenamed("id", id_column)


def piece_digests(pieces: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The pieces with their ids' number and checksum in place of the ids."""
    length = F.octet_length("ids").cast("bigint") / 4
    return pieces.select(id_column, "start", length.cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
