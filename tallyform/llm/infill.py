"""Fill-in-middle examples from seekable compressed texts.

A text is stored as independent zstandard frames, each with the units and characters that the text holds up to its end.
A cut behind a number of units is found by binary search in those counts: only the frame that holds it is decompressed.
The transformed text is again a row of frames: marks, the two cut frames anew, and every other frame as it was stored,
never decompressed. One behind the other they are a valid zstandard stream. Digests read the frames in order, one at a time.

A unit is a run of other characters with the white space (``[\\x20\\x09-\\x0D]``) before it; white space at the end is a
unit of its own. Frames are cut at characters, not at units, so that a text without white space has bounded frames too.

Cases: null and empty texts have no frame and are plain; a null id draws as the empty text; rows are handled one by one,
so repeated rows and ids give repeated results; an empty table gives none. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyform.llm.shared import SPACE_WORDS, text_passes

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)

#: Bytes of text in a frame, at most.
FRAME_BYTES = 1 << 16

FRAMES = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())]))
_FRAMES_DDL = "array<struct<units:bigint,chars:bigint,data:binary>>"


def _chars(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def _inner_ends(raw: np.ndarray) -> np.ndarray:
    """Where units end inside a frame: behind a character that white space follows there."""
    word = SPACE_WORDS[raw]
    return np.flatnonzero(word[:-1] & ~word[1:]) + 1


def frames_of(raw: np.ndarray, pack: zstandard.ZstdCompressor, size: int = FRAME_BYTES) -> list[dict]:
    """The frames of one text, each with the units and characters up to its end."""
    out, units, chars, at = [], 0, 0, 0
    while at < len(raw):
        stop = min(at + size, len(raw))
        while stop < len(raw) and (raw[stop] & 0xC0) == 0x80:
            stop -= 1
        part = raw[at:stop]
        ends_here = stop == len(raw) or (SPACE_WORDS[part[-1]] and not SPACE_WORDS[raw[stop]])
        units += len(_inner_ends(part)) + int(ends_here)
        chars += _chars(part)
        out.append({"units": units, "chars": chars, "data": pack.compress(part.tobytes())})
        at = stop
    return out


def frame_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The id, ``marked`` (the text holds one of the marks), frames. No shuffle."""
    if frame_bytes < 4:
        raise ValueError("a frame holds at least one character")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for first, stop, data, offsets in text_passes(batch["text"]):
                made = [frames_of(data[a:b], pack, frame_bytes) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                ids = batch["id"].slice(first, stop - first)
                marked = batch["marked"].slice(first, stop - first)
                yield pa.RecordBatch.from_arrays([ids, marked, pa.array(made, FRAMES)], names=["id", "marked", "frames"])

    text = F.col(text_column)
    marked = F.coalesce(F.contains(text, F.lit("<P>")) | F.contains(text, F.lit("<S>")) | F.contains(text, F.lit("<M>")), F.lit(False))
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text"), marked.alias("marked"))
    framed = rows.mapInArrow(run, f"id {kind}, marked boolean, frames {_FRAMES_DDL}")
    return framed.select(F.col("id").alias(id_column), "marked", "frames")


def draws(id_column: str, seed: int) -> Column:
    """Four numbers below 2**32 that follow from the seed and the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)])


def cut(frames: list[dict], units: int, unpack: zstandard.ZstdDecompressor) -> tuple[int, bytes, int, int]:
    """Where ``units`` units end: (frame, its text, bytes of it before the cut, characters of the whole text before it)."""
    if not units:
        return 0, b"", 0, 0
    k = bisect_left(frames, units, key=lambda f: f["units"])
    before = frames[k - 1] if k else {"units": 0, "chars": 0}
    raw = unpack.decompress(frames[k]["data"])
    seen = np.frombuffer(raw, dtype=np.uint8)
    ends, place = _inner_ends(seen), units - before["units"]
    at = int(ends[place - 1]) if place <= len(ends) else len(raw)
    return k, raw, at, before["chars"] + _chars(seen[:at])


def _between(frames: list[dict], a: tuple, b: tuple | None, pack: zstandard.ZstdCompressor) -> list[bytes]:
    """Frames of the text from cut ``a`` to cut ``b`` (or the end): only the cut ones are compressed again."""
    (k, raw, at, _), (last, _, stop, _) = a, b if b else (len(frames), b"", 0, 0)
    if k == last:
        return [pack.compress(raw[at:stop] if raw else b[1][:stop])] if stop > at else []
    head = [frames[k]["data"]] if not at else [pack.compress(raw[at:])] if at < len(raw) else []
    return head + [f["data"] for f in frames[k + 1 : last]] + ([pack.compress(b[1][:stop])] if stop else [])


def fill_in_middle(framed: DataFrame, id_column: str = "doc_id", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """The id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output (frames of the transformed text).

    ``rate`` of 100 texts are transformed, ``spm_rate`` of 100 of them with the suffix first. Texts that hold a mark stay
    plain, so that every output can be taken apart again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        mark = {m: pack.compress(m) for m in MARKS}
        for batch in batches:
            rows: list[tuple] = []
            for marked, frames, (h1, h2, h3, h4) in zip(*(batch[c].to_pylist() for c in ("marked", "frames", "draws")), strict=True):
                n = frames[-1]["units"] if frames else 0
                if not frames or marked or h3 % 100 >= rate:
                    rows.append((n, "plain", None, None, [f["data"] for f in frames]))
                    continue
                a, b = (cut(frames, u, unpack) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
                prefix = [mark[PREFIX], *_between(frames, (0, b"", 0, 0), a, pack)]
                middle = [mark[MIDDLE], *_between(frames, a, b, pack)]
                suffix = [mark[SUFFIX], *_between(frames, b, None, pack)]
                spm = h4 % 100 < spm_rate
                rows.append((n, "spm" if spm else "psm", a[3], b[3] - a[3], suffix + prefix + middle if spm else prefix + suffix + middle))
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.list_(pa.binary()))],
                names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    kind = framed.schema[id_column].dataType.simpleString()
    rows = framed.select(F.col(id_column).alias("id"), "marked", "frames", draws(id_column, seed).alias("draws"))
    done = rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output array<binary>")
    return done.withColumnRenamed("id", id_column)


def texts(done: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The id, form, and the transformed text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            found = [b"".join(map(unpack.decompress, frames)).decode() for frames in batch["output"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["form"], pa.array(found, pa.string())], names=["id", "form", "text"])

    kind = done.schema[id_column].dataType.simpleString()
    rows = done.select(F.col(id_column).alias("id"), "form", "output")
    return rows.mapInArrow(run, f"id {kind}, form string, text string").withColumnRenamed("id", id_column)


class _Output:
    """The frames of one output, read in order, never all at once."""

    def __init__(self, frames: list[bytes], unpack: zstandard.ZstdDecompressor):
        self.frames, self.unpack = frames, unpack

    def read(self, start: int, stop: int | None) -> Iterator[bytes]:
        at = 0
        for frame in self.frames:
            size = zstandard.frame_content_size(frame)
            if stop is not None and at >= stop:
                return
            if at + size > start:
                raw = self.unpack.decompress(frame)
                yield raw[max(0, start - at) : None if stop is None else stop - at]
            at += size

    def hashed(self) -> tuple[str, dict[bytes, int], int]:
        """Digest of the output, where each mark begins first, and the output's length."""
        digest, found, at, tail = hashlib.sha256(), {}, 0, b""
        for raw in self.read(0, None):
            digest.update(raw)
            seen = tail + raw
            for m in MARKS:
                if m not in found and (k := seen.find(m)) >= 0:
                    found[m] = at - len(tail) + k
            at += len(raw)
            tail = seen[-2:]
        return digest.hexdigest(), found, at

    def restored(self, form: str, found: dict[bytes, int], size: int) -> str:
        """Digest of the text that the output was made from, which follows from the output and its form."""
        order = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}[form]
        borders = [found[m] for m in order] + [size]
        spans = {m: (borders[k] + len(m), borders[k + 1]) for k, m in enumerate(order)}
        digest = hashlib.sha256()
        for m in (PREFIX, MIDDLE, SUFFIX):
            for raw in self.read(*spans[m]):
                digest.update(raw)
        return digest.hexdigest()


def digests(done: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256: both from the frames of the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for form, frames in zip(batch["form"].to_pylist(), batch["output"].to_pylist(), strict=True):
                output = _Output(frames, unpack)
                shown, found, size = output.hashed()
                rows.append((shown, shown if form == "plain" else output.restored(form, found, size)))
            shown, restored = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in kept), pa.array(shown, pa.string()), pa.array(restored, pa.string())],
                names=[*kept, "output_sha256", "restored_sha256"],
            )

    kept = ["id", "n", "form", "prefix_chars", "middle_chars"]
    kind = done.schema[id_column].dataType.simpleString()
    rows = done.select(F.col(id_column).alias("id"), *kept[1:], "output")
    ddl = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return rows.mapInArrow(run, ddl).withColumnRenamed("id", id_column)
