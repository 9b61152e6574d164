"""Small helpers shared by the operators: text buffers of Arrow batches, vectorised words, staged tables."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyform.sources.scratch import scratch_path

#: Bytes of text that one numpy pass works on; a longer text is a pass of its own.
PASS_BYTES = 1 << 20

#: Bytes of the rows that a Python worker gets at once; a longer row is a batch of its own.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

#: [\x20\x09-\x0D] separate words.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False

#: Every ASCII byte that is neither a letter nor a digit separates words.
ALNUM_WORDS = np.ones(256, dtype=bool)
ALNUM_WORDS[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [_rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]
GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    """Odd multipliers for the first ``n`` places of a word."""
    have = _POWERS[0]
    if n > len(have):
        more = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        more[: len(have)] = have
        _POWERS[0] = more
    return _POWERS[0][:n]


def grown(array: np.ndarray, least: int) -> np.ndarray:
    """The array, with room for ``least`` entries."""
    if least <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(least, 2 * len(array)) - len(array), dtype=array.dtype)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_passes(column: pa.Array | pa.ChunkedArray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) of runs of texts; null counts as empty. No copy is made."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, stop, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop


class Words:
    """Words of a run of texts: byte ranges, a 64-bit hash each, and where each text's words begin."""

    __slots__ = ("starts", "ends", "hashes", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = True):
        inside = is_word[data]
        n = len(data)
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        texts = offsets[:-1][offsets[:-1] < n]
        begin[texts] = inside[texts]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        tails = offsets[1:][offsets[1:] > 0] - 1
        last[tails] = inside[tails]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)
        lengths = self.ends - self.starts
        if not len(lengths):
            self.hashes = np.zeros(0, dtype=np.uint64)
            return
        kept = data[inside]
        if lower:
            kept = LOWER[kept]
        heads = np.zeros(len(lengths), dtype=np.int64)
        np.cumsum(lengths[:-1], out=heads[1:])
        place = np.arange(len(kept), dtype=np.int64) - np.repeat(heads, lengths)
        self.hashes = mix(np.add.reduceat(_BYTE[kept] * _powers(int(lengths.max()))[place], heads) + lengths.astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of each text, and the text of each. A text of fewer words (not none) gives one, of them all."""
    count = words.counts()
    total = len(words.hashes)
    text_of = np.repeat(np.arange(len(count)), np.where(count >= k, count - k + 1, (count > 0).astype(np.int64)))
    out = np.zeros(total, dtype=np.uint64)
    for i in range(min(k, total)):
        out[: total - i] += words.hashes[i:] * GRAM[i]
    left = np.repeat(words.first[1:], count) - np.arange(total)
    keep = left >= k
    short = np.flatnonzero((count > 0) & (count < k))
    whole = np.zeros(len(short), dtype=np.uint64)
    for i in range(k - 1):
        has = count[short] > i
        whole[has] += words.hashes[words.first[short[has]] + i] * GRAM[i]
    heads = words.first[short]
    out[heads] = whole + count[short].astype(np.uint64) * GRAM[63]
    keep[heads] = True
    return mix(out[keep]), text_of


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers find this library where the driver has it, whatever folder they start in, and get rows in batches of
    bounded bytes: 10,000 long texts at once would fill a worker. A batch size set in the session is kept."""
    spark.conf.set(BATCH_SETTING, spark.conf.get(BATCH_SETTING, str(BATCH_BYTES)))
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_column: str, text_column: str) -> F.Column:
    """A row's own key besides its id, so that rows that share an id (or have none) are told apart by their text."""
    return F.xxhash64(F.col(text_column), F.col(id_column))


def held_out(id_column: str) -> F.Column:
    """Rows kept back from training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hash_below(hashed: F.Column, share: F.Column) -> F.Column:
    """Whether a 64-bit hash is among the lowest ``share`` of all values: rows drawn in the tasks that read them, and a
    beginning of the order by that hash."""
    return hashed.cast("double") <= F.lit(-(2.0**63)) + F.least(share, F.lit(1.0)) * F.lit(2.0**64)
