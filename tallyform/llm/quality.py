"""Quality rules by distribution divergence.

Every document gets plain counts (words, symbols, repeated lines, repeated 3-word windows) and two histograms: of character
classes and of the common short words of a language. References come from all documents of a language: the median share of
each class (so that junk, while it is under half, leaves no mark) and the summed shares of the common words. Every language
has one, however many there are. A document is compared with every language by Jensen-Shannon distance (square root of the divergence to base 2,
0 to 1); the nearest language counts. It is kept if both distances stay below their bounds. Guards: a histogram of fewer
than ``min_chars`` characters or ``min_common`` words says little and is not held against a document.

Cases: null text is an empty document (base_failed, not kept); documents of null language are judged, but are in no reference;
without any reference only the base rules judge; repeated rows are judged one by one, each alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyform.llm.shared import ALNUM_WORDS, SPACE_WORDS, Words, grams, stage, text_passes

#: Characters that count as symbols, and classes of characters; multi-byte characters count once, by their first byte.
SYMBOLS = b"#*$%&|<>"
CLASSES = ["lower", "upper", "digit", "space", "line", "stop", "symbol", "other", "wide"]
_CLASS = np.full(256, 7, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[0x20, 0x09]] = 3
_CLASS[[0x0A, 0x0D]] = 4
_CLASS[list(b".,;:?!'\"()-")] = 5
_CLASS[list(SYMBOLS)] = 6
_CLASS[0xC0:] = 8
_CLASS[0x80:0xC0] = 9  # bytes within a character; not counted
#: Languages whose class histograms a text is compared with at once.
LANGUAGE_BLOCK = 64
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class QualityParams:
    #: Common words of a language: its most frequent ones among those of at most ``word_bytes`` bytes.
    common_words: int = 64
    word_bytes: int = 6
    min_chars: int = 100
    min_common: int = 40
    max_class_distance: float = 0.17
    max_word_distance: float = 0.5
    #: Steps in which a document's share of a class is counted, for the median.
    steps: int = 2000


@dataclass(frozen=True)
class References:
    """Probabilities per language: classes, and common words (hash, probability; the last place is for all other words)."""

    langs: list[str]
    classes: np.ndarray
    words: list[np.ndarray]
    shares: list[np.ndarray]


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of ``p`` and ``q`` (each sums to 1)."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(-1)
    return np.sqrt(np.clip((left + right) / 2, 0.0, 1.0))


def _class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    at = np.repeat(np.arange(n, dtype=np.int64) * 10, np.diff(offsets))
    return np.bincount(at + _CLASS[data], minlength=n * 10).reshape(n, 10)[:, :9]


def _sum_by(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def _repeated_words(words: Words) -> np.ndarray:
    """Words within 3-word windows that their text has twice or more."""
    count = words.counts()
    long = count >= 3
    hashes, text_of = grams(words, 3)
    ours = long[text_of]
    hashes, text_of = hashes[ours], text_of[ours]
    tail = np.repeat(words.first[1:], count)
    starts = np.flatnonzero(tail - np.arange(len(tail)) >= 3)
    key = hashes + text_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(words.hashes) + 2, dtype=bool)
    at = starts[twice]
    for k in range(3):
        hit[at + k] = True
    return _sum_by(hit[: len(words.hashes)], words.first)


def _repeated_lines(text: bytes) -> int:
    if text.count(b"\n") == 0:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def counts_ddl() -> str:
    return "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _base(data: np.ndarray, offsets: np.ndarray, words: Words) -> dict[str, np.ndarray]:
    inner = (data & 0xC0) != 0x80
    chars = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(inner, out=chars[1:])
    raw = data.tobytes()
    return {
        "n_words": words.counts(),
        "word_chars": _sum_by(chars[words.ends] - chars[words.starts], words.first),
        "n_symbols": _sum_by(_SYMBOL[data], offsets),
        "n_dup_lines": np.array([_repeated_lines(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.int64),
        "n_repeat_words": _repeated_words(words),
    }


def _reference_counts(docs: DataFrame, params: QualityParams) -> DataFrame:
    """lang, kind, key, n over all documents. Kind share: documents whose share of a class is so many steps (key: class number
    times steps + 1, plus steps); word: occurrences (key: hash); all: words in total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch["lang"].to_pylist()
            langs = sorted({x for x in names if x is not None})
            number = {x: i for i, x in enumerate(langs)}
            of = np.array([number.get(x, -1) for x in names], dtype=np.int64)
            shares: dict[int, list] = {i: [] for i in range(len(langs))}
            every = np.zeros(len(langs), dtype=np.int64)
            found: dict[int, list] = {i: [] for i in range(len(langs))}
            for a, b, data, offsets in text_passes(batch["text"]):
                words = Words(data, offsets, ALNUM_WORDS)
                lang = of[a:b]
                has = lang >= 0
                classes = _class_counts(data, offsets)
                size = classes.sum(1)
                share = (classes * params.steps + size[:, None] // 2) // np.maximum(size, 1)[:, None] + np.arange(9) * (params.steps + 1)
                np.add.at(every, lang[has], words.counts()[has])
                of_word = np.repeat(lang, words.counts())
                short = words.ends - words.starts <= params.word_bytes
                for i in np.unique(lang[has]):
                    shares[int(i)].append(share[(lang == i) & (size >= params.min_chars)].ravel())
                    found[int(i)].append(np.unique(words.hashes[short & (of_word == i)], return_counts=True))
            rows: list[tuple[list, list, list, list]] = []
            for i, lang in enumerate(langs):
                rows.append(([lang], ["all"], [0], [int(every[i])]))
                if found[i]:
                    keys, n = np.unique(np.concatenate(shares[i]), return_counts=True)
                    rows.append(([lang] * len(keys), ["share"] * len(keys), keys, n))
                    keys, back = np.unique(np.concatenate([k for k, _ in found[i]]), return_inverse=True)
                    n = np.bincount(back, np.concatenate([c for _, c in found[i]])).astype(np.int64)
                    rows.append(([lang] * len(keys), ["word"] * len(keys), keys.view(np.int64), n))
            for lang, kind, key, n in rows:
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(kind, pa.string()), pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["lang", "kind", "key", "n"])

    parts = docs.select("lang", "text").where(F.col("lang").isNotNull()).mapInArrow(run, "lang string, kind string, key long, n long")
    return parts.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def _common(counts: DataFrame, params: QualityParams) -> DataFrame:
    """The common words of each language. Ranks are cut within each partition before a language's words meet."""
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    return counts.where("kind = 'word'").withColumn("place", F.row_number().over(best)).where(F.col("place") <= params.common_words).drop("place")


def references(docs: DataFrame, params: QualityParams = QualityParams()) -> References:
    """Histograms of every language over all its documents. To the driver come, for each language, ``common_words`` rows, one
    total, and one row for the median of each class."""
    counts = stage(_reference_counts(docs, params), "quality-references")
    rows = _common(counts, params).unionByName(counts.where("kind = 'all'"))
    # the median: the least share up to which at least half of the documents lie
    of_class = Window.partitionBy("lang", "class")
    shares = counts.where("kind = 'share'").withColumn("class", F.floor(F.col("key") / (params.steps + 1)))
    shares = shares.withColumn("running", F.sum("n").over(of_class.orderBy("key"))).withColumn("total", F.sum("n").over(of_class))
    medians = shares.where("running * 2 >= total").groupBy("lang", "class").agg(F.min("key").alias("key"))
    found = rows.unionByName(medians.select("lang", F.lit("share").alias("kind"), "key", F.lit(1).cast("long").alias("n"))).toArrow()
    langs, of = np.unique(np.array(found["lang"].to_pylist(), dtype=object), return_inverse=True)
    kind, key, n = np.array(found["kind"].to_pylist(), dtype=object), found["key"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(len(langs) + 1))
    classes, words, shares_of, kept = [], [], [], []
    for i, lang in enumerate(langs.tolist()):
        own = order[edges[i] : edges[i + 1]]
        share, word = own[kind[own] == "share"], own[kind[own] == "word"]
        hist = np.zeros(9)
        hist[key[share] // (params.steps + 1)] = key[share] % (params.steps + 1)
        every = int(n[own[kind[own] == "all"]].sum())
        if hist.sum() == 0 or every == 0:
            continue
        hashes = key[word].view(np.uint64)
        up = np.argsort(hashes)
        common = n[word][up].astype(np.float64)
        kept.append(lang)
        classes.append(hist / hist.sum())
        words.append(hashes[up])
        shares_of.append(np.append(common, every - common.sum()) / every)
    return References(kept, np.array(classes).reshape(len(kept), 9), words, shares_of)


def _found_in(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where each hash is in the sorted ``keys``; their number if it is not."""
    if not len(keys):
        return np.zeros(len(hashes), dtype=np.int64)
    at = np.searchsorted(keys, hashes)
    return np.where(keys[np.minimum(at, len(keys) - 1)] == hashes, at, len(keys))


def _distances(data: np.ndarray, offsets: np.ndarray, refs: References, params: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    """Class distance and word distance of each text to its nearest language; 0 where a guard holds."""
    n = len(offsets) - 1
    if not refs.langs or not n:
        return np.zeros(n), np.zeros(n)
    classes = _class_counts(data, offsets).astype(np.float64)
    size = classes.sum(1)
    share_of_class, by_class = classes / np.maximum(size, 1)[:, None], np.full(n, np.inf)
    for at in range(0, len(refs.langs), LANGUAGE_BLOCK):
        by_class = np.minimum(by_class, js_distance(share_of_class[:, None, :], refs.classes[None, at : at + LANGUAGE_BLOCK]).min(1))
    words = Words(data, offsets, ALNUM_WORDS)
    count = words.counts()
    # words that are common in no language are looked up once
    common = np.unique(np.concatenate(refs.words))
    seen = _found_in(common, words.hashes) < len(common)
    hashes, text_of = words.hashes[seen], np.repeat(np.arange(n), count)[seen]
    by_word = np.full(n, np.inf)
    for keys, share in zip(refs.words, refs.shares, strict=True):
        hist = np.bincount(text_of * len(share) + _found_in(keys, hashes), minlength=n * len(share)).reshape(n, -1)
        hist[:, -1] = count - hist[:, :-1].sum(1)
        by_word = np.minimum(by_word, js_distance(hist / np.maximum(count, 1)[:, None], share[None]))
    return np.where(size >= params.min_chars, by_class, 0.0), np.where(count >= params.min_common, by_word, 0.0)


def judge_quality(docs: DataFrame, params: QualityParams = QualityParams(), refs: References | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept:
    a row for each row of ``docs`` (doc_id, text, lang)."""
    return _judged(docs, ["doc_id"], params, refs)


def _judged(docs: DataFrame, carried: list[str], params: QualityParams, refs: References | None) -> DataFrame:
    refs = references(docs, params) if refs is None else refs
    shared = docs.sparkSession.sparkContext.broadcast(refs)
    fields = [docs.schema[c] for c in carried]
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_passes(batch["text"]):
                out = _base(data, offsets, Words(data, offsets, SPACE_WORDS, lower=False))
                out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
                out["class_distance"], out["word_distance"] = _distances(data, offsets, shared.value, params)
                out["kept"] = ~out["base_failed"] & (out["class_distance"] <= params.max_class_distance) & (out["word_distance"] <= params.max_word_distance)
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(a, b - a) for c in carried), *(pa.array(out[m]) for m in measures)], names=[*carried, *measures])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    ddl += f", {counts_ddl()}, base_failed boolean, class_distance double, word_distance double, kept boolean"
    return docs.select(*carried, *([] if "text" in carried else ["text"])).mapInArrow(run, ddl)


def keep_good(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """Rows of ``docs`` that pass, with the columns of ``docs``. Nothing is shuffled."""
    return _filtered(docs, params, references(docs, params))


def _filtered(docs: DataFrame, params: QualityParams, refs: References) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for _, _, data, offsets in text_passes(batch["text"]):
                words = Words(data, offsets, SPACE_WORDS, lower=False)
                n = words.counts()
                by_class, by_word = _distances(data, offsets, shared.value, params)
                good.append((n >= 50) & (100 * _repeated_words(words) <= 50 * n) & (by_class <= params.max_class_distance) & (by_word <= params.max_word_distance))
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, dtype=bool)))

    return docs.mapInArrow(run, docs.schema)
