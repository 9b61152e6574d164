"""Toxicity: a logistic classifier over words, regularised by counterfactuals.

Features are which words, and which beginnings of words (4 to 6 bytes), a text has, hashed to ``buckets``. It is fitted on a
bounded sample of at most ``rows`` labelled documents, chosen by a hash of the id; the ``features`` buckets that tell the
labels apart best within it are used. Each training text also comes with two counterfactuals: one with the first group word in it
swapped for another one, and one without that word (a text without one gets one, and then another). The squared change of the
score from the text to each of them is penalised, so that the mention of a group by itself moves no score.

Cases: a null text is an empty one, which scores as the bias alone; without labels, or with labels of one kind, all scores are
the share of toxic labels (0 without any); unlabelled, repeated and contradictory rows are no fault; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyform.llm.shared import ALNUM_WORDS, GRAM, LOWER, Words, hash_below, held_out, mix, text_passes

#: Words for groups of people, in the four languages of the corpus. Swapped for one another, within a language.
GROUP_WORDS = [
    ["women", "men", "muslims", "christians", "jews", "immigrants", "refugees", "gays", "lesbians", "blacks", "whites", "asians", "africans", "disabled"],
    ["frauen", "männer", "muslime", "christen", "juden", "einwanderer", "flüchtlinge", "schwule", "lesben", "schwarze", "weiße", "asiaten", "afrikaner", "behinderte"],
    ["mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "refugiados", "gais", "lesbianas", "negros", "blancos", "asiáticos", "africanos", "discapacitados"],
    ["femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés", "gays", "lesbiennes", "noirs", "blancs", "asiatiques", "africains", "handicapés"],
]


def _hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    return Words(np.frombuffer(b" ".join(raw), dtype=np.uint8), np.array([0, sum(map(len, raw)) + len(raw) - 1]), ALNUM_WORDS).hashes


#: Hash of each group word, sorted, and which word it is: its language and its place there (that of the first language that has it).
_GROUP_HASHES, _first = np.unique(np.concatenate([_hashes(words) for words in GROUP_WORDS]), return_index=True)
_GROUP_PLACES = [divmod(int(i), len(GROUP_WORDS[0])) for i in _first]


@dataclass(frozen=True)
class ToxicityParams:
    rows: int = 8_000
    bucket_bits: int = 20
    features: int = 2000
    #: Least number of sample documents that a feature must occur in.
    least: int = 5
    l1: float = 0.0005
    l2: float = 0.0001
    counterfactual: float = 1.0
    steps: int = 400
    threshold: float = 0.3


#: Columns of the sample that tell a text's counterfactuals from it.
CHANGES = ["less1", "more1", "less2", "more2"]


@dataclass
class Scorer:
    #: Hashed buckets with a weight, sorted, and the weights.
    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and beginning of a word; repeats included."""
    words = Words(data, offsets, ALNUM_WORDS)
    text_of = np.repeat(np.arange(len(offsets) - 1), words.counts())
    lengths = words.ends - words.starts
    found, where = [words.hashes], [text_of]
    part = np.zeros(len(text_of), dtype=np.uint64)
    for k in range(6):
        some = lengths > k
        part[some] += (LOWER[data[words.starts[some] + k]].astype(np.uint64) + np.uint64(1)) * GRAM[k]
        if k >= 3:
            found.append(mix(part[some] + np.uint64(k)))
            where.append(text_of[some])
    return np.concatenate(where), (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)


def _of_text(text: str, bits: int) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return np.unique(features(raw, np.array([0, len(raw)]), bits)[1])


def counterfactuals(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Both counterfactuals of each text, chosen by its checksum."""
    words = Words(data, offsets, ALNUM_WORDS)
    at = np.minimum(np.searchsorted(_GROUP_HASHES, words.hashes), len(_GROUP_HASHES) - 1)
    group = np.where(_GROUP_HASHES[at] == words.hashes, at, -1)
    raw = data.tobytes()
    one, two = [], []
    for i in range(len(offsets) - 1):
        text = raw[offsets[i] : offsets[i + 1]]
        mine = slice(words.first[i], words.first[i + 1])
        pick, named = zlib.crc32(text), np.flatnonzero(group[mine] >= 0)
        if not len(named):
            lang = GROUP_WORDS[pick % len(GROUP_WORDS)]
            first = pick // len(GROUP_WORDS) % len(lang)
            other = (first + 1 + pick // 64 % (len(lang) - 1)) % len(lang)
            one.append(text + b" " + lang[first].encode())
            two.append(text + b" " + lang[other].encode())
            continue
        word = group[mine][named[0]]
        lang, place = GROUP_WORDS[_GROUP_PLACES[word][0]], _GROUP_PLACES[word][1]
        other = lang[(place + 1 + pick % (len(lang) - 1)) % len(lang)].encode()
        hit = np.flatnonzero(group[mine] == word) + words.first[i]
        edges = [offsets[i], *np.stack([words.starts[hit], words.ends[hit]], 1).ravel(), offsets[i + 1]]
        parts = [raw[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2)]
        one.append(other.join(parts))
        two.append(b"".join(parts))
    return one, two


def _keys(data: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """Distinct (text, bucket) of a run of texts, sorted, as text << bits | bucket."""
    text_of, bucket = features(data, offsets, bits)
    return np.unique(text_of << bits | bucket)


def _lists(keys: np.ndarray, n: int, bits: int) -> pa.ListArray:
    edges = np.searchsorted(keys, np.arange(n + 1) << bits)
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(keys & (2**bits - 1), pa.int32()))


def sample(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """toxic, buckets (distinct), and for each counterfactual the buckets that it lacks and those that it has besides (less1, more1,
    less2, more2): the sample. Its ids and labels, at most ``rows`` of them, are what is broadcast."""
    usable = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
    # about twice the rows that are needed are drawn by their hash where they are read; only those are put in order
    share = F.lit((2.0 * params.rows + 50) / max(1, usable.count()))
    rows = usable.where(hash_below(F.xxhash64("doc_id"), share)).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(params.rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_passes(batch["text"]):
                bits = params.bucket_bits
                own = _keys(data, offsets, bits)
                out = [own]
                for texts in counterfactuals(data, offsets):
                    other = _keys(np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)]), bits)
                    out += [np.setdiff1d(own, other, assume_unique=True), np.setdiff1d(other, own, assume_unique=True)]
                yield pa.RecordBatch.from_arrays([batch["toxic"].slice(a, b - a), *(_lists(keys, b - a, bits) for keys in out)], names=["toxic", "buckets", *CHANGES])

    ddl = ", ".join(["toxic int", "buckets array<int>", *(f"{c} array<int>" for c in CHANGES)])
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, ddl)


@dataclass
class Swaps:
    """Entries of the matrix of feature changes, a row for each counterfactual: row, feature, change (1 or -1); and the text of each row."""

    row: np.ndarray
    feature: np.ndarray
    change: np.ndarray
    text: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.change * w[self.feature], minlength=len(self.text)).astype(np.float32)

    def back(self, rows: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.feature, self.change * rows[self.row], minlength=width).astype(np.float32)


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, swaps: Swaps, params: ToxicityParams) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic loss with the penalties, by accelerated proximal gradient steps. The penalty of a text is
    the sum over its counterfactuals of the squared change of its score."""
    n, width = x.shape
    w, bias = np.zeros(width, dtype=np.float32), np.float32(0)
    v, vb, t = w.copy(), bias, 1.0
    # Largest curvature: a quarter of that of the data, by a few power steps, and that of the penalties (a slope is a quarter at
    # most; changes of the slope along the data count with both counterfactuals).
    probe, swap_probe = np.ones(width, dtype=np.float32), np.ones(width, dtype=np.float32)
    top, swap_top = 1.0, 0.0
    for _ in range(12):
        probe = x.T @ (x @ probe) / n
        top = float(np.linalg.norm(probe)) or 1.0
        probe /= top
        swap_probe = swaps.back(swaps.times(swap_probe), width) / n
        swap_top = float(np.linalg.norm(swap_probe))
        swap_probe /= swap_top or 1.0
    step = np.float32(1 / (0.25 * (1 + params.counterfactual) * (top + 1) + params.l2 + 0.25 * params.counterfactual * swap_top))
    for _ in range(params.steps):
        z = x @ v + vb
        p = _chance(z)
        q = _chance(z[swaps.text] + swaps.times(v))
        moved = 2 * params.counterfactual / n * (q - p[swaps.text])
        slope, own_slope = moved * q * (1 - q), moved * (p * (1 - p))[swaps.text]
        error = (p - y) / n + np.bincount(swaps.text, slope - own_slope, minlength=n).astype(np.float32)
        grad = x.T @ error + params.l2 * v + swaps.back(slope, width)
        new, new_bias = v - step * grad, vb - step * error.sum()
        new = np.sign(new) * np.maximum(np.abs(new) - step * params.l1, 0)
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = new + (t - 1) / t_next * (new - w), new_bias + (t - 1) / t_next * (new_bias - bias)
        w, bias, t = new.astype(np.float32), new_bias, t_next
        v = v.astype(np.float32)
    return w, float(bias)


def _flat(rows: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the lists of a column."""
    lists = pa.concat_arrays(rows[column].chunks)
    return np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy()), lists.flatten().to_numpy().astype(np.int32)


def _places(row: np.ndarray, bucket: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in ``chosen``) of the buckets that are in it."""
    at = np.minimum(np.searchsorted(chosen, bucket), len(chosen) - 1)
    has = chosen[at] == bucket
    return row[has], at[has]


def train(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> Scorer:
    """Only buckets of the chosen features come to the driver, for at most ``rows`` documents."""
    rows = sample(docs, labels, params).toArrow().combine_chunks()
    y = np.array([(t or 0) > 0 for t in rows["toxic"].to_pylist()], dtype=np.float32)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Scorer(np.zeros(0, dtype=np.int64), np.zeros(0), 20.0 if share else -20.0)
    owner, flat = _flat(rows, "buckets")
    changes = [_flat(rows, c) for c in CHANGES]
    del rows
    width = 1 << params.bucket_bits
    bad, every = np.bincount(flat[y[owner] > 0], minlength=width), np.bincount(flat, minlength=width)
    expected = every * share
    value = np.where(every >= params.least, (bad - expected) ** 2 / np.maximum(expected * (1 - share), 1e-9), 0.0)
    chosen = np.sort(np.argsort(-value, kind="stable")[: params.features])
    chosen = chosen[value[chosen] > 0]
    groups = np.unique(np.concatenate([_of_text(w, params.bucket_bits) for words in GROUP_WORDS for w in words]))
    chosen = np.unique(np.concatenate([chosen, groups]))
    owner, at = _places(owner, flat, chosen)
    x = np.zeros((len(y), len(chosen)), dtype=np.float32)
    x[owner, at] = 1
    parts = [(*_places(text, bucket, chosen), i) for i, (text, bucket) in enumerate(changes)]
    swaps = Swaps(
        np.concatenate([text + i // 2 * len(y) for text, _, i in parts]), np.concatenate([place for _, place, _ in parts]),
        np.concatenate([np.full(len(text), i % 2 * 2 - 1, dtype=np.float32) for text, _, i in parts]), np.tile(np.arange(len(y)), 2),
    )
    weights, bias = fit(x, y, swaps, params)
    some = weights != 0
    return Scorer(chosen[some], weights[some].astype(np.float64), bias)


def score(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(), scorer: Scorer | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer or train(docs, labels, params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shared.value
            weight = np.zeros(1 << params.bucket_bits)
            weight[own.buckets] = own.weights
            for a, b, data, offsets in text_passes(batch["text"]):
                text_of, bucket = features(data, offsets, params.bucket_bits)
                hit = np.flatnonzero(weight[bucket])
                both = np.unique(text_of[hit] << params.bucket_bits | bucket[hit])
                total = own.bias + np.bincount(both >> params.bucket_bits, weight[both & (2**params.bucket_bits - 1)], minlength=b - a)
                p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), batch["held_out"].slice(a, b - a), pa.array(p), pa.array((p >= params.threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held_out("doc_id").alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
