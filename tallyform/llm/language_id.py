"""Language identification: a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on a bounded sample of labelled documents: of every language at most
``docs_per_language`` documents chosen by a hash of the id (``docs`` over all languages, but at least one of each), whole or, if
longer than ``doc_chars`` characters, a stretch of so many from a place chosen alike. Every byte of every text gets a probability for each language; a document's probabilities are the means
over its bytes. Long texts run as stretches of ``stretch`` bytes side by side.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if there is nothing to learn from;
repeated rows give repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyform.llm.shared import hash_below, held_out, text_passes

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    docs_per_language: int = 300
    docs: int = 19_200
    doc_chars: int = 8000
    hidden: int = 8
    steps: int = 500
    batch: int = 256
    length: int = 48
    rate: float = 0.02
    seed: int = 11
    stretch: int = 128
    #: Stretches that run side by side, fewer where there are more than 64 languages.
    columns: int = 3072


@dataclass
class Network:
    """``inputs`` [2, 3H, 256]: what a byte adds to the gates (update, reset, candidate); ``own`` [2, 3H, H]: what the state
    adds; ``out`` [C, 2H], ``bias`` [C]. The first axis is the direction."""

    langs: list[str]
    inputs: np.ndarray
    own: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def _states(x: np.ndarray, inputs: np.ndarray, own: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States [T, H, B] of one direction over bytes ``x`` [T, B], and with ``keep`` what backpropagation needs."""
    steps, width = x.shape
    size = own.shape[1]
    h = np.zeros((size, width), dtype=np.float32)
    out = np.empty((steps, size, width), dtype=np.float32)
    kept = []
    for t in range(steps):
        gates = np.take(inputs, x[t], axis=1)
        mine = own @ h
        zr = _sigmoid(gates[: 2 * size] + mine[: 2 * size])
        z, r = zr[:size], zr[size:]
        n = np.tanh(gates[2 * size :] + r * mine[2 * size :])
        new = n + z * (h - n)
        if keep:
            kept.append((h, z, r, n, mine[2 * size :]))
        h = out[t] = new
    return out, kept


def _back(dstates: np.ndarray, kept: list, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of ``inputs`` and ``own`` given those of the states: backpropagation through time."""
    size = own.shape[1]
    dinputs, downs = np.zeros((256, 3 * size), dtype=np.float32), np.zeros_like(own)
    dh = np.zeros_like(dstates[0])
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, n, mine = kept[t]
        dh = dh + dstates[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * mine * r * (1 - r)
        dgates = np.concatenate([dz, dr, dn])
        np.add.at(dinputs, x[t], dgates.T)
        dmine = np.concatenate([dz, dr, dn * r])
        downs += dmine @ h.T
        dh = dh * z + own.T @ dmine
    return dinputs.T, downs


def _softmax(x: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(x - x.max(axis, keepdims=True))
    return e / e.sum(axis, keepdims=True)


def train(samples: list[tuple[bytes, str]], params: LanguageParams = LanguageParams()) -> Network | None:
    """A network for the languages of ``samples`` (text, language). None without samples."""
    samples = [s for s in samples if s[0]]
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return None
    rng = np.random.Generator(np.random.PCG64(params.seed))
    size, n = params.hidden, len(langs)
    by_lang: dict[str, list[np.ndarray]] = {name: [] for name in langs}
    for t, lang in samples:
        by_lang[lang].append(np.frombuffer(t, dtype=np.uint8))
    texts = list(by_lang.values())
    net = {
        "inputs": rng.normal(0, 0.3, (2, 3 * size, 256)).astype(np.float32), "own": rng.normal(0, 0.3, (2, 3 * size, size)).astype(np.float32),
        "out": rng.normal(0, 0.3, (n, 2 * size)).astype(np.float32), "bias": np.zeros((n, 1), dtype=np.float32),
    }
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    for step in range(1, params.steps + 1):
        x = np.zeros((params.length, params.batch), dtype=np.uint8)
        y = rng.integers(0, n, params.batch)
        for b in range(params.batch):
            text = texts[y[b]][rng.integers(len(texts[y[b]]))]
            start = rng.integers(max(1, len(text) - params.length + 1))
            part = text[start : start + params.length]
            x[: len(part), b] = part
        ahead, kept_a = _states(x, net["inputs"][0], net["own"][0], True)
        behind, kept_b = _states(x[::-1], net["inputs"][1], net["own"][1], True)
        both = np.concatenate([ahead, behind[::-1]], axis=1)
        p = _softmax(net["out"] @ both + net["bias"], 1)
        p[:, y, np.arange(params.batch)] -= 1
        p /= params.length * params.batch
        grads = {"out": np.einsum("tcb,thb->ch", p, both), "bias": p.sum((0, 2))[:, None]}
        dboth = np.einsum("ch,tcb->thb", net["out"], p)
        one, two = _back(dboth[:, :size], kept_a, x, net["own"][0]), _back(dboth[::-1, size:], kept_b, x[::-1], net["own"][1])
        grads["inputs"], grads["own"] = np.stack([one[0], two[0]]), np.stack([one[1], two[1]])
        rate = params.rate * min(1.0, 2 * (1 - step / (params.steps + 1)))
        for k, g in grads.items():
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            net[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Network(langs, net["inputs"], net["own"], net["out"], net["bias"])


def _fast_states(x: np.ndarray, inputs: np.ndarray, own: np.ndarray) -> np.ndarray:
    """``_states`` without what training needs, by exponentials: 1 / (1 + e^-a) and 1 - 2 / (1 + e^2a)."""
    steps, width = x.shape
    size = own.shape[1]
    scale = np.repeat(np.array([-1, -1, 2], dtype=np.float32), size)[:, None]
    inputs, own = np.ascontiguousarray(inputs * scale), own * scale
    h = np.zeros((size, width), dtype=np.float32)
    out = np.empty((steps, size, width), dtype=np.float32)
    gates = np.empty((3 * size, width), dtype=np.float32)
    with np.errstate(over="ignore"):
        for t in range(steps):
            np.take(inputs, x[t], axis=1, out=gates, mode="clip")
            mine = own @ h
            zr = gates[: 2 * size]
            zr += mine[: 2 * size]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            n, cand = gates[2 * size :], mine[2 * size :]
            cand *= zr[size:]
            n += cand
            np.exp(n, out=n)
            n += 1
            np.divide(-2, n, out=n)
            n += 1
            h = np.subtract(h, n, out=out[t])
            h *= zr[:size]
            h += n
    return out


def position_probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    """[T, C, B]: the probability of each language at each position of the columns of ``x``."""
    ahead = _fast_states(x.astype(np.intp), net.inputs[0], net.own[0])
    behind = _fast_states(x[::-1].astype(np.intp), net.inputs[1], net.own[1])
    size = net.own.shape[2]
    return _softmax(net.out[:, :size] @ ahead + net.out[:, size:] @ behind[::-1] + net.bias, 1)


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray, stretch: int, columns: int = 3072) -> np.ndarray:
    """[texts, C]: mean probabilities over all bytes of each text."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    pieces = -(-lengths // stretch)
    text_of = np.repeat(np.arange(n), pieces)
    first = np.cumsum(pieces) - pieces
    starts = offsets[:-1][text_of] + (np.arange(len(text_of)) - first[text_of]) * stretch
    sizes = np.minimum(offsets[1:][text_of] - starts, stretch)
    total = np.zeros((n, len(net.langs)))
    columns = max(1, min(columns, columns * 64 // len(net.langs)))
    order = np.argsort(sizes, kind="stable")  # columns of like length run together
    for at in range(0, len(order), columns):
        some = order[at : at + columns]
        width = int(sizes[some].max())
        place = np.minimum(starts[some] + np.arange(width)[:, None], len(data) - 1)
        inside = np.arange(width)[:, None] < sizes[some]
        p = position_probabilities(net, np.where(inside, data[place], 0))
        np.add.at(total, text_of[some], np.einsum("tcb,tb->bc", p, inside.astype(np.float32)))
    return total / np.maximum(lengths, 1)[:, None]


def sample(docs: DataFrame, params: LanguageParams = LanguageParams()) -> list[tuple[bytes, str]]:
    """Labelled documents that are not held out, as the bounds in ``params`` have it; every language that has one is in it."""
    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out("doc_id"))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    each = min(params.docs_per_language, max(1, params.docs // max(1, counts.count())))
    start = F.pmod(F.xxhash64("doc_id", "lang"), F.greatest(F.length("text") - params.doc_chars, F.lit(0)) + 1).cast("int") + 1
    # about twice the rows that are needed are drawn by their hash where they are read; only those are ranked. The counts have
    # a row for each language, as many as the network, which every task gets, has outputs
    drawn = usable.join(F.broadcast(counts), "lang").where(hash_below(F.xxhash64("doc_id"), F.lit(2.0 * each + 50) / F.col("n")))
    by = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = (
        drawn.select("doc_id", "lang", F.col("text").substr(start, F.lit(params.doc_chars)).alias("text"))
        .withColumn("place", F.row_number().over(by)).where(F.col("place") <= each).orderBy("lang", "place").collect()
    )
    return [(r.text.encode(), r.lang) for r in rows]


def identify(docs: DataFrame, params: LanguageParams = LanguageParams(), net: Network | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""
    net = net or train(sample(docs, params), params)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = shared.value
            for a, b, data, offsets in text_passes(batch["text"]):
                letters = np.array(batch["letters"].slice(a, b - a).to_pylist(), dtype=bool)
                if model is None:
                    names, score = [UNKNOWN] * (b - a), np.zeros(b - a)
                else:
                    p = pooled(model, data, offsets, params.stretch, params.columns)
                    best = p.argmax(1)
                    names = [model.langs[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
                    score = np.where(letters, np.clip(p.max(1), 0.0, 1.0), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), batch["held_out"].slice(a, b - a), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
