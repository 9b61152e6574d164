"""Benchmark decontamination over a distributed positional inverted index.

The index holds, for terms of the test set, the positions in every training document. A phrase is found by intersecting
posting lists, shifted by each term's place in the phrase, from the rarest term (by document frequency over all documents) on:
the rarest term's list gives candidate starts, the next ones thin them out, and what is left is compared in full with the
words of the document. Proximity search asks for all terms within a span of words instead.

Distinct test terms are dealt into blocks of at most ``TERMS_PER_BLOCK``, whatever items they come from; the sizes of blocks are
counted before any is used. What a block broadcasts is thus bounded (8 bytes a term), and a larger test set takes more blocks,
each with a pass over the documents.

Cases: null texts have no words and match nothing; an item of fewer than ``window`` words (not none) is one phrase; equal
items and repeated rows each count; an item without an id hits words, but is in no list of items; documents that share an id
are told apart by their text; empty tables give no hits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyform.llm.shared import ALNUM_WORDS, Words, grams, row_key, stage, text_passes

TERMS_PER_BLOCK = 1_000_000
#: Terms of a phrase whose lists are intersected before the words themselves are compared.
RAREST = 3


def test_terms(items: DataFrame, id_column: str = "item_id") -> DataFrame:
    """item_id, item_key, place, term (64-bit hash): the words of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_passes(batch["text"]):
                words = Words(data, offsets, ALNUM_WORDS)
                n = words.counts()
                rows = np.repeat(np.arange(a, b), n)
                place = np.arange(len(rows)) - np.repeat(words.first[:-1], n)
                yield pa.RecordBatch.from_arrays([batch["item_id"].take(pa.array(rows)), batch["item_key"].take(pa.array(rows)), pa.array(place, pa.int32()), pa.array(words.hashes.view(np.int64))], names=["item_id", "item_key", "place", "term"])

    kind = items.schema[id_column].dataType.simpleString()
    return (
        items.select(F.col(id_column).alias("item_id"), "text").withColumn("item_key", row_key("item_id", "text"))
        .mapInArrow(run, f"item_id {kind}, item_key long, place int, term long")
    )


def term_blocks(terms: DataFrame) -> Iterator[np.ndarray]:
    """The distinct terms in sorted blocks of at most ``TERMS_PER_BLOCK``."""
    distinct = stage(terms.select("term").distinct(), "distinct-terms")
    blocks = max(1, -(-distinct.count() // TERMS_PER_BLOCK))
    while blocks > 1:
        block = F.pmod(F.xxhash64("term"), F.lit(blocks))
        if distinct.groupBy(block).count().agg(F.max("count")).first()[0] <= TERMS_PER_BLOCK:
            break
        blocks += 1 + blocks // 4
    for b in range(blocks):
        own = distinct.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b) if blocks > 1 else distinct
        yield np.sort(np.array([r.term for r in own.toLocalIterator()], dtype=np.int64).view(np.uint64))


def _members(hashes: np.ndarray, terms: np.ndarray) -> np.ndarray:
    if not len(terms):
        return np.zeros(len(hashes), dtype=bool)
    return terms[np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)] == hashes


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """term, df: documents that have it, of the given sorted terms."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = shared.value
            df = np.zeros(len(known), dtype=np.int64)
            for _, _, data, offsets in text_passes(batch["text"]):
                words = Words(data, offsets, ALNUM_WORDS)
                hit = _members(words.hashes, known)
                place = np.searchsorted(known, words.hashes[hit])
                of = np.repeat(np.arange(len(offsets) - 1), words.counts())[hit]
                df += np.bincount(np.unique(of * len(known) + place) % max(len(known), 1), minlength=len(known))
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(df[some])], names=["term", "df"])

    return docs.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def positional_index(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """doc_id, doc_key, n_words, term, positions: one row per document and given term that it has, and one of null term per
    document for its number of words."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_passes(batch["text"]):
                words = Words(data, offsets, ALNUM_WORDS)
                n = words.counts()
                hit = np.flatnonzero(_members(words.hashes, shared.value))
                of = np.repeat(np.arange(b - a), n)[hit]
                place = hit - words.first[of]
                order = np.lexsort((place, words.hashes[hit], of))
                of, place, term = of[order], place[order], words.hashes[hit][order]
                new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (term[1:] != term[:-1])]) if len(of) else np.zeros(0, dtype=np.int64)
                rows = np.concatenate([np.arange(a, b), of[new] + a])
                edges = np.concatenate([np.zeros(b - a + 1, dtype=np.int64), new[1:], [len(of)]] if len(new) else [np.zeros(b - a + 1, dtype=np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].take(pa.array(rows)), batch["doc_key"].take(pa.array(rows)), pa.array(n[rows - a], pa.int64()),
                        pa.array(np.concatenate([np.zeros(b - a, dtype=np.int64), term[new].view(np.int64)]), pa.int64(), mask=np.arange(len(rows)) < b - a),
                        pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(place, pa.int32())),
                    ],
                    names=["doc_id", "doc_key", "n_words", "term", "positions"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text").withColumn("doc_key", row_key("doc_id", "text"))
    return keyed.mapInArrow(run, f"doc_id {kind}, doc_key long, n_words long, term long, positions array<int>")


def phrases(terms: DataFrame, frequencies: DataFrame, window: int, rarest: int = RAREST) -> DataFrame:
    """phrase (hash of its words), size, item_id, item_key, terms and places: its rarest terms, the rarest first, and where
    in the phrase they stand. One row per window of each item."""
    item_kind = terms.schema["item_id"].dataType.simpleString()

    def windows(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("place").sort_values("place")
        term, df, n = part["term"].to_numpy(), part["df"].to_numpy(), len(part)
        size = min(window, n)
        one = Words.__new__(Words)
        one.hashes, one.first = term.view(np.uint64), np.array([0, n])
        keys = grams(one, window)[0].view(np.int64)
        rows = []
        for s in range(n - size + 1):
            order = sorted(range(s, s + size), key=lambda i: (df[i], term[i], i))
            seen, picked = set(), []
            for i in order:
                if term[i] not in seen and len(picked) < rarest:
                    seen.add(term[i])
                    picked.append(i)
            rows.append((keys[s], size, part["item_id"].iloc[0], part["item_key"].iloc[0], [int(term[i]) for i in picked], [i - s for i in picked]))
        return pd.DataFrame(rows, columns=["phrase", "size", "item_id", "item_key", "terms", "places"])

    known = terms.join(frequencies, "term", "left").fillna(0, ["df"])
    return known.groupBy("item_key").applyInPandas(windows, f"phrase long, size int, item_id {item_kind}, item_key long, terms array<long>, places array<int>")


def phrase_candidates(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, doc_key, phrase, size, start: where the rarest terms of a phrase stand as they do in it."""
    lists = index.where(F.col("term").isNotNull()).select("doc_id", "doc_key", "term", "positions")
    one = wanted.groupBy("phrase").agg(F.first("size").alias("size"), F.first(F.struct("terms", "places")).alias("t")).select("phrase", "size", "t.terms", "t.places")
    found = (
        one.withColumn("term", F.element_at("terms", 1)).join(lists, "term")
        .select("doc_id", "doc_key", "phrase", "size", "terms", "places", F.explode("positions").alias("at"))
        .withColumn("start", F.col("at") - F.element_at("places", 1)).where("start >= 0").drop("at")
    )
    later = lists.select(F.col("doc_id").alias("d2"), F.col("doc_key").alias("k2"), F.col("term").alias("t2"), "positions")
    for k in range(2, RAREST + 1):
        term, place = F.try_element_at("terms", F.lit(k)), F.try_element_at("places", F.lit(k))
        on = found.doc_id.eqNullSafe(later.d2) & (found.doc_key == later.k2) & (F.col("wanted") == later.t2)
        found = (
            found.withColumn("wanted", term).join(later, on, "left")
            .where(F.col("wanted").isNull() | F.array_contains("positions", F.col("start") + place))
            .drop("wanted", "d2", "k2", "t2", "positions")
        )
    return found.select("doc_id", "doc_key", "phrase", "size", "start")


def proximity_matches(index: DataFrame, terms: list[int], within: int) -> DataFrame:
    """doc_id, doc_key, at, start, stop: for each position ``at`` of the rarest term the shortest span around it that holds all
    ``terms`` in at most ``within`` words (the first of equals). ``terms`` are hashes, as ``test_terms`` gives them, the rarest
    first. Positions farther than ``within`` words from ``at`` are dropped as lists are joined."""
    lists = index.where(F.col("term").isNotNull())
    at = F.col("at")
    found = lists.where(F.col("term") == terms[0]).select("doc_id", "doc_key", F.explode("positions").alias("at"))
    found = found.withColumn("near", F.array().cast("array<array<int>>"))
    for t in dict.fromkeys(terms[1:]):
        if t == terms[0]:
            continue
        other = lists.where(F.col("term") == t).select(F.col("doc_id").alias("d2"), F.col("doc_key").alias("k2"), "positions")
        close = F.filter("positions", lambda p: F.abs(p - at) < within)
        found = (
            found.join(other, found.doc_id.eqNullSafe(other.d2) & (found.doc_key == other.k2)).withColumn("close", close).where(F.size("close") > 0)
            .select("doc_id", "doc_key", "at", F.concat("near", F.array("close")).alias("near"))
        )
    # a span begins at one of the positions up to ``at``, and ends where every other term has come after that
    starts = F.array_distinct(F.concat(F.array(at), F.filter(F.flatten("near"), lambda p: p < at)))
    nexts = lambda s: F.transform("near", lambda ps: F.array_min(F.filter(ps, lambda p: p >= s)))
    spans = F.transform(starts, lambda s: F.struct((F.greatest(at, F.array_max(nexts(s))) - s).alias("size"), s.alias("start"), F.exists(nexts(s), F.isnull).alias("open")))
    best = F.array_min(F.filter(spans, lambda x: ~x["open"] & (x["size"] < within)))
    return found.withColumn("best", best).where(F.col("best").isNotNull()).select(
        "doc_id", "doc_key", "at", F.col("best.start").alias("start"), (F.col("best.start") + F.col("best.size")).alias("stop")
    )


def _confirmed(docs: DataFrame, candidates: DataFrame, window: int) -> DataFrame:
    """doc_id, doc_key, n_hit, phrases: candidates whose words all agree, by document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cases = batch["cases"].to_pylist()
            hits, kept = [], []
            for a, b, data, offsets in text_passes(batch["text"]):
                words = Words(data, offsets, ALNUM_WORDS)
                for k in range(b - a):
                    own = words.hashes[words.first[k] : words.first[k + 1]]
                    mark, found = np.zeros(len(own), dtype=bool), set()
                    by_size: dict[int, np.ndarray] = {}
                    for case in cases[a + k]:
                        size, start = case["size"], case["start"]
                        if start + size > len(own):
                            continue
                        if size not in by_size:
                            one = Words.__new__(Words)
                            one.hashes, one.first = own, np.array([0, len(own)])
                            if size == window:
                                by_size[size] = grams(one, window)[0].view(np.int64)
                            else:  # a short item: every run of its length, hashed as a whole
                                runs = np.lib.stride_tricks.sliding_window_view(own, size)
                                one.hashes, one.first = runs.ravel(), np.arange(len(runs) + 1) * size
                                by_size[size] = grams(one, window)[0].view(np.int64)
                        if by_size[size][start] == case["phrase"]:
                            mark[start : start + size] = True
                            found.add(case["phrase"])
                    hits.append(int(mark.sum()))
                    kept.append(sorted(found))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["doc_key"], pa.array(hits, pa.int64()), pa.array(kept, pa.list_(pa.int64()))], names=["doc_id", "doc_key", "n_hit", "phrases"])

    keyed = docs.select("doc_id", "text").withColumn("doc_key", row_key("doc_id", "text"))
    cases = candidates.groupBy(F.col("doc_id").alias("d2"), F.col("doc_key").alias("k2")).agg(F.collect_set(F.struct("phrase", "size", "start")).alias("cases"))
    joined = keyed.join(cases, keyed.doc_id.eqNullSafe(cases.d2) & (keyed.doc_key == cases.k2)).select("doc_id", "doc_key", "text", "cases")
    return joined.mapInArrow(run, f"doc_id {kind}, doc_key long, n_hit long, phrases array<long>").dropDuplicates(["doc_id", "doc_key"]).where("n_hit > 0")


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """doc_id, doc_key, n_words, n_hit, n_items, items_sha256, contaminated: a row for each row of ``docs``.

    A document is contaminated if it has hit words, and they are at least one in ``share`` of its words."""
    terms = stage(test_terms(items), "test-terms")
    counted = [stage(document_frequencies(docs, block), "test-term-df") for block in term_blocks(terms)]
    wanted = stage(phrases(terms, reduce(DataFrame.unionAll, counted), window), "test-phrases")
    parts = [stage(positional_index(docs, block), "positional-index") for block in term_blocks(wanted.select(F.explode("terms").alias("term")))]
    counts = parts[0].where("term is null").select("doc_id", "doc_key", "n_words")
    found = phrase_candidates(reduce(DataFrame.unionAll, parts), wanted)
    hits = stage(_confirmed(docs, found, window), "phrase-hits")
    owner = wanted.select("phrase", F.col("item_id").cast("string").alias("item")).distinct()
    listed = (
        hits.select("doc_id", "doc_key", F.explode("phrases").alias("phrase")).join(owner, "phrase")
        .groupBy("doc_id", "doc_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    found_by_doc = hits.drop("phrases").join(listed.withColumnsRenamed({"doc_id": "d3", "doc_key": "k3"}), F.col("doc_id").eqNullSafe(F.col("d3")) & (F.col("doc_key") == F.col("k3")), "left")
    found_by_doc = found_by_doc.select(F.col("doc_id").alias("d2"), F.col("doc_key").alias("k2"), "n_hit", "items")
    out = counts.join(found_by_doc, counts.doc_id.eqNullSafe(found_by_doc.d2) & (counts.doc_key == found_by_doc.k2), "left")
    n_hit, listed_items = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "doc_key", "n_words", n_hit.alias("n_hit"), F.size(listed_items).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed_items, ","), 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with the columns of ``docs``."""
    bad = find_contamination(docs, items).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("doc_key").alias("__key")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__id"]) & (row_key("doc_id", "text") == bad["__key"]), "left_anti")
