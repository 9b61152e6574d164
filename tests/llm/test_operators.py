"""The training-data operators against brute force, round trips, the library and held-out labels, and on awkward rows."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyform.llm import chat, decontaminate, language_id, near_dedup, pages, pieces, quality, suffix_dedup, toxicity, urls
from tallyform.llm.queries import QUERIES, piece_model

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE_WORD, ALNUM_WORD = re.compile("[^\x20\x09-\x0d]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    """Awkward documents: nulls everywhere, empty, long, tied and repeated ones, an id with two texts."""
    rnd = random.Random(3)
    words = ["the", "of", "and", "Thing", "ertion", "é", "ñoño", "über", "x1", "#", "die", "der", "la", "que"]
    prose = [" ".join(rnd.choices(words, k=n)) for n in (3, 4, 60, 300, 300)]
    long = " ".join(rnd.choices(words, k=40_000))
    made = [*prose, prose[3], prose[3] + " more", long, "", None, " \n\t ", "a" * 3000, "ab" * 400 + "\n" + "é" * 300, "é" * 300, "one\ntwo\none\n\n", "x" * 199, "\x00 \x1c\x85 \ufffd 🇩🇪 ▁ </s>"]
    out = [(i, t, ["en", "de", None][i % 3], "s", None if t is None else len(t)) for i, t in enumerate(made)]
    return [*out, out[2], (2, "another text of the same id", "en", None, 1), (None, prose[4], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # columns whose names clash with the operators' own
    return spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("x"), "kept": F.lit(1), "label": F.lit(2), "node": F.lit(3), "runs": F.lit(4), "doc": F.lit(5), "n_words": F.lit(6)})


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def key(*values):
    return tuple((v is None, v) for v in values)


def test_quality_counts(docs, rows):
    got = sorted((key(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge_quality(docs).collect()))
    want = []
    for doc_id, text, *_ in rows:
        text = text or ""
        w = SPACE_WORD.findall(text)
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
        want.append(key(doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    assert got == sorted(want)


def test_quality_distance_is_that_of_the_definition():
    p, q = np.array([[0.5, 0.5, 0.0]]), np.array([[0.25, 0.25, 0.5]])
    m = (p + q) / 2
    want = (0.5 * sum(a * np.log2(a / c) for a, c in zip(p[0], m[0]) if a) + 0.5 * sum(b * np.log2(b / c) for b, c in zip(q[0], m[0]) if b)) ** 0.5
    assert abs(quality.js_distance(p, q)[0] - want) < 1e-12


def test_quality_rejects_labelled_junk_and_keeps_the_rest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    judged = quality.judge_quality(docs).join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("not base_failed")
    share = {r.quality: r.kept for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[0] < 0.05 and share[1] > 0.98


def many_languages(n):
    """``n`` languages of words of their own, the last with the least text."""
    rnd = random.Random(8)
    out = []
    for i in range(n):
        words = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}{a}{b}" for a in "aeiou" for b in "bdfglmnr"]
        out += [(len(out) + j, " ".join(rnd.choices(words, k=400 if i < n - 1 else 120)), f"l{i:02}", "s", 0) for j in range(2)]
    return out


def test_quality_keeps_documents_of_every_language(spark):
    rows = many_languages(66)
    judged = quality.judge_quality(spark.createDataFrame(rows, DOCS)).collect()
    assert len(judged) == len(rows) and all(r.kept and r.word_distance < 0.5 for r in judged)


def test_quality_references_against_counting(spark, corpus):
    params = quality.QualityParams()
    refs = quality.references(corpus)
    rows = [r for r in corpus.collect() if r.lang is not None]
    assert refs.langs == sorted({r.lang for r in rows})
    for i, lang in enumerate(refs.langs):
        raw = [r.text.encode() for r in rows if r.lang == lang and r.text is not None]
        data, offsets = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])
        counts = quality._class_counts(data, offsets)
        size = counts.sum(1)
        steps = ((counts * params.steps + size[:, None] // 2) // np.maximum(size, 1)[:, None])[size >= params.min_chars]
        median = np.sort(steps, axis=0)[(len(steps) - 1) // 2]
        assert np.allclose(refs.classes[i], median / median.sum())
        found = collections.Counter(w for t in raw for w in ALNUM_WORD.findall(lower(t.decode())))
        top = sorted((c for w, c in found.items() if len(w.encode()) <= params.word_bytes), reverse=True)[: params.common_words]
        assert np.allclose(np.sort(refs.shares[i][:-1])[::-1], np.array(top) / found.total())


def test_quality_ranks_are_cut_before_the_shuffle(spark, capsys):
    counts = spark.range(1000).selectExpr("if(id % 2 = 0, 'de', 'en') AS lang", "'word' AS kind", "id AS key", "id % 7 AS n")
    common = quality._common(counts, quality.QualityParams())
    common.explain()
    plan = capsys.readouterr().out
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")
    want = [k for lang in (0, 1) for k in sorted((k for k in range(1000) if k % 2 == lang), key=lambda k: (-(k % 7), k))[:64]]
    assert sorted(r.key for r in common.collect()) == sorted(want)


def similar(rows, k):
    sets = []
    for _, text, *_ in rows:
        w = SPACE_WORD.findall(lower(text or ""))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return [(r[0], len(sets[i]), min(least[find(i)], default=None) if sets[i] else r[0]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("k", [4, 5])
def test_near_components(docs, rows, k):
    got = sorted(key(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_components(docs, k).collect())
    assert got == sorted(key(*x) for x in similar(rows, k))


def test_near_components_of_edited_copies(spark):
    """Copies that are edited apart by more than the bound from each other, but not from the original."""
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(2000)]
    made = []
    for _ in range(6):
        seed = rnd.choices(vocabulary, k=200)
        made.append(list(seed))
        for edits in range(25):
            copy = list(seed)
            for _ in range(edits % 7):
                copy[rnd.randrange(200)] = rnd.choice(vocabulary)
            made.append(copy)
    rnd.shuffle(made)
    rows = [(i, " ".join(w)) for i, w in enumerate(made)]
    got = sorted(key(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect())
    assert got == sorted(key(*x) for x in similar(rows, 4))


def test_near_components_of_copies_without_original(spark, monkeypatch):
    """Large buckets whose members lie on both sides of the bound: compared in blocks, smaller here than in use."""
    monkeypatch.setattr(near_dedup, "SMALL", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    seed = rnd.choices(vocabulary, k=150)
    rows = []
    for i in range(150):
        copy = list(seed)
        for _ in range(rnd.choice([3, 4, 4, 5, 5])):
            copy[rnd.randrange(150)] = rnd.choice(vocabulary)
        rows.append((i, " ".join(copy)))
    want = sorted(key(*x) for x in similar(rows, 4))
    got = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted(key(r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert len({x[2] for x in want}) > 10


def test_joining_links():
    shared = np.array([[10, 9, 0, 9], [9, 10, 9, 0], [0, 9, 10, 0], [9, 0, 0, 10]])
    n = np.array([10, 10, 10, 10])
    assert near_dedup._joining(shared, n, np.array([5, 6, 7, 5])) == [(0, 1), (1, 2)]
    assert near_dedup._joining(np.zeros((2, 2)), n[:2], np.array([1, 2])) == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (3, 10), (8, 7), (7, 9), (5, 5)]
    got = {r.u: r.root for r in near_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {2: 1, 3: 1, 10: 1, 8: 7, 9: 7}


def removed(texts, length=200):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        spans = sum(1 for i, m in enumerate(mark) if m and (not i or not mark[i - 1]))
        out.append((len(t), sum(mark), spans, sha(bytes(c for c, m in zip(t, mark) if not m))))
    return out


@pytest.mark.parametrize("per_salt", [2000, 2])
def test_suffix_removal(docs, rows, monkeypatch, per_salt):
    monkeypatch.setattr(suffix_dedup, "PER_SALT", per_salt)
    some = [r for r in rows if r[1] is None or len(r[1]) < 20_000]
    got = sorted(key(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removal_digests(docs.where("text is null or length(text) < 20000")).collect())
    assert got == sorted(key(r[0], *x) for r, x in zip(some, removed([(r[1] or "").encode() for r in some])))


@pytest.mark.parametrize("per_salt", [2000, 3])
def test_suffix_removal_of_the_corpus(corpus, monkeypatch, per_salt):
    monkeypatch.setattr(suffix_dedup, "PER_SALT", per_salt)
    rows = corpus.select("doc_id", "text").collect()
    got = sorted(key(*r) for r in suffix_dedup.removal_digests(corpus).collect())
    assert got == sorted(key(r.doc_id, *x) for r, x in zip(rows, removed([(r.text or "").encode() for r in rows])))


def test_suffix_array_and_prefixes():
    data = np.frombuffer(b"abracadabra\xffabracadabra abra\xff", dtype=np.uint8)
    order, place = suffix_dedup.suffix_array(data)
    raw = data.tobytes()
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    lcp = suffix_dedup.common_prefixes(data, order, place, np.array([0, 12]), np.array([12, 17]), 200)
    for a, b, n in zip(order, order[1:], lcp[1:]):
        assert n == next(k for k in range(99) if raw[a + k : a + k + 1] != raw[b + k : b + k + 1])


def hits(rows, items, size=13):
    windows, out = collections.defaultdict(set), []
    for item, text in items:
        w = ALNUM_WORD.findall(lower(text or ""))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(str(item) if item is not None else None)
    for doc_id, text, *_ in rows:
        w = ALNUM_WORD.findall(lower(text or ""))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        found = sorted(x for x in found if x is not None)
        out.append(key(doc_id, len(w), len(hit), len(found), sha(",".join(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_contamination(spark, docs, rows, monkeypatch):
    body = (rows[3][1]).split()
    items = [(1, " ".join(body[5:40])), (2, "the of"), (3, None), (4, ""), (5, " ".join(body[5:40])), (None, " ".join(body[50:70])), (6, "never seen words " * 9)]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1))
    for block in (decontaminate.TERMS_PER_BLOCK, 5):
        monkeypatch.setattr(decontaminate, "TERMS_PER_BLOCK", block)
        found = decontaminate.find_contamination(docs, table)
        # equal rows are one document to the index: each has its row, found by either
        assert sorted(key(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()) == hits(rows, items)


def test_contamination_of_the_corpus(spark, corpus):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = decontaminate.find_contamination(corpus, items)
    want = hits(corpus.select("doc_id", "text").collect(), [tuple(r) for r in items.select("item_id", "text").collect()])
    assert sorted(key(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()) == want


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red a b blue"), (2, "red a b c d e blue"), (3, "blue red")], "doc_id long, text string")
    terms = {r.place: r.term for r in decontaminate.test_terms(spark.createDataFrame([(1, "red blue")], "item_id long, text string")).collect()}
    index = decontaminate.positional_index(docs, np.sort(np.array(list(terms.values()), dtype=np.int64).view(np.uint64)))
    got = {(r.doc_id, r.start, r.stop) for r in decontaminate.proximity_matches(index, [terms[0], terms[1]], 4).collect()}
    assert got == {(1, 0, 3), (3, 0, 1)}


def test_pieces_equal_the_library(docs, corpus):
    spm = pytest.importorskip("sentencepiece")
    library, own = spm.SentencePieceProcessor(model_file=piece_model()), pieces.Pieces(piece_model())
    rnd = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "the", "▁", "é", "日本", "😀", "\x00", "</s>", "<0x0A>", "2023", ".", "́", "\r\n", "ing", "🇩🇪", "�"]
    odd = ["".join(rnd.choices(parts, k=rnd.randint(0, 60))) for _ in range(300)] + ["", " ", "a" * 500, "=-" * 200 + " " + "x" * 90]
    for text in odd:
        ids, spans = own.encode(text)
        assert ids == [*library.encode(text), 2] and own.decode(ids) == library.decode(ids)
        assert b"".join(text.encode()[a:b] for a, b in spans) == text.encode()
    for table in (docs, corpus):
        texts = [(r.doc_id, r.text or "") for r in table.select("doc_id", "text").collect()]
        want = [key(i, len(e := [*library.encode(t), 2]), sha(" ".join(map(str, e))), sha(library.decode(e)), len(t.encode())) for i, t in texts]
        assert sorted(key(*r) for r in pieces.encoding_digests(table, piece_model()).collect()) == sorted(want)


def test_character_map():
    """A map built by hand: trie units as the compiled form has them, then longest-prefix rewriting with source bytes."""
    units = [0] * 1024
    base = {b"": 256, b"a": 512, b"ab": 768}
    units[0] = base[b""] << 10
    leaf_a, leaf_ab = 0, 2
    units[256 ^ 97] = (((256 ^ 97) ^ 512) << 10) | 1 << 8 | 97
    units[512] = 1 << 31 | leaf_a
    units[512 ^ 98] = (((512 ^ 98) ^ 768) << 10) | 1 << 8 | 98
    units[768] = 1 << 31 | leaf_ab
    trie = b"".join(u.to_bytes(4, "little") for u in units)
    entries = pieces.read_character_map(len(trie).to_bytes(4, "little") + trie + b"X\0YY\0")
    assert entries == {b"a": "X", b"ab": "YY"}
    text, source = pieces.Normalizer(entries, add_dummy_prefix=False)("cab aé")
    assert (text, source) == ("cYY▁Xé", [0, 1, 1, 3, 4, 5, 7])
    assert pieces.Normalizer({}, True, True)("  a  b ")[0] == "▁a▁b"


def test_language(spark, docs, rows):
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language_id.train(language_id.sample(corpus))
    got = language_id.identify(corpus, net=net).join(corpus.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95
    odd = language_id.identify(docs, net=net).collect()
    assert len(odd) == len(rows) and all(0 <= r.score <= 1 for r in odd)
    assert {r.lang_pred for r in odd if r.doc_id in (8, 9, 10)} == {"und"}
    nothing = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_language_sample_has_every_language(spark):
    rows = [r for i, t, lang, s, n in many_languages(66) for r in [(4 * i + k, t, lang, s, n) for k in range(4)]]
    long = [(10_000 + i, f"é{i:04} " * 2000, "long", "s", 0) for i in range(20)]
    empty = [(20_000 + i, "", "l00", "s", 0) for i in range(20)]
    params = language_id.LanguageParams(docs=100, steps=1)
    got = language_id.sample(spark.createDataFrame(rows + long + empty, DOCS), params)
    count = collections.Counter(lang for _, lang in got)
    assert set(count) == {r[2] for r in rows + long} and max(count.values()) == 1 and all(t for t, _ in got)
    stretch = next(t.decode() for t, lang in got if lang == "long")
    assert len(stretch) == params.doc_chars and any(stretch in r[1] for r in long)
    net = language_id.train(got, params)
    assert len(net.langs) == 67
    assert np.allclose(language_id.pooled(net, np.frombuffer(b"abcd" * 99, dtype=np.uint8), np.array([0, 100, 396]), 128).sum(1), 1, atol=1e-4)


def test_language_gradient():
    """Backpropagation through time against differences."""
    rng = np.random.default_rng(0)
    inputs, own = rng.normal(0, 0.4, (6, 256)).astype(np.float64), rng.normal(0, 0.4, (6, 2)).astype(np.float64)
    x, weight = rng.integers(0, 9, (5, 3)).astype(np.uint8), rng.normal(0, 1, (5, 2, 3))
    loss = lambda: float((language_id._states(x, inputs, own, False)[0] * weight).sum())
    _, kept = language_id._states(x, inputs, own, True)
    dinputs, downs = language_id._back(weight, kept, x, own)
    for table, grad, at in ((own, downs, (1, 0)), (own, downs, (5, 1)), (inputs, dinputs, (0, int(x[2, 1]))), (inputs, dinputs, (4, int(x[0, 0])))):
        was = table[at]
        table[at] = was + 1e-3
        up = loss()
        table[at] = was - 1e-3
        down = loss()
        table[at] = was
        assert abs((up - down) / 2e-3 - grad[at]) < 5e-3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_s"), reason="a table with enough labels is not here")
def test_toxicity(spark, docs, rows):
    # sf0.1 has 300 toxic labels to learn from, which give a held-out recall of 0.88 (see the README).
    corpus, labels = (spark.read.parquet(f"/root/testdata/check_s/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.train(corpus, labels)
    got = toxicity.score(corpus, labels, scorer=scorer).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit / sum(r.toxic for r in got) > 0.9 and hit / sum(r.predicted for r in got) > 0.95
    texts = [(i, f"The {w} of the thing.", None, None, None) for i, words in enumerate(toxicity.GROUP_WORDS) for w in words]
    assert not toxicity.score(spark.createDataFrame(texts, DOCS), labels, scorer=scorer).where("predicted = 1").count()
    assert len(toxicity.score(docs, labels, scorer=scorer).collect()) == len(rows)
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {1 / (1 + np.exp(20.0))}


def test_toxicity_counterfactuals():
    texts = ["The Women and women, not womenfolk.", "nothing named", "", "Die Männer"]
    raw = [t.encode() for t in texts]
    one, two = toxicity.counterfactuals(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
    swapped = re.fullmatch(r"The (\w+) and (\w+), not womenfolk\.", one[0].decode())
    assert swapped[1] == swapped[2] != "women" and swapped[1] in toxicity.GROUP_WORDS[0]
    assert two[0].decode() == "The  and , not womenfolk." and two[3] == b"Die "
    assert one[3].decode()[4:] in set(toxicity.GROUP_WORDS[1]) - {"männer"}
    every = {w for words in toxicity.GROUP_WORDS for w in words}
    for i in (1, 2):
        a, b = (v[i].decode().removeprefix(texts[i] + " ") for v in (one, two))
        assert a != b and {a, b} <= every


def test_toxicity_of_neutral_mentions_where_labels_go_along_with_groups(spark):
    rnd = random.Random(4)
    words = [a + b for a in "bcdfghlmnprst" for b in ("alo", "emi", "iro", "osa", "une")]
    rows, marks = [], []
    for i in range(3000):
        bad = i % 8 == 0
        text = rnd.choices(words, k=40) + ["vile"] * (bad and rnd.random() < 0.7) + [rnd.choice(toxicity.GROUP_WORDS[0])] * (rnd.random() < (0.9 if bad else 0.02))
        rnd.shuffle(text)
        rows.append((i, " ".join(text), "en", "s", 0))
        marks.append((i, int(bad)))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    scorer = toxicity.train(spark.createDataFrame(rows, DOCS), labels)
    said = ["", *toxicity.GROUP_WORDS[0], "vile"]
    table = spark.createDataFrame([(i, " ".join([*words[:40], w]), "en", "s", 0) for i, w in enumerate(said)], DOCS)
    got = {said[r.doc_id]: r.score for r in toxicity.score(table, labels, scorer=scorer).collect()}
    assert max(got[w] for w in toxicity.GROUP_WORDS[0]) < 0.3 <= got["vile"]


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST]"
    turns = [(-1, 0, "user", said), (-1, 1, "assistant", said), (1, 0, "system", "be [\\INST] kind"), (2, 0, None, None), (2, 1, "tool [SAYS] x", "<\\\\s> [[/INST] "), (None, 0, "assistant", "a"), (None, 0, "assistant", "a")]
    turns += [(1, t, ["user", "assistant"][t % 2], f"turn {t} " + "word " * (t * 7) + said * (t % 3)) for t in range(1, 30)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    windows = chat.format_windows(table, budget=120, history=40)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(windows).collect()}
    by = collections.defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn, role or "", text or ""))
    for conv, own in by.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert got[conv] == (len(own), sha("".join(f"{r}\n{t}\n" for _, r, t in own)), len(loss), sha(loss))
    parts = windows.where("conv_id = 1").orderBy("window").collect()
    assert len(parts) > 3 and all(w.text.startswith("<s><<SYS>> ") for w in parts)
    assert all(w.text[3:].count("[INST] ") + w.text.count("[ANS] ") > 0 for w in parts)
    assert not chat.format_windows(table.limit(0)).collect()


def test_pages(spark):
    raw = spark.read.parquet(f"{SF}/pages.parquet")
    labeller = pages.train_blocks(pages.sample(raw))
    for r in pages.extract(raw, model=labeller).join(raw.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(__import__("html").unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", body))).split())
        assert (r.text, r.n_chars) == (want, len(want))
    odd = ["", None, "plain", "<p>unclosed <b>bold", "<article><p>Said &eacute; &#x41;&am", "<script>var a='<p>x</p>'", "<article>" + "<p>word</p>" * 3000 + "</article>", "<div <p"]
    table = spark.createDataFrame([(i, None, h) for i, h in enumerate(odd)] + [(None, "u", odd[4])], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in pages.extract(table, model=labeller).collect()}
    assert len(got) == 9 and got[0] == got[1] == got[5] == "" and got[6].count("word") == 3000
    assert {r.text for r in pages.extract(table.limit(0)).collect()} == set()


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ('<p>one <svg class="icon" /> two</p><p>three</p>', ["one two", "three"]),
        ('<p>one <svg><path d="M0"/><g><text>T</text></g></svg> two</p><p>three</p>', ["one T two", "three"]),
        ("<p>one <svg><path> two</p><p>three</p>", ["one two", "three"]),
        ("<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p>", ["let x=1 be"]),
        ("<p>let <math /> be</p><p>three</p>", ["let be", "three"]),
        ("<div>a<math><mi>x<p>b</p>c</div><p>d</p>", ["ax", "b", "c", "d"]),
        ('<object data="x"/><p>one</p>', ["one"]),
        ("<object><p>one</p></object><p>two</p>", ["one", "two"]),
        ("<div><object><param name=x>one</div><p>two</p>", ["one", "two"]),
        ("<p>a <noscript>b</noscript> c</p><p>d</p>", ["a", "b", "c", "d"]),
        ('<iframe src="x"/><p>one</p><canvas>two<p>three</p>', ["one", "two", "three"]),
        ("<p>a<svg><style>.b{}</style><title>t</title><title/></svg>b</p><select><option>no</select><textarea>no</textarea><p>c</p>", ["ab", "c"]),
    ],
)
def test_page_blocks_around_embedded_elements(inner, want):
    cut = pages.blocks(f"<body><article>{inner}</article><footer>end</footer></body>")
    assert [b.text for b in cut] == [*want, "end"]
    assert [pages.markup_label(b.path) for b in cut] == [True] * len(want) + [False]
    assert all([e[0] for e in b.path][:2] == ["body", "article"] for b in cut[:-1])


def test_page_paragraph_goes_on_after_what_is_embedded():
    cut = pages.blocks("<article><p class=advert>a <noscript>b</noscript> c</p>d</article>")
    assert [(b.text, pages.markup_label(b.path)) for b in cut] == [("a", False), ("b", False), ("c", False), ("d", True)]


def test_urls(spark):
    rows = [
        (1, "https://a.example.net/en/1?x"), (2, "http://EXAMPLE.NET/fr/1"), (3, "http://www.example.com/de/"), (4, "https://x.org/fr/2#t"), (5, "https://x.example.com/en/7"),
        (6, None), (7, "no scheme"), (8, "http://badexample.net/en/"), (9, "http://net"), (10, "https://x.example.com/en/7"), (10, "https://x.example.com/en/7"), (None, "https://y.org/a"), (11, "s://h?q/en/"), (12, "https://z.org/" + "a" * 20_000),
    ]
    table = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("clash"), "score": F.lit(1)})
    got = urls.judge_urls(table).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert (by[2].host, by[2].rule, by[2].verdict) == ("example.net", "net/", "block")
    assert (by[3].rule, by[3].verdict, by[4].rule, by[4].verdict) == ("example.com/de/", "block", "org/fr/", "allow")
    assert (by[6].host, by[6].path, by[7].host, by[7].path) == ("", "", "", "")
    assert (by[8].rule, by[9].rule, by[11].host, by[11].path, by[11].rule) == ("net/", None, "h", "", None)
    assert {r.verdict for r in got} <= {"allow", "block"} and all((r.score is None) == (r.rule is not None) for r in got)
    alone = urls.judge_urls(table.where("page_id = 5")).collect()
    assert [(r.verdict, r.score, r.bound) for r in alone] == [("allow", 0.0, 0.0)]


def test_url_scores_against_counting(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    got = {(r.page_id): (r.verdict, r.score, r.bound) for r in urls.judge_urls(table).collect()}
    judged = urls.ruled(table).collect()
    counts = {v: [collections.Counter() for _ in range(4)] for v in ("allow", "block")}
    windows = lambda u: [("\x02" * 3 + u + "\x02")[i : i + 4] for i in range(len(u) + 1)]
    for r in judged:
        if r.ruling:
            for g in windows(r.url):
                for k in range(4):
                    counts[r.ruling][k][g[3 - k :]] += 1

    def p(v, g):
        out = 1 / 256
        for k in range(4):
            own = counts[v][k]
            after = [c for x, c in own.items() if x[:k] == g[3 - k : 3]]
            if after:
                out = (own[g[3 - k :]] + len(after) * out) / (sum(after) + len(after))
        return out

    memo = {}
    score = lambda g: memo.setdefault(g, np.log(p("allow", g)) - np.log(p("block", g)))
    for r in [r for r in judged if not r.ruling][:15]:
        ws = windows(r.url)
        assert abs(got[r.page_id][1] - sum(map(score, ws)) / len(ws)) < 1e-6


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if re.match(r"op(\d|10)_", n)))
def test_registered_query(spark, name):
    out = QUERIES[name](spark, SF)
    table = {"op8_chat_windows": "conversations", "op9_block_labeller": "pages", "op10_url_ratio": "pages"}.get(name, "documents")
    source = spark.read.parquet(f"{SF}/{table}.parquet")
    want = source.select("conv_id").distinct().count() + 1 if table == "conversations" else source.count()
    assert out.count() == want


ARTICLE = "<html><body><nav class=menu><a href=/>Home</a></nav><article>{}</article><footer>bye</footer></body></html>"


def test_pages_of_any_length_are_learned_from(spark):
    """Pages that are all longer than 50,000 characters."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    longer = rows.withColumn("html", F.concat("html", F.lit("<!--" + "x" * 60_000 + "-->")))
    got = {r.page_id: r.text for r in pages.extract(longer).collect()}
    want = {r.page_id: r.text for r in pages.extract(rows).collect()}
    assert sum(map(len, got.values())) > 100_000 and sum(got[k] == want[k] for k in want) >= 0.98 * len(want)


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article class=it's><p>one</p><p>two</p></article>", ["one", "two"]),
        ("<p title=\"a>b\">one</p><p title='c>\"d'>two", ["one", "two"]),
        ("<p a\"b>one</p><p>two</p>", ["one", "two"]),
        ("<div><a href=x/>one</a> two</div>", ["one two"]),
        ("<p a = 'x>' b=y'>one</p>", ["one"]),
        ("<p>one</p><p title='never closed>two", ["one"]),
    ],
)
def test_attribute_values(page, want):
    assert [b.text for b in pages.blocks(page)] == want


def test_runs_and_groups_of_pages_change_nothing(spark, monkeypatch):
    rows = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    params = pages.PageParams(rounds=40)
    model, cut = pages.train(rows, params), [pages.blocks(h) for h in rows]
    want = pages.label(model, cut, params, pages.Encoder(params))
    for run, cells in ((1, 1), (3, 50), (7, 10_000)):
        monkeypatch.setattr(pages, "RUN", run)
        monkeypatch.setattr(pages, "CELLS", cells)
        assert all((a == b).all() for a, b in zip(want, pages.label(model, cut, params, pages.Encoder(params)), strict=True))


def test_a_page_of_200_000_blocks_beside_small_ones():
    import resource

    params = pages.PageParams(rounds=5)
    small = [ARTICLE.format("<p>word</p>" * n) for n in range(1, 100)]
    model = pages.train(small, params)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    cut = [pages.blocks(p) for p in [*small, ARTICLE.format("<p>word</p>" * 200_000)]]
    marks = pages.label(model, cut, params, pages.Encoder(params))
    assert len(marks[-1]) == 200_002 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20


def brute_windows(turns, budget, history):
    """(first, start, stop, tokens) of windows, by trying every number of turns."""
    sizes = [chat.tokens(t) for _, t in turns]
    system = turns[0][0] == "system" if turns else False
    out, start = [], 0
    while start < len(turns):
        own = sizes[0] if system and out else 0
        first = start
        if out:
            while first > int(system) and sum(sizes[first - 1 : start]) <= history:
                first -= 1
        while first < start and own + sum(sizes[first : start + 1]) > budget:
            first += 1
        stop = start + 1
        while stop < len(turns) and own + sum(sizes[first : stop + 1]) <= budget:
            stop += 1
        out.append((first, start, stop, own + sum(sizes[first:stop])))
        start = stop
    return out


@pytest.mark.parametrize("budget, history", [(40, 12), (40, 0), (25, 100), (9, 3), (10_000, 50)])
def test_chat_windows_keep_the_budget(spark, budget, history):
    rnd = random.Random(budget)
    talks = {c: [("system" if not k and c % 2 else rnd.choice(["user", "assistant"]), " ".join(["w"] * rnd.choice([0, 1, 3, 8, 20, 45]))) for k in range(rnd.choice([1, 2, 6, 40]))] for c in range(60)}
    df = spark.createDataFrame([(c, k, r, t) for c, ts in talks.items() for k, (r, t) in enumerate(ts)], "conv_id long, turn long, role string, text string")
    got = collections.defaultdict(list)
    for w in chat.format_windows(df, budget, history).orderBy("conv_id", "window").collect():
        got[w.conv_id].append((w.first_turn, w.n_history, w.n_tokens, len(list(chat.parse(w.text)))))
    for c, turns in talks.items():
        want, again = brute_windows(turns, budget, history), int(turns[0][0] == "system")
        assert got[c] == [(s, s - f + (again if k else 0), n, e - f + (again if k else 0)) for k, (f, s, e, n) in enumerate(want)]
        for first, start, stop, n in want:
            assert n <= budget or stop == start + 1 and first == start


def test_proximity_against_brute_force(spark):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choices(["red", "blue", "green", "x", "y"], weights=[1, 2, 2, 3, 3], k=rnd.randint(0, 30))) for _ in range(80)]
    texts.append("w w w w w w w w blue w red w w blue green")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = [r.term for r in decontaminate.test_terms(spark.createDataFrame([(1, "red blue green")], "item_id long, text string")).orderBy("place").collect()]
    index = decontaminate.positional_index(docs, np.sort(np.array(terms, dtype=np.int64).view(np.uint64)))
    got = {(r.doc_id, r.at, r.start, r.stop) for r in decontaminate.proximity_matches(index, terms, 5).collect()}
    want = set()
    for d, text in enumerate(texts):
        words = text.split()
        for at in (k for k, w in enumerate(words) if w == "red"):
            spans = [(b - a, a, b) for a in range(max(0, at - 4), at + 1) for b in range(at, min(len(words), a + 5)) if {"red", "blue", "green"} <= set(words[a : b + 1])]
            if spans:
                size, a, b = min(spans)
                want.add((d, at, a, b))
    assert got == want and (80, 10, 10, 14) in got


def test_blocks_of_terms_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "TERMS_PER_BLOCK", 20)
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(60))) for k in range(5)], "item_id long, text string")
    blocks = list(decontaminate.term_blocks(decontaminate.test_terms(items)))
    assert max(map(len, blocks)) <= 20 and sum(map(len, blocks)) == 300 == len(set(np.concatenate(blocks).tolist()))
