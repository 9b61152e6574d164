"""Fill-in-middle, packing and turn repair against brute force, on awkward rows and on the given tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyform.llm import infill, packing, repair
from tallyform.llm.queries import ORACLE, QUERIES, word_vocabulary

SF = "/root/testdata/sf0.001"
UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def sort_key(values):
    return tuple((v is None, v) for v in values)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    words = ["the", "Thing", "é", "ñoño", "über", "don't", "x1", "#", "\n", "\t", "  ", "日本", "😀", "'s", "é", "3.14", "<|endoftext|>", " ", "\x1c"]
    made = [" ".join(rnd.choices(words, k=n)) for n in (1, 2, 5, 60, 300, 5000)]
    made += ["", None, "   ", " a", "a ", "a  b \n", "<P>", "x <M> y", "<S", "a<" * 40, "é" * 300, "x" * 500, "word " * 4095, "word " * 8191]
    made += [" ".join(rnd.choices(words, k=rnd.randint(0, 40))) for _ in range(150)]
    return [(k, t) for k, t in enumerate(made)] + [(3, made[3]), (3, "same id"), (None, "no id at all"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = {c: F.lit(1) for c in ("n", "form", "ids", "start", "id", "frames", "output", "offset", "marked")}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash).repartition(3)


def infilled(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("frame_bytes", [4, 7, 64, infill.FRAME_BYTES])
def test_infill(docs, rows, frame_bytes):
    done = infill.fill_in_middle(infill.frame_texts(docs, frame_bytes=frame_bytes))
    want = [(d, t, *infilled(d, t)) for d, t in rows]
    got = [tuple(r) for r in infill.digests(done).collect()]
    assert sorted(got, key=sort_key) == sorted(((d, *x[:4], sha(x[4]), sha(t or "")) for d, t, *x in want), key=sort_key)
    shown = [tuple(r) for r in infill.texts(done).collect()]
    assert sorted(shown, key=sort_key) == sorted(((d, x[1], x[4]) for d, t, *x in want), key=sort_key)
    assert {x[3] for x in want} == {"plain", "psm", "spm"}


def test_infill_keeps_whole_frames_as_they_are(spark):
    """Only the cut frames are compressed anew, and the output is one zstandard stream."""
    import zstandard

    text = " ".join(str(k) for k in range(200_000))
    for doc_id in range(40):
        if infilled(doc_id, text)[1] != "plain":
            break
    framed = infill.frame_texts(spark.createDataFrame([(doc_id, text)], "doc_id long, text string"), frame_bytes=10_000)
    stored = {bytes(f.data) for f in framed.first().frames}
    output = [bytes(x) for x in infill.fill_in_middle(framed).first().output]
    assert len(stored) > 100 and len(stored - set(output)) <= 2
    stream = zstandard.ZstdDecompressor().stream_reader(b"".join(output), read_across_frames=True).read()
    assert stream.decode() == infilled(doc_id, text)[4]


def test_infill_of_an_empty_table(spark):
    framed = infill.frame_texts(spark.createDataFrame([], "doc_id long, text string"))
    assert infill.digests(infill.fill_in_middle(framed)).collect() == []


def library_ids(texts):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(word_vocabulary())
    coder.encode_special_tokens = True
    return [x.ids + [2] for x in coder.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_packing(pieces, docs, capacity=4096):
    """Every id lies in one piece, sequences have no gap, and padding is none."""
    want = collections.Counter((d, tuple(ids)) for d, ids in docs)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, dtype="<u4")
        by_doc[(p.doc_id, p.doc_tokens)].append((p.start, ids))
        by_sequence[p.sequence_id].append((p.offset, len(ids)))
    single = {k: v for k, v in collections.Counter((d, len(ids)) for d, ids in docs).items() if v == 1}
    for d, ids in docs:
        if (d, len(ids)) in single:
            parts = sorted(by_doc[(d, len(ids))], key=lambda x: x[0])
            assert [s for s, _ in parts] == [0, *np.cumsum([len(i) for _, i in parts])[:-1]]
            assert np.concatenate([i for _, i in parts]).tolist() == list(ids)
    assert sum(len(i) for parts in by_doc.values() for _, i in parts) == sum(len(ids) * n for (_, ids), n in want.items())
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n
            at += n
        assert at == capacity or at & (at - 1) == 0 and at < capacity


def test_packing(docs, rows):
    pieces = packing.pack(docs, word_vocabulary(), 2)
    got = pieces.collect()
    check_packing(got, list(zip([d for d, _ in rows], library_ids([t for _, t in rows]), strict=True)))
    shown = packing.piece_digests(pieces).collect()
    assert sorted((r.sequence_id, r.offset, r.length, r.ids_crc32) for r in shown) == sorted((r.sequence_id, r.offset, len(r.ids) // 4, zlib.crc32(r.ids)) for r in got)
    assert packing.pack(docs.limit(0), word_vocabulary(), 2).collect() == []


def test_packing_of_the_corpus(spark):
    corpus = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = corpus.collect()
    check_packing(packing.pack(corpus, word_vocabulary(), 2).collect(), [(r.doc_id, ids) for r, ids in zip(found, library_ids([r.text for r in found]), strict=True)])


def test_encoder_equals_the_library(monkeypatch):
    import pyarrow as pa

    from tallyform.llm.shared import text_passes

    rnd = random.Random(1)
    parts = "a B the 's ' ’ é é ́ ̈ ≠ ≠ K İ ß ΣΣ Σ 1 ² ½ ١ \u0085 \x1c \x00 한글 각 日本 😀 🇩🇪 _ - . ... <|endoftext|> don't 'STORE 'd ﬁ ǅ Å ʼ Éa ÿ ×".split(" ")
    texts = ["".join(rnd.choices([*parts, " ", "\n", " "], k=rnd.randint(0, 25))) for _ in range(5000)]
    want = library_ids(texts)
    for remembered in (100, packing.REMEMBERED):
        monkeypatch.setattr(packing, "REMEMBERED", remembered)
        coder = packing.Encoder(word_vocabulary())
        for first, stop, data, offsets in text_passes(pa.array(texts), 4000):
            ids, begin = coder.encode(data, offsets)
            for k in range(stop - first):
                assert ids[begin[k] : begin[k + 1]].tolist() == want[first + k][:-1], texts[first + k]


@pytest.mark.parametrize("classes", [2, 3, 8, 64])
def test_harmonic_classes(classes):
    """Before the end of a task every closed bin holds exactly as many pieces as its class has places, and is full."""
    rnd = random.Random(classes)
    bins = packing.Harmonic(0, 64, classes)
    for d in range(4000):
        bins.add(d, np.arange(rnd.choice([1, 5, 20, 63, 64, 65, rnd.randint(1, 300)]), dtype="<u4"))
    by_bin = collections.defaultdict(list)
    for _, _, ids, _, sequence, _ in bins.take():
        by_bin[sequence].append(len(ids))
    for sizes in by_bin.values():
        assert sum(sizes) == 64
        # the last class is filled one behind the other
        assert max(sizes) - min(sizes) <= 1 and len(sizes) <= classes or max(sizes) * classes <= 64
    assert {len(s) for s in by_bin.values()} >= set(range(1, min(classes, 5)))
    assert all(len(v) < j for j, v in bins.bins.items())
    bins.finish()
    sizes = collections.Counter()
    for _, _, ids, _, sequence, _ in bins.take():
        sizes[sequence] += len(ids)
    assert all(s == 64 or s & (s - 1) == 0 for s in sizes.values())
    assert len(set(sizes.values()) - {64}) == len([s for s in sizes.values() if s < 64])


def brute_report(turns):
    """Faults and the cheapest repair of one conversation's (turn, role, text), by states and whole strings."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    seen, faults = set(), []
    for _, role, text in turns:
        end = text.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {(len(turns), 0): (0, ""), (len(turns), 3): (0, ""), (len(turns), 2): (3, "I"), (len(turns), 1): (6, "II")}
    after = {"s": 1, "u": 2, "a": 3}
    for i in range(len(turns) - 1, -1, -1):
        role, must, more = turns[i][1][:1], faults[i] in ("blank", "duplicate"), 3 * (faults[i] == "truncated")

        def there(state, cost, edit, i=i):
            rest = best[(i + 1, state)]
            return rest[0] + cost, edit + rest[1]

        def direct(state, role=role, must=must, more=more, there=there):
            found = [there(state, 4, "D")]
            if not must:
                if (state, role) in ((0, "s"), (0, "u"), (1, "u"), (3, "u"), (2, "a")):
                    found.append(there(after[role], more, "K"))
                found.append(there(3 if state == 2 else 2, 3 + more, "R"))
            return min(found)

        for state in range(4):
            found, now, cost = [direct(state)], state, 0
            for k in range(1, 4):
                now, cost = 3 if now == 2 else 2, cost + 3
                x = direct(now)
                found.append((x[0] + cost, "I" * k + x[1]))
            best[(i, state)] = min(found)
    cost, audit = best[(0, 0)]
    state, at, lines = 0, 0, []
    for edit in audit:
        if edit in "RI":
            lines.append(("assistant" if state == 2 else "user") + ":" + ("" if edit == "I" else turns[at][2]))
        elif edit == "K":
            lines.append(f"{turns[at][1]}:{turns[at][2]}")
        if edit != "D":
            state = after[lines[-1][0]]
        at += edit != "I"
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    known = [t[0] for t in turns if t[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:], strict=False)]
    return (
        max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(lines)),
    )


def brute_repair(turns):
    talks = collections.defaultdict(list)
    for conv_id, turn, role, text in turns:
        talks[conv_id].append((turn, " " if role is None else role, " " if text is None else text))
    return sorted(((c, *brute_report(t)) for c, t in talks.items()), key=sort_key)


def talk(rnd, n):
    texts = ["Well.", "no stop", "", " \n", "Why? ", "ok!", "a.\t", "Well", None]
    return [(rnd.choice([None, *range(n)]), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", None]), rnd.choice([*texts, f"Turn {rnd.random()}.", f"cut {rnd.random()}"])) for _ in range(n)]


@pytest.mark.parametrize("block_rows", [1, 2, 5, 32])
def test_repair(spark, block_rows):
    rnd = random.Random(block_rows)
    turns = [(c, *t) for c in [None, *range(150)] for t in talk(rnd, rnd.choice([1, 2, 3, 5, 8, 14]))]
    # one conversation holds a third of all, one of its turns a third of that
    turns += [(7, *t) for t in talk(rnd, 300)] + [(7, 9, "user", "Well.")] * 150
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"block": F.lit(1), "audit": F.lit("x"), "copies": F.lit(2)})
    got = repair.digests(repair.repair(df, block_rows))
    assert sorted((tuple(r) for r in got.collect()), key=sort_key) == brute_repair(turns)


def test_repaired_turns(spark):
    turns = [(1, 0, "user", "Hi."), (1, 1, "user", "There?"), (1, 2, "assistant", "cut"), (2, 0, "system", "Be."), (2, 5, "system", "Be.")]
    done = repair.repair(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = [(r.conv_id, r.role, r.text) for r in repair.repaired_turns(done).orderBy("conv_id", "block", "place").collect()]
    assert got == [(1, "user", "Hi."), (1, "assistant", ""), (1, "user", "There?"), (1, "assistant", "cut")]
    assert {r.conv_id: r.audit for r in done.collect()} == {1: "KIKK", 2: "DD"}


def test_repair_tables_equal_whole_alignment():
    """Blocks with any band give what one alignment of all rows gives, between any two states."""
    rnd = random.Random(9)
    for _ in range(300):
        rows = [(rnd.choice("suax"), rnd.random() < 0.2, rnd.random() < 0.3, rnd.choice([1, 1, 3])) for _ in range(rnd.randint(1, 9))]
        block = repair.Block(rows)
        for start in range(4):
            for end in range(4):
                x = block.best(start, end)
                free = repair.Block(rows)
                free.incumbent = lambda *_: 200
                assert x == free.best(start, end), (rows, start, end)


def test_repair_damaged(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rnd = random.Random(2)
    rows += [(c, *t) for c in [None, *range(10**6, 10**6 + 300)] for t in talk(rnd, rnd.choice([1, 1, 2, 4, 6]))]
    left, every = [], {r[0] for r in rows}
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        left += [(conv_id, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    want = brute_repair(left)
    nothing = every - {w[0] for w in want}
    assert nothing
    want = sorted([*want, *((c, 0, 0, 0, 0, 0, 0, "", sha("")) for c in nothing)], key=sort_key)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = repair.repair_damaged(df)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=sort_key) == want
    assert repair.repair_damaged(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_harmonic_packing", "op13_turn_repair"])
def test_registered(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cursor = con.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, cursor.fetchall()))
