"""The pipeline's stages against brute force, each on its own input."""

import collections

import corpus_pipeline
from tallyform.llm import quality
from tests.llm.test_operators import SF, hits, removed, sha, similar


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stage(step(spark, before, SF), "test-" + name.replace(" ", "-"))
        seen[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.schema.names == before.schema.names
    rows = lambda df: [tuple(r) for r in df.collect()]
    before, after = seen["quality rules"]
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in quality.judge_quality(before).where("kept").collect())
    before, after = seen["near-duplicates"]
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, _, c in similar(rows(before), 5) if i == c)
    before, after = seen["suffix-array dedup"]
    kept = {r.doc_id: len(r.text.encode()) for r in after.collect()}
    source = before.collect()
    for r, (n, gone, spans, _) in zip(source, removed([r.text.encode() for r in source])):
        assert 0 <= kept[r.doc_id] - (n - gone) <= 6 * spans
    before, after = seen["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = collections.Counter(h[0][1] for h in hits(rows(before.select("doc_id", "text")), items) if not h[5][1])
    assert collections.Counter(r.doc_id for r in after.collect()) == want
    before, after = seen["piece encoding"]
    texts = {r.doc_id: r.text for r in before.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in after.collect()} == {i: sha(t) for i, t in texts.items()}
    assert corpus_pipeline.run(spark, SF).count() == after.count()


def test_one_of_each_with_null_shared_and_repeated_ids(spark):
    def text(n, *changed):
        return " ".join(f"w{n}x{i}" + "z" * (i in changed) for i in range(200))

    rows = [
        (None, text(0, 7)), (0, text(0)),  # a copy without an id
        (None, text(1)), (None, text(2)), (None, ""), (None, None),  # nothing like them
        (None, text(3)), (None, text(3, 9)),  # a group without any id
        (4, text(4)), (5, text(4, 9)), (5, text(5)),  # a copy and a clean text that share an id
        (6, text(6)), (6, text(6, 9)),  # near copies that share an id
        (7, text(7)), (7, text(7)), (7, text(7)), (8, ""), (8, ""), (8, None),  # repeated rows
        (9, text(9)), (10, text(9)),
    ]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = corpus_pipeline.one_of_each(spark, docs, SF)
    assert got.schema == docs.schema
    count = collections.Counter((r.doc_id, r.text) for r in got.collect())
    six = [count.pop((6, t), 0) for t in (text(6), text(6, 9))]
    assert sorted(six) == [0, 1]
    gone = {(None, text(0, 7)), (5, text(4, 9)), (6, text(6)), (6, text(6, 9)), (10, text(9))}
    assert count == dict.fromkeys(set(rows) - gone, 1)
