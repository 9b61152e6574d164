"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Equal shingle sets are one class from the start. A class is signed by the least and the greatest value of its shingles under
each of ``PERMUTATIONS`` permutations; two permutations (four values) make a band, and classes that agree in a band share a
bucket. At 0.8 similarity a pair shares none of the 24 bands with probability 0.59 ^ 24, about 3 in a million.

Buckets are worked off without listing their pairs. In a round each bucket names one of its members, at first the one that
shares most buckets with others (an original among its copies), later one at random; each class that is in another component
is compared, on full sets, with one of the members that its buckets name. Links join components, and buckets that lie in one
component are done, so a group of n copies takes about n comparisons a round. After the first round the shingles that only
one class still in question has are counted: two classes share at most what is left of either, which rules out most pairs of
copies that were edited apart. When few pairs are left (or after ``ROUNDS`` rounds) all that this allows are compared, so that
no link between candidates is lost: the pairs of a small bucket as rows, dealt by (member named, salt), where a task holds one set
and streams the others; the members of a larger bucket in pairs of blocks, where a task counts what the sets of two blocks
share and returns only the links that join components, so that no bucket is ever written out as its pairs.

Cases: null or empty texts have an empty set, link with nothing and are their own component; a text of fewer words than a shingle has
one shingle, the whole; repeated rows are one class; among rows that share an id each has its own set, and their component the
least id; a row of null id is in its class, but never names it (a component without any id has a null component_id and
all its rows are kept); other columns are ignored. Rows are told apart by id and text throughout, so what is said of one row never
counts for another that shares its id, or has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyform.llm.shared import SPACE_WORDS, Words, grams, mix, row_key, stage, text_passes

PERMUTATIONS = 48
BANDS = 24
#: Members that one task compares with the set of one named member.
PER_SALT = 256
ROUNDS = 6
#: Pairs in buckets, for each place in them, that are few enough to be gone through at once.
FEW = 200
#: Members of a bucket whose pairs may be rows; a larger one is compared in blocks of so many members, or shingles, on average.
SMALL = 32
BLOCK = 256
BLOCK_SHINGLES = 200_000
#: Shingles that one product of a block counts.
COLUMNS = 4096

_rng = np.random.Generator(np.random.PCG64(48))
_FACTORS = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(1, 2**63, (BANDS, 4), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, one text after the other, and where each text's begin."""
    words = Words(data, offsets, SPACE_WORDS)
    hashes, text_of = grams(words, k)
    order = np.lexsort((hashes, text_of))
    hashes, text_of = hashes[order], text_of[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text_of[1:] != text_of[:-1])
    return hashes[new], np.searchsorted(text_of[new], np.arange(len(offsets)))


def _signed(shingles: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """[texts, BANDS]: bucket numbers. ``heads``: where each (not empty) set begins."""
    values = np.empty((len(heads), 2 * PERMUTATIONS), dtype=np.uint64)
    for k, factor in enumerate(_FACTORS):
        x = shingles * factor
        values[:, 2 * k], values[:, 2 * k + 1] = np.minimum.reduceat(x, heads), np.maximum.reduceat(x, heads)
    per_band = 2 * PERMUTATIONS // BANDS
    return mix((values.reshape(len(heads), BANDS, per_band) * _BAND[None, :, :per_band]).sum(2, dtype=np.uint64) + _BAND[None, :, 0])


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, key (of its id and text), n_shingles, d1, d2 (a 128-bit digest of the set), buckets array<long> (empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_passes(batch["text"]):
                shingles, first = shingle_sets(data, offsets, k)
                n = np.diff(first)
                some = np.flatnonzero(n)
                d = np.zeros((2, b - a), dtype=np.uint64)
                bands = np.zeros((0, BANDS), dtype=np.uint64)
                if len(some):
                    heads = first[some]
                    d[0, some], d[1, some] = np.add.reduceat(shingles, heads), np.add.reduceat(mix(shingles + np.uint64(k)), heads)
                    bands = _signed(shingles, heads)
                edges = np.concatenate([[0], np.cumsum(n > 0)]) * BANDS
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(a, b - a), batch["key"].slice(a, b - a), pa.array(n, pa.int64()), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(bands.ravel().view(np.int64))),
                    ],
                    names=["doc_id", "key", "n_shingles", "d1", "d2", "buckets"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key("doc_id", "text").alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key long, n_shingles long, d1 long, d2 long, buckets array<long>")


def components(edges: DataFrame) -> DataFrame:
    """u, root: the least node that each node of ``edges`` (u, v) reaches. Alternating large and small stars, one staged table a
    turn; a star's many edges meet as partial minima."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        # done when every node has one edge, to a node that has none
        ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(edges.select("v", F.lit(0), F.lit(1)).distinct())
        odd = ends.groupBy("u").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out > 1 or (out > 0 and into > 0)")
        if odd.isEmpty():
            return edges.select("u", F.col("v").alias("root"))


def _own_shingles(texts: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, rest: how many shingles of each of ``nodes`` (node, n) another one of them has as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in text_passes(batch["text"]):
                shingles, first = shingle_sets(data, offsets, k)
                of = np.repeat(np.arange(len(offsets) - 1), np.diff(first)) + a
                yield pa.RecordBatch.from_arrays([batch["node"].take(pa.array(of)), pa.array(shingles.view(np.int64))], names=["node", "shingle"])

    rows = texts.join(nodes.select("node"), "node", "left_semi").mapInArrow(run, "node long, shingle long")
    own = rows.groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("u"))
    return nodes.join(own, "node", "left").select("node", (F.col("n") - F.coalesce("u", F.lit(0))).alias("rest"))


def _possible(n: str, m: str, rest: str, other: str) -> F.Column:
    """Whether sets of n and m shingles, of which ``rest`` and ``other`` are not theirs alone, can be 0.8 similar: they share
    at least 4 / 9 of n + m."""
    return (100 * F.least(n, m) >= 80 * F.greatest(n, m)) & (9 * F.least(rest, other) >= 4 * (F.col(n) + F.col(m)))


def _linked(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """a, b: the pairs (a, b) whose sets are 0.8 similar. The texts of b are held, one at a time; those of a stream by. Texts are
    shuffled to the numbers that want them at every size, so that costs grow in proportion."""
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PER_SALT).cast("int").alias("salts"))
    members = (
        texts.withColumnRenamed("node", "a")
        .join(pairs.join(salts, "b").select("b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), "a").hint("shuffle_hash"), "a")
        .select("b", "salt", "a", "text")
    )
    named = (
        texts.withColumnRenamed("node", "b")
        .join(salts.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).hint("shuffle_hash"), "b")
        .select("b", "salt", F.lit(None).cast("long").alias("a"), "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_of, held = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            of, who = batch["b"].to_pylist(), batch["a"].to_pylist()
            out: tuple[list, list] = ([], [])
            for a, _, data, offsets in text_passes(batch["text"]):
                shingles, first = shingle_sets(data, offsets, k)
                for i in range(len(offsets) - 1):
                    own = shingles[first[i] : first[i + 1]]
                    if who[a + i] is None:
                        held_of, held = of[a + i], own
                        continue
                    if held_of != of[a + i] or not len(held):
                        raise RuntimeError("a member came before the set that it is compared with")
                    at = np.minimum(np.searchsorted(held, own), len(held) - 1)
                    both = int((held[at] == own).sum())
                    if 100 * both >= 80 * (len(held) + len(own) - both):
                        out[0].append(who[a + i])
                        out[1].append(of[a + i])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])

    dealt = members.unionAll(named).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return dealt.mapInArrow(run, "a long, b long")


def _joining(shared: np.ndarray, n: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of members that join their labels into components. ``shared``: how many shingles each two of the sets have in common."""
    close = np.triu(100 * shared >= 80 * (n[:, None] + n[None, :] - shared), 1) & (label[:, None] != label[None, :])
    a, b = np.nonzero(close)
    if not len(a):
        return []
    _, one = np.unique(np.stack([label[a], label[b]]), axis=1, return_index=True)
    above = {x: x for x in label.tolist()}

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    out = []
    for i in one:
        u, v = top(int(label[a[i]])), top(int(label[b[i]]))
        if u != v:
            above[u] = v
            out.append((int(a[i]), int(b[i])))
    return out


def _linked_in_blocks(places: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """a, b: links that join the labels of each bucket's members as all its links would. ``places``: bucket, node, label, blocks."""
    both = places.withColumn("x", F.pmod(F.xxhash64("node"), F.col("blocks")))
    both = both.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    both = both.select("bucket", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "node", "label").join(texts, "node")

    def run(members: pa.Table) -> pa.Table:
        node, label = members["node"].to_numpy(), members["label"].to_numpy()
        values, sizes = [], []
        for _, _, data, offsets in text_passes(members["text"]):
            shingles, first = shingle_sets(data, offsets, k)
            values.append(shingles)
            sizes.append(np.diff(first))
        n = np.concatenate(sizes)
        _, column, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        of, wide = np.repeat(np.arange(len(n)), n), count > 1
        of, column = of[wide[column]], (np.cumsum(wide) - 1)[column[wide[column]]]
        order = np.argsort(column, kind="stable")
        of, column = of[order], column[order]
        shared = np.zeros((len(n), len(n)))
        for low in range(0, int(wide.sum()), COLUMNS):
            part = slice(*np.searchsorted(column, [low, low + COLUMNS]))
            has = np.zeros((len(n), COLUMNS), dtype=np.float32)
            has[of[part], column[part] - low] = 1
            shared += has @ has.T
        pairs = np.array(_joining(shared, n, label), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]})

    return both.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text: one text for each node (id, key)."""
    wanted = nodes.select("node", F.col("id").alias("node_id"), F.col("key").alias("node_key"))
    on = F.col("doc_id").eqNullSafe(F.col("node_id")) & (row_key("doc_id", "text") == F.col("node_key"))
    return docs.select("doc_id", "text").join(wanted.hint("shuffle_hash"), on).select("node", "text").dropDuplicates(["node"])


def near_components(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    out = _row_components(docs, k).select("doc_id", "n_shingles", F.col("head.id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _head(id_column: str) -> F.Column:
    """The least id of a group and the least key of the rows that have it; a null id only where there is no other."""
    return F.min(F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), F.col("key"))).alias("head")


def _row_components(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, key, n_shingles, head (none, id, key: the row that names the component) for every row of ``docs``."""
    signed = stage(signatures(docs, k), "near-signatures")
    nodes = stage(
        signed.where("n_shingles > 0").groupBy("d1", "d2").agg(_head("doc_id"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"))
        .select("d1", "d2", "head.id", "head.key", "n", "buckets").withColumn("node", F.monotonically_increasing_id()),
        "near-classes",
    )
    every = nodes.select(F.explode("buckets").alias("bucket"), "node")
    shared = every.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    held = stage(every.join(shared, "bucket"), "near-buckets")
    labels = held.groupBy("node").agg(F.sum("c").alias("shares")).join(nodes.select("node", "id", "key", "n"), "node")
    labels = stage(labels.withColumn("label", F.col("node")), "near-labels")
    texts = stage(_texts(docs, labels.select("node", "id", "key")), "near-texts")
    labels, held = labels.select("node", "n", F.col("n").alias("rest"), "shares", "label"), held.select("bucket", "node")
    tested = None
    for turn in range(ROUNDS + 1):
        labelled = held.join(labels, "node")
        weight = F.col("shares") if turn == 0 else F.xxhash64("node", F.lit(turn))
        parts = labelled.groupBy("bucket", "label").agg(F.count("*").alias("c"), F.max_by("node", weight).alias("member"), F.max_by("n", weight).alias("n"), F.max_by("rest", weight).alias("rest"), F.sum("n").alias("size"), F.max(weight).alias("w"))
        open_buckets = parts.groupBy("bucket").agg(
            F.count("*").alias("labels"), F.sum("size").alias("size"), F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"),
            F.max_by("label", "w").alias("l1"), F.max_by("member", "w").alias("b"), F.max_by("rest", "w").alias("rb"), F.max_by("n", "w").alias("nb"), F.max("w").alias("w"),
        ).where("labels > 1")
        open_buckets = stage(open_buckets, "near-open")
        left = open_buckets.agg(F.count("*").alias("n"), F.sum("c").alias("members"), F.sum((F.col("c") * F.col("c") - F.col("cc")) / 2).alias("pairs")).first()
        if not left.n:
            break
        last = turn > 1 and (left.pairs <= FEW * left.members or turn == ROUNDS)
        mine = labelled.join(open_buckets.select("bucket", "l1", "b", "nb", "rb", "w", "c", "size"), "bucket")
        if last:
            few = mine.where(F.col("c") <= SMALL)
            theirs = few.select("bucket", F.col("node").alias("other"), F.col("label").alias("lo"), F.col("n").alias("no"), F.col("rest").alias("ro"))
            on = (few["bucket"] == theirs["bucket"]) & (few["label"] < theirs["lo"]) & _possible("n", "no", "rest", "ro")
            pairs = few.join(theirs, on).select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        else:
            pairs = mine.where((F.col("label") != F.col("l1")) & _possible("n", "nb", "rest", "rb")).groupBy(F.col("node").alias("a")).agg(F.max_by("b", "w").alias("b"))
        pairs = stage(pairs, "near-pairs")
        links = _linked(pairs, texts, k)
        if last:
            blocks = F.ceil(F.greatest(F.col("c") / BLOCK, F.col("size") / BLOCK_SHINGLES)).alias("blocks")
            links = links.unionAll(_linked_in_blocks(mine.where(F.col("c") > SMALL).select("bucket", "node", "label", blocks), texts, k))
        links = stage(links, "near-links")
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tested = both if tested is None else tested.unionAll(both)
        of = labels.select(F.col("node").alias("x"), "label")
        joined = links.join(of, F.col("a") == of["x"]).select(F.col("label").alias("u"), "b").join(of, F.col("b") == of["x"]).select("u", F.col("label").alias("v"))
        roots = components(joined)
        labels = labels.join(roots, labels["label"] == roots["u"], "left").select("node", "n", "rest", "shares", F.coalesce("root", "label").alias("label"))
        labels = stage(labels, "near-labels")
        if last:
            break
        # Buckets that lie in one component are done, and so are classes with too few shared shingles for any partner.
        mixed = held.join(labels, "node").groupBy("bucket").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 < l2").select("bucket")
        held = stage(held.join(mixed, "bucket", "left_semi"), "near-buckets")
        if turn == 0:
            rest = _own_shingles(texts, labels.select("node", "n").join(held.select("node").distinct(), "node", "left_semi"), k)
            labels = stage(labels.drop("rest").join(rest, "node", "left").select("node", "n", F.coalesce("rest", "n").alias("rest"), "shares", "label"), "near-labels")
            held = held.join(labels.where("100 * rest >= 80 * n").select("node"), "node", "left_semi")
    of = nodes.select("d1", "d2", "node", "id", "key").join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = of.groupBy("label").agg(_head("id"))
    of = of.join(heads, "label").select("d1", "d2", "head")
    out = signed.where("n_shingles > 0").select("doc_id", "key", "n_shingles", "d1", "d2").join(of, ["d1", "d2"]).select("doc_id", "key", "n_shingles", "head")
    alone = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("key"))
    return out.unionAll(signed.where("n_shingles = 0").select("doc_id", "key", "n_shingles", alone.alias("head")))


def keep_one(docs: DataFrame, k: int = 5) -> DataFrame:
    """One row of each component, with the columns of ``docs``: of the rows with its least id, the one of least key. A component
    without any id keeps its rows. Of rows that are alike in id and text one stays."""
    kept = F.col("head.none") | (F.col("doc_id").eqNullSafe(F.col("head.id")) & (F.col("key") == F.col("head.key")))
    rows = _row_components(docs, k).groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.count("*").alias("c"), F.max(kept).alias("kept"))
    marked = stage(rows.where("c > 1 or not kept"), "near-marked")
    again = marked.where("kept").select("__id", "__key")
    keyed = docs.withColumn("__row_key", row_key("doc_id", "text"))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row_key") == F.col("__key"))
    one = keyed.join(again, on, "left_semi").dropDuplicates(["doc_id", "__row_key"])
    return keyed.join(marked, on, "left_anti").unionAll(one).drop("__row_key")
