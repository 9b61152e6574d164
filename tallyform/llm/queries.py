"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyform.llm import (
    chat, decontaminate, infill, language_id, near_dedup, packing, pages, pieces, quality, repair, suffix_dedup, toxicity, urls,
)
from tallyform.llm.shared import table


def piece_model() -> str:
    """The public BPE vocabulary that the queries use; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def word_vocabulary() -> str:
    """The public vocabulary with word ends that packing uses; the operator takes any of its kind."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op3_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents"), k=4)


def op4_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_digests(table(spark, sf_dir, "documents"), piece_model())


def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("doc_key")


def op6_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(table(spark, sf_dir, "documents"))


def op7_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.format_windows(talks))


def op9_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = infill.frame_texts(table(spark, sf_dir, "documents"))
    return infill.digests(infill.fill_in_middle(framed, seed=42, rate=50, spm_rate=80))


def op12_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents"), word_vocabulary(), end_id=2))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_language_network": op1_language_network,
    "op2_quality_divergence": op2_quality_divergence,
    "op3_minmax_dedup": op3_minmax_dedup,
    "op4_piece_encoding": op4_piece_encoding,
    "op5_positional_index": op5_positional_index,
    "op6_suffix_arrays": op6_suffix_arrays,
    "op7_counterfactual_toxicity": op7_counterfactual_toxicity,
    "op8_chat_windows": op8_chat_windows,
    "op9_block_labeller": op9_block_labeller,
    "op10_url_ratio": op10_url_ratio,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_harmonic_packing": op12_harmonic_packing,
    "op13_turn_repair": op13_turn_repair,
}

# -- the same in plain SQL, where it can state the result -------------------------------------------------------------

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE_WORDS = r"'[^\x20\x09-\x0D]+'"
_ALNUM_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLE: dict[str, str] = {
    "op3_minmax_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACE_WORDS}) AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS shingle
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0) x),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.size + y.size - common)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least_of AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a)
SELECT doc_id, coalesce(size, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, least(doc_id, coalesce(least, doc_id)) = doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)""",
    "op5_positional_index": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM_WORDS}) AS words FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM_WORDS}) AS words FROM benchmark),
iw AS (SELECT DISTINCT item_id, size, array_to_string(words[pos : pos + size - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS pos FROM (SELECT *, least(len(words), 13) AS size FROM i WHERE len(words) > 0) x) y),
dw AS (SELECT doc_id, pos, size, array_to_string(words[pos : pos + size - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS pos FROM d, (SELECT DISTINCT size FROM iw) z WHERE len(words) >= size) y),
hit AS (SELECT doc_id, item_id, pos, dw.size FROM dw JOIN iw ON dw.phrase = iw.phrase AND dw.size = iw.size),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS place FROM hit) x GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) x GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN o USING (doc_id)""",
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(units[1 : a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1 : b], ''), '') AS middle, coalesce(array_to_string(units[b + 1 :], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p""",
}
