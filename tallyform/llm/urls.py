"""URL filter: host and path rules, then a character language-model ratio. DataFrame functions only.

Two variable-order Markov models (contexts of 0 to 3 characters, interpolated by Witten-Bell) are counted over the urls
that the rules allow and over those that they block. A url that no rule fits gets the mean, over its characters, of
log P_allowed - log P_blocked, and is allowed if that is at least the calibrated bound: the midpoint of the means that
the two groups of ruled urls reach.

Cases: a url that is null or has no ``://`` has an empty host and path and is scored over what it has (null: as empty text).
With no allowed or no blocked url to learn from every url scores 0 against a bound of 0 and is allowed. Repeated rows give
repeated results; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyform.llm.shared import stage

#: (verdict, host, path): a rule fits its host and all subdomains, on paths that begin with its own. The longest wins.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: Longest context, in characters.
ORDER = 3
#: Stands before and after a url.
EDGE = "\u0002"
#: Characters that the order -1 model spreads its weight over.
ALPHABET = 256.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, ruling (allow, block or null)."""
    host, path = host_and_path(F.col("url"))
    best, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        best, name = F.when(fits, verdict).otherwise(best), F.when(fits, h + p).otherwise(name)
    return (
        pages.select("page_id", "url")
        .withColumns({"host": host, "path": path})
        .select("page_id", "url", "host", "path", name.alias("rule"), best.alias("ruling"))
    )


def _windows(url: Column) -> Column:
    """Each character with the ORDER characters before it, the end of the url included."""
    marks = F.array(*[F.lit(EDGE)] * ORDER)
    chars = F.concat(marks, F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit("(?s)."), 0), F.array(F.lit(EDGE)))
    return F.transform(F.sequence(F.lit(1), F.size(chars) - ORDER), lambda i: F.array_join(F.slice(chars, i, ORDER + 1), ""))


def gram_counts(judged: DataFrame) -> DataFrame:
    """gram (ORDER + 1 characters), how often it occurs in allowed, blocked and unruled urls."""
    of = lambda v: F.count(F.when(F.col("ruling") == v, 1))
    return (
        judged.select("ruling", F.explode(_windows(F.col("url"))).alias("gram"))
        .groupBy("gram")
        .agg(of("allow").alias("a"), of("block").alias("b"))
    )


def gram_scores(counts: DataFrame) -> DataFrame:
    """gram, a, b, score: log P_allowed - log P_blocked of its last character after the others."""
    scored = counts.select("gram", "a", "b", F.lit(1 / ALPHABET).alias("pa"), F.lit(1 / ALPHABET).alias("pb"))
    for k in range(ORDER + 1):
        tail, context = F.substring("gram", ORDER + 1 - k, k + 1), F.substring("gram", ORDER + 1 - k, k)
        seen = counts.groupBy(tail.alias("tail")).agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))
        after = seen.groupBy(F.substring("tail", 1, k).alias("context")).agg(
            F.sum("ca").alias("na"), F.sum("cb").alias("nb"), F.sum((F.col("ca") > 0).cast("long")).alias("ta"), F.sum((F.col("cb") > 0).cast("long")).alias("tb")
        )
        blend = lambda c, n, t, p: F.when(F.col(n) > 0, (F.col(c) + F.col(t) * F.col(p)) / (F.col(n) + F.col(t))).otherwise(F.col(p))
        scored = (
            scored.withColumns({"tail": tail, "context": context}).join(seen, "tail").join(after, "context")
            .select("gram", "a", "b", blend("ca", "na", "ta", "pa").alias("pa"), blend("cb", "nb", "tb", "pb").alias("pb"))
        )
    return scored.select("gram", "a", "b", (F.log("pa") - F.log("pb")).alias("score"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (of unruled urls; else null), bound for every row of ``pages``."""
    judged = ruled(pages, rules)
    scores = stage(gram_scores(stage(gram_counts(judged), "url-grams")), "url-scores")
    whole = lambda c: F.sum(F.col(c) * F.col("score")) / F.sum(c)
    bound = scores.agg(F.coalesce((whole("a") + whole("b")) / 2, F.lit(0.0)).alias("bound"), (F.sum("a") > 0).alias("has_a"), (F.sum("b") > 0).alias("has_b"))
    known = bound.select(F.when(F.col("has_a") & F.col("has_b"), F.col("bound")).alias("bound"))
    key = F.xxhash64("url").alias("url_key")
    per_url = (
        judged.where(F.col("ruling").isNull()).select("page_id", key, F.explode(_windows(F.col("url"))).alias("gram"))
        .join(scores.select("gram", "score"), "gram")
        .groupBy("page_id", "url_key").agg(F.avg("score").alias("mean"))
        .withColumnsRenamed({"page_id": "scored_id", "url_key": "scored_key"})
    )
    out = judged.withColumn("url_key", key)
    out = out.join(per_url, out.page_id.eqNullSafe(per_url.scored_id) & (out.url_key == per_url.scored_key), "left")
    out = out.withColumn("bound", known.scalar())
    score = F.when(F.col("ruling").isNull(), F.when(F.col("bound").isNull(), 0.0).otherwise(F.round("mean", 9)))
    return out.select("page_id", "host", "path", "rule", F.coalesce(F.col("bound"), F.lit(0.0)).alias("bound"), "ruling", score.alias("score")).select(
        "page_id", "host", "path", "rule",
        F.coalesce(F.col("ruling"), F.when(F.col("score") >= F.round("bound", 9), "allow").otherwise("block")).alias("verdict"), "score", "bound",
    )
