"""URL filter: rules by host and path, and a ratio of character language models for the rest.

Two smoothed variable-order Markov models of characters are counted over all URLs that the rules
allow and block, but for 3 in 16 by hash: two of these calibrate, the third tests. Digits 1 to 9
count as 0. A model's probability of a character interpolates contexts of 3, 2, 1 and 0 characters
by Witten-Bell smoothing; the order in effect varies with what a context has been seen to continue
with. A URL's score is the difference
of its log-likelihoods over its length, in whole micro-nats a gram, so that sums don't depend on
their order. The threshold lies midway between the mean scores of the calibrating URLs of either
kind. Counting works on distinct URLs and then on distinct grams, so copies of a URL and frequent
grams meet in partial sums; only DataFrame functions are used.

Null or without ``://``: host and path are empty, no rule fits, and the model judges the text
(a null or empty URL scores 0). Without URLs of both kinds every other URL scores 0 and is
allowed. Repeated rows get the same answer. Other columns pass through; the operator's own columns
replace input columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, tasks_for, written

#: (rule, verdict); the longest that fits wins.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER = 3  # characters of context
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROWS_A_TASK = 2_000  # URLs whose grams one task makes
START, END = "\x02", "\x03"
OWN = ("host", "path", "rule", "verdict", "lm_score", "lm_threshold")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    fits = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at, _, rest = rule.partition("/")
        fits.append(F.when(((host == at) | host.endswith("." + at)) & path.startswith("/" + rest), F.lit(rule)))
    return F.coalesce(*fits)


def verdict_of(rule: Column, rules=RULES) -> Column:
    return F.coalesce(*[F.when(rule == r, F.lit(v)) for r, v in rules])


def _grams(url: Column) -> Column:
    """The grams of ORDER + 1 characters that end at each character, digits as 0, with the end."""
    text = F.concat(F.lit(START * ORDER), F.translate(url, "123456789", "000000000"), F.lit(END))
    chars = F.split(text, "")
    shifted = F.arrays_zip(*(F.slice(chars, k + 1, F.size(chars)).alias(f"c{k}") for k in range(ORDER + 1)))  # linear in the URL's length
    whole = F.slice(shifted, 1, F.size(chars) - ORDER)
    return F.transform(whole, lambda z: F.concat(*(z[f"c{k}"] for k in range(ORDER + 1))))


def gram_ratios(grams: DataFrame) -> DataFrame:
    """gram, ratio: micro-nats that each gram's last character speaks for allowed URLs.

    ``grams``: gram, n_allow, n_block with one row a gram; grams without counts are rated too.
    """
    below = None
    for k in range(ORDER + 1):
        level = grams.groupBy(F.substring("gram", -(k + 1), k + 1).alias("s")).agg(F.sum("n_allow").alias("na"), F.sum("n_block").alias("nb"))
        level = level.withColumn("ctx", F.substring("s", 1, k))
        seen = level.groupBy("ctx").agg(*[f(c).alias(n) for c, f, n in (("na", F.sum, "ta"), ("nb", F.sum, "tb"), ("na", lambda c: F.count_if(F.col(c) > 0), "da"), ("nb", lambda c: F.count_if(F.col(c) > 0), "db"))])
        level = level.join(seen, "ctx")
        if below is None:
            level = level.withColumns({"pa0": F.lit(1 / 256), "pb0": F.lit(1 / 256)})
        else:
            level = level.withColumn("rest", F.substring("s", 2, k)).join(below, "rest")
        smooth = lambda n, t, d, p: F.when(F.col(t) + F.col(d) > 0, (F.col(n) + F.col(d) * F.col(p)) / (F.col(t) + F.col(d))).otherwise(F.col(p))
        level = level.select("s", smooth("na", "ta", "da", "pa0").alias("pa"), smooth("nb", "tb", "db", "pb0").alias("pb"))
        below = level.select(F.col("s").alias("rest"), F.col("pa").alias("pa0"), F.col("pb").alias("pb0"))
    ratio = F.round((F.ln("pa") - F.ln("pb")) * 1e6).cast("long")
    return level.select(F.col("s").alias("gram"), ratio.alias("ratio"))


def url_scores(urls: DataFrame) -> DataFrame:
    """``urls``: k_url (distinct), label (allow, block or null), n. Returns k_url, k_fold, label, n, score.

    score: whole micro-nats a gram, rounded down.
    """
    digit = F.substring(F.md5("k_url"), 1, 1)
    fold = F.when(digit.isin("0", "1"), "calibrate").when(digit == "2", "test").otherwise("count")
    n = {r["label"]: r["n"] for r in urls.groupBy("label").agg(F.count("*").alias("n")).collect()}  # at most three rows
    urls = urls.repartition(tasks_for(urls.sparkSession, sum(n.values()), ROWS_A_TASK), "k_url")  # few bytes here, many grams below
    exploded = urls.withColumn("k_fold", fold).withColumn("gram", F.explode(_grams(F.col("k_url"))))
    weight = lambda kind: F.when((F.col("label") == kind) & (F.col("k_fold") == "count"), F.col("n")).otherwise(0)
    grams = exploded.groupBy("gram").agg(F.sum(weight("allow")).alias("n_allow"), F.sum(weight("block")).alias("n_block"))
    ratios = written(gram_ratios(written(grams, "url-grams")), "gram-ratios")
    score = F.floor(F.sum("ratio") / F.count("*")) if n.get("allow") and n.get("block") else F.lit(0).cast("long")
    return spread_join(exploded, ratios, "gram", ["k_url"]).groupBy("k_url", "k_fold", "label", "n").agg(score.alias("score"))


def _scored(pages: DataFrame, rules) -> tuple[DataFrame, int]:
    """Scores of the distinct URLs (``pages``: k_url), and the threshold."""
    label = verdict_of(rule_of(host_of(F.col("k_url")), path_of(F.col("k_url")), rules), rules)
    urls = pages.groupBy("k_url").agg(F.count("*").alias("n")).withColumn("label", label)
    scores = written(url_scores(written(urls, "urls")), "url-scores")
    mean = {r["label"]: r["m"] for r in scores.where("k_fold = 'calibrate' and label is not null").groupBy("label").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("m")).collect()}  # two rows
    return scores, round((mean["allow"] + mean["block"]) / 2) if len(mean) == 2 else 0


def held_out_errors(pages: DataFrame, rules=RULES) -> dict[str, tuple[int, int]]:
    """By the rules' verdict: URLs of the test fold, and those that the model judges otherwise."""
    scores, threshold = _scored(pages.select(F.coalesce(F.col("url"), F.lit("")).alias("k_url")), rules)
    wrong = F.count_if((F.col("score") >= threshold) != (F.col("label") == "allow"))
    rows = scores.where("k_fold = 'test' and label is not null").groupBy("label").agg(F.count("*").alias("n"), wrong.alias("wrong")).collect()  # two rows
    return {r["label"]: (r["n"], r["wrong"]) for r in rows}


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` (url, more) with host, path, rule, verdict, lm_score and lm_threshold."""
    pages = pages.drop(*(c for c in OWN if c in pages.columns)).withColumn("k_url", F.coalesce(F.col("url"), F.lit("")))
    scores, threshold = _scored(pages, rules)
    judged = pages.join(scores.select("k_url", "score"), "k_url", "left")
    rule = rule_of(host_of(F.col("k_url")), path_of(F.col("k_url")), rules)
    return judged.select(
        *(F.col(f"`{c}`") for c in pages.columns if c != "k_url"),
        host_of(F.col("k_url")).alias("host"), path_of(F.col("k_url")).alias("path"), rule.alias("rule"),
        F.coalesce(verdict_of(rule, rules), F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"),
        F.col("score").alias("lm_score"), F.lit(threshold).cast("long").alias("lm_threshold"),
    )
