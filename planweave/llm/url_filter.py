"""URL filter: rules first, then a character language-model ratio. DataFrame functions only.

Two smoothed variable-order Markov models are counted over all distinct URLs that a rule accepts or
rejects. A URL that no rule fits is judged by the difference of its log-likelihoods per character
against a threshold calibrated on 3 in 16 of the ruled URLs, which the counts leave out.

URLs are mapped to an alphabet of 39 characters before counting, so a model of order 4 has at most
39 + 39^2 + 39^3 + 39^4 = 2.4 million grams whatever the input is. Grams of one length are broadcast up to
``BROADCAST_GRAMS`` of them, which are counted first; beyond that their join is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.llm.common import materialize

ORDER = 4
ALPHABET = 39
HELD_OUT = 3  # of 16 distinct ruled URLs so many calibrate the threshold
BIN = 0.01  # width of a calibration bin, in nats per character
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: Grams of one length that are broadcast: about 100 bytes each in Spark's hashed form.
BROADCAST_GRAMS = 500_000


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """Struct of verdict and rule of the longest rule that fits, or null."""
    found = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def _letters(host_: Column, path_: Column) -> Column:
    """Letters, one sign for digits, eight further signs as they are, ``*`` for any other, framed."""
    plain = F.regexp_replace(F.translate(F.concat(host_, path_), UPPER, LOWER), "[0-9]", "0")
    return F.concat(F.lit("^" * (ORDER - 1)), F.regexp_replace(plain, r"[^a-z0./_%~=&-]", "*"), F.lit("$"))


def _places(urls: DataFrame) -> DataFrame:
    """One row per character with its grams of 1 to ORDER characters, shortest first."""
    last = F.explode(F.sequence(F.lit(ORDER), F.length("letters"))).alias("at")
    grams = [
        F.substring(F.col("letters"), F.col("at") - F.lit(k - 1), F.lit(k)).alias(f"g{k}") for k in range(1, ORDER + 1)
    ]
    return urls.select("*", last).select("*", *grams).drop("letters", "at")


def held_out(key: Column) -> Column:
    """Whether a URL calibrates the threshold, by the first digit of its hash."""
    return F.conv(F.substring(F.md5(key), 1, 1), 16, 10).cast("int") < HELD_OUT


def ratio_model(ruled: DataFrame) -> DataFrame:
    """``gram, ratio``: log of the accepted over the rejected probability of each seen gram.

    ``ruled`` has ``letters`` and ``good`` (true: accepted). Witten-Bell smoothing: a gram takes its
    share of its context's count, and the share of new characters goes to the next shorter gram.
    """
    good, bad = F.col("good").cast("bigint"), (~F.col("good")).cast("bigint")
    every = F.explode(F.array(*(F.col(f"g{k}") for k in range(1, ORDER + 1)))).alias("gram")
    counts = materialize(
        _places(ruled.select("letters", "good")).select(every, good.alias("a"), bad.alias("b"))
        .groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )
    shorter, levels = None, []
    for k in range(1, ORDER + 1):
        here = counts.filter(F.length("gram") == k).withColumn("context", F.substring("gram", 1, k - 1))
        totals = here.groupBy("context").agg(
            *(F.sum(c).alias(f"n{c}") for c in "ab"), *(F.count(F.when(F.col(c) > 0, 1)).alias(f"t{c}") for c in "ab")
        )
        here = here.join(totals, "context").withColumn("rest", F.substring("gram", 2, k))
        if shorter is None:
            here = here.withColumns({f"p{c}": F.lit(1.0 / ALPHABET) for c in "ab"})
        else:
            here = here.join(shorter.select(F.col("gram").alias("rest"), "pa", "pb"), "rest")
        smooth = {
            f"p{c}": F.when(F.col(f"n{c}") > 0, (F.col(c) + F.col(f"t{c}") * F.col(f"p{c}")) / (F.col(f"n{c}") + F.col(f"t{c}")))
            .otherwise(F.col(f"p{c}"))
            for c in "ab"
        }
        shorter = here.withColumns(smooth).select("gram", "pa", "pb")
        levels.append(shorter)
    return reduce(DataFrame.unionByName, levels).select("gram", (F.log("pa") - F.log("pb")).alias("ratio"))


def score_urls(urls: DataFrame, model: DataFrame) -> DataFrame:
    """Add ``score`` to rows of unique ``key`` with ``letters``: mean ratio over the characters.

    Each character counts with the longest of its grams that the model has seen.
    """
    places = _places(urls.select("key", "letters"))
    sizes = dict(model.groupBy(F.length("gram")).count().collect())
    for k in range(1, ORDER + 1):
        level = model.filter(F.length("gram") == k).select(F.col("gram").alias(f"g{k}"), F.col("ratio").alias(f"r{k}"))
        # Beyond the limit the join is shuffled.
        places = places.join(F.broadcast(level) if sizes.get(k, 0) <= BROADCAST_GRAMS else level, f"g{k}", "left")
    ratio = F.coalesce(*(F.col(f"r{k}") for k in range(ORDER, 0, -1)), F.lit(0.0))
    # Rounded, so that the order of the sum is no matter.
    means = places.groupBy("key").agg(F.round(F.avg(ratio), 6).alias("score"))
    return urls.join(means, "key", "left")


def calibrated_threshold(scored: DataFrame) -> float:
    """The score that parts held-out accepted from rejected URLs best; 0 without one of the classes.

    Best: highest share of accepted URLs kept plus share of rejected URLs dropped, the lowest such
    bin on ties. Bins are ``BIN`` wide and end at 20 nats, so one task sees 4001 rows at most.
    """
    edge = int(20 / BIN)
    bins = (
        scored.select(F.greatest(F.lit(-edge), F.least(F.lit(edge), F.floor(F.col("score") / BIN + 1e-9))).alias("bin"), "good")
        .groupBy("bin").agg(F.count(F.when(F.col("good"), 1)).alias("a"), F.count(F.when(~F.col("good"), 1)).alias("b"))
    )
    rows = sorted(bins.collect())
    accepted, rejected = sum(r.a for r in rows), sum(r.b for r in rows)
    if not accepted or not rejected:
        return 0.0
    best, at, a, b = -math.inf, 0, 0, 0
    for r in rows:
        gain = b / rejected - a / accepted
        if gain > best:
            best, at = gain, r.bin
        a, b = a + r.a, b + r.b
    return round(at * BIN, 2)


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, key: str = "page_id", url: str = "url"
) -> DataFrame:
    """Host, path, rule, verdict, score and threshold of every page.

    Only ``key`` and ``url`` are read. Repeated rows each get a row; counts and scores see a distinct
    host and path once. A null URL, or one without ``://``, has empty host and path, no score, and is
    allowed: nothing speaks against it. Without ruled URLs of both kinds the threshold is 0.
    """
    parts = pages.select(
        F.col(key).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path")
    ).withColumn("ruled", fitting_rule(F.col("host"), F.col("path"), rules))
    distinct = parts.filter((F.col("host") != "") | (F.col("path") != "")).groupBy("host", "path").agg(
        F.first("ruled.verdict").alias("ruled")
    ).select(
        F.concat_ws("", "host", "path").alias("key"), _letters(F.col("host"), F.col("path")).alias("letters"),
        (F.col("ruled") == "allow").alias("good"),
    ).dropDuplicates(["key"]).withColumn("held_out", held_out(F.col("key")))
    model = materialize(ratio_model(distinct.filter("good is not null and not held_out")))
    scored = materialize(score_urls(distinct, model).select("key", "score", "good", "held_out"))
    threshold = calibrated_threshold(scored.filter("good is not null and held_out"))
    verdict = F.when(F.coalesce(F.col("score"), F.lit(threshold)) >= threshold, "allow").otherwise("block")
    return (
        parts.withColumn("key", F.concat_ws("", "host", "path"))
        .join(scored.select("key", "score"), "key", "left")
        .select(
            "page_id", "host", "path", F.col("ruled.rule").alias("rule"),
            F.coalesce(F.col("ruled.verdict"), verdict).alias("verdict"), "score",
            F.lit(threshold).alias("threshold"),
        )
    )
