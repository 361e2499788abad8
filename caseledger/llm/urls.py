"""URL filter: host rules first, then logistic regression on hashed character
n-grams of host and path. DataFrame expressions only.

The regression learns from a small labelled URL table by gradient descent: each
step is one aggregation over that table, and only the weights, whose number is
fixed, come back to the driver.

Cases: a null URL, or one without ``://``, has an empty host and path, so no rule
fits and the bias alone decides. Extra columns pass through; repeated rows are
judged each. Of rules equally long the lexically greatest wins. An empty
labelled table leaves all weights 0, and every URL then counts as allowed.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host and start of path). A short list by design: it becomes part of the plan.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/")]
BITS = 12
SIZES = (3, 4)
STEPS = 60
RATE, MOMENTUM, DECAY = 10.0, 0.9, 1e-4
THRESHOLD = 0.5
#: The training table is worked on in one task; it may not hold more rows.
MAX_LABELLED = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BAD = ("cheap-pills adult-video xxx-cams casino-online free-bets spam-links ads-tracker pills-shop poker-win "
        "win-cash sex-chat porn-tube link-farm click-track betting-odds loan-fast viagra-buy adult-x spam-mail ad-serve").split()
_GOOD = ("orchard bakery harvest island meadow lantern bridge weaving pottery sailing gallery forest valley "
         "almanac chapter folklore granite heritage journal kettle lighthouse marble notebook painter quarry "
         "library garden weather school history science museum kitchen music letters travel nature harbour "
         "village forum theatre painting railway mountain council").split()
_ENDINGS = ("net", "com", "org")
_SUBS = ("", "www.", "blog.", "m.")
_PATHS = ("/en/1204", "/de/page.html", "/fr/7?ref=x", "/es/31/")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """A small table (url, label): label 1 for unwanted hosts. Each word stands
    with several sub-domains, endings and paths, so that only it tells."""
    rows = [f"{y} https://{_SUBS[(i + k) % 4]}{w}.example.{_ENDINGS[(i + k) % 3]}{_PATHS[(i + 2 * k) % 4]}"
            for y, words in ((1, _BAD), (0, _GOOD)) for i, w in enumerate(words) for k in range(4)]
    lines = spark.range(0, 1, 1, 1).select(F.explode(F.split(F.lit("\n".join(rows)), "\n")).alias("line"))
    pair = F.split("line", " ")
    return lines.select(pair[1].alias("url"), pair[0].cast("int").alias("label"))


def host_of(url: Column) -> Column:
    """From the first ``://`` up to / ? # or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits; else null."""
    fits = []
    for verdict, rule in rules:
        name, start = rule[:rule.index("/")], rule[rule.index("/"):]
        ok = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"),
                                        F.lit(verdict).alias("verdict"))))
    if not fits:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def features(host: Column, path: Column) -> Column:
    """Distinct hashed n-grams of host and path (digits as one class). The
    look-ahead pattern walks the text once, however long it is."""
    parts = [(F.concat(F.lit("^"), host, F.lit("$")), 1),
             (F.concat(F.lit("^"), F.regexp_replace(path, "[0-9]", "0"), F.lit("$")), 2)]
    grams = [F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)),
                         lambda g, s=side: F.pmod(F.xxhash64(g, F.lit(s)), F.lit(1 << BITS)).cast("int"))
             for text, side in parts for n in SIZES]
    return F.array_distinct(reduce(F.concat, grams))


def margin(grams: Column, weights: list[float], bias: float) -> Column:
    """Bias plus the weights of the n-grams over the root of their number. The
    weights are one constant array."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.get(table, g))
    return F.lit(bias) + total / F.sqrt(F.greatest(F.size(grams), F.lit(1)))


def train(labelled: DataFrame, steps: int = STEPS) -> tuple[list[float], float]:
    """Weights by gradient descent with momentum, and the bias: the log odds of the
    labels, so that a URL of which nothing is known gets their share. Rows with a
    null label are left out."""
    n = labelled.where("label IS NOT NULL").limit(MAX_LABELLED + 1).count()
    if n > MAX_LABELLED:
        raise ValueError(f"the labelled URL table may hold {MAX_LABELLED} rows at most")
    weights, speed = [0.0] * (1 << BITS), [0.0] * (1 << BITS)
    if not n:
        return weights, 0.0
    share = min(max(labelled.agg(F.avg("label")).first()[0], 0.01), 0.99)
    bias = math.log(share / (1 - share))
    rows = (labelled.where("label IS NOT NULL").coalesce(1)
            .select(F.col("label").cast("double").alias("y"),
                    features(host_of(F.col("url")), path_of(F.col("url"))).alias("grams")))
    for _ in range(steps):
        error = 1 / (1 + F.exp(-margin(F.col("grams"), weights, bias))) - F.col("y")
        parts = F.transform("grams", lambda g: F.struct(g.alias("b"), (F.col("e") / F.sqrt(F.size("grams"))).alias("g")))
        grads = (rows.withColumn("e", error).select(F.inline(parts)).groupBy("b").agg(F.sum("g").alias("g")).collect())
        step = dict.fromkeys(range(1 << BITS), 0.0) | {r["b"]: r["g"] / n for r in grads}
        for b in range(1 << BITS):
            speed[b] = MOMENTUM * speed[b] - RATE * (step[b] + DECAY * weights[b])
            weights[b] += speed[b]
    return weights, bias


def judge(pages: DataFrame, model: tuple[list[float], float], rules: list[tuple[str, str]] = RULES,
          url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns with host, path, rule, verdict and score of every row."""
    weights, bias = model
    d = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    d = d.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    z = margin(features(F.col("host"), F.col("path")), weights, bias)
    d = d.withColumn("score", 1 / (1 + F.exp(-z)))
    learned = F.when(F.col("score") > THRESHOLD, "block").otherwise("allow")
    return d.select(*keep, "host", "path", F.col("_rule.rule").alias("rule"),
                    F.coalesce("_rule.verdict", learned).alias("verdict"), "score")
