"""URL filters: listed rules first, then rules over URL tokens that FP-growth mines from labelled URLs.

Everything here is columns, joins and Spark's own FP-growth; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftweb.llm.common import drop_own, keep

#: a mined rule covers at least this share of the labelled URLs and holds for this share of those it covers
SUPPORT, CONFIDENCE = 0.01, 0.8
#: the verdict where no rule fits
OTHERWISE = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OWN = ["host", "path", "rule", "verdict", "source", "confidence", "support", "antecedent"]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting (verdict, host, path prefix) as a struct (size, rule, verdict), else null.

    A rule fits its host and all hosts below it. The list is written into the plan, so its size is that of a configuration.
    """
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
                   F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    none = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.greatest(*fits, none, none)


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a whole URL: host, its parents and first label, path segments by place (digits as 9), ending, query keys, fragment."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: F.concat(F.lit("under:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parents = F.when(F.size(labels) > 1, parents).otherwise(F.array().cast("array<string>"))
    words = F.filter(F.split(path, "/"), lambda s: s != "")
    places = F.transform(words, lambda s, i: F.concat(F.lit("path"), i + 1, F.lit(":"), F.regexp_replace(s, "[0-9]+", "9")))
    heads = F.transform(F.filter(words, lambda s: F.rlike(s, F.lit("^[0-9]"))), lambda s: F.concat(F.lit("number:"), F.substring(s, 1, 1)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda q: q != ""), lambda q: F.concat(F.lit("key:"), F.substring_index(q, "=", 1)))
    some = F.filter(F.array(
        F.when(host != "", F.concat(F.lit("host:"), host)), F.when(F.size(labels) > 1, F.concat(F.lit("first:"), labels[0])),
        F.when(F.rlike(path, F.lit(r"\.[A-Za-z]{2,5}$")), F.concat(F.lit("ending:"), F.regexp_extract(path, r"\.([A-Za-z]{2,5})$", 1))),
        F.when(F.endswith(path, F.lit("/")), F.lit("folder")), F.when(F.contains(url, F.lit("#")), F.lit("fragment"))), lambda t: t.isNotNull())
    return F.array_distinct(F.concat(some, parents, places, heads, keys))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules ``antecedent -> verdict`` with ``confidence`` and ``support`` from rows of (tokens, verdict); a written table.

    FP-growth runs over the token sets with the verdict as a further item. Of its rules those that conclude a verdict
    stay, unless leaving out one token gives a rule of the same verdict and at least the same confidence.
    At least ``support`` of the rows hold a rule, so the number of rules is bounded by the tokens of a row, not by the rows.
    """
    spark = labelled.sparkSession
    empty = spark.sql("SELECT array('') AS antecedent, '' AS verdict, 0D AS confidence, 0D AS support WHERE false")
    if labelled.isEmpty():
        return empty
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    rules = keep(model.associationRules.filter(F.startswith(F.col("consequent")[0], F.lit("verdict="))).select(
        F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 9, 1 << 20).alias("verdict"), "confidence", "support"), "rules")
    shorter = rules.select("*", F.explode("antecedent").alias("_left")).select(
        F.col("antecedent").alias("_full"), "verdict", F.col("confidence").alias("_conf"),
        F.array_except("antecedent", F.array("_left")).alias("antecedent"))
    needless = (shorter.join(rules.select("antecedent", "verdict", "confidence"), ["antecedent", "verdict"])
                .filter(F.col("confidence") >= F.col("_conf")).select(F.col("_full").alias("antecedent"), "verdict").distinct())
    return keep(rules.join(needless, ["antecedent", "verdict"], "left_anti").select(*empty.columns), "pruned")


def match(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Best rule of every distinct ``tokens``: of the rules whose tokens are all there the most confident, then the best supported.

    Inverted index: a rule is posted under one of its tokens, the one with the fewest rules; a token set meets the rules
    posted under its tokens and no others.
    """
    tokens = rules.select("*", F.explode("antecedent").alias("_token"))
    sizes = tokens.groupBy("_token").agg(F.count(F.lit(1)).alias("_posted"))
    postings = (tokens.join(sizes, "_token").groupBy("antecedent", "verdict", "confidence", "support")
                .agg(F.min(F.struct("_posted", "_token"))["_token"].alias("_token")))
    best = F.max(F.struct("confidence", "support", F.size("antecedent").alias("n"), "verdict", "antecedent"))
    return (token_sets.select("tokens", F.explode("tokens").alias("_token")).join(keep(postings, "postings"), "_token")
            .filter(F.size(F.array_intersect("antecedent", "tokens")) == F.size("antecedent"))
            .groupBy("tokens").agg(best.alias("_best")))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``pages`` with host, path, rule, verdict and, where a mined rule decided, its antecedent and confidence.

    The labelled URLs are those that a listed rule covers; what FP-growth learns from them judges the others, and where
    nothing fits the verdict is OTHERWISE. A null url or one without ``://`` has empty host and path and no tokens.
    Repeated rows are judged alike; an empty table gives an empty result; extra columns stay unless they clash with added ones.
    URLs with equal tokens are matched once.
    """
    url = F.col("url").cast("string")
    rows = drop_own(pages, [*_OWN, "tokens", "_listed", "_best"]).select("*", host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens"))
    rows = rows.withColumn("_listed", listed_rule(F.col("host"), F.col("path"), rules))
    narrow = rows.select("tokens", F.col("_listed")["verdict"].alias("verdict"))
    found = mine(narrow.filter(F.col("verdict").isNotNull()), support, confidence)
    matched = match(narrow.filter(F.col("verdict").isNull()).select("tokens").distinct(), found)
    out = rows.join(matched, "tokens", "left")
    mined = F.col("_listed").isNull()
    return out.select(*[c for c in rows.columns if c not in ("tokens", "_listed")], F.col("_listed")["rule"].alias("rule"),
                      F.coalesce(F.col("_listed")["verdict"], F.col("_best")["verdict"], F.lit(OTHERWISE)).alias("verdict"),
                      F.when(mined, F.col("_best")["antecedent"]).alias("antecedent"), F.when(mined, F.col("_best")["confidence"]).alias("confidence"))


#: verdict, host, path prefix
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    from siftweb.llm.common import read

    judged = judge(read(spark, folder, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.array_join("antecedent", " ").alias("because"), "confidence")
