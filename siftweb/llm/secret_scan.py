"""Secret scans: patterns propose strings, a random forest trained on labelled findings removes the false positives.

Candidates, features and predictions are columns and Spark's own forest; no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftweb.llm.common import keep, text_of
from siftweb.scale import unnest

#: a candidate: a whole run of so many key characters with a digit in it; known keys and assigned values follow below
LEAST = 12
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])([A-Za-z0-9+/_-]{%d,}+)" % LEAST
#: code points of context on either side
CONTEXT = 48
#: labelled findings that a fit uses at most, trees and their depth
LABELLED, TREES, DEPTH, SEED = 20_000, 30, 6, 11
#: findings from this probability on are secrets
THRESHOLD = 0.5

# Words that names and prose are made of, for the dictionary coverage
DICTIONARY = ["account", "access", "admin", "api", "app", "article", "auth", "blog", "build", "changeme", "client", "code", "com", "commit", "config",
              "content", "data", "date", "default", "demo", "dev", "doc", "dummy", "example", "fake", "feed", "file", "http", "https", "image",
              "index", "item", "key", "license", "local", "login", "main", "name", "news", "null", "page", "pass", "password", "placeholder",
              "post", "prod", "public", "sample", "secret", "server", "site", "src", "test", "the", "time", "token", "user", "version", "web", "www", "your"]
# Words before a value that speak for and against a secret, and how known keys look
FOR_WORDS = "password|passwd|pwd|secret|token|apikey|api_key|access_key|private_key|credential|auth|bearer"
AGAINST_WORDS = "commit|sha1|sha256|md5|checksum|digest|uuid|guid|version|isbn|order|phone|tel|card|href|src|http|https|url|page"
_KNOWN = r"(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}+)"
KNOWN_FORM = f"^{_KNOWN}$"
# A secret's name with its sign of assignment
_NAMED = rf"(?:{FOR_WORDS})[\"']?\s*+[=:]"
ASSIGNED = rf"{_NAMED}\s*+[\"']?"
#: what proposes candidates, the value in group 1: runs, known keys, values of any length and characters behind a secret's name up
#: to the closing quote or blank (or a name whose value follows the blank), and the same up to the next name, so that none hides behind another
PROPOSE = (CANDIDATE, rf"(?<![A-Za-z0-9])({_KNOWN})(?![A-Za-z0-9])",
           *(rf"(?i){_NAMED}\s*+(?:\"(?!{_NAMED})(?=[^\s\"])|'(?!{_NAMED})(?=[^\s'])|(?![\s\"']|{_NAMED}))"
             rf"((?<=\")(?:{step}[^\s\"])++|(?<=')(?:{step}[^\s'])++|(?<![\"'])(?:{step}[^\s\"'])++)" for step in (rf"(?!{_NAMED}(?:\s|$))", rf"(?!{_NAMED})")))

_CLASSES = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "other": "[+/_-]"}
FEATURES = ["length", *[f"{a}_{b}" for a in _CLASSES for b in _CLASSES], "distinct", "entropy", "hex_only", "dictionary", "slashes", "in_path",
            "word_for", "word_against", "assigned", "quoted"]


def candidates(rows: DataFrame, text: str, keys: list[str], path: str | None = None) -> DataFrame:
    """One row per candidate of the whole text: keys, start, end (code points), value, before, after, path.

    The text is cut at the matches of each pattern; the lengths of the parts give the positions, their ends the context.
    Candidates of different patterns may overlap; the same place is listed once, with the context of the first.
    """
    some = rows.select(*keys, text_of(text).alias("_text"), (F.col(path).cast("string") if path else F.lit(None).cast("string")).alias("path"))
    own, cuts = [*keys, "path"], range(len(PROPOSE))
    hits = [F.rlike("_text", F.lit(p)) for p in PROPOSE]
    cut = some.filter(reduce(Column.__or__, hits)).select(*own, *(c for i, p in enumerate(PROPOSE) for c in (
        F.regexp_extract_all("_text", F.lit(p), F.lit(0)).alias(f"_match{i}"), F.regexp_extract_all("_text", F.lit(p), F.lit(1)).alias(f"_found{i}"),
        F.split("_text", p, -1).alias(f"_parts{i}"))))

    def short(i):
        parts = F.col(f"_parts{i}")
        pairs = F.arrays_zip(F.col(f"_match{i}").alias("match"), F.col(f"_found{i}").alias("value"), parts.alias("part"), F.slice(parts, 2, F.size(parts)).alias("rest"))
        lead = lambda p: F.left(p["match"], F.length(p["match"]) - F.length(p["value"]))
        return F.transform(F.filter(pairs, lambda p: p["match"].isNotNull()), lambda p: F.struct(
            p["value"].alias("value"), F.right(F.concat(p["part"], lead(p)), F.lit(CONTEXT)).alias("before"), F.left(p["rest"], F.lit(CONTEXT)).alias("after"),
            (F.length(p["part"]) + F.length(p["match"])).alias("step")))

    def placed(i):
        end = lambda at: F.aggregate(F.slice(f"_steps{i}", 1, at + 1), F.lit(0), lambda a, x: a + x)
        return F.transform(f"_short{i}", lambda c, at: F.struct(end(at).cast("long").alias("end"), c["value"].alias("value"), c["before"].alias("before"),
                                                                F.coalesce(c["after"], F.lit("")).alias("after")))

    place = lambda c: c["end"] * (1 << 31) + F.length(c["value"])
    each = cut.select(*own, *(short(i).alias(f"_short{i}") for i in cuts))
    each = each.select("*", *(F.col(f"_short{i}.step").alias(f"_steps{i}") for i in cuts)).select(*own, *(placed(i).alias(f"_placed{i}") for i in cuts))
    each = each.select("*", *(F.transform(f"_placed{i}", place).alias(f"_at{i}") for i in cuts))
    seen = lambda i, c: reduce(Column.__or__, (F.array_contains(f"_at{j}", place(c)) for j in range(i)), F.lit(False))
    fresh = [F.filter(f"_placed{i}", (lambda i: lambda c: ~seen(i, c))(i)) for i in cuts]
    out = unnest(each.select(*own, F.concat(*fresh).alias("_all")), own, "_all", "_c").select(*own, "_c.end", "_c.value", "_c.before", "_c.after")
    return out.withColumn("start", F.col("end") - F.length("value"))


def _share(pattern: str, value: Column) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def features(found: DataFrame) -> DataFrame:
    """Add the columns named in FEATURES: length, character transitions, dictionary coverage, path and neighbouring words."""
    value, before = F.col("value"), F.lower(F.col("before"))
    characters = F.split(value, "")
    pairs = [_share(f"(?<={x})(?={y})", value).alias(f"{a}_{b}") for a, x in _CLASSES.items() for b, y in _CLASSES.items()]
    shares = F.transform(F.array_distinct(characters), lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / F.length(value))
    entropy = F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log(p))
    plain = F.regexp_replace(F.lower(value), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")
    last_words = F.regexp_extract(before, r"([\w.-]*\W*[\w.-]*\W*)$", 1)
    return found.select(
        "*", F.length(value).cast("double").alias("length"), *pairs, (F.size(F.array_distinct(characters)) / F.length(value)).alias("distinct"),
        entropy.alias("entropy"), F.rlike(value, F.lit("^[0-9a-fA-F]+$")).cast("double").alias("hex_only"),
        (1 - F.length(plain) / F.length(value)).alias("dictionary"), _share("/", value).alias("slashes"),
        (F.rlike(before, F.lit(r"[/\\.][\w.-]*[/\\]?$")) | F.rlike(F.coalesce("path", F.lit("")), F.lit(r"(?i)\.(md|lock|svg|html?)$"))).cast("double").alias("in_path"),
        F.rlike(last_words, F.lit(FOR_WORDS)).cast("double").alias("word_for"), F.rlike(last_words, F.lit(rf"\b({AGAINST_WORDS})\b")).cast("double").alias("word_against"),
        F.rlike(before, F.lit(r"[=:]\s*[\"']?$")).cast("double").alias("assigned"), F.rlike(before, F.lit("[\"']$")).cast("double").alias("quoted"))


def train(findings: DataFrame, most: int = LABELLED) -> RandomForestClassificationModel | float:
    """Forest over findings (value, before, after, path) with ``label`` 0 or 1.

    At most ``most`` findings enter, the lowest by a hash of value and context, equal numbers of either label where there are enough;
    repeated findings count once. With findings of one label the result is that label, without any 0.5: then all candidates get it.
    """
    named = findings.filter(F.col("label").isin(0, 1)).select("value", "before", "after", "path", F.col("label").cast("double").alias("label")).distinct()
    rank = F.xxhash64("value", "before", "after")
    halves = [named.filter(F.col("label") == y).orderBy(rank, "value", "before").limit(most // 2) for y in (0.0, 1.0)]
    sample = keep(features(halves[0].unionByName(halves[1])), "findings")
    seen = [r["label"] for r in sample.select("label").distinct().collect()]
    if len(seen) < 2:
        return seen[0] if seen else 0.5
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="_vector", probabilityCol="_probability", rawPredictionCol="_raw",
                                    predictionCol="_class")
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="_vector").transform(sample))


def judge(found: DataFrame, model: RandomForestClassificationModel | float) -> DataFrame:
    """The candidates with ``probability`` and ``is_secret``."""
    if isinstance(model, float):
        return found.withColumn("probability", F.lit(model)).withColumn("is_secret", F.lit(model >= THRESHOLD))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="_vector").transform(features(found)))
    return scored.select(*found.columns, vector_to_array("_probability")[1].alias("probability")).withColumn("is_secret", F.col("probability") >= THRESHOLD)


def propose(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All candidates of every whole text, a written table. ``path``: column with the document's path, if there is one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col(path).alias("_path")] if path else []))
    return keep(candidates(rows, "text", ["doc_id"], "_path" if path else None), "candidates")


def scan(docs: DataFrame, findings: DataFrame, path: str | None = None) -> DataFrame:
    """Every candidate of every whole text: doc_id, start, end, value, before, after, path, probability, is_secret.

    ``findings``: labelled ones (value, before, after, path, label). Null, empty and clean texts have no rows; repeated
    rows repeat; a null doc_id stays null; an empty table gives an empty result; other columns are ignored.
    """
    return judge(propose(docs, path), train(findings))


def labelled_findings(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Findings with labels that need no reader: of the candidates ``found``, 1 for known key forms and long values with
    a digit assigned to a secret's name (shorter and plainer ones are judged, not learnt from) and 0 for digit runs; 0 for the parts of ``pages``' addresses."""
    label = (F.when(F.rlike("value", F.lit(KNOWN_FORM)), 1)
             .when(F.rlike(F.lower("before"), F.lit(rf"{ASSIGNED}$")) & F.rlike("value", F.lit(f"^{CANDIDATE}$")), 1)
             .when(F.rlike("value", F.lit("^[0-9-]+$")), 0))
    url = F.concat(F.lit(" "), F.regexp_replace(F.col("url"), r"[.:?=&#]", " "))
    listed = candidates(pages.select("page_id", url.alias("text")), "text", ["page_id"]).drop("page_id").withColumn("label", F.lit(0))
    return found.drop("doc_id").withColumn("label", label).filter("label IS NOT NULL").unionByName(listed)


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate of ``documents`` with the forest's verdict; the value itself is shown as a hash."""
    from siftweb.llm.common import read

    found = propose(read(spark, folder, "documents"))
    judged = judge(found, train(labelled_findings(found, read(spark, folder, "pages"))))
    return judged.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), F.round("probability", 6).alias("probability"), "is_secret")
