"""The one-pass index against a search word by word, and required words against matches."""

import random
import re

from pyspark.sql import functions as F

from siftweb.functions import lexicon
from siftweb.functions.multimatch import WordIndex, required_words


def test_index_finds_every_word(spark):
    rng = random.Random(4)
    words = {"".join(rng.choices("abc中文 .+", k=rng.randint(1, 5))) for _ in range(150)} | {"robots.txt", "a", "abcab"}
    numbers = {w: [i, i + 1000 * (i % 3)] for i, w in enumerate(sorted(words))}
    texts = ["".join(rng.choices("abcd中文字 .+\n", k=rng.randint(0, 60))) for _ in range(400)] + ["", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, low string")
    for r in rows.select("low", WordIndex(numbers).proposed(F.col("low")).alias("found")).collect():
        assert r["found"] == sorted({n for w in words if w in (r["low"] or "") for n in numbers[w]})
    assert rows.select(WordIndex({}).proposed(F.col("low")).alias("found")).filter("size(found) > 0").count() == 0


def test_required_words():
    assert required_words(r"(?i)(?:foo|Barn)[^x]{0,9}(?:q|z)") == {"foo", "barn"}
    assert required_words(r"\d+") is None and required_words("a?b?") is None and required_words("(") is None
    assert required_words(r"^https?://([\w.]+\.)?example\.com/item/\d+$") == {"example.com/item/"}
    assert required_words("Straße|x") is None
    rng = random.Random(7)
    for patterns in lexicon.PATTERNS.values():
        for pattern, _, _ in patterns:
            needed = required_words(pattern)
            assert needed
            parts = [*needed, " ", "不得", "抓取", "no ", "CRAWLER", "rate LIMIT", "每秒", "次", "automated access"]
            for _ in range(100):
                text = "".join(rng.choices(parts, k=4))
                assert not re.search(pattern, text) or any(w in text.lower() for w in needed)


def test_scores_with_a_lexicon_of_ones_own(spark):
    from siftweb.operators.policy import score_clauses

    terms = {"crawler": {"strong": [f"term{i}x" for i in range(3000)], "weak": ["term7"]}}
    rows = spark.createDataFrame([(1, "u", 0, "1:0", "Term12x and term7x here"), (2, "u", 0, "2:0", "nothing"), (3, "u", 0, "3:0", None)], "page_index int, page_url string, clause_index int, uid string, text string")
    got = score_clauses(rows, terms, {}, 0.0).select("uid", "category", "matched_terms").collect()
    assert [tuple(r) for r in got] == [("1:0", "crawler", "term7x、term12x、term7")]
