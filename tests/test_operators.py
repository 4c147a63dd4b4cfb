"""Order-sensitive operators against plain row-by-row descriptions, hot keys included."""

import random
import re

from pyspark.sql import functions as F

from siftweb.functions import lexicon
from siftweb.operators import audit, graph, media, policy
from siftweb.scale import join_by_hot_key, lookup_by_key, number_all, number_in_groups


def test_numbering_and_hot_joins(spark):
    rnd = random.Random(4)
    rows = [(i, "hot" if rnd.random() < 0.4 else f"k{rnd.randint(0, 20)}") for i in range(2000)]
    df = spark.createDataFrame(rows, "i long, k string")
    seen, want = {}, {}
    for i, k in rows:
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    got = {r.i: r.n for r in number_in_groups(df, ["k"], ["i"], F.floor(F.col("i") / 64), "n").collect()}
    assert got == want
    assert {r.i: r.n for r in number_all(df, ["i"], F.floor(F.col("i") / 100), "n").collect()} == {i: i + 1 for i, _ in rows}
    sums = df.groupBy("k").agg(F.max("i").alias("top"), F.count(F.lit(1)).alias("size"))
    plain = {(r.i, r.top) for r in df.join(sums, "k").collect()}
    assert {(r.i, r.top) for r in lookup_by_key(df, sums, "k", "size", F.col("i"), hot_rows=50).collect()} == plain
    table = sums.drop("size").filter("k <> 'k3'")
    plain = {(r.i, r.top) for r in df.join(table, "k", "left").collect()}
    assert {(r.i, r.top) for r in join_by_hot_key(df, table, "k", F.col("i"), hot_rows=100).collect()} == plain


def expected_labels(rows, cap):
    kept, out = [], {}
    for i, url, kind, width in rows:
        if kind != "image":
            out[i] = "wrong_kind"
        elif url in kept:
            out[i] = "duplicate"
        elif cap and len(kept) >= cap:
            out[i] = "truncated"
        elif width and width < 10:
            out[i] = "too_small"
        else:
            kept.append(url)
            out[i] = "kept"
    return out


def test_keep_first_accepted(spark):
    rnd = random.Random(5)
    for cap in (0, 4, 1000):
        rows = [(i, "http://h/hot.jpg" if rnd.random() < 0.3 else f"http://h/{rnd.randint(0, 12)}.jpg", rnd.choice(["image"] * 4 + ["other"]), rnd.choice([0, 5, 20]))
                for i in range(150)]
        df = spark.createDataFrame(rows, "arrival long, url string, kind string, width long").withColumns(
            {"height": F.lit(0), "size": F.lit(0), "ext": F.lit("")})
        done = media.label_media(df, media.MediaConfig(min_width=10, max_count=cap))
        assert {r.arrival: r.label for r in done.collect()} == expected_labels(rows, cap)
        shuffled = media.label_media(df.repartition(3, "width"), media.MediaConfig(min_width=10, max_count=cap))
        assert {r.arrival: r.label for r in shuffled.collect()} == expected_labels(rows, cap)


def test_near_groups(spark):
    rnd = random.Random(6)
    hashes = [rnd.getrandbits(12) for _ in range(120)] + [77] * 60
    rnd.shuffle(hashes)
    df = spark.createDataFrame(list(enumerate(hashes)), "i long, h long")
    keepers, want = [], {}
    for i, h in enumerate(hashes):
        if not h:
            continue
        near = next((k for k in keepers if bin(h ^ hashes[k]).count("1") <= 2), None)
        if near is None:
            keepers.append(i)
        want[i] = i if near is None else near
    got = media.perceptual_groups(df.withColumn("at", F.col("i")), "i", "h", "at", 2)
    assert {r.i: r.keeper_order for r in got.collect()} == want
    pairs = {(r.a_hash, r.b_hash) for r in media.near_duplicate_pairs(df, "i", "h", 2).collect()}
    distinct = sorted({h for h in hashes if h}, key=hashes.index)
    assert pairs == {(a, b) for x, a in enumerate(distinct) for b in distinct[x + 1:] if bin(a ^ b).count("1") <= 2}


HEAD = re.compile(r"^(?:第\s*[一二三四五六七八九十百零两\d]+\s*[条章节款项]|[一二三四五六七八九十]+\s*[、\.]|\d+(?:\.\d+)*\s*[、\.]?\s|"
                  r"(?:article|section|clause|appendix|schedule)\s+\d+|[（(]\s*[一二三四五六七八九十\d]+\s*[)）])", re.I)


def expected_clauses(text):
    out, offset, heading = [], 0, ""
    for line in text.split("\n"):
        start, offset = offset, offset + len(line) + 1
        if not line:
            continue
        ends = line[-1] in "。！？.!?"
        if len(line) <= 48 and not ends and (HEAD.match(line) or (line[-1] not in "，,、；;" and len(line) <= 24)):
            heading = line
            out.append((start, start + len(line), heading))
            continue
        if HEAD.match(line):
            cut = next((line.find(m) for m in "：:—-－" if 0 < line.find(m) <= 30), 30)
            heading = line[:cut].strip()
        spans, at = [], 0
        for m in re.finditer(r"[。！？!?]+|(?<=[A-Za-z0-9%\)\"'’”])\.(?=\s|$)", line):
            spans.append((at, m.end()))
            at = m.end()
        spans.append((at, len(line)))
        merged, begin, end = [], None, 0
        for s, e in spans:
            piece = line[s:e]
            if not piece.strip():
                continue
            s, e = s + len(piece) - len(piece.lstrip()), e - len(piece) + len(piece.rstrip())
            begin, end = (s if begin is None else begin), e
            if end - begin >= 80:
                merged.append((begin, end))
                begin = None
        if begin is not None:
            if merged and end - begin < 8:
                merged[-1] = (merged[-1][0], end)
            else:
                merged.append((begin, end))
        for s, e in merged:
            while e - s > 1500:
                cut = line.rfind(" ", s + 750, s + 1500)
                cut = cut if cut > s else s + 1500
                out.append((start + s, start + cut, heading))
                s = cut
                while s < e and line[s].isspace():
                    s += 1
            if e > s:
                out.append((start + s, start + e, heading))
    return out


def test_clauses(spark):
    rnd = random.Random(7)
    words = ["第一条 总则", "不得使用爬虫。", "Hello there. Some more words follow! ", "1.2 Scope", "a", "，", "Section 3 rules: you must not. ", "x" * 40, "短句", " "]
    texts = []
    for _ in range(40):
        lines = ["".join(rnd.choice(words) for _ in range(rnd.randint(1, 9))).strip() for _ in range(rnd.randint(1, 6))]
        texts.append("\n".join(x for x in lines if x))
    texts += ["word " * 900 + "end.", "y" * 4000]
    texts = [t.strip() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "page_index long, text string")
    got = {}
    for r in policy.segment_clauses(df).orderBy("page_index", "clause_index").collect():
        got.setdefault(r.page_index, []).append((r.start, r.end, r.heading))
        assert texts[r.page_index][r.start:r.end] == r.text
    for i, t in enumerate(texts):
        assert got.get(i, []) == expected_clauses(t), t


def test_term_suppression(spark):
    texts = ["see the api doc", "the api is here", "api doc " + "z" * 40 + " api", "api 文档", "chatbot", "a bot runs"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    hit = lambda term: [r.x for r in rows.select(policy.contains_term(F.col("t"), term).alias("x")).collect()]
    assert hit("api") == [False, True, True, False, False, False]
    assert hit("bot") == [False, False, False, False, False, True]
    assert lexicon.markers_of("api 文档") == lexicon.FALSE_POSITIVE_RULES["api"]


def test_chain_loops_and_limits(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (10, 11), (11, None), (20, 20)], "node long, next long")
    starts = spark.createDataFrame([(1,), (10,), (20,)], "node long")
    chain = graph.next_chain(links, starts, 50)
    assert sorted(map(tuple, chain.collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (10, 10, 0), (10, 11, 1), (20, 20, 0)]
    stops = {r.start: r.stop_reason for r in graph.chain_stop_reason(chain, links, 50).collect()}
    assert stops == {1: "loop", 10: "end", 20: "loop"}
    assert graph.next_chain(links, starts, 2).count() == 5


def test_politeness_across_chunks(spark):
    rnd = random.Random(8)
    rows = sorted((rnd.choice(["a", "b"]), rnd.randint(0, 400_000_000), i) for i in range(300))
    df = spark.createDataFrame([(h, t, i) for h, t, i in rows], "host string, ts_us long, id long")
    got = {r.id: (r.in_window, r.too_soon) for r in audit.politeness_audit(df, 10, 500_000, chunk_us=70_000_000).collect()}
    for h, t, i in rows:
        inside = sum(1 for g, u, _ in rows if g == h and t - 59_999_999 <= u <= t)
        earlier = [(u, j) for g, u, j in rows if g == h and (u, j) < (t, i)]
        assert got[i] == (inside, bool(earlier) and t - max(earlier)[0] < 500_000)


def test_redaction_order(spark):
    rows = spark.createDataFrame([("可以爬取可以抓取",), ("nothing",), (None,)], "t string")
    done = policy.redact_verdicts(rows, "t").collect()
    assert [(r.clean, r.redacted) for r in done] == [(lexicon.REVIEW_MARK, 2), ("nothing", 0), ("", 0)]
