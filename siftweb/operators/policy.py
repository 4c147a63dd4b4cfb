"""Policy screening: robots rules, seed pages, clauses, scoring, overlays, report."""

from __future__ import annotations

import json
import re
from string import ascii_letters

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftweb.functions import html, lexicon, urls
from siftweb.functions.fold import scan
from siftweb.functions.multimatch import WordIndex, required_words
from siftweb.functions.urls import bind
from siftweb.operators.batching import batch_by_budget
from siftweb.scale import join_by_hot_key, only, unnest
from siftweb.session import cut_lineage

# ---- robots --------------------------------------------------------------------


def robots_groups(rules: DataFrame, agent: str, site: str = "site") -> DataFrame:
    """One row per site: the allow and disallow prefixes that bind ``agent``.

    The longest agent name inside the user agent wins, else ``*``. A site's rules come from one file,
    so the arrays stay small.
    """
    name = F.col("agent")
    fits = (name == "*") | F.contains(F.lit(agent.lower()), F.lower(name)) if agent else name == "*"
    weight = F.when(name == "*", -1).otherwise(F.length(name))
    usable = rules.filter(fits).withColumn("_w", weight)
    groups = usable.groupBy(site).agg(
        F.max(F.struct("_w", "agent")).alias("best"), F.collect_set(F.struct("agent", "verb", "path")).alias("rules"))
    pick = lambda verb: F.transform(F.filter("rules", lambda r: (r["agent"] == F.col("best.agent")) & (r["verb"] == verb)), lambda r: r["path"])
    return groups.select(site, pick("allow").alias("allow"), pick("disallow").alias("disallow"))


def robots_allowed(df: DataFrame, groups: DataFrame, url: str = "url", site: str = "site") -> DataFrame:
    """Add ``robots_ok``: out only when the longest matching Disallow beats the longest Allow."""
    joined = join_by_hot_key(df, groups, site, F.col(url))
    path = F.when(urls.path_of(F.col(url)) == "", "/").otherwise(urls.path_of(F.col(url)))
    longest = lambda prefixes: F.coalesce(F.array_max(F.transform(F.filter(
        prefixes, lambda p: (p != "") & F.startswith(F.col("_path"), p)), lambda p: F.length(p))), F.lit(0))
    return (joined.withColumn("_path", path)
            .withColumn("robots_ok", longest(F.col("disallow")) <= longest(F.col("allow")))
            .withColumn("robots_ok", F.coalesce("robots_ok", F.lit(True))).drop("_path", "allow", "disallow"))


# ---- seed pages ------------------------------------------------------------------

SEED = ["site", "start_url", "url", "source", "anchor", "pos"]


def anchor_seeds(pages: DataFrame) -> DataFrame:
    """Links of a start page that announce a policy page, by text or by path."""
    from siftweb.operators.extract import extract_anchors

    found = extract_anchors(pages).filter(~F.lower("href").rlike("^(?:javascript:|mailto:|tel:|#)"))
    return (found.filter((F.col("hint") != "") | (urls.looks_like_legal_url(F.col("href")) != ""))
            .select(urls.host_of(F.col("base_url")).alias("site"), F.col("base_url").alias("start_url"),
                    urls.join_url(F.col("base_url"), urls.trimmed(F.col("href"))).alias("url"),
                    F.when(F.col("hint") != "", "页脚链接").otherwise("URL 特征").alias("source"),
                    F.left("text", F.lit(80)).alias("anchor"), F.col("pos").cast("long").alias("pos")))


def sitemap_seeds(locs: DataFrame) -> DataFrame:
    """``locs``: site, start_url, loc, seen."""
    return locs.filter(urls.looks_like_legal_url(F.col("loc")) != "").select(
        "site", "start_url", urls.join_url(F.col("start_url"), F.col("loc")).alias("url"), F.lit("sitemap").alias("source"),
        F.lit("").alias("anchor"), (F.col("seen") + (1 << 40)).alias("pos"))


def path_seeds(starts: DataFrame) -> DataFrame:
    """The usual addresses of each site: thirty rows per start, from a literal array of rooted paths."""
    paths = F.array(*[F.lit(p) for p in lexicon.LEGAL_PATHS])
    rows = starts.select("site", "start_url", urls.root_of(F.col("start_url")).alias("_root"), F.posexplode(paths).alias("n", "path"))
    url = F.coalesce(F.concat("_root", "path"), urls.join_url(F.col("start_url"), F.col("path")))
    return rows.select("site", "start_url", url.alias("url"), F.lit("路径词典").alias("source"),
        F.lit("").alias("anchor"), (F.col("n") + (1 << 41)).cast("long").alias("pos"))


def seed_reason(same_host_only: bool = True) -> Column:
    """Why a seed is not fetched, '' when it is."""
    foreign = F.lit(same_host_only) & ~urls.same_host(F.col("url"), F.col("start_url"))
    return (F.when(foreign, "站外链接（本次不扫描跨域页面）")
            .when(urls.is_non_html(F.col("url")), "非 HTML 资源（PDF/文档/媒体），无法做文本提取").otherwise(""))


def union_seeds(*tables: DataFrame) -> DataFrame:
    out = tables[0].select(*SEED)
    for t in tables[1:]:
        out = out.unionByName(t.select(*SEED))
    return out.filter(F.lower("url").rlike("^https?://")).withColumn("reason", seed_reason())


def rank_legal_seeds(seeds: DataFrame, n: int = 12) -> DataFrame:
    """Seeds per start, one per address (best source, earliest on ties), with their position.

    ``picked`` marks the first ``n``; the others stay as rows with a reason. A start names few pages, so
    its group is small however many starts there are.
    """
    rank = F.lit(0)
    for name, value in lexicon.SOURCE_RANK.items():
        rank = F.when(F.col("source") == name, value).otherwise(rank)
    keyed = seeds.filter(F.col("reason") == "").withColumn("url", urls.legal_url_key(F.col("url"))).withColumn("rank", rank)
    # moved once, by start: the addresses of a start and their order are both found where its rows lie
    dealt = keyed.select(*SEED, "rank").repartition("site", "start_url")
    best = F.min(F.struct((-F.col("rank")).alias("r"), "pos", "source", "anchor")).alias("_best")
    ones = dealt.groupBy("site", "start_url", "url").agg(best).select(
        "site", "start_url", "url", (-F.col("_best.r")).alias("rank"), F.col("_best.source").alias("source"), F.col("_best.anchor").alias("anchor"))
    order = Window.partitionBy("site", "start_url").orderBy(F.col("rank").desc(), F.length("url"), "url")
    numbered = ones.withColumn("position", F.row_number().over(order).cast("long"))
    return numbered.withColumn("picked", F.col("position") <= n).withColumn(
        "reason", F.when(F.col("position") > n, f"超出页面数上限（{n}）").otherwise(""))


# ---- clauses -----------------------------------------------------------------------

# --- fixed values: line endings and numbering that make or unmake a heading
HEADING = (r"^(?:第\s*[一二三四五六七八九十百零两\d]+\s*[条章节款项]|[一二三四五六七八九十]+\s*[、\.]|"
           r"\d+(?:\.\d+)*\s*[、\.]?\s|(?i:article|section|clause|appendix|schedule)\s+\d+|[（(]\s*[一二三四五六七八九十\d]+\s*[)）])")
SENTENCE_END = r"""[.。！？!?](?:(?<!\.)(?![。！？!?])|(?<=[A-Za-z0-9%)"'’”]\.)(?=\s|$))"""
HEADING_MAX, SHORT_HEADING_MAX, PREFIX_MAX = 48, 24, 30


def looks_like_heading(line: Column) -> Column:
    short = F.length(line) <= HEADING_MAX
    ends = line.rlike("[。！？.!?]$")
    return short & ~ends & (line.rlike(HEADING) | (~line.rlike("[，,、；;]$") & (F.length(line) <= SHORT_HEADING_MAX)))


def heading_prefix(line: Column) -> Column:
    """Section name in front of a numbered clause, '' for other lines."""
    cut = F.lit(0)
    for mark in reversed(["：", ":", "—", "-", "－"]):
        at = F.locate(mark, line)
        cut = F.when((at > 1) & (at <= PREFIX_MAX + 1), at).otherwise(cut)
    text = bind(cut, lambda c: F.when(c > 0, F.substring(line, F.lit(1), c - 1)).otherwise(F.left(line, F.lit(PREFIX_MAX))))
    return F.when(line.rlike(HEADING), urls.trimmed(text)).otherwise("")


#: ranges of a line, blanks outside skipped: sentences until they hold 80 characters, with a tail under 8 if nothing else follows, or what is left
_BLANK, _INK = f"[{urls.BLANKS}]", f"[^{urls.BLANKS}]"
_FULL = f"{_INK}.{{{lexicon.TARGET_CLAUSE_CHARS - 2},}}?(?![{ascii_letters} ,]){SENTENCE_END}"  # letters are told apart by one table, which saves the longer test
_TAIL = rf"{_BLANK}*+{_INK}(?:.{{0,{lexicon.MIN_CLAUSE_CHARS - 3}}}{_INK})?(?={_BLANK}*+\z)"
_RANGE = rf"(?s)\G{_BLANK}*+(?:{_FULL}(?:{_TAIL})?|{_INK}(?:.*{_INK})?)"


#: pieces of an overlong range: up to its limit, cut at the last blank of the second half where there is one; blanks behind a piece are skipped
_LONG = (rf"(?sU)\G((?=.{{{lexicon.MAX_CLAUSE_CHARS + 1}}})(?:.{{{lexicon.MAX_CLAUSE_CHARS // 2},{lexicon.MAX_CLAUSE_CHARS - 1}}}(?= )|.{{{lexicon.MAX_CLAUSE_CHARS}}})"
         rf"|(?!.{{{lexicon.MAX_CLAUSE_CHARS + 1}}}).+)\s*")


def split_long(text: Column) -> Column:
    """(at, text) of the parts of one range, each of 1500 characters at most."""
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(_LONG), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(_LONG), F.lit(1)).alias("own"))
    placed = scan(parts, F.lit(0), lambda at, p: at + F.length(p["whole"]), "struct<item:struct<whole:string,own:string>,state:int>")
    cut = F.transform(placed, lambda p: F.struct(p["state"].alias("at"), p["item"]["own"].alias("text")))
    return F.when(F.length(text) > lexicon.MAX_CLAUSE_CHARS, cut).otherwise(F.array(F.struct(F.lit(0).alias("at"), text.alias("text"))))


def line_clauses(line: Column) -> Column:
    """(at, text) of the clauses of one line of running text."""

    def of_ranges(ranges: Column) -> Column:
        """A match ends where its range ends, so its blanks in front are what the range doesn't hold."""
        placed = scan(ranges, F.lit(0), lambda at, r: at + F.length(r), "struct<item:string,state:int>")
        own = F.transform(placed, lambda r: bind(F.ltrim(r["item"], F.lit(urls.BLANKS)), lambda t: F.struct(
            (r["state"] + F.length(r["item"]) - F.length(t)).alias("at"), t.alias("text"))))
        parts = lambda rs: F.flatten(F.transform(rs, lambda r: F.transform(
            split_long(r["text"]), lambda p: F.struct((r["at"] + p["at"]).alias("at"), p["text"].alias("text")))))
        return F.when(F.length(line) > lexicon.MAX_CLAUSE_CHARS, bind(own, parts)).otherwise(own)

    return bind(F.regexp_extract_all(line, F.lit(_RANGE), F.lit(0)), of_ranges)


def heading_carry(text: Column) -> Column:
    """The lines of a text with their offsets and the heading that holds for each: struct<item: struct<line, own, alone>, state: struct<offset, heading>>.

    ``own`` is the heading a line sets, if any, ``alone`` says that the line is nothing else; ``state`` is what holds before the line.
    """
    marked = F.transform(F.split(text, "\n"), lambda line: bind(looks_like_heading(line) & (line != ""), lambda alone: F.struct(
        line.alias("line"), F.when(alone, F.left(line, F.lit(HEADING_MAX))).otherwise(F.nullif(heading_prefix(line), F.lit(""))).alias("own"), alone.alias("alone"))))
    return scan(marked, F.struct(F.lit(0).alias("offset"), F.lit("").alias("heading")), lambda state, x: F.struct(
        (state["offset"] + F.length(x["line"]) + 1).alias("offset"), F.coalesce(x["own"], state["heading"]).alias("heading")),
        "struct<item:struct<line:string,own:string,alone:boolean>,state:struct<offset:int,heading:string>>")


def clause_array(text: Column) -> Column:
    """Clauses of one normalised page text, ``text[start:end]`` being the clause itself.

    Lines get their offsets and headings in one pass; every line's clauses are an array of their own, joined once.
    """

    def of_line(x: Column) -> Column:
        line, heading = x["item"]["line"], F.coalesce(x["item"]["own"], x["state"]["heading"])
        parts = F.when(x["item"]["alone"], F.array(F.struct(F.lit(0).alias("at"), line.alias("text")))).otherwise(line_clauses(line))
        return F.when(line == "", F.array().cast("array<struct<text:string,start:int,end:int,heading:string>>")).otherwise(F.transform(parts, lambda p: F.struct(
            p["text"].alias("text"), (x["state"]["offset"] + p["at"]).alias("start"), (x["state"]["offset"] + p["at"] + F.length(p["text"])).alias("end"), heading.alias("heading"))))

    return F.flatten(F.transform(heading_carry(text), of_line))


def segment_clauses(texts: DataFrame, page_index: str = "page_index", text: str = "text", url: str = "page_url") -> DataFrame:
    """One row per clause; a page is folded inside its row, so nothing shuffles."""
    keep = [page_index] + ([url] if url in texts.columns else [])
    rows = unnest(texts, keep, clause_array(F.col(text)), "c", "clause_index")
    return rows.select(*keep, F.col("clause_index").cast("long").alias("clause_index"),
                       F.concat(F.col(page_index).cast("string"), F.lit(":"), F.col("clause_index").cast("string")).alias("uid"),
                       F.col("c.text").alias("text"), F.col("c.start").cast("long").alias("start"),
                       F.col("c.end").cast("long").alias("end"), F.col("c.heading").alias("heading"))


# ---- scoring -------------------------------------------------------------------------

def _guarded(term: str) -> Column:
    """A term as data: how it is shown, looked for and cut at, and the markers that change its meaning nearby."""
    low = term.lower()
    return F.struct(F.lit(term).alias("label"), F.lit(low).alias("low"), F.lit(re.escape(low)).alias("cut"),
                    F.array(*map(F.lit, lexicon.markers_of(low))).cast("array<string>").alias("markers"))


def _found(low: Column, term: Column) -> Column:
    """The term occurs at least once away from its markers."""
    reach = lexicon.FALSE_POSITIVE_WINDOW

    def some_clean(parts: Column) -> Column:
        """The text cut at the term: hit ``i`` lies between parts i and i + 1, and ``reach`` parts hold ``reach`` characters."""

        def clean(i: Column) -> Column:
            begin = F.greatest(i - reach, F.lit(1))
            before = F.call_function("array_join", F.slice(parts, begin, i - begin + 1), term["low"])
            after = F.call_function("array_join", F.slice(parts, i + 1, F.lit(reach + 1)), term["low"])
            window = F.concat(F.right(before, F.lit(reach)), term["low"], F.left(after, F.lit(reach)))
            return ~bind(window, lambda w: F.exists(term["markers"], lambda m: F.contains(w, m)))

        return F.exists(F.sequence(F.lit(1), F.size(parts) - 1), clean)

    there = F.contains(low, term["low"])
    return F.when(F.size(term["markers"]) == 0, there).when(there, bind(F.split(low, term["cut"], -1), some_clean)).otherwise(False)


def contains_term(low: Column, term: str) -> Column:
    """Term occurs at least once away from the markers that change its meaning."""
    return bind(_guarded(term), lambda t: _found(low, t))


def any_of(low: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(low, F.lit(word.lower()))
    return hit


def context_flags(df: DataFrame, low: str = "_low") -> DataFrame:
    """Add prohibition, negation, permission and the note that follows from them."""
    text = F.col(low)
    out = (df.withColumn("prohibition", any_of(text, lexicon.PROHIBITION_HINTS))
           .withColumn("negation", any_of(text, lexicon.NEGATION_HINTS))
           .withColumn("permission", any_of(text, lexicon.PERMISSION_HINTS)))
    return out.withColumn("context_note", _context_note())


def _context_note() -> Column:
    return (F.when(F.col("negation"), lexicon.NOTE_NEGATION).when(F.col("permission") & ~F.col("prohibition"), lexicon.NOTE_PERMISSION)
            .when(F.col("prohibition"), lexicon.NOTE_PROHIBITION).otherwise(""))


#: numbers of the context flags in the index
_FLAGS = {"prohibition": (-1, lexicon.PROHIBITION_HINTS), "negation": (-2, lexicon.NEGATION_HINTS), "permission": (-3, lexicon.PERMISSION_HINTS)}


def _lexicon_index(known: list[str], terms: dict, patterns: dict) -> tuple[WordIndex, list[dict], list[tuple[int, str, bool]]]:
    """Index over terms, hints and the words that the patterns need; the items in evidence order; the patterns as (item, pattern, always tried)."""
    words: dict[str, list[int]] = {}
    items: list[dict] = []
    tried = []
    for at, category in enumerate(known):
        for pattern, weight, label in patterns.get(category, []):
            needed = required_words(pattern)
            for word in needed or ():
                words.setdefault(word, []).append(len(items))
            tried.append((len(items), pattern, not needed))
            items.append({"at": at, "label": label, "weight": weight, "low": None, "cut": None, "markers": []})
        for strength, weight in (("strong", lexicon.STRONG_WEIGHT), ("weak", lexicon.WEAK_WEIGHT)):
            for term in terms.get(category, {}).get(strength, []):
                low = term.lower()
                words.setdefault(low, []).append(len(items))
                items.append({"at": at, "label": term, "weight": weight, "low": low, "cut": re.escape(low), "markers": list(lexicon.markers_of(low))})
    for number, hints in _FLAGS.values():
        for hint in hints:
            words.setdefault(hint.lower(), []).append(number)
    return WordIndex(words), items, tried


_ITEM = "struct<at:int,label:string,weight:int,low:string,cut:string,markers:array<string>>"


def score_clauses(clauses: DataFrame, terms: dict | None = None, patterns: dict | None = None,
                  min_confidence: float = lexicon.MIN_CONFIDENCE) -> DataFrame:
    """One row per (clause, category) that reaches the threshold.

    The lexicon is plan-time data, so every clause is scored inside its row: no join, no shuffle. One pass over the clause
    proposes terms, hints and patterns by an index; only proposed terms that have markers and proposed patterns are tested further.
    Weights are integers; the factors 1.18, 0.55 and 0.85 scale them to millionths, rounded once.
    """
    terms = lexicon.TERMS if terms is None else terms
    patterns = lexicon.PATTERNS if patterns is None else patterns
    known = [c for c in lexicon.CATEGORIES if c in terms or c in patterns]
    index, items, tried = _lexicon_index(known, terms, patterns)
    table = F.from_json(F.lit(json.dumps(items, ensure_ascii=False)), f"array<{_ITEM}>")
    proposed = clauses.withColumn("_low", F.lower("text")).withColumn("_ids", index.proposed(F.col("_low")))
    if not any(always for _, _, always in tried):
        proposed = only(proposed, F.size("_ids") > 0)  # most clauses hold no word of the lexicon: nothing to weigh
    flagged = proposed.withColumns({name: F.array_contains("_ids", number) for name, (number, _) in _FLAGS.items()})
    flagged = flagged.withColumn("context_note", _context_note())
    certain = lambda i: bind(F.get(table, i), lambda t: (i >= 0) & t["low"].isNotNull() & _found(F.col("_low"), t))
    by_pattern = [F.when((F.lit(always) | F.array_contains("_ids", i)) & F.col("text").rlike(p), F.lit(i)) for i, p, always in tried]
    hits = F.filter("_ids", certain)
    if by_pattern:
        hits = F.array_sort(F.concat(hits, F.array_compact(F.array(*by_pattern))))
    evidence = F.transform(hits, lambda i: bind(F.get(table, i), lambda t: F.struct(t["at"].alias("at"), t["label"].alias("label"), t["weight"].alias("weight"))))
    matched = flagged.withColumn("_found", evidence)
    per = F.transform(F.array_distinct(F.transform("_found", lambda e: e["at"])),
                      lambda at: F.struct(at.alias("at"), F.filter("_found", lambda e: e["at"] == at).alias("found")))
    rows = unnest(matched, [*clauses.columns, "prohibition", "negation", "permission", "context_note"], per, "h")
    cents = F.least(F.aggregate("h.found", F.lit(0), lambda acc, m: acc + m["weight"]), F.lit(100))
    # three integer factors of hundredths: the product is in millionths
    boosted = F.when(F.col("prohibition"), F.least(cents * lexicon.PROHIBITION_FACTOR, F.lit(10_000))).otherwise(cents * 100)
    factor = F.when(F.col("negation"), lexicon.NEGATION_FACTOR).when(F.col("permission"), lexicon.PERMISSION_FACTOR).otherwise(100)
    scored = rows.withColumn("_millionths", (boosted * factor).cast("long"))
    name = lambda values: F.get(F.array(*map(F.lit, values)), F.col("h.at"))
    return (scored.filter(F.col("_millionths") >= round(min_confidence * 1_000_000))
            .select(*clauses.columns, name(known).alias("category"),
                    F.array_join(F.transform(F.slice("h.found", 1, lexicon.MAX_EVIDENCE), lambda m: m["label"]), "、").alias("matched_terms"),
                    (F.floor((F.col("_millionths") + 500) / 1000) / 1000).cast("double").alias("confidence"),
                    "context_note", name([lexicon.REVIEW_HINTS[c] for c in known]).alias("review_hint")))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.75, "高").when(confidence >= 0.5, "中").otherwise("低")


def top_findings(hits: DataFrame, n: int = lexicon.MAX_FINDINGS, url: str = "page_url") -> DataFrame:
    return hits.orderBy(F.col("confidence").desc(), url, "clause_index", "category").limit(n)


def top_candidates(hits: DataFrame, n: int = 30) -> DataFrame:
    """Best hit per clause (first category on ties), then the n best of all."""
    return best_per_clause(hits).orderBy(F.col("confidence").desc(), "page_index", "clause_index").limit(n)


def best_per_clause(hits: DataFrame) -> DataFrame:
    """Best hit of every clause, the first category on ties."""
    order = F.lit(len(lexicon.CATEGORIES))
    for i, c in enumerate(lexicon.CATEGORIES):
        order = F.when(F.col("category") == c, i).otherwise(order)
    per_uid = Window.partitionBy("uid").orderBy(F.col("confidence").desc(), order)
    return hits.withColumn("_n", F.row_number().over(per_uid)).filter(F.col("_n") == 1).drop("_n")


def chunk_by_budget(candidates: DataFrame, budget: int = 12_000, clip: int = 400, order=("rank",)) -> DataFrame:
    """Greedy batches (uid, batch) of any number of candidates: a new one starts when the next would pass the budget."""
    size = F.least(F.length(F.coalesce("text", F.lit(""))), F.lit(clip + 1)) + 80
    return batch_by_budget(candidates, [*map(F.col, order), F.col("uid")], size, budget, "uid")


def category_stats(hits: DataFrame) -> DataFrame:
    """Count per category in report order, zero when there is none."""
    counts = hits.groupBy("category").agg(F.count(F.lit(1)).alias("hits"))
    spark = hits.sparkSession
    names = spark.createDataFrame([(i, c, lexicon.LABELS[c]) for i, c in enumerate(lexicon.CATEGORIES)],
                                  "pos int, category string, label string")
    return (names.join(F.broadcast(counts), "category", "left")
            .select("pos", "category", "label", F.coalesce("hits", F.lit(0)).alias("count")).orderBy("pos").drop("pos"))


def report_totals(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Hits, readable pages, skipped pages."""
    ok = (F.col("error") == "") & (F.col("chars") > 0)
    return pages.agg(F.count_if(ok).alias("pages_scanned"), F.count_if(~ok).alias("pages_skipped")).withColumn(
        "total_hits", hits.agg(F.count(F.lit(1)).alias("n")).scalar())


def with_titles(hits: DataFrame, pages: DataFrame, url: str = "page_url") -> DataFrame:
    titles = pages.groupBy(F.col("url").alias(url)).agg(F.min("title").alias("page_title"))  # of several titles the least
    return join_by_hot_key(hits, titles, url, F.col("uid")).withColumn("page_title", F.coalesce("page_title", F.lit("")))


# ---- wording guard and overlays ---------------------------------------------------------

def redact_verdicts(df: DataFrame, text: str, out: str = "clean", count: str = "redacted") -> DataFrame:
    """Replace statements that sound like a verdict, in order, and count the replacements."""
    current = df.withColumn(out, F.coalesce(F.col(text), F.lit(""))).withColumn(count, F.lit(0))
    for pattern in lexicon.VERDICT_PATTERNS:
        current = (current.withColumn(count, F.col(count) + F.regexp_count(out, F.lit(pattern)))
                   .withColumn(out, F.regexp_replace(out, pattern, lexicon.REVIEW_MARK)))
    merged = F.regexp_replace(out, f"(?:{lexicon.REVIEW_MARK}){{2,}}", lexicon.REVIEW_MARK)
    return current.withColumn(out, F.when(F.col(count) > 0, merged).otherwise(F.col(out))).withColumn(count, F.col(count).cast("long"))


def _for_match(text: Column) -> Column:
    return F.lower(urls.trimmed(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "　\xa0", "  "), r"(?U)\s+", " ")))


def quote_in_source(quote: Column, source: Column) -> Column:
    """Every stretch of the quote between ellipses occurs in the source, blanks and case aside."""
    pieces = F.filter(F.split(_for_match(quote), r"(?:\.\.\.|…)+"), lambda s: urls.trimmed(s) != "")
    return bind(pieces, lambda p: (F.size(p) > 0) & F.forall(p, lambda s: F.contains(_for_match(source), s)))


def parse_refinements(answers: DataFrame, text: str = "answer") -> DataFrame:
    """Answers of an annotating service to rows: uid, category, label, note, relevant, quote, intercepted.

    Accepts a code fence, an array, ``{"items": [...]}`` and ``{uid: {...}}``.
    """
    bare = urls.trimmed(F.regexp_replace(urls.trimmed(F.col(text)), r"(?m)^```(?:json)?|```$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    parsed = answers.withColumn("_v", F.coalesce(F.try_parse_json(bare), F.try_parse_json(inner)))
    items = F.try_variant_get("_v", "$.items", "variant")
    box = F.when(F.schema_of_variant("_v").startswith("ARRAY"), F.col("_v")) \
        .when(F.schema_of_variant(items).startswith("ARRAY"), items).otherwise(F.col("_v"))
    opened = parsed.filter(F.col("_v").isNotNull()).withColumn("_box", box)
    spark = answers.sparkSession
    rows = opened.lateralJoin(spark.tvf.variant_explode(F.col("_box").outer()).toDF("_pos", "_key", "_item"))
    get = lambda name: F.coalesce(F.try_variant_get("_item", f"$.{name}", "string"), F.lit(""))
    raw = rows.filter(F.schema_of_variant("_item").startswith("OBJECT")).select(
        urls.trimmed(F.coalesce(F.col("_key"), get("uid"))).alias("uid"), F.lower(urls.trimmed(get("category"))).alias("_category"),
        get("label").alias("_label"), get("note").alias("_note"),
        F.coalesce(F.try_variant_get("_item", "$.relevant", "boolean"), F.lit(True)).alias("relevant"), urls.trimmed(get("quote")).alias("quote"))
    clean = redact_verdicts(redact_verdicts(raw.filter(F.col("uid") != ""), "_label", "label", "_n1"), "_note", "note", "_n2")
    return clean.select("uid", F.when(F.col("_category").isin(lexicon.CATEGORIES), F.col("_category")).otherwise("").alias("category"),
                        F.left(urls.trimmed(F.col("label")), F.lit(40)).alias("label"), F.left(urls.trimmed(F.col("note")), F.lit(200)).alias("note"),
                        "relevant", "quote", (F.col("_n1") + F.col("_n2")).alias("intercepted"))


def _last_answers(refinements: DataFrame, order: str | None) -> DataFrame:
    """One answer per clause: the last by ``order``, of equally late ones, or without an order, the greatest row."""
    rest = [c for c in refinements.columns if c != "uid"]
    last = F.max(F.struct(*([order] if order else []), *[c for c in rest if c != order]))
    return refinements.groupBy("uid").agg(last.alias("r")).select("uid", "r.*")


def apply_refinements(hits: DataFrame, refinements: DataFrame, order: str | None = None) -> DataFrame:
    """Overlay labels and notes; hits judged beside the point lose a tenth, nothing is removed. Of several answers the last counts.

    Both branches read one written overlay, so hits and answers are computed once.

    A category the clause had no hit in is added once with confidence 0.4.
    """
    r = _last_answers(refinements, order)
    r = r.select("uid", *[F.col(c).alias(f"_{c}") for c in refinements.columns if c != "uid"])
    joined = hits.join(r, "uid", "left").withColumn("llm_applied", F.col("_relevant").isNotNull())
    label = F.coalesce(F.col("_label"), F.lit(""))
    off = F.col("llm_applied") & ~F.coalesce(F.col("_relevant"), F.lit(True))
    overlaid = (joined.withColumn("llm_label", F.when(off, F.concat(F.lit("模型标注可能不相关（需人工确认）："), label)).otherwise(label))
                .withColumn("llm_note", F.coalesce(F.col("_note"), F.lit("")))
                .withColumn("confidence", F.when(off, F.bround(F.col("confidence") * 0.9, 3)).otherwise(F.col("confidence")))
                .withColumn("quote_dropped", F.col("llm_applied") & (F.col("_quote") != "") & ~quote_in_source(F.col("_quote"), F.col("text"))))
    overlaid = cut_lineage(overlaid)
    known = F.collect_set("category").over(Window.partitionBy("uid"))
    # a clause has six hits at most, so its window is tiny
    first = F.row_number().over(Window.partitionBy("uid").orderBy(F.col("confidence").desc(), "category"))
    fresh = (overlaid.withColumn("_known", known).withColumn("_n", first)
             .filter((F.col("_n") == 1) & F.col("llm_applied") & F.col("_relevant") & (F.col("_category") != "")
                     & ~F.array_contains("_known", F.col("_category")))
             .withColumn("category", F.col("_category")).withColumn("matched_terms", F.lit(lexicon.TERM_ADDED))
             .withColumn("confidence", F.lit(0.4)).withColumn("context_note", F.lit(lexicon.NOTE_ADDED))
             .withColumn("llm_label", F.col("_label")).withColumn("quote_dropped", F.lit(False)))
    keep = [*hits.columns, "llm_applied", "llm_label", "llm_note", "quote_dropped"]
    return overlaid.select(*keep).withColumn("added", F.lit(False)).unionByName(fresh.select(*keep).withColumn("added", F.lit(True)))


def guard_stats(overlaid: DataFrame, refinements: DataFrame, order: str | None = None) -> DataFrame:
    """Intercepted statements (once per clause) and quotes that are not in their source."""
    touched = overlaid.filter("llm_applied").select("uid").distinct()
    once = _last_answers(refinements, order).join(touched, "uid", "left_semi")
    dropped = overlaid.agg(F.count_if("quote_dropped").alias("n")).scalar()
    return once.agg(F.coalesce(F.sum("intercepted"), F.lit(0)).cast("long").alias("intercepted")).withColumn("dropped_quotes", dropped)


def failure_reason(status: Column, error: Column) -> Column:
    out = F.when(F.coalesce(error, F.lit("")) != "", error) \
        .when(F.coalesce(status, F.lit(0)) != 0, F.concat(F.lit("HTTP "), status.cast("string"))).otherwise("抓取失败")
    for code, text in lexicon.STATUS_REASONS.items():
        out = F.when(status == code, text).otherwise(out)
    return out


def is_retryable(status: Column, error: Column, annotating: bool = False) -> Column:
    """Transport failures and server errors; an annotating service also when it limits the rate."""
    broken = F.coalesce(error, F.lit("")) != ""
    again = (status == 0) | (status >= 500)
    return (again | (status == 429)) if annotating else broken & again


def compliance_report(sites: DataFrame, pages: DataFrame, hits: DataFrame, skipped: DataFrame, scan_time: str,
                      most_findings: int = lexicon.MAX_FINDINGS, most_skipped: int = 50) -> DataFrame:
    """One nested report per site: always the notice, every category, the best ``most_findings`` and the first ``most_skipped``.

    A report is read by people; both lengths are the caller's, and all rows stay in ``hits`` and ``skipped``.
    """
    page = F.struct("url", "title", "status", "chars", "error", "matched_by")
    hit = F.struct(F.col("confidence"), F.col("page_url").alias("source_url"), F.col("clause_index"), F.col("category"), F.col("text").alias("quote"),
                   F.col("matched_terms"), F.col("heading"), F.col("uid"), F.col("start").alias("char_offset"), F.col("context_note"),
                   confidence_band(F.col("confidence")).alias("confidence_text"), F.lit(True).alias("needs_human_review"), F.col("review_hint"))
    order = Window.partitionBy("site").orderBy(F.col("confidence").desc(), "page_url", "clause_index", "category")
    best = hits.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most_findings)
    per_page = pages.groupBy("site").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    per_hit = best.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("_n", hit.alias("hit")))).alias("_hits"))
    per_skip = skipped.withColumn("_n", F.row_number().over(Window.partitionBy("site").orderBy("url", "reason"))) \
        .filter(F.col("_n") <= most_skipped).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("url", "reason"))).alias("skipped"))
    empty = lambda name, like: F.coalesce(F.col(name), F.array().cast(like.schema[name].dataType))
    joined = (sites.join(per_page, "site", "left").join(per_hit, "site", "left").join(per_skip, "site", "left")
              .withColumn("pages", empty("pages", per_page)).withColumn("skipped", empty("skipped", per_skip))
              .withColumn("findings", F.transform(empty("_hits", per_hit), lambda h: h["hit"])))
    stats = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(lexicon.LABELS[c]).alias("label"),
                               F.size(F.filter("findings", _in_category(c))).alias("count")) for c in lexicon.CATEGORIES])
    return joined.select(
        F.lit("1.0").alias("report_version"), "site", "start_url", F.lit(scan_time).alias("scan_time"), F.lit("local").alias("engine"),
        F.lit(lexicon.DISCLAIMER).alias("disclaimer"), F.lit(lexicon.DISCLAIMER_VERSION).alias("disclaimer_version"), "pages", "skipped",
        "findings", stats.alias("stats"), F.array(*[F.lit(s) for s in lexicon.NEXT_STEPS]).alias("next_steps"))


def _in_category(name: str):
    return lambda h: h["category"] == name


def report_markdown(reports: DataFrame) -> DataFrame:
    """Readable form: site and text."""
    c, lit = F.concat, F.lit
    quote = lambda t: F.array_join(F.transform(F.split(t, "\n"), lambda s: c(lit("> "), s)), "\n")
    or_else = lambda v, d: F.when(v == "", d).otherwise(v)
    ok = F.size(F.filter("pages", lambda p: (p["error"] == "") & (p["chars"] > 0)))
    row = lambda k, v: c(lit(f"| {k} | "), v.cast("string"), lit(" |"))
    head = F.array(lit(f"# {lexicon.REPORT_TITLE}"), lit("## 免责声明"), quote(F.col("disclaimer")), lit("## 一、站点与扫描概况"),
                   F.array_join(F.array(lit("| 项目 | 内容 |"), lit("| --- | --- |"), row("起始网址", F.col("start_url")), row("站点", F.col("site")),
                                        row("扫描时间", F.col("scan_time")), row("检测引擎", lit("本地关键词匹配（未使用 LLM）")),
                                        row("成功扫描页面", c(ok.cast("string"), lit(" 个"))), row("命中线索", c(F.size("findings").cast("string"), lit(" 条"))),
                                        row("跳过页面", c(F.size("skipped").cast("string"), lit(" 项")))), "\n"),
                   lit("## 二、分类命中统计"),
                   c(lit("| 关注类别 | 命中线索数 |\n| --- | --- |\n"), F.array_join(F.transform(
                       "stats", lambda s: c(lit("| "), s["label"], lit(" | "), s["count"].cast("string"), lit(" |"))), "\n")),
                   lit("## 三、命中明细"))
    found = F.transform("findings", lambda h: c(
        lit("**置信度："), h["confidence_text"], lit("（"), h["confidence"].cast("string"), lit("）**\n\n- 来源页面："), h["source_url"],
        lit("\n- 小节："), or_else(h["heading"], "（未识别）"), lit("\n- 命中词条："), or_else(h["matched_terms"], "（无）"),
        lit("\n- 原文位置：第 "), (h["clause_index"] + 1).cast("string"), lit(" 条（字符偏移 "), h["char_offset"].cast("string"), lit("）\n\n"),
        quote(h["quote"]), lit("\n\n- **需人工确认**："), h["review_hint"]))
    steps = F.transform("next_steps", lambda s: c(lit("1. "), s))
    return reports.select("site", F.array_join(F.concat(head, found, F.array(lit("## 四、建议的人工后续动作")), steps), "\n\n").alias("text"))
