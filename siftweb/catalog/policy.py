"""Policy screening queries over documents, pages and conversations."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from siftweb.catalog.inputs import load, pages, quoted, sql_host, sql_part
from siftweb.functions import lexicon, urls
from siftweb.operators import policy
from siftweb.scale import unnest
from siftweb.session import cut_lineage
from siftweb.sources.pages import read_robots

# phrases laid over the document lines by (doc_id + line) % 12
PHRASES = ["", "You must not use any crawler or spider.", "see the api doc reference guide", "the api key and quota are not required",
           "不得使用自动化程序抓取数据", "本公司不限制正常频率访问 api 接口", "rate limit: reasonable rate, permitted", "no automated access without prior consent",
           "下载 app 客户端", "reverse engineer or circumvent any technical measures", "允许使用机器人客服", "batch script export copy download limit"]


def lines(spark, folder):
    """Document lines as clauses: a third of all lines carry the same page address."""
    d = load(spark, folder, "documents")
    phrase = F.array(*[F.lit(p) for p in PHRASES])
    rows = unnest(d, ["doc_id"], F.split("text", "\n"), "line", "n")
    url = F.concat(F.lit("https://d.example.com/"), F.when(F.col("doc_id") % 3 == 0, F.lit("hot")).otherwise(F.col("doc_id").cast("string")))
    at = F.element_at(phrase, ((F.col("doc_id") + F.col("n")) % len(PHRASES) + 1).cast("int"))
    return rows.select(F.col("doc_id").alias("page_index"), F.col("n").cast("long").alias("clause_index"), url.alias("page_url"),
                       F.concat("doc_id", F.lit(":"), "n").alias("uid"), F.concat("line", F.lit(" "), at).alias("text"))


def _hits(spark, folder):
    return policy.score_clauses(lines(spark, folder))


def lexicon_scores(spark, folder):
    return _hits(spark, folder).select("uid", "category", "matched_terms", "confidence", "context_note",
                                       policy.confidence_band(F.col("confidence")).alias("band"))


def category_stats(spark, folder):
    return policy.category_stats(_hits(spark, folder))


def top_candidates(spark, folder):
    return policy.top_candidates(_hits(spark, folder)).select("uid", "category", "confidence")


def top_findings(spark, folder):
    return policy.top_findings(_hits(spark, folder)).select("uid", "page_url", "category", "confidence")


_BY_RANK = ("lead", "page_index", "clause_index")


def candidate_batches(spark, folder):
    best = policy.top_candidates(_hits(spark, folder))
    return policy.chunk_by_budget(best.withColumn("lead", -F.col("confidence")), budget=1500, order=_BY_RANK)


def hit_batches(spark, folder):
    """Batches of every clause with a hit."""
    best = policy.best_per_clause(_hits(spark, folder))
    return policy.chunk_by_budget(best.withColumn("lead", -F.col("confidence")), order=_BY_RANK)


def finding_titles(spark, folder):
    heads = load(spark, folder, "documents").filter(F.col("doc_id") % 3 != 0).select(
        F.concat(F.lit("https://d.example.com/"), "doc_id").alias("url"), F.concat("source", F.lit(" "), "lang").alias("title"))
    return policy.with_titles(_hits(spark, folder), heads).select("uid", "category", "page_title")


def clauses(spark, folder):
    """Clauses of the whole documents, long lines and all."""
    from siftweb.functions.html import normalize_text

    d = load(spark, folder, "documents").select(F.col("doc_id").alias("page_index"), normalize_text(F.col("text")).alias("text"))
    return policy.segment_clauses(d)


def clause_totals(spark, folder):
    """What any segmentation must keep: each document's characters without blanks."""
    return clauses(spark, folder).groupBy("page_index").agg(
        F.sum(F.length(F.regexp_replace("text", r"\s", ""))).cast("long").alias("chars"),
        F.max(F.length("text")).alias("longest").cast("long").alias("longest")).select(
        F.col("page_index").alias("doc_id"), "chars", (F.col("longest") <= lexicon.MAX_CLAUSE_CHARS + 8).alias("bounded"))


def _refinements(hits):
    """Annotations that arrive as service answers, one per third clause."""
    h = hits.select("uid", "page_index", "clause_index", "text").distinct()
    n = F.col("page_index") + F.col("clause_index")
    body = F.to_json(F.struct(
        "uid", F.when(n % 2 == 0, "rate_limit").otherwise("none").alias("category"), F.lit("label you can crawl here").alias("label"),
        F.lit("plain note").alias("note"), (n % 4 != 0).alias("relevant"),
        F.when(n % 5 == 0, F.concat(F.left("text", F.lit(5)), F.lit(" ... "), F.right("text", F.lit(4)))).otherwise("not in there").alias("quote")))
    return policy.parse_refinements(h.filter(F.col("clause_index") % 3 == 0).select(
        F.concat(F.lit("```json\n{\"items\": ["), body, F.lit("]}\n```")).alias("answer")))


def refinements(spark, folder):
    hits = cut_lineage(_hits(spark, folder))  # read by the answers and by their overlay
    out = policy.apply_refinements(hits, _refinements(hits))
    return out.select("uid", "category", "confidence", "llm_applied", "llm_label", "llm_note", "quote_dropped", "added")


def refinement_guard(spark, folder):
    hits = cut_lineage(_hits(spark, folder))
    r = cut_lineage(_refinements(hits))
    return policy.guard_stats(policy.apply_refinements(hits, r), r)


def verdict_redaction(spark, folder):
    c = load(spark, folder, "conversations")
    tail = F.array(*[F.lit(t) for t in VERDICTS])
    text = F.concat("text", F.lit(" "), F.element_at(tail, ((F.col("conv_id") + F.col("turn")) % len(VERDICTS) + 1).cast("int")))
    return policy.redact_verdicts(c.withColumn("said", text), "said").select("conv_id", "turn", "clean", "redacted")


VERDICTS = ["you can crawl this", "It is legal; there is no risk", "可以抓取，属于合法，没有任何法律风险", "禁止爬取允许下载", "nothing to see", "it is safe to scrape it"]
ROBOTS = ("User-agent: *\nDisallow: /en/\nAllow: /en/1\n# note\nUser-agent: SiftBot\nUser-agent: other\nDisallow: /de/ # no\nDisallow: /en/9\n\n"
          "user-agent: none\n")


def robots_check(spark, folder):
    p = load(spark, folder, "pages").select("page_id", "url", urls.host_of(F.col("url")).alias("site"))
    files = p.filter(F.col("page_id") % 2 == 0).groupBy("site").agg(F.count(F.lit(1)).alias("n")).select(
        "site", F.concat(F.lit(ROBOTS), F.lit("Disallow: /fr/\n")).alias("text"))
    rules = read_robots(files)
    bots = policy.robots_allowed(p, policy.robots_groups(rules, "Mozilla SiftBot/1.0"))
    plain = policy.robots_allowed(bots.withColumnRenamed("robots_ok", "bot_ok"), policy.robots_groups(rules, "curl"))
    return plain.select("page_id", "bot_ok", "robots_ok")


def robots_rules(spark, folder):
    p = load(spark, folder, "pages").select(F.col("page_id").cast("string").alias("site"), F.concat(F.lit(ROBOTS), F.lit("Disallow: "), urls.path_of(F.col("url"))).alias("text"))
    return read_robots(p).filter(F.col("verb") != "group")


def legal_seeds(spark, folder):
    p = pages(spark, folder)
    # the hints of the reference tables are few, so every page's links count as its entry links
    starts = p.select(urls.host_of(F.col("url")).alias("site"), F.col("base_url").alias("start_url"))
    seeds = policy.union_seeds(policy.anchor_seeds(_legal_pages(p)), policy.path_seeds(starts))
    return policy.rank_legal_seeds(seeds).select("start_url", "url", "source", "position", "picked")


def _legal_pages(p):
    extra = F.concat(F.lit('<a href="/privacy/">Privacy policy</a><a href="https://other.example/terms">Terms</a><a href="/legal.pdf">Legal</a><a href="/Tos?x='),
                     F.col("page_id").cast("string"), F.lit('">read</a>'))
    return p.withColumn("html", F.concat("html", extra))


def failures(spark, folder):
    e = load(spark, folder, "events")
    status = F.element_at(F.array(*[F.lit(s) for s in [0, 200, 401, 404, 429, 500, 503]]), (F.col("event_id") % 7 + 1).cast("int"))
    error = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_type"))
    return e.select("event_id", policy.failure_reason(status, error).alias("reason"), policy.is_retryable(status, error).alias("retry"),
                    policy.is_retryable(status, error, True).alias("retry_annotating"))


QUERIES = {
    "lexicon_scores": lexicon_scores, "category_stats": category_stats, "top_candidates": top_candidates, "top_findings": top_findings,
    "candidate_batches": candidate_batches, "hit_batches": hit_batches, "finding_titles": finding_titles, "clauses": clauses, "clause_totals": clause_totals,
    "refinements": refinements, "refinement_guard": refinement_guard, "verdict_redaction": verdict_redaction,
    "robots_check": robots_check, "robots_rules": robots_rules, "legal_seeds": legal_seeds, "failures": failures,
}

# ---- SQL ----------------------------------------------------------------------------

_TERM_ROWS, _seq = [], 0
for _c in lexicon.CATEGORIES:
    for _strength, _w in (("strong", lexicon.STRONG_WEIGHT), ("weak", lexicon.WEAK_WEIGHT)):
        for _t in lexicon.TERMS[_c][_strength]:
            _seq += 1
            _marks = lexicon.markers_of(_t)
            _TERM_ROWS.append(f"('{_c}', {_seq}, '{_t}', {_w}, [{quoted(_marks)}]::VARCHAR[])")


def _guarded(pattern: str) -> str:
    """A cheap test on the words a pattern starts with, in front of the pattern itself."""
    lead = re.match(r"(?:\(\?i\))?\(\?:([^()\\\[]+)\)", pattern)
    test = f"regexp_matches(text, '{pattern}')"
    if not lead:
        return test
    words = " OR ".join(f"contains(low, '{w}')" for w in lead.group(1).split("|"))
    return f"CASE WHEN {words} THEN {test} ELSE false END"


_PATTERN_SQL = " ".join(
    f"UNION ALL SELECT uid, '{c}', {i - 100}, '{label}', {w} FROM clause WHERE {_guarded(p)}" for c in lexicon.CATEGORIES for i, (p, w, label) in enumerate(lexicon.PATTERNS[c]))
_DOC_PHRASE = "[" + quoted(PHRASES) + "]"


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


_CAT_POS = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(lexicon.CATEGORIES)) + " END"
_HITS = f"""
  raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
  cl AS (SELECT doc_id AS page_index, n AS clause_index, 'https://d.example.com/' || CASE WHEN doc_id % 3 = 0 THEN 'hot' ELSE doc_id::VARCHAR END AS page_url,
           doc_id || ':' || n AS uid, line || ' ' || {_DOC_PHRASE}[((doc_id + n) % 12)::INT + 1] AS text FROM raw),
  clause AS MATERIALIZED (SELECT *, lower(text) AS low, @FLAGS@ FROM cl),
  terms(category, seq, term, weight, markers) AS (VALUES {", ".join(_TERM_ROWS)}),
  cand AS MATERIALIZED (SELECT uid, low, category, seq, term, weight, markers FROM clause, terms WHERE contains(low, term)),
  found AS (SELECT uid, category, seq, term AS label, weight FROM cand WHERE (len(markers) = 0 OR
              len(list_filter(range(1, length(low) - length(term) + 2), lambda i: substr(low, i, length(term)) = term AND
                len(list_filter(markers, lambda m: contains(substr(low, greatest(i - 14, 1), i + length(term) + 14 - greatest(i - 14, 1)), m))) = 0)) > 0)
            {_PATTERN_SQL}),
  agg AS (SELECT uid, category, least(sum(weight), 100)::BIGINT AS cents, list(label ORDER BY seq) AS labels FROM found GROUP BY 1, 2),
  sc AS (SELECT a.*, c.page_index, c.clause_index, c.page_url, c.text, c.neg, c.per, c.pro, (CASE WHEN pro THEN least(cents * 118, 10000) ELSE cents * 100 END *
            CASE WHEN neg THEN 55 WHEN per THEN 85 ELSE 100 END)::BIGINT AS mil FROM agg a JOIN clause c USING (uid)),
  hits AS MATERIALIZED (SELECT uid, category, page_index, clause_index, page_url, text, array_to_string(labels[1:6], '、') AS matched_terms, ((mil + 500) // 1000) / 1000.0::DOUBLE AS confidence,
            CASE WHEN neg THEN '{lexicon.NOTE_NEGATION}' WHEN per AND NOT pro THEN '{lexicon.NOTE_PERMISSION}' WHEN pro THEN '{lexicon.NOTE_PROHIBITION}' ELSE '' END AS context_note,
            {_CAT_POS} AS cat_pos FROM sc WHERE mil >= 350000)""".replace(
    "@FLAGS@", f"{_any(lexicon.PROHIBITION_HINTS)} AS pro, {_any(lexicon.NEGATION_HINTS)} AS neg, {_any(lexicon.PERMISSION_HINTS)} AS per")
_BEST = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY confidence DESC, cat_pos) AS rn FROM hits) WHERE rn = 1
             ORDER BY confidence DESC, page_index, clause_index LIMIT 30)"""


def _batches_sql(source: str, budget: int) -> str:
    """Batch heads one after the other, each found in the running sums of its own."""
    return f"""WITH RECURSIVE {_HITS}, {source},
  o AS MATERIALIZED (SELECT uid, n, size, sum(size) OVER (ORDER BY n) AS total FROM (
    SELECT uid, row_number() OVER (ORDER BY confidence DESC, page_index, clause_index, uid) AS n, least(length(text), 401) + 80 AS size FROM best)),
  heads AS (SELECT 1::BIGINT AS n, 0 AS batch WHERE EXISTS (FROM o)
    UNION ALL SELECT * FROM (SELECT (SELECT min(o.n) FROM o WHERE o.total > h.total - h.size + {budget} AND o.n > h.n) AS n, h.batch + 1 AS batch
      FROM (SELECT o.*, heads.batch FROM heads JOIN o USING (n)) h) WHERE n IS NOT NULL)
  SELECT uid, batch FROM o ASOF JOIN heads ON o.n >= heads.n"""


_ALL_BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY confidence DESC, cat_pos) AS rn FROM hits) WHERE rn = 1)"
_CAT_ROWS = ", ".join(f"('{c}', '{lexicon.LABELS[c]}')" for c in lexicon.CATEGORIES)
_REF = f"""
  u AS (SELECT DISTINCT uid, page_index, clause_index, text, page_index + clause_index AS n FROM hits WHERE clause_index % 3 = 0),
  ref AS (SELECT uid, CASE WHEN n % 2 = 0 THEN 'rate_limit' ELSE '' END AS rcat, 'label {lexicon.REVIEW_MARK} here' AS rlabel, 'plain note' AS rnote,
            n % 4 <> 0 AS relevant, CASE WHEN n % 5 = 0 THEN left(text, 5) || ' ... ' || right(text, 4) ELSE 'not in there' END AS quote, 1 AS intercepted FROM u),
  norm AS (SELECT h.*, r.* EXCLUDE (uid), r.uid IS NOT NULL AS applied,
            lower(regexp_replace(regexp_replace(h.text, '\\s+', ' ', 'g'), '^ | $', '', 'g')) AS hay,
            list_filter(string_split(lower(regexp_replace(regexp_replace(r.quote, '\\s+', ' ', 'g'), '^ | $', '', 'g')), '...'), lambda s: trim(s) <> '') AS segs
          FROM hits h LEFT JOIN ref r USING (uid)),
  over1 AS (SELECT *, applied AND quote <> '' AND (len(segs) = 0 OR len(list_filter(segs, lambda s: NOT contains(hay, s))) > 0) AS quote_dropped FROM norm)"""

_ROBOT_RULES = [("*", "disallow", "/en/"), ("*", "allow", "/en/1"), ("SiftBot", "disallow", "/de/"), ("SiftBot", "disallow", "/en/9"),
                ("other", "disallow", "/de/"), ("other", "disallow", "/en/9")]
_PATH_ROWS = ", ".join(f"({i}, '{p}')" for i, p in enumerate(lexicon.LEGAL_PATHS))
_ROOT = f"({sql_part('url', 1)} || '://' || {sql_part('url', 2)})"


def _sql_redact(text: str) -> tuple[str, str]:
    count = "0"
    for p in lexicon.VERDICT_PATTERNS:
        q = p.replace("'", "''")
        count += f" + len(regexp_extract_all({text}, '{q}'))"
        text = f"regexp_replace({text}, '{q}', '{lexicon.REVIEW_MARK}', 'g')"
    return text, count


_SAID = "(text || ' ' || [" + quoted(VERDICTS) + f"][((conv_id + turn) % {len(VERDICTS)})::INT + 1])"


def _redaction_sql() -> str:
    """One step per pattern, so the text of a step is computed once."""
    steps = [f"s0 AS (SELECT conv_id, turn, {_SAID} AS t, 0 AS n FROM conversations)"]
    for i, p in enumerate(lexicon.VERDICT_PATTERNS):
        q = p.replace("'", "''")
        steps.append(f"s{i + 1} AS (SELECT conv_id, turn, regexp_replace(t, '{q}', '{lexicon.REVIEW_MARK}', 'g') AS t, n + len(regexp_extract_all(t, '{q}')) AS n FROM s{i})")
    last = len(lexicon.VERDICT_PATTERNS)
    return (f"WITH {', '.join(steps)} SELECT conv_id, turn, CASE WHEN n > 0 THEN regexp_replace(t, '(?:{lexicon.REVIEW_MARK}){{2,}}', '{lexicon.REVIEW_MARK}', 'g') ELSE t END AS clean, "
            f"n::BIGINT AS redacted FROM s{last}")


SQL = {
    "lexicon_scores": f"""WITH {_HITS} SELECT uid, category, matched_terms, confidence, context_note,
        CASE WHEN confidence >= 0.75 THEN '高' WHEN confidence >= 0.5 THEN '中' ELSE '低' END AS band FROM hits""",
    "category_stats": f"""WITH {_HITS}, c(category, label) AS (VALUES {_CAT_ROWS})
        SELECT c.category, c.label, count(h.uid) AS "count" FROM c LEFT JOIN hits h USING (category) GROUP BY ALL""",
    "top_candidates": f"WITH {_HITS}, {_BEST} SELECT uid, category, confidence FROM best",
    "candidate_batches": _batches_sql(_BEST, 1500),
    "hit_batches": _batches_sql(_ALL_BEST, 12_000),
    "top_findings": f"WITH {_HITS} SELECT uid, page_url, category, confidence FROM hits ORDER BY confidence DESC, page_url, clause_index, category LIMIT 200",
    "finding_titles": f"""WITH {_HITS} SELECT uid, category, CASE WHEN page_index % 3 = 0 THEN '' ELSE source || ' ' || lang END AS page_title
        FROM hits JOIN documents ON doc_id = page_index""",
    "clause_totals": """SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS chars, true AS bounded FROM documents WHERE regexp_matches(text, '\\S')""",
    "refinements": f"""WITH {_HITS}, {_REF},
        o AS (SELECT uid, category, CASE WHEN applied AND NOT relevant THEN round_even(confidence * 0.9, 3) ELSE confidence END AS confidence, applied AS llm_applied,
                CASE WHEN applied AND NOT relevant THEN '模型标注可能不相关（需人工确认）：' ELSE '' END || coalesce(rlabel, '') AS llm_label,
                coalesce(rnote, '') AS llm_note, quote_dropped, false AS added, rcat, rlabel, relevant FROM over1),
        known AS (SELECT uid, list(category) AS cats FROM hits GROUP BY 1)
        SELECT uid, category, confidence, llm_applied, llm_label, llm_note, quote_dropped, added FROM o
        UNION ALL SELECT DISTINCT uid, rcat, 0.4::DOUBLE, true, rlabel, llm_note, false, true FROM o JOIN known USING (uid)
          WHERE llm_applied AND relevant AND rcat <> '' AND NOT list_contains(cats, rcat)""",
    "refinement_guard": f"""WITH {_HITS}, {_REF} SELECT (SELECT count(DISTINCT uid) FROM ref) AS intercepted,
        (SELECT count(*) FROM over1 WHERE quote_dropped) AS dropped_quotes""",
    "verdict_redaction": _redaction_sql(),
    "robots_check": f"""
        WITH p AS (SELECT page_id, {sql_host('url')} AS site, {sql_part('url', 3)} AS path FROM pages),
             f AS (SELECT DISTINCT site FROM p WHERE page_id % 2 = 0)
        SELECT page_id, site NOT IN (FROM f) OR NOT (starts_with(path, '/de/') OR starts_with(path, '/en/9')) AS bot_ok,
               site NOT IN (FROM f) OR NOT (starts_with(path, '/en/') AND NOT starts_with(path, '/en/1')) AS robots_ok FROM p""",
    "robots_rules": f"""
        WITH r(agent, verb, path) AS (VALUES {", ".join("(" + quoted(r) + ")" for r in _ROBOT_RULES)})
        SELECT page_id::VARCHAR AS site, agent, verb, path FROM pages, r
        UNION ALL SELECT page_id::VARCHAR, 'none', 'disallow', {sql_part('url', 3)} FROM pages""",
    "legal_seeds": f"""
        WITH s AS (SELECT page_id, url AS start_url, {_ROOT} AS root, {sql_part('url', 2)} AS host FROM pages),
        paths(n, path) AS (VALUES {_PATH_ROWS}),
        c AS (SELECT start_url, root || '/privacy' AS url, 3 AS rank, '页脚链接' AS source FROM s
              UNION ALL SELECT start_url, root || '/Tos?x=' || page_id, 1, 'URL 特征' FROM s
              UNION ALL SELECT start_url, root || path, 1, '路径词典' FROM s, paths WHERE path <> '/privacy'),
        d AS (SELECT DISTINCT start_url, lower(url[:8]) || url[9:] AS url, rank, source FROM c),
        r AS (SELECT *, row_number() OVER (PARTITION BY start_url ORDER BY rank DESC, length(url), url) AS position FROM d)
        SELECT start_url, url, source, position, position <= 12 AS picked FROM r""",
    "failures": f"""
        WITH e AS (SELECT event_id, [0, 200, 401, 404, 429, 500, 503][event_id % 7 + 1] AS status, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS error FROM events)
        SELECT event_id, CASE status WHEN 401 THEN '{lexicon.STATUS_REASONS[401]}' WHEN 404 THEN '{lexicon.STATUS_REASONS[404]}' WHEN 429 THEN '{lexicon.STATUS_REASONS[429]}'
               ELSE CASE WHEN error <> '' THEN error WHEN status <> 0 THEN 'HTTP ' || status ELSE '抓取失败' END END AS reason,
               error <> '' AND (status = 0 OR status >= 500) AS retry, status = 0 OR status >= 500 OR status = 429 AS retry_annotating FROM e""",
}
