"""URL risk queries. Addresses come from the page table; hosts and parameters vary by page number."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftweb.catalog.inputs import load, quoted, sql_host, sql_part
from siftweb.functions import fixed, urls
from siftweb.operators import risk

# host and tail by page_id % 16; the rest of the address is the page's own
HOSTS = ["", "ad.doubleclick.net", "paypa1.com", "login-secure-pay-x.example.tk", "bit.ly", "10.0.0.7:8081", "192.168.1.9",
         "www.g00gle.co", "arnazon.net", "netflix.com", "facebook-support.info", "qwrtpsdfghjkl.com", "paypal.co.uk",
         "shop.alipay.com", "Amazom.org", "micros0ft.ga"]
TAILS = ["", "ads/verify", "account?fbclid=1&from=a", "banner/x?ref=2&click=1"]


def crafted(spark, folder):
    p = load(spark, folder, "pages")
    host = urls.url_domain(F.col("url"))
    for i, name in enumerate(HOSTS):
        if name:
            host = F.when(F.col("page_id") % len(HOSTS) == i, name).otherwise(host)
    tail = F.lit("")
    for i, text in enumerate(TAILS):
        if text:
            tail = F.when(F.floor(F.col("page_id") / len(HOSTS)) % len(TAILS) == i, text).otherwise(tail)
    path = F.when(tail == "", F.regexp_extract("url", "^https?://[^/]*(/.*)$", 1)).otherwise(F.concat(F.lit("/"), tail))
    return p.select(F.col("page_id").alias("pos"), F.concat(F.lit(" http://"), host, path).alias("url"))


def _analyzed(spark, folder):
    return risk.analyze_urls(risk.distinct_urls(crafted(spark, folder)))


def risk_findings(spark, folder):
    return risk.finding_rows(_analyzed(spark, folder)).select("url", "kind", "rule", "title", "detail", "severity", "regex", "auto_select")


def risk_levels(spark, folder):
    return risk.risk_levels(_analyzed(spark, folder)).select("url", "risk_level", "is_ad", "is_phishing", "n_findings")


def risk_summary(spark, folder):
    return risk.risk_summary(_analyzed(spark, folder))


def regex_suggest(spark, folder):
    return risk.regex_suggestions(risk.finding_rows(_analyzed(spark, folder)))


def brand_imitation(spark, folder):
    c = crafted(spark, folder).select("pos", urls.host_of(urls.trimmed(F.col("url"))).alias("host"))
    found = c.withColumn("b", risk.brand_imitation(F.col("host")))
    return found.filter(F.col("b").isNotNull()).select("pos", "host", F.col("b.brand").alias("brand"), F.col("b.label").alias("label"),
                                                       risk.normalize_confusable(F.col("b.label")).alias("folded"))


def suffix_join(spark, folder):
    hosts = load(spark, folder, "pages").select("page_id", urls.host_of(F.col("url")).alias("host"))
    domains = hosts.select(urls.registered_domain(F.col("host")).alias("domain")).unionByName(hosts.select(F.col("host").alias("domain")))
    return risk.host_in_domains(hosts, domains).select("page_id", "host", "matched_domain")


def distinct_urls(spark, folder):
    links = load(spark, folder, "events").select(
        F.concat(F.lit(" http://h"), (F.col("user_id") % 90).cast("string"), F.when(F.col("event_id") % 3 == 0, " ").otherwise(".example.com")).alias("url"),
        F.col("event_id").alias("pos"))
    return risk.distinct_urls(links)


QUERIES = {"risk_findings": risk_findings, "risk_levels": risk_levels, "risk_summary": risk_summary, "regex_suggest": regex_suggest,
           "brand_imitation": brand_imitation, "suffix_join": suffix_join, "distinct_urls": distinct_urls}

_HOST_CASE = "CASE page_id % 16 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HOSTS) if h) + f" ELSE {sql_part('url', 2)} END"
_TAIL_CASE = "CASE page_id // 16 % 4 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TAILS) if t) + " ELSE '' END"


def _values(pairs) -> str:
    return ", ".join("(" + quoted(p) + ")" for p in pairs)


def _domain_hit(domains) -> str:
    return ("coalesce(CASE " + " ".join(f"WHEN host = '{d}' OR host LIKE '%.{d}' THEN '{d}'" for d in domains) + " END, '')")


_BRAND_ROWS = ", ".join(f"({i}, '{b}', '{risk.brand_variant_regex(b)}')" for i, b in enumerate(b for b in fixed.OFFICIAL_SITES if len(b) >= 4))
_OFFICIAL = [d for s in fixed.OFFICIAL_SITES.values() for d in s]
_FOLD = f"replace(replace(translate(lower(label), '{fixed.HOMOGLYPHS_FROM}', '{fixed.HOMOGLYPHS_TO}'), 'rn', 'm'), 'vv', 'w')"
_BASE = f"""
  src AS (SELECT page_id AS pos, trim(' http://' || {_HOST_CASE} || CASE WHEN {_TAIL_CASE} = '' THEN
            regexp_extract(url, '^https?://[^/]*(/.*)$', 1) ELSE '/' || {_TAIL_CASE} END) AS url FROM pages),
  u AS (SELECT url, min(pos) AS pos FROM src GROUP BY 1),
  a AS (SELECT *, {sql_host('url')} AS host, regexp_extract({sql_part('url', 2)}, ':([0-9]+)$', 1) AS port,
          {sql_part('url', 3)} || CASE WHEN {sql_part('url', 4)} <> '' THEN '?' || {sql_part('url', 4)} ELSE '' END AS pq,
          list_sort(list_distinct(list_transform(list_filter(string_split({sql_part('url', 4)}, '&'), lambda p: p <> ''),
             lambda p: lower(split_part(p, '=', 1))))) AS names FROM u),
  b AS (SELECT *, string_split(host, '.') AS labels, regexp_matches(host, '^\\d+\\.\\d+\\.\\d+\\.\\d+$') AS is_ip,
          {_domain_hit(fixed.AD_DOMAINS)} AS ad_domain, {_domain_hit(fixed.SHORTENER_DOMAINS)} AS short,
          {_domain_hit(_OFFICIAL)} AS official, regexp_extract(pq, '{fixed.AD_PATH}', 0) AS ad_path,
          list_filter(names, lambda n: n IN ({quoted(fixed.STRONG_AD_PARAMS)}) OR starts_with(n, 'utm_')) AS strong,
          list_filter(names, lambda n: n IN ({quoted(fixed.WEAK_AD_PARAMS)})) AS weak FROM a),
  lab AS (SELECT url, labels, unnest(labels[:-2]) AS label, generate_subscripts(labels[:-2], 1) AS li FROM b WHERE NOT is_ip AND official = ''),
  brands(bi, brand, regex) AS (VALUES {_BRAND_ROWS}),
  cmp AS (SELECT *, {_FOLD} AS folded, array_to_string(labels[li + 1:], '.') AS tail FROM lab, brands WHERE label <> 'www'),
  hit AS (SELECT *, CASE WHEN label = brand OR folded = brand THEN CASE WHEN folded <> label THEN '同形字符仿冒' ELSE '品牌名被仿冒使用' END
            WHEN levenshtein(folded, brand) = 1 AND length(label) >= 5 THEN '近似拼写仿冒'
            WHEN length(label) - length(brand) >= 3 AND contains(label, brand) THEN '品牌名 + 诱饵词' ELSE '' END AS how FROM cmp),
  br AS (SELECT url, arg_min(struct_pack(brand, label, how, folded, regex), li * 100 + bi) AS b FROM hit
         WHERE how <> '' AND NOT (label = brand AND tail IN ({quoted(fixed.OFFICIAL_TLD_SUFFIXES)})) GROUP BY 1),
  c AS (SELECT b.*, br.b.brand AS brand, br.b.label AS blabel, br.b.how AS how, br.b.regex AS bregex, labels[-1] AS tld,
          list_filter(labels[:-2], lambda x: regexp_matches(x, '-.*-')) AS hyphens,
          list_filter(labels[:-2], lambda x: length(x) >= 12 AND (length(regexp_replace(x, '[^aeiou]', '', 'g')) / length(x) < 0.2
             OR regexp_matches(x, '[bcdfghjklmnpqrstvwxyz]{{5,}}'))) AS randoms,
          list_filter([{quoted(sorted(fixed.SENSITIVE_KEYWORDS))}], lambda w: contains(lower(host || pq), w)) AS words
        FROM b LEFT JOIN br USING (url)),
  d AS (SELECT *, is_ip OR short <> '' OR tld IN ({quoted(fixed.SUSPICIOUS_TLDS)}) OR len(hyphens) > 0 OR len(randoms) > 0 OR brand IS NOT NULL AS susp FROM c),
  f AS (
    SELECT url, pos, 1 AS n, 'ad' AS kind, 'ad_domain' AS rule, '广告联盟域名' AS title, '域名 ' || host || ' 属于已知广告/追踪网络（' || ad_domain || '）' AS detail,
           'high' AS severity, '{fixed.REGEX_AD_DOMAIN}' AS regex, true AS auto_select FROM d WHERE ad_domain <> ''
    UNION ALL SELECT url, pos, 2, 'ad', 'ad_param', '广告追踪参数', '命中高置信追踪参数：' || array_to_string(strong, '、'), 'high', '{fixed.REGEX_AD_PARAM}', true FROM d WHERE len(strong) > 0
    UNION ALL SELECT url, pos, 2, 'ad', 'ad_param_weak', '通用广告参数', '命中通用广告参数：' || array_to_string(weak, '、'), 'medium', '', true
      FROM d WHERE len(strong) = 0 AND len(weak) > 0 AND (ad_domain <> '' OR ad_path <> '')
    UNION ALL SELECT url, pos, 2, 'ad', 'ad_param_weak', '通用广告参数（弱特征）', '命中通用参数：' || array_to_string(weak, '、') || '（可能是普通业务参数）', 'low', '', true
      FROM d WHERE len(strong) = 0 AND len(weak) > 0 AND ad_domain = '' AND ad_path = ''
    UNION ALL SELECT url, pos, 3, 'ad', 'ad_path', '广告路径', '路径命中广告目录模式：' || ad_path, 'medium', '{fixed.AD_PATH}', true FROM d WHERE ad_path <> ''
    UNION ALL SELECT url, pos, 4, 'phishing', 'ip_port', 'IP 直连 + 非常规端口', '直接使用 IP 地址 ' || host || ':' || port || ' 访问，绕过域名与证书验证', 'high', '{fixed.REGEX_IP_PORT}', true
      FROM d WHERE is_ip AND port NOT IN ('', '80', '443')
    UNION ALL SELECT url, pos, 4, 'phishing', 'ip_host', 'IP 直连访问', '直接使用 IP 地址 ' || host || ' 访问，无法通过域名验证站点归属', 'low', '{fixed.REGEX_IP_HOST}', true
      FROM d WHERE is_ip AND port IN ('', '80', '443')
    UNION ALL SELECT url, pos, 5, 'phishing', 'brand_imitation', '仿冒 ' || brand || ' 域名', how || '：域名标签 “' || blabel || '” 与品牌 “' || brand ||
      '” 高度相似，注册域 ' || labels[-2] || '.' || labels[-1] || ' 非官方域名', 'high', bregex, false FROM d WHERE brand IS NOT NULL
    UNION ALL SELECT url, pos, 6, 'phishing', 'shortener', '短链接跳转', host || ' 为短链接服务，真实目标地址不可见（' || short || '）', 'medium', '{fixed.REGEX_SHORTENER}', true FROM d WHERE short <> ''
    UNION ALL SELECT url, pos, 7, 'phishing', 'bad_tld', '高风险 TLD', '域名使用高滥用免费顶级域 .' || tld || '，钓鱼站点高发', 'medium', '{fixed.REGEX_BAD_TLD}', true
      FROM d WHERE tld IN ({quoted(fixed.SUSPICIOUS_TLDS)})
    UNION ALL SELECT url, pos, 8, 'phishing', 'hyphen_domain', '域名含大量连字符', '域名标签 ' || array_to_string(hyphens, '、') || ' 含多个连字符，是仿冒域名常见写法', 'low', '', true FROM d WHERE len(hyphens) > 0
    UNION ALL SELECT url, pos, 9, 'phishing', 'random_domain', '域名含随机字符串', '域名标签 ' || array_to_string(randoms, '、') || ' 形似随机生成（元音稀少/长串辅音）', 'low', '', true FROM d WHERE len(randoms) > 0
    UNION ALL SELECT url, pos, 10, 'phishing', 'suspicious_keyword', '敏感词 + 可疑域名', 'URL 含账户/安全类敏感词：' || array_to_string(words, '、') || '，且域名存在可疑特征', 'high', '', true
      FROM d WHERE susp AND len(words) > 0),
  sev AS (SELECT *, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS sr FROM f),
  lv AS (SELECT u.url, coalesce(CASE min(sr) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END, '') AS risk_level,
           coalesce(bool_or(kind = 'ad'), false) AS is_ad, coalesce(bool_or(kind = 'phishing'), false) AS is_phishing, count(rule) AS n_findings
         FROM u LEFT JOIN sev USING (url) GROUP BY 1)"""

_HINT = "CASE rule " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in risk.HINTS.items() if "_weak_" not in k) + " END"
SQL = {
    "risk_findings": f"WITH {_BASE} SELECT url, kind, rule, title, detail, severity, regex, auto_select FROM f",
    "risk_levels": f"WITH {_BASE} SELECT url, risk_level, is_ad, is_phishing, n_findings FROM lv",
    "risk_summary": f"""WITH {_BASE} SELECT count(*) AS url_count, count(*) FILTER (is_ad) AS ad_count, count(*) FILTER (is_phishing) AS phishing_count,
        count(*) FILTER (risk_level = 'high') AS high_count, (SELECT count(DISTINCT regex) FROM f WHERE regex <> '') AS regex_count FROM lv""",
    "regex_suggest": f"""WITH {_BASE}, o AS (SELECT *, {_HINT} AS hint, pos * 100 + sr * 20 + n AS ord FROM sev WHERE regex <> '')
        SELECT regex, arg_min(title, ord) AS title, arg_min(kind, ord) AS kind, arg_min(severity, ord) AS severity, arg_min(auto_select, ord) AS auto_select,
               arg_min(hint, ord) AS hint, arg_min(url, ord) AS sample_url, count(*) AS "count" FROM o GROUP BY 1""",
    "brand_imitation": f"""WITH {_BASE}, s AS (SELECT src.pos, a.host, br.b FROM src JOIN a USING (url) JOIN br USING (url))
        SELECT pos, host, b.brand AS brand, b.label AS label, b.folded AS folded FROM s""",
    "suffix_join": f"""
        WITH h AS (SELECT page_id, {sql_host('url')} AS host FROM pages),
             dm AS (SELECT DISTINCT domain FROM (SELECT split_part(host, '.', -2) || '.' || split_part(host, '.', -1) AS domain FROM h
                    UNION ALL SELECT host FROM h))
        SELECT page_id, host, domain AS matched_domain FROM h JOIN dm ON host = domain OR ends_with(host, '.' || domain)""",
    "distinct_urls": """
        SELECT trim(' http://h' || user_id % 90 || CASE WHEN event_id % 3 = 0 THEN ' ' ELSE '.example.com' END) AS url, min(event_id) AS pos FROM events GROUP BY 1""",
}
