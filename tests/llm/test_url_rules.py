"""URL filters: listed rules and mined rules against plain versions."""

from itertools import combinations

from siftweb.llm.url_rules import OTHERWISE, RULES, judge, mine, tokens_of


def host_path(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    at = min([i for c in "/?#" if (i := rest.find(c)) >= 0] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at])
    tail = rest[at:]
    end = min([i for c in "?#" if (i := tail.find(c)) >= 0] or [len(tail)])
    return host, tail[:end]


def listed(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = ["http://a.org/x", "https://Sub.EXAMPLE.org/es/1", "http://example.org/en/12", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/de/9?q=1",
        "http://x.com/de", "http://org/", "http://borg/", "http://x.net/de/1", "x.org/en", None, "", "a://b://c.org/es/", "http://x.org?x=/es/", "http://é.org/#a",
        "http://" + "a." * 300 + "org/" + "p/" * 3000, "http://x.com/fr/\nline"]


def test_listed_rules(spark):
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(URLS)] + [(0, URLS[0], "v")], "page_id long, url string, verdict string")
    got = judge(pages, RULES, support=0.4).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path = host_path(r["url"])
        rule, verdict = listed(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")


def test_mined_rules_are_those_of_counting(spark):
    rows = [(["a", "b"], "block")] * 6 + [(["a", "c"], "allow")] * 6 + [(["b", "c"], "block")] * 5 + [(["b"], "allow")] + [(["d"], "block")] * 2
    got = {(tuple(r["antecedent"]), r["verdict"]): (round(r["confidence"], 6), round(r["support"], 6))
           for r in mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.2, 0.8).collect()}
    every = {}
    for size in (1, 2):
        for items in combinations("abcd", size):
            covered = [v for t, v in rows if set(items) <= set(t)]
            for verdict in ("allow", "block"):
                n = covered.count(verdict)
                if covered and n / len(rows) >= 0.2 and n / len(covered) >= 0.8:
                    every[items, verdict] = (round(n / len(covered), 6), round(n / len(rows), 6))
    want = {(i, v): f for (i, v), f in every.items() if not any((s, v) in every and every[s, v][0] >= f[0] for s in combinations(i, len(i) - 1) if s)}
    assert got == want and got


def test_the_best_mined_rule_judges_the_others(spark):
    urls = [f"http://h{i}.org/es/{i}" for i in range(20)] + [f"http://h{i}.example.org/es/{i}" for i in range(30)] + [f"http://g{i}.com/de/{i}" for i in range(20)]
    others = ["http://new.net/es/3", "http://new.net/de/3", "http://new.net/xx/", "nothing"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls + others)], "page_id long, url string")
    got = {r["url"]: r for r in judge(pages, RULES, 0.05, 0.9).collect()}
    rules = [(set(r["antecedent"]), r) for r in mine(spark.createDataFrame(
        [(r["t"], listed(*host_path(r["url"]))[1]) for r in pages.select("url", tokens_of(pages["url"]).alias("t")).collect() if listed(*host_path(r["url"]))[1]],
        "tokens array<string>, verdict string"), 0.05, 0.9).collect()]
    tokens = {r["url"]: set(r["t"]) for r in pages.select("url", tokens_of(pages["url"]).alias("t")).collect()}
    for url in others:
        fits = [r for a, r in rules if a <= tokens[url]]
        best = max(fits, key=lambda r: (r["confidence"], r["support"], len(r["antecedent"]), r["verdict"], r["antecedent"]), default=None)
        assert got[url]["verdict"] == (best["verdict"] if best else OTHERWISE)
        assert got[url]["antecedent"] == (best["antecedent"] if best else None)
    assert got["http://new.net/de/3"]["verdict"] == "block"


def test_empty(spark):
    assert judge(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
