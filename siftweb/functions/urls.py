"""URL functions, all native column expressions.

Splitting follows RFC 3986 appendix B with one regular expression; the Java URI parser is avoided
because it rejects blanks and other characters that real links contain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftweb.functions import fixed

SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"

# --- fixed values: wording of address problems, hints in paths, endings that are not markup
PROBLEM_EMPTY = "请输入起始网址"
PROBLEM_SCHEME = "网址必须以http://或https://开头"
PROBLEM_HOST = "网址无效，请输入包含有效域名的完整网址，例如：https://www.example.com"
LEGAL_URL_HINTS = [
    "term", "privacy", "legal", "policy", "policies", "agreement",
    "disclaimer", "copyright", "cookie", "eula", "tos", "dpa",
    "条款", "协议", "隐私", "声明", "政策", "规范", "须知", "免责",
]
NON_HTML_EXTS = [
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip",
    ".rar", ".7z", ".tar", ".gz", ".png", ".jpg", ".jpeg", ".gif", ".svg",
    ".webp", ".mp4", ".mp3", ".css", ".js", ".json", ".xml", ".csv",
]


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


#: every kind of white space, and the control characters that separate records
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """Strip every kind of white space at both ends (plain ``trim`` removes blanks only); an expression would try every character between them too."""
    return F.trim(text, F.lit(BLANKS))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, inside lambdas too, where nothing is shared."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, SPLIT, group)


def scheme_of(url: Column) -> Column:
    return F.lower(part(url, 1))


def url_domain(url: Column) -> Column:
    """Authority as written: port and case kept."""
    return part(url, 2)


def path_of(url: Column) -> Column:
    return part(url, 3)


def query_of(url: Column) -> Column:
    return part(url, 4)


def host_of(url: Column) -> Column:
    """Lower-case host without user info, brackets and port."""
    place = F.substring_index(url_domain(url), "@", -1)
    return F.lower(F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)", 1))
                   .otherwise(F.substring_index(place, ":", 1)))


def port_of(url: Column) -> Column:
    """Explicit port as int, NULL when absent or not a number up to 65535."""
    digits = F.regexp_extract(url_domain(url), r":(\d{1,5})$", 1)
    number = F.when(digits != "", digits.cast("int"))
    return F.when(number <= 65535, number)


def is_http_url(url: Column) -> Column:
    return F.coalesce(url.rlike("^https?://[^/?#]"), F.lit(False))


def url_problem(url: Column) -> Column:
    """First thing wrong with an address, empty when it is usable."""
    text = trimmed(F.coalesce(url, F.lit("")))
    return (F.when(text == "", PROBLEM_EMPTY)
            .when(~scheme_of(text).isin("http", "https"), PROBLEM_SCHEME)
            .when(url_domain(text) == "", PROBLEM_HOST)
            .otherwise(""))


def normalize_domain(text: Column) -> Column:
    """Bare lower-case domain out of a typed entry; leading dots go."""
    plain = F.lower(trimmed(F.coalesce(text, F.lit(""))))
    inside = F.when(plain.contains("://"), F.coalesce(F.nullif(url_domain(plain), F.lit("")), plain)).otherwise(plain)
    return F.regexp_replace(F.substring_index(F.substring_index(inside, "/", 1), ":", 1), r"^\.+", "")


def normalize_cookie_domain(text: Column) -> Column:
    """Like ``normalize_domain`` but user info and all edge dots go."""
    plain = trimmed(F.coalesce(text, F.lit("")))
    place = F.when(plain.contains("//"), F.coalesce(F.nullif(url_domain(plain), F.lit("")), plain)) \
        .otherwise(F.substring_index(plain, "/", 1))
    bare = F.substring_index(F.substring_index(place, "@", -1), ":", 1)
    return F.lower(F.regexp_replace(trimmed(bare), r"^\.+|\.+$", ""))


# ---- query strings ---------------------------------------------------------

def form_decode(text: Column) -> Column:
    """Percent and plus decoding; a lone ``%`` stays as it is."""
    return F.url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def percent_decode(text: Column) -> Column:
    """Percent decoding only: a plus sign is kept."""
    return form_decode(F.regexp_replace(text, r"\+", "%2B"))


def form_encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(query: Column) -> Column:
    """Decoded (k, v) structs in order; pairs without ``=`` get an empty value."""
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        form_decode(F.substring_index(p, "=", 1)).alias("k"),
        F.when(p.contains("="), form_decode(F.regexp_replace(p, r"(?s)^[^=]*=", "")))
        .otherwise("").alias("v")))


def encode_pairs(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(form_encode(p["k"]), F.lit("="), form_encode(p["v"]))), "&")


def is_tracking(name: Column) -> Column:
    low = F.lower(name)
    return low.isin(fixed.STRONG_AD_PARAMS) | low.startswith("utm_")


def _with_query(head: Column, query: Column) -> Column:
    return F.when(query != "", F.concat(head, F.lit("?"), query)).otherwise(head)


def canonical_url(url: Column) -> Column:
    """Address used for media identity: tracking parameters, fragment and default port dropped."""
    def rebuild(raw: Column, p: Column) -> Column:
        place = F.substring_index(p["netloc"], "@", -1)
        host = F.lower(F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)", 1)).otherwise(F.substring_index(place, ":", 1)))
        user_info = F.when(p["netloc"].contains("@"), F.regexp_replace(p["netloc"], r"@[^@]*$", "")).otherwise("")
        port = F.when(place.contains(":"), F.regexp_extract(place, r":(\d{1,5})$", 1)).otherwise("")

        def assemble(s: Column) -> Column:
            user = F.substring_index(s["info"], ":", 1)
            secret = F.when(s["info"].contains(":"), F.regexp_replace(s["info"], r"^[^:]*:", "")).otherwise("")
            auth = F.when(user == "", "").when(secret == "", F.concat(user, F.lit("@"))).otherwise(F.concat(user, F.lit(":"), secret, F.lit("@")))
            number = F.when(s["port"] != "", s["port"].cast("int"))
            usual = number.isNull() | (number == 0) | ((p["scheme"] == "http") & (number == 80)) | ((p["scheme"] == "https") & (number == 443))
            port_text = F.when(usual, "").otherwise(F.concat(F.lit(":"), number.cast("string")))
            odd = place.contains(":") & ((~place.contains("[") & place.rlike(r":[^\]]*[^\d\]]|:\d{6,}$")) | (number > 65535))
            kept = F.array_sort(F.filter(query_pairs(p["query"]), lambda q: ~is_tracking(q["k"])))
            query = F.when(p["query"] == "", "").otherwise(bind(encode_pairs(kept), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))
            head = F.concat(F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit("://"))).otherwise("//"), auth, s["host"], port_text, p["path"])
            return F.when((s["host"] == "") | odd, raw).otherwise(F.concat(head, query))

        return bind(F.struct(host.alias("host"), user_info.alias("info"), port.alias("port")), assemble)

    return bind(trimmed(F.coalesce(url, F.lit(""))), lambda raw: bind(_parts(raw), lambda p: rebuild(raw, p)))


def url_hash_raw(url: Column) -> Column:
    """Identity used by crawl bookkeeping."""
    return F.sha2(url.cast("binary"), 256)


def url_key(url: Column) -> Column:
    """Identity used by the media inventory."""
    return F.sha2(canonical_url(url).cast("binary"), 256)


# --- addresses that are their own key: lower case up to the path, no parameters, fragment or trailing slash, nothing to strip
_OWN_KEY = r"^[a-z][a-z0-9+.\-]*://[a-z0-9.:\-]+/(?:[!-~&&[^#;?]]*[!-~&&[^#/;?]])?(?:\?[!-~&&[^#]]+)?\z"


def legal_url_key(url: Column) -> Column:
    """Identity used for policy pages: keeps the query, drops fragment and trailing slashes. Most addresses are their own, which one expression tells."""
    def key(p: Column) -> Column:
        path = F.when(p["path"] == "", "/").otherwise(p["path"])
        path = F.when(F.contains(path, F.lit(";")), F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)
        path = bind(path, lambda x: F.when((F.length(x) > 1) & x.endswith("/"), F.regexp_replace(x, r"/+$", "")).otherwise(x))
        head = F.concat(F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit(":"))).otherwise(""),
                        F.when(p["netloc"] != "", F.concat(F.lit("//"), F.lower(p["netloc"]))).otherwise(""), path)
        return _with_query(head, p["query"])

    return F.when(url.rlike(_OWN_KEY), url).otherwise(
        bind(trimmed(F.coalesce(url, F.lit(""))), lambda raw: F.when(raw == "", "").otherwise(bind(_parts(raw), key))))


# ---- reference resolution --------------------------------------------------

def _remove_dots(segments: Column) -> Column:
    walked = F.aggregate(segments, F.array().cast("array<string>"), lambda acc, s: (
        F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .when(s == ".", acc).otherwise(F.array_append(acc, s))))
    last = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return bind(F.array_join(F.concat(walked, last), "/"), lambda j: F.when(j == "", "/").otherwise(j))


def _merged_path(base_path: Column, path: Column) -> Column:
    """Reference path put on the folder of the base path, double slashes of the joint squeezed."""
    folder = F.split(F.regexp_replace(base_path, r"/?[^/]*$", ""), "/")

    def squeeze(parts: Column) -> Column:
        size = F.size(parts)
        inner = F.filter(F.slice(parts, 2, F.greatest(size - 2, F.lit(0))), lambda s: s != "")
        return F.when(size > 1, F.concat(F.slice(parts, 1, 1), inner, F.slice(parts, size, 1))).otherwise(parts)

    merged = F.concat(F.when(base_path.contains("/"), folder).otherwise(F.array().cast("array<string>")), F.split(path, "/"))
    return bind(bind(merged, squeeze), _remove_dots)


def _parts(url: Column) -> Column:
    return F.struct(scheme_of(url).alias("scheme"), part(url, 2).alias("netloc"), part(url, 3).alias("path"),
                    part(url, 4).alias("query"), part(url, 5).alias("fragment"))


# --- references that need no taking apart: an address of its own, a rooted path, a name beside the base; none with dot segments, empty queries or fragments
_REST = r"(?:\?[^#]+)?(?:#.+)?\z"
_ABSOLUTE = r"^https?://[^/?#]+[^?#]*" + _REST
_ROOTED = r"^(?![^?#]*/\.\.?(?:[/?#]|\z))/(?!/)[^?#]*" + _REST
_BESIDE = r"^[^/?#:.][^/?#:]*(?:/[^/?#:.][^/?#:]*)*+/?" + _REST
_ROOT = r"^[a-z][a-z0-9+.\-]*://[^/?#]*"
_FOLDER = _ROOT + r"/(?:[^/?#.][^/?#]*/)*+(?=[^/?#]*(?:[?#]|\z))"


def root_of(url: Column) -> Column:
    """Scheme and authority of an address, to which a rooted reference without dot segments is joined as it is; NULL where ``join_url`` must split."""
    return F.regexp_substr(url, F.lit(_ROOT))


def join_url(base: Column, ref: Column) -> Column:
    """RFC 3986 reference resolution for http(s) bases, dot segments included.

    Most references are put behind a part of the base as they are, which takes two expressions; only the others are split and merged.
    """
    def joined(ref: Column, r: Column, b: Column) -> Column:
        tail = F.when(r["fragment"] != "", F.concat(F.lit("#"), r["fragment"])).otherwise("")
        path = (F.when(r["path"] == "", b["path"])
                .when(~r["path"].startswith("/"), F.regexp_replace(_merged_path(b["path"], r["path"]), "^(?!/)", "/"))
                .when(r["path"].rlike(r"/\.\.?(/|$)"), F.regexp_replace(_remove_dots(F.split(r["path"], "/")), "^(?!/)", "/"))
                .otherwise(r["path"]))
        query = F.when((r["path"] == "") & (r["query"] == ""), b["query"]).otherwise(r["query"])
        elsewhere = r["netloc"] != ""
        head = F.concat(b["scheme"], F.lit("://"), F.when(elsewhere, r["netloc"]).otherwise(b["netloc"]),
                        F.when(elsewhere, r["path"]).otherwise(path))
        asked = F.when(elsewhere, r["query"]).otherwise(query)
        return (F.when((r["scheme"] != "") & (r["scheme"] != b["scheme"]), ref)
                .otherwise(F.concat(head, bind(asked, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")), tail)))

    def resolved(x: Column) -> Column:
        here, t = x["base"], x["ref"]
        behind = lambda kind, lead: F.when(t.rlike(kind), F.concat(F.regexp_substr(here, F.lit(lead)), t))
        return F.when(t == "", here).otherwise(F.coalesce(
            F.when(here.isNotNull() & t.rlike(_ABSOLUTE), t), behind(_ROOTED, _ROOT), behind(_BESIDE, _FOLDER),
            bind(_parts(t), lambda r: bind(_parts(here), lambda b: joined(t, r, b)))))

    return bind(F.struct(base.alias("base"), ref.alias("ref")), resolved)


_PSEUDO = "(?i)^(?:%s)" % "|".join(p for p in fixed.SKIPPED_PREFIXES)


def resolve_url(base: Column, href: Column, keep_fragment: bool = True) -> Column:
    """Absolute http(s) address of a link, '' for pseudo links and other schemes."""
    def absolute(ref: Column) -> Column:
        full = join_url(base, ref)
        full = full if keep_fragment else F.substring_index(full, "#", 1)
        return F.when((ref == "") | ref.rlike(_PSEUDO), "").otherwise(
            bind(full, lambda u: F.when(u.rlike("^https?://"), u).otherwise("")))

    return bind(trimmed(F.coalesce(href, F.lit(""))), absolute)


# ---- hosts -----------------------------------------------------------------

def _without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def same_host(a: Column, b: Column) -> Column:
    left, right = _without_www(host_of(a)), _without_www(host_of(b))
    return (left != "") & (left == right)


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts, or one is a subdomain of the other (``www.`` ignored)."""
    left, right = _without_www(host_of(a)), _without_www(host_of(b))
    dot = F.lit(".")
    return (left != "") & (right != "") & (
        (left == right) | F.endswith(left, F.concat(dot, right)) | F.endswith(right, F.concat(dot, left)))


def host_labels(host: Column) -> Column:
    return F.filter(F.split(host, r"\."), lambda x: x != "")


def registered_domain(host: Column) -> Column:
    labels = host_labels(host)
    return F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(host)


def domain_family(host: Column) -> Column:
    """The host and each parent with at least two labels."""
    labels = host_labels(host)
    n = F.size(labels)
    return F.when(n < 2, F.filter(F.array(host), lambda x: x != "")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                    lambda i: F.array_join(F.slice(labels, i, n), ".")))


def in_domains(host: Column, domains) -> Column:
    """Host equals one of the listed domains or lies under it: one set test per parent."""
    return F.exists(domain_family(host), lambda d: d.isin(list(domains)))


# ---- paths, names, formats -------------------------------------------------

def ext_of(url: Column) -> Column:
    """Lower-case extension of the path, '' when the last segment has none."""
    last = F.substring_index(path_of(url), "/", -1)
    return F.lower(F.regexp_extract(last, r"^\.*[^.].*(\.[^.]*)$|^\.*[^.](\.[^.]*)$", 1))


def looks_like_legal_url(url: Column) -> Column:
    path = F.lower(path_of(url))
    hits = F.filter(_lits(LEGAL_URL_HINTS), lambda h: F.contains(path, h))
    return F.when((path == "") | (path == "/"), "").otherwise(F.coalesce(F.get(hits, F.lit(0)), F.lit("")))


def is_non_html(url: Column) -> Column:
    return F.lower(path_of(url)).rlike(r"\.(?:%s)\z" % "|".join(e[1:] for e in NON_HTML_EXTS))


def upgrade_thumbnail(url: Column) -> Column:
    """Address of the original behind a thumbnail, '' when no rule changes anything."""
    def by_query(raw: Column, pairs: Column) -> Column:
        kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(fixed.THUMB_QUERY_KEYS))
        base = F.regexp_replace(raw, r"[?#].*$", "")
        anchor = F.regexp_extract(raw, r"(#.+)$", 1)
        return bind(kept, lambda k: F.when(F.size(k) < F.size(pairs), F.concat(
            base, F.when(F.size(k) > 0, F.concat(F.lit("?"), encode_pairs(k))).otherwise(""), anchor)).otherwise(""))

    def upgraded(raw: Column) -> Column:
        low = F.lower(raw)
        out = F.when(raw == "", "")
        for small, large in fixed.THUMB_RULES:
            swapped = F.replace(F.replace(raw, F.lit(small), F.lit(large)), F.lit(small.upper()), F.lit(large))
            out = out.when(low.contains(small), swapped)
        return (out.when(raw.contains("?") & (ext_of(raw) != ""), bind(query_pairs(query_of(raw)), lambda p: by_query(raw, p)))
                .otherwise(""))

    return bind(trimmed(F.coalesce(url, F.lit(""))),
                lambda raw: bind(upgraded(raw), lambda u: F.when(u == raw, "").otherwise(u)))


def safe_name(name: Column, fallback: str = "", cap: int = 80) -> Column:
    clean = F.regexp_replace(F.coalesce(name, F.lit("")), r'[\\/:*?"<>|\x00-\x1f]+', "_")
    clean = F.regexp_replace(clean, r"^[ ._]+|[ ._]+$", "")
    clean = trimmed(F.left(F.regexp_replace(clean, r"(?U)\s+", " "), F.lit(cap)))
    return F.when(clean == "", fallback).otherwise(clean)


def sanitize_name(name: Column, fallback: str = "task", cap: int = 80) -> Column:
    clean = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)[^\w\-.]+", "_")
    clean = F.left(F.regexp_replace(clean, "^_+|_+$", ""), F.lit(cap))
    return F.when(clean == "", fallback).otherwise(clean)


def sanitize_filename(name: Column, fallback: str = "session", cap: int = 120) -> Column:
    clean = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)[^\w.\-]+", "_")
    clean = F.left(F.regexp_replace(clean, "^[._]+|[._]+$", ""), F.lit(cap))
    return F.when(clean == "", fallback).otherwise(clean)


def url_basename(url: Column) -> Column:
    return F.substring_index(path_of(url), "/", -1)


def media_filename(album: Column, title: Column, index: Column, kind: Column, ext: Column, url: Column,
                   template: str = "{album}/{index:03d}_{title}{ext}") -> Column:
    """Relative save path; ``template`` is split at build time into literals and columns."""
    import re

    fields = {"album": safe_name(album), "title": safe_name(title), "kind": kind, "ext": ext, "url": url}
    pieces = []
    for literal, name, width in re.findall(r"([^{}]+)|\{(\w+)(?::0?(\d+)d)?\}", template):
        if literal:
            pieces.append(F.lit(literal))
        elif name == "index":
            text = index.cast("string")
            pieces.append(F.when(F.length(text) >= int(width), text).otherwise(F.lpad(text, int(width), "0"))
                          if width else text)
        else:
            pieces.append(fields[name])
    rendered = F.array_join(F.filter(F.transform(F.split(F.concat(*pieces), "/"), lambda s: safe_name(s)), lambda s: s != ""), "/")
    name = safe_name(url_basename(url), "media")
    named = F.when(name.contains("."), name).otherwise(F.concat(name, ext))
    return F.when(rendered.isin("", ".", ".."), safe_name(named, "media")).otherwise(rendered)


def _named(name: str):
    return lambda p: F.lower(p["k"]) == name


def query_param(url: Column, names=tuple(fixed.PAGE_PARAMS)) -> Column:
    """Struct(name, value) of the first numeric page parameter, in the order of ``names``."""
    numeric = F.filter(query_pairs(query_of(url)), lambda p: p["v"].rlike(r"^\d{1,18}$"))

    def first(pairs: Column) -> Column:
        hit = F.coalesce(*[F.get(F.filter(pairs, _named(name)), F.lit(0)) for name in names])
        return bind(hit, lambda p: F.struct(p["k"].alias("name"), p["v"].cast("long").alias("value")))

    return bind(numeric, first)


def with_param(url: Column, name: Column, value: Column) -> Column:
    """Set a parameter in place, or append it; the fragment goes."""
    text = value.cast("string")

    def changed(pairs: Column) -> Column:
        swapped = F.transform(pairs, lambda p: F.struct(
            p["k"].alias("k"), F.when(F.lower(p["k"]) == F.lower(name), text).otherwise(p["v"]).alias("v")))
        added = F.when(F.exists(pairs, lambda p: F.lower(p["k"]) == F.lower(name)), swapped).otherwise(
            F.array_append(swapped, F.struct(name.alias("k"), text.alias("v"))))
        return F.concat(F.regexp_replace(url, r"[?#].*$", ""), F.lit("?"), encode_pairs(added))

    return bind(query_pairs(query_of(url)), changed)


LAST_NUMBER = r"^(.*?)(\d+)([^\d]*)$"


def split_trailing_number(path: Column) -> Column:
    """Struct(prefix, number, suffix) around the last number, NULL fields when there is none."""
    hit = path.rlike(LAST_NUMBER)
    pick = lambda i: F.when(hit, F.regexp_extract(path, LAST_NUMBER, i))
    return F.struct(pick(1).alias("prefix"), pick(2).try_cast("long").alias("number"), pick(3).alias("suffix"))


def site_name(url: Column) -> Column:
    return trimmed(F.coalesce(F.nullif(url_domain(url), F.lit("")), url, F.lit("")))


def report_filename(site: Column, stamp: Column) -> Column:
    safe = F.regexp_replace(site_name(site), "[^0-9A-Za-z._-]+", "_")
    safe = F.regexp_replace(safe, "^_+|_+$", "")
    return F.concat(F.when(safe == "", "site").otherwise(safe), F.lit("_"), stamp, F.lit(".json"))


def _one_decimal(value: Column, unit: str) -> Column:
    return F.format_string(f"%.1f {unit}", F.bround(value, 1))


def format_size(n: Column) -> Column:
    """Bytes with one decimal in 1024 steps, TB at most; ties round to even."""
    size = n.cast("double")
    out = F.when(size < 1024, _one_decimal(size, "B"))
    step = 1024.0
    for unit in ("KB", "MB", "GB"):
        out = out.when(size / step < 1024, _one_decimal(size / step, unit))
        step *= 1024.0
    return out.otherwise(_one_decimal(size / step, "TB"))


def fmt_duration(seconds: Column) -> Column:
    whole = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)
