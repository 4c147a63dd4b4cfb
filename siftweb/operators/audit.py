"""Audits over download, session and request logs, and keyed-table helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftweb.functions import fixed, media, urls

FILTERED = "质量过滤："


def last_write_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key. An aggregate, so a hot key shrinks before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


# --- fixed values: expiry range and the date forms that may occur
EXPIRY_MIN, EXPIRY_MAX = 1_000_000_000, 4_000_000_000
DATE_FORMATS = ["yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd MMM yyyy HH:mm:ss"]


def normalize_epoch(value: Column) -> Column:
    """Unix seconds from seconds, milliseconds, 1601 microseconds or a date text; NULL outside the range."""
    text = urls.trimmed(value.cast("string"))
    number = F.when(text.rlike(r"^\d+(\.\d+)?$"), text.try_cast("double"))
    seconds = (F.when(number > 1e16, number / 1_000_000 - 11_644_473_600)
               .when(number > 1e13, number / 1000).when(number > EXPIRY_MAX, number / 1000).otherwise(number))
    iso = F.regexp_replace(text, "Z$", "+0000")
    # "Mon, 01-Jan-2024 00:00:00 GMT": weekday and zone go, dashes become blanks
    header = F.regexp_replace(F.regexp_replace(text, "^[A-Za-z]{3}, | GMT$", ""), r"^(\d+)-([A-Za-z]{3})-", "$1 $2 ")
    dated = F.coalesce(*[F.try_to_timestamp(iso, F.lit(f)) for f in DATE_FORMATS[:4]], F.try_to_timestamp(header, F.lit(DATE_FORMATS[4])),
                       text.try_cast("timestamp"))
    result = F.floor(F.when(number.isNotNull(), seconds).otherwise(F.unix_timestamp(dated))).cast("long")
    return F.when(result.between(EXPIRY_MIN, EXPIRY_MAX), result)


def normalize_same_site(value: Column) -> Column:
    low = F.lower(urls.trimmed(F.coalesce(value, F.lit(""))))
    return (F.when(low == "strict", "Strict").when(low == "lax", "Lax")
            .when(low.isin("none", "unspecified", "no_restriction", "unspecifiedsamesite"), "None"))


def domain_filter(df: DataFrame, host: str, domain: str = "domain", mode: str = "all") -> DataFrame:
    """Keep rows whose domain is in, or under, the family of ``host``; ``all`` keeps everything."""
    labels = [x for x in host.lower().strip(".").split(".") if x]
    family = [".".join(labels[i:]) for i in range(max(1, len(labels) - 1))] if labels else []
    if mode != "same-site" or not family:
        return df
    return df.filter(F.exists(urls.domain_family(urls.normalize_cookie_domain(F.col(domain))), lambda d: d.isin(family)))


def expiry_rollup(rows: DataFrame, now: int, domain: str = "domain", expiry: str = "expiry") -> DataFrame:
    """Rows and expired rows per domain; no expiry means never."""
    return rows.groupBy(domain).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(expiry) <= now).alias("expired"))


def set_fingerprint(rows: DataFrame, group: str, keys: Sequence[str], value: str) -> DataFrame:
    """Digest of each group's rows that does not depend on their order and shows no value.

    The 256-bit digests of the rows are added up in eight parts, with their number: sums are formed before the shuffle,
    and a group of any size is one short row.
    """
    row = F.sha2(F.concat_ws("|", *keys, F.length(value), F.left(F.sha2(F.col(value).cast("binary"), 256), F.lit(12))).cast("binary"), 256)
    sums = [F.sum(F.conv(F.substring("_d", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(8)]
    return rows.select(group, row.alias("_d")).groupBy(group).agg(
        F.left(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums).cast("binary"), 256), F.lit(16)).alias("fingerprint"))


EVIDENCE_CHARS = 120


def login_wall(pages: DataFrame, in_markers: Sequence[str], out_markers: Sequence[str], statuses: Sequence[int] = (),
               assume_valid: bool = True, text: str = "text", status: str = "status") -> DataFrame:
    """Add logged_in, reason, evidence and conflict: signed-out words first, then signed-in words, status, default."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))

    def first(markers):
        out = F.lit("")
        for m in reversed([m.strip().lower() for m in markers if m.strip()]):
            out = F.when(F.contains(low, F.lit(m)), m).otherwise(out)
        return out

    staged = pages.withColumn("_out", first(out_markers)).withColumn("_in", first(in_markers))
    marker = F.when(F.col("_out") != "", F.col("_out")).otherwise(F.col("_in"))
    at = F.greatest(F.instr(low, marker) - 40, F.lit(1))
    code = F.coalesce(F.col(status), F.lit(0))
    listed = code.isin(list(statuses)) if statuses else F.lit(False)
    known = F.lit(bool(statuses)) & (code != 0)
    blank = urls.trimmed(F.coalesce(F.col(text), F.lit(""))) == ""
    weak = F.lit(bool(statuses)) & (code == 0) & ~blank
    return (staged.withColumn("logged_in", F.when(F.col("_out") != "", False).when(F.col("_in") != "", True).when(known, listed)
                              .when(weak, True).otherwise(assume_valid))
            .withColumn("rule", F.when(F.col("_out") != "", "logout_marker").when(F.col("_in") != "", "login_marker").when(known, "status")
                        .when(weak, "non_empty").otherwise("default"))
            .withColumn("evidence", F.when(marker != "", F.regexp_replace(F.substring(F.col(text), at, F.lit(EVIDENCE_CHARS)), "\n", " ")).otherwise(""))
            .withColumn("conflict", (F.col("_out") != "") & (F.col("_in") != "")).drop("_out", "_in"))


def politeness_audit(log: DataFrame, per_minute: int, min_interval_us: int, host: str = "host", ts_us: str = "ts_us", key: str = "id",
                     chunk_us: int = 3_600_000_000) -> DataFrame:
    """Flag requests that break a sliding sixty-second quota or a least gap per host.

    A host's log is cut into chunks of time; each chunk also receives the last minute before it, and the
    gap to the request just before a chunk comes from the chunk maxima. So no host fills one task.
    """
    minute = 59_999_999
    base = log.select(host, ts_us, key).withColumn("_chunk", F.floor(F.col(ts_us) / chunk_us))
    lead_in = base.filter((F.col("_chunk") + 1) * chunk_us - F.col(ts_us) <= minute).withColumn("_chunk", F.col("_chunk") + 1)
    both = base.withColumn("_own", F.lit(True)).unionByName(lead_in.withColumn("_own", F.lit(False)))
    by_time = Window.partitionBy(host, "_chunk").orderBy(ts_us)
    counted = (both.withColumn("in_window", F.count(F.lit(1)).over(by_time.rangeBetween(-minute, 0)))
               .withColumn("_before", F.lag(ts_us).over(Window.partitionBy(host, "_chunk").orderBy(ts_us, key))).filter("_own"))
    last = base.groupBy(host, "_chunk").agg(F.max(ts_us).alias("_last"))
    earlier = last.withColumn("_earlier", F.lag("_last").over(Window.partitionBy(host).orderBy("_chunk"))).drop("_last")
    joined = counted.join(earlier, [host, "_chunk"], "left").withColumn("_before", F.coalesce("_before", "_earlier"))
    return joined.select(host, ts_us, key, "in_window", (F.col("in_window") > per_minute).alias("over_quota"),
                         F.coalesce((F.col(ts_us) - F.col("_before")) < min_interval_us, F.lit(False)).alias("too_soon"))


# ---- downloads ------------------------------------------------------------------

def header_md5(headers: Column) -> Column:
    """Digest announced by the server: ``Digest: md5=hex``, else base64 ``Content-MD5``; NULL when none."""
    digest = F.coalesce(F.try_element_at(headers, F.lit("Digest")), F.lit(""))
    coded = F.coalesce(F.try_element_at(headers, F.lit("Content-MD5")), F.lit(""))
    return (F.when(F.lower(digest).startswith("md5="), F.lower(urls.trimmed(F.substring(digest, 5, 200))))
            .when(coded.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(coded) % 4 == 0), F.lower(F.hex(F.unbase64(coded)))))


def download_verdict(df: DataFrame) -> DataFrame:
    """Add ``resource_type``, ``ok`` and ``note`` from url, item_kind, content_type, status, expected, actual, md5s, problem.

    The first rule that applies decides.
    """
    staged = df.withColumn("_by_url", media.kind_of(F.col("url"))).withColumn("_ct", F.lower(urls.trimmed(
        F.substring_index(F.coalesce(F.col("content_type"), F.lit("")), ";", 1))))
    staged = staged.withColumn("_typed", media.kind_by_content_type(F.col("_ct")))
    by_url = F.when(F.col("_by_url").isin(fixed.STREAM_KINDS), "video").otherwise(F.col("_by_url"))
    item = F.coalesce(F.col("item_kind"), F.lit(""))
    url_type = F.when((by_url == "other") & (item != ""), F.when(item.isin(fixed.STREAM_KINDS), "video").otherwise(item)).otherwise(by_url)
    ct = F.col("_ct")
    typed = F.when(F.col("_typed").isin(fixed.STREAM_KINDS), "video").otherwise(F.col("_typed"))
    page = url_type.isin("video", "image", "audio") & (ct.startswith("text/") | ct.isin("application/json", "application/xml"))
    note = (F.when(page, F.concat(F.lit("返回 "), ct, F.lit(" 页面而非媒体文件（可能被拦截或链接失效）")))
            .when(~F.col("status").isin(200, 206), F.concat(F.lit("HTTP "), F.col("status").cast("string")))
            .when(F.coalesce(F.col("actual"), F.lit(0)) <= 0, "未下载到有效数据")
            .when((F.col("expected") > 0) & (F.col("actual") != F.col("expected")), F.concat(
                F.lit("下载不完整（"), urls.format_size(F.col("actual")), F.lit("/"), urls.format_size(F.col("expected")), F.lit("），可续传")))
            .when(F.coalesce(F.col("expected_md5"), F.lit("")).isin("") == F.lit(False),
                  F.when(F.lower("expected_md5") != F.lower("md5"), "MD5校验失败")))
    note = F.coalesce(note, F.when(F.coalesce(F.col("problem"), F.lit("")) != "", F.concat(F.lit(FILTERED), F.col("problem"))), F.lit(""))
    judged = staged.withColumns({"resource_type": F.coalesce(typed, url_type), "note": note}).drop("_by_url", "_ct", "_typed")
    return judged.withColumn("ok", F.col("note") == "")


def is_filtered(note: Column) -> Column:
    return F.startswith(note, F.lit(FILTERED))


def download_totals(audited: DataFrame) -> DataFrame:
    filtered = is_filtered(F.col("note"))
    return audited.agg(F.count_if("ok").alias("success"), F.count_if(~F.col("ok") & ~filtered).alias("failed"), F.count_if(filtered).alias("filtered"))


def failed_urls(audited: DataFrame) -> DataFrame:
    """Addresses to try again and addresses dropped for quality, as rows."""
    return audited.filter(~F.col("ok")).select("url", F.when(is_filtered(F.col("note")), "filtered").otherwise("failed").alias("outcome"))


def manifest_rows(downloads: DataFrame, items: DataFrame) -> DataFrame:
    """Downloads with album, resolution and duration of their item, by exact address."""
    known = items.select("url", "album", F.when((F.col("width") > 0) & (F.col("height") > 0), F.concat(
        F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))).otherwise("").alias("resolution"), "duration")
    # of several items with one address the least row counts
    known = known.groupBy("url").agg(F.min(F.struct("album", "resolution", "duration")).alias("r")).select("url", "r.*")
    # the downloads go into the join as they come, once: counting their hot addresses first would judge them all a second time. A partition that a
    # hot address (or a missing one) fills is split by Spark, which needs an exchange of its own on either side
    joined = downloads.join(known.repartition(F.xxhash64("url")), "url", "left")
    return joined.withColumns({"album": F.coalesce("album", F.lit("")), "resolution": F.coalesce("resolution", F.lit("")), "duration": F.coalesce("duration", F.lit(0.0))})


def manifest_line(rows: DataFrame) -> DataFrame:
    extra = F.array_join(F.filter(F.array("album", "resolution"), lambda x: x != ""), " ")
    shown = F.when(extra == "", "").otherwise(F.concat(F.lit(" "), extra))
    return rows.withColumn("line", F.concat(F.lit("["), "resource_type", F.lit("]"), shown, F.lit(" "), "url", F.lit("\n     → "), "path", F.lit(" ("),
                                            urls.format_size(F.col("size")), F.lit(", MD5:"), "md5", F.lit(")")))
