"""HLS playlists and DASH manifests held as text, one document per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftweb.functions import html, urls
from siftweb.functions.playlist import read_playlist
from siftweb.scale import unnest

ATTRIBUTE = r"""([A-Za-z0-9\-]+)=("[^"]*"|[^,]*)"""


def _attribute(line: Column, name: str) -> Column:
    raw = F.regexp_extract(line, rf"""(?i)[:,]\s*{name}=("[^"]*"|[^,]*)""", 1)
    return F.regexp_replace(urls.trimmed(raw), '^"+|"+$', "")


def playlist_lines(playlists: DataFrame, key: str, text: str = "text", url: str = "url") -> DataFrame:
    rows = unnest(playlists, [key, F.col(url).alias("base")], html.lines_of(F.col(text)), "line", "n")
    return rows.withColumn("tag", F.upper(F.regexp_extract("line", "^(#[^:]*)", 1)))


def _number(text: Column, kind: str) -> Column:
    return F.coalesce(urls.trimmed(text).try_cast(kind), F.lit(0).cast(kind))


def _summarised(playlists: DataFrame, key: str, text: str, url: str) -> DataFrame:
    """Playlists with what their lines say and the summary of it; all inside the row, every text is read once."""
    keys = F.transform("_read.keys", lambda line: F.struct(F.upper(_attribute(line, "METHOD")).alias("method"), _attribute(line, "URI").alias("uri")))
    used = F.transform(F.filter("_keys", lambda k: (k["method"] != "NONE") & (k["uri"] != "")), lambda k: urls.join_url(F.col("_base"), k["uri"]))
    barred = F.array_max(F.filter(F.transform("_keys", lambda k: k["method"]), lambda m: m.isin("SAMPLE-AES", "SAMPLE-AES-CTR")))
    last = lambda values: F.get(values, F.size(values) - 1)
    rows = (playlists.select(key, F.col(url).alias("_base"), read_playlist(F.col(text)).alias("_read")).withColumn("_keys", keys)
            .withColumns({"_used": F.when(F.size("_keys") > 0, used).otherwise(F.array().cast("array<string>")), "_barred": barred}))
    different = F.size(F.array_distinct("_used"))
    error = (F.when(F.col("_barred").isNotNull(), F.concat(F.lit("该流使用 "), "_barred", F.lit(" 加密（样本级加密/DRM），本工具不支持")))
             .when(different > 1, F.concat(F.lit("播放列表内出现 "), different.cast("string"), F.lit(" 个不同的密钥（密钥轮换）"))).otherwise(""))
    return rows.select(
        key, "_base", "_read", F.coalesce(last(F.col("_used")), F.lit("")).alias("key_uri"), F.col("_read.live").alias("live"),
        F.col("_read.is_master").alias("is_master"), error.alias("error"), F.coalesce(_attribute(F.col("_read.map"), "URI"), F.lit("")).alias("init_uri"))


def hls_summary(playlists: DataFrame, key: str, text: str = "text", url: str = "url") -> DataFrame:
    """Per playlist: key address, live flag, kind and why it cannot be used ('' when it can). A text without lines is no playlist."""
    return _summarised(playlists, key, text, url).filter(F.col("_read.lines") > 0).drop("_base", "_read")


def hls_totals(playlists: DataFrame, key: str, text: str = "text", url: str = "url") -> DataFrame:
    """The summary with number and duration of a usable playlist's segments (null without any), counted in the row."""
    count = F.when(F.col("error") == "", F.nullif(F.size("_read.segments"), F.lit(0))).cast("long")
    seconds = F.aggregate("_read.segments", F.lit(0.0), lambda total, s: total + _seconds(s["duration"]))
    rows = _summarised(playlists, key, text, url).filter(F.col("_read.lines") > 0).withColumn("segments", count)
    return rows.withColumn("total_duration", F.when(F.col("segments").isNotNull(), F.round(seconds, 3))).drop("_base", "_read")


def _seconds(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def _segment_rows(rows: DataFrame, key: str, array: Column) -> DataFrame:
    segments = unnest(rows, [key, "_base"], array, "s")
    sequence = F.coalesce(F.col("s.base").try_cast("long"), F.lit(0).cast("long")) + F.col("s.passed")
    return segments.select(key, urls.join_url(F.col("_base"), F.col("s.line")).alias("segment_url"), _seconds(F.col("s.duration")).alias("duration"),
                           sequence.alias("sequence"), "s.range_offset", "s.range_length")


def hls_segments(playlists: DataFrame, key: str, text: str = "text", url: str = "url") -> DataFrame:
    """One row per segment; a playlist is read inside its row, so nothing moves."""
    return _segment_rows(playlists.select(key, F.col(url).alias("_base"), read_playlist(F.col(text)).alias("_read")), key, F.col("_read.segments"))


def parse_hls(playlists: DataFrame, key: str, text: str = "text", url: str = "url") -> tuple[DataFrame, DataFrame]:
    """(summary, segments of the usable playlists)."""
    # a test in front of the array, not a filter, which would be pushed down with a copy of all it needs
    usable = F.when(F.col("error") == "", F.col("_read.segments"))
    return hls_summary(playlists, key, text, url), _segment_rows(_summarised(playlists, key, text, url), key, usable)


def playlist_totals(segments: DataFrame, key: str) -> DataFrame:
    return segments.groupBy(key).agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum("duration"), 3).alias("total_duration"))


def resolution_pixels(resolution: Column) -> Column:
    size = F.regexp_extract(resolution, r"(?i)^\s*(\d+)\s*x", 1).try_cast("long") * F.regexp_extract(resolution, r"(?i)x\s*(\d+)\s*$", 1).try_cast("long")
    return F.coalesce(size, F.lit(0))


def hls_variants(lines: DataFrame, key: str) -> DataFrame:
    """Streams of master playlists: each takes the next address line before another stream starts."""
    after = Window.partitionBy(key).orderBy("n").rowsBetween(1, Window.unboundedFollowing)
    is_stream = F.col("tag") == "#EXT-X-STREAM-INF"
    line = F.struct("n", "line")
    staged = (lines.withColumn("_next", F.first(F.when(~F.col("line").startswith("#"), line), ignorenulls=True).over(after))
              .withColumn("_stream", F.first(F.when(is_stream, F.col("n")), ignorenulls=True).over(after)))
    found = staged.filter(is_stream & F.col("_next").isNotNull() & (F.col("_stream").isNull() | (F.col("_next.n") < F.col("_stream"))))
    return found.select(key, "n", urls.join_url(F.col("base"), F.col("_next.line")).alias("variant_url"),
                        _number(_attribute(F.col("line"), "BANDWIDTH"), "long").alias("bandwidth"),
                        _attribute(F.col("line"), "RESOLUTION").alias("resolution"), _attribute(F.col("line"), "CODECS").alias("codecs"))


def best_variant(variants: DataFrame, key: str) -> DataFrame:
    """Largest picture, then highest bandwidth, then first listed."""
    rank = F.struct(resolution_pixels(F.col("resolution")), "bandwidth", -F.col("n"))
    return variants.groupBy(key).agg(F.max_by(F.struct("variant_url", "bandwidth", "resolution", "codecs"), rank).alias("v")).select(key, "v.*")


# ---- DASH ------------------------------------------------------------------------

_TEMPLATE = ("struct<_media:string,_initialization:string,_startNumber:string,_timescale:string,_duration:string,"
             "SegmentTimeline:struct<S:array<struct<_t:string,_d:string,_r:string,_VALUE:string>>>>")
_LIST = "struct<Initialization:struct<_sourceURL:string,_VALUE:string>,SegmentURL:array<struct<_media:string,_VALUE:string>>>"
_COMMON = f"BaseURL:array<string>,SegmentTemplate:{_TEMPLATE},SegmentList:{_LIST}"
MPD = (f"struct<_mediaPresentationDuration:string,BaseURL:array<string>,Period:array<struct<_duration:string,BaseURL:array<string>,"
       f"AdaptationSet:array<struct<_contentType:string,_mimeType:string,_codecs:string,{_COMMON},"
       f"Representation:array<struct<_id:string,_bandwidth:string,_width:string,_height:string,_mimeType:string,_codecs:string,{_COMMON}>>>>>>>")


def iso_duration(text: Column) -> Column:
    """Seconds of an ISO 8601 duration, 0 when unreadable."""
    pattern = r"(?i)^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:([\d.]+)S)?)?$"
    part = lambda i: F.coalesce(F.regexp_extract(text, pattern, i).try_cast("double"), F.lit(0.0))
    return F.coalesce(part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4), F.lit(0.0))


def _rebase(base: Column, own: Column) -> Column:
    first = urls.trimmed(F.coalesce(F.get(own, F.lit(0)), F.lit("")))
    return F.when(first == "", base).otherwise(urls.join_url(base, first))


def parse_dash(manifests: DataFrame, key: str, text: str = "text", url: str = "url") -> tuple[DataFrame, DataFrame]:
    """(representations, segments). Unreadable manifests give no rows."""
    parsed = manifests.withColumn("m", F.from_xml(F.col(text), MPD, {"ignoreNamespace": "true", "rowTag": "MPD", "mode": "PERMISSIVE"}))
    top = parsed.select(key, _rebase(F.col(url), F.col("m.BaseURL")).alias("base"), iso_duration(F.col("m._mediaPresentationDuration")).alias("total"), "m.Period")
    periods = unnest(top, [key, "base", "total"], "Period", "p", "pi")
    periods = periods.select(key, "pi", _rebase(F.col("base"), F.col("p.BaseURL")).alias("base"), F.col("p.AdaptationSet").alias("sets"),
                             F.when(iso_duration(F.col("p._duration")) > 0, iso_duration(F.col("p._duration"))).otherwise(F.col("total")).alias("seconds"))
    sets = unnest(periods, [key, "pi", "base", "seconds"], "sets", "a", "ai")
    sets = sets.withColumn("base", _rebase(F.col("base"), F.col("a.BaseURL")))
    reps = unnest(sets, [key, "pi", "ai", "base", "seconds", "a"], F.col("a.Representation"), "r", "ri")
    pick = lambda name: F.coalesce(F.col(f"r.SegmentTemplate.{name}"), F.col(f"a.SegmentTemplate.{name}"))
    mime = F.coalesce(F.nullif("r._mimeType", F.lit("")), F.col("a._mimeType"), F.lit(""))
    content = F.lower(F.coalesce(F.nullif("a._contentType", F.lit("")), F.col("a._mimeType"), F.lit("")))
    number = lambda c: _number(F.coalesce(c, F.lit("")), "long")
    built = reps.withColumn("rep_base", _rebase(F.col("base"), F.col("r.BaseURL"))).select(
        key, F.struct("pi", "ai", "ri").alias("rep"), F.coalesce("r._id", F.lit("")).alias("id"),
        number(F.col("r._bandwidth")).alias("bandwidth"), number(F.col("r._width")).alias("width"), number(F.col("r._height")).alias("height"),
        mime.alias("mime_type"), F.coalesce("r._codecs", "a._codecs", F.lit("")).alias("codecs"),
        F.when(content != "", content).when(F.lower(mime).startswith("video/"), "video").when(F.lower(mime).startswith("audio/"), "audio").otherwise("").alias("content_type"),
        "seconds", "rep_base", pick("_media").alias("media"), F.coalesce(pick("_initialization"), F.lit("")).alias("init"),
        F.greatest(number(pick("_startNumber")), F.when(pick("_startNumber").isNull() | (number(pick("_startNumber")) == 0), 1).otherwise(0)).alias("start"),
        F.when(number(pick("_timescale")) == 0, 1).otherwise(number(pick("_timescale"))).alias("scale"),
        F.coalesce(pick("_duration").try_cast("double"), F.lit(0.0)).alias("step"), pick("SegmentTimeline.S").alias("timeline"),
        F.coalesce("r.SegmentList", "a.SegmentList").alias("list"), (F.col("r.BaseURL").isNotNull()).alias("single"))
    # what a representation offers is known inside its row: a manifest is parsed once for either table and nothing moves
    usable = built.filter(F.size(_runs()) > 0)
    return (usable.select(key, "rep", "id", "bandwidth", "width", "height", "mime_type", "codecs", "content_type",
                          F.when(F.col("init") != "", urls.join_url(F.col("rep_base"), _fill(F.col("init"), F.lit(0), F.lit(0)))).otherwise("").alias("init_url")),
            _dash_segments(built, key))


def _fill(template: Column, number: Column, time: Column) -> Column:
    out = F.replace(F.replace(template, F.lit("$RepresentationID$"), F.col("id")), F.lit("$Bandwidth$"), F.col("bandwidth").cast("string"))
    for name, value in (("Number", number), ("Time", time)):
        text = value.cast("string")
        width = F.coalesce(F.regexp_extract(template, rf"\${name}%0(\d+)d\$", 1).try_cast("int"), F.lit(0))
        padded = F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, F.lit("0")))
        out = F.regexp_replace(F.replace(out, F.lit(f"${name}$"), text), F.lit(rf"\${name}%0\d+d\$"), padded)
    return out


_RUN = "struct<time:bigint,number:bigint,d:bigint,count:bigint,listed:string>"


def _runs() -> Column:
    """Runs of equal segments of a representation: of its template, else the listed addresses, else its own one; null or empty without segments."""
    whole = lambda number, media: F.struct(F.lit(0).cast("long").alias("time"), number.cast("long").alias("number"), F.lit(0).cast("long").alias("d"),
                                           F.lit(1).cast("long").alias("count"), media.alias("listed"))
    listed = F.filter(F.transform(F.col("list.SegmentURL"), lambda s, i: whole(i + 1, s["_media"])), lambda r: F.coalesce(r["listed"], F.lit("")) != "")
    alone = F.when(F.col("list").isNull() & F.col("single"), F.array(whole(F.lit(1), F.lit("").cast("string"))))
    of_template = F.transform(_template_runs(), lambda r: F.struct(r["time"].alias("time"), r["number"].alias("number"), r["d"].alias("d"),
                                                                   r["count"].alias("count"), F.lit(None).cast("string").alias("listed")).cast(_RUN))
    return F.when(F.coalesce("media", F.lit("")) != "", of_template).otherwise(F.coalesce(listed.cast(f"array<{_RUN}>"), alone.cast(f"array<{_RUN}>")))


def _dash_segments(built: DataFrame, key: str) -> DataFrame:
    runs = unnest(built, [key, "rep", "id", "bandwidth", "rep_base", "media", "scale"], _runs(), "run")
    each = unnest(runs, [key, "rep", "id", "bandwidth", "rep_base", "media", "scale", "run"], F.sequence(F.lit(0).cast("long"), F.col("run.count") - 1), "k")
    number, time = F.col("run.number") + F.col("k"), F.col("run.time") + F.col("run.d") * F.col("k")
    place = F.coalesce("run.listed", _fill(F.col("media"), number, time))
    return each.select(key, "rep", number.alias("sequence"), urls.join_url(F.col("rep_base"), place).alias("segment_url"),
                       (F.col("run.d") / F.col("scale")).alias("duration"))


def _template_runs() -> Column:
    """Timeline runs, else a fixed step over the period; a run of ``r=-1`` lasts to the period's end."""
    start = F.struct(F.lit(0).cast("long").alias("time"), F.col("start").cast("long").alias("number"),
                     F.array().cast("array<struct<time:bigint,number:bigint,d:bigint,count:bigint>>").alias("runs"))

    def step(state: Column, s: Column) -> Column:
        at = F.coalesce(s["_t"].try_cast("long"), state["time"])
        d = F.coalesce(s["_d"].try_cast("long"), F.lit(0).cast("long"))
        r = F.coalesce(s["_r"].try_cast("long"), F.lit(0).cast("long"))
        to_end = F.greatest(F.ceil((F.col("seconds") * F.col("scale") - at) / d), F.lit(1)).cast("long")
        count = F.when((r < 0) & (F.col("seconds") > 0), to_end).otherwise(F.greatest(r, F.lit(0)) + 1).cast("long")
        run = F.struct(at.alias("time"), state["number"].alias("number"), d.alias("d"), count.alias("count"))
        return F.when(d <= 0, F.struct(at.alias("time"), state["number"].alias("number"), state["runs"].alias("runs"))).otherwise(
            F.struct((at + d * count).alias("time"), (state["number"] + count).alias("number"), F.array_append(state["runs"], run).alias("runs")))

    listed = F.when(F.col("timeline").isNotNull(), F.aggregate("timeline", start, step)["runs"])
    total = F.greatest(F.ceil(F.col("seconds") * F.col("scale") / F.col("step")), F.lit(1)).cast("long")
    fixed = F.when((F.col("step") > 0) & (F.col("seconds") > 0), F.array(F.struct(
        F.lit(0).cast("long").alias("time"), F.col("start").cast("long").alias("number"), F.col("step").cast("long").alias("d"), total.alias("count"))))
    return F.coalesce(listed, fixed)


def best_representation(reps: DataFrame, key: str, max_height: int = 0) -> DataFrame:
    """Best video per manifest (within the height when any fits), else best audio; best audio alongside."""
    video = (F.col("content_type") == "video") | ((F.col("content_type") == "") & (F.col("height") > 0))
    audio = (F.col("content_type") == "audio") | F.lower("mime_type").contains("audio/")
    fits = F.lit(max_height > 0) & (F.col("height") > 0) & (F.col("height") <= max_height)
    first = F.struct(-F.col("rep.pi"), -F.col("rep.ai"), -F.col("rep.ri"))
    rank = F.struct(F.when(fits, 1).otherwise(0), F.col("width") * F.col("height"), "bandwidth", first)
    plain = F.struct(F.col("width") * F.col("height"), "bandwidth", first)
    best = reps.groupBy(key).agg(F.max_by("rep", F.when(video, rank)).alias("video"), F.max_by("rep", F.when(audio, plain)).alias("audio"))
    chosen = F.coalesce("video", "audio")
    return best.filter(chosen.isNotNull()).select(key, chosen.alias("rep"), F.when(F.col("audio") != chosen, F.col("audio")).alias("audio_rep"))
