"""Media kinds from extensions and content types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftweb.functions import fixed
from siftweb.functions.urls import bind, ext_of, trimmed

_BY_KIND = [
    ("image", fixed.IMAGE_EXTS), ("video", fixed.VIDEO_EXTS), ("audio", fixed.AUDIO_EXTS),
    ("document", fixed.DOCUMENT_EXTS), ("hls", fixed.HLS_EXTS), ("dash", fixed.DASH_EXTS),
]
MEDIA_EXT = r"(?i)\.(?:%s)(?:[?#]|$)" % "|".join(
    sorted(e[1:] for kind, exts in _BY_KIND if kind != "document" for e in exts))


def kind_by_ext(ext: Column) -> Column:
    def pick(low: Column) -> Column:
        out = None
        for kind, exts in _BY_KIND:
            out = F.when(low.isin(exts), kind) if out is None else out.when(low.isin(exts), kind)
        return out.otherwise("other")

    return bind(F.lower(F.coalesce(ext, F.lit(""))), pick)


def _plain_type(content_type: Column) -> Column:
    return F.lower(trimmed(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))


def kind_by_content_type(content_type: Column) -> Column:
    """NULL when the type says nothing."""
    def pick(ct: Column) -> Column:
        return (F.when(ct == "", F.lit(None).cast("string"))
                .when(ct.isin(fixed.HLS_CONTENT_TYPES), "hls")
                .when(ct.isin(fixed.DASH_CONTENT_TYPES), "dash")
                .when(ct.startswith("image/"), "image")
                .when(ct.startswith("video/"), "video")
                .when(ct.startswith("audio/"), "audio")
                .when(ct.startswith("text/") | ct.rlike("|".join(fixed.DOCUMENT_CT_WORDS)), "document"))

    return bind(_plain_type(content_type), pick)


def is_media_kind(kind: Column) -> Column:
    return kind.isin(fixed.MEDIA_KINDS)


def kind_of(url: Column, content_type: Column | None = None) -> Column:
    """Content type first; a mere ``document`` yields to a media extension."""
    by_url = kind_by_ext(ext_of(url))
    if content_type is None:
        return by_url

    def settle(k: Column) -> Column:
        return (F.when(k["type"].isNull(), k["url"])
                .when((k["type"] == "document") & is_media_kind(k["url"]), k["url"])
                .otherwise(k["type"]))

    return bind(F.struct(kind_by_content_type(content_type).alias("type"), by_url.alias("url")), settle)


def guess_extension(content_type: Column) -> Column:
    def pick(ct: Column) -> Column:
        main = F.substring_index(ct, "/", 1)
        sub = F.regexp_replace(ct, "^[^/]*/", "")
        out = F.when(~ct.contains("/") | ~main.isin("image", "video", "audio", "application", "text"), ".bin")
        for name, ext in fixed.SUBTYPE_EXT.items():
            out = out.when(ct.endswith(f"/{name}") & (sub == name), f".{ext}")
        return out.otherwise(F.concat(F.lit("."), sub))

    return bind(_plain_type(content_type), pick)


def has_media_ext(url: Column) -> Column:
    return url.rlike(MEDIA_EXT)


def event_kind(url: Column, content_type: Column, resource_type: Column) -> Column:
    """Kind of a logged request, '' when it is no media."""
    def settle(k: Column) -> Column:
        typed = is_media_kind(F.coalesce(k["type"], F.lit("")))
        return (F.when(is_media_kind(k["kind"]), k["kind"])
                .when(k["res"] == "image", "image")
                .when(k["res"] == "media", F.when(typed, k["type"]).otherwise("video"))
                .when(k["res"].isin(fixed.SKIPPED_RESOURCE_TYPES), "")
                .when(~has_media_ext(url), "")
                .when(typed, k["type"])
                .otherwise(kind_of(url)))

    return bind(F.struct(kind_of(url, content_type).alias("kind"), kind_by_content_type(content_type).alias("type"),
                         F.lower(F.coalesce(resource_type, F.lit(""))).alias("res")), settle)
