"""Pages, images, request logs and robots/sitemap files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftweb.functions.html import LINE_BREAKS, unescape
from siftweb.functions.urls import trimmed
from siftweb.scale import unnest

#: optional columns of a fetched page and the value they take when absent
PAGE_DEFAULTS = {
    "final_url": ("string", ""), "status": ("int", 0), "content_type": ("string", ""),
    "json_text": ("string", None), "error": ("string", ""), "media_direct": ("boolean", False),
}

# --- fixed values: request headers worth forwarding to a download
FORWARDED_HEADERS = ["referer", "origin", "user-agent", "authorization", "cookie", "accept", "range"]


def as_pages(df: DataFrame) -> DataFrame:
    """Complete a page table: defaults, ``base_url`` (redirect target first) and ``ok``."""
    for name, (kind, value) in PAGE_DEFAULTS.items():
        column = F.col(name) if name in df.columns else F.lit(None)
        df = df.withColumn(name, F.coalesce(column.cast(kind), F.lit(value).cast(kind)))
    return (df.withColumn("base_url", F.when(F.col("final_url") != "", F.col("final_url")).otherwise(F.col("url")))
            .withColumn("ok", (F.col("error") == "") & ~F.col("media_direct")
                        & ((F.coalesce(F.col("html"), F.lit("")) != "") | F.col("json_text").isNotNull())))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return as_pages(spark.read.parquet(path))


def cap_page_text(pages: DataFrame, max_chars: int) -> DataFrame:
    """Limit the markup kept per page on the user's request; 0 keeps all."""
    if max_chars <= 0:
        return pages.withColumn("truncated", F.lit(False))
    return (pages.withColumn("truncated", F.length("html") > max_chars)
            .withColumn("html", F.left("html", F.lit(max_chars))))


def read_binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def decode_bodies(files: DataFrame, content_type: str = "content_type", body: str = "content") -> DataFrame:
    """Add ``text``: the body in the charset its content type names, else in the first of the usual ones that fits."""
    from siftweb.functions.arrow import decode_bytes

    declared = F.regexp_extract(F.coalesce(F.col(content_type), F.lit("")), r"""(?i)charset\s*=\s*["']?([\w.:-]+)""", 1)
    return files.withColumn("text", decode_bytes(F.col(body), declared))


def read_images(spark: SparkSession, path: str, header_bytes: int = 65536) -> DataFrame:
    """Path, length and the header of each image: enough for the dimensions."""
    return read_binary(spark, path).select(
        "path", "length", F.substring("content", 1, header_bytes).alias("header"))


def forward_headers(headers, base_url):
    """Known headers only, a ``Referer`` added when the log has none."""
    kept = F.map_filter(F.coalesce(headers, F.create_map().cast("map<string,string>")),
                        lambda k, v: F.lower(k).isin(FORWARDED_HEADERS) & (v != ""))
    named = F.exists(F.map_keys(kept), lambda k: F.lower(k) == "referer")
    return F.when(named | (base_url == ""), kept).otherwise(
        F.map_concat(kept, F.create_map(F.lit("Referer"), base_url)))


def read_network_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_robots(files: DataFrame, site: str = "site", text: str = "text") -> DataFrame:
    """Robots files -> one row per rule: site, agent, verb, path; ``group`` rows name the agents themselves.

    Consecutive ``User-agent`` lines share the rules below them. A file is one row, so its lines are
    folded in place and no shuffle is needed.
    """
    lines = F.filter(F.transform(F.split(F.col(text), LINE_BREAKS),
                                 lambda s: trimmed(F.substring_index(s, "#", 1))), lambda s: s.contains(":"))
    parsed = F.transform(lines, lambda s: F.struct(
        F.lower(trimmed(F.substring_index(s, ":", 1))).alias("key"),
        trimmed(F.regexp_replace(s, "^[^:]*:", "")).alias("value")))
    start = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(False).alias("closed"),
                     F.array().cast("array<struct<agents:array<string>,verb:string,path:string>>").alias("rules"))

    def step(acc, line):
        is_agent = line["key"] == "user-agent"
        is_rule = line["key"].isin("allow", "disallow")
        agents = (F.when(is_agent & acc["closed"], F.array(line["value"]))
                  .when(is_agent, F.array_append(acc["agents"], line["value"])).otherwise(acc["agents"]))
        rules = (F.when(is_rule & (F.size(acc["agents"]) > 0), F.array_append(acc["rules"], F.struct(
                     acc["agents"].alias("agents"), line["key"].alias("verb"), line["value"].alias("path"))))
                 .when(is_agent, F.array_append(acc["rules"], F.struct(
                     F.array(line["value"]).alias("agents"), F.lit("group").alias("verb"), F.lit("").alias("path"))))
                 .otherwise(acc["rules"]))
        return F.struct(agents.alias("agents"), F.when(is_agent, F.lit(False)).when(is_rule, F.lit(True))
                        .otherwise(acc["closed"]).alias("closed"), rules.alias("rules"))

    rules = F.aggregate(parsed, start, step)["rules"]
    return (unnest(files, [site], rules, "r")
            .select(site, F.explode("r.agents").alias("agent"), F.col("r.verb").alias("verb"), F.col("r.path").alias("path"))
            .filter((F.col("path") != "") | (F.col("verb") == "group")))


def sitemap_locs(files: DataFrame, site: str = "site", url: str = "url", text: str = "text") -> DataFrame:
    locs = F.regexp_extract_all(F.col(text), F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    return (unnest(files, [site, F.col(url).alias("map_url")], locs, "raw", "pos")
            .select(site, "map_url", "pos", unescape(F.col("raw")).alias("loc")))


def read_sitemaps(files: DataFrame, roots: DataFrame, site: str = "site", url: str = "url", text: str = "text", most: int = 0) -> DataFrame:
    """Addresses listed by each site's root map and, one level down, by the maps it names.

    ``roots`` holds (site, url) of the entry maps. ``most``: so many listed addresses per site count, 0 for all.
    """
    from siftweb.scale import number_in_groups

    locs = sitemap_locs(files, site, url, text)
    top = locs.join(roots.select(site, F.col(url).alias("map_url")), [site, "map_url"], "left_semi") \
        .withColumn("level", F.lit(0))
    is_map = F.lower("loc").rlike(r"\.xml(\.gz)?$")
    named = top.filter(is_map).groupBy(site, F.col("loc").alias("map_url")).agg(F.min("pos").alias("parent_pos"))
    below = locs.join(named, [site, "map_url"]).withColumn("level", F.lit(1))
    both = (top.withColumn("parent_pos", F.lit(0)).unionByName(below))
    numbered = number_in_groups(both, [site], ["level", "parent_pos", "map_url", "pos"],
                                F.col("level").cast("long") * 1000000000 + F.col("parent_pos"), "seen")
    counted = numbered.filter(F.col("seen") <= most) if most else numbered
    return counted.filter(~is_map).select(site, "map_url", "loc", "seen")
