"""Media inventory: merge, keep-first dedup, cap, numbering, naming, duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftweb.functions import fixed, urls
from siftweb.operators import filters
from siftweb.scale import lookup_by_key, number_all, number_in_groups, unnest

TEXT_FIELDS = ["kind", "source_page", "album", "title", "ext", "origin"]
NUMBER_FIELDS = ["index", "width", "height", "size", "duration"]
MAP_FIELDS = ["headers", "extra"]
#: pages per numbering block; a page bounds the media it can name
PAGES_PER_BLOCK = 4096


@dataclass(frozen=True)
class MediaConfig:
    kinds: tuple[str, ...] = ("image", "video")
    min_width: int = 0
    min_height: int = 0
    min_size: int = 0
    max_size: int = 0
    allow_svg: bool = False
    max_count: int = 0
    max_pages: int = 5
    max_depth: int = 0
    detail_link_pattern: str = ""
    upgrade_urls: bool = True
    block: tuple[str, ...] = field(default_factory=tuple)
    filename_template: str = "{album}/{index:03d}_{title}{ext}"


def arrival(*columns: str) -> Column:
    return F.struct(*columns)


def _first_filled(name: str, order: str, blank) -> Column:
    value = F.when(F.col(name) != blank, F.col(name))
    return F.coalesce(F.min_by(value, F.when(value.isNotNull(), F.col(order))), F.lit(blank)).alias(name)


def merge_items(df: DataFrame, keys: Sequence[str] = ("url_key",), order: str = "arrival") -> DataFrame:
    """One row per key: first non-empty value of each field, map entries of earlier rows win.

    Every step is a partial aggregate, so a key that fills a third of the table still merges map-side.
    """
    keys = list(keys)
    fields = [c for c in TEXT_FIELDS if c in df.columns], [c for c in NUMBER_FIELDS if c in df.columns]
    merged = df.groupBy(*keys).agg(
        F.min(order).alias(order), F.min_by("url", order).alias("url"), F.count(F.lit(1)).alias("mentions"),
        *[_first_filled(c, order, "") for c in fields[0]], *[_first_filled(c, order, 0) for c in fields[1]])
    maps = [c for c in MAP_FIELDS if c in df.columns]
    if not maps:
        return merged
    entries = [F.transform(F.map_entries(F.col(c)), _tagged(c)) for c in maps]
    pairs = (unnest(df, [*keys, order], F.concat(*entries), "e")
             .groupBy(*keys, F.col("e.m").alias("m"), F.col("e.k").alias("k")).agg(F.min_by("e.v", order).alias("v")))
    # distinct header and attribute names per address are few
    packed = pairs.groupBy(*keys).agg(*[
        F.map_from_entries(F.collect_list(F.when(F.col("m") == c, F.struct("k", "v")))).alias(c) for c in maps])
    joined = merged.join(packed, keys, "left")
    for c in maps:
        joined = joined.withColumn(c, F.coalesce(F.col(c), F.create_map().cast("map<string,string>")))
    return joined


def _tagged(name: str):
    return lambda e: F.struct(F.lit(name).alias("m"), e["key"].alias("k"), e["value"].alias("v"))


def union_sources(*tables: DataFrame) -> DataFrame:
    """Candidates of all extractors, merged per page and address; earlier extractors lead."""
    base = tables[0]
    for other in tables[1:]:
        base = base.unionByName(other, allowMissingColumns=True)
    ranked = base.withColumn("url_key", urls.url_key(F.col("url"))).withColumn("arrival", arrival("priority", "pos"))
    return (merge_items(ranked, ["page_seq", "url_key"])
            .withColumn("arrival", F.struct(F.col("page_seq"), F.col("arrival.priority").alias("priority"), F.col("arrival.pos").alias("pos"))))


def label_media(candidates: DataFrame, config: MediaConfig, order: str = "arrival", block: Column | None = None) -> DataFrame:
    """Add ``url_key``, ``kept_arrival`` and ``label``.

    A row is ``kept`` when it is the first of its address that passes everything, ``duplicate`` when it
    comes later, else it carries its own reason. With a cap, whatever arrives behind the last kept row
    and belongs to no kept address is ``truncated``.
    """
    base = candidates if "url_key" in candidates.columns else candidates.withColumn("url_key", urls.url_key(F.col("url")))
    blocked = F.lit(False)
    for pattern in filters.usable_patterns(config.block):
        blocked = blocked | F.col("url").rlike(pattern)
    early = urls.bind(filters.media_kind_reason(config.kinds, config.allow_svg),
                      lambda kind: F.when(kind != "", kind).when(blocked, "blocked").otherwise(""))
    late = filters.media_quality_reason(config.min_width, config.min_height, config.min_size, config.max_size)
    judged = base.withColumn("_early", early).withColumn("_late", late)
    passing = (F.col("_early") == "") & (F.col("_late") == "")
    summary = judged.groupBy("url_key").agg(
        F.min(F.when(passing, F.col(order))).alias("kept_arrival"), F.count(F.lit(1)).alias("_rows"))
    limit = None
    if config.max_count > 0:
        limit = _cap_limit(summary.filter(F.col("kept_arrival").isNotNull()).select("kept_arrival"), config.max_count, block)
    joined = lookup_by_key(judged, summary, "url_key", "_rows", F.struct(F.col(order), F.col("url")))
    me, kept = F.col(order), F.col("kept_arrival")
    label = F.when(F.col("_early") != "", F.col("_early"))
    if limit is not None:
        joined = joined.withColumn("_limit", limit)
        beyond = F.col("_limit").isNotNull() & (me > F.col("_limit")) & (kept.isNull() | (kept > F.col("_limit")))
        label = label.when(beyond, "truncated")
    label = label.when(me == kept, "kept").when(me > kept, "duplicate").otherwise(F.col("_late"))
    return joined.withColumn("label", label).drop("_early", "_late", "_limit")


def _cap_limit(kept: DataFrame, count: int, block: Column | None) -> Column:
    """Arrival of the last row under the cap, NULL when the cap is not reached."""
    from siftweb.session import cut_lineage

    if block is None:  # ranges of the arrivals; checkpointed, so that a row keeps its range
        kept = cut_lineage(kept.repartitionByRange("kept_arrival")).withColumn("_range", F.spark_partition_id())
        block = F.col("_range")
    ranked = number_all(kept, ["kept_arrival"], block, "_rank")
    return ranked.filter(F.col("_rank") == count).agg(F.max("kept_arrival")).scalar()


def default_album(hint: str | None = None) -> Column:
    """Album of a kept item: its own, the page's hint, the source host, else ``media``."""
    source = F.when(F.coalesce(F.col("source_page"), F.lit("")) != "", F.col("source_page")).otherwise(F.col("url"))
    host = F.regexp_replace(urls.url_domain(source), ":", "_")
    names = [F.nullif(F.col("album"), F.lit(""))]
    if hint:
        names.append(F.nullif(urls.trimmed(F.col(hint)), F.lit("")))
    return F.coalesce(*names, F.nullif(host, F.lit("")), F.lit("media"))


def kept_items(labelled: DataFrame, order: str = "arrival", block: Column | None = None, hint: str | None = None) -> DataFrame:
    """Kept rows with their duplicates merged in, albums assigned and items numbered per album.

    The merged items are checkpointed because numbering reads them twice; ``labelled`` is read twice too.
    """
    from siftweb.session import cut_lineage

    part = labelled.filter(F.col("label").isin("kept", "duplicate"))
    is_kept = F.col("label") == "kept"
    # album and document index are settled by the kept row before anything merges into it
    part = part.withColumn("album", F.when(is_kept, default_album(hint)).otherwise(F.col("album")))
    if {"index", "extra"} <= set(part.columns):
        noted = F.map_concat(F.create_map(F.lit("doc_index"), F.col("index").cast("string")), F.col("extra"))
        part = part.withColumn("extra", F.when(is_kept & (F.col("index") != 0), noted).otherwise(F.col("extra")))
    merged = cut_lineage(merge_items(part, ["url_key"], order).drop("index"))
    span = F.floor(F.col(f"{order}.page_seq") / PAGES_PER_BLOCK) if block is None else block
    return number_in_groups(merged, ["album"], [order], span, "index")


def media_stats(labelled: DataFrame) -> DataFrame:
    """The counters of one run, in one aggregate."""
    names = ["kept", "duplicate", "wrong_kind", "svg", "blocked", "too_small", "too_large", "truncated"]
    return labelled.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("label") == n).alias(n) for n in names])


def rejected_samples(labelled: DataFrame, order: str = "arrival", cap: int = 0) -> DataFrame:
    """Rejected addresses with their reason; with ``cap`` the first ones only, as a run's log shows them."""
    rows = labelled.filter(~F.col("label").isin("kept", "duplicate", "truncated")).select(order, "url", F.col("label").alias("reason"))
    return rows.orderBy(order).limit(cap) if cap else rows


def new_media(items: DataFrame, known: DataFrame) -> DataFrame:
    """Items with an address that ``known(url)`` lacks, one per address (the least row)."""
    named = items.filter(F.coalesce("url", F.lit("")) != "")
    fresh = named.join(known.select("url").distinct(), "url", "left_anti")
    rest = [c for c in fresh.columns if c != "url"]
    return fresh.groupBy("url").agg(F.min(F.struct(*rest)).alias("r")).select("url", "r.*").select(*items.columns) if rest else fresh.distinct()


def merge_stats(stats: DataFrame) -> DataFrame:
    return stats.agg(*[F.sum(c).alias(c) for c in stats.columns])


def result_order(items: DataFrame) -> DataFrame:
    return items.orderBy("album", "index")


def download_order(items: DataFrame, order: str) -> DataFrame:
    """Rank by type, then arrival: images first, streams late."""
    rank = F.lit(4)
    for kind, value in fixed.TYPE_PRIORITY.items():
        rank = F.when(F.col("kind") == kind, value).otherwise(rank)
    return items.withColumn("priority", rank).orderBy("priority", order)


def save_paths(items: DataFrame, order: Sequence[str], url: str = "url", kind: str = "kind",
               relative: Column | None = None) -> DataFrame:
    """Save path per address: type/host/name, a hash suffix when another address owns the path.

    Only the first distinct address of a path keeps the plain name.
    """
    host = F.coalesce(F.nullif(F.regexp_replace(urls.url_domain(F.col(url)), ":", "_"), F.lit("")), F.lit("unknown_host"))
    rel = F.lit("") if relative is None else relative
    folder = F.concat(F.col(kind), F.lit("/"), host,
                      F.when(rel.contains("/"), F.concat(F.lit("/"), F.regexp_replace(rel, "/[^/]*$", ""))).otherwise(""))
    name = F.when(rel != "", F.substring_index(rel, "/", -1)).otherwise(urls.percent_decode(urls.url_basename(F.col(url))))
    name = F.regexp_replace(name, r'[\\/:*?"<>|]', "_")
    digest = urls.url_hash_raw(F.col(url))
    named = (items.withColumn("_folder", folder).withColumn("_digest", digest)
             .withColumn("_name", F.when((name == "") | ~name.contains("."), F.left(digest, F.lit(16))).otherwise(name))
             .withColumn("_plain", F.concat("_folder", F.lit("/"), "_name")))
    owners = named.groupBy("_plain").agg(F.min_by(url, F.struct(*order)).alias("_owner"), F.count(F.lit(1)).alias("_rows"))
    joined = lookup_by_key(named, owners, "_plain", "_rows", F.struct(*order))
    stem = F.regexp_replace("_name", r"(?<=[^.])\.[^.]*$", "")
    suffix = F.substr("_name", F.length(stem) + 1)
    other = F.concat("_folder", F.lit("/"), stem, F.lit("_"), F.left("_digest", F.lit(8)), suffix)
    return (joined.withColumn("save_path", F.when(F.col("_owner") == F.col(url), F.col("_plain")).otherwise(other))
            .drop("_folder", "_digest", "_name", "_plain", "_owner"))


# ---- duplicates by content ----------------------------------------------------

def exact_dedup(files: DataFrame, path: str, order: Sequence[str], digest: str = "md5") -> DataFrame:
    """Point each file at the first one with the same digest (``kept_path``)."""
    firsts = files.groupBy(digest).agg(F.min_by(path, F.struct(*order)).alias("kept_path"), F.count(F.lit(1)).alias("_rows"))
    joined = lookup_by_key(files, firsts, digest, "_rows", F.col(path))
    return joined.withColumn("is_duplicate", F.col("kept_path") != F.col(path))


def difference_hash(samples: Column, width: int, rows: int) -> Column:
    """Bit string of left < right over neighbours of a luminance grid, as a signed long."""
    steps = F.array(*[F.lit(r * width + c) for r in range(rows) for c in range(width - 1)])
    return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(
        F.when(F.get(samples, i) < F.get(samples, i + 1), 1).otherwise(0).cast("long")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band_values(digest: Column, bands: int, bits: int = 64) -> Column:
    """The hash cut into ``bands`` slices; two hashes within bands-1 bits share a slice."""
    edges = [bits * i // bands for i in range(bands + 1)]
    return F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(digest, edges[i]).bitwiseAND(
        F.lit((1 << (edges[i + 1] - edges[i])) - 1 if bands > 1 else -1)).alias("slice")) for i in range(bands)])


def near_duplicate_pairs(hashes: DataFrame, key: str, digest: str, threshold: int = 4) -> DataFrame:
    """Pairs of *distinct hashes* within ``threshold`` bits.

    Equal hashes are grouped first, so a hash that a third of the rows share is one row here and never
    turns into all pairs of its copies; the copies follow their hash (``members``). Zero never matches.
    A hash is cut into half as many slices as bits may differ, so one slice at least differs by one bit or none: one side looks
    slices up as they are, the other with every bit turned over once. Slices are twice as long as for equal ones, so a bucket holds the
    square root of as many hashes. Both sides are sorted and merged: the planner takes a side for as small as it is before its slices
    are unfolded, and would broadcast it.
    """
    groups = hashes.filter(F.col(digest) != 0).groupBy(digest).agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("copies"))
    # a row becomes many: as many tasks as cores, which are not merged to one because the rows are few yet
    groups = groups.repartition(hashes.sparkSession.sparkContext.defaultParallelism, F.xxhash64(digest))
    bands, bits = threshold // 2 + 1, 64
    width = [bits * (i + 1) // bands - bits * i // bands for i in range(bands)]
    slices = band_values(F.col(digest), bands)
    widths = F.array(*map(F.lit, width))
    turned = F.flatten(F.transform(slices, lambda b: F.transform(F.sequence(F.lit(-1), F.get(widths, b["band"]) - 1), lambda k: F.struct(
        b["band"].alias("band"), F.when(k < 0, b["slice"]).otherwise(b["slice"].bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))).alias("slice")))))
    side = lambda array, name: unnest(groups, ["first_key", F.col(digest).alias("h"), "copies"], array, "b").select(
        "b.band", "b.slice", F.col("first_key").alias(f"{name}_key"), F.col("h").alias(f"{name}_hash"), F.col("copies").alias(f"{name}_copies"))
    close = side(slices, "a").hint("merge").join(side(turned, "b"), ["band", "slice"]).filter(
        (F.col("a_key") < F.col("b_key")) & (hamming(F.col("a_hash"), F.col("b_hash")) <= threshold))
    # a pair is reported by the lowest slice that is near enough, which makes it unique without a distinct
    shared = F.array_position(F.transform(F.arrays_zip(
        band_values(F.col("a_hash"), bands).alias("x"), band_values(F.col("b_hash"), bands).alias("y")),
        lambda z: hamming(z["x"]["slice"], z["y"]["slice"]) <= 1), True) - 1
    return close.filter(shared == F.col("band")).select(
        "a_key", "b_key", "a_hash", "b_hash", "a_copies", "b_copies",
        hamming(F.col("a_hash"), F.col("b_hash")).cast("long").alias("distance"))


# ---- image headers ------------------------------------------------------------

def _unsigned(data: Column, start: int, size: int, little: bool = False) -> Column:
    raw = F.hex(F.substring(data, start + 1, size))
    if little:
        raw = F.concat(*[F.substring(raw, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.conv(raw, 16, 10).try_cast("long")


def image_dimensions(data: Column) -> Column:
    """Struct(width, height) from header bytes, zeros when unknown.

    JPEG segments are walked by a fold whose state is only the next offset and the result.
    """
    head = lambda start, size: F.hex(F.substring(data, start + 1, size))
    pair = lambda w, h: F.struct(F.coalesce(w, F.lit(0)).cast("long").alias("width"),
                                 F.coalesce(h, F.lit(0)).cast("long").alias("height"))
    signed = lambda v: F.when(v >= 2147483648, 4294967296 - v).otherwise(v)
    bits = _unsigned(data, 21, 4, True)
    webp = (F.when(head(12, 4) == "56503858", pair(_unsigned(data, 24, 3, True) + 1, _unsigned(data, 27, 3, True) + 1))
            .when((head(12, 4) == "56503820") & (head(23, 3) == "9D012A"), pair(
                _unsigned(data, 26, 2, True).bitwiseAND(F.lit(0x3FFF)), _unsigned(data, 28, 2, True).bitwiseAND(F.lit(0x3FFF))))
            .when((head(12, 4) == "5650384C") & (head(20, 1) == "2F"), pair(
                bits.bitwiseAND(F.lit(0x3FFF)) + 1, F.shiftright(bits, 14).bitwiseAND(F.lit(0x3FFF)) + 1))
            .otherwise(pair(F.lit(0), F.lit(0))))
    return (F.when(F.length(data) < 32, pair(F.lit(0), F.lit(0)))
            .when(head(0, 8) == "89504E470D0A1A0A", pair(_unsigned(data, 16, 4), _unsigned(data, 20, 4)))
            .when(head(0, 2) == "FFD8", _jpeg(data))
            .when(head(0, 6).isin("474946383761", "474946383961"), pair(_unsigned(data, 6, 2, True), _unsigned(data, 8, 2, True)))
            .when(head(0, 2) == "424D", pair(signed(_unsigned(data, 18, 4, True)), signed(_unsigned(data, 22, 4, True))))
            .when((head(0, 4) == "52494646") & (head(8, 4) == "57454250"), webp)
            .otherwise(pair(F.lit(0), F.lit(0))))


def _jpeg(data: Column) -> Column:
    zero = F.struct(F.lit(2).cast("long").alias("at"), F.lit(0).cast("long").alias("width"), F.lit(0).cast("long").alias("height"))

    def byte(at: Column, size: int = 1) -> Column:
        return F.conv(F.hex(F.substr(data, at.cast("int") + 1, F.lit(size))), 16, 10).try_cast("long")

    def over(state: Column) -> Column:
        return (state["at"] < 0) | (state["at"] + 9 > F.length(data))

    def step(state: Column, _: Column) -> Column:
        at = state["at"]

        def read(seen: Column) -> Column:
            out = lambda a, w=F.lit(0), h=F.lit(0): F.struct(a.cast("long").alias("at"), w.cast("long").alias("width"),
                                                             h.cast("long").alias("height"))
            marker, size = seen["marker"], seen["size"]
            return (F.when(seen["lead"] != 255, out(at + 1))
                    .when(marker.isin(0xD8, 0x01) | marker.between(0xD0, 0xD7), out(at + 2))
                    .when(marker == 0xD9, out(F.lit(-1)))
                    .when(marker.between(0xC0, 0xCF) & ~marker.isin(0xC4, 0xC8, 0xCC), out(F.lit(-1), byte(at + 7, 2), byte(at + 5, 2)))
                    .when(size < 2, out(F.lit(-1))).otherwise(out(at + 2 + size)))

        return F.when(over(state), state).otherwise(urls.bind(
            F.struct(byte(at).alias("lead"), byte(at + 1).alias("marker"), byte(at + 2, 2).alias("size")), read))

    # every step moves on by a byte at least: as many steps as bytes, in rows of their root, and rows after the end cost nothing
    row = F.sequence(F.lit(1), F.ceil(F.sqrt(F.length(data))).cast("int"))
    walked = F.aggregate(row, zero, lambda state, _: F.when(over(state), state).otherwise(F.aggregate(row, state, step)))
    return urls.bind(walked, lambda s: F.struct(s["width"].alias("width"), s["height"].alias("height")))


def quality_audit(files: DataFrame, config: MediaConfig) -> DataFrame:
    """Add ``problem``: why a stored file does not meet the configuration, '' when it does."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    size = F.col("size")
    bound = lambda n: urls.format_size(F.lit(n))
    measured = ext.isin(".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".avif", ".ico")
    out = F.when((ext == ".svg") & F.lit(not config.allow_svg), "SVG 图标（默认排除）")
    if config.min_size:
        out = out.when(size < config.min_size, F.concat(F.lit("体积 "), urls.format_size(size), F.lit(" 小于下限 "), bound(config.min_size)))
    if config.max_size:
        out = out.when(size > config.max_size, F.concat(F.lit("体积 "), urls.format_size(size), F.lit(" 超过上限 "), bound(config.max_size)))
    if config.min_width:
        out = out.when(measured & (F.col("width") > 0) & (F.col("width") < config.min_width),
                       F.concat(F.lit("宽度 "), F.col("width").cast("string"), F.lit(f" 小于下限 {config.min_width}")))
    if config.min_height:
        out = out.when(measured & (F.col("height") > 0) & (F.col("height") < config.min_height),
                       F.concat(F.lit("高度 "), F.col("height").cast("string"), F.lit(f" 小于下限 {config.min_height}")))
    return files.withColumn("problem", out.otherwise(""))


#: undecided hashes that are settled one after the other in one task, and their links at most
RUN, RUN_LINKS = 100_000, 2_000_000


def _settle_run(table: pa.Table) -> pa.Table:
    """Greedy leaders among the first undecided hashes: all earlier ones are decided or in the run."""
    rows = table.sort_by("node")
    keepers, found = set(), []
    for node, known, near in zip(*(rows.column(c).to_pylist() for c in ("node", "known", "near"))):
        first = min((n for n in near or () if n in keepers), default=None)
        first = known if first is None or (known is not None and known < first) else first
        if first is None:
            keepers.add(node)
        found.append(node if first is None else first)
    return pa.table({"node": rows.column("node"), "keeper": pa.array(found, pa.int64())})


def perceptual_groups(hashes: DataFrame, key: str, digest: str, order: str, threshold: int = 4) -> DataFrame:
    """Greedy leader groups in arrival order: a row joins the first keeper within ``threshold`` bits.

    Distinct hashes only; copies follow theirs. In a round every undecided hash joins its earliest keeper
    once every earlier neighbour up to that keeper is decided, and becomes a keeper once all its earlier
    neighbours are decided and none is a keeper; that settles nearly all at once, but a chain link by link. So a round also takes the first
    undecided hashes in order, RUN of them at most and fewer where they have very many links, and settles them one after the other: what comes before them is decided.
    """
    from siftweb.session import cut_lineage

    ranked = hashes.filter(F.col(digest) != 0).groupBy(digest).agg(F.min(order).cast("long").alias("_at"), F.count(F.lit(1)).alias("_n"))
    pairs = near_duplicate_pairs(ranked.select(F.col("_at").alias("k"), F.col(digest).alias("d")), "k", "d", threshold)
    # an edge leads from the later hash to the earlier one
    edges = cut_lineage(pairs.select(F.col("b_key").alias("node"), F.col("a_key").alias("earlier")))
    keepers = _leaders(ranked.select(F.col("_at").alias("node")), edges)
    summary = ranked.join(keepers.withColumnRenamed("node", "_at"), "_at").select(digest, "keeper", "_n")
    return lookup_by_key(hashes.filter(F.col(digest) != 0), summary, digest, "_n", F.col(key)).select(key, digest, F.col("keeper").alias("keeper_order"))


def _leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, keeper) over ``edges(node, earlier)``."""
    from siftweb.session import cut_lineage

    busy = edges.select("node").distinct()
    state = cut_lineage(nodes.join(busy, "node", "left_anti").select("node", F.col("node").alias("keeper")))
    open_nodes = cut_lineage(busy)
    while not open_nodes.isEmpty():
        seen = edges.join(open_nodes, "node", "left_semi").join(state.withColumnsRenamed({"node": "earlier"}), "earlier", "left")
        status = seen.groupBy("node").agg(
            F.min(F.when(F.col("keeper") == F.col("earlier"), F.col("earlier"))).alias("first_keeper"),
            F.min(F.when(F.col("keeper").isNull(), F.col("earlier"))).alias("first_open"))
        settled = status.filter(F.col("first_open").isNull() | (F.col("first_keeper") < F.col("first_open"))) \
            .select("node", F.coalesce("first_keeper", "node").alias("keeper"))
        state = cut_lineage(state.unionByName(settled))
        open_nodes = cut_lineage(open_nodes.join(state, "node", "left_anti"))
        n, links = RUN, None
        while n and (links is None or links > RUN_LINKS):
            run = cut_lineage(open_nodes.orderBy("node").limit(n))
            near = edges.join(run, "node", "left_semi").join(run.select(F.col("node").alias("earlier")), "earlier", "left_semi")
            links, n = near.count(), n // 2
        if links is None or links > RUN_LINKS:
            continue
        known = edges.join(run, "node", "left_semi").join(state.filter("node = keeper").select(F.col("node").alias("earlier")), "earlier", "left_semi")
        lists = run.join(known.groupBy("node").agg(F.min("earlier").alias("known")), "node", "left").join(
            near.groupBy("node").agg(F.collect_list("earlier").alias("near")), "node", "left")
        done = lists.withColumn("run", F.lit(0)).groupBy("run").applyInArrow(_settle_run, "node long, keeper long")
        state = cut_lineage(state.unionByName(done))
        open_nodes = cut_lineage(open_nodes.join(state, "node", "left_anti"))
    return state
