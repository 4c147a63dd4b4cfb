"""Site rules, filter settings and task queues from JSON files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftweb.functions import arrow, urls
from siftweb.scale import unnest

_SPEC = "struct<selector:string,attr:string,kind:string,require:string,upgrade:array<array<string>>>"
RULE = ("id string, name string, enabled boolean, priority int, match struct<domain:array<string>,url_regex:string,exclude_url_regex:string>, "
        f"headers map<string,string>, pagination struct<strategy:string,template:string,param:string,start:int,step:int,max_pages:int>, "
        f"media array<{_SPEC}>, regex array<struct<pattern:string,`group`:int,kind:string,ignore_case:boolean>>, "
        "detail_links struct<selector:string,attr:string,pattern:string>, album struct<selector:string,attr:string>")


def read_site_rules(spark: SparkSession, folders: Sequence[str], drop_empty: bool = True) -> DataFrame:
    """Rules of all folders, one per id, the first folder's winning; a missing id is the file's stem."""
    out = None
    for rank, folder in enumerate(folders):
        rows = (spark.read.schema(RULE).option("multiLine", "true").option("pathGlobFilter", "[!_]*.json").json(folder)
                .withColumn("_file", F.col("_metadata.file_name")).withColumn("_rank", F.lit(rank)))
        out = rows if out is None else out.unionByName(rows)
    stem = F.regexp_replace("_file", r"\.json$", "")
    named = (out.withColumn("id", F.coalesce(F.nullif(F.trim("id"), F.lit("")), stem))
             .withColumn("enabled", F.coalesce("enabled", F.lit(True)))
             .withColumn("priority", F.coalesce(F.nullif("priority", F.lit(0)), F.lit(50))))
    order = Window.partitionBy("id").orderBy("_rank", "_file")
    # ids are file stems: one short group each
    first = named.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == 1).drop("_n", "_rank", "_file")
    if not drop_empty:
        return first
    any_list = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return first.filter(any_list("media") | any_list("regex") | F.col("detail_links.selector").isNotNull() | F.col("pagination").isNotNull()).orderBy("priority", "id")


def validate_rules(rules: DataFrame) -> DataFrame:
    """One row per violated constraint: id and problem."""
    checked = (rules.withColumn("_url", arrow.regex_problem(F.col("match.url_regex")))
               .withColumn("_exclude", arrow.regex_problem(F.col("match.exclude_url_regex"))))
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    strategy = F.coalesce(F.nullif("pagination.strategy", F.lit("")), F.lit("auto"))
    problems = F.array(
        F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "缺少 id"),
        F.when(~has("match.domain") & (F.coalesce("match.url_regex", F.lit("")) == ""), "match 至少需要 domain 或 url_regex 之一"),
        F.when(F.col("_url") != "", F.concat(F.lit("url_regex 正则非法："), "_url")),
        F.when(F.col("_exclude") != "", F.concat(F.lit("exclude_url_regex 正则非法："), "_exclude")),
        F.when(~has("media") & ~has("regex") & F.col("detail_links").isNull() & F.col("pagination").isNull(),
               "至少需要 media / regex / detail_links / pagination 之一"),
        F.when(~strategy.isin("auto", "next_link", "page_param", "api_offset"), F.concat(F.lit("pagination.strategy 非法："), strategy)),
        F.when((strategy == "api_offset") & (F.coalesce("pagination.template", F.lit("")) == ""), "pagination.strategy=api_offset 需要 template"))
    media = F.transform(F.coalesce("media", F.array().cast(rules.schema["media"].dataType)), lambda m, i: F.when(
        F.coalesce(m["selector"], F.lit("")) == "", F.concat(F.lit("media["), i.cast("string"), F.lit("] 缺少 selector"))))
    base = unnest(checked, ["id"], F.filter(F.concat(problems, media), lambda p: p.isNotNull()), "problem").drop("_pos")
    specs = unnest(rules, ["id"], "regex", "s", "i").withColumn("_bad", arrow.regex_problem(F.col("s.pattern")))
    at = F.concat(F.lit("regex["), F.col("i").cast("string"), F.lit("] "))
    broken = specs.select("id", F.when(F.coalesce("s.pattern", F.lit("")) == "", F.concat(at, F.lit("缺少 pattern")))
                          .when(F.col("_bad") != "", F.concat(at, F.lit("正则非法："), "_bad")).alias("problem")).filter("problem is not null")
    return base.unionByName(broken)


FILTER = "block_patterns array<string>, allow_domains array<string>"


def read_filter_config(spark: SparkSession, path: str) -> DataFrame:
    """Rows (kind, value): usable block patterns in order and normalised allowed domains.

    A file whose entries are no lists is an error.
    """
    raw = spark.read.schema(FILTER).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    block = unnest(raw, [], "block_patterns", "value", "pos").select(F.lit("block").alias("kind"), "pos", F.trim("value").alias("value"))
    block = block.filter((F.col("value") != "") & (arrow.regex_problem(F.col("value")) == "")).groupBy("kind", "value").agg(F.min("pos").alias("pos"))
    allow = unnest(raw, [], "allow_domains", "value", "pos").select(urls.normalize_domain(F.col("value")).alias("value")).filter("value <> ''").distinct()
    return block.select("kind", "value", "pos").unionByName(allow.select(F.lit("allow").alias("kind"), "value", F.lit(0).alias("pos"))).orderBy("kind", "pos", "value")


def write_filter_config(rows: DataFrame, path: str) -> None:
    pick = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", "value")))), lambda s: s["value"])
    rows.agg(pick("block").alias("block_patterns"), pick("allow").alias("allow_domains")).write.mode("overwrite").json(path)


_CONFIG = ("struct<task_name:string,start_url:string,max_depth:int,crawl_external:boolean,request_delay:double,max_chars_per_page:int,link_filter:string,"
           "jitter:double,max_pages:int,max_retries:int,robots_check:boolean,priority:int,depends_on:array<bigint>,block_patterns:array<string>,allow_domains:array<string>>")
QUEUE = f"version int, saved_at string, tasks array<struct<config:{_CONFIG},status:string,retry_count:int,crawler_task_id:bigint,created_at:string,error:string>>"
# --- fixed values: defaults of a task
TASK_DEFAULTS = {"task_name": "", "start_url": "", "max_depth": 1, "crawl_external": False, "request_delay": 0.5, "max_chars_per_page": 0, "link_filter": "",
                 "jitter": 0.3, "max_pages": 0, "max_retries": 2, "robots_check": True, "priority": 1}


def read_task_queue(spark: SparkSession, path: str) -> DataFrame:
    """Saved tasks with typed defaults, waiting again; entries without a usable address are dropped."""
    raw = spark.read.schema(QUEUE).option("multiLine", "true").json(path)
    rows = unnest(raw, [], "tasks", "t", "pos")
    empty = F.array()
    fields = [F.coalesce(F.col(f"t.config.{n}"), F.lit(v)).alias(n) for n, v in TASK_DEFAULTS.items()]
    lists = [F.coalesce(F.col(f"t.config.{n}"), empty.cast(k)).alias(n) for n, k in (
        ("depends_on", "array<bigint>"), ("block_patterns", "array<string>"), ("allow_domains", "array<string>"))]
    out = rows.select("pos", *fields, *lists, F.lit("pending").alias("status"), F.coalesce("t.retry_count", F.lit(0)).alias("retry_count"),
                      F.coalesce("t.error", F.lit("")).alias("error"), F.col("t.crawler_task_id").alias("crawler_task_id"))
    out = out.filter(urls.is_http_url(F.col("start_url")))
    return out.withColumn("name", F.when(F.col("task_name") != "", F.col("task_name")).otherwise(urls.url_domain(F.col("start_url")))).orderBy("pos")


def write_task_queue(tasks: DataFrame, path: str, saved_at: str) -> None:
    """Unfinished tasks; running and paused ones are saved as pending."""
    open_tasks = tasks.filter(F.col("status").isin("pending", "running", "paused"))
    config = F.struct(*[c for c in [*TASK_DEFAULTS, "depends_on", "block_patterns", "allow_domains"] if c in tasks.columns])
    row = F.struct(F.col("pos"), F.struct(config.alias("config"), F.lit("pending").alias("status"), "retry_count", "error").alias("task"))
    (open_tasks.agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["task"]).alias("tasks"))
     .select(F.lit(1).alias("version"), F.lit(saved_at).alias("saved_at"), "tasks").write.mode("overwrite").json(path))
