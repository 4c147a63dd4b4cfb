"""Exports as CSV, JSON lines and Markdown tables. Each task writes its own part file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftweb.functions import urls

# --- fixed values: media columns and their headings
MEDIA_FIELDS = {"url": "资源URL", "kind": "类型", "album": "合集", "index": "序号", "width": "宽", "height": "高",
                "duration": "时长(秒)", "size": "大小(字节)", "origin": "来源", "source_page": "来源页", "referer": "Referer"}
CELL_CHARS = 200


def crawl_rows(pages: DataFrame, fields: Sequence[str] = ("url", "domain", "text")) -> DataFrame:
    made = {"url": F.col("url"), "domain": urls.url_domain(F.col("url")), "text": F.coalesce("text", F.lit(""))}
    return pages.select(*[made[f].alias(f) for f in fields if f in made])


def referer(headers: str = "headers", fallback: str = "source_page") -> Column:
    named = F.map_values(F.map_filter(F.col(headers), lambda k, v: F.lower(k) == "referer"))
    return F.coalesce(F.nullif(F.get(named, F.lit(0)), F.lit("")), F.col(fallback), F.lit(""))


def media_rows(items: DataFrame, fields: Sequence[str] = tuple(MEDIA_FIELDS)) -> DataFrame:
    made = items
    if "headers" in items.columns:
        made = made.withColumn("referer", referer())
    elif "referer" not in items.columns:
        made = made.withColumn("referer", F.coalesce("source_page", F.lit("")))
    if "index" not in made.columns:
        made = made.withColumn("index", F.coalesce("seq", F.lit(0)) if "seq" in made.columns else F.lit(0))
    return made.select(*[(F.col(f) if f in made.columns else F.lit("")).alias(f) for f in fields])


def markdown_cell(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    cut = F.when(F.length(text) > CELL_CHARS, F.concat(F.left(text, F.lit(CELL_CHARS)), F.lit("…"))).otherwise(text)
    return F.replace(F.replace(cut, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def markdown_lines(rows: DataFrame) -> DataFrame:
    cells = F.array_join(F.array(*[markdown_cell(F.col(c)) for c in rows.columns]), " | ")
    return rows.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("value"))


def markdown_head(names: Sequence[str]) -> str:
    return "| " + " | ".join(names) + " |\n|" + "|".join(["---"] * len(names)) + "|"


def write_rows(rows: DataFrame, path: str, fmt: str = "csv", labels: dict | None = None) -> None:
    """Write ``rows`` to a folder; Markdown parts hold table lines, the head goes to its own file."""
    names = [(labels or {}).get(c, c) for c in rows.columns]
    if fmt == "json":
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    elif fmt == "markdown":
        markdown_lines(rows).write.mode("overwrite").text(path)
        rows.sparkSession.createDataFrame([(markdown_head(names),)], "value string").write.mode("overwrite").text(f"{path}_head")
    else:
        rows.toDF(*names).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def export_crawl(pages: DataFrame, path: str, fmt: str = "csv", fields: Sequence[str] = ("url", "domain", "text")) -> None:
    write_rows(crawl_rows(pages, fields), path, fmt)


def export_media(items: DataFrame, path: str, fmt: str = "csv", fields: Sequence[str] = tuple(MEDIA_FIELDS)) -> None:
    write_rows(media_rows(items, fields), path, fmt, None if fmt == "json" else MEDIA_FIELDS)


def task_lines(results: DataFrame, exported_at: str) -> DataFrame:
    """The lines of one JSON document {exported_at, count, tasks} with their order (part, at): opening, tasks, end."""
    from siftweb.session import cut_lineage

    # numbered and checkpointed, so that repeated rows differ and keep their places
    each = cut_lineage(results.select(F.struct("task_id", "url", F.monotonically_increasing_id().alias("n")).alias("at"),
                                      F.to_json(F.struct(*results.columns)).alias("line")))
    figures = each.agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least"))
    comma = F.when(F.col("at") == figures.select("least").scalar(), F.lit("")).otherwise(F.lit(","))
    tasks = each.select(F.lit(1).alias("part"), "at", F.concat(comma, "line").alias("value"))
    head = F.regexp_replace(F.to_json(F.struct(F.lit(exported_at).alias("exported_at"), F.col("n").alias("count"))), r"\}$", ', "tasks": [')
    frame = F.array(F.struct(F.lit(0).alias("part"), head.alias("value")), F.struct(F.lit(2).alias("part"), F.lit("]}").alias("value")))
    ends = figures.select(F.explode(frame).alias("e")).select("e.part", F.lit(None).cast(dict(each.dtypes)["at"]).alias("at"), "e.value")
    return tasks.unionByName(ends)


def export_tasks(results: DataFrame, path: str, fmt: str = "json", exported_at: str | None = None) -> None:
    """Task outputs (task_id, task_name, url, text); Markdown shows the text's length only.

    JSON with ``exported_at`` is one document {exported_at, count, tasks}, the part files one after the other; without it one object per line.
    """
    if fmt == "json" and exported_at is not None:
        task_lines(results, exported_at).repartitionByRange("part", "at").sortWithinPartitions("part", "at").select("value").write.mode("overwrite").text(path)
        return
    if fmt == "markdown":
        results = results.select("task_id", "task_name", "url", F.length("text").alias("chars"))
    write_rows(results, path, fmt)


def write_manifest(lines: DataFrame, filtered: DataFrame, path: str) -> None:
    """Manifest text: a line pair per file, then the addresses dropped for quality."""
    good = lines.select(F.lit(0).alias("part"), F.col("path").alias("at"), F.col("line").alias("value"))
    bad = filtered.select(F.lit(1).alias("part"), F.col("url").alias("at"), F.concat(F.lit("  "), "url").alias("value"))
    good.unionByName(bad).repartitionByRange("part", "at").sortWithinPartitions("part", "at").select("value").write.mode("overwrite").text(path)


def write_reports(reports: DataFrame, path: str, fmt: str = "json") -> None:
    from siftweb.operators.policy import report_markdown

    if fmt == "markdown":
        report_markdown(reports).write.mode("overwrite").partitionBy("site").text(path)
    else:
        reports.select(F.col("site"), F.to_json(F.struct(*reports.columns)).alias("value")).write.mode("overwrite").partitionBy("site").text(path)
