"""The pipeline's stages and its registered query, and that the rest doesn't need them."""

import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from compare import compare, connect
from siftweb.llm import catalog

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@needs_tables
def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, frame = docs.count(), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, FOLDER)
        assert frame.columns == docs.columns
        rows = frame.collect()
        assert 0 < len(rows) <= before and len({r["doc_id"] for r in rows}) == len(rows)
        before = len(rows)
        frame = spark.createDataFrame(rows, docs.schema)
    kept = {r["doc_id"] for r in frame.select("doc_id").collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, frame, FOLDER).collect()
    assert {r["doc_id"] for r in last} == kept
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, last))


@needs_tables
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_queries_with_sql(spark, name):
    problem, _ = compare(catalog.QUERIES[name](spark, FOLDER), connect(FOLDER), catalog.SQL[name])
    assert not problem


@needs_tables
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_queries_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() >= 0


def test_the_rest_works_alone(tmp_path):
    (tmp_path / "siftweb").mkdir()
    for child in (ROOT / "siftweb").iterdir():
        if child.name not in ("llm", "__pycache__"):
            (tmp_path / "siftweb" / child.name).symlink_to(child)
    (tmp_path / "entry.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import entry; q = entry.queries(); assert len(q) >= 100 and 'pipeline' not in q and not any(k.startswith('op3') for k in q); assert set(entry.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)})
