import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harrow.llm import queries
from harrow.llm.common import written

TABLES = "documents embeddings conversations".split()


def odd_documents(spark, data):
    """Documents with rows of every odd kind, and columns named like those that operators make."""
    real = spark.read.parquet(f"{data}/documents.parquet")
    odd = [(None, "a b c d e f g", "en", "s", None), (-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "½ ² Ⅷ 12", "en", "s", 9), (-4, None, "es", "s", 3), (-5, "x" * 300_000, "en", "s", 300_000), (-6, "\x00\t", None, "s", 2)]
    docs = real.union(spark.createDataFrame(odd + odd[:3], real.schema))
    return docs.select("*", F.lit(7.0).alias("score"), F.lit("mine").alias("lang_pred"), F.lit(9).alias("predicted"), F.lit("r").alias("row"), F.lit(1).alias("sig"), F.lit(2).alias("n"), F.lit(3).alias("component_id"), F.lit(4).alias("length"))


def test_stages_on_odd_rows(spark, data):
    docs = before = odd_documents(spark, data)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, data), name)
        assert docs.columns == columns and docs.dtypes == before.dtypes
        assert docs.where("score <> 7 or lang_pred <> 'mine' or predicted <> 9 or row <> 'r' or sig <> 1 or n <> 2 or component_id <> 3 or length <> 4").count() == 0
        if name == "language":
            assert docs.where("doc_id in (-1, -2, -3, -4, -6)").count() == 0
    packed = corpus_pipeline.packing(spark, docs, data)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_on_an_empty_table(spark, data):
    none = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, none, data)
        assert found.count() == 0 and (name == "packing" or found.columns == none.columns)


def test_entry_without_the_subpackage(tmp_path):
    """The entry point imports, and has the engine's queries, when the folders and corpus_pipeline.py are gone."""
    root = Path(corpus_pipeline.__file__).parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "harrow", tmp_path / "harrow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q2_hash' in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        if name != "packing":
            assert docs.columns == columns
            counts.append(docs.count())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "secrets", "packing"]
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] / 2 and counts[3] == counts[4]
    assert docs.select("doc_id").distinct().count() == counts[-1] and docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_same_rows_as_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    ours = queries.QUERIES[name](spark, data)
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    want = sorted(tuple(dict(zip(columns, r, strict=True))[c] for c in ours.columns) for r in found.fetchall())
    assert sorted(map(tuple, ours.collect())) == want


@pytest.mark.parametrize("name", queries.QUERIES)
def test_every_query_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0
