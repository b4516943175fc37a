import os
import re
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from tallyforge.llm import queries as Q

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_on_the_small_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "123 456", "en", "s", 7)], docs.schema)
    docs = docs.union(extra)
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        path = str(tmp_path / f"{k}-{name}")
        out.write.parquet(path)
        got = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == docs.columns
        sizes.append(got.count())
        docs = got
    total = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert sizes[0] == total and sizes[1] <= sizes[0] and sizes[2] <= sizes[1] and sizes[3] > 0 and sizes[4] == sizes[3]


def test_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_each_operator_has_one_query():
    numbers = sorted(int(re.match(r"op(\d+)_", k)[1]) for k in Q.queries())
    assert numbers == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()


def test_exact_search_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS FROM '/root/testdata/sf0.001/embeddings.parquet'")
    expected = con.execute(Q.OP8_SQL + " ORDER BY 1, 2").fetchall()
    got = Q.op8_exact_topk(spark, "/root/testdata/sf0.001").orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == expected


def test_the_rest_works_without_the_subpackage():
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('tallyforge.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert 'supplier_ranking' in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
