"""Every suite query against its DuckDB form on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from brindle import suite

SF = os.environ.get("BRINDLE_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(df):
    df = df[sorted(df.columns)]
    shown = lambda v: "None" if v is None or v is pd.NA or v is pd.NaT or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) else str(v)
    return list(df.columns), sorted(tuple(shown(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(suite.ORACLES))
def test_oracle(spark, con, name):
    assert rows(suite.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(suite.ORACLES[name]).df())


def test_entry_registers_everything(spark):
    import __spark_entry__ as e

    assert set(suite.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == suite.TOP


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_json_files_stay_bounded(spark):
    from pyspark.sql import functions as F

    files = suite._record_files(spark, "/root/testdata/sf0.1")
    size = F.json_array_length("content")
    most, total = files.agg(F.max(size), F.sum(size)).first()
    assert most <= 500 and total == spark.read.parquet("/root/testdata/sf0.1/events.parquet").count()


def test_ann_recall(spark, tmp_path):
    import numpy as np
    from pyspark.sql import functions as F

    from brindle.operators import ivfpq
    from brindle.operators.search import knn

    r = np.random.default_rng(0)
    centres = r.standard_normal((20, 32))
    x = (centres[r.integers(0, 20, 1200)] + 0.3 * r.standard_normal((1200, 32))).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").cache()
    assert ivfpq.build(df, str(tmp_path / "ix"))
    hit = 0
    for q in range(5):
        exact = {a.id for a in knn(df, x[q].tolist(), 10).select("id").collect()}
        hit += len(exact & {a.id for a in ivfpq.search(spark, str(tmp_path / "ix"), x[q].tolist(), 10).collect()})
    assert hit >= 45
    assert not ivfpq.build(df.limit(100), str(tmp_path / "few"))
    assert ivfpq.sizing(10_000, 64) == (100, 8) and ivfpq.sizing(100_000, 768) == (256, 16) and ivfpq.sizing(256, 64) is None


def test_files_of_an_ingest_make_no_paragraph_longer(spark, tmp_path):
    """A thread that fills a chunk to its last character is one chunk (F1: the file's line feed made two of it)."""
    turns = [(1, 0, "user", "a" * 500), (1, 1, "assistant", "b" * 500), (2, 0, "user", "c" * 1200), (2, 1, "assistant", "d" * 10), (3, 0, "user", "e" * 501), (3, 1, "user", "f" * 500)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    chunks = suite.text_chunks(spark, str(tmp_path)).count()
    assert chunks == 5 and [tuple(r) for r in suite.ingest_twice(spark, str(tmp_path)).collect()] == [(chunks, 0, chunks)]


def test_thread_files_are_written_whole_by_tasks(spark, tmp_path):
    """One file for each thread and nothing beside it, without a writer of partitions (F7)."""
    turns = [(k, t, "user", f"text {k} {t} é") for k in range(50) for t in range(2)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    folder = "/" + suite._thread_files(spark, str(tmp_path)).removeprefix("file:").lstrip("/")
    held = {os.path.relpath(os.path.join(d, n), folder): open(os.path.join(d, n), encoding="utf-8").read() for d, _, names in os.walk(folder) for n in names}
    assert held == {f"name=conv{k}/thread.txt": f"text {k} 0 é\n\ntext {k} 1 é\n" for k in range(50)}
