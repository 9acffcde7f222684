"""Partials that merge in any order, and pages sought by cursor."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brindle.operators import rollup, rollup_state
from brindle.operators.store import Manifests

AS_OF = "2024-01-31"
SHAPE = "id long, fingerprint_id string, sanitized_sql string, sample_sql string, db string, query_time_sec double, ts timestamp_ntz, tables array<string>, user string, host string, rows_sent long, rows_examined long, lock_time_sec double, batch_id string"


def logs(spark, n=600, seed=1):
    r = random.Random(seed)
    start = datetime(2024, 1, 10)
    some = lambda x: x if r.random() < 0.6 else None
    rows = []
    for k in range(n):
        # instants of midnight and equal times among them
        ts = start + timedelta(days=r.randint(0, 25)) + (timedelta(0) if r.random() < 0.3 else timedelta(seconds=r.randint(0, 86_399), microseconds=r.choice((0, 1, 999_999))))
        rows.append((k, f"fp{k % 7}", some(f"s{k}"), some(f"x{k}"), some("d"), r.randint(1, 64) / 8, ts, some([f"t{k}"]), some("u"), some("h"), some(k), some(k % 5), some(0.5), some(f"b{k % 2}")))
    return spark.createDataFrame(rows + [(9999, "fp0", "s", "x", "d", 1.0, None, None, None, None, 1, 1, 1.0, "b0")], SHAPE)


def day():
    return F.lit(AS_OF).cast("date")


def shown(df):
    return [tuple(r) for r in df.collect()]


def test_partials_in_any_order_equal_the_rollup_of_the_logs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rollup_state, "MOST_PARTS", 3)
    every = logs(spark).cache()
    state = rollup_state.RollupState(spark, str(tmp_path / "s"), "id")
    with pytest.raises(ValueError):
        state.rollup(day())
    for k in (4, 2, 0, 3, 1):
        assert state.add(every.where(F.pmod(F.xxhash64("id"), F.lit(5)) == k), ingest=f"i{k}")
    assert not state.add(every, ingest="i3") and len(state._held()) <= 4
    for how in ({}, {"batch_id": "b1"}, {"days": 3}, {"cap": 2}, {"cap": None, "days": 100}):
        assert shown(state.rollup(day(), **how)) == shown(rollup.fingerprint_rollup(every, day(), tiebreak="id", **how))


def test_a_broken_off_fold_counts_nothing(spark, tmp_path, monkeypatch):
    every = logs(spark, 50)
    state = rollup_state.RollupState(spark, str(tmp_path / "s"), "id")
    state.add(every.where("id < 25"), ingest="a")
    with monkeypatch.context() as m:
        m.setattr(Manifests, "_put", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            state.add(every.where("id >= 25"), ingest="b")
    assert state.add(every.where("id >= 25"), ingest="b")
    assert shown(state.rollup(day())) == shown(rollup.fingerprint_rollup(every, day(), tiebreak="id"))


def test_a_stream_that_is_tried_again_counts_once(spark, tmp_path):
    every = logs(spark, 200).cache()
    state = rollup_state.RollupState(spark, str(tmp_path / "s"), "id")
    for k, some in enumerate((every.where("id >= 100"), every.where("id < 100"))):  # the second brings late rows
        some.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(every.schema).parquet(str(tmp_path / "in"))
        state.follow(stream, str(tmp_path / "cp"), once=True).awaitTermination(120)
    # the same micro-batches once more, as after a lost checkpoint of their end
    assert not state.add(every, ingest="stream-0") and not state.add(every, ingest="stream-1")
    assert shown(state.rollup(day())) == shown(rollup.fingerprint_rollup(every.where("ts is not null"), day(), tiebreak="id"))


def test_pages_read_their_files_alone(spark, tmp_path):
    r = random.Random(3)
    rows = [(f"q{k}", float(r.randint(0, 30)), k) for k in range(500)]
    whole = spark.createDataFrame(rows, "id string, execution_time_ms double, calls long")
    want = sorted(rows, key=lambda x: (-x[1], x[0]))
    path = str(tmp_path / "p")
    rollup_state.store_pages(whole, path, rows_per_file=50)
    n_files = spark.read.parquet(f"{path}/files").count()
    assert n_files > 5
    for limit in (7, 50, 130, 499, 500, 600):
        got, cursor, reads = [], None, []
        while True:
            page, cursor = rollup_state.seek_page(spark, path, limit, cursor)
            got += [tuple(x) for x in page.select("id", "execution_time_ms", "calls").collect()]
            reads.append(len(page.inputFiles()))
            if cursor is None:
                break
        assert got == want and len(reads) == -(-500 // limit)
        if limit == 7:
            assert max(reads) <= 2 and sum(x == 1 for x in reads) > 0.7 * len(reads)
    assert rollup_state.read_cursor(rollup_state.cursor_of(1.5, "ü,\n")) == (1.5, "ü,\n")
    for bad in ("", "x", "bm9wZQ==", "WzFd"):
        with pytest.raises(ValueError):
            rollup_state.read_cursor(bad)
    rollup_state.store_pages(whole.where("false"), str(tmp_path / "e"))
    page, cursor = rollup_state.seek_page(spark, str(tmp_path / "e"), 5)
    assert page.count() == 0 and cursor is None
