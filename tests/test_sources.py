"""Embedded files that take filters, and records over HTTP in streams that resume."""

import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, Not, StringContains

from brindle.plans.config import Engine, Settings
from brindle.plans.engine import RetrievalEngine
from brindle.sources import duckfile, http_api
from brindle.streaming.ingest import into_vault


def write_log(path, numbers, extra=""):
    con = duckdb.connect(str(path))
    con.execute(f"""CREATE TABLE slow_logs AS SELECT range AS id, 'fp' || (range % 5) AS fingerprint_id, 'q' AS sanitized_sql, 'raw' AS sample_sql, 'db' AS db, 0.5 AS query_time_sec,
      TIMESTAMP '2024-01-01' + INTERVAL (range) HOUR AS ts, ['t'] AS "tables", 'u' AS "user", NULL::VARCHAR AS host, range::UBIGINT AS rows_sent, range AS rows_examined, 0.1 AS lock_time_sec, 'b' || (range % 2) AS batch_id{extra}
      FROM range({numbers[0]}, {numbers[1]})""")
    con.close()
    return str(path)


def test_filters_are_told_by_the_files_own_engine(spark, tmp_path):
    path = write_log(tmp_path / "a.duckdb", (0, 500))
    rows = duckfile.read_table(spark, path, "slow_logs", ["id", "ts", "batch_id"])
    reader = duckfile._Reader({"files": json.dumps([[path, 499]]), "table": "slow_logs", "pushable": '["id", "ts", "batch_id"]'}, rows.schema)
    filters = [GreaterThan(("ts",), datetime(2024, 1, 10)), EqualTo(("batch_id",), "b1"), IsNotNull(("id",)), In(("id",), (301, 303, 305, 8)), Not(EqualTo(("id",), 303)), StringContains(("batch_id",), "b")]
    assert list(reader.pushFilters(filters)) == filters[4:]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3  # rows that enter Spark
    for where, n in (("ts > TIMESTAMP_NTZ '2024-01-10 00:00:00' AND batch_id = 'b1'", 142), ("id IN (1, 2) OR id = 7", 3), ("batch_id LIKE 'b1%' AND id < 10", 5), ("id <=> 4", 1), ("ts IS NULL", 0)):
        assert rows.where(where).count() == n
    assert rows.count() == 500
    only = duckfile.scan(spark, [path], table="slow_logs", columns=["ts", "batch_id"], pushable=("batch_id",)).where("batch_id = 'b1' AND ts IS NOT NULL")
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "Filter isnotnull(ts" in plan and "batch_id" not in plan.split("Filter isnotnull(ts")[1].split("\n")[0] and only.count() == 250  # the other is told by the file
    day = F.lit("2024-01-20").cast("date")
    want = duckfile.fingerprint_rollup(duckfile.read_table(spark, path, "slow_logs"), day, batch_id="b1", tiebreak="id").collect()
    assert duckfile.read_duckfile(spark, path, as_of="2024-01-20", batch_id="b1", tiebreak="id").collect() == want and want


def test_many_files_are_one_scan(spark, tmp_path):
    paths = [write_log(tmp_path / f"f{k}.duckdb", (10 * k, 10 * k + 10)) for k in range(6)]
    other = write_log(tmp_path / "g.duckdb", (100, 105), ", 7 AS more")
    (tmp_path / "h.duckdb").write_text("this is no database")
    every = duckfile.scan(spark, [*paths, other, str(tmp_path / "h.duckdb")], table="slow_logs", skip_broken=True)
    assert every.count() == 65 and every.where("more = 7").count() == 5
    assert every._jdf.queryExecution().executedPlan().toString().count("BatchScan") == 2  # one for each set of columns
    with pytest.raises(ValueError, match="h.duckdb"):
        duckfile.read_table(spark, [*paths, str(tmp_path / "h.duckdb")], "slow_logs")
    assert duckfile.scan(spark, [], table="slow_logs") is None
    # each file has a rollup of its own in the engine, and a broken one is left out
    engine = RetrievalEngine(spark, Engine(vector_dimension=8, mapper_type="sql", chunker_type="duckdb", table_name="d"), Settings(db_path=str(tmp_path / "db")))
    chunks = engine.chunks(str(tmp_path), "SELECT fingerprint_id AS id, any_value(sanitized_sql) AS text, any_value(db) AS source, any_value(sample_sql) AS raw_query, sum(query_time_sec) AS execution_time_ms, count(*) AS calls FROM slow_logs GROUP BY 1")
    assert chunks.count() == 35 and chunks.agg(F.sum("calls")).first()[0] == 65
    with pytest.raises(ValueError, match="must give"):
        engine.chunks(str(tmp_path), "SELECT 1 AS id")


class Server(BaseHTTPRequestHandler):
    rows: list = []
    broken = 0

    def do_GET(self):  # noqa: N802
        if Server.broken > 0 and "cursor" in self.path:
            Server.broken -= 1
            return self.send_error(503)
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        if self.path == "/sql/databases":
            body = {"databases": ["d0", "d1", "d2"]}
        else:
            rows = [r for r in Server.rows if q.get("database", r["source"]) == r["source"]]
            a, n = int(q.get("cursor", 0)), int(q["limit"])
            body = {"data": rows[a : a + n], "has_more": a + n < len(rows)} | ({"next_cursor": str(a + n)} if a + n < len(rows) else {})
        raw = json.dumps(body).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *a):
        pass


@pytest.fixture
def server():
    Server.rows, Server.broken = record_range(0, 25), 0
    s = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def record_range(a, b):
    return [{"id": f"q{i}", "text": f"SELECT {i}", "source": f"d{i % 3}", "execution_time_ms": 1.0, "calls": 1, "latest_ts": "2024-01-01T00:00:00Z"} for i in range(a, b)]


def test_a_partition_for_each_database(spark, server):
    rows = http_api.read_http(spark, server, page_size=4, by_database="true")
    assert rows.rdd.getNumPartitions() == 3 and sorted(r.id for r in rows.collect()) == sorted(r["id"] for r in Server.rows)
    assert http_api.read_http(spark, "http://127.0.0.1:9", by_database="true").count() == 0


def test_a_stream_resumes_behind_its_cursor(spark, server, tmp_path):
    got, batches = [], []

    def take(df, number):
        found = [r.id for r in df.select("id").collect()]
        batches.append((number, len(found)))
        got.extend(found)

    def run():
        stream = http_api.stream_http(spark, server, page_size=4, pages_per_batch=2, since="2024-01-01T00:00:00Z")
        query = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run()
    assert got == [f"q{k}" for k in range(25)] and max(n for _, n in batches) <= 8
    Server.rows = record_range(0, 31)  # the last page grows, and others follow
    Server.broken = 1
    with pytest.raises(Exception, match="503"):
        run()
    run()
    assert got == [f"q{k}" for k in range(31)]


def test_offsets_read_the_same_again(server):
    s = http_api._Stream({"path": server, "page_size": "4", "pages_per_batch": "3", "since": "2024-01-01T00:00:00Z"})
    at, steps = s.initialOffset(), []
    for _ in range(6):
        rows, after = s.read(at)
        steps.append((at, after, list(rows)))
        at = after
    assert [len(x) for *_, x in steps] == [12, 12, 1, 0, 0, 0]
    Server.rows = record_range(0, 40)
    for start, end, rows in steps:
        assert list(s.readBetweenOffsets(start, end)) == rows
    rows, _ = s.read(at)
    assert [r[0] for r in rows][:4] == ["q25", "q26", "q27", "q28"]


def test_micro_batches_come_into_a_vault_once(spark, tmp_path):
    from brindle.streaming.ingest import watch_records

    engine = RetrievalEngine(spark, Engine(vector_dimension=8, mapper_type="sql", chunker_type="sql", table_name="s"), Settings(db_path=str(tmp_path / "db")))
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps({"query": f"SELECT {k}{j}"}) + "\n" for j in range(5)))
        into_vault(watch_records(spark, str(tmp_path / "in"), "2024-01-01 00:00:00"), lambda df, n: engine.add(df, ingest_id=f"stream-{n}") and None, str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert engine.vault.read().count() == 10 and engine.vault.state()["ingests"] == ["stream-0", "stream-1"]
