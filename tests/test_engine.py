import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.edge import api, cli, conformance, report
from brindle.functions.embedding import embed_query, hashing_embedder
from brindle.operators import records, store
from brindle.plans.config import Engine, Settings, load
from brindle.plans.engine import RetrievalEngine
from brindle.sources import files
from brindle.sources.duckfile import read_duckfile
from brindle.sources.http_api import read_http


@pytest.fixture
def engine(spark, tmp_path):
    return RetrievalEngine(spark, Engine(vector_dimension=32, chunk_max_chars=200), Settings(db_path=str(tmp_path / "db")))


def test_ingest_is_idempotent_and_search_finds(engine, tmp_path, spark):
    src = tmp_path / "docs"
    (src / "sub").mkdir(parents=True)
    (src / "a.md").write_text("# Cats\n\nCats sleep all day long.\n\n```\ncode stays whole\n```\n")
    (src / "sub" / "b.txt").write_bytes(b"Dogs bark at night.\r\n\r\nThey run far.")
    (src / "_c.txt").write_text("Hidden names count too.")
    (src / "bad.txt").write_bytes(b"\xff\xfe")
    assert engine.ingest(str(src)) == 4
    assert engine.ingest(str(src)) == 0
    found = engine.search("cats sleep", 2)
    assert "Cats" in found[0]["text"] and found[0]["score"] == found[0]["distance"] and "vector" not in found[0]
    assert engine.search("dogs", 5, source="no such") == []
    assert all(r["source"].endswith("b.txt") for r in engine.search("cats", 5, source=found[0]["source"].replace("a.md", "sub/b.txt")))
    assert engine.ingest(str(src), rebuild=True) == 4
    status, body = api.search({"md": engine}, "document", {"query": "dogs", "limit": 1})
    assert status == 200 and body["total_results"] == 1 and "chunk" in body["results"][0]
    assert api.search({"md": engine}, "document", {"query": "x", "limit": 101})[0] == 422 and api.search({}, "sql", {"query": "x"})[0] == 503
    assert api.search({"md": engine}, "document", {"query": " "})[0] == 500
    assert api.health({})[0] == 503 and api.health({"md": engine})[1]["md_model"] == "hashing"
    assert "Found 1 results" in api.tool_search({"md": engine}, "document", "dogs", 1)
    with pytest.raises(store.SchemaMismatch):
        store.Vault(spark, f"{engine.root}/vault", "sql", 32)
    with pytest.raises(store.SchemaMismatch):
        store.Vault(spark, f"{engine.root}/vault", "document", 16)


def test_json_engine_and_min_time(spark, tmp_path):
    e = RetrievalEngine(spark, Engine(vector_dimension=16, mapper_type="sql", chunker_type="sql", table_name="q"), Settings(db_path=str(tmp_path / "db")))
    rows = [{"query": "SELECT 1", "duration": 5, "calls": 0}, {"query": " "}, {"query": None}, {"query": "SELECT '2'", "query_hash": "h", "database": "d", "duration": "900", "calls": "4"}]
    (tmp_path / "q.json").write_text(json.dumps(rows))
    (tmp_path / "bad.json").write_text("{")
    assert e.ingest(str(tmp_path / "*.json")) == 2
    assert [r["id"] for r in e.search("select", 5, min_time=100)] == ["h"]
    got = {r["raw_query"]: r for r in e.search("select", 5)}
    assert got["SELECT 1"]["calls"] == 1 and got["SELECT '2'"]["calls"] == 4 and got["SELECT 1"]["source"] == "unknown"
    assert "N/A (FTS Match)" in report.lines([got["SELECT 1"] | {"distance": None}])[1]


def test_record_coercion(spark):
    df = spark.createDataFrame([("1", "t", "s", "2.7", "bad", "2024-01-02T03:04:05Z"), ("2", "u", "s", "x", "3", "2024"), (None, "v", "s", None, None, None)], "id string, text string, source string, rows_sent string, calls string, latest_ts string")
    got = records.project_sql_chunks(records.with_required(df), F.lit("2024-05-05 00:00:00")).orderBy("id").collect()
    assert [r.rows_sent for r in got] == [2, None] and [r.calls for r in got] == [1, 3]
    assert [r.latest_ts for r in got] == [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 5, 5)] and got[0].tables == []


def test_duckfile(spark, tmp_path):
    p = str(tmp_path / "x.duckdb")
    con = duckdb.connect(p)
    con.execute('CREATE TABLE slow_logs (fingerprint_id VARCHAR, sanitized_sql VARCHAR, sample_sql VARCHAR, db VARCHAR, query_time_sec DOUBLE, ts TIMESTAMP, "tables" VARCHAR[], "user" VARCHAR, host VARCHAR, rows_sent UBIGINT, rows_examined BIGINT, lock_time_sec DOUBLE)')
    for fp, sec, user in (("fp1", 1.5, "u"), ("fp1", 2.0, "u"), ("fp2", 0.5, None)):
        con.execute("INSERT INTO slow_logs VALUES (?, 's', 'x', 'd', ?, now()::TIMESTAMP, ['t'], ?, NULL, 1, 2, 0.1)", [fp, sec, user])
    con.close()
    got = records.project_sql_chunks(read_duckfile(spark, p), F.lit("2024-01-01 00:00:00")).orderBy(F.desc("execution_time_ms")).collect()
    assert [(r.id, r.calls, r.execution_time_ms, r.user, r.tables) for r in got] == [("fp1", 2, 3500.0, "u", ["t"]), ("fp2", 1, 500.0, None, ["t"])]
    assert read_duckfile(spark, p, "SELECT 'a' AS id, DATE '2024-01-01' AS latest_ts").first().id == "a"


class Server(BaseHTTPRequestHandler):
    rows = [{"id": f"q{i}", "text": f"SELECT {i}", "source": f"d{i % 2}", "execution_time_ms": 100.0 - i, "calls": 1, "latest_ts": "2024-01-01T00:00:00Z", "tables": ["t"]} for i in range(5)]

    def send(self, status, body):
        raw = json.dumps(body).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(raw)))
        self.send_header("Content-Type", "application/json")
        self.send_header("X-Request-Id", "r1")
        self.end_headers()
        self.wfile.write(raw)

    def allowed(self):
        if self.headers.get("Authorization") == "Bearer k":
            return True
        self.send(401, {"error": "invalid_token", "message": "no"})

    def do_GET(self):  # noqa: N802
        from urllib.parse import parse_qs, urlparse

        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        if self.path == "/health":
            return self.send(200, {"status": "ok", "version": "1", "databases": ["d0", "d1"]})
        if not self.allowed():
            return
        if self.path == "/sql/databases":
            return self.send(200, {"databases": ["d1", "d0"]})
        if not 1 <= int(q["limit"]) <= 1000:
            return self.send(422, {"detail": "limit"})
        rows = [r for r in self.rows if r["execution_time_ms"] >= float(q.get("min_execution_ms", 0)) and q.get("database", r["source"]) == r["source"] and q.get("since", "") < "2900"]
        a = int(q.get("cursor", 0))
        b = a + int(q["limit"])
        self.send(200, {"data": rows[a:b], "has_more": b < len(rows), "total_count": len(rows)} | ({"next_cursor": str(b)} if b < len(rows) else {}))

    def do_POST(self):  # noqa: N802
        if not self.allowed():
            return
        sql = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["query"]
        if ";" in sql or not sql.upper().startswith("SELECT"):
            return self.send(422, {"error": "unsafe_query"})
        self.send(200, {"columns": ["id", "text", "source"], "rows": [["a", "b", "c"], [None, "x", "y"]], "row_count": 2, "truncated": False, "execution_time_ms": 1.5})

    def log_message(self, *a):
        pass


@pytest.fixture
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_http(spark, server):
    assert read_http(spark, server, api_key="k", page_size=2).count() == 5
    assert records.with_required(read_http(spark, server, api_key="k", query="SELECT 1")).count() == 1
    assert read_http(spark, server, api_key="wrong").count() == 0
    found = conformance.run(server, "k")
    assert [name for name, ok, _ in found if not ok] == [] and len({name for name, _, _ in found}) == len(found) > 45
    assert not all(ok for _, ok, _ in conformance.run(server, "wrong"))


def test_config_and_cli(tmp_path, monkeypatch, spark):
    f = tmp_path / "c.yaml"
    f.write_text(f"system:\n  db_path: {tmp_path}/db\n  unknown: 1\nengines:\n  md:\n    vector_dimension: 16\n    chunk_max_chars: 0\n")
    monkeypatch.setenv("BRINDLE_NPROBES", "7")
    s = load(str(f))
    assert s.nprobes == 7 and s.engines["md"].source_options() == {} and s.db_path == f"{tmp_path}/db"
    with pytest.raises(ValueError):
        Engine(mapper_type="other")
    (tmp_path / "a.txt").write_text("A text for the command line.")
    out = []
    assert cli.main(["-c", str(f), "ingest", str(tmp_path / "a.txt")], out=out.append, spark=spark) == 0 and out[-1].startswith("1 ")
    assert cli.main(["-c", str(f), "search", "command line", "-l", "1"], out=out.append, spark=spark) == 0 and "Top Results:" in out
    assert cli.main(["-c", str(f), "ingest", "x", "-r"], ask=lambda _: "n", out=out.append, spark=spark) == 1


def test_embedder_guards():
    e = hashing_embedder(8)
    assert e([]).shape == (0, 8)
    with pytest.raises(ValueError):
        embed_query(e, "  ", 8)
    with pytest.raises(ValueError):
        embed_query(e, "x", 9)


def test_embedder_reads_whole_texts(spark):
    import random
    import zlib

    import numpy as np

    from brindle.functions.embedding import embed_passages

    r = random.Random(2)
    head = [f"w{r.randint(0, 300)}" for _ in range(2048)]
    texts = [" ".join(head + tail) for tail in ([], ["Cat"] * 3000, ["dog\u2003eel"] * 3000, head * 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {x.id: np.array(x.vector) for x in embed_passages(df, lambda: hashing_embedder(16), ("hashing", 16), 16).collect()}
    for k, t in enumerate(texts):
        want = np.zeros(16)
        for w in t.lower().split():
            for f in [w] + [f" {w} "[i : i + n] for n in (3, 4) for i in range(len(w) + 3 - n)]:
                h = zlib.crc32(f.encode())
                want[h % 16] += 1 if h >> 31 else -1
        assert np.allclose(got[k], want / np.linalg.norm(want), atol=1e-6)
    assert not np.allclose(got[0], got[1]) and not np.allclose(got[1], got[2])


def test_token_window(spark, tmp_path):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from brindle.functions.embedding import embed_passages, token_embedder

    file = public_tokenizers.path("word_bpe_49k.json")
    library, vectors = Tokenizer.from_file(file), np.random.default_rng(5).standard_normal((Tokenizer.from_file(file).get_vocab_size(), 8)).astype(np.float32)
    texts = ["a cat sat", "", "word " * 50 + "tail", "word " * 50 + "other end", "it's Ünïcode"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {x.id: np.array(x.vector) for x in embed_passages(df, lambda: token_embedder(file, 8, 20), ("tokens", 8, 20), 8).collect()}
    for k, t in enumerate(texts):
        want = sum((vectors[i] for i in library.encode(t, add_special_tokens=False).ids[:20]), np.zeros(8, np.float32))
        norm = np.linalg.norm(want)
        assert np.allclose(got[k], want / norm if norm else want, atol=1e-5)
    assert np.allclose(got[2], got[3])  # alike within the window
    e = RetrievalEngine(spark, Engine(table_name="w", vector_dimension=16, max_token_length=64), Settings(db_path=str(tmp_path / "db"), tokenizer_file=file))
    (tmp_path / "a.txt").write_text("otters swim in rivers")
    assert e.ingest(str(tmp_path / "a.txt")) == 1 and e.search("otters", 1)[0]["distance"] < 1


def test_stream(spark, tmp_path):
    from brindle.streaming.ingest import into_vault, watch_records

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"query": "SELECT 1"}\n{"query": ""}\n')
    got = []
    into_vault(watch_records(spark, str(tmp_path / "in"), "2024-01-01 00:00:00"), lambda df, _: got.append(df.count()), str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert got == [1]


def test_find(tmp_path):
    (tmp_path / "x.log").write_text("1")
    assert files.find(str(tmp_path), (".md",)) == [] and len(files.find(str(tmp_path / "*.log"), (".md",))) == 1


def test_mcp(engine, tmp_path):
    import json

    from brindle.edge import mcp

    (tmp_path / "m.txt").write_text("otters swim in rivers all day")
    engine.ingest(str(tmp_path / "m.txt"))
    ask = lambda method, **p: json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": p})
    lines = [ask("initialize", protocolVersion="2024-11-05"), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), ask("tools/list"), "no json", ask("nothing"),
             ask("tools/call", name="search_documents", arguments={"query": "otters", "limit": 1}), ask("tools/call", name="search_sql_logs", arguments={"query": "x"}),
             ask("tools/call", name="search_documents", arguments={"query": "x", "limit": 0}), ask("tools/call", name="other")]
    got = [json.loads(x) for x in mcp.talk({"md": engine}, lines)]
    assert got[0]["result"]["protocolVersion"] == "2024-11-05" and {t["name"] for t in got[1]["result"]["tools"]} == {"search_documents", "search_sql_logs"}
    assert [x["error"]["code"] for x in (got[2], got[3], got[6], got[7])] == [mcp.PARSE, mcp.NO_METHOD, mcp.BAD_PARAMS, mcp.BAD_PARAMS]
    assert "otters swim" in got[4]["result"]["content"][0]["text"] and not got[4]["result"]["isError"] and got[5]["result"]["isError"]


def test_search_reads_the_indexes(spark, tmp_path):
    """Above the index's threshold vectors and texts come from it, filters hold before ranking, and a damaged text index leaves vectors."""
    import os
    import shutil

    from brindle.plans.config import Engine, Settings
    from brindle.plans.engine import RetrievalEngine

    os.makedirs(tmp_path / "in")
    for k in range(300):
        (tmp_path / "in" / f"f{k}.txt").write_text(f"topic{k % 30} words{k} common filler text")
    e = RetrievalEngine(spark, Engine(table_name="v", vector_dimension=32), Settings(db_path=str(tmp_path / "db")))
    assert e.ingest(str(tmp_path / "in")) == 300
    (segment,) = e.vault.state()["segments"]
    assert segment["vectors"] and segment["words"] and segment["texts"] == 300
    found = e.search("words77", 3)
    assert found[0]["source"].endswith("f77.txt")
    own = found[0]["source"].replace("f77.txt", "f5.txt")
    assert [r["source"] for r in e.search("words77 topic5", 5, source=own)] == [own]
    for f in (tmp_path / "db" / "v" / "vault" / "index" / segment["words"]).rglob("*.parquet"):
        f.write_text("damaged")
        f.with_name(f".{f.name}.crc").unlink()
    assert e.search("words77", 3) and all(r["distance"] is not None for r in e.search("words77", 3))
    assert e.ingest(str(tmp_path / "in"), rebuild=True) == 300 and e.search("words77", 1)[0]["source"].endswith("f77.txt")
    shutil.rmtree(tmp_path / "db")


def test_hashing_embedder_equals_plain_loops():
    """Features counted all at once, those of ASCII words by tables, are the ones that a loop over words counts (F6)."""
    import zlib

    texts = ["", "a", "The cat's the CAT", "é ÉÉ naïve x", "日本 語 word " * 50, "x" * 3000 + " y z", " ".join(f"w{k}" for k in range(5000))]
    for dim, grams in ((16, (3, 4)), (64, (2, 5))):
        want = np.zeros((len(texts), dim))
        for k, t in enumerate(texts):
            for w in t.lower().split():
                p = f" {w} "
                for f in (w, *(p[i : i + n] for n in grams for i in range(len(p) - n + 1))):
                    h = zlib.crc32(f.encode())
                    want[k, h % dim] += 1 if (h >> 31) & 1 else -1
        norms = np.linalg.norm(want, axis=1, keepdims=True)
        assert np.allclose(hashing_embedder(dim, grams)(texts), np.divide(want, norms, out=np.zeros_like(want), where=norms > 0), atol=1e-6)
