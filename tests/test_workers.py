"""Every path with Python workers, in a fresh process elsewhere: the package must reach the workers by itself."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import duckdb
from brindle.session import get_spark
from brindle.operators import chunking, ivfpq, search
from brindle.sources import duckfile, http_api
spark = get_spark("2", 2)
sys.path.remove(sys.argv[1])
con = duckdb.connect("t.duckdb")
con.execute("CREATE TABLE t AS SELECT range AS id FROM range(3)")
con.close()
print("table", duckfile.read_table(spark, "t.duckdb", "t").count())
"""
PARTS = {
    "duckfile": 'print(duckfile.read_table(spark, "t.duckdb", "t").collect())',
    "http": 'print(http_api.read_http(spark, "http://127.0.0.1:9", strict="false").count())',
    "chunks": 'print(chunking.chunk_text(spark.createDataFrame([("a.txt", "one\\n\\ntwo three", "h")], "filepath string, content string, content_hash string")).collect())',
    "knn": 'e = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(9)], "id long, vector array<double>"); print(search.knn_many(e, e.selectExpr("id AS query_id", "vector AS query_vector"), 2).count())',
}


def test_the_package_reaches_workers_in_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "run.py").write_text(SCRIPT + "\n".join(PARTS.values()) + "\nprint('done')\n")
    # only entries that hold the repository go, as the libraries may come from others
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and not os.path.isdir(os.path.join(p, "brindle"))]
    env = os.environ | {"PYTHONPATH": os.pathsep.join(paths), "PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "run.py", root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and out.stdout.strip().endswith("done"), out.stderr[-3000:]
