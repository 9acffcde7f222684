"""Sort-means against plain rounds over every centroid, and against its SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from brindle.llm import sort_means


def plain(rows, clusters=40, rounds=5):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) by looking at every centroid, in whole numbers of any size."""
    v = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) and abs(x) < sort_means.LIMIT / 256 for x in e)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in v if i is not None)
    c = [x for _, x in named[:clusters]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y)), k) for k, y in enumerate(c))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in v]
        for k in range(len(c)):
            own = [x for (_, x), j in zip(v, at) if j == k]
            if own:
                c[k] = [sum(col) // len(own) for col in zip(*own)]
    last = [(i, *near(x)) for i, x in v]
    of = {}
    for _, d, k in last:
        of[k] = of.get(k, 0) + d
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, k, d, of[k], sum(of.values()), digest[k]) for i, d, k in last), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows):
    """With further columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<float>, cluster string, at long")


def rows_of(seed, n):
    r = np.random.default_rng(seed)
    middle = r.standard_normal((12, 64))
    x = (middle[r.integers(0, 12, n)] + 0.4 * r.standard_normal((n, 64))).astype(np.float32)
    x[: n // 5] = x[0]  # copies, and so ties
    x[n // 5 : n // 4] = np.round(x[n // 5 : n // 4])
    return [(k, v.tolist()) for k, v in enumerate(x)]


def test_sort_means_equals_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(sort_means, "BLOCK", 32)
    nan, inf = float("nan"), float("inf")
    odd = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [nan] + [0.0] * 63), (905, [inf] + [0.0] * 63), (906, [None] + [0.0] * 63), (907, [0.0] * 64), (907, [1.0] * 64), (908, [-3e4] * 64), (909, [3e38] * 64)]
    rows = rows_of(1, 300) + odd
    got = found(sort_means.cluster(frame(spark, rows)))
    assert got == plain(rows) and len(got) == 303
    assert {x[1] for x in got} != {0}


def test_few_and_no_vectors(spark):
    few = rows_of(2, 7)[2:] + [(None, [0.25] * 64)]
    got = found(sort_means.cluster(frame(spark, few)))
    assert len(got) == 6 and sum(r[2] for r in got) == got[0][4] and any(r[0] is None for r in got)
    assert sort_means.cluster(frame(spark, [(1, None), (2, [1.0])])).count() == 0
    assert sort_means.cluster(frame(spark, [])).count() == 0
    one = found(sort_means.cluster(frame(spark, [(5, [0.5] * 64)] * 3)))
    assert [r[:5] for r in one] == [(5, 0, 0, 0, 0)] * 3


def test_scan_stops_early_and_ties_go_to_the_smaller_number():
    r = np.random.default_rng(3)
    c = r.integers(-500, 500, (40, 64))
    c[7] = c[30]
    x = c[r.integers(0, 40, 2000)] + r.integers(-20, 20, (2000, 64))
    x[:5] = c[30]
    d = ((x[:, None] - c[None]) ** 2).sum(-1)
    for scale in (1, 1 << 16):  # in doubles, and in whole numbers beyond them
        cent = sort_means.Centroids(c * scale)
        at = np.zeros(len(x), np.int64)
        at, least, _ = cent.assign(x * scale, at)
        assert (at == d.argmin(1)).all() and (least == d.min(1) * scale * scale).all() and (at[:5] == 7).all()
        again, _, told = cent.assign(x * scale, at)
        assert (again == at).all() and told < 40 * len(x) / 8


def test_whole_tables(spark):
    folder = "/root/testdata/sf0.001"
    if not __import__("os").path.isdir(folder):
        pytest.skip("no test tables")
    from brindle.llm.queries import op11_sort_means

    want = duckdb.connect()
    want.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert found(op11_sort_means(spark, folder)) == sorted(want.execute(sort_means.oracle()).fetchall(), key=str)
