import math
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm import centroids as C
from cohortflow.llm.queries import ORACLE

SF001 = "/root/testdata/sf0.001"


def plain_version(rows, p):
    """All distances in Python integers, round by round."""
    kept = [(i, [math.floor(p.scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == p.dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (sha256(f"{p.seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=key)[:p.k]]
    dist = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    for r in range(p.rounds + 1):
        of = [min((dist(v, c), j) for j, c in enumerate(cents)) for _, v in kept]
        if r == p.rounds:
            break
        for j in range(len(cents)):
            own = [v for (_, v), (_, c) in zip(kept, of) if c == j]
            if own:
                cents[j] = [sum(col) // len(own) for col in zip(*own)]
    total = sum(d for d, _ in of)
    return sorted(((i, c, d, sum(e for e, b in of if b == c), total,
                    sha256(",".join(map(str, cents[c])).encode()).hexdigest())
                   for (i, _), (d, c) in zip(kept, of)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet(f"{SF001}/embeddings.parquet")


def test_equals_the_plain_version_and_skips_scans(embeddings):
    rows = [(r.vec_id, r.embedding) for r in embeddings.collect()]
    log = []
    p = C.CentroidParams()
    assert got(C.cluster(embeddings, p, log=log)) == plain_version(rows, p)
    assert log[0][0] == log[0][1] and sum(s for s, _ in log[1:]) < 0.9 * sum(n for _, n in log[1:])


def test_edge_rows(spark):
    rng = np.random.default_rng(3)
    p = C.CentroidParams(dims=3, k=4, rounds=6)
    good = [(int(i), [float(x) for x in rng.normal(size=3)]) for i in range(300)]
    odd = [(1000, None), (1001, [1.0, 2.0]), (1002, [1.0, None, 2.0]), (1003, [1.0, float("nan"), 2.0]),
           (1004, [1.0, float("inf"), 2.0]), (None, [0.1, 0.2, 0.3]), (5, good[5][1]), (5, [9.0, 9.0, 9.0]),
           *((2000 + i, [0.5, 0.5, 0.5]) for i in range(200)), (7, good[7][1]), (7, good[7][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in good + odd],
                               "vec_id long, embedding array<double>, cluster int, block int")
    assert got(C.cluster(df, p)) == plain_version(good + odd, p)
    few = df.where("vec_id in (1, 2)")
    assert got(C.cluster(few, p)) == plain_version(good[1:3], p)
    none = C.cluster(df.where("vec_id = 1000"), p)
    assert none.count() == 0 and none.columns == [x.split()[0] for x in C.RESULT.split(", ")]
    one = C.CentroidParams(dims=3, k=1, rounds=2)
    assert got(C.cluster(df, one)) == plain_version(good + odd, one)


def test_too_large_components_are_refused(spark):
    df = spark.createDataFrame([(1, [1e9] * 3), (2, [0.0] * 3)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="do not fit a long"):
        C.cluster(df, C.CentroidParams(dims=3, k=1, rounds=1)).collect()


def test_loosening_is_a_bound_and_less_than_the_drift():
    rng = np.random.default_rng(11)
    smaller = 0
    for _ in range(400):
        dims = int(rng.integers(2, 6))
        center, old, new = rng.normal(size=(3, dims)) * rng.choice([0.2, 1, 5], size=(3, 1))
        radius = float(rng.random() * 3)
        bound = C.nearer_by(center, radius, old, new)
        drift = np.linalg.norm(new - old)
        x = rng.normal(size=(4000, dims))
        x = center + radius * x / np.linalg.norm(x, axis=1, keepdims=True) * rng.random((4000, 1)) ** 0.2
        seen = (np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)).max()
        assert seen <= bound + 1e-9 <= drift + 1e-6
        smaller += bound < 0.9 * drift
    assert smaller > 100


def test_a_hot_vector_keeps_bounds_right(spark):
    """A third of all rows are one vector."""
    p = C.CentroidParams(dims=2, k=5, rounds=8)
    rows = [(i, [float(i % 37), float(i % 11)]) for i in range(600)] + [(i, [3.0, 3.0]) for i in range(600, 900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5, F.col("vec_id"))
    assert got(C.cluster(df, p)) == plain_version(rows, p)


def test_sql_equals_the_operator(embeddings):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF001}/embeddings.parquet'")
    sql = con.execute(ORACLE["op11_centroid_clustering"]).fetchall()
    assert sorted(sql, key=str) == got(C.cluster(embeddings))
