"""Exact k-means against a plain version and against SQL."""

import hashlib

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tillscope.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<float>, label int, id long, x string, cluster string, distance int, centroid int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None, None, None, None, None, None) for i, v in rows], SCHEMA)


def plain(rows, k, rounds, order):
    kept = [(i, np.floor(1024 * np.float32(v).astype(float)).astype(np.int64)) for i, v in rows]
    first = sorted((v for v in kept if v[0] is not None), key=lambda r: (order(r[0]), r[1].tolist()))[:k]
    centres = np.array([v for _, v in first])
    x = np.array([v for _, v in kept])
    for t in range(rounds + 1):
        d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        c = d.argmin(axis=1)
        if t < rounds:
            centres = np.array([x[c == j].sum(axis=0) // (c == j).sum() if (c == j).any() else centres[j] for j in range(len(centres))])
    d = d.min(axis=1)
    return sorted(
        ((i, int(c[n]), int(d[n]), int(d[c == c[n]].sum()), int(d.sum()), centres[c[n]].tolist()) for n, (i, _) in enumerate(kept)),
        key=repr,
    )


def sha(i):
    return hashlib.sha256(f"3:{i}".encode()).hexdigest()


def by_hash():
    return F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)


def test_clusters_against_plain_version(spark):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(11, 64))
    sound = [(i, (middle[i % 11] + 0.3 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(400)]
    sound += [(i, sound[3][1]) for i in range(400, 500)]  # many copies
    sound += [sound[7], (None, sound[9][1])]
    odd = [(600, None), (601, []), (602, [1.0] * 63), (603, [float("nan")] * 64), (604, [float("inf")] + [0.0] * 63)]
    odd += [(605, [None] + [0.0] * 63), (606, [1.0] * 65)]
    got = centroids.cluster_vectors(vectors(spark, sound + odd), by_hash()).collect()
    assert sorted(map(tuple, got), key=repr) == plain(sound, 8, 10, sha)


def test_few_vectors_ties_and_nothing(spark):
    rows = [(i, [float(i // 2)] + [0.0] * 63) for i in range(6)]  # pairs of equal vectors: centres tie, some stay empty
    got = centroids.cluster_vectors(vectors(spark, rows), by_hash()).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, 8, 10, sha)
    got = centroids.cluster_vectors(vectors(spark, rows), F.col("vec_id"), centres=3, rounds=1).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, 3, 1, lambda i: i)
    assert centroids.cluster_vectors(vectors(spark, [(1, None)]), by_hash()).count() == 0
    assert centroids.cluster_vectors(vectors(spark, []), by_hash()).columns[0] == "vec_id"


def test_bounds_are_exact_and_save_work():
    rng = np.random.default_rng(3)
    middle = 4000 * rng.normal(size=(8, 64))
    x = (middle[rng.integers(0, 8, 3000)] + 700 * rng.normal(size=(3000, 64))).astype(np.int64)
    centres = x[:8].copy()
    history = centres[None]
    cluster, squared, when = np.zeros(len(x), int), np.zeros((len(x), 8), np.int64), np.full((len(x), 8), -1)
    measured = []
    for _ in range(10):
        cluster, n = centroids.nearest_centres(x, history, cluster, squared, when)
        measured.append(n)
        d = ((x[:, None] - history[-1][None]) ** 2).sum(axis=2)
        assert (cluster == d.argmin(axis=1)).all()
        stored = ((x[:, None] - history[when, np.arange(8)]) ** 2).sum(axis=2)
        assert (squared == stored).all()
        moved = [x[cluster == c].sum(axis=0) // max(1, (cluster == c).sum()) for c in range(8)]
        history = np.concatenate([history, np.array([moved])])
    assert measured[0] == 8 * len(x) and sum(measured[1:]) < 0.5 * 9 * 8 * len(x)


def test_clusters_against_sql(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(120)] + [(200, None), (201, [1.0] * 63)]
    vectors(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op11_centroids(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.register("embeddings", pd.DataFrame({"vec_id": [i for i, _ in rows], "embedding": [v and np.float32(v) for _, v in rows]}))
    want = con.execute(queries.ORACLE_SQL["op11_centroids"]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))
