import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tickloom.llm.neighbours import labels, nearest


def brute(rows, k, every):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for n, i in enumerate(ids):
        if i % every == 0:
            score = x @ x[n]
            order = sorted((j for j in range(len(ids)) if ids[j] != i), key=lambda j: (-round(score[j], 9), ids[j]))[:k]
            out[int(i)] = [(int(ids[j]), score[j]) for j in order]
    return out


@pytest.mark.parametrize("shard", [8192, 150])
def test_recall_against_brute_force(spark, shard):
    r = np.random.default_rng(1)
    x = (r.normal(size=(900, 12)) * r.uniform(0.2, 3, size=(900, 1))).astype(np.float32)
    x[200:500] = x[200]  # a large group of copies
    rows = [(3 * n, x[n].tolist()) for n in range(900)]
    bad = [(9000, None), (9010, [0.0] * 12), (9020, [float("nan")] * 12), (9030, [1.0] * 11 + [None]), (9040, [float("inf")] * 12), (9050, [1.0]), (None, x[0].tolist()), (0, x[0].tolist())]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], "vec_id long, embedding array<float>, n int").repartition(4)
    got = {}
    for row in nearest(frame, F.col("vec_id") % 10 == 0, 20, shard).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    want = brute(rows, 20, 10)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.97
    assert all(abs(s - np.dot(x[q // 3].astype(float), x[i // 3].astype(float))) < 1e-9 for q, v in got.items() for i, s in v)
    assert all(a[1] > b[1] or (a[1] == b[1] and a[0] < b[0]) for v in got.values() for a, b in zip(v, v[1:]))


@pytest.mark.parametrize(("lengths", "shard"), [("equal", 32_768), ("gaussian", 32_768), ("spread", 32_768), ("spread", 3000)])
def test_recall_of_the_query_at_64_components(spark, tmp_path, lengths, shard):
    """The registered query's search (every id divisible by 20), double vectors, one shard for each core or three."""
    r = np.random.default_rng(5)
    x = r.normal(size=(9000, 64))
    if lengths != "gaussian":
        x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    if lengths == "spread":
        x *= r.uniform(0.5, 1.5, size=(9000, 1))
    table = pa.table({"vec_id": np.arange(9000), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float64()))})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    frame = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for row in nearest(frame, F.col("vec_id") % 20 == 0, 20, shard).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    scores = x[::20] @ x.T
    scores[np.arange(450), np.arange(0, 9000, 20)] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    assert len(got) == 450
    assert np.mean([len({i for i, _ in got[20 * n]} & set(want[n].tolist())) / 20 for n in range(450)]) >= 0.95
    assert all(abs(s - x[q] @ x[i]) < 1e-13 for q, v in got.items() for i, s in v)  # not those of single precision


def test_different_vectors_of_one_id(spark):
    shape = "vec_id long, embedding array<double>, own string"
    rows = [(20, [1.0, 0.0], "a"), (1, [0.5, 0.5], "a"), (1, [0.25, 0.5], "b"), (1, None, "c"), (2, [0.125, 1.0], "d")]
    for data in (rows, rows[::-1]):
        got = nearest(spark.createDataFrame(data, shape), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in got] == [(1, 0.25), (2, 0.125)]


def test_few_and_none(spark):
    shape = "vec_id long, embedding array<float>"
    assert nearest(spark.createDataFrame([], shape), F.col("vec_id") % 20 == 0).count() == 0
    got = nearest(spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], shape), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(20, 1, 1, 0.5), (20, 2, 2, 0.5)]


def test_a_partition_for_each_shard(spark):
    for shards in (1, 7, 40):
        found = labels(spark, shards)
        assert sorted(r.number for r in found.collect()) == list(range(shards))
        assert len({r.p for r in found.repartition(shards, "shard").select(F.spark_partition_id().alias("p")).collect()}) == shards
