"""The vector index against comparison with every vector."""

import numpy as np
import pytest

from plylake.operators import vector_index

SF_DIR = "/root/testdata/sf0.1"


def brute(rows, queries, k=5):
    names = np.array([r[0] for r in rows])
    units = np.array([r[1] for r in rows], float)
    units /= np.linalg.norm(units, axis=1)[:, None]
    out = []
    for q in queries:
        scores = np.round(units @ units[np.flatnonzero(names == q)[0]], 6)
        order = [i for i in np.lexsort((names, -scores)) if names[i] != q][:k]
        out += [(int(q), n + 1, int(names[i]), float(scores[i])) for n, i in enumerate(order)]
    return out


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    vector_index.build_index(vectors, path)
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    return path, vectors.where("vec_id % 100 = 0"), rows


def test_every_vector_is_indexed_once(spark, indexed):
    path, _, rows = indexed
    stored = spark.read.parquet(f"{path}/vectors")
    assert sorted(r.id for r in stored.select("id").collect()) == sorted(r[0] for r in rows)
    assert spark.read.parquet(f"{path}/cells").count() > 10


def test_exact_search_equals_brute_force(spark, indexed):
    path, queries, rows = indexed
    got = sorted((r.query_id, r.rank, r.vec_id, r.similarity) for r in vector_index.nearest(spark, path, queries).collect())
    assert got == brute(rows, sorted(q for q, _ in rows if q % 100 == 0))


def test_recall_of_the_index_alone(spark, indexed):
    """Probing alone, on vectors that lie in groups, as positions do."""
    path, _, _ = indexed
    dice = np.random.default_rng(5)
    hubs = dice.normal(size=(60, 16))
    rows = [(i, (hubs[i % 60] + dice.normal(size=16) * 0.25).tolist(), 1) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    vector_index.build_index(df, path + "-groups")
    queries = df.where("vec_id % 100 = 0")
    want = {(q, v) for q, _, v, _ in brute([r[:2] for r in rows], range(0, 6000, 100))}
    got = {(r.query_id, r.vec_id) for r in vector_index.nearest(spark, path + "-groups", queries, exact=False).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_blocks_and_awkward_vectors(spark, tmp_path, monkeypatch):
    """Small blocks, ties, and vectors without a direction, which are neither indexed nor found."""
    monkeypatch.setattr(vector_index, "BLOCK", 7)
    dice = np.random.default_rng(6)
    rows = [(i, dice.integers(1, 3, 4).astype(float).tolist(), i % 3) for i in range(400)]
    bad = [(900, None, 1), (901, [0.0] * 4, 1), (902, [float("nan"), 1.0, 1.0, 1.0], 1), (903, [1.0, None, 1.0, 1.0], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int")
    vector_index.build_index(df, str(tmp_path))
    queries = df.where("vec_id % 40 = 0 OR vec_id >= 900")
    got = sorted((r.query_id, r.rank, r.vec_id, r.similarity) for r in vector_index.nearest(spark, str(tmp_path), queries, k=9).collect())
    assert got == brute([r[:2] for r in rows], range(0, 400, 40), k=9)


def test_index_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<double>, label int")
    vector_index.build_index(df, str(tmp_path))
    assert vector_index.nearest(spark, str(tmp_path), df).collect() == []
