"""Nearest neighbours against the SQL of their queries, on odd vectors too, and their work."""

import numpy as np
import pytest

from lumenark.operators import neighbours
from lumenark.plans import catalog
from tests.oracle import rows_of, rows_of_sql

NAN = float("nan")


def both(spark, tmp_path, name, rows):
    import duckdb

    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    return rows_of(catalog.queries()[name](spark, str(tmp_path))), rows_of_sql(con, catalog.oracle_sql()[name])


def odd():
    """Copies, zeros, missing vectors, missing places, other lengths, tiny, huge and undefined values."""
    r = np.random.default_rng(7)
    rows = [(i, int(r.integers(0, 4)), [float(v) for v in r.integers(-3, 4, 8)]) for i in range(120)]
    for i, x in {3: None, 20: None, 5: [], 40: [], 7: [0.0] * 8, 60: [0.0] * 8, 9: [1.0, 2.0], 80: [1.0, 2.0, 3.0], 11: [None] * 8, 12: [None, *[1.0] * 7], 100: [2.0, None, *[1.0] * 6], 13: [1e-30] * 8, 14: [3e30] * 8, 15: [NAN] * 8}.items():
        rows[i] = (i, rows[i][1], x)
    rows[31] = (31, None, rows[32][2])
    return rows


@pytest.mark.parametrize("name", ["knn_vote", "most_similar"])
def test_odd_vectors_as_in_sql(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name, odd())
    assert got == want


@pytest.mark.parametrize("name", ["knn_vote", "most_similar"])
def test_many_copies_in_small_blocks(spark, tmp_path, name, monkeypatch):
    for k, v in {"QUERY_BLOCK": 7, "PART_ROWS": 100}.items():
        monkeypatch.setattr(neighbours, k, v)
    r = np.random.default_rng(8)
    base = [[float(v) for v in r.integers(-2, 3, 4)] for _ in range(40)]
    got, want = both(spark, tmp_path, name, [(i, i % 3, base[int(r.integers(0, 40))] if i % 2 else base[0]) for i in range(400)])
    assert got == want


@pytest.mark.parametrize("measure", ["squared", "cosine"])
def test_few_pairs_are_summed(measure, monkeypatch):
    for k, v in {"TILE_QUERIES": 128, "TILE_ROWS": 700, "PAIRS": 50}.items():
        monkeypatch.setattr(neighbours, k, v)
    r = np.random.default_rng(9)
    q, x = r.normal(size=(300, 16)), r.normal(size=(9000, 16)).astype(np.float32).astype(float)
    pairs, measured = [], neighbours._Search._measured
    monkeypatch.setattr(neighbours._Search, "_measured", lambda self, a, *b: pairs.append(len(a)) or measured(self, a, *b))
    s = neighbours._Search(-1 - np.arange(300), q, None, np.full(300, 16), 5, measure)
    for i in range(0, 9000, 3000):
        s.add(np.arange(i, i + 3000), x[i : i + 3000], None, np.full(3000, 16))
    d = ((q[:, None] - x[None]) ** 2).sum(2) if measure == "squared" else -(q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)
    query, vec, at, score, _ = s.best()
    assert np.array_equal(vec.reshape(300, 5)[np.argsort(-query[::5])], np.argsort(d, axis=1)[:, :5]) and np.array_equal(at, vec)
    assert np.allclose(score, d[-1 - query, vec]) and sum(pairs) < 300 * 9000 / 50
