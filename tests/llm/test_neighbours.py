"""Nearest neighbours against a comparison with every row."""

from __future__ import annotations

import numpy as np
import pytest

from pyspark.sql import functions as F

from tracequarry.llm import neighbours
from tracequarry.llm.queries import op11_neighbours

SF_DIR = "/root/testdata/sf0.01"
KINDS = "vec_id long, embedding array<float>, label int, list int, q long"


def brute(rows, asked, k=10):
    """rows: (vec_id, vector) that take part. Answers of each query row, as sorted lists."""
    x = np.array([v for _, v in rows], dtype=np.float64)
    ids = np.array([i for i, _ in rows])
    out = []
    for at in np.flatnonzero(asked(ids)):
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != at][:k]
        out.append((int(ids[at]), [(int(ids[j]), float(d[j])) for j in order]))
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(rows) for q, rows in out.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, 3) for i, v in rows], KINDS)


def recall(df, rows, asked):
    got, hits, n = answers(df), 0, 0
    for q, want in brute(rows, asked):
        assert [r for r, _, _ in got[q]] == list(range(1, len(want) + 1))
        exact = dict(want)
        for _, i, d in got[q]:
            if i in exact:
                assert d == pytest.approx(exact[i], rel=1e-12, abs=1e-15)
        hits += len({i for _, i, _ in got[q]} & set(exact))
        n += len(want)
    return hits / n


def test_recall_of_the_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    assert recall(op11_neighbours(spark, SF_DIR), rows, lambda i: i % 100 == 0) >= 0.9


@pytest.mark.parametrize("kind", ["spread", "dense"])
def test_recall_over_many_lists(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 16)) if kind == "spread" else np.concatenate([rng.normal(size=(4000, 16)), rng.normal(size=16) + 1e-3 * rng.normal(size=(2000, 16))])
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    assert recall(neighbours.nearest_neighbours(frame(spark, rows), F.col("vec_id") % 50 == 0), rows, lambda i: i % 50 == 0) >= 0.93


def test_copies_ties_and_small_blocks(spark, monkeypatch):
    """A third of all rows are one vector; distances tie; blocks are dealt on both sides. Everything lies in reach, so results are exact."""
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 0.0]) for i in range(0, 300, 3)] + [(i, [float(rng.integers(-2, 3)), float(rng.integers(1, 3))]) for i in range(300) if i % 3]
    rows += [(300, [1.0, 0.0]), (300, [1.0, 0.0]), (300, [5.0, 5.0])]  # one vec_id, three rows
    got = neighbours.nearest_neighbours(frame(spark, rows), F.col("vec_id") % 10 == 0, k=10).collect()
    want = sorted((q, n + 1, i, round(d, 9)) for q, own in brute(rows, lambda i: i % 10 == 0) for n, (i, d) in enumerate(own))
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == want


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(100, None), (200, []), (300, [0.0, 0.0]), (400, [1.0, None]), (500, [nan, 1.0]), (600, [1.0, inf]), (700, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    rows = [(0, [1.0, 1.0]), (1, [1.0, 2.0]), (2, [-0.0, 3.0]), (3, [0.0, 3.0])]
    got = answers(neighbours.nearest_neighbours(frame(spark, odd + rows), F.col("vec_id") % 100 == 0))
    assert {q: [(r, i, round(d, 12)) for r, i, d in a] for q, a in got.items()} == {0: [(1, 1, 1.0), (2, 2, round(5**0.5, 12)), (3, 3, round(5**0.5, 12))]}
    assert neighbours.nearest_neighbours(frame(spark, odd), F.col("vec_id") % 100 == 0).collect() == []
    assert neighbours.nearest_neighbours(frame(spark, []), F.lit(True)).collect() == []
    assert answers(neighbours.nearest_neighbours(frame(spark, rows[:1]), F.lit(True))) == {}


def test_lists_are_balanced_and_every_centroid_is_reached():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(900, 8)), np.ones((300, 8)) + 1e-6 * rng.normal(size=(300, 8))]).astype(np.float32)
    centroids = neighbours.fit_centroids(x, 37)
    assert len(centroids) == 37
    graph = neighbours.Graph.of(centroids)
    rows, nodes, d = graph.near(x[:50], 1e9)
    assert len(rows) == 50 * 37 and (np.diff(d.reshape(50, 37)) >= 0).all()
    rows, lists = graph.lists_of(x)
    assert set(rows.tolist()) == set(range(len(x)))
    copies = np.bincount(rows)
    assert copies.min() == 1 and copies.max() <= neighbours.COPIES
    to_own = np.sqrt(((x - centroids[lists[: len(x)]]) ** 2).sum(1))
    assert (to_own <= neighbours._distances(x.astype(float), centroids.astype(float)).min(1) + 1e-4).mean() > 0.97
    assert len(neighbours.fit_centroids(np.ones((5, 3), np.float32), 5)) == 5
