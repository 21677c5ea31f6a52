"""Posting lists against brute force."""

import numpy as np
import pytest

from captrail.llm import postings


def brute(rows, every, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in usable:
        if q % every == 0:
            near = sorted({(float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in usable if i != q})[:k]
            out[q] = near
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 3
    out = [(k, [float(x) for x in np.float32(centres[k % 20] + rng.normal(size=8))]) for k in range(3000)]
    out += [(5000 + k, out[10][1]) for k in range(300)]
    out += [(7000, None), (7100, [0.0] * 8), (7200, [float("nan")] * 8), (7300, [None] + [1.0] * 7), (7400, [float("inf")] * 8), (None, out[0][1]), (100, out[100][1])]
    return out


def test_recall_and_order(spark, rows, monkeypatch):
    monkeypatch.setattr(postings, "TASK_ROWS", 100)
    vectors = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, list string, id int")
    got = {}
    for r in postings.neighbours(vectors).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = brute(rows, 100, 10)
    assert set(got) == set(want)
    hits = sum(len({v for _, v in got[q]} & {v for _, v in near}) for q, near in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, near in got.items():
        assert near == sorted(near) and len(near) == 10
        by_id = dict((v, s) for s, v in brute(rows, 100, 10**6)[q]) if q == 0 else None
        assert by_id is None or all(by_id[v] == pytest.approx(s, abs=0) for s, v in near)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [1.0, 1.0])], schema)
    assert [tuple(r)[:3] for r in postings.neighbours(few).orderBy("query_id", "rank").collect()] == [(0, 1, 3), (0, 2, 100), (100, 1, 3), (100, 2, 0)]
    assert postings.neighbours(few.where("vec_id = 0")).count() == 0
    assert postings.neighbours(few.where("vec_id < 0")).count() == 0


def test_graph_finds_near_centroids():
    rng = np.random.default_rng(7)
    centroids = postings.bisect(rng.normal(size=(6000, 16)), 20)
    graph = postings.CentroidGraph(centroids)
    x = rng.normal(size=(50, 16))
    found, _ = graph.search(x)
    true = np.argsort(postings.squared(x, centroids), axis=1)[:, :5]
    assert np.mean([len(set(a[:10]) & set(b)) / 5 for a, b in zip(found.tolist(), true.tolist(), strict=True)]) > 0.9


def test_recall_without_near_lists(spark, monkeypatch):
    """Noise in many dimensions: the lists near a query hold few of its neighbours, so more are read."""
    monkeypatch.setattr(postings, "LIST_SIZE", 10)
    rng = np.random.default_rng(11)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.float32(rng.normal(size=(6000, 48))))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in postings.neighbours(vectors).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    y = np.array([v for _, v in rows])
    hits = 0
    for q in range(0, 6000, 100):
        score = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        score[q] = np.inf
        hits += len(got[q] & set(np.lexsort((np.arange(6000), score))[:10].tolist()))
    assert hits >= 0.9 * 600


def test_closest_counts_equal_rows_once():
    ids, y = np.array([7, 3, 3, 9, 1, 1]), np.array([[1.0], [2.0], [2.0], [2.0], [5.0], [6.0]])
    q, v, score = postings.closest(np.array([9]), np.array([[2.0]]), ids, y, 3)
    assert (q.tolist(), v.tolist(), score.tolist()) == ([9, 9, 9], [3, 7, 1], [0.0, 1.0, 3.0])


def test_rows_follow_the_queries(spark, monkeypatch):
    """Where most lists are read, a query still goes to each group of lists once and returns from it with k rows."""
    monkeypatch.setattr(postings, "LIST_SIZE", 10)
    staged, stage = [], postings.stage

    def counted(df, *by):
        out = stage(df, *by)
        if "vector" in out.columns and not out.where("id % 100 <> 0").count():
            staged.append(out.count())
        return out

    monkeypatch.setattr(postings, "stage", counted)
    rng = np.random.default_rng(12)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.float32(rng.normal(size=(4000, 48))))]
    assert postings.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)).count() == 400
    assert 40 <= staged[0] <= 40 * 2 * 16


def test_group_keeps_the_nearest_of_its_lists():
    import pyarrow as pa
    y = np.arange(12.0).reshape(-1, 1)
    stored = pa.table({"list": [0] * 6 + [1] * 6 + [2], "id": [*range(12), 3], "vector": [*y.tolist(), [3.0]]})
    asked = pa.table({"id": [100, 200], "vector": [[5.6], [0.0]], "lists": [[0, 1, 2], [1]]})
    got = postings._nearest(1, 3)(asked, stored).to_pydict()
    assert (got["query_id"], got["vec_id"]) == ([100, 100, 100, 200, 200, 200], [6, 5, 7, 6, 7, 8])
    first, parts = postings.placed({0: 4, 1: 25, 2: 3, 3: 7, 5: 1}, 6, 10)
    assert (first.tolist(), parts.tolist()) == ([0, 1, 4, 4, 0, 5], [1, 3, 1, 1, 0, 1])
