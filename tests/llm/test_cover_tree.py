import numpy as np
import pytest
from pyspark.sql import functions as F

from tidejoin.llm import cover_tree as C


def brute(q, query_ids, x, ids, k):
    return [sorted(((-int(a @ b), int(j)) for b, j in zip(x, ids) if j != i))[:k] for a, i in zip(q, query_ids)]


@pytest.mark.parametrize("kind", ["random", "clusters", "copies", "few"])
def test_search(kind):
    rng = np.random.default_rng(3)
    n = {"few": 5}.get(kind, 1500)
    x = rng.normal(size=(n, 8)) * 100
    if kind == "clusters":
        x = rng.normal(size=(10, 8))[rng.integers(0, 10, n)] * 1000 + rng.normal(size=(n, 8)) * 5
    if kind == "copies":
        x[: n // 2] = x[0]
    x = np.floor(x)
    ids, at = np.arange(n), np.arange(0, n, 7)
    ranking, scored = C.search(x[at], ids[at], x, ids, 10)
    assert [list(zip((-s).astype(int).tolist(), j.tolist())) for s, j in zip(ranking.scores, ranking.ids)] == brute(x[at], ids[at], x, ids, 10)
    assert scored <= 1.05 * len(at) * n
    if kind == "clusters":
        assert scored < 0.2 * len(at) * n


def covered(node, vectors, above=None):
    """Every vector stands once below the root, within its node's radius of the centre, and centres are further apart than half the scale."""
    own = vectors[node.rows]
    assert (np.sqrt(((own - vectors[node.center]) ** 2).sum(axis=1)) <= node.radius + 1e-6).all()
    if node.children:
        half = 2.0 ** (np.ceil(np.log2(node.radius)) - 1)
        gaps = C.distances(vectors[node.points], vectors[node.points])
        assert (gaps[~np.eye(len(gaps), dtype=bool)] > half - 1e-6).all() and all(c.radius <= half for c in node.children)
    rows = [*node.points, *(r for c in node.children for r in covered(c, vectors))]
    assert sorted(rows) == sorted(node.rows)
    return rows


def test_covers():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20, 6))[rng.integers(0, 20, 700)] * 100 + rng.normal(size=(700, 6))
    x[:50] = x[0]
    assert sorted(covered(C.cover_tree(x), x)) == list(range(700))


def test_parts_carry_their_worst_scores(spark):
    """Clusters in blocks: most pairs of a query and a vector of another block are left out, and the result is exact."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(8, 6))[rng.integers(0, 8, 1200)] * 4 + rng.normal(size=(1200, 6)) * 0.01
    frame = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = F.col("vec_id") % 20 == 0
    got = {}
    for r in C.top_k(frame, asked, block=100).collect():
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    w = np.floor(1024 * x).astype(np.int64)
    want = brute(w[::20], range(0, 1200, 20), w, range(1200), 10)
    assert [[y[1:] for y in sorted(got[i])] for i in range(0, 1200, 20)] == want
    assert C.pairs_scored(frame, asked, block=100) < 0.3 * 60 * 1200


def test_share_of_pairs_on_the_table(spark):
    """Vectors without clusters in 64 dimensions: the search computes no more products than there are pairs, and can leave out few."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    n = rows.where("embedding IS NOT NULL").count()
    assert C.pairs_scored(rows, F.col("vec_id") % 100 == 0) <= n * rows.where("vec_id % 100 = 0").count()


def test_tiles_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 4) / 4]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [float("inf")] * 4), (None, [1.0] * 4), (7, [0.5] * 4), (400, [1.0, 1.0]), (404, [2.0, 1.0]), (500, [])]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in C.top_k(frame, F.col("vec_id") % 4 == 0, k=5, block=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    good = [(i, np.floor(1024 * np.array(v))) for i, v in rows[:300]] + [(7, np.floor(1024 * np.array([0.5] * 4)))]
    want = brute([v for i, v in good if i % 4 == 0], [i for i, _ in good if i % 4 == 0], [v for _, v in good], [i for i, _ in good], 5)
    assert [[x[1:] for x in sorted(got[i])] for i in range(0, 300, 4)] == want
    assert got[400] == [(1, -3 * 1024**2, 404)] and 500 not in got and 300 not in got
    assert C.top_k(frame.limit(0), F.lit(True)).count() == 0


def test_large_components(spark):
    frame = spark.createDataFrame([(i, [1e12 + i, 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in C.top_k(frame, F.col("vec_id") == 0, k=2).orderBy("rank").collect()]
    # The two best by their whole scores; equal once set to the end of the range.
    assert [r[2] for r in got] == [2, 3] and all(r[3] == 2**63 - 1 for r in got)
