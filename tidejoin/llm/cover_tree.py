"""Exact top-k inner-product search by dual-tree traversal of cover trees.

Centres, the first level of a cover tree over a bounded sample of the vectors (`SAMPLE`, those with the smallest hashes), part the vectors: each goes to its
nearest centre, and a part with more than `block` vectors is split. Queries are searched twice. First each in the block of its own part, which gives it a worst k-th score to begin with.
Then in all other blocks: the queries, in groups of at most `block`, carry their worst k-th scores along, and a part whose covering radius shows that it
can't reach the worst one of a query group isn't sent to that group at all. The two searches' top k of each query meet in one ranking.

In a tile (a query group and a data block; one group of a co-grouped shuffle, whose size `block` bounds) a cover tree indexes the data and another the queries. A pair of nodes
(query centre c, radius r; data centre d, radius s) can't hold a score above <c,d> + |c| s + |d| r + r s, so it is left out if that is below the worst k-th score of the query
node's queries. The others are split, pairs with the highest bounds first. Centres are vectors of the table; a node's children cover its vectors within half its scale and their centres are further apart than
that; a child with one vector is a point. The products of two nodes' points and children's centres are computed at once.

Scores are integers: components are floor(scale * x). They are computed in doubles where these are exact, else in Python's integers, by the same traversal.

How much is left out depends on the vectors: of pairs of a query and a cluster of near copies, nearly all; of vectors without clusters in many dimensions, nothing,
as covers there are as wide as the space. `pairs_scored` counts.

Defined results: vectors that are null, have a null or non-finite component, or have no id take no part; a query is compared with vectors of its own length only;
every row is a candidate, repeated ones too, but for rows with the query's own id; each query row has a ranking, shorter than k if there are fewer candidates; ties go
to the smaller id; scores beyond the range of long are set to its ends; an empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

K = 10
SCALE = 1024
#: Vectors of a block, and queries of a group; blocks that the first search fills.
BLOCK = 4096
#: Vectors that centres are chosen from, and most centres.
SAMPLE, PARTS = 4096, 256
LEAF = 8
EXACT = 2.0**53


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


class Node:
    """points: places of the vectors that are this node's own, its children's centres among them; children: nodes, with their other vectors; rows: all places."""

    __slots__ = ("center", "radius", "points", "children", "rows")

    def __init__(self, center: int, radius: float, points: np.ndarray, children: list, rows: np.ndarray):
        self.center, self.radius, self.points, self.children, self.rows = center, radius, points, children, rows


def _net(own: np.ndarray, apart: float) -> np.ndarray:
    """Places of vectors, the first among them, that are further apart than `apart` and within which of one each other vector is."""
    found = np.zeros(1, np.int64)
    for at in range(1, len(own), 256):
        part = np.arange(at, min(at + 256, len(own)))
        part = part[distances(own[part], own[found]).min(axis=1) > apart]
        far = distances(own[part], own[part]) > apart
        free, new = np.ones(len(part), bool), []
        for i in range(len(part)):
            if free[i]:
                new.append(part[i])
                free &= far[i]
        found = np.concatenate([found, np.array(new, np.int64)])
    return found


def cover_tree(vectors: np.ndarray, rows: np.ndarray | None = None, leaf: int = LEAF, skip: int = 0) -> Node:
    """skip: 1 if the centre, the first of the rows, belongs to the parent."""
    rows = np.arange(len(vectors)) if rows is None else rows
    own = vectors[rows]
    radius = float(np.sqrt(((own - own[0]) ** 2).sum(axis=1)).max())
    if len(rows) <= leaf or radius == 0.0:
        return Node(int(rows[0]), radius, rows[skip:], [], rows[skip:])
    centers = _net(own, 2.0 ** (np.ceil(np.log2(radius)) - 1))
    of = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), 1024):
        of[at : at + 1024] = distances(own[at : at + 1024], own[centers]).argmin(axis=1)
    of[centers] = np.arange(len(centers))
    order = np.argsort(of, kind="stable")
    children = []
    for c, part in enumerate(np.split(order, np.cumsum(np.bincount(of, minlength=len(centers)))[:-1])):
        if len(part) > 1:
            part = np.concatenate([centers[c : c + 1], part[part != centers[c]]])
            children.append(cover_tree(vectors, rows[part], leaf, 1))
    # The root's centre is its own; that of another node was its parent's, and so is the first child's.
    return Node(int(rows[0]), radius, rows[centers][skip:], children, rows[skip:])


def _with_centers(node: Node) -> Node:
    """The tree with each node's centre among the node's own points and not among its parent's: a query node's queries are all below it."""
    children = [_with_centers(c) for c in node.children]
    taken = {c.center for c in children}
    points = np.array([p for p in node.points.tolist() if p not in taken], np.int64)
    if node.center not in taken and node.center not in points:
        points = np.append(points, node.center)
    rows = np.concatenate([points, *(c.rows for c in children)]).astype(np.int64)
    return Node(node.center, node.radius, points, children, rows)


class Ranking:
    """The best k (score, id) of each query so far, and the worst score that a further one must reach."""

    def __init__(self, n: int, k: int, worst: np.ndarray | None = None, whole: bool = False):
        self.k, self.kind = k, object if whole else float
        self.scores, self.ids = [np.zeros(0, self.kind)] * n, [np.zeros(0, np.int64)] * n
        self.worst = np.full(n, -np.inf) if worst is None else worst.astype(float).copy()

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[query], scores]), np.concatenate([self.ids[query], ids])
        if self.kind is float and len(scores) > 4 * self.k:
            near = np.flatnonzero(scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k])
            scores, ids = scores[near], ids[near]
        order = np.lexsort((ids, -scores)) if self.kind is float else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), np.int64)
        order = order[: self.k]
        self.scores[query], self.ids[query] = scores[order], ids[order]
        if len(order) == self.k:
            self.worst[query] = max(self.worst[query], _below(self.scores[query][-1]))


def _below(score) -> float:
    """A double that isn't above the score."""
    return float(score) if abs(score) < EXACT else float(score) - abs(float(score)) * 1e-15


def search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int = K, worst: np.ndarray | None = None, leaf: int = LEAF) -> tuple[Ranking, int]:
    """Every query's best k of the points, without those of its own id, that reach its worst score; and how many products were computed.

    Queries and points are integers, as longs.
    """
    largest = float(np.abs(points.astype(float)).max(initial=0)) * float(np.abs(queries.astype(float)).max(initial=0)) * points.shape[1]
    whole = largest >= EXACT
    ranking, scored = Ranking(len(queries), k, worst, whole), 0
    if not len(queries) or not len(points):
        return ranking, scored
    x, y = queries.astype(float), points.astype(float)
    exact = (queries.astype(object), points.astype(object)) if whole else (x, y)
    norm_x, norm_y = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    some = lambda rows: Node(int(rows[0]), 0.0, rows, [], rows)
    heap, tick = [(-np.inf, 0, _with_centers(cover_tree(x, leaf=leaf)), cover_tree(y, leaf=leaf))], 0

    def push(most: float, q: Node, d: Node) -> None:
        nonlocal tick
        tick += 1
        heapq.heappush(heap, (-most, tick, q, d))

    while heap:
        most, _, q, d = heapq.heappop(heap)
        if -most < ranking.worst[q.rows].min():
            continue
        a, b = len(q.points), len(d.points)
        at_q = np.array([*q.points, *(c.center for c in q.children)], np.int64)
        product = x[at_q] @ y[d.points].T
        scored += product.size
        if a and b:
            scores = exact[0][q.points] @ exact[1][d.points].T if whole else product
            other = ids[d.points]
            for i, query in enumerate(q.points):
                near = product[i] + (norm_x[query] * norm_y[d.points] * 1e-12 if whole else 0.0) >= ranking.worst[query]
                fit = np.flatnonzero(near & (other != query_ids[query]))
                if len(fit):
                    ranking.add(query, scores[i, fit], other[fit])
        if not q.children and not d.children:
            continue
        r, n = np.array([0.0] * a + [c.radius for c in q.children])[:, None], norm_x[at_q][:, None]
        low = np.concatenate([ranking.worst[q.points], [ranking.worst[c.rows].min() for c in q.children]])[:, None]
        if q.children and b:
            m = norm_y[d.points]
            bound = product + m * r + (n + r) * m * 1e-9 + 1e-6
            for i, child in enumerate(q.children, a):
                if len(columns := np.flatnonzero(bound[i] >= low[i])):
                    push(bound[i, columns].max(), child, some(d.points[columns]))
        if d.children:
            middle = np.array([c.center for c in d.children])
            s, m = np.array([c.radius for c in d.children]), norm_y[middle]
            place = {p: i for i, p in enumerate(d.points.tolist())}
            known = np.array([place.get(c, -1) for c in middle.tolist()])
            # A node's own centre, which its parent has, may be its first child's too.
            between = np.where(known >= 0, product[:, known] if b else 0.0, x[at_q] @ y[middle].T if (known < 0).any() else 0.0)
            scored += int((known < 0).sum()) * len(at_q)
            bound = between + n * s + m * r + r * s + (n + r) * (m + s) * 1e-9 + 1e-6
            near = bound >= low
            for j, child in enumerate(d.children):
                if a and len(rows := np.flatnonzero(near[:a, j])):
                    push(bound[rows, j].max(), some(q.points[rows]), child)
                for i, other in enumerate(q.children, a):
                    if near[i, j]:
                        push(bound[i, j], other, child)
    return ranking, scored


def whole_components(vectors: DataFrame, vector: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component x as a double; null for vectors that take no part."""
    parts = F.col(vector).cast("array<double>")
    odd = F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(parts.isNotNull() & ~odd, F.transform(parts, lambda x: F.floor(x * scale)))


def centers(rows: DataFrame, block: int) -> dict[int, tuple[np.ndarray, int]]:
    """By length of vectors, centres chosen one after the other, each the vector of the sample that is farthest from those before: as many as the rows have blocks, PARTS at most.
    And how many of them, the first ones, part the queries."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x", "dim").collect()
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("q").alias("queries")).where(F.col("dim").isin(sorted({r["dim"] for r in sample}))).collect()
    out = {}
    for dim, n, queries in counts:
        own = np.array([r["x"] for r in sample if r["dim"] == dim], float)
        chosen, nearest = [0], distances(own, own[:1])[:, 0]
        while len(chosen) < min(-(-n // block), PARTS) and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, distances(own, own[chosen[-1:]])[:, 0])
        out[dim] = own[chosen], min(max(1, -(-queries // block)), len(chosen))
    return out


PLACED = "id long, x array<long>, dim int, q boolean, row long, part int, near int, far double"


def placed(rows: DataFrame, centers: dict[int, tuple[np.ndarray, int]]) -> DataFrame:
    """The rows with their part (the nearest centre), the nearest of the centres that part the queries, and the distance from the former. Vectors of a length that the sample lacks are one part, with the origin as its centre."""

    def place(batches):
        for batch in batches:
            part, near, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            x, dims = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                own = x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), dim)
                middle, first = centers.get(dim, (np.zeros((1, dim)), 1))
                gaps = distances(own, middle)
                part[at], near[at], far[at] = gaps.argmin(axis=1), gaps[:, :first].argmin(axis=1), gaps.min(axis=1)
            yield pa.record_batch([*batch.columns, pa.array(part), pa.array(near), pa.array(far)], [c.split()[0] for c in PLACED.split(", ")])

    return rows.mapInArrow(place, PLACED)


def _anew(rows: DataFrame) -> DataFrame:
    """The rows with columns of their own, as both sides of a co-grouping come from one table."""
    return rows.select(*(F.col(c).alias(c) for c in rows.columns))


FOUND = "row long, query_id long, vec_id long, score long"


def _tile(k: int):
    def tile(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in FOUND.split(", ")})
        points, q = np.array(own["x"].tolist(), np.int64), np.array(asked["x"].tolist(), np.int64)
        query_ids = asked["id"].to_numpy()
        ranking, scored = search(q, query_ids, points, own["id"].to_numpy(), k, asked["worst"].fillna(-np.inf).to_numpy())
        found = [len(x) for x in ranking.ids]
        scores = [max(min(int(s), 2**63 - 1), -(2**63)) for x in ranking.scores for s in x]
        # The last row says how many products there were.
        return pd.DataFrame({
            "row": np.append(np.repeat(asked["row"].to_numpy(), found), -1), "query_id": np.append(np.repeat(query_ids, found), -1),
            "vec_id": np.concatenate([*ranking.ids, [-1]]).astype(np.int64), "score": np.array([*scores, scored], np.int64),
        })

    return tile


def searched(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """As FOUND says: what both searches found, and with row -1 the numbers of products that they computed."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), whole_components(vectors, vector).alias("x"), is_query.alias("q")).where("id IS NOT NULL AND x IS NOT NULL")
    rows = rows.select("id", "x", F.size("x").alias("dim"), F.coalesce("q", F.lit(False)).alias("q"), F.monotonically_increasing_id().alias("row"))
    middle = centers(rows, block)
    dealt = checkpointed(placed(rows, middle))
    # A row for each part: PARTS at most for each length of vectors that the sample has, one for each other.
    parts = dealt.groupBy("dim", "part").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.count_if("q").alias("queries"))
    parts = checkpointed(parts.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")))
    split = dealt.join(parts.select("dim", "part", "blocks"), ["dim", "part"]).withColumn("sub", F.pmod(F.xxhash64("id", "row"), F.col("blocks")).cast("int"))
    tile = _tile(k)
    worst = F.lit(None).cast("double").alias("worst")

    # First search: each query in the first block of its own part, in groups of its own.
    groups = parts.select("dim", "part", F.explode(F.sequence(F.lit(0), F.floor((F.col("queries") - 1) / block).cast("int"))).alias("group")).where("group >= 0")
    group = F.pmod(F.xxhash64("row"), F.floor((F.col("queries") - 1) / block).cast("int") + 1).cast("int").alias("group")
    asked = dealt.where("q").join(parts.select("dim", "part", "queries"), ["dim", "part"]).select("dim", "part", group, "id", "x", "row", worst)
    own = split.where("sub = 0").join(groups, ["dim", "part"]).select("dim", "part", "group", "id", "x")
    key = ["dim", "part", "group"]
    first = checkpointed(_anew(own).groupBy(*key).cogroup(_anew(asked).groupBy(*key)).applyInPandas(tile, FOUND))

    # Second search: groups of queries, by their nearest of fewer centres, in all other blocks.
    bars = first.where("row >= 0").groupBy("row").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("worst"))
    asked = dealt.where("q").select("dim", "part", "near", "id", "x", "row").join(bars, "row", "left")
    pieces = dealt.where("q").groupBy("dim", "near").agg(F.ceil(F.count("*") / block).cast("int").alias("pieces"))
    asked = checkpointed(asked.join(pieces, ["dim", "near"]).withColumn("group", F.struct("near", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int").alias("piece"))))
    reach = _reachable(asked, parts, middle)
    own = split.join(reach, ["dim", "part"]).select("dim", "part", "sub", "group", "id", "x")
    asked = asked.drop("near", "pieces").withColumnRenamed("part", "home").join(reach.join(parts.select("dim", "part", "blocks"), ["dim", "part"]), ["dim", "group"])
    asked = asked.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("part <> home OR sub > 0")
    key = ["dim", "part", "sub", "group"]
    second = _anew(own).groupBy(*key).cogroup(_anew(asked.select(*key, "id", "x", "row", "worst")).groupBy(*key)).applyInPandas(tile, FOUND)
    return first.unionByName(second)


def _reachable(asked: DataFrame, parts: DataFrame, middle: dict[int, tuple[np.ndarray, int]]) -> DataFrame:
    """dim, group, part: where some query of the group may find a score that reaches its worst one, by <q,c> + |q| far."""
    known = {dim: [(r["part"], r["far"]) for r in rows] for dim, rows in _by_dim(parts).items()}

    def reach(batches):
        found = set()
        for batch in batches:
            dims, groups, x, bars = (batch.column(c) for c in ("dim", "group", "x", "worst"))
            dims, groups = dims.to_numpy(zero_copy_only=False), [(g["near"], g["piece"]) for g in groups.to_pylist()]
            low = np.nan_to_num(bars.to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                own = x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), dim)
                number, far = np.array([p for p, _ in known[dim]]), np.array([f for _, f in known[dim]])
                center = middle[dim][0][number] if dim in middle else np.zeros((1, dim))
                norm = np.sqrt((own * own).sum(axis=1))[:, None]
                bound = own @ center.T + norm * far + norm * (np.sqrt((center * center).sum(axis=1)) + far) * 1e-9 + 1e-6
                for i, j in zip(*np.nonzero(bound >= low[at][:, None])):
                    found.add((int(dim), *groups[at[i]], int(number[j])))
        rows = sorted(found)
        yield pa.record_batch([pa.array([r[c] for r in rows], pa.int32()) for c in range(4)], ["dim", "near", "piece", "part"])

    found = asked.select("dim", "group", "x", "worst").mapInArrow(reach, "dim int, near int, piece int, part int").distinct()
    return checkpointed(found.select("dim", F.struct("near", "piece").alias("group"), "part"))


def _by_dim(parts: DataFrame) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in parts.select("dim", "part", "far").toLocalIterator():
        out.setdefault(r["dim"], []).append(r)
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k best other rows by inner product."""
    found = searched(vectors, is_query, k, id_col, vector, block).where("row >= 0")
    rank = F.row_number().over(Window.partitionBy("row", "query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pairs_scored(vectors: DataFrame, is_query: Column, **options) -> int:
    """How many products of two vectors the search computes."""
    return searched(vectors, is_query, **options).where("row = -1").agg(F.coalesce(F.sum("score"), F.lit(0))).first()[0]


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM whole q JOIN whole d ON q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""
