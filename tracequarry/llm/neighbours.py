"""Approximate nearest neighbours by balanced posting lists.

Equal vectors form one point with its k + 1 smallest vec_ids: nearer copies of a vector than those cannot be asked for.

1. Centroids are fitted on at most SAMPLE points (lowest hashes), halved again and again at the median between two means,
   so that lists are balanced; their number grows with the points up to MAX_LISTS. They are joined by a graph of relative
   neighbours, which every task holds in memory (under 1 KB for each centroid of 64 numbers, so at most 64 MB).
2. Every point goes to its nearest centroid's list, and, near boundaries, to up to COPIES lists in all whose centroids are
   within BOUNDARY of the nearest distance and not nearer to one another than to the point.
3. A query reads all lists whose centroids lie within a ratio of its distance to the nearest one. The ratio is the least
   that finds TARGET of the true neighbours of TRIALS points, which are compared with all points beforehand; so recall is
   measured, not assumed.
4. Queries and lists meet in blocks of at most BLOCK rows on each side. Distances are taken in double precision on the
   original vectors; equal ones are ordered by vec_id.

Defined results: rows with a null vec_id, and vectors that are null, empty, zero, or hold null or non-finite components take
no part, nor do vectors of another length than most (of two equally frequent lengths, the longer counts); a repeated vec_id
stands for several rows, each of which is a candidate of the others and, if a query, asks for itself; fewer candidates than k
give fewer rows; an empty table gives none. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Points to a list before boundary copies, most lists, and points that the centroids are fitted on.
LIST_ROWS, MAX_LISTS, SAMPLE = 256, 65_536, 131_072
#: Lists of a point, and how much farther than the nearest centroid another one may be.
COPIES, BOUNDARY = 4, 0.2
#: Nearest centroids that are looked at for boundary copies; neighbours in the graph before and after pruning.
LOOKED_AT, CANDIDATES, DEGREE = 16, 48, 16
#: Points whose neighbours are found exactly to set the ratio, and the share of neighbours to find.
TRIALS, TARGET = 128, 0.98
#: Rows of either side of a scan, and vectors that walk the graph together.
BLOCK, TOGETHER = 4096, 256


def _halves(x: np.ndarray, rng: np.random.Generator, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of two groups, the first with `share` of the rows, cut across the line between two means."""
    a, b = x[rng.integers(len(x))], x[rng.integers(len(x))]
    for _ in range(6):
        side = ((x - b) ** 2).sum(1) > ((x - a) ** 2).sum(1)
        if side.all() or not side.any():
            break
        a, b = x[side].mean(0), x[~side].mean(0)
    order = np.argsort(x @ (b - a), kind="stable")
    cut = min(len(x) - 1, max(1, round(len(x) * share)))
    return order[:cut], order[cut:]


def fit_centroids(x: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Means of `lists` groups of nearly equal size; neighbours in the order of the halving are neighbours in space, mostly."""
    rng, out = np.random.default_rng(seed), []
    todo = [(np.arange(len(x)), min(lists, len(x)))]
    while todo:
        rows, n = todo.pop()
        if n == 1:
            out.append(x[rows].mean(0))
            continue
        left = n // 2
        first, second = _halves(x[rows], rng, left / n)
        if len(first) < left:  # each list keeps a row at least
            first, second = np.arange(left), np.arange(left, len(rows))
        elif len(second) < n - left:
            cut = len(rows) - (n - left)
            order = np.concatenate([first, second])
            first, second = order[:cut], order[cut:]
        todo += [(rows[second], n - left), (rows[first], left)]
    return np.array(out, dtype=np.float32).reshape(len(out), x.shape[1])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(squares, 0))


@dataclass
class Graph:
    """Centroids, the neighbours of each (from starts[i] to starts[i + 1]), and the ones where a walk may begin."""

    centroids: np.ndarray
    neighbours: np.ndarray
    starts: np.ndarray
    seeds: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> Graph:
        """Relative neighbours: a near centroid is linked if no linked one is nearer to it. Lists next to each other in the halving are linked too, so all are reached."""
        n = len(centroids)
        here, there = [np.arange(n - 1)], [np.arange(1, n)]
        for at in range(0, n, 1024):
            own = centroids[at : at + 1024]
            d = _distances(own, centroids)
            d[np.arange(len(own)), np.arange(at, at + len(own))] = np.inf
            m = min(CANDIDATES, n - 1)
            near = np.argsort(d, axis=1, kind="stable")[:, :m]
            d = np.take_along_axis(d, near, 1)
            linked = np.zeros((len(own), m), dtype=bool)
            count = np.zeros(len(own), dtype=int)
            kept = np.full((len(own), DEGREE), -1)
            for r in range(m):
                to_kept = np.sqrt(((centroids[near[:, r]][:, None] - centroids[kept]) ** 2).sum(2))
                free = (count < DEGREE) & ~((to_kept < d[:, r, None]) & (kept >= 0)).any(1)
                linked[free, r] = True
                kept[free, count[free]] = near[free, r]
                count[free] += 1
            i, j = np.nonzero(linked)
            here.append(i + at)
            there.append(near[i, j])
        pairs = np.concatenate([np.concatenate(here) * n + np.concatenate(there), np.concatenate(there) * n + np.concatenate(here)])
        pairs = np.unique(pairs)
        starts = np.searchsorted(pairs // max(1, n), np.arange(n + 1))
        seeds = np.unique(np.linspace(0, n - 1, int(np.ceil(np.sqrt(n)))).astype(int))
        return cls(centroids, (pairs % max(1, n)).astype(np.int32), starts, seeds)

    def near(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of x, centroid and distance for the centroids found within 1 + ratio of each row's nearest distance, nearest first."""
        parts = [self._walk(x[i : i + TOGETHER], ratio, i) for i in range(0, len(x), TOGETHER)]
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    def _walk(self, x: np.ndarray, ratio: float, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the nearest seeds on, all neighbours of centroids that lie within reach of the best so far, until none is new."""
        n = len(self.centroids)
        seen = np.zeros((len(x), n), dtype=bool)
        best = np.full(len(x), np.inf)
        reach = 1 + max(ratio, 0.1)
        m = min(4, len(self.seeds))
        nodes = self.seeds[np.argsort(_distances(x, self.centroids[self.seeds]), axis=1, kind="stable")[:, :m]].ravel()
        rows = np.repeat(np.arange(len(x)), m)
        found = []
        while len(rows):
            seen[rows, nodes] = True
            d = np.sqrt(((x[rows] - self.centroids[nodes]) ** 2).sum(1))
            np.minimum.at(best, rows, d)
            found.append((rows, nodes, d))
            go = d <= reach * best[rows]
            rows, nodes = rows[go], nodes[go]
            first, count = self.starts[nodes], self.starts[nodes + 1] - self.starts[nodes]
            at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            rows, nodes = np.repeat(rows, count), self.neighbours[at]
            new = ~seen[rows, nodes]
            key = np.unique(rows[new].astype(np.int64) * n + nodes[new])
            rows, nodes = key // n, key % n
        rows, nodes, d = (np.concatenate(c) for c in zip(*found, strict=True))
        ok = d <= (1 + ratio) * best[rows]
        rows, nodes, d = rows[ok], nodes[ok], d[ok]
        order = np.lexsort((nodes, d, rows))
        return rows[order] + offset, nodes[order].astype(np.int32), d[order]

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of x and list, for the nearest list and boundary copies."""
        rows, nodes, d = self.near(x, BOUNDARY)
        first = np.searchsorted(rows, np.arange(len(x)))
        rank = np.arange(len(rows)) - first[rows]
        kept = np.full((len(x), COPIES), -1)
        kept[:, 0] = nodes[first]
        count, out = np.ones(len(x), dtype=int), [(np.arange(len(x)), nodes[first])]
        for r in range(1, LOOKED_AT):
            at = np.flatnonzero(rank == r)
            i, c = rows[at], nodes[at]
            to_kept = np.sqrt(((self.centroids[c][:, None] - self.centroids[kept[i]]) ** 2).sum(2))
            free = (count[i] < COPIES) & ~((to_kept < d[at, None]) & (kept[i] >= 0)).any(1)
            i, c = i[free], c[free]
            kept[i, count[i]] = c
            count[i] += 1
            out.append((i, c))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _matrix(column: pa.Array | pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=kind).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1), kind)


def _nearest(x: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows of x to q, equal distances by `least`, and their distances."""
    diff = x - q
    d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    at = np.arange(len(d))
    if len(d) > k:
        at = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    at = at[np.lexsort((least[at], d[at]))[:k]]
    return at, d[at]


def usable(vectors: DataFrame) -> DataFrame:
    """row, vec_id, embedding of the rows that take part, written."""
    e = F.col("embedding")
    finite = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e).where(F.col("vec_id").isNotNull() & (F.size(e) > 0)).where(finite & F.exists(e, lambda c: c != 0))
    kept = written(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")
    length = kept.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return kept.where(F.size("embedding") == (length["n"] if length else 0))


def points(vectors: DataFrame, k: int) -> DataFrame:
    """point, embedding, ids (the k + 1 smallest vec_ids with their rows) of each distinct vector, written."""
    order = Window.partitionBy("embedding").orderBy("vec_id", "row")
    first = vectors.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    found = first.groupBy("embedding").agg(F.array_sort(F.collect_list(F.struct("vec_id", "row"))).alias("ids"))
    return written(found.withColumn("point", F.monotonically_increasing_id()), "points")


def _some(found: DataFrame, rows: int, total: int) -> DataFrame:
    """About `rows` points, those with the lowest hashes, never more than twice as many."""
    share = min(1.0, rows / max(1, total))
    return found.where(F.pmod(F.xxhash64("point"), F.lit(1 << 40)) < int(share * (1 << 40)) + 1).limit(2 * rows)


def _exact(found: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """q (row of queries), point of the k nearest among all points, itself included."""
    shared = found.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                x, ids = _matrix(batch["embedding"][i : i + BLOCK]), np.asarray(batch["point"][i : i + BLOCK])
                new = [_nearest(x, q, ids, k) for q in shared.value]
                new = [(d, ids[at]) for at, d in new]
                best = new if best is None else [(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])) for a, b in zip(best, new, strict=True)]
                best = [(d[o], p[o]) for d, p in best for o in [np.lexsort((p, d))[:k]]]
        for q, (d, p) in enumerate(best or []):
            yield pa.RecordBatch.from_pydict({"q": pa.array(np.full(len(d), q, np.int32)), "d": d, "point": p})

    near = found.select("point", "embedding").mapInArrow(run, "q int, d double, point long")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d", "point"))).where(F.col("rank") <= k)


def fit_ratio(found: DataFrame, posts: DataFrame, graph: Graph, total: int, k: int) -> float:
    """The least ratio at which lists hold TARGET of the trial points' true neighbours."""
    trial = _some(found.select("point", "embedding"), TRIALS, total).toArrow()
    queries = _matrix(trial["embedding"])
    near = F.broadcast(_exact(found, queries, k + 1).select("q", "point"))  # at most 2 * TRIALS * (k + 1) rows
    placed = posts.select("list", "point").join(near, "point").toArrow()
    if not placed.num_rows:
        return 0.0
    q, lists = np.asarray(placed["q"]), np.asarray(placed["list"])
    d = _distances(queries, graph.centroids.astype(np.float64))
    needed = np.maximum(0, d[q, lists] / np.maximum(d.min(1)[q], 1e-30) - 1)
    pairs, at = np.unique(np.stack([q, np.asarray(placed["point"])]), axis=1, return_inverse=True)
    least = np.full(pairs.shape[1], np.inf)
    np.minimum.at(least, at.ravel(), needed)
    return float(np.quantile(least, TARGET, method="higher")) + 1e-4


def _posts(graph, kinds: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                rows, lists = graph.value.lists_of(_matrix(part["embedding"], np.float32))
                part = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), *part.columns], ["list", *part.schema.names])

    return run, f"list int, {kinds}"


def _asks(graph, ratio: float, kinds: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(i, TOGETHER)
                rows, lists, _ = graph.value.near(_matrix(part["embedding"], np.float32), ratio)
                part = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(lists), *part.columns], ["list", *part.schema.names])

    return run, f"list int, {kinds}"


def _scan(k: int):
    def run(key: tuple, lists: pa.Table, asks: pa.Table) -> pa.Table:
        """The nearest points of a block of a list to each query of a block of queries."""
        out = []
        if lists.num_rows and asks.num_rows:
            x, least = _matrix(lists["embedding"]), np.asarray(lists["least"])
            for q, vector in zip(asks["q"].to_pylist(), _matrix(asks["embedding"]), strict=True):
                at, d = _nearest(x, vector, least, k)
                out.append((np.full(len(at), q), d, at))
        q, d, at = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        chosen = lists.select(["point", "least"]).take(pa.array(at, pa.int64()))
        return pa.table({"q": pa.array(q, pa.int64()), "d": d, "point": chosen["point"], "least": chosen["least"]})

    return run


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query holds (of vec_id), its own row left out."""
    spark = vectors.sparkSession
    kept = usable(vectors)
    kind = kept.schema["embedding"].dataType.simpleString()
    found = points(kept, k)
    total = found.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = _matrix(_some(found.select("point", "embedding"), SAMPLE, total).toArrow()["embedding"], np.float32)
    fitted = Graph.of(fit_centroids(sample, min(MAX_LISTS, -(-total // LIST_ROWS))))
    graph = spark.sparkContext.broadcast(fitted)  # at most MAX_LISTS centroids

    run, kinds = _posts(graph, f"point long, least long, embedding {kind}")
    posts = written(found.select("point", F.col("ids")[0]["vec_id"].alias("least"), "embedding").mapInArrow(run, kinds), "posting-lists")
    ratio = fit_ratio(found, posts, fitted, total, k)

    asked = kept.where(is_query)
    distinct = written(asked.groupBy("embedding").agg(F.min("row").alias("q")), "queries")
    run, kinds = _asks(graph, ratio, f"q long, embedding {kind}")
    asks = written(distinct.select("q", "embedding").mapInArrow(run, kinds), "asked-lists")
    # rows of lists and of queries for each list: at most MAX_LISTS rows
    sizes = posts.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(asks.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("asked")), "list")
    sizes = F.broadcast(written(sizes, "list-sizes"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of_lists = posts.join(sizes, "list").withColumn("block", F.pmod(F.hash("point"), "blocks")).select("list", "block", every("asked").alias("side"), "point", "least", "embedding")
    of_asks = asks.join(sizes, "list").withColumn("side", F.pmod(F.hash("q"), "asked")).select("list", every("blocks").alias("block"), "side", "q", "embedding")
    key = ["list", "block", "side"]
    near = of_lists.groupBy(*key).cogroup(of_asks.groupBy(*key)).applyInArrow(_scan(k + 1), "q long, d double, point long, least long")
    best = Window.partitionBy("q").orderBy("d", "least")
    near = near.dropDuplicates(["q", "point"]).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    near = near.join(found.select("point", "ids"), "point").select("q", "d", F.explode("ids").alias("id")).select("q", "d", "id.*")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id", "row"))).where(F.col("n") <= k + 1)
    answers = near.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("d", "vec_id", "row"))).alias("answers"))
    answers = distinct.join(answers, "q").select("embedding", "answers")
    mine = asked.select("embedding", F.col("vec_id").alias("query_id"), F.col("row").alias("own")).join(answers, "embedding")
    mine = mine.select("query_id", F.slice(F.filter("answers", lambda a: a["row"] != F.col("own")), 1, k).alias("answers"))
    return mine.select("query_id", F.posexplode("answers").alias("at", "a")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("a.vec_id").alias("vec_id"), F.col("a.d").alias("score"))
