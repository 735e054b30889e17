"""Packing token sequences by cutting-stock column generation.

Documents are tokenised, ended with an end id and cut at every `capacity` tokens, so that each leaves whole sequences and
a rest. Rests are counted by length; lengths are rounded up to classes,
multiples of `unit` whose sizes grow by `ratio`. A linear program
chooses how often to use each pattern (a multiset of classes that fits a sequence): its columns are generated by a
knapsack dynamic program over the dual prices, from one pattern per class on. Pattern counts are rounded down, what
is then left over is placed first-fit by class, and the n-th rest of a class, longest first, gets the class's n-th slot.

Only the length histogram (capacity rows at most) reaches the driver. Ranks come from window counts over (class, bucket)
groups of bounded size, plus the buckets' running totals, so that a length which a third of all documents have is dealt
over many tasks.

Defined results: a null or empty text is its end id alone; repeated rows are packed each by itself; an empty table has no
pieces. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vocab import vocabulary

BUCKET = 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) of each piece of at most `capacity` tokens."""
    end = np.array([end_id], dtype="<u4").tobytes()
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), words.encode(batch["text"]), strict=True):
                raw += end
                for at in range(0, len(raw), width):
                    part = raw[at : at + width]
                    rows.append((doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(raw) // 4, part))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + ", ids binary" * with_ids)


def class_sizes(capacity: int, ratio: float, unit: int) -> np.ndarray:
    """Multiples of `unit` that lengths under `capacity` are rounded up to."""
    sizes = [unit]
    while sizes[-1] < capacity - 1:
        sizes.append(min(-(-capacity // unit) * unit, max(sizes[-1] + unit, int(sizes[-1] * ratio) // unit * unit)))
    return np.array(sizes)


def _best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of items that fits, by dynamic programming over the capacity."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for room in range(int(sizes[0]), capacity + 1):
        k = int(np.searchsorted(sizes, room, side="right"))
        values = best[room - sizes[:k]] + prices[:k]
        i = int(values.argmax())
        if values[i] > best[room - 1]:
            best[room], took[room] = values[i], i
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
            continue
        pattern[took[room]] += 1
        room -= int(sizes[took[room]])
    return float(best[capacity]), pattern


def cutting_plan(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, most: int = 4000) -> list[tuple[int, np.ndarray]]:
    """(times, pattern) pairs that cover the demand of each class."""
    used = np.flatnonzero(demand > 0)
    if not len(used):
        return []
    s, d = sizes[used], demand[used].astype(float)
    m = len(s)
    basis = [np.eye(m, dtype=np.int64)[i] * (capacity // int(s[i])) for i in range(m)]
    inverse = np.diag([1 / (capacity // int(x)) for x in s])
    for _ in range(most):
        prices = np.maximum(inverse.sum(axis=0), 0.0)
        value, pattern = _best_pattern(s, prices, capacity)
        if value <= 1 + gap:
            break
        x, step = inverse @ d, inverse @ pattern
        up = np.flatnonzero(step > 1e-12)
        leave = int(up[np.argmin(x[up] / step[up])])
        basis[leave] = pattern
        pivot = inverse[leave] / step[leave]
        inverse = inverse - np.outer(step, pivot)
        inverse[leave] = pivot
    x = np.maximum(inverse @ d, 0.0)
    plan, left = [], demand[used].astype(np.int64).copy()
    for times, pattern in sorted(zip(x, basis, strict=True), key=lambda p: -p[0]):
        held = np.flatnonzero(pattern)
        whole = int(min(int(times + 1e-9), *(left[i] // pattern[i] for i in held)))
        if whole > 0:
            plan.append((whole, pattern))
            left -= whole * pattern
    bins: list[tuple[int, np.ndarray]] = []
    for i in range(m - 1, -1, -1):  # first fit of what rounding left over, largest class first
        for b, (room, pattern) in enumerate(bins):
            n = int(min(left[i], room // s[i]))
            if n:
                pattern[i] += n
                left[i] -= n
                bins[b] = (room - n * int(s[i]), pattern)
        per = capacity // int(s[i])
        while left[i] > 0:
            n = int(min(left[i], per))
            pattern = np.zeros(m, dtype=np.int64)
            pattern[i] = n
            bins.append((capacity - n * int(s[i]), pattern))
            left[i] -= n
    plan += [(1, pattern) for _, pattern in bins]
    wide = []
    for times, pattern in plan:
        full = np.zeros(len(sizes), dtype=np.int64)
        full[used] = pattern
        wide.append((times, full))
    return wide


@dataclass(frozen=True)
class Slots:
    """For each class: first ranks of its runs of slots, with each run's first sequence, slots per sequence and place."""

    first: list[np.ndarray]
    sequence: list[np.ndarray]
    per: list[np.ndarray]
    place: list[np.ndarray]

    @classmethod
    def of(cls, plan: list[tuple[int, np.ndarray]], n_classes: int, n_full: int) -> Slots:
        runs: list[list[tuple[int, int, int, int]]] = [[] for _ in range(n_classes + 1)]
        ranks, sequence = [0] * n_classes, 0
        for times, pattern in plan:
            place = 0
            for c in np.flatnonzero(pattern)[::-1]:
                n = int(pattern[c])
                runs[c].append((ranks[c], sequence, n, place))
                ranks[c] += times * n
                place += n
            sequence += times
        runs[n_classes].append((0, sequence, 1, 0))
        columns = [[np.array(x, dtype=np.int64) for x in zip(*r, strict=True)] if r else [np.zeros(0, np.int64)] * 4 for r in runs]
        return cls(*[list(x) for x in zip(*columns, strict=True)])

    def of_ranks(self, c: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, place = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        for k in np.unique(c):
            at = np.flatnonzero(c == k)
            r = np.searchsorted(self.first[k], rank[at], side="right") - 1
            own = rank[at] - self.first[k][r]
            sequence[at] = self.sequence[k][r] + own // self.per[k][r]
            place[at] = self.place[k][r] + own % self.per[k][r]
        return sequence, place


def pack(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 4096, ratio: float = 1.02, unit: int = 16, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) of every piece."""
    spark = docs.sparkSession
    pieces = cut_pieces(docs, path, end_id, capacity, with_ids).withColumn("_uid", F.monotonically_increasing_id())
    pieces = written(pieces, "pieces")
    sizes = class_sizes(capacity, ratio, unit if capacity % unit == 0 else 1)
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    demand = np.zeros(len(sizes) + 1, dtype=np.int64)
    for length, n in counts.items():
        demand[np.searchsorted(sizes, length) if length < capacity else len(sizes)] += n
    slots = spark.sparkContext.broadcast(Slots.of(cutting_plan(sizes // sizes[0], demand[:-1], capacity // int(sizes[0])), len(sizes), int(demand[-1])))
    of_length = np.append(np.searchsorted(sizes, np.arange(capacity)), len(sizes))
    # two literal arrays of fixed length: the class of a length, the buckets of a class
    pieces = pieces.withColumn("_class", F.get(F.lit(of_length.tolist()), F.col("length").cast("int")))
    buckets = np.maximum(1, -(-demand // BUCKET))
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("_uid"), F.get(F.lit(buckets.tolist()), F.col("_class").cast("int"))))
    sums = pieces.groupBy("_class", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_class", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_class", "_bucket").orderBy(F.desc("length"), "_uid")
    ranked = pieces.withColumn("_rank", F.row_number().over(inside)).join(sums, ["_class", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before") - 1)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, place = slots.value.of_ranks(batch["_class"].to_numpy(), batch["_rank"].to_numpy())
            rest = batch.drop_columns(["_class", "_rank"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sequence), pa.array(place)], [*rest.schema.names, "sequence_id", "_place"])

    ids = ", ids binary" * with_ids
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    out = ranked.select(*columns, F.col("_class").cast("long").alias("_class"), F.col("_rank").cast("long").alias("_rank"))
    out = out.mapInArrow(placed, PIECES + ids + ", sequence_id long, _place long")
    ahead = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("_place")
