"""Toxic passages as maximum-scoring segments of token log-odds.

Learning. A bounded sample of labelled rows (the `max_labelled` of lowest hash of doc_id; of near copies, which share the
smallest hash of their word 5-grams, one) is split by hash: four fifths give unit weights, one fifth calibrates. Units
are words and word prefixes of PREFIXES characters. A unit's weight is the log-odds of its rate in toxic and other
documents under a Dirichlet prior, a flat part plus `prior` pseudo-counts shared out by the unit's overall rate; units of
at least `min_weight` whose log-odds lie over `min_z` standard errors above zero are kept, the `max_units` clearest at
most. Words that are more frequent than their toxic prefix suggests keep their own weight.

Scoring. Each word has its unit's weight, or a small negative one. One left-to-right scan finds all maximal scoring
segments in linear time: each candidate remembers the nearest one before it whose sum of all earlier weights is smaller,
so no candidate is passed twice.

Calibration. The number of segments of score s or more in a clean text of n words follows an extreme-value tail
K n exp(-lambda s); lambda and K are fitted on the segments of the calibration fold's clean rows that reach TAIL. A
segment is significant if its tail probability 1 - exp(-K n exp(-lambda s)) is at most LEVEL. A document's score is
logistic in the tail's exponent of its best segment and in the number of further significant segments. `cut` is the least
score that at most `false_alarms` of the calibration fold's clean rows reach, within CUTS.

Defined results: null and empty texts have no segment and get the score of no evidence; rows are scored one by one, so
repeated rows get equal scores; labels with a null doc_id or label are left out and of repeated ones the larger counts;
with no toxic or no clean labelled rows there are no weights and every score is 0. The input's own columns are kept
beside one struct column, which replaces an input column of its name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_texts, written

PREFIXES = (7, 6, 5, 4)
STRIP = ".,;:!?|#*$%&\"'()[]{}<>-_"
BACKGROUND = -0.08
MEMO = 400_000
#: Least score of a segment that the tail is fitted on; tail probability of a significant one; bounds of the cut.
TAIL, LEVEL, CUTS = 1.5, 0.01, (0.1, 0.7)
MOST_EXPONENT = 40.0
#: Scores of a labelled text that calibration looks at, the best ones; scoring looks at all.
MOST_LISTED = 200


def tokens(text: str | None) -> list[str]:
    return [w.strip(STRIP) for w in (text or "").lower().split()]


@dataclass(frozen=True)
class ToxicityModel:
    """weights: of words, and of prefixes under '^' + prefix. rate and scale: lambda and K. coefficients: intercept,
    exponent of the best segment, log of further significant segments."""

    weights: dict[str, float]
    rate: float = 1.0
    scale: float = 1.0
    coefficients: tuple[float, float, float] = (0.0, 0.0, 0.0)
    cut: float = CUTS[1]

    def weight(self, word: str) -> float:
        if (w := self.weights.get(word)) is not None:
            return w
        for k in PREFIXES:
            if len(word) >= k and (w := self.weights.get("^" + word[:k])) is not None:
                return w
        return BACKGROUND

    def exponent(self, n: int, score: float) -> float:
        """-log of the expected number of segments of that score in a clean text of n words."""
        return self.rate * score - math.log(self.scale * max(1, n))

    def p_value(self, n: int, score: float) -> float:
        return -math.expm1(-math.exp(min(60.0, -self.exponent(n, score))))

    def features(self, n: int, scores: list[float]) -> tuple[float, float, float]:
        if not scores:
            return 1.0, 0.0, 0.0
        clear = sum(self.p_value(n, s) <= LEVEL for s in scores)
        return 1.0, min(MOST_EXPONENT, max(0.0, self.exponent(n, max(scores)))), math.log1p(max(0, clear - 1))

    def probability(self, n: int, scores: list[float]) -> float:
        if not self.weights:
            return 0.0
        z = sum(a * b for a, b in zip(self.coefficients, self.features(n, scores), strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def maximal_segments(weights: list[float]) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal scoring segments, in one scan; end is exclusive."""
    starts: list[int] = []
    ends: list[int] = []
    lefts: list[float] = []  # sum of all weights before the segment
    rights: list[float] = []  # and with it
    nearest: list[int] = []  # the last segment before with a smaller left sum, -1 if none
    total = 0.0
    for i, w in enumerate(weights):
        before, total = total, total + w
        if w <= 0:
            continue
        start, left, j = i, before, len(lefts) - 1
        while j >= 0 and lefts[j] >= left:
            j = nearest[j]
        while j >= 0 and rights[j] < total:
            start, left = starts[j], lefts[j]
            k, j = j, nearest[j]
            for column in (starts, ends, lefts, rights, nearest):
                del column[k:]
        for column, value in ((starts, start), (ends, i + 1), (lefts, left), (rights, total), (nearest, j)):
            column.append(value)
    return [(s, e, r - l) for s, e, l, r in zip(starts, ends, lefts, rights, strict=True)]


class _Weights(dict):
    """Weights above or below the background by written word, 0 for background words; of bounded size."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        w = self.model.weight(word.strip(STRIP))
        self[word] = x = 0.0 if w == BACKGROUND else w
        return x


def segments(text: str | None, known: _Weights) -> tuple[int, list[tuple[int, int, float]]]:
    """The number of words, and (start, end, score) in words of each maximal toxic segment.

    Runs of background words are one item each: segments begin and end at other words."""
    words = (text or "").lower().split()
    hits = [(i, w) for i, w in enumerate(map(known.__getitem__, words)) if w]
    if not any(w > 0 for _, w in hits):
        return len(words), []
    items, places, last = [], [], hits[0][0]
    for i, w in hits:
        if i > last:
            items.append(BACKGROUND * (i - last))
            places.append(last)
        items.append(w)
        places.append(i)
        last = i + 1
    return len(words), [(places[s], places[e - 1] + 1, score) for s, e, score in maximal_segments(items)]


def _sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """doc_id, text, toxic of the labelled rows that are learned from."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    return labelled_texts(docs, chosen)  # at most max_labelled rows


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = []
        for words in map(tokens, batch["text"].to_pylist()):
            grams = (" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
            keys.append(min(xxhash.xxh64_intdigest(g) for g in grams) >> 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], [*batch.schema.names, "key"])


def _unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each unit, by label, added up over a task in steps of bounded size."""
    counts = (Counter(), Counter())

    def drained() -> pa.RecordBatch:
        units = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_pydict({"unit": pa.array(units, pa.string()), "clean": pa.array([counts[0][u] for u in units], pa.int64()), "toxic": pa.array([counts[1][u] for u in units], pa.int64())})
        counts[0].clear()
        counts[1].clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            own = set(tokens(text))
            own |= {"^" + w[:k] for w in own for k in PREFIXES if len(w) >= k}
            own.discard("")
            counts[int(toxic)].update(own)
        if len(counts[0]) + len(counts[1]) > MEMO:
            yield drained()
    yield drained()


def _weights(train: DataFrame, prior: float, min_z: float, min_weight: float, max_units: int) -> dict[str, float]:
    counted = train.mapInArrow(_unit_counts, "unit string, clean long, toxic long").groupBy("unit").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    by_label = {int(r["toxic"]): r["count"] for r in train.groupBy("toxic").count().collect()}
    clean, toxic = by_label.get(0, 0), by_label.get(1, 0)
    if not clean or not toxic:
        return {}
    rate = (F.col("c") + F.col("t")) / (clean + toxic)
    a = 0.5 + prior * rate
    odds = lambda k, n: F.log((F.col(k) + a) / (n + 1 + prior - F.col(k) - a))
    scored = counted.withColumn("w", odds("t", toxic) - odds("c", clean)).withColumn("z", F.col("w") / F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a)))
    up = scored.where((F.col("z") >= min_z) & (F.col("w") >= min_weight)).orderBy(F.desc("z"), "unit").limit(max_units).select("unit", "w").collect()
    weights = {r["unit"]: float(r["w"]) for r in up}
    toxic_prefixes = [u[1:] for u in weights if u[0] == "^"]
    if toxic_prefixes:  # a word often seen in clean text is an exception to its prefix
        own = F.array(*[F.concat(F.lit("^"), F.substring("unit", 1, k)) for k in PREFIXES])
        listed = F.broadcast(train.sparkSession.createDataFrame([("^" + p,) for p in toxic_prefixes], "p string"))
        plain = scored.where(~F.col("unit").startswith("^") & (F.col("c") >= 3) & (F.col("z") < 0))
        odd = plain.withColumn("p", F.explode(F.array_distinct(own))).join(listed, "p", "left_semi").dropDuplicates(["unit"]).orderBy("z", "unit").limit(max_units)
        weights |= {r["unit"]: float(min(r["w"], BACKGROUND)) for r in odd.select("unit", "w").collect()}
    return weights


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton's method."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def _tail(n: np.ndarray, scores: list[list[float]]) -> tuple[float, float]:
    """lambda and K of the clean rows' segments; a prior worth one segment keeps both defined."""
    over = np.array([s - TAIL for own in scores for s in own if s >= TAIL])
    rate = (len(over) + 1) / (over.sum() + 1)
    return float(rate), float((len(over) + 0.5) * math.exp(min(50.0, rate * TAIL)) / max(1.0, n.sum()))


def learn_toxicity(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 40_000, max_units: int = 100_000, prior: float = 1.0, min_z: float = 3.3,
    min_weight: float = 1.5, false_alarms: float = 0.01,
) -> ToxicityModel:
    """A model from docs (doc_id, text) and labels (doc_id, toxic). What reaches the driver is bounded by max_labelled and max_units."""
    keyed = written(_sample(docs, labels, max_labelled).mapInArrow(_with_keys, "doc_id long, text string, toxic int, key long"), "toxicity")
    one = keyed.groupBy("key", "toxic").agg(F.min("doc_id").alias("doc_id"))
    train = keyed.join(F.broadcast(one.select("doc_id")), "doc_id", "left_semi")
    fold = F.pmod(F.xxhash64("key"), F.lit(5))
    weights = _weights(train.where(fold != 0), prior, min_z, min_weight, max_units)
    if not weights:
        return ToxicityModel({})
    draft = ToxicityModel(weights)

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Weights(draft)
        for pdf in batches:
            found = [segments(text, known) for text in pdf["text"]]
            best = [sorted((s for *_, s in own), reverse=True)[:MOST_LISTED] for _, own in found]
            yield pd.DataFrame({"n": [n for n, _ in found], "scores": best, "toxic": pdf["toxic"].to_numpy()})

    held = train.where(fold == 0).mapInPandas(seen, "n long, scores array<double>, toxic int").toPandas()
    n, y = held["n"].to_numpy(dtype=float), held["toxic"].to_numpy(dtype=float)
    scores = [list(s) for s in held["scores"]]
    rate, scale = _tail(n[y == 0], [s for s, t in zip(scores, y, strict=True) if t == 0])
    model = ToxicityModel(weights, rate, scale)
    x = np.array([model.features(k, s) for k, s in zip(held["n"], scores, strict=True)]).reshape(-1, 3)
    b = _fit(x, y)
    if b[2] < 0:  # more passages are no reason against
        b = (*_fit(x[:, :2], y), 0.0)
    model = replace(model, coefficients=b)
    clean = [model.probability(k, s) for k, s, t in zip(held["n"], scores, y, strict=True) if t == 0]
    cut = float(np.quantile(clean, 1 - false_alarms, method="higher")) + 1e-9 if clean else CUTS[1]
    return replace(model, cut=min(CUTS[1], max(CUTS[0], cut)))


SEGMENT = pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())])


def score_toxicity(docs: DataFrame, model: ToxicityModel, out: str = "toxicity", threshold: float = 0.7) -> DataFrame:
    """docs with a struct column `out`: score, predicted, n_segments, the best segment's first and last word and score, and
    segments: all that are significant, in order of place."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(
        "score double, predicted int, n_segments int, first_word int, last_word int, segment_score double, "
        "segments array<struct<first_word:int,last_word:int,score:double,p_value:double>>"
    )
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        known = _Weights(m)
        for batch in texts:
            rows = []
            for text in batch.to_pylist():
                n, found = segments(text, known)
                p = m.probability(n, [s for *_, s in found])
                first, last, best = max(found, key=lambda x: (x[2], -x[0]), default=(None, None, 0.0))
                clear = [(a, b - 1, s, q) for a, b, s in found if (q := m.p_value(n, s)) <= LEVEL]
                rows.append((p, int(p >= threshold), len(clear), first, None if last is None else last - 1, best, [dict(zip(SEGMENT.names, c, strict=True)) for c in clear]))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(SEGMENT))
            names = ["score", "predicted", "n_segments", "first_word", "last_word", "segment_score", "segments"]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(*[docs[c] for c in docs.columns if c != out], scored(docs["text"]).alias(out))


def reject_toxic(docs: DataFrame, model: ToxicityModel, threshold: float | None = None) -> DataFrame:
    """The documents whose score stays under the threshold, the model's cut unless given, with their own columns only."""
    out = "_toxicity_score"
    return score_toxicity(docs, model, out, model.cut if threshold is None else threshold).where(F.col(out)["predicted"] == 0).select(*docs.columns)
