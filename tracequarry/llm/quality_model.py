"""Document quality by hierarchical empirical Bayes.

Evidence. A logistic regression on FEATURES of the text gives each document a log-odds; it is fitted on the `max_labelled`
labelled rows of lowest hash of doc_id.

Hierarchy. Host and path rates are posteriors of that evidence: per-document probabilities are summed by (host, path)
and by host, and each sum is shrunk toward the level above by a pseudo-count that the method of moments estimates from
all groups (between-group variance against what the groups' sizes explain). Sparse sites so stay near their host, and
sparse hosts near the global rate. A document's own probability is taken out of its group's sums. The score is the
document's log-odds with the prior log-odds of its site in place of the training rows' rate.

Groups are aggregated before the shuffle, so a host with a third of all rows costs one row per task.

Defined results: null and empty texts have the features of no words; a null host or path is a group of its own; labels
with a null doc_id or label are left out, repeated ones take the smaller; without labels of both kinds the evidence is
0 for all; repeated rows count each. Columns other than doc_id, text, host and path are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_texts, small, written

FEATURES = ("one", "log_words", "distinct", "word_length", "symbols", "capitals", "marks", "short_words", "repeated_lines", "top_word")
SYMBOLS = frozenset("#*$%&|<>")
FLOOR = 1e-4


def features(text: str | None) -> tuple[float, ...]:
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    distinct = set(words)
    lines = [x for x in text.split("\n") if x.strip()]
    common = max(Counter(words).values(), default=0)
    return (
        1.0,
        math.log1p(len(words)) / 4,
        len(distinct) / n,
        min(30.0, sum(map(len, words)) / n) / 6,
        min(1.0, 10 * sum(text.count(c) for c in SYMBOLS) / chars),
        min(1.0, 4 * (chars - len(text) + sum(map(str.isupper, text))) / chars),
        min(1.0, 10 * sum(text.count(c) for c in ".,;:!?") / chars),
        sum(len(w) < 4 for w in words) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        common / n,
    )


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [list(features(t)) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["good"], pa.array(rows, pa.list_(pa.float64()))], ["good", "x"])


def fit_evidence(docs: DataFrame, labels: DataFrame, max_labelled: int = 40_000, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Coefficients, and the log-odds of the training rows' rate. At most max_labelled rows of numbers reach the driver."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    rows = labelled_texts(docs, chosen).select("good", "text").mapInArrow(_featured, "good int, x array<double>").toPandas()
    if rows["good"].nunique() < 2:
        return np.zeros(len(FEATURES)), 0.0
    x, y = np.stack(rows["x"].to_numpy()), rows["good"].to_numpy(dtype=float)
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    rate = min(1 - FLOOR, max(FLOOR, float(y.mean())))
    return b, math.log(rate / (1 - rate))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(FLOOR), F.least(F.lit(1 - FLOOR), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: str) -> DataFrame:
    """One row: the pseudo-count by which a group's rate p of n documents is shrunk toward `mean`."""
    usual = F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean)))
    between = F.sum(F.col("n") * F.pow(F.col("p") - F.col(mean), 2))
    return groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), usual.alias("u"), between.alias("b"), F.sum(F.col("n") * F.col("n")).alias("q")).select(
        # variance between groups beyond what k groups of these sizes show by chance
        F.coalesce(F.try_divide(F.col("u") / F.col("n"), F.greatest(F.lit(1e-6), F.try_divide(F.col("b") - F.col("u") * F.col("k") / F.col("n"), F.col("n") - F.col("q") / F.col("n")))) - 1, F.lit(100.0)).alias("m")
    ).select(F.least(F.lit(10_000.0), F.greatest(F.lit(1.0), F.col("m"))).alias("m"))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_labelled: int = 40_000) -> DataFrame:
    """doc_id, evidence (log-odds), host_rate, path_rate, score, kept of each row of docs (doc_id, text, host, path)."""
    b, base = fit_evidence(docs, labels, max_labelled)

    @F.pandas_udf("double")
    def evidence(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([features(t) for t in batch]).reshape(-1, len(b)) @ b, dtype=float)

    scored = docs.select("doc_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), evidence("text").alias("evidence"))
    scored = written(scored.withColumn("p", 1 / (1 + F.exp(-F.col("evidence")))), "evidence")
    total = scored.agg(F.avg("p").alias("all"))
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).crossJoin(F.broadcast(total))  # one row
    hosts = hosts.withColumn("p", F.col("s") / F.col("n"))
    hosts = hosts.crossJoin(F.broadcast(_strength(hosts, "all"))).withColumn("rate", (F.col("s") + F.col("m") * F.col("all")) / (F.col("n") + F.col("m")))
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), F.col("m").alias("host_m"), "all", F.col("rate").alias("host_rate"))
    sites = paths.join(hosts, "host").withColumn("p", F.col("s") / F.col("n"))
    sites = sites.crossJoin(F.broadcast(_strength(sites, "host_rate").withColumnRenamed("m", "path_m")))
    sites = sites.select("host", "path", "n", "s", "path_m", "host_n", "host_s", "host_m", "all")
    sites = written(sites, "sites")
    joined = scored.join(small(sites), ["host", "path"])  # by shuffles, with Spark's skew join, where there are many sites
    own = F.col("p")
    host_rate = (F.col("host_s") - own + F.col("host_m") * F.col("all")) / (F.col("host_n") - 1 + F.col("host_m"))
    joined = joined.withColumn("host_rate", host_rate)
    joined = joined.withColumn("path_rate", (F.col("s") - own + F.col("path_m") * F.col("host_rate")) / (F.col("n") - 1 + F.col("path_m")))
    score = 1 / (1 + F.exp(-(F.col("evidence") - F.lit(base) + _logit(F.col("path_rate")))))
    return joined.select("doc_id", "evidence", "host_rate", "path_rate", score.alias("score"), (score >= threshold).alias("kept"))
