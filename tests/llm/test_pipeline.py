"""The pipeline's stages one by one against plain Python on their predecessors' rows, and as a chain on odd and empty tables."""

import math
from pathlib import Path

import duckdb
import pytest
from helpers import SF_DIR
from test_line_dedup import brute_passages
from test_minhash import brute as brute_links

import corpus_pipeline
from tracequarry.llm import sql
from tracequarry.llm.common import written
from tracequarry.llm.queries import toxicity_model
from tracequarry.llm.toxicity import LEVEL, MOST_EXPONENT, STRIP, score_toxicity


def best_segment(w, a, b):
    """Start, end and sum of the best segment of w[a:b], the shortest of equals: one pass over sums."""
    total = low = 0.0
    at, best = a, (0.0, 0, a, a)
    for j in range(a, b):
        if total <= low:
            low, at = total, j
        total += w[j]
        best = max(best, (total - low, at - j - 1, at, j + 1), key=lambda x: (x[0], x[1]))
    return best[2], best[3], best[0]


def plain_score(text, model):
    """The score by its definition: segments split off one by one, tail exponents, logistic."""
    w = [model.weight(x.strip(STRIP)) for x in (text or "").lower().split()]
    sums, todo = [], [(0, len(w))]
    while todo and max(w, default=0) > 0:
        a, b = todo.pop()
        i, j, s = best_segment(w, a, b)
        if s > 0:
            sums.append(s)
            todo += [(a, i), (j, b)]
    expected = [model.scale * max(1, len(w)) * math.exp(-model.rate * s) for s in sums]
    z = model.coefficients[0]
    if sums:
        clear = sum(1 - math.exp(-e) <= LEVEL for e in expected)
        z += model.coefficients[1] * min(MOST_EXPONENT, max(0.0, -math.log(min(expected)))) + model.coefficients[2] * math.log(max(1, clear))
    return 1 / (1 + math.exp(-z)) if model.weights else 0.0


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, documents):
    """Every stage keeps the very rows and texts that plain Python, or SQL, keeps of what the stage before left."""
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before, out = texts_of(docs), written(stage(spark, docs, SF_DIR), name)
        if name != "packing":
            assert out.columns == documents.columns
            kept[name] = texts_of(out)
            assert out.count() == len(kept[name])
        if name == "quality":
            con = duckdb.connect()
            con.sql(f"CREATE VIEW documents AS SELECT * FROM '{Path(SF_DIR)}/documents.parquet'")
            good = {i for (i,) in con.sql(f"SELECT doc_id FROM ({sql.quality_rules_sql()}) WHERE kept").fetchall()}
            assert kept[name] == {i: t for i, t in before.items() if i in good}
        if name == "toxicity":
            model = toxicity_model(spark, SF_DIR)
            scores = {r["doc_id"]: r["toxicity"]["score"] for r in score_toxicity(docs, model).collect()}
            assert scores == pytest.approx({i: plain_score(t, model) for i, t in before.items()}, rel=1e-6, abs=1e-9)
            assert kept[name] == {i: t for i, t in before.items() if scores[i] < model.cut}
        if name == "line_dedup":
            want = brute_passages([(i, t) for i, t in before.items()])
            assert kept[name] == {i: t for i, t in want.items() if t == before[i] or t.strip(" \t\n\v\f\r")}
            assert {r["doc_id"]: r["n_chars"] for r in out.collect()} == {i: len(t) for i, t in kept[name].items()}
        if name == "near_dedup":
            first = {i for i, _, _, stays in brute_links(list(before.items()), 5, 80) if stays}
            assert kept[name] == {i: t for i, t in before.items() if str(i) in first}
        docs = out
    assert {r["doc_id"] for r in docs.collect()} == set(kept["near_dedup"])
    assert len(kept["near_dedup"]) > 0.5 * len(kept["quality"])


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_chain_of_odd_and_empty_tables(spark, odd, none, rows):
    """Null and empty texts, repeated and null doc_ids, clashing columns, and no rows at all go through every stage."""
    docs = {"odd": odd.unionByName(odd.selectExpr("doc_id + 1000 doc_id", "concat_ws(' ', transform(sequence(1, 90), i -> concat('word', i * doc_id))) text", "'en' lang", "source", "n_chars", "_key", "_text")), "none": none}[rows]
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs.count(), written(stage(spark, docs, SF_DIR), name)
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
        else:
            assert out.columns == docs.columns and out.count() <= before
            assert (out.count() > 0) == (rows == "odd")
        docs = out


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
