"""Toxicity, fingerprints, quality rules and the quality classifier against plain Python, and on held-out labels."""

import hashlib
import math
import re
import time
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracequarry.llm import queries
from tracequarry.llm.fingerprint import digest, edited, fingerprints, likeness
from tracequarry.llm.quality_model import FEATURES, classify_quality, features
from tracequarry.llm.quality_rules import quality_rules, reject_low_quality
from tracequarry.llm.toxicity import ToxicityModel, _tail, learn_toxicity, maximal_segments, reject_toxic, score_toxicity

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_segments(w):
    """By definition: split off the best segment (the shortest, leftmost of equals), then left and right of it."""
    def go(a, b):
        sums = [0, *accumulate(w[a:b])]
        best = max(((sums[j] - sums[i], -(j - i), -i) for i in range(b - a) for j in range(i + 1, b - a + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i = a - best[2]
        j = i - best[1]
        return [*go(a, i), (i, j, best[0]), *go(j, b)]

    return go(0, len(w))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-5, 5).filter(bool), max_size=14))
def test_segments(w):
    found = maximal_segments([float(x) for x in w])
    assert max((s for *_, s in found), default=0) == max((s for *_, s in brute_segments(w)), default=0)
    for a, b, s in found:
        assert sum(w[a:b]) == s and all(x > 0 for x in accumulate(w[a:b])) and all(x > 0 for x in accumulate(w[a:b][::-1]))
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
    assert {i for a, b, _ in found for i in range(a, b)} >= {i for i, x in enumerate(w) if x > 0}


@pytest.mark.parametrize("seed", range(200))
def test_segments_are_those_of_the_definition(seed):
    w = np.random.default_rng(seed).normal(-0.1, 1, seed % 40).tolist()
    assert [(a, b) for a, b, _ in maximal_segments(w)] == [(a, b) for a, b, _ in brute_segments(w)]


@pytest.mark.parametrize("pattern", [[3.0, -4.0], [3.0, -2.0], [1.0, -1.5, 0.2], [5.0, -0.1, -7.0]])
def test_segments_take_linear_time(pattern):
    w = pattern * (100_000 // len(pattern))
    began = time.process_time()
    maximal_segments(w)
    assert time.process_time() - began < 2


def test_extreme_value_tail():
    """lambda and K are found again from drawn scores, and p-values are those of the tail."""
    r = np.random.default_rng(7)
    n = np.full(4000, 200.0)
    scores = [(1.5 + r.exponential(1 / 1.3, r.poisson(0.4))).tolist() for _ in n]
    rate, scale = _tail(n, scores)
    assert abs(rate - 1.3) < 0.1 and abs(scale * 200 * math.exp(-1.5 * rate) - 0.4) < 0.04
    m = ToxicityModel({}, rate, scale)
    got = np.mean([max(own, default=0) >= 3 for own in scores])
    assert abs(m.p_value(200, 3.0) - got) < 0.02 and m.p_value(200, 3.0) > m.p_value(200, 4.0) and m.p_value(100, 3.0) < m.p_value(200, 3.0)


def test_two_passages_far_apart(spark):
    model = ToxicityModel({"bad": 6.0, "awful": 6.0, "weak": 0.5}, 1.2, 0.01, (-4.0, 1.0, 0.0))
    text = " ".join(["bad awful", *["plain"] * 300, "weak", *["plain"] * 300, "awful! Bad."])
    r = score_toxicity(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()["toxicity"]
    assert [(s["first_word"], s["last_word"]) for s in r["segments"]] == [(0, 1), (603, 604)] and r["n_segments"] == 2
    assert all(s["score"] == 12 and s["p_value"] < 0.01 for s in r["segments"])


def auc(y, s):
    y, s = np.array(y), np.array(s)
    return np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])


def test_toxicity_on_held_out_labels(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null").collect()}
    held = [(labels[r["doc_id"]], r["score"], r["predicted"]) for r in queries.op5_toxicity(spark, SF).collect() if r["held_out"] and r["doc_id"] in labels]
    assert auc([y for y, *_ in held], [s for _, s, _ in held]) > 0.85
    assert sum(p for y, _, p in held if y == 0) <= 0.05 * len(held)


def test_toxicity_rows(spark, odd, none):
    model = ToxicityModel({"bad": 3.0, "^awful": 2.0}, 1.5, 0.01, (-4.0, 1.5, 0.0), 0.7)
    out = score_toxicity(odd, model)
    assert out.columns == [*odd.columns, "toxicity"] and out.count() == odd.count()
    assert reject_toxic(odd, model).columns == odd.columns and reject_toxic(none, model).count() == 0
    r = score_toxicity(spark.createDataFrame([(1, "so bad, awfully Bad! fine")], "doc_id long, text string"), model).first()["toxicity"]
    assert (r["first_word"], r["last_word"], r["n_segments"], r["predicted"]) == (1, 3, 1, 1)
    empty = learn_toxicity(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert score_toxicity(odd, empty).where("toxicity.score > 0").count() == 0


def test_fingerprints(documents, odd):
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        changed = (t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()
        a, b, c = digest(t.encode()), digest(changed), digest(after.encode())
        want.append((str(i), len(t), hashlib.sha256(changed).hexdigest(), a.hex(), b.hex(), likeness(a, b), likeness(a, c)))
    for range_bytes in (16 << 20, 20_000):
        assert sorted((str(r[0]), *r[1:]) for r in fingerprints(docs, range_bytes).collect()) == sorted(want)


@given(st.binary(max_size=300), st.binary(max_size=300))
def test_likeness(a, b):
    x, y = digest(a), digest(b)
    assert likeness(x, x) == 1 and 0 <= likeness(x, y) == likeness(y, x) <= 1
    assert edited("abcde", "XY1") == "abcXY" and edited("ab", "") == "a" and edited("", "x") == ""


def test_likeness_tells_edits_from_others(spark):
    r = queries.op6_fingerprint(spark, SF).where("n_chars > 400").selectExpr("avg(near_edited) e", "avg(near_next) n").first()
    assert r["e"] > r["n"] + 0.1


def base_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_quality_counts(documents, odd, none):
    docs = documents.select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang"))
    want = sorted((str(r["doc_id"]), *base_counts(r["text"])) for r in docs.collect())
    got = quality_rules(docs, keep=["doc_id"]).select("doc_id", "quality.*").collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    assert reject_low_quality(odd).columns == odd.columns and quality_rules(none).count() == 0


def test_quality_classifier(spark, odd, none):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null").collect()}
    held = [(labels[r["doc_id"]], r["score"]) for r in queries.op3_quality_classifier(spark, SF).collect() if r["held_out"] and r["doc_id"] in labels]
    assert auc(*zip(*held, strict=True)) > 0.85
    sites = odd.selectExpr("doc_id", "text", "lang as host", "source as path")
    marks = spark.createDataFrame([(9004, 1), (9005, 0), (9005, 1), (None, 1), (9006, None)], "doc_id long, quality int")
    assert classify_quality(sites, marks).count() == odd.count()
    assert classify_quality(sites.where("false"), marks).count() == 0
    assert classify_quality(sites, marks.where("false")).where("score is null").count() == 0


def test_site_rates(spark):
    """Posteriors against the same sums in plain Python."""
    rows = [(i, "word " * (3 + i % 5) + ("#$ " * (i % 3)), f"h{i % 4 % 3}", f"p{i % 2}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in classify_quality(docs, marks).collect()}
    p = {i: 1 / (1 + np.exp(-got[i]["evidence"])) for i in got}
    every = np.mean(list(p.values()))

    def strength(groups):  # (n, rate, mean)
        n, u = sum(g[0] for g in groups), sum(g[0] * g[2] * (1 - g[2]) for g in groups)
        b, q = sum(g[0] * (g[1] - g[2]) ** 2 for g in groups), sum(g[0] ** 2 for g in groups)
        between = (b - u * len(groups) / n) / (n - q / n) if n != q / n else None
        return 100.0 if between is None else min(10_000.0, max(1.0, u / n / max(1e-6, between) - 1))

    of = lambda f: {k: [i for i, *r in rows if f(r) == k] for k in {f(r) for _, *r in rows}}
    hosts, sites = of(lambda r: r[1]), of(lambda r: (r[1], r[2]))
    total = lambda ids: sum(p[i] for i in ids)
    hm = strength([(len(v), total(v) / len(v), every) for v in hosts.values()])
    rate = {h: (total(v) + hm * every) / (len(v) + hm) for h, v in hosts.items()}
    pm = strength([(len(v), total(v) / len(v), rate[h]) for (h, _), v in sites.items()])
    for i, _, h, path in rows:
        own = (total(hosts[h]) - p[i] + hm * every) / (len(hosts[h]) - 1 + hm)
        deep = (total(sites[h, path]) - p[i] + pm * own) / (len(sites[h, path]) - 1 + pm)
        assert got[i]["host_rate"] == pytest.approx(own, rel=1e-9) and got[i]["path_rate"] == pytest.approx(deep, rel=1e-9)


def test_top_word_counts_all_words():
    """A word that is 40% of a text, but not its first, middle or last word."""
    words = [f"w{i}" for i in range(60)] + ["junk"] * 40
    words[50], words[-1], words[60], words[70] = "middle", "end", "a", "b"
    assert features(" ".join(words))[FEATURES.index("top_word")] == words.count("junk") / 100
    assert features("")[FEATURES.index("top_word")] == 0


def test_one_text_for_each_labelled_doc_id(spark):
    """A doc_id that many rows bear gives the learners one row, whatever its texts."""
    from tracequarry.llm.common import labelled_texts

    docs = spark.range(2000).selectExpr("id % 3 as doc_id", "concat('text ', id % 7) as text", "'mine' as toxic")
    chosen = spark.createDataFrame([(0, 1), (2, 0), (5, 1)], "doc_id long, toxic int")
    rows = labelled_texts(docs, chosen).collect()
    assert sorted((r["doc_id"], r["toxic"]) for r in rows) == [(0, 1), (2, 0)]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, labelled_texts(docs.repartition(7), chosen).collect()))
    assert labelled_texts(docs.where("false"), chosen).collect() == []


def test_sites_help_where_a_text_says_little(spark):
    """Hosts and paths differ in quality, texts tell little of it: the score ranks better than evidence alone, at large sites
    and over all, and hosts of one document keep close to the rate of all."""
    rng, rows, marks = np.random.default_rng(7), [], []
    for host in range(60):
        rate = rng.beta(0.4, 0.4)
        for path in range(2 if host < 30 else 1):
            for _ in range(30 if host < 30 else 1):
                good = int(rng.random() < rate)
                text = " ".join("#" if x < (0.06 if good else 0.11) else f"w{int(x * 1000)}" for x in rng.random(40))
                rows.append((len(rows), text, f"h{host}", f"p{path}"))
                marks.append((len(marks), good))
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    got = {r["doc_id"]: r for r in classify_quality(docs, spark.createDataFrame(marks, "doc_id long, quality int")).collect()}
    large = [i for i, _, host, _ in rows if int(host[1:]) < 30]
    for ids in (large, list(got)):
        y = [marks[i][1] for i in ids]
        assert auc(y, [got[i]["score"] for i in ids]) > auc(y, [got[i]["evidence"] for i in ids])
    every = np.mean([1 / (1 + math.exp(-got[i]["evidence"])) for i in got])
    alone = [got[i]["host_rate"] for i in got if i not in set(large)]
    assert len(alone) == 30 and all(abs(r - every) < 1e-9 for r in alone)
