"""Collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from tracequarry.llm import collocations as c


def pieces(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def brute(docs, longest, least, share, top):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    held = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    found = {}
    for (lang, p), a in held.items():
        longer = (b for (other, q), b in held.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
        if any(100 * b >= share * a for b in longer):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return sorted((lang, i, x[2].decode(), -x[1], *x[3:]) for lang, rows in found.items() for i, x in enumerate(sorted(rows)[:top], 1))


def spread(seed):
    rng = random.Random(seed)
    ws = ["a", "B", "ä", "Ä", "日本", "x\x1cy", "it's", "\x00"]
    return [("".join(rng.choice(ws) + rng.choice([" ", " ", " ", "\t ", ", ", "\n", ".", "  "]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, ""])) for _ in range(40)]


ODD = [(None, "en"), ("", None), (" \t\n.", "xx"), ("one", "en"), ("same words here " * 3000, "en"), ("a b. a b, a b", "en"), ("a b. a b, a b", "en"), ("no end " * 5 + "ÉA é", "und")]


@pytest.mark.parametrize(("longest", "least", "share", "top"), [(3, 10, 50, 2000), (2, 3, 50, 4), (4, 3, 80, 30), (5, 6, 20, 2000)])
def test_equals_counting(spark, monkeypatch, longest, least, share, top):
    docs = spread(longest) + ODD
    df = spark.createDataFrame([(i, *d, "mine", 1) for i, d in enumerate(docs)], "doc_id long, text string, lang string, phrase string, f int").repartition(3)
    got = sorted(tuple(r) for r in c.collocations(df, longest, least, share, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute(docs, longest, least, share, top)


def test_blocks_and_steps_do_not_change_the_result(spark, monkeypatch):
    docs = spread(7) * 3 + ODD
    whole = sorted(b"".join(c._steps([t.encode() for t, _ in docs if t])).split())
    monkeypatch.setattr(c, "STEP", 16)
    assert sorted(b"".join(c._steps([t.encode() for t, _ in docs if t])).split()) == whole
    from pyspark import TaskContext

    monkeypatch.setattr(c, "BLOCK_WORDS", 20)
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("", (), {"partitionId": lambda self: 5})()))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(docs), "text": pa.array([t and t.encode() for t, _ in docs], pa.binary())})
    rows = pa.Table.from_batches(list(c._blocks(iter([batch, batch])))).to_pylist()
    want = Counter(w for t, _ in docs for p in pieces(t) for w in p)
    got = Counter()
    for r in rows:
        if r["local"] is not None:
            got[r["word"]] += r["count"]
    assert got == Counter({w: 2 * n for w, n in want.items()}) and len({r["block"] for r in rows}) > 10


def test_exact_arithmetic_past_64_bits(spark):
    a = 10**12 + 7
    df = spark.createDataFrame([(a, [a + 3], [a + 11])], "f long, heads array<long>, tails array<long>").selectExpr("1 as k", "*")
    assert df.selectExpr(c.SCORE).first()[0] == 1000000 * a * a // ((a + 3) * (a + 11))


def test_empty_table(spark, none):
    assert c.collocations(none).collect() == []
