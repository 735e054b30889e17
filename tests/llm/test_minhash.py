"""Links and components against all pairs of a small table."""

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from tracequarry.llm.minhash import _described, _links_of_blocks, _open_links, connected_components, drop_near_duplicates, near_duplicates


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, percent):
    sets, root = [shingle_set(t, k) for _, t in rows], {i: i for i, _ in rows if i is not None}

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in combinations([(rows[n][0], s) for n, s in enumerate(sets)], 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((of(a), of(b)))
            root[high] = low
    return sorted((str(i), len(s), None if i is None else of(i), i is None or of(i) == i) for (i, _), s in zip(rows, sets, strict=True))


def check(docs, k, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = near_duplicates(docs, k, percent).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in got) == brute(rows, k, percent)


def test_documents(documents, odd):
    check(documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text")), 3, 85)


def test_chains_and_blocks(spark):
    """Copies that drift step by step: neighbours are linked, ends are not."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for n in range(60):
        base[n * 2 % 120] = f"v{n}"
        rows.append((1000 - n, " ".join(base)))
    rows += [(2000 + n, " ".join(base)) for n in range(40)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)


def test_links_of_both_texts(spark):
    """Twenty documents have two texts; the one that is near another document's counts in their shared buckets."""
    words = lambda n, k: [f"{k}{n}x{i}" for i in range(80)]
    rows = [(n, " ".join(words(n, k))) for n in range(10, 30) for k in "ab"]
    rows += [(n + 100, " ".join([*words(n, "b")[:-1], "end"])) for n in range(10, 30)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    described = texts.mapInArrow(_described(3, 28, 7), "doc_id long, n_shingles long, mark binary, signature binary, keys array<long>")
    reps = described.select(F.col("doc_id").alias("rep"), "mark", "signature", "keys")
    banded = reps.select("rep", F.posexplode("keys").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.countDistinct("rep").alias("n")).where("n > 1").select("key", F.lit(1).cast("long").alias("low"))
    none = spark.createDataFrame([], "node long, component long")
    got = _open_links(texts, reps, banded.join(shared, "key"), none, (3, 85, 140)).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(n + 100, n) for n in range(10, 30)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_filter_keeps_columns(odd, none):
    out = drop_near_duplicates(odd)
    assert out.columns == odd.columns and out.count() >= 10
    assert near_duplicates(none).count() == 0 and drop_near_duplicates(none).count() == 0


def test_links_in_first_band_by_key():
    """Two texts whose minima of band 0 differ, but not in their low bytes, meet in the bucket of band 1."""
    minima = np.array([[0x101, 5, 7, 9], [0x201, 5, 7, 9]], np.uint32)
    keys = [[xxhash.xxh64_intdigest(m[2 * i : 2 * i + 2].tobytes(), seed=i) - (1 << 63) for i in range(2)] for m in minima]
    assert keys[0][0] != keys[1][0] and keys[0][1] == keys[1][1]
    group = pa.table({
        "side": pa.array([0, 0], pa.int32()), "band": pa.array([1, 1], pa.int32()), "rep": pa.array([3, 8], pa.int64()), "component": pa.array([3, 8], pa.int64()),
        "shingles": pa.array([np.arange(50, dtype="<u8").tobytes()] * 2, pa.binary()),
        "signature": pa.array([(m & 0xFF).astype(np.uint8).tobytes() for m in minima], pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64())),
    })
    assert _links_of_blocks(3, 80)(group).to_pylist() == [{"a": 8, "b": 3}]
