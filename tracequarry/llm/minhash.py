"""Near-duplicate documents: MinHash bands, signature and full-set verification, connected components.

A text's set is that of its word shingles. Texts with equal sets form a class, which its smallest doc_id represents, so
that exact copies cost one row each. Per representative, `bands` x `rows` universal hash minima (multiply-shift) give
band keys and a signature of one byte per minimum.

Candidate pairs never grow with the square of a bucket:

1. each member of a band bucket is paired with the bucket's smallest member only (partial aggregation finds it);
2. buckets whose other members still lie in several components are dealt into pairs of blocks of bounded size. Members of
   the bucket's largest component meet the others only, so their shingle sets are copied once for each block of the
   others, which are few in a large group of copies; only members outside of it meet each other. Within a block pair
   numpy compares signatures, then the shingle sets, likeliest pairs first, and passes over pairs whose components it has
   joined already: it gives no more links than there are components to join. The work of a bucket so grows with its
   members times those outside its largest component.

Pairs whose signatures agree often enough are verified on the full sets of their texts. Links become components by
alternating large-star and small-star; every step is a join or an aggregation, written to the shared folder.

Defined results: null and empty texts, and texts without a word, have an empty set and are linked with nothing; a text
with fewer words than a shingle is one shingle; rows with a null doc_id get no component and are kept; rows with the
same doc_id are one node, whose links are those of all its texts. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Members, and bytes of shingle sets, of a block at most (about).
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Pairs of one document to a salt.
SALTED = 2000
MEMO = 300_000
MASK = (1 << 64) - 1
#: Multipliers of the word hashes within a shingle; odd, from the golden ratio's and other fixed bits.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingles:
    """Hashed shingle sets of texts; word hashes are kept in a table of bounded size."""

    def __init__(self, size: int):
        self.size, self.memo = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles of `size` words, A-Z lower-cased."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        hashes = []
        for w in words:
            h = memo.get(w)
            if h is None:
                h = memo[w] = xxhash.xxh64_intdigest(w)
            hashes.append(h)
        h = np.array(hashes, dtype=np.uint64)
        if not len(h):
            return h
        k = min(self.size, len(h))
        n = len(h) - k + 1
        out = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            out = _mixed(out * MULTIPLIERS[j % len(MULTIPLIERS)] + h[j : j + n])
        return np.unique(out)


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20_240).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(hashes: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The top 32 bits of the least product with each multiplier."""
    least = np.full(len(by), MASK, dtype=np.uint64)
    for i in range(0, len(hashes), 256):
        np.minimum(least, (hashes[i : i + 256, None] * by).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _described(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, by = Shingles(size), multipliers(bands * rows)
        for batch in batches:
            n, marks, signatures, keys = [], [], [], []
            for text in batch["text"].to_pylist():
                s = shingles(text)
                n.append(len(s))
                if not len(s):
                    marks.append(None)
                    signatures.append(None)
                    keys.append(None)
                    continue
                m = minima(s, by)
                marks.append(xxhash.xxh128_digest(s.tobytes()))
                signatures.append((m & 0xFF).astype(np.uint8).tobytes())
                keys.append([xxhash.xxh64_intdigest(part.tobytes(), seed=i) - (1 << 63) for i, part in enumerate(m.reshape(bands, rows))])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "n_shingles": pa.array(n, pa.int64()), "mark": pa.array(marks, pa.binary()),
                "signature": pa.array(signatures, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64())),
            })

    return run


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of equal signature bytes to pairs with sa and sb."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
        yield pa.RecordBatch.from_pydict({"a": batch["a"], "b": batch["b"], "agree": pa.array((a == b).sum(axis=1), pa.int32())})


def _likely(reps: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    left, right = (reps.select(F.col("rep").alias(x), F.col("signature").alias("s" + x)) for x in "ab")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(_agreement, "a long, b long, agree int").where(F.col("agree") >= least).select("a", "b")


def _verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs of which 100 * intersection size >= percent * union size of the full sets."""
    left, right = (docs.select(F.col("doc_id").alias(x), F.col("text").alias("t" + x)) for x in "ab")
    # the smallest member of a large group is in many pairs: these are dealt over salts, and so is its text
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("_salts"))
    salted = pairs.join(salts, "b").withColumn("_salt", F.pmod(F.xxhash64("a"), F.col("_salts")).cast("int")).drop("_salts")
    right = right.join(salts, "b").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    joined = salted.join(left, "a").join(right, ["b", "_salt"]).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        last: tuple = (None, None)
        for batch in batches:
            a, b, ok = batch["a"], batch["b"], []
            for ta, tb in zip(batch["ta"].to_pylist(), batch["tb"].to_pylist(), strict=True):
                x = shingles(ta)
                if last[0] != tb:
                    last = (tb, shingles(tb))
                y = last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_pydict({"a": a, "b": b}).filter(pa.array(ok, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that can be reached) of the nodes of edges (a, b), by alternating large-star and small-star."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, written(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
        forget(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _sets(size: int):
    """The full shingle set of each text, as bytes, and its mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for batch in batches:
            sets = [shingles(t).astype("<u8").tobytes() for t in batch["text"].to_pylist()]
            marks = [xxhash.xxh128_digest(x) for x in sets]
            yield pa.RecordBatch.from_pydict({"rep": batch["rep"], "mark": pa.array(marks, pa.binary()), "shingles": pa.array(sets, pa.binary())})

    return run


def _links_of_blocks(least: int, percent: int):
    """Links between components in a pair of blocks of one bucket, as few as join what the block pair can join.

    A pair of documents is looked at in the first band only whose key they share."""

    def run(group: pa.Table) -> pa.Table:
        side, band = group["side"].to_numpy(), group["band"][0].as_py()
        rep, comp = group["rep"].to_numpy(), group["component"].to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in group["shingles"].to_pylist()]
        s = np.frombuffer(b"".join(group["signature"].to_pylist()), np.uint8).reshape(len(rep), -1)
        keys = group["keys"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        rows = np.flatnonzero(side == side.min())
        cols = np.flatnonzero(side == side.max())
        found: list[tuple[int, int, int]] = []
        for i in rows:
            others = cols[cols > i] if side[i] == side[cols[0]] else cols
            others = others[comp[others] != comp[i]]
            agree = (s[others] == s[i]).sum(axis=1)
            fits = np.flatnonzero(agree >= least)
            first = (keys[others[fits]] == keys[i]).argmax(axis=1)
            found += [(-int(agree[k]), int(i), int(others[k])) for k in fits[first == band]]
        root: dict[int, int] = {}

        def of(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        out: list[tuple[int, int]] = []
        for _, i, j in sorted(found):
            ci, cj = of(int(comp[i])), of(int(comp[j]))
            if ci == cj:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[max(ci, cj)] = min(ci, cj)
                out.append((max(int(rep[i]), int(rep[j])), min(int(rep[i]), int(rep[j]))))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _open_links(texts: DataFrame, reps: DataFrame, buckets: DataFrame, components: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Pairs that may link different components of one bucket, besides those with the bucket's smallest member."""
    size, percent, least = shape
    member = buckets.where("rep <> low").join(components, F.col("rep") == F.col("node"), "left")
    member = member.select("key", "band", "rep", F.coalesce("component", "rep").alias("component")).distinct()
    open_ = member.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("key")
    member = written(member.join(open_, "key"), "open-buckets")
    wanted = member.select("rep").distinct()
    sets = texts.join(wanted, texts["doc_id"] == wanted["rep"]).select("rep", "text").mapInArrow(_sets(size), "rep long, mark binary, shingles binary")
    sets = written(sets.join(reps.select("rep", "mark", "signature", "keys"), ["rep", "mark"]).dropDuplicates(["rep", "mark"]), "open-sets")
    # of a doc_id with several texts, those that have the bucket's key
    of_bucket = F.element_at("keys", F.col("band") + 1) == F.col("key")
    member = member.join(sets.select("rep", "mark", "keys", F.length("shingles").alias("bytes")), "rep").where(of_bucket).drop("keys")
    # the others' blocks come first, the largest component's after them
    most = member.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("_main"))
    member = member.join(most, "key").withColumn("_out", F.col("component") != F.col("_main"))
    blocks = lambda inside: F.coalesce(F.greatest(F.ceil(F.count_if(inside) / BLOCK), F.ceil(F.sum(F.when(inside, F.col("bytes"))) / BLOCK_BYTES)), F.lit(0)).cast("int")
    sums = member.groupBy("key").agg(blocks(F.col("_out")).alias("n_out"), blocks(~F.col("_out")).alias("n_in"))
    member = member.join(sums, "key")
    mixed = F.xxhash64("rep")
    block = F.when(F.col("_out"), F.pmod(mixed, F.col("n_out"))).otherwise(F.col("n_out") + F.pmod(mixed, F.greatest(F.lit(1), F.col("n_in")))).cast("int")
    member = member.withColumn("block", block)
    last = F.when(F.col("_out"), F.col("n_out") + F.col("n_in") - 1).otherwise(F.col("n_out") - 1)
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    member = member.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block").alias("side"), "band", "rep", "mark", "component")
    kinds = "a long, b long"
    return member.join(sets, ["rep", "mark"]).groupBy("key", "i", "j").applyInArrow(_links_of_blocks(least, percent), kinds).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 28, rows: int = 7, slack: float = 4.5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text).

    Signatures must agree on as many minima as a pair at the threshold does, less `slack` standard deviations."""
    docs = docs.select("doc_id", "text")
    p = percent / 100
    least = int(bands * rows * p - slack * (bands * rows * p * (1 - p)) ** 0.5)
    described = written(docs.mapInArrow(_described(shingle, bands, rows), "doc_id long, n_shingles long, mark binary, signature binary, keys array<long>"), "minima")
    usable = described.where(F.col("mark").isNotNull() & F.col("doc_id").isNotNull())
    classes = written(usable.groupBy("mark").agg(F.min("doc_id").alias("rep")), "classes")
    reps = usable.join(classes, (usable["mark"] == classes["mark"]) & (usable["doc_id"] == classes["rep"]), "left_semi")
    reps = written(reps.select(F.col("doc_id").alias("rep"), "mark", "signature", "keys").dropDuplicates(["rep", "mark"]), "representatives")
    banded = reps.select("rep", F.posexplode("keys").alias("band", "key"))
    lows = banded.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("top")).where("low <> top").select("key", "low")
    buckets = written(banded.join(lows, "key"), "buckets")
    texts = docs.where(F.col("doc_id").isNotNull())
    links = written(_verified(texts, _likely(reps, buckets.where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct(), least), shingle, percent), "links")
    more = _open_links(texts, reps, buckets, connected_components(links), (shingle, percent, least))
    links = written(links.unionByName(_verified(texts, more, shingle, percent)), "links")
    one = usable.groupBy("doc_id").agg(F.min("mark").alias("m0"), F.max("mark").alias("m1")).where("m0 <> m1").select("doc_id")
    shared = usable.join(one, "doc_id").join(classes, "mark").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))  # rows of one doc_id with unlike texts
    components = connected_components(links.unionByName(shared))
    out = described.select("doc_id", "n_shingles", "mark").join(classes, "mark", "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.col("rep")))
    out = out.join(components, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows of which a smaller doc_id of the same component stays."""
    found = near_duplicates(docs, shingle, percent)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
