"""Document fingerprints by quartile bucket digests.

Byte triplets, taken within a window of four bytes in WINDOWS ways, are hashed into BUCKETS buckets and counted. The
digest writes each bucket's quartile in two bits after one byte for the length (on a logarithmic scale) and one each for
the ratios of the quartiles. Two digests are compared by a difference that is bounded for every part, so the score lies
between 0 and 1; equal texts have equal digests and score 1.

For each document the text is also compared with the next document's, in ascending doc_id order. Documents are dealt
into ranges of doc_id, and each range also gets the first document of the next one, so that neighbours meet without one
task ordering all documents; a range is read as a sorted stream.

Defined results: null texts are empty; an empty text has the digest of no triplets; rows are ordered by doc_id, nulls
first, then by text, and the last row's next is the first; a single row's next is itself; rows of one doc_id lie in one
range; an empty table has no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 2048
#: The other two bytes of a triplet, counted from its first byte.
WINDOWS = ((1, 2), (1, 3))
#: Most that two lengths, two quartile ratios and two buckets can differ by.
LENGTH_CAP, RATIO_CAP, BUCKET_CAP = 24, 8, 6
CHUNK = 1 << 20
#: Bytes of text to a range, about, and most ranges: what the driver holds of them is so bounded, and larger tables have larger
#: ranges, which are sorted and read as streams.
RANGE_BYTES, MAX_RANGES = 16 << 20, 20_000


def _counts(raw: bytes) -> np.ndarray:
    out = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, max(1, len(raw)), CHUNK):
        b = np.frombuffer(raw, dtype=np.uint8, offset=at, count=min(len(raw) - at, CHUNK + 3)).astype(np.uint32)
        n = min(len(b), CHUNK)
        for k, (i, j) in enumerate(WINDOWS):
            m = min(n, len(b) - j)
            if m <= 0:
                continue
            h = (b[:m] * np.uint32(0x9E3779B1)) ^ (b[i : i + m] * np.uint32(0x85EBCA77)) ^ (b[j : j + m] * np.uint32(0xC2B2AE3D)) ^ np.uint32(k * 0x27D4EB2F & 0xFFFFFFFF)
            h *= np.uint32(0x2C1B3C6D)
            out += np.bincount(h >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    return out


def digest(raw: bytes) -> bytes:
    counts = _counts(raw)
    at = [BUCKETS * q // 4 - 1 for q in (1, 2, 3)]
    q1, q2, q3 = (int(x) for x in np.partition(counts, at)[at])
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8).reshape(-1, 4)
    packed = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    length = min(255, round(8 * np.log2(1 + len(raw))))
    ratios = (q1 * 16 // q3 if q3 else 0), (q2 * 16 // q3 if q3 else 0)
    return bytes([length, *ratios]) + packed.astype(np.uint8).tobytes()


def _differences() -> np.ndarray:
    """Of two bytes with four bucket codes each: sum over codes, opposite quartiles counting double."""
    codes = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
    d = np.abs(codes[:, None, :] - codes[None, :, :])
    return np.where(d == 3, BUCKET_CAP, d).sum(axis=2).astype(np.int64)


DIFFERENCES = _differences()


def likeness(a: bytes, b: bytes) -> float:
    """1 minus the bounded difference as a share of what unrelated digests can differ by."""
    if a == b:
        return 1.0
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    head = np.abs(x[:3].astype(int) - y[:3])
    d = min(int(head[0]), LENGTH_CAP) + min(int(head[1]), RATIO_CAP) + min(int(head[2]), RATIO_CAP) + int(DIFFERENCES[x[3:], y[3:]].sum())
    most = LENGTH_CAP + 2 * RATIO_CAP + 2 * BUCKETS
    return max(0.0, 1.0 - d / most)


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranges(docs: DataFrame, range_bytes: int) -> tuple[Column, int]:
    """The range of each row's doc_id, and the number of ranges: about range_bytes of text each, rows of one doc_id together.

    The cut points, one number for each range, are looked up by binary search."""
    size, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n = max(1, min(rows, -(-(size or 0) // range_bytes), MAX_RANGES))
    if n == 1:
        return F.lit(0), 1
    cuts = np.unique(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)).astype(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(cuts)

    @F.arrow_udf("int")
    def part(ids: pa.Array) -> pa.Array:
        found = np.searchsorted(shared.value, np.asarray(ids.fill_null(np.iinfo(np.int64).min)), side="left")
        return pa.array(found.astype(np.int32))

    return part("doc_id"), len(cuts) + 1


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted stream with the row after them; a row marked `after` only ends its range."""
    held: tuple | None = None
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for batch in batches:
        rows = []
        for part, after, doc_id, text in zip(*(batch[c].to_pylist() for c in ("part", "after", "doc_id", "text")), strict=True):
            now = (part, doc_id, text or "", digest((text or "").encode()))
            if held and held[0] == part:
                _, at, own, mark = held
                changed = edited(own, now[2]).encode()
                other = digest(changed)
                rows.append((at, len(own), hashlib.sha256(changed).hexdigest(), mark.hex(), other.hex(), likeness(mark, other), likeness(mark, now[3])))
            held = None if after else now
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    part, n = _ranges(docs, range_bytes)
    placed = docs.withColumn("part", part)
    # the least doc_id of each range that has rows, and the range before it; the first range's ends the last
    firsts = placed.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"))).alias("low")).collect()  # MAX_RANGES at most
    firsts = sorted((r["part"], r["low"]["id"]) for r in firsts)  # a pair of numbers for each range
    rows = [(p, low, firsts[i - 1][0]) for i, (p, low) in enumerate(firsts)]
    parts = docs.sparkSession.createDataFrame(rows, "part int, low long, ends int")
    heads = placed.join(F.broadcast(parts), (placed["part"] == parts["part"]) & placed["doc_id"].eqNullSafe(parts["low"]))
    heads = heads.groupBy("ends").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("low").alias("doc_id"))
    stream = placed.select("part", F.lit(False).alias("after"), "doc_id", "text").unionByName(heads.select(F.col("ends").alias("part"), F.lit(True).alias("after"), "doc_id", "text"))
    dealt = stream.repartitionById(n, "part").sortWithinPartitions("part", "after", F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(_pairs, kinds)
