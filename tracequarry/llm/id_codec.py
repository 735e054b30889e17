"""Token ids as files of binary blocks, by an adaptive context-mixing range coder.

A block holds whole documents. Its ids are dealt to lanes, contiguous runs of equal length; step t codes the t-th id of
every lane at once in numpy, under one model of the block, and then updates the model with what all lanes showed. The
model starts anew in each block, so blocks can be read in any order and a damaged one harms no other; a CRC-32 over the
block's body is checked on reading.

Model. Order 2 keeps one id with a count for each context (the two ids before, hashed), order 1 two ids (by the one
before); order 0 keeps the frequencies of all ids that the others missed, with a share for new ones. The three
distributions are mixed by weights that are learned for each pair of confidences (how often the contexts were seen, and how
one-sidedly): an order's weight is the mean share that it had in the probabilities of the ids that came. An id's
probability is the sum over the orders of weight times probability, so each id takes one coding step; ids in slots come
first in the coding interval, all ids follow in id order by order 0. The parts that the slots' ids have there a second time
are never used, and each lane's interval is as much longer. All quantities are integers, some kept in doubles that hold
them exactly, so that every machine decodes alike.

A step costs some hundred calls of numpy whatever the lanes, so blocks have many lanes, numbers are of 32 bits, and choices
are made by masks of bits.

Coder. Each lane keeps a range coder of 48 bits that puts out 16-bit digits; carries are added up in the digits and
resolved when the lane ends.

File. Blocks in a row, each followed by a newline. Block: HEAD (magic, version, shard, block, documents, ids, lanes,
vocabulary, bytes of body, CRC-32 of body), then the body: doc_ids (int64; null flags as bytes), ids per document
(uint32), digits per lane (uint32), digits (uint16), all little-endian. A file holds one shard; shards and their blocks
follow ascending doc_id.

Defined results: a null or empty text is its end id alone; documents are written in ascending doc_id order, nulls first,
ties by a hash of the text; repeated rows are written each; an empty table gives no blocks. Columns other than doc_id and
text are not read. Strings of special tokens within a text are ordinary text. A document's ids are held in memory whole,
as its text is.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete_at_end, scratch_root
from .vocab import vocabulary

MAGIC, VERSION = b"TQID", 3
HEAD = struct.Struct("<4sBIIIIIIII")
BLOCK_IDS, LANES, LANE_LEAST = 1 << 22, 8192, 512
#: Bytes of text to a shard, about.
SHARD_BYTES = 64 << 20
#: A lane's least range, the place of its digit to put out, and the digits' base.
LEAST, HIGH, DIGIT_BITS, DIGIT = float(1 << 32), 2.0**-32, 16, float(1 << 16)
#: Bits of order 0's total and of a share; weights sum to 2 ** 8.
BASE_BITS, SHARE_BITS = 22, 14
#: Rows of the order-2 table; greatest count. A slot is a count above an id of ID_BITS.
ROWS2, MOST, ID_BITS = 1 << 18, 15, 24
ID_MASK, ONE, TWO, FULL = (np.int32(n) for n in ((1 << ID_BITS) - 1, 1 << ID_BITS, 2 << ID_BITS, MOST << ID_BITS))
#: Part of order 0's total for which the first id is kept, in bits.
NEAR_BITS = 7
CLASSES2, CLASSES1 = 6, 9
CLASSES = CLASSES2 * CLASSES1


def _states() -> tuple[np.ndarray, np.ndarray]:
    """By the counts of order 2's slot and of order 1's two: the pair of confidences (0 unseen, then seen more often, in order
    1 one-sided or not), and order 1's shares."""
    n2, a, b = np.indices((MOST + 1,) * 3).reshape(3, -1).astype(np.int64)
    total = a + b
    often = (total > 1).astype(np.int64) + (total > 3) + (total > 12)
    order2 = sum((n2 > k).astype(np.int64) for k in (0, 1, 3, 7, 14))
    order1 = np.where(total == 0, 0, 1 + 2 * often + (4 * np.maximum(a, b) >= 3 * total))
    return order2 * CLASSES1 + order1, np.stack([a, b]) * (1 << SHARE_BITS) // np.maximum(total, 1)


PAIRS, SHARES = _states()


def _equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All bits where equal, else none; of numbers from 0."""
    out = x ^ y
    out -= 1
    out >>= 31
    return out


def _less(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = x - y
    out >>= 31
    return out


def _pick(mask: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x where the mask has all bits, y where it has none; quicker than numpy's where."""
    out = x ^ y
    out &= mask
    out ^= y
    return out


def _missed(slot: np.ndarray, new: np.ndarray) -> np.ndarray:
    """A slot whose id did not come: one less, or the new id's."""
    return _pick(_less(slot, TWO), new, slot - ONE)


class _Model:
    """The mixed distribution of each lane's next id; encoder and decoder apply the same updates. An empty slot has the
    vocabulary's size as its id, and count 0."""

    def __init__(self, vocabulary_size: int):
        self.size = vocabulary_size
        self.table2 = np.full(ROWS2, vocabulary_size, np.int32)
        self.table1 = np.full((vocabulary_size, 2), vocabulary_size, np.int32).view(np.int64).reshape(-1)  # both slots at once
        self.counts = np.zeros(vocabulary_size, np.int64)
        self.waiting: list[np.ndarray] = []
        self.steps, self.due = 0, 1
        # shares that order 2 and order 1 had, and what they are shares of, by pair of confidences
        self.had = np.tile(np.array([[90], [60]], np.int64), (1, CLASSES)) * 16
        self.seen = np.full(CLASSES, 256 * 16, np.int64)
        known2, known1 = np.divmod(np.arange(CLASSES), CLASSES1)
        self.known = np.stack([known2 > 0, known1 > 0])
        self._weigh()
        self._cumulate()

    def _weigh(self) -> None:
        w2, w1 = np.where(self.known, np.maximum(1, self.had * 250 // self.seen), 0)
        w0 = 256 - w2 - w1
        slots1 = w1[PAIRS] * SHARES << BASE_BITS - SHARE_BITS
        self.mixed = np.stack([w2[PAIRS] << BASE_BITS, *slots1, w0[PAIRS]]).astype(np.int32)

    def _cumulate(self) -> None:
        total = int(self.counts.sum())
        kinds = int(np.count_nonzero(self.counts))
        floor = max(1, ((1 << BASE_BITS) // self.size) * (kinds + 8) // (total + kinds + 8))
        room = (1 << BASE_BITS) - floor * self.size
        self.base = np.append(self.counts * room // max(1, total) + floor, 0).astype(np.int32)  # none for empty slots
        self.cumulative = np.concatenate([[0], np.cumsum(self.base[:-1])]).astype(np.int32)
        self.near: np.ndarray | None = None

    def predict(self, before1: np.ndarray, before2: np.ndarray) -> None:
        self.at1, self.at2 = before1, (before1 * 40_503 + before2 * 2_654_435_761 >> 5) & (ROWS2 - 1)
        slots1 = self.table1.take(before1).view(np.int32).reshape(-1, 2)
        self.slots = slot2, slot_a, slot_b = self.table2.take(self.at2), slots1[:, 0].copy(), slots1[:, 1].copy()
        self.ids = id2, id_a, id_b = [slot & ID_MASK for slot in self.slots]
        self.state = ((slot2 >> ID_BITS) << 8 | (slot_a >> ID_BITS) << 4 | slot_b >> ID_BITS).astype(np.int64)
        p2, pa, pb, self.w0 = [p.take(self.state) for p in self.mixed]
        # ends of the slots' intervals; an id in slots of both orders has one interval, order 2's
        same_a, same_b = _equal(id2, id_a), _equal(id2, id_b)
        end2, end_a, end_b = [self.base.take(x) * self.w0 for x in self.ids]
        end2 += p2
        end2 += pa & same_a
        end2 += pb & same_b
        end_a += pa
        end_a &= ~same_a
        end_a += end2
        end_b += pb
        end_b &= ~same_b
        end_b += end_a
        self.ends = end2, end_a, end_b
        self.total = end_b + (self.w0 << BASE_BITS)  # below 2 ** 31

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and width of each lane's id, of the lane's total."""
        end2, end_a, end_b = self.ends
        self.hits = hit2, hit_a, hit_b = [_equal(x, own) for own in self.ids]
        begin, end = _pick(hit_a, end2, end_a), _pick(hit2, end2, _pick(hit_a, end_a, end_b))
        begin &= ~hit2
        self._in_no_slot(np.flatnonzero((hit2 | hit_a | hit_b) == 0), x, begin, end)
        return begin, end - begin

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids at the values, with their begin and width."""
        end2, end_a, end_b = self.ends
        in2, in_a = _less(value, end2), _less(value, end_a)
        x = _pick(in2, self.ids[0], _pick(in_a, self.ids[1], self.ids[2]))
        begin, end = _pick(in_a, end2, end_a), _pick(in2, end2, _pick(in_a, end_a, end_b))
        begin &= ~in2
        rest = np.flatnonzero(value >= end_b)
        x[rest] = self._at_base((value[rest] - end_b[rest]) // self.w0[rest])
        self._in_no_slot(rest, x, begin, end)
        self.hits = [_equal(x, own) for own in self.ids]
        return x, begin, end - begin

    def _in_no_slot(self, rest: np.ndarray, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Sets begin and end of the lanes that have their ids in no slot."""
        y, w0 = x[rest], self.w0[rest]
        self.missed = y
        begin[rest] = at = self.ends[-1][rest] + self.cumulative[y] * w0
        end[rest] = at + self.base[y] * w0

    def _at_base(self, inside: np.ndarray) -> np.ndarray:
        """The ids at places of order 0's total: halving, from the first ids of the parts around."""
        if self.near is None:
            parts = np.arange((1 << BASE_BITS - NEAR_BITS) + 1, dtype=np.int32) << NEAR_BITS
            self.near = np.minimum(np.searchsorted(self.cumulative, parts, side="right") - 1, self.size - 1).astype(np.int32)
        part = (inside >> NEAR_BITS).astype(np.int64)
        found, last = self.near.take(part), self.near.take(part + 1)
        open_ = np.flatnonzero(found < last)
        value, low, high = inside[open_], found[open_], last[open_]
        while len(open_):
            middle = low + high + 1 >> 1
            up = self.cumulative.take(middle) <= value
            low, high = np.where(up, middle, low), np.where(up, high, middle - 1)
            found[open_] = low
            more = np.flatnonzero(low < high)
            open_, value, low, high = open_[more], value[more], low[more], high[more]
        return found

    def update(self, x: np.ndarray, width: np.ndarray) -> None:
        (slot2, slot_a, slot_b), (hit2, hit_a, hit_b) = self.slots, self.hits
        self.steps += 1
        if self.steps < 32 or self.steps % 4 == 0:
            p2, pa, pb, _ = self.mixed
            pair, scale = PAIRS.take(self.state), 256.0 / width
            for had, p in zip(self.had, (hit2 & p2.take(self.state), hit_a & pa.take(self.state) | hit_b & pb.take(self.state)), strict=True):
                had += np.bincount(pair, np.floor(p * scale), CLASSES).astype(np.int64)
            self.seen += np.bincount(pair, minlength=CLASSES) * 256
        new, full = x | ONE, x | FULL
        self.table2[self.at2] = _pick(hit2, np.minimum(slot2 + ONE, full), _missed(slot2, new))
        slot_a, slot_b = _pick(hit_a, np.minimum(slot_a + ONE, full), slot_a), _pick(hit_b, np.minimum(slot_b + ONE, full), _pick(hit_a, slot_b, _missed(slot_b, new)))
        slots1 = np.empty((len(x), 2), np.int32)  # the greater count first
        np.maximum(slot_a, slot_b, out=slots1[:, 0])
        np.minimum(slot_a, slot_b, out=slots1[:, 1])
        self.table1[self.at1] = slots1.view(np.int64).reshape(-1)
        self.waiting.append(self.missed)
        if self.steps < 32 or self.steps % 8 == 0:
            self._weigh()
        if self.steps == self.due:
            self.counts += np.bincount(np.concatenate(self.waiting), minlength=self.size)
            self.waiting = []
            self._cumulate()
            self.due = self.steps + min(16, self.steps)


def _lanes(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // LANE_LEAST))
    return lanes, -(-n // lanes)


def encode_ids(ids: np.ndarray, vocabulary_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits per lane, and the digits of all lanes in a row."""
    lanes, steps = _lanes(len(ids))
    grid = np.zeros(lanes * steps, np.int32)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(vocabulary_size)
    low, size = np.zeros(lanes), np.full(lanes, DIGIT / HIGH)
    digits, at = np.zeros((2 * steps + 4) * lanes, np.int32), np.arange(lanes)  # a row for each digit; what is not due is overwritten
    one = two = np.zeros(lanes, np.int64)
    for x in grid:
        model.predict(one, two)
        begin, width = model.interval(x)
        step = np.floor(size / model.total)  # exact: quotients below 2 ** 18 and 2 ** -31 apart from the next integer
        low += step * begin
        size = step * width
        due = size < LEAST
        digits[at] = high = np.floor(low * HIGH)
        at += due * lanes
        factor = due * (DIGIT - 1) + 1
        low = (low - due * high * LEAST) * factor
        size *= factor
        while len(own := np.flatnonzero(size < LEAST)):
            digits[at[own]] = high = np.floor(low[own] * HIGH)
            at[own] += lanes
            low[own] = (low[own] - high * LEAST) * DIGIT
            size[own] *= DIGIT
        model.update(x, width)
        one, two = x.astype(np.int64), one
    low = np.ceil(low / DIGIT)  # whatever digit follows the last two stays inside
    digits[at] = np.floor(low / DIGIT)
    digits[at + lanes] = low % DIGIT
    at = at // lanes + 2
    digits = digits.reshape(-1, lanes)[: at.max()]
    kept = np.arange(len(digits))[:, None] < at
    digits *= kept
    for k in range(len(digits) - 1, 0, -1):
        digits[k - 1] += digits[k] >> DIGIT_BITS
    return at.astype("<u4"), digits.astype("<u2").T[kept.T]


def decode_ids(n: int, sizes: np.ndarray, digits: np.ndarray, vocabulary_size: int) -> np.ndarray:
    """The n ids that encode_ids was given."""
    lanes, steps = _lanes(n)
    digits = np.append(digits, np.zeros(4, "<u2")).astype(np.float64)
    at = np.concatenate([[0], np.cumsum(sizes[:-1], dtype=np.int64)]).astype(np.int64)
    code, size = np.zeros(lanes), np.full(lanes, DIGIT / HIGH)
    for _ in range(3):
        code = code * DIGIT + digits[at]
        at += 1
    model, grid = _Model(vocabulary_size), np.zeros((steps, lanes), np.int32)
    one = two = np.zeros(lanes, np.int64)
    for t in range(steps):
        model.predict(one, two)
        step = np.floor(size / model.total)
        value = np.floor(code / step).astype(np.int32)  # exact: below 2 ** 31, quotients 2 ** -18 apart from the next integer
        x, begin, width = model.find(value)
        code -= step * begin
        size = step * width
        due = size < LEAST
        factor = due * (DIGIT - 1) + 1
        code = code * factor + due * digits.take(at)
        at += due
        size *= factor
        while len(own := np.flatnonzero(size < LEAST)):
            code[own] = code[own] * DIGIT + digits[at[own]]
            at[own] += 1
            size[own] *= DIGIT
        model.update(x, width)
        grid[t] = x
        one, two = x.astype(np.int64), one
    return np.ascontiguousarray(grid.T).reshape(-1)[:n].astype("<u4")


def write_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, vocabulary_size: int, shard: int = 0, block: int = 0) -> bytes:
    sizes, digits = encode_ids(ids, vocabulary_size)
    body = b"".join([
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids),
        np.array(lengths, "<u4").tobytes(), sizes.tobytes(), digits.tobytes(),
    ])
    return HEAD.pack(MAGIC, VERSION, shard, block, len(doc_ids), len(ids), len(sizes), vocabulary_size, len(body), zlib.crc32(body)) + body


def read_block(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids per document and all ids of a block; ValueError if it is damaged."""
    if len(data) < HEAD.size:
        raise ValueError("block is cut short")
    magic, version, _, _, docs, n, lanes, size, length, crc = HEAD.unpack_from(data)
    body = data[HEAD.size :]
    if magic != MAGIC or version != VERSION or len(body) != length or zlib.crc32(body) != crc:
        raise ValueError("block is damaged")
    doc_ids = np.frombuffer(body, "<i8", docs).tolist()
    null = body[8 * docs : 9 * docs]
    lengths = np.frombuffer(body, "<u4", docs, 9 * docs)
    sizes = np.frombuffer(body, "<u4", lanes, 13 * docs)
    digits = np.frombuffer(body[13 * docs + 4 * lanes :], "<u2")
    return [None if x else d for d, x in zip(doc_ids, null, strict=True)], lengths, decode_ids(n, sizes, digits, size)


def blocks_of(content: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """shard, block, ids, first and last byte (exclusive) of each block of a file; ValueError where none begins."""
    at = 0
    while at < len(content):
        if len(content) - at < HEAD.size:
            raise ValueError("file is cut short")
        magic, _, shard, block, _, n, _, _, length, _ = HEAD.unpack_from(content, at)
        end = at + HEAD.size + length
        if magic != MAGIC or end >= len(content) or content[end : end + 1] != b"\n":
            raise ValueError("file is damaged")
        yield shard, block, n, at, end
        at = end + 1


def write_ids(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 0) -> str:
    """Writes the files of blocks to `folder`; returns it. Unless given it is a new one in the shared folder, deleted when the
    application ends."""
    spark, end = docs.sparkSession, np.array([end_id], "<u4").tobytes()
    if folder is None:
        folder = f"{scratch_root(spark).rstrip('/')}/tracequarry/ids-{uuid.uuid4().hex}"
        delete_at_end(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, block = vocabulary(path), TaskContext.get().partitionId(), 0
        size = words.library.get_vocab_size()
        doc_ids: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def flushed() -> pa.RecordBatch:
            data = write_block(doc_ids, [len(p) // 4 for p in parts], np.frombuffer(b"".join(parts), "<u4"), size, shard, block)
            return pa.RecordBatch.from_pydict({"data": pa.array([data], pa.binary())})

        for batch in batches:
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), words.encode(batch["text"]), strict=True):
                if held and held + len(raw) // 4 + 1 > BLOCK_IDS:
                    yield flushed()
                    doc_ids, parts, held, block = [], [], 0, block + 1
                doc_ids.append(doc_id)
                parts.append(raw + end)
                held += len(raw) // 4 + 1
        if held:
            yield flushed()

    docs = docs.select("doc_id", "text")
    shards = -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    # a shard for each range of doc_id: as many as the text needs, not fewer than the session's partitions
    ordered = docs.repartitionByRange(max(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order)
    # bytes as they are: a string column is written without recoding
    ordered.mapInArrow(run, "data binary").select(F.col("data").cast("string")).write.option("compression", "none").text(folder)
    return folder


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document in the folder's files."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                rows = [found[:3] for found in blocks_of(content.as_py())]
                columns = list(zip(*rows, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["shard", "block", "n_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                data = content.as_py()
                for shard, block, _, a, b in blocks_of(data):
                    doc_ids, lengths, ids = read_block(data[a:b])
                    raw, ends = ids.tobytes(), np.cumsum(lengths, dtype=np.int64).tolist()
                    starts = [0, *ends[:-1]]
                    own = [raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]
                    n = len(doc_ids)
                    columns = {
                        "doc_id": pa.array(doc_ids, pa.int64()), "_shard": pa.array([shard] * n, pa.int64()), "_block": pa.array([block] * n, pa.int64()),
                        "_start": pa.array(starts, pa.int64()), "n_tokens": pa.array(lengths.tolist(), pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64()),
                    }
                    yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(own, pa.binary())} if with_ids else {}))

    files = spark.read.format("binaryFile").load(folder).select("content")
    kinds = "doc_id long, _shard long, _block long, _start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    found = files.mapInArrow(run, kinds)
    places = files.mapInArrow(heads, "shard long, block long, n_ids long")
    sums = places.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    sums = sums.select("shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = places.select("shard", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("block_start")).join(sums, "shard")
    joined = found.join(places, (F.col("_shard") == F.col("shard")) & (F.col("_block") == F.col("block")))
    return joined.select("doc_id", (F.col("shard_start") + F.col("block_start") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
