"""Byte-level BPE encoding and decoding without a regular expression.

Pre-tokenisation follows the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
on arrays: each code point has a class, and neighbours' classes give most boundaries. What depends on more than
neighbours (a space that opens a token, an apostrophe that opens a contraction) is a machine of four states. A code
point is then a function from state to state, kept as one byte; functions compose associatively by a table of 65,536
entries, so that states of all texts of a batch come from one blocked scan over the batch.

Slices are merged pair by pair, lowest rank first; results are kept in a table of bounded size for each Python worker.
Token byte offsets come along with the ids, so that any run of tokens can be decoded to its place in the text.

Defined results: null texts are empty; empty texts have no ids; lone surrogates cannot occur in Spark strings; rows are
independent, so repeated rows and ties give equal results. Columns other than those named are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
PLAIN, PREFIX, INSIDE, CLOSED = range(4)
MEMO = 700_000
STEP_CHARS = 1_000_000
#: Code points with the property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    first = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    letters = np.array(first)
    out[letters == "L"], out[letters == "N"] = LETTER, NUMBER
    out[WHITE_SPACE] = WHITE
    out[32] = SPACE
    return out


def _function(*to: int) -> int:
    """The byte of the function that takes state i to to[i]."""
    return sum(t << 2 * i for i, t in enumerate(to))


#: What code points do to the state, by kind: ordinary, a space before other text, an apostrophe, a contraction's inner and last letter.
ORDINARY = _function(PLAIN, PLAIN, PLAIN, PLAIN)
OPENS = _function(PREFIX, PREFIX, PREFIX, PREFIX)
APOSTROPHE = _function(INSIDE, PLAIN, INSIDE, INSIDE)
INNER = _function(PLAIN, PLAIN, INSIDE, PLAIN)
LAST = _function(PLAIN, PLAIN, CLOSED, PLAIN)


@cache
def compositions() -> np.ndarray:
    """[f * 256 + g]: first f, then g."""
    f, g = np.divmod(np.arange(65536, dtype=np.int64), 256)
    out = np.zeros(65536, dtype=np.int64)
    for s in range(4):
        out |= ((g >> (2 * ((f >> 2 * s) & 3))) & 3) << 2 * s
    return out.astype(np.uint8)


def scanned(functions: np.ndarray, width: int = 256) -> np.ndarray:
    """Inclusive prefix compositions of a run of functions."""
    table, n = compositions(), len(functions)
    if n <= width:
        out = functions.copy()
        for i in range(1, n):
            out[i] = table[int(out[i - 1]) * 256 + int(out[i])]
        return out
    rows = -(-n // width)
    blocks = np.full(rows * width, _function(0, 1, 2, 3), dtype=np.uint8)
    blocks[:n] = functions
    blocks = np.ascontiguousarray(blocks.reshape(rows, width).T)
    for t in range(1, width):
        blocks[t] = table[(blocks[t - 1].astype(np.uint16) << 8) | blocks[t]]
    before = scanned(blocks[-1], width)
    blocks[:, 1:] = table[(before[:-1].astype(np.uint16) << 8)[None, :] | blocks[:, 1:]]
    return blocks.T.reshape(-1)[:n]


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a token starts at each code point of texts in a row; first: where a text starts."""
    n = len(points)
    kind = classes()[points]
    white = kind >= SPACE
    opens = np.zeros(n, dtype=bool)
    opens[first] = True
    ends = np.append(opens[1:], True)
    before, after = np.roll(kind, 1), np.roll(kind, -1)
    white_before, white_after = np.roll(white, 1) & ~opens, np.roll(white, -1) & ~ends
    last_white = white & ~white_after & ~ends  # of a run that text follows
    runs = np.full(n, ORDINARY, dtype=np.uint8)
    runs[last_white & (kind == SPACE)] = OPENS
    quote = np.flatnonzero((points == 39) & (opens | (before != OTHER)))
    if len(quote):
        at = lambda k: points[np.minimum(quote + k, n - 1)]
        inside = lambda k: (quote + k < n) & ~np.logical_or.reduce([opens[np.minimum(quote + i, n - 1)] for i in range(1, k + 1)])
        one = inside(1) & np.isin(at(1), [ord(c) for c in "stmd"])
        pair = at(1).astype(np.int64) << 32 | at(2)
        two = inside(2) & np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
        runs[quote[one | two]] = APOSTROPHE
        runs[quote[one] + 1] = LAST
        runs[quote[two] + 1] = INNER
        runs[quote[two] + 2] = LAST
    head = np.flatnonzero(opens)
    runs[head] = (runs[head] & 3) * 0b01010101  # constant: whatever came before, the text starts in the plain state
    state = np.roll(scanned(runs) & 3, 1)  # after the code point before
    start = np.where(white, ~white_before | last_white, (kind != before) | white_before)
    start &= (state == PLAIN) | (state == CLOSED)
    start |= state == CLOSED
    return start | opens


class ByteBpe:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.memo: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one slice: the adjacent pair of lowest rank is merged until none is left."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(self.tokens)
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _ids(self, slices: list[str]) -> list[bytes]:
        memo = self.memo
        new = {s for s in set(slices) if s not in memo}
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = set(slices)
        for s in new:
            memo[s] = np.array(self.merged(s.encode()), dtype="<u4").tobytes() if len(s) < 400 else self._long(s)
        return list(map(memo.__getitem__, slices))

    def _long(self, s: str) -> bytes:
        """Very long slices, in time n log n: pairs wait in a heap, parts form a linked list."""
        import heapq

        piece, ranks = s.encode(), self.ranks
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = right[i] if parts[i] is not None else -1
            if j < 0 or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a] + parts[b]))
        return np.array([ranks[p] for p in parts if p is not None], dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        group: list[str] = []
        for i, text in enumerate(texts):
            group.append(text)
            if i + 1 == len(texts) or sum(map(len, group[-64:])) + 1 > STEP_CHARS or len(group) >= 256:
                out += self._encode_together(group)
                group = []
        return out

    def _encode_together(self, texts: list[str]) -> list[np.ndarray]:
        whole = "".join(texts)
        if not whole:
            return [np.zeros(0, dtype="<u4")] * len(texts)
        lengths = np.array([len(t) for t in texts])
        begin = np.concatenate([[0], np.cumsum(lengths)])
        points = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
        starts = np.flatnonzero(boundaries(points, begin[:-1][lengths > 0]))
        bounds = [*starts.tolist(), len(whole)]
        ids = self._ids([whole[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        cut = np.searchsorted(starts, begin)
        return [np.frombuffer(b"".join(ids[a:b]), dtype="<u4") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token begins, in bytes of the text."""
        return np.cumsum([0, *map(len, map(self.tokens.__getitem__, ids.tolist()))])[:-1]

    def joined(self, ids: np.ndarray) -> bytes:
        return ",".join(map(self.decimal.__getitem__, ids.tolist())).encode()


@cache
def coder(path: str) -> ByteBpe:
    """One for each file and Python worker."""
    return ByteBpe(path)


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return ["" if t is None else t for t in batch[column].to_pylist()]


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, offsets (of each token in the text's bytes) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            ids = bpe.encode(_texts(batch, "text"))
            arrays = [batch["doc_id"], pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.offsets(x) for x in ids], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "offsets"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, offsets array<long>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and bytes of encoded (doc_id, ids); null ids are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            found = [bpe.decode(np.array(x or [], dtype="<u4")) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids (decimal, joined by commas) and of the bytes that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            ids = bpe.encode(_texts(batch, "text"))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"],
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(bpe.joined(x)).hexdigest() for x in ids]),
                "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
            })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
