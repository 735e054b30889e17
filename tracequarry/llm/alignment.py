"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes.

Both tokenizers read the text after a space. Every byte gets a label: no token, a token of A, of B, or of both ends there.
A regular expression scans the labels for spans up to each both-label; a span's counts of labels say how many tokens of A
and of B form the group. The last tokens of a group are the only ones of it that end together, so a group is one link.

Links are counted over all documents: a document's distinct id pairs with their multiples are kept, summed by pair, and
read again with the sums. The table of sums has at most one row for each pair of ids; it is broadcast if it has at most
MAX_PAIRS rows, and otherwise joined by pair, where Spark splits pairs that many documents hold.

Defined results: null and empty texts, and texts whose tokens do not spell them, have no tokens, zeros and an empty digest;
rows with equal or null doc_id are documents of their own; an empty table has no rows. Columns other than doc_id and text are
not read. Texts are never cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from .common import small, written
from .vocab import Vocabulary

#: Most distinct id pairs that are broadcast, and characters of text to a step.
MAX_PAIRS, STEP = 1_000_000, 1 << 21
#: Words whose pieces a Python worker remembers.
MAX_WORDS = 400_000
A_ENDS, B_ENDS, BOTH = 1, 2, 3
SPAN = re.compile(rb"[^\x03]*\x03", re.DOTALL)


class _Counts(dict):
    """Labels of A and of B in a span, as one number; spans recur, and the table is emptied when it holds many."""

    def __missing__(self, span: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        both = span.count(b"\x03")
        self[span] = n = (span.count(b"\x01") + both) << 32 | span.count(b"\x02") + both
        return n


class _AfterSpace(Vocabulary):
    """Ids of texts that follow a space, so that the first word is one like others."""

    lead = " "

    def __init__(self, path: str):
        super().__init__(path)
        letters = _byte_of_letter()
        #: Whether tokens always spell the text: each byte is a token, and nothing is changed before.
        self.lossless = self.library.normalizer is None and all(self.library.token_to_id(c) is not None for c in letters)


class _Pieces:
    """Ids of a piece model. No piece goes on past a space, so that words are encoded once each, many to a call, and remembered."""

    def __init__(self, path: str):
        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.spelled = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.by_word = not any("▁" in n.lstrip("▁") for n in names)
        self.starts = np.array([n.startswith("▁") for n in names])
        self.known: dict[str, bytes | None] = {}

    def _spell(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids.tolist()))

    def _learn(self, words: list[str]) -> None:
        """Each word's ids, or None where they do not spell it."""
        ids = np.array(self.model.encode(" ".join(words)), "<u4")
        first = np.flatnonzero(self.starts[ids])
        if len(first) == len(words) and self._spell(ids) == b"".join(b" " + w.encode() for w in words):
            raw, bounds = ids.tobytes(), [*(first * 4).tolist(), len(ids) * 4]
            self.known.update((w, raw[a:b]) for w, a, b in zip(words, bounds[:-1], bounds[1:], strict=True))
            return
        for w, own in zip(words, self.model.encode(words, num_threads=1), strict=True):
            own = np.array(own, "<u4")
            self.known[w] = own.tobytes() if self._spell(own) == b" " + w.encode() else None

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        """Each text's ids, and whether they spell it after a space."""
        split = [t.split(" ") if self.by_word else [""] for t in texts]
        every = set().union(*split)
        new = [w for w in every if w and w not in self.known]
        if len(self.known) + len(new) > MAX_WORDS:
            self.known.clear()
            new = [w for w in every if w]
        for i in range(0, len(new), 4096):
            self._learn(new[i : i + 4096])
        out = []
        for text, words in zip(texts, split, strict=True):
            try:
                out.append((np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4"), True))
            except (KeyError, TypeError):  # an empty word: spaces in a row or at an end form pieces of their own; or one misspelt
                ids = np.array(self.model.encode(text), "<u4")
                out.append((ids, self._spell(ids) == b" " + text.encode()))
        return out


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible ones themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Aligner:
    def __init__(self, byte_level: str, pieces: str):
        self.a, self.b = _AfterSpace(byte_level), _Pieces(pieces)
        letters = _byte_of_letter()
        size = self.a.library.get_vocab_size()
        names = [self.a.library.id_to_token(i) or "" for i in range(size)]
        self.spelled_a = [bytes(letters[c] for c in n) if all(c in letters for c in n) else n.encode() for n in names]
        self.length_a = np.array([len(s) for s in self.spelled_a])
        self.length_b = np.array([len(s) for s in self.b.spelled])
        mark = lambda n, sign: np.array([b"%d%c" % (i, sign) for i in range(n)], dtype=object)
        self.a_inner, self.a_last = mark(size, ord(",")), mark(size, ord("|"))
        self.b_inner, self.b_last = mark(len(self.length_b), ord(",")), mark(len(self.length_b), ord(";"))
        self.counts = _Counts()

    def __call__(self, texts: list[str | None]) -> list[tuple | None]:
        """n_a, n_b, n_groups, digest, distinct linked pairs (id of A in the upper half) and how often, of each text; None without tokens."""
        out: list[tuple | None] = [None] * len(texts)
        full = [i for i, t in enumerate(texts) if t]
        ids_a = [np.frombuffer(x, "<u4") for x in self.a.encode([texts[i] for i in full])]
        at, a, b, size = [], [], [], 0
        for i, x, (y, spelt) in zip(full, ids_a, self.b.encode([texts[i] for i in full]), strict=True):
            length = int(self.length_b[y].sum())
            if spelt and (self.a.lossless or b"".join(map(self.spelled_a.__getitem__, x.tolist())) == b" " + texts[i].encode()):
                at.append(i)
                a.append(x)
                b.append(y)
                size += length
        if at:
            for i, found in zip(at, self._aligned(a, b, size), strict=True):
                out[i] = found
        return out

    def _aligned(self, texts_a: list[np.ndarray], texts_b: list[np.ndarray], size: int) -> Iterator[tuple]:
        """Of texts laid end to end, as both tokenizers end where a text does."""
        a, b = np.concatenate(texts_a), np.concatenate(texts_b)
        labels = np.zeros(size, dtype=np.uint8)
        labels[np.cumsum(self.length_a[a]) - 1] |= A_ENDS
        labels[np.cumsum(self.length_b[b]) - 1] |= B_ENDS
        spans = SPAN.findall(labels.tobytes())
        both = np.fromiter(map(self.counts.__getitem__, spans), np.int64, len(spans))
        n_a, n_b = both >> 32, both & 0xFFFFFFFF
        to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
        links = a[to_a - 1].astype(np.int64) << 32 | b[to_b - 1]
        words = np.empty(len(a) + len(b), dtype=object)
        place = np.arange(len(a)) + np.repeat(to_b - n_b, n_a)
        words[place] = self.a_inner[a]
        words[place[to_a - 1]] = self.a_last[a[to_a - 1]]
        place = np.arange(len(b)) + np.repeat(to_a, n_b)
        words[place] = self.b_inner[b]
        words[place[to_b - 1]] = self.b_last[b[to_b - 1]]
        words = words.tolist()
        ends_a, ends_b = np.cumsum([len(x) for x in texts_a]), np.cumsum([len(x) for x in texts_b])
        groups = np.searchsorted(to_a, ends_a) + 1
        first = word = 0
        for x, y, end, last in zip(texts_a, texts_b, groups.tolist(), (ends_a + ends_b).tolist(), strict=True):
            pairs, times = np.unique(links[first:end], return_counts=True)
            yield len(x), len(y), end - first, hashlib.sha256(b"".join(words[word:last])[:-1]).hexdigest(), pairs, times
            first, word = end, last


@cache
def _aligner(byte_level: str, pieces: str) -> _Aligner:
    return _Aligner(byte_level, pieces)


def token_groups(text: str, byte_level: str, pieces: str) -> list[tuple[list[int], list[int]]]:
    """The groups of one text, as lists of ids."""
    one = _aligner(byte_level, pieces)
    if not one([text])[0]:
        return []
    a, b = np.frombuffer(next(one.a.encode([text])), "<u4"), one.b.encode([text])[0][0]
    labels = np.zeros(len(text.encode()) + 1, dtype=np.uint8)
    labels[np.cumsum(one.length_a[a]) - 1] |= A_ENDS
    labels[np.cumsum(one.length_b[b]) - 1] |= B_ENDS
    out, i, j = [], 0, 0
    for span in SPAN.findall(labels.tobytes()):
        n = one.counts[span]
        out.append((a[i : (i := i + (n >> 32))].tolist(), b[j : (j := j + (n & 0xFFFFFFFF))].tolist()))
    return out


def _steps(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= STEP:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


KINDS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


def linked_pairs(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, and the distinct linked id pairs (A's in the upper half) with their multiples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _aligner(byte_level, pieces)
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"].to_pylist()
            for i, j in _steps(texts):
                rows = [(0, 0, 0, "", (), ()) if x is None else x for x in align(texts[i:j])]
                yield pa.RecordBatch.from_arrays([ids[i:j], *(pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), list(KINDS)[1:], strict=True))], schema=KINDS)

    kinds = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds)


def align_tokenizers(docs: DataFrame, byte_level: str, pieces: str, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""
    found = written(linked_pairs(docs, byte_level, pieces).withColumn("row", F.monotonically_increasing_id()), "alignment")
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = links.groupBy("pair").agg(F.sum("times").alias("links"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    sums = written(sums.withColumn("best", F.col("links") == F.max("links").over(of_b)), "alignment-pairs")
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0)))
    per_row = links.join(small(sums, max_pairs), "pair").groupBy("row").agg(best.alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    joined = found.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(per_row, "row", "left")
    return joined.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
