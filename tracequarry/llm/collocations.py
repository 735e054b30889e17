"""Phrase collocations by hierarchical pair naming.

Texts are cut into pieces and words; a task gathers them, by language, into blocks of about BLOCK_WORDS words, each a
list of the block's distinct words and one sequence of their numbers. Then, level by level, a phrase of k words is a pair
of adjacent phrases of k - 1 words that overlap in all but one word:

1. every block lists its distinct pairs of neighbours that both have a global name, with counts;
2. one shuffle by the pair brings the blocks' lists together: its sum is the phrase's frequency, the least (block, number)
   its global name, and phrases under `least` are dropped. A frequent phrase's subphrases are frequent, so none is lost;
3. blocks get back the names of their own phrases and replace their sequence by them.

What is shuffled is a row for each distinct phrase of a block, not for each occurrence, so that a very common phrase has
one row for each block. Names point to the two phrases they were made of: following left pointers gives the frequency of
each beginning, right pointers that of each end, which is all that the cuts need; and as frequencies fall with length, a
phrase lies in a longer one that is frequent enough exactly if one of its children is.

Defined results: null and empty texts have no words; a null language is `und`; words are compared as bytes, with A-Z
lower-cased only; a language without candidates has no rows; repeated rows count each time; an empty table has no rows.
Columns other than text and lang are not read. A text is never cut, so a block may be larger than BLOCK_WORDS by one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written

#: Words to a block, and bytes of text to a step.
BLOCK_WORDS, STEP = 1 << 20, 1 << 22
#: Bits of a number within a block, and of a block within its task.
LOCAL_BITS, BLOCK_BITS = 28, 14
#: Groups of a language's phrases that are ranked before the language as a whole.
SALTS = 64
#: Marks that end a piece become line feeds, tabs spaces.
MARKS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
SCORE = "1000000BD * cast(f as decimal(15, 0)) * cast(f as decimal(15, 0)) div (cast(heads[k - 1] as decimal(18, 0)) * cast(tails[size(tails) - k] as decimal(18, 0)))"


class _Numbers(dict):
    """Numbers of words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Block:
    """Words of one language; 0 stands for nothing, 1 for the end of a piece."""

    def __init__(self):
        self.numbers, self.parts, self.words = _Numbers({b"": 0, b"\n": 1}), [], 0

    def add(self, raw: bytes) -> None:
        words = raw.lower().translate(MARKS).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        ids = ids[ids != 0]
        self.parts.append(ids)
        self.words += int((ids > 1).sum())

    def rows(self, block: int, lang: str) -> pa.RecordBatch:
        seq = _joined(np.concatenate([*self.parts, np.zeros(0, np.int32)]) - 2)
        words = list(self.numbers)[2:]
        counts = np.bincount(seq[seq >= 0], minlength=len(words))
        n = len(words)
        return pa.RecordBatch.from_pydict({
            "block": pa.array(np.full(n + 1, block)),
            "lang": pa.DictionaryArray.from_arrays(np.zeros(n + 1, np.int32), [lang]).cast(pa.string()),
            "local": pa.array([*range(n), None], pa.int32()),
            "word": pa.array([*words, None], pa.binary()).cast(pa.string()),
            "count": pa.array([*counts.tolist(), None], pa.int64()),
            "seq": pa.array([None] * n + [seq.tobytes()], pa.binary()),
        })


def _joined(seq: np.ndarray) -> np.ndarray:
    """The sequence with each run of gaps as one gap."""
    gap = seq < 0
    if len(seq) > 1:
        seq = seq[~(gap & np.concatenate([[False], gap[:-1]]))]
    return np.where(seq < 0, -1, seq).astype(np.int32)


def _steps(texts: list[bytes]) -> Iterator[bytes]:
    """Texts joined to about STEP bytes, a longer one in parts that end before a space."""
    held, size = [], 0
    for t in texts:
        at = 0
        while len(t) - at > STEP and (cut := t.find(b" ", at + STEP)) >= 0:
            if held:
                yield b"\n".join([*held, b""])
                held, size = [], 0
            yield t[at:cut]
            at = cut
        held.append(t[at:] if at else t)
        size += len(t) - at
        if size >= STEP:
            yield b"\n".join([*held, b""])
            held, size = [], 0
    if held:
        yield b"\n".join([*held, b""])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, lang, local, word, count) for a block's words, and one with its sequence."""
    task, made, open_blocks = TaskContext.get().partitionId(), 0, {}

    def closed(least: int) -> Iterator[pa.RecordBatch]:
        nonlocal made
        for lang in [k for k, b in open_blocks.items() if b.words >= least]:
            if made >> BLOCK_BITS:
                raise ValueError("too many blocks in one task; use more partitions")
            yield open_blocks.pop(lang).rows(task << BLOCK_BITS | made, lang)
            made += 1

    for batch in batches:
        langs, texts = batch["lang"].to_pylist(), batch["text"].to_pylist()
        by_lang: dict[str, list[bytes]] = {}
        for lang, t in zip(langs, texts, strict=True):
            if t:
                by_lang.setdefault(lang, []).append(t)
        for lang, own in by_lang.items():
            for raw in _steps(own):
                open_blocks.setdefault(lang, _Block()).add(raw)
                if raw.endswith(b"\n"):  # else the text goes on
                    yield from closed(BLOCK_WORDS)
                    if sum(b.words for b in open_blocks.values()) >= 4 * BLOCK_WORDS:
                        yield from closed(0)
    yield from closed(0)


def _pairs(key: tuple, seqs: pa.Table, names: pa.Table) -> pa.Table:
    """The distinct pairs of a block's adjacent named phrases, and the sequence of their numbers."""
    kinds = pa.schema([("block", pa.int64()), ("local", pa.int32()), ("left", pa.int64()), ("right", pa.int64()), ("count", pa.int64()), ("seq", pa.binary())])
    if not (seqs.num_rows and names.num_rows):
        return kinds.empty_table()
    seq = np.frombuffer(seqs["seq"][0].as_buffer(), dtype=np.int32).astype(np.int64)
    own, ids = names["local"].to_numpy(), names["id"].to_numpy()
    order = np.argsort(own)
    own, ids = own[order], ids[order]
    rank = np.full(int(max(seq.max(initial=-1), own[-1])) + 2, -1, dtype=np.int64)  # the last stands for a gap
    rank[own] = np.arange(len(own))
    at = rank[seq]
    both = (at[:-1] >= 0) & (at[1:] >= 0)
    pairs, place, counts = np.unique(at[:-1][both] * len(own) + at[1:][both], return_inverse=True, return_counts=True)
    out = np.full(max(0, len(at) - 1), -1, dtype=np.int32)
    out[both] = place
    n = len(pairs)
    return pa.table({
        "block": pa.array(np.full(n + 1, key[0].as_py())), "local": pa.array([*range(n), None], pa.int32()),
        "left": pa.array([*ids[pairs // len(own)].tolist(), None], pa.int64()), "right": pa.array([*ids[pairs % len(own)].tolist(), None], pa.int64()),
        "count": pa.array([*counts.tolist(), None], pa.int64()), "seq": pa.array([None] * n + [_joined(out).tobytes()], pa.binary()),
    }, schema=kinds)


def _named(rows: DataFrame, least: int, *of: str) -> DataFrame:
    """The rows of phrases that occur `least` times in all: block, local, id, f, `of`, and whether the row gives the name."""
    same = Window.partitionBy(*of)
    here = F.shiftleft(F.col("block"), LOCAL_BITS).bitwiseOR(F.col("local").cast("long"))
    found = rows.withColumns({"f": F.sum("count").over(same), "id": F.min(here).over(same)}).where(F.col("f") >= least)
    return found.select("block", "local", "id", "f", *of, (F.col("id") == here).alias("own"))


def phrases(docs: DataFrame, longest: int = 3, least: int = 10) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases of each length from 1 to `longest`, and n, the count of words, for each language.

    Phrases: id, lang, phrase, last (its last word), f, heads and tails (frequencies of its first and last 1, 2, ... words),
    left, right (ids of the phrases it was made of; null for words)."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    blocks = written(texts.mapInArrow(_blocks, "block long, lang string, local int, word string, count long, seq binary"), "blocks")
    words = blocks.where("local is not null")
    totals = words.groupBy("lang").agg(F.sum("count").alias("n"))
    named = written(_named(words, least, "lang", "word"), "words")
    none = F.array().cast("array<long>")
    own = named.where("own")
    levels = [own.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("heads"), none.alias("tails"), F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"))]
    for k in range(2, longest + 1):
        seqs = blocks.where("seq is not null").select("block", "seq").groupBy("block")
        pairs = seqs.cogroup(named.select("block", "local", "id").groupBy("block")).applyInArrow(_pairs, "block long, local int, left long, right long, count long, seq binary")
        last = blocks
        blocks = written(pairs, f"pairs{k}")
        if k > 2:
            forget(last)
        named = written(_named(blocks.where("local is not null"), least, "left", "right"), f"names{k}")
        up = levels[-1]
        left = up.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("start"), F.col("heads").alias("_heads"), F.col("f").alias("_head"))
        right = up.select(F.col("id").alias("right"), "last", F.col("tails").alias("_tails"), F.col("f").alias("_tail"))
        made = named.where("own").select("id", "f", "left", "right").join(left, "left").join(right, "right")
        made = made.select("id", "lang", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "f", F.array_append("_heads", F.col("_head")).alias("heads"), F.array_append("_tails", F.col("_tail")).alias("tails"), "left", "right")
        levels.append(written(made, f"phrases{k}"))
    return levels, totals


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """Each language's first `top` phrases of 2 to `longest` words by score: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's frequency, l and r those of its parts at the cut with the least floor(1000000 * a * a / (l * r)), the
    first such cut. A phrase is left out if a longer candidate holds it and has at least `share` percent of its frequency."""
    levels, totals = phrases(docs, longest, least)
    found = []
    for k, level in enumerate(levels[1:], start=1):
        if k + 1 < len(levels):
            above = levels[k + 1]
            children = above.select(F.col("left").alias("id"), "f").unionByName(above.select(F.col("right").alias("id"), "f"))
            level = level.join(children.groupBy("id").agg(F.max("f").alias("above")), "id", "left").where(F.expr(f"above is null or 100 * above < {share} * f"))
        cut = F.array_min(F.expr(f"transform(sequence(1, size(heads)), k -> named_struct('score', {SCORE}, 'k', k, 'l', heads[k - 1], 'r', tails[size(tails) - k]))"))
        found.append(level.withColumn("cut", cut).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = every.withColumn("_salt", F.pmod(F.hash("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
