"""Removal of multi-line passages that other documents have too, in DataFrame functions only.

Lines are hashed, and a rolling hash covers each pair of adjacent line hashes. A chunk ends where that hash is less than
the one before and not more than the one after, so chunk ends depend on four nearby lines only, an insertion elsewhere
does not shift them, and every chunk but the last has two lines at least, three on average. Chunks of two lines or more whose hash occurs more than once in the corpus are candidates; candidates are then grouped by their very bytes. Of each group
the first occurrence, by doc_id and place, stays and all others are removed.

Hot chunks: occurrences are reduced to their first one before the shuffle (partial aggregation). A chunk hash that occurs
n times is dealt over n / SALTED salts when its occurrences meet the first one, so that no task gets a hot chunk whole;
chunk places and candidates' bytes are written once to the shared folder.

Surroundings (dedup_passages): a chunk reaches over a passage's edge, so short passages hold no whole chunk. Every pair of
adjacent lines whose two line hashes an earlier place has too is a hit; hits that share a line make runs, and runs of over
MIN_WORDS words are removed besides the chunks. The earlier places of a run's pairs need not lie in one document; the first
occurrence of every line stays. Line hashes are confirmed by the bytes of the lines in repeated pairs: pairs with a hash
that stands for unlike lines are no hits. First places are found by partial aggregation and written; pairs with very many
occurrences, MOST_HOT of them at most, meet theirs by a broadcast, and the rest by a join.

Defined results: null and empty texts have no lines and stay as they are; a null doc_id comes after all others; rows
that are equal in doc_id and text are one document, treated alike; a chunk repeated within one document is removed from
its second place on; chunks without a word are left alone. The input's own columns are kept, text replaced, with one
struct column, which replaces an input column of its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, small, words, written


#: Occurrences of one chunk to a salt.
SALTED = 200
#: Chunk hashes that are broadcast, at most.
MOST_HOT = 10_000
#: A run of repeated line pairs has more words than these.
MIN_WORDS = 50


def _hashed(docs: DataFrame) -> DataFrame:
    """_id, _key and line hashes of each text with two lines or more."""
    d = docs.select(docs["doc_id"].alias("_id"), _key(docs["doc_id"], docs["text"]).alias("_key"), docs["text"].alias("_text")).where(F.col("_text").contains("\n"))
    return d.select("_id", "_key", F.transform(F.split("_text", "\n", -1), lambda x: F.xxhash64(x)).alias("_hashes"))


def _chunks(hashed: DataFrame) -> DataFrame:
    """_key, start and n (in lines) and _h of each chunk with two lines or more.

    Chunks are made as an array and only that is exploded, so that no row carries a whole text along."""
    d = hashed.select("_key", "_hashes")
    h, r, last = F.col("_hashes"), F.col("_rolling"), F.size("_hashes") - 1
    d = d.withColumn("_rolling", F.transform(h, lambda x, i: F.when(i > 0, F.xxhash64(F.get(h, i - 1), x))))
    low = lambda i: (i > 0) & F.coalesce(F.get(r, i) < F.get(r, i - 1), F.lit(True)) & F.coalesce(F.get(r, i) <= F.get(r, i + 1), F.lit(True))
    d = d.select("_key", "_hashes", F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | low(i)).alias("_ends"))
    spans = F.transform("_ends", lambda e, j: F.struct(F.coalesce(F.get("_ends", j - 1) + 1, F.lit(0)).alias("start"), e.alias("end")))
    d = d.select("_key", "_hashes", F.filter(spans, lambda c: c["end"] > c["start"]).alias("_spans"))
    size = lambda c: c["end"] - c["start"] + 1
    chunks = F.transform("_spans", lambda c: F.struct(c["start"].alias("start"), size(c).alias("n"), F.xxhash64(F.slice(h, c["start"] + 1, size(c))).alias("_h")))
    return d.select("_key", F.explode(chunks).alias("c")).select("_key", "c.*")


def _key(doc_id: Column, text: Column) -> Column:
    """128 bits of both, equal for rows that are equal in both."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(" "), F.coalesce(text, F.lit("")))))


def _place() -> Column:
    """Of a chunk or pair, in the order in which the first one stays."""
    return F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_key").alias("key"), F.col("start").alias("start"))


def _repeated_pairs(hashed: DataFrame) -> DataFrame:
    """_key, start, line hashes _a and _b of the pairs of adjacent lines that occur more than once; again: not the first place."""
    h = F.col("_hashes")
    pairs = F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: F.struct(i.alias("start"), F.get(h, i).alias("_a"), F.get(h, i + 1).alias("_b")))
    pairs = hashed.select("_id", "_key", F.explode(pairs).alias("p")).select("_id", "_key", "p.*")
    first = pairs.groupBy("_a", "_b").agg(F.min(_place()).alias("_first"), F.count("*").alias("_count")).where("_count > 1")
    first = written(first.select("_a", "_b", F.col("_first.key").alias("_first_key"), F.col("_first.start").alias("_first_start"), "_count"), "first-pairs")
    # as for chunks: pairs with over n / MOST_HOT occurrences, MOST_HOT at most, meet theirs by a broadcast
    total = hashed.agg(F.sum(F.greatest(F.size("_hashes") - 1, F.lit(0)))).first()[0] or 0
    often = F.col("_count") > max(SALTED, total // MOST_HOT)
    hot, others = first.where(often).drop("_count"), first.where(~often).drop("_count")
    marked = pairs.select("_key", "start", "_a", "_b").join(F.broadcast(hot), ["_a", "_b"], "left")
    rare = marked.where("_first_key is null").drop("_first_key", "_first_start").join(others, ["_a", "_b"])
    found = marked.where("_first_key is not null").unionByName(rare)
    again = (F.col("_key") != F.col("_first_key")) | (F.col("start") != F.col("_first_start"))
    return written(found.select("_key", "start", "_a", "_b", again.alias("again")), "repeated-pairs")


def _long_runs(lines: Column, starts: Column) -> Column:
    """(start, n) of the runs of pairs, given by their first lines in order, that have over MIN_WORDS words."""
    froms = F.filter(starts, lambda x, i: F.coalesce(F.get(starts, i - 1) < x - 1, F.lit(True)))
    tos = F.filter(starts, lambda x, i: F.coalesce(F.get(starts, i + 1) > x + 1, F.lit(True)))
    runs = F.zip_with(froms, tos, lambda a, b: F.struct(a.alias("start"), (b - a + 2).alias("n")))
    return F.filter(runs, lambda r: F.size(words(F.array_join(F.slice(lines, r["start"] + 1, r["n"]), "\n"))) > MIN_WORDS)


def dedup_lines(docs: DataFrame, out: str = "line_dedup") -> DataFrame:
    """docs without the chunks that an earlier document, or an earlier place, has; `out`: n_lines, n_removed (lines)."""
    return _without_repeats(docs, out, passages=False)


def dedup_passages(docs: DataFrame, out: str = "line_dedup") -> DataFrame:
    """dedup_lines that also removes the runs of repeated line pairs, whether or not a chunk lies inside them."""
    return _without_repeats(docs, out, passages=True)


def _without_repeats(docs: DataFrame, out: str, passages: bool) -> DataFrame:
    names = [c for c in docs.columns if c != out]
    hashed = written(_hashed(docs), "line-hashes")
    chunks = written(_chunks(hashed), "line-chunks")
    twice = chunks.groupBy("_h").agg(F.min("_key").alias("_k0"), F.max("_key").alias("_k1"), F.min("start").alias("_s0"), F.max("start").alias("_s1"), F.count("*").alias("_count"))
    twice = twice.where((F.col("_k0") != F.col("_k1")) | (F.col("_s0") != F.col("_s1"))).select("_h", "_count", F.ceil(F.col("_count") / SALTED).cast("int").alias("salts"))
    # chunks with over n / MOST_HOT occurrences, MOST_HOT at most, meet theirs by a broadcast, so that none lands in one task
    often = F.col("_count") > max(SALTED, chunks.count() // MOST_HOT)
    marked = chunks.distinct().join(F.broadcast(twice.where(often).select("_h", "salts")), "_h", "left")
    rare = marked.where("salts is null").drop("salts").join(twice.where(~often).select("_h", "salts"), "_h")
    listed = marked.where("salts is not null").unionByName(rare).groupBy("_key").agg(F.collect_list(F.struct("start", "n", "_h", "salts")).alias("_spans"))
    if passages:
        pairs = _repeated_pairs(hashed)
        listed = listed.join(pairs.groupBy("_key").agg(F.collect_set("start").alias("_starts")), "_key", "full")
    else:
        listed = listed.withColumn("_starts", F.lit(None).cast("array<int>"))
    texts = docs.select(docs["doc_id"].alias("_id"), _key(docs["doc_id"], docs["text"]).alias("_key"), docs["text"].alias("_text"))
    split = texts.join(listed, "_key").select("_id", "_key", "_spans", "_starts", F.split("_text", "\n", -1).alias("_lines"))
    chunk_bytes = lambda c: F.array_join(F.slice("_lines", c["start"] + 1, c["n"]), "\n")
    taken = F.transform("_spans", lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), c["_h"].alias("_h"), c["salts"].alias("salts"), chunk_bytes(c).alias("_bytes"), F.lit(False).alias("line")))
    in_pairs = F.array_distinct(F.flatten(F.transform("_starts", lambda i: F.array(F.get(F.col("_lines"), i), F.get(F.col("_lines"), i + 1)))))
    no = F.lit(None).cast("int")
    single = F.transform(in_pairs, lambda x: F.struct(no.alias("start"), no.alias("n"), F.xxhash64(x).alias("_h"), no.alias("salts"), x.alias("_bytes"), F.lit(True).alias("line")))
    candidates = split.select("_id", "_key", F.explode(F.flatten(F.array_compact(F.array(taken, single)))).alias("c")).select("_id", "_key", "c.*")
    candidates = written(candidates.where(F.col("line") | F.col("_bytes").rlike(NOT_SPACE)), "repeated-chunks")
    lines = candidates.where("line")
    candidates = candidates.where("not line").drop("line")
    first = candidates.groupBy("_h", "_bytes").agg(F.min(_place()).alias("_first"), F.first("salts").alias("salts"))
    first = first.select("_h", "_bytes", "_first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("_salt"))
    salted = candidates.withColumn("_salt", F.pmod(F.xxhash64("_key", "start"), F.col("salts")).cast("int"))
    again = salted.join(first, ["_h", "_bytes", "_salt"]).where((F.col("_key") != F.col("_first.key")) | (F.col("start") != F.col("_first.start")))
    gone = again.select("_key", "start", "n", F.lit(False).alias("pair"))
    if passages:
        unlike = lines.groupBy("_h").agg(F.min("_bytes").alias("b0"), F.max("_bytes").alias("b1")).where("b0 <> b1")
        unlike = small(unlike.select(F.col("_h").alias("_a"), F.col("_h").alias("_b")))  # 64-bit collisions of unlike lines
        hits = pairs.where("again").join(unlike.select("_a"), "_a", "left_anti").join(unlike.select("_b"), "_b", "left_anti")
        gone = gone.unionByName(hits.select("_key", "start", F.lit(2).alias("n"), F.lit(True).alias("pair")))
    chunk_or_pair = [F.collect_set(F.when(~F.col("pair"), F.struct("start", "n"))).alias("_gone"), F.array_sort(F.collect_set(F.when(F.col("pair"), F.col("start")))).alias("_hits")]
    gone = gone.groupBy("_key").agg(*chunk_or_pair)

    row = F.struct(*[docs[c] for c in names])
    full = docs.select(row.alias("_row"), _key(docs["doc_id"], docs["text"]).alias("_key")).join(gone, "_key", "left")
    full = full.withColumn("_lines", F.split(F.col("_row")["text"], "\n", -1))
    full = full.withColumn("_gone", F.concat("_gone", _long_runs(F.col("_lines"), F.col("_hits"))))
    full = full.withColumn("_gone", F.when(F.size("_gone") > 0, F.col("_gone")))
    removed = F.flatten(F.transform("_gone", lambda g: F.sequence(g["start"], g["start"] + g["n"] - 1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), removed)
    full = full.withColumns({
        "_stay": F.when(F.col("_gone").isNotNull(), stay),
        "_total": F.when(F.length(F.coalesce(F.col("_row")["text"], F.lit(""))) == 0, 0).otherwise(F.size("_lines")),
    })
    rest = F.array_join(F.transform("_stay", lambda i: F.get(F.col("_lines"), i)), "\n")
    text = F.when(F.col("_stay").isNull(), F.col("_row")["text"]).otherwise(rest)
    report = F.struct(F.col("_total").cast("int").alias("n_lines"), F.when(F.col("_stay").isNull(), 0).otherwise(F.col("_total") - F.size("_stay")).cast("int").alias("n_removed"))
    return full.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in names], report.alias(out))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """dedup_passages with the columns of docs only; documents of which no word is left are dropped, n_chars follows the text."""
    out = "_line_dedup"
    d = dedup_passages(docs, out)
    d = d.where((F.col(out)["n_removed"] == 0) | F.col("text").rlike(NOT_SPACE))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col(out)["n_removed"] == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return d.select(*docs.columns)
