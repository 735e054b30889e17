"""Rules on document quality, in DataFrame functions only.

Two kinds of evidence lead to a verdict:

* counts within a text: words, characters in words, symbols, repeated lines, and words that lie in three-word
  windows found twice or more;
* Jensen-Shannon distances of a text's histogram of character classes, and of its histogram of common words, from the
  mean histograms of all documents of its language.

The reference histograms are summed over all documents that have enough words; they have one row per language of
COMMON_WORDS and one for the rest, so joining them is a broadcast of at most five rows whatever the corpus holds.

Defined results: a null or empty text has no words and fails the base rules; a null or unknown lang is compared with the
mean of all such documents by character class only; texts under `min_judged_words` words are never
judged by distance; repeated rows are judged alike, one by one. Counts are made
once and written to the shared folder, as the references and the verdicts both need them. The input's own columns are kept, and the results are put into one
struct column, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, words, written

#: Frequent function words of each language.
COMMON_WORDS = {
    "de": ["das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "in", "ist", "mit", "nicht", "sich", "und", "von", "zu"],
    "en": ["a", "and", "are", "as", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with"],
    "es": ["con", "de", "del", "el", "en", "es", "la", "las", "los", "no", "para", "por", "que", "se", "su", "un", "una", "y"],
    "fr": ["avec", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pour", "que", "qui", "sur", "un", "une"],
}
#: Character classes besides letters, which take the rest: pattern of everything that is not in the class.
CLASSES = {"space": r"[^\x20\x09-\x0D]+", "upper": r"[^A-Z]+", "digit": r"[^0-9]+", "symbol": r"[^#*$%&|<>]+", "mark": r"[^!-\"'-),-/:;=?@\[-`{}~]+"}
INDEX_BITS = 30


def _length_of(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, ""))


def _with_counts(df: DataFrame) -> DataFrame:
    """Adds _t: the text; _w: its words; _n; _classes: characters by class, letters last."""
    df = df.withColumn("_t", F.coalesce(F.col("_text"), F.lit(""))).withColumn("_w", words(F.col("_t")))
    counts = [_length_of(F.col("_t"), p).cast("double") for p in CLASSES.values()]
    df = df.withColumns({"_n": F.size("_w").cast("long"), "_named": F.array(*counts)})
    total = F.length("_t").cast("double")
    return df.withColumn("_classes", F.concat("_named", F.array(total - F.aggregate("_named", F.lit(0.0), lambda a, x: a + x))))


def _common(lang: Column, ws: Column) -> Column:
    """Occurrences of each common word of the language, then of all other words; null where the language is unknown."""
    every = sorted({w for ws_ in COMMON_WORDS.values() for w in ws_})
    found = F.filter(F.transform(ws, lambda w: F.lower(w)), lambda w: w.isin(every))
    out = F.lit(None).cast("array<double>")
    for code, listed in COMMON_WORDS.items():
        bins = F.transform(F.array(*map(F.lit, listed)), lambda k: F.size(F.filter(F.col("_found"), lambda w: w == k)).cast("double"))
        out = F.when(lang == code, bins).otherwise(out)
    return found, out


def _with_common(df: DataFrame) -> DataFrame:
    found, bins = _common(F.col("_lang"), F.col("_w"))
    df = df.withColumn("_found", found).withColumn("_bins", bins)
    rest = F.col("_n").cast("double") - F.aggregate("_bins", F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("_common", F.concat("_bins", F.array(rest)))


def _references(df: DataFrame, min_words: int) -> DataFrame:
    """_ref_lang, _ref_classes, _ref_common: the shares of each language, summed over all documents with enough words.

    Shares, not counts: a few very long documents then weigh no more than others."""
    widest = max(map(len, COMMON_WORDS.values())) + 1
    df = df.where(F.col("_n") >= min_words)
    sums = [F.sum(F.col("_classes")[i] / F.col("_chars")).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    sums += [F.sum(F.get(F.col("_common"), F.lit(i)) / F.col("_n")).alias(f"w{i}") for i in range(widest)]
    out = df.groupBy(F.col("_lang").alias("_ref_lang")).agg(*sums)
    return out.select(
        "_ref_lang",
        F.array(*[f"c{i}" for i in range(len(CLASSES) + 1)]).alias("_ref_classes"),
        F.filter(F.array(*[f"w{i}" for i in range(widest)]), lambda x: x.isNotNull()).alias("_ref_common"),
    )


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of counts; null if either is null or empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    share = lambda a: F.transform(a, lambda x: F.try_divide(x, total(a)))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    parts = F.zip_with(share(p), share(q), lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)))


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds _repeat: words in three-word windows that the text has twice or more.

    Windows are sorted by hash with their place in the low bits, which sorts plain longs; only windows whose hash has an
    equal neighbour are then compared as text.
    """
    mask = (1 << INDEX_BITS) - 1
    w = F.col("_w")
    three = lambda i: (F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    places = F.when(F.col("_n") >= 3, F.sequence(F.lit(0), (F.col("_n") - 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    key = lambda i: F.xxhash64(*three(i)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))
    top = lambda x: F.shiftright(x, INDEX_BITS)
    s = F.col("_keys")
    df = df.withColumn("_keys", F.sort_array(F.transform(places, key)))
    twin = lambda x, i: (top(x) == top(F.get(s, i - 1))) | (top(x) == top(F.get(s, i + 1)))
    maybe = F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x.bitwiseAND(F.lit(mask)).cast("int"))
    df = df.withColumn("_maybe", F.when(F.size(s) > 1, maybe).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_same", F.sort_array(F.transform("_maybe", lambda i: F.struct(F.concat_ws(" ", *three(i)).alias("t"), i.alias("i")))))
    m = F.col("_same")
    equal = lambda x, j: F.coalesce((x["t"] == F.get(m, j - 1)["t"]) | (x["t"] == F.get(m, j + 1)["t"]), (x["t"] == F.get(m, j - 1)["t"]), (x["t"] == F.get(m, j + 1)["t"]), F.lit(False))
    covered = F.flatten(F.transform(F.filter(m, equal), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return df.withColumn("_repeat", F.size(F.array_distinct(covered)).cast("long"))


def quality_rules(
    docs: DataFrame,
    out: str = "quality",
    keep: list[str] | None = None,
    min_words: int = 50,
    repeat_percent: int = 50,
    min_judged_words: int = 80,
    max_distance: float = 0.4,
) -> DataFrame:
    """docs, or its columns `keep`, with one struct column `out`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_distance, common_distance, kept. A text that passes the base rules is rejected if it has `min_judged_words` and
    its two distances (the first twice where there is no second) add up to more than max_distance."""
    names = [c for c in (docs.columns if keep is None else keep) if c != out]
    known = F.when(docs["lang"].isin(list(COMMON_WORDS)), docs["lang"]).otherwise(F.lit(""))
    base = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), docs["text"].alias("_text"), known.alias("_lang"))
    full = _with_repeats(_with_common(_with_counts(base)))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(NOT_SPACE))
    full = full.withColumn("_lines", lines).select(
        "_row", "_lang", "_n", "_classes", "_common", "_repeat",
        F.length("_t").cast("long").alias("_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_dup"),
    )
    full = written(full, "quality-counts")
    full = full.join(F.broadcast(_references(full, min_words)), F.col("_lang") == F.col("_ref_lang"), "left")
    full = full.withColumns({
        "_base": (F.col("_n") < min_words) | (100 * F.col("_repeat") > repeat_percent * F.col("_n")),
        "_dc": F.when(F.col("_n") >= min_words, _distance(F.col("_classes"), F.col("_ref_classes"))),
        "_dw": F.when(F.col("_n") >= min_words, _distance(F.col("_common"), F.col("_ref_common"))),
    })
    far = (F.col("_n") >= min_judged_words) & (F.coalesce(F.col("_dc") + F.coalesce("_dw", "_dc"), F.lit(0.0)) > max_distance)
    verdict = F.struct(
        F.col("_n").alias("n_words"),
        (F.col("_chars") - F.col("_classes")[0]).cast("long").alias("word_chars"),
        F.col("_classes")[3].cast("long").alias("n_symbols"),
        F.col("_dup").alias("n_dup_lines"),
        F.col("_repeat").alias("n_repeat_words"),
        F.col("_base").alias("base_failed"),
        F.col("_dc").alias("class_distance"),
        F.col("_dw").alias("common_distance"),
        (~F.col("_base") & ~far).alias("kept"),
    )
    return full.select(*[F.col("_row")[c].alias(c) for c in names if c != out], verdict.alias(out))


def reject_low_quality(docs: DataFrame, **rules) -> DataFrame:
    """The documents that quality_rules keeps, with their own columns only."""
    out = "_quality_verdict"
    return quality_rules(docs, out=out, **rules).where(F.col(out)["kept"]).select(*docs.columns)
