"""A generator and an embedder that need no network: results depend on the input's SHA-256 alone."""

from __future__ import annotations

import hashlib
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The marker that makes generation fail, and the vector's length.
#: What makes the generator fail, what marks its texts, and characters to a token.
FAIL_MARKER, MARK, TOKEN_LENGTH = "__FAIL__", " [fake:", 4
DIMENSIONS = 256


def joined(messages: Column) -> Column:
    """messages: array of (role, content)."""
    return F.array_join(F.transform(messages, lambda m: m["content"]), "\n")


def generate(messages: Column) -> Column:
    """struct(text, error, input_tokens, output_tokens): the last user message with a digest of all; tokens are a quarter of the characters."""
    whole = joined(messages)
    asked = F.filter(messages, lambda m: m["role"] == "user")
    last = F.when(F.size(asked) > 0, F.element_at(asked, -1)["content"]).otherwise(whole)
    text = F.concat(F.regexp_replace(last, r"^\s+|\s+$", ""), F.lit(MARK), F.substring(F.sha2(whole, 256), 1, 8), F.lit("]"))
    failed = F.contains(whole, F.lit(FAIL_MARKER))
    tokens = lambda t: F.greatest(F.lit(1), F.floor(F.length(t) / TOKEN_LENGTH)).cast("int")
    return F.struct(
        F.when(~failed, text).alias("text"), F.when(failed, F.lit("the generator was asked to fail")).alias("error"),
        F.when(~failed, tokens(whole)).alias("input_tokens"), F.when(~failed, tokens(text)).alias("output_tokens"),
    )


def generate_judgement(messages: Column) -> Column:
    """A judge's JSON reply with a score of 1 to 5 from the digest's first byte."""
    digest = F.sha2(joined(messages), 256)
    score = 1 + F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % 5
    return F.to_json(F.struct(score.alias("score"), F.concat(F.lit("fake reasoning for "), F.substring(digest, 1, 8)).alias("reasoning")))


def vector(text: str) -> list[float]:
    v = [0.0] * DIMENSIONS
    for word in re.findall(r"\w+", text.lower()):
        digest = hashlib.sha256(word.encode()).digest()
        v[int.from_bytes(digest[:4], "big") % DIMENSIONS] += 1.0 if digest[4] % 2 == 0 else -1.0
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm else [1.0, *v[1:]]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def embed(texts: pd.Series) -> pd.Series:
    """Unit vectors of texts: each word adds 1 or -1 at a place by its digest; a text without words is the first axis."""
    return pd.Series([None if t is None else vector(t) for t in texts], dtype=object)
