"""Against the tiktoken library."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tracequarry.llm.byte_bpe import boundaries, coder, decode_ids, encode_texts, round_trip_digests

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = st.sampled_from(list("ab stdmlrevZ9²'’ \t\n\r  .,-é日🙂́\x1c\x85"))


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.text(ALPHABET, max_size=40) | st.text(max_size=20), max_size=8))
def test_ids_are_those_of_the_library(library, texts):
    assert [x.tolist() for x in coder(PATH).encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_long_slices(library):
    texts = ["ab" * 3000, "\n" * 5000, " " * 777 + "x", "né" * 900]
    assert [x.tolist() for x in coder(PATH).encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_boundaries_do_not_cross_texts():
    points = np.frombuffer("it'" .encode("utf-32-le") + "s a".encode("utf-32-le"), "<u4")
    assert np.flatnonzero(boundaries(points, np.array([0, 3]))).tolist() == [0, 2, 3, 4]


def test_documents(spark, documents, odd, library):
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want.append((str(r["doc_id"]), len(ids), digest(",".join(map(str, ids)).encode()), digest((r["text"] or "").encode())))
    got = [(str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in round_trip_digests(docs, PATH).collect()]
    assert sorted(got) == sorted(want)


def test_offsets_and_decoding(spark, odd, library):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    encoded = encode_texts(docs, PATH).cache()
    for r in encoded.collect():
        raw, ends = text[r["doc_id"]].encode(), [*r["offsets"][1:], len(text[r["doc_id"]].encode())]
        assert [raw[a:b] for a, b in zip(r["offsets"], ends, strict=False)] == [library.decode_single_token_bytes(i) for i in r["ids"]]
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in decode_ids(encoded, PATH).collect()} == {i: t for i, t in text.items()}


def test_empty_table(none):
    assert round_trip_digests(none, PATH).count() == 0
