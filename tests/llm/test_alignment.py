"""Alignment against plain loops over the libraries' own tokens."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tracequarry.llm import alignment
from tracequarry.llm.queries import op13_alignment
from helpers import SF_DIR

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EXTRA = [
    (1, "Spaces  in   a row \t\tand\n\n\nlines "), (2, " lead"), (3, "trail "), (4, "▁taken for a space"), (5, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (6, "日本語のテキスト🙂👩‍👩‍👧 é ﬁ ２"), (7, "\x00\x01\x7f\xa0　x"), (8, " "), (9, "\n"), (10, "word " * 3000 + "end"), (10, "word"), (11, "x" * 3000),
]



def brute(rows):
    one, two = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    letters = {c: b for c, b in alignment._byte_of_letter().items()}
    docs, count = [], Counter()
    for doc_id, text in rows:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        spell_a = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
        spell_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(spell_a) != raw or b"".join(spell_b) != raw:
            a, b = [], []
        groups, ga, gb, i, j, end_a, end_b = [], [], [], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if end_a <= end_b:
                end_a += len(spell_a[i])
                ga.append(a[i])
                i += 1
            else:
                end_b += len(spell_b[j])
                gb.append(b[j])
                j += 1
            if end_a == end_b:
                groups.append((ga, gb))
                ga, gb = [], []
        count.update((x[-1], y[-1]) for x, y in groups)
        docs.append((doc_id, a, b, groups))
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for doc_id, a, b, groups in docs:
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_equals_loops(spark, documents):
    got = op13_alignment(spark, SF_DIR)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute([(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()])


@pytest.mark.parametrize("max_pairs", [1_000_000, 5])
def test_odd_texts_and_both_ways_to_join(spark, odd, max_pairs):
    more = spark.createDataFrame(EXTRA, "doc_id long, text string")
    docs = odd.unionByName(more, allowMissingColumns=True).withColumnRenamed("_key", "pairs").withColumnRenamed("_text", "row")
    got = alignment.align_tokenizers(docs, A, B, max_pairs).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    zero = [r for r in got if r["doc_id"] == 4][0]
    assert zero["n_a"] == zero["n_groups"] == 0 and zero["groups_sha256"] == ""


def test_groups_of_one_text_and_emptied_tables(monkeypatch):
    monkeypatch.setattr(alignment, "MAX_WORDS", 3)
    texts = [t for _, t in EXTRA]
    whole = SentencePieceProcessor(model_file=B)
    assert [x.tolist() for x, _ in alignment._Pieces(B).encode(texts)] == [whole.encode(t) for t in texts]
    groups = alignment.token_groups("unbelievable, naïve 日本", A, B)
    assert all(a and b for a, b in groups) and len(groups) > 3 and alignment.token_groups("▁", A, B) == []


def test_ids_after_a_space():
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    texts = [t for _, t in EXTRA] + ["Words begin\nlines\n\nhere", "one", "\nline first", "naïve"]
    got = alignment._AfterSpace(A).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [one.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_empty_table(spark, none):
    assert alignment.align_tokenizers(none, A, B).collect() == []
