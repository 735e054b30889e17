"""Id blocks and packing, against the tokenizers library and their own invariants."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tracequarry.llm.id_codec import blocks_of, decode_ids, encode_ids, read_block, read_ids, write_block, write_ids
from tracequarry.llm.packing import cutting_plan, pack
from tracequarry.llm.vocab import vocabulary


def library(name):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return lambda text, end: [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_are_forgotten_when_idle(monkeypatch, name):
    from tracequarry.llm import vocab

    monkeypatch.setattr(vocab, "IDLE", 0.2)
    own, texts = vocab.Vocabulary(P.path(name)), ["Some words,\nand more words", None, "others  here"]
    first = list(own.encode(texts))
    assert own.spaced.known
    own.timer.join(20)
    assert not own.spaced.known and not own.marks
    assert list(own.encode(texts)) == first == list(vocabulary(P.path(name)).encode(texts))



@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_vocabulary(documents, odd, name):
    own, lib = vocabulary(P.path(name)), library(name)
    texts = [r["text"] for r in documents.collect()] + [r["text"] for r in odd.collect()]
    texts += ["A  b", "\n\n", " lead", "trail ", "tab\tnew\n line", "İstanbul ẞ ﬁ", "<|endoftext|> x<|startoftext|>", "a b c", "O'Neil's\n'tis", "…—“q”", "ÉCOLE été\r\n"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [lib(t, 0)[:-1] for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_steps_of_few_bytes_and_small_tables(monkeypatch, documents, odd, name):
    """Steps cut between texts, tables cut back to a step's words, and ASCII marks behind words learned in one call."""
    from tracequarry.llm import vocab

    monkeypatch.setattr(vocab, "STEP_BYTES", 3000)
    monkeypatch.setattr(vocab, "MAX_WORDS", 300)
    own, lib = vocab.Vocabulary(P.path(name)), library(name)
    texts = [r["text"] for r in odd.collect()] + [r["text"] for r in documents.limit(60).collect()]
    texts += ["", None, "\n", "\nA", "a\n\nb", " a \n b ", *[f"Wörd{m} x{m}{m}\nWord{m}{m}" for m in map(chr, range(33, 127))], "İSTANBUL É", "ΣΑΣ À ΑΣ"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [lib(t, 0)[:-1] for t in texts]
    calls = []
    monkeypatch.setattr(own, "wholes", lambda ts: calls.append(ts) or [b""] * len(ts))
    list(own.encode(["one freshly#### coined$$$ wordings*** here|"]))
    assert {t for ts in calls for t in ts} <= {"one"}
    assert list(own.encode(pa.array([], pa.string()))) == [] == list(own.encode([]))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_are_kept_in_arrays(monkeypatch, name):
    """Under 100 bytes a word; words with marks share their letters' entry; letters that a call does not tell apart go one by one."""
    from tracequarry.llm import vocab

    own, lib = vocab.Vocabulary(P.path(name)), library(name)
    rng = np.random.default_rng(5)
    letters = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 12)))) for _ in range(5000)]
    texts = [" ".join(["one", *(w + m for w in letters[i : i + 100] for m in ("", ",", "$$$"))]) for i in range(0, 5000, 100)]
    want = [lib(t, 0)[:-1] for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want
    table = own.spaced
    assert len(set(letters)) <= len(table.known) <= len(set(letters)) + 1
    assert table.known.nbytes + table.ids.flat.nbytes + table.ids.sizes.nbytes + table.ids.alone.nbytes < 100 * len(table.known)
    monkeypatch.setattr(vocab._Table, "_plain", lambda self, cores: None)
    table.forget()
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 129, 5000, 200_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49_999).astype("<u4")
    ids[n // 2 :] = np.resize(ids[: max(1, n // 10)], n - n // 2) if n else ids
    sizes, words = encode_ids(ids, 50_000)
    assert decode_ids(n, sizes, words, 50_000).tolist() == ids.tolist()


@pytest.mark.parametrize("ids", [np.zeros(70_000), np.full(3000, 299), np.arange(90_000) % 300, np.arange(90_000) // 7 % 2, np.repeat(np.arange(300), 400)], ids=["zeros", "last", "cycle", "runs", "long runs"])
def test_one_sided_and_changing_ids(ids):
    """Slots that fill, tie, lose their ids and hold one id in both orders; digits that carry far."""
    ids = ids.astype("<u4")
    sizes, digits = encode_ids(ids, 300)
    assert decode_ids(len(ids), sizes, digits, 300).tolist() == ids.tolist()


def test_full_block_takes_few_steps():
    """A step's calls of numpy are shared by thousands of ids, which is what keeps the coder's time down."""
    from tracequarry.llm import id_codec

    lanes, steps = id_codec._lanes(id_codec.BLOCK_IDS)
    assert lanes * steps >= id_codec.BLOCK_IDS and lanes >= 8192
    model = id_codec._Model(50_257)
    model.predict(np.zeros(lanes, np.int64), np.zeros(lanes, np.int64))
    assert all(a.dtype == np.int32 for a in (model.table2, model.base, model.total, *model.ends))


def test_damage_is_found():
    data = write_block([1, None], [2, 1], np.array([5, 6, 7], "<u4"), 10)
    doc_ids, lengths, ids = read_block(data)
    assert (doc_ids, lengths.tolist(), ids.tolist()) == ([1, None], [2, 1], [5, 6, 7])
    for bad in (data[:-1], data[:10], data[:-1] + bytes([data[-1] ^ 1]), b"XXXX" + data[4:]):
        with pytest.raises(ValueError):
            read_block(bad)


@pytest.mark.parametrize("n", [1 << 15, 1 << 18])
def test_fewer_bits_than_order_0(n):
    """On ids of the test documents, lanes' digit counts included; order 0's entropy is without the cost of its table."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    ids = np.frombuffer(b"".join(vocabulary(P.path("byte_bpe_50k.json")).encode(texts)), "<u4")[:n]
    share = np.bincount(ids)[np.unique(ids)] / n
    sizes, digits = encode_ids(ids, 50_257)
    assert len(ids) == n and (32 * len(sizes) + 16 * len(digits)) / n < -(share * np.log2(share)).sum()


def test_file_of_blocks():
    blocks = [write_block([k], [3], np.array([5, 10, 7], "<u4"), 11, shard=4, block=k) for k in range(3)]
    content = b"".join(b + b"\n" for b in blocks)
    found = list(blocks_of(content))
    assert [f[:3] for f in found] == [(4, k, 3) for k in range(3)] and [content[a:b] for *_, a, b in found] == blocks
    for bad in (content[:-1], content[:-2], b"x" + content, content + b"TQ"):
        with pytest.raises(ValueError):
            list(blocks_of(bad))


def test_blocks_against_the_library(spark, documents, odd):
    docs = documents.select("doc_id", "text").unionByName(odd.where("doc_id <> 9010 and doc_id is not null").select("doc_id", "text"))
    lib, at, want = library("byte_bpe_50k.json"), 0, []
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"], r["text"] or "")):
        ids = lib(r["text"], 0)
        want.append((r["doc_id"], at, len(ids), crc(ids)))
        at += len(ids)
    got = read_ids(spark, write_ids(docs, P.path("byte_bpe_50k.json"))).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_odd_rows_and_empty_tables(spark, odd, none):
    texts = sorted(r["text"] or "" for r in odd.collect())
    got = read_ids(spark, write_ids(odd, P.path("byte_bpe_50k.json")), with_ids=True).collect()
    lib = library("byte_bpe_50k.json")
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in got) == sorted(lib(t, 0) for t in texts)
    assert sorted(r["start"] for r in got)[0] == 0 and sum(r["n_tokens"] for r in got) == max(r["start"] + r["n_tokens"] for r in got)
    assert read_ids(spark, write_ids(none, P.path("byte_bpe_50k.json"))).count() == 0


def test_packing(documents, odd):
    docs = documents.select("doc_id", "text").unionByName(odd.where("doc_id is not null and doc_id not in (9010, 9011)").select("doc_id", "text"))
    lib = library("word_bpe_49k.json")
    ids = {r["doc_id"]: lib(r["text"], 2) for r in docs.collect()}
    rows = pack(docs, P.path("word_bpe_49k.json")).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == crc(own[r["start"] : r["start"] + r["length"]])
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for runs, whole in [(by_doc, lambda k: len(ids[k])), (by_sequence, None)]:
        for k, parts in runs.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at and length > 0
                at += length
            assert at == whole(k) if whole else at <= 4096
    assert set(by_doc) == set(ids)
    total = sum(map(len, ids.values()))
    assert len(by_sequence) <= -(-total // 4096) * 1.05 + 2


def test_plan_covers_demand():
    """Pieces of sequences cut at random: as many sequences hold them again, but for rounding."""
    rng, n, demand = np.random.default_rng(3), 3000, np.zeros(64, np.int64)
    for _ in range(n):
        cuts = np.sort(rng.choice(np.arange(1, 64), rng.integers(0, 6), replace=False))
        demand += np.bincount(np.diff([0, *cuts, 64]), minlength=65)[1:]
    plan = cutting_plan(np.arange(1, 65), demand, 64)
    assert all((p * np.arange(1, 65)).sum() <= 64 for _, p in plan)
    assert (sum(t * p for t, p in plan) == demand).all()
    assert n <= sum(t for t, _ in plan) <= n * 1.005 + 5


def test_empty_tables(none):
    assert read_ids(none.sparkSession, write_ids(none, P.path("byte_bpe_50k.json"))).count() == 0
    assert pack(none, P.path("word_bpe_49k.json")).count() == 0


def test_odd_rows(odd):
    assert read_ids(odd.sparkSession, write_ids(odd, P.path("byte_bpe_50k.json"))).count() == odd.count()
    assert pack(odd, P.path("word_bpe_49k.json")).selectExpr("sum(length)").first()[0] > 0
