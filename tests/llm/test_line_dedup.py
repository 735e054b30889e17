"""Chunks and removals against plain Python."""

import xxhash

from tracequarry.llm.line_dedup import dedup_lines, dedup_passages, drop_repeated_lines

SEED = 42


def hash_text(s, seed=SEED):
    return xxhash.xxh64_intdigest(s.encode(), seed)


def hash_longs(values, seed=SEED):
    for v in values:
        seed = xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chunks(text):
    lines = text.split("\n")
    h = [hash_text(x) for x in lines]
    r = [float("inf"), *[signed(hash_longs(h[i - 1 : i + 1])) for i in range(1, len(h))], float("inf")]
    ends = [i for i in range(len(h)) if i == len(h) - 1 or i and r[i] < r[i - 1] and r[i] <= r[i + 1]]
    start = 0
    for e in ends:
        if e > start:
            yield start, "\n".join(lines[start : e + 1])
        start = e + 1


def brute(rows):
    seen, out = {}, []
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        gone = set()
        for start, chunk in chunks(text) if text and "\n" in text else ():
            if not chunk.strip(" \t\n\v\f\r"):
                continue
            if chunk in seen:
                gone |= set(range(start, start + chunk.count("\n") + 1))
            seen[chunk] = True
        lines = (text or "").split("\n")
        new = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text
        out.append((doc_id, new, len(lines) if text else 0, len(gone)))
    return out


def test_documents(documents, odd):
    docs = documents.select("doc_id", "text").unionByName(odd.where("doc_id is not null and doc_id <> 9010").select("doc_id", "text").distinct())
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [(r["doc_id"], r["text"], r["line_dedup"]["n_lines"], r["line_dedup"]["n_removed"]) for r in dedup_lines(docs).collect()]
    want = brute(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[3] for r in want) > 0


def test_shared_passage(spark):
    """A passage in many documents, at shifting places, is cut to its first document but for its edges."""
    passage = [f"Passage line number {i} with some words in it." for i in range(30)]
    rows = [(d, "\n".join([f"own {d} {i} {i * d}" for i in range(d % 7 + 1)] + passage + [f"end {d}"])) for d in range(1500)]
    out = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == rows[0][1]
    for d in range(1, 1500):
        left = out[d].split("\n")
        assert sum(x in passage for x in left) <= 10
        assert sum(x.startswith(("own", "end")) for x in left) >= 1


def test_odd_rows(odd, none):
    out = dedup_lines(odd)
    assert out.columns == [*odd.columns, "line_dedup"] and out.count() == odd.count()
    kept = drop_repeated_lines(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 9011").count() == 2
    assert dedup_lines(none).count() == 0


def brute_passages(rows):
    """Rows after the chunks of brute() and the runs of over 50 words of line pairs that an earlier place has."""
    seen, first, out = set(), set(), {}
    for doc_id, text in sorted(rows):
        lines, gone, hits = text.split("\n"), set(), []
        for start, chunk in chunks(text) if "\n" in text else ():
            if chunk.strip() and chunk in seen:
                gone |= set(range(start, start + chunk.count("\n") + 1))
            seen.add(chunk)
        for pair in enumerate(zip(lines, lines[1:], strict=False)):
            if pair[1] in first:
                hits.append(pair[0])
            first.add(pair[1])
        while hits:
            n = 1
            while n < len(hits) and hits[n] == hits[0] + n:
                n += 1
            run = range(hits[0], hits[0] + n + 1)
            if len(" ".join(lines[i] for i in run).split()) > 50:
                gone |= set(run)
            hits = hits[n:]
        out[doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_short_passages(spark):
    """Passages of 2 to 8 lines and over 50 words between other lines go from all documents but the first, whole."""
    rows, want = [], {}
    for n in range(2, 9):
        for k in range(12):
            passage = [f"passage {n} {k} {i} " + " ".join(f"w{i}{j}" for j in range(-(-51 // n) - 3)) for i in range(n)] if k % 4 else [f"few {n} {k} {i}" for i in range(n)]
            for copy in range(3):
                own = [f"own {n} {k} {copy} {i}" for i in range(6)]
                rows.append((len(rows), "\n".join([*own[:3], *passage, *own[3:]])))
                if k % 4:
                    want[rows[-1][0]] = "\n".join(own) if copy else rows[-1][1]
    got = {r["doc_id"]: r["text"] for r in dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: got[d] for d in want} == want
    assert got == brute_passages(rows)


def test_passages_of_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.where("text is not null").collect()]
    got = {r["doc_id"]: r["text"] for r in dedup_passages(documents.where("text is not null").select("doc_id", "text")).collect()}
    assert got == brute_passages(rows)
