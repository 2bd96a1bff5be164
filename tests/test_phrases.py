"""Byte n-grams against plain counting, in bounded batches."""

from collections import Counter

import pyarrow as pa

from tidemark.operators import phrases as P

TEXTS = [("a", "abcabcabc"), ("b", "abcd"), ("a", "abcabd"), (None, "abc"), ("b", None), ("a", ""), ("b", "é漢字 abc " * 40)] * 3


def plain():
    n, d = Counter(), Counter()
    for c, text in TEXTS:
        data = P.framed(text)
        found = Counter((c, k, int.from_bytes(data[i : i + k], "big")) for k in P.LENGTHS for i in range(len(data) - k + 1))
        n.update(found)
        d.update(found.keys())
    return {x: (n[x], d[x]) for x in n}


def summed(rows):
    out: dict = {}
    for c, k, gram, n, d in rows:
        before = out.get((c, k, gram), (0, 0))
        out[c, k, gram] = (before[0] + n, before[1] + d)
    return out


def test_class_counts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(TEXTS)], "id long, c string, text string")
    assert summed(tuple(r) for r in P.class_ngrams(docs, "text", "c").collect()) == plain()
    # Sums that go out early, and classes that start anew, change nothing.
    batch = pa.RecordBatch.from_arrays([pa.array([c for c, _ in TEXTS]), pa.array([t for _, t in TEXTS])], names=["c", "text"])
    for name, value in (("WAITING_ROWS", 40), ("KEPT_ROWS", 60), ("MOST_CLASSES", 2), ("BATCH_ROWS", 50)):
        monkeypatch.setattr(P, name, value)
    out = list(P.by_class(iter([batch.slice(0, 9), batch.slice(9)]), ["c", "len", "gram", "n", "d"]))
    assert max(x.num_rows for x in out) <= 50
    assert summed(tuple(r.values()) for x in out for r in x.to_pylist()) == plain()


def test_many_short_texts_go_out_in_bounded_batches():
    """10,000 documents that came as one batch went out as one batch of all their n-grams."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array([f"{i:04}" + "abcdefghijklmnopqrstuvwxyz" for i in range(10_000)])], names=["id", "text"])
    out = list(P.by_document(iter([batch]), ["id", "len", "gram", "n"]))
    assert max(x.num_rows for x in out) <= P.BATCH_ROWS
    assert sum(x.num_rows for x in out) == sum(len(set(x[i : i + k] for i in range(33 - k))) for j in range(10_000) for x in [P.framed(f"{j:04}abcdefghijklmnopqrstuvwxyz")] for k in P.LENGTHS)


def test_copies_are_summed_where_they_are_read(spark):
    """What is shuffled does not grow with the documents that say the same."""
    docs = spark.range(0, 4000, 1, 2).selectExpr("id", "id % 2 AS c", "'the same words again and again' AS text")
    counts = P.class_ngrams(docs, "text", "c")
    assert counts.count() <= 2 * 2 * 3 * 32
    assert {(r["n"], r["df"]) for r in P.phrase_counts(counts, "c").where("len = 5 AND hex(gram) = '7468652073'").collect()} == {(2000, 4000)}


def test_scores(spark):
    docs = spark.createDataFrame([(1, "abcabc"), (2, None), (3, "xyz")], "id long, text string")
    weights = spark.createDataFrame([(3, 0x616263, 5, -7), (4, 0x63616263, 1, 2)], "len int, gram long, w0 int, w1 int")
    assert {tuple(r) for r in P.phrase_hits(docs, "id", "text", weights, [0, 1]).collect()} == {(1, 3, 11, -12), (2, 0, 0, 0), (3, 0, 0, 0)}
    assert {r["hits"] for r in P.phrase_hits(docs, "id", "text", weights.limit(0), [0, 1]).collect()} == {0}
