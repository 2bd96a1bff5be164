"""Byte-phrase evidence: which byte n-grams tell classes apart.

An n-gram is one long: its bytes, the first one highest. N-grams are counted where the documents are read: by document,
or by class over many documents, so that what is shuffled does not grow with every place in the texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.cut import cut
from tidemark.operators.prefix import prior_totals

LENGTHS = (3, 4, 5)
#: N-grams held at once: rows of a batch that goes out, rows that wait to be summed, different ones that are kept.
BATCH_ROWS, WAITING_ROWS, KEPT_ROWS = 200_000, 2_000_000, 1_000_000
#: A key is the class's number, the length and the n-gram; lengths take 3 bits, n-grams 40.
GRAM_BITS, KEY_BITS, MOST_CLASSES = 40, 43, 1 << 20
#: Fixed values of the reference budget: documents and bytes a class at most, bytes over all classes, bytes a class at least.
CLASS_DOCUMENTS, CLASS_BYTES, ALL_BYTES, LEAST_BYTES = 4096, 64 << 10, 512 << 10, 1024


def framed(text: str | None, most: int | None = None) -> bytes:
    """A text's bytes in normal form KC, `most` of them at most, between the bytes FF and FE, which UTF-8 does not have; null is empty."""
    return b"\xff" + unicodedata.normalize("NFKC", text or "").encode()[:most] + b"\xfe"


def packed(data: bytes, length: int) -> np.ndarray:
    """The n-grams of one length as numbers, in their order."""
    x = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    n = len(x) - length + 1
    out = np.zeros(max(n, 0), dtype=np.int64)
    for k in range(length if n > 0 else 0):
        out = out << 8 | x[k : k + n]
    return out


def shown(length: str, gram: str) -> Column:
    """An n-gram's bytes as hex digits."""
    return F.lpad(F.hex(gram), 2 * F.col(length), "0")


def counted(text: str | None, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys (without a class) of the different n-grams of a framed text, sorted, and how often each occurs."""
    data = framed(text, most)
    parts = [np.unique(packed(data, length), return_counts=True) for length in LENGTHS]
    return np.concatenate([x | length << GRAM_BITS for length, (x, _) in zip(LENGTHS, parts, strict=True)]), np.concatenate([n for _, n in parts])


def _unkeyed(keys: np.ndarray) -> tuple[pa.Array, pa.Array]:
    return pa.array((keys >> GRAM_BITS & 7).astype(np.int32)), pa.array(keys & ((1 << GRAM_BITS) - 1))


def by_document(batches: Iterator[pa.RecordBatch], names: list[str], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Of batches with a text last: the other columns, len, gram, n of each row's different n-grams, in batches of bounded size."""
    for batch in batches:
        at, keys, counts, held = [], [], [], 0
        for i, x in enumerate(batch.column(batch.num_columns - 1)):
            found, times = counted(x.as_py(), most)
            at.append(np.full(len(found), i))
            keys.append(found)
            counts.append(times)
            held += len(found)
            if held >= BATCH_ROWS or i + 1 == batch.num_rows:
                rows, every, n = np.concatenate(at), np.concatenate(keys), np.concatenate(counts).astype(np.int64)
                for k in range(0, len(every), BATCH_ROWS):
                    taken = pa.array(rows[k : k + BATCH_ROWS])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in range(batch.num_columns - 1)), *_unkeyed(every[k : k + BATCH_ROWS]), pa.array(n[k : k + BATCH_ROWS])], names=names)
                at, keys, counts, held = [], [], [], 0


def by_class(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Of batches (class, text): class, len, gram, n, d summed over many documents; a class's n-gram may come more than once."""
    codes: dict = {}
    kind: pa.DataType | None = None
    kept = [np.zeros(0, dtype=np.int64)] * 3
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def summed() -> None:
        nonlocal held, kept
        keys = np.concatenate([kept[0], *(x for x, _ in waiting)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        n = np.concatenate([kept[1], *(x for _, x in waiting)])[order]
        d = np.concatenate([kept[2], np.ones(held, dtype=np.int64)])[order]
        kept = [keys[starts], np.add.reduceat(n, starts), np.add.reduceat(d, starts)] if len(starts) else kept
        waiting.clear()
        held = 0

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal kept
        summed()
        values = pa.array(list(codes), kind)
        for k in range(0, len(kept[0]), BATCH_ROWS):
            keys, n, d = (x[k : k + BATCH_ROWS] for x in kept)
            yield pa.RecordBatch.from_arrays([values.take(pa.array(keys >> KEY_BITS)), *_unkeyed(keys), pa.array(n), pa.array(d)], names=names)
        kept = [np.zeros(0, dtype=np.int64)] * 3
        codes.clear()

    for batch in batches:
        kind = batch.schema.field(0).type
        for value, x in zip(batch.column(0), batch.column(1), strict=True):
            if len(codes) >= MOST_CLASSES:
                yield from out()
            found, times = counted(x.as_py())
            waiting.append((found | codes.setdefault(value.as_py(), len(codes)) << KEY_BITS, times))
            held += len(found)
            if held >= WAITING_ROWS:
                summed()
                if len(kept[0]) >= KEPT_ROWS:
                    yield from out()
    if kind is not None:
        yield from out()


def ngrams(docs: DataFrame, doc: str, text: str, keep: list[str] | None = None, most: int | None = None) -> DataFrame:
    """doc, kept columns, len, gram, n: the different byte n-grams of each row's framed text and how often each occurs.

    The whole text counts unless `most` bytes are given. A null text is the frame alone.
    """
    keep = keep or []
    schema = T.StructType([*(docs.schema[c] for c in (doc, *keep)), T.StructField("len", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
    return docs.select(doc, *keep, F.col(text).alias("__text")).mapInArrow(lambda batches: by_document(batches, schema.names, most), schema)


def class_ngrams(docs: DataFrame, text: str, target: str) -> DataFrame:
    """target, len, gram, n, d: like ngrams, but summed over documents of a class as they are read, d documents to a row; each document is one row."""
    schema = T.StructType([docs.schema[target], *(T.StructField(c, T.IntegerType() if c == "len" else T.LongType()) for c in ("len", "gram", "n", "d"))])
    return docs.select(target, F.col(text).alias("__text")).mapInArrow(lambda batches: by_class(batches, schema.names), schema)


def phrase_hits(docs: DataFrame, doc: str, text: str, weights: DataFrame, classes: list[int]) -> DataFrame:
    """doc, hits, w<class>: occurrences of known n-grams in each row's framed text, and their weights' sums; weights go to the driver (2,048 rows at most)."""
    columns = ["hits", *(f"w{c}" for c in classes)]
    known = sorted((r["len"] << GRAM_BITS | r["gram"], *(r[c] for c in columns[1:])) for r in weights.select("len", "gram", *columns[1:]).collect())
    keys = np.array([r[0] for r in known], dtype=np.int64)
    worth = np.array([[1, *r[1:]] for r in known], dtype=np.int64).reshape(-1, len(columns))
    schema = T.StructType([docs.schema[doc], *(T.StructField(c, T.LongType()) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((batch.num_rows, len(columns)), dtype=np.int64)
            for i, x in enumerate(batch.column(1)):
                data = framed(x.as_py())
                for length in LENGTHS if len(keys) else ():
                    found = packed(data, length) | length << GRAM_BITS
                    at = np.searchsorted(keys, found).clip(max=len(keys) - 1)
                    sums[i] += np.bincount(at[keys[at] == found], minlength=len(keys)) @ worth
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(sums[:, k].copy()) for k in range(len(columns)))], names=schema.names)

    return docs.select(doc, F.col(text).alias("__text")).mapInArrow(run, schema)


def reference_budget(docs: DataFrame, doc: str, text: str, target: str) -> DataFrame:
    """doc, target, text of the documents that phrases are learnt from, with equal bytes a class.

    A class's first CLASS_DOCUMENTS documents by the MD5 of their id count; the budget is the least of CLASS_BYTES, ALL_BYTES
    over the classes and the smallest class's bytes, LEAST_BYTES at least; the text that crosses it is cut there.
    """
    order = F.md5(F.col(doc).cast("string"))
    ranked = docs.where(F.col(target).isNotNull()).withColumn("__rank", F.row_number().over(Window.partitionBy(target).orderBy(order, doc))).where(F.col("__rank") <= CLASS_DOCUMENTS)
    sized = cut(ranked.select(doc, target, F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("__raw"), "__rank"))
    before = prior_totals(sized, "__rank", F.floor(F.col("__rank") / 256), (target,), b=F.sum(F.length("__raw")))
    classes = sized.groupBy(target).agg(F.sum(F.length("__raw")).alias("b"))
    budget = classes.agg(F.greatest(F.least(F.lit(CLASS_BYTES), F.floor(F.lit(ALL_BYTES) / F.count(F.lit(1))), F.min("b")), F.lit(LEAST_BYTES)).alias("__budget"))
    left = sized.join(before, [target, "__rank"]).crossJoin(F.broadcast(budget)).withColumn("__left", F.col("__budget") - F.col("prior_b"))  # one row
    return left.where("__left > 0").select(doc, target, F.substring(F.col("__raw"), F.lit(1), F.col("__left").cast("int")).alias("reference"))


def phrase_counts(grams: DataFrame, target: str) -> DataFrame:
    """len, gram, class, n, df: occurrences by class, and documents over all classes, of class_ngrams."""
    each = grams.repartition("len", "gram").groupBy("len", "gram", F.col(target).alias("class")).agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return each.withColumn("df", F.sum("d").over(Window.partitionBy("len", "gram"))).drop("d")


def phrase_weights(grams: DataFrame, target: str, classes: list[int], most: int = 2048) -> DataFrame:
    """len, gram, df, span, rank and w<class>: quantized log2 ratios to the mean class probability of the strongest phrases of class_ngrams.

    p = (n + 1/2) / (positions of that length in the class + V / 2), V phrases of that length. Kept: df >= 2, span of the
    weights >= 1/2 bit; ranked by span * sqrt(df) * (1 + 0.15 (len - 3)); weights are clipped to 12 bits and held in 256ths.
    """
    one = lambda c: F.sum(F.when(F.col(target) == c, F.col("n")).otherwise(0)).alias(f"n{c}")
    wide = cut(grams.groupBy("len", "gram").agg(F.sum(F.when(F.col(target).isNotNull(), F.col("d")).otherwise(0)).alias("df"), *map(one, classes)))
    positions = wide.groupBy("len").agg(F.count(F.lit(1)).alias("v"), *(F.sum(f"n{c}").alias(f"t{c}") for c in classes))
    p = wide.where("df >= 2").join(F.broadcast(positions), "len").withColumns({f"p{c}": (F.col(f"n{c}") + 0.5) / (F.col(f"t{c}") + 0.5 * F.col("v")) for c in classes})  # a row a length
    mean = sum((F.col(f"p{c}") for c in classes[1:]), F.col(f"p{classes[0]}")) / len(classes)
    w = p.withColumns({f"w{c}": F.log2(F.col(f"p{c}") / mean) for c in classes})
    span = F.greatest(*(F.col(f"w{c}") for c in classes)) - F.least(*(F.col(f"w{c}") for c in classes))
    scored = w.withColumn("span", span).where("span >= 0.5").withColumn("score", F.round(F.col("span") * F.sqrt("df") * (1 + 0.15 * (F.col("len") - 3)), 6))
    top = scored.orderBy(F.desc("score"), shown("len", "gram")).limit(most)
    return top.select("len", "gram", "df", "span", "score", *(F.rint(F.least(F.greatest(F.col(f"w{c}"), F.lit(-12.0)), F.lit(12.0)) * 256).cast("int").alias(f"w{c}") for c in classes))


def phrase_scores(hits: DataFrame, doc: str, classes: list[int], sizes: DataFrame) -> DataFrame:
    """doc, s<class>, coverage: sums of weights over 256 * max(1, bytes - 2), and known n-grams over that, of phrase_hits; sizes(doc, bytes) of the framed texts."""
    hit = hits.groupBy(doc).agg(*(F.sum(c).alias(c) for c in ("hits", *(f"w{c}" for c in classes))))
    per = F.greatest(F.col("bytes") - 2, F.lit(1))
    return sizes.join(hit, doc, "left").select(doc, *((F.coalesce(f"w{c}", F.lit(0)) / (256.0 * per)).alias(f"s{c}") for c in classes), (F.coalesce("hits", F.lit(0)) / per).alias("coverage"))
