"""Operator 2: benchmark decontamination by Wu-Manber multi-pattern search over words.

Symbols are words (A-Z lower-cased, runs of 0-9, a-z and all beyond ASCII). Patterns are windows of `window`
consecutive item words, or the whole item if it has fewer; patterns of one length share tables. A block is the last two
words (one, for patterns of one word). The shift table says how far a search may move on from a block; at shift zero
the block's suffix bucket is looked up, a window hash selects test strings in it, and the words themselves are compared
before an occurrence counts. Many stretches of many documents are searched in lockstep with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, fresh, in_arrow, quoted, ranges, slices

WINDOW = 13
SLICE_BYTES = 4 << 20
#: Most bytes of item texts (one item at least) whose tables, some ten times as large, the driver and a worker hold at
#: once; a larger benchmark takes several passes.
PASS_BYTES = 8 << 20
STRETCH = 256
TABLE_BITS = 20

_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[0x30:0x3A] = _WORD_BYTE[0x61:0x7B] = _WORD_BYTE[0x80:] = True
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Words:
    """The words of texts, as offsets into one lower-cased byte string, with a hash each."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join([b"\0" * 8, *(x.lower() for x in texts), b"\0" * 8])
        data = np.frombuffer(self.raw, dtype=np.uint8)
        inside = _WORD_BYTE[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        text_starts = 9 + np.cumsum(sizes + 1) - sizes - 1
        self.first = np.searchsorted(self.starts, text_starts)
        self.count = np.searchsorted(self.starts, text_starts + sizes) - self.first
        eights = np.ndarray(shape=(len(self.raw) - 7,), dtype="<u8", buffer=self.raw, strides=(1,))
        length = self.ends - self.starts
        head = eights[self.starts] & _KEEP[np.minimum(length, 8)]
        tail = np.where(length > 8, eights[np.maximum(self.ends - 8, 0)], np.uint64(0))
        middle = np.where(length > 16, eights[self.starts + length // 2], np.uint64(0))
        mixed = (head * _A) ^ (tail * _B) ^ (middle * _C) ^ length.astype(np.uint64)
        mixed ^= mixed >> np.uint64(29)
        self.hash = mixed * _B

    def string(self, at: int, n: int) -> bytes:
        return b" ".join(self.raw[s:e] for s, e in zip(self.starts[at : at + n].tolist(), self.ends[at : at + n].tolist(), strict=True))


def _window_hash(hashes: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(last), dtype=np.uint64)
    for k in range(n - 1, -1, -1):
        out = (out ^ hashes[last - k]) * _A
        out ^= out >> np.uint64(31)
    return out


class Patterns:
    """Wu-Manber tables for windows of n words each, as numpy arrays over the items' words: last word and owner by window."""

    def __init__(self, n: int, words: Words, last: np.ndarray, owner: np.ndarray):
        self.n, self.words = n, words
        self.block = min(2, n)
        self.bits = min(TABLE_BITS, max(10, len(last).bit_length() + 4))
        self.shift = np.full(1 << self.bits, n - self.block + 1, dtype=np.int16)
        for k in range(n - self.block, -1, -1):  # blocks ending k words before the end allow moves of k
            at = self._block(words.hash, last - k)
            self.shift[at] = np.minimum(self.shift[at], k)
        # Buckets by suffix block; in each, tests are sorted by window hash. One joint key finds both.
        joint = self._joint(self._block(words.hash, last), _window_hash(words.hash, last, n))
        order = np.lexsort((owner, joint))
        joint, last, owner = joint[order], last[order], owner[order]
        new = np.ones(len(joint), dtype=bool)  # equal windows are one test string with several owners
        new[1:] = joint[1:] != joint[:-1]
        for k in np.flatnonzero(~new).tolist():
            new[k] = words.string(int(last[k]) - n + 1, n) != words.string(int(last[k - 1]) - n + 1, n)
        self.joint, self.last, self.owner = joint[new], last[new], owner
        self.owners = np.append(np.flatnonzero(new), len(joint))

    def _block(self, hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
        mixed = hashes[last] * _C
        if self.block == 2:
            mixed = mixed ^ hashes[last - 1]
        return ((mixed * _A) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _joint(self, suffix: np.ndarray, tests: np.ndarray) -> np.ndarray:
        return (suffix.astype(np.uint64) << np.uint64(64 - self.bits)) | (tests >> np.uint64(self.bits))

    def search(self, words: Words) -> list[tuple[int, int]]:
        """(last word, pattern) of every occurrence inside a text."""
        has = np.flatnonzero(words.count >= self.n)
        low, high = words.first[has] + self.n - 1, words.first[has] + words.count[has]
        stretches = (high - low + STRETCH - 1) // STRETCH
        at = ranges(np.zeros(len(has), dtype=np.int64), stretches) * STRETCH + np.repeat(low, stretches)
        end = np.minimum(at + STRETCH, np.repeat(high, stretches))
        found: list[np.ndarray] = []
        while len(at):
            move = self.shift[self._block(words.hash, at)]
            found.append(at[move == 0])
            at = at + np.maximum(move, 1)
            on = at < end
            at, end = at[on], end[on]
        last = np.concatenate([np.zeros(0, dtype=np.int64), *found])
        joint = self._joint(self._block(words.hash, last), _window_hash(words.hash, last, self.n))
        a, b = np.searchsorted(self.joint, joint, "left"), np.searchsorted(self.joint, joint, "right")
        hits = []
        for k in np.flatnonzero(b > a).tolist():
            string = words.string(int(last[k]) - self.n + 1, self.n)
            hits += [(int(last[k]), p) for p in range(a[k], b[k]) if self.words.string(int(self.last[p]) - self.n + 1, self.n) == string]
        return hits


class Tables:
    """The tables for items (item_id, text), one for each length; null texts and texts without words have no windows."""

    def __init__(self, items: list[tuple], window: int):
        self.ids = [None if i is None else str(i) for i, _ in items]
        words = Words([(t or "").encode() for _, t in items])
        length = np.minimum(words.count, window)
        self.patterns = []
        for n in np.unique(length[length > 0]).tolist():
            mine = np.flatnonzero(length == n)
            windows = words.count[mine] - n + 1
            self.patterns.append(Patterns(n, words, ranges(words.first[mine] + n - 1, windows), np.repeat(mine, windows)))

    def search(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
        """Of each text: its number of words, its hit runs on end, and the sorted ids of its items."""
        words = Words(texts)
        change = np.zeros(len(words.starts) + 1, dtype=np.int32)
        ends = words.first + words.count
        found: dict[int, set[str]] = {}
        for tables in self.patterns:
            for last, p in tables.search(words):
                change[last - tables.n + 1] += 1
                change[last + 1] -= 1
                owners = tables.owner[tables.owners[p] : tables.owners[p + 1]].tolist()
                found.setdefault(int(np.searchsorted(ends, last, "right")), set()).update(self.ids[k] for k in owners if self.ids[k] is not None)
        hit = np.concatenate([[False], np.cumsum(change) > 0])
        spans: list[list[int]] = [[] for _ in texts]
        for d in _touched(hit, words):
            part = np.concatenate([[False], hit[1 + words.first[d] : 1 + ends[d]], [False]])
            spans[d] = np.flatnonzero(part[1:] != part[:-1]).tolist()
        return words.count, spans, [sorted(found.get(d, ())) for d in range(len(texts))]


def _passes(benchmark: DataFrame, most: int) -> list[DataFrame]:
    """The benchmark in parts of about `most` bytes of text; one part if it is no larger."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // most) if size else 1
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else benchmark for k in range(n)]


def _searched(docs: DataFrame, keep: list[str], part: DataFrame, window: int, names: list[str], only_hits: bool) -> DataFrame:
    """The columns `keep` of docs, and by the three names the words, spans and items that one part of the benchmark gives.

    The driver holds one part at a time; its tables are built once and reach each worker as a broadcast file.
    """
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, t) for n, t in zip(names, _STATE, strict=True)])
    shared = docs.sparkSession.sparkContext.broadcast(Tables([(r["item_id"], r["text"]) for r in part.select("item_id", "text").toLocalIterator()], window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            at = batch.schema.get_field_index
            count, spans, items = shared.value.search([x or b"" for x in batch.column(at("text")).cast(pa.binary()).to_pylist()])
            new = [pa.array(count, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in keep), *new], names=[*keep, *names])
            yield out.filter(pa.array([bool(x) for x in spans])) if only_hits else out

    needed = list(dict.fromkeys([*keep, "text"]))
    return in_arrow(docs.select(*(F.col(quoted(c)) for c in needed)), run, schema)


_STATE = (T.LongType(), T.ArrayType(T.LongType()), T.ArrayType(T.StringType()))


def _union(name: str, more: str):
    """Hit runs of several passes as one list of runs."""

    def merge(runs: list[list[int]]) -> list[int]:
        out: list[int] = []
        for s, e in sorted(x for own in runs for x in zip(own[::2], own[1::2], strict=True)):
            if out and s <= out[-1]:
                out[-1] = max(out[-1], e)
            else:
                out += [s, e]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            own, others = batch.column(at(name)).to_pylist(), batch.column(at(more)).to_pylist()
            yield batch.set_column(at(name), name, pa.array([merge([x, *y]) if y else x for x, y in zip(own, others, strict=True)], pa.list_(pa.int64())))

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = 0.05, pass_bytes: int = PASS_BYTES, keep: bool = False) -> DataFrame:
    """One row for each of documents(doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items.

    A word is hit if it lies in an occurrence of any window; spans are the hit runs as word numbers [start, end) on
    end, items the sorted ids of items with an occurring window. contaminated: n_hit > 0 and n_hit >= share * n_words.
    A null text has no words; a null item text has no windows; a null item_id hits but is no item; items with equal
    text both count; repeated items count once. With keep the columns of documents stay and contaminated is added (in
    place of one of that name).
    """
    kept = [c for c in docs.columns if not keep or c != "contaminated"] if keep else ["doc_id"]
    words, spans, items, row, more_spans, more_items = fresh(docs, "found_words", "found_spans", "found_items", "found_row", "more_spans", "more_items")
    names, parts = [words, spans, items], _passes(benchmark, pass_bytes)
    if len(parts) == 1:
        out = _searched(docs, kept, parts[0], window, names, False)
    else:  # every pass reads the texts; only the rows it hits move
        known = durable(docs.select(*(F.col(quoted(c)) for c in dict.fromkeys([*kept, "text"]))).withColumn(row, F.monotonically_increasing_id()))
        first = _searched(known, [*kept, row], parts[0], window, names, False)
        hits = reduce(DataFrame.unionByName, [_searched(known, [row], part, window, names, True) for part in parts[1:]])
        gathered = hits.groupBy(row).agg(F.collect_list(spans).alias(more_spans), F.collect_list(items).alias(more_items))
        both = first.join(gathered, row, "left")
        out = in_arrow(both, _union(spans, more_spans), both.schema)
        out = out.withColumn(items, F.when(F.col(more_items).isNull(), F.col(items)).otherwise(F.array_sort(F.array_distinct(F.concat(F.col(items), F.flatten(more_items))))))
    limit = round(1 / share)
    n_hit = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    bad = ((n_hit > 0) & (n_hit * limit >= F.col(words))).alias("contaminated")
    if keep:
        return out.select(*(F.col(quoted(c)) for c in kept), bad)
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(words).alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.col(items)), 256).alias("items_sha256"), bad, F.col(spans).alias("spans"), F.col(items).alias("items"),
    )


def _touched(hit: np.ndarray, words: Words) -> list[int]:
    """Texts with a hit word."""
    upto = np.cumsum(hit[1:])
    upto = np.concatenate([[0], upto])
    return np.flatnonzero(upto[words.first + words.count] > upto[words.first]).tolist()
