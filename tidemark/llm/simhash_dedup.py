"""Operator 6: near-duplicates by SimHash, found with Golay-code fuzzy hashing.

Fingerprints of 64 bits link at three or fewer differing bits. Of their four 16-bit blocks one is then equal; of the
other 48 bits one 24-bit half differs in one bit at most. The first 23 bits of that half are a word of the perfect
binary Golay code's space: every codeword within distance 4 of it is a key (one to six of them), and two words that
differ in one bit share a key, namely the codeword nearest to either. So equal block + codeword are equal for any two
linked fingerprints, 28 bits in all; each bucket is then verified by Hamming distance and gives a spanning forest of
its links, never all pairs. Components come from alternating large-star and small-star steps over these edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, parallelism, ranges, slices

SEED = 42
SLICE_BYTES = 4 << 20
#: Fixed value: a generator polynomial of the binary Golay code of length 23 (x^11+x^10+x^6+x^5+x^4+x^2+1).
GENERATOR = 0xC75


def _remainder(x: int) -> int:
    for bit in range(22, 10, -1):
        if x >> bit & 1:
            x ^= GENERATOR << (bit - 11)
    return x


def _cosets() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of (i << 11); and for each syndrome its error patterns of up to four bits, the lightest first, the rest repeated."""
    tails = np.array([_remainder(i << 11) for i in range(1 << 12)], dtype=np.int64)
    patterns: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            patterns[_remainder(error)].append(error)
    return tails, np.array([(p + [p[0]] * 6)[:6] for p in patterns], dtype=np.int64)


_tables: list = []


def golay_keys(words: np.ndarray) -> np.ndarray:
    """(n, 6): the information bits of all codewords within distance 4 of each 23-bit word; the nearest comes first and fills up."""
    if not _tables:
        _tables.extend(_cosets())
    tails, patterns = _tables
    syndromes = (words & 0x7FF) ^ tails[words >> 11]
    return (words[:, None] ^ patterns[syndromes]) >> 11


def bucket_keys(prints: np.ndarray) -> np.ndarray:
    """(n, 48): each fingerprint's keys over the choice of equal block, half and codeword."""
    prints = prints.astype(np.uint64)
    blocks = [((prints >> np.uint64(s)) & np.uint64(0xFFFF)).astype(np.int64) for s in (48, 32, 16, 0)]
    keys = []
    for i in range(4):
        a, b, c = (blocks[j] for j in range(4) if j != i)
        rest = a << 32 | b << 16 | c
        for half, word in ((0, rest >> 25), (1, rest >> 1 & 0x7FFFFF)):
            keys.append(((i * 2 + half) << 28) | (blocks[i][:, None] << 12) | golay_keys(word))
    return np.concatenate(keys, axis=1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int) -> int:
    """SimHash of a text's word shingles, repeats included; A-Z are lower-cased, words end at ASCII white space."""
    found = text.encode().lower().split() if text else []
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    return majority(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), dtype=np.uint64, count=len(found) - words + 1))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, print (the fingerprint as a signed long) of documents(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            prints = np.array([fingerprint(x, words) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, print long")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 20_000):
            batch = whole.slice(at, 20_000)
            if not batch.num_rows:
                continue
            prints = batch.column(0).to_numpy().view(np.uint64)
            keys = bucket_keys(prints)
            keys.sort(axis=1)
            new = np.ones(keys.shape, dtype=bool)
            new[:, 1:] = keys[:, 1:] != keys[:, :-1]
            row = np.nonzero(new)[0]
            yield pa.RecordBatch.from_arrays([pa.array(keys[new]), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], names=["key", "print", "node"])


def _links(distance: int, prints: np.ndarray, nodes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the linked members of each bucket (members on end, sizes[k] in bucket k)."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    starts = np.cumsum(sizes) - sizes
    small = (sizes > 1) & (sizes <= 8)
    for step in range(1, 8):  # small buckets: all pairs at once
        left = ranges(starts[small & (sizes > step)], sizes[small & (sizes > step)] - step)
        ok = np.bitwise_count(prints[left] ^ prints[left + step]) <= distance
        a.append(nodes[left[ok]])
        b.append(nodes[left[ok] + step])
    for k in np.flatnonzero(sizes > 8).tolist():  # large ones: breadth first, each member is reached once
        left = np.arange(starts[k], starts[k] + sizes[k])
        while len(left):
            front, left = [left[0]], left[1:]
            while front and len(left):
                at = front.pop()
                ok = np.bitwise_count(prints[left] ^ prints[at]) <= distance
                found, left = left[ok], left[~ok]
                front += found.tolist()
                a.append(np.full(len(found), nodes[at]))
                b.append(nodes[found])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])



def _bucket_edges(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def edges(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            keys, prints, nodes = (np.concatenate(x) for x in zip(*parts, strict=True))
            cuts = np.flatnonzero(np.diff(keys)) + 1
            sizes = np.diff(np.concatenate([[0], cuts, [len(keys)]]))
            a, b = _links(distance, prints, nodes, sizes)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

        for batch in batches:  # sorted by key; the last bucket may go on in the next batch
            if not batch.num_rows:
                continue
            keys, prints, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or (held and held[-1][0][-1] != keys[0]):
                yield from edges([*held, (keys[:cut], prints[:cut], nodes[:cut])])
                held = []
            held.append((keys[cut:], prints[cut:], nodes[cut:]))
        if held:
            yield from edges(held)

    return run


def near_edges(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """a < b: links of nodes(print, node), one row for each print, that keep linked prints connected."""
    if distance > 3:
        raise ValueError("the keys find links of up to three bits")
    keyed = nodes.select("print", "node").mapInArrow(_keyed, "key long, print long, node long")
    dealt = keyed.repartition(parallelism(nodes.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_bucket_edges(distance), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of edges(a, b); nodes without an edge are left out."""
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = durable(small)
        after = mark(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def simhash_components(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """One row for each row of documents(doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    A null or empty text, or one of white space, has fingerprint zero and links like any other. Rows with a null
    doc_id link nothing: their component_id is that of the same fingerprint elsewhere, or null.
    Equal fingerprints are one node, named by their smallest doc_id, however many documents share them.
    """
    prints = durable(fingerprints(docs, words))
    nodes = durable(prints.groupBy("print").agg(F.min("doc_id").alias("node")))
    named = components(near_edges(nodes.where("node is not null"), distance))
    whole = nodes.join(named, "node", "left").select("print", F.coalesce("component", "node").alias("component_id"))
    return prints.join(whole, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
