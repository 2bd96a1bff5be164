"""Near copies: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Operator 6's method comes first: SimHash fingerprints of the sets, linked at three or fewer differing bits through Golay
keys. Its links are verified on the texts, and their components are what the rest starts from. Similar sets may differ in
more bits, so an exact set-similarity join finds what is not connected yet. In any fixed order of all shingles two similar
sets share one among the first |x| - ceil(0.8 |x|) + 1 of each (prefix filter); shingles that are frequent in a sample of
documents come last in the order, so few sets meet. Sets that meet are compared by how many shingles fall in each of CELLS
cells: the differences add up to no more than the sets' symmetric difference, so nothing similar is dropped. Large buckets
first give forests over what may be similar, which are verified on the texts; then those members that may still be similar
to one that they are not connected with are compared by their whole sets, and only links that connect them come out. So no
step's rows grow with the square of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, in_arrow, parallelism, slices
from .simhash_dedup import SEED, SLICE_BYTES, components, majority, near_edges

WORDS = 5
#: A power of two; counts by cell are of one byte.
CELLS = 256
#: One document in so many is looked at for frequent shingles, of which so many are told to all tasks at most.
SAMPLE, FREQUENT = 8, 200_000
#: Buckets of more members give forests at first.
LARGE = 8
#: Bits of the map of rows whose texts are wanted, a power of two; 64 of them are one row of a broadcast.
WANTED_BITS = 1 << 24
#: Groups of so many sets and bytes of hashes at most are compared as one list, so that each set is dealt out once.
GROUP_NODES, GROUP_BYTES = 4096, 64 << 20
#: Spark's setting that lets an action's shuffle files go when it ends.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Names of the columns that are added meanwhile.
ROW, NODE, SIZE, CELL, PRINT = "__row", "__node", "__size", "__cells", "__print"


def shingles(text: str | None) -> set[bytes]:
    """A text's five-word shingles; A-Z are lower-cased, words end at ASCII white space, fewer words are one shingle."""
    found = text.encode().lower().split() if text else []
    if len(found) <= WORDS:
        return {b" ".join(found)} if found else set()
    return set(map(b" ".join, zip(*(found[i:] for i in range(WORDS)), strict=False)))


def hashes(text: str | None) -> np.ndarray:
    """The shingles' hashes, sorted, each once."""
    found = shingles(text)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in found), dtype=np.uint64, count=len(found)))


def _node(found: np.ndarray) -> int:
    """Names a set; texts with equal sets are one node."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes(), SEED)).view(np.int64))


def _cells(found: np.ndarray) -> np.ndarray:
    """How many of a set's hashes fall in each cell."""
    return np.bincount((found >> np.uint64(65 - CELLS.bit_length())).astype(np.int64), minlength=CELLS).clip(max=255).astype(np.uint8)


def marked(docs: DataFrame) -> DataFrame:
    """docs with a key of the row, its set's name, size, counts by cell and SimHash fingerprint."""
    schema = T.StructType([*docs.schema.fields, T.StructField(ROW, T.LongType()), T.StructField(NODE, T.LongType()), T.StructField(SIZE, T.LongType()), T.StructField(CELL, T.BinaryType()), T.StructField(PRINT, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            sets = [hashes(x) for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            prints = np.array([majority(x) for x in sets], dtype=np.uint64).view(np.int64)
            more = [pa.array([_node(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([_cells(x).tobytes() for x in sets], pa.binary()), pa.array(prints)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, NODE, SIZE, CELL, PRINT])

    return durable(in_arrow(docs.withColumn(ROW, F.monotonically_increasing_id()), run, schema))


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that occur in more than one sampled set, sorted, and the place of each in the order, the rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            found = [hashes(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    some = docs.where(F.pmod(F.xxhash64(NODE), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "h long")
    top = some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = (top.column(k).to_numpy().astype(np.int64) for k in range(2))
    h = h.view(np.uint64)
    place = np.empty(len(h), dtype=np.int64)
    place[np.lexsort((h, n))] = np.arange(len(h))
    order = np.argsort(h)
    return h[order], place[order]


def prefix(found: np.ndarray, frequent: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first |x| - ceil(0.8 |x|) + 1 hashes of a set: by hash those that are not frequent, then the others by place."""
    n = len(found) - (4 * len(found) + 4) // 5 + 1
    if not len(frequent):
        return found[:n]
    at = np.searchsorted(frequent, found).clip(max=len(frequent) - 1)
    known = frequent[at] == found
    rare, often = found[~known], at[known]
    return np.concatenate([rare[:n], frequent[often[np.argsort(place[often])]][: max(0, n - len(rare))]])


def _prefixes(frequent: np.ndarray, place: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task
        for batch in slices(batches, "text", SLICE_BYTES):
            keys, nodes = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
            for text, node in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node not in seen:
                    seen.add(node)
                    found = hashes(text)
                    if len(found):
                        keys.append(prefix(found, frequent, place))
                        nodes.append(np.full(len(keys[-1]), node))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], names=["key", "node"])

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each key that more than one node has: the name of its list of nodes, and the nodes. Rows come sorted by key and node."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def lists(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, nodes = (np.concatenate(x) for x in zip(*parts, strict=True))
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, nodes = keys[new], nodes[new]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        known: dict[int, np.ndarray] = {}
        for k in np.flatnonzero(sizes > 1).tolist():
            members = nodes[starts[k] : starts[k] + sizes[k]]
            known.setdefault(xxhash.xxh3_64_intdigest(members.tobytes(), SEED), members)
        names = np.repeat(np.fromiter(known, dtype=np.uint64, count=len(known)).view(np.int64), [len(x) for x in known.values()])
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *known.values()]))], names=["list", "node"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut or (held and held[-1][0][-1] != keys[0]):
            yield lists([*held, (keys[:cut], nodes[:cut])])
            held = []
        held.append((keys[cut:], nodes[cut:]))
    if held:
        yield lists(held)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows sorted by list as tables of whole lists, with the places where lists begin and the end."""
    held: list[pa.RecordBatch] = []

    def table() -> tuple[pa.Table, list[int]]:
        out = pa.Table.from_batches(held).combine_chunks()
        names = out.column(0).to_numpy()
        return out, [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]

    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(0).to_numpy()
        cut = int(np.searchsorted(names, names[-1]))
        if cut or (held and held[-1].column(0)[-1].as_py() != names[0]):
            held.append(batch.slice(0, cut))
            yield table()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield table()


def _near(i: int, rest: np.ndarray, sizes: np.ndarray, cells: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Those of rest that may be similar to i by size and cells and are not connected with it."""
    rest = rest[(joined[rest] != joined[i]) & (9 * np.abs(sizes[rest] - sizes[i]) <= sizes[rest] + sizes[i])]
    parts = (rest[at : at + 4096] for at in range(0, len(rest), 4096))
    return np.concatenate([rest[:0], *(x[9 * np.abs(cells[x] - cells[i]).sum(axis=1) <= sizes[x] + sizes[i]] for x in parts)])


def _forest(m: int, joined: np.ndarray, near) -> list[tuple[int, int]]:
    """Links of near(i, rest) that connect what it and joined connect; one at most for each of joined's groups but the first."""
    out: list[tuple[int, int]] = []
    left = np.arange(m)
    while len(left):
        own = joined[left] == joined[left[0]]
        front, left = left[own].tolist(), left[~own]
        while front and len(left):
            at = front.pop()
            found = near(at, left)
            if len(found):
                groups, first = np.unique(joined[found], return_index=True)
                out += [(at, int(x)) for x in found[first]]
                new = np.isin(joined[left], groups)
                front += left[new].tolist()
                left = left[~new]
    return out


def _members(whole: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """nodes, sizes, cells and joined of rows (list, node, size, cells, joined)."""
    nodes, sizes, joined = (whole.column(k).to_numpy() for k in (1, 2, 4))
    return nodes, sizes, np.frombuffer(b"".join(whole.column(3).to_pylist()), dtype=np.uint8).reshape(-1, CELLS).astype(np.int16), joined


def _batch(pairs: list[np.ndarray]) -> pa.RecordBatch:
    found = np.unique(np.sort(np.concatenate([np.zeros((0, 2), dtype=np.int64), *pairs]), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each list's members that may be similar and are not connected: all of a small list, a forest of a large one."""
    for whole, cuts in _whole(batches):
        nodes, sizes, cells, joined = _members(whole)
        out: list[np.ndarray] = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            order = i + np.argsort(sizes[i:j], kind="stable")
            own = sizes[order], cells[order], joined[order]
            if j - i > LARGE:
                pairs = _forest(j - i, own[2], lambda k, rest, own=own: _near(k, rest, *own))
            else:
                pairs = [(k, int(x)) for k in range(j - i) for x in _near(k, np.arange(k + 1, j - i), *own)]
            if pairs:
                out.append(nodes[order[np.array(pairs)]])
        yield _batch(out)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each list the members that may be similar to another one with which they are not connected.

    A list falls into the parts that such pairs connect. Each is named by its members, so the same part of many lists is one;
    first is its smallest node.
    """
    for whole, cuts in _whole(batches):
        nodes, sizes, cells, joined = _members(whole)
        names, heads, rows = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            every, part, open_ = np.arange(i, j), np.arange(j - i), np.zeros(j - i, dtype=bool)
            _, group, count = np.unique(joined[i:j], return_inverse=True, return_counts=True)
            for k in every[group != count.argmax()].tolist():
                found = np.append(_near(k, every, sizes, cells, joined), k) - i
                if len(found) > 1:
                    open_[found] = True
                    both = np.unique(part[found])
                    part[np.isin(part, both)] = both[0]
            own = np.flatnonzero(open_)
            own = own[np.argsort(part[own], kind="stable")]  # by node in each part, as rows come
            for one in np.split(own, np.flatnonzero(np.diff(part[own])) + 1) if len(own) else ():
                names.append(np.full(len(one), xxhash.xxh3_64_intdigest(nodes[i + one].tobytes(), SEED), dtype=np.uint64))
                heads.append(np.full(len(one), nodes[i + one[0]]))
                rows.append(i + one)
        at = np.concatenate(rows)
        found = np.concatenate(names).view(np.int64), np.concatenate(heads), nodes[at], joined[at]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["list", "first", "node", "joined"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of similar members of each list that connect all of them that are similar; rows (list, node, joined, hashes)."""
    for whole, cuts in _whole(batches):
        nodes, joined = (whole.column(k).to_numpy() for k in (1, 2))
        out: list[np.ndarray] = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            sets = [np.frombuffer(x, dtype=np.uint64) for x in whole.column(3).slice(i, j - i).to_pylist()]
            sizes, own = np.array([len(x) for x in sets]), joined[i:j]
            cells = np.stack([_cells(x) for x in sets]).astype(np.int16)

            every = np.unique(np.concatenate(sets))
            sets = [np.searchsorted(every, x).astype(np.int32) for x in sets]
            held = np.zeros(len(every), dtype=bool)

            def near(k: int, rest: np.ndarray, sets=sets, sizes=sizes, cells=cells, own=own, held=held) -> np.ndarray:
                some = _near(k, rest, sizes, cells, own)
                held[sets[k]] = True
                both = np.array([np.count_nonzero(held[sets[x]]) for x in some], dtype=np.int64)
                held[sets[k]] = False
                return some[9 * both >= 4 * (sizes[some] + sizes[k])]

            if pairs := _forest(j - i, own, near):
                out.append(nodes[i + np.array(pairs)])
        yield _batch(out)


def similar(x: set[bytes], y: set[bytes]) -> bool:
    """Whether the Jaccard similarity is 0.8 or more, in whole numbers."""
    return 9 * len(x & y) >= 4 * (len(x) + len(y))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by a."""
    last, own = None, set()
    for whole in batches:
        for batch in slices([whole], "y", SLICE_BYTES):
            ok = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if a != last:
                    last, own = a, shingles(x)
                ok.append(similar(own, shingles(y)))
            kept = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])


def _wanted(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without most of the rows that are not among rows(ROW): a map of bits, broadcast, says which may be."""
    bit = F.pmod(F.xxhash64(ROW), F.lit(WANTED_BITS))
    word, mask = F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))")
    bits = rows.select(bit.alias("bit")).select(F.shiftright("bit", 6).alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    known = docs.withColumns({"word": word, "bit": bit}).join(F.broadcast(bits), "word")
    return known.where(mask.bitwiseAND(F.col("mask")) != 0).drop("word", "bit", "mask")


def _texts(docs: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of these nodes. Only texts that a map of bits lets through are dealt out."""
    rows = durable(reps.join(nodes.distinct(), "node").select("node", F.col("row").alias(ROW)))
    return _wanted(docs.select(ROW, "text"), rows).join(rows, ROW).select("node", "text")


def _links(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs(a, b) of nodes that are similar."""
    texts = durable(_texts(docs, reps, pairs.select(F.explode(F.array("a", "b")).alias("node"))))
    whole = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return durable(whole.select("a", "b", "x", "y").sortWithinPartitions("a").mapInArrow(_verify, "a long, b long"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE_BYTES):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashes(x).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], names=["node", "hashes"])


def simhash_pairs(reps: DataFrame) -> DataFrame:
    """a < b: links of nodes(node, print) at three or fewer differing bits that keep all such nodes connected."""
    heads = durable(reps.groupBy("print").agg(F.min("node").alias("head")))
    same = reps.join(heads, "print").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return durable(near_edges(heads.withColumnRenamed("head", "node")).unionByName(same))


def _grouped(apart: DataFrame, reps: DataFrame) -> DataFrame:
    """list, node, joined: parts that share members are one list, unless it would be of more than GROUP_NODES or GROUP_BYTES."""
    groups = durable(components(apart.select(F.col("first").alias("a"), F.col("node").alias("b"))))
    sums = groups.join(reps, "node").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    small = sums.where((F.col("n") <= GROUP_NODES) & (8 * F.col("size") <= GROUP_BYTES)).select("component", F.col("component").alias("group"))
    named = groups.join(small, "component", "left").select("node", "group")
    return durable(apart.join(named, "node").select(F.coalesce("group", "list").alias("list"), "node", "joined").distinct())


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Meanwhile shuffle files go when the action that made them ends; else they stay until the driver collects its garbage.

    What is read again is written by durable(), so nothing comes back to them.
    """
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SWEEP)
        else:
            spark.conf.set(SWEEP, before)


def near_components(docs: DataFrame) -> DataFrame:
    """node, component of marked documents; nodes that are similar to no other are left out."""
    with swept(docs.sparkSession):
        return _connected(docs)


def _connected(docs: DataFrame) -> DataFrame:
    n = parallelism(docs.sparkSession)
    reps = durable(docs.groupBy(F.col(NODE).alias("node")).agg(F.min(ROW).alias("row"), F.min(SIZE).alias("size"), F.min(CELL).alias("cells"), F.min(PRINT).alias("print")))
    links = _links(docs, reps, simhash_pairs(reps.where("size > 0").select("node", "print")))
    found = durable(components(links))

    keyed = docs.select("text", NODE).mapInArrow(_prefixes(*_frequent(docs)), "key long, node long")
    lists = keyed.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(_lists, "list long, node long").distinct()
    lists = durable(lists.join(reps, "node").select("list", "node", "size", "cells"))

    def dealt(members: DataFrame, found: DataFrame) -> DataFrame:
        known = members.join(found, "node", "left").select("list", "node", "size", "cells", F.coalesce("component", "node").alias("joined"))
        return known.repartition(n, "list").sortWithinPartitions("list", "node")

    pairs = durable(dealt(lists, found).mapInArrow(_pairs, "a long, b long").distinct())
    links = durable(links.unionByName(_links(docs, reps, pairs)))
    found = durable(components(links))
    large = lists.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).select("list")
    apart = durable(dealt(lists.join(large, "list"), found).mapInArrow(_apart, "list long, first long, node long, joined long").distinct())
    if apart.isEmpty():
        return found
    apart = _grouped(apart, reps)
    sets = durable(_texts(docs, reps, apart.select("node")).mapInArrow(_hashed, "node long, hashes binary"))
    members = apart.join(sets, "node").select("list", "node", "joined", "hashes").repartition(n, "list").sortWithinPartitions("list", "node")
    return components(links.unionByName(members.mapInArrow(_exact, "a long, b long")))
