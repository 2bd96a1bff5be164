"""Operator 4: removal of repeated substrings by a sparse suffix array, merged without re-comparing known prefixes.

Every window of LENGTH bytes has an anchor: the place of its smallest GRAM-byte hash (the leftmost). Equal windows have
equal anchors at equal offsets, so a window recurs exactly if, at its anchor, what follows and what precedes recur.
So only suffixes at anchors are sorted (about one in eighteen), and only those whose gram occurs in two documents.

1. Scan. Documents are packed into runs of bounded size. Each run is written once, compressed, with the sorted hashes
   of its anchors' grams by bucket; a gram in several documents of a run is marked, so a common passage counts once a
   run however many documents have it.
2. Each bucket finds the grams that two documents share and answers each run with a bitmap over its own sorted hashes.
3. Each run sorts its suffixes at those anchors. Equal ones (with all that decides their windows) become one entry with
   the smallest doc_id. A part is a range of gram hashes; a run sends each part its sorted entries front-coded: the length
   of the prefix shared with the entry before, then the rest.
4. Each part merges its runs with loser trees that hold common prefix lengths: of two suffixes the one that shares more
   with the last output is smaller, and bytes are compared only past equal lengths. Many trees, each over a slice of the
   order, advance in lockstep. The merged order's prefix lengths and those of the sorted left contexts name each window
   exactly; an entry's mask tells which of its windows occur in a document with a smaller id.
5. Each run applies its masks and removes the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, parallelism, ranges, slices

LENGTH = 50
GRAM = 16
#: Offsets a window's anchor can have; also the longest left context and one more.
OFFSETS = LENGTH - GRAM + 1
RUN_BYTES = 8 << 20
PIECE_BYTES = 1 << 18
#: Bytes of input for each bucket of grams and part of the merge.
PART_BYTES = 16 << 20
HASH_BITS = 48
LANES = 512

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# Scan: runs and their anchors.


def _anchors_of(data: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, gram hash, least offset, largest offset) of the anchors of windows starts[k] ... starts[k] + windows[k] - 1."""
    eights = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    mixed = (eights[: len(data) - 15] * _A) ^ ((eights[8:] ^ (eights[8:] >> np.uint64(31))) * _B)
    mixed ^= mixed >> np.uint64(29)
    mixed *= _A
    low = np.uint64(64 - HASH_BITS)
    hashes = ((mixed ^ (mixed >> np.uint64(32))) * _B) >> low  # mixed anew: anchors are where `mixed` is small
    # Minimum over OFFSETS grams by doubling; the place breaks ties, 22 bits of it, the hash has the others.
    least = (mixed >> np.uint64(22) << np.uint64(22)) | np.arange(len(mixed), dtype=np.uint64)
    width = 1
    while 2 * width <= OFFSETS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (OFFSETS - width)], least[OFFSETS - width :])
    at = ranges(starts, windows)
    place = (least[at] & np.uint64((1 << 22) - 1)).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(at) - 1)[: len(first)]
    place = place[first]
    return place, hashes[place], place - at[last], place - at[first]


class Run:
    """The texts of a run on end, and their anchors: place, document, gram hash, least and largest offset."""

    def __init__(self, docs: list[int | None], texts: list[bytes]):
        self.docs = docs
        self.sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = b"".join(texts)
        self.data = np.frombuffer(self.raw + bytes(64), dtype=np.uint8)
        judged = np.array([d is not None for d in docs], dtype=bool)
        windows = np.where(judged, np.maximum(self.sizes - LENGTH + 1, 0), 0)
        # Pieces of bounded size: whole documents, or stretches of windows of a long one.
        per = PIECE_BYTES
        cuts = -(-windows // per)
        doc = np.repeat(np.arange(len(docs)), cuts)
        begin = self.starts[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * per
        count = np.minimum(per, self.starts[doc] + windows[doc] - begin)
        found = []
        at = 0
        while at < len(doc):
            upto = at + 1
            while upto < len(doc) and begin[upto] + count[upto] - begin[at] <= 2 * per:
                upto += 1
            low = int(begin[at])
            part = self.data[low : int(begin[upto - 1] + count[upto - 1]) + LENGTH + 16]
            place, *rest = _anchors_of(part, begin[at:upto] - low, count[at:upto])
            place = place + low
            found.append((place, np.searchsorted(self.starts, place, "right") - 1, *rest))
            at = upto
        none = [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64)]
        self.place, self.doc, self.gram, self.low, self.high = (np.concatenate([n, *x]) for n, x in zip(none, zip(*found, strict=True), strict=True)) if found else none
        # Empty documents share a start with the next; the last of equal starts holds the bytes.
        self.grams, inverse = np.unique(self.gram, return_inverse=True)
        self.gram_of = inverse.reshape(-1)

    def shared(self) -> np.ndarray:
        """Which of grams occur in several of the run's documents (by id)."""
        ids = np.array([d if d is not None else 0 for d in self.docs], dtype=np.int64)[self.doc] if len(self.doc) else np.zeros(0, dtype=np.int64)
        least, most = np.full(len(self.grams), np.iinfo(np.int64).max), np.full(len(self.grams), np.iinfo(np.int64).min)
        np.minimum.at(least, self.gram_of, ids)
        np.maximum.at(most, self.gram_of, ids)
        return least < most

    def owner(self) -> np.ndarray:
        """One document id for each gram (its only one, where it is not shared)."""
        out = np.zeros(len(self.grams), dtype=np.int64)
        out[self.gram_of] = np.array([d if d is not None else 0 for d in self.docs], dtype=np.int64)[self.doc] if len(self.doc) else 0
        return out


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes, so a run's sorted hashes fall into them in order."""
    return ((grams >> np.uint64(HASH_BITS - 31)) * np.uint64(buckets) >> np.uint64(31)).astype(np.int64)


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _shuffled(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compresses sorted numbers' differences well."""
    return _squeeze(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _unshuffled(data: bytes, kind: str, n: int) -> np.ndarray:
    raw = np.frombuffer(_expand(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, n).T).view(kind).reshape(n)


_RUNS = "kind string, run long, bucket long, n long, a binary, b binary, c binary"
_RUN_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _RUN_TYPES, strict=True)], names=["kind", "run", "bucket", "n", "a", "b", "c"])


def _packed(docs: list, texts: list[bytes]) -> tuple[bytes, bytes, bytes]:
    ids = np.array([d if d is not None else 0 for d in docs], dtype=np.int64)
    known = np.array([d is not None for d in docs], dtype=np.uint8)
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    return _squeeze(ids.tobytes() + sizes.tobytes()), known.tobytes(), zstandard.ZstdCompressor(level=3).compress(b"".join(texts))


def _unpacked(n: int, a: bytes, b: bytes, c: bytes) -> Run:
    numbers = np.frombuffer(_expand(a), dtype=np.int64)
    known = np.frombuffer(b, dtype=np.uint8).tolist()
    raw, docs, ends = _expand(c) if c else b"", numbers[:n].tolist(), np.cumsum(numbers[n:]).tolist()
    return Run([d if k else None for d, k in zip(docs, known, strict=True)], [raw[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)])


def _scan(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        docs: list = []
        texts: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            whole = Run(docs, texts)
            rows = [("run", number, 0, len(docs), *_packed(docs, texts))]
            bucket, mark, owner = bucket_of(whole.grams, buckets), whole.shared(), whole.owner()
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            for k in range(buckets):
                s, e = edges[k], edges[k + 1]
                if e > s:
                    steps = np.diff(whole.grams[s:e], prepend=np.uint64(0))
                    rows.append(("grams", number, k, int(e - s), _shuffled(steps), np.packbits(mark[s:e]).tobytes(), _shuffled(owner[s:e])))
            return _rows(rows)

        for batch in slices(batches, "text", RUN_BYTES):
            size = batch.column(1).nbytes
            if docs and held + size > RUN_BYTES:
                yield close()
                number, docs, texts, held = number + 1, [], [], 0
            docs = docs + batch.column(0).to_pylist()
            texts = texts + [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            held += size
        if docs:
            yield close()

    return run


# Buckets: which grams two documents share.


def _answer(t: pa.Table) -> pa.Table:
    """For each run of a bucket, a bitmap over its grams: those that some other document has too."""
    rows = t.to_pylist()
    grams, marks, owners = [], [], []
    for r in rows:
        grams.append(np.cumsum(_unshuffled(r["a"], "<u8", r["n"])))
        marks.append(np.unpackbits(np.frombuffer(r["b"], dtype=np.uint8), count=r["n"]).astype(bool))
        owners.append(_unshuffled(r["c"], "<i8", r["n"]))
    every, mark, owner = np.concatenate(grams), np.concatenate(marks), np.concatenate(owners)
    order = np.lexsort((owner, every))
    same = every[order][1:] == every[order][:-1]
    group = np.concatenate([[0], np.cumsum(~same)])
    heads = np.concatenate([[0], np.flatnonzero(~same) + 1])
    tails = np.append(heads[1:], len(order)) - 1
    by = owner[order]
    twice = (by[heads] < by[tails]) | np.logical_or.reduceat(mark[order], heads)
    hit = np.empty(len(order), dtype=bool)
    hit[order] = twice[group]
    ends = np.cumsum([len(g) for g in grams])
    bits = [np.packbits(x).tobytes() for x in np.split(hit, ends[:-1])]
    return pa.table({"run": pa.array([r["run"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int64()), "n": pa.array([r["n"] for r in rows], pa.int64()), "bits": pa.array(bits, pa.binary())})


# Runs: sorted, front-coded entries.


class Entries:
    """A run's candidate anchors and their classes: equal right context, left context and offsets make one entry."""

    def __init__(self, run: Run, answers: list[dict]):
        flags = [np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8), count=r["n"]) for r in sorted(answers, key=lambda r: r["bucket"])]
        hit = np.concatenate([np.zeros(0, dtype=np.uint8), *flags]).astype(bool)
        self.anchors = np.flatnonzero(hit[run.gram_of]) if len(run.gram_of) else np.zeros(0, dtype=np.int64)
        place, low, high = run.place[self.anchors], run.low[self.anchors], run.high[self.anchors]
        ids = np.array([d if d is not None else 0 for d in run.docs], dtype=np.int64)
        self.ids = ids[run.doc[self.anchors]] if len(self.anchors) else np.zeros(0, dtype=np.int64)
        right_size, left_size = LENGTH - low, high
        right = _context(run.data, place, 1, right_size, 56)
        left = _context(run.data, place - 1, -1, left_size, 40)
        words = [right.view(">u8")[:, k] for k in range(7)] + [left.view(">u8")[:, k] for k in range(5)] + [low, high]
        order = np.lexsort([self.ids, *reversed(words)]) if len(place) else np.zeros(0, dtype=np.int64)
        differ = np.zeros(max(len(order) - 1, 0), dtype=bool)
        for w in words:
            differ |= w[order][1:] != w[order][:-1]
        self.class_of = np.empty(len(order), dtype=np.int64)
        self.class_of[order] = np.concatenate([[0], np.cumsum(differ)]) if len(order) else order
        first = order[np.concatenate([[True], differ])] if len(order) else order  # the smallest doc_id of each
        self.doc, self.low, self.high = self.ids[first], low[first], high[first]
        self.right, self.left, self.gram = right[first], left[first], run.gram[self.anchors][first]


def _context(data: np.ndarray, place: np.ndarray, step: int, sizes: np.ndarray, width: int) -> np.ndarray:
    """(n, width): bytes from place on by step, sizes[k] of them, then zeros."""
    out = np.zeros((len(place), width), dtype=np.uint8)
    for c in range(int(sizes.max(initial=0))):
        has = sizes > c
        out[has, c] = data[place[has] + step * c]
    return out


def front_code(rows: np.ndarray, sizes: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, list[bytes]]:
    """Prefix lengths shared with the row before, and for each stretch of rows (from starts on; default: all) the rest of its rows' bytes on end."""
    shared = np.zeros(len(rows), dtype=np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    shared = np.minimum(shared, sizes)
    edges = [0] if starts is None else starts.tolist()
    shared[[k for k in edges if k < len(rows)]] = 0
    column = np.arange(rows.shape[1])
    own = (column >= shared[:, None]) & (column < sizes[:, None])
    return shared, [rows[s:e][own[s:e]].tobytes() for s, e in zip(edges, [*edges[1:], len(rows)], strict=True)]


def front_decode(shared: np.ndarray, sizes: np.ndarray, rest: bytes, width: int) -> np.ndarray:
    """The rows of front_code, filled with zeros."""
    n = len(shared)
    out = np.zeros((n, width), dtype=np.uint8)
    column = np.arange(width)
    own = (column >= shared[:, None]) & (column < sizes[:, None])
    out[own] = np.frombuffer(rest, dtype=np.uint8)
    for c in range(int(sizes.max(initial=0))):
        source = np.maximum.accumulate(np.where(column[c] >= shared, np.arange(n), 0))
        filled = out[source, c]
        out[:, c] = np.where(c < sizes, filled, 0)
    return out


def _send(parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for r in left.to_pylist():
            e = Entries(_unpacked(r["n"], r["a"], r["b"], r["c"]), right.to_pylist())
            part = bucket_of(e.gram, parts)
            order = np.argsort(part, kind="stable")  # within a part they stay sorted
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            used = np.flatnonzero(np.diff(edges))
            starts = edges[used]
            right_shared, right_rest = front_code(e.right[order], LENGTH - e.low[order], starts)
            left_shared, left_rest = front_code(e.left[order], e.high[order], starts)
            small = np.stack([right_shared, left_shared, e.low[order], e.high[order]]).astype(np.uint8)
            docs = e.doc[order]
            for i, k in enumerate(used.tolist()):
                mine = slice(edges[k], edges[k + 1])
                out.append((k, r["run"], mine.stop - mine.start, _squeeze(small[:, mine].tobytes()), _squeeze(right_rest[i]), _squeeze(left_rest[i]), _shuffled(docs[mine])))
        names = ["part", "run", "n", "small", "rights", "lefts", "docs"]
        types = [pa.int64()] * 3 + [pa.binary()] * 4
        return pa.table({n: pa.array([x[i] for x in out], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})

    return run


# Parts: the merge.


def _first_difference(words: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a before b or equal, common prefix length) of rows a and b that agree in `known` bytes; words are read from there on."""
    n = words.shape[1]
    at = known >> 3
    length = np.full(len(a), 8 * n, dtype=np.int64)
    less = np.ones(len(a), dtype=bool)
    open_ = np.arange(len(a))
    while len(open_):
        open_ = open_[at[open_] < n]
        x, y = words[a[open_], at[open_]], words[b[open_], at[open_]]
        differ = x != y
        d = open_[differ]
        z = x[differ] ^ y[differ]
        byte = np.zeros(len(d), dtype=np.int64)
        for k in range(1, 8):
            byte += z < np.uint64(1 << (64 - 8 * k))
        length[d] = 8 * at[d] + byte
        less[d] = x[differ] < y[differ]
        open_ = open_[~differ]
        at[open_] += 1
    return less, length


def merge_runs(rows: np.ndarray, run_starts: np.ndarray, run_ends: np.ndarray, shared: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of all runs merged, and each one's prefix shared with the one before it.

    rows: (n, 8k) bytes, each run's sorted; shared: each row's prefix shared with the one before it in its run. Loser
    trees over all runs, one for each of `lanes` slices of the order, advance together.
    """
    n, runs = len(rows), len(run_starts)
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    if runs == 1 or not n:
        return np.arange(n), shared.copy()
    # A lane costs its trees' set-up over all runs, a step costs its calls however few lanes there are: balanced by both.
    lanes = max(1, min(lanes, n // 8 or 1, int((500 * n * runs.bit_length() / runs) ** 0.5)))
    # Splitters: every so-manieth row of a sample; a row's slice is settled by its own bytes, so equal rows stay together.
    sample = np.sort(_strings(rows[:: max(1, n // (lanes * 16))]))
    cuts = sample[(np.arange(1, lanes) * len(sample)) // lanes] if lanes > 1 else sample[:0]
    cursor = np.empty((lanes, runs), dtype=np.int64)
    limit = np.empty((lanes, runs), dtype=np.int64)
    for k in range(runs):
        edges = run_starts[k] + np.searchsorted(_strings(rows[run_starts[k] : run_ends[k]]), cuts, "left")
        cursor[:, k] = np.concatenate([[run_starts[k]], edges])
        limit[:, k] = np.concatenate([edges, [run_ends[k]]])
    size = 1 << (runs - 1).bit_length()
    lane = np.arange(lanes)
    if size > runs:
        pad = np.zeros((lanes, size - runs), dtype=np.int64)
        cursor, limit = np.concatenate([cursor, pad], axis=1), np.concatenate([limit, pad], axis=1)
    loser = np.zeros((lanes, size), dtype=np.int64)  # node 1 is the root; a node's children are 2k and 2k + 1
    known = np.zeros((lanes, size), dtype=np.int64)

    def play(a: np.ndarray, ha: np.ndarray, b: np.ndarray, hb: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, ...]:
        """(winner, its length, loser, its length); lengths are of the prefix shared with the lane's last output."""
        live_a, live_b = cursor[where, a] < limit[where, a], cursor[where, b] < limit[where, b]
        a_wins = np.where(live_a & live_b, ha > hb, live_a | ~live_b)
        lost = np.where(a_wins, hb, ha)
        tie = np.flatnonzero(live_a & live_b & (ha == hb))
        if len(tie):
            less, length = _first_difference(words, cursor[where[tie], a[tie]], cursor[where[tie], b[tie]], ha[tie])
            a_wins[tie] = less
            lost[tie] = length
        return np.where(a_wins, a, b), np.where(a_wins, ha, hb), np.where(a_wins, b, a), lost

    level = np.tile(np.arange(size), (lanes, 1))
    length = np.zeros((lanes, size), dtype=np.int64)
    while level.shape[1] > 1:  # the first round: nothing is known yet
        half = level.shape[1] // 2
        where = np.repeat(lane, half)
        w, hw, lo, hl = play(level[:, ::2].ravel(), length[:, ::2].ravel(), level[:, 1::2].ravel(), length[:, 1::2].ravel(), where)
        loser[:, half : 2 * half], known[:, half : 2 * half] = lo.reshape(lanes, half), hl.reshape(lanes, half)
        level, length = w.reshape(lanes, half), hw.reshape(lanes, half)
    winner, h = level[:, 0], length[:, 0]
    total = (limit - cursor).sum(axis=1)
    base = np.cumsum(total) - total
    order, prefix = np.empty(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    active, step = lane[total > 0], 0
    winner, h = winner[active], h[active]
    while len(active):
        row = cursor[active, winner]
        order[base[active] + step], prefix[base[active] + step] = row, h
        cursor[active, winner] += 1
        step += 1
        on = total[active] > step
        active, winner = active[on], winner[on]
        here = cursor[active, winner]
        h = np.where(here < limit[active, winner], shared[np.minimum(here, n - 1)], 0)
        node = (winner + size) >> 1
        for _ in range(size.bit_length() - 1):
            w, hw, lo, hl = play(winner, h, loser[active, node], known[active, node], active)
            loser[active, node], known[active, node] = lo, hl
            winner, h, node = w, hw, node >> 1
    for k in np.flatnonzero(total > 0)[1:].tolist():  # between slices
        i = base[k]
        if i:
            prefix[i] = _first_difference(words, order[i - 1 : i], order[i : i + 1], np.zeros(1, dtype=np.int64))[1][0]
    return order, prefix


def _strings(rows: np.ndarray) -> np.ndarray:
    """Rows as fixed-width strings that compare byte by byte (zeros at the end are their padding)."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").reshape(-1)


def window_masks(rows: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, order: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """For each entry, bit i is set if its window at offset i occurs in an entry with a smaller document id."""
    n = len(order)
    words = left.view(">u8").astype(np.uint64)
    by_left = np.lexsort([words[:, k] for k in range(words.shape[1] - 1, -1, -1)])
    left_prefix = np.zeros(n, dtype=np.int64)
    if n > 1:
        left_prefix[1:] = _first_difference(words, by_left[:-1], by_left[1:], np.zeros(n - 1, dtype=np.int64))[1]
    masks = np.zeros(n, dtype=np.int64)
    right_class, left_class = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for i in range(OFFSETS):
        has = np.flatnonzero((low <= i) & (i <= high))
        if len(has) < 2:
            continue
        right_class[order] = np.cumsum(prefix < LENGTH - i)
        left_class[by_left] = np.cumsum(left_prefix < i)
        key = right_class[has] << 32 | left_class[has]
        by = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
        least = np.minimum.reduceat(doc[has[by]], heads)
        group = np.repeat(least, np.diff(np.append(heads, len(by))))
        masks[has[by]] |= (group < doc[has[by]]).astype(np.int64) << i
    return masks


def _merge(t: pa.Table) -> pa.Table:
    """A part's masks, for each run in the order of its entries."""
    parts = sorted(t.to_pylist(), key=lambda r: r["run"])
    # A run's first row shares nothing with the one before, so all runs are decoded at once.
    small = np.concatenate([np.frombuffer(_expand(r["small"]), dtype=np.uint8).reshape(4, -1) for r in parts], axis=1).astype(np.int64)
    right_shared, left_shared, low, high = small
    rows = front_decode(right_shared, LENGTH - low, b"".join(_expand(r["rights"]) for r in parts), 56)
    left = front_decode(left_shared, high, b"".join(_expand(r["lefts"]) for r in parts), 40)
    docs = np.concatenate([_unshuffled(r["docs"], "<i8", r["n"]) for r in parts])
    sizes = np.array([r["n"] for r in parts], dtype=np.int64)
    ends = np.cumsum(sizes)
    # Rows are padded with zeros, so what two of them share can go past the shorter one's end: see it whole.
    whole = _padded_prefixes(rows, right_shared, ends - sizes)
    order, prefix = merge_runs(rows, ends - sizes, ends, whole)
    masks = window_masks(rows, left, low, high, docs, order, prefix)
    return pa.table({"run": pa.array([r["run"] for r in parts], pa.int64()), "part": pa.array([r["part"] for r in parts], pa.int64()), "n": pa.array(sizes, pa.int64()), "masks": pa.array([_shuffled(x) for x in np.split(masks, ends[:-1])], pa.binary())})


def _padded_prefixes(rows: np.ndarray, shared: np.ndarray, starts: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    out = np.zeros(len(rows), dtype=np.int64)
    inner = np.ones(len(rows), dtype=bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    out[at] = _first_difference(words, at - 1, at, shared[at].copy())[1]
    return out


# Runs again: the bytes go.

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removal(parts: int, texts: bool):
    def run(left: pa.Table, right: pa.Table, answers: pa.Table) -> Iterator[tuple]:
        for r in left.to_pylist():
            whole = _unpacked(r["n"], r["a"], r["b"], r["c"])
            e = Entries(whole, answers.to_pylist())
            masks = np.zeros(len(e.doc), dtype=np.int64)
            order = np.argsort(bucket_of(e.gram, parts), kind="stable")
            got = [_unshuffled(m["masks"], "<i8", m["n"]) for m in sorted(right.to_pylist(), key=lambda m: m["part"])]
            masks[order] = np.concatenate([np.zeros(0, dtype=np.int64), *got])
            low, high = whole.low[e.anchors], whole.high[e.anchors]
            everything = ((np.int64(1) << (high + 1)) - 1) & ~((np.int64(1) << low) - 1)
            mask = np.where(e.ids > e.doc[e.class_of], everything, masks[e.class_of]) if len(e.ids) else np.zeros(0, dtype=np.int64)
            change = np.zeros(len(whole.raw) + 1, dtype=np.int32)
            for i in range(OFFSETS):
                at = whole.place[e.anchors[(mask >> i) & 1 == 1]] - i
                change[at] += 1  # windows at one offset start at different places
                change[at + LENGTH] -= 1
            gone = np.cumsum(change[:-1]) > 0
            touched = np.concatenate([[0], np.cumsum(gone)])
            for doc, start, size in zip(whole.docs, whole.starts.tolist(), whole.sizes.tolist(), strict=True):
                raw = whole.raw[start : start + size]
                removed = int(touched[start + size] - touched[start])
                spans = 0
                if removed:
                    mine = gone[start : start + size]
                    spans = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum())
                    raw = np.frombuffer(raw, dtype=np.uint8)[~mine].tobytes()
                yield (doc, size, removed, spans, hashlib.sha256(raw).hexdigest(), *([raw] if texts else []))

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        masks = right.filter(pc.is_valid(right.column("masks")))
        answers = right.filter(pc.is_valid(right.column("bits")))
        rows = list(run(left, masks, answers))
        types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * texts
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        return pa.table({n: pa.array([x[i] for x in rows], t) for i, (n, t) in enumerate(zip(names, types, strict=False))})

    return joined


def remove_repeats(docs: DataFrame, keep: bool = False) -> DataFrame:
    """One row for each of documents(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep also kept, the bytes left.

    A byte goes if it lies in a LENGTH-byte string that also starts in a document with a smaller doc_id, judged on the
    input. A null text is empty. A row with a null doc_id is kept whole and makes no other lose anything; rows of one
    doc_id do not cost each other anything. Other columns are not read.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(parallelism(docs.sparkSession), -(-size // PART_BYTES))  # so a part is no larger at any size of the input
    scanned = durable(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan(parts), _RUNS))
    runs = scanned.where("kind = 'run'").select("run", "n", "a", "b", "c")
    grams = scanned.where("kind = 'grams'").select("run", "bucket", "n", "a", "b", "c")
    answers = durable(grams.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_answer, "run long, bucket long, n long, bits binary"))
    entries = runs.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(_send(parts), "part long, run long, n long, small binary, rights binary, lefts binary, docs binary")
    masks = entries.repartition(parts, "part").groupBy("part").applyInArrow(_merge, "run long, part long, n long, masks binary")
    back = masks.select("run", "part", "n", "masks", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("bits")).unionByName(
        answers.select("run", F.lit(None).cast("long").alias("part"), "n", F.lit(None).cast("binary").alias("masks"), "bucket", "bits")
    )
    return runs.groupBy("run").cogroup(back.groupBy("run")).applyInArrow(_removal(parts, keep), RESULT + ", kept binary" * keep)
