"""Operator 8: exact top-k inner products by pivot-table elimination.

With M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0), |q' - x'|^2 = |q|^2 + M^2 - 2 q.x: the largest
inner products are the smallest distances. Distances of all vectors to the pivots are computed once and kept with them.
For a query and a candidate the largest difference of their distances to one pivot bounds their distance from below, so
their score from above; candidates are evaluated in the order of these bounds until the next bound is under the k-th
score.

Candidates are dealt to the nearest of some centres, and each centre's to blocks of bounded size. A first block of its own
centre gives each query a threshold. The interval of a centre's distances to each pivot bounds all its candidates' scores
at once: a query goes only to centres whose bound reaches its threshold, and only those blocks' vectors are shipped to it.

Geometry is in floats, scaled by a power of two so that no component is over 1, with slack for rounding. Scores are exact:
in float64 while sums stay under 2^53, in int64 while they stay under 2^63, in whole numbers of any size beyond.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

PIVOTS = 24
CANDIDATES_AT_ONCE = 8192
QUERIES_AT_ONCE = 1024
#: Centres: one in so many rows, and no more than so many.
ROWS_A_CENTRE, CENTRES = 4096, 64
STEP = 512
SLACK = 1e-6
LONG = 1 << 63


class Space(NamedTuple):
    """What is known of all vectors: their size, the exponent that scales them under 1, a bound of their scaled squared norms, the kind of exact products."""

    size: int
    exponent: int
    top: float
    kind: str

    def matrix(self, vectors: list) -> np.ndarray:
        """Rows of components; shorter vectors are filled with zeros, which add nothing to a product."""
        out = np.zeros((len(vectors), self.size))
        for k, v in enumerate(vectors):
            out[k, : len(v)] = v
        return out

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """floor(256 x) over the power of two; components at which 256 x is no float any more are whole anyway."""
        with np.errstate(over="ignore"):
            whole = np.floor(256.0 * x)
        return np.where(np.isinf(whole), np.ldexp(x, 8 - self.exponent), np.ldexp(np.where(np.isinf(whole), 0, whole), -self.exponent))

    def lifted(self, scaled: np.ndarray, query: bool) -> np.ndarray:
        last = np.zeros(len(scaled)) if query else np.sqrt(np.maximum(self.top - (scaled**2).sum(axis=1), 0))
        return np.concatenate([scaled, last[:, None]], axis=1)

    def exact(self, x: np.ndarray) -> np.ndarray:
        """floor(256 x) in numbers whose products are exact."""
        if self.kind == "float":
            return np.floor(256.0 * x)
        if self.kind == "int":
            return np.floor(256.0 * x).astype(np.int64)
        return np.array([[math.floor(256.0 * c) if abs(c) < 2.0**52 else int(c) * 256 for c in row] for row in x.tolist()], dtype=object).reshape(x.shape)

    def ratio(self, score: int) -> float:
        """A score in scaled units."""
        return int(score) / (1 << 2 * self.exponent)


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(points)))
    for k, p in enumerate(points):
        out[:, k] = np.sqrt(((x - p) ** 2).sum(axis=1))
    return out


def _spread(points: np.ndarray, n: int) -> np.ndarray:
    """n of the points, each as far as can be from those before it."""
    chosen = [0] if len(points) else []
    far = _distances(points, points[:1])[:, 0] if len(points) else np.zeros(0)
    while len(chosen) < min(n, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


class _Block:
    """Rows of a group: keys, ids, components, scaled squared norms, distances to pivots."""

    def __init__(self, t: pa.Table, space: Space, far: str):
        read = lambda name, width: np.frombuffer(b"".join(t.column(name).to_pylist()), dtype=np.float64).reshape(t.num_rows, width)
        self.row, self.id = t.column("row").to_numpy(), t.column("vec_id").to_numpy()
        x = read("v", space.size)
        self.exact, self.norm = space.exact(x), (space.scaled(x) ** 2).sum(axis=1)
        self.far = read(far, -1) if t.num_rows else np.zeros((0, 0))


def _best(queries: _Block, at_least: list, candidates: _Block, space: Space, k: int) -> Iterator[tuple]:
    """(query's row and id, candidate's id, score clipped to a long, whether it is under a long) of each query's k best of a
    block with a score of at_least (None: any) or more, then one with its number of evaluated candidates."""
    for i in range(len(queries.row)):
        lower = np.zeros(len(candidates.row))
        for p in range(candidates.far.shape[1]):
            np.maximum(lower, np.abs(candidates.far[:, p] - queries.far[i, p]), out=lower)
        upper = (queries.norm[i] + space.top - lower**2) / 2 + SLACK * (1 + space.top)
        order = np.argsort(-upper, kind="stable")
        best: list[tuple[int, int, int]] = []
        limit = -math.inf if at_least[i] is None else space.ratio(at_least[i])
        evaluated = 0
        for at in range(0, len(order), STEP):
            if upper[order[at]] < limit:
                break
            part = order[at : at + STEP]
            part = part[candidates.row[part] != queries.row[i]]
            evaluated += len(part)
            scores = candidates.exact[part] @ queries.exact[i]
            if space.kind == "float":
                scores = scores.astype(np.int64)
            if space.kind != "whole" and len(part) > k:  # only the step's own best, ties included
                chosen = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                part, scores = part[chosen], scores[chosen]
            best = sorted([*best, *zip((-x for x in scores.tolist()), candidates.id[part].tolist(), candidates.row[part].tolist(), strict=True)])[:k]
            if len(best) == k:
                limit = max(limit, space.ratio(-best[-1][0]))
        for score, vec_id, _ in best:
            if at_least[i] is None or -score >= at_least[i]:
                if -score >= LONG:
                    raise OverflowError(f"the score {-score} of query {queries.id[i]} and vector {vec_id} is no long")
                yield int(queries.row[i]), int(queries.id[i]), vec_id, max(-score, -LONG), -score < -LONG, 0
        yield int(queries.row[i]), int(queries.id[i]), None, None, False, evaluated


_FOUND = "query_row long, query_id long, vec_id long, score long, under boolean, evaluated long"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]


def _table(rows: list[tuple]) -> pa.Table:
    names = [x.split()[0] for x in _FOUND.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, _TYPES, strict=True))})


def _measured(valid: DataFrame, space: Space, pivots: np.ndarray, centres: np.ndarray, every: int) -> DataFrame:
    """Each row's components, distances to the pivots as candidate (far) and, of queries, as query (near), and centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = space.matrix(batch.column(2).to_pylist())
                scaled = space.scaled(x)
                lifted = space.lifted(scaled, False)
                far, near = _distances(lifted, pivots), _distances(space.lifted(scaled, True), pivots)
                centre = pa.array(_distances(lifted, centres).argmin(axis=1).astype(np.int32))
                near = [r.tobytes() if i % every == 0 else None for r, i in zip(near, batch.column(1).to_pylist(), strict=True)]
                columns = [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in far], pa.binary()), pa.array(near, pa.binary()), centre]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "vec_id", "v", "far", "near", "centre"])

    return valid.mapInArrow(run, "row long, vec_id long, v binary, far binary, near binary, centre int")


def _intervals(measured: DataFrame, n_pivots: int, n_centres: int) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """By centre: least and largest distances to each pivot, how many rows, how many queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.float64).reshape(batch.num_rows, n_pivots)
            of, query = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            rows = [(c, p, far[of == c, p].min(), far[of == c, p].max(), int((of == c).sum()), int(query[of == c].sum())) for c in np.unique(of).tolist() for p in range(n_pivots)]
            types = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["centre", "pivot", "low", "high", "n", "queries"])

    part = measured.select("far", "centre", F.col("near").isNotNull().alias("query")).mapInArrow(run, "centre int, pivot int, low double, high double, n long, queries long")
    low, high, rows, queries = np.full((n_centres, n_pivots), np.inf), np.full((n_centres, n_pivots), -np.inf), [0] * n_centres, [0] * n_centres
    for r in part.groupBy("centre", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("queries").alias("queries")).collect():
        low[r["centre"], r["pivot"]], high[r["centre"], r["pivot"]] = r["low"], r["high"]
        rows[r["centre"]], queries[r["centre"]] = r["n"], r["queries"]
    return low, high, rows, queries


def _packed(queries: list[int], groups: list[int]) -> list[int]:
    """By centre, the number of the first team its queries are in: a team is a part of a large centre's, or several small centres'."""
    out, teams, held = [0] * len(queries), 0, QUERIES_AT_ONCE
    for c, n in enumerate(queries):
        if groups[c] > 1:
            out[c], teams, held = teams, teams + groups[c], QUERIES_AT_ONCE
            continue
        if held + n > QUERIES_AT_ONCE:
            teams, held = teams + 1, 0
        out[c], held = teams - 1, held + n
    return out


def exact_top_k(embeddings: DataFrame, every: int = 50, k: int = 5, pivots: int = PIVOTS, report: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id is divisible by every, the k largest inner products with other rows.

    Ties go to the smaller vec_id. Rows with a null vec_id, and vectors that are null or hold null or non-finite
    components, take no part; vectors of unlike length are compared as if filled with zeros. Rows of one vec_id are
    candidates each, for each other too, and each is a query of its own. Fewer than k others give fewer ranks; no rows
    give none. All finite components take part; a score among the k best that no long holds raises OverflowError (one
    under the least long an error of the same words). With report: query_id and n_evaluated instead, the number of
    candidates whose product with the query was computed.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = embeddings.where(F.col("vec_id").isNotNull() & finite).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    largest = F.array_max(F.transform("v", F.abs))
    norm = largest * F.sqrt(F.aggregate(F.transform("v", lambda x: F.pow(F.try_divide(x, largest), F.lit(2))), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))))
    found = valid.agg(F.count(F.lit(1)), F.max(largest), F.max(norm), F.max(F.size("v"))).first()
    n, big, longest, size = found[0], found[1] or 0.0, found[2] or 0.0, found[3] or 0
    exponent = max(0, math.frexp(big)[1] + 9)
    products = size * ((int(big) + 1) * 256) ** 2
    top = min(float(size), (math.ldexp(longest, 8 - exponent) + math.ldexp(math.sqrt(size), -exponent)) ** 2) * (1 + 1e-9)
    space = Space(size, exponent, top, "float" if products < 1 << 53 else "int" if products < LONG else "whole")
    n_centres = max(1, min(CENTRES, n // ROWS_A_CENTRE))
    sample = [r["v"] for r in valid.orderBy(F.xxhash64("vec_id"), "row").limit(4 * (pivots + n_centres)).collect()]
    points = space.lifted(space.scaled(space.matrix(sample)), False)
    pivot_points, centres = _spread(points, pivots), points[:n_centres] if len(points) else np.zeros((1, size + 1))
    measured = durable(_measured(valid, space, pivot_points, centres, every))
    low, high, rows, queries = _intervals(measured, len(pivot_points), n_centres)

    blocks = [-(-x // CANDIDATES_AT_ONCE) or 1 for x in rows]
    groups = [-(-x // QUERIES_AT_ONCE) or 1 for x in queries]
    by_centre = lambda values, centre: F.element_at(F.array(*map(F.lit, values)), F.col(centre) + 1)
    bases = _packed(queries, groups)
    dealt = lambda of, salt: F.pmod(F.xxhash64("row", F.lit(salt)), of).cast("int")
    candidates = measured.select("row", "vec_id", "v", "far", "centre", dealt(by_centre(blocks, "centre"), 0).alias("block"))
    asking = measured.where("near is not null").select("row", "vec_id", "v", "near", F.col("centre").alias("home"), dealt(by_centre(groups, "centre"), 1).alias("part")).withColumn("team", by_centre(bases, "home") + F.col("part"))

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        ask = _Block(left, space, "near")
        got = _best(ask, [None] * left.num_rows, _Block(right, space, "far"), space, k) if left.num_rows and right.num_rows else ()
        by: dict[int, list[int]] = {}
        for r in got:
            if r[3] is not None:
                by.setdefault(r[0], []).append(r[3])
        rows = [(row, min(x)) for row, x in by.items() if len(x) == k]
        return pa.table({"row": pa.array([r[0] for r in rows], pa.int64()), "at_least": pa.array([r[1] for r in rows], pa.int64())})

    own = candidates.where("block = 0").withColumn("home", F.col("centre")).withColumn("part", F.explode(F.sequence(F.lit(0), by_centre(groups, "centre") - 1)))
    thresholds = asking.groupBy("home", "part").cogroup(own.groupBy("home", "part")).applyInArrow(first, "row long, at_least long")

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The centres that may hold one of a query's best."""
        for batch in batches:
            at = batch.schema.get_field_index
            near = np.frombuffer(b"".join(batch.column(at("near")).to_pylist()), dtype=np.float64).reshape(batch.num_rows, -1)
            x = np.frombuffer(b"".join(batch.column(at("v")).to_pylist()), dtype=np.float64).reshape(batch.num_rows, size)
            limit = np.array([-math.inf if t is None else space.ratio(t) for t in batch.column(at("at_least")).to_pylist()])
            norm = (space.scaled(x) ** 2).sum(axis=1)
            go = []
            for c in range(n_centres):
                lower = np.maximum(np.maximum(low[c] - near, near - high[c]), 0).max(axis=1, initial=0)
                go.append((norm + top - lower**2) / 2 + SLACK * (1 + top) >= limit if rows[c] else np.zeros(len(norm), dtype=bool))
            query, centre = np.nonzero(np.stack(go, axis=1))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(query)) for k in range(batch.num_columns)), pa.array(centre.astype(np.int32))], names=[*batch.schema.names, "centre"])

    known = asking.join(thresholds, "row", "left").select("row", "vec_id", "v", "near", "team", "at_least")
    wanted = "row long, vec_id long, v binary, near binary, team int, at_least long, centre int"
    each_block = F.explode(F.sequence(F.lit(0), by_centre(blocks, "centre") - 1)).alias("block")
    going = durable(known.mapInArrow(visits, wanted))
    pairs = going.select("centre", "team").distinct().select(*(F.col(c).alias(f"to_{c}") for c in ("centre", "team")), each_block.alias("to_block"))
    sent = candidates.join(pairs, (F.col("centre") == F.col("to_centre")) & (F.col("block") == F.col("to_block"))).select("row", "vec_id", "v", "far", "to_centre", "to_block", "to_team")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([])
        return _table(list(_best(_Block(left, space, "near"), left.column("at_least").to_pylist(), _Block(right, space, "far"), space, k)))

    key = ["centre", "block", "team"]
    scored = going.select("*", each_block).groupBy(*key).cogroup(sent.groupBy(*(f"to_{c}" for c in key))).applyInArrow(search, _FOUND)
    if report:
        return scored.groupBy("query_row", "query_id").agg(F.sum("evaluated").alias("n_evaluated")).drop("query_row")
    ranked = scored.where("vec_id is not null").withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")))
    score = F.when(F.col("under"), F.raise_error(F.lit("OverflowError: a score among the best is no long"))).otherwise(F.col("score")).cast("long")
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", score.alias("score"))


#: DuckDB SQL for exact_top_k over the embeddings table with the default parameters.
ORACLE = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
