"""Replayable predicates, interval and category algebra, regions and trees as tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Predicate:
    """A frozen program over columns.

    kind: state (two bits equal value), or, xor, count (exactly value of the bits), and (literals), dnf (branches of
    literals, or-ed), exception (the first branch and none of the others), threshold_and, threshold_or, interval
    (low < x <= high), union (or of intervals). A literal of bits is (column, wanted); of thresholds (column, op, value)
    with op <= or >; of an interval (column, low, high), with None for no bound.
    """

    kind: str
    columns: tuple[str, ...] = ()
    value: int = 0
    branches: tuple[tuple[tuple, ...], ...] = ()


def _bit(column: str, wanted: int = 1) -> Column:
    return F.col(column) == wanted


def _threshold(column: str, op: str, value: float) -> Column:
    return F.col(column) <= value if op == "<=" else F.col(column) > value


def interval(column: str, low: float | None, high: float | None) -> Column:
    """low < x <= high."""
    parts = ([F.col(column) > low] if low is not None else []) + ([F.col(column) <= high] if high is not None else [])
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def compiled(p: Predicate) -> Column:
    """The predicate as a column expression."""
    bits = [F.col(c) for c in p.columns]
    if p.kind == "state":
        return 2 * bits[0] + bits[1] == p.value
    if p.kind == "or":
        return _any([_bit(c) for c in p.columns])
    if p.kind == "xor":
        return bits[0] != bits[1]
    if p.kind == "count":
        return reduce(lambda a, b: a + b, bits) == p.value
    if p.kind in ("and", "dnf", "exception"):
        branches = [_all([_bit(*x) for x in b]) for b in p.branches]
        return branches[0] & ~_any(branches[1:]) if p.kind == "exception" else _any(branches)
    if p.kind in ("threshold_and", "threshold_or"):
        literals = [_threshold(*x) for x in p.branches[0]]
        return _all(literals) if p.kind == "threshold_and" else _any(literals)
    if p.kind in ("interval", "union"):
        return _any([_all([interval(*x) for x in b]) for b in p.branches])
    raise ValueError(f"unknown kind {p.kind}")


def described(p: Predicate) -> str:
    """The predicate in words."""
    bit = lambda x: x[0] if x[1] else f"NOT {x[0]}"
    span = lambda x: f"{x[0]} in ({'-inf' if x[1] is None else x[1]}, {'inf' if x[2] is None else x[2]}]"
    joined = lambda b, f: " AND ".join(f(x) for x in b)
    if p.kind == "state":
        return f"{p.columns[0]}={p.value >> 1} AND {p.columns[1]}={p.value & 1}"
    if p.kind == "or":
        return " OR ".join(p.columns)
    if p.kind == "xor":
        return f"{p.columns[0]} XOR {p.columns[1]}"
    if p.kind == "count":
        return f"exactly {p.value} of {', '.join(p.columns)}"
    if p.kind == "exception":
        return f"({joined(p.branches[0], bit)}) AND NOT ({' OR '.join(joined(b, bit) for b in p.branches[1:])})"
    if p.kind in ("and", "dnf"):
        return " OR ".join(f"({joined(b, bit)})" for b in p.branches)
    if p.kind in ("threshold_and", "threshold_or"):
        return (" AND " if p.kind == "threshold_and" else " OR ").join(f"{c} {op} {v}" for c, op, v in p.branches[0])
    return " OR ".join(f"({joined(b, span)})" for b in p.branches)


def append(df: DataFrame, programs: dict[str, Predicate]) -> DataFrame:
    """df with each program's outcome as 0/1, in one projection."""
    return df.withColumns({n: compiled(p).cast("int") for n, p in programs.items()})


def merged_intervals(df: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """keys, low, high: each key's (low, high] intervals as their canonical union: sorted, empty ones gone, touching ones joined."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    full = df.where(F.col(low) < F.col(high))
    before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    started = full.withColumn("__new", F.coalesce((F.col(low) > before).cast("int"), F.lit(1)))
    island = started.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "__island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("__island")


def conjunctions(literals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, feature, lo, hi: repeated bounds of a region (keys, feature, lo, hi) collapsed; a region with an empty one goes whole."""
    per = literals.groupBy(*keys, "feature").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    empty = (F.col("lo").isNotNull() & F.col("hi").isNotNull() & (F.col("lo") >= F.col("hi"))).cast("int")
    return per.withColumn("__empty", F.max(empty).over(Window.partitionBy(*keys))).where("__empty = 0").drop("__empty")


Tree = tuple  # ("node", column, threshold, left, right), ("cat", column, levels, left, right) or ("leaf", value)


def tree_column(tree: Tree) -> Column:
    """The tree's value as nested CASE: left if x <= threshold, or x among the levels."""
    if tree[0] == "leaf":
        return F.lit(float(tree[1]))
    _, column, at, left, right = tree
    test = F.col(column).isin(list(at)) if tree[0] == "cat" else F.col(column) <= at
    return F.when(test, tree_column(left)).otherwise(tree_column(right))


def tree_regions(tree: Tree, number: int = 0, bounds: dict | None = None) -> list[dict]:
    """The tree's leaves as rows: tree, leaf, value and bounds {column: (lo, hi]}."""
    out: list[dict] = []

    def walk(t: Tree, b: dict) -> None:
        if t[0] == "leaf":
            out.append({"tree": number, "leaf": len(out), "value": float(t[1]), "bounds": b})
            return
        _, c, at, left, right = t
        lo, hi = b.get(c, (None, None))
        walk(left, b | {c: (lo, at if hi is None else min(hi, at))})
        walk(right, b | {c: (at if lo is None else max(lo, at), hi)})

    walk(tree, bounds or {})
    return out


def region_frame(spark, trees: list[Tree], columns: list[str]) -> DataFrame:
    """All leaves of numeric trees as a table: tree, leaf, value, and <column>_lo, <column>_hi, open bounds infinite."""
    inf = float("inf")
    rows = []
    for k, t in enumerate(trees):
        for r in tree_regions(t, k):
            b = [(-inf if (x := r["bounds"].get(c, (None, None)))[0] is None else float(x[0]), inf if x[1] is None else float(x[1])) for c in columns]
            rows.append((r["tree"], r["leaf"], r["value"], *(v for pair in b for v in pair)))
    return spark.createDataFrame(rows, "tree int, leaf int, value double, " + ", ".join(f"{c}_lo double, {c}_hi double" for c in columns))


def region_join(df: DataFrame, regions: DataFrame, columns: list[str]) -> DataFrame:
    """df's rows with the one leaf of each tree they fall in. regions has one row a leaf, made from the driver's trees."""
    inside = reduce(lambda a, b: a & b, [(F.col(c) > F.col(f"{c}_lo")) & (F.col(c) <= F.col(f"{c}_hi")) for c in columns])
    return df.join(F.broadcast(regions), inside)


def additive_score(trees: list[Tree], base: float, rate: float) -> Column:
    """base + rate * sum of the trees' values."""
    return base + rate * reduce(lambda a, b: a + b, [tree_column(t) for t in trees])


def box_bounds(boxes: DataFrame, regions: DataFrame, columns: list[str], base: float, rate: float) -> DataFrame:
    """id, lower, upper: bounds of the additive score over a box (id, <column>_from < x <= <column>_to), exact for each tree."""
    overlap = reduce(lambda a, b: a & b, [(F.greatest(f"{c}_lo", f"{c}_from") < F.least(f"{c}_hi", f"{c}_to")) for c in columns])
    per = boxes.join(F.broadcast(regions), overlap).groupBy("id", "tree").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    return per.groupBy("id").agg((base + rate * F.sum("a")).alias("lower"), (base + rate * F.sum("b")).alias("upper"))


def stability_boxes(df: DataFrame, row_id: str, regions: DataFrame, columns: list[str]) -> DataFrame:
    """row_id and <column>_lo, <column>_hi: the box around each row in which no tree changes its leaf."""
    hit = region_join(df, regions, columns)
    return hit.groupBy(row_id).agg(*(f(F.col(f"{c}_{side}")).alias(f"{c}_{side}") for c in columns for side, f in (("lo", F.max), ("hi", F.min))))


def recourse(df: DataFrame, row_id: str, trees: list[Tree], columns: list[str], scales: dict[str, float], base: float, rate: float, goal: float) -> DataFrame:
    """row_id, column, to, cost, score: the cheapest single-column move to just beyond a threshold that lifts the score to goal.

    A move is to a threshold (if that is below x) or next above it; cost is the distance over the column's scale.
    """
    cuts: dict[str, set[float]] = {c: set() for c in columns}
    for t in trees:
        for r in tree_regions(t):
            for c, (lo, hi) in r["bounds"].items():
                cuts[c].update(v for v in (lo, hi) if v is not None)
    moves = [(c, v + s) for c in columns for v in sorted(cuts[c]) for s in (0.0, 1e-6)]
    options = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(v).alias("to")) for c, v in moves)))
    long = df.select(row_id, *columns, additive_score(trees, base, rate).alias("__now"), options.alias("m")).where(F.col("__now") < goal).select(row_id, *columns, "m.*")
    cost = reduce(lambda a, b: a + b, [F.when(F.col("column") == c, F.abs(F.col("to") - F.col(c)) / scales[c]).otherwise(F.lit(0.0)) for c in columns])
    moved = long.withColumn("cost", cost).withColumns({c: F.when(F.col("column") == c, F.col("to")).otherwise(F.col(c)) for c in columns})
    good = moved.withColumn("score", additive_score(trees, base, rate)).where(F.col("score") >= goal)
    best = good.groupBy(row_id).agg(F.min_by(F.struct("column", "to", "cost", "score"), F.struct(F.round("cost", 9), "column", "to")).alias("b"))
    return best.select(row_id, "b.*")
