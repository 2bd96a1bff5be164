"""Fitted models as single objects: scores, intervals, certified decisions, bounds over boxes, reasons, recourse, records.

A model is a few lists of trees and numbers on the driver. Everything that touches rows is a DataFrame; what concerns one row
(a reason, a record) takes a dict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import wilson_lower
from tidemark.operators import boost, metrics, predicates, proofs
from tidemark.operators.predicates import tree_column
from tidemark.sources import readers

#: Least rows of a region with a bound of its own, z of that bound, share of rows held for calibration.
REGION_ROWS, BOUND_Z, CALIBRATED = 20, 1.64, 5


def _numbered(tree: tuple, start: int = 0) -> tuple[tuple, int]:
    """The tree with leaves numbered from start as their values, and the next number."""
    if tree[0] == "leaf":
        return ("leaf", float(start)), start + 1
    left, after = _numbered(tree[3], start)
    right, end = _numbered(tree[4], after)
    return (*tree[:3], left, right), end


class Additive:
    """What a regressor and a binary classifier share; scores are base + rate * sum of tree values."""

    objective = "regression"

    def __init__(self, features: list[str], alpha: float = 0.1, **options):
        self.features, self.alpha, self.options = list(features), alpha, options
        self.model: boost.Boosted | None = None

    @property
    def trees(self) -> list[tuple]:
        return [stage[0] for stage in self.model.trees]

    def _calibration(self, df: DataFrame, calibrate: Column | None) -> Column:
        """Marks rows held for calibration: by a hash of the features unless told."""
        return F.pmod(F.xxhash64(*self.features), F.lit(CALIBRATED)) == 0 if calibrate is None else calibrate

    def _fit(self, df: DataFrame, target: str, held: Column) -> None:
        self.model = boost.fit(df.where(~held), self.features, target, self.objective, **self.options)
        spread = df.agg(*(F.stddev_pop(F.col(c).cast("double")).alias(c) for c in self.features)).first()
        self.scales = {c: spread[c] or 1.0 for c in self.features}

    def score(self) -> Column:
        return self.model.scores()[0]

    def bounds(self, boxes: DataFrame) -> DataFrame:
        """id, lower, upper of the score over boxes (id, <feature>_from < x <= <feature>_to)."""
        regions = predicates.region_frame(boxes.sparkSession, self.trees, self.features)
        return predicates.box_bounds(boxes, regions, self.features, self.model.bases[0], self.model.rate)

    def stability(self, df: DataFrame, row_id: str) -> DataFrame:
        """The box around each row in which no tree changes its leaf."""
        return predicates.stability_boxes(df, row_id, predicates.region_frame(df.sparkSession, self.trees, self.features), self.features)

    def recourse(self, df: DataFrame, row_id: str, goal: float) -> DataFrame:
        """The cheapest move of one feature, in standard deviations, that lifts a row's score to goal."""
        return predicates.recourse(df, row_id, self.trees, self.features, self.scales, self.model.bases[0], self.model.rate, goal)

    def reason(self, row: dict, goal: float) -> str:
        """Conditions that alone keep the row's score on its side of goal, in words."""
        return proofs.words(proofs.sufficient_reason(self.trees, self.model.bases[0], self.model.rate, row, goal))

    def proof(self, row: dict) -> dict:
        """A record of the row's score that can be checked without this object."""
        return proofs.artifact(self.trees, self.model.bases[0], self.model.rate, row)

    def verify(self, record: dict) -> bool:
        """Whether a record is whole and of this very model."""
        return proofs.check(record, self.trees, base=self.model.bases[0], rate=self.model.rate)

    def save(self, spark: SparkSession, path: str) -> None:
        """Plain numbers, no code."""
        kept = {k: v for k, v in vars(self).items() if k not in ("model", "options", "sigma", "regions")}
        readers.save_model(spark, path, type(self).__name__, {"own": kept, "model": _plain(self.model), "sigma": _plain(getattr(self, "sigma", None)), "regions": getattr(self, "regions", None)})

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        """The object of save; fails on another kind."""
        found = readers.load_model(spark, path, cls.__name__)
        out = cls(found["own"]["features"])
        vars(out).update(found["own"])
        out.model = _boosted(found["model"])
        if found["sigma"]:
            out.sigma = _boosted(found["sigma"])
        if found["regions"]:
            out.regions = _tuples(found["regions"])
        return out


def _plain(model: boost.Boosted | None) -> dict | None:
    return None if model is None else {"objective": model.objective, "features": model.features, "bases": model.bases, "rate": model.rate, "trees": model.trees}


def _tuples(tree) -> tuple:
    return ("leaf", tree[1]) if tree[0] == "leaf" else (*tree[:3], _tuples(tree[3]), _tuples(tree[4]))


def _boosted(kept: dict) -> boost.Boosted:
    return boost.Boosted(kept["objective"], kept["features"], kept["bases"], kept["rate"], [[_tuples(t) for t in stage] for stage in kept["trees"]])


class Regressor(Additive):
    """Boosted regression with intervals that hold 1 - alpha of exchangeable new rows, wider where residuals are larger."""

    def fit(self, df: DataFrame, target: str, calibrate: Column | None = None) -> Regressor:
        held = self._calibration(df, calibrate)
        known = df.where(F.col(target).isNotNull())
        self._fit(known, target, held)
        missed = self.model.predict(known).withColumn("__missed", F.abs(F.col(target) - F.col("prediction")))
        self.sigma = boost.fit(missed.where(~held), self.features, "__missed", rounds=10, depth=2)
        self.floor = max(1e-3 * (known.agg(F.stddev_pop(target)).first()[0] or 0.0), 1e-9)
        scored = missed.where(held).select((F.col("__missed") / self._width()).alias("score"))
        self.quantile = metrics.conformal_quantile(scored, "score", self.alpha, F.floor(F.log1p("score") * 64)).first()["q"] or 0.0
        return self

    def _width(self) -> Column:
        return F.greatest(self.sigma.scores()[0], F.lit(self.floor))

    def predict(self, df: DataFrame) -> DataFrame:
        """df with prediction."""
        return self.model.predict(df)

    def interval(self, df: DataFrame) -> DataFrame:
        """df with prediction, lower and upper."""
        half = self.quantile * self._width()
        return self.predict(df).withColumns({"lower": F.col("prediction") - half, "upper": F.col("prediction") + half})


class Classifier(Additive):
    """Boosted binary classification (target 0 or 1) with a lower bound of precision by region and sets of plausible labels."""

    objective = "binary"

    def fit(self, df: DataFrame, target: str, calibrate: Column | None = None) -> Classifier:
        held = self._calibration(df, calibrate)
        known = df.where(F.col(target).isNotNull())
        self._fit(known, target, held)
        judged = self.predict(known.where(held)).withColumn("__right", (F.col("label") == F.col(target)).cast("double"))
        # One half of the held rows shapes the regions, the other is counted in them.
        shaping = F.pmod(F.xxhash64(*self.features, F.lit(7)), F.lit(2)) == 0
        tree = boost.fit(judged.where(shaping), self.features, "__right", rounds=1, rate=1.0, depth=5, least=60)
        self.regions = _numbered(tree.trees[0][0])[0] if tree.trees else ("leaf", 0.0)
        counted = judged.where(~shaping).groupBy(tree_column(self.regions).cast("int").alias("region")).agg(F.sum("__right").alias("k"), F.count(F.lit(1)).alias("n"))
        rows = counted.select("region", "k", "n", wilson_lower(F.col("k"), F.col("n"), BOUND_Z).alias("low")).collect()  # a row a leaf
        k, n = sum(r["k"] for r in rows), sum(r["n"] for r in rows)
        whole = df.sparkSession.createDataFrame([(float(k), max(n, 1))], "k double, n long").select(wilson_lower(F.col("k"), F.col("n"), BOUND_Z)).first()[0]
        self.lows = {str(r["region"]): r["low"] for r in rows if r["n"] >= REGION_ROWS}
        self.low = max(whole, 0.0) if n else 0.0
        wrong = judged.select((1 - F.when(F.col(target) == 1, F.col("probability_1")).otherwise(F.col("probability_0"))).alias("score"))
        self.quantile = metrics.conformal_quantile(wrong, "score", self.alpha, F.floor(F.col("score") * 256)).first()["q"]
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """df with probability_1, probability_0 and label."""
        return self.model.predict(df).withColumn("label", (F.col("probability_1") > 0.5).cast("int"))

    def certify(self, df: DataFrame) -> DataFrame:
        """df with probabilities, label, precision_low (the bound of the row's region, or of all) and labels, the plausible ones."""
        region = tree_column(self.regions).cast("int").cast("string")
        low = F.coalesce(*(F.when(region == r, F.lit(v)) for r, v in sorted(self.lows.items())), F.lit(self.low))
        limit = F.lit(1.0 if self.quantile is None else self.quantile)
        labels = F.array_compact(F.array(*(F.when(1 - F.col(f"probability_{k}") <= limit, F.lit(k)) for k in (0, 1))))
        return self.predict(df).withColumns({"precision_low": low, "labels": labels})


class MultiOutput:
    """One classifier a label; a row's prediction is its set of labels."""

    def __init__(self, features: list[str], alpha: float = 0.1, **options):
        self.features, self.alpha, self.options = features, alpha, options

    def fit(self, df: DataFrame, labels: list[str], calibrate: Column | None = None) -> MultiOutput:
        self.models = {c: Classifier(self.features, self.alpha, **self.options).fit(df, c, calibrate) for c in labels}
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """df with labels: the names whose probability is over one half, sorted."""
        chosen = [F.when(m.score() > 0, F.lit(c)) for c, m in sorted(self.models.items())]
        return df.withColumn("labels", F.array_compact(F.array(*chosen)))
