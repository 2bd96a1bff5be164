"""A fitted column compiler: roles and parameters from one table, applied to others without looking at them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import encode as E

MOST_LEVELS = 20


@dataclass
class Preprocessor:
    """Numeric columns are imputed and flagged, times unfolded, categories of up to MOST_LEVELS levels one-hot, others by frequency."""

    columns: list[str] = field(default_factory=list)
    numeric: dict[str, float] = field(default_factory=dict)
    flagged: list[str] = field(default_factory=list)
    times: dict[str, int] = field(default_factory=dict)
    hot: dict[str, list[str]] = field(default_factory=dict)
    frequency: dict[str, DataFrame] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: list[str]) -> Preprocessor:
        """Roles by type; parameters by aggregates. Flags only where the table has missing values."""
        self.columns = columns
        kinds = {f.name: f.dataType for f in df.schema}
        numeric = [c for c in columns if isinstance(kinds[c], (T.NumericType, T.BooleanType))]
        times = [c for c in columns if isinstance(kinds[c], (T.TimestampType, T.TimestampNTZType, T.DateType))]
        self.numeric = E.medians(df, numeric) if numeric else {}
        if numeric:
            missing = df.agg(*(F.max(E.finite(F.col(c)).isNull()).alias(c) for c in numeric)).first()
            self.flagged = [c for c in numeric if missing[c]]
        self.times = {c: E.datetime_origin(df, c) for c in times}
        for c in columns:
            if c not in numeric and c not in times:
                try:
                    self.hot[c] = E.levels(df, c, MOST_LEVELS)
                except ValueError:
                    self.frequency[c] = E.frequencies(df, c)
        return self

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep and the features; fails on missing columns. Unseen levels have no indicator and frequency 0."""
        if missing := [c for c in [*keep, *self.columns] if c not in df.columns]:
            raise ValueError(f"missing columns: {missing}")
        out = df.select(*dict.fromkeys([*keep, *self.columns]))
        if self.numeric:
            plain = [f"{c}__isna" for c in self.numeric if c not in self.flagged]
            out = E.impute(out, list(self.numeric), self.numeric).drop(*plain)
        for c, origin in self.times.items():
            out = E.datetime_features(out, c, origin)
        for c, fitted in self.hot.items():
            out = E.one_hot(out, c, fitted)
        for c, shares in self.frequency.items():
            out = E.lookup(out, c, shares, "share", 0.0, f"{c}__freq")
        return out.drop(*(c for c in [*self.times, *self.hot, *self.frequency] if c not in keep))
