"""Elo ratings: sequential by nature, so one task per league."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def elo_snapshots(games: DataFrame, league: str, edition: str, at: str, a: str, b: str, result: str, k: float = 32.0, start: float = 1500.0) -> DataFrame:
    """league, edition, player, rating: each player's rating before an edition they play in.

    Games of a league are replayed in order of (edition, at, a, b), streamed through one task; result is a's score
    (1, 0.5 or 0). Memory is one number a player of the league.
    """

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now_league = now_edition = None
        ratings: dict[int, float] = {}
        before: dict[int, float] = {}

        def out() -> pa.RecordBatch:
            n = len(before)
            return pa.RecordBatch.from_arrays([pa.array([now_league] * n, pa.string()), pa.array([now_edition] * n, pa.int64()), pa.array(list(before), pa.int64()), pa.array(list(before.values()), pa.float64())], names=["league", "edition", "player", "rating"])

        for batch in batches:
            for lg, ed, pa_, pb, score in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (lg, ed) != (now_league, now_edition):
                    if before:
                        yield out()
                    if lg != now_league:
                        ratings = {}
                    now_league, now_edition, before = lg, ed, {}
                ra, rb = ratings.get(pa_, start), ratings.get(pb, start)
                before.setdefault(pa_, ra)
                before.setdefault(pb, rb)
                change = k * (score - 1 / (1 + 10 ** ((rb - ra) / 400)))
                ratings[pa_], ratings[pb] = ra + change, rb - change
        if before:
            yield out()

    ordered = games.repartition(league).sortWithinPartitions(league, edition, at, a, b).select(F.col(league).alias("league"), F.col(edition).alias("edition"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(result).alias("result"))
    return ordered.mapInArrow(replay, "league string, edition long, player long, rating double")
