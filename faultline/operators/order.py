"""Outputs whose order is part of the result, as position columns.

A position stays right whatever task a row is in; rows that tie in the stated order keep the order
of their place in the source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import expr as X
from ..model import BUCKETS, HEALTH
from ..scale import number_rows
from . import impact as I


def impacted(verdicts: DataFrame) -> DataFrame:
    """Confident breaks and degrades of each change: severity, then runs, then place in the log."""
    return number_rows(I.impacted(verdicts), ["change_id"], [*I.impacted_order(), F.col("query_id")], "position")


def ledger(rows: DataFrame) -> DataFrame:
    """Sweep rows: worst bucket first, then catalog and place."""
    return number_rows(rows, [], [X.rank_in("bucket", BUCKETS), F.col("catalog"), F.col("place")], "position")


def leaderboard(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """Assets by health, worst first, equal ones in the order they came in."""
    return number_rows(rows, [], [X.rank_in("status", HEALTH), F.col(pos), F.col("urn")], "position")


def transitions(rows: DataFrame) -> DataFrame:
    """Verdict moves of each change: regressions first, then by consumer."""
    return number_rows(rows, ["change_id"], [F.desc("regressed"), F.col("consumer"), F.col("query_id")], "position")


def by_psi(drift: DataFrame, keys: Sequence[str] = (), feature: str = "feature") -> DataFrame:
    """Features of each key by falling PSI, those without one last, ties by name."""
    return number_rows(drift, list(keys), [F.desc_nulls_last("psi"), F.col(feature)], "position")


def first_occurrences(rows: DataFrame, keys: Sequence[str], value: str, at: str | Column) -> DataFrame:
    """(*keys, value, first, times, position): distinct values in the order they first occur.

    Copies meet before the shuffle, so a value that fills a third of the rows is a row per task.
    """
    first = rows.groupBy(*keys, value).agg(F.min(at).alias("first"), F.count("*").alias("times"))
    return number_rows(first, list(keys), ["first", value], "position")
