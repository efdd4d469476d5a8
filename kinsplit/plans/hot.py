"""Joins with one row a group, where a few groups may hold much of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SHARE, LEAST = 1000, 200


def hot_limit(total: int) -> int:
    """Groups of more rows than this are hot. Groups share ``total`` rows, so at most SHARE of them are."""
    return max(LEAST, total // SHARE)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` inner-joined with ``groups`` (one row a ``key``, with the number of its rows as ``size``).

    Rows of hot groups meet theirs by a broadcast of at most SHARE rows; all others shuffle, and no task gets more of
    one group than the limit. ``groups`` is read three times, so it should be a table.
    """
    limit = hot_limit(total)
    hot, cool = groups.where(F.col(size) > limit), groups.where(F.col(size) <= limit)
    met = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cool, key)
    return met.unionByName(rest)
