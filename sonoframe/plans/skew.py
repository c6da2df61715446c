"""Joins whose keys may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key from which it is joined by broadcast.
HOT_ROWS = 1_000_000


def join_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot_rows: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has at most one row per ``key``; ``how`` is inner or left.

    Keys with more than ``hot_rows`` (HOT_ROWS) rows in ``left`` are never shuffled: their rows of ``right`` are
    broadcast, at most one for every ``hot_rows`` rows of ``left``. Everything else is joined as usual. ``left`` is
    counted by key first, so it should be cheap to read again, unless ``sizes`` (key, _n) tells how many rows its keys
    have; a key that is not there is not hot. A null key matches nothing.
    """
    most = HOT_ROWS if hot_rows is None else hot_rows
    if sizes is None:
        if left.count() <= most:  # no key can have more
            return left.join(right, key, how)
        sizes = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    hot = [r[0] for r in sizes.where(F.col("_n") > most).select(key).collect()]  # at most rows / most
    if not hot:
        return left.join(right, key, how)
    keys = left.sparkSession.createDataFrame([(k,) for k in hot], left.select(key).schema)
    few = F.broadcast(right.join(F.broadcast(keys), key, "left_semi"))
    marked = left.join(F.broadcast(keys.withColumn("_hot", F.lit(True))), key, "left")
    rest = marked.where("_hot IS NULL").drop("_hot").join(right, key, how)
    return marked.where("_hot").drop("_hot").join(few, key, how).unionByName(rest)
