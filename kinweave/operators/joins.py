"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than one in so many of all rows; there are no more hot keys than this.
HOT_ONE_IN = 200


def counted_join(rows: DataFrame, values: DataFrame, key: str, count: str, how: str = "left") -> DataFrame:
    """``rows`` joined with ``values``, one row per ``key``, where ``values[count]`` says how many rows have the key.

    The rows of hot keys meet their at most HOT_ONE_IN values by broadcast and are not
    shuffled; all others meet by an ordinary join.  Null keys of ``rows`` match nothing.
    ``values`` should be a stored table, as it is read more than once.
    """
    total, most = values.agg(F.sum(count), F.max(count)).first()
    limit = (total or 0) // HOT_ONE_IN
    if (most or 0) <= max(limit, 1):
        return rows.join(values.drop(count), key, how)
    hot = values.filter(F.col(count) > limit).drop(count)
    cold = values.filter(F.col(count) <= limit).drop(count)
    names = hot.select(F.col(key), F.lit(True).alias("_hot"))
    tagged = rows.join(F.broadcast(names), key, "left")
    frequent = tagged.filter("_hot").drop("_hot").join(F.broadcast(hot), key)
    others = tagged.filter("_hot is null").drop("_hot").join(cold, key, how)
    return frequent.unionByName(others)
