"""Relational helpers of imports: joins on alternatives, differences and snapshot merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def or_equi_join(left: DataFrame, right: DataFrame, alternatives: list[list[tuple[str, str]]], keys: list[str]) -> DataFrame:
    """Inner join on any of several lists of equal columns (left, right), each pair of rows once.

    Every alternative is an equi-join of its own; ``keys`` identify a pair of rows in the
    union.  Null matches nothing.
    """
    parts = [left.join(right, reduce(lambda a, b: a & b, [left[x] == right[y] for x, y in alternative])) for alternative in alternatives]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(keys)


def differs(pairs: list[tuple[Column, Column]]) -> Column:
    """Whether any pair of columns differs, null being a value."""
    return reduce(lambda a, b: a | b, [~a.eqNullSafe(b) for a, b in pairs])


def merge_snapshot(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Upsert by keys: the new snapshot, and the (change, rows) counts of it.

    Rows of ``source`` whose keys are new are added; where any of ``columns`` differs they
    replace the old values; all else stays as it is.  The result has the target's columns,
    null where a new row lacks one.  Both sides have unique keys.
    """
    others = [c for c in target.columns if c not in keys and c not in columns]
    given = [c for c in others if c in source.columns]
    new = source.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in [*columns, *given]], F.lit(True).alias("_in"))
    both = target.withColumn("_old", F.lit(True)).join(new, keys, "full")
    update = F.col("_old").isNotNull() & F.col("_in").isNotNull() & differs([(F.col(c), F.col(f"_new_{c}")) for c in columns])
    change = F.when(F.col("_old").isNull(), "ADD").when(update, "UPDATE").otherwise("KEEP")
    marked = both.withColumn("_change", change)
    take = lambda c: F.when(F.col("_change") != "KEEP", F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
    fill = lambda c: F.when(F.col("_change") == "ADD", F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c)
    merged = marked.select(*keys, *[take(c) for c in columns], *[fill(c) for c in others]).select(target.columns)
    return merged, marked.filter("_change <> 'KEEP'").groupBy(F.col("_change").alias("change")).agg(F.count(F.lit(1)).alias("rows"))


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Additive merge: rows of ``source`` whose keys the target lacks; returns the snapshot and the new rows."""
    new = source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new.select([c for c in target.columns if c in new.columns]), allowMissingColumns=True), new
