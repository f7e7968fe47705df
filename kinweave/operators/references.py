"""Orphan references: rows that point to keys which are missing or arrive later.

Parent and child keys are brought into one long form, tagged by origin, and
aggregated per parent table, tree and key.  The aggregate combines on the map
side, so a key that a third of all rows refer to costs one row per map task.
Only the keys that turn out to be suspect are joined back to the references,
salted, to name the records.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of a reference that stands for nobody, after :func:`reference_key`.
VOID_KEYS = ("", "void", "null", "none", "0" * 32)

SALTS = 8


def reference_key(value: Column) -> Column:
    """A reference without differences of notation: letters and digits only, lower case.

    Null stays null; a blank or void reference becomes null.
    """
    key = F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))
    return F.when(~key.isin(*VOID_KEYS), key)


@dataclass(frozen=True)
class References:
    """References of one column: ``rows`` are read through the named columns only."""

    rows: DataFrame
    table_name: str
    record_id: str
    field_name: str
    parent: str
    tree_id: str = "tree_id"
    created_at: str = "created_at"


@dataclass(frozen=True)
class Parents:
    """Keys that one parent table offers under the name ``parent``."""

    rows: DataFrame
    parent: str
    key: str
    tree_id: str = "tree_id"
    created_at: str = "created_at"


def _children(refs: Sequence[References]) -> DataFrame:
    out = None
    for r in refs:
        part = r.rows.select(
            F.lit(r.parent).alias("parent"),
            F.coalesce(F.lower(F.trim(r.rows[r.tree_id])), F.lit("")).alias("tree"),
            reference_key(r.rows[r.field_name]).alias("key"),
            r.rows[r.created_at].alias("child_at"),
            F.lit(r.table_name).alias("table_name"),
            r.rows[r.record_id].cast("string").alias("record_id"),
            F.lit(r.field_name).alias("field_name"),
        ).filter(F.col("key").isNotNull())
        out = part if out is None else out.unionByName(part)
    return out


def _parents(parents: Sequence[Parents]) -> DataFrame:
    out = None
    for p in parents:
        part = p.rows.select(
            F.lit(p.parent).alias("parent"),
            F.lower(F.trim(p.rows[p.tree_id])).alias("tree"),
            reference_key(p.rows[p.key]).alias("key"),
            p.rows[p.created_at].alias("parent_at"),
        ).filter(F.col("key").isNotNull() & F.col("tree").isNotNull())
        out = part if out is None else out.unionByName(part)
    return out


def orphan_references(refs: Sequence[References], parents: Sequence[Parents]) -> DataFrame:
    """One row per orphan reference.

    Columns: ``table_name, record_id, field_name, reference_at, reason`` where
    ``reason`` is ``missing`` (no parent of the tree has the key) or ``later``
    (the earliest such parent was created after the referring row).

    * null, blank and void references are no orphans;
    * a referring row without tree has no parent, so its reference is missing;
    * a parent or a referring row without ``created_at`` never counts as late;
    * repeated rows give one row (the earliest ``reference_at``);
    * empty tables give an empty result; other columns of the inputs are not read.
    """
    kids = _children(refs)
    long = kids.select("parent", "tree", "key", "child_at", F.lit(None).cast("timestamp_ntz").alias("parent_at"), F.lit(0).alias("is_parent")).unionByName(
        _parents(parents).select("parent", "tree", "key", F.lit(None).cast("timestamp_ntz").alias("child_at"), "parent_at", F.lit(1).alias("is_parent"))
    )
    suspect = (
        long.groupBy("parent", "tree", "key")
        .agg(
            F.max("is_parent").alias("known"),
            F.when(F.count(F.when(F.col("is_parent") == 1, 1)) == F.count("parent_at"), F.min("parent_at")).alias("parent_at"),
            F.min("child_at").alias("first_at"),
            F.count(F.when(F.col("is_parent") == 0, 1)).alias("references"),
        )
        .filter((F.col("references") > 0) & ((F.col("known") == 0) | (F.col("first_at") < F.col("parent_at"))))
        .select("parent", "tree", "key", "known", "parent_at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    hit = kids.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int")).join(suspect, ["parent", "tree", "key", "salt"])
    return (
        hit.filter((F.col("known") == 0) | (F.col("child_at") < F.col("parent_at")))
        .groupBy("table_name", "record_id", "field_name")
        .agg(F.min("child_at").alias("reference_at"), F.max(F.when(F.col("known") == 0, "missing").otherwise("later")).alias("reason"))
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references per table, field, month of ``created_at`` and reason.

    A record without ``created_at`` is counted under a null period.
    """
    period = F.date_format("reference_at", "yyyy-MM")
    return orphans.groupBy("table_name", "field_name", period.alias("period"), "reason").agg(F.count(F.lit(1)).alias("orphans"))
