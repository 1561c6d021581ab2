"""References to records that do not exist, from signed counts per key.

Every change is a delta of a key: a reference that came (+1) or went (-1), a
record that came (+1) or went (-1), a retirement. The state of a key is the
sum of its deltas with the earliest time it existed, so states of any parts
merge by the same sums, in any order. Keys with references and no existence
are orphans; keys that exist from later on make the earlier references late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables of exempt labels are broadcast up to this many rows.
BROADCAST_LABELS = 10_000

STATE = "key string, refs long, existing long, first_at timestamp_ntz, first_ref_at timestamp_ntz, retired long"


def deltas(references: DataFrame, existing: DataFrame, retired: DataFrame) -> DataFrame:
    """Signed deltas from references(ref, at[, sign]), existing(key, at[, sign]) and retired(key)."""

    def sign(df: DataFrame):
        return (F.col("sign") if "sign" in df.columns else F.lit(1)).cast("long")

    none, zero = F.lit(None).cast("timestamp_ntz"), F.lit(0).cast("long")
    came = references.select(F.col("ref").alias("key"), sign(references).alias("refs"), zero.alias("existing"), none.alias("first_at"), F.col("at").alias("first_ref_at"), zero.alias("retired"))
    is_there = existing.select("key", zero.alias("refs"), sign(existing).alias("existing"), F.col("at").alias("first_at"), none.alias("first_ref_at"), zero.alias("retired"))
    gone = retired.select("key", zero.alias("refs"), zero.alias("existing"), none.alias("first_at"), none.alias("first_ref_at"), F.lit(1).cast("long").alias("retired"))
    return came.unionByName(is_there).unionByName(gone).where("key is not null")


def merged(*changes: DataFrame) -> DataFrame:
    """The state of each key: sums of deltas or of earlier states. Partial sums are taken before the shuffle."""
    whole = changes[0]
    for more in changes[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("key").agg(
        F.sum("refs").alias("refs"),
        F.sum("existing").alias("existing"),
        F.min("first_at").alias("first_at"),
        F.min("first_ref_at").alias("first_ref_at"),
        F.sum("retired").alias("retired"),
    )


def orphan_keys(state: DataFrame) -> DataFrame:
    """Keys with references that have, or had at first, no record."""
    return state.where("refs > 0 and (existing <= 0 or first_at > first_ref_at)")


def without_labels(references: DataFrame, labels: DataFrame, label_col: str = "label") -> DataFrame:
    """References that are not exempt labels; the label table is broadcast behind a check of its size."""
    exempt = labels.select(F.col(label_col).alias("ref")).where("ref is not null").distinct()
    if exempt.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        exempt = F.broadcast(exempt)
    return references.join(exempt, "ref", "left_anti")


def orphan_references(references: DataFrame, existing: DataFrame, retired: DataFrame) -> DataFrame:
    """table_name, record_id, ref, reason, period for each orphan of references(table_name, record_id, ref, at).

    late: the key's earliest existing(key, at) is after the reference's time;
    deleted: it doesn't exist but is in retired(key); missing: neither. Keys
    compare exactly; null keys are no references. A reference without a time
    is never late and has a null period.
    """
    state = orphan_keys(merged(deltas(references, existing, retired)))
    reason = (
        F.when(F.col("existing") > 0, F.when(F.col("first_at") > F.col("at"), F.lit("late")))
        .when(F.col("retired") > 0, F.lit("deleted"))
        .otherwise(F.lit("missing"))
    )
    return (
        references.join(state.select(F.col("key").alias("ref"), "existing", "first_at", "retired"), "ref")
        .select("table_name", "record_id", "ref", reason.alias("reason"), F.date_format("at", "yyyy-MM").alias("period"))
        .where("reason is not null")
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """table_name, period, reason, n_references, n_keys."""
    return orphans.groupBy("table_name", "period", "reason").agg(F.count("*").alias("n_references"), F.countDistinct("ref").alias("n_keys"))
