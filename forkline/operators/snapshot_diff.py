"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forkline.operators.ordering import newest, with_next

#: Milliseconds of one block when snapshots of a branch are put in order.
ORDER_BLOCK = 30 * 86_400_000


def row_hash(columns: list[str]):
    """128-bit hash of a canonical spelling of the columns: null and the empty string differ, as do (ab, c) and (a, bc)."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("|", *parts)))


def successors(snapshots: DataFrame, group: list[str], order: str = "created_at") -> DataFrame:
    """``snapshot_id, next_id``: each snapshot that has a later one in its group, with the next. Repeats count once."""
    rows = snapshots.filter(F.col("snapshot_id").isNotNull() & F.col(order).isNotNull())
    rows = rows.groupBy(*group, order).agg(F.min("snapshot_id").alias("snapshot_id"))
    chained = with_next(rows, group, order, ORDER_BLOCK, "_next_at").alias("a")
    later = rows.alias("b")
    same = F.col("a._next_at") == F.col(f"b.{order}")
    for g in group:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    return chained.join(later, same).select(F.col("a.snapshot_id").alias("snapshot_id"), F.col("b.snapshot_id").alias("next_id"))


def snapshot_changes(snapshots: DataFrame, listing: DataFrame, compare: list[str] = ("lsn",), key: str = "path", version: str = "lsn", group: list[str] = ("project_id", "branch_id")) -> DataFrame:
    """``snapshot_id, path, change_kind, old_<c>, new_<c>`` of each record that differs from the snapshot before.

    Both listings are keyed by the later snapshot and the record's key, and a full outer join compares hashes of the
    compared columns: a missing side gives ``added`` or ``removed``, unequal hashes ``changed``. Where a snapshot lists
    a key more than once, the highest ``version`` holds; of several such rows, each compared column takes its greatest
    non-null value, so an incomplete repeat hides nothing. A snapshot without rows is empty: all is removed, then
    added. The first snapshot of a group has no rows. Rows without key or version are ignored.
    """
    compare, group = list(compare), list(group)
    rows = listing.filter(F.col("snapshot_id").isNotNull() & F.col(key).isNotNull() & F.col(version).isNotNull())
    if set(compare) == {version}:
        held = rows.groupBy("snapshot_id", key).agg(F.max(version).alias(version))
    else:
        per = rows.groupBy("snapshot_id", key, version).agg(*[F.max(c).alias(c) for c in compare if c != version])
        held = newest(per.select("snapshot_id", key, version, *[c for c in compare if c != version]), ["snapshot_id", key], version)
    held = held.withColumn("_hash", row_hash(compare)).select("snapshot_id", F.col(key).alias("_key"), "_hash", *compare)
    pairs = successors(snapshots, group)
    now = held.join(pairs.select(F.col("next_id").alias("snapshot_id")), "snapshot_id", "left_semi")
    then = held.join(pairs, "snapshot_id").drop("snapshot_id").withColumnRenamed("next_id", "snapshot_id")
    now = now.select("snapshot_id", "_key", F.col("_hash").alias("_new"), *[F.col(c).alias(f"new_{c}") for c in compare])
    then = then.select("snapshot_id", "_key", F.col("_hash").alias("_old"), *[F.col(c).alias(f"old_{c}") for c in compare])
    both = now.join(then, ["snapshot_id", "_key"], "full_outer")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_new") != F.col("_old"), "changed")
    out = both.withColumn("change_kind", kind).filter(F.col("change_kind").isNotNull())
    return out.select("snapshot_id", F.col("_key").alias(key), "change_kind", *[f"{side}_{c}" for c in compare for side in ("old", "new")])
