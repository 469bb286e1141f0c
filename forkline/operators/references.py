"""References to records that do not exist.

Parents and children go into one long, tagged form; a group of parent table and key that lacks a usable parent is
broken, and its children are the orphans. Counts per table and period follow from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forkline.functions import month_of_millis
from forkline.operators.ordering import newest
from forkline.sources import tidy, written


def children_of(df: DataFrame, table: str, key: Column, ref_key: Column, at: Column, scope: Column | None = None) -> DataFrame:
    """Child side in long form: what refers to ``key`` (within ``scope``), and when, in epoch milliseconds."""
    return df.select(
        F.lit(table).alias("ref_table"), F.coalesce(scope if scope is not None else F.lit(""), F.lit("")).alias("scope"),
        key.cast("string").alias("target_key"), ref_key.cast("string").alias("ref_key"), at.cast("bigint").alias("at"),
    ).filter(F.col("target_key").isNotNull())


def parents_of(df: DataFrame, table: str, key: Column, since: Column, scope: Column | None = None) -> DataFrame:
    """Parent side in long form: ``since`` is when the record came to be, null if it is deleted."""
    return df.select(
        F.lit(table).alias("ref_table"), F.coalesce(scope if scope is not None else F.lit(""), F.lit("")).alias("scope"),
        key.cast("string").alias("target_key"), since.cast("bigint").alias("since"),
    ).filter(F.col("target_key").isNotNull())


@tidy
def orphans(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Every distinct reference without a parent that exists at its time.

    Returns ``ref_table, ref_key, target_key, at, reason``; ``reason`` is ``missing`` (never there), ``deleted`` or
    ``later`` (came after the reference). A reference without a time has no parent at its time: ``later`` if the
    parent lives. A null key refers to nothing and gives no row; empty tables give no rows; repeated rows count once.

    The grouping combines before it shuffles, so a key that holds a third of all references costs one row per task.
    The broken groups are written out, one row each, so that the join with their children has a shuffle of its own on
    either side, which Spark splits where a key is hot; over the grouping's own partitions it would not.
    """
    keys = ["ref_table", "scope", "target_key"]
    nothing = F.lit(None).cast("bigint")
    long = children.select(*keys, nothing.alias("since"), F.lit(0).alias("parent"), F.coalesce("at", F.lit(-(2**63))).alias("first")).unionByName(
        parents.select(*keys, "since", F.lit(1).alias("parent"), nothing.alias("first"))
    )
    groups = long.groupBy(*keys).agg(F.min("since").alias("since"), F.max("parent").alias("parent"), F.min("first").alias("first"))
    broken = groups.filter(F.col("first").isNotNull() & (F.col("since").isNull() | (F.col("since") > F.col("first"))))
    found = children.join(written(broken.drop("first")), keys).filter(
        F.col("since").isNull() | F.col("at").isNull() | (F.col("since") > F.col("at"))
    )
    reason = F.when(F.col("parent") == 0, "missing").when(F.col("since").isNull(), "deleted").otherwise("later")
    return (
        found.withColumn("reason", reason)
        .groupBy("ref_table", "ref_key", "target_key")
        .agg(F.min("at").alias("at"), F.max("reason").alias("reason"))
    )


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per referring table, month (UTC) and reason; a null month holds references without a time."""
    by = found.groupBy("ref_table", month_of_millis(F.col("at")).alias("month"), "reason")
    return by.agg(F.count(F.lit(1)).alias("n_orphans"))


def collection_references(mutations: DataFrame, chunks: DataFrame, handles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Children and parents of the two links of a versioned collection: change to chunk, branch to parent branch.

    Hashes compare in lower case. Of a branch, the version with the highest ``commit_seq`` counts, and a parent is
    looked up within the project. Changes without path refer to their chunks like any other.
    """
    refs = mutations.select("node_id", "lsn", "created_at", F.explode("chunks").alias("hash"))
    change = F.concat(F.col("node_id").cast("string"), F.lit(":"), F.col("lsn").cast("string"))
    current = newest(handles.select("project_id", "branch_id", "parent_branch_id", "created_at", "commit_seq", "deleted_at"), ["project_id", "branch_id"], "commit_seq")
    children = children_of(refs, "mutations", F.lower("hash"), change, F.col("created_at")).unionByName(
        children_of(current, "branch_handles", F.col("parent_branch_id"), F.col("branch_id"), F.col("created_at"), F.col("project_id"))
    )
    alive = F.col("deleted_at").isNull()
    parents = parents_of(chunks, "mutations", F.lower("hash"), F.when(alive, F.col("stored_at"))).unionByName(
        parents_of(current, "branch_handles", F.col("branch_id"), F.when(alive, F.col("created_at")), F.col("project_id"))
    )
    return children, parents
