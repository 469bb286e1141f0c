"""Which segments a branch sees, and up to which position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.errors import StorageError

#: Stands for "no limit" where a number is needed.
NO_CAP = 2**63 - 1


def chain(nodes: dict[int, dict], leaf: int, at_lsn: int | None = None) -> list[tuple[int, int]]:
    """``(node, cap)`` from the leaf to the root; the cap is the lowest of ``at_lsn`` and every fork position so far."""
    out, seen, cap, node = [], set(), NO_CAP if at_lsn is None else at_lsn, leaf
    while node is not None:
        if node in seen:
            raise StorageError(f"segment {node} is its own ancestor")
        seen.add(node)
        out.append((node, cap))
        row = nodes.get(node) or {}
        if row.get("fork_lsn") is not None:
            cap = min(cap, row["fork_lsn"])
        node = row.get("parent_node_id")
    return out


def chain_frame(spark: SparkSession, links: list[tuple[int, int]]) -> DataFrame:
    """``node_id, depth, cap`` of a chain; no limit is a null cap."""
    rows = [(n, d, None if cap == NO_CAP else cap) for d, (n, cap) in enumerate(links)]
    return spark.createDataFrame(rows, "node_id bigint, depth bigint, cap bigint")


def max_lsns(mutations: DataFrame) -> DataFrame:
    """``node_id, max_lsn`` of every segment with changes."""
    return mutations.groupBy("node_id").agg(F.max("lsn").alias("max_lsn"))


def heads(nodes: DataFrame, mutations: DataFrame) -> DataFrame:
    """``node_id, fork_lsn, head_lsn`` of every segment: the higher of its fork position and its newest change, else 0."""
    none = F.lit(0).cast("bigint")
    joined = nodes.join(max_lsns(mutations), "node_id", "left")
    head = F.greatest(F.coalesce("fork_lsn", none), F.coalesce("max_lsn", none))
    return joined.select("node_id", "fork_lsn", head.alias("head_lsn"))


def branch_infos(handles: DataFrame, nodes: DataFrame, mutations: DataFrame) -> DataFrame:
    """``branch_id, parent_id, fork_lsn, head_lsn`` of current handles; a root handle has no fork position."""
    fork = F.when(F.col("parent_branch_id").isNotNull(), F.col("fork_lsn"))
    return handles.join(heads(nodes, mutations), "node_id").select("branch_id", F.col("parent_branch_id").alias("parent_id"), fork.alias("fork_lsn"), "head_lsn")


def children(handles: DataFrame, branch_id: str) -> DataFrame:
    """Current handles whose parent is the branch."""
    return handles.filter(F.col("parent_branch_id") == branch_id).select("branch_id")
