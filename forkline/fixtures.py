"""A versioned collection derived from the events table: four segments, three levels, one of them after a restore."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.operators.ordering import ranked
from forkline.sources import table

#: Events of one block when they are numbered.
BLOCK = 100_000
HANDLES = {"main": (1, None), "dev": (4, "main"), "backup": (2, "dev"), "staging": (3, "dev")}


@dataclass(frozen=True)
class Collection:
    log: DataFrame
    nodes: dict[int, dict]
    fork: int

    def node_frame(self) -> DataFrame:
        rows = [(n["node_id"], n["parent_node_id"], n["fork_lsn"]) for n in self.nodes.values()]
        return self.log.sparkSession.createDataFrame(rows, "node_id bigint, parent_node_id bigint, fork_lsn bigint")

    def handle_frame(self) -> DataFrame:
        rows = [(b, n, p) for b, (n, p) in HANDLES.items()]
        return self.log.sparkSession.createDataFrame(rows, "branch_id string, node_id bigint, parent_branch_id string")


def derived_collection(spark: SparkSession, folder: str) -> Collection:
    """Node 1 is main, 2 was forked from it and is now the backup, 3 is staging, 4 is dev after its restore."""
    events = table(spark, folder, "events")
    n = events.count()
    e = F.col("event_id")
    node = (
        F.when((e % 4 == 2) & (e * 2 >= n), 2).when((e % 4 == 3) & (e * 4 >= 3 * n), 3).when((e % 8 == 1) & (e * 8 >= 7 * n), 4).otherwise(1)
    )
    tagged = events.withColumn("node_id", node.cast("bigint"))
    count = lambda cond: F.count(F.when(cond, 1))
    f2, d2, n2 = tagged.agg(
        count((F.col("node_id") == 1) & (e * 2 < n)), count((F.col("node_id") == 2) & (e * 4 < 3 * n)), count(F.col("node_id") == 2)
    ).first()
    above = F.when(F.col("node_id") == 2, f2).when(F.col("node_id") == 3, f2 + d2).when(F.col("node_id") == 4, f2 + n2).otherwise(0)
    rows = ranked(tagged, ["node_id"], "event_id", BLOCK, "_rank")
    log = rows.select(
        "node_id", (F.col("_rank") + above).cast("bigint").alias("lsn"),
        F.concat(F.lit("user/"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit("/obj-"), (e % 7).cast("string")).alias("path"),
        F.octet_length("props").cast("bigint").alias("size"), F.col("event_type").alias("content_type"), (F.col("event_type") == "error").alias("tombstone"),
        F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("created_at"),
    )
    nodes = [(1, None, None), (2, 1, f2), (3, 2, f2 + d2), (4, 2, f2 + d2 // 2)]
    return Collection(log, {i: {"node_id": i, "parent_node_id": p, "fork_lsn": f} for i, p, f in nodes}, f2)
