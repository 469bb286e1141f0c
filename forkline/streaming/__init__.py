"""Writing streams of objects into a branch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from forkline.api import Engine


def ingest(stream: DataFrame, engine: Engine, project: str, branch: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Put each micro-batch of ``path, content[, content_type][, deleted]`` into a branch, puts and deletes in one commit.

    The commit names the stream, by its checkpoint and branch, and the batch: a batch that is run again after a failure
    finds itself there and appends nothing.
    """
    name = f"{checkpoint}|{project}|{branch}"

    def write(batch: DataFrame, number: int) -> None:
        if engine.log.refresh().batches.get(name, -1) >= number:
            return
        deleted = F.col("deleted") if "deleted" in batch.columns else None
        engine.put_objects(project, branch, batch, deleted=deleted, batch={name: number})

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
