"""What an engine is put together from, each replaceable: the log of commits, the store of chunks, the numbering of changes."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any, Protocol

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from forkline import chunking
from forkline.commitlog import Files, State
from forkline.schema import CHUNKS

PREFIXES = "0123456789abcdef"
#: The first position of new changes, given the newest one of their branch; it must be greater.
Numbering = Callable[[int], int]


def dense(head: int) -> int:
    """Positions without gaps."""
    return head + 1


class Log(Protocol):
    """An ordered log of commits and the state that they leave."""

    root: str
    state: State
    files: Files

    def refresh(self) -> State: ...

    def publish(self, based_on: int, actions: dict[str, Any]) -> int:
        """Append a commit after ``based_on``; a Conflict if another was first."""
        ...

    def new_folder(self, table: str) -> str: ...

    def unnamed(self, older_than_ms: int) -> list[str]: ...


class ChunkStore(Protocol):
    """Keeps chunks, ``hash, data, length``; commits name what it has kept."""

    def keep(self, chunks: DataFrame, folder: str) -> list[dict]:
        """Write new chunks; what a commit must record to find them, each with a ``path``."""
        ...

    def open(self, named: list[dict], hashes: Iterable[bytes] | None = None) -> DataFrame | None:
        """The chunks that commits name, at least those of the given hashes; None if there are none."""
        ...


class PrefixFolders:
    """Parquet files in folders by the first hex digit of the hash, sorted, with filters by which look-ups skip most files."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def keep(self, chunks: DataFrame, folder: str) -> list[dict]:
        out = chunks.select(*[F.col(f.name).cast(f.dataType) for f in CHUNKS], chunking.prefix_of(F.col("hash")).alias("prefix"))
        seen = Observation()
        counted = out.observe(seen, *[F.count(F.when(F.col("prefix") == x, 1)).alias(x) for x in PREFIXES])
        writer = counted.sortWithinPartitions("prefix", "hash").write.partitionBy("prefix").option("compression", "zstd")
        writer.option("parquet.bloom.filter.enabled#hash", "true").option("parquet.bloom.filter.expected.ndv#hash", "100000").parquet(folder)
        prefixes = "".join(x for x, n in seen.get.items() if n)
        return [{"path": folder, "prefixes": prefixes}] if prefixes else []

    def open(self, named: list[dict], hashes: Iterable[bytes] | None = None) -> DataFrame | None:
        wanted = {h.hex()[0] for h in hashes} if hashes is not None else set(PREFIXES)
        paths = [f"{c['path']}/prefix={x}" for c in named for x in c["prefixes"] if x in wanted]
        return self.spark.read.schema(CHUNKS).parquet(*paths) if paths else None
