"""What a branch shows: the newest version of each path along its chain of segments."""

from __future__ import annotations

import base64
import binascii
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from forkline.errors import InvalidCursor, InvalidInput
from forkline.lineage import NO_CAP
from forkline.sources import BROADCAST_ROWS


#: Segments of a chain up to which it goes into the plan as literals, and up to which its segments are listed for pruning.
LITERALS, LISTED = 32, 1000


def within_chain(mutations: DataFrame, chain: list[tuple[int, int]]) -> DataFrame:
    """The changes that a chain admits, with their ``depth``.

    A short chain goes into the plan as literals, so that segments and positions are pruned where the files are read. A
    long one is a small table that the changes are joined with, next to filters by segment and greatest position.
    """
    if not chain:
        return mutations.filter("false").withColumn("depth", F.lit(0))
    ids = [n for n, _ in chain]
    if len(chain) > LITERALS:
        listed = F.col("node_id").isin(ids) if len(ids) <= LISTED else F.col("node_id").between(min(ids), max(ids))
        top = max(cap for _, cap in chain)
        table = pa.table({"node_id": ids, "depth": range(len(ids)), "_cap": [cap for _, cap in chain]}, pa.schema([("node_id", pa.int64()), ("depth", pa.int32()), ("_cap", pa.int64())]))
        levels = mutations.sparkSession.createDataFrame(table)
        levels = F.broadcast(levels) if len(ids) <= BROADCAST_ROWS else levels
        rows = mutations.filter(listed if top == NO_CAP else listed & (F.col("lsn") <= top))
        return rows.join(levels, "node_id").filter(F.col("lsn") <= F.col("_cap")).select(*[mutations[c] for c in mutations.columns], "depth")
    admitted = reduce(Column.__or__, [(F.col("node_id") == n) & (F.col("lsn") <= cap) if cap < NO_CAP else F.col("node_id") == n for n, cap in chain])
    depth = F.lit(None).cast("int")
    for d, (n, _) in enumerate(chain):
        depth = F.when(F.col("node_id") == n, F.lit(d)).otherwise(depth)
    return mutations.filter(F.col("node_id").isin(ids) & admitted).withColumn("depth", depth)


def top_versions(admitted: DataFrame) -> DataFrame:
    """Per path the change on the segment nearest the leaf, and of that segment the newest; tombstones included.

    Spark keeps one row per path and task before it shuffles (window group limit).
    """
    order = W.partitionBy("path").orderBy(F.col("depth"), F.col("lsn").desc())
    return admitted.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def resolved(mutations: DataFrame, chain: list[tuple[int, int]], prefix: str | None = None, after: str | None = None, path: str | None = None) -> DataFrame:
    """The visible version of every path: top versions without tombstones, which hide what lies below them."""
    rows = mutations
    if prefix:
        rows = rows.filter(F.col("path").startswith(prefix))
    if after is not None:
        rows = rows.filter(F.col("path") > after)
    if path is not None:
        rows = rows.filter(F.col("path") == path)
    return top_versions(within_chain(rows, chain)).filter(~F.coalesce("tombstone", F.lit(False))).drop("depth")


def node_local(mutations: DataFrame, node_id: int, cap: int = NO_CAP) -> DataFrame:
    """The newest change at or below ``cap`` of each path on one segment, tombstones kept."""
    return top_versions(within_chain(mutations, [(node_id, cap)])).drop("depth")


def listing(view: DataFrame, limit: int) -> DataFrame:
    """The first paths of a resolved view in bytewise order."""
    return view.select("path", "lsn", "size", "content_type").orderBy("path").limit(limit)


def common_prefixes(view: DataFrame, prefix: str, delimiter: str) -> DataFrame:
    """``entry, is_prefix``: paths up to the first delimiter after the prefix rolled up, the others as they are."""
    rest = F.substring("path", F.lit(len(prefix) + 1), F.lit(2**31 - 1))
    cut = F.instr(rest, delimiter)
    rolled = F.concat(F.lit(prefix), F.substring(rest, F.lit(1), cut + F.lit(len(delimiter) - 1)))
    entries = view.filter(F.col("path").startswith(prefix)).select(F.when(cut > 0, rolled).otherwise(F.col("path")).alias("entry"), (cut > 0).alias("is_prefix"))
    return entries.groupBy("entry").agg(F.max("is_prefix").alias("is_prefix"))


def merge_records(mutations: DataFrame, source_node: int) -> DataFrame:
    """What a merge moves: the newest change per path of the source's own segment, tombstones included."""
    return node_local(mutations, source_node)


def encode_cursor(key: str) -> str:
    return base64.b64encode(key.encode()).decode()


def decode_cursor(cursor: str | None) -> str | None:
    if cursor is None:
        return None
    try:
        return base64.b64decode(cursor, validate=True).decode()
    except (binascii.Error, UnicodeDecodeError, ValueError) as e:
        raise InvalidCursor(cursor) from e


def without_nul(name: str, value: str) -> str:
    if "\0" in value:
        raise InvalidInput(f"{name} must not hold NUL")
    return value


def page_size(limit: int | None, default: int, most: int) -> int:
    """The default if none is given, at least one; too many are an error."""
    n = default if limit is None else limit
    if n > most or n < 0:
        raise InvalidInput(f"limit must be at most {most}")
    return max(1, n)
