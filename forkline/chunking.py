"""Cutting object bytes into content-addressed chunks, and putting them together again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forkline.errors import InvalidInput
from forkline.sources import BROADCAST_ROWS, shipped

DEFAULT_CHUNK_SIZE = 8 * 1024 * 1024


def fixed_cuts(content: Column, size: int) -> Column:
    """Array of ``(offset, length)`` of consecutive blocks of ``size`` bytes; empty for empty content."""
    if size <= 0:
        raise InvalidInput("chunk size must be positive")
    n = F.octet_length(content)
    blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / F.lit(size)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(
        blocks, lambda i: F.struct((i.cast("bigint") * size).alias("offset"), F.least(F.lit(size).cast("bigint"), n - i.cast("bigint") * size).alias("length"))
    )


def slice_of(content: Column, cut: Column) -> Column:
    """The bytes of a cut."""
    return F.substring(content, (cut["offset"] + 1).cast("int"), cut["length"].cast("int"))


def chunk_hash(data: Column) -> Column:
    """SHA-256 of the bytes."""
    return F.unhex(F.sha2(data, 256))


def hash_list(content: Column, cuts: Column) -> Column:
    """The hashes of an object's chunks in byte order, without leaving the row."""
    return F.transform(cuts, lambda c: chunk_hash(slice_of(content, c)))


def chunks_of(objects: DataFrame, id_col: str, content_col: str, cuts_col: str) -> DataFrame:
    """``id, chunk_index, offset, length, hash, data`` of every chunk."""
    rows = objects.select(id_col, content_col, F.posexplode(cuts_col).alias("chunk_index", "_cut"))
    rows = rows.withColumn("data", slice_of(F.col(content_col), F.col("_cut")))
    return rows.select(id_col, "chunk_index", F.col("_cut.offset").alias("offset"), F.col("_cut.length").alias("length"), chunk_hash(F.col("data")).alias("hash"), "data")


@cache
def gear_table() -> np.ndarray:
    """256 fixed random 64-bit numbers, by rule: the first bytes of the SHA-256 of each byte."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "little") for b in range(256)], np.uint64)


def gear_hashes(data: bytes) -> np.ndarray:
    """The gear hash at each byte: each of the last 64 bytes' numbers, shifted by its distance, by doubling."""
    h = gear_table()[np.frombuffer(data, np.uint8)]
    for k in range(6):
        step = 1 << k
        if len(h) > step:
            shifted = h.copy()
            shifted[step:] += h[:-step] << np.uint64(step)
            h = shifted
    return h


def check_bounds(least: int, average: int, most: int) -> None:
    if not 0 < least <= average <= most:
        raise InvalidInput("content-defined chunks need 0 < min <= avg <= max")


def content_cuts(data: bytes, least: int, average: int, most: int) -> list[tuple[int, int]]:
    """``(offset, length)`` of content-defined chunks, with normalised chunking after the FastCDC paper.

    A cut comes where the gear hash has a run of zero bits: more of them before the average size, fewer after. Every
    chunk but the last has at least ``least`` bytes, none more than ``most``; equal data has equal cuts.
    """
    check_bounds(least, average, most)
    bits = max(1, round(np.log2(average)))
    top = gear_hashes(data)
    hard = np.flatnonzero(top >> np.uint64(64 - min(63, bits + 1)) == 0)
    easy = np.flatnonzero(top >> np.uint64(64 - max(1, bits - 1)) == 0)
    out, start, n = [], 0, len(data)
    while start < n:
        end = min(start + most, n)
        middle = min(start + average, end)
        i = np.searchsorted(hard, start + least - 1)
        if i < len(hard) and hard[i] + 1 <= middle:
            end = int(hard[i]) + 1
        else:
            i = np.searchsorted(easy, max(middle, start + least - 1))
            if i < len(easy) and easy[i] + 1 <= end:
                end = int(easy[i]) + 1
        out.append((start, end - start))
        start = end
    return out


def with_content_cuts(objects: DataFrame, content_col: str, least: int, average: int, most: int, out: str = "cuts") -> DataFrame:
    """Add the array of content-defined cuts, computed by Arrow batches."""
    check_bounds(least, average, most)
    shipped(objects.sparkSession)
    kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(content_col)
            cuts = [[{"offset": o, "length": n} for o, n in content_cuts(c.as_py() or b"", least, average, most)] for c in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cuts, kind)], names=[*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in objects.schema)
    return objects.mapInArrow(of, f"{fields}, `{out}` array<struct<offset: bigint, length: bigint>>")


class Chunker(Protocol):
    """How objects are cut: adds a column ``cuts``, an array of ``(offset, length)``, for a binary column."""

    def with_cuts(self, objects: DataFrame, content_col: str) -> DataFrame: ...


@dataclass(frozen=True)
class FixedSize:
    """Blocks of one size; the last may be shorter."""

    size: int = DEFAULT_CHUNK_SIZE

    def __post_init__(self) -> None:
        if self.size <= 0:
            raise InvalidInput("chunk size must be positive")

    def with_cuts(self, objects: DataFrame, content_col: str) -> DataFrame:
        return objects.withColumn("cuts", fixed_cuts(F.col(content_col), self.size))


@dataclass(frozen=True)
class ContentDefined:
    """Cuts placed by the content, so that an insertion moves only the cuts near it."""

    least: int
    average: int
    most: int

    def __post_init__(self) -> None:
        check_bounds(self.least, self.average, self.most)

    def with_cuts(self, objects: DataFrame, content_col: str) -> DataFrame:
        return with_content_cuts(objects, content_col, self.least, self.average, self.most)


def prefix_of(hash: Column) -> Column:
    """The hash prefix that chunks are stored by: its first hex digit."""
    return F.lower(F.substring(F.hex(hash), 1, 1))


def staged_chunks(objects: DataFrame, content_col: str, cuts_col: str) -> DataFrame:
    """The objects with ``parts``, their chunks as ``(hash, length, data)`` in byte order, instead of content and cuts."""
    piece = lambda c: F.struct(chunk_hash(slice_of(F.col(content_col), c)).alias("hash"), c["length"].alias("length"), slice_of(F.col(content_col), c).alias("data"))
    return objects.withColumn("parts", F.transform(cuts_col, piece)).drop(content_col, cuts_col)


def fresh_keys(staged: DataFrame, stored: DataFrame | None, row: str) -> DataFrame:
    """``hash`` of chunks that are not stored yet with one place of each: ``row`` and ``at`` in its parts.

    Only hashes and places are read and moved, never bytes.
    """
    keys = staged.select(row, F.posexplode("parts.hash").alias("at", "hash"))
    once = keys.groupBy("hash").agg(F.min(F.struct(row, "at")).alias("_place"))
    if stored is not None:
        once = once.join(stored.select("hash"), "hash", "left_anti")
    return once.select("hash", f"_place.{row}", "_place.at")


def chunks_at(staged: DataFrame, places: DataFrame, row: str) -> DataFrame:
    """``hash, data, length`` of the chunks at given places, once each."""
    wanted = places.groupBy(row).agg(F.collect_list("at").alias("_at"))
    if places.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    kept = staged.select(row, "parts").join(wanted, row)
    kept = kept.select(F.explode(F.transform("_at", lambda i: F.get("parts", i))).alias("c"))
    return kept.select("c.hash", "c.data", "c.length")


def new_chunks(chunks: DataFrame, stored: DataFrame | None) -> DataFrame:
    """``hash, data, length`` of chunks that are not stored yet, once each; for chunks that are at hand as rows."""
    rows = chunks.select("hash", "data", "length")
    if stored is not None:
        rows = rows.join(stored.select("hash"), "hash", "left_anti")
    return rows.dropDuplicates(["hash"])


def chunk_key(hash_hex: Column) -> Column:
    """The storage key of a chunk: two levels of two hex digits each, then the hash."""
    return F.concat_ws("/", F.lit("chunks"), F.substring(hash_hex, 1, 2), F.substring(hash_hex, 3, 2), hash_hex)


def object_chunks(objects: DataFrame, chunks: DataFrame, id_col: str = "path") -> DataFrame:
    """``id, chunk_index, length, data``: the chunks of each object; missing ones have null data."""
    refs = objects.select(id_col, F.posexplode("chunks").alias("chunk_index", "hash"))
    return refs.join(chunks.select("hash", "length", "data"), "hash", "left").drop("hash")


def assembled(objects: DataFrame, chunks: DataFrame, id_col: str = "path") -> DataFrame:
    """``id, content``: each object's bytes, its chunks in list order; empty for no chunks, null if one is missing.

    A value of Spark holds 2 GiB at most; larger objects can be read as rows of :func:`object_chunks`.
    """
    parts = object_chunks(objects, chunks, id_col)
    grouped = parts.sparkSession.sql(
        f"SELECT `{id_col}`, CASE WHEN count(data) = count(*) THEN listagg(data) WITHIN GROUP (ORDER BY chunk_index) END AS content, true AS _has FROM {{parts}} GROUP BY `{id_col}`", parts=parts
    )
    out = objects.select(id_col).join(grouped, id_col, "left")
    return out.select(id_col, F.when(F.col("_has"), F.col("content")).otherwise(F.lit(b"")).alias("content"))


def orphan_chunks(mutations: DataFrame, chunks: DataFrame) -> DataFrame:
    """``hash, length`` of stored chunks that no change names; a report, nothing is deleted."""
    used = mutations.select(F.explode("chunks").alias("hash"))
    return chunks.select("hash", "length").join(used, "hash", "left_anti")
