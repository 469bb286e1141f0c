"""Tables and records of a versioned collection."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

#: Append-only change log of all segments; ``(node_id, lsn)`` names a change.
MUTATIONS = T.StructType(
    [
        T.StructField("project_id", T.StringType()),
        T.StructField("node_id", T.LongType()),
        T.StructField("lsn", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("chunks", T.ArrayType(T.BinaryType())),
        T.StructField("size", T.LongType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("tombstone", T.BooleanType()),
        T.StructField("created_at", T.LongType()),
    ]
)
CHUNKS = T.StructType([T.StructField("hash", T.BinaryType()), T.StructField("data", T.BinaryType()), T.StructField("length", T.LongType())])
PROJECTS = T.StructType([T.StructField("project_id", T.StringType()), T.StructField("root_branch_id", T.StringType()), T.StructField("created_at", T.LongType())])
HANDLES = T.StructType(
    [
        T.StructField("project_id", T.StringType()),
        T.StructField("branch_id", T.StringType()),
        T.StructField("node_id", T.LongType()),
        T.StructField("parent_branch_id", T.StringType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("commit_seq", T.LongType()),
    ]
)
NODES = T.StructType(
    [
        T.StructField("project_id", T.StringType()),
        T.StructField("node_id", T.LongType()),
        T.StructField("parent_node_id", T.LongType()),
        T.StructField("fork_lsn", T.LongType()),
    ]
)
SNAPSHOTS = T.StructType(
    [
        T.StructField("project_id", T.StringType()),
        T.StructField("snapshot_id", T.StringType()),
        T.StructField("branch_id", T.StringType()),
        T.StructField("lsn", T.LongType()),
        T.StructField("node_id", T.LongType()),
        T.StructField("created_at", T.LongType()),
    ]
)
TABLES = {"mutations": MUTATIONS, "chunks": CHUNKS}

DEFAULT_CONTENT_TYPE = "application/octet-stream"
#: Page sizes: default for metadata, default for objects, greatest.
PAGE, OBJECT_PAGE, MAX_PAGE = 20, 100, 1000


@dataclass(frozen=True)
class Project:
    project_id: str
    root_branch_id: str
    created_at: int


@dataclass(frozen=True)
class BranchInfo:
    branch_id: str
    parent_id: str | None
    fork_lsn: int | None
    head_lsn: int
    created_at: int


@dataclass(frozen=True)
class Snapshot:
    snapshot_id: str
    branch_id: str
    lsn: int
    created_at: int


@dataclass(frozen=True)
class ObjectEntry:
    path: str
    lsn: int
    size: int
    content_type: str


@dataclass(frozen=True)
class ObjectMeta:
    path: str
    lsn: int
    size: int
    content_type: str
    created_at: int
    chunks: list[bytes] = field(default_factory=list)


@dataclass(frozen=True)
class PutResult:
    lsn: int
    size: int


@dataclass(frozen=True)
class Page:
    items: list[Any]
    next_cursor: str | None
    has_more: bool
    common_prefixes: list[str] = field(default_factory=list)
