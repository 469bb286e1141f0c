"""The engine: projects, branches, snapshots and objects over a warehouse folder.

Metadata lives in the commit log and on the driver, one small row per branch or snapshot. Changes and chunks are Parquet
folders, each of one segment and one commit, named by the log together with their position range: a read takes just the
folders of its chain whose range it needs. A fork writes one small file, whatever the branch holds.
"""

from __future__ import annotations

import secrets
import string
import time
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any, TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline import chunking, lineage, resolve, stores
from forkline.commitlog import CommitLog, State
from forkline.errors import (
    BranchHasChildren, BranchIsRoot, BranchNotFound, ChunkStoreError, Conflict, InvalidCursor, InvalidInput, InvalidRestoreLsn,
    ObjectNotFound, ProjectAlreadyExists, ProjectNotFound, SnapshotNotFound, StorageError,
)
from forkline.operators.ordering import numbered
from forkline.sources import tidy, written
from forkline.schema import (
    CHUNKS, DEFAULT_CONTENT_TYPE, HANDLES, MAX_PAGE, MUTATIONS, NODES, OBJECT_PAGE, PAGE, PROJECTS, SNAPSHOTS, BranchInfo, ObjectEntry,
    ObjectMeta, Page, Project, PutResult, Snapshot,
)

T = TypeVar("T")
_SHAPES = ("amber", "brisk", "calm", "deep", "even", "fair", "grand", "keen")
_THINGS = ("arch", "brook", "cliff", "dune", "field", "gate", "hill", "isle")
#: How often a lost race is run again before it is a Conflict.
RETRIES = 20
#: Bytes of chunks that one file has after a compaction, about.
CHUNK_FILE = 1 << 30
BAD_PATH = "paths must not be null or hold NUL"


def _now() -> int:
    return time.time_ns() // 1_000_000


def _slug(kind: str) -> str:
    tail = "".join(secrets.choice(string.ascii_letters + string.digits) for _ in range(10))
    return f"{kind}-{secrets.choice(_SHAPES)}-{secrets.choice(_THINGS)}-{tail}"


def _node_id() -> int:
    return secrets.randbits(62)


class Engine:
    def __init__(
        self, spark: SparkSession, root: str, chunk_size: int | None = None, chunker: chunking.Chunker | None = None,
        log: stores.Log | None = None, chunks: stores.ChunkStore | None = None, numbering: stores.Numbering = stores.dense,
    ):
        """``chunker`` says how objects are cut; by default into blocks of ``chunk_size`` bytes.

        Commits, chunks and positions can come from elsewhere: see :mod:`forkline.stores`.
        """
        if chunk_size is not None and chunker is not None:
            raise InvalidInput("give a chunk size or a chunker, not both")
        self.spark = spark
        self.chunker = chunker or chunking.FixedSize(chunking.DEFAULT_CHUNK_SIZE if chunk_size is None else chunk_size)
        self.log = log or CommitLog(spark, root)
        self.chunks = chunks or stores.PrefixFolders(spark)
        self.numbering = numbering

    # state

    def _retried(self, step: Callable[[State], tuple[dict[str, Any], T]]) -> T:
        """Run ``step`` on the newest state and publish what it returns; again if another commit came first."""
        for _ in range(RETRIES):
            state = self.log.refresh()
            seq = state.seq
            actions, result = step(state)
            if not actions:
                return result
            try:
                self.log.publish(seq, actions)
            except Conflict:
                continue
            return result
        raise Conflict("too many other commits")

    def _project(self, state: State, project: str) -> dict:
        if project not in state.projects:
            raise ProjectNotFound(project)
        return state.projects[project]

    def _branch(self, state: State, project: str, branch: str) -> tuple[dict, dict]:
        handle = state.handles.get((project, branch))
        if handle is None:
            raise BranchNotFound(branch)
        return handle, state.nodes[handle["node_id"]]

    @staticmethod
    def _head(state: State, handle: dict) -> int:
        """The newest position: never below the fork, nor below one that the branch ever had."""
        node = state.nodes[handle["node_id"]]
        return max(node["fork_lsn"] or 0, state.heads.get(node["node_id"], 0), handle.get("high") or 0)

    def _info(self, state: State, handle: dict) -> BranchInfo:
        node = state.nodes[handle["node_id"]]
        fork = node["fork_lsn"] if handle["parent_branch_id"] is not None else None
        return BranchInfo(handle["branch_id"], handle["parent_branch_id"], fork, self._head(state, handle), handle["created_at"])

    # projects

    def create_project(self, project_id: str | None = None) -> Project:
        def step(state: State):
            project = project_id or _slug("prj")
            if project in state.projects:
                raise ProjectAlreadyExists(project)
            row = {"project_id": project, "root_branch_id": _slug("br"), "created_at": _now()}
            node = {"project_id": project, "node_id": _node_id(), "parent_node_id": None, "fork_lsn": None}
            handle = {"project_id": project, "branch_id": row["root_branch_id"], "node_id": node["node_id"], "parent_branch_id": None, "created_at": row["created_at"]}
            return {"projects": [row], "nodes": [node], "handles": [handle]}, Project(**row)

        return self._retried(step)

    def get_project(self, project: str) -> Project:
        return Project(**self._project(self.log.refresh(), project))

    def list_projects(self, cursor: str | None = None, limit: int | None = None) -> Page:
        state = self.log.refresh()
        return self._page(sorted(list(state.projects)), lambda k: Project(**state.projects[k]), cursor, limit)

    def delete_project(self, project: str) -> None:
        def step(state: State):
            self._project(state, project)
            return {"deleted_projects": [project]}, None

        self._retried(step)

    def _page(self, keys: list[str], make: Callable[[str], Any], cursor: str | None, limit: int | None) -> Page:
        size = resolve.page_size(limit, PAGE, MAX_PAGE)
        after = resolve.decode_cursor(cursor)
        if after is not None and after not in keys:
            raise InvalidCursor(cursor or "")
        keys = sorted((k for k in keys if after is None or k.encode() > after.encode()), key=str.encode)
        taken = keys[:size]
        more = len(keys) > size
        return Page([make(k) for k in taken], resolve.encode_cursor(taken[-1]) if more else None, more)

    # branches

    def _forked(self, state: State, project: str, source: str, lsn: int | None) -> tuple[dict[str, Any], BranchInfo]:
        self._project(state, project)
        handle, node = self._branch(state, project, source)
        head = self._head(state, handle)
        if lsn is not None and not 0 <= lsn <= head:
            raise InvalidRestoreLsn(f"{lsn} is not in 0..{head}")
        at = head if lsn is None else lsn
        new = {"project_id": project, "node_id": _node_id(), "parent_node_id": node["node_id"], "fork_lsn": at}
        row = {"project_id": project, "branch_id": _slug("br"), "node_id": new["node_id"], "parent_branch_id": source, "created_at": _now()}
        return {"nodes": [new], "handles": [row]}, BranchInfo(row["branch_id"], source, at, at, row["created_at"])

    def create_branch(self, project: str, source_branch_id: str) -> BranchInfo:
        """Fork at the source's head."""
        return self._retried(lambda state: self._forked(state, project, source_branch_id, None))

    def fork_at_lsn(self, project: str, branch: str, lsn: int | None = None, snapshot_id: str | None = None) -> BranchInfo:
        """Fork at a position, which may lie before the source's own fork."""
        at = self.resolve_lsn(project, branch, lsn, snapshot_id)
        return self._retried(lambda state: self._forked(state, project, branch, at))

    def get_branch(self, project: str, branch: str) -> BranchInfo:
        state = self.log.refresh()
        self._project(state, project)
        return self._info(state, self._branch(state, project, branch)[0])

    def list_branches(self, project: str, cursor: str | None = None, limit: int | None = None) -> Page:
        state = self.log.refresh()
        self._project(state, project)
        keys = [b for p, b in list(state.handles) if p == project]
        return self._page(keys, lambda b: self._info(state, state.handles[project, b]), cursor, limit)

    def list_children(self, project: str, branch: str) -> list[str]:
        return self._children(self.log.refresh(), project, branch)

    @staticmethod
    def _children(state: State, project: str, branch: str) -> list[str]:
        return sorted(b for (p, b), h in list(state.handles.items()) if p == project and h["parent_branch_id"] == branch)

    def restore(self, project: str, branch: str, lsn: int | None = None, snapshot_id: str | None = None) -> tuple[BranchInfo, BranchInfo]:
        """Rewind a branch in place; a new child branch keeps its whole history. One commit does both."""
        at = self.resolve_lsn(project, branch, lsn, snapshot_id)

        def step(state: State):
            self._project(state, project)
            handle, node = self._branch(state, project, branch)
            head = self._head(state, handle)
            if not 0 <= at <= head:
                raise InvalidRestoreLsn(f"{at} is not in 0..{head}")
            new = {"project_id": project, "node_id": _node_id(), "parent_node_id": node["node_id"], "fork_lsn": at}
            backup = {"project_id": project, "branch_id": _slug("br"), "node_id": node["node_id"], "parent_branch_id": branch, "created_at": _now(), "high": head}
            moved = {k: v for k, v in handle.items() if k != "commit_seq"} | {"node_id": new["node_id"], "high": head}
            fork = None if handle["parent_branch_id"] is None else at
            infos = BranchInfo(branch, handle["parent_branch_id"], fork, head, handle["created_at"]), BranchInfo(backup["branch_id"], branch, node["fork_lsn"], head, backup["created_at"])
            return {"nodes": [new], "handles": [backup, moved]}, infos

        return self._retried(step)

    def reset_from_parent(self, project: str, branch: str) -> BranchInfo:
        """Start a branch anew from its parent's current segment and head, under the same id."""

        def step(state: State):
            self._project(state, project)
            handle, _ = self._branch(state, project, branch)
            if handle["parent_branch_id"] is None:
                raise BranchIsRoot(branch)
            parent, node = self._branch(state, project, handle["parent_branch_id"])
            at, head = self._head(state, parent), self._head(state, handle)
            new = {"project_id": project, "node_id": _node_id(), "parent_node_id": node["node_id"], "fork_lsn": at}
            moved = {k: v for k, v in handle.items() if k != "commit_seq"} | {"node_id": new["node_id"], "high": head}
            return {"nodes": [new], "handles": [moved]}, BranchInfo(branch, handle["parent_branch_id"], at, max(at, head), handle["created_at"])

        return self._retried(step)

    def merge(self, project: str, source: str) -> tuple[BranchInfo, int]:
        """Append the newest change per path of the source's own segment to its parent, numbered in path order.

        Another change of the source or the target branch between reading and publishing is a Conflict; commits to
        other branches are none.
        """

        def view(state: State):
            """What a merge depends on."""
            self._project(state, project)
            handle, _ = self._branch(state, project, source)
            if handle["parent_branch_id"] is None:
                raise BranchIsRoot(source)
            if self._children(state, project, source):
                raise BranchHasChildren(source)
            target, _ = self._branch(state, project, handle["parent_branch_id"])
            return handle, target, self._head(state, handle), self._head(state, target)

        state = self.log.refresh()
        seen = view(state)
        handle, target, _, head = seen
        records = resolve.merge_records(self._log_of(state, [(handle["node_id"], lineage.NO_CAP)]), handle["node_id"])
        first = self._first(head)
        rows, n = numbered(records.drop("lsn"), [F.col("path")], first, "lsn")
        if n == 0:
            return self._info(state, target), 0
        actions = self._appended(rows, project, target["node_id"], first, first + n - 1)

        def step(now: State):
            if view(now) != seen:
                raise Conflict("the branches changed during the merge")
            return actions, None

        self._retried(step)
        return self._info(self.log.state, self.log.state.handles[project, target["branch_id"]]), n

    def delete_branch(self, project: str, branch: str) -> None:
        """Take a branch away; not the root, nor one with children. Its segments stay for those who see them."""

        def step(state: State):
            self._project(state, project)
            handle, _ = self._branch(state, project, branch)
            if handle["parent_branch_id"] is None:
                raise BranchIsRoot(branch)
            if self._children(state, project, branch):
                raise BranchHasChildren(branch)
            return {"deleted_branches": [[project, branch]]}, None

        self._retried(step)

    # snapshots

    def create_snapshot(self, project: str, branch: str) -> Snapshot:
        def step(state: State):
            self._project(state, project)
            handle, _ = self._branch(state, project, branch)
            row = {"project_id": project, "snapshot_id": _slug("sc"), "branch_id": branch, "lsn": self._head(state, handle), "node_id": handle["node_id"], "created_at": _now()}
            return {"snapshots": [row]}, Snapshot(row["snapshot_id"], branch, row["lsn"], row["created_at"])

        return self._retried(step)

    def get_snapshot(self, project: str, branch: str, snapshot_id: str) -> Snapshot:
        state = self.log.refresh()
        self._project(state, project)
        self._branch(state, project, branch)
        row = state.snapshots.get((project, branch, snapshot_id))
        if row is None:
            raise SnapshotNotFound(snapshot_id)
        return Snapshot(snapshot_id, branch, row["lsn"], row["created_at"])

    def list_snapshots(self, project: str, branch: str, cursor: str | None = None, limit: int | None = None) -> Page:
        state = self.log.refresh()
        self._project(state, project)
        self._branch(state, project, branch)
        rows = {s: r for (p, b, s), r in list(state.snapshots.items()) if (p, b) == (project, branch)}
        return self._page(list(rows), lambda s: Snapshot(s, branch, rows[s]["lsn"], rows[s]["created_at"]), cursor, limit)

    def delete_snapshot(self, project: str, branch: str, snapshot_id: str) -> None:
        def step(state: State):
            if (project, branch, snapshot_id) not in state.snapshots:
                raise SnapshotNotFound(snapshot_id)
            return {"deleted_snapshots": [[project, branch, snapshot_id]]}, None

        self._retried(step)

    def resolve_lsn(self, project: str, branch: str, lsn: int | None = None, snapshot_id: str | None = None) -> int:
        """Exactly one of a position and a snapshot of the same branch, as a position."""
        if (lsn is None) == (snapshot_id is None):
            raise InvalidInput("exactly one of lsn and snapshot_id must be given")
        return lsn if lsn is not None else self.get_snapshot(project, branch, snapshot_id).lsn

    # objects

    def _log_of(self, state: State, chain: list[tuple[int, int]]) -> DataFrame:
        """The change log, only of the chain's folders that reach below their caps."""
        paths = [x["path"] for n, cap in chain for x in state.logs.get(n, ()) if x["min_lsn"] <= cap]
        if not paths:
            return self.spark.createDataFrame([], MUTATIONS)
        return self.spark.read.schema(MUTATIONS).parquet(*paths)

    def _stored(self, state: State, hashes: Iterable[bytes] | None = None) -> DataFrame | None:
        """The stored chunks, of given hashes only what may hold them."""
        return self.chunks.open(state.chunks, hashes)

    def _kept(self, chunks: DataFrame) -> list[dict]:
        """Chunks written and named for a commit."""
        return self.chunks.keep(chunks, self.log.new_folder("chunks"))

    def _first(self, head: int) -> int:
        first = self.numbering(head)
        if first <= head:
            raise StorageError(f"position {first} is not after {head}")
        return first

    def _appended(self, rows: DataFrame, project: str, node_id: int, first: int, last: int) -> dict[str, Any]:
        """Write changes of one segment, sorted by path, and name them for a commit."""
        folder = self.log.new_folder("mutations")
        columns = {"project_id": F.lit(project), "node_id": F.lit(node_id).cast("bigint")}
        out = rows.withColumns(columns).select(*[F.col(f.name).cast(f.dataType) for f in MUTATIONS])
        out.sortWithinPartitions("path", F.col("lsn").desc()).write.option("compression", "zstd").parquet(folder)
        return {"logs": [{"node_id": node_id, "path": folder, "min_lsn": first, "max_lsn": last, "rows": last - first + 1}]}

    def _write(self, project: str, branch: str, rows: DataFrame, order: list[Column], chunks: list[dict] = (), cleanings: int | None = None, batch: dict[str, int] | None = None) -> tuple[int, int]:
        """Number and append changes to a branch; the numbers are taken anew if another commit comes first.

        With ``cleanings``, chunks that were taken away since then make it a Conflict: the changes may name one of them.
        """
        state = self.log.refresh()
        self._branch(state, project, branch)
        counted, n = numbered(rows, order, 0, "_at")
        extra = ({"chunks": list(chunks)} if chunks else {}) | ({"batches": batch} if batch else {})

        def step(now: State):
            handle, node = self._branch(now, project, branch)
            if chunks and cleanings is not None and now.cleanings != cleanings:
                raise Conflict("chunks were cleaned during the write")
            if batch and any(now.batches.get(k, -1) >= v for k, v in batch.items()):
                return {}, (self._head(now, handle), 0)
            if n == 0:
                return {"batches": batch} if batch else {}, (self._head(now, handle), 0)
            first = self._first(self._head(now, handle))
            actions = self._appended(counted.withColumn("lsn", F.col("_at") + first), project, node["node_id"], first, first + n - 1)
            return actions | extra, (first, n)

        return self._retried(step)

    def _checked(self, rows: DataFrame) -> DataFrame:
        """Rows whose path is missing or holds NUL are an error where they are read."""
        bad = F.col("path").isNull() | (F.instr("path", "\0") > 0)
        return rows.withColumn("path", F.when(bad, F.raise_error(F.lit(BAD_PATH))).otherwise(F.col("path")))

    @contextmanager
    def _paths_checked(self) -> Iterator[None]:
        try:
            yield
        except Exception as e:
            if BAD_PATH in str(e):
                raise InvalidInput(BAD_PATH) from e
            raise

    def put_objects(self, project: str, branch: str, objects: DataFrame, order: list[Column] | None = None, deleted: Column | None = None, batch: dict[str, int] | None = None) -> tuple[int, int]:
        """Write many objects, ``path, content[, content_type]``, in one commit; returns the first position and their number.

        Positions follow ``order``, by default path and content. Rows for which ``deleted`` holds become tombstones. The
        objects are read once, cut and staged where they are; which chunks are new is found from hashes alone, and only
        those are written, without moving bytes between tasks. Chunks are on disk before the commit names a change that
        refers to them. ``batch`` names a stream's batch, which is written once, however often it is run.
        """
        return self._put(project, branch, objects, order, deleted, batch)

    @tidy
    def _put(self, project: str, branch: str, objects: DataFrame, order: list[Column] | None, deleted: Column | None, batch: dict[str, int] | None) -> tuple[int, int]:
        state = self.log.refresh()
        self._branch(state, project, branch)
        cleanings = state.cleanings
        kind = F.col("content_type") if "content_type" in objects.columns else F.lit(None)
        extra = [c for c in objects.columns if c not in ("path", "content", "content_type")]
        gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
        rows = objects.select("path", gone.alias("_gone"), F.coalesce("content", F.lit(b"")).alias("content"), F.coalesce(kind, F.lit(DEFAULT_CONTENT_TYPE)).alias("content_type"), *extra)
        rows = rows.withColumns({"content": F.when(F.col("_gone"), F.lit(b"")).otherwise(F.col("content")), "content_type": F.when(F.col("_gone"), "").otherwise(F.col("content_type"))})
        rows = chunking.staged_chunks(self.chunker.with_cuts(self._checked(rows), "content"), "content", "cuts")
        folder = self.log.new_folder("staged")
        rows = rows.withColumn("_row", F.monotonically_increasing_id())
        with self._paths_checked():
            rows.write.option("compression", "lz4").parquet(folder)
        staged = self.spark.read.schema(rows.schema).parquet(folder)
        try:
            places = written(chunking.fresh_keys(staged, self._stored(state), "_row"))
            chunks = self._kept(chunking.chunks_at(staged, places, "_row"))
            size = F.aggregate("parts.length", F.lit(0).cast("bigint"), lambda a, x: a + x)
            hashed = staged.select(
                "path", *extra, F.col("parts.hash").alias("chunks"), size.alias("size"), "content_type", F.col("_gone").alias("tombstone"), F.lit(_now()).alias("created_at"),
            )
            return self._write(project, branch, hashed, order or [F.col("path"), F.col("chunks")], chunks, cleanings, batch)
        finally:
            self.log.files.delete(folder)

    def put_object(self, project: str, branch: str, path: str, content: bytes, content_type: str | None = None) -> PutResult:
        resolve.without_nul("path", path)
        self._branch(self.log.refresh(), project, branch)
        one = self.spark.createDataFrame([(path, bytearray(content), content_type)], "path string, content binary, content_type string")
        return PutResult(self.put_objects(project, branch, one)[0], len(content))

    def delete_objects(self, project: str, branch: str, paths: DataFrame) -> tuple[int, int]:
        """Append a tombstone for each ``path``, also where nothing was."""
        return self._delete(project, branch, paths)

    @tidy
    def _delete(self, project: str, branch: str, paths: DataFrame) -> tuple[int, int]:
        rows = self._checked(paths.select("path")).select("path", F.array().cast("array<binary>").alias("chunks"), F.lit(0).cast("bigint").alias("size"), F.lit("").alias("content_type"), F.lit(True).alias("tombstone"), F.lit(_now()).alias("created_at"))
        with self._paths_checked():
            return self._write(project, branch, rows, [F.col("path")])

    def delete_object(self, project: str, branch: str, path: str) -> int:
        resolve.without_nul("path", path)
        return self.delete_objects(project, branch, self.spark.createDataFrame([(path,)], "path string"))[0]

    def visible(self, project: str, branch: str, at_lsn: int | None = None, prefix: str | None = None, after: str | None = None, path: str | None = None) -> DataFrame:
        """The resolved view of a branch, as a DataFrame of changes."""
        state = self.log.refresh()
        handle, _ = self._branch(state, project, branch)
        chain = lineage.chain(state.nodes, handle["node_id"], at_lsn)
        return resolve.resolved(self._log_of(state, chain), chain, prefix, after, path)

    def list_objects(self, project: str, branch: str, prefix: str | None = None, cursor: str | None = None, limit: int | None = None, at_lsn: int | None = None, delimiter: str | None = None) -> Page:
        """A page of paths in bytewise order. With a delimiter, paths that go on after it are rolled up."""
        size = resolve.page_size(limit, OBJECT_PAGE, MAX_PAGE)
        after = resolve.decode_cursor(cursor)
        if prefix is not None:
            resolve.without_nul("prefix", prefix)
        view = self.visible(project, branch, at_lsn, prefix, after)
        if delimiter:
            entries = resolve.common_prefixes(view, prefix or "", delimiter)
            if after is not None:
                entries = entries.filter(F.col("entry") > after)
            taken = entries.orderBy("entry").limit(size + 1).collect()
            shown = taken[:size]
            names = [r["entry"] for r in shown if not r["is_prefix"]]
            rows = view.filter(F.col("path").isin(names)).select("path", "lsn", "size", "content_type").orderBy("path").collect() if names else []
            more = len(taken) > size
            return Page([ObjectEntry(**r.asDict()) for r in rows], resolve.encode_cursor(shown[-1]["entry"]) if more else None, more, [r["entry"] for r in shown if r["is_prefix"]])
        rows = resolve.listing(view, size + 1).collect()
        items = [ObjectEntry(**r.asDict()) for r in rows[:size]]
        more = len(rows) > size
        return Page(items, resolve.encode_cursor(items[-1].path) if more else None, more)

    def get_object_meta(self, project: str, branch: str, path: str, at_lsn: int | None = None) -> ObjectMeta:
        rows = self.visible(project, branch, at_lsn, path=resolve.without_nul("path", path)).collect()
        if not rows:
            raise ObjectNotFound(path)
        r = rows[0]
        return ObjectMeta(path, r["lsn"], r["size"], r["content_type"], r["created_at"], [bytes(h) for h in r["chunks"]])

    def get_object(self, project: str, branch: str, path: str, at_lsn: int | None = None) -> bytes:
        meta = self.get_object_meta(project, branch, path, at_lsn)
        if not meta.chunks:
            return b""
        wanted = [bytearray(h) for h in set(meta.chunks)]
        stored = self._stored(self.log.state, meta.chunks)
        data = {bytes(r["hash"]): bytes(r["data"]) for r in stored.filter(F.col("hash").isin(wanted)).select("hash", "data").collect()} if stored is not None else {}
        if missing := [h.hex() for h in meta.chunks if h not in data]:
            raise ChunkStoreError(f"chunk {missing[0]} is missing")
        return b"".join(data[h] for h in meta.chunks)

    def iter_object(self, project: str, branch: str, path: str, at_lsn: int | None = None) -> Iterator[bytes]:
        """The object chunk by chunk, for objects that the driver cannot hold whole."""
        meta = self.get_object_meta(project, branch, path, at_lsn)
        for h in meta.chunks:
            stored = self._stored(self.log.state, [h])
            row = stored.filter(F.col("hash") == F.lit(bytearray(h))).select("data").first() if stored is not None else None
            if row is None:
                raise ChunkStoreError(f"chunk {h.hex()} is missing")
            yield bytes(row["data"])

    def get_objects(self, project: str, branch: str, paths: DataFrame | None = None, at_lsn: int | None = None) -> DataFrame:
        """``path, content`` of many objects at once; paths that show nothing have no row."""
        view = self.visible(project, branch, at_lsn)
        if paths is not None:
            view = view.join(paths.select("path").distinct(), "path", "left_semi")
        stored = self._stored(self.log.state)
        return chunking.assembled(view, stored if stored is not None else self.spark.createDataFrame([], CHUNKS))

    def resolve(self, project: str, branch: str, paths: DataFrame, at_lsn: int | None = None) -> DataFrame:
        """The versions that a branch shows of the given paths."""
        return self.visible(project, branch, at_lsn).join(paths.select("path").distinct(), "path", "left_semi")

    # tables and upkeep

    def frame(self, table: str) -> DataFrame:
        """A table of the collection: projects, branch_handles, branch_nodes, snapshots, mutations or chunks."""
        state = self.log.refresh()
        if table == "mutations":
            return self._log_of(state, [(n, lineage.NO_CAP) for n in state.logs])
        if table == "chunks":
            stored = self._stored(state)
            return stored if stored is not None else self.spark.createDataFrame([], CHUNKS)
        kind, rows = {
            "projects": (PROJECTS, state.projects), "branch_handles": (HANDLES, state.handles), "branch_nodes": (NODES, state.nodes), "snapshots": (SNAPSHOTS, state.snapshots),
        }[table]
        return self.spark.createDataFrame([tuple(r.get(f.name) for f in kind) for r in rows.values()], kind)

    def orphan_chunks(self) -> DataFrame:
        return chunking.orphan_chunks(self.frame("mutations"), self.frame("chunks"))

    def compact(self, project: str, branch: str) -> int:
        """Rewrite a branch's own segment into one folder; returns how many folders went into it. Nothing visible changes."""
        state = self.log.refresh()
        seq = state.seq
        _, node = self._branch(state, project, branch)
        logs = state.logs.get(node["node_id"], [])
        if len(logs) < 2:
            return 0
        rows = self._log_of(state, [(node["node_id"], lineage.NO_CAP)])
        actions = self._appended(rows, project, node["node_id"], min(x["min_lsn"] for x in logs), max(x["max_lsn"] for x in logs))
        self.log.publish(seq, actions | {"replaces": [x["path"] for x in logs]})
        return len(logs)

    def compact_chunks(self, clean: bool = False) -> int:
        """Rewrite all chunks into one folder, each once, in order of hash; returns how many folders went into it.

        With ``clean``, chunks that no change names are left out, except where a write that is under way would notice: it
        then fails as a Conflict. Files of the old folders stay until :meth:`vacuum`.
        """
        state = self.log.refresh()
        seq = state.seq
        stored = self._stored(state)
        if stored is None or (len(state.chunks) < 2 and not clean):
            return 0
        if clean:
            logs = self._log_of(state, [(n, lineage.NO_CAP) for n in state.logs])
            stored = stored.join(logs.select(F.explode("chunks").alias("hash")).distinct(), "hash", "left_semi")
        size = max(1, int(stored.agg(F.sum("length")).first()[0] or 0) // CHUNK_FILE)
        once = stored.dropDuplicates(["hash"]) if len(state.chunks) > 1 else stored
        kept = self._kept(once.repartitionByRange(min(16 + size, 100_000), "hash"))
        old = [c["path"] for c in state.chunks]
        self.log.publish(seq, {"chunks": kept, "replaces": old, "cleaned": clean})
        return len(old)

    def vacuum(self, hours: float = 24 * 7) -> int:
        """Delete data folders that no commit in force names and that are older; returns how many.

        They come from lost races, failed writes and compactions. The age must exceed the longest write and read.
        """
        gone = self.log.unnamed(_now() - int(hours * 3_600_000))
        for path in gone:
            self.log.files.delete(path)
        return len(gone)
