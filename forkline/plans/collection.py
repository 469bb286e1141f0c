"""Queries for the operators of a versioned collection, over the collection derived from events and over documents."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline import chunking, config, errors, lineage, resolve, streaming
from forkline.api import Engine
from forkline.fixtures import HANDLES, Collection, derived_collection
from forkline.operators.ordering import numbered
from forkline.sources import shared_folder, table

CHUNK = 1024
VIEW = ["path", "lsn", "size", "content_type", "created_at"]
PREFIX, AFTER, PAGE_ROWS = "user/00000", "user/000003/obj-2", 11
HIT, DELETED, INHERITED = "user/000010/obj-3", "user/000000/obj-0", "user/000001/obj-1"


def _view(c: Collection, branch: str, at: int | None = None, **how) -> DataFrame:
    chain = lineage.chain(c.nodes, HANDLES[branch][0], at)
    return resolve.resolved(c.log, chain, **how).select(*VIEW)


def _over(make: Callable[[Collection], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: make(derived_collection(spark, folder))


def _chain(c: Collection, branch: str) -> DataFrame:
    return lineage.chain_frame(c.log.sparkSession, lineage.chain(c.nodes, HANDLES[branch][0]))


def _changed(c: Collection, new: dict) -> DataFrame:
    """The view of a new segment that a fork, restore or reset would make."""
    chain = lineage.chain(c.nodes | {new["node_id"]: new}, new["node_id"])
    return resolve.resolved(c.log, chain).select("path", "lsn", "size")


def _head(c: Collection, node: int) -> int:
    newest = c.log.filter(F.col("node_id") == node).agg(F.max("lsn")).first()[0]
    return max(newest or 0, c.nodes[node]["fork_lsn"] or 0)


def _merge(c: Collection) -> DataFrame:
    """Staging's own layer as appended to dev's current segment."""
    records = resolve.merge_records(c.log, HANDLES["staging"][0])
    rows, _ = numbered(records.drop("lsn"), [F.col("path")], _head(c, HANDLES["dev"][0]) + 1, "lsn")
    return rows.withColumn("node_id", F.lit(HANDLES["dev"][0]).cast("bigint")).select(*c.log.columns)


def _merged_view(c: Collection) -> DataFrame:
    chain = lineage.chain(c.nodes, HANDLES["dev"][0])
    return resolve.resolved(c.log.unionByName(_merge(c)), chain).select(*VIEW)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    return docs.withColumn("cuts", chunking.fixed_cuts(F.col("content"), CHUNK))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunking.chunks_of(_documents(spark, folder), "doc_id", "content", "cuts")
    return rows.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "offset", "length", F.lower(F.hex("hash")).alias("hash"), F.col("hash").alias("raw"), "data")


def chunks_fixed_1024(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).drop("raw", "data")


def chunk_dedup_stats(spark: SparkSession, folder: str) -> DataFrame:
    per = _chunks(spark, folder).groupBy("raw").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("length"))
    return per.agg(F.sum("n").alias("n_chunks"), F.count(F.lit(1)).alias("n_distinct"), F.sum(F.col("n") * F.col("length")).alias("bytes"), F.sum("length").alias("stored_bytes"))


def chunk_keys(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).select("hash").distinct().select("hash", chunking.chunk_key(F.col("hash")).alias("key"))


def shared_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).groupBy("hash").agg(F.count(F.lit(1)).alias("refs")).filter("refs > 1")


def object_reassembly(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    stored = chunking.new_chunks(chunking.chunks_of(docs, "doc_id", "content", "cuts"), None)
    objects = docs.select("doc_id", chunking.hash_list(F.col("content"), F.col("cuts")).alias("chunks"))
    whole = chunking.assembled(objects, stored, "doc_id")
    return whole.select("doc_id", F.octet_length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256"))


def content_chunk_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Content-defined chunks put together again: the size and hash of every document."""
    docs = chunking.with_content_cuts(_documents(spark, folder).drop("cuts"), "content", 256, 1024, 4096)
    parts = F.transform("cuts", lambda c: F.hex(chunking.slice_of(F.col("content"), c)))
    return docs.select("doc_id", F.aggregate("cuts", F.lit(0).cast("bigint"), lambda a, c: a + c["length"]).alias("size"), F.sha2(F.unhex(F.array_join(parts, "")), 256).alias("sha256"))


def content_chunk_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Per document whether its content-defined chunks follow each other, none too long and only the last too short; and those that occur twice."""
    docs = chunking.with_content_cuts(_documents(spark, folder).drop("cuts"), "content", 256, 1024, 4096)
    last = F.size("cuts") - 1
    follow = F.forall(F.sequence(F.lit(1), last), lambda i: F.get("cuts", i)["offset"] == F.get("cuts", i - 1)["offset"] + F.get("cuts", i - 1)["length"])
    full = F.forall(F.transform("cuts", lambda c, i: (c["length"] <= 4096) & ((c["length"] >= 256) | (i == last))), lambda ok: ok)
    total = F.aggregate("cuts", F.lit(0).cast("bigint"), lambda a, c: a + c["length"])
    return docs.select("doc_id", (F.when(last > 0, follow).otherwise(True) & full).alias("within"), (total == F.octet_length("content")).alias("whole"))


def chunk_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Stored chunks that no change names."""
    refs = table(spark, folder, "mutations").select(F.transform("chunks", F.lower).alias("chunks"))
    stored = table(spark, folder, "chunks").groupBy(F.lower("hash").alias("hash")).agg(F.max("length").alias("length"))
    return chunking.orphan_chunks(refs, stored)


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark, f"{shared_folder(spark)}/collection-{uuid.uuid4().hex}", chunk_size=CHUNK)


def _path() -> Column:
    return F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 10, "0"))


def _bulk(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select(_path().alias("path"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"), F.coalesce("source", F.lit("none")).alias("content_type"))


def engine_bulk_put(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written to a new branch, as it lists them."""
    engine = _engine(spark)
    p = engine.create_project()
    engine.put_objects(p.project_id, p.root_branch_id, _bulk(spark, folder))
    return engine.visible(p.project_id, p.root_branch_id).select("path", "lsn", "size", "content_type")


def engine_read_back(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written and read back from their chunks."""
    engine = _engine(spark)
    p = engine.create_project()
    engine.put_objects(p.project_id, p.root_branch_id, _bulk(spark, folder))
    return engine.get_objects(p.project_id, p.root_branch_id).select("path", F.sha2("content", 256).alias("sha256"))


def engine_fork_merge(spark: SparkSession, folder: str) -> DataFrame:
    """English documents put on main, the others on a fork that also deletes some of main's; the fork is merged."""
    engine = _engine(spark)
    p = engine.create_project()
    rows = _bulk(spark, folder)
    main = rows.filter(F.col("path").startswith("en/"))
    engine.put_objects(p.project_id, p.root_branch_id, main)
    fork = engine.create_branch(p.project_id, p.root_branch_id)
    engine.put_objects(p.project_id, fork.branch_id, rows.filter(~F.col("path").startswith("en/")))
    engine.delete_objects(p.project_id, fork.branch_id, main.filter(F.col("path").endswith("7")).select("path"))
    engine.merge(p.project_id, fork.branch_id)
    return engine.visible(p.project_id, p.root_branch_id).select("path", "lsn", "size")


SEEN = ["path", "lsn", "size"]


def _two_layers(spark: SparkSession, folder: str) -> tuple[Engine, str, str, str, int]:
    """A project with English documents on main, put twice, and the others on a fork: engine, project, main, fork, English ones."""
    engine = _engine(spark)
    p = engine.create_project()
    rows = _bulk(spark, folder)
    main = rows.filter(F.col("path").startswith("en/"))
    _, n = engine.put_objects(p.project_id, p.root_branch_id, main)
    fork = engine.create_branch(p.project_id, p.root_branch_id).branch_id
    engine.put_objects(p.project_id, p.root_branch_id, main)
    engine.put_objects(p.project_id, fork, rows.filter(~F.col("path").startswith("en/")))
    return engine, p.project_id, p.root_branch_id, fork, n


def engine_fork_at_lsn(spark: SparkSession, folder: str) -> DataFrame:
    """A fork of the fork at half of main's first put."""
    engine, p, _, fork, n = _two_layers(spark, folder)
    return engine.visible(p, engine.fork_at_lsn(p, fork, n // 2).branch_id).select(SEEN)


def engine_restore(spark: SparkSession, folder: str) -> DataFrame:
    """The fork restored to ten changes after its fork, and the branch that keeps what it had."""
    engine, p, _, fork, n = _two_layers(spark, folder)
    info, backup = engine.restore(p, fork, n + 10)
    of = lambda kind, b, i: engine.visible(p, b).select(F.lit(kind).alias("kind"), *SEEN, F.lit(i.head_lsn).cast("bigint").alias("head_lsn"))
    return of("restored", fork, info).unionByName(of("backup", backup.branch_id, backup))


def engine_reset(spark: SparkSession, folder: str) -> DataFrame:
    """The fork started anew from main as it is now, and the next position it would use."""
    engine, p, _, fork, _ = _two_layers(spark, folder)
    engine.reset_from_parent(p, fork)
    lsn = engine.delete_object(p, fork, "none such")
    return engine.visible(p, fork).select(*SEEN, F.lit(lsn).cast("bigint").alias("next_lsn"))


def engine_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Main as its snapshot before the second put names it, through the snapshot's position, and its metadata."""
    engine = _engine(spark)
    p = engine.create_project()
    main = p.root_branch_id
    rows = _bulk(spark, folder)
    engine.put_objects(p.project_id, main, rows)
    first = engine.create_snapshot(p.project_id, main)
    engine.delete_objects(p.project_id, main, rows.filter(F.col("path").endswith("7")).select("path"))
    second = engine.create_snapshot(p.project_id, main)
    engine.put_objects(p.project_id, main, rows)
    engine.delete_snapshot(p.project_id, main, engine.create_snapshot(p.project_id, main).snapshot_id)
    listed = {s.snapshot_id for s in engine.list_snapshots(p.project_id, main).items}
    kept = [("first", first), ("second", second)]
    views = [
        engine.visible(p.project_id, main, engine.resolve_lsn(p.project_id, main, snapshot_id=s.snapshot_id)).select(
            F.lit(name).alias("name"), *SEEN, F.lit(engine.get_snapshot(p.project_id, main, s.snapshot_id).lsn).cast("bigint").alias("at"), F.lit(len(listed)).cast("bigint").alias("n_snapshots")
        )
        for name, s in kept if s.snapshot_id in listed
    ]
    return views[0].unionByName(views[1])


def engine_pages(spark: SparkSession, folder: str) -> DataFrame:
    """All of main by cursors, with the page that each path was on."""
    engine, p, main, _, _ = _two_layers(spark, folder)
    out, cursor, more = [], None, True
    while more:
        page = engine.list_objects(p, main, prefix="en/", cursor=cursor, limit=100)
        out += [(i, o.path, o.lsn) for i, o in enumerate(page.items, len(out))]
        cursor, more = page.next_cursor, page.has_more
    return spark.createDataFrame(out, "place bigint, path string, lsn bigint")


def engine_bulk_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Deletes on the fork: of its own paths, of main's and of one that never was; main shows none of them."""
    engine, p, main, fork, _ = _two_layers(spark, folder)
    paths = _bulk(spark, folder).filter(F.col("path").endswith("3")).select("path").unionByName(spark.createDataFrame([("none such",)], "path string"))
    engine.delete_objects(p, fork, paths)
    of = lambda kind, b: engine.visible(p, b).select(F.lit(kind).alias("kind"), *SEEN)
    return of("fork", fork).unionByName(of("main", main))


def engine_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Branches and children as the engine gives them, by their place in the tree."""
    engine, p, main, fork, _ = _two_layers(spark, folder)
    names = {main: "main", fork: "fork", None: None}
    infos = [engine.get_branch(p, b.branch_id) for b in engine.list_branches(p).items]
    rows = [(names[i.branch_id], names[i.parent_id], i.fork_lsn, i.head_lsn, len(engine.list_children(p, i.branch_id))) for i in infos]
    return spark.createDataFrame(rows, "branch string, parent string, fork_lsn bigint, head_lsn bigint, n_children bigint")


def engine_projects(spark: SparkSession, folder: str) -> DataFrame:
    """One project per language, listed by pages of two after one was deleted and one made twice; the page of each, and whether it is found by name."""
    engine = _engine(spark)
    names = sorted(r[0] for r in table(spark, folder, "documents").select(F.coalesce("lang", F.lit("none"))).distinct().collect())
    for name in ["gone", *names]:
        engine.create_project(name)
    engine.delete_project("gone")
    rows, cursor, more, page = [], None, True, 0
    while more:
        found = engine.list_projects(cursor, 2)
        rows += [(x.project_id, page, engine.get_project(x.project_id) == x) for x in found.items]
        cursor, more, page = found.next_cursor, found.has_more, page + 1
    return spark.createDataFrame(rows, "project_id string, page bigint, found boolean")


def engine_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """The longest document written by itself, and its first kilobyte over it: read whole, by chunks, and as it was, with what its head says."""
    engine = _engine(spark)
    p = engine.create_project()
    row = table(spark, folder, "documents").filter("text IS NOT NULL").orderBy(F.octet_length("text").desc(), "doc_id").select("text").first()
    data, main = row["text"].encode(), p.root_branch_id
    engine.put_object(p.project_id, main, "a", data, "text/plain")
    engine.put_object(p.project_id, main, "a", data[:CHUNK])
    rows = []
    for name, at in (("then", 1), ("now", None)):
        meta = engine.get_object_meta(p.project_id, main, "a", at)
        whole, parts = engine.get_object(p.project_id, main, "a", at), b"".join(engine.iter_object(p.project_id, main, "a", at))
        rows.append((name, meta.lsn, meta.size, meta.content_type, len(meta.chunks), hashlib.sha256(whole).hexdigest(), hashlib.sha256(parts).hexdigest()))
    return spark.createDataFrame(rows, "name string, lsn bigint, size bigint, content_type string, n_chunks bigint, whole string, parts string")


def engine_errors(spark: SparkSession, folder: str) -> DataFrame:
    """The code of each refused call, on a project with a fork of a fork."""
    engine, p, main, fork, n = _two_layers(spark, folder)
    child = engine.create_branch(p, fork).branch_id
    calls = {
        "get unknown project": lambda: engine.get_project("none"), "create it twice": lambda: engine.create_project(p), "get unknown branch": lambda: engine.get_branch(p, "none"),
        "read unknown path": lambda: engine.get_object(p, main, "none"), "get unknown snapshot": lambda: engine.get_snapshot(p, main, "none"), "delete unknown snapshot": lambda: engine.delete_snapshot(p, main, "none"),
        "delete a root": lambda: engine.delete_branch(p, main), "delete a parent": lambda: engine.delete_branch(p, fork), "merge a root": lambda: engine.merge(p, main), "merge a parent": lambda: engine.merge(p, fork),
        "reset a root": lambda: engine.reset_from_parent(p, main), "restore beyond the head": lambda: engine.restore(p, child, n + 10**9), "restore below zero": lambda: engine.restore(p, main, -1),
        "fork beyond the head": lambda: engine.fork_at_lsn(p, main, 3 * n + 1), "neither position nor snapshot": lambda: engine.restore(p, main), "both": lambda: engine.restore(p, main, 1, "x"),
        "bad cursor": lambda: engine.list_objects(p, main, cursor="%"), "unknown cursor": lambda: engine.list_projects(resolve.encode_cursor("none")), "too many": lambda: engine.list_objects(p, main, limit=1001),
        "NUL in a path": lambda: engine.put_object(p, main, "a\0", b""), "NUL in a prefix": lambda: engine.list_objects(p, main, prefix="\0"), "chunks of no size": lambda: Engine(spark, engine.log.root, chunk_size=0),
        "unknown chunker": lambda: config.settings({"FORKLINE__CHUNKER__TYPE": "other"}), "after all that": lambda: engine.get_branch(p, fork),
    }
    rows = []
    for name, call in calls.items():
        try:
            call()
            rows.append((name, "OK"))
        except errors.EngineError as e:
            rows.append((name, e.code))
    return spark.createDataFrame(rows, "call string, code string")


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as a stream into a branch, those whose name ends with 7 as deletes; run twice."""
    engine = _engine(spark)
    p = engine.create_project()
    kind = spark.read.parquet(f"{folder}/documents.parquet").schema
    for _ in range(2):
        docs = spark.readStream.schema(kind).option("pathGlobFilter", "documents.parquet").parquet(folder)
        rows = docs.select(_path().alias("path"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"), _path().endswith("7").alias("deleted"))
        streaming.ingest(rows, engine, p.project_id, p.root_branch_id, f"{engine.log.root}/_streams/documents").awaitTermination()
    return engine.visible(p.project_id, p.root_branch_id).select(SEEN)


def _segments(spark: SparkSession, folder: str) -> dict[int, dict]:
    """The recorded segments, with parents only where the project records them."""
    rows = table(spark, folder, "branch_nodes").filter("node_id IS NOT NULL").distinct().collect()
    there = {(r["project_id"], r["node_id"]) for r in rows}
    return {r["node_id"]: r.asDict() | {"parent_node_id": r["parent_node_id"] if (r["project_id"], r["parent_node_id"]) in there else None} for r in rows}


def _depths(nodes: dict[int, dict]) -> dict[int, int]:
    """The depth of each segment whose parents lead to a root."""
    below: dict[int | None, list[int]] = {}
    for n, r in nodes.items():
        below.setdefault(r["parent_node_id"], []).append(n)
    out, level = {}, below.get(None, [])
    while level:
        out |= dict.fromkeys(level, len(out) and out[nodes[level[0]]["parent_node_id"]] + 1)
        level = [c for n in level for c in below.get(n, ())]
    return out


def _shown(spark: SparkSession, folder: str, nodes: dict[int, dict], leaf: int) -> DataFrame:
    log = table(spark, folder, "mutations").filter("path IS NOT NULL").select("node_id", "lsn", "path", "tombstone")
    return resolve.resolved(log, lineage.chain(nodes, leaf)).select("node_id", "path", "lsn")


def resolve_deepest(spark: SparkSession, folder: str) -> DataFrame:
    """What the deepest segment of the change feed shows."""
    nodes = _segments(spark, folder)
    depths = _depths(nodes)
    return _shown(spark, folder, nodes, min(depths, key=lambda n: (-depths[n], n)))


def resolve_ten_branches(spark: SparkSession, folder: str) -> DataFrame:
    """What the ten branches with the smallest MD5 of their name show, of those that lead to a root."""
    nodes = _segments(spark, folder)
    depths = _depths(nodes)
    current = table(spark, folder, "branch_handles").groupBy("project_id", "branch_id").agg(F.max_by("node_id", "commit_seq").alias("leaf"))
    rooted = spark.createDataFrame([(n,) for n in depths], "leaf bigint")
    chosen = current.join(rooted, "leaf").orderBy(F.md5("branch_id")).limit(10).collect()
    views = [_shown(spark, folder, nodes, r["leaf"]).select(F.lit(r["branch_id"]).alias("branch_id"), "*") for r in chosen]
    return reduce(DataFrame.unionByName, views)


QUERIES = {
    **{f"ancestry_chain_{b}": _over(lambda c, b=b: _chain(c, b)) for b in ("main", "dev", "staging")},
    **{f"resolve_{b}_live": _over(lambda c, b=b: _view(c, b)) for b in HANDLES},
    "resolve_staging_at_lsn": _over(lambda c: _view(c, "staging", c.fork // 2)),
    "resolve_at_zero": _over(lambda c: _view(c, "dev", 0)),
    "list_prefix": _over(lambda c: _view(c, "main", prefix=PREFIX).drop("created_at")),
    "list_page1": _over(lambda c: resolve.listing(_view(c, "main", prefix=PREFIX), PAGE_ROWS)),
    "list_page2": _over(lambda c: resolve.listing(_view(c, "main", prefix=PREFIX, after=AFTER), PAGE_ROWS)),
    "list_common_prefixes": _over(lambda c: resolve.common_prefixes(_view(c, "dev"), "user/", "/")),
    "point_read_hit": _over(lambda c: _view(c, "main", path=HIT).select("path", "lsn", "size")),
    "point_read_tombstone": _over(lambda c: _view(c, "main", path=DELETED).select("path", "lsn", "size")),
    "point_read_inherited": _over(lambda c: _view(c, "staging", path=INHERITED).select("path", "lsn", "size")),
    "node_local_latest": _over(lambda c: resolve.node_local(c.log, 2).select("path", "lsn", "tombstone")),
    "node_local_get": _over(lambda c: resolve.node_local(c.log.filter(F.col("path") == HIT), 1, c.fork).select("path", "lsn", "tombstone")),
    "node_max_lsn": _over(lambda c: lineage.max_lsns(c.log)),
    "head_lsn": _over(lambda c: lineage.heads(c.node_frame(), c.log)),
    "branch_info": _over(lambda c: lineage.branch_infos(c.handle_frame(), c.node_frame(), c.log)),
    "list_children": _over(lambda c: lineage.children(c.handle_frame(), "dev")),
    "fork_at_lsn_view": _over(lambda c: _changed(c, {"node_id": 5, "parent_node_id": 1, "fork_lsn": c.fork // 2})),
    "restore_view": _over(lambda c: _changed(c, {"node_id": 5, "parent_node_id": 3, "fork_lsn": c.nodes[3]["fork_lsn"] + 10})),
    "reset_view": _over(lambda c: _changed(c, {"node_id": 5, "parent_node_id": 4, "fork_lsn": _head(c, 4)})),
    "merge_records": _over(lambda c: _merge(c).select("node_id", "lsn", "path", "tombstone", "size")),
    "merge_result_view": _over(_merged_view),
    "merge_count": _over(lambda c: resolve.merge_records(c.log, 3).agg(F.count(F.lit(1)).alias("objects_merged"))),
    "snapshot_view": _over(lambda c: _view(c, "staging", c.nodes[3]["fork_lsn"] + 20).select("path", "lsn", "size")),
    "tombstones_visible": _over(lambda c: resolve.top_versions(resolve.within_chain(c.log, lineage.chain(c.nodes, 4))).filter("tombstone").select("path", "lsn")),
    "version_history": _over(lambda c: resolve.within_chain(c.log, lineage.chain(c.nodes, 3)).filter(F.col("path") == HIT).select("node_id", "lsn", "tombstone")),
    **{f.__name__: f for f in (chunks_fixed_1024, chunk_dedup_stats, chunk_keys, shared_chunks, object_reassembly, content_chunk_coverage, content_chunk_bounds, chunk_orphans, engine_bulk_put, engine_read_back, engine_fork_merge, engine_fork_at_lsn, engine_restore, engine_reset, engine_snapshots, engine_pages, engine_bulk_delete, engine_tables, engine_projects, engine_bytes, engine_errors, stream_ingest, resolve_deepest, resolve_ten_branches)},
}

_BASE = """
ev AS (SELECT *, count(*) OVER () n FROM events),
tagged AS (SELECT *, CASE WHEN event_id % 4 = 2 AND event_id * 2 >= n THEN 2 WHEN event_id % 4 = 3 AND event_id * 4 >= 3 * n THEN 3
  WHEN event_id % 8 = 1 AND event_id * 8 >= 7 * n THEN 4 ELSE 1 END node FROM ev),
f AS (SELECT count(*) FILTER (node = 1 AND event_id * 2 < n) f2, count(*) FILTER (node = 2 AND event_id * 4 < 3 * n) d2, count(*) FILTER (node = 2) n2 FROM tagged),
log AS (SELECT CAST(node AS BIGINT) node_id,
  CAST(row_number() OVER (PARTITION BY node ORDER BY event_id) + CASE node WHEN 1 THEN 0 WHEN 2 THEN f2 WHEN 3 THEN f2 + d2 ELSE f2 + n2 END AS BIGINT) lsn,
  concat('user/', lpad(CAST(user_id AS VARCHAR), 6, '0'), '/obj-', CAST(event_id % 7 AS VARCHAR)) path, CAST(strlen(props) AS BIGINT) size,
  event_type content_type, event_type = 'error' tombstone, epoch_us(ts) // 1000 created_at FROM tagged, f),
node AS (SELECT CAST(1 AS BIGINT) node_id, CAST(NULL AS BIGINT) parent, CAST(NULL AS BIGINT) fork UNION ALL SELECT 2, 1, f2 FROM f
  UNION ALL SELECT 3, 2, f2 + d2 FROM f UNION ALL SELECT 4, 2, f2 + d2 // 2 FROM f),
newest AS (SELECT node_id, max(lsn) m FROM log GROUP BY node_id),
head AS (SELECT n.node_id, fork, greatest(coalesce(fork, 0), coalesce(m, 0)) h FROM node n LEFT JOIN newest l ON l.node_id = n.node_id),
handle AS (SELECT * FROM (VALUES ('main', 1, NULL), ('dev', 4, 'main'), ('backup', 2, 'dev'), ('staging', 3, 'dev')) v(branch_id, node_id, parent_id))
"""


def _sql(body: str, leaf: int | None = None, at: str = "NULL", extra: str = "", log: str = "log") -> str:
    """SQL over the derived collection; with a leaf, ``chain`` is its chain, ``top`` the top versions and ``view`` what shows."""
    parts = [_BASE]
    if leaf is not None:
        parts.append(f"nodes AS (SELECT * FROM node {extra})")
        parts.append(
            f"chain(node_id, parent, fork, depth, cap) AS (SELECT node_id, parent, fork, CAST(0 AS BIGINT), CAST({at} AS BIGINT) FROM nodes WHERE node_id = {leaf} "
            "UNION ALL SELECT n.node_id, n.parent, n.fork, c.depth + 1, least(c.cap, c.fork) FROM chain c JOIN nodes n ON n.node_id = c.parent)"
        )
        parts.append(f"admitted AS (SELECT l.*, depth FROM {log} l JOIN chain c ON c.node_id = l.node_id AND (cap IS NULL OR lsn <= cap))")
        parts.append("top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY depth, lsn DESC) rn FROM admitted) WHERE rn = 1)")
        parts.append("view AS (SELECT * FROM top WHERE NOT tombstone)")
    return f"WITH RECURSIVE {', '.join(parts)} {body}"


_COLUMNS = ", ".join(VIEW)
_MERGE = (
    "moved AS (SELECT CAST(4 AS BIGINT) node_id, (SELECT h FROM head WHERE node_id = 4) + CAST(row_number() OVER (ORDER BY path) AS BIGINT) lsn, path, size, content_type, tombstone, created_at "
    "FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY lsn DESC) r FROM log WHERE node_id = 3) WHERE r = 1)"
)
_DOC_CHUNKS = (
    "d AS (SELECT doc_id, encode(coalesce(text, '')) b, strlen(coalesce(text, '')) n FROM documents), "
    f"c AS (SELECT doc_id, i, b[i * {CHUNK} + 1 : (i + 1) * {CHUNK}] x, least({CHUNK}, n - i * {CHUNK}) len FROM (SELECT *, unnest(range(0, (n + {CHUNK - 1}) // {CHUNK})) i FROM d))"
)
_BULK = "bulk AS (SELECT coalesce(lang, 'none') || '/' || lpad(CAST(doc_id AS VARCHAR), 10, '0') path, coalesce(text, '') t, coalesce(source, 'none') content_type FROM documents)"

_LAYERS = f"""{_BULK},
en AS (SELECT path, CAST(row_number() OVER (ORDER BY path) AS BIGINT) r, CAST(count(*) OVER () AS BIGINT) n, CAST(strlen(t) AS BIGINT) size FROM bulk WHERE starts_with(path, 'en/')),
rest AS (SELECT path, CAST(row_number() OVER (ORDER BY path) AS BIGINT) r, CAST(strlen(t) AS BIGINT) size FROM bulk WHERE NOT starts_with(path, 'en/')),
k AS (SELECT (SELECT count(*) FROM en) n, (SELECT count(*) FROM rest) m)"""
_REAL = """
node AS (SELECT DISTINCT project_id, node_id, parent_node_id, fork_lsn FROM branch_nodes WHERE node_id IS NOT NULL),
tree AS (SELECT n.project_id, n.node_id, 0 depth FROM node n LEFT JOIN node p ON p.project_id = n.project_id AND p.node_id = n.parent_node_id WHERE p.node_id IS NULL
 UNION ALL SELECT n.project_id, n.node_id, t.depth + 1 FROM tree t JOIN node n ON n.project_id = t.project_id AND n.parent_node_id = t.node_id),
"""
_REAL_VIEW = """
chain AS (SELECT branch_id, node_id, 0 depth, 9223372036854775807 cap FROM leaf
 UNION ALL SELECT c.branch_id, p.node_id, c.depth + 1, least(c.cap, coalesce(n.fork_lsn, 9223372036854775807)) FROM chain c JOIN node n ON n.node_id = c.node_id
 JOIN node p ON p.project_id = n.project_id AND p.node_id = n.parent_node_id),
top AS (SELECT c.branch_id, m.node_id, path, lsn, coalesce(tombstone, false) dead, row_number() OVER (PARTITION BY c.branch_id, path ORDER BY depth, lsn DESC) rn
 FROM chain c JOIN mutations m ON m.node_id = c.node_id AND m.lsn <= c.cap WHERE path IS NOT NULL)
"""

SQL = {
    "content_chunk_bounds": "SELECT doc_id, true AS within, true AS whole FROM documents",
    "engine_fork_at_lsn": f"WITH {_LAYERS} SELECT path, r AS lsn, size FROM en WHERE r <= n // 2",
    "engine_restore": f"""WITH {_LAYERS}, own AS (SELECT path, n + r lsn, r, size, n + m head_lsn FROM rest, k)
SELECT 'restored' AS kind, path, CAST(lsn AS BIGINT) AS lsn, size, CAST(head_lsn AS BIGINT) AS head_lsn FROM own WHERE r <= 10
UNION ALL SELECT 'backup', path, CAST(lsn AS BIGINT), size, CAST(head_lsn AS BIGINT) FROM own
UNION ALL SELECT x.kind, path, r, size, CAST(k.n + m AS BIGINT) FROM en, k, (VALUES ('restored'), ('backup')) x(kind)""",
    "engine_reset": f"WITH {_LAYERS} SELECT path, CAST(k.n + r AS BIGINT) AS lsn, size, CAST(greatest(2 * k.n, k.n + m) + 1 AS BIGINT) AS next_lsn FROM en, k",
    "engine_snapshots": f"""WITH {_BULK}, b AS (SELECT path, CAST(row_number() OVER (ORDER BY path) AS BIGINT) lsn, CAST(strlen(t) AS BIGINT) size, CAST(count(*) OVER () AS BIGINT) n FROM bulk),
d AS (SELECT CAST(count(*) AS BIGINT) d FROM b WHERE ends_with(path, '7'))
SELECT 'first' AS name, path, lsn, size, n AS at, CAST(2 AS BIGINT) AS n_snapshots FROM b UNION ALL SELECT 'second', path, lsn, size, n + d, 2 FROM b, d WHERE NOT ends_with(path, '7')""",
    "engine_pages": f"WITH {_LAYERS} SELECT r - 1 AS place, path, CAST(k.n + r AS BIGINT) AS lsn FROM en, k",
    "engine_bulk_delete": f"""WITH {_LAYERS}
SELECT 'fork' AS kind, path, CAST(k.n + r AS BIGINT) AS lsn, size FROM rest, k WHERE NOT ends_with(path, '3') UNION ALL SELECT 'fork', path, r, size FROM en WHERE NOT ends_with(path, '3')
UNION ALL SELECT 'main', path, CAST(k.n + r AS BIGINT), size FROM en, k""",
    "engine_tables": f"""WITH {_LAYERS} SELECT 'main' AS branch, NULL AS parent, CAST(NULL AS BIGINT) AS fork_lsn, CAST(2 * n AS BIGINT) AS head_lsn, CAST(1 AS BIGINT) AS n_children FROM k
UNION ALL SELECT 'fork', 'main', CAST(n AS BIGINT), CAST(n + m AS BIGINT), 0 FROM k""",
    "engine_projects": """WITH l AS (SELECT DISTINCT coalesce(lang, 'none') project_id FROM documents)
SELECT project_id, CAST((row_number() OVER (ORDER BY encode(project_id)) - 1) // 2 AS BIGINT) AS page, true AS found FROM l""",
    "engine_bytes": f"""WITH d AS (SELECT encode(text) b, strlen(text) n FROM documents WHERE text IS NOT NULL ORDER BY strlen(text) DESC, doc_id LIMIT 1)
SELECT 'then' AS name, CAST(1 AS BIGINT) AS lsn, CAST(n AS BIGINT) AS size, 'text/plain' AS content_type, CAST((n + {CHUNK - 1}) // {CHUNK} AS BIGINT) AS n_chunks, sha256(b) AS whole, sha256(b) AS parts FROM d
UNION ALL SELECT 'now', 2, CAST(least(n, {CHUNK}) AS BIGINT), 'application/octet-stream', 1, sha256(b[1:{CHUNK}]), sha256(b[1:{CHUNK}]) FROM d""",
    "engine_errors": """SELECT * FROM (VALUES ('get unknown project', 'PROJECT_NOT_FOUND'), ('create it twice', 'PROJECT_ALREADY_EXISTS'), ('get unknown branch', 'BRANCH_NOT_FOUND'), ('read unknown path', 'OBJECT_NOT_FOUND'),
 ('get unknown snapshot', 'SNAPSHOT_NOT_FOUND'), ('delete unknown snapshot', 'SNAPSHOT_NOT_FOUND'), ('delete a root', 'BRANCH_IS_ROOT'), ('delete a parent', 'BRANCH_HAS_CHILDREN'), ('merge a root', 'BRANCH_IS_ROOT'),
 ('merge a parent', 'BRANCH_HAS_CHILDREN'), ('reset a root', 'BRANCH_IS_ROOT'), ('restore beyond the head', 'INVALID_RESTORE_LSN'), ('restore below zero', 'INVALID_RESTORE_LSN'), ('fork beyond the head', 'INVALID_RESTORE_LSN'),
 ('neither position nor snapshot', 'INVALID_INPUT'), ('both', 'INVALID_INPUT'), ('bad cursor', 'INVALID_CURSOR'), ('unknown cursor', 'INVALID_CURSOR'), ('too many', 'INVALID_INPUT'), ('NUL in a path', 'INVALID_INPUT'),
 ('NUL in a prefix', 'INVALID_INPUT'), ('chunks of no size', 'INVALID_INPUT'), ('unknown chunker', 'INVALID_INPUT'), ('after all that', 'OK')) v(call, code)""",
    "stream_ingest": f"WITH {_BULK} SELECT path, lsn, size FROM (SELECT path, CAST(row_number() OVER (ORDER BY path) AS BIGINT) lsn, CAST(strlen(t) AS BIGINT) size FROM bulk) WHERE NOT ends_with(path, '7')",
    "resolve_deepest": f"WITH RECURSIVE {_REAL} leaf AS (SELECT 'x' branch_id, node_id FROM tree ORDER BY depth DESC, node_id LIMIT 1), {_REAL_VIEW} SELECT node_id, path, lsn FROM (SELECT DISTINCT * FROM top WHERE rn = 1) WHERE NOT dead",
    "resolve_ten_branches": f"""WITH RECURSIVE {_REAL}
cur AS (SELECT project_id, branch_id, arg_max(node_id, commit_seq) node_id FROM branch_handles GROUP BY ALL),
leaf AS (SELECT branch_id, node_id FROM cur WHERE node_id IN (SELECT node_id FROM tree) ORDER BY md5(branch_id) LIMIT 10), {_REAL_VIEW}
SELECT branch_id, node_id, path, lsn FROM top WHERE rn = 1 AND NOT dead""",
    **{f"ancestry_chain_{b}": _sql("SELECT node_id, depth, cap FROM chain", HANDLES[b][0]) for b in ("main", "dev", "staging")},
    **{f"resolve_{b}_live": _sql(f"SELECT {_COLUMNS} FROM view", n) for b, (n, _) in HANDLES.items()},
    "resolve_staging_at_lsn": _sql(f"SELECT {_COLUMNS} FROM view", 3, "(SELECT f2 // 2 FROM f)"),
    "resolve_at_zero": _sql(f"SELECT {_COLUMNS} FROM view", 4, "0"),
    "list_prefix": _sql(f"SELECT path, lsn, size, content_type FROM view WHERE starts_with(path, '{PREFIX}')", 1),
    "list_page1": _sql(f"SELECT path, lsn, size, content_type FROM view WHERE starts_with(path, '{PREFIX}') ORDER BY path LIMIT {PAGE_ROWS}", 1),
    "list_page2": _sql(f"SELECT path, lsn, size, content_type FROM view WHERE starts_with(path, '{PREFIX}') AND path > '{AFTER}' ORDER BY path LIMIT {PAGE_ROWS}", 1),
    "list_common_prefixes": _sql("SELECT DISTINCT 'user/' || split_part(path, '/', 2) || '/' AS entry, true AS is_prefix FROM view", 4),
    "point_read_hit": _sql(f"SELECT path, lsn, size FROM view WHERE path = '{HIT}'", 1),
    "point_read_tombstone": _sql(f"SELECT path, lsn, size FROM view WHERE path = '{DELETED}'", 1),
    "point_read_inherited": _sql(f"SELECT path, lsn, size FROM view WHERE path = '{INHERITED}'", 3),
    "node_local_latest": _sql("SELECT path, lsn, tombstone FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY lsn DESC) r FROM log WHERE node_id = 2) WHERE r = 1"),
    "node_local_get": _sql(f"SELECT path, lsn, tombstone FROM log WHERE node_id = 1 AND path = '{HIT}' AND lsn <= (SELECT f2 FROM f) ORDER BY lsn DESC LIMIT 1"),
    "node_max_lsn": _sql("SELECT node_id, max(lsn) AS max_lsn FROM log GROUP BY node_id"),
    "head_lsn": _sql("SELECT node_id, fork AS fork_lsn, h AS head_lsn FROM head"),
    "branch_info": _sql("SELECT branch_id, parent_id, CASE WHEN parent_id IS NOT NULL THEN fork END AS fork_lsn, h AS head_lsn FROM handle JOIN head ON handle.node_id = head.node_id"),
    "list_children": _sql("SELECT branch_id FROM handle WHERE parent_id = 'dev'"),
    "fork_at_lsn_view": _sql("SELECT path, lsn, size FROM view", 5, extra="UNION ALL SELECT 5, 1, f2 // 2 FROM f"),
    "restore_view": _sql("SELECT path, lsn, size FROM view", 5, extra="UNION ALL SELECT 5, 3, f2 + d2 + 10 FROM f"),
    "reset_view": _sql("SELECT path, lsn, size FROM view", 5, extra="UNION ALL SELECT 5, 4, h FROM head WHERE node_id = 4"),
    "merge_records": f"WITH {_BASE}, {_MERGE} SELECT node_id, lsn, path, tombstone, size FROM moved",
    "merge_result_view": _sql(f"SELECT {_COLUMNS} FROM view", 4, log="(SELECT node_id, lsn, path, size, content_type, tombstone, created_at FROM log UNION ALL SELECT * FROM moved)").replace("nodes AS (", f"{_MERGE}, nodes AS (", 1),
    "merge_count": _sql("SELECT CAST(count(DISTINCT path) AS BIGINT) AS objects_merged FROM log WHERE node_id = 3"),
    "snapshot_view": _sql("SELECT path, lsn, size FROM view", 3, "(SELECT f2 + d2 + 20 FROM f)"),
    "tombstones_visible": _sql("SELECT path, lsn FROM top WHERE tombstone", 4),
    "version_history": _sql(f"SELECT node_id, lsn, tombstone FROM admitted WHERE path = '{HIT}'", 3),
    "chunks_fixed_1024": f"WITH {_DOC_CHUNKS} SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, CAST(i * {CHUNK} AS BIGINT) AS \"offset\", CAST(len AS BIGINT) AS length, sha256(x) AS hash FROM c",
    "chunk_dedup_stats": f"WITH {_DOC_CHUNKS}, h AS (SELECT sha256(x) h, count(*) n, max(len) len FROM c GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_chunks, CAST(count(*) AS BIGINT) AS n_distinct, CAST(sum(n * len) AS BIGINT) AS bytes, CAST(sum(len) AS BIGINT) AS stored_bytes FROM h",
    "chunk_keys": f"WITH {_DOC_CHUNKS} SELECT DISTINCT sha256(x) AS hash, 'chunks/' || substr(sha256(x), 1, 2) || '/' || substr(sha256(x), 3, 2) || '/' || sha256(x) AS key FROM c",
    "shared_chunks": f"WITH {_DOC_CHUNKS} SELECT sha256(x) AS hash, CAST(count(*) AS BIGINT) AS refs FROM c GROUP BY 1 HAVING count(*) > 1",
    "object_reassembly": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, sha256(encode(coalesce(text, ''))) AS sha256 FROM documents",
    "content_chunk_coverage": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, sha256(encode(coalesce(text, ''))) AS sha256 FROM documents",
    "chunk_orphans": "SELECT lower(hash) AS hash, max(length) AS length FROM chunks WHERE lower(hash) NOT IN (SELECT lower(h) FROM (SELECT unnest(chunks) h FROM mutations) WHERE h IS NOT NULL) GROUP BY 1",
    "engine_bulk_put": f"WITH {_BULK} SELECT path, CAST(row_number() OVER (ORDER BY path) AS BIGINT) AS lsn, CAST(strlen(t) AS BIGINT) AS size, content_type FROM bulk",
    "engine_read_back": f"WITH {_BULK} SELECT path, sha256(encode(t)) AS sha256 FROM bulk",
    "engine_fork_merge": f"""WITH {_BULK}, m AS (SELECT *, row_number() OVER (ORDER BY path) lsn FROM bulk WHERE starts_with(path, 'en/')),
src AS (SELECT path, CAST(strlen(t) AS BIGINT) size, false dead FROM bulk WHERE NOT starts_with(path, 'en/') UNION ALL SELECT path, 0, true FROM m WHERE ends_with(path, '7')),
moved AS (SELECT *, (SELECT count(*) FROM m) + row_number() OVER (ORDER BY path) lsn FROM src)
SELECT path, CAST(lsn AS BIGINT) AS lsn, size FROM moved WHERE NOT dead
UNION ALL SELECT path, CAST(lsn AS BIGINT), CAST(strlen(t) AS BIGINT) FROM m WHERE NOT ends_with(path, '7')""",
}
