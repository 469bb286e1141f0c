"""The engine's operations: the acceptance scenarios, guards, listings, and a random comparison with a model."""

import random

import pytest

from forkline import config, errors, lineage, resolve, schema, sources
from forkline.api import Engine


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/w", chunk_size=1024)


def read(engine, p, branch, path, at=None):
    try:
        return engine.get_object(p, branch, path, at).decode()
    except errors.ObjectNotFound:
        return None


@pytest.fixture
def graph(engine):
    """main: foo, bar, bax, then foo deleted; dev forked after bar, with its own foo and baz."""
    project = engine.create_project()
    p, main = project.project_id, project.root_branch_id
    assert engine.put_object(p, main, "foo.txt", b"foo-v1").lsn == 1
    assert engine.put_object(p, main, "bar.pdf", b"bar").lsn == 2
    dev = engine.create_branch(p, main).branch_id
    assert engine.put_object(p, main, "bax.png", b"bax").lsn == 3
    assert engine.delete_object(p, main, "foo.txt") == 4
    assert engine.put_object(p, dev, "foo.txt", b"foo-v2").lsn == 3
    assert engine.put_object(p, dev, "baz.md", b"baz").lsn == 4
    return p, main, dev


def test_single_log(engine, graph):
    p, main, _ = graph
    assert [read(engine, p, main, x) for x in ("foo.txt", "bar.pdf", "bax.png")] == [None, "bar", "bax"]
    assert read(engine, p, main, "foo.txt", 3) == "foo-v1"
    assert [read(engine, p, main, x, at) for x, at in (("bar.pdf", 1), ("bax.png", 2), ("foo.txt", 0))] == [None, None, None]
    engine.put_object(p, main, "bar.pdf", b"bar2")
    assert (read(engine, p, main, "bar.pdf"), read(engine, p, main, "bar.pdf", 2)) == ("bar2", "bar")


def test_branching(engine, graph):
    p, main, dev = graph
    assert [read(engine, p, dev, x) for x in ("bar.pdf", "foo.txt", "bax.png")] == ["bar", "foo-v2", None]
    assert read(engine, p, dev, "foo.txt", 1) == "foo-v1"
    assert [read(engine, p, main, x) for x in ("foo.txt", "baz.md")] == [None, None]
    early = engine.fork_at_lsn(p, main, 1)
    assert (early.fork_lsn, early.head_lsn) == (1, 1)
    assert [read(engine, p, early.branch_id, x) for x in ("foo.txt", "bar.pdf")] == ["foo-v1", None]
    deep = engine.fork_at_lsn(p, dev, 1)  # below dev's own fork position
    assert [read(engine, p, deep.branch_id, x) for x in ("foo.txt", "bar.pdf", "baz.md")] == ["foo-v1", None, None]
    with pytest.raises(errors.InvalidRestoreLsn):
        engine.fork_at_lsn(p, dev, 9)


def test_merge(engine, graph):
    p, main, dev = graph
    engine.delete_object(p, dev, "bar.pdf")
    info, n = engine.merge(p, dev)
    assert (n, info.head_lsn) == (3, 7)
    listed = {o.path: o.lsn for o in engine.list_objects(p, main).items}
    assert listed == {"bax.png": 3, "baz.md": 6, "foo.txt": 7}  # numbered by path: bar.pdf's tombstone is 5
    assert read(engine, p, main, "foo.txt") == "foo-v2"
    assert engine.merge(p, engine.create_branch(p, main).branch_id)[1] == 0
    with pytest.raises(errors.BranchIsRoot):
        engine.merge(p, main)
    child = engine.create_branch(p, dev)
    with pytest.raises(errors.BranchHasChildren):
        engine.merge(p, dev)
    engine.delete_branch(p, child.branch_id)
    assert engine.merge(p, dev)[1] == 3


@pytest.mark.parametrize("what, lost", [("project", False), ("put elsewhere", False), ("put on target", True), ("put on source", True), ("child", True)])
def test_merge_conflicts_on_its_own_branches_only(engine, graph, monkeypatch, what, lost):
    p, main, dev = graph
    side = engine.create_branch(p, main).branch_id
    appended = engine._appended

    def late(*args):
        monkeypatch.setattr(engine, "_appended", appended)
        other = Engine(engine.spark, engine.log.root)
        if what == "project":
            other.create_project()
        elif what == "child":
            other.create_branch(p, dev)
        else:
            other.put_object(p, {"put elsewhere": side, "put on target": main, "put on source": dev}[what], "late", b"late")
        return appended(*args)

    monkeypatch.setattr(engine, "_appended", late)
    if lost:
        with pytest.raises((errors.Conflict, errors.BranchHasChildren)):
            engine.merge(p, dev)
        assert read(engine, p, main, "baz.md") is None
    else:
        assert engine.merge(p, dev)[1] == 2
        assert read(engine, p, main, "baz.md") == "baz"


def test_restore(engine, graph):
    p, _, dev = graph
    info, backup = engine.restore(p, dev, 3)
    assert (info.branch_id, info.fork_lsn, info.head_lsn, backup.parent_id) == (dev, 3, 4, dev)
    assert {o.path: o.lsn for o in engine.list_objects(p, dev).items} == {"bar.pdf": 2, "foo.txt": 3}
    assert read(engine, p, backup.branch_id, "baz.md") == "baz"
    assert engine.put_object(p, dev, "new.txt", b"new").lsn == 5
    assert [read(engine, p, b, "new.txt") for b in (dev, backup.branch_id)] == ["new", None]
    engine.put_object(p, backup.branch_id, "late.txt", b"late")
    assert read(engine, p, dev, "late.txt") is None
    again, _ = engine.restore(p, dev, 1)  # before the fork
    assert [read(engine, p, dev, x) for x in ("foo.txt", "bar.pdf")] == ["foo-v1", None]
    with pytest.raises(errors.BranchHasChildren):
        engine.merge(p, dev)


def test_reset(engine, graph):
    p, main, dev = graph
    info = engine.reset_from_parent(p, dev)
    assert (info.fork_lsn, info.head_lsn) == (4, 4)
    assert [o.path for o in engine.list_objects(p, dev).items] == ["bar.pdf", "bax.png"]
    engine.restore(p, main, 2)
    engine.reset_from_parent(p, dev)
    assert {o.path for o in engine.list_objects(p, dev).items} == {"bar.pdf", "foo.txt"}
    with pytest.raises(errors.BranchIsRoot):
        engine.reset_from_parent(p, main)


def test_snapshots(engine, graph):
    p, main, dev = graph
    snap = engine.create_snapshot(p, dev)
    assert snap.lsn == 4 and engine.get_snapshot(p, dev, snap.snapshot_id) == snap
    engine.put_object(p, dev, "x", b"x")
    fork = engine.fork_at_lsn(p, dev, snapshot_id=snap.snapshot_id)
    assert read(engine, p, fork.branch_id, "x") is None
    with pytest.raises(errors.SnapshotNotFound):
        engine.get_snapshot(p, main, snap.snapshot_id)
    for args in ({}, {"lsn": 1, "snapshot_id": snap.snapshot_id}):
        with pytest.raises(errors.InvalidInput):
            engine.resolve_lsn(p, dev, **args)
    others = [engine.create_snapshot(p, dev).snapshot_id for _ in range(3)]
    page = engine.list_snapshots(p, dev, limit=3)
    rest = engine.list_snapshots(p, dev, page.next_cursor, 3)
    assert [s.snapshot_id for s in page.items + rest.items] == sorted([snap.snapshot_id, *others], key=str.encode)
    engine.delete_snapshot(p, dev, others[0])
    assert len(engine.list_snapshots(p, dev).items) == 3


def test_listing(engine, spark):
    project = engine.create_project()
    p, main = project.project_id, project.root_branch_id
    paths = ["Z", "a", "a-", "a/b", "a/c/d", "b%_/x", "z", "\u00e9", "\uffff", "\U0001f600"]
    engine.put_objects(p, main, spark.createDataFrame([(x, x.encode()) for x in paths], "path string, content binary"))
    engine.delete_object(p, main, "a-")
    kept = sorted((x for x in paths if x != "a-"), key=str.encode)
    seen, cursor = [], None
    while True:
        page = engine.list_objects(p, main, cursor=cursor, limit=2)
        seen += [o.path for o in page.items]
        cursor = page.next_cursor
        if not page.has_more:
            break
    assert seen == kept
    assert [o.path for o in engine.list_objects(p, main, prefix="a/").items] == ["a/b", "a/c/d"]
    assert [o.path for o in engine.list_objects(p, main, prefix="b%_").items] == ["b%_/x"]
    rolled = engine.list_objects(p, main, prefix="a", delimiter="/")
    assert ([o.path for o in rolled.items], rolled.common_prefixes) == (["a"], ["a/"])
    assert engine.list_objects(p, main, at_lsn=0).items == []
    assert len(engine.list_objects(p, main, at_lsn=10**9).items) == 9
    assert len(engine.list_objects(p, main, limit=0).items) == 1
    for bad in ({"limit": 1001}, {"prefix": "a\0"}):
        with pytest.raises(errors.InvalidInput):
            engine.list_objects(p, main, **bad)
    with pytest.raises(errors.InvalidCursor):
        engine.list_objects(p, main, cursor="!!!")


def test_bytes(engine):
    project = engine.create_project()
    p, main = project.project_id, project.root_branch_id
    for size in (0, 1, 1023, 1024, 1025, 5000):
        body = bytes(i % 251 for i in range(size))
        assert engine.put_object(p, main, f"f{size}", body).size == size
        assert engine.get_object(p, main, f"f{size}") == body
        assert len(engine.get_object_meta(p, main, f"f{size}").chunks) == -(-size // 1024)
    stored = engine.frame("chunks").count()
    engine.put_object(p, main, "again", bytes(i % 251 for i in range(5000)), "text/plain")
    assert engine.frame("chunks").count() == stored
    assert engine.get_object_meta(p, main, "again").content_type == "text/plain"
    assert engine.delete_object(p, main, "never there") == 8
    many = {r.path: bytes(r.content) for r in engine.get_objects(p, main).collect()}
    assert many["f0"] == b"" and len(many["f5000"]) == 5000 and len(many) == 7
    assert engine.orphan_chunks().count() == 0
    assert engine.compact(p, main) > 1
    assert len(engine.get_object(p, main, "f1025")) == 1025
    for bad in ("a\0b",):
        with pytest.raises(errors.InvalidInput):
            engine.put_object(p, main, bad, b"")


def test_projects_and_branches(engine):
    ids = sorted(engine.create_project().project_id for _ in range(5))
    page = engine.list_projects(limit=3)
    assert [x.project_id for x in page.items + engine.list_projects(page.next_cursor).items] == ids
    with pytest.raises(errors.ProjectAlreadyExists):
        engine.create_project(ids[0])
    with pytest.raises(errors.ProjectNotFound):
        engine.get_project("prj-none")
    with pytest.raises(errors.BranchNotFound):
        engine.put_object("prj-none", "br-none", "x", b"")
    root = engine.get_project(ids[0]).root_branch_id
    made = [engine.create_branch(ids[0], root).branch_id for _ in range(3)]
    assert engine.list_children(ids[0], root) == sorted(made)
    assert [b.branch_id for b in engine.list_branches(ids[0]).items] == sorted([root, *made], key=str.encode)
    assert engine.get_branch(ids[0], root).fork_lsn is None
    with pytest.raises(errors.InvalidCursor):
        engine.list_branches(ids[0], cursor="bm9uZQ==")
    engine.delete_project(ids[0])
    with pytest.raises(errors.ProjectNotFound):
        engine.list_branches(ids[0])


def test_log_is_shared_and_checkpointed(engine, spark):
    from forkline import commitlog

    first = engine.create_project()
    for _ in range(commitlog.CHECKPOINT_EVERY + 3):
        engine.create_branch(first.project_id, first.root_branch_id)
    other = Engine(spark, engine.log.root)
    assert len(other.list_branches(first.project_id, limit=1000).items) == commitlog.CHECKPOINT_EVERY + 4
    other.put_object(first.project_id, first.root_branch_id, "x", b"x")
    assert engine.get_object(first.project_id, first.root_branch_id, "x") == b"x"
    assert engine.frame("branch_nodes").count() == commitlog.CHECKPOINT_EVERY + 4


class Model:
    """A plain in-memory walk: branches point to nodes, nodes hold (lsn, path, value) and a parent with a cap."""

    def __init__(self, main):
        self.nodes = {0: (None, None, [])}
        self.at = {main: 0}
        self.parent = {main: None}
        self.high = {main: 0}

    def head(self, b):
        node = self.nodes[self.at[b]]
        return max(node[1] or 0, max((x[0] for x in node[2]), default=0), self.high[b])

    def write(self, b, path, value):
        self.nodes[self.at[b]][2].append((self.head(b) + 1, path, value))

    def node(self, parent, cap):
        self.nodes[len(self.nodes)] = (parent, cap, [])
        return len(self.nodes) - 1

    def fork(self, b, new, lsn):
        self.at[new], self.parent[new], self.high[new] = self.node(self.at[b], lsn), b, 0

    def restore(self, b, backup, lsn):
        self.at[backup], self.parent[backup], self.high[backup] = self.at[b], b, self.head(b)
        self.high[b] = self.head(b)
        self.at[b] = self.node(self.at[b], lsn)

    def view(self, b, cap=10**18):
        paths = {x[1] for n in self.nodes.values() for x in n[2]}
        out = {}
        for path in paths:
            node, limit = self.at[b], cap
            while node is not None:
                parent, fork, log = self.nodes[node]
                hits = [x for x in log if x[1] == path and x[0] <= limit]
                if hits:
                    best = max(hits)
                    if best[2] is not None:
                        out[path] = (best[0], best[2])
                    break
                limit = limit if fork is None else min(limit, fork)
                node = parent
        return out


@pytest.mark.parametrize("seed", range(2))
def test_random_operations(engine, seed):
    rnd = random.Random(seed)
    project = engine.create_project()
    p, main = project.project_id, project.root_branch_id
    model = Model(main)
    for step in range(25):
        b = rnd.choice(list(model.at))
        kind = rnd.choice(["put"] * 4 + ["delete", "fork", "fork_at", "restore", "reset", "merge"])
        path = rnd.choice("abcde")
        if kind == "put":
            engine.put_object(p, b, path, str(step).encode())
            model.write(b, path, len(str(step)))
        elif kind == "delete":
            engine.delete_object(p, b, path)
            model.write(b, path, None)
        elif kind in ("fork", "fork_at"):
            lsn = model.head(b) if kind == "fork" else rnd.randint(0, model.head(b))
            model.fork(b, (engine.create_branch(p, b) if kind == "fork" else engine.fork_at_lsn(p, b, lsn)).branch_id, lsn)
        elif kind == "restore":
            lsn = rnd.randint(0, model.head(b))
            model.restore(b, engine.restore(p, b, lsn)[1].branch_id, lsn)
        elif model.parent[b] is not None:
            parent = model.parent[b]
            if kind == "reset":
                engine.reset_from_parent(p, b)
                model.high[b] = model.head(b)
                model.at[b] = model.node(model.at[parent], model.head(parent))
            elif b not in model.parent.values():
                latest = {}
                for x in sorted(model.nodes[model.at[b]][2]):
                    latest[x[1]] = x[2]
                assert engine.merge(p, b)[1] == len(latest)
                for path in sorted(latest):
                    model.write(parent, path, latest[path])
    for b in model.at:
        assert engine.get_branch(p, b).head_lsn == model.head(b)
        for at in (None, rnd.randint(0, model.head(b))):
            view = {o.path: (o.lsn, o.size) for o in engine.list_objects(p, b, at_lsn=at).items}
            assert view == model.view(b, 10**18 if at is None else at)


def test_stream_ingest(engine, spark, tmp_path):
    from forkline.streaming import ingest

    spark.createDataFrame([("a", bytearray(b"1"), False), ("b", bytearray(b"2"), False)], "path string, content binary, deleted boolean").write.parquet(f"{tmp_path}/in")
    project = engine.create_project()
    p, main = project.project_id, project.root_branch_id
    stream = spark.readStream.schema("path string, content binary, deleted boolean").parquet(f"{tmp_path}/in")
    ingest(stream, engine, p, main, f"{tmp_path}/state").awaitTermination()
    spark.createDataFrame([("a", None, True)], "path string, content binary, deleted boolean").write.mode("append").parquet(f"{tmp_path}/in")
    ingest(stream, engine, p, main, f"{tmp_path}/state").awaitTermination()
    assert [o.path for o in engine.list_objects(p, main).items] == ["b"]


def test_content_defined_engine(spark, tmp_path):

    env = {"FORKLINE__WAREHOUSE__ROOT": f"file://{tmp_path}/c", "FORKLINE__CHUNKER__TYPE": "cdc"} | {f"FORKLINE__CHUNKER__{k}_BYTES": v for k, v in (("MIN", "64"), ("AVG", "256"), ("MAX", "1024"))}
    engine = config.engine(spark, env)
    project = engine.create_project()
    p, main = project.project_id, project.root_branch_id
    body = random.Random(5).randbytes(20_000)
    engine.put_object(p, main, "a", body)
    first = engine.frame("chunks").count()
    engine.put_object(p, main, "b", b"new start" + body)
    assert engine.frame("chunks").count() < first + 5
    assert engine.get_object(p, main, "b") == b"new start" + body == b"".join(engine.iter_object(p, main, "b"))
    for bad in ({"CHUNKER__TYPE": "x"}, {"CHUNKER__TYPE": "cdc"}, {"CHUNKER__CHUNK_SIZE_BYTES": "x"}, {"CHUNKER__CHUNK_SIZE_BYTES": "0"}):
        with pytest.raises(errors.InvalidInput):
            config.settings({f"FORKLINE__{k}": v for k, v in bad.items()})
    s3 = config.settings({"FORKLINE__STORAGE__ENDPOINT": "http://localhost:9000", "FORKLINE__STORAGE__REGION": "r"}).storage
    assert s3["spark.hadoop.fs.s3a.endpoint"] == "http://localhost:9000" and s3["spark.hadoop.fs.s3a.path.style.access"] == "true"


def test_files_in_and_out(engine, spark, tmp_path):
    from forkline.sources.files import files_as_objects, objects_as_files

    bodies = {"a.txt": b"a", "d/b c.bin": bytes(3000), "d/e/c.txt": b""}
    for name, body in bodies.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(body)
    project = engine.create_project()
    p, main = project.project_id, project.root_branch_id
    engine.put_objects(p, main, files_as_objects(spark, f"{tmp_path}/in"))
    assert [o.path for o in engine.list_objects(p, main).items] == sorted(bodies)
    assert objects_as_files(engine.get_objects(p, main), f"{tmp_path}/out").count() == 3
    assert {n: (tmp_path / "out" / n).read_bytes() for n in bodies} == bodies
    assert files_as_objects(spark, f"file://{tmp_path}/in", "*.txt").count() == 2


def test_concurrent_writers_share_one_log(engine, spark):
    from concurrent.futures import ThreadPoolExecutor

    project = engine.create_project()
    p, main = project.project_id, project.root_branch_id
    writers = [Engine(spark, engine.log.root, chunk_size=1024) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        lsns = list(pool.map(lambda x: writers[x[0]].put_object(p, main, f"f{x[1]}", b"x").lsn, [(i % 4, i) for i in range(12)]))
    assert sorted(lsns) == list(range(1, 13))
    assert {o.path: o.lsn for o in engine.list_objects(p, main).items} == {f"f{i}": lsn for i, lsn in enumerate(lsns)}


def test_bulk_paths_are_checked(engine, spark):
    p = engine.create_project()
    main = p.root_branch_id
    for bad in (None, "a\0b"):
        rows = spark.createDataFrame([("fine", bytearray(b"x")), (bad, bytearray(b"y"))], "path string, content binary")
        with pytest.raises(errors.InvalidInput):
            engine.put_objects(p.project_id, main, rows)
        with pytest.raises(errors.InvalidInput):
            engine.delete_objects(p.project_id, main, rows)
    assert engine.get_branch(p.project_id, main).head_lsn == 0


def test_a_batch_is_written_once(engine, spark, tmp_path):
    p = engine.create_project()
    rows = spark.createDataFrame([("a", bytearray(b"1"), False), ("b", bytearray(b"2"), True)], "path string, content binary, deleted boolean")
    for _ in range(2):
        engine.put_objects(p.project_id, p.root_branch_id, rows, deleted=rows["deleted"], batch={"s": 0})
    assert engine.get_branch(p.project_id, p.root_branch_id).head_lsn == 2
    engine.put_objects(p.project_id, p.root_branch_id, rows.limit(0), batch={"s": 1})
    assert engine.log.refresh().batches == {"s": 1} and [o.path for o in engine.list_objects(p.project_id, p.root_branch_id).items] == ["a"]


def test_upkeep(engine, spark, tmp_path):
    p = engine.create_project()
    main = p.root_branch_id
    put = lambda n, text: engine.put_objects(p.project_id, main, spark.range(n).selectExpr("concat('o', id) AS path", f"encode(concat('{text}', id), 'utf-8') AS content"))
    put(40, "x"), put(40, "x"), put(60, "x")
    before = engine.get_objects(p.project_id, main).orderBy("path").collect()
    assert engine.frame("chunks").count() == 60 and len(engine.log.state.chunks) == 2
    # a chunk that no change names: of a commit that lost its changes
    engine.log.publish(engine.log.refresh().seq, {"chunks": engine._kept(spark.createDataFrame([(bytearray(b"\1" * 32), bytearray(b"z"), 1)], "hash binary, data binary, length bigint"))})
    assert engine.orphan_chunks().count() == 1
    assert engine.compact_chunks() == 3 and engine.frame("chunks").count() == 61
    assert engine.compact_chunks() == 0 and engine.compact_chunks(clean=True) == 1
    assert engine.frame("chunks").count() == 60 and engine.orphan_chunks().count() == 0
    folders = lambda: sum(len(list((tmp_path / "w" / t).iterdir())) for t in ("chunks", "mutations"))
    held = folders()
    assert engine.vacuum(hours=1) == 0 and engine.vacuum(hours=-1) >= 4 and folders() < held
    assert engine.get_objects(p.project_id, main).orderBy("path").collect() == before


def test_cleaning_during_a_write_is_a_conflict(engine, spark, monkeypatch):
    p = engine.create_project()
    write = engine._write

    def late(*args):
        other = Engine(spark, engine.log.root)
        other.log.publish(other.log.refresh().seq, {"replaces": [], "cleaned": True})
        return write(*args)

    monkeypatch.setattr(engine, "_write", late)
    with pytest.raises(errors.Conflict):
        engine.put_object(p.project_id, p.root_branch_id, "a", b"x")


def test_a_log_opens_from_its_newest_checkpoint(engine, spark, monkeypatch):
    p = engine.create_project()
    for _ in range(130):
        engine.create_branch(p.project_id, p.root_branch_id)
    fresh = Engine(spark, engine.log.root)
    seen, read = [], fresh.log.files.read
    monkeypatch.setattr(fresh.log.files, "read", lambda path: seen.append(path) or read(path))
    assert fresh.log.refresh().seq == 131 and len(fresh.log.state.handles) == 131
    assert len(seen) == 2 + 31 + 1  # pointer, checkpoint 100, the commits after it and the one that is not there


def test_objects_are_read_once(engine, spark):
    # an input that gives other bytes each time it is read still names only chunks that are stored
    p = engine.create_project()
    rows = spark.range(50).selectExpr("concat('o', id) AS path", "encode(uuid(), 'utf-8') AS content")
    engine.put_objects(p.project_id, p.root_branch_id, rows)
    assert engine.get_objects(p.project_id, p.root_branch_id).filter("content IS NOT NULL").count() == 50 and engine.orphan_chunks().count() == 0


def test_stores_that_cannot_create_exclusively_are_refused(engine):
    engine.log.files.local, engine.log.files.scheme = False, "ftp"
    with pytest.raises(errors.StorageError):
        engine.log.files.create("ftp://x/y", "z")


def test_deep_chains(spark):
    n = 10_000
    nodes = {i: {"node_id": i, "parent_node_id": i - 1 if i else None, "fork_lsn": 2 * i if i else None} for i in range(n)}
    chain = lineage.chain(nodes, n - 1)
    log = spark.createDataFrame([(0, 1, "a", False), (0, 3, "a", False), (500, 1001, "b", False), (700, 1401, "b", True), (9_000, 18_001, "c", None)], "node_id bigint, lsn bigint, path string, tombstone boolean")
    assert sorted((r.path, r.node_id, r.lsn) for r in resolve.resolved(log, chain).collect()) == [("a", 0, 1), ("c", 9_000, 18_001)]
    assert sorted((r.path, r.lsn) for r in resolve.resolved(log, lineage.chain(nodes, 600)).collect()) == [("a", 1), ("b", 1001)]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://somewhere:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(errors.StorageError):
        sources.shared_folder(Session())
    with pytest.raises(errors.InvalidInput):
        config.engine(Session(), {})


def test_stores_and_numbers_can_be_replaced(spark, tmp_path):
    class Memory:
        held: dict[str, list] = {}

        def keep(self, chunks, folder):
            self.held[folder] = chunks.collect()
            return [{"path": folder, "prefixes": ""}]

        def open(self, named, hashes=None):
            rows = [r for c in named for r in self.held[c["path"]]]
            return spark.createDataFrame(rows, schema.CHUNKS) if rows else None

    engine = Engine(spark, f"file://{tmp_path}/w", chunks=Memory(), numbering=lambda head: (head // 100 + 1) * 100)
    p = engine.create_project()
    assert [engine.put_object(p.project_id, p.root_branch_id, x, x.encode()).lsn for x in ("a", "b")] == [100, 200]
    assert engine.get_object(p.project_id, p.root_branch_id, "a") == b"a" and not (tmp_path / "w" / "chunks").exists()
    assert read(engine, p.project_id, p.root_branch_id, "b", 199) is None
    with pytest.raises(errors.StorageError):
        Engine(spark, engine.log.root, log=engine.log, numbering=lambda head: head).put_object(p.project_id, p.root_branch_id, "c", b"")


def test_threads_share_one_engine(engine):
    from concurrent.futures import ThreadPoolExecutor

    p = engine.create_project()
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda _: engine.create_branch(p.project_id, p.root_branch_id).branch_id, range(120)))
    fresh = Engine(engine.spark, engine.log.root).log.refresh()
    assert len(set(made)) == 120 and engine.log.state.seq == fresh.seq == 121
    assert engine.log.state.handles == fresh.handles and engine.log.state.nodes == fresh.nodes
