"""Edge cases of the core's data-processing operators on small tables: nulls, ties, repeats, empty tables, extra columns."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from forkline.operators import asof, changefeed, hierarchy, intervals, ordering, references, snapshot_diff

MUTATIONS = "project_id string, node_id bigint, lsn bigint, path string, chunks array<string>, size bigint, content_type string, tombstone boolean, created_at bigint, arrived_at timestamp"
CHUNKS = "hash string, byte_offset bigint, length bigint, stored_at bigint, deleted_at bigint"
HANDLES = "project_id string, branch_id string, node_id bigint, parent_branch_id string, created_at bigint, commit_seq bigint, deleted_at bigint"
NODES = "project_id string, node_id bigint, parent_node_id bigint, fork_lsn bigint"
REQUESTS = "request_id bigint, project_id string, branch_id string, path string, at_lsn bigint, requested_at timestamp"
SNAPSHOTS = "project_id string, snapshot_id string, branch_id string, lsn bigint, created_at bigint"
LISTING = "snapshot_id string, path string, lsn bigint, size bigint, content_type string"
#: Columns whose names the operators use inside.
CLASH = ("since", "scope", "parent", "ptr", "cap", "level", "cell", "_block", "rank", "start", "next_value", "bits", "_hash", "feed")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def clash(df):
    return df.select("*", *[F.lit(7).alias(c) for c in CLASH if c not in df.columns])


def change(node, lsn, path="a", chunks=(), tombstone=False, at=100, size=1, kind="t"):
    return ("p", node, lsn, path, None if chunks is None else list(chunks), size, kind, tombstone, at, None)


def test_orphans(spark):
    m = spark.createDataFrame(
        [change(1, 1, chunks=["AA", "bb", "aa"]), change(1, 1, chunks=["AA", "bb", "aa"]), change(1, 2, None, chunks=["cc", None]), change(1, 3, chunks=["dd"], at=None), change(1, 4, chunks=None), change(1, 5, chunks=["ee"], at=5)],
        MUTATIONS,
    )
    c = spark.createDataFrame([("aa", 0, 1, 50, None), ("aa", 0, 1, 200, None), ("bb", 0, 1, 1, 60), ("dd", 0, 1, 1, None), ("ee", 0, 1, 6, None), (None, 0, 1, 1, None)], CHUNKS)
    h = spark.createDataFrame(
        [
            ("p", "root", 1, None, 10, 1, None), ("p", "old", 1, "root", 10, 1, None), ("p", "old", 1, "root", 10, 2, 99), ("p", "a", 1, "old", 20, 1, None),
            ("p", "b", 1, "gone", 20, 1, None), ("p", "c", 1, "root", 5, 1, None), ("q", "d", 1, "root", 20, 1, None), ("p", "e", 1, "root", 10, 1, None),
        ],
        HANDLES,
    )
    found = references.orphans(*references.collection_references(clash(m), clash(c), clash(h)))
    got = {(r.ref_table, r.ref_key, r.target_key): r.reason for r in found.collect()}
    assert got == {
        ("mutations", "1:1", "bb"): "deleted", ("mutations", "1:2", "cc"): "missing", ("mutations", "1:3", "dd"): "later", ("mutations", "1:5", "ee"): "later",
        ("branch_handles", "a", "old"): "deleted", ("branch_handles", "b", "gone"): "missing", ("branch_handles", "c", "root"): "later", ("branch_handles", "d", "root"): "missing",
    }
    counts = {(r.ref_table, r.month, r.reason): r.n_orphans for r in references.orphan_counts(found).collect()}
    assert counts["mutations", None, "later"] == 1 and counts["mutations", "1970-01", "later"] == 1
    assert references.orphans(*references.collection_references(m.limit(0), c.limit(0), h.limit(0))).count() == 0


def test_hot_orphan_key(spark):
    m = spark.range(20000).select(F.lit("p").alias("project_id"), F.col("id").alias("node_id"), F.lit(1).cast("bigint").alias("lsn"), F.lit(5).cast("bigint").alias("created_at"), F.array(F.lit("hot")).alias("chunks"))
    found = references.orphans(*references.collection_references(m, spark.createDataFrame([], CHUNKS), spark.createDataFrame([], HANDLES)))
    assert found.count() == 20000


def test_layer_state(spark):
    feed = spark.createDataFrame(
        [
            change(1, 2, "a", tombstone=None), change(1, 1, "a", tombstone=True), change(1, 1, "b"), change(1, 3, "b", None, True), change(1, 3, "b", None, True),
            change(1, 1, "c", size=5), change(1, 1, "c", size=None, kind=None), change(2, 9, "a"), change(1, 4, None), change(1, None, "n"),
        ],
        MUTATIONS,
    )
    assert rows(changefeed.layer_state(clash(feed))) == [(1, "a", 2), (1, "c", 1), (2, "a", 9)]
    full = {(r.node_id, r.path): (r.size, r.content_type) for r in changefeed.layer_state(feed, ["chunks", "size", "content_type"]).collect()}
    assert full[1, "c"] == (5, "t")
    assert changefeed.layer_state(feed.limit(0)).count() == 0


def test_apply_changes_column_wise(spark):
    data = [
        (1, 1, "put", 1, "x"), (1, 2, "set", None, "y"), (2, 1, "put", 1, "x"), (2, 2, "del", None, None), (2, 3, "set", 5, None),
        (3, 1, "put", 1, "x"), (3, 2, "put", None, "z"), (4, 1, "put", 1, "x"), (4, 1, "del", None, None), (None, 1, "put", 8, "n"), (5, 1, "put", 1, "a"), (5, 1, "put", 2, None),
    ]
    feed = spark.createDataFrame(data, "k int, seq bigint, op string, v int, w string")
    for part in (feed, feed.orderBy(F.rand(1)), feed.union(feed)):
        got = rows(changefeed.apply_changes(part, ["k"], "seq", "op = 'del'", ["v", "w"], "op = 'put'"))
        assert got == sorted([(1, 2, 1, "y"), (2, 3, 5, None), (3, 2, None, "z"), (None, 1, 8, "n"), (5, 1, 2, "a")], key=repr)


def brute_tree(parent):
    out = {}
    for v in parent:
        seen, u = [], v
        while u is not None and u not in seen:
            seen.append(u)
            u = parent[u] if parent[u] in parent else None
        out[v] = (seen[-1], len(seen) - 1) if u is None else (min(seen[seen.index(u) :]), -1)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_hierarchy_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    n = 60
    names = [f"{rnd.randrange(10**6):06d}-{i}" for i in range(n)]
    parent = {v: rnd.choice([*names, None, "absent"]) if rnd.random() < 0.5 else (names[i - 1] if i else None) for i, v in enumerate(names)}
    data = [("s", v, u) for v, u in parent.items()] * 2 + [("s", None, names[0])]
    links = hierarchy.links_of(clash(spark.createDataFrame(data, "scope string, member string, up string")), "k", F.col("member"), F.col("up"), F.col("scope"))
    tree = hierarchy.hierarchy(links, paths=True).cache()
    want = brute_tree(parent)
    assert {r.member_key: (r.root_key, r.depth) for r in tree.collect()} == want
    held = [r for r in tree.collect() if r.depth >= 0]
    assert sorted(r.start for r in held) == list(range(len(held)))
    ups = {(v, w, d) for v in parent if want[v][1] >= 0 for d, w in enumerate(chain_of(parent, v)) if d}
    assert {(r.member_key, r.ancestor_key, r.distance) for r in hierarchy.ancestors(tree, tree).collect()} == ups
    assert {(r.descendant_key, r.member_key) for r in hierarchy.descendants(tree, tree).collect()} == {(v, w) for v, w, _ in ups}
    assert all(r.path == "".join(f"/{x}" for x in reversed(chain_of(parent, r.member_key))) for r in held)


def chain_of(parent, v):
    out = []
    while v is not None and v in parent:
        out.append(v)
        v = parent[v]
    return out


def test_hierarchy_shapes(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "SIBLING_BLOCK", 50)  # siblings in several buckets
    star = [("s", "root", None)] + [("s", f"c{i}", "root") for i in range(300)]
    chain = [("t", f"{i:04d}", f"{i - 1:04d}" if i else None) for i in range(300)]
    loop = [("u", "self", "self"), ("u", "x", "self"), ("v", "root", "c1")]
    links = hierarchy.links_of(spark.createDataFrame(star + chain + loop, "scope string, m string, u string"), "k", F.col("m"), F.col("u"), F.col("scope"))
    got = {(r.scope, r.member_key): (r.root_key, r.depth, r.size) for r in hierarchy.hierarchy(links).collect()}
    assert got["s", "root"] == ("root", 0, 301) and got["s", "c7"] == ("root", 1, 1)
    assert got["t", "0299"] == ("0000", 299, 1) and got["t", "0000"][2] == 300
    assert got["u", "self"] == got["u", "x"] == ("self", -1, None)
    assert got["v", "root"] == ("root", 0, 1)
    assert hierarchy.hierarchy(links.limit(0)).count() == 0


def brute_reads(requests, handles, nodes, mutations):
    leaf, parent, log = {}, {}, defaultdict(list)
    for h in sorted(handles, key=lambda h: h[5]):
        leaf[h[0], h[1]] = h[2]
    for p, n, u, f in nodes:
        parent[n] = (p, u, f)
    for m in mutations:
        log[m[1], m[3]].append((m[2], bool(m[7])))
    out = set()
    for rid, p, b, path, at, _ in requests:
        n, cap, seen = leaf.get((p, b)), 10**18 if at is None else at, set()
        while n is not None and n not in seen and path is not None:
            seen.add(n)
            hits = [x for x in log[n, path] if x[0] <= cap]
            if hits:
                lsn, dead = max(hits)
                if not dead:
                    out.add((rid, n, lsn))
                break
            _, u, f = parent.get(n, (None, None, None))
            cap = cap if f is None else min(cap, f)
            n = u if u in parent and parent[u][0] == parent[n][0] else None
    return out


@pytest.mark.parametrize("seed", range(2))
def test_reads_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    n = 30
    nodes = [("p", i, rnd.choice([None, i - 1, i - 1, rnd.randrange(n), 999]) if i else None, rnd.choice([None, rnd.randrange(40)])) for i in range(n)]
    handles = [("p", f"b{i}", i, None, 1, 2, None) for i in range(n)] + [("p", "b1", 0, None, 1, 1, None)]
    mutations = list({(m[1], m[2]): m for m in (change(rnd.randrange(n), rnd.randrange(1, 60), rnd.choice("abc"), tombstone=rnd.random() < 0.3) for _ in range(200))}.values())
    requests = [(i, "p", f"b{rnd.randrange(n)}", rnd.choice("abcd"), rnd.choice([None, 0, 5, 30, 100, 10**15]), None) for i in range(200)]
    extra = [(900, "p", "none", "a", None, None), (901, "p", "b1", None, None, None)]
    frames = [spark.createDataFrame(requests + extra + requests[:20], REQUESTS), spark.createDataFrame(handles * 2, HANDLES), spark.createDataFrame(nodes * 2, NODES), spark.createDataFrame(mutations * 2 + [change(1, 1, None), change(1, None, "a")], MUTATIONS)]
    want = brute_reads(requests, handles, nodes, mutations)
    assert {tuple(r) for r in asof.visible_versions(*map(clash, frames)).collect()} == want
    for i in range(4):
        empty = [f.limit(0) if i == k else f for k, f in enumerate(frames)]
        got = {tuple(r) for r in asof.visible_versions(*empty).collect()}
        assert got == brute_reads(*[[] if i == k else x for k, x in enumerate((requests, handles, nodes, mutations))])


def test_interval_grid(spark):
    rnd = random.Random(3)
    spans = [(i, lo, rnd.choice([None, lo + 1, lo + rnd.randrange(1, 9), lo + rnd.randrange(1, 5000)])) for i, lo in enumerate(rnd.sample(range(10000), 200))]
    points = rnd.sample(range(16000), 300)
    left, right = spark.createDataFrame(spans, "i int, lo bigint, hi bigint"), spark.createDataFrame([(p,) for p in points], "p bigint")
    bits = left.agg(intervals.levels_in_use(left, "lo", "hi").alias("b")).first()["b"]
    met = intervals.probes(right.withColumn("b", F.lit(bits)), "p", "b").join(intervals.filed(left, "lo", "hi"), ["level", "cell"])
    met = met.filter("lo <= p AND (hi IS NULL OR p < hi)")
    got = [(r.i, r.p) for r in met.collect()]
    assert sorted(got) == sorted((i, p) for i, lo, hi in spans for p in points if lo <= p and (hi is None or p < hi))


def test_snapshot_changes(spark):
    s = spark.createDataFrame(
        [("p", "s1", "b", 9, 100), ("p", "s2", "b", 3, 10**12), ("p", "s2", "b", 3, 10**12), ("p", "s3", "b", 5, 2 * 10**12), ("p", "s0", "c", 5, 1), ("p", "s9", "c", 5, None)], SNAPSHOTS
    )
    o = spark.createDataFrame(
        [
            ("s1", "a", 1, 1, "t"), ("s1", "b", 1, 1, "t"), ("s1", "b", 2, 1, "t"), ("s1", "c", 1, None, "t"), ("s1", "c", 1, 4, None), ("s1", None, 1, 1, "t"),
            ("s3", "a", 1, 1, "t"), ("s3", "a", 1, 1, "t"), ("s0", "z", 1, 1, "t"),
        ],
        LISTING,
    )
    got = rows(snapshot_diff.snapshot_changes(clash(s), clash(o)).select("snapshot_id", "path", "change_kind"))
    assert got == [("s2", "a", "removed"), ("s2", "b", "removed"), ("s2", "c", "removed"), ("s3", "a", "added")]
    later = o.filter("snapshot_id = 's1'").withColumn("snapshot_id", F.lit("s2")).withColumn("size", F.when(F.col("path") == "a", 7).otherwise(F.col("size")))
    both = o.filter("snapshot_id <> 's3'").unionByName(later)
    assert rows(snapshot_diff.snapshot_changes(s, both, ["lsn", "size", "content_type"]).filter("snapshot_id = 's2'")) == [("s2", "a", "changed", 1, 1, 1, 7, "t", "t")]
    assert rows(snapshot_diff.snapshot_changes(s, both).filter("snapshot_id = 's2'")) == []
    for a, b in ((s.limit(0), o), (s, o.limit(0))):
        assert snapshot_diff.snapshot_changes(a, b).count() == 0


def test_row_hash_tells_values_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, ""), ("", None), ("-", "")], "x string, y string")
    assert df.select(snapshot_diff.row_hash(["x", "y"]).alias("h")).distinct().count() == 5


@pytest.mark.parametrize("block", [1, 7, 10**6])
def test_order_helpers(spark, block):
    rnd = random.Random(block)
    data = [(k, v, rnd.randrange(5)) for k in ("a", "b", None) for v in rnd.sample(range(300), 60)]
    df = spark.createDataFrame(data, "k string, v bigint, w bigint")
    per = defaultdict(list)
    for k, v, _ in data:
        per[k].append(v)
    nexts = {(r.k, r.v): r.n for r in ordering.with_next(df, ["k"], "v", block, "n").collect()}
    assert nexts == {(k, v): min((x for x in vs if x > v), default=None) for k, vs in per.items() for v in vs}
    ranks = {(r.k, r.v): r["rank"] for r in ordering.ranked(df.filter("k IS NOT NULL"), ["k"], "v", block).collect()}
    assert ranks == {(k, v): sum(x <= v for x in vs) for k, vs in per.items() if k for v in vs}
    numbered, n = ordering.numbered(df, [F.col("k"), F.col("v")], 5, "at")
    assert n == len(data)
    order = [(r.k or "", r.v) for r in sorted(numbered.collect(), key=lambda r: r.at)]
    assert order == sorted(order) and {r.at for r in numbered.collect()} == set(range(5, 5 + n))


def test_offsets_are_disjoint(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id"), (F.col("id") % 5 + 1).alias("w"))
    for buckets in (1, 8):
        got = ordering.with_offset(df, ["g"], "id", "w", buckets).collect()
        for g in range(3):
            spans = sorted((r.offset, r.offset + r.w) for r in got if r.g == g)
            assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_rows_of_nulls_change_nothing(spark):
    from .conftest import DATA

    def load(name):
        return spark.read.parquet(f"{DATA}/{name}.parquet")

    def nulls(df):
        return df.unionByName(spark.createDataFrame([tuple([None] * len(df.columns))] * 2, df.schema))

    def results(change):
        m, c, h, n, r, s, o = (change(load(t)) for t in ("mutations", "chunks", "branch_handles", "branch_nodes", "read_requests", "snapshots", "snapshot_objects"))
        yield references.orphans(*references.collection_references(m, c, h))
        yield changefeed.layer_state(m, ["chunks", "size"])
        yield hierarchy.hierarchy(hierarchy.collection_links(n, h)).select("tree_kind", "member_key", "root_key", "depth", "size")
        yield asof.visible_versions(r, h, n, m)
        yield snapshot_diff.snapshot_changes(s, o, ["lsn", "size"])

    for plain, nulled in zip(results(lambda df: df), results(nulls)):
        assert rows(plain) == rows(nulled)


@pytest.mark.parametrize("rows_of_a_range", [5, 1_000_000])
def test_last_values_and_sweeps_over_blocks(spark, monkeypatch, rows_of_a_range):
    monkeypatch.setattr(ordering, "RANGE_ROWS", rows_of_a_range)
    rnd = random.Random(4)
    rows = [(rnd.randrange(3), i, rnd.choice([None, i * 10])) for i in rnd.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "k int, at bigint, v bigint").withColumn("w", F.col("v") + 1)
    got = {(r.k, r["at"]): (r.last_v, r.last_w) for r in ordering.with_last(df, ["k"], "at", 16, ["v", "w"], "last_").collect()}
    for k, at, _ in rows:
        earlier = [(a, v) for kk, a, v in rows if kk == k and a < at and v is not None]
        assert got[k, at] == ((max(earlier)[1], max(earlier)[1] + 1) if earlier else (None, None))
    run = ordering.swept(df, [F.col("k"), F.col("at")], F.when(F.col("v").isNull(), -1).otherwise(1), F.struct("k", "at"), "n", "level", "following", 200).collect()
    level = 0
    for i, r in enumerate(sorted(run, key=lambda r: (r.k, r["at"]))):
        level += -1 if r.v is None else 1
        assert (r.n, r.level) == (i + 1, level)
    assert sum(r.following is None for r in run) == 1
    assert ordering.swept(df.limit(0), [F.col("k"), F.col("at")], F.lit(1), F.struct("k", "at"), "n", "level", "following").count() == 0


def test_sorted_offsets(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, 1, 2]), i, rnd.randrange(1, 5)) for i in range(100)]
    df = spark.createDataFrame(rows, "g int, i int, w bigint")
    got = {r.i: r.offset for r in ordering.with_sorted_offset(df, ["g"], [-F.col("i")], "w").collect()}
    assert got == {i: sum(w for gg, j, w in rows if gg == g and j > i) for g, i, _ in rows}
