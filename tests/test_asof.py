"""Reads at a time against a walk of each read by hand, over random trees with all that is odd about them."""

import random

from forkline.operators import asof
from forkline.sources import written


def _walk(nodes, changes, leaf, path, at):
    """The version a read sees, by following parents one by one."""
    seen, limit = set(), at if at is not None else 2**62
    while leaf is not None and leaf not in seen:
        seen.add(leaf)
        found = [(lsn, dead) for lsn, dead in changes.get((leaf, path), ()) if lsn <= limit]
        if found:
            lsn, dead = max(found)
            return None if dead else (leaf, lsn)
        parent, fork = nodes.get(leaf, (None, None))
        if parent not in nodes:
            return None
        limit = limit if fork is None else min(limit, fork)
        leaf = parent
    return None


def _case(seed, base, dirty):
    """Segments, changes and reads of one random project; ids from ``base`` up."""
    rnd = random.Random(seed)
    n = rnd.randrange(2, 14)
    nodes = {base: (None, None)}
    for i in range(1, n):
        p = base + (rnd.randrange(i) if rnd.random() < 0.7 else i - 1)
        up = nodes[p][1] or 0
        fork = rnd.randrange(0, 30) if dirty and rnd.random() < 0.5 else up + rnd.randrange(0, 8)
        nodes[base + i] = (p, None if dirty and rnd.random() < 0.1 else fork)
    if dirty and n > 4:  # a circle, a parent that nobody records
        nodes[base + 1] = (base + rnd.randrange(1, n), rnd.choice([5, 9, None]))
        nodes[base + 2] = (10**9, 4)
    changes = {}
    for _ in range(rnd.randrange(1, 40)):
        node = base + rnd.randrange(n)
        least = 0 if dirty else (nodes[node][1] or 0) + 1
        lsn = least + rnd.randrange(0, 30)
        cell = changes.setdefault((node, rnd.choice("ab")), {})
        cell[lsn] = rnd.random() < 0.25
    reads = [(base + rnd.randrange(n + 1), rnd.choice("abc"), rnd.choice([None, *range(-1, 45)])) for _ in range(30)]
    return nodes, {k: list(v.items()) for k, v in changes.items()}, reads


def _frames(spark, cases):
    nodes, changes, handles, reads, want = [], [], [], [], []
    for c, (n, m, r) in enumerate(cases):
        nodes += [(f"p{c}", i, p, f) for i, (p, f) in n.items()] * 2
        changes += [(i, path, lsn, dead or None) for (i, path), v in m.items() for lsn, dead in v] * 2
        leaves = {leaf for leaf, _, _ in r}
        handles += [(f"p{c}", f"b{leaf}", leaf, 2) for leaf in leaves] + [(f"p{c}", f"b{leaf}", 77, 1) for leaf in leaves]
        for leaf, path, at in r:
            k = len(reads)
            reads.append((k, f"p{c}", f"b{leaf}", path, at))
            if (v := _walk(n, m, leaf, path, at)) is not None:
                want.append((k, *v))
    reads += reads[:50] + [(None, "p0", None, "a", 1), (10**6, "p0", "none", "a", 1), (10**6 + 1, None, None, None, None)]
    changes += [(None, "a", 1, None), (nodes[0][1], None, 1, None), (nodes[0][1], "a", None, True)]
    handles += [(None, None, None, None), ("p0", None, 1, 1)]
    nodes += [(None, None, None, None), ("p0", None, 1, 1)]
    return [
        spark.createDataFrame(reads, "request_id bigint, project_id string, branch_id string, path string, at_lsn bigint"),
        spark.createDataFrame(handles, "project_id string, branch_id string, node_id bigint, commit_seq bigint"),
        spark.createDataFrame(nodes, "project_id string, node_id bigint, parent_node_id bigint, fork_lsn bigint"),
        spark.createDataFrame(changes, "node_id bigint, path string, lsn bigint, tombstone boolean"),
    ], want


def test_reads_match_a_walk(spark):
    frames, want = _frames(spark, [_case(seed, 1000 * (seed + 1), seed % 4 > 0) for seed in range(60)])
    got = sorted(map(tuple, asof.visible_versions(*frames).collect()))
    assert got == sorted(want) and len(want) > 300


def test_rectangles_are_disjoint_and_few(spark):
    (_, handles, nodes, mutations), _ = _frames(spark, [_case(seed, 1000 * (seed + 1), False) for seed in range(40)])
    places, reaches, hops = asof.layout(nodes, handles.filter("branch_id IS NOT NULL").selectExpr("node_id AS id").distinct())
    laid = written(asof.sheets(mutations, places, reaches))
    tiles = asof.rectangles(laid).collect()
    assert hops.count() == 0 and 0 < len(tiles) <= 3 * laid.count()
    for a in tiles:
        for b in tiles:
            if a is not b and a.path == b.path:
                far = 2**61
                assert max(a.x0, b.x0) >= min(a.x1, b.x1) or max(a.y0, b.y0) >= min(a.y1 or far, b.y1 or far)


def test_empty_tables(spark):
    frames, _ = _frames(spark, [_case(1, 1000, False)])
    for i in range(4):
        some = [f.limit(0) if k == i else f for k, f in enumerate(frames)]
        assert asof.visible_versions(*some).count() == 0 or i == 2


def test_positions_at_the_ends_of_their_type(spark):
    least, most = -(2**63), 2**63 - 1
    nodes = spark.createDataFrame([("p", 1, None, None), ("p", 2, 1, most), ("p", 3, 1, least)], "project_id string, node_id bigint, parent_node_id bigint, fork_lsn bigint")
    handles = spark.createDataFrame([("p", f"b{i}", i, 1) for i in (1, 2, 3)], "project_id string, branch_id string, node_id bigint, commit_seq bigint")
    mutations = spark.createDataFrame([(1, "a", least, None), (1, "a", 5, None), (1, "b", 7, None)], "node_id bigint, path string, lsn bigint, tombstone boolean")
    reads = [(1, "p", "b1", "a", None), (2, "p", "b1", "a", most), (3, "p", "b1", "a", 4), (4, "p", "b2", "b", None), (5, "p", "b2", "b", least), (6, "p", "b3", "b", None)]
    requests = spark.createDataFrame(reads, "request_id bigint, project_id string, branch_id string, path string, at_lsn bigint")
    got = sorted(map(tuple, asof.visible_versions(requests, handles, nodes, mutations).collect()))
    assert got == [(1, 1, 5), (2, 1, 5), (3, 1, least), (4, 1, 7)]
