"""Parent links to full hierarchies: paths, depths, roots, descendants and circles, for trees of any depth.

Subtree sizes are summed upward, siblings then get disjoint preorder ranges by prefix sums, and the ranges are carried
downward, so that a node's descendants are the positions inside its range. All passes jump: after k rounds each node
points 2**k steps up, and so a chain of a million nodes takes twenty rounds, not a million. Nodes whose pointer never
leaves the table are on a circle or lead into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forkline.operators import intervals
from forkline.operators.ordering import with_offset
from forkline.sources import dropped, tidy, written, written_counting

#: Siblings up to which their ranges are allocated in one window group.
SIBLING_BLOCK = 100_000
#: Positions of a range that one row is expanded to at a time.
RANGE_BLOCK = 4096
PLACE = ["tree_kind", "scope"]


def links_of(df: DataFrame, kind: str, key: Column, parent: Column, scope: Column) -> DataFrame:
    """Links in long form. ``scope`` bounds where a parent is looked up."""
    return df.select(
        F.lit(kind).alias("tree_kind"), F.coalesce(scope.cast("string"), F.lit("")).alias("scope"),
        key.cast("string").alias("member_key"), parent.cast("string").alias("parent_key"),
    )


def _moved(df: DataFrame) -> tuple[DataFrame, int]:
    """The next state, written, and how many members still point somewhere."""
    return written_counting(df, F.col("ptr").isNotNull())


def _numbered(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with an ``id``, and ``id, parent`` by number; the parent is null if it is not recorded in the scope."""
    once = links.filter(F.col("member_key").isNotNull()).groupBy(*PLACE, "member_key").agg(F.min("parent_key").alias("parent_key"))
    members = written(once.withColumn("id", F.monotonically_increasing_id()))
    up = members.select(*PLACE, F.col("member_key").alias("parent_key"), F.col("id").alias("parent"))
    return members, written(members.join(up, [*PLACE, "parent_key"], "left").select("id", "parent"))


def subtree_sizes(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``id, size`` by the upward pass, final for members of trees, and the ``id`` of all others, None if there are none.

    Round k passes up the size within distance 2**k of every member that has an ancestor that far; others drop out, so a
    flat forest is done after a round or two. A member's size is one plus all that it was passed.
    """
    state, active = _moved(edges.filter("parent IS NOT NULL").select("id", F.col("parent").alias("ptr"), F.lit(1).cast("bigint").alias("size")))
    before, passed = -1, []
    while active and active != before:
        passed.append(state)
        gain = state.groupBy(F.col("ptr").alias("id")).agg(F.sum("size").alias("gain"))
        jump = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("further"))
        moved = state.join(jump, "ptr").join(gain, "id", "left")
        before = active
        state, active = _moved(moved.select("id", F.col("further").alias("ptr"), (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size")))
    parts = edges.select("id", F.lit(1).cast("bigint").alias("size"))
    for p in passed:
        parts = parts.unionByName(p.select(F.col("ptr").alias("id"), "size"))
    sizes = parts.groupBy("id").agg(F.sum("size").alias("size"))
    return written(sizes), state.select("id") if active else None


def carried(edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``id, start, depth, root[, path]`` by the downward pass over ``id, parent, offset``."""
    state = edges.select("id", F.col("parent").alias("ptr"), F.col("offset").alias("start"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), F.coalesce("parent", "id").alias("root"))
    if names is not None:
        state = state.join(names, "id")
    state, active = _moved(state)
    while active:
        jump = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), *[F.col(c).alias(f"_{c}") for c in state.columns if c not in ("id", "ptr")])
        moved = state.join(jump, "ptr", "left")
        to = [F.col("id"), F.col("_ptr").alias("ptr"), (F.col("start") + F.coalesce("_start", F.lit(0))).alias("start"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.coalesce("_root", "root").alias("root")]
        if names is not None:
            to.append(F.concat(F.coalesce("_path", F.lit("")), F.col("path")).alias("path"))
        last = state
        state, active = _moved(moved.select(*to))
        dropped(last)
    return state


def _circles(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``id, root_key`` of members on a circle or leading into one: the smallest key on that circle.

    Jumping shrinks the set of pointers to just the members on circles; there a jumping minimum finds the smallest key.
    """
    state = written(edges.select("id", F.col("parent").alias("ptr")))
    held, before = state.select("ptr").distinct().count(), -1
    while held != before:
        jump = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("further"))
        last, state = state, written(state.join(jump, "ptr").select("id", F.col("further").alias("ptr")))
        dropped(last)
        before, held = held, state.select("ptr").distinct().count()
    on = state.select(F.col("ptr").alias("id")).distinct()
    ring, changed = written_counting(on.join(edges, "id").join(members.select("id", "member_key"), "id").select("id", F.col("parent").alias("ptr"), F.col("member_key").alias("least"), F.lit(True).alias("new")), F.col("new"))
    while changed:
        jump = ring.select(F.col("id").alias("ptr"), F.col("ptr").alias("further"), F.col("least").alias("other"))
        moved = ring.join(jump, "ptr").select("id", F.col("further").alias("ptr"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("new"))
        last = ring
        ring, changed = written_counting(moved, F.col("new"))
        dropped(last)
    return state.join(ring.select(F.col("id").alias("ptr"), F.col("least").alias("root_key")), "ptr").select("id", "root_key")


@tidy
def hierarchy(links: DataFrame, paths: bool = False) -> DataFrame:
    """One row per member: ``tree_kind, scope, member_key, root_key, depth, start, size[, path]``.

    Members of trees hold the positions ``start`` to ``start + size - 1`` of one preorder over all trees, themselves at
    ``start``; ``size - 1`` is the number of descendants. ``path`` is the keys from the root down, each after a slash.
    A null parent, or one that is not recorded in the scope, makes a root (depth 0). On a circle, or where links lead
    into one, ``depth`` is -1, ``root_key`` the smallest key on that circle, and the other columns are null. Repeated
    links count once; of several parents of one key the smallest counts. A null key is no member.

    A parent with any number of children is one group of sums over hash buckets, never one task.
    """
    members, edges = _numbered(links)
    n = members.count()
    sizes, others = subtree_sizes(edges)
    trees = edges.join(others, "id", "left_anti") if others is not None else edges
    trees = trees.join(sizes, "id").select("id", "parent", F.coalesce("parent", F.lit(-1)).alias("above"), "size")
    placed = with_offset(trees, ["above"], "id", "size", max(1, -(-n // SIBLING_BLOCK)))
    placed = placed.select("id", "parent", (F.col("offset") + F.when(F.col("parent").isNull(), 0).otherwise(1)).alias("offset"))
    names = members.select("id", F.concat(F.lit("/"), "member_key").alias("path")) if paths else None
    down = carried(placed, names)
    roots = members.select(F.col("id").alias("root"), F.col("member_key").alias("root_key"))
    extra = ["path"] if paths else []
    out = down.join(sizes, "id").join(roots, "root").select("id", "root_key", "depth", "start", "size", *extra)
    if others is not None:
        stuck = edges.join(others, "id", "left_semi")
        nothing = F.lit(None).cast("bigint")
        rings = _circles(stuck, members).select("id", "root_key", F.lit(-1).cast("bigint").alias("depth"), nothing.alias("start"), nothing.alias("size"), *[F.lit(None).cast("string").alias(c) for c in extra])
        out = out.unionByName(rings)
    return members.join(out, "id").select(*PLACE, "member_key", "root_key", "depth", "start", "size", *extra)


def descendants(tree: DataFrame, of: DataFrame) -> DataFrame:
    """``tree_kind, member_key, descendant_key`` of the members of ``of`` (rows of ``tree``), against all members.

    The ranges of ``tree`` say the same for all members at once; pairs of all members grow with the square of the depth. Each range is expanded to its positions, which are unique, and those are looked up: the work is the output.
    Ranges are cut before they are expanded, so that no task holds more than a block of a large one.
    """
    spans = of.filter("size > 1").select("tree_kind", "member_key", (F.col("start") + 1).alias("lo"), (F.col("start") + F.col("size") - 1).alias("hi"))
    cut = spans.select("*", F.explode(F.sequence(F.floor(F.col("lo") / RANGE_BLOCK), F.floor(F.col("hi") / RANGE_BLOCK))).alias("block"))
    cut = cut.repartition("block")
    lo, hi = F.greatest(F.col("lo"), F.col("block") * RANGE_BLOCK), F.least(F.col("hi"), F.col("block") * RANGE_BLOCK + RANGE_BLOCK - 1)
    positions = cut.select("tree_kind", "member_key", F.explode(F.sequence(lo, hi)).alias("start"))
    at = tree.filter("start IS NOT NULL").select("start", F.col("member_key").alias("descendant_key"))
    return positions.join(at, "start").select("tree_kind", "member_key", "descendant_key")


def ancestors(tree: DataFrame, of: DataFrame) -> DataFrame:
    """``tree_kind, member_key, ancestor_key, distance`` of the members of ``of``: whose ranges hold their positions."""
    spans = tree.filter("size > 1").select(F.col("member_key").alias("ancestor_key"), F.col("depth").alias("above"), F.col("start").alias("lo"), (F.col("start") + F.col("size")).alias("hi"))
    bits = spans.agg(intervals.levels_in_use(spans, "lo", "hi").alias("bits")).first()["bits"]
    points = of.filter("depth > 0").select("tree_kind", "member_key", "depth", "start", F.lit(bits or 0).alias("bits"))
    met = intervals.probes(points, "start", "bits").join(intervals.filed(spans, "lo", "hi"), ["level", "cell"])
    met = met.filter((F.col("lo") < F.col("start")) & (F.col("start") < F.col("hi")))
    return met.select("tree_kind", "member_key", "ancestor_key", (F.col("depth") - F.col("above")).alias("distance"))


def collection_links(nodes: DataFrame, handles: DataFrame) -> DataFrame:
    """Both trees of a versioned collection: log segments (``node``) and current branches (``handle``)."""
    current = handles.groupBy("project_id", "branch_id").agg(F.max_by("parent_branch_id", "commit_seq").alias("parent_branch_id"))
    return links_of(nodes, "node", F.col("node_id"), F.col("parent_node_id"), F.col("project_id")).unionByName(
        links_of(current, "handle", F.col("branch_id"), F.col("parent_branch_id"), F.col("project_id"))
    )
