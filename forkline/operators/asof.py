"""Attributes as known at an event's time: which version of an object a read sees.

The plane has the tree of log segments on one axis, as positions of a preorder, and the log position on the other. A
change is visible from its own position upward, on its segment and on all below that were forked late enough. Where
siblings are laid out by falling fork position, those are one range of the preorder, so that a change is a quarter plane
over a range, and what hides it (a later change of its segment, or one of a segment below) is a quarter plane within that
range. Cut along those, the plane of a path falls into disjoint rectangles with one current version each, at most three
for each change. They are indexed by a grid over both axes, and every read is located in it as a point.

That needs fork positions that do not fall on the way down. A segment forked before its parent's own fork starts a block
of its own, outside of which its readers see less than others; a read is then one point in its own block and one in each
block above it, each with the limit that holds there, and the nearest block decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forkline.operators import intervals
from forkline.operators.hierarchy import carried, subtree_sizes
from forkline.operators.ordering import swept, with_last, with_next, with_sorted_offset
from forkline.sources import dropped, tidy, written, written_counting

#: Log positions, or numbers of changes, of one block when they are put in order.
BLOCK = 4096
#: Log positions beyond count as this one.
FAR = 1 << 60


def _near(position: Column) -> Column:
    return F.greatest(F.least(position, F.lit(FAR)), F.lit(-FAR))


def segment_edges(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """``id, ptr, fork``: each segment with its parent and the position it was forked at (no limit: the greatest).

    A parent that is null or not recorded in the project is none. Repeated rows count once; among several rows of one
    segment the smallest project, then parent counts. ``leaves`` (``id``) are there also where no row records them.
    """
    row = F.struct("project_id", "parent_node_id", "fork_lsn")
    real = nodes.filter("node_id IS NOT NULL").select(F.col("node_id").alias("id"), row.alias("up"))
    once = real.unionByName(leaves.select("id", F.lit(None).cast(real.schema["up"].dataType).alias("up"))).groupBy("id").agg(F.min("up").alias("up"))
    there = once.filter("up IS NOT NULL").select(F.col("up.project_id").alias("p"), F.col("id").alias("ptr"))
    known = F.col("up.project_id").eqNullSafe(F.col("p")) & (F.col("up.parent_node_id") == F.col("ptr"))
    return once.join(there, known, "left").select("id", "ptr", F.when(F.col("ptr").isNotNull(), _near(F.coalesce("up.fork_lsn", F.lit(FAR)))).alias("fork"))


def _blocks(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, ptr, fork, parent`` with the parent within the block, null for a block's first segment, and ``id, size``.

    Links in a circle whose fork positions never fall are all cut.
    """
    above = edges.filter("ptr IS NOT NULL").select(F.col("id").alias("ptr"), F.col("fork").alias("above"))
    kept = edges.join(above, "ptr", "left").select("id", "ptr", "fork", F.when(F.col("above").isNull() | (F.col("fork") >= F.col("above")), F.col("ptr")).alias("parent"))
    kept = written(kept)
    sizes, around = subtree_sizes(kept)
    if around is not None:
        cut = around.select("id", F.lit(True).alias("_cut"))
        kept = kept.join(cut, "id", "left").withColumn("parent", F.when(F.col("_cut").isNull(), F.col("parent"))).drop("_cut")
        sizes = sizes.join(cut, "id", "left").select("id", F.when(F.col("_cut").isNull(), F.col("size")).otherwise(1).alias("size"))
    return kept, sizes


def _circling(edges: DataFrame) -> DataFrame | None:
    """The ``id`` of members whose walk never ends, None if there are none: those left when a round ends no walk."""
    state, active = written_counting(edges.filter("ptr IS NOT NULL").select("id", "ptr"), F.lit(True))
    before = -1
    while active and active != before:
        jump = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("further"))
        last, before = state, active
        state, active = written_counting(state.join(jump, "ptr").select("id", F.col("further").alias("ptr")), F.lit(True))
        dropped(last)
    return state.select("id") if active else None


def _own(edges: DataFrame) -> DataFrame:
    return edges.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("cap"))


def _further(hop: DataFrame, pairs: DataFrame, step: int) -> DataFrame:
    """The pairs reached through ``hop`` (``id, ptr, hop_cap``: where each walk is after ``step`` links)."""
    onward = hop.join(pairs.withColumnRenamed("id", "ptr"), "ptr")
    return onward.select("id", "ancestor", (F.col("depth") + step).alias("depth"), F.least("hop_cap", "cap").alias("cap"))


def _straight(edges: DataFrame) -> DataFrame:
    """The lineage pairs of members whose walks end."""
    up = edges.filter("ptr IS NOT NULL").select(F.col("id").alias("ancestor"), "ptr", F.col("cap").alias("more"))
    last = pairs = _own(edges)
    step = 1
    while True:
        hop = last.filter(F.col("depth") == step - 1).join(up, "ancestor").select("id", "ptr", F.least("cap", "more").alias("hop_cap"))
        last, made = written_counting(_further(hop, pairs, step), F.lit(True))
        if not made:
            return pairs
        pairs, step = pairs.unionByName(last), step * 2


def _around(edges: DataFrame) -> DataFrame:
    """The lineage pairs of members on circles or leading into them, each ancestor at its first visit.

    Limits only fall on the way, so a second visit sees nothing new.
    """
    state = edges.select("id", "ptr", F.col("cap").alias("hop_cap"))
    pairs, step, held, before = _own(edges), 1, 0, -1
    while held != before:
        # of two visits the first is limited less
        both = pairs.unionByName(_further(state, pairs, step)).groupBy("id", "ancestor").agg(F.min(F.struct("depth", "cap")).alias("v"))
        before = held
        pairs, held = written_counting(both.select("id", "ancestor", "v.depth", "v.cap"), F.lit(True))
        jump = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("further"), F.col("hop_cap").alias("more"))
        state = written(state.join(jump, "ptr").select("id", F.col("further").alias("ptr"), F.least("hop_cap", "more").alias("hop_cap")))
        step *= 2
    return pairs


def _lineage(edges: DataFrame) -> DataFrame:
    """``id, ancestor, depth, cap`` over ``id, ptr, cap``: each member with itself (depth 0) and all its ancestors.

    ``cap`` is the lowest on the way, null where nothing limits. Each round doubles the distance, so the rounds are the
    logarithm of the depth, and every pair is made once.
    """
    circling = _circling(edges)
    if circling is None:
        return _straight(edges)
    return _straight(edges.join(circling, "id", "left_anti")).unionByName(_around(edges.join(circling, "id", "left_semi")))


@tidy
def layout(nodes: DataFrame, leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The axis of segments: ``places, reaches, hops``.

    ``places`` is ``id, start, block``: a segment's position. ``reaches`` is ``id, lo, hi, reach``: a change of the
    segment at a position from ``lo`` to before ``hi`` is visible on the positions ``start`` to ``start + reach`` of its
    block. ``hops`` is ``block, hop, start, cap``: from a block the reader goes on at ``start``, in the order of ``hop``,
    with a limit of ``cap``.
    """
    edges = written(segment_edges(nodes, leaves))
    kept, sizes = _blocks(edges)
    sized = kept.join(sizes, "id").select("id", "ptr", "fork", "parent", "size")
    placed = written(with_sorted_offset(sized, ["parent"], [F.when(F.col("parent").isNotNull(), -F.col("fork")), F.col("id")], "size", rows=edges.count()))
    inner = placed.filter("parent IS NOT NULL")
    down = placed.select("id", "parent", (F.col("offset") + F.when(F.col("parent").isNull(), 0).otherwise(1)).alias("offset"))
    places = written(carried(down).select("id", "start", F.col("root").alias("block")))

    # children of equal fork position reach equally far; those of the next lower one add to it
    ends = inner.groupBy(F.col("parent").alias("id"), (-F.col("fork")).alias("above")).agg(F.max(F.col("offset") + F.col("size")).alias("reach"))
    ends = with_next(ends, ["id"], "above", BLOCK, "below")
    some = ends.select("id", F.coalesce(1 - F.col("below"), F.lit(-FAR)).alias("lo"), (1 - F.col("above")).alias("hi"), "reach")
    open_end = F.lit(None).cast("bigint").alias("hi")
    top = placed.join(ends.groupBy("id").agg(F.min("above").alias("above")), "id", "left").select("id", F.coalesce(1 - F.col("above"), F.lit(-FAR)).alias("lo"), open_end, F.lit(0).cast("bigint").alias("reach"))
    reaches = written(some.unionByName(top))

    outer = placed.filter("parent IS NULL").join(places.select(F.col("id").alias("ptr"), F.col("start").alias("entry"), F.col("block").alias("onto")), "ptr", "left")
    outer = written(outer.select("id", F.col("onto").alias("ptr"), F.col("fork").alias("cap"), "entry"))
    leaving = outer.filter("ptr IS NOT NULL").select(F.col("id").alias("ancestor"), "entry", F.col("cap").alias("last"))
    walks = _lineage(outer.select("id", "ptr", "cap")).join(leaving, "ancestor")
    hops = walks.select(F.col("id").alias("block"), (F.col("depth") + 1).alias("hop"), F.col("entry").alias("start"), F.least("cap", "last").alias("cap"))
    return places, reaches, written(hops)


def changes(mutations: DataFrame) -> DataFrame:
    """``id, path, lsn, dead``: each change once; ``dead`` marks tombstones. Rows without path, segment or position take no part."""
    rows = mutations.filter("node_id IS NOT NULL AND path IS NOT NULL AND lsn IS NOT NULL")
    return rows.groupBy(F.col("node_id").alias("id"), "path", "lsn").agg(F.max(F.coalesce("tombstone", F.lit(False)).cast("int")).alias("dead"))


def sheets(mutations: DataFrame, places: DataFrame, reaches: DataFrame) -> DataFrame:
    """``path, lo, hi, lsn, dead``: each change with the range of positions it is visible on, itself from ``lsn`` upward."""
    levels = reaches.groupBy("id").agg(intervals.levels_in_use(reaches, "lo", "hi").alias("bits"))
    known = written(places.join(levels, "id").select("id", "start", "bits"))
    at = changes(mutations).join(known, "id").withColumn("at", _near(F.col("lsn")))
    met = intervals.probes(at, "at", "bits").join(intervals.filed(reaches, "lo", "hi"), ["id", "level", "cell"])
    met = met.filter((F.col("lo") <= F.col("at")) & (F.col("hi").isNull() | (F.col("at") < F.col("hi"))))
    return met.select("path", F.col("start").alias("lo"), (F.col("start") + 1 + F.col("reach")).alias("hi"), "lsn", "dead")


def rectangles(sheets: DataFrame) -> DataFrame:
    """``path, x0, x1, y0, y1, v``: disjoint rectangles, each with the version current there (``v``: lo, lsn, dead of its sheet).

    Ranges of one path lie within each other or apart. Sorted like brackets, each has the one around it as the last
    opened before it one level up; over a range the outer version holds from its position up to the inner one's, and
    between the brackets the innermost holds without end. Where a change lies at or below the fork of its own segment,
    rectangles of outer segments may overlap its own; there the one with the greatest ``v`` holds.
    """
    events = sheets.withColumn("opens", F.explode(F.array(F.lit(0), F.lit(1))))
    opens = F.col("opens") == 1
    pos = F.when(opens, F.col("lo")).otherwise(F.col("hi"))
    # at one position those that end come first, inner ones before outer ones, then those that begin, outer ones first
    order = [F.col("path"), pos, F.col("opens"), -F.when(opens, F.col("hi")).otherwise(F.col("lo")), F.when(opens, F.col("lsn")).otherwise(F.bitwise_not("lsn"))]
    run = swept(events, order, F.when(opens, 1).otherwise(-1), F.struct("path", pos.alias("pos")), "g", "level", "following", 2 * sheets.count())
    own_level = F.when(opens, F.col("level")).otherwise(F.col("level") + 1)
    next_pos = F.when(F.col("following.path") == F.col("path"), F.col("following.pos"))
    run = run.select("path", "opens", "lo", "hi", "lsn", "dead", "g", own_level.alias("level"), next_pos.alias("next_pos"))
    # each event asks for the last bracket opened one level up; one that opens is on offer, for one level down
    both = run.withColumn("offers", F.explode(F.when(opens, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    given = {f"v_{c}": F.when(F.col("offers"), F.col(c)) for c in ("lo", "lsn", "dead")}
    both = both.withColumns({"key": F.when(F.col("offers"), F.col("level")).otherwise(F.col("level") - 1), **given}).drop("level")
    filled = with_last(both, ["key"], "g", BLOCK, list(given), "around_").filter("NOT offers")
    around = F.struct(*[F.col(f"around_v_{c}").alias(c) for c in ("lo", "lsn", "dead")])
    version = F.struct("lo", "lsn", "dead")
    none = F.lit(None).cast("bigint")
    kept = F.col("around_v_lo").isNotNull()
    under = F.when(opens & kept & (F.col("around_v_lsn") < F.col("lsn")), F.struct(F.col("lo").alias("x0"), F.col("hi").alias("x1"), F.col("around_v_lsn").alias("y0"), F.col("lsn").alias("y1"), around.alias("v")))
    inner = F.when(opens, version).otherwise(around)
    beside = F.when((F.col("next_pos") > pos) & (opens | kept), F.struct(pos.alias("x0"), F.col("next_pos").alias("x1"), inner["lsn"].alias("y0"), none.alias("y1"), inner.alias("v")))
    return filled.select("path", F.explode(F.array(under, beside)).alias("r")).filter("r IS NOT NULL").select("path", "r.*")


@tidy
def visible_versions(requests: DataFrame, handles: DataFrame, nodes: DataFrame, mutations: DataFrame) -> DataFrame:
    """``request_id, node_id, lsn``: each distinct request that finds a version, and that version.

    The walk starts at the segment of the branch's current handle (highest ``commit_seq``) with the limit ``at_lsn``
    (null: none); towards a parent the limit becomes the lower of itself and ``fork_lsn``. The first segment with a
    change of the path at or below the limit decides by its newest such change; a tombstone means not found. A request
    sent again counts once. Requests of unknown branches or paths, or without a path, find nothing. Log positions beyond
    2**60 count as that one.
    """
    current = handles.filter("branch_id IS NOT NULL AND node_id IS NOT NULL").groupBy("project_id", "branch_id").agg(F.max_by("node_id", "commit_seq").alias("id"))
    current = written(current)
    places, reaches, hops = layout(nodes, current.select("id").distinct())
    asked = requests.filter("path IS NOT NULL").groupBy("request_id", "project_id", "branch_id", "path", "at_lsn").agg(F.lit(1).alias("_one"))
    # one-row-per-key sides are written: over a grouping's own partitions Spark would not split a hot branch or path
    leaf = written(current.join(places, "id").select("project_id", "branch_id", "start", "block"))
    first = asked.join(leaf, ["project_id", "branch_id"]).select("request_id", "path", "block", "start", _near(F.coalesce("at_lsn", F.lit(FAR))).alias("at"))
    first = written(first)
    onward = first.drop("start").join(hops, "block").select("request_id", "path", "hop", "start", F.least("at", "cap").alias("at"))
    points = first.select("request_id", "path", F.lit(0).cast("bigint").alias("hop"), "start", "at").unionByName(onward)
    laid = written(sheets(mutations, places, reaches))
    tiles = written(rectangles(laid))
    dropped(laid)
    filed = intervals.filed(intervals.filed(tiles, "x0", "x1", "x"), "y0", "y1", "y")
    known = filed.groupBy("path").agg(F.collect_set(F.struct("x_level", "y_level")).alias("levels"))
    probes = points.join(written(known), "path").select("*", F.explode("levels").alias("l")).select("request_id", "path", "hop", "start", "at", "l.*")
    probes = intervals.looked_up(intervals.looked_up(probes, "start", "x"), "at", "y")
    met = probes.join(filed, ["path", "x_level", "x_cell", "y_level", "y_cell"])
    met = met.filter((F.col("x0") <= F.col("start")) & (F.col("start") < F.col("x1")) & (F.col("y0") <= F.col("at")) & (F.col("y1").isNull() | (F.col("at") < F.col("y1"))))
    best = met.groupBy("request_id").agg(F.min(F.struct("hop", (-F.col("v.lo")).alias("lo"), F.bitwise_not(F.col("v.lsn")).alias("lsn"), "v.dead")).alias("v"))
    segment = places.select((-F.col("start")).alias("lo"), F.col("id").alias("node_id"))
    return best.filter("v.dead = 0").select("request_id", "v.lo", F.bitwise_not(F.col("v.lsn")).alias("lsn")).join(segment, "lo").select("request_id", "node_id", "lsn")
