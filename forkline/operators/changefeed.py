"""Applying a feed of inserts, updates and deletes in SQL, column by column."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def apply_changes(
    feed: DataFrame, keys: list[str], seq: str, deleted: str, fields: list[str] = (), replaces: str | None = None
) -> DataFrame:
    """The table that a change feed leaves: one row per key that is alive after all changes.

    ``seq`` orders the changes of a key; arrival order and repetition make no difference. ``deleted`` is a SQL
    condition that marks deletes (null: no delete), ``replaces`` one that marks changes which replace the whole row
    and so hide what was set before. Each of ``fields`` takes the value of the last change that set it (not null)
    since the latest delete or replacement; a change with the sequence of a replacement belongs to it. Returns the
    keys, ``seq`` as that of the last change, and the fields; ``seq`` may itself be one of them.

    Cases: a key whose last change is a delete has no row, also where a delete and another change share a sequence.
    Changes without sequence are ignored. A null key column is a key value of its own. Among repeats of one sequence
    with different values the greatest value wins. An empty feed gives an empty table.

    Everything is one aggregation that combines before the shuffle: a hot key costs one row per task. With no field but
    ``seq`` the buffers are numbers and Spark keeps them in a hash table.
    """
    key = ", ".join(map(_q, keys))
    s, dead = _q(seq), f"coalesce({deleted}, false)"
    inner = [f"max({s}) FILTER (WHERE {dead}) AS _dead", f"max({s}) FILTER (WHERE NOT {dead}) AS _last"]
    if fields and replaces:
        inner.append(f"max({s}) FILTER (WHERE NOT {dead} AND coalesce({replaces}, false)) AS _replaced")
    outer = [key, *([] if seq in fields else [f"_last AS {s}"])]
    barrier = "greatest(_dead, _replaced)" if replaces else "_dead"
    for i, name in enumerate(fields):
        f = _q(name)
        sets = f"FILTER (WHERE NOT {dead} AND {f} IS NOT NULL AND {s} IS NOT NULL)"
        inner.append(f"max_by({f}, {s if name == seq else f'struct({s}, {f})'}) {sets} AS _v{i}")
        inner.append(f"max({s}) {sets} AS _s{i}")
        outer.append(f"CASE WHEN {barrier} IS NULL OR _s{i} >= {barrier} THEN _v{i} END AS {f}")
    query = (
        f"SELECT {', '.join(outer)} FROM (SELECT {key}, {', '.join(inner)} FROM {{feed}} GROUP BY {key}) "
        "WHERE _last IS NOT NULL AND (_dead IS NULL OR _last > _dead)"
    )
    return feed.sparkSession.sql(query, feed=feed)


def layer_state(mutations: DataFrame, fields: list[str] = ()) -> DataFrame:
    """The state of every node's own layer: paths whose last change is no tombstone, with that ``lsn`` and ``fields``.

    The position is a field like the others. A change that carries a chunk list replaces the object. Rows without path
    take no part.
    """
    keys, fields = ["node_id", "path"], ["lsn", *fields]
    whole = "chunks IS NOT NULL" if len(fields) > 1 else None
    feed = mutations.select(*keys, "tombstone", *fields, *(["chunks"] if whole and "chunks" not in fields else []))
    return apply_changes(feed.filter("path IS NOT NULL"), keys, "lsn", "tombstone", fields, whole)
