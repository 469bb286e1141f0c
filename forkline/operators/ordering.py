"""Successors and running sums within groups of any size.

Spark's window functions sort one whole group in one task. The helpers here cut each group into blocks of its order
value first, so that a group holding a large share of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from forkline.sources import dropped, written


def with_next(df: DataFrame, keys: list[str], order: str, block: int, out: str = "next_value") -> DataFrame:
    """Add ``out``: the next greater value of ``order`` among rows of the same keys; null for the last.

    ``order`` is a non-null integer column, unique within its keys. A block spans ``block`` values of it, so one
    window group has at most ``block`` rows; only one row per block goes into the second window.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    inner = W.partitionBy(*keys, "_block").orderBy(order)
    heads = blocked.groupBy(*keys, "_block").agg(F.min(order).alias("_head"))
    heads = heads.withColumn("_later", F.lead("_head").over(W.partitionBy(*keys).orderBy("_block"))).drop("_head")
    rows = blocked.withColumn("_inner", F.lead(order).over(inner)).alias("r")
    heads = heads.alias("h")
    same = F.col("r._block").eqNullSafe(F.col("h._block"))
    for k in keys:
        same = F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}")) & same
    return rows.join(heads, same, "left").select(
        *[F.col(f"r.{c}") for c in df.columns], F.coalesce("r._inner", "h._later").alias(out)
    )


def with_offset(df: DataFrame, group: list[str], member: str, weight: str, buckets: int, out: str = "offset") -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows before this one in its group.

    Rows of a group are ordered by a hash bucket of ``member``, then by ``member`` (unique): a fixed order, though not
    the order of ``member`` once there is more than one bucket. A window group holds one bucket of one group.
    """
    if buckets <= 1:
        before = W.partitionBy(*group).orderBy(member).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(weight).over(before), F.lit(0)).cast("bigint"))
    split = df.withColumn("_bucket", F.pmod(F.xxhash64(member), F.lit(buckets)))
    sums = split.groupBy(*group, "_bucket").agg(F.sum(weight).alias("_sum"))
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = W.partitionBy(*group, "_bucket").orderBy(member).rowsBetween(W.unboundedPreceding, -1)
    split = split.withColumn("_in", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    joined = split.join(sums, [*group, "_bucket"])
    return joined.withColumn(out, (F.col("_base") + F.col("_in")).cast("bigint")).select(*df.columns, out)


def newest(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the highest ``seq`` of each key; of equal ones, the one whose other columns sort last.

    Aggregates before shuffling, so a hot key costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys and c != seq]
    best = df.groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in df.columns if c not in keys])


def with_last(df: DataFrame, keys: list[str], order: str, block: int, values: list[str], prefix: str) -> DataFrame:
    """Add ``<prefix><value>`` for each of ``values``: those of the last earlier row of the same keys that has them, else null.

    A row has all of the values or none. ``order`` is a non-null integer column, unique within its keys; a window group
    holds one block of it at most. Values of fixed size keep the aggregation in a hash table.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    before = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    there = F.when(F.col(values[0]).isNotNull(), F.col(order))
    heads = blocked.groupBy(*keys, "_block").agg(*[F.max_by(v, there).alias(v) for v in values])
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select(*keys, "_block", *[F.last(v, ignorenulls=True).over(earlier).alias(f"_earlier_{v}") for v in values])
    inner = blocked.withColumns({f"_inner_{v}": F.last(v, ignorenulls=True).over(before) for v in values})
    return inner.join(heads, [*keys, "_block"]).select(*df.columns, *[F.coalesce(f"_inner_{v}", f"_earlier_{v}").alias(f"{prefix}{v}") for v in values])


#: Rows of one range when all rows are put in one order.
RANGE_ROWS = 1_000_000


def ranges_of(spark: SparkSession, rows: int) -> int:
    """How many ranges so many rows are cut into: enough for all cores, and no range above a bound."""
    return max(spark.sparkContext.defaultParallelism * 2, -(-rows // RANGE_ROWS))


def swept(df: DataFrame, order: list[Column], step: Column, at: Column, number: str, level: str, following: str, rows: int = 0) -> DataFrame:
    """All rows put in one order: add their ``number`` in it, the running sum of ``step`` (``level``), and the next row's ``at``.

    Rows are range-partitioned by ``order`` (its first columns are those of ``at``) and written; only a count, a sum and
    the first ``at`` of each partition go to the driver, and no task sorts more than its range. The result is
    written. ``rows`` is about how many there are, where that is known to be many.
    """
    spark = df.sparkSession
    ranges = ranges_of(spark, rows)
    placed = written(df.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.sum(step.cast("bigint")).alias("s"), F.min(at).alias("first"))
    rows, n, s = [], 0, 0
    found = sorted(sums.collect(), key=lambda r: r["_part"])
    for r, after in zip(found, [*found[1:], None]):
        rows.append((r["_part"], n, s, None if after is None else after["first"]))
        n, s = n + r["n"], s + r["s"]
    kind = next(f.dataType for f in sums.schema if f.name == "first").simpleString()
    bases = F.broadcast(spark.createDataFrame(rows, f"_part int, _n bigint, _s bigint, _next {kind}"))
    # as many tasks as ranges, also where the session has fewer shuffle partitions
    spread = placed.repartition(ranges, "_part") if ranges > ranges_of(spark, 0) else placed
    w = W.partitionBy("_part").orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    run = spread.withColumns({number: F.row_number().over(w), level: F.sum(step.cast("bigint")).over(upto), following: F.lead(at).over(w)})
    out = written(
        run.join(bases, "_part").select(
            *df.columns, (F.col(number) + F.col("_n")).alias(number), (F.col(level) + F.col("_s")).alias(level), F.coalesce(following, "_next").alias(following)
        )
    )
    dropped(placed)
    return out


def with_sorted_offset(df: DataFrame, group: list[str], order: list[Column], weight: str, out: str = "offset", rows: int = 0) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows before this one in its group, by ``order`` (unique in the group).

    Sums run over all rows, sorted by group and order, whatever the size of a group; what comes before a group is taken
    off. Null is a group of its own.
    """
    run = swept(df, [*[F.col(g) for g in group], *order], F.col(weight), F.lit(0), "_number", "_upto", "_following", rows)
    run = run.withColumn("_before", F.col("_upto") - F.col(weight)).alias("r")
    first = run.groupBy(*group).agg(F.min("_before").alias("_first")).alias("f")
    same = F.lit(True)
    for g in group:
        same = same & F.col(f"r.{g}").eqNullSafe(F.col(f"f.{g}"))
    return run.join(first, same).select(*[F.col(f"r.{c}") for c in df.columns], (F.col("r._before") - F.col("f._first")).alias(out))


def ranked(df: DataFrame, keys: list[str], order: str, block: int, out: str = "rank") -> DataFrame:
    """Add ``out``: 1, 2, ... by ``order`` (a non-null integer, unique within the keys) among rows of the same keys.

    Like ``row_number``, but a window group holds one block of ``block`` values of ``order`` at most.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    sizes = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(W.partitionBy(*keys, "_block").orderBy(order))
    joined = blocked.withColumn("_in", within).join(sizes, [*keys, "_block"])
    return joined.withColumn(out, (F.col("_base") + F.col("_in")).cast("bigint")).select(*df.columns, out)


def numbered(df: DataFrame, order: list[Column], first: int, out: str) -> tuple[DataFrame, int]:
    """Number all rows ``first``, ``first + 1``, ... in ``order``, and count them.

    Rows are range-partitioned and written once, so that the numbers cannot change; only one count per partition goes to
    the driver, and no task sorts more than its range.
    """
    placed = written(df.repartitionByRange(ranges_of(df.sparkSession, 0), *order).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())
    bases, total = {}, 0
    for part, n in counts:
        bases[part], total = first + total, total + n
    base = F.element_at(F.create_map(*[F.lit(x) for kv in bases.items() for x in kv]), F.col("_part")) if bases else F.lit(first)
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return placed.withColumn(out, (base + within - 1).cast("bigint")).drop("_part"), total
