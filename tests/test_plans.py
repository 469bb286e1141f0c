"""What the plans must look like to hold at scale: pushed filters, pruned columns, early top-1, one shuffle where one is enough."""

import re
import shutil

from pyspark.sql import functions as F

from forkline import lineage, resolve, sources
from forkline.api import Engine
from forkline.operators import changefeed
from forkline.plans import data_quality

from .conftest import DATA


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_listing_prunes_and_pushes(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/w", chunk_size=1024)
    p = engine.create_project()
    rows = spark.range(50).select(F.concat(F.lit("a/"), F.col("id")).alias("path"), F.lit(b"x").alias("content"))
    engine.put_objects(p.project_id, p.root_branch_id, rows)
    view = engine.visible(p.project_id, p.root_branch_id, at_lsn=20, prefix="a/", after="a/1")
    text = plan(resolve.listing(view, 10))
    assert "WindowGroupLimit" in text and "TakeOrderedAndProject" in text
    for pushed in ("StringStartsWith(path,a/)", "GreaterThan(path,a/1)", "LessThanOrEqual(lsn,20)"):
        assert pushed in text
    read = re.search(r"ReadSchema: struct<([^>]*)", text)[1]
    assert "chunks" not in read and "created_at" not in read
    assert text.count("Exchange hashpartitioning") == 1
    # folders that begin after the cap are not read
    engine.put_objects(p.project_id, p.root_branch_id, rows)
    assert "w/mutations" in plan(engine.visible(p.project_id, p.root_branch_id)) and "InMemoryFileIndex(1 paths)" in plan(view)
    assert "InMemoryFileIndex(1 paths)" in plan(engine.visible(p.project_id, p.root_branch_id, at_lsn=20))
    assert "InMemoryFileIndex(2 paths)" in plan(engine.visible(p.project_id, p.root_branch_id))


def test_layer_state_is_one_hash_aggregation(spark):
    text = plan(data_quality.p2_found(spark, DATA))
    assert "max_by(lsn" in text
    assert text.count("Exchange") == 1 and "SortAggregate" not in text and "Python" not in text
    assert "chunks" not in re.search(r"ReadSchema: struct<(.*?)>\n", text + "\n")[1]


def test_heads_are_hash_aggregated(spark):
    log = spark.read.parquet(f"{DATA}/mutations.parquet")
    text = plan(lineage.max_lsns(log))
    assert "SortAggregate" not in text and text.count("Exchange") == 1


def test_no_query_crosses(spark):
    for name in ("p1_found", "p2_found", "p3_found", "p4_found", "p5_found"):
        text = plan(data_quality.QUERIES[name](spark, DATA))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_column_wise_state_is_one_shuffle(spark):
    feed = spark.createDataFrame([], "k int, seq bigint, gone boolean, a string, b array<int>")
    assert plan(changefeed.apply_changes(feed, ["k"], "seq", "gone", ["a", "b"])).count("Exchange") == 1


def test_a_point_read_opens_one_prefix_folder(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/w", chunk_size=64)
    p = engine.create_project()
    rows = spark.range(200).select(F.concat(F.lit("a/"), F.col("id")).alias("path"), F.encode(F.repeat(F.col("id").cast("string"), 100), "utf-8").alias("content"))
    engine.put_objects(p.project_id, p.root_branch_id, rows)
    one = engine.get_object_meta(p.project_id, p.root_branch_id, "a/7").chunks[0]
    stored = engine._stored(engine.log.state, [one])
    assert f"prefix={one.hex()[0]}" in stored.inputFiles()[0] and "InMemoryFileIndex(1 paths)" in plan(stored)
    assert "EqualTo(hash" in plan(stored.filter(F.col("hash") == F.lit(bytearray(one))))


def test_puts_move_no_bytes(spark, tmp_path, monkeypatch):
    engine = Engine(spark, f"file://{tmp_path}/w", chunk_size=64)
    p = engine.create_project()
    rows = spark.range(200).select(F.concat(F.lit("a/"), F.col("id")).alias("path"), F.encode(F.repeat(F.col("id").cast("string"), 100), "utf-8").alias("content"))
    engine.put_objects(p.project_id, p.root_branch_id, rows)
    texts = []
    kept = engine._kept
    monkeypatch.setattr(engine, "_kept", lambda chunks: (texts.append(plan(chunks)), kept(chunks))[1])
    engine.put_objects(p.project_id, p.root_branch_id, rows.withColumn("content", F.concat("content", F.lit(b"!"))))
    # the only exchanges carry places of new chunks; the scan that holds data is joined where it is
    assert "BroadcastHashJoin" in texts[0] and "Exchange hashpartitioning" in texts[0]
    for line in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", texts[0]):
        assert "parts" not in line and "_row" in line
    assert not re.search(r"Exchange[^\n]*\n(?:[^\n]*\n){0,3}[^\n]*FileScan parquet \[parts", texts[0])


def test_long_chains_are_joined(spark):
    log = spark.read.parquet(f"{DATA}/mutations.parquet")
    text = plan(resolve.within_chain(log, [(n, 10**6 - n) for n in range(100)]))
    assert "BroadcastHashJoin" in text and "In(node_id" in text and "LessThanOrEqual(lsn" in text


def test_operators_leave_nothing_that_is_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "shared_folder", lambda _: f"file://{tmp_path}")
    for name in ("p1_found", "p3_found", "p4_found"):
        df = data_quality.QUERIES[name](spark, DATA)
        left = {x.name for x in tmp_path.iterdir() if x.is_dir() and x.name.startswith("forkline-")}
        read = {f.split("/")[-2] for f in df.inputFiles()}
        assert left and left <= read, name
        assert df.count() > 0
        for x in tmp_path.iterdir():
            shutil.rmtree(x)
