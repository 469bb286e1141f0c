import pytest
from pyspark.sql import functions as F

from forkline import chunking, errors

BOUNDS = 64, 256, 1024


def pattern(n, m):
    return bytes(i % m for i in range(n))


@pytest.mark.parametrize("data", [b"", b"x", pattern(2048, 251), pattern(4096, 199), pattern(16384, 137), bytes(5000)])
def test_content_cuts_cover_and_keep_bounds(data):
    cuts = chunking.content_cuts(data, *BOUNDS)
    assert b"".join(data[o : o + n] for o, n in cuts) == data
    assert all(n <= BOUNDS[2] for _, n in cuts) and all(n >= BOUNDS[0] for _, n in cuts[:-1])
    assert cuts == chunking.content_cuts(data, *BOUNDS)


def test_content_cuts_follow_the_content():
    import random

    data = random.Random(1).randbytes(200_000)
    cuts = chunking.content_cuts(data, *BOUNDS)
    mean = len(data) / len(cuts)
    assert 128 < mean < 512
    moved = chunking.content_cuts(b"12345" + data, *BOUNDS)
    pieces = {data[o : o + n] for o, n in cuts}
    assert sum((b"12345" + data)[o : o + n] in pieces for o, n in moved) > 0.9 * len(moved)


def test_gear_hash_matches_the_rolling_form():
    data, table = pattern(500, 251), [int(x) for x in chunking.gear_table()]
    h, want = 0, []
    for b in data:
        h = ((h << 1) + table[b]) % 2**64
        want.append(h)
    assert [int(x) for x in chunking.gear_hashes(data)] == want


@pytest.mark.parametrize("bounds", [(0, 1, 2), (5, 4, 8), (4, 9, 8)])
def test_bad_bounds(bounds):
    with pytest.raises(errors.InvalidInput):
        chunking.content_cuts(b"x", *bounds)


def test_fixed_cuts_and_assembly(spark):
    rows = [(i, bytearray(pattern(n, 251))) for i, n in enumerate((0, 1, 10, 11, 95))]
    objects = spark.createDataFrame(rows, "path int, content binary").withColumn("cuts", chunking.fixed_cuts(F.col("content"), 10))
    chunks = chunking.chunks_of(objects, "path", "content", "cuts")
    assert chunks.count() == 0 + 1 + 1 + 2 + 10
    stored = chunking.new_chunks(chunks, None)
    assert stored.count() == chunks.select("hash").distinct().count()
    assert chunking.new_chunks(chunks, stored).count() == 0
    listed = objects.select("path", chunking.hash_list(F.col("content"), F.col("cuts")).alias("chunks"))
    whole = {r.path: bytes(r.content) for r in chunking.assembled(listed, stored).collect()}
    assert whole == {i: bytes(b) for i, b in rows}
    broken = {r.path: r.content for r in chunking.assembled(listed, stored.filter("length = 10")).collect()}
    assert broken[1] is None and broken[0] == b"" and bytes(broken[2]) == bytes(rows[2][1])
    with pytest.raises(errors.InvalidInput):
        chunking.fixed_cuts(F.col("content"), 0)
