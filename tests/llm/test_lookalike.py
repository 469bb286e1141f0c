import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from forkline.llm import lookalike, queries
from forkline.llm.unicode_forms import coarse_args, translate_args, visible, visible_map

from .. import conftest

SAME = [
    ("\uff21bc\uff11", "Abc1"), ("cafe\u0301", "caf\u00e9"), ("a\u200bb", "ab"), ("a\u00a0b", "a b"), ("\u0430\u3000b", "a b"), ("p\u0430yp\u0430l", "paypal"), ("\u0391\u0392\u0395", "ABE"),
    ("\uff76\uff9e", "\u30ac"), ("\u0451", "\u00eb"), ("S\u0307\u0323", "\u1e68"), ("\u1e62\u0307", "\u1e68"), ("\u212b", "A\u030a"), ("\u212a", "K"), ("n\ufeff\u2060o", "n\u03bf"),
    ("\u00ca\u0323", "\u1ec6"), ("\u1e60\u0323", "\u1e68"), ("\u040e", "Y\u0306"), ("\u1f40", "o\u0313"), ("e\u0302\u200b\u0323", "\u1ec7"),
]
OTHER = [("a", "A"), ("\u00e9", "e"), ("1", "l"), ("a b", "a  b"), ("a\n", "a\r\n"), ("a.", "a!"), ("\u00bd", "1/2"), ("\ufb01", "fi"), ("a\tb", "a b"), ("a\x01", "a"), ("\u00b2", "2"), ("\u0e40\u0e01", "\u0e01\u0e40"), ("a\x01b", "ab\x01"), ("\u0661", "1"), ("\U0001d41a", "\U0001d44e")]


@pytest.mark.parametrize("a, b", SAME)
def test_same(a, b):
    assert visible(a) == visible(b)


@pytest.mark.parametrize("a, b", OTHER)
def test_other(a, b):
    assert visible(a) != visible(b)


def test_visible_is_stable():
    for c in visible_map():
        assert visible(visible(c)) == visible(c)


def test_coarse_form_follows_the_visible_form():
    gone_or = lambda args: {c: (args[1][i] if i < len(args[1]) else "") for i, c in enumerate(args[0])}
    coarse, plain = gone_or(coarse_args()), gone_or(translate_args())
    fold = lambda t: "".join(coarse.get(c, c) for c in t)
    for c in [*plain, *"\u00e9\u00c5\u00e4\u00f1\u0451\uac00\uac01\u30ac\u304c\u1ed7", *(chr(x) for x in range(0xC0, 0x250))]:
        assert fold(c) == fold(visible(c)) == fold(unicodedata.normalize("NFD", visible(c)))


def pairs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS block", "2 AS id", "3 AS stored")
    return sorted(map(tuple, lookalike.lookalike_pairs(df).collect()))


def test_pairs(spark):
    rows, want = [], []
    for i, (a, b) in enumerate(SAME):
        tail = f" number {i}."
        rows += [(10 * i + 5, a + tail), (10 * i, b + tail)]
        want.append((10 * i, 10 * i + 5))
    for i, (a, b) in enumerate(OTHER):
        rows += [(1000 + 10 * i, a + f" other {i}."), (1001 + 10 * i, b + f" other {i}.")]
    assert pairs(spark, rows) == want


def test_edges(spark):
    assert pairs(spark, [(1, None), (2, None), (3, ""), (4, ""), (5, "x"), (6, "x"), (None, "\u0445")]) == []
    # copies, ties and repeated rows: each of two spellings with each
    got = pairs(spark, [(1, "xa"), (2, "xa"), (3, "\u0445a"), (3, "\u0445a"), (4, "x\u200ba"), (5, "x\u0430")])
    assert got == [(1, 3), (1, 4), (1, 5), (2, 3), (2, 4), (2, 5), (3, 4), (3, 5), (4, 5)]
    assert pairs(spark, [(1, "y" * 300_000 + "\u0430"), (2, "y" * 300_000 + "a")]) == [(1, 2)]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert lookalike.lookalike_pairs(empty).count() == lookalike.canonical_members(empty).count() == 0


def test_mapped_follows_the_visible_form(spark):
    # every character that has another form, alone and before and after marks that need another order
    chars = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x30000)]) if c in visible_map() or unicodedata.decomposition(c)]
    texts = [t for c in chars for t in (c, c + "\u0323", "A\u0301" + c + "\u0327\u200b\u0316")]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", lookalike._mapped(F.col("text")).alias("mapped"))
    assert [t for t, m in df.collect() if m != unicodedata.normalize("NFD", visible(t))] == []


def _equal_to_collation(spark, pairs_of_texts):
    """For pairs of texts: whether class key and guard agree, which is what decides in the operator."""
    df = spark.createDataFrame(pairs_of_texts, "a string, b string").select("a", "b", lookalike._mapped(F.col("a")).alias("ma"), lookalike._mapped(F.col("b")).alias("mb"))
    df = df.withColumn("g", lookalike._guard(F.col("ma")) == lookalike._guard(F.col("mb")))
    return [(r.a, r.b, r.same) for r in df.selectExpr("a", "b", "g AND ma COLLATE UNICODE = mb COLLATE UNICODE AS same").collect()]


def test_every_changing_character_keeps_its_pair(spark):
    # each character with another form, with its canonical decomposition, and with its marks in another order
    chars = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x30000)]) if c in visible_map() or (unicodedata.decomposition(c) and "<" not in unicodedata.decomposition(c))]
    two = [(f"x{c}\u0323 {c}y", f"x{visible(c)}\u0323 {visible(c)}y") for c in chars] + [(f"{c} z", unicodedata.normalize("NFD", c) + " z") for c in chars]
    two += [(f"z {c}\u0301\u0316", "z " + unicodedata.normalize("NFC", visible(c) + "\u0316\u0301")) for c in chars]
    assert len(two) > 5684 and [(a, b) for a, b, same in _equal_to_collation(spark, two) if not same] == []


def test_what_the_collation_does_not_tell_apart_is_guarded(spark):
    # every character against those that the collation holds equal to it, and every ignored one against its absence
    chars = [chr(c) for c in [*range(0x300, 0xD800), *range(0xE000, 0x20000)] if unicodedata.normalize("NFD", visible(chr(c))) == chr(c)] + [chr(c) for c in range(1, 0x300)]
    df = spark.createDataFrame([(c,) for c in chars], "c string").selectExpr("c", "concat('a', c, 'b') COLLATE UNICODE AS look")
    groups = df.groupBy("look").agg(F.collect_list("c").alias("cs")).filter("size(cs) > 1").collect()
    two = [(f"a{x}b", f"a{y}b") for r in groups for x, y in zip(r.cs, r.cs[1:])] + [(f"a{c}b", f"ab{c}") for r in groups if "\x01" in r.cs for c in r.cs] + [("a\x01b", "ab")]
    assert len(two) > 2000 and [(a, b) for a, b, same in _equal_to_collation(spark, two) if same != (visible(a) == visible(b))] == []


def test_plain_strings_are_told_apart(spark):
    rnd = random.Random(5)
    plain = [chr(c) for c in range(0x10000) if re.fullmatch(lookalike.PLAIN, chr(c))]
    latin = [c for c in plain if ord(c) < 0x180]
    texts = {"".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 4))) for pool in (plain, latin) for _ in range(100_000)}
    df = spark.createDataFrame([(t,) for t in {unicodedata.normalize("NFD", visible(t)) for t in texts}], "t string")
    looks = df.select(lookalike._guard(F.col("t")).alias("g"), F.expr("t COLLATE UNICODE").alias("look"))
    assert looks.distinct().count() == df.count()


def test_accented_sentences_pair_in_both_forms(spark):
    sentences = ["Ў нашым доме ўсё добра.", "Ή ζωή είναι ωραία, ἀλλὰ σύντομη.", "Їжак їсть ґрунт і йде.", "Việt Nam đất nước tôi yêu."]
    rows = [(10 * i + j, unicodedata.normalize(f, s) + f" {i}") for i, s in enumerate(sentences) for j, f in enumerate(("NFC", "NFD"))]
    assert pairs(spark, rows) == [(10 * i, 10 * i + 1) for i in range(len(sentences))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, lookalike.canonical_members(df).collect())) == [(10 * i + j, 10 * i, 2) for i in range(len(sentences)) for j in (0, 1)]


def test_canonical(spark):
    df = spark.createDataFrame([(9, "a b"), (3, "\u0430 b"), (4, "a b"), (5, "c")], "doc_id bigint, text string")
    assert sorted(map(tuple, lookalike.canonical_members(df).collect())) == [(3, 3, 2), (4, 3, 2), (9, 3, 2)]


def test_archive_matches_brute_force(spark):
    by = {}
    for r in spark.read.parquet(f"{conftest.DATA}/documents.parquet").collect():
        if r.text:
            by.setdefault(visible(r.text), set()).add((r.doc_id, r.text))
    want = {(a, b) for group in by.values() for a, s in group for b, t in group if a < b and s != t}
    assert {tuple(r) for r in queries.p8_found(spark, conftest.DATA).collect()} == want and want
