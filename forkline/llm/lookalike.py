"""Visually identical texts made of different characters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from forkline.functions import wide_hash
from forkline.llm.unicode_forms import coarse_args, translate_args
from forkline.sources import shipped, small_side, written

#: Characters that the Unicode collation tells apart from each other: ASCII but digits and controls, and the letters of
#: some scripts. It ignores others (controls, signs without weight) or holds them equal (digits of all scripts, styles).
PLAIN = (
    r"[\t\n\r\x20-\x2F\x3A-\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017E\u0391-\u03A9\u03B1-\u03C9\u0402-\u0481\u0531-\u0556\u0561-\u0586"
    r"\u05D0-\u05EA\u0621-\u063A\u0641-\u064A\u10D0-\u10F0\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\u1100-\u1112\u1161-\u1175\u11A8-\u11C2\u2010\u2013-\u201E]"
)


def _translated(text: Column, args: tuple[str, str]) -> Column:
    """translate(), spared for texts of ASCII only, which it leaves alone."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, *args))


@F.pandas_udf(StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    """Canonical decomposition, marks in canonical order; null for null."""
    return texts.map(lambda t: unicodedata.normalize("NFD", t), na_action="ignore")


def _mapped(text: Column) -> Column:
    """Look-alike characters mapped in SQL; equal for texts of equal visible form.

    Spark's collation does not put marks in canonical order, so all texts that are not ASCII after the one-to-one changes
    are decomposed first. Then the base letters of those with a longer visible form change one by one, too.
    """
    plain = F.translate(text, *translate_args())
    parts = _decomposed(F.when(F.octet_length(plain) != F.length(plain), plain))
    return F.coalesce(F.translate(parts, *translate_args()), plain)


def _guard(mapped: Column) -> Column:
    """Splits a class where the collation ignores or equates characters: those characters with their places, hashed."""
    return F.md5(F.regexp_replace(mapped, PLAIN, "x"))


def _texts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & (F.col("text") != ""))


def classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Classes of texts that look the same but are stored differently, and the documents that may be in one.

    Returns ``id, block, stored`` of documents and ``block, stored, class, canonical_id, variants`` of the spellings of
    classes. ``stored`` hashes the stored text; ``class`` is the smallest such hash of the class, ``canonical_id`` the
    smallest id, ``variants`` the number of spellings.

    Look-alike letters, widths, spaces and zero-width characters are mapped in SQL, and the mapped values are grouped
    under Spark's Unicode collation, which tells accents and case apart but not composed from combining accents. As it
    gives no weight to some characters and the same to others, what it does not tell apart is a second key of the group.

    Only texts that share a coarse form (no accents) with a different text are grouped; that is found from 64-bit
    hashes, so the corpus itself is not shuffled. Copies of one stored text shrink to one row before classes are formed.
    """
    shipped(documents.sparkSession)
    texts = _texts(documents, id_col, text_col)
    coarse = texts.select("id", F.xxhash64(_translated(F.col("text"), coarse_args())).alias("block"), *wide_hash(F.col("text")))
    blocks = coarse.groupBy("block").agg(*[f(c).alias(f"{n}_{c}") for c in ("h1", "h2") for n, f in (("min", F.min), ("max", F.max))])
    mixed = written(blocks.filter("min_h1 <> max_h1 OR min_h2 <> max_h2").select("block"))
    side, _ = small_side(mixed)
    held = texts.withColumn("block", F.xxhash64(_translated(F.col("text"), coarse_args()))).join(side, "block", "left_semi")
    chosen = written(held.select("id", "block", F.md5("text").alias("stored"), "text"))
    # one row per stored spelling: copies of one text, however many, are mapped and compared once
    spellings = chosen.groupBy("block", "stored").agg(F.min("id").alias("id"), F.min("text").alias("text"))
    spellings = spellings.select("block", "stored", "id", _mapped(F.col("text")).alias("mapped"))
    spellings = written(spellings.withColumn("guard", _guard(F.col("mapped"))))
    found = spellings.sparkSession.sql(
        """
        WITH class AS (
          SELECT block, guard, mapped COLLATE UNICODE AS look, min(stored) AS class, min(id) AS canonical_id, count(*) AS variants
          FROM {spellings} GROUP BY block, guard, mapped COLLATE UNICODE)
        SELECT s.block, s.stored, k.class, k.canonical_id, k.variants
        FROM {spellings} s JOIN class k ON s.block = k.block AND s.guard = k.guard AND s.mapped COLLATE UNICODE = k.look
        WHERE k.variants > 1
        """,
        spellings=spellings,
    )
    return chosen.select("id", "block", "stored"), written(found)


def lookalike_pairs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id_a, doc_id_b``: each pair of documents whose stored texts differ but look the same, smaller id first.

    Null and empty texts form no pairs, nor do equal texts; null ids are left out. Repeated rows of one id make one pair.
    Two spellings of a class are paired first, then their documents: copies of one spelling never meet each other, and
    the work is the number of pairs.
    """
    rows, spellings = classes(documents, id_col, text_col)
    rows = rows.distinct()
    key = ["block", "class"]
    a = spellings.select(*key, F.col("stored").alias("stored_a"))
    b = spellings.select(*key, F.col("stored").alias("stored_b"))
    two = a.join(b, key).filter("stored_a < stored_b").select("block", "stored_a", "stored_b")
    pairs = two.join(rows.select("block", F.col("stored").alias("stored_a"), F.col("id").alias("a")), ["block", "stored_a"])
    pairs = pairs.join(rows.select("block", F.col("stored").alias("stored_b"), F.col("id").alias("b")), ["block", "stored_b"])
    return pairs.filter("a <> b").select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()


def canonical_members(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, canonical_id, variants``: every document that looks like a differently stored one, with its class.

    ``canonical_id`` is the smallest id of the class, ``variants`` the number of stored spellings. An id with several
    texts has a row for each class that one of them is in.
    """
    rows, spellings = classes(documents, id_col, text_col)
    held = rows.join(spellings.drop("class"), ["block", "stored"])
    return held.select(F.col("id").alias("doc_id"), "canonical_id", "variants").distinct()
