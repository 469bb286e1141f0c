"""Evaluation texts inside training texts.

Both sides are read as streams of letters and digits of their visible form in lower case, so that transfer encodings,
markup, quote marks, line breaks, spacing, case, punctuation and look-alike letters make no difference. Winnowing keeps
the smallest k-gram hash of every window; equal fingerprints are joined and extended to whole runs. A run at least as
long as a window plus a k-gram always shares a fingerprint, so none is missed.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forkline.llm.reader import visible_parts
from forkline.llm.unicode_forms import visible
from forkline.sources import shipped, small_side, written

#: Letters of a k-gram at most, and of the shortest run that a class of items is searched by.
GRAM, LONGEST = 24, 64
#: Letters that are hashed at a time.
SLICE = 1 << 20
#: Fingerprints of items up to which they are sent to every executor.
ITEM_PRINTS = 2_000_000
#: Separates parts and documents in a stream; it is no character.
GAP = 0xFFFFFFFF
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@functools.cache
def _kept() -> np.ndarray:
    """For each code point whether it is a letter, digit or accent."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LNM" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def letters(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The stream of the parts, each in visible form: codes of its letters, and where a word starts.

    Parts are set apart by a gap.
    """
    codes, starts = [], []
    for part in parts:
        folded = part.lower() if part.isascii() else unicodedata.normalize("NFC", part.casefold())
        inside = False
        for lo in range(0, len(folded), SLICE):
            raw = np.frombuffer(folded[lo : lo + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
            keep = _kept()[raw]
            begins = keep.copy()
            begins[1:] &= ~keep[:-1]
            begins[0] &= not inside
            inside = bool(keep[-1])
            codes.append(raw[keep])
            starts.append(begins[keep])
        codes.append(np.array([GAP], np.uint32))
        starts.append(np.array([True]))
    if not codes:
        return np.empty(0, np.uint32), np.empty(0, bool)
    return np.concatenate(codes), np.concatenate(starts)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-gram, by doubling; the largest value for those that hold a gap."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    block, width, power = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1), 1, base
    total, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                if total is None:
                    total, done = block, width
                else:
                    total = total[: len(block) - done] * power + block[done:] if len(block) > done else total[:0]
                    done += width
            if width * 2 > k:
                break
            block = block[: len(block) - width] * power + block[width:]
            power, width = power * power, width * 2
        out = total[:n]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    gaps = np.flatnonzero(codes == GAP)
    if len(gaps):
        bad = np.zeros(len(codes) + 1, np.int32)
        bad[np.maximum(gaps - k + 1, 0)] += 1
        np.add.at(bad, gaps + 1, -1)
        out = np.where(np.cumsum(bad)[:n] > 0, _NONE, out)
    return out


def _least(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row, by doubling."""
    done = 1
    while done < w:
        step = min(done, w - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def winnowed(codes: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of one k-gram of each window of w, over the whole stream, slice by slice.

    It is the one of least hash (by its upper bits), of several such the rightmost: equal windows keep equal places, and
    text that repeats itself keeps one gram per window.
    """
    at, kept = [], []
    bits = np.uint64((SLICE + w + k).bit_length())
    low = np.uint64(1 << int(bits)) - np.uint64(1)
    for lo in range(0, max(1, len(codes)), SLICE):
        hashes = gram_hashes(codes[lo : lo + SLICE + w + k - 2], k)
        if len(hashes) < w:
            continue
        # places make the keys unique: among equal upper bits the rightmost is least
        keys = (hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64))
        keys[hashes == _NONE] = _NONE
        least = _least(keys, w)
        least = least[least != _NONE]
        mine = (low - (least & low)).astype(np.int64)
        mine = mine[np.flatnonzero(np.diff(mine, prepend=-1))]
        at.append(mine + lo)
        kept.append(hashes[mine])
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    where, hashes = np.concatenate(at), np.concatenate(kept)
    where, first = np.unique(where, return_index=True)
    return where, hashes[first]


class Item:
    """An evaluation item as a stream, with its words (those with a letter or digit, between spaces)."""

    def __init__(self, text: str):
        words = [w for w in visible(text).split() if len(letters([w])[0]) > 1]
        streams = [letters([w])[0][:-1] for w in words]
        self.ends = np.cumsum([len(s) for s in streams], dtype=np.int64) if streams else np.empty(0, np.int64)
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if streams else self.ends
        self.codes = np.concatenate(streams) if streams else np.empty(0, np.uint32)
        self.needed = -(-len(words) // 2)
        #: the fewest letters that so many words in a row have
        self.shortest = int((self.ends[self.needed - 1 :] - self.begins[: len(words) - self.needed + 1]).min()) if words else 0


def _class_of(shortest: int) -> tuple[int, int]:
    """k and w of items whose shortest run has so many letters: w + k - 1 does not exceed it."""
    run = min(LONGEST, 1 << (shortest.bit_length() - 1))
    k = max(1, min(GRAM, run * 3 // 8))
    return k, run - k + 1


def item_prints(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, k, w, item_pos, print`` of all items with a word."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = {"item_id": [], "k": [], "w": [], "item_pos": [], "print": []}
            for i, text in zip(rows["id"], rows["text"], strict=True):
                item = Item(text)
                if item.needed:
                    k, w = _class_of(item.shortest)
                    where, hashes = winnowed(item.codes, k, w)
                    for name, value in (("item_id", [i] * len(where)), ("k", [k] * len(where)), ("w", [w] * len(where)), ("item_pos", where), ("print", hashes.view(np.int64))):
                        out[name].extend(value)
            yield pd.DataFrame(out)

    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL").distinct()
    return rows.mapInPandas(of, "item_id bigint, k int, w int, item_pos bigint, print bigint")


def _prints(documents: DataFrame, classes: list[tuple[int, int]]) -> DataFrame:
    """``doc_id, k, doc_pos, print`` of all documents, for each k and w in use."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ids, texts = rows["id"].to_numpy(), rows["text"].tolist()
            lo = 0
            while lo < len(texts):  # whole documents, about a slice of letters at a time
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= SLICE):
                    size, hi = size + len(texts[hi]), hi + 1
                streams = [letters(visible_parts(t))[0] for t in texts[lo:hi]]
                lengths = np.array([len(s) for s in streams])
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                joined = np.concatenate(streams) if streams else np.empty(0, np.uint32)
                for k, w in classes:
                    where, hashes = winnowed(joined, k, w)
                    doc = np.searchsorted(offsets, where, "right") - 1
                    yield pd.DataFrame({"doc_id": ids[lo:hi][doc], "k": np.full(len(where), k, np.int32), "doc_pos": where - offsets[doc], "print": hashes.view(np.int64)})
                lo = hi

    return documents.mapInPandas(of, "doc_id bigint, k int, doc_pos bigint, print bigint")


def longest_run(codes: np.ndarray, starts: np.ndarray, item: Item, shift: int) -> int:
    """Words of the longest unbroken run of the item in a document, with the item laid at ``shift`` over it.

    The run's first word must begin and its last word end where words of the document do. Runs of fewer letters than
    half of the item has count as none.
    """
    lo, hi = max(0, -shift), min(len(item.codes), len(codes) - shift)
    if lo >= hi:  # a place in another text of the same id
        return 0
    cuts = np.concatenate([[lo - 1], lo + np.flatnonzero(codes[lo + shift : hi + shift] != item.codes[lo:hi]), [hi]])
    most = 0
    long = np.flatnonzero(np.diff(cuts) > item.shortest)
    for left, right in zip(cuts[long] + 1, cuts[long + 1], strict=True):  # letters left to right - 1 are equal
        first, last = np.searchsorted(item.begins, left), np.searchsorted(item.ends, right, "right") - 1
        if last - first + 1 <= most:
            continue
        begins = np.flatnonzero(starts[item.begins[first : last + 1] + shift])
        after = item.ends[first : last + 1] + shift
        ends = np.flatnonzero((after >= len(starts)) | starts[np.minimum(after, len(starts) - 1)])
        if len(begins) and len(ends):
            most = max(most, int(ends[-1] - begins[0] + 1))
    return most


def _extended(hits: DataFrame) -> DataFrame:
    """Texts with their hits, ``doc_id, text, wanted``, to ``doc_id, item_id`` of those that hold half an item."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items: dict[str, Item] = {}
        for rows in batches:
            found = []
            for doc, text, wanted in zip(rows["doc_id"], rows["text"], rows["wanted"], strict=True):
                codes, starts = letters(visible_parts(text))
                for hit in wanted:
                    if len(items) > 10_000:
                        items.clear()
                    item = items.get(hit["item_text"]) or items.setdefault(hit["item_text"], Item(hit["item_text"]))
                    if any(longest_run(codes, starts, item, int(s)) >= item.needed for s in hit["shifts"]):
                        found.append((doc, hit["item_id"]))
            yield pd.DataFrame(found, columns=["doc_id", "item_id"])

    return hits.mapInPandas(of, "doc_id bigint, item_id bigint")


def leaked(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """``doc_id, item_id``: each document with each item of which it holds at least half the words as one unbroken run.

    The window follows from the items: half an item in letters, 64 at most, never less than the k-gram. Null and empty
    texts and items hold nothing; rows without id are left out; repeated rows count once, and an id with several texts
    holds what any of them holds. Texts are used whole, in slices that overlap by a window. Item fingerprints are
    broadcast only after a count shows that they are few; otherwise the fingerprints meet in a shuffled join. Hits shrink
    to diagonals (how far an item would have to be moved to lie on the hit), of which a document has at most as many as
    letters with each item. Texts are decoded again only for the documents with a hit, which meet their hits in a sorted
    join: the item texts of the hits are never broadcast.
    """
    shipped(documents.sparkSession)
    texts = documents.select(F.col(doc_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & (F.col("text") != ""))
    prints = written(item_prints(items, item_col, item_text))
    classes = [(r["k"], r["w"]) for r in prints.select("k", "w").distinct().collect()]  # seven at most
    side, _ = small_side(prints.drop("w"), ITEM_PRINTS)
    hits = _prints(texts, classes).join(side, ["k", "print"])
    # one place per document, item and diagonal: the whole item is compared where it would lie
    shifts = hits.groupBy("doc_id", "item_id").agg(F.collect_set(F.col("doc_pos") - F.col("item_pos")).alias("shifts"))
    wanted = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("item_text")).filter("item_text IS NOT NULL").distinct()
    # one row per document, so that its text never is copied per item; the short texts of the items travel instead
    met = shifts.join(wanted, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "item_text", "shifts")).alias("wanted"))
    met = written(met)
    docs, _ = small_side(met.select(F.col("doc_id").alias("id")))
    held = texts.join(docs, "id", "left_semi").withColumnRenamed("id", "doc_id")
    # sorted, as Spark would broadcast by file sizes, in which a repeated item text takes a few bytes and in memory all of its own
    return _extended(held.join(met.hint("merge"), "doc_id").select("doc_id", "text", "wanted")).distinct()
