"""Token ids by a byte-level BPE vocabulary, through a sentencepiece model made from that vocabulary.

The vocabulary is a list of byte strings with ranks. Each becomes a piece in which a printable character stands for each
byte, scored by its negative rank, so that sentencepiece's merges (highest score first, then leftmost) are those of the
ranks. Normalisation is off. Texts are cut into pre-tokens first, and each distinct pre-token is encoded once per worker.
"""

from __future__ import annotations

import base64
import functools
import os
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forkline.sources import shipped

#: Where the public vocabulary files are, unless a path is given.
TOKENIZERS = os.environ.get("FORKLINE_TOKENIZERS", "/opt/tokenizers")
#: The public pattern that cuts texts into pre-tokens for this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of pre-tokens that a worker keeps with their ids, about.
CACHE = 50_000_000
#: Characters from which a text is cut lazily, and the pre-tokens that are then encoded at a time.
LONG, BLOCK = 1_000_000, 100_000


@functools.cache
def byte_letters() -> list[str]:
    """The printable character of each byte: itself where it is one, else the next free one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(0x100 + others.index(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """The byte strings of a vocabulary file (base64 and rank per line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _field(number: int, kind: int, payload: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(payload)) if kind == 2 else b"") + payload


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model whose piece numbers are the ranks.

    Ranks without a token, and one after the last, are unused pieces; the one after the last is the unknown piece, which
    sentencepiece demands and no text can reach, as every byte is a piece.
    """
    letters = byte_letters()
    normal, unknown, unused = 1, 2, 5
    pieces: dict[int, tuple[str, float, int]] = {r: ("".join(letters[b] for b in t), -float(r), normal) for t, r in ranks.items()}
    top = max(pieces, default=-1) + 1
    out = []
    for r in range(top + 1):
        name, score, kind = pieces.get(r, (f"<{r}>", 0.0, unused)) if r < top else ("<unk>", 0.0, unknown)
        piece = _field(1, 2, name.encode()) + _field(2, 5, struct.pack("<f", score)) + _field(3, 0, _varint(kind))
        out.append(_field(1, 2, piece))
    no = _varint(0)
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(top + 1)) + _field(40, 0, _varint(top))
    trainer += b"".join(_field(n, 0, _varint(2**64 - 1)) for n in (41, 42, 43))  # no begin, end or padding pieces
    normalizer = _field(1, 2, b"identity") + b"".join(_field(n, 0, no) for n in (3, 4, 5))
    return b"".join(out) + _field(2, 2, trainer) + _field(3, 2, normalizer)


class Encoder:
    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(PATTERN)
        self.map = {b: ord(c) for b, c in enumerate(byte_letters())}
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, words: set[str]) -> None:
        if self.held > CACHE:
            self.known.clear()
            self.held = 0
        if new := list(words.difference(self.known)):
            mapped = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.map) for w in new]
            for w, ids in zip(new, self.sp.encode(mapped, out_type=int, num_threads=1), strict=True):
                self.known[w] = struct.pack(f"={len(ids)}i", *ids)
            self.held += sum(map(len, new)) + 100 * len(new)

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit numbers; none for null and empty."""
        short = [self.cut.findall(t) if t and len(t) <= LONG else [] for t in texts]
        self._learn(set().union(*short))
        out = [b"".join(map(self.known.__getitem__, words)) for words in short]
        for i, text in enumerate(texts):
            if text and len(text) > LONG:
                source, parts = (m.group() for m in self.cut.finditer(text)), []
                while block := list(islice(source, BLOCK)):
                    self._learn(set(block))
                    parts.append(b"".join(map(self.known.__getitem__, block)))
                out[i] = b"".join(parts)
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text. Spellings of special tokens are ordinary text."""
        return np.frombuffer(self.packed([text])[0], np.int32).tolist()


@functools.lru_cache(2)
def encoder(model: bytes) -> Encoder:
    """One encoder per worker and model, with what it has learnt."""
    return Encoder(model)


@functools.lru_cache(2)
def piece_bytes(model: bytes) -> list[bytes]:
    """The bytes of each piece of a model: the inverse of the letters that stand for them; none for unused pieces."""
    sp, of_letter = encoder(model).sp, {c: b for b, c in enumerate(byte_letters())}
    pieces = ((i, sp.id_to_piece(i)) for i in range(sp.get_piece_size()))
    return [b"" if sp.is_unused(i) or sp.is_unknown(i) else bytes(of_letter[c] for c in piece) for i, piece in pieces]


def decode(ids: Iterable[int], pieces: list[bytes]) -> str:
    """The text of ids by the inverse mapping; bytes that are no UTF-8 become replacement characters."""
    return b"".join(pieces[i] for i in ids).decode("utf-8", "replace")


def token_ids(documents: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", out: str = "ids") -> DataFrame:
    """``doc_id, ids``: each row's text as a list of token ids, without special tokens; an empty list for null and empty.

    One row out per row in, repeated or not, whatever its id. ``vocabulary`` is the path of a rank file; it is read
    where the query is built and sent along as a model of a fixed size. Texts are encoded whole.
    """
    shipped(documents.sparkSession)
    model = model_bytes(read_ranks(vocabulary or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_model = encoder(model)
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, len(texts), 128):
                packed = of_model.packed(texts.slice(lo, 128).to_pylist())
                ends = np.cumsum([0, *map(len, packed)]) // 4
                flat = np.frombuffer(b"".join(packed), np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 128), values], names=[id_col, out])

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(of, f"`{id_col}` {kind}, `{out}` array<int>")


def token_texts(encoded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``doc_id, text``: the texts of lists of token ids; null for a null list."""
    shipped(encoded.sparkSession)
    model = model_bytes(read_ranks(vocabulary or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_bytes(model)
        for batch in batches:
            texts = [None if ids is None else decode(ids, pieces) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, out])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(of, f"`{id_col}` {kind}, `{out}` string")
