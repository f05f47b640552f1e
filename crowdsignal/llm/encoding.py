"""Encoding of texts with a public byte-level BPE vocabulary through sentencepiece (problem 6).

A sentencepiece BPE model is serialised straight from the rank file: each token's bytes become characters by the usual
byte-to-character mapping, its score is its negative rank, so that merges happen in rank order, and its id is its rank.
Normalisation is the identity. Texts are cut by the vocabulary's pattern first; pieces are encoded once per worker and
kept, as most of them recur. Decoding is the inverse mapping.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator, Sequence
from itertools import chain
from pathlib import Path
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crowdsignal.sources.tables import spread

T = TypeVar("T")

#: Fixed value: the pattern that cuts a text before merging, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: A worker forgets its encoded pieces beyond this number.
MOST_KEPT_PIECES = 300_000


def byte_characters() -> list[str]:
    """A printable character for every byte: bytes that print stand for themselves, the others follow from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


def read_ranks(path: str = DEFAULT_RANKS) -> list[bytes]:
    """The tokens of a rank file in order of rank; ranks must be 0, 1, 2, ..."""
    pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line.strip()]
    tokens = [base64.b64decode(token) for token, _ in pairs]
    if [int(rank) for _, rank in pairs] != list(range(len(pairs))):
        raise ValueError(f"ranks of {path} aren't 0, 1, 2, ...")
    return tokens


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: int | bytes | float) -> bytes:
    """A protobuf field: whole numbers as varints, floats in 4 bytes, bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (1 << 64) - 1)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(tokens: Sequence[bytes]) -> bytes:
    """A serialised sentencepiece model of the tokens; the piece for unknown text, which never occurs, takes the next id."""
    chars = byte_characters()
    normal, unknown, bpe, off = 1, 2, 2, -1
    out = [_field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, -float(rank)) + _field(3, normal)) for rank, token in enumerate(tokens)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + _field(41, off) + _field(42, off) + _field(43, off)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Encodes and decodes texts in one worker."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.cut = regex.compile(PATTERN).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.to_char = dict(enumerate(byte_characters()))
        self.to_byte = {ord(c): b for b, c in self.to_char.items()}
        self.known: dict[str, tuple[int, ...]] = {}

    def _each(self, texts: Sequence[str | None], wanted: Callable[[Iterator[tuple[int, ...]]], T]) -> list[T]:
        """What ``wanted`` makes of the ids of each text's pieces, one after the other."""
        if len(self.known) > MOST_KEPT_PIECES:
            self.known.clear()
        known = self.known
        parts = [self.cut(text) if text else [] for text in texts]
        if new := list(set(chain.from_iterable(parts)).difference(known)):
            mapped = [p.encode().decode("latin-1").translate(self.to_char) for p in new]
            known.update(zip(new, map(tuple, self.pieces.encode(mapped, num_threads=1)), strict=True))
        return [wanted(map(known.__getitem__, p)) for p in parts]

    def encode_batch(self, texts: Sequence[str | None]) -> list[list[int]]:
        """Ids of each text; none for an empty or null one."""
        return self._each(texts, lambda pieces: list(chain.from_iterable(pieces)))

    def count_batch(self, texts: Sequence[str | None]) -> list[int]:
        """The number of ids of each text."""
        return self._each(texts, lambda pieces: sum(map(len, pieces)))

    def decode(self, ids: Sequence[int]) -> str:
        return "".join(map(self.pieces.id_to_piece, map(int, ids))).translate(self.to_byte).encode("latin-1").decode()


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(model: bytes) -> Encoder:
    """The encoder of this Python worker, which is built once."""
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def _encoded(df: DataFrame, id_: str, text: str, ranks: str, schema: str, column: Callable[[Encoder, list[str | None]], pa.Array]) -> DataFrame:
    model = df.sparkSession.sparkContext.broadcast(model_bytes(read_ranks(ranks)))  # a fixed size, some 1.2 MB
    kind = df.schema[id_].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # bounds the ids that are held at once
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), column(encoder, part.column(1).to_pylist())], names=["id", "out"])

    out = spread(df.select(df[id_].alias("id"), df[text].cast("string").alias("text"))).mapInArrow(work, f"id {kind}, out {schema}")
    return out.withColumnRenamed("id", id_)


def _list_column(rows: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, ends[-1])))


def token_ids(df: DataFrame, id_: str, text: str, ranks: str = DEFAULT_RANKS, name: str = "ids") -> DataFrame:
    """(id, ids): the token ids of every row's text, without special tokens, in one pass, without a shuffle where the files give every core a part.

    Null and empty texts have no ids (an empty list); the strings of special tokens are ordinary text; rows are kept as
    they are, repeated ones too. The rank file is read by the driver only.
    """
    return _encoded(df, id_, text, ranks, "array<int>", lambda encoder, texts: _list_column(encoder.encode_batch(texts))).withColumnRenamed("out", name)


def token_counts(df: DataFrame, id_: str, text: str, ranks: str = DEFAULT_RANKS, name: str = "n_tokens") -> DataFrame:
    """(id, n_tokens) of every row's text; 0 for null and empty ones."""
    return _encoded(df, id_, text, ranks, "int", lambda encoder, texts: pa.array(encoder.count_batch(texts), pa.int32())).withColumnRenamed("out", name)


def decoded(df: DataFrame, id_: str, ids: str, ranks: str = DEFAULT_RANKS, name: str = "text") -> DataFrame:
    """(id, text): the inverse of token_ids; null or no ids give an empty text."""
    model = df.sparkSession.sparkContext.broadcast(model_bytes(read_ranks(ranks)))
    kind = df.schema[id_].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(model.value)
        for batch in batches:
            texts = [encoder.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "out"])

    return df.select(df[id_].alias("id"), df[ids].alias("ids")).mapInArrow(work, f"id {kind}, out string").toDF(id_, name)
