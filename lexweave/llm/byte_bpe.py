"""Byte-level BPE by a sentencepiece model that is written directly from a rank vocabulary.

Every byte stands for one printable character, so that each piece of the vocabulary is a string
without blanks; a piece's score is its negative rank, its number the rank, and the normaliser leaves
text alone. Sentencepiece then merges, within a pre-token, the adjacent pair whose union has the
lowest rank, as a rank-based byte-level BPE does. Decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from lexweave.llm.shared import schema_with, small_batches
from lexweave.llm.words import column

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of pre-tokens and ids that a worker remembers besides the vocabulary's own; then it starts anew. A longer pre-token isn't kept.
REMEMBERED, LONGEST = 8 << 20, 200
#: Texts that a worker takes together.
BATCH = 200

_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The character that stands for a byte: itself where printable, else the next one from U+0100 on.
BYTE_CHARS = [chr(b) if b in _SHOWN else chr(0x100 + i) for b, i in ((b, b - sum(x < b for x in _SHOWN)) for b in range(256))]
_TO_CHARS = dict(enumerate(BYTE_CHARS))


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token and rank a line), by rank; a rank that is missing has the empty token."""
    with open(path, "rb") as file:
        ranks = {int(rank): base64.b64decode(token) for token, rank in filter(None, map(bytes.split, file))}
    return [ranks.get(i, b"") for i in range(max(ranks, default=-1) + 1)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A field of a protocol buffer message."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(tokens: list[bytes]) -> bytes:
    """A sentencepiece model of type BPE with these tokens, and after them the unknown piece."""
    # a rank without token gets a piece of a character that stands for no byte, so that ids stay ranks
    names = ["".join(BYTE_CHARS[b] for b in token) or chr(0xF0000 + rank) for rank, token in enumerate(tokens)]
    pieces = [_field(1, name.encode()) + _field(2, float(-rank)) + _field(3, 1 if token else 5) for rank, (name, token) in enumerate(zip(names, tokens, strict=True))]
    pieces.append(_field(1, "<unknown piece>".encode()) + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces))  # model_type BPE, vocab_size
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no dummy prefix, no squeezing or escaping of blanks
    return b"".join(_field(1, x) for x in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes texts in a worker."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.find = tokens, regex.compile(pattern).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model_proto(tokens))
        self.known: dict[str, bytes] = {}
        self.found: dict[str, bytes] = {}
        for rank, token in enumerate(tokens):
            try:
                self.known[token.decode()] = struct.pack("<I", rank)
            except UnicodeDecodeError:
                pass
        self.found, self.size = dict(self.known), 0
        # decoding: the id's piece, and for each of its characters the byte that it stands for
        byte_of = {c: b for b, c in enumerate(BYTE_CHARS)}
        self.bytes_of = [bytes(byte_of[c] for c in self.pieces.id_to_piece(i)) if token else b"" for i, token in enumerate(tokens)]

    def _learn(self, new: list[str]) -> None:
        mapped = [x.encode().decode("latin-1").translate(_TO_CHARS) for x in new]
        for x, ids in zip(new, self.pieces.encode(mapped, out_type=int, num_threads=1), strict=True):
            self.found[x] = struct.pack(f"<{len(ids)}I", *ids)
            self.size += len(x) + 4 * len(ids) + 150

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers. New pre-tokens are learnt together."""
        if self.size > REMEMBERED:
            self.found, self.size = dict(self.known), 0
        parts = [self.find(text or "") for text in texts]
        new = list({x for run in parts for x in run} - self.found.keys())
        self._learn(new)
        out = [b"".join(map(self.found.__getitem__, run)) for run in parts]
        for x in new:
            if len(x) > LONGEST:
                del self.found[x]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple, Codec] = {}


def _name(tokens: list[bytes]) -> bytes:
    """What tells a vocabulary from others; taken once, on the driver."""
    return hashlib.sha256(b"".join(struct.pack("<I", len(x)) + x for x in tokens)).digest()


def _codec(tokens: list[bytes], pattern: str, name: bytes) -> Codec:
    """One codec per worker process."""
    key = (name, pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(tokens, pattern)
    return _codecs[key]


def _added(df: DataFrame, new: dict[str, str], make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """df with the new columns that make(batch) gives, in place of columns of these names."""
    schema = schema_with(df, new)
    rest = schema.names[: -len(new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *make(part)], schema.names)

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, tokens: list[bytes], pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs (text, ...) with ``ids``: binary, little-endian unsigned 32-bit. Null counts as empty.

    Each match of the pattern is encoded separately, without special tokens. The vocabulary (under
    1 MB) goes to the tasks with their code.
    """
    name = _name(tokens)
    return _added(docs, {"ids": "binary"}, lambda b: [pa.array(_codec(tokens, pattern, name).encode(column(b, "text").to_pylist()), pa.binary())])


def decode(encoded: DataFrame, tokens: list[bytes]) -> DataFrame:
    """encoded (ids, ...) with ``decoded``: the bytes; null ids give null."""
    name = _name(tokens)
    return _added(encoded, {"decoded": "binary"}, lambda b: [pa.array((None if x is None else _codec(tokens, public_tokenizers.PATTERN, name).decode(x) for x in column(b, "ids").to_pylist()), pa.binary())])


def round_trip(docs: DataFrame, tokens: list[bytes], pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encode and decode in one pass, keeping digests only.

    Every row of docs, repeated ones too, gives one row; an empty or null text has no tokens, and texts of
    any length are taken whole. Other columns come along; columns of the three names are replaced. An
    empty table gives an empty table.
    """
    name = _name(tokens)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = _codec(tokens, pattern, name)
        n, ids_sha, decoded_sha = [], [], []
        for ids in codec.encode(column(batch, "text").to_pylist()):
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            decoded_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]

    return _added(docs, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, make)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count and the digests of its ids and of their decoding."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, read_ranks(public_tokenizers.path(VOCABULARY))).drop("text")
