"""Byte-level BPE through a sentencepiece model that is written from the ranks alone.

The vocabulary's byte strings become pieces of printable characters, one per byte, scored by the
negative rank, so the model merges the pair whose result has the lowest rank, as the rank file
defines. Normalisation is the identity. The model is only serialised, never trained. Pre-tokens are
encoded one by one; decoding maps ids back to their bytes.

Null and empty texts have no ids. Repeated rows give repeated rows. Columns besides the id and the
text are ignored, whatever they are called.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellkpi.llm import tokenizing
from cellkpi.llm.common import sized_slices

RANKS = "byte_bpe_50k.tiktoken"

# Fixed values of the model file's layout: field numbers and enumeration members.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
TYPE_NORMAL, TYPE_UNKNOWN = 1, 2
MODEL_TYPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID, UNK_PIECE = 3, 4, 40, 41, 42, 43, 45
MODEL_BPE = 2
NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5


def _varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, content: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(content)) + content


def _score(field: int, value: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", value)


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank. Ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as file:
        rows = [line.split() for line in file if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in rows}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks must be consecutive from 0")
    return [tokens[rank] for rank in range(len(tokens))]


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes last."""
    symbols = tokenizing.byte_symbols()
    unknown = "<unknown>"
    out = []
    for rank, token in enumerate(tokens):
        text = "".join(symbols[b] for b in token).encode()
        piece = _block(PIECE_TEXT, text) + _score(PIECE_SCORE, -float(rank))
        out.append(_block(PIECES, piece + _number(PIECE_TYPE, TYPE_NORMAL)))
    last = _block(PIECE_TEXT, unknown.encode()) + _score(PIECE_SCORE, 0.0)
    out.append(_block(PIECES, last + _number(PIECE_TYPE, TYPE_UNKNOWN)))
    trainer = _number(MODEL_TYPE, MODEL_BPE) + _number(VOCAB_SIZE, len(tokens) + 1)
    trainer += _number(UNK_ID, len(tokens)) + _block(UNK_PIECE, unknown.encode())
    trainer += b"".join(_number(field, -1) for field in (BOS_ID, EOS_ID, PAD_ID))
    normalizer = _block(NAME, b"identity")
    for field in (ADD_DUMMY_PREFIX, REMOVE_EXTRA_SPACES, ESCAPE_SPACES):
        normalizer += _number(field, 0)
    return b"".join(out) + _block(TRAINER, trainer) + _block(NORMALIZER, normalizer)


class Codec:
    """Encodes texts to ids (little-endian unsigned 32-bit) and decodes them."""

    def __init__(self, path: str):
        self.tokens = read_ranks(path)
        self.whole = {token: rank for rank, token in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        self.mapping = str.maketrans(
            {chr(b): symbol for b, symbol in enumerate(tokenizing.byte_symbols())}
        )
        self.known: dict[str, bytes] = {}

    def learn(self, found: Iterable[str]) -> None:
        new = set(found).difference(self.known)
        if len(self.known) + len(new) > tokenizing.CACHE_ENTRIES:
            self.known, new = {}, set(found)
        rest = []
        for pretoken in new:
            # A pre-token that is a token by itself is that token.
            rank = self.whole.get(pretoken.encode())
            if rank is None:
                rest.append(pretoken)
            else:
                self.known[pretoken] = rank.to_bytes(4, "little")
        mapped = [x.encode().decode("latin-1").translate(self.mapping) for x in rest]
        for pretoken, ids in zip(rest, self.model.encode(mapped, num_threads=1), strict=True):
            self.known[pretoken] = np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of ``text``, in parts of bounded size."""
        for piece in tokenizing.pieces(text):
            found = tokenizing.split(piece)
            self.learn(found)
            yield b"".join(map(self.known.__getitem__, found))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(
    documents: DataFrame,
    ranks: str | None = None,
    with_ids: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """A row per document: its id, tokens, SHA-256 of the ids and of the bytes decoded from them.

    ``ranks`` is the path of a rank file, readable on every machine. ``with_ids`` adds ``ids``, the
    ids as an array of integers.
    """
    path = ranks or public_tokenizers.path(RANKS)
    texts = documents.select(
        F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text")
    )
    kind = texts.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string"
    schema += ", decoded_sha256 string" + ", ids array<int>" * with_ids

    def transcode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in sized_slices(batches, 1):
            counts, id_hashes, text_hashes, all_ids = [], [], [], []
            for text in batch.column(1).to_pylist():
                id_hash, text_hash, size, parts = hashlib.sha256(), hashlib.sha256(), 0, []
                for part in own.encode(text):
                    id_hash.update(part)
                    text_hash.update(own.decode(part))
                    size += len(part) // 4
                    if with_ids:
                        parts.append(np.frombuffer(part, "<i4"))
                counts.append(size)
                id_hashes.append(id_hash.hexdigest())
                text_hashes.append(text_hash.hexdigest())
                all_ids.append(np.concatenate(parts) if parts else None)
            columns = [batch.column(0), pa.array(counts, pa.int64())]
            columns += [pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(columns, names)

    return texts.mapInArrow(transcode, schema)
