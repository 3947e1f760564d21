"""Byte-level BPE encoding and decoding through a sentencepiece model that is written straight from the ranks.

Every byte stands for one printable character, so a piece of the vocabulary is a string of such characters.  The model
file holds these pieces with score minus rank, the identity normaliser, no dummy prefix and no white-space handling.  The
BPE of sentencepiece joins the neighbouring pair whose union scores best, leftmost first: the pair of lowest rank.  Pieces
that its merges do not rebuild (a rank file may hold some) are found when the model is loaded and looked up instead.
Texts are cut into pre-tokens by a given pattern; each is encoded by itself.  Decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts
from .vocab import PartEncoder

#: First code point of the 256 characters that stand for bytes; all are letters without special meaning.
BYTE_CHARS = 0x4E00


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file, by rank; ranks have to be 0, 1, 2 and so on."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"the ranks of {path} have gaps")
    return [t for _, t in pairs]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def as_chars(token: bytes) -> str:
    return token.decode("latin-1").translate(_TO_CHARS)


_TO_CHARS = {b: BYTE_CHARS + b for b in range(256)}


def model_file(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model: fields of the public ``ModelProto`` message."""
    unknown, normal = 2, 1
    pieces = [(as_chars(t), -float(rank), normal) for rank, t in enumerate(tokens)] + [("<unk>", 0.0, unknown)]
    body = b"".join(
        _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _field(3, kind))
        for text, score, kind in pieces)
    bpe = 2
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(24, 0) + _field(45, b"<unk>")
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return body + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder over one rank file and one pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model_file(self.tokens))
        self.pattern = regex.compile(pattern)
        whole = self.processor.encode([as_chars(t) for t in self.tokens], num_threads=1)
        self.direct = {t: rank for rank, (t, ids) in enumerate(zip(self.tokens, whole, strict=True)) if ids != [rank]}
        self.encoder = PartEncoder(self._encode_part)

    def _encode_part(self, part: str) -> list[int]:
        out: list[int] = []
        for word in self.pattern.findall(part):
            raw = word.encode()
            out += [self.direct[raw]] if raw in self.direct else self.processor.encode(as_chars(raw))
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encoder.ids(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per process and vocabulary."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids`` with the token ids of every row as ``array<int>``; a null text is empty."""
    kind = docs.schema[key].dataType.simpleString()

    def run(keys: list, texts: list[bytes]) -> dict:
        c = codec(path, pattern)
        return {key: keys, "ids": [np.frombuffer(c.encode(t.decode("utf-8", "replace")), "<i4") for t in texts]}

    return map_texts(docs, run, f"{key} {kind}, ids array<int>", key, text)


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, bytes``: the decoded bytes of every row of ids; null ids are empty."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(keys: list, _: list, rows: list) -> dict:
        c = codec(path, pattern)
        return {key: keys, "bytes": [c.decode(np.asarray(r or [], "<u4").tobytes()) for r in rows]}

    from pyspark.sql import functions as F

    return map_texts(encoded.withColumn("no_text", F.lit(None).cast("string")), run, f"{key} {kind}, bytes binary", key,
                     "no_text", more=(ids,))


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256, exact`` for every row: digests of its ids and of their decoding.

    Ids and decoded bytes of one document at a time are held in a worker; neither is shuffled.  A null text is empty; a
    null key and repeated rows give rows like any other.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(keys: list, texts: list[bytes]) -> dict:
        c = codec(path, pattern)
        out: dict[str, list] = {key: keys, "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "exact": []}
        for t in texts:
            ids = c.encode(t.decode("utf-8", "replace"))
            back = c.decode(ids)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
            out["exact"].append(back == t)
        return out

    return map_texts(docs, run, f"{key} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean",
                     key, text)
