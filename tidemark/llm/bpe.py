"""Byte-level BPE encoding and decoding with a sentencepiece model that is written directly from a vocabulary.

The vocabulary (token bytes and ranks) becomes a serialised sentencepiece model: each token's bytes are mapped to
printable characters, one a byte, and its score is its negative rank, so that sentencepiece merges the pair of least
rank first, as byte-level BPE does. Normalisation is the identity. Texts are cut into pre-tokens by the vocabulary's
pattern and each is encoded by itself; a pre-token that is a token as a whole is that token, as in tiktoken. Decoding
maps ids back to their bytes.

The vocabulary file is read on the driver, by the path that is a parameter, and its model (under 1 MB) goes to the
tasks as a broadcast. Workers remember encoded pre-tokens in a table of bounded size.

Defined results: a null or empty text has no tokens (the digests of nothing); repeated rows are each encoded; null ids
pass through; extra columns are ignored by ``op6_bpe`` and kept by ``encode``; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import struct
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import document_text

#: Pre-tokens, and characters of them, that a worker remembers before it begins anew; characters cut up at once.
REMEMBERED, REMEMBERED_CHARS, AT_ONCE = 400_000, 16_000_000, 1_000_000


def read_vocabulary(path: str) -> list[bytes]:
    """Token bytes in the order of their ranks, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must count from 0 without gaps")
    return [t for _, t in ranked]


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it prints in Latin-1, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b not in rest else chr(0x100 + rest.index(b)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _bytes_field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: pieces in rank order, then the unknown piece that the format asks for."""
    shown = byte_characters()
    out = bytearray()
    for rank, token in enumerate(vocabulary):
        piece = "".join(shown[b] for b in token).encode()
        out += _bytes_field(1, _bytes_field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)))
    out += _bytes_field(1, _bytes_field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _int_field(3, 2))
    trainer = _int_field(3, 2) + _int_field(4, len(vocabulary) + 1)  # model type BPE, size
    trainer += _int_field(40, len(vocabulary)) + b"".join(_int_field(n, (1 << 64) - 1) for n in (41, 42, 43))  # ids of unk; no bos, eos, pad
    normaliser = _bytes_field(1, b"identity") + b"".join(_int_field(n, 0) for n in (3, 4, 5))  # no prefix, white space as it is
    return bytes(out + _bytes_field(2, trainer) + _bytes_field(3, normaliser))


class Codec:
    """Encodes and decodes with a model and its vocabulary; one a worker."""

    def __init__(self, vocabulary: list[bytes], pattern: str):
        self.tokens, self.whole = vocabulary, {t: i for i, t in enumerate(vocabulary)}
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=serialise(vocabulary))
        self.find = regex.compile(pattern).findall
        self.shown = "".join(byte_characters())
        self.iterate = regex.compile(pattern).finditer
        self.known: dict[str, tuple[int, ...]] = {}
        self.chars = 0

    def _learn(self, pieces) -> None:
        unknown = []
        for p in pieces:
            token = self.whole.get(p.encode())
            if token is None:
                unknown.append(p)
            else:
                self.known[p] = (token,)
        mapped = [codecs.charmap_decode(p.encode(), "strict", self.shown)[0] for p in unknown]
        for p, ids in zip(unknown, self.processor.encode(mapped, num_threads=1)):
            self.known[p] = tuple(ids)

    def encode(self, text: str) -> list[int]:
        if len(text) <= AT_ONCE:
            return self._ids(self.find(text))
        matches = (m.group() for m in self.iterate(text))
        return list(chain.from_iterable(map(self._ids, iter(lambda: list(islice(matches, AT_ONCE // 8)), []))))

    def _ids(self, pieces: list[str]) -> list[int]:
        if new := set(pieces).difference(self.known):
            if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
                self.known, self.chars = {}, 0
                new = set(pieces)
            self._learn(new)
            self.chars += sum(map(len, new))
        return list(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(model) -> Codec:
    return Codec(*model.value)


class _Model:
    """A broadcast vocabulary and pattern, hashable by its broadcast's number."""

    def __init__(self, spark, path: str, pattern: str):
        self.broadcast = spark.sparkContext.broadcast((read_vocabulary(path), pattern))
        self.number = self.broadcast._jbroadcast.id() if self.broadcast._jbroadcast is not None else 0

    def __getstate__(self):
        return {"broadcast": self.broadcast, "number": self.number}

    def __hash__(self):
        return hash(self.number)

    def __eq__(self, other):
        return self.number == other.number

    @property
    def value(self):
        return self.broadcast.value


def production_model(spark) -> _Model:
    """The multilingual vocabulary of 50,256 tokens; its path comes from the package of public tokenizers."""
    import public_tokenizers

    return _Model(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def encode(text: Column, model: _Model) -> Column:
    """The ids of a text."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        codec = _codec(model)
        return pa.array([codec.encode(t.as_py() or "") for t in texts], pa.list_(pa.int32()))

    return ids(text)


def decode(ids: Column, model: _Model) -> Column:
    """The bytes of ids."""

    @F.arrow_udf(BinaryType())
    def data(rows: pa.Array) -> pa.Array:
        codec = _codec(model)
        return pa.array([codec.decode(r or ()) for r in rows.to_pylist()], pa.binary())

    return data(ids)


DIGEST = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])
WITH_IDS = StructType([StructField("ids", ArrayType(IntegerType())), *DIGEST.fields])


def round_trip(text: Column, model: _Model, with_ids: bool = False) -> Column:
    """What encoding and then decoding gives, as digests, and if asked for the ids too."""
    kind = WITH_IDS if with_ids else DIGEST

    @F.arrow_udf(kind)
    def trip(texts: pa.Array) -> pa.Array:
        codec = _codec(model)
        shown = list(map(str, range(len(codec.tokens))))
        every, n, of_ids, of_bytes = [], [], [], []
        for t in texts:
            ids = codec.encode(t.as_py() or "")
            n.append(len(ids))
            of_ids.append(hashlib.sha256(",".join(map(shown.__getitem__, ids)).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            if with_ids:
                every.append(np.array(ids, np.int32))
        out = [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
        return pa.StructArray.from_arrays([*([pa.array(every, pa.list_(pa.int32()))] if with_ids else []), *out], kind.names)

    return trip(text)


def encode_documents(docs: DataFrame, model: _Model | None = None) -> DataFrame:
    """doc_id, source, ids, n_tokens and the digests of the ids and of what they decode to, for each row."""
    trip = round_trip(F.coalesce("text", F.lit("")), model or production_model(docs.sparkSession), with_ids=True)
    return docs.select("doc_id", "source", trip.alias("trip")).select("doc_id", "source", "trip.*")


def digest(docs: DataFrame, model: _Model | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    trip = round_trip(F.col("text"), model or production_model(docs.sparkSession))
    return document_text(docs).select("doc_id", trip.alias("trip")).select("doc_id", "trip.*")


def op6_bpe(spark, sf_dir) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB has no BPE; the digest of the decoded bytes is the digest of the text, which the tests hold the result to.
QUERIES = {"op6_bpe": op6_bpe}
ORACLE_SQL = {}
