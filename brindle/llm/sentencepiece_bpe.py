"""Byte-level BPE through a sentencepiece model written directly from a rank vocabulary.

Each byte is mapped to a printable character, each vocabulary entry becomes a piece with score
-rank, and normalisation is the identity.  Sentencepiece merges the adjacent pair with the best
score, leftmost first, which is the rank order.  Pre-tokens that are entries themselves take
their rank at once, as rank encoders do.  Decoding is the inverse mapping id -> bytes.

Defined cases: null and empty texts have no tokens; texts of any length are encoded whole; ids do
not depend on other rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

CACHE = 1 << 18


def read_ranks(path: str) -> list[bytes]:
    """Entries of a rank file, by id; the ids must be 0, 1, 2..."""
    with open(path, "rb") as f:
        pairs = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, f))
    if [x for x, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks have gaps")
    return [x for _, x in pairs]


def byte_characters() -> list[str]:
    """A character for each byte: its own Latin-1 one if printable and no space, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def model_proto(entries: Sequence[bytes]) -> bytes:
    """A serialised sentencepiece ModelProto: entries as pieces in id order, then the unknown piece.

    ModelProto: pieces 1, trainer_spec 2, normalizer_spec 3.  Piece: piece 1, score 2, type 3
    (NORMAL 1, UNKNOWN 2).  TrainerSpec: model_type 3 (BPE 2), vocab_size 4, unk_id 40, bos_id 41,
    eos_id 42, pad_id 43.  NormalizerSpec: name 1, add_dummy_prefix 3, remove_extra_whitespaces 4,
    escape_whitespaces 5."""
    chars = byte_characters()
    none = (1 << 64) - 1
    out = [
        _field(1, _field(1, "".join(chars[b] for b in x).encode()) + _field(2, float(-i)) + _field(3, 1))
        for i, x in enumerate(entries)
    ]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    n = len(entries)
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n) + _field(41, none) + _field(42, none) + _field(43, none)
    out.append(_field(2, trainer))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Codec:
    """Encoder and decoder of one vocabulary and pre-token pattern."""

    def __init__(self, entries: Sequence[bytes], pattern: str, model: bytes | None = None):
        import regex

        self.entries = list(entries)
        self.whole = {x: i for i, x in enumerate(entries)}
        self.table = byte_characters()
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model or model_proto(entries))
        self.find = regex.compile(pattern).findall
        self.known: dict[str, tuple[str, int, list[int]]] = {}

    def pre_token(self, token: str) -> list[int]:
        raw = token.encode()
        own = self.whole.get(raw)
        if own is not None:
            return [own]
        table = self.table
        return self.pieces.encode("".join([table[b] for b in raw]))

    def encode(self, text: str) -> list[int]:
        known, ids = self.known, []
        if len(known) > CACHE:
            known.clear()
        for token in self.find(text):
            got = known.get(token)
            if got is None:
                got = self.pre_token(token)
                if len(token) < 64:
                    known[token] = got
            ids += got
        return ids

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join([self.entries[i] for i in ids])


def _encode(entries, pattern: str, digest: bool):
    model = model_proto(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(entries, pattern, model)
        names = [str(i) for i in range(len(entries))]
        for batch in batches:
            texts = [x.decode("utf-8", "replace") for x in utf8(batch.column(1))]
            if digest:
                out = []
                for text in texts:
                    ids = codec.encode(text)
                    listed = ",".join([names[i] for i in ids])
                    back = codec.decode(ids)
                    out.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
                cols = [[x[i] for x in out] for i in range(3)]
                yield pa.record_batch(
                    [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
            else:
                yield pa.record_batch(
                    [batch.column(0), pa.array([codec.encode(x) for x in texts], pa.list_(pa.int32()))],
                    names=["doc_id", "ids"],
                )

    return run


def _decode(entries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join([entries[i] for i in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

    return run


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of every row.  The vocabulary (under a megabyte) goes with the tasks."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_encode(read_ranks(vocabulary), pattern, False), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, bytes from doc_id, ids."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(read_ranks(vocabulary)), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(
        _encode(read_ranks(vocabulary), pattern, True),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
