"""Byte-level BPE through a sentencepiece model written directly from a rank file.

No model is trained. The rank file's byte strings become pieces over a printable
alphabet (one character a byte), scored by their negative rank, with a
normaliser that changes nothing. sentencepiece then merges the adjacent pair
with the best score, leftmost first, which is the merge order of the ranks.
Piece index = rank, and the unknown piece comes last, where no input reaches it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_columns

#: Pre-tokens whose ids a worker remembers before it starts afresh, and the characters of the longest one it remembers.
CACHE, LONGEST = 400_000, 64
#: The pattern whose pre-tokens hold no space but at their start, adjoining spaces aside.
SPACE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
])
TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])


def _alphabet() -> list[str]:
    """A printable character for each byte: itself where printable, else one past U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


ALPHABET = _alphabet()
#: latin-1 text (a character per byte) to the alphabet, and back to the byte.
_MAP = {b: c for b, c in enumerate(ALPHABET)}
_BYTE = {c: b for b, c in enumerate(ALPHABET)}


def read_ranks(path: str) -> list[bytes]:
    """Byte strings of a rank file in the order of their ranks, which must be gapless from 0."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes | None] = [None] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    if any(x is None for x in out) or len(set(out)) != len(out):
        raise ValueError("ranks aren't a gapless, unambiguous range")
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: length-delimited, varint or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_proto(pieces: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model: trainer spec (BPE), identity normaliser and the pieces."""
    out = bytearray()
    for rank, piece in enumerate(pieces):
        out += _field(1, _field(1, "".join(ALPHABET[b] for b in piece).encode()) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(24, 0) + _field(40, len(pieces))
    trainer += _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normaliser = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


class Codec:
    """Encoder and decoder for one rank file and one pre-token pattern.

    Ids are remembered as packed 32-bit integers, which the garbage collector
    needn't visit. `chunks` remembers what follows a single space up to the next
    one: no pre-token holds a space after another character unless spaces
    adjoin, so texts without two adjoining spaces are encoded chunk by chunk.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import sentencepiece

        pieces = read_ranks(path)
        self.whole = {p: i for i, p in enumerate(pieces)}
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model_proto(pieces))
        # Decoding knows the model only: each id's piece, and the byte behind each of its characters.
        self.bytes = [bytes(map(_BYTE.__getitem__, self.sp.id_to_piece(i))) for i in range(len(pieces))]
        self.find = regex.compile(pattern).findall
        self.splits_at_spaces = pattern == SPACE_PATTERN
        self.strings = [str(i) for i in range(len(self.bytes))]
        self.parts: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _learn(self, new: set[str]) -> None:
        """Ids of pre-tokens not met before: the whole pre-token if it is a piece, else its merges."""
        cut, forms = [], []
        for t in new:
            raw = t.encode()
            if (i := self.whole.get(raw)) is not None:
                self.parts[t] = i.to_bytes(4, "little")
            else:
                cut.append(t)
                forms.append(raw.decode("latin-1").translate(_MAP))
        for t, ids in zip(cut, self.sp.encode(forms, out_type=int, num_threads=1), strict=True):
            self.parts[t] = array("i", ids).tobytes()

    def _cut(self, text: str | None) -> tuple[str, list[str]]:
        """What precedes the first space, and the chunks after each; all in the first where spaces adjoin."""
        if not text:
            return "", []
        if not text.isascii():
            try:
                text.encode()
            except UnicodeEncodeError:
                text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        if not self.splits_at_spaces or "  " in text:
            return text, []
        first, *rest = text.split(" ")
        return first, rest

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; none for null and empty ones. Lone surrogates are replaced, as in tiktoken.

        sentencepiece is called once for all pre-tokens that are new.
        """
        if len(self.parts) > CACHE:
            self.parts.clear()
        if len(self.chunks) > CACHE:
            self.chunks.clear()
        known, parts, find = self.chunks, self.parts, self.find
        cut = [self._cut(t) for t in texts]
        heads = [find(first) for first, _ in cut]
        new = list({t for _, rest in cut for t in rest if t not in known})
        found = [find(" " + t) for t in new]
        self._learn({t for x in chain(heads, found) for t in x if t not in parts})
        part = parts.__getitem__
        for t, x in zip(new, found, strict=True):
            known[t] = part(x[0]) if len(x) == 1 else b"".join(map(part, x))
        chunk = known.__getitem__
        out = [np.frombuffer(b"".join(map(part, head)) + b"".join(map(chunk, rest)), "<i4") for head, (_, rest) in zip(heads, cut, strict=True)]
        for t in new:
            if len(t) > LONGEST:
                del known[t]
        for t in {t for x in chain(heads, found) for t in x if len(t) > LONGEST}:
            parts.pop(t, None)
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes behind ids by the inverse of the byte map; the inverse of `encode` on UTF-8."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def text_of(self, ids: np.ndarray) -> str:
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and rank file."""
    return Codec(path, pattern)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(x) for x in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32), pa.int32()), type=pa.list_(pa.field("element", pa.int32(), False)))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids, decoded, *keep) for each row: token ids and the text got back from them.

    Null and empty texts give no ids and an empty string. Repeated ids give one
    row each; columns named in `keep` pass through, others are not read. One narrow stage: nothing is shuffled,
    a lost executor costs its own partitions only.
    """
    def make():
        c = codec(path, pattern)

        def run(ids, texts, *rest):
            out = c.encode_all(texts)
            return ids, _lists(out), [c.decode_bytes(x).decode("utf-8", "replace") for x in out], *rest

        return run

    schema = T.StructType([*TOKENS.fields, *[docs.schema[c] for c in keep]])
    return map_columns(docs, [docs[id_col].cast("long").alias("doc_id"), docs[text_col], *[docs[c] for c in keep]], make, schema)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row; hashes are taken where the ids are made."""
    def make():
        c = codec(path, pattern)

        def run(ids, texts):
            n, a, b = [], [], []
            for x in c.encode_all(texts):
                n.append(len(x))
                a.append(hashlib.sha256(c.text_of(x).encode()).hexdigest())
                b.append(hashlib.sha256(c.decode_bytes(x)).hexdigest())
            return ids, n, a, b

        return run

    return map_columns(docs, [docs[id_col].cast("long").alias("doc_id"), docs[text_col]], make, SCHEMA)
