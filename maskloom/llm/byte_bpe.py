"""Byte-level BPE: texts to token ids and back, by a given rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskloom.llm.records import REGION_ID, TEXT, slices, texts_of

_loaded: dict[int, object] = {}


def read_ranks(path: str) -> bytes:
    """The rank file: one base64 token and its rank a line. Read once on the driver; it has a fixed size."""
    with open(path, "rb") as f:
        return f.read()


def token_bytes(ranks: bytes) -> list[bytes]:
    """The bytes of each token, by rank."""
    found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, ranks.splitlines())}
    return [found.get(i, b"") for i in range(max(found, default=-1) + 1)]


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def build_tokenizer(tokens: list[bytes]):
    """A BPE model of the tokenizers library that merges the bytes of one piece as the ranks say.

    Every split of a token into two tokens is a merge, ordered by the rank of what it makes: any two
    neighbours whose bytes together are a token may join, and the lowest rank joins first.
    """
    from tokenizers import Tokenizer, models, pre_tokenizers

    shown = byte_characters()
    names = ["".join(shown[b] for b in t) for t in tokens]
    known = set(names) - {""}
    merges = [
        (name[:k], name[k:])
        for name in names for k in range(1, len(name)) if name[:k] in known and name[k:] in known
    ]
    model = models.BPE(vocab={n: i for i, n in enumerate(names) if n}, merges=merges, fuse_unk=False)
    out = Tokenizer(model)
    out.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return out


class TokenBytes:
    """The bytes of all tokens in one array, from which the bytes of any ids are taken at once."""

    def __init__(self, tokens: list[bytes]):
        self.widths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.table, self.begins = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(self.widths) - self.widths

    def joined(self, ids: np.ndarray) -> bytes:
        width = self.widths[ids]
        ends = np.cumsum(width)
        return self.table[np.repeat(self.begins[ids] - ends + width, width) + np.arange(width.sum())].tobytes()


class PieceEncoder:
    """Cuts texts into pieces by a pattern and encodes each distinct piece once.

    Ids of pieces are remembered across the texts of a task, up to ``MOST`` pieces or ``MOST_BYTES``; beyond that
    memory begins anew, and only time is lost.
    """
    MOST, MOST_BYTES = 150_000, 8 << 20

    def __init__(self, ranks: bytes, pattern: str):
        import regex

        tokens = token_bytes(ranks)
        self.tokenizer, self.pattern = build_tokenizer(tokens), regex.compile(pattern)
        self.bytes = TokenBytes(tokens)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [self.pattern.findall(t) for t in texts]
        if len(self.known) > self.MOST or self.held > self.MOST_BYTES:
            self.known, self.held = {}, 0
        new = list({p for own in pieces for p in own} - self.known.keys())
        for piece, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.known[piece] = ids = np.array(e.ids, dtype=np.int32).tobytes()
            self.held += len(ids)
        known = self.known
        return [np.frombuffer(b"".join([known[p] for p in own]), np.int32) for own in pieces]


def _worker_encoder(ranks: bytes, pattern: str) -> PieceEncoder:
    key = hash((ranks, pattern))
    if key not in _loaded:
        _loaded[key] = PieceEncoder(ranks, pattern)
    return _loaded[key]


def _list_column(values: list[np.ndarray], lengths: np.ndarray) -> pa.Array:
    ends = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=ends[1:])
    flat = np.concatenate(values).astype(np.int32) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode_texts(regions: DataFrame, ranks: bytes, pattern: str, offsets: bool = False, decoded: bool = False) -> DataFrame:
    """``region_id``, ``token_ids`` array<int> of each whole ``original_text``; one row per row.

    ``pattern`` cuts a text into pieces and each piece is merged on its own. Nothing in a text is a special
    token. With ``offsets`` also ``starts`` and ``ends`` array<int>: the characters each token covers; a
    token that holds only some bytes of a character covers the whole character, so neighbours may overlap.
    With ``decoded`` also ``decoded`` binary as :func:`decode_tokens` gives it, by the same workers: each step in
    Python of a stage has workers of its own beside the others'.

    A null or empty text has no tokens. Ids may be null or repeat; rows are not compared with each other.
    Text of any length is one row; batches are cut by bytes, so memory is bounded by the longest text.
    """
    from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

    shared = regions.sparkSession.sparkContext.broadcast(ranks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _worker_encoder(shared.value, pattern)
        for rows, data, bounds in slices(batches, TEXT, 1 << 18):
            texts = [t.decode("utf-8", "replace") for t in texts_of(data, bounds)]
            ids = encoder.encode(texts)
            lengths = np.array([len(x) for x in ids])
            columns = [rows.column(0), _list_column(ids, lengths)]
            if offsets:
                spans = [_character_spans(encoder.bytes.widths[x], np.frombuffer(t.encode(), np.uint8)) for x, t in zip(ids, texts)]
                columns += [_list_column([s[k] for s in spans], lengths) for k in (0, 1)]
            if decoded:
                columns.append(pa.array([encoder.bytes.joined(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=names)
        encoder.known, encoder.held = {}, 0  # an idle worker should not hold it

    id_field = regions.select(REGION_ID).schema[0]
    lists = ["token_ids"] + ["starts", "ends"] * offsets
    names = [REGION_ID] + lists + ["decoded"] * decoded
    schema = StructType([id_field] + [StructField(n, ArrayType(IntegerType(), False), False) for n in lists]
                        + [StructField("decoded", BinaryType(), False)] * decoded)
    return regions.select(REGION_ID, TEXT).mapInArrow(encode, schema)


def _character_spans(widths: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last character of byte runs of these widths."""
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(widths)
    return (character[ends - widths], character[ends - 1] + 1) if len(widths) else (ends, ends)


def decode_tokens(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """``encoded`` with ``decoded`` binary: the bytes of ``token_ids``, joined.

    Characters that several tokens share come together again, since bytes and not characters are joined.
    A null list gives no bytes; an id outside the rank file is an error. Other columns stay.
    """
    from pyspark.sql.types import BinaryType, StructField, StructType

    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    fields = [f for f in encoded.schema if f.name != "decoded"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenBytes(token_bytes(shared.value))
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("token_ids"))
            joined = []
            for ids in lists:
                joined.append(tokens.joined(ids.values.to_numpy() if ids.is_valid else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(joined, pa.binary())], names=names)

    names = [f.name for f in fields] + ["decoded"]
    return encoded.select(*[f"`{f.name}`" for f in fields]).mapInArrow(
        decode, StructType(fields + [StructField("decoded", BinaryType(), False)]))


def joined_ids(column: str = "token_ids"):
    return F.concat_ws(" ", F.col(column).cast("array<string>"))
