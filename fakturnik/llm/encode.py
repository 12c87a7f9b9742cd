"""Encoding and decoding of texts with a public byte-level BPE tokenizer.

The library runs over Arrow batches, one tokenizer per Python worker. Token strings are mapped back
to bytes by the byte table of byte-level BPE, so every token has an exact span of bytes, and a map
from bytes to characters turns it into a span of characters; a character whose bytes are spread over
several tokens belongs to each of them.

Defined cases: null and empty texts have an empty list of ids; strings of special tokens inside a
text are ordinary text; texts of any length are encoded whole; repeated rows are encoded as often as
they stand there; further columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the tokenizer files; a parameter of every operator, this is its default.
FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k.json"

#: Characters encoded in one call of the library; bounds the memory that a call takes.
CHUNK_CHARS = 1_000_000


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def tokenizer_path(folder: str = FOLDER, name: str = TOKENIZER) -> str:
    return os.path.join(folder, name)


@lru_cache(maxsize=1)
def byte_of_sign() -> dict[str, int]:
    """The byte table: printable bytes stand for themselves, the others for signs from 256 upward."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            table[chr(256 + extra)] = b
            extra += 1
    return table


def token_bytes(token: str) -> bytes:
    table = byte_of_sign()
    return bytes(table[c] for c in token)


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive groups of texts of about CHUNK_CHARS characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_all(texts: list[str | None], path: str) -> Iterator[list[int]]:
    tok = load(path)
    for part in chunks([t or "" for t in texts]):
        for e in tok.encode_batch_fast(part, add_special_tokens=False):
            yield e.ids


def ids(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): the token ids of every text."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = list(encode_all(b.column(1).to_pylist(), path))
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, tokens): the number of tokens of every text."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(x) for x in encode_all(b.column(1).to_pylist(), path)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=[key, "tokens"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, tokens int")


def spans_of(text: str, lengths: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Byte spans and character spans (half open) of the tokens of a text, from their lengths in bytes."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    char_at = np.cumsum((raw & 0xC0) != 0x80) - 1  # character that a byte belongs to
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    if len(ends) == 0:
        return [], [], [], []
    return starts.tolist(), ends.tolist(), char_at[starts].tolist(), (char_at[ends - 1] + 1).tolist()


SPAN = "struct<id:int,byte_start:int,byte_end:int,char_start:int,char_end:int>"


def spans(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, tokens): ids with their byte and character spans."""
    path = path or tokenizer_path()
    names = ["id", "byte_start", "byte_end", "char_start", "char_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary_bytes(path)
        for b in batches:
            offsets, columns = [0], [[] for _ in names]
            texts = [t or "" for t in b.column(1).to_pylist()]
            for t, own in zip(texts, encode_all(texts, path), strict=True):
                for column, values in zip(columns, (own, *spans_of(t, [len(table[i]) for i in own])), strict=True):
                    column.extend(values)
                offsets.append(len(columns[0]))
            inner = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], names=names)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)], names=[key, "tokens"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, tokens array<{SPAN}>")


@lru_cache(maxsize=4)
def vocabulary_bytes(path: str) -> list[bytes]:
    tok = load(path)
    table = byte_of_sign()
    out = [b""] * tok.get_vocab_size()
    for sign, at in tok.get_vocab().items():
        out[at] = bytes(table[c] for c in sign) if all(c in table for c in sign) else sign.encode()
    return out


def decode_bytes(token_ids: list[int], path: str) -> bytes:
    table = vocabulary_bytes(path)
    return b"".join(table[i] for i in token_ids)


def pieces_of(token_ids: list[int], path: str) -> list[str]:
    """The text of each token; a character split over tokens comes out whole with the token that completes it."""
    import codecs

    table, stream = vocabulary_bytes(path), codecs.getincrementaldecoder("utf-8")("replace")
    out = [stream.decode(table[i]) for i in token_ids]
    rest = stream.decode(b"", final=True)
    if rest and out:
        out[-1] += rest
    return out


def texts(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text): the text of every list of ids; a null list gives the empty text, broken UTF-8 the replacement sign."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [decode_bytes(x or [], path).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, text string")
