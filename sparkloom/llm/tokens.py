"""Token ids of whole corpora under a public byte-pair vocabulary.

The rank file is read on the driver (its path is a parameter) and its bytes are broadcast, about a
megabyte; each worker builds the encoder once. Long texts are cut where the splitting pattern never joins
characters: before white space that follows something else, and between a letter and a digit or mark that
follows it (of the scripts listed); so the ids are those of the whole text, in any of these scripts. Decoding
joins the raw bytes of all tokens before it reads them as text.

Defined results: null and empty texts give an empty list; blank texts give the tokens of their
blanks; bytes that are not valid UTF-8 read as U+FFFD.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MULTI_RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to both vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 1 << 16
# Letters and what may follow them, by everyone's tables: a token with letters ends in one, so here a token ends.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u05d0-\u05ea\u0621-\u063a\u0e01-\u0e30\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_MARKS = "0-9.,;:!?()\"\u3001\u3002\uff0c\uff01\uff1f\uff1a\uff1b"
SAFE = rf"(?<=\S)(?=[ \t\r\n])|(?<=[{_LETTERS}])(?=[{_MARKS}])"


class Codec:
    """Encoder and decoder over one rank file and its splitting pattern; `safe` finds places to cut long texts at, None leaves them whole."""

    _built: dict[int, Codec] = {}

    def __init__(self, rank_file: bytes, pattern: str = PATTERN, safe: str | None = SAFE) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.safe = re.compile(safe) if safe else None

    @classmethod
    def shared(cls, rank_file: bytes, pattern: str = PATTERN, safe: str | None = SAFE) -> Codec:
        key = hash((rank_file, pattern, safe))
        if key not in cls._built:
            cls._built.clear()
            cls._built[key] = cls(rank_file, pattern, safe)
        return cls._built[key]

    def encode(self, text: str | None) -> list[int]:
        # encode_to_numpy would spare the lists, but looks for special tokens on its way and takes half as long again.
        if not text:
            return []
        if self.safe is None or len(text) <= CHUNK:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for part in safe_parts(text, self.safe):
            ids += self.encoding.encode_ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode("utf-8", "replace")


def safe_parts(text: str, safe: re.Pattern[str], size: int = CHUNK) -> Iterator[str]:
    """The text in parts of about `size` characters, cut only where no token can reach across."""
    at = 0
    while len(text) - at > size:
        cut = safe.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def read_ranks(path: str = DEFAULT_RANKS) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _texts(column: pa.Array) -> list[str | None]:
    return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def _mapped(df: DataFrame, made: str, kind: str, make) -> DataFrame:  # noqa: ANN001
    kept = [c for c in df.columns if c != made]  # a column of that name is replaced
    schema = df.select(*kept).withColumn(made, F.lit(None).cast(kind)).schema

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], make(b)], names=[*kept, made])

    return df.mapInArrow(convert, schema)


def _encoded(df: DataFrame, text: str, made: str, kind: str, ranks: str, pattern: str, safe: str | None, each) -> DataFrame:  # noqa: ANN001
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    def make(b: pa.RecordBatch) -> pa.Array:
        codec = Codec.shared(shared.value, pattern, safe)
        return each([codec.encode(t) for t in _texts(b.column(b.schema.get_field_index(text)))])

    return _mapped(df, made, kind, make)


def with_ids(df: DataFrame, text: str = "text", ids: str = "ids", ranks: str = DEFAULT_RANKS, pattern: str = PATTERN, safe: str | None = SAFE) -> DataFrame:
    """df with the list of token ids of a text column. Another pattern than the default needs its own `safe`, or None."""
    return _encoded(df, text, ids, "array<int>", ranks, pattern, safe, lambda ids: pa.array(ids, pa.list_(pa.int32())))


def with_token_count(df: DataFrame, text: str = "text", count: str = "n_tokens", ranks: str = DEFAULT_RANKS, pattern: str = PATTERN, safe: str | None = SAFE) -> DataFrame:
    """df with the number of tokens of a text column; the lists never leave the worker."""
    return _encoded(df, text, count, "bigint", ranks, pattern, safe, lambda ids: pa.array(np.fromiter(map(len, ids), np.int64, len(ids))))


def with_text(df: DataFrame, ids: str = "ids", text: str = "text", ranks: str = DEFAULT_RANKS, pattern: str = PATTERN) -> DataFrame:
    """df with the text that a list of ids stands for; a null list gives an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    def make(b: pa.RecordBatch) -> pa.Array:
        codec = Codec.shared(shared.value, pattern)
        return pa.array([codec.decode(x or []) for x in b.column(b.schema.get_field_index(ids)).to_pylist()], pa.string())

    return _mapped(df, text, "string", make)
