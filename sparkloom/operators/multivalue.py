"""Several values packed in one text field, one row per value with its place.

A batch of texts is one array of characters. The parity of the double quotes within a row tells
quoted stretches from the rest, letter and digit masks give the runs outside, and single letters
hung on by slashes are joined to their run. The kept bytes and the lengths give the child
offsets, so the list array is built from buffers and flattened with its parents' ordinals.

Defined results: null, empty and delimiter-only texts give no rows; a last quote without a partner
is a separator; an empty stretch in quotes is no value; repeats are kept; texts may be any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Words that join values and are never values themselves.
JOINERS = ("and", "et")


def _classes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which characters are letters, and which letters or digits."""
    found, back = np.unique(codes, return_inverse=True)
    chars = [chr(c) for c in found]
    alpha = np.array([c.isalpha() for c in chars], bool)
    alnum = np.array([c.isalnum() for c in chars], bool)
    return alpha[back], alnum[back]


def _before(x: np.ndarray, fill: int | bool = 0) -> np.ndarray:
    return np.concatenate([np.array([fill], x.dtype), x[:-1]])


def split_packed(texts: pa.Array) -> pa.ListArray:
    """The values of each text, in order."""
    values = texts.to_pylist()
    lengths = np.array([len(t) if t else 0 for t in values], np.int64)
    n = int(lengths.sum())
    starts = np.concatenate([[0], np.cumsum(lengths)])
    if n == 0:
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(values) + 1, np.int32)), pa.array([], pa.string()))
    codes = np.frombuffer("".join(t for t in values if t).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(values)), lengths)
    alpha, alnum = _classes(codes)

    quote = codes == 34
    seen = np.concatenate([[0], np.cumsum(quote)])
    odd = np.flatnonzero((seen[starts[1:]] - seen[starts[:-1]]) % 2)
    for r in odd:  # the last quote of such a row has no partner
        quote[starts[r] + np.flatnonzero(quote[starts[r] : starts[r + 1]])[-1]] = False
    rank = np.cumsum(quote) - np.concatenate([[0], np.cumsum(quote)])[starts[:-1]][row]
    stretch = quote | (rank % 2 == 1)
    new_row = np.zeros(n, bool)
    new_row[starts[:-1][lengths > 0]] = True

    word = alnum & ~stretch
    edge = lambda mask: mask & (~_before(mask, False) | new_row)
    tail = lambda mask: mask & ~np.concatenate([mask[1:] & ~new_row[1:], [False]])
    word_at, word_end = np.flatnonzero(edge(word)), np.flatnonzero(tail(word)) + 1
    # A one-letter run right after a slash that follows a run belongs to that run.
    hung = np.zeros(len(word_at), bool)
    if len(word_at) > 1:
        hung[1:] = (word_end[1:] - word_at[1:] == 1) & alpha[word_at[1:]] & (word_at[1:] - word_end[:-1] == 1) & (codes[word_end[:-1]] == 47) & (row[word_at[1:]] == row[word_at[:-1]])
    first = np.flatnonzero(~hung)
    last = np.concatenate([first[1:] - 1, [len(word_at) - 1]]) if len(first) else first
    run_at, run_end = word_at[first], word_end[last]

    quoted_at, quoted_end = np.flatnonzero(edge(stretch)), np.flatnonzero(tail(stretch)) + 1
    at = np.concatenate([run_at, quoted_at])
    end = np.concatenate([run_end, quoted_end])
    is_quoted = np.concatenate([np.zeros(len(run_at), bool), np.ones(len(quoted_at), bool)])
    order = np.argsort(at, kind="stable")
    at, end, is_quoted = at[order], end[order], is_quoted[order]

    # Kept characters: whole runs; of a stretch all but its outer quotes and one of each doubled pair.
    delta = np.zeros(n + 1, np.int64)
    delta[at] += 1
    np.add.at(delta, end, -1)
    keep = np.cumsum(delta[:-1]) > 0
    keep[at[is_quoted]] = False
    keep[end[is_quoted] - 1] = False
    keep &= ~(quote & (rank % 2 == 1))
    kept = np.concatenate([[0], np.cumsum(keep)])
    size = kept[end] - kept[at]
    good = size > 0
    short = good & ~is_quoted & (size <= max(map(len, JOINERS)))
    text = "".join(t for t in values if t)
    for k in np.flatnonzero(short):
        if text[at[k] : end[k]].lower() in JOINERS:
            good[k] = False
    drop = np.zeros(n + 1, np.int64)
    drop[at[~good]] += 1
    np.add.at(drop, end[~good], -1)
    keep &= np.cumsum(drop[:-1]) == 0

    byte_count = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    child_bytes = np.concatenate([[0], np.cumsum(np.where(keep, byte_count, 0))])
    child_offsets = np.concatenate([child_bytes[at[good]], child_bytes[-1:]]).astype(np.int64)
    child_data = data[np.repeat(keep, byte_count)]
    child = pa.LargeStringArray.from_buffers(int(good.sum()), pa.py_buffer(child_offsets.tobytes()), pa.py_buffer(child_data.tobytes()))
    per_row = np.bincount(row[at[good]], minlength=len(values))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)), child.cast(pa.string()))


def explode_packed(df: DataFrame, field: str, value: str = "value", pos: str = "pos") -> DataFrame:
    """One row per value of `field`: the other columns, pos from 1 within the row, and the value.

    Other columns already called like the new ones are replaced.
    """
    others = [c for c in df.columns if c not in (field, value, pos)]
    schema = StructType([*[df.schema[c] for c in others], StructField(pos, IntegerType()), StructField(value, StringType())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = split_packed(b.column(b.schema.get_field_index(field)))
            parents = pc.list_parent_indices(lists)
            at = lists.offsets.to_numpy()[:-1][parents.to_numpy()]
            places = pa.array((np.arange(len(parents)) - at + 1).astype(np.int32))
            kept = [b.column(b.schema.get_field_index(c)).take(parents) for c in others]
            yield pa.RecordBatch.from_arrays([*kept, places, lists.flatten()], names=[*others, pos, value])

    return df.mapInArrow(convert, schema)
