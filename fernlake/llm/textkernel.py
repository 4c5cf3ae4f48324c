"""Vectorised words and shingles over Arrow string columns.

Texts are read as UTF-8 bytes.  A word is a run of bytes other than 0x20 and 0x09-0x0D; since
every byte of a multi-byte character is 0x80 or more, these are also runs of characters.  A-Z
are lower-cased.  Each word gets a 64-bit hash, computed for all words of a batch at once, in
blocks of a fixed number of bytes so that memory stays flat for texts of any length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 17
_POW = np.cumprod(np.full(_BLOCK, U(_BASE), U))
_INV = np.cumprod(np.full(_BLOCK, U(pow(_BASE, -1, 1 << 64)), U))
_STEP = (U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))


def bound_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bound the rows and bytes of an Arrow batch in this session, where its limits are wider.

    Texts are long, and a task holds a batch on both sides of its pipe.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of a batch: hash, first byte and end byte each; at[i]:at[i+1] are those of text i."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    data: np.ndarray


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its texts; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def words(col: pa.Array, separators: np.ndarray | None = None) -> Words:
    """Words of each text; `separators` marks the bytes between words, if these are not blanks."""
    raw, off = bytes_of(col)
    low = raw + (((raw - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))
    gap = (raw == 32) | ((raw - np.uint8(9)) < 5) if separators is None else separators[raw]
    word = ~gap
    begins = word.copy()
    begins[1:] &= gap[:-1]
    ends = word.copy()
    ends[:-1] &= gap[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    begins[edge] |= word[edge]
    ends[edge - 1] |= word[edge - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return Words(_hashes(low, start, end), start, end, np.searchsorted(start, off), low)


def _hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        base = start[i]
        j = int(np.searchsorted(end, base + _BLOCK, side="right"))
        if j <= i:
            out[i] = _long_word(low[base : end[i]])
            i += 1
            continue
        piece = low[base : end[j - 1]]
        value = (piece.astype(U) + U(1)) * _POW[: len(piece)]
        total = np.zeros(len(piece) + 1, U)
        np.cumsum(value, out=total[1:])
        at = start[i:j] - base
        out[i:j] = (total[end[i:j] - base] - total[at]) * _INV[at] + (end[i:j] - start[i:j]).astype(U)
        i = j
    return mix(out)


def _long_word(piece: np.ndarray) -> np.uint64:
    """The same hash for one word beyond a block, folded block by block."""
    total, power = 0, 1
    mask = (1 << 64) - 1
    for k in range(0, len(piece), _BLOCK):
        part = piece[k : k + _BLOCK]
        total = (total + int(((part.astype(U) + U(1)) * _POW[: len(part)]).sum()) * power) & mask
        power = power * pow(_BASE, len(part), 1 << 64) & mask
    return U((total + len(piece)) & mask)


def shingle_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, and offsets by text.

    A text with fewer words, but at least one, has its whole sequence as its one shingle.
    """
    n = len(w.hash)
    count = np.diff(w.at)
    if not n:
        return np.zeros(0, U), np.zeros(len(w.at), np.int64)
    runs = np.zeros(max(0, n - size + 1), U)
    for k in range(size):
        runs += w.hash[k : k + len(runs)] * _STEP[k]
    runs = mix(runs)
    full = np.where(count >= size, count - size + 1, 0)
    short = (count > 0) & (count < size)
    out_n = full + short
    at = np.zeros(len(w.at), np.int64)
    np.cumsum(out_n, out=at[1:])
    out = np.empty(at[-1], U)
    # position of every full run: the k-th of text i starts at word w.at[i] + k
    owner = np.repeat(np.arange(len(count)), full)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
    out[at[owner] + inside] = runs[w.at[owner] + inside]
    for i in np.flatnonzero(short):
        h = w.hash[w.at[i] : w.at[i + 1]]
        out[at[i]] = mix((h * np.array(_STEP[: len(h)], U)).sum(keepdims=True) + U(len(h)))[0]
    return out, at


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 21):
    """Slices of a batch with about `most` bytes of text each; a longer text is a slice of its own."""
    col = batch.column(batch.schema.get_field_index(column))
    if not batch.num_rows:
        return
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
