"""Numpy views of Arrow text columns: word bounds and rolling hashes without Python strings.

Everything here works inside one task on one slice of rows; Spark partitions the work.
Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text is handled alone.
SLICE_BYTES = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as large_string without nulls or an offset."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return pc.fill_null(col, "") if col.null_count else col


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice has at most `most` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(text_column(batch, text)).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(size)
        yield batch.slice(at)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets (one more than texts), from 0."""
    col = col if pa.types.is_large_binary(col.type) else col.cast(pa.large_string())
    col = pc.fill_null(col, "") if col.null_count else col
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_table(outside: str) -> np.ndarray:
    """256 flags: true where the byte is none of these separators. Bytes from 0x80 on are never separators."""
    table = np.ones(256, bool)
    table[[ord(c) for c in outside]] = False
    return table


#: Words of the contracts with [^\x20\x09-\x0D]+ and those with letters, digits and non-ASCII alone.
SPACED = byte_table(" \t\n\v\f\r")
PLAIN = byte_table("".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(raw: np.ndarray) -> np.ndarray:
    """LOWER[raw]."""
    return raw + ((raw - np.uint8(65)) < 26).view(np.uint8) * np.uint8(32)


def inside_of(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[raw], by a comparison for each range of separators."""
    edges = np.flatnonzero(np.diff(table, prepend=True, append=True)).tolist()
    out = np.ones(len(raw), bool)
    for low, end in zip(edges[::2], edges[1::2]):
        out &= raw - np.uint8(low) > np.uint8(end - low - 1)
    return out


def word_bounds(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each text the number of its first word (one more at the end)."""
    inside = inside_of(raw, table)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=2)
def _powers_of(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if n > SLICE_BYTES + 2:  # a text longer than a slice: not kept
        return _powers_of.__wrapped__(n, base)
    return _powers_of(SLICE_BYTES + 2, base)[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair; equal spans have equal hashes, whatever their place."""
    if not len(starts):
        return np.zeros(0, U64)
    n = len(values)
    prefix = np.zeros(n + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * powers(n + 1)[1:], dtype=U64, out=prefix[1:])
    back = powers(n + 1, pow(_BASE, -1, 1 << 64))
    return mix((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


#: By the bytes that are left of a span, up to eight: which bits of eight bytes belong to it.
_MASKS = np.frombuffer(b"".join(b"\xff" * n + bytes(8 - n) for n in range(9)), U64)


def limb_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of raw[start:end] for each pair, which is not empty, from eight bytes at a time; they depend on bytes
    and salt alone. Cheaper than span_hashes where spans are short and do not overlap."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, U64, padded, 0, (1,))
    sizes = ends - starts
    seeds = mix(np.array([2 * salt + 1, 2 * salt + 2], U64) * U64(_BASE))
    limbs = eight[starts] & _MASKS[np.minimum(sizes, 8)]
    out = [mix(limbs + seeds[0]), mix(limbs ^ seeds[1])]
    long = np.flatnonzero(sizes > 8)
    if len(long):
        more = (sizes[long] - 1) // 8
        k = expand(np.ones(len(long), np.int64), more)
        limbs = eight[np.repeat(starts[long], more) + 8 * k] & _MASKS[np.minimum(np.repeat(sizes[long], more) - 8 * k, 8)]
        at, k = np.cumsum(more) - more, k.astype(U64) * U64(0xD6E8FEB86659FD93)
        out[0][long] += np.add.reduceat(mix(limbs + k + seeds[1]), at)
        out[1][long] += np.add.reduceat(mix((limbs ^ k) + seeds[0]), at)
    sizes = sizes.astype(U64)
    return mix(out[0] + sizes), mix(out[1] ^ sizes)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(raw, starts, ends)


def window_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """The hash of values[i:i+n] for every i that has n values."""
    count = len(values) - n + 1
    at = np.arange(max(count, 0))
    return span_hashes(values, at, at + n)


def rightmost_minima(values: np.ndarray, w: int) -> np.ndarray:
    """For each run of w values the place of its smallest, the rightmost of equal ones."""
    n = len(values)
    if n < w:
        return np.zeros(0, np.int64)
    at, width = np.arange(n), 1
    while width < w:
        step = min(width, w - width)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] <= values[left], right, left)
        width += step
    return at


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, .. for lengths[0] values, then the next, and so on."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
