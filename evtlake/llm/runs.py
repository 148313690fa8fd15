"""Sorted runs of counted keys: cut to chunks in map tasks, merged in order in the tasks of a partition; and fixed-size
filters of the keys that are frequent enough.

A chunk is one row: group columns, part, low (its first key), keys (ascending bytes, a line feed after each) and one column of
counts. A task that merges gets its chunks by (group, part, low), so keys below the next chunk's low are complete and leave
its memory. Keys hold no line feed. Chunks are cut and read a batch at a time, as those of rare groups are small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded, lean
from .textarrays import U64, mix, text_bytes

#: Keys of a chunk at most, and keys that a merging task holds before it looks for complete ones.
CHUNK, HELD = 1 << 14, 1 << 18
#: Bytes of keys and counts that are sent at once.
SENT = 1 << 22
#: log2 of the bits of a filter: 8 MB, whatever the number of keys. More keys than that make it let more through, no fewer.
FILTER_BITS = 26


def strings(raw: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other in raw."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def lines(keys: pa.Array) -> tuple[bytes, np.ndarray]:
    """All keys, each with a line feed after it, and where they start."""
    ended = pc.binary_join_element_wise(keys.cast(pa.large_binary()), pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    raw, offsets = text_bytes(ended)
    return raw.tobytes(), offsets


def ended(raw: np.ndarray) -> pa.Array:
    """The keys of chunks that lie one after the other in raw, each still with its line feed."""
    return strings(raw, np.diff(np.flatnonzero(raw == 10), prepend=-1))


def chunk_rows(group: tuple, part: int, keys: tuple[bytes, np.ndarray], counts: np.ndarray, first: int, last: int) -> Iterator[tuple]:
    """Rows of the ascending keys first to last (of `lines`), which are of one group and part."""
    raw, offsets = keys
    for at in range(first, last, CHUNK):
        end = min(last, at + CHUNK)
        yield (*group, part, raw[offsets[at] : offsets[at + 1] - 1], raw[offsets[at] : offsets[end]], counts[at:end].astype("<i8").tobytes())


def chunk_schema(groups: list[str]) -> str:
    return ", ".join([*(f"{g} string" for g in groups), "part int", "low binary", "keys binary", "counts binary"])


def chunk_batch(rows: list[tuple], groups: list[str]) -> pa.RecordBatch:
    kinds = [*[pa.string()] * len(groups), pa.int32(), *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*groups, "part", "low", "keys", "counts"])


def chunk_batches(names: list[tuple], groups: list[str], group: np.ndarray, part: np.ndarray, keys: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Chunks of keys (large_binary, each with its line feed) in order of (group, part, key). group: places in names."""
    raw, offsets = text_bytes(keys)
    n = np.arange(len(group))
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (part[1:] != part[:-1])
    at = np.flatnonzero((n - np.maximum.accumulate(np.where(new, n, 0))) % CHUNK == 0)
    ends = np.append(at, len(group))
    low = pc.binary_slice(keys.take(pa.array(at)), 0, -1)
    columns = [pa.array([name[i] for name in names], pa.string()).take(pa.array(group[at])) for i in range(len(groups))]
    columns += [pa.array(part[at].astype(np.int32)), low, pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets[ends]), pa.py_buffer(raw)])]
    columns.append(pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(8 * ends), pa.py_buffer(np.ascontiguousarray(counts, "<i8"))]))
    bytes_at = offsets[ends] + 8 * ends
    first = 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(bytes_at, bytes_at[first] + SENT, "right")) - 1)
        own = [c.slice(first, last - first) for c in columns]
        yield pa.RecordBatch.from_arrays([*own[:-3], *(c.cast(pa.binary()) for c in own[-3:])], [*groups, "part", "low", "keys", "counts"])
        first = last


def merged(chunks: DataFrame, groups: list[str], least: int = 1, totals: bool = False) -> DataFrame:
    """(groups, key, n): the summed counts of at least `least`. totals: also a row with a null key for each group and part,
    whose n is the sum of all its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, size, most, total = None, [], 0, HELD, 0

        def rows(keys: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
            columns = [pa.repeat(pa.scalar(g, pa.string()), len(keys)) for g in current[:-1]]
            keys = pc.binary_slice(keys, 0, -1)
            return pa.RecordBatch.from_arrays([*columns, keys.cast(pa.large_string()).cast(pa.string()), pa.array(counts, pa.int64())], [*groups, "key", "n"])

        def summed() -> tuple[pa.Array, np.ndarray]:
            found = pa.concat_arrays([k for k, _ in held]).dictionary_encode()
            counts = np.zeros(len(found.dictionary), np.int64)
            np.add.at(counts, found.indices.to_numpy(), np.concatenate([c for _, c in held]))
            return found.dictionary, counts

        def complete(low: bytes | None) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, total
            if not held:
                return
            keys, counts = summed()
            # a key with its line feed is below low only if the key is
            done = np.ones(len(keys), bool) if low is None else pc.less(keys, pa.scalar(low, keys.type)).to_numpy(zero_copy_only=False)
            total += int(counts[done].sum())
            good = done & (counts >= least)
            for at in range(0, int(good.sum()), CHUNK):
                pick = np.flatnonzero(good)[at : at + CHUNK]
                yield rows(keys.take(pa.array(pick)), counts[pick])
            held = [(keys.filter(pa.array(~done)), counts[~done])] if not done.all() else []
            size = int((~done).sum())
            if totals and low is None:
                yield rows(pa.nulls(1, pa.large_binary()), np.array([total]))
                total = 0

        for batch in batches:
            *columns, low, keys, counts = (batch.column(i) for i in range(batch.num_columns))
            new = np.zeros(batch.num_rows, bool)
            new[:1] = True
            for c in columns:
                codes = pc.fill_null(c.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            (raw, at), (numbers, places) = text_bytes(keys.cast(pa.large_binary())), text_bytes(counts.cast(pa.large_binary()))
            numbers, places = np.frombuffer(numbers, "<i8"), places // 8
            new[1:] |= places[1:-1] // HELD != places[:-2] // HELD
            at_new = np.flatnonzero(new)
            for first, last in zip(at_new.tolist(), np.append(at_new[1:], batch.num_rows).tolist()):
                key = tuple(c[first].as_py() for c in columns)
                if key != current:
                    yield from complete(None)
                    current, size, most = key, 0, HELD
                elif size > most:
                    yield from complete(low[first].as_py())
                    most = max(HELD, 2 * size)
                held.append((ended(raw[at[first] : at[last]]), numbers[places[first] : places[last]]))
                size += len(held[-1][1])
        yield from complete(None)

    keys = [*groups, "part"]
    ordered = chunks.repartition(*keys).sortWithinPartitions(*keys, "low")
    return bounded(ordered).mapInArrow(lean(run), ", ".join([*(f"{g} string" for g in groups), "key string", "n bigint"]))


def hash_filter(keys: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """A bit for each hash of a key: 2 ** FILTER_BITS bits, put together by Spark, of which the driver gets the words that
    are not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = filter_places(hashes(batch))
            yield pa.RecordBatch.from_arrays([pa.array((at >> U64(6)).astype(np.int32)), pa.array((U64(1) << (at & U64(63))).view(np.int64))], ["word", "bits"])

    words = bounded(keys).mapInArrow(lean(run), "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), U64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(U64)
    return table


def filter_places(hashes: np.ndarray) -> np.ndarray:
    return hashes >> U64(64 - FILTER_BITS)


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = filter_places(hashes)
    return (table[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1


def salted(hashes: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Hashes of keys together with those of their groups."""
    return mix(hashes * U64(0x9E3779B97F4A7C15) + salt)
