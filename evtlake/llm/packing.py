"""Pattern packing by non-negative least squares.

Documents are tokenized and cut into pieces of at most `capacity` tokens. The driver sees only the histogram of piece
lengths (at most `capacity` numbers): it enumerates patterns of one to three lengths (in units) that fill a sequence, fits
how often each is used by non-negative least squares, rounds down, and packs the residual lengths best fit first into
what is left of the open groups. The plan is a table of length ranges whose size depends on the capacity alone; pieces
find their sequence by their rank among those of the same length, numbered in salted groups.

Defined results: a null text is empty and one token (the separator) long; repeated rows, and those with a null or repeated
doc_id, are packed each on their own; pieces of one length are interchangeable, so ties go by the order of a written table; a
very long text is tokenized alone and cut into pieces of `capacity`, the first of which may be shorter; an empty table
gives no pieces; further columns are left out, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import bounded, lean, written
from .textarrays import slices, text_column
from .tokens import SLICE, encoder

CAPACITY, UNITS, GROUP_ROWS = 2048, 256, 50_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """One row for each piece; longer documents are cut so that only the first piece may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            ids, offsets = encoder(vocabulary).encode(text_column(batch, "text"))
            out: list[tuple[int, int, int, int]] = []
            row: list[int] = []
            for i in range(batch.num_rows):
                own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                n = len(own)
                cuts = range(n % capacity - capacity if n % capacity else 0, n, capacity) if n > capacity else [0]
                for k, at in enumerate(cuts):
                    end, at = min(at + capacity, n), max(at, 0)
                    out.append((k, at, end - at, zlib.crc32(own[at:end])))
                    row.append(i)
            columns = [batch.column(0).take(pa.array(row)), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PIECES.split(", ")])
        encoder(vocabulary).rest()

    return bounded(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(lean(run), PIECES)


def patterns(units: int = UNITS) -> np.ndarray:
    """All ways to fill `units` with one to three sizes, as columns of counts by size (row 0 is size 1)."""
    parts = [(units,)] + [(a, units - a) for a in range((units + 1) // 2, units)]
    parts += [(a, b, units - a - b) for a in range(-(-units // 3), units - 1) for b in range(-(-(units - a) // 2), min(a, units - a - 1) + 1)]
    out = np.zeros((units, len(parts)))
    for column, sizes in enumerate(parts):
        for s in sizes:
            out[s - 1, column] += 1
    return out


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that makes |a x - b| smallest, by an active set: the steepest column enters, those that turn negative leave."""
    gram, target = a.T @ a, a.T @ b
    x = np.zeros(a.shape[1])
    active: list[int] = []
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds):
        slope = target - gram[:, active] @ x[active]
        slope[active] = -1
        best = int(slope.argmax())
        if slope[best] <= tolerance:
            break
        active.append(best)
        while True:
            solution = np.linalg.lstsq(gram[np.ix_(active, active)], target[active], rcond=None)[0]
            if (solution > 0).all():
                x[active] = solution
                break
            now = x[active]
            down = solution <= 0
            step = float(np.min(now[down] / np.maximum(now[down] - solution[down], 1e-300)))
            now = now + step * (solution - now)
            x[active] = np.where(now < 1e-12, 0, now)
            gone = [c for c in active if x[c] <= 0]
            x[gone] = 0
            active = [c for c in active if x[c] > 0]
            if not active or best in gone:
                break
        if best not in active:
            break
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY, units: int = UNITS) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset): ranks of a length by range of sequences."""
    units = min(units, capacity)
    unit = capacity / units
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] += count
    size = np.ceil(np.arange(capacity + 1) / unit - 1e-9).astype(int)
    by_unit = np.bincount(size, left, units + 1)[1:]
    # Groups of equal sequences, by free room: [lengths, how many].
    groups: dict[int, list[list]] = defaultdict(list)

    def take_fit(room: int, least: int) -> int:
        """The longest length left that fits, at least `least`; 0 if there is none."""
        found = np.flatnonzero(left[least : room + 1])
        return int(found[-1]) + least if len(found) else 0

    if by_unit.any():
        shapes = patterns(units)
        weight = np.where(np.arange(1, units + 1) * 32 <= units, 0.3, 1.0)
        repeats = np.floor(nonnegative_least_squares(shapes * weight[:, None], by_unit * weight) + 1e-6).astype(np.int64)
        for column in np.argsort(-repeats, kind="stable"):
            count = int(repeats[column])
            if not count:
                break
            sizes = [s + 1 for s in np.flatnonzero(shapes[:, column]) for _ in range(int(shapes[s, column]))][::-1]
            while count > 0:
                # One length for each size but the last: the longest left of that size; the last is the best fit.
                lengths: list[int] = []
                for s in sizes[:-1]:
                    low = int(np.floor((s - 1) * unit)) + 1
                    length = take_fit(int(np.floor(s * unit)), low)
                    lengths.append(length)
                    left[length] -= 1
                room = capacity - sum(lengths)
                last = take_fit(room, max(1, int((sizes[-1] - 1) * unit) + 1)) if all(lengths) or len(sizes) == 1 else 0
                for length in lengths:
                    left[length] += 1
                lengths.append(last)
                if not all(lengths):
                    break
                often = min([count, *(int(left[x]) // lengths.count(x) for x in set(lengths))])
                if not often:
                    break
                for length in lengths:
                    left[length] -= often
                groups[capacity - sum(lengths)].append([lengths, often])
                count -= often
    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            room = next((r for r in range(length, capacity) if groups.get(r)), None)
            if room is None:
                each = capacity // length
                often = count // each or 1
                each = min(each, count)
                groups[capacity - each * length].append([[length] * each, often])
                count -= each * often
                continue
            lengths, often = groups[room].pop()
            each = min(room // length, max(1, count // often))
            used = min(often, count // each)
            groups[room - each * length].append([lengths + [length] * each, used])
            if used < often:
                groups[room].append([lengths, often - used])
            count -= used * each
    rank: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for group in groups.values():
        for lengths, often in group:
            offset = 0
            for length in lengths:
                out.append((length, rank[length], rank[length] + often, sequence, offset))
                rank[length] += often
                offset += length
            sequence += often
    return out


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = docs.sparkSession
    cut = written(pieces(docs, capacity, vocabulary, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    ranges = spark.createDataFrame(plan(histogram, capacity), "length bigint, first bigint, end bigint, at bigint, offset bigint")
    salts = -(-max(histogram.values(), default=1) // GROUP_ROWS)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))
    # The plan's size is bounded by the capacity, not by the data.
    placed = ranked.join(F.broadcast(ranges.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("at") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
