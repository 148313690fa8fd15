"""Substring dedup by level-wise doubling.

Levels are window lengths, each about half of the next and the last the full length (9, 18 and 35 words). Each full window
is stood for by one window of the first level inside it (the one with the smallest hash, rightmost of equal ones), so equal
full windows have equal ones at equal places. Windows that repeat at one level, and only those, are extended to the next:
to the right where that stays inside the full window, else to the left. Neighbouring full windows with the same window are
one run. At the last level runs that repeat as a whole are settled, and the full windows of what is left are taken one by
one, against one copy of every run. Where no candidates survive a level the search ends.

Rows are numbered once, in a written table, so lost executors or other splits change no number. Counts are aggregated
before any shuffle and joined as tables, so that a passage that a third of all documents share is split like any skewed
join. Hashes are 64 bits; full windows are equal if their own hash and that of the window before are.

Defined results: a null text has no words; each row is a document of its own, so repeated rows and null or repeated
doc_ids are too; texts shorter than the window keep every word; an empty table gives no rows. A very long text is handled
alone, with about 100 bytes a word in its task. Further columns stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded, discard, fresh, lean, written
from .textarrays import SPACED, expand, rightmost_minima, slices, span_hashes, text_bytes, text_column, word_bounds, word_hashes

LENGTH = 35
#: The first level has at least so many words.
LEAST = 8
RUNS = "uid bigint, first int, last int, place int, hash bigint, whole bigint"


def levels(length: int, least: int = LEAST) -> list[int]:
    """Window lengths from the first level to the full length."""
    out = [length]
    while (half := -(-out[0] // 2)) >= least and half < out[0]:
        out.insert(0, half)
    return out


def _words(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words) of a slice."""
    raw, offsets = text_bytes(text_column(batch, "text"))
    starts, ends, first = word_bounds(raw, offsets, SPACED)
    hashes = word_hashes(raw, starts, ends)
    for row in range(batch.num_rows):
        yield row, hashes[first[row] : first[row + 1]]


def _emitted(uid: int, hashes: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray, size: int, length: int) -> list[np.ndarray]:
    """Columns of RUNS: the hash of each run's window, and that of the run as a whole with its shape."""
    whole = span_hashes(hashes, first, last + length) ^ (place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [np.full(len(place), uid), first, last, place, span_hashes(hashes, place, place + size).view(np.int64), whole.view(np.int64)]


def _batch(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    names, types = zip(*(x.split() for x in RUNS.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), {"int": pa.int32(), "bigint": pa.int64()}[t]) for c, t in zip(zip(*parts), types)], names=list(names))


def first_runs(docs: DataFrame, size: int, length: int) -> DataFrame:
    """Runs of the first level: neighbouring full windows with the same window of `size` words. docs: uid, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            uids, parts = batch.column(0).to_pylist(), []
            for row, hashes in _words(batch):
                if len(hashes) < length:
                    continue
                at = np.arange(len(hashes) - size + 1)
                chosen = rightmost_minima(span_hashes(hashes, at, at + size), length - size + 1)
                first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
                parts.append(_emitted(uids[row], hashes, first, np.append(first[1:], len(chosen)) - 1, chosen[first], size, length))
            if parts:
                yield _batch(parts)

    return bounded(docs.select("uid", "text")).mapInArrow(lean(run), RUNS)


def extended(docs: DataFrame, runs: DataFrame, size: int, to: int, length: int) -> DataFrame:
    """The same runs with windows of `to` words, of which those of `size` words are the left or the right end."""
    by_doc = runs.groupBy("uid").agg(F.collect_list(F.struct("first", "last", "place")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            uids, spans, parts = batch.column(0).to_pylist(), batch.column(2), []
            for row, hashes in _words(batch):
                first, last, place = (spans[row].values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
                turn = place - (length - to)  # full windows from here on hold the window extended to the right
                right, left = last >= turn, first < turn
                parts.append(
                    _emitted(
                        uids[row], hashes, np.concatenate([np.maximum(first, turn)[right], first[left]]), np.concatenate([last[right], np.minimum(last, turn - 1)[left]]),
                        np.concatenate([place[right], (place + size - to)[left]]), to, length,
                    )
                )
            if parts:
                yield _batch(parts)

    return bounded(docs.select("uid", "text").join(by_doc, "uid").select("uid", "text", "runs")).mapInArrow(lean(run), RUNS)


def _windows(batch: pa.RecordBatch, length: int) -> Iterator[tuple]:
    """The full windows of the runs of each text: uid, at, hash of the run's window, full, often, open."""
    uids, spans = batch.column(0).to_pylist(), batch.column(2)
    for row, hashes in _words(batch):
        first, last, own, often, open_ = (spans[row].values.field(i).to_numpy(zero_copy_only=False) for i in range(5))
        counts = (last - first + 1).astype(np.int64)
        at = expand(first.astype(np.int64), counts)
        full = span_hashes(hashes, at, at + length)
        yield np.full(len(at), uids[row]), at, np.repeat(own, counts), full.view(np.int64), np.repeat(often, counts), np.repeat(open_, counts)


def repeated_windows(docs: DataFrame, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """(uid, first, last): ranges of full windows whose words also start elsewhere. docs: uid, text, read alike each time."""
    sizes = levels(length, least)
    before = written(first_runs(docs, sizes[0], length), "runs")
    for size, to in zip(sizes, [*sizes[1:-1], None]):
        # Windows that repeat at this level, and the runs that they stand for.
        again = written(before.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "again")
        runs = written(before.join(again, "hash"), "runs")
        discard(before, again)
        if to is None or runs.isEmpty():
            break
        before = written(extended(docs, runs, size, to, length), "runs")
        discard(runs)
    # The full length. Runs that repeat as a whole are settled; one copy of each stays to be compared with.
    kinds = written(runs.groupBy("hash", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "first", "last")).alias("one")), "kinds")
    settled = written(runs.join(kinds.where("n > 1").select("hash", "whole"), ["hash", "whole"]).select("uid", "first", "last"), "settled")
    # Windows with a run that is alone and another one.
    unsettled = kinds.groupBy("hash").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1").select("hash")
    rest = kinds.join(unsettled, "hash").select("one.*", "hash", "n")
    by_doc = rest.groupBy("uid").agg(F.collect_list(F.struct("first", "last", "hash", F.least("n", F.lit(2)).cast("int").alias("often"), (F.col("n") == 1).alias("open"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for columns in _windows(batch, length):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["uid", "at", "hash", "full", "often", "open"])

    windows = bounded(docs.select("uid", "text").join(by_doc, "uid").select("uid", "text", "spans")).mapInArrow(lean(run), "uid bigint, at bigint, hash bigint, full bigint, often int, open boolean")
    windows = written(windows, "windows")
    again = windows.groupBy("hash", "full").agg(F.sum("often").alias("n")).where("n > 1").select("hash", "full")
    single = written(windows.where("open").join(again, ["hash", "full"]).select("uid", F.col("at").cast("int").alias("first"), F.col("at").cast("int").alias("last")), "single")
    discard(runs, kinds, windows)
    return settled.unionByName(single)


def _covered(n: int, spans: list | None, length: int) -> np.ndarray:
    """For each word whether a window of the ranges covers it."""
    change = np.zeros(n + 1, np.int64)
    if spans is not None and len(spans):
        first, last = (spans.field(i).to_numpy(zero_copy_only=False) for i in range(2))
        np.add.at(change, first, 1)
        np.add.at(change, np.minimum(last + length, n), -1)
    return np.cumsum(change[:-1]) > 0


def _with_spans(docs: DataFrame, length: int, least: int, uid: str, spans: str) -> DataFrame:
    """docs, numbered, with the ranges of their repeated windows."""
    rows = written(docs.withColumn(uid, F.monotonically_increasing_id()), "rows")
    found = repeated_windows(rows.select(F.col(uid).alias("uid"), F.col("text").cast("string").alias("text")), length, least)
    by_doc = found.groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias(spans)).withColumnRenamed("uid", uid)
    return rows.join(by_doc, uid, "left").drop(uid)


def _kept(batch: pa.RecordBatch, text: str, spans: str, length: int) -> Iterator[tuple[int, int, bytes]]:
    """(words, removed words, kept text) of each row."""
    raw, offsets = text_bytes(text_column(batch, text))
    starts, ends, first = word_bounds(raw, offsets, SPACED)
    data, ranges = raw.tobytes(), batch.column(batch.schema.get_field_index(spans))
    for row in range(batch.num_rows):
        own = slice(first[row], first[row + 1])
        a, b = starts[own], ends[own]
        gone = _covered(len(a), ranges[row].values if ranges[row].is_valid else None, length)
        yield len(a), int(gone.sum()), b" ".join(data[x:y] for x, y in zip(a[~gone].tolist(), b[~gone].tolist()))


def removal_report(docs: DataFrame, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [(n, gone, hashlib.sha256(kept).hexdigest()) for n, gone, kept in _kept(batch, "text", "spans", length)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*rows))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return bounded(_with_spans(docs, length, least, "uid", "spans")).mapInArrow(lean(run), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def deduplicated(docs: DataFrame, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """docs without the repeated words, n_chars with them where there is such a column; texts with none stay as they are,
    those left empty go."""
    names, uid, spans = docs.columns, fresh(docs, "uid"), fresh(docs, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            columns = dict(zip(names, batch.columns))
            old = columns["text"]
            rows = list(_kept(batch, "text", spans, length))
            texts = [old[i].as_py() if not gone else kept.decode() for i, (_, gone, kept) in enumerate(rows)]
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                sizes = [len(t) if gone else n for t, (_, gone, _), n in zip(texts, rows, columns["n_chars"].to_pylist())]
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            stays = pa.array([not gone or bool(kept) for _, gone, kept in rows])
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names).filter(stays)

    return bounded(_with_spans(docs.withColumn("text", F.col("text").cast("string")), length, least, uid, spans)).mapInArrow(lean(run), docs.withColumn("text", F.col("text").cast("string")).schema)
