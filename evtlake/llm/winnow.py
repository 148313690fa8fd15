"""Document fingerprints by winnowing: rolling hashes of k-grams of code points, the minimum of each window of w of them
chosen, the rightmost of equal ones, with its place.

Two texts that share a run of at least w + k - 1 code points share a chosen hash. Defined results: a null text counts as
empty and has no hashes; a text shorter than k has one hash, of the whole text, at 0; one with fewer than w k-grams has
the minimum of them all. Equal texts have equal fingerprints; repeated rows and null or repeated doc_ids are rows of their
own; an empty table gives no rows. A very long text is handled alone, with about 40 bytes a code point in its task. Of
further columns `fingerprints` keeps all (but the text and those named hashes and places), `edited_fingerprints` none.
Hashes keep 32 bits: two of them are equal by chance once in four billion pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded, lean
from .textarrays import span_hashes, window_hashes

GRAM, WINDOW = 32, 64
#: k and w of the query over all documents: texts that share 19 code points share a hash.
DENSE = 10, 10
LOW = np.uint64(0xFFFFFFFF)


def winnow(text: str, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hashes, their places) in the order of the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    hashes = window_hashes(codes, k) if n >= k else span_hashes(codes, np.array([0]), np.array([n]))
    # The hash above, the distance from the end below: the smallest value is the smallest hash, rightmost of equal ones.
    keys = (hashes & ~LOW) | (LOW - np.arange(len(hashes), dtype=np.uint64))
    w, width = min(w, len(keys)), 1
    while width < w:
        step = min(width, w - width)
        keys = np.minimum(keys[: len(keys) - step], keys[step:])
        width += step
    chosen = keys[np.append(True, keys[1:] != keys[:-1])]
    return (chosen >> np.uint64(32)).astype(np.uint32), (LOW - (chosen & LOW)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared distinct hashes by all distinct hashes; 1 for two empty texts."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def text_of(hashes: np.ndarray) -> str:
    """Eight hexadecimal digits for each hash."""
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, column: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """docs without the text, plus hashes array<bigint> and places array<bigint>."""
    kept = [f for f in docs.schema.fields if f.name not in (column, "hashes", "places")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["hashes array<bigint>", "places array<bigint>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(t or "", k, w) for t in batch.column(batch.num_columns - 1).to_pylist()]
            arrays = [*batch.columns[:-1], pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(f.name for f in kept), "hashes", "places"])

    return bounded(docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{column}`").cast("string").alias(column))).mapInArrow(lean(run), schema)


EDITED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_hashes bigint, places array<int>, edited_places array<int>"
#: Characters of text in a batch of results.
BATCH_CHARS = 2_000_000


def range_bounds(rows: DataFrame, n: int) -> list[tuple[int | None, int]]:
    """Upper ends, but for the last, of about n ranges of (doc_id, hash of text) with equally many rows, nulls first. A doc_id,
    or null, with more rows than a range is cut by the hash, whose values are spread evenly."""
    if n < 2:
        return []
    found = rows.agg(F.count(F.lit(1)).alias("all"), F.count("doc_id").alias("some"), F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20_000).alias("b")).first()
    top = 2**63 - 1
    cuts = lambda d, m: [(d, -(2**63) + (2**64 * j) // m) for j in range(1, m)]
    nulls = found["all"] - found["some"]
    out: list[tuple[int | None, int]] = [*cuts(None, max(1, -(-nulls * n // max(found["all"], 1)))), (None, top)] if nulls else []
    often: dict[int, int] = {}
    for d in found["b"] or []:
        often[d] = often.get(d, 0) + 1
    for d in sorted(often):
        out += [*cuts(d, often[d] + 1 if often[d] > 1 else 1), (d, top)]
    return out


def edited_fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """For each document its fingerprint and that of its text with the last half replaced by the start of the next one,
    with the places of the chosen hashes.

    The next document by ascending doc_id, nulls first, equal doc_ids by the hash of their texts; after the last comes the
    first. Documents go to ranges of doc_id and hash once, in order; the first document of each range is also sent to the
    range before, so no task sees more than its range. Only rows equal in both stay in one range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct(F.col("doc_id").alias("d"), F.col("h").alias("h"))
    bounds = F.array(*(F.struct(F.lit(d).cast("bigint").alias("d"), F.lit(h).cast("bigint").alias("h")) for d, h in range_bounds(rows, n)))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.withColumn("bucket", F.size(F.filter(bounds, lambda x: x < place)).cast("int") if n > 1 else F.lit(0))
    firsts = [(b, *first) for b, first in rows.groupBy("bucket").agg(F.min(place)).orderBy("bucket").collect()]  # as many as ranges
    ghosts = spark.createDataFrame([(d, h, firsts[i - 1][0]) for i, (_, d, h) in enumerate(firsts)], "first bigint, first_h bigint, to_bucket int")
    own = F.struct(F.col("bucket").alias("at"), F.lit(False).alias("ghost"))
    copy = F.struct(F.col("to_bucket").alias("at"), F.lit(True).alias("ghost"))
    dealt = (
        rows.join(F.broadcast(ghosts), F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("h") == F.col("first_h")), "left")
        .select("doc_id", "text", "h", F.explode(F.when(F.col("to_bucket").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("x"))
        .select("doc_id", "text", "x.at", "x.ghost", "h")
        .repartitionById(n, F.pmod(F.col("at"), F.lit(n)).cast("int"))
        .sortWithinPartitions("at", "ghost", F.asc_nulls_first("doc_id"), "h")
        .drop("h")
    )
    names = [x.split()[0] for x in EDITED.split(", ")]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<int>": pa.list_(pa.int32())}
        types = [types[x.split()[1]] for x in EDITED.split(", ")]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        out: list[tuple] = []
        size = 0
        last: tuple | None = None  # (bucket, doc_id, text, its hashes and places), waiting for the next one
        for doc_id, text, at, ghost in rows_of(batches):
            if last and last[0] != at:
                last = None
            if ghost and not last:
                continue
            hashes, places = winnow(text, k, w)
            if last:
                _, own_id, own_text, own_hashes, own_places = last
                half = len(own_text) // 2
                edited = own_text[: len(own_text) - half] + text[:half]
                other, other_places = winnow(edited, k, w)
                out.append(
                    (
                        own_id, len(own_text), hashlib.sha256(edited.encode()).hexdigest(), text_of(own_hashes), text_of(other), likeness(own_hashes, other), likeness(own_hashes, hashes), len(own_hashes),
                        own_places.astype(np.int32), other_places.astype(np.int32),
                    )
                )
                size += len(own_text)
            last = None if ghost else (at, doc_id, text, hashes, places)
            if len(out) >= 500 or size > BATCH_CHARS:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    return bounded(dealt).mapInArrow(lean(run), EDITED)
