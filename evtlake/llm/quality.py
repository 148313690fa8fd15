"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated scores.

Each word class (its hash, to `BUCKETS`) has a sparse random index vector; its context vector is the sum of the index
vectors of its neighbours over all documents. A document's features are the mean of its words' context directions, and
how often a word follows itself. The network is fitted on a bounded sample of labelled rows (`MAX_ROWS`), those with the
smallest hashes of doc_id; a temperature for its logits is then fitted on rows of the sample that it was not trained on.

Words are runs of letters, of digits and of other signs, case kept; a word equal to the one before is the word "again".
Labels, lang, source and doc_id are no inputs of a score. Rows whose crc32(doc_id as text) modulo 5 is 0 are held out.

Defined results: a null text is empty; empty texts have the features 0 and a score like any other; rows with a null
doc_id are held out; null labels are ignored; of several labels of a doc_id the highest is taken; without two labels the
score is the share of label 1, or 0.5 without any. Rows with one doc_id are scored each on their own and count as one in the
sample, by the least of their features; equal texts have equal scores. A very long text is one row like any other, read
whole, alone in its slice. An empty table gives no rows. Columns named held_out, score or predicted are replaced, others kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded, lean
from .textarrays import mix, slices, text_bytes, text_column, word_bounds, word_hashes

BUCKETS, DIMS, NONZERO, REACH = 1 << 15, 32, 4, 2
MAX_ROWS, HIDDEN, EPOCHS, THRESHOLD = 20_000, 32, 60, 0.3
BLOCKS = 64
#: Bytes of text handled at once: each word has a vector while they are added.
SLICE = 1 << 19
AGAIN = 0
#: Byte classes: 0 white space, 1 letters and bytes beyond ASCII, 2 digits, 3 other signs.
KINDS = np.full(256, 3, np.uint8)
KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KINDS[48:58] = 2
KINDS[[9, 10, 11, 12, 13, 32]] = 0


def bucketed_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words of a slice, and the number of each text's first word (one more at the end)."""
    raw, offsets = text_bytes(text_column(batch, "text"))
    kind = KINDS[raw]
    bounds = [word_bounds(kind, offsets, np.arange(256) == k)[:2] for k in (1, 2, 3)]
    starts, ends = (np.concatenate([b[i] for b in bounds]) for i in (0, 1))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    first = np.searchsorted(starts, offsets)
    hashes = word_hashes(raw, starts, ends)
    bucket = (hashes % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    if len(hashes) > 1:
        same = hashes[1:] == hashes[:-1]
        same[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(hashes))] - 1] = False
        bucket[1:][same] = AGAIN
    return bucket, first


@lru_cache(maxsize=1)
def index_vectors() -> np.ndarray:
    """NONZERO entries of 1 or -1 for each bucket, from its number."""
    out = np.zeros((BUCKETS, DIMS), np.float32)
    number = np.arange(BUCKETS, dtype=np.uint64)
    for i in range(NONZERO):
        r = mix(number * np.uint64(NONZERO) + np.uint64(i + 1))
        out[np.arange(BUCKETS), (r % np.uint64(DIMS)).astype(int)] += np.where(r >> np.uint64(40) & np.uint64(1), 1, -1)
    return out


def _add_contexts(table: np.ndarray, bucket: np.ndarray, first: np.ndarray) -> None:
    """Adds the index vectors of the neighbours of each word."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    vectors = index_vectors()
    near = np.zeros((len(bucket), DIMS), np.float32)
    for d in range(1, REACH + 1):
        same = (text[d:] == text[:-d])[:, None]
        near[d:] += vectors[bucket[:-d]] * same
        near[:-d] += vectors[bucket[d:]] * same
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])) if len(bucket) else []
    if len(starts):
        table[bucket[order][starts]] += np.add.reduceat(near[order], starts, axis=0, dtype=np.float64).astype(np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The context directions over all documents: a table of fixed size (BUCKETS x DIMS). Sums are whole numbers, so they do
    not depend on how the documents are split over tasks."""
    rows = BUCKETS // BLOCKS
    schema = "block int, sums binary"

    def emit(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts = [(b, table[b * rows : (b + 1) * rows].tobytes()) for b in range(BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.zeros((BUCKETS, DIMS), np.int64), False
        for batch in slices(batches, "text", SLICE):
            _add_contexts(table, *bucketed_words(batch))
            seen = True
        if seen:
            yield from emit(table)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(blob, np.int64)
        for block, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "sums"])

    partial = bounded(docs.select(F.col("text").cast("string").alias("text"))).mapInArrow(lean(add), schema)
    table = np.zeros((BUCKETS, DIMS), np.float64)
    for r in partial.repartition(BLOCKS // 4, "block").mapInArrow(lean(merge), schema).collect():  # BLOCKS rows, 8 MB in all
        table[r["block"] * rows : (r["block"] + 1) * rows] = np.frombuffer(r["sums"], np.int64).reshape(rows, DIMS)
    size = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.maximum(size, 1e-9)).astype(np.float32)


def pooled(batch: pa.RecordBatch, vectors: np.ndarray) -> np.ndarray:
    """One row of features for each text."""
    bucket, first = bucketed_words(batch)
    counts = np.diff(first)
    out = np.zeros((batch.num_rows, DIMS + 2), np.float32)
    some = np.flatnonzero(counts)
    if len(some):
        out[some, :DIMS] = np.add.reduceat(vectors[bucket], first[:-1][some], axis=0) / counts[some, None]
        out[some, DIMS] = np.add.reduceat((bucket == AGAIN).astype(np.float32), first[:-1][some]) / counts[some]
        out[some, DIMS + 1] = 1
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Two layers by Adam on four fifths of the rows; the temperature on the rest."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    share = float(y.mean()) if len(y) else 0.5
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(DIMS + 2), np.ones(DIMS + 2))
    prior = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    rng = np.random.default_rng(seed)
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1] if x.ndim == 2 else DIMS), (DIMS + 2, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), prior)
    if not len(y) or not 0 < share < 1:
        return net
    held = np.arange(len(y)) % 5 == 4
    a, b = (x[~held] - mean) / scale, y[~held]
    params = [net.w1, net.b1, rng.normal(0, 0.1, HIDDEN), np.array(prior)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(b))
        for at in range(0, len(b), 256):
            rows = order[at : at + 256]
            hidden = np.tanh(a[rows] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -50, 50))) - b[rows]) / len(rows)
            back = error[:, None] * params[2] * (1 - hidden**2)
            grads = [a[rows].T @ back + 1e-4 * params[0], back.sum(0), hidden.T @ error + 1e-4 * params[2], error.sum()]
            step += 1
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                params[i] = params[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, params[0], params[1], params[2], float(params[3]))
    if held.any():
        logits, target = net.logits(x[held]), y[held]
        losses = {t: float(np.mean(np.logaddexp(0, logits / t) - target * logits / t)) for t in np.geomspace(0.5, 8, 60)}
        net.temperature = min(losses, key=losses.get)
    return net


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, max_rows: int = MAX_ROWS, keep_text: bool = True) -> DataFrame:
    """docs (with or without the text) with held_out, score and predicted; labels: doc_id and a column of 0 and 1."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(word_vectors(docs))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(True))
    known = labels.where(F.col(label).isin(0, 1) & ~held).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    # A bounded sample: the smallest hashes of doc_id, at most max_rows.
    sample = known.select("doc_id", "y", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y", "h")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            x = pooled(batch, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2), batch.column(3)], names=["id", "x", "y", "h"])

    # One row for each doc_id, however often it occurs: at most max_rows.
    found = bounded(rows).mapInArrow(lean(features), "id string, x binary, y int, h bigint").groupBy("id", "y", "h").agg(F.min("x").alias("x"))
    found = sorted(found.collect(), key=lambda r: (r["h"], r["id"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in found]) if found else np.zeros((0, DIMS + 2))
    net = spark.sparkContext.broadcast(fit(x, np.array([r["y"] for r in found])))
    fields = [f for f in docs.schema.fields if f.name not in ("held_out", "score", "predicted")]
    kept = [f for f in fields if keep_text or f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["held_out boolean, score double, predicted int"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            s = net.value.scores(pooled(batch, shared.value))
            names = [n for n in batch.schema.names if keep_text or n != "text"]
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return bounded(docs.select(*(F.col(f"`{f.name}`") for f in fields), held.alias("held_out"))).mapInArrow(lean(score), schema)
