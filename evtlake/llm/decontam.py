"""Benchmark decontamination by a distributed positional inverted index.

The index is a table of segments, each a few thousand documents: the sorted terms that occur in them and for each term its
postings (places in the segment), with the documents' bounds. It holds every word of every document, is built once and
serves any number of tests. Queries are windows of test words. For each window the postings of its rarest term (by count
over all segments) are adjusted by the term's offset to candidate starts, and each further term's postings, the next rarest
first, thin them out; with a slop, terms may stand that far from their place (proximity matches). Segments are searched
where they lie; only test windows travel, in blocks of a stated size.

Defined results: words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased; a null text has none; an item with
fewer words than the window is one window, one without words has none; equal windows of several items count for each;
null item_ids are ignored; repeated items count once; repeated documents and those with a null doc_id are rows of their
own; empty tables give no rows or no matches. A very long text is a segment of its own, searched in parts; a task holds
its words' hashes and postings (about 40 bytes a word), not more. Further columns are ignored by `contamination` and kept
by `decontaminated`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded, discard, fresh, lean, written
from .textarrays import LOWER, PLAIN, expand, slices, text_bytes, text_column, word_bounds, word_hashes

WINDOW = 10
#: Test windows that are sent to the tasks at once (at most 120 bytes each); more are taken in further blocks.
BLOCK = 250_000
#: Candidate starts that are thinned out at once.
CANDIDATES = 1 << 20
SEGMENT = "row_ids array<bigint>, doc_ids array<bigint>, doc_ends array<bigint>, terms binary, term_starts binary, postings binary"


def _hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice, and the number of the first word of each text (one more at the end)."""
    raw, offsets = text_bytes(text_column(batch, "text"))
    raw = LOWER[raw]
    starts, ends, first = word_bounds(raw, offsets, PLAIN)
    return word_hashes(raw, starts, ends).view(np.int64), first


def test_windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """item_id and words binary (64-bit hashes) of every window of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, first = _hashed(batch)
            ids, words = [], []
            for row, item in enumerate(batch.column(0).to_pylist()):
                own = hashes[first[row] : first[row + 1]]
                for at in range(max(1, len(own) - length + 1) if len(own) else 0):
                    ids.append(item)
                    words.append(own[at : at + length].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(words, pa.binary())], names=["item_id", "words"])

    rows = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return bounded(rows).mapInArrow(lean(run), "item_id string, words binary").distinct()


@dataclass
class Queries:
    """A block of distinct windows: rows of term numbers (-1 beyond a shorter one), and the items of each."""

    terms: np.ndarray  # sorted hashes of all terms
    windows: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]
    rarity: np.ndarray | None = None  # for each window its offsets, the rarest term first

    @staticmethod
    def of(rows: list, length: int) -> Queries:
        by_words: dict[bytes, list[str]] = {}
        for r in rows:
            by_words.setdefault(bytes(r["words"]), []).append(r["item_id"])
        parts = [np.frombuffer(w, np.int64) for w in by_words]
        terms = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        windows = np.full((len(parts), length), -1, np.int32)
        for row, p in enumerate(parts):
            windows[row, : len(p)] = np.searchsorted(terms, p)
        return Queries(terms, windows, np.array([len(p) for p in parts], np.int64), list(by_words.values()))

    def rank(self, counts: dict[int, int]) -> None:
        often = np.array([counts.get(t, 0) for t in self.terms.tolist()] + [np.iinfo(np.int64).max])
        self.rarity = np.argsort(often[self.windows], axis=1, kind="stable").astype(np.int16)


def build_index(docs: DataFrame, row: str | None = None) -> DataFrame:
    """Segments with the postings of all words of docs (doc_id, text), written to the shared folder. `row` names a column
    with a number for each row; without it rows are numbered here, once, as the index is written."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(number.cast("bigint").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, first = _hashed(batch)
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array([batch.column(c).to_pylist()], pa.list_(pa.int64())) for c in (0, 1)),
                    pa.array([first[1:]], pa.list_(pa.int64())),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (hashes[starts], starts.astype(np.uint32), order.astype(np.uint32))),
                ],
                names=["row_ids", "doc_ids", "doc_ends", "terms", "term_starts", "postings"],
            )

    return written(bounded(rows).mapInArrow(lean(run), SEGMENT), "index")


def _places(blobs: Iterable[bytes], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a segment's terms those wanted: their places in the segment's list, and the number and counts of each."""
    terms, starts = (np.frombuffer(b, t) for b, t in zip(blobs, (np.int64, np.uint32)))
    at = np.searchsorted(terms, wanted)
    at = at[terms[np.minimum(at, len(terms) - 1)] == wanted] if len(terms) else at[:0]
    return terms[at], at, starts.astype(np.int64)


def term_counts(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """How often each of these terms occurs in all documents: as many numbers as a block has terms."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found, at, starts = _places([batch.column(c)[i].as_py() for c in (0, 1)], shared.value)
                counts = np.diff(starts, append=batch.column(2)[i].as_py())[at]
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], names=["term", "n"])

    sizes = index.select("terms", "term_starts", (F.octet_length("postings") / 4).cast("bigint").alias("n"))
    return {r["term"]: r["n"] for r in bounded(sizes).mapInArrow(lean(run), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def intersect(queries: Queries, terms: np.ndarray, starts: np.ndarray, postings: np.ndarray, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, start) of all matches in a segment, by offset-adjusted intersection from the rarest term on, for some windows
    at a time. terms, starts, postings: those of the segment that the queries hold."""
    n_words = int(postings.max()) + 1 if len(postings) else 0
    ends = np.append(starts[1:], len(postings)).astype(np.int64)
    local = np.full(len(queries.terms) + 1, -1, np.int64)  # the last stands for a place beyond a shorter window
    local[np.searchsorted(queries.terms, terms)] = np.arange(len(terms))
    found = local[queries.windows]
    alive = np.flatnonzero(((found >= 0) | (queries.windows < 0)).all(axis=1))
    if not len(alive):
        return
    stride = n_words + 2 * (slop + queries.windows.shape[1]) + 2
    keys = np.repeat(np.arange(len(terms)), ends - starts) * stride + postings  # sorted: by term, then place
    offset = queries.rarity[alive, 0].astype(np.int64)
    first = found[alive, offset]
    counts = ends[first] - starts[first]
    part = np.cumsum(counts) // CANDIDATES  # a window whose rarest term is frequent is a part of its own
    for own in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(part)) + 1):
        window = np.repeat(alive[own], counts[own])
        at = postings[expand(starts[first[own]], counts[own])].astype(np.int64) - np.repeat(offset[own], counts[own])
        keep = at >= 0
        window, at = window[keep], at[keep]
        for step in range(1, queries.windows.shape[1]):
            more = queries.lengths[window] > step
            place = queries.rarity[window, step].astype(np.int64)
            term = np.where(more, found[window, np.where(more, place, 0)], 0)
            want = term * stride + np.maximum(at + place - slop, 0)
            near = np.searchsorted(keys, want)
            hit = keys[np.minimum(near, len(keys) - 1)]
            keep = ~more | ((near < len(keys)) & (hit >= want) & (hit <= term * stride + at + place + slop))
            window, at = window[keep], at[keep]
        yield window, at


MATCHES = "row bigint, doc_id bigint, n_words bigint, item_ids array<string>, first array<bigint>, last array<bigint>"


def _search(index: DataFrame, queries: Queries, slop: int) -> DataFrame:
    """For each document its words, the items found, and the first and last word of each match."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row_ids, ids, doc_ends = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), np.array(batch.column(2)[i].as_py(), np.int64)
                terms, places, starts = _places([batch.column(c)[i].as_py() for c in (3, 4)], queries.terms)
                postings = np.frombuffer(batch.column(5)[i].as_buffer(), np.uint32)
                counts = np.diff(starts, append=len(postings))[places]
                postings = postings[expand(starts[places], counts)]
                found = list(intersect(queries, terms, np.cumsum(counts) - counts, postings, slop))
                window, at = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
                doc = np.searchsorted(doc_ends, at, side="right")
                begins = np.append(0, doc_ends[:-1])
                last = at + queries.lengths[window] - 1
                inside = last < doc_ends[np.minimum(doc, len(doc_ends) - 1)]
                window, at, last, doc = window[inside], at[inside], last[inside], doc[inside]
                order = np.argsort(doc, kind="stable")
                cuts = np.searchsorted(doc[order], np.arange(len(ids) + 1))
                items, firsts, lasts = [], [], []
                for d in range(len(ids)):
                    own = order[cuts[d] : cuts[d + 1]]
                    items.append(sorted({x for w in np.unique(window[own]) for x in queries.items[w]}))
                    firsts.append(at[own] - begins[d])
                    lasts.append(last[own] - begins[d])
                arrays = [pa.array(row_ids, pa.int64()), pa.array(ids, pa.int64()), pa.array(doc_ends - begins), pa.array(items, pa.list_(pa.string())), pa.array(firsts, pa.list_(pa.int64())), pa.array(lasts, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in MATCHES.split(", ")])

    return bounded(index).mapInArrow(lean(run), MATCHES)


def search(index: DataFrame, items: DataFrame, length: int = WINDOW, slop: int = 0, block: int = BLOCK) -> DataFrame:
    """For each document of the index row, doc_id, n_words, the items found and the places of the matches, those of all
    blocks together."""
    windows = written(test_windows(items, length), "tests")
    blocks = max(1, -(-windows.count() // block))
    out = None
    for b in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).collect()  # at most about `block` windows
        queries = Queries.of(rows, length)
        queries.rank(term_counts(index, queries.terms))
        found = _search(index, queries, slop)
        out = found if out is None else out.unionByName(found)
    discard(windows)
    if blocks > 1:
        keys = out.groupBy("row", "doc_id", "n_words")
        out = keys.agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("item_ids", "first", "last")))
    return out


def matches(docs: DataFrame, items: DataFrame, length: int = WINDOW, slop: int = 0, block: int = BLOCK) -> DataFrame:
    """`search` in an index of docs, by the numbers of its rows."""
    return search(build_index(docs), items, length, slop, block)


def _judged(found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, n_items, digest = [], [], []
            for n, items, first, last in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, first.values.to_numpy(), 1)
                np.add.at(change, last.values.to_numpy() + 1, -1)
                n_hit.append(int((np.cumsum(change) > 0).sum()))
                items = sorted(set(items))
                n_items.append(len(items))
                digest.append(hashlib.sha256(",".join(items).encode()).hexdigest())
            arrays = [*batch.columns[:3], pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest), pa.array([x > 0 for x in n_hit])]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return bounded(found).mapInArrow(lean(run), "row bigint, doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def contamination(docs: DataFrame, items: DataFrame, length: int = WINDOW, slop: int = 0, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit (words inside a match), n_items, items_sha256 and contaminated for every document."""
    return _judged(matches(docs, items, length, slop, block)).drop("row")


def decontaminated(docs: DataFrame, items: DataFrame, length: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """docs without the rows that hold a test window, whatever their doc_id."""
    row = fresh(docs, "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    index = build_index(rows, row)
    bad = written(_judged(search(index, items, length, 0, block)).where("contaminated").select(F.col("row").alias(row)), "contaminated")
    discard(index)
    return rows.join(bad, row, "left_anti").select(*(f"`{c}`" for c in docs.columns))
