"""SimHash near-dedup by tiled exact comparison: tiles of fingerprints are compared with numpy exclusive-or and bit counts,
and tile pairs whose population counts differ beyond the radius are never formed.

Bits of 64-bit fingerprints: a tile holds fingerprints with the same population counts of their four 16-bit parts; the
sum of the differences of these counts is a lower bound of the distance, so only tiles within the radius meet. For wide
fingerprints (more than 64 bits) with a least similarity, the population is that of shingles: texts of which one has
fewer than `similarity` times the shingles of the other cannot be as similar, and tiles are bands of that ratio.

Equal fingerprints are one node, so copies are never expanded; within a tile pair the matches are joined at once and only
a link to the smallest node of each local group is kept, which loses no connection. Hot tiles are cut by salt.

Wide fingerprints only pick candidates: those of distinct shingles within the radius are verified by the shingle sets
themselves before they are linked. Beside its fingerprint each set has a parity sketch: one bit for each bucket of hashes,
set if an odd number of its hashes falls there. Sketches differ in at most as many bits as sets differ in hashes, so a
pair whose sketches differ in more than the least similarity allows is no candidate, and no link is lost. First each node meets its nearest candidates of each tile and one that all share, then
all candidates that are in different groups still, so that a large group of copies takes few verifications.

Defined results: a null text counts as empty; a text without words has fingerprint 0 and is linked like any other; one
with fewer words than a shingle has the whole sequence as its only shingle; repeated rows are equal nodes; a null doc_id
is linked like any other, and a component whose doc_ids are all null has component_id null; an empty table gives no rows.
A very long text is hashed and folded in parts; its task holds the text, its words' hashes and one part. Further columns
are ignored by `near_duplicates` and kept by `deduplicated`, whatever their names.

Work: 64-bit fingerprints meet few tiles. Wide ones meet all of their size band and the next, so their comparison grows
with the square of a band; it takes two of eight words for most pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import bounded, discard, fresh, lean, written
from .textarrays import mix, slices, text_column

SEED, SHINGLE, RADIUS, PARTS = 42, 3, 3, 4
#: Wide fingerprints of the pipeline: sets of shingles of five words at a similarity of 0.8 differ in about 77 of 512 bits (standard
#: deviation 8), at most 96 (9) for the shortest, four and five shingles. The radius lies over four deviations beyond; it only picks candidates.
WIDE_BITS, WIDE_SHINGLE, WIDE_SIMILARITY, WIDE_RADIUS = 512, 5, 0.8, 136
#: Of wide fingerprints the first words are compared first, within so many bits more than their share of the radius (five
#: standard deviations for the shortest sets at the least similarity).
FIRST_WORDS, FIRST_SLACK = 2, 12
#: Nearest candidates of a node in a tile that are verified first.
NEAREST = 8
#: Fingerprints in a tile, of 64 bits and of more; bytes of the latter with their sketches.
TILE, WIDE_TILE, TILE_BYTES = 4096, 16384, 1 << 22
#: Bytes of sketches compared at once.
SKETCH_BYTES = 1 << 23
#: Bytes of a text whose words are cut at once, and hashes folded at once.
CHUNK, FOLD = 1 << 20, 1 << 16
WHITE = re.compile(rb"[ \t-\r]")


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, part by part."""
    at = 0
    while at < len(data):
        cut = WHITE.search(data, at + CHUNK)
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def shingle_hashes(text: str, n: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of n words, A-Z lower-cased, words cut at ASCII white space."""
    one, parts, carried = xxhash.xxh64_intdigest, [], []
    for words in _words(text.encode("utf-8", "surrogatepass").lower()):
        words = carried + words
        parts.append(np.fromiter((one(g, SEED) for g in map(b" ".join, zip(*(words[i:] for i in range(n))))), np.uint64))
        carried = words[max(0, len(words) - n + 1) :] if n > 1 else []
    found = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(found) and carried:  # fewer words than a shingle
        found = np.array([one(b" ".join(carried), SEED)], np.uint64)
    return found


def _bits(hashes: np.ndarray, word: int) -> np.ndarray:
    """The bits of a fingerprint's word in each hash."""
    values = hashes if not word else mix(hashes + np.uint64(word * 0x9E3779B97F4A7C15 % 2**64))
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fold(hashes: list[np.ndarray], bits: int) -> np.ndarray:
    """Fingerprints (rows of 64-bit words): a bit is set if it is in over half of the text's hashes; 0 without hashes."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros((len(hashes), bits // 64), np.uint64)
    pack = lambda counts, n: np.packbits(2 * counts > n, axis=1, bitorder="little").view(np.uint64)[:, 0]
    for row in np.flatnonzero(sizes > FOLD):
        for word in range(bits // 64):
            counts = sum(_bits(hashes[row][at : at + FOLD], word).sum(axis=0, dtype=np.int64) for at in range(0, sizes[row], FOLD))
            out[row, word] = pack(counts[None, :], sizes[row])[0]
    some = np.flatnonzero((sizes > 0) & (sizes <= FOLD))
    for rows in np.split(some, np.flatnonzero(np.diff(np.cumsum(sizes[some]) // FOLD)) + 1):
        if len(rows):
            flat = np.concatenate([hashes[r] for r in rows])
            starts = np.cumsum(sizes[rows]) - sizes[rows]
            for word in range(bits // 64):
                out[rows, word] = pack(np.add.reduceat(_bits(flat, word), starts, axis=0, dtype=np.int32), sizes[rows, None])
    return out


def sketch_bits(sizes: np.ndarray) -> np.ndarray:
    """Bits of the parity sketches of sets of these sizes: the least power of two of at least twice the size, and 64."""
    return 1 << np.ceil(np.log2(np.maximum(2 * np.asarray(sizes, np.int64), 64))).astype(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """The parity sketch of a set of distinct hashes."""
    bits = int(sketch_bits(len(hashes)))
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def fold_sketches(blob: pa.Buffer, sizes: np.ndarray, bits: int) -> np.ndarray:
    """Sketches of sets of these sizes, one after the other in blob, folded to so many bits: rows of 64-bit words."""
    words, out, at = np.frombuffer(blob, np.uint64), np.zeros((len(sizes), bits // 64), np.uint64), 0
    for row, own in enumerate(sketch_bits(sizes) // 64):
        np.bitwise_xor.reduce(words[at : at + own].reshape(-1, bits // 64), axis=0, out=out[row])
        at += own
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, bits: int = 64) -> DataFrame:
    """doc_id, fp binary (little-endian words), size int (shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes = [shingle_hashes(t, shingle) for t in text_column(batch, "text").to_pylist()]
            fps = fold(hashes, bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.tobytes() for f in fps], pa.binary()), pa.array([len(h) for h in hashes], pa.int32())], names=["doc_id", "fp", "size"])

    return bounded(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(lean(run), "doc_id bigint, fp binary, size int")


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels after joining the groups of a[i] and b[i]; a label is the smallest place of its group."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return labels
        a, b = a[differ], b[differ]
        np.minimum.at(labels, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while not np.array_equal(labels, shorter := labels[labels]):
            labels = shorter


def _alike(sketches: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs have sketches that differ in no more bits than sets of that similarity differ in hashes."""
    step, far = max(1, SKETCH_BYTES // (8 * sketches.shape[1])), np.zeros(len(i), np.int64)
    for at in range(0, len(i), step):
        rows = slice(at, at + step)
        far[rows] = np.bitwise_count(sketches[i[rows]] ^ sketches[j[rows]]).sum(axis=1, dtype=np.int64)
    return far <= (1 - similarity) / (1 + similarity) * (sizes[i].astype(np.int64) + sizes[j]) + 1e-6


def _near_pairs(fps: np.ndarray, sizes: np.ndarray, split: int, radius: int, ratio: float, sketches: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (i, j) of a tile pair within the radius (rows before and from split on; a tile with itself if split is 0) and
    their distances, all of an i at once."""
    left, right = (np.arange(split), np.arange(split, len(fps))) if split else (np.arange(len(fps)), np.arange(len(fps)))
    step = max(1, (1 << 21) // max(1, len(right)))
    words = fps.shape[1]
    dense = min(words, FIRST_WORDS)  # words compared for all pairs; the rest only where still near
    within = radius if words <= dense else min(radius, radius * dense // words + FIRST_SLACK)
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        far = np.bitwise_count(fps[rows, 0][:, None] ^ fps[right, 0][None, :])
        for word in range(1, dense):
            far += np.bitwise_count(fps[rows, word][:, None] ^ fps[right, word][None, :])
        i, j = np.nonzero(far <= within)
        far = far[i, j].astype(np.int64)
        i, j = rows[i], right[j]
        for word in range(dense, words):
            far = far + np.bitwise_count(fps[i, word] ^ fps[j, word])
        keep = (far <= radius) & (i != j)
        if ratio:
            keep &= np.minimum(sizes[i], sizes[j]) >= ratio * np.maximum(sizes[i], sizes[j])
        i, j, far = i[keep], j[keep], far[keep]
        if sketches is not None:
            keep = _alike(sketches, sizes, i, j, ratio)
            i, j, far = i[keep], j[keep], far[keep]
        if len(i):
            yield i, j, far


def tile_links(nodes: np.ndarray, fps: np.ndarray, sizes: np.ndarray, split: int, radius: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a tile pair as (node, smallest node)."""
    labels = np.arange(len(nodes))
    for i, j, _ in _near_pairs(fps, sizes, split, radius, ratio):
        labels = unite(labels, i, j)
    at = np.flatnonzero(labels != np.arange(len(labels)))
    return nodes[at], nodes[labels[at]]


def tile_candidates(nodes: np.ndarray, fps: np.ndarray, sizes: np.ndarray, split: int, radius: int, ratio: float, groups: np.ndarray | None, sketches: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of a tile pair: all whose groups differ, or without groups for each node the nearest and the first one."""
    hub = np.full(len(nodes), len(nodes))
    for i, j, far in _near_pairs(fps, sizes, split, radius, ratio, sketches):
        if groups is None:
            np.minimum.at(hub, i, j)
            np.minimum.at(hub, j, i)
            order = np.lexsort((far, i))
            first = np.flatnonzero(np.append(True, np.diff(i[order]) != 0))
            rank = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
            order = order[rank < NEAREST]
            yield nodes[i[order]], nodes[j[order]]
            continue
        keep = (groups[i] != groups[j]) & ((i < j) | bool(split))
        if keep.any():
            yield nodes[i[keep]], nodes[j[keep]]
    if groups is None:
        at = np.flatnonzero(hub < len(nodes))
        if len(at):
            yield nodes[at], nodes[hub[at]]


def _near_cells(radius: int) -> list[int]:
    """Differences of cell numbers to compare with: those of population counts within the radius, one of each opposite two."""
    steps = [d for d in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius and d >= (0,) * PARTS]
    return [sum(x * 64**i for i, x in enumerate(reversed(d))) for d in steps]


BLOBS = ["nodes", "fps", "sizes", "sketches"]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles with their nodes, fingerprints, sizes and sketches as one value each; of 64-bit fingerprints nothing else is needed."""
    for batch in batches:
        out = []
        for rows in batch.column(2):
            field = {rows.values.type.field(i).name: rows.values.field(i) for i in range(rows.values.type.num_fields)}
            fps = b"".join(field["fp"].to_pylist())
            wide = len(fps) > 8 * len(field["fp"])
            numbers = [field[name].to_numpy().tobytes() for name in ("node", "component") if name in field]
            sketches = b"".join(field["sketch"].to_pylist()) if "sketch" in field else b""
            out.append((b"".join(numbers) if wide else b"", fps, field["size"].to_numpy().tobytes() if wide else b"", sketches))
        columns = [pa.array(c, pa.binary()) for c in zip(*out)] if out else [pa.array([], pa.binary())] * len(BLOBS)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["cell", "salt", *BLOBS])


def _read(blobs: list[pa.Buffer], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fps = np.frombuffer(blobs[1], np.uint64).reshape(-1, words)
    if words == 1:
        return fps[:, 0].byteswap().view(np.int64), fps, np.zeros(len(fps), np.int32)
    return np.frombuffer(blobs[0], np.int64).reshape(-1, len(fps)).T, fps, np.frombuffer(blobs[2], np.int32)


def _sketches(sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]], blobs: list[pa.Buffer]) -> np.ndarray | None:
    """Sketches of a tile or two, all folded to the least number of bits; none where tiles hold none."""
    if not all(map(len, blobs)):
        return None
    bits = int(min(sketch_bits(side[2]).min() for side in sides))
    return np.concatenate([fold_sketches(blob, side[2], bits) for side, blob in zip(sides, blobs)])


def links(nodes: DataFrame, bits: int, radius: int, similarity: float | None = None, candidates: str = "") -> DataFrame:
    """Links (u, v) that connect what is within the radius. nodes: node bigint, fp binary, size int, distinct by node.

    With candidates 'first' or 'all' pairs to be verified instead: a few for each node and tile pair, or all between
    different groups (a further column of nodes, component bigint). A column sketch of nodes rules out pairs that cannot
    be as similar.
    """
    words = bits // 64
    if similarity:
        cell = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / -np.log(similarity) + 1e-9).cast("bigint")
        near, ratio = [0, 1], similarity
    else:
        # Four counts of two bytes each, as digits to base 64.
        digits = [F.bit_count(F.conv(F.hex(F.substring("fp", 2 * i + 1, 2)), 16, 10).cast("int")) for i in range(PARTS)]
        cell = sum((d.cast("bigint") * 64 ** (PARTS - 1 - i) for i, d in enumerate(digits)), F.lit(0).cast("bigint"))
        near, ratio = _near_cells(radius), 0.0
    placed = nodes.withColumn("cell", cell)
    # At most 17**4 cells, or one for each factor of the number of words: a bounded table.
    more = [c for c in ("sketch", "component") if c in nodes.columns]
    bytes_each = F.length("fp") + (F.length("sketch") if "sketch" in more else 0)
    share = F.lit(1 / TILE) if words == 1 else F.greatest(F.lit(1 / WIDE_TILE), bytes_each / TILE_BYTES)
    counts = written(placed.groupBy("cell").agg(F.ceil(F.sum(share)).cast("int").alias("tiles")), "cells")
    salted = placed.join(F.broadcast(counts), "cell").withColumn("salt", F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("int"))
    grouped = salted.groupBy("cell", "salt").agg(F.collect_list(F.struct("node", "fp", "size", *more)).alias("rows"))
    tiles = written(grouped.mapInArrow(lean(_tiles), "cell bigint, salt int, " + ", ".join(f"{b} binary" for b in BLOBS)), "tiles")
    left = tiles.select(F.col("cell").alias("own"), F.col("salt").alias("own_salt"), *(F.col(b).alias(f"own_{b}") for b in BLOBS), F.explode(F.array(*(F.col("cell") + d for d in near))).alias("cell"))
    left = left.join(F.broadcast(counts), "cell").withColumn("salt", F.explode(F.sequence(F.when(F.col("own") == F.col("cell"), F.col("own_salt")).otherwise(0), F.col("tiles") - 1)))
    same = (F.col("own") == F.col("cell")) & (F.col("own_salt") == F.col("salt"))
    pairs = left.join(tiles, ["cell", "salt"]).select(same.alias("same"), *(f"own_{b}" for b in BLOBS), *BLOBS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column(0)[row].as_py()
                own, other = ([batch.column(c)[row].as_buffer() for c in cs] for cs in (range(1, 5), range(5, 9)))
                sides = [_read(x, words) for x in ([own] if same else [own, other])]
                if same and len(sides[0][0]) < 2:
                    continue
                nodes, fps, sizes = (np.concatenate(x) for x in zip(*sides))
                split = 0 if same else len(sides[0][0])
                if candidates:
                    sketches = _sketches(sides, [own[3]] if same else [own[3], other[3]])
                    for u, v in tile_candidates(nodes[:, 0], fps, sizes, split, radius, ratio, nodes[:, 1] if candidates == "all" else None, sketches):
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                    continue
                if nodes.ndim > 1:
                    nodes = nodes[:, 0]
                u, v = tile_links(nodes, fps, sizes, split, radius, ratio)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return bounded(pairs).mapInArrow(lean(run), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = 64, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """doc_id, fp, size and component_id, the smallest doc_id reachable, one row for each document."""
    prints = fingerprints(docs, shingle, bits)
    node = F.conv(F.hex("fp"), 16, -10).cast("bigint") if bits == 64 else F.xxhash64("fp", "size")
    prints = written(prints.withColumn("node", node), "prints")
    nodes = written(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.max("size").alias("size"), F.min("doc_id").alias("rep")), "nodes")
    groups = components(links(nodes, bits, radius, similarity))
    grouped = nodes.select("node", "rep").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = written(grouped.join(least, "component").select("node", "component_id"), "named")
    return prints.join(named, "node").select("doc_id", "fp", "size", "component_id")


def hex_digits(fp: str = "fp") -> Column:
    """A 64-bit fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.concat(*(F.hex(F.substring(fp, 8 - i, 1)) for i in range(8))))


def shingle_sets(rows: DataFrame, shingle: int, bits: int = 0) -> DataFrame:
    """Of the distinct shingles of each text (row bigint, text): row, node (a hash of the set), and fp, size and sketch, or
    without bits the sorted hashes themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in text_column(batch, "text").to_pylist()]
            nodes = pa.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) - (1 << 63) for x in sets], pa.int64())
            if bits:
                more = {"fp": pa.array([f.tobytes() for f in fold(sets, bits)], pa.binary()), "size": pa.array([len(x) for x in sets], pa.int32()), "sketch": pa.array([sketch(x) for x in sets], pa.binary())}
            else:
                more = {"hashes": pa.array([x.tobytes() for x in sets], pa.binary())}
            yield pa.RecordBatch.from_arrays([batch.column(0), nodes, *more.values()], names=["row", "node", *more])

    schema = "row bigint, node bigint, " + ("fp binary, size int, sketch binary" if bits else "hashes binary")
    return bounded(rows.select("row", F.col("text").cast("string").alias("text"))).mapInArrow(lean(run), schema)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (u, v) whose sets (node, hashes) share at least `similarity` of all their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda name: sets.select(F.col("node").alias(name), F.col("hashes").alias(f"{name}_hashes"))
    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    joined = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "u_hashes", "v_hashes")
    return bounded(joined).mapInArrow(lean(run), "u bigint, v bigint")


def deduplicated(docs: DataFrame, shingle: int = WIDE_SHINGLE, bits: int = WIDE_BITS, radius: int = WIDE_RADIUS, similarity: float = WIDE_SIMILARITY) -> DataFrame:
    """docs without near copies: of each group of rows linked by verified similarity the one with the smallest doc_id stays
    (null last, one of several rows of that doc_id)."""
    number = fresh(docs, "row")
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    own = rows.select(F.col(number).alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    prints = written(shingle_sets(own.select("row", "text"), shingle, bits), "prints")
    nodes = written(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.max("size").alias("size"), F.first("sketch").alias("sketch"), F.min("row").alias("row")), "nodes")
    pairs = written(links(nodes, bits, radius, similarity, "first"), "pairs")
    # Every node that has a candidate is in a pair of the first round.
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes.select("node", "row"), "node")
    sets = written(shingle_sets(own.select("row", "text").join(wanted.select("row"), "row"), shingle).select("node", "hashes"), "sets")
    found = written(verified(pairs, sets, similarity), "similar")
    grouped = written(nodes.join(components(found), "node", "left").select("node", "fp", "size", "sketch", F.coalesce("component", "node").alias("component")), "grouped")
    rest = written(links(grouped, bits, radius, similarity, "all"), "pairs")
    found = found.unionByName(written(verified(rest, sets, similarity), "similar"))
    discard(pairs, sets, grouped, rest)
    named = nodes.select("node").join(components(found), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    placed = prints.select("row", "node").join(named, "node").join(own.select("row", "doc_id"), "row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    kept = placed.groupBy("component").agg(F.min(order).alias("least")).select(F.col("least.row").alias(number))
    return rows.join(kept, number, "left_semi").drop(number)
