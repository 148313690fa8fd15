"""Source divergence audit: how far the term frequencies of each (lang, source) are from those of the other sources of its
language, and which terms set it apart.

Counting is by length-bucketed packing. A term of up to 8 bytes is one uint64, one of up to 16 bytes is two (big-endian,
padded with zero bytes, which no term holds, so the order of numbers is that of bytes); they are sorted by radix passes over
16-bit digits and counted by runs, in numpy. Longer terms are in a bucket of their own, sorted as bytes. The first scan
counts documents by (lang, term), the second occurrences by (lang, source, term) of the terms kept; each task adds up its
counts and sends sorted runs, which are merged by ranges of no group (`runs`), so that a source with a third of all rows is
spread by its terms. The second scan drops other terms by a filter of fixed size before they are counted; an exact join
drops the rest.

Distances are sums over blocks of terms: within a block, tiles of at most `TILE` sources are compared as matrices.

Defined results: null text, lang and source are empty; a text without terms, an empty text and a null make their group
exist; a language without kept terms gives value 0 to its pairs and no terms; ties go to the smaller item in UTF-8 order;
repeated rows count as often as they stand; texts and terms of any length are read whole; an empty table gives no rows;
further columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import chunk_batch, chunk_rows, chunk_schema, hash_filter, lines, merged, passes, salted, strings
from .store import bounded, lean, written
from .textarrays import LOWER, U64, byte_table, slices, span_hashes, text_bytes, text_column, word_bounds

TERMS = byte_table("".join(map(chr, [*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])))
#: Parts of a group's terms and of a language's; runs that a task holds before it adds them up, entries before it sends them.
GROUP_PARTS, LANG_PARTS, HELD, MOST = 16, 256, 1 << 20, 1 << 21
#: Sources of a tile and table rows of a block of terms.
TILE, BLOCK = 64, 200_000
SCALE = 1_000_000_000


def packed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int) -> list[np.ndarray]:
    """The bytes of spans of up to 8 * words bytes as `words` uint64 each, most significant first."""
    n, width = len(starts), 8 * words
    at = starts[:, None] + np.arange(width)
    inside = at < ends[:, None]
    grid = np.where(inside, raw[np.minimum(at, max(len(raw) - 1, 0))], 0).astype(np.uint8) if n else np.zeros((0, width), np.uint8)
    return list(grid.view(">u8").astype(U64).T)


def unpacked(words: list[np.ndarray]) -> pa.Array:
    grid = np.column_stack(words).astype(">u8").view(np.uint8).reshape(len(words[0]), -1)
    return strings(grid[grid != 0], (grid != 0).sum(1))


def radix_order(*columns: np.ndarray) -> np.ndarray:
    """The stable order by columns, the most significant first: radix passes over 16-bit digits, constant ones left out."""
    order = None
    for column in reversed(columns):
        column = column.astype(U64, copy=False)
        span = int(np.bitwise_or.reduce(column ^ column[0])) if len(column) else 0
        for shift in range(0, 64, 16):
            if span >> shift & 0xFFFF:
                digits = (column >> U64(shift)).astype(np.uint16)
                order = np.argsort(digits, kind="stable") if order is None else order[np.argsort(digits[order], kind="stable")]
    return np.arange(len(columns[0])) if order is None else order


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted columns change."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def counted(columns: list[np.ndarray], weights: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns in order, with the sums of their weights (None: one each)."""
    order = radix_order(*columns)
    columns = [c[order] for c in columns]
    at = run_starts(*columns)
    sums = np.diff(np.append(at, len(order))) if weights is None else np.add.reduceat(weights[order], at) if len(at) else np.zeros(0, np.int64)
    return [c[at] for c in columns], sums.astype(np.int64)


class Bucket:
    """Counts by (group, term) for terms of one length bucket: runs, added up when they are many."""

    def __init__(self, words: int) -> None:
        self.words, self.runs, self.raw, self.size = words, [], 0, 0

    def add(self, columns: list[np.ndarray], counts: np.ndarray) -> None:
        self.runs.append((columns, counts))
        self.raw += len(counts)
        if self.raw > 2 * self.size + HELD:
            self.total()

    def total(self) -> tuple[list[np.ndarray], np.ndarray]:
        if not self.runs:
            return [np.zeros(0, U64)] * (1 + self.words), np.zeros(0, np.int64)
        if len(self.runs) > 1:
            self.runs = [counted([np.concatenate(c) for c in zip(*(r[0] for r in self.runs))], np.concatenate([r[1] for r in self.runs]))]
        self.raw = self.size = len(self.runs[0][1])
        return self.runs[0]


class Counter:
    """A task's counts, by group and bucket, and the runs that it sends."""

    def __init__(self, parts: int) -> None:
        self.parts, self.groups = parts, {}
        self.clear()

    def clear(self) -> None:
        self.short = [Bucket(1), Bucket(2)]
        self.long: dict[tuple[int, bytes], int] = {}

    def full(self) -> bool:
        return sum(b.raw for b in self.short) + 4 * len(self.long) > MOST

    def number(self, group: tuple) -> int:
        return self.groups.setdefault(group, len(self.groups))

    def chunks(self) -> Iterator[tuple]:
        names = list(self.groups)
        for kind, bucket in enumerate(self.short):
            columns, counts = bucket.total()
            if len(counts):
                terms = columns[1:]
                part = (salted(terms[0], terms[-1]) >> U64(33)) % U64(self.parts)
                order = radix_order(columns[0], part)  # stable: terms stay in order
                group, part, counts = columns[0][order], part[order], counts[order]
                keys = lines(unpacked([t[order] for t in terms]))
                at = run_starts(group, part)
                for first, last in zip(at, np.append(at[1:], len(group))):
                    yield from chunk_rows(names[int(group[first])], int(part[first]) * 3 + kind, keys, counts, first, last)
        by_part: dict[tuple[int, int], list[tuple[bytes, int]]] = {}
        for (group, term), n in self.long.items():
            by_part.setdefault((group, int.from_bytes(term[-4:], "big") % self.parts), []).append((term, n))
        for (group, part), found in by_part.items():
            found.sort()
            yield from chunk_rows(names[group], part * 3 + 2, lines(pa.array([t for t, _ in found], pa.large_binary())), np.array([n for _, n in found]), 0, len(found))
        self.clear()


def text_runs(docs: DataFrame, groups: list[str], parts: int, by_document: bool, keep: np.ndarray | None = None) -> DataFrame:
    """Chunks of (groups, term): documents that hold it, or its occurrences. keep: a filter by (lang, term)."""
    table = docs.sparkSession.sparkContext.broadcast(keep) if keep is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(parts)
        for batch in slices(batches, "text"):
            names = list(zip(*(batch.column(batch.schema.get_field_index(g)).to_pylist() for g in groups)))
            group = np.array([counter.number(n) for n in names], U64)
            raw, offsets = text_bytes(text_column(batch, "text"))
            raw = LOWER[raw]
            starts, ends, first = word_bounds(raw, offsets, TERMS)
            doc = np.repeat(np.arange(len(names), dtype=U64), np.diff(first))
            if table is not None:
                salts = lang_salts([n[0] for n in names])
                good = passes(table.value, salted(span_hashes(raw, starts, ends), salts[doc.astype(np.int64)]))
                starts, ends, doc = starts[good], ends[good], doc[good]
            own, sizes = group[doc.astype(np.int64)], ends - starts
            for kind, (low, high) in enumerate(((0, 8), (8, 16))):
                pick = (sizes > low) & (sizes <= high)
                columns, counts = [own[pick], *packed(raw, starts[pick], ends[pick], kind + 1)], None
                if by_document:
                    columns = counted([*columns, doc[pick]], None)[0][:-1]
                counter.short[kind].add(*counted(columns, counts))
            data, seen = raw.tobytes(), set()
            for g, d, a, b in zip(*(x[sizes > 16].tolist() for x in (own, doc, starts, ends))):
                term = data[a:b]
                if not by_document or (d, term) not in seen:
                    seen.add((d, term))
                    counter.long[int(g), term] = counter.long.get((int(g), term), 0) + 1
            if counter.full():
                yield from sent(counter)
        yield from sent(counter)

    def sent(counter: Counter) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in counter.chunks():
            rows.append(row)
            size += len(row[-1]) + len(row[-2])
            if size > 1 << 22:
                yield chunk_batch(rows, groups)
                rows, size = [], 0
        if rows:
            yield chunk_batch(rows, groups)

    return bounded(docs.select(*groups, "text")).mapInArrow(lean(run), chunk_schema(groups))


def lang_salts(langs: list[str]) -> np.ndarray:
    raw, offsets = text_bytes(pa.array(langs, pa.large_string()))
    return span_hashes(raw, offsets[:-1], offsets[1:])


def term_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """Of the columns lang and term, as the scan hashes them."""
    raw, offsets = text_bytes(batch.column(1))
    return salted(span_hashes(raw, offsets[:-1], offsets[1:]), lang_salts(batch.column(0).to_pylist()))


def rate(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * kept)), exactly."""
    wide = lambda c: c.cast("decimal(28,0)")
    return F.call_function("div", wide(F.lit(SCALE)).cast("decimal(10,0)") * wide(count + 5), wide(total + 5 * kept)).cast("long") + 1


def audited(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part `pair`, the distance to each other source of the language; part
    `term`, the `top` terms whose rate exceeds the language's most. least: documents that a kept term stands in."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    docs = docs.select(empty("lang").alias("lang"), empty("source").alias("source"), empty("text").alias("text"))
    kept = written(merged(text_runs(docs, ["lang"], LANG_PARTS, True), ["lang"], least).select("lang", F.col("key").alias("term")), "terms")
    keep = hash_filter(kept, term_hashes)
    counts = merged(text_runs(docs, ["lang", "source"], GROUP_PARTS, False, keep), ["lang", "source"]).withColumnRenamed("key", "term")
    counts = written(counts.join(kept, ["lang", "term"], "left_semi"), "term-counts")

    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "kept"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    base = F.when(F.col("kept") > 0, rate(F.lit(0), F.col("total"), F.greatest("kept", F.lit(1)))).otherwise(0)
    groups = written(groups.withColumn("base", base).withColumn("number", number.cast("int")).withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang"))), "groups")
    rates = counts.join(groups, ["lang", "source"]).withColumn("p", rate(F.col("n"), F.col("total"), F.col("kept")))
    return _pairs(rates, groups, counts.count()).unionByName(_terms(rates, top)).select("lang", "source", "part", "item", "value", "rank")


def _terms(rates: DataFrame, top: int) -> DataFrame:
    whole = rates.groupBy("lang", "term").agg(F.sum("n").alias("m"))
    both = rates.join(whole, ["lang", "term"]).withColumn("value", F.col("p") - rate(F.col("m"), F.col("lang_total"), F.col("kept"))).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return both.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(rates: DataFrame, groups: DataFrame, n_rows: int) -> DataFrame:
    """Within a block the distance of each pair is taken beyond that of a term that neither has; the rest is that times V."""
    blocks = max(1, -(-n_rows // BLOCK))
    tile = F.floor(F.col("number") / TILE).cast("int")
    tiles = groups.groupBy("lang").agg((F.floor(F.max("number") / TILE) + 1).cast("int").alias("tiles"))
    meets = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("met")
    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")
    rows = rates.select("lang", block.alias("block"), "number", "term", "p")
    marks = groups.where("kept > 0").select("lang", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "number", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"))
    rows = rows.unionByName(marks).join(tiles, "lang").select("*", tile.alias("tile"), meets)
    rows = rows.select("lang", "block", F.least("tile", "met").alias("a"), F.greatest("tile", "met").alias("b"), "number", "term", "p")

    def compare(table: pa.Table) -> pa.Table:
        number, term, p = table.column("number").to_numpy(), table.column("term").combine_chunks(), table.column("p").to_numpy()
        mark = term.is_null().to_numpy(zero_copy_only=False)
        own, place = np.unique(number, return_inverse=True)
        base = np.zeros(len(own), np.int64)
        base[place[mark]] = p[mark]
        codes = term.filter(pa.array(~mark)).dictionary_encode()
        grid = np.repeat(base[None, :], len(codes.dictionary), 0)
        grid[codes.indices.to_numpy(), place[~mark]] = p[~mark]
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        left, right = np.flatnonzero(own // TILE == a), np.flatnonzero(own // TILE == b)
        found = [(own[i], own[right], np.abs(grid[:, [i]] - grid[:, right]).sum(0) - len(grid) * np.abs(base[i] - base[right])) for i in left]
        columns = [np.concatenate([np.full(len(js), i, np.int32) for i, js, _ in found]), np.concatenate([js for _, js, _ in found]), np.concatenate([d for *_, d in found])]
        good = columns[0] < columns[1]
        lang = pa.repeat(table.column("lang")[0], int(good.sum()))
        return pa.table([lang.cast(pa.string()), *(pa.array(c[good], k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64())))], ["lang", "i", "j", "d"])

    part = rows.groupBy("lang", "block", "a", "b").applyInArrow(compare, "lang string, i int, j int, d bigint")
    beyond = part.groupBy("lang", "i", "j").agg(F.sum("d").alias("d"))
    left = groups.select("lang", F.col("source").alias("source"), F.col("number").alias("i"), F.col("base").alias("base_i"), "kept")
    right = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("j"), F.col("base").alias("base_j"))
    ahead = left.join(right, "lang").where("i < j").join(beyond, ["lang", "i", "j"], "left")
    ahead = ahead.withColumn("value", F.coalesce("d", F.lit(0)) + F.col("kept") * F.abs(F.col("base_i") - F.col("base_j")))
    both = ahead.select("lang", "source", "item", "value").unionByName(ahead.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return both.withColumn("rank", rank).withColumn("part", F.lit("pair"))
