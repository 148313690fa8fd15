"""Phrase collocation mining: counts of all phrases of up to `longest` words by language, and the phrases that hold together
better than any of their cuts would suggest.

Phrases are counted length by length in a HAT-trie of each task. Its keys are paths of word ids; its leaves are hash
containers (aggregated by Arrow's hash tables) for a range of ids at one depth. A container that grows beyond `BURST` entries bursts
into two for the halves of its range, or, where a single id is left, into a node one word deeper. When the trie holds
`MOST` entries it spills whole subtrees, the largest first, as sorted runs of `RUN` entries, dealt out by prefix (language and first two words); the
runs of a prefix partition are merged in order (`runs`), so a common word or a large language is spread over partitions.
A language has at most `PARTS` of them, however many partitions Spark is given, so that the pieces of a run stay large.

A phrase can only be frequent if the two phrases one word shorter in it are; a filter of fixed size, built from the phrases
found before, leaves out others while counting. It lets some rare phrases through, never holds back a frequent one; the
counts that are merged are exact.

Defined results: null texts are empty, a null lang is `und`; pieces without words count nothing; repeated rows count as
often as they stand; ties in score go to the larger count, then to the smaller phrase in UTF-8 order; texts, pieces and words of any
length are read whole; an empty table gives no rows; further columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runs import chunk_batches, chunk_schema, hash_filter, merged, passes
from .store import bounded, give_back, lean, written
from .textarrays import SLICE_BYTES, U64, byte_table, inside_of, limb_hashes, lowered, mix, slices, span_hashes, text_bytes, text_column, word_bounds

BREAKS = byte_table(".,;:!?\n\v\f\r")
WORDS = byte_table(" \t.,;:!?\n\v\f\r")
#: Entries of a container before it bursts, rows that wait in one before they are added up, entries of a trie before it spills,
#: and of a run before it is sent.
BURST, WAIT, MOST, RUN = 1 << 15, 1 << 14, 3 << 18, 1 << 18
#: Bytes of text counted at once.
SLICE = SLICE_BYTES
#: Prefix partitions of a language: fewest and most.
PARTS = 256, 1024


class Container:
    """Counts of paths whose word at `depth` is in a range of ids; the path is packed, two ids to a number."""

    def __init__(self, depth: int) -> None:
        self.depth, self.waiting, self.rows = depth, [], 0
        self.table = pa.table({"a": pa.array([], pa.uint64()), "b": pa.array([], pa.uint64()), "n": pa.array([], pa.int64())})

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Container | Node:
        self.waiting.append((a, b, n))
        self.rows += len(a)
        if self.rows > max(WAIT, self.table.num_rows):
            self.settle()
            if self.table.num_rows > BURST:
                return self.burst()
        return self

    def settle(self) -> pa.Table:
        if self.waiting:
            more = pa.table({c: np.concatenate(x) for c, x in zip("abn", zip(*self.waiting))})
            self.table = pa.concat_tables([self.table, more]).combine_chunks().group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])
            self.waiting, self.rows = [], 0
        return self.table

    def size(self) -> int:
        return self.table.num_rows + self.rows

    def burst(self) -> Node:
        a, b = (self.table.column(c).to_numpy() for c in "ab")
        depth, words = self.depth, word_at(a, b, self.depth)
        while words.min() == words.max():
            depth += 1
            words = word_at(a, b, depth)
        middle = np.uint64(np.median(words)) + U64(1)
        if not (words >= middle).any():
            middle = words.max()
        halves = []
        for pick in (words < middle, words >= middle):
            half = Container(depth)
            half.table = self.table.filter(pa.array(pick))
            halves.append(half)
        return Node(depth, np.array([0, middle], U64), halves)

    def tables(self) -> Iterator[pa.Table]:
        yield self.settle()


class Node:
    """Children by ranges of the word id at `depth`."""

    def __init__(self, depth: int, bounds: np.ndarray, children: list[Container | Node]) -> None:
        self.depth, self.bounds, self.children = depth, bounds, children

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Node:
        child = np.searchsorted(self.bounds, word_at(a, b, self.depth), "right") - 1
        order = np.argsort(child.astype(np.uint16), kind="stable")
        ends = np.searchsorted(child[order], np.arange(len(self.children) + 1))
        bounds, children = [], []
        for i, old in enumerate(self.children):
            own = order[ends[i] : ends[i + 1]]
            new = old.add(a[own], b[own], n[own]) if len(own) else old
            if new is not old and isinstance(new, Node) and new.depth == self.depth:  # halves of a range: siblings
                bounds += [self.bounds[i], new.bounds[1]]
                children += new.children
            else:
                bounds.append(self.bounds[i])
                children.append(new)
        self.bounds, self.children = np.array(bounds, U64), children
        return self

    def size(self) -> int:
        return sum(c.size() for c in self.children)

    def tables(self) -> Iterator[pa.Table]:
        for c in self.children:
            yield from c.tables()


def word_at(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    packed = a if depth < 2 else b
    return packed >> U64(32) if depth % 2 == 0 else packed & U64(0xFFFFFFFF)


class Trie:
    """A task's trie and its vocabulary: ids of (lang, word), from 1. Words are told apart by a 64-bit hash; a second one shows
    whether two have the first in common. Then the vocabulary starts anew with another `salt`."""

    def __init__(self, length: int, parts: int) -> None:
        self.length, self.parts, self.salt = length, parts, 0
        self.clear()

    def clear(self) -> None:
        self.root: Container | Node = Container(0)
        self.known, self.known_ids = np.zeros(0, U64), np.zeros(0, np.int64)  # ascending hashes and their ids
        self.checks, self.hashes = np.zeros(1, U64), np.zeros(1, U64)  # by id: second hash, hash for filters and prefixes
        self.words: list[bytes] = []
        self.langs: list[str] = []

    def numbers(self, own: np.ndarray, checks: np.ndarray, spell: Callable[[np.ndarray], tuple[list[str], list[bytes], np.ndarray]]) -> np.ndarray | None:
        """Ids of distinct hashes; None if one of them is another word's. spell: langs, words and lasting hashes of new ones."""
        at = np.searchsorted(self.known, own)
        old = np.zeros(len(own), bool)
        inside = at < len(self.known)
        old[inside] = self.known[at[inside]] == own[inside]
        ids = np.zeros(len(own), np.int64)
        ids[old] = self.known_ids[at[old]]
        if (self.checks[ids[old]] != checks[old]).any():
            return None
        new = np.flatnonzero(~old)
        if len(new):
            langs, words, hashes = spell(new)
            ids[new] = np.arange(len(self.words) + 1, len(self.words) + 1 + len(new))
            self.langs += langs
            self.words += words
            self.checks, self.hashes = np.concatenate([self.checks, checks[new]]), np.concatenate([self.hashes, hashes])
            self.known, self.known_ids = np.insert(self.known, at[new], own[new]), np.insert(self.known_ids, at[new], ids[new])
        return ids

    def add(self, columns: list[np.ndarray], counts: np.ndarray | None = None) -> None:
        """Paths by columns of ids; counts: how often each stands, once if None."""
        counts = np.ones(len(columns[0]), np.int64) if counts is None else counts
        columns = [*(c.astype(U64) for c in columns), *[np.zeros(len(columns[0]), U64)] * (4 - len(columns))]
        self.root = self.root.add(columns[0] << U64(32) | columns[1], columns[2] << U64(32) | columns[3], counts)

    def spill(self, whole: bool) -> Iterator[pa.RecordBatch]:
        """Runs of the largest subtrees, until half of MOST is left, or of all."""
        left = self.root.size()
        if not whole and left <= MOST and len(self.words) <= MOST:
            return
        whole = whole or len(self.words) > MOST
        own: list[pa.Table] = []
        for tree in sorted([self.root] if isinstance(self.root, Container) else self.root.children, key=lambda t: -t.size()):
            if not whole and left <= MOST // 2:
                break
            left -= tree.size()
            own += tree.tables()
            if isinstance(self.root, Node):
                self.root.children[self.root.children.index(tree)] = Container(self.root.depth)
            else:
                self.root = Container(0)
            if sum(t.num_rows for t in own) >= RUN:
                yield from self.run(own)
                own = []
        yield from self.run(own)
        if whole:
            self.clear()
        give_back()

    def run(self, tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        """Chunks of the paths, ordered by language, part and bytes. Words are ranked with the space that follows them, as one
        with a control character comes before its own beginning and a space."""
        if not any(t.num_rows for t in tables):
            return
        a, b, n = (np.concatenate([t.column(c).to_numpy() for t in tables]) for c in "abn")
        path = [word_at(a, b, d).astype(np.int64) for d in range(self.length)]
        prefix = self.hashes[path[0]] if self.length == 1 else mix(self.hashes[path[0]] + mix(self.hashes[path[1]]))
        part = ((prefix >> U64(20)) % U64(self.parts)).astype(np.int64)
        used = np.zeros(len(self.words) + 1, bool)
        for p in path:
            used[p] = True
        used = np.flatnonzero(used)
        words = pa.array([self.words[i - 1] for i in used.tolist()], pa.large_binary())
        langs = pa.array([self.langs[i - 1] for i in used.tolist()], pa.string()).dictionary_encode()
        place = np.zeros(len(self.words) + 1, np.int64)
        place[used] = np.arange(len(used))
        group = langs.indices.to_numpy()[place[path[0]]].astype(np.int64)
        ranks, spelled = [], []
        for d, p in enumerate(path):
            if d in (0, self.length - 1):
                end = pa.scalar(b"\n" if d == self.length - 1 else b" ", pa.large_binary())
                closed = pc.binary_join_element_wise(words, end, pa.scalar(b"", pa.large_binary()))
                order = pc.sort_indices(words if d == self.length - 1 else closed)
                closed, rank = closed.take(order), np.empty(len(used), np.int64)
                rank[order.to_numpy()] = np.arange(len(used))
            ranks.append(rank[place[p]])
            spelled.append(closed)
        order = order_of([group * self.parts + part, *ranks], [len(langs.dictionary) * self.parts, *[len(used)] * self.length])
        keys = [w.take(pa.array(r[order])) for w, r in zip(spelled, ranks)]
        keys = pc.binary_join_element_wise(*keys, pa.scalar(b"", pa.large_binary())) if self.length > 1 else keys[0]
        yield from chunk_batches([(x,) for x in langs.dictionary.to_pylist()], ["lang"], group[order], part[order], keys, n[order])


def order_of(columns: list[np.ndarray], ends: list[int]) -> np.ndarray:
    """The order by columns, the most significant first, of numbers from 0 below their ends; as many columns as fit are sorted
    as one."""
    packed, room = [], 0
    for column, end in zip(columns, ends):
        bits = max(1, int(end - 1).bit_length())
        if bits <= room:
            packed[-1], room = packed[-1] << bits | column, room - bits
        else:
            packed, room = [*packed, column], 63 - bits
    return np.argsort(packed[0]) if len(packed) == 1 else np.lexsort(packed[::-1])


def lang_hashes(langs: list[str]) -> np.ndarray:
    raw, offsets = text_bytes(pa.array(langs, pa.large_string()))
    return span_hashes(raw, offsets[:-1], offsets[1:])


def gram_hashes(words: list[np.ndarray]) -> np.ndarray:
    """Of paths of word hashes."""
    out = words[0]
    for w in words[1:]:
        out = mix(out * U64(0x9E3779B97F4A7C15) + w)
    return out


def phrase_hashes(length: int):
    """For hash_filter: hashes of the columns lang and key, as the scan hashes paths of this length."""

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        raw, offsets = text_bytes(batch.column(1))
        starts, ends, first = word_bounds(raw, offsets, SPACES)
        langs = batch.column(0).dictionary_encode()
        own = mix(limb_hashes(raw, starts, ends)[0] + np.repeat(lang_hashes(langs.dictionary.to_pylist())[langs.indices.to_numpy()], np.diff(first)))
        return gram_hashes([own[i::length] for i in range(length)])

    return hashes


SPACES = byte_table(" ")


def phrase_runs(docs: DataFrame, length: int, parts: int, keep: np.ndarray | None) -> DataFrame:
    """Chunks of (lang, phrase) counts of one length. keep: a filter of the phrases one word shorter."""
    table = docs.sparkSession.sparkContext.broadcast(keep) if keep is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(length, parts)
        for batch in slices(batches, "text", SLICE):
            while (found := words_of(batch, trie)) is None:
                yield from trie.spill(True)
                trie.salt += 1
            ids, joins = found
            n = len(ids) - length + 1
            if n > 0 and length == 1:
                counts = np.bincount(ids)
                at = np.flatnonzero(counts)
                trie.add([at], counts[at])
            elif n > 0:
                good = np.ones(n, bool)
                for i in range(length - 1):
                    good &= joins[i : i + n]
                if table is not None:
                    hashes = trie.hashes[ids]
                    hit = passes(table.value, gram_hashes([hashes[i : len(ids) - length + 2 + i] for i in range(length - 1)]))
                    good &= hit[:-1] & hit[1:]
                at = np.flatnonzero(good)
                if len(at):
                    trie.add([ids[at + i] for i in range(length)])
            yield from trie.spill(False)
        yield from trie.spill(True)

    return bounded(docs.select("lang", "text")).mapInArrow(lean(run), chunk_schema(["lang"]))


def words_of(batch: pa.RecordBatch, trie: Trie) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids of all words of a slice in order, and whether each is followed by another of its piece; None if two words have one
    hash."""
    raw, offsets = text_bytes(text_column(batch, "text"))
    raw = lowered(raw)
    starts, ends, first = word_bounds(raw, offsets, WORDS)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
    whole = inside_of(raw, BREAKS)
    joins = np.append(whole[ends[:-1]] & (doc[1:] == doc[:-1]), False)
    wide = np.flatnonzero(joins[:-1] & (starts[1:] - ends[:-1] > 1))  # more than one byte between two words
    if len(wide):
        joins[wide] = np.logical_and.reduceat(whole, np.column_stack([ends[wide], starts[wide + 1]]).ravel())[::2]
    langs = batch.column(batch.schema.get_field_index("lang")).dictionary_encode()
    names, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy()[doc]
    bases = lang_hashes(names)
    lasting, checks = limb_hashes(raw, starts, ends)
    salts = mix(bases + U64(1))[lang]
    hashes, checks = (lasting if not trie.salt else limb_hashes(raw, starts, ends, trie.salt)[0]) + salts, checks + salts
    kind = pa.array(hashes).dictionary_encode().indices.to_numpy()
    firsts = np.flatnonzero(np.diff(np.maximum.accumulate(kind), prepend=-1))
    if (checks != checks[firsts][kind]).any():
        return None

    def spell(chosen: np.ndarray) -> tuple[list[str], list[bytes], np.ndarray]:
        at = firsts[order[chosen]]
        data = raw.tobytes()
        return [names[i] for i in lang[at].tolist()], [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())], mix(lasting[at] + bases[lang[at]])

    order = np.argsort(hashes[firsts])
    found = trie.numbers(hashes[firsts][order], checks[firsts][order], spell)
    if found is None:
        return None
    ids = np.empty(len(order), np.int64)
    ids[order] = found
    return ids[kind], joins


def mined(docs: DataFrame, longest: int = 4, least: int = 30, top: int = 2000, share: int = 80, scale: int = 2_000_000) -> DataFrame:
    """The first `top` phrases of 2 to `longest` words of each lang: lang, rank, phrase, a (its count), l and r (counts of the
    two sides of its weakest cut), n (words of the language), score = floor(scale * a / (l + r)). Phrases that stand at least
    `least` times are candidates; one whose words lie inside a longer candidate with at least `share` percent of its count is
    dropped. longest: at most 4."""
    if not 2 <= longest <= 4:
        raise ValueError("phrases have two to four words")
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    parts = min(max(PARTS[0], int(spark.conf.get("spark.sql.shuffle.partitions"))), PARTS[1])
    levels: list[DataFrame] = []
    sizes, keep = None, None
    for length in range(1, longest + 1):
        found = written(merged(phrase_runs(docs, length, parts, keep), ["lang"], least, totals=length == 1), f"phrases-{length}")
        if length == 1:
            sizes = found.where("key IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
        levels.append(found.where(f"key IS NOT NULL AND n >= {least}"))
        if length < longest:
            keep = hash_filter(levels[-1], phrase_hashes(length))
    return _ranked(levels, sizes, longest, top, share, scale)


def _ranked(levels: list[DataFrame], sizes: DataFrame, longest: int, top: int, share: int, scale: int) -> DataFrame:
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)
    whole = [f.withColumn("words", F.split("key", " ", -1)).withColumn("size", F.lit(k)) for k, f in enumerate(levels[1:], 2)]
    candidates = whole[0]
    for f in whole[1:]:
        candidates = candidates.unionByName(f)
    spell = lambda at, n: F.array_join(F.slice("words", at, n), " ")

    cuts = candidates.select("lang", "key", F.col("n").alias("a"), "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.select("lang", "key", "a", "cut", spell(F.lit(1), F.col("cut")).alias("first"), spell(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("rest"))
    left = counts.select("lang", F.col("key").alias("first"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("key").alias("rest"), F.col("n").alias("r"))
    wide = lambda c: c.cast("decimal(28,0)")
    score = F.call_function("div", F.lit(scale).cast("decimal(10,0)") * wide(F.col("a")), wide(F.col("l")) + wide(F.col("r"))).cast("long")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    weakest = scored.groupBy("lang", "key", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w"))

    inner = candidates.where("size > 2").select("lang", "n", "words", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"))
    inner = inner.select("lang", "n", "words", "k", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("at"))
    covers = inner.groupBy("lang", spell(F.col("at"), F.col("k")).alias("key")).agg(F.max("n").alias("longer"))
    covered = F.lit(100).cast("decimal(10,0)") * wide(F.col("longer")) >= F.lit(share).cast("decimal(10,0)") * wide(F.col("a"))
    kept = weakest.join(covers, ["lang", "key"], "left").where(F.col("longer").isNull() | ~covered).select("lang", F.col("key").alias("phrase"), "a", "w.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    kept = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    return kept.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
