"""Tables that are kept, not recomputed: a log by block bucket, the latest row of each key, and running totals.

Each takes batches by (writer, number), in any order; a batch that comes again changes nothing. The writer of a stream is the
stream's name, its numbers are those of its micro-batches, so a stream that starts again from its checkpoint repeats nothing.

Defined results: an empty batch is noted as applied; rows of a batch may repeat and come in any order; of two rows of a log
with one (block_number, log_index) the later ingest_seq stays, or the later batch's where a log has no such column; rows with
a null key are one key; a null block number is bucket -1.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from ..operators.lifecycle import until_frozen
from ..operators.query import latest_event
from ..operators.registry import child_events
from ..operators.tables import deltas, earliest, latest, merged_deltas
from ..schemas import BUCKET_BLOCKS, CONFIRMATION_DEPTH, Aggregate
from .streams import for_each_batch
from .versions import BUCKET, Version, Versioned, values_of

POSITION = ["block_number", "log_index"]
#: Buckets of a keyed table; parts of a table of totals before they are added up.
KEY_BUCKETS, PARTS = 64, 32


class UniqueTable:
    """The row of the highest (block_number, log_index) of each key, or of the lowest (first), in buckets by the key's hash.

    A batch is reduced to one row of each key first; only the buckets that it touches are read and written again. An older row
    never replaces a newer one, so batches may come in any order.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = KEY_BUCKETS, first: bool = False) -> None:
        self.store, self.keys, self.buckets = Versioned(spark, path, schema), keys, buckets
        self.pick = earliest if first else latest

    def merge(self, rows: DataFrame, writer: str, batch: int) -> None:
        old = self.store.version()
        if old.has(writer, batch):
            return
        new = self.pick(rows.select(*self.store.schema.names), *self.keys).withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")).persist()
        touched = values_of(new, BUCKET)
        version = old
        if touched:
            kept = self.store.read(old, touched)
            both = self.pick(new.drop(BUCKET).unionByName(kept), *self.keys).withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
            written = self.store.write(both.repartition(len(touched), BUCKET))
            version = replace(old, folders={**old.folders, **written})
        self.store.publish(old, version.with_batch(writer, batch))
        new.unpersist()

    def read(self) -> DataFrame:
        return self.store.read()


class LogTable:
    """Every event once, in folders by block bucket, with undone ranges taken out and confirmed blocks compacted.

    A batch adds a folder to each bucket that it has rows for. Only where it brings rows of positions that are there already
    (redelivered ones) their buckets are written again, the new rows in place of the old.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, bucket_blocks: int = BUCKET_BLOCKS) -> None:
        self.store, self.bucket_blocks = Versioned(spark, path, schema), bucket_blocks
        self.seq = "ingest_seq" in schema.names

    def _bucket(self) -> Column:
        return F.coalesce(F.floor(F.col("block_number") / self.bucket_blocks), F.lit(-1)).cast("int")

    def _write(self, rows: DataFrame) -> dict[int, tuple[str, ...]]:
        """One row of each position: the later ingest_seq, then the later _order. In order of blocks, so that a bucket is a few
        sorted files, not one from each task; the shuffle and the sort for that also bring the rows of a position together."""
        placed = rows.withColumn(BUCKET, self._bucket()).repartitionByRange(BUCKET, *POSITION)
        later = [*(["ingest_seq"] if self.seq else []), "_order", F.xxhash64(*self.store.schema.names)]
        order = Window.partitionBy(BUCKET, *POSITION).orderBy(*map(F.desc, later))
        newest = placed.withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
        return self.store.write(newest.select(*self.store.schema.names, BUCKET).sortWithinPartitions(BUCKET, *POSITION))

    def _again(self, old: Version, new: DataFrame, known: list[int]) -> list[int]:
        """Those of the buckets that are there already in which new rows have positions of stored ones."""
        if not known:
            return []
        there, here = self.store.read(old, known).select(*POSITION), new.where(F.col(BUCKET).isin(known))
        same = [there[c].eqNullSafe(here[c]) for c in POSITION]
        return values_of(here.join(there, same[0] & same[1], "left_semi"), BUCKET)

    def append(self, rows: DataFrame, writer: str, batch: int, cached: bool = False) -> None:
        """cached: rows are little more than a cached table, so that they are not cached once more."""
        old = self.store.version()
        if old.has(writer, batch):
            return
        new = rows.select(*self.store.schema.names).withColumn("_order", F.lit(1)).withColumn(BUCKET, self._bucket())
        new = new if cached else new.persist()
        touched = values_of(new, BUCKET)
        folders = dict(old.folders)
        if touched:
            again = self._again(old, new, [b for b in touched if b in old.folders])
            fresh = new.where(~F.col(BUCKET).isin(again)) if again else new
            for bucket, paths in self._write(fresh).items():
                folders[bucket] = (*folders.get(bucket, ()), *paths)
            if again:
                kept = self.store.read(old, again).withColumn("_order", F.lit(0))
                folders |= self._write(kept.unionByName(new.where(F.col(BUCKET).isin(again)).drop(BUCKET)))
        self.store.publish(old, replace(old, folders=folders).with_batch(writer, batch))
        if not cached:
            new.unpersist()

    def undo(self, start_block: int, end_block: int, seq: int, writer: str = "reorg") -> None:
        """Takes the rows of start_block..end_block out, but those of a later ingest_seq than the notice's. Only buckets that
        hold such rows are written again; confirmed blocks stay; a notice that comes again changes nothing."""
        old = self.store.version()
        if old.has(writer, seq):
            return
        first = max(start_block, old.notes.get("confirmed", -1) + 1)
        hit = F.col("block_number").between(first, end_block)
        if self.seq:
            hit = hit & (F.coalesce("ingest_seq", F.lit(-1)) < seq)
        inside = [b for b in old.folders if first // self.bucket_blocks <= b <= end_block // self.bucket_blocks]
        rows = self.store.read(old, inside).withColumn(BUCKET, self._bucket())
        touched = values_of(rows.where(hit), BUCKET) if inside else []
        folders = dict(old.folders)
        if touched:
            left = self._write(self.store.read(old, touched).where(~F.coalesce(hit, F.lit(False))).withColumn("_order", F.lit(0)))
            folders = {b: left.get(b, f) if b in touched else f for b, f in folders.items() if b not in touched or b in left}
        self.store.publish(old, replace(old, folders=folders).with_batch(writer, seq))

    def confirm(self, block: int) -> None:
        """Notes that blocks up to this one are final, and brings the folders of each bucket below to one."""
        old = self.store.version()
        if block <= old.notes.get("confirmed", -1):
            return
        done = (block + 1) // self.bucket_blocks
        many = [b for b, f in old.folders.items() if 0 <= b < done and len(f) > 1]
        folders = dict(old.folders)
        if many:
            rows = self.store.read(old, many).withColumn(BUCKET, self._bucket()).repartition(len(many), BUCKET)
            folders |= self.store.write(rows.sortWithinPartitions(BUCKET, *POSITION))
        self.store.publish(old, replace(old, folders=folders, notes={**old.notes, "confirmed": block}))

    def confirm_depth(self, depth: int = CONFIRMATION_DEPTH) -> None:
        """`confirm` of what lies `depth` blocks or more below the newest block, which only the last bucket is read for."""
        version = self.store.version()
        if version.folders:
            top = self.store.read(version, [max(version.folders)]).agg(F.max("block_number")).first()[0]
            if top is not None and top >= depth:
                self.confirm(top - depth)

    def read(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """All rows, or those of a range of blocks: other buckets are not listed."""
        if first is None and last is None:
            return self.store.read()
        version = self.store.version()
        low = min(version.folders, default=0) if first is None else first // self.bucket_blocks
        high = max(version.folders, default=0) if last is None else last // self.bucket_blocks
        rows = self.store.read(version, [b for b in version.folders if low <= b <= high])
        rows = rows if first is None else rows.where(F.col("block_number") >= first)
        return rows if last is None else rows.where(F.col("block_number") <= last)


    def latest(self) -> DataFrame:
        """The newest event: only the last bucket is read, as no bucket without rows is kept."""
        version = self.store.version()
        return latest_event(self.store.read(version, [max(version.folders)] if version.folders else []))


class TotalsTable:
    """Sums, counts and averages from signed changes: one row of additive parts a batch, added up when they are many."""

    def __init__(self, spark: SparkSession, path: str, aggregates: list[Aggregate]) -> None:
        fields = [f"{a.column}_sum double" for a in aggregates if a.operation != "count"]
        self.aggregates, self.store = aggregates, Versioned(spark, path, StructType.fromDDL(", ".join([*fields, "n bigint"])))

    def add(self, changes: DataFrame, writer: str, batch: int) -> None:
        """changes: op (insert, update, delete) and the fields that are added up."""
        old = self.store.version()
        if old.has(writer, batch):
            return
        paths = self.store.write(deltas(changes, self.aggregates).withColumn(BUCKET, F.lit(0)))
        version = replace(old, folders={0: (*old.folders.get(0, ()), *paths[0])})
        if len(version.folders[0]) > PARTS:
            parts = self.store.read(version)
            sums = parts.agg(*(F.sum(c).alias(c) for c in parts.columns)).withColumn(BUCKET, F.lit(0))
            version = replace(version, folders=self.store.write(sums))
        self.store.publish(old, version.with_batch(writer, batch))

    def read(self) -> DataFrame:
        return merged_deltas(self.store.read(), self.aggregates)


class FrozenLog:
    """A log that ends, for each contract, with the event that freezes it.

    triggers: from events to (contract_name, frozen_at_block, frozen_at_log), as those of `lifecycle`. The first trigger of each
    contract is kept; a batch's own triggers cut the batch itself. Where a trigger comes after later events of its contract,
    `read` leaves those out.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, triggers: Callable[[DataFrame], DataFrame], bucket_blocks: int = BUCKET_BLOCKS) -> None:
        self.log, self.triggers = LogTable(spark, f"{path}/log", schema, bucket_blocks), triggers
        self.frozen = UniqueTable(spark, f"{path}/frozen", StructType.fromDDL("contract_name string, block_number bigint, log_index bigint"), ["contract_name"], first=True)

    def found(self) -> DataFrame:
        return self.frozen.read().select("contract_name", F.col("block_number").alias("frozen_at_block"), F.col("log_index").alias("frozen_at_log"))

    def append(self, rows: DataFrame, writer: str, batch: int) -> None:
        rows = rows.persist()
        new = self.triggers(rows).select("contract_name", F.col("frozen_at_block").alias("block_number"), F.col("frozen_at_log").alias("log_index"))
        self.frozen.merge(new, writer, batch)
        self.log.append(until_frozen(rows, self.found()), writer, batch, cached=True)
        rows.unpersist()

    def read(self) -> DataFrame:
        return until_frozen(self.log.read(), self.found())


class ChildLog:
    """Events of contracts found in the events themselves.

    children: from events to registry rows (contract_name, contract_address, start_block, log_index and others, as those of
    `registry.children`). A batch's children are registered first, the first of each name, then its events are taken with
    all that are registered, so a child's own events in the batch that deploys it are taken too. Batches come in order of
    blocks: what a contract did in an earlier batch than its registration is not looked up again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, children: Callable[[DataFrame], DataFrame], registry: StructType, bucket_blocks: int = BUCKET_BLOCKS) -> None:
        named = StructType([*schema.fields, *StructType.fromDDL("contract_name string").fields]) if "contract_name" not in schema.names else schema
        self.log, self.children = LogTable(spark, f"{path}/log", named, bucket_blocks), children
        renamed = StructType([replace_name(f, "block_number") if f.name == "start_block" else f for f in registry.fields])
        self.registry = UniqueTable(spark, f"{path}/registry", renamed, ["contract_name"], first=True)

    def registered(self) -> DataFrame:
        return self.registry.read().withColumnRenamed("block_number", "start_block")

    def append(self, rows: DataFrame, writer: str, batch: int) -> None:
        rows = rows.persist()
        self.registry.merge(self.children(rows).withColumnRenamed("start_block", "block_number"), writer, batch)
        self.log.append(child_events(rows.drop("contract_name"), self.registered()), writer, batch, cached=True)
        rows.unpersist()

    def read(self) -> DataFrame:
        return self.log.read()


def replace_name(field: StructField, name: str) -> StructField:
    return StructField(name, field.dataType, field.nullable)


def kept_by(stream: DataFrame, take: Callable[[DataFrame, str, int], None], writer: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Feeds a stream's micro-batches to `merge`, `append` or `add` of a table."""
    return for_each_batch(stream, lambda rows, batch: take(rows, writer, batch), checkpoint, once)
