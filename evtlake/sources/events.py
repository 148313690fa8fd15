"""Reads of raw events: ranges, positional key filters, address filters, backfill, resume and enrichment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BUCKET_BLOCKS, CATCHUP_BLOCKS


def write_raw(raw: DataFrame, path: str, mode: str = "append", bucket_blocks: int = BUCKET_BLOCKS) -> None:
    """Stored by block bucket, with the selector as a column of its own, sorted for min/max statistics."""
    rows = raw.withColumn("selector", F.try_element_at("keys", F.lit(1))).withColumn("block_bucket", F.expr(f"block_number div {bucket_blocks}"))
    # By ranges of the order itself, so that a batch of one bucket, or of one block, is not one task.
    rows.repartitionByRange("block_number", "event_seq").sortWithinPartitions("block_number", "event_seq").write.mode(mode).partitionBy("block_bucket").parquet(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def block_range(raw: DataFrame, first: int, last: int, address: str | None = None, keys: list[list[str]] | None = None, bucket_blocks: int = BUCKET_BLOCKS) -> DataFrame:
    """Events of first..last, both included. The bucket's predicate prunes folders where the table has that column."""
    rows = raw.where(F.col("block_number").between(first, last))
    if "block_bucket" in raw.columns:
        rows = rows.where(F.col("block_bucket").between(first // bucket_blocks, last // bucket_blocks))
    if address is not None:
        rows = rows.where(F.col("contract_address") == address)
    return rows.where(key_match(keys)) if keys else rows


def key_match(keys: list[list[str]]) -> Column:
    """keys[i] lists what is allowed at place i; an empty list allows anything."""
    tests = [F.coalesce(F.try_element_at("keys", F.lit(i + 1)).isin(allowed), F.lit(False)) for i, allowed in enumerate(keys) if allowed]
    return reduce(Column.__and__, tests, F.lit(True))


def tracked_only(raw: DataFrame, tracked: DataFrame) -> DataFrame:
    """tracked: contract_address."""
    return raw.join(tracked.select("contract_address").distinct(), "contract_address", "left_semi")


def backfill(raw: DataFrame, contracts: DataFrame, to_block: int) -> DataFrame:
    """Events of each contract from its start_block to to_block, marked as catch-up."""
    starts = contracts.select("contract_address", F.coalesce("start_block", F.lit(0)).alias("start_block"))
    return raw.join(starts, "contract_address").where((F.col("block_number") >= F.col("start_block")) & (F.col("block_number") <= to_block)).drop("start_block").withColumn("is_catchup", F.lit(True))


def with_catchup(raw: DataFrame, tip: int) -> DataFrame:
    return raw.withColumn("is_catchup", F.col("block_number") + CATCHUP_BLOCKS < F.lit(tip))


def history_and_live(history: DataFrame, live: DataFrame, tip: int, start: int) -> DataFrame:
    """start..tip from history, everything later from the live feed: no gap, no overlap."""
    return history.where(F.col("block_number").between(start, tip)).unionByName(live.where(F.col("block_number") >= max(tip + 1, start)))


def partitioned_union(raw: DataFrame, conditions: list[Column]) -> DataFrame:
    """Feeds by condition; each event comes from the first that it meets, so they are disjoint."""
    taken, feeds = F.lit(False), []
    for condition in conditions:
        condition = F.coalesce(condition, F.lit(False))
        feeds.append(raw.where(condition & ~taken))
        taken = taken | condition
    return reduce(DataFrame.unionByName, feeds)


def from_cursor(raw: DataFrame, cursors: DataFrame, key: str = "contract_address") -> DataFrame:
    """Drops events below the contract's cursor; the boundary block may repeat. cursors: key, last_block."""
    return raw.join(cursors.select(key, "last_block"), key, "left").where(F.col("block_number") >= F.coalesce("last_block", F.lit(0))).drop("last_block")


def exact_dedup(raw: DataFrame) -> DataFrame:
    """One row for each event; a stream needs a watermark and drops repeats within it."""
    keys = ["block_number", "transaction_hash", "event_seq"]
    return raw.dropDuplicatesWithinWatermark(keys) if raw.isStreaming else raw.dropDuplicates(keys)


def with_timestamps(raw: DataFrame, blocks: DataFrame) -> DataFrame:
    """Block timestamps; 0 where the block is unknown."""
    times = blocks.groupBy("block_number").agg(F.max("timestamp").alias("timestamp")) if not blocks.isStreaming else blocks
    return raw.join(times, "block_number", "left").withColumn("timestamp", F.coalesce("timestamp", F.lit(0).cast("bigint")))
