"""Operators that keep state between micro-batches: numbers in a block, a buffer of unconfirmed rows, debounced readings.

Numbers and debounced readings use transformWithState, the buffer is an aggregation that ends with the watermark. Their state
lies in the stream's checkpoint, so a stream that starts again goes on where it stopped and rows come out once. It needs the
RocksDB state store, which `with_state` sets. Time in these operators is event time: block heights count as seconds, so a
watermark of `depth` seconds is one of `depth` blocks, and timers fire as heights grow, not as a clock runs. Heights and times
are moved by one second, as Spark's first watermark is 0 and 0 is a block.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..schemas import CONFIRMATION_DEPTH

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Blocks below the newest for which counters are kept.
COUNTED_BLOCKS = 1000
#: Shares of a block whose rows wait for its confirmation.
BLOCK_PARTS = 8


def with_state(stream: DataFrame) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return stream


class _Numbers(StatefulProcessor):
    """The next number of each block."""

    def __init__(self, names: list[str]) -> None:
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "n bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n = self.next.get()[0] if self.next.exists() else 0
        for row in sorted(rows, key=lambda r: r["event_seq"]):
            yield Row(**{c: row[c] for c in self.names}, log_index=n)
            n += 1
        self.next.update((n,))
        self.handle.registerTimer((key[0] + 1) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.next.clear()
        return iter(())

    def close(self) -> None:
        pass


def with_log_index(stream: DataFrame, keep: int = COUNTED_BLOCKS) -> DataFrame:
    """Zero-based number in the block over accepted rows of a stream. A block may be split over micro-batches in order of
    event_seq; a batch's rows of it, as many as a block holds, are sorted in memory. The counters of blocks more than `keep`
    below the newest are dropped, and so are rows of such blocks that come later."""
    names = stream.columns
    shape = StructType([*stream.schema.fields, *StructType.fromDDL("log_index bigint").fields])
    height = stream.where("block_number IS NOT NULL").withColumn("_height", F.timestamp_seconds(F.col("block_number") + 1)).withWatermark("_height", f"{keep} seconds")
    return with_state(height).groupBy("block_number").transformWithState(_Numbers(names), shape, "Append", "EventTime")


def confirmed(stream: DataFrame, notices: DataFrame | None = None, depth: int = CONFIRMATION_DEPTH, parts: int = BLOCK_PARTS) -> DataFrame:
    """Rows of a stream once their block lies `depth` blocks below the newest, each once; rows that a notice of a later seq
    than their ingest_seq undoes before that never come. stream: block_number, log_index, ingest_seq and others; notices:
    a stream of start_block, end_block, seq, which do not count for the height. Rows and notices of blocks that are confirmed
    already come too late and go.

    The rows of a block wait as lists, one for each of `parts` shares of its log indexes, so that no block is one task's."""
    height = F.timestamp_seconds(F.col("block_number") + 1).alias("_height")
    share = F.pmod(F.xxhash64("log_index"), F.lit(parts)).cast("int").alias("_share")
    rows = stream.where("block_number IS NOT NULL").select(height, share, F.struct(*(F.col(c) for c in stream.columns)).alias("_row"), F.lit(None).cast("bigint").alias("_undo"))
    rows = rows.withWatermark("_height", f"{depth} seconds")
    if notices is not None:
        blocks = notices.where("start_block <= end_block").select(F.explode(F.sequence("start_block", "end_block")).alias("block_number"), F.col("seq").alias("_undo"))
        blocks = blocks.select(height, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_share"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_undo")
        rows = rows.unionByName(blocks)
    held = with_state(rows).groupBy("_height", "_share").agg(F.collect_list("_row").alias("rows"), F.max("_undo").alias("undo"))
    return held.select(F.explode("rows").alias("r"), "undo").where("undo IS NULL OR r.ingest_seq >= undo").select("r.*")


class _Debounce(StatefulProcessor):
    """Triggers that wait for their time, the last reading, and a planned one."""

    def __init__(self, window: int) -> None:
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts bigint")
        self.readings = handle.getValueState("readings", "last bigint, planned boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        times = sorted({r["ts"] for r in rows})
        self.waiting.appendList([(t,) for t in times])
        self.handle.registerTimer((times[0] + 1) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """All triggers that the watermark has passed, in order: one reading of the waiting ones for a batch, not for each."""
        now = timerValues.getCurrentWatermarkInMs() // 1000 - 1
        waiting = sorted(r[0] for r in self.waiting.get()) if self.waiting.exists() else []
        last, planned = tuple(self.readings.get()) if self.readings.exists() else (None, False)
        due = bisect_right(waiting, now)
        for t in waiting[:due]:
            if planned and last <= t:
                yield Row(contract_address=key[0], function=key[1], ts=last)
                planned = False
            if self.window <= 0 or last is None or t >= last + self.window:
                last = t
                yield Row(contract_address=key[0], function=key[1], ts=last)
            elif t > last:
                last, planned = last + self.window, True
        if planned and last <= now:
            yield Row(contract_address=key[0], function=key[1], ts=last)
            planned = False
        if last is not None:
            self.readings.update((last, planned))
        if planned:
            self.handle.registerTimer((last + 1) * 1000)
        if due == len(waiting):
            self.waiting.clear()
        else:
            self.waiting.put([(t,) for t in waiting[due:]])
            self.handle.registerTimer((waiting[due] + 1) * 1000)

    def close(self) -> None:
        pass


def debounced(asked: DataFrame, window: int, delay: str = "0 seconds") -> DataFrame:
    """`views.debounced` on a stream of triggers (contract_address, function, ts): a reading comes out when event time has
    passed it. Triggers may come in any order within `delay`; later ones go."""
    rows = asked.where("ts IS NOT NULL").select("contract_address", "function", "ts", F.timestamp_seconds(F.col("ts") + 1).alias("_time")).withWatermark("_time", delay)
    return with_state(rows).groupBy("contract_address", "function").transformWithState(_Debounce(window), StructType.fromDDL("contract_address string, function string, ts bigint"), "Append", "EventTime")
