"""Views sampled over time, from a table of readings: contract_address, function, block_number, ts, result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["contract_address", "function"]
#: A bucket of time of a view that is read in one task.
BUCKET_SECONDS = 86_400


def interval_snapshots(readings: DataFrame, seconds: int) -> DataFrame:
    """The last reading of each interval of each view."""
    rows = readings.withColumn("tick", F.expr(f"ts div {int(seconds)} * {int(seconds)}"))
    last = F.max_by(F.struct("block_number", "ts", "result"), F.struct("ts", "block_number", F.to_json("result")))
    return rows.groupBy(*KEYS, "tick").agg(last.alias("r")).select(*KEYS, "tick", "r.*")


def constant_snapshots(readings: DataFrame) -> DataFrame:
    """The first reading of each view."""
    first = F.min_by(F.struct("block_number", "ts", "result"), F.struct("ts", "block_number", F.to_json("result")))
    return readings.groupBy(*KEYS).agg(first.alias("r")).select(*KEYS, "r.*")


def triggers(events: DataFrame, rules: DataFrame) -> DataFrame:
    """(contract_address, function, ts, block_number) of events that ask for a reading; none while catching up.

    rules: contract_address, function, event, source_address (null: the contract itself).
    """
    rules = rules.select(*KEYS, F.col("event").alias("event_name"), F.coalesce("source_address", "contract_address").alias("emitter")).distinct()
    live = events.where(~F.col("is_catchup")).select(F.col("contract_address").alias("emitter"), "event_name", F.col("timestamp").alias("ts"), "block_number")
    return live.join(rules, ["emitter", "event_name"]).select(*KEYS, "ts", "block_number").distinct()


def ticks(asked: DataFrame, seconds: int, until: int, bucket: int = BUCKET_SECONDS) -> DataFrame:
    """Forced readings: every `seconds` after each trigger until the next one of the same view (or `until`), which is sought in
    the trigger's bucket of time, then in a table of one row a bucket."""
    rows = asked.withColumn("bucket", F.expr(f"ts div {int(bucket)}"))
    firsts = rows.groupBy(*KEYS, "bucket").agg(F.min("ts").alias("first"))
    firsts = firsts.withColumn("later", F.lead("first").over(Window.partitionBy(*KEYS).orderBy("bucket"))).drop("first")
    own = F.lead("ts").over(Window.partitionBy(*KEYS, "bucket").orderBy("ts", "block_number"))
    rows = rows.withColumn("own", own).join(firsts, [*KEYS, "bucket"]).withColumn("next_ts", F.coalesce("own", "later", F.lit(until)))
    rows = rows.where(F.col("next_ts") - F.col("ts") > seconds)
    return rows.select(*KEYS, F.explode(F.sequence(F.col("ts") + seconds, F.col("next_ts") - 1, F.lit(seconds).cast("bigint"))).alias("ts"), "block_number")


def reorg_triggers(views: DataFrame, reorgs: DataFrame) -> DataFrame:
    """Every view is read again after a reorg, so the result has a row for each view and notice. reorgs: start_block, ts."""
    return views.select(*KEYS).distinct().crossJoin(reorgs.select("ts", F.col("start_block").alias("block_number")))


def readings_at(asked: DataFrame, readings: DataFrame, bucket: int = BUCKET_SECONDS) -> DataFrame:
    """The first reading at or after each trigger, by one ordered pass over the union of both in each bucket of time of a view;
    where a bucket has none later, the first reading of the next bucket with one, from a table of one row a bucket."""
    a = asked.select(*KEYS, "ts", F.lit(None).cast("bigint").alias("block_number"), F.lit(None).cast("array<string>").alias("result"), F.lit(True).alias("asked"))
    r = readings.select(*KEYS, "ts", "block_number", "result", F.lit(False).alias("asked"))
    both = a.unionByName(r).withColumn("bucket", F.expr(f"ts div {int(bucket)}"))
    reading = F.when(~F.col("asked"), F.struct("ts", "block_number", "result"))
    order = Window.partitionBy(*KEYS, "bucket").orderBy(F.desc("ts"), F.asc("asked"), F.desc("block_number"))
    later = F.last(reading, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    firsts = both.groupBy(*KEYS, "bucket").agg(F.min_by(reading, F.when(~F.col("asked"), F.struct("ts", "block_number"))).alias("first"))
    after = Window.partitionBy(*KEYS).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("next", F.last("first", ignorenulls=True).over(after)).select(*KEYS, "bucket", "next")
    rows = both.withColumn("r", later).where("asked").join(firsts, [*KEYS, "bucket"]).withColumn("r", F.coalesce("r", "next")).where("r IS NOT NULL")
    return rows.select(*KEYS, F.col("ts").alias("asked_ts"), F.col("r.ts").alias("ts"), F.col("r.block_number").alias("block_number"), F.col("r.result").alias("result"))


def debounced_times(times: list[int], window: int) -> list[int]:
    """When readings happen: at once if the last one is `window` or more ago, else once at the end of that window."""
    out: list[int] = []
    for t in times:
        if window <= 0 or not out or t >= out[-1] + window:
            out.append(t)
        elif t > out[-1]:
            out.append(out[-1] + window)
        # a trigger before an already planned reading falls to it
    return out


def debounced(asked: DataFrame, window: int) -> DataFrame:
    """Reading times of each view. The state is one time a view: the triggers of a view stream through in order, and
    views are spread over tasks, so that no view's triggers are held at once."""
    rows = asked.select(*KEYS, "ts").repartition(*KEYS).sortWithinPartitions(*KEYS, "ts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for pdf in batches:
            out = []
            for address, function, ts in pdf.itertuples(index=False):
                if (address, function) != key:
                    key, last = (address, function), None
                if window <= 0 or last is None or ts >= last + window:
                    last = ts
                elif ts > last:
                    last += window
                else:
                    continue
                out.append((address, function, last))
            yield pd.DataFrame(out, columns=[*KEYS, "ts"])

    return rows.mapInPandas(run, "contract_address string, function string, ts bigint")
