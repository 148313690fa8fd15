"""The same operators on streams: live tables, replay then live, idempotent sinks and cursors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.query import after_event, filtered, with_event_id
from ..schemas import CONFIRMATION_DEPTH, RAW_EVENT, Filter
from ..sources.events import exact_dedup


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path that is not used yet, in spark.checkpoint.dir, in a folder of the application that goes when the driver ends. Where
    the setting is unset, a temporary folder is set there once in local tests; a cluster is refused, as executors do not
    share their own folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    own = f"{root.rstrip('/')}/evtlake-{name}-{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(own)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        system.mkdirs(where)
        system.deleteOnExit(where)
    return f"{own}/{uuid.uuid4().hex}"


def raw_stream(spark: SparkSession, path: str, schema: str = RAW_EVENT, files_per_trigger: int | None = 100) -> DataFrame:
    """New files of raw events; the checkpoint of the query that reads it remembers where it was. Without files_per_trigger a
    micro-batch takes all files that are there."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(path)


def live(stream: DataFrame, filters: list[Filter] | tuple[Filter, ...] = ()) -> DataFrame:
    """New rows of a table that meet all filters, ranges too."""
    return with_event_id(filtered(stream, filters))


def appended(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """A log table from a stream, each row once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def for_each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """act(rows, batch_id): a batch that broke off comes again under the same id."""
    writer = stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def batch_writer(path: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own, overwritten if it comes again."""

    def act(rows: DataFrame, batch_id: int) -> None:
        transform(rows).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return act


def cursor_deltas(rows: DataFrame) -> DataFrame:
    """The last block of each contract in a batch; the maximum over batches never moves back."""
    return rows.groupBy("contract_name").agg(F.max("block_number").alias("last_block"))


def merged_cursors(parts: DataFrame) -> DataFrame:
    return parts.groupBy("contract_name").agg(F.max("last_block").alias("last_block"))


def followed(log: DataFrame, stream: DataFrame, block: int, log_index: int, path: str, checkpoint: str, filters: list[Filter] | tuple[Filter, ...] = (), once: bool = True) -> StreamingQuery:
    """Rows after an event id: those stored first, in the folder `path/replay`, then the stream's, each batch in a folder of
    its own. The stream takes over behind the last row stored at the first start. That boundary is kept beside the checkpoint,
    so a later start replays nothing beyond it, whatever the log holds by then, and no row comes twice."""
    spark, kept = log.sparkSession, f"{checkpoint}-boundary"
    schema = "block_number bigint, log_index bigint"
    if not finished(spark, kept):
        tip = log.agg(F.max(F.struct("block_number", "log_index")).alias("t")).select("t.block_number", "t.log_index")
        tip.write.mode("overwrite").parquet(kept)
    tip = spark.read.schema(schema).parquet(kept).first()
    at = (block, log_index) if tip["block_number"] is None else max((block, log_index), (tip["block_number"], tip["log_index"]))
    later = (F.col("block_number") > at[0]) | ((F.col("block_number") == at[0]) & (F.col("log_index") > at[1]))
    if not finished(spark, f"{path}/replay"):
        with_event_id(after_event(log.where(~later), block, log_index, filters)).write.mode("overwrite").parquet(f"{path}/replay")
    return for_each_batch(with_event_id(filtered(stream.where(later), filters)), batch_writer(path), checkpoint, once)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a Spark job has written this folder to its end."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def timestamped(stream: DataFrame, blocks: DataFrame, delay: int = CONFIRMATION_DEPTH) -> DataFrame:
    """Block timestamps for a stream of events from a stream of blocks (block_number, timestamp); 0 where the block does not
    come within `delay` blocks of the newest. A row comes out when its block is known, one without at the end of the delay.
    Heights count as seconds of event time; a block that comes again counts once."""
    height = lambda df: df.withColumn("_height", F.timestamp_seconds(F.col("block_number") + 1)).withWatermark("_height", f"{delay} seconds")
    times = height(blocks.select("block_number", "timestamp")).dropDuplicatesWithinWatermark(["block_number"])
    times = times.select(F.col("block_number").alias("_block"), "timestamp", F.col("_height").alias("_at"))
    rows = height(stream.drop("timestamp"))
    joined = rows.join(times, (F.col("block_number") == F.col("_block")) & (F.col("_height") == F.col("_at")), "left")
    return joined.withColumn("timestamp", F.coalesce("timestamp", F.lit(0).cast("bigint"))).drop("_block", "_at", "_height")


def distinct_events(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Each event of a stream once, as long as repeats come within `delay` of the newest time."""
    return exact_dedup(stream.withWatermark(time, delay))


def replay_then_live(log: DataFrame, later: DataFrame, block: int, log_index: int, filters: list[Filter] | tuple[Filter, ...] = ()) -> DataFrame:
    """Rows after an event id from the stored log and from the live part, each event once."""
    rows = with_event_id(after_event(log, block, log_index, filters)).unionByName(with_event_id(after_event(later, block, log_index, filters)))
    return rows.dropDuplicates(["event_id"])
