"""Reversible changes and undone block ranges.

A change: op (insert, update, delete), op_seq, block_number, log_index, data and prev (structs). A log's rows carry
ingest_seq where ranges may be undone: a row is undone by a reorg of its block that came later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CONFIRMATION_DEPTH
from .ranges import within

KEY = ["block_number", "log_index"]


def applied(changes: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The table after all changes: of each row its last change, deletes gone. Columns: key and the fields of data."""
    key = key or KEY
    last = changes.groupBy(*key).agg(F.max_by(F.struct("op", "data"), "op_seq").alias("l")).where("l.op <> 'delete'")
    fields = [f for f in changes.schema["data"].dataType.names if f not in key]
    return last.select(*key, *(F.col(f"l.data.{f}").alias(f) for f in fields))


def partly_updated(table: DataFrame, updates: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Rows with the given columns replaced where an update of the same key has a value."""
    key = key or KEY
    columns = [c for c in updates.columns if c not in key]
    new = updates.select(*key, *(F.col(c).alias(f"new_{c}") for c in columns))
    joined = table.join(new, key, "left")
    return joined.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns))


def inverse(changes: DataFrame) -> DataFrame:
    """Insert and delete exchanged, data and prev of updates too; a delete comes back as its former row."""
    op = F.when(F.col("op") == "insert", "delete").when(F.col("op") == "delete", "insert").otherwise(F.col("op"))
    data = F.when(F.col("op") != "insert", F.col("prev"))
    prev = F.when(F.col("op") != "delete", F.col("data"))
    return changes.withColumns({"op": op, "data": data, "prev": prev})


def reverted(changes: DataFrame, undone: Column) -> DataFrame:
    """The changelog with the inverse of those chosen appended, the last first."""
    top = changes.agg((F.max("op_seq") + 1).alias("top"))
    undo = inverse(changes.where(undone)).crossJoin(F.broadcast(top)).withColumn("op_seq", 2 * F.col("top") - F.col("op_seq")).drop("top")  # one row
    return changes.unionByName(undo.select(*changes.columns))


def with_previous(changes: DataFrame, key: list[str] | None = None) -> DataFrame:
    """prev filled from the change before on the same row."""
    order = Window.partitionBy(*(key or KEY)).orderBy("op_seq")
    return changes.withColumn("prev", F.coalesce("prev", F.lag(F.when(F.col("op") != "delete", F.col("data"))).over(order)))


def pending(log: DataFrame, confirmed_block: int) -> DataFrame:
    return log.where(F.col("block_number") > confirmed_block)


def confirmed_block(log: DataFrame, depth: int = CONFIRMATION_DEPTH) -> DataFrame:
    return log.agg((F.max("block_number") - depth).alias("confirmed_block"))


def confirmed(log: DataFrame, depth: int = CONFIRMATION_DEPTH) -> DataFrame:
    """Rows at least `depth` blocks below the newest."""
    return log.crossJoin(F.broadcast(confirmed_block(log, depth))).where("block_number <= confirmed_block").drop("confirmed_block")  # one row


def undone_blocks(log: DataFrame, reorgs: DataFrame) -> DataFrame:
    """(block_number, undone_seq): blocks of the log that a range covers, with the newest such notice.

    Only distinct blocks meet the ranges, by the equi-join of `ranges`; the log itself is joined by block number.
    """
    blocks = log.select("block_number").distinct()
    hit = within(blocks, "block_number", reorgs.select("start_block", "end_block", "seq"), "start_block", "end_block")
    return hit.groupBy("block_number").agg(F.max("seq").alias("undone_seq"))


def surviving(log: DataFrame, reorgs: DataFrame) -> DataFrame:
    """Rows that no later notice undoes; redelivered rows have a newer ingest_seq and stay. Without ingest_seq all are older."""
    rows = log.join(undone_blocks(log, reorgs), "block_number", "left")
    seq = F.col("ingest_seq") if "ingest_seq" in log.columns else F.lit(-1)
    return rows.where(F.col("undone_seq").isNull() | (F.col("undone_seq") <= seq)).select(*log.columns)


def reset_cursors(cursors: DataFrame, start_block: int) -> DataFrame:
    return cursors.withColumn("last_block", F.when(F.col("last_block") >= start_block, F.greatest(F.lit(start_block - 1), F.lit(0))).otherwise(F.col("last_block")).cast("bigint"))


def surviving_contracts(contracts: DataFrame, reorgs: DataFrame) -> DataFrame:
    """The registry without dynamic contracts whose start block lies in an undone range."""
    blocks = contracts.where("dynamic").select(F.col("start_block").alias("undone")).distinct()
    undone = within(blocks, "undone", reorgs.select("start_block", "end_block"), "start_block", "end_block").select("undone").distinct()
    return contracts.join(undone, (F.col("start_block") == F.col("undone")) & F.col("dynamic"), "left_anti")
