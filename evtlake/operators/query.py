"""Read queries: filters, order and pages over typed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import Aggregate, Filter, Query
from .tables import latest, totals

#: Skipped rows from which a page is checked for being past the end before it is ordered.
DEEP_OFFSET = 100_000


def _compared(df: DataFrame, f: Filter) -> Column:
    """The filter on the column's own type; text columns compare as numbers for ranges. A null row is never kept."""
    kind, col = df.schema[f.column].dataType, F.col(f.column)
    if f.op in ("eq", "neq"):
        if isinstance(kind, T.BooleanType):
            value = F.lit(str(f.value).lower() == "true")
        elif isinstance(kind, T.NumericType):
            value = F.lit(str(f.value)).try_cast("double" if isinstance(kind, (T.DoubleType, T.FloatType)) else "decimal(38,9)")
        else:
            value = F.lit(str(f.value))
        equal = col == value
        return F.coalesce(equal if f.op == "eq" else ~equal, F.lit(False))
    if isinstance(kind, T.StringType):
        # Digits of any length compare exactly by length and text; other text as a double, 0 if it is no number.
        number = str(f.value)
        plain = F.ltrim(col, F.lit("0"))
        digits = col.rlike("^[0-9]+$")
        if number.isdigit():
            want = number.lstrip("0")
            size = F.length(plain)
            less, equal = (size < len(want)) | ((size == len(want)) & (plain < want)), plain == want
            whole = {"lt": less, "lte": less | equal, "gt": ~(less | equal), "gte": ~less}[f.op]
            return F.coalesce(F.when(digits, whole).otherwise(_ordered(F.coalesce(col.try_cast("double"), F.when(col.isNotNull(), 0.0)), f.op, float(number))), F.lit(False))
        col = F.coalesce(col.try_cast("double"), F.when(col.isNotNull(), 0.0))
    try:
        value = float(f.value) if isinstance(kind, (T.StringType, T.DoubleType, T.FloatType)) or "." in str(f.value) else int(f.value)
    except (TypeError, ValueError):
        value = 0
    return F.coalesce(_ordered(col, f.op, value), F.lit(False))


def _ordered(col: Column, op: str, value: float) -> Column:
    return {"lt": col < value, "lte": col <= value, "gt": col > value, "gte": col >= value}[op]


def filtered(df: DataFrame, filters: tuple[Filter, ...] | list[Filter]) -> DataFrame:
    """Rows that meet all filters; unknown columns meet none."""
    tests = [_compared(df, f) if f.column in df.columns else F.lit(False) for f in filters]
    return df.where(reduce(Column.__and__, tests)) if tests else df


def ordered(df: DataFrame, order: str, descending: bool) -> DataFrame:
    turn = F.desc if descending else F.asc
    columns = [turn(order)] + ([turn("log_index")] if "log_index" in df.columns and order != "log_index" else [])
    return df.orderBy(*columns)


def listed(df: DataFrame, query: Query) -> DataFrame:
    """Filter, order, skip, limit: planned as a top-k. Of a page far down a count tells first whether it is past the end, as
    a top-k would hold all rows that it skips."""
    kept = filtered(df, query.filters)
    if query.offset >= DEEP_OFFSET and not df.isStreaming and kept.count() <= query.offset:
        return kept.limit(0)
    rows = ordered(kept, query.order, query.descending).offset(query.offset)
    return rows if query.limit is None else rows.limit(query.limit)


def latest_event(df: DataFrame) -> DataFrame:
    return listed(df, Query(limit=1))


def counted(df: DataFrame, filters: tuple[Filter, ...] | list[Filter] = ()) -> DataFrame:
    return filtered(df, filters).agg(F.count(F.lit(1)).alias("count"))


def unique_query(df: DataFrame, keys: list[str], query: Query) -> DataFrame:
    """The latest row of each key, then filters, order and page."""
    return listed(latest(df, *keys), query)


def aggregate_query(df: DataFrame, aggregates: list[Aggregate]) -> DataFrame:
    """Totals of an aggregation table; it takes no filters."""
    return totals(df, aggregates)


def of_contract(df: DataFrame, address: str) -> DataFrame:
    return df.where(F.col("contract_address") == address)


def after_event(df: DataFrame, block: int, log_index: int, filters: tuple[Filter, ...] | list[Filter] = (), limit: int | None = None) -> DataFrame:
    """Rows after an event id (block:log_index), ascending: replay, and paging without skipped rows."""
    later = (F.col("block_number") > block) | ((F.col("block_number") == block) & (F.col("log_index") > log_index))
    rows = filtered(df.where(later), filters).orderBy("block_number", "log_index")
    return rows if limit is None else rows.limit(limit)


def with_event_id(df: DataFrame) -> DataFrame:
    return df.withColumn("event_id", F.concat_ws(":", F.col("block_number").cast("string"), F.col("log_index").cast("string")))


def start_blocks(contracts: DataFrame, cursors: DataFrame, tip: int) -> DataFrame:
    """Where each contract starts: after its cursor, not before its configured block; without both at the tip."""
    rows = contracts.join(cursors, "contract_name", "left").withColumn("c", F.coalesce("last_block", F.lit(0)))
    start = F.when(F.col("start_block").isNull() & (F.col("c") == 0), F.lit(tip)).otherwise(F.greatest(F.coalesce("start_block", F.lit(0)), F.when(F.col("c") > 0, F.col("c") + 1)))
    return rows.select("contract_name", start.cast("bigint").alias("start"))


def cursors(log: DataFrame) -> DataFrame:
    return log.groupBy("contract_name").agg(F.max("block_number").alias("last_block"))


def sync_status(contracts: DataFrame, cursors: DataFrame) -> DataFrame:
    """By factory: children, those at or past the smallest cursor of all, and the rest."""
    least = cursors.agg(F.min("last_block").alias("global_block"))
    rows = contracts.where("factory_name IS NOT NULL").join(cursors, "contract_name", "left").crossJoin(F.broadcast(least))  # one row
    synced = F.coalesce(F.col("last_block") >= F.col("global_block"), F.lit(False))
    return rows.groupBy("factory_name", "global_block").agg(F.count(F.lit(1)).alias("children"), F.count_if(synced).alias("synced"), F.count_if(~synced).alias("backfilling"))


def contract_list(contracts: DataFrame, cursors: DataFrame) -> DataFrame:
    return contracts.join(cursors, "contract_name", "left").withColumn("last_block", F.coalesce("last_block", F.lit(0).cast("bigint")))


def view_status(readings: DataFrame) -> DataFrame:
    """Of each view the last reading's block and time, and its readings (and errors where the input has them)."""
    last = F.max(F.struct("block_number", "ts"))
    errors = [F.count_if(F.col("error").isNotNull()).alias("errors")] if "error" in readings.columns else []
    return readings.groupBy("contract_address", "function").agg(last.alias("l"), F.count(F.lit(1)).alias("readings"), *errors).select("contract_address", "function", F.col("l.block_number").alias("last_block"), F.col("l.ts").alias("last_ts"), "readings", *(["errors"] if errors else []))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def show_text(df: DataFrame, n: int = 20) -> None:
    df.show(n, truncate=False)
