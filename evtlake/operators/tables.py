"""Tables made of events: logs, the latest row of each key, and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import Aggregate


def expanded_rules(rules: DataFrame, catalog: DataFrame, contracts: DataFrame) -> DataFrame:
    """One rule for each contract and event of its ABI: an explicit one, else the contract's '*'. Unknown names go."""
    events = catalog.where("kind = 'event'").select("abi_name", F.col("name").alias("event_name")).distinct()
    every = contracts.select("contract_name", "abi_name").join(events, "abi_name")
    details = [c for c in rules.columns if c not in ("contract_name", "event_name")]
    explicit = rules.where("event_name <> '*'").select("contract_name", "event_name", F.struct(*details).alias("own"))
    star = rules.where("event_name = '*'").select("contract_name", F.struct(*details).alias("star"))
    joined = every.join(explicit, ["contract_name", "event_name"], "left").join(star, "contract_name", "left")
    return joined.withColumn("r", F.coalesce("own", "star")).where("r IS NOT NULL").select("contract_name", "event_name", "r.*")


def latest(df: DataFrame, *keys: str) -> DataFrame:
    """The row of the highest (block_number, log_index) of each key. Spark limits groups before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("block_number"), F.desc("log_index"))
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def earliest(df: DataFrame, *keys: str) -> DataFrame:
    """The row of the lowest (block_number, log_index) of each key."""
    order = Window.partitionBy(*keys).orderBy("block_number", "log_index")
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def latest_shared(df: DataFrame, key: str) -> DataFrame:
    """The same in a table of several contracts."""
    return latest(df, "contract_address", key)


def _number(field: str) -> Column:
    """The field as double; missing or no number counts as 0."""
    return F.coalesce(F.col(field).try_cast("double"), F.lit(0.0))


def totals(df: DataFrame, aggregates: list[Aggregate], weight: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """One row of sums, counts and averages over the table (or by the given columns). weight: 1 or -1 for signed rows."""
    w = F.lit(1) if weight is None else weight
    out = []
    for a in aggregates:
        total, n = F.coalesce(F.sum(w * _number(a.field)), F.lit(0.0)) if a.field else F.lit(0.0), F.coalesce(F.sum(w), F.lit(0)).cast("bigint")
        value = {"sum": total, "count": n, "avg": F.when(n > 0, total / n).otherwise(0.0)}[a.operation]
        out.append(value.alias(a.column))
    return df.groupBy(*(by or [])).agg(*out)


def deltas(changes: DataFrame, aggregates: list[Aggregate]) -> DataFrame:
    """Additive parts of a batch of changes: inserts add, deletes subtract, updates leave totals alone."""
    rows = changes.where("op IN ('insert', 'delete')")
    w = F.when(F.col("op") == "insert", 1).otherwise(-1)
    parts = [F.coalesce(F.sum(w * _number(a.field)), F.lit(0.0)).alias(f"{a.column}_sum") for a in aggregates if a.operation != "count"]
    return rows.agg(*parts, F.coalesce(F.sum(w), F.lit(0)).cast("bigint").alias("n"))


def merged_deltas(parts: DataFrame, aggregates: list[Aggregate]) -> DataFrame:
    """Totals from the deltas of any number of batches; of none, 0."""
    sums = parts.agg(*(F.coalesce(F.sum(c), F.lit(0).cast(parts.schema[c].dataType)).alias(c) for c in parts.columns))
    out = []
    for a in aggregates:
        value = F.col("n") if a.operation == "count" else F.col(f"{a.column}_sum")
        out.append((F.when(F.col("n") > 0, value / F.col("n")).otherwise(0.0) if a.operation == "avg" else value).alias(a.column))
    return sums.select(*out)


def exact_sum(df: DataFrame, text: str, to: str = "total") -> DataFrame:
    """The exact sum of decimal text of up to 78 digits, with or without a sign, as text, by parts of 18 digits. Text that is
    no whole number counts as 0."""
    sign = F.when(F.col(text).startswith("-"), -1).otherwise(1)
    padded = F.lpad(F.regexp_replace(text, "^[+-]", ""), 90, "0")
    part = [F.coalesce(F.sum(sign * F.substring(padded, 1 + 18 * (4 - i), 18).cast("decimal(18,0)")).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias(f"p{i}") for i in range(5)]
    row = df.where(F.col(text).rlike("^[+-]?[0-9]{1,78}$")).agg(*part)
    base = F.lit(10**18).cast("decimal(38,0)")

    def digits(side: int) -> tuple[Column, Column]:
        """The sum, or its negative, in parts from 0 to 10**18 - 1, and what is carried out of the last."""
        carry: Column = F.lit(0).cast("decimal(38,0)")
        texts = []
        for i in range(5):
            whole = side * F.col(f"p{i}") + carry
            texts.append(F.lpad(F.pmod(whole, base).cast("decimal(18,0)").cast("string"), 18, "0"))
            carry = ((whole - F.pmod(whole, base)) / base).cast("decimal(38,0)")
        return F.ltrim(F.concat(carry.cast("string"), *reversed(texts)), F.lit("0")), carry

    (plus, over), (minus, _) = digits(1), digits(-1)
    return row.select(F.when(over < 0, F.concat(F.lit("-"), minus)).when(plus == "", F.lit("0")).otherwise(plus).alias(to))


def migrated(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows with all columns; those that a side lacks are null, none is dropped."""
    return old.unionByName(new, allowMissingColumns=True)


def shared_rows(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Events of all children of a factory in one table, with contract_name."""
    return events.join(registry.select("contract_address", "contract_name"), "contract_address")


def view_table(readings: DataFrame, kind: str, key: str = "latest", shared: bool = False) -> DataFrame:
    """Readings of a view: all of them (log), or the last of each _view_key ('latest' or an output column)."""
    rows = readings.withColumn("_view_key", F.lit("latest") if key == "latest" else F.col(key).cast("string"))
    if kind == "log":
        return rows
    keys = (["contract_address"] if shared else []) + ["_view_key"]
    order = Window.partitionBy(*keys).orderBy(F.desc("block_number"), F.desc("ts"))
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
