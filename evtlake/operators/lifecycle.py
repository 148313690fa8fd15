"""Contracts retired by their own, a named or a sibling contract's events, or by a predicate on their metadata.

Rules (one row each): contract_name, kind ('local', 'foreign', 'sibling', 'predicate'), event, source (name of the foreign
contract), meta_field, op, value (decimal text or hex).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.felt import canonical, compared, let, number_text

def _triggers(rows: DataFrame) -> DataFrame:
    """The first trigger of each contract."""
    return rows.groupBy("contract_name").agg(F.min(F.struct("block_number", "log_index")).alias("t")).select("contract_name", F.col("t.block_number").alias("frozen_at_block"), F.col("t.log_index").alias("frozen_at_log"))


def local_triggers(events: DataFrame, rules: DataFrame) -> DataFrame:
    """events: contract_name, event_name, block_number, log_index."""
    own = rules.where("kind = 'local'").select("contract_name", F.col("event").alias("event_name")).distinct()
    return _triggers(events.join(own, ["contract_name", "event_name"]))


def foreign_triggers(events: DataFrame, rules: DataFrame) -> DataFrame:
    own = rules.where("kind = 'foreign'").select("contract_name", F.col("source").alias("emitter"), F.col("event").alias("event_name")).distinct()
    return _triggers(events.withColumnRenamed("contract_name", "emitter").join(own, ["emitter", "event_name"]))


def sibling_triggers(events: DataFrame, rules: DataFrame, contracts: DataFrame) -> DataFrame:
    """The emitter is the address in the contract's metadata field."""
    own = rules.where("kind = 'sibling'").join(contracts.select("contract_name", "factory_meta"), "contract_name")
    own = own.select("contract_name", F.col("event").alias("event_name"), canonical(F.col("factory_meta")[F.col("meta_field")]).alias("emitter")).distinct()
    return _triggers(events.drop("contract_name").withColumn("emitter", canonical(F.col("contract_address"))).join(own, ["emitter", "event_name"]))


def resolved(value: Column, now: int) -> Column:
    """A rule's value as plain decimal text: a number, or now() with an optional offset such as '- 2d'; null if it is none."""
    text = F.trim(value)
    sign = F.regexp_extract(text, r"^now\(\)\s*([+-])", 1)
    count = F.regexp_extract(text, r"(\d+)[smhd]$", 1).try_cast("bigint")
    unit = F.regexp_extract(text, r"([smhd])$", 1)
    seconds = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    moved = F.lit(now) + F.when(sign == "-", -1).otherwise(1) * count * seconds
    time = F.when(text == "now()", F.lit(now)).when(text.rlike(r"^now\(\)\s*[+-]\s*\d+[smhd]$"), moved)
    return F.when(text.startswith("now()"), time.cast("string")).otherwise(number_text(text))


def predicate_matches(contracts: DataFrame, rules: DataFrame, now: int) -> DataFrame:
    """Names of contracts whose metadata meets a predicate; a missing field or a value that is no number meets none. Numbers
    of any length, with fractions, compare exactly."""
    own = rules.where("kind = 'predicate'").withColumn("bound", resolved(F.col("value"), now))
    joined = own.join(contracts.select("contract_name", "factory_meta"), "contract_name")
    op = F.col("op")

    def holds(c: Column) -> Column:
        less, equal = c["less"], c["equal"]
        return F.when(op == "lt", less).when(op == "gt", ~(less | equal)).when(op == "lte", less | equal).when(op == "gte", ~less).when(op == "eq", equal)

    meets = let(compared(number_text(F.col("factory_meta")[F.col("meta_field")]), F.col("bound")), holds)
    return joined.where(F.coalesce(meets, F.lit(False))).select("contract_name").distinct()


def reconciled(events: DataFrame, rules: DataFrame, contracts: DataFrame, now: int) -> DataFrame:
    """Names to freeze from what is stored: local and sibling triggers and predicates; foreign ones are left out."""
    return local_triggers(events, rules).select("contract_name").unionByName(sibling_triggers(events, rules, contracts).select("contract_name")).unionByName(predicate_matches(contracts, rules, now)).distinct()


def frozen_registry(contracts: DataFrame, triggers: DataFrame) -> DataFrame:
    """The registry with frozen and frozen_at_block."""
    rows = contracts.drop("frozen", "frozen_at_block").join(triggers.select("contract_name", "frozen_at_block"), "contract_name", "left")
    return rows.withColumn("frozen", F.col("frozen_at_block").isNotNull())


def until_frozen(events: DataFrame, triggers: DataFrame) -> DataFrame:
    """Events up to and with the trigger's row; what follows goes."""
    rows = events.join(triggers.select("contract_name", "frozen_at_block", "frozen_at_log"), "contract_name", "left")
    after = (F.col("block_number") > F.col("frozen_at_block")) | ((F.col("block_number") == F.col("frozen_at_block")) & (F.col("log_index") > F.col("frozen_at_log")))
    return rows.where(F.coalesce(~after, F.lit(True))).drop("frozen_at_block", "frozen_at_log")


def registered(found: DataFrame, rules: DataFrame, now: int) -> DataFrame:
    """New children, those already past a predicate frozen at once."""
    past = predicate_matches(found, rules, now).withColumn("frozen", F.lit(True))
    return found.drop("frozen").join(past, "contract_name", "left").withColumn("frozen", F.coalesce("frozen", F.lit(False)))
