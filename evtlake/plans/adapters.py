"""The supplied tables in the shapes of the data model (typed log, raw events, contracts, readings, changes)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.selector import selector
from ..sources.abi import abi_catalog, abi_entries, checked
from ..sources.config import config_table

EVENTS = ["click", "error", "purchase", "signup", "view"]
ADDRESSES = [f"0x{i}" for i in range(1, 8)]

LOG_SQL = """SELECT CAST(floor(epoch(ts)/3600) AS BIGINT) AS block_number,
  row_number() OVER (PARTITION BY CAST(floor(epoch(ts)/3600) AS BIGINT) ORDER BY event_id) - 1 AS log_index,
  '0x' || lower(to_hex(event_id)) AS transaction_hash, CAST(floor(epoch(ts)/3600) AS BIGINT) * 3600 AS "timestamp",
  '0x' || lower(to_hex(user_id % 7 + 1)) AS contract_address, event_type AS event_name, 'ACCEPTED_ON_L2' AS status,
  '0x' || lower(to_hex(user_id)) AS account, CAST(round(value * 100) AS BIGINT) AS amount_cents, value AS amount,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id, 'c' || (user_id % 7 + 1) AS contract_name FROM events"""
LOG_COLUMNS = ["block_number", "log_index", "transaction_hash", "timestamp", "contract_address", "event_name", "status", "account", "amount_cents", "amount", "k"]


def log(spark: SparkSession, sf_dir: str, extra: bool = False) -> DataFrame:
    """events as a typed log: blocks are hours, log_index by event_id; with extra also event_id and contract_name."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    low_hex = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    block = F.floor(seconds / 3600).cast("bigint")
    rows = events.select(
        block.alias("block_number"), "event_id",
        low_hex(F.col("event_id")).alias("transaction_hash"), (block * 3600).alias("timestamp"), low_hex(F.col("user_id") % 7 + 1).alias("contract_address"),
        F.col("event_type").alias("event_name"), F.lit("ACCEPTED_ON_L2").alias("status"), low_hex(F.col("user_id")).alias("account"),
        F.round(F.col("value") * 100).cast("bigint").alias("amount_cents"), F.col("value").alias("amount"), F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.concat(F.lit("c"), (F.col("user_id") % 7 + 1).cast("string")).alias("contract_name"),
    )
    order = Window.partitionBy("block_number").orderBy("event_id")
    rows = rows.withColumn("log_index", (F.row_number().over(order) - 1).cast("bigint"))
    return rows.select(*LOG_COLUMNS, *(["event_id", "contract_name"] if extra else []))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as raw events: keys [selector, account], data [amount_cents, k]."""
    rows = log(spark, sf_dir, extra=True)
    selectors = F.create_map(*(F.lit(x) for e in EVENTS for x in (e, selector(e))))
    as_felt = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    return rows.select(
        "block_number", as_felt(F.col("block_number") * 100).alias("block_hash"), "transaction_hash", "contract_address", "timestamp",
        F.array(selectors[F.col("event_name")], F.col("account")).alias("keys"), F.array(as_felt("amount_cents"), as_felt("k")).alias("data"),
        F.when(F.col("event_id") % 2 == 0, F.lit("ACCEPTED_ON_L2")).otherwise(F.lit("")).alias("finality_status"), F.col("event_id").alias("event_seq"), "event_name", "contract_name",
    )


def abi_text(data: list[tuple[str, str]] | None = None, events: list[str] = EVENTS) -> str:
    """An interface whose events have the key account and these data members."""
    members = [{"name": "account", "type": "core::starknet::contract_address::ContractAddress", "kind": "key"}]
    members += [{"name": n, "type": t, "kind": "data"} for n, t in data or [("amount_cents", "core::integer::u64"), ("k", "core::integer::u8")]]
    entries = [{"type": "event", "name": f"shop::Shop::{e}", "kind": "struct", "members": members} for e in events]
    entries.append({"type": "function", "name": "balance", "state_mutability": "view", "inputs": [], "outputs": [{"type": "core::integer::u64"}]})
    return json.dumps(entries)


def catalog(spark: SparkSession, data: list[tuple[str, str]] | None = None, more: str = "[]") -> DataFrame:
    text = json.dumps(json.loads(abi_text(data)) + json.loads(more))
    return checked(abi_catalog(abi_entries(config_table(spark, [("shop", text)], "abi_name string, text string"))))


def contracts(spark: SparkSession) -> DataFrame:
    """Seven contracts; the odd ones have a start block."""
    rows = [(f"c{i}", f"0x{i}", "shop", 473_400 + i if i % 2 else None, "f" if i < 4 else None, {"k": str(10 * i), "peer": f"0x{i % 7 + 1}"}, i < 4) for i in range(1, 8)]
    return config_table(spark, rows, "contract_name string, contract_address string, abi_name string, start_block bigint, factory_name string, factory_meta map<string,string>, dynamic boolean")


CONTRACTS_SQL = "SELECT 'c' || i AS contract_name, '0x' || i AS contract_address, CASE WHEN i % 2 = 1 THEN 473400 + i END AS start_block, CASE WHEN i < 4 THEN 'f' END AS factory_name, 10 * i AS k, '0x' || (i % 7 + 1) AS peer, i < 4 AS dynamic FROM (SELECT CAST(unnest(range(1, 8)) AS BIGINT) AS i)"


def rules(spark: SparkSession) -> DataFrame:
    return config_table(spark, [(f"c{i}", "*", "log", "") for i in range(1, 8)] + [("c1", "purchase", "unique", "account"), ("c2", "missing", "log", "")], "contract_name string, event_name string, table_type string, unique_key string")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading of 'balance' for each row of the log."""
    rows = log(spark, sf_dir)
    return rows.select("contract_address", F.lit("balance").alias("function"), "block_number", (F.col("timestamp") + F.col("log_index")).alias("ts"), F.array(F.concat(F.lit("0x"), F.lower(F.hex("amount_cents")))).alias("result"))


READINGS_SQL = "SELECT contract_address, 'balance' AS \"function\", block_number, \"timestamp\" + log_index AS ts, '0x' || lower(to_hex(amount_cents)) AS result FROM L"


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows inserted, every tenth updated, every 17th deleted, in this order."""
    rows = log(spark, sf_dir, extra=True)
    data = F.struct("account", "amount_cents")
    raised = F.struct("account", (F.col("amount_cents") + 1).alias("amount_cents"))
    none = F.lit(None).cast("struct<account:string,amount_cents:bigint>")
    base = ["block_number", "log_index"]
    tenth, last = F.col("event_id") % 10 == 0, F.when(F.col("event_id") % 10 == 0, raised).otherwise(data)
    inserts = rows.select(*base, F.lit("insert").alias("op"), F.col("event_id").alias("op_seq"), data.alias("data"), none.alias("prev"))
    updates = rows.where(tenth).select(*base, F.lit("update").alias("op"), (F.col("event_id") + 10**9).alias("op_seq"), raised.alias("data"), data.alias("prev"))
    deletes = rows.where("event_id % 17 = 0").select(*base, F.lit("delete").alias("op"), (F.col("event_id") + 2 * 10**9).alias("op_seq"), none.alias("data"), last.alias("prev"))
    return inserts.unionByName(updates).unionByName(deletes)
