"""Queries over the supplied tables, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import felt
from ..operators import changelog as ch
from ..operators import decode, lifecycle, query, registry, tables, views
from ..schemas import Aggregate, Filter, Query
from ..sources import abi
from ..sources import events as src
from ..sources.config import config_table
from ..streaming import stateful, stored, streams
from . import adapters as ad

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LOG = "block_number, log_index, transaction_hash, \"timestamp\", contract_address, event_name, status, account, amount_cents, amount, k"
AGGS = [Aggregate("total", "sum", "amount_cents"), Aggregate("n", "count", "amount_cents"), Aggregate("mean", "avg", "amount_cents")]
AGG_SQL = "SUM(CAST(amount_cents AS DOUBLE)) AS total, COUNT(*) AS n, ROUND(SUM(CAST(amount_cents AS DOUBLE)) / COUNT(*), 4) AS mean"
TIP = 474_000  # a block near the end of the supplied month
REORG = (473_900, 473_923)
REORGS = [(*REORG, 1), (473_500, 473_510, 2), (10, 5, 3)]


def add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None, log: bool = True) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = f"WITH L AS ({ad.LOG_SQL}) {sql}" if log else sql


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("mean", F.round("mean", 4))


def on_log(f: Callable[[DataFrame], DataFrame], extra: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: f(ad.log(s, d, extra))


# Lists, filters, order and pages.
FLAGSHIP = Query((Filter("event_name", "eq", "purchase"), Filter("amount", "gte", 10)))
add("list_flagship", on_log(lambda L: query.listed(L, FLAGSHIP)), f"SELECT {LOG} FROM L WHERE event_name = 'purchase' AND amount >= 10 ORDER BY block_number DESC, log_index DESC LIMIT 50")
add("list_page", on_log(lambda L: query.listed(L, Query(offset=100))), f"SELECT {LOG} FROM L ORDER BY block_number DESC, log_index DESC LIMIT 50 OFFSET 100")
for op, sign in (("eq", "="), ("neq", "<>"), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    add(f"filter_{op}", on_log(lambda L, op=op: query.filtered(L, [Filter("k", op, "42")])), f"SELECT {LOG} FROM L WHERE k {sign} 42")
add("filter_all_of", on_log(lambda L: query.filtered(L, [Filter("k", "gte", 10), Filter("k", "lt", 20), Filter("event_name", "neq", "view")])), f"SELECT {LOG} FROM L WHERE k >= 10 AND k < 20 AND event_name <> 'view'")
add("filter_text_number", on_log(lambda L: query.filtered(L.withColumn("big", F.concat(F.col("amount_cents").cast("string"), F.lit("000000000000000000000000000000"))), [Filter("big", "gte", "1" + "0" * 33)]).drop("big")), f"SELECT {LOG} FROM L WHERE amount_cents >= 1000")
add("order_ascending", on_log(lambda L: query.listed(L, Query(order="k", descending=False, limit=200)).select("k", "log_index")), "SELECT k, log_index FROM L ORDER BY k, log_index LIMIT 200")
add("page_past_end", on_log(lambda L: query.listed(L, Query(offset=max(150_000, L.count())))), f"SELECT {LOG} FROM L LIMIT 0")
add("latest_event", on_log(query.latest_event), f"SELECT {LOG} FROM L ORDER BY block_number DESC, log_index DESC LIMIT 1")
add("count_filtered", on_log(lambda L: query.counted(L, [Filter("event_name", "eq", "click")])), "SELECT COUNT(*) AS \"count\" FROM L WHERE event_name = 'click'")
add("contract_filter", on_log(lambda L: query.of_contract(L, "0x3")), f"SELECT {LOG} FROM L WHERE contract_address = '0x3'")
add("replay_after", on_log(lambda L: query.after_event(L, TIP - 50, 3)), f"SELECT {LOG} FROM L WHERE (block_number, log_index) > ({TIP - 50}, 3)")

# Unique and aggregation tables.
NEWEST = "row_number() OVER (PARTITION BY {keys} ORDER BY block_number DESC, log_index DESC) = 1"
add("unique_latest", on_log(lambda L: tables.latest(L, "account")), f"SELECT {LOG} FROM L QUALIFY {NEWEST.format(keys='account')}")
add("unique_shared", on_log(lambda L: tables.latest_shared(L, "event_name")), f"SELECT {LOG} FROM L QUALIFY {NEWEST.format(keys='contract_address, event_name')}")
add("unique_filtered", on_log(lambda L: query.unique_query(L, ["account"], Query((Filter("event_name", "eq", "view"),), limit=None))), f"SELECT * FROM (SELECT {LOG} FROM L QUALIFY {NEWEST.format(keys='account')}) WHERE event_name = 'view'")
add("agg_totals", on_log(lambda L: rounded(query.aggregate_query(L, AGGS))), f"SELECT {AGG_SQL} FROM L")
add("agg_per_contract", on_log(lambda L: rounded(tables.totals(L, AGGS, by=["contract_address"]))), f"SELECT contract_address, {AGG_SQL} FROM L GROUP BY contract_address")
add("agg_missing_as_zero", on_log(lambda L: tables.totals(L.withColumn("x", F.when(F.col("k") > 50, F.col("k").cast("string")).otherwise(F.lit("n/a"))), [Aggregate("total", "sum", "x"), Aggregate("n", "count", "x")])), "SELECT SUM(CASE WHEN k > 50 THEN CAST(k AS DOUBLE) ELSE 0 END) AS total, COUNT(*) AS n FROM L")


def _delta(s: SparkSession, d: str) -> DataFrame:
    changes = ad.changelog(s, d).select("op", F.coalesce("data", "prev").alias("r"), "block_number").select("op", "r.amount_cents", "block_number")
    halves = [tables.deltas(changes.where(c), AGGS) for c in ("block_number % 2 = 0", "block_number % 2 = 1")]
    return rounded(tables.merged_deltas(halves[0].unionByName(halves[1]), AGGS))


GONE = "CASE WHEN event_id % 17 = 0 THEN amount_cents + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END ELSE 0 END"
add("agg_delta", _delta, f"SELECT CAST(SUM(amount_cents) - SUM({GONE}) AS DOUBLE) AS total, CAST(COUNT(*) FILTER (WHERE event_id % 17 <> 0) AS BIGINT) AS n, ROUND(CAST(SUM(amount_cents) - SUM({GONE}) AS DOUBLE) / COUNT(*) FILTER (WHERE event_id % 17 <> 0), 4) AS mean FROM L")
add("exact_sum", on_log(lambda L: tables.exact_sum(L.select(F.concat(F.col("amount_cents").cast("string"), F.lit("000000000000000000"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("v")), "v")), "SELECT CAST(SUM(CAST(amount_cents AS HUGEINT) * 100000000000000000000 + k) AS VARCHAR) AS total FROM L")
add("log_index", lambda s, d: decode.with_log_index(ad.raw_events(s, d)).select("block_number", "event_seq", "log_index"), "SELECT block_number, event_id AS event_seq, log_index FROM L")
add("status_default", lambda s, d: ad.raw_events(s, d).select("event_seq", decode.status_or_default(F.col("finality_status")).alias("status")), "SELECT event_id AS event_seq, 'ACCEPTED_ON_L2' AS status FROM L")
add("json_text", on_log(lambda L: decode.as_text(L.select("transaction_hash", F.struct("k", "account").alias("pair"), F.when(F.col("k") > 50, F.col("k")).alias("maybe")))), "SELECT transaction_hash, '{\"k\":' || k || ',\"account\":\"' || account || '\"}' AS pair, CASE WHEN k > 50 THEN CAST(k AS VARCHAR) ELSE '' END AS maybe FROM L")
add("cast_columns", on_log(lambda L: decode.cast_columns(L.select("transaction_hash", F.col("k").cast("string").alias("k"), F.when(F.col("k") > 50, "true").otherwise("no").alias("flag")), {"k": "bigint", "flag": "boolean"})), "SELECT transaction_hash, k, k > 50 AS flag FROM L")
add("migrate_union", on_log(lambda L: tables.migrated(L.where("k < 50").select("transaction_hash", "k"), L.where("k >= 50").select("transaction_hash", "account"))), "SELECT transaction_hash, k, NULL::VARCHAR AS account FROM L WHERE k < 50 UNION ALL SELECT transaction_hash, NULL, account FROM L WHERE k >= 50")
add("shared_table", lambda s, d: tables.shared_rows(ad.log(s, d), ad.contracts(s).where("factory_name IS NOT NULL")).select("contract_name", "contract_address", "transaction_hash"), "SELECT contract_name, contract_address, transaction_hash FROM L WHERE contract_name IN ('c1', 'c2', 'c3')")


def _wildcard(s: SparkSession, d: str) -> DataFrame:
    """The rules met by events: rows of each contract and event with the rule's table type."""
    rules = tables.expanded_rules(ad.rules(s), ad.catalog(s), ad.contracts(s))
    return ad.log(s, d, extra=True).join(rules, ["contract_name", "event_name"]).groupBy("contract_name", "event_name", "table_type", "unique_key").agg(F.count(F.lit(1)).alias("n"))


add("wildcard_rules", _wildcard, "SELECT contract_name, event_name, CASE WHEN contract_name = 'c1' AND event_name = 'purchase' THEN 'unique' ELSE 'log' END AS table_type, CASE WHEN contract_name = 'c1' AND event_name = 'purchase' THEN 'account' ELSE '' END AS unique_key, COUNT(*) AS n FROM L GROUP BY ALL")

# Changes, confirmation and undone ranges.
FINAL = "SELECT block_number, log_index, account, amount_cents + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS amount_cents FROM L WHERE event_id % 17 <> 0"
add("apply_changelog", lambda s, d: ch.applied(ad.changelog(s, d)), FINAL)
add("revert_changelog", lambda s, d: ch.applied(ch.reverted(ad.changelog(s, d), F.col("op") != "insert")), "SELECT block_number, log_index, account, amount_cents FROM L")
add("inverse_changes", lambda s, d: ch.inverse(ad.changelog(s, d)).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("data.amount_cents").alias("amount")), "SELECT 'delete' AS op, COUNT(*) AS n, CAST(NULL AS BIGINT) AS amount FROM L UNION ALL SELECT 'update', COUNT(*), CAST(SUM(amount_cents) AS BIGINT) FROM L WHERE event_id % 10 = 0 UNION ALL SELECT 'insert', COUNT(*), CAST(SUM(amount_cents + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) FROM L WHERE event_id % 17 = 0")
add("partial_update", on_log(lambda L: ch.partly_updated(L.select("block_number", "log_index", "account", "k"), L.where("k % 5 = 0").select("block_number", "log_index", (F.col("k") + 1000).alias("k")))), "SELECT block_number, log_index, account, CASE WHEN k % 5 = 0 THEN k + 1000 ELSE k END AS k FROM L")
add("confirmed_split", on_log(ch.confirmed), f"SELECT {LOG} FROM L WHERE block_number <= (SELECT max(block_number) - 10 FROM L)")
add("pending_rows", on_log(lambda L: ch.pending(L, TIP - 100)), f"SELECT {LOG} FROM L WHERE block_number > {TIP - 100}")


def _reorgs(s: SparkSession) -> DataFrame:
    return config_table(s, REORGS, "start_block bigint, end_block bigint, seq bigint")


KEPT = f"block_number NOT BETWEEN {REORG[0]} AND {REORG[1]} AND block_number NOT BETWEEN 473500 AND 473510"
add("reorg_log", lambda s, d: ch.surviving(ad.log(s, d), _reorgs(s)), f"SELECT {LOG} FROM L WHERE {KEPT}")
add("reorg_unique", lambda s, d: tables.latest(ch.surviving(ad.log(s, d), _reorgs(s)), "account"), f"SELECT {LOG} FROM L WHERE {KEPT} QUALIFY {NEWEST.format(keys='account')}")
add("reorg_agg", lambda s, d: rounded(tables.totals(ch.surviving(ad.log(s, d), _reorgs(s)), AGGS)), f"SELECT {AGG_SQL} FROM L WHERE {KEPT}")


def _redelivered(s: SparkSession, d: str) -> DataFrame:
    rows = ad.log(s, d).withColumn("ingest_seq", F.lit(0).cast("bigint"))
    again = rows.where(F.col("block_number").between(*REORG)).withColumns({"ingest_seq": F.lit(1).cast("bigint"), "k": F.col("k") + 500})
    return ch.surviving(rows.unionByName(again), _reorgs(s)).drop("ingest_seq")


add("redelivery", _redelivered, f"SELECT {LOG.replace(', k', '')}, CASE WHEN block_number BETWEEN {REORG[0]} AND {REORG[1]} THEN k + 500 ELSE k END AS k FROM L WHERE block_number NOT BETWEEN 473500 AND 473510")
CURSORS = "SELECT contract_name, max(block_number) AS last_block FROM L GROUP BY contract_name"
add("cursors", on_log(query.cursors, True), CURSORS)
add("reorg_cursors", lambda s, d: ch.reset_cursors(query.cursors(ad.log(s, d, True)), 473_500), f"SELECT contract_name, CASE WHEN last_block >= 473500 THEN CAST(473499 AS BIGINT) ELSE last_block END AS last_block FROM ({CURSORS})")


def _reorg_registry(s: SparkSession, d: str) -> DataFrame:
    children = _children(s, d)
    return ch.surviving_contracts(children, _reorgs(s)).select("contract_name", "start_block")


# Sources.
RAW = "event_id AS event_seq, block_number"
raw = lambda s, d: ad.raw_events(s, d)
pick = lambda df: df.select("event_seq", "block_number")
add("block_range_scan", lambda s, d: pick(src.block_range(raw(s, d), 473_400, 473_500, "0x2")), f"SELECT {RAW} FROM L WHERE block_number BETWEEN 473400 AND 473500 AND contract_address = '0x2'")
add("key_filter", lambda s, d: pick(src.block_range(raw(s, d), 0, 10**9, keys=[[ad.selector("view"), ad.selector("click")], []])), f"SELECT {RAW} FROM L WHERE event_name IN ('view', 'click')")
add("tracked_semijoin", lambda s, d: pick(src.tracked_only(raw(s, d), ad.contracts(s).where("contract_name IN ('c1', 'c5')"))), f"SELECT {RAW} FROM L WHERE contract_name IN ('c1', 'c5')")
add("backfill", lambda s, d: src.backfill(raw(s, d), ad.contracts(s), 473_600).select("event_seq", "block_number", "is_catchup"), f", C AS ({ad.CONTRACTS_SQL}) SELECT {RAW}, true AS is_catchup FROM L JOIN C USING (contract_name) WHERE block_number BETWEEN coalesce(start_block, 0) AND 473600")
add("catchup_flag", lambda s, d: src.with_catchup(raw(s, d), TIP).select("event_seq", "is_catchup"), f"SELECT event_id AS event_seq, block_number + 50 < {TIP} AS is_catchup FROM L")
add("backfill_live_split", lambda s, d: pick(src.history_and_live(raw(s, d), raw(s, d), TIP - 100, 473_450)), f"SELECT {RAW} FROM L WHERE block_number >= 473450")
add("stream_union", lambda s, d: pick(src.partitioned_union(raw(s, d), [F.col("event_name") == "view", F.col("contract_address") == "0x1", F.lit(True)])), f"SELECT {RAW} FROM L")
add("resume_guard", lambda s, d: pick(src.from_cursor(raw(s, d), query.cursors(ad.log(s, d, True).where("contract_name <> 'c7'")).withColumn("last_block", F.col("last_block") - 20), "contract_name")), f", C AS (SELECT contract_name, max(block_number) - 20 AS last_block FROM L WHERE contract_name <> 'c7' GROUP BY contract_name) SELECT {RAW} FROM L LEFT JOIN C USING (contract_name) WHERE block_number >= coalesce(last_block, 0)")
add("exact_dedup", lambda s, d: pick(src.exact_dedup(raw(s, d).unionByName(raw(s, d).where("event_seq % 4 = 0")))), f"SELECT {RAW} FROM L")
add("timestamp_enrich", lambda s, d: src.with_timestamps(raw(s, d).drop("timestamp"), ad.log(s, d).where("block_number % 5 <> 0").select("block_number", "timestamp").distinct()).select("event_seq", "timestamp"), "SELECT event_id AS event_seq, CASE WHEN block_number % 5 <> 0 THEN \"timestamp\" ELSE 0 END AS \"timestamp\" FROM L")

# Decoding.


def _decode(s: SparkSession, d: str) -> DataFrame:
    interfaces = ad.catalog(s)
    wide, _, events = decode.decode_wide(raw(s, d).drop("event_name", "contract_name"), ad.contracts(s), interfaces, tables.expanded_rules(ad.rules(s), interfaces, ad.contracts(s)))
    member = lambda m: F.coalesce(*(F.col(f"`{e}`.`{m}`") for e in events))
    return wide.select(*decode.METADATA, "contract_name", member("account").alias("account"), member("amount_cents").cast("bigint").alias("amount_cents"), member("k").alias("k"))


add("decode_events", _decode, "SELECT block_number, transaction_hash, log_index, \"timestamp\", contract_address, event_name, status, contract_name, account, amount_cents, k FROM L")


def _quarantine(s: SparkSession, d: str) -> DataFrame:
    _, failed = decode.decode_events(raw(s, d).drop("event_name", "contract_name"), ad.contracts(s), ad.catalog(s, [("amount_cents", "u8"), ("k", "u8")]), ad.rules(s).select("contract_name", F.explode(F.array(*map(F.lit, ad.EVENTS))).alias("event_name")).distinct())
    return failed.select("event_seq", "decode_error")


add("quarantine", _quarantine, "SELECT event_id AS event_seq, 'value out of range for u8' AS decode_error FROM L WHERE amount_cents > 255")


def _typed(data: list[tuple[str, str]], build: Callable[[], object], more: str = "[]") -> Callable[[SparkSession, str], DataFrame]:
    """Decodes rows whose data are rebuilt from the log's columns."""

    def run(s: SparkSession, d: str) -> DataFrame:
        catalog = ad.catalog(s, data, more)
        kinds = decode.kinds_of(catalog, decode._types(catalog))["shop", "view"]
        rows = ad.log(s, d, True).select("event_id", F.array(F.lit("0x0"), F.col("account")).alias("keys"), build().alias("data"))
        return decode.decoded(rows, kinds).drop("keys", "data", "account")

    return run


low = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
add("decode_u64", _typed([("v", "u64")], lambda: F.array(low(F.col("amount_cents")))), "SELECT event_id, CAST(amount_cents AS DECIMAL(20,0)) AS v, NULL::VARCHAR AS decode_error FROM L")
add("decode_i32", _typed([("v", "i32")], lambda: F.array(low(F.when(F.col("k") > 50, F.lit(2**32) - F.col("k")).otherwise(F.col("k"))))), "SELECT event_id, CASE WHEN k > 50 THEN -k ELSE k END AS v, NULL::VARCHAR AS decode_error FROM L")
add("decode_bool", _typed([("v", "bool")], lambda: F.array(low(F.col("k") % 2))), "SELECT event_id, k % 2 = 1 AS v, NULL::VARCHAR AS decode_error FROM L")
for bits in (8, 16, 64):  # k, negative above 50
    value = "CASE WHEN k > 50 THEN -k ELSE k END"
    add(f"decode_i{bits}", _typed([("v", f"i{bits}")], lambda bits=bits: F.array(F.when(F.col("k") > 50, F.concat(F.lit("0x"), F.right(low(-F.col("k")), F.lit(bits // 4)))).otherwise(low(F.col("k"))))), f"SELECT event_id, {value} AS v, NULL::VARCHAR AS decode_error FROM L")
add("decode_i128", _typed([("v", "i128")], lambda: F.array(F.when(F.col("k") > 50, F.concat(F.lit("0x"), F.repeat(F.lit("f"), 16), F.substring(low(-F.col("k")), 3, 16))).otherwise(F.concat(low(F.col("k")), F.lit("0000000000000000"))))), "SELECT event_id, CAST(CASE WHEN k > 50 THEN CAST(-k AS HUGEINT) ELSE CAST(k AS HUGEINT) * 18446744073709551616 END AS VARCHAR) AS v, NULL::VARCHAR AS decode_error FROM L")
# 2**128 = 34028236692093846346 * 10**19 + 3374607431768211456.
add("decode_u256", _typed([("v", "u256")], lambda: F.array(low(F.col("amount_cents")), low(F.col("k")))), ", P AS (SELECT event_id, CAST(k AS HUGEINT) * 3374607431768211456 + amount_cents AS low, CAST(k AS HUGEINT) * 34028236692093846346 AS high FROM L) SELECT event_id, CASE WHEN high + low // 10000000000000000000 = 0 THEN CAST(low AS VARCHAR) ELSE CAST(high + low // 10000000000000000000 AS VARCHAR) || lpad(CAST(low % 10000000000000000000 AS VARCHAR), 19, '0') END AS v, NULL::VARCHAR AS decode_error FROM P")
_array = _typed([("v", "core::array::Array::<u64>")], lambda: F.concat(F.array(low(F.col("k") % 3)), F.slice(F.array(low(F.col("k")), low(F.col("amount_cents"))), F.lit(1), (F.col("k") % 3).cast("int"))))
add("decode_array", lambda s, d: _array(s, d).withColumn("v", F.col("v").cast("string")), "SELECT event_id, CAST(CASE k % 3 WHEN 0 THEN [] WHEN 1 THEN [k] ELSE [k, amount_cents] END AS VARCHAR) AS v, NULL::VARCHAR AS decode_error FROM L")
add("decode_array_size", lambda s, d: _array(s, d).select("event_id", F.size("v").cast("bigint").alias("n"), F.array_max("v").cast("bigint").alias("most")), "SELECT event_id, k % 3 AS n, CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN k ELSE greatest(k, amount_cents) END AS most FROM L")
_enum = _typed([("v", "Choice")], lambda: F.array(low(F.col("k") % 2), low(F.col("k"))), '[{"type": "enum", "name": "Choice", "variants": [{"name": "None", "type": "()"}, {"name": "Some", "type": "u8"}]}]')
add("decode_enum", lambda s, d: _enum(s, d).withColumn("v", F.to_json("v")), "SELECT event_id, CASE WHEN k % 2 = 1 THEN '{\"variant\":\"Some\",\"value\":\"' || k || '\"}' ELSE '{\"variant\":\"None\"}' END AS v, NULL::VARCHAR AS decode_error FROM L")
add("decode_enum_parts", lambda s, d: _enum(s, d).select("event_id", "v.variant", "v.value"), "SELECT event_id, CASE WHEN k % 2 = 1 THEN 'Some' ELSE 'None' END AS variant, CASE WHEN k % 2 = 1 THEN CAST(k AS VARCHAR) END AS value FROM L")
add("decode_struct", lambda s, d: _typed([("v", "(u64, bool)")], lambda: F.array(low(F.col("amount_cents")), low(F.col("k"))))(s, d).select("event_id", F.col("v.`0`").cast("bigint").alias("a"), F.col("v.`1`").alias("b")), "SELECT event_id, amount_cents AS a, k <> 0 AS b FROM L")
add("decode_u128_text", _typed([("v", "u128")], lambda: F.array(F.concat(low(F.col("amount_cents")), F.lit("000000000000")))), "SELECT event_id, CAST(CAST(amount_cents AS HUGEINT) * 281474976710656 AS VARCHAR) AS v, NULL::VARCHAR AS decode_error FROM L")
add("decode_u256_limbs", lambda s, d: ad.log(s, d, True).select("event_id", felt.limb(F.concat(low(F.col("k")), F.lpad(F.substring(low(F.col("amount_cents")), 3, 16), 16, "0")), 0).cast("bigint").alias("low"), felt.limb(F.concat(low(F.col("k")), F.lpad(F.substring(low(F.col("amount_cents")), 3, 16), 16, "0")), 1).cast("bigint").alias("high")), "SELECT event_id, amount_cents AS low, k AS high FROM L")


def _byte_array(s: SparkSession, d: str) -> DataFrame:
    """Whole texts of the benchmark as byte arrays of 31-byte chunks, decoded again."""
    items = s.read.parquet(f"{d}/benchmark.parquet")
    h = F.lower(F.hex(F.encode("text", "UTF-8")))
    n = (F.floor(F.length(h) / 62)).cast("int")
    chunks = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("0x"), F.substring(h, i * 62 + 1, F.lit(62))))
    rest = F.substring(h, n * 62 + 1, F.lit(62))
    data = F.concat(F.array(low(n)), chunks, F.array(F.concat(F.lit("0x"), F.when(rest == "", "0").otherwise(rest)), low(F.length(rest) / 2)))
    return decode.decoded(items.select("item_id", data.alias("data"), F.array().cast("array<string>").alias("keys")), [("data", "text", felt.Kind("bytes"))]).select("item_id", "text")


add("decode_byte_array", _byte_array, "SELECT item_id, text FROM benchmark", log=False)
add("decode_view", lambda s, d: decode.decode_results(ad.readings(s, d), [("output", "balance", felt.Kind("u64"))]).select("contract_address", "ts", F.col("balance").cast("bigint").alias("balance")), "SELECT contract_address, \"timestamp\" + log_index AS ts, amount_cents AS balance FROM L")

# Registry, status and lifecycle.


def _children(s: SparkSession, d: str) -> DataFrame:
    rows = ad.log(s, d).select("block_number", "log_index", "event_name", "account", "k", "contract_address")
    return registry.first_registrations(registry.children(rows, "f", "signup", "account", "shop"))


CHILD = ", N AS (SELECT 'f_' || right(regexp_replace(account, '^0x', ''), 8) AS contract_name, account AS contract_address, block_number AS start_block, k, row_number() OVER (PARTITION BY account ORDER BY block_number, log_index) AS r FROM L WHERE event_name = 'signup'), CH AS (SELECT * FROM N WHERE r = 1)"
add("child_names", lambda s, d: _children(s, d).select("contract_name", "contract_address", "start_block", F.col("factory_meta")["k"].cast("bigint").alias("k")), f"{CHILD} SELECT contract_name, contract_address, start_block, k FROM CH")
none_yet = lambda s: config_table(s, [], "contract_name string, last_block bigint")
add("children_list", lambda s, d: registry.children_list(_children(s, d), none_yet(s), "f", ["k"], query=Query(order="contract_name", limit=100)), f"{CHILD} SELECT contract_name, contract_address, start_block AS deployment_block, CAST(0 AS BIGINT) AS last_block, CAST(k AS VARCHAR) AS k FROM CH ORDER BY contract_name DESC LIMIT 100")
add("children_count", lambda s, d: registry.children_count(_children(s, d), "f", {"k": "7"}), f"{CHILD} SELECT COUNT(*) AS \"count\" FROM CH WHERE k = 7")
add("child_events", lambda s, d: registry.child_events(ad.log(s, d).select(F.col("account").alias("contract_address"), "block_number", "transaction_hash"), _children(s, d)).select("contract_name", "transaction_hash"), f"{CHILD} SELECT contract_name, transaction_hash FROM L JOIN CH ON L.account = CH.contract_address WHERE block_number >= start_block".replace("SELECT contract_name, transaction_hash", "SELECT CH.contract_name, transaction_hash"))
add("reorg_registry", _reorg_registry, f"{CHILD} SELECT contract_name, start_block FROM CH WHERE {KEPT.replace('block_number', 'start_block')}")


def _deployer(s: SparkSession, d: str) -> DataFrame:
    rows = ad.log(s, d, True).where("event_name = 'signup'")
    hash_ = low(F.col("k") % 4)
    v1 = F.struct(F.array(F.lit("0x1"), F.col("account"), F.lit("0x0"), F.lit("0x0")).alias("keys"), F.array(hash_, F.lit("0x0")).alias("data"))
    v0 = F.struct(F.array(F.lit("0x1")).alias("keys"), F.array(F.col("account"), F.lit("0x0"), F.lit("0x0"), hash_).alias("data"))
    return rows.select("block_number", F.col("event_id").alias("event_seq"), F.when(F.col("event_id") % 2 == 0, v1).otherwise(v0).alias("e")).select("block_number", "event_seq", "e.keys", "e.data")


def _discovered(s: SparkSession, d: str) -> DataFrame:
    watched = config_table(s, [("0x1", "pool", "shop", True), ("0x2", "vault", "shop", False)], "class_hash string, group string, abi_name string, shared boolean")
    return registry.discovered(registry.deployments(_deployer(s, d)), watched, "{group}_{address_short}")


add("discovery_layout", lambda s, d: registry.deployments(_deployer(s, d)), "SELECT block_number, event_id AS event_seq, account AS contract_address, '0x' || (k % 4) AS class_hash FROM L WHERE event_name = 'signup'")
DISCOVERED = "SELECT CASE k % 4 WHEN 1 THEN 'pool' ELSE 'vault' END || '_' || right(regexp_replace(account, '^0x', ''), 8) AS contract_name, account AS contract_address, 'shop' AS abi_name, block_number AS start_block, event_id AS log_index, CASE k % 4 WHEN 1 THEN 'shop' END AS factory_name, '0x' || (k % 4) AS class_hash, k % 4 = 1 AS shared, true AS dynamic FROM L WHERE event_name = 'signup' AND k % 4 IN (1, 2)"
add("discovered", _discovered, DISCOVERED)
add("discovered_default_names", lambda s, d: registry.discovered(registry.deployments(_deployer(s, d)), config_table(s, [("0x1", "", "shop", False)], "class_hash string, group string, abi_name string, shared boolean")).select("contract_name", "contract_address"), "SELECT '1_' || right(regexp_replace(account, '^0x', ''), 8) AS contract_name, account AS contract_address FROM L WHERE event_name = 'signup' AND k % 4 = 1")
# The deployer's address (v1 keys[2] is 0x0) and the class hash from the places given, whatever the shape.
add("discovery_layout_places", lambda s, d: registry.deployments(_deployer(s, d), address_key=2, address_data=1, class_hash_data=0), "SELECT block_number, event_id AS event_seq, '0x0' AS contract_address, CASE WHEN event_id % 2 = 0 THEN '0x' || (k % 4) ELSE account END AS class_hash FROM L WHERE event_name = 'signup'")
add("discovered_by_class", lambda s, d: registry.of_class(registry.first_registrations(_discovered(s, d)), "0x1", none_yet(s)).select("contract_name", "start_block", "last_block"), f", D AS ({DISCOVERED}) SELECT contract_name, start_block, CAST(NULL AS BIGINT) AS last_block FROM D QUALIFY row_number() OVER (PARTITION BY contract_name ORDER BY start_block, log_index) = 1 AND class_hash = '0x1'")
add("merge_contracts", lambda s, d: registry.merged(_children(s, d).where("start_block < 473600").select("contract_name", "start_block"), _children(s, d).select("contract_name", "start_block", F.lit(True).alias("stored"))), f"{CHILD} SELECT contract_name, start_block, CASE WHEN start_block >= 473600 THEN true END AS stored FROM CH")


def _resync(s: SparkSession, d: str) -> DataFrame:
    rules = config_table(s, [("f", "shop", "own"), ("a", "other", "any")], "factory_name string, abi_name string, events string")
    kids = _children(s, d).withColumn("abi_name", F.when(F.col("start_block") % 2 == 0, F.lit("other")).otherwise(F.col("abi_name")))
    return registry.resynced(kids, rules).select("contract_name", "events")


add("resync_children", _resync, f"{CHILD} SELECT contract_name, CASE WHEN start_block % 2 = 0 THEN 'any' ELSE 'own' END AS events FROM CH")
add("start_blocks", lambda s, d: query.start_blocks(ad.contracts(s), query.cursors(ad.log(s, d, True).where("contract_name NOT IN ('c6', 'c7')")), TIP), f", C AS ({ad.CONTRACTS_SQL}), K AS ({CURSORS}) SELECT contract_name, CAST(CASE WHEN contract_name = 'c6' THEN {TIP} WHEN contract_name = 'c7' THEN start_block ELSE greatest(coalesce(start_block, 0), last_block + 1) END AS BIGINT) AS start FROM C JOIN K USING (contract_name)")
add("sync_status", lambda s, d: query.sync_status(ad.contracts(s), query.cursors(ad.log(s, d, True).where("contract_name <> 'c2'"))), f", K AS (SELECT * FROM ({CURSORS}) WHERE contract_name <> 'c2') SELECT 'f' AS factory_name, min(last_block) AS global_block, CAST(3 AS BIGINT) AS children, CAST(2 AS BIGINT) AS synced, CAST(1 AS BIGINT) AS backfilling FROM K")
add("contract_list", lambda s, d: query.contract_list(ad.contracts(s).select("contract_name", "contract_address"), query.cursors(ad.log(s, d, True).where("contract_name <> 'c2'"))), f", C AS ({ad.CONTRACTS_SQL}), K AS ({CURSORS}) SELECT contract_name, contract_address, CASE WHEN contract_name = 'c2' THEN 0 ELSE last_block END AS last_block FROM C JOIN K USING (contract_name)")


def _rules(s: SparkSession) -> DataFrame:
    rows = [("c1", "local", "error", None, None, None, None), ("c2", "foreign", "error", "c3", None, None, None), ("c4", "sibling", "error", None, "peer", None, None), ("c5", "predicate", None, None, "k", "lte", "0x32"), ("c6", "predicate", None, None, "k", "gt", "now() - 2d"), ("c7", "predicate", None, None, "none", "eq", "70")]
    return config_table(s, rows, "contract_name string, kind string, event string, source string, meta_field string, op string, value string")


def _terminal(s: SparkSession, d: str) -> DataFrame:
    return ad.log(s, d, True).select("contract_name", "contract_address", "event_name", "block_number", "log_index")


def _first(name: str, emitter: str) -> str:
    return f"SELECT '{name}' AS contract_name, block_number AS frozen_at_block, log_index AS frozen_at_log FROM L WHERE contract_name = '{emitter}' AND event_name = 'error' QUALIFY row_number() OVER (ORDER BY block_number, log_index) = 1"




def _predicate_children(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    kids = _children(s, d)
    rules = kids.select("contract_name", F.lit("predicate").alias("kind"), F.lit("k").alias("meta_field"), F.lit("lt").alias("op"), F.lit("0x14").alias("value"))
    return kids, rules


add("freeze_predicate", lambda s, d: lifecycle.predicate_matches(*_predicate_children(s, d), 0), f"{CHILD} SELECT contract_name FROM CH WHERE k < 20")


def _fractions(s: SparkSession, d: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Contracts by transaction whose metadata is an amount with cents behind 40 digits, and the rule 'at most value'."""
    amount = F.concat(F.lit("1" * 40), F.lpad(F.col("amount_cents").cast("string"), 12, "0"))
    rows = ad.log(s, d).select(F.col("transaction_hash").alias("contract_name"), F.create_map(F.lit("amount"), F.concat(F.substring(amount, 1, 50), F.lit("."), F.substring(amount, 51, 2))).alias("factory_meta"))
    return rows, rows.select("contract_name", F.lit("predicate").alias("kind"), F.lit("amount").alias("meta_field"), F.lit("lte").alias("op"), F.lit(value).alias("value"))


# Amounts up to 123.45, as fractions of numbers beyond 38 digits.
add("freeze_fractions", lambda s, d: lifecycle.predicate_matches(*_fractions(s, d, "1" * 40 + "0000000123.450"), 0), "SELECT transaction_hash AS contract_name FROM L WHERE amount_cents <= 12345")
add("freeze_at_registration", lambda s, d: lifecycle.registered(*_predicate_children(s, d), 0).select("contract_name", "frozen"), f"{CHILD} SELECT contract_name, k < 20 AS frozen FROM CH")
add("freeze_coercion", on_log(lambda L: L.select("transaction_hash", felt.number_text(F.col("account")).cast("bigint").alias("n"))), "SELECT transaction_hash, CAST(('0x' || substring(account, 3)) AS BIGINT) AS n FROM L")
add("freeze_reconcile", lambda s, d: lifecycle.reconciled(_terminal(s, d), _rules(s), ad.contracts(s), 0).join(ad.log(s, d, True), "contract_name").groupBy("contract_name").agg(F.count(F.lit(1)).alias("n")), "SELECT contract_name, COUNT(*) AS n FROM L WHERE contract_name IN ('c1', 'c4', 'c5', 'c6') GROUP BY contract_name")

add("freeze_local", lambda s, d: lifecycle.local_triggers(_terminal(s, d), _rules(s)), _first("c1", "c1"))
add("freeze_foreign", lambda s, d: lifecycle.foreign_triggers(_terminal(s, d), _rules(s)), _first("c2", "c3"))
add("freeze_sibling", lambda s, d: lifecycle.sibling_triggers(_terminal(s, d), _rules(s), ad.contracts(s)), _first("c4", "c5"))
add("freeze_effect", lambda s, d: lifecycle.until_frozen(ad.log(s, d, True), lifecycle.local_triggers(_terminal(s, d), _rules(s))).select("transaction_hash"), f", T AS ({_first('c1', 'c1')}) SELECT transaction_hash FROM L LEFT JOIN T USING (contract_name) WHERE frozen_at_block IS NULL OR (block_number, log_index) <= (frozen_at_block, frozen_at_log)")
add("frozen_registry", lambda s, d: lifecycle.frozen_registry(ad.contracts(s), lifecycle.local_triggers(_terminal(s, d), _rules(s))).select("contract_name", "frozen", "frozen_at_block"), f", C AS ({ad.CONTRACTS_SQL}), T AS ({_first('c1', 'c1')}) SELECT contract_name, frozen_at_block IS NOT NULL AS frozen, frozen_at_block FROM C LEFT JOIN T USING (contract_name)")

# Views over time. Readings of one view may share a second: the highest result text decides, as in the SQL.
R = f", R AS ({ad.READINGS_SQL})"
first_of = lambda df: df.withColumn("result", F.element_at("result", 1))
add("view_interval", lambda s, d: first_of(views.interval_snapshots(ad.readings(s, d), 86400)), f"{R} SELECT contract_address, \"function\", ts // 86400 * 86400 AS tick, block_number, ts, result FROM R QUALIFY row_number() OVER (PARTITION BY contract_address, ts // 86400 ORDER BY ts DESC, block_number DESC, result DESC) = 1")
add("view_constant", lambda s, d: first_of(views.constant_snapshots(ad.readings(s, d))), f"{R} SELECT * FROM R QUALIFY row_number() OVER (PARTITION BY contract_address ORDER BY ts, block_number, result) = 1")
add("view_status", lambda s, d: query.view_status(ad.readings(s, d)), f"{R} SELECT contract_address, \"function\", max(block_number) AS last_block, max(ts) AS last_ts, COUNT(*) AS readings FROM R GROUP BY ALL")
add("view_table", lambda s, d: first_of(tables.view_table(ad.readings(s, d), "unique", shared=True)), f"{R} SELECT *, 'latest' AS _view_key FROM R QUALIFY row_number() OVER (PARTITION BY contract_address ORDER BY block_number DESC, ts DESC) = 1")


def _asked(s: SparkSession, d: str) -> DataFrame:
    rules = config_table(s, [("0x1", "balance", "error", None), ("0x2", "balance", "purchase", "0x3")], "contract_address string, function string, event string, source_address string")
    events = src.with_catchup(ad.log(s, d), TIP - 60).withColumn("timestamp", F.col("timestamp") + F.col("log_index"))
    return views.triggers(events, rules)


ASKED = f", A AS (SELECT DISTINCT CASE contract_address WHEN '0x1' THEN '0x1' ELSE '0x2' END AS contract_address, 'balance' AS \"function\", \"timestamp\" + log_index AS ts, block_number FROM L WHERE block_number + 50 >= {TIP - 60} AND ((contract_address = '0x1' AND event_name = 'error') OR (contract_address = '0x3' AND event_name = 'purchase')))"
add("view_triggers", _asked, f"{ASKED} SELECT * FROM A")
add("view_reactive", lambda s, d: views.readings_at(_asked(s, d), ad.readings(s, d)).select("contract_address", "asked_ts", "ts"), f"{R}{ASKED} SELECT A.contract_address, A.ts AS asked_ts, min(R.ts) AS ts FROM A JOIN R ON A.contract_address = R.contract_address AND R.ts >= A.ts GROUP BY A.contract_address, A.ts, A.block_number")
add("view_debounce", lambda s, d: views.debounced(_asked(s, d), 7200), ASKED.replace(", A AS", ", E AS", 1) + """, A AS (SELECT contract_address, "function", ts, row_number() OVER (PARTITION BY contract_address ORDER BY ts) AS i FROM E),
T AS (WITH RECURSIVE R AS (SELECT contract_address, "function", i, ts AS last, true AS read FROM A WHERE i = 1
  UNION ALL SELECT A.contract_address, A."function", A.i, CASE WHEN A.ts >= last + 7200 THEN A.ts WHEN A.ts > last THEN last + 7200 ELSE last END, A.ts > last FROM R JOIN A ON A.contract_address = R.contract_address AND A.i = R.i + 1) SELECT * FROM R)
SELECT contract_address, "function", last AS ts FROM T WHERE read""")
add("view_ceiling", lambda s, d: views.ticks(_asked(s, d), 7200, (TIP + 40) * 3600), f"{ASKED}, B AS (SELECT *, lead(ts, 1, {(TIP + 40) * 3600}) OVER (PARTITION BY contract_address ORDER BY ts, block_number) AS n FROM A) SELECT contract_address, \"function\", unnest(range(ts + 7200, n, 7200)) AS ts, block_number FROM B")
add("view_reorg", lambda s, d: views.readings_at(views.reorg_triggers(ad.readings(s, d), config_table(s, [(473_900, 473_900 * 3600)], "start_block bigint, ts bigint")), ad.readings(s, d)).select("contract_address", "ts"), f"{R} SELECT contract_address, min(ts) AS ts FROM R WHERE ts >= {473_900 * 3600} GROUP BY contract_address")

# Streams.


def _folder(s: SparkSession) -> str:
    return streams.shared_folder(s, "stream")


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """The raw events by files of whole blocks, streamed, filtered and kept as a log."""
    folder = _folder(s)
    raw(s, d).select("block_number", "transaction_hash", "contract_address", "event_seq", F.col("event_name")).repartition(4, "block_number").write.parquet(f"{folder}/raw")
    schema = "block_number bigint, transaction_hash string, contract_address string, event_seq bigint, event_name string"
    stream = streams.live(streams.raw_stream(s, f"{folder}/raw", schema, 1).withColumnRenamed("event_seq", "log_index"), [Filter("event_name", "eq", "view"), Filter("block_number", "gte", 473_500)])
    streams.appended(stream, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return s.read.schema("block_number bigint, transaction_hash string, contract_address string, log_index bigint, event_name string, event_id string").parquet(f"{folder}/log")


add("stream_log", _streamed, "SELECT block_number, transaction_hash, contract_address, event_id AS log_index, event_name, block_number || ':' || event_id AS event_id FROM (SELECT * FROM L) WHERE event_name = 'view' AND block_number >= 473500".replace("block_number || ':' || event_id AS event_id", "block_number || ':' || L2.event_id AS event_id").replace("event_id AS log_index", "L2.event_id AS log_index").replace("(SELECT * FROM L)", "L AS L2"))


def _stream_cursors(s: SparkSession, d: str) -> DataFrame:
    folder = _folder(s)
    raw(s, d).select("block_number", "contract_name").repartition(3).write.parquet(f"{folder}/raw")
    stream = streams.raw_stream(s, f"{folder}/raw", "block_number bigint, contract_name string", 1)
    streams.for_each_batch(stream, streams.batch_writer(f"{folder}/parts", streams.cursor_deltas), f"{folder}/checkpoint").awaitTermination()
    return streams.merged_cursors(s.read.schema("contract_name string, last_block bigint").parquet(f"{folder}/parts/*"))


add("stream_cursors", _stream_cursors, CURSORS)
add("replay_then_live", lambda s, d: streams.replay_then_live(ad.log(s, d).where(f"block_number <= {TIP}"), ad.log(s, d).where(f"block_number >= {TIP - 5}"), TIP - 20, 0).select("event_id", "transaction_hash"), f"SELECT block_number || ':' || log_index AS event_id, transaction_hash FROM L WHERE (block_number, log_index) > ({TIP - 20}, 0)")


def _followed(s: SparkSession, d: str) -> DataFrame:
    """The log up to a block as stored, the rest (five blocks of both) as a stream of files."""
    folder = _folder(s)
    ad.log(s, d).where(f"block_number >= {TIP - 5}").select("block_number", "log_index", "transaction_hash").repartition(3, "block_number").write.parquet(f"{folder}/live")
    stored = ad.log(s, d).where(f"block_number <= {TIP}").select("block_number", "log_index", "transaction_hash")
    stream = streams.raw_stream(s, f"{folder}/live", "block_number bigint, log_index bigint, transaction_hash string", 1)
    streams.followed(stored, stream, TIP - 20, 0, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return s.read.schema("transaction_hash string, event_id string").parquet(f"{folder}/out/*")


add("replay_then_stream", _followed, f"SELECT block_number || ':' || log_index AS event_id, transaction_hash FROM L WHERE (block_number, log_index) > ({TIP - 20}, 0)")


def _stream_dedup(s: SparkSession, d: str) -> DataFrame:
    """The raw events and every fourth again, streamed; each comes once."""
    folder = _folder(s)
    rows = raw(s, d).select("block_number", "transaction_hash", "event_seq", F.col("timestamp").cast("timestamp").alias("time"))
    rows.unionByName(rows.where("event_seq % 4 = 0")).repartition(3).write.parquet(f"{folder}/raw")
    stream = streams.raw_stream(s, f"{folder}/raw", "block_number bigint, transaction_hash string, event_seq bigint, time timestamp", 1)
    streams.appended(streams.distinct_events(stream, "time", "60 days"), f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return s.read.schema("event_seq bigint, block_number bigint").parquet(f"{folder}/log")


add("stream_dedup", _stream_dedup, f"SELECT {RAW} FROM L")

# Stored tables, output files and interface files, written and read again.


def _stored_scan(s: SparkSession, d: str) -> DataFrame:
    """A range of a stored log: folders pruned by the bucket, row groups by the block, other columns not read."""
    folder = _folder(s)
    src.write_raw(raw(s, d), f"{folder}/raw", bucket_blocks=100)
    return pick(src.block_range(src.read_raw(s, f"{folder}/raw"), 473_400, 473_500, "0x2", bucket_blocks=100))


add("stored_scan", _stored_scan, f"SELECT {RAW} FROM L WHERE block_number BETWEEN 473400 AND 473500 AND contract_address = '0x2'")


def _stored_log(s: SparkSession, d: str) -> DataFrame:
    """The log appended in two batches, one of them twice under its number, and some rows once more in a third: each row once."""
    rows = ad.log(s, d)
    log = stored.LogTable(s, f"{_folder(s)}/log", rows.schema, 100)
    for batch, part in ((0, "k < 50"), (1, "k >= 50"), (1, "k >= 50"), (2, "k BETWEEN 40 AND 60")):
        log.append(rows.where(part), "log", batch)
    return log.read()


add("append_log", _stored_log, f"SELECT {LOG} FROM L")


def _stored_reads(f: Callable[[stored.LogTable], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """f on the log as a stored table in buckets of 100 blocks."""

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = ad.log(s, d)
        log = stored.LogTable(s, f"{_folder(s)}/log", rows.schema, 100)
        log.append(rows, "log", 0)
        return f(log)

    return run


# The same queries as on the log made from events, where predicates reach the files and a range lists its buckets alone.
add("stored_list", _stored_reads(lambda t: query.listed(t.read(), FLAGSHIP)), SQL["list_flagship"], log=False)
add("stored_latest", _stored_reads(stored.LogTable.latest), SQL["latest_event"], log=False)
add("stored_count", _stored_reads(lambda t: query.counted(t.read(), [Filter("event_name", "eq", "purchase")])), "SELECT COUNT(*) AS \"count\" FROM L WHERE event_name = 'purchase'")
add("stored_range", _stored_reads(lambda t: t.read(473_450, 473_520)), f"SELECT {LOG} FROM L WHERE block_number BETWEEN 473450 AND 473520")


def _split(rows: DataFrame, folder: str, parts: int) -> int:
    """Files of rows in no order, so that every micro-batch has old rows and new ones; how many files a micro-batch takes, so
    that all cores write and read each of the `parts`."""
    files = rows.sparkSession.sparkContext.defaultParallelism
    rows.repartition(parts * files, F.xxhash64("block_number", "log_index")).write.parquet(folder)
    return files


def _stored_unique(s: SparkSession, d: str) -> DataFrame:
    """The latest row of each account, kept by a stream that starts twice; then its batches come again from a second one."""
    rows, folder = ad.log(s, d), _folder(s)
    files = _split(rows, f"{folder}/raw", 4)
    table = stored.UniqueTable(s, f"{folder}/unique", rows.schema, ["account"], 16)
    for writer in ("live", "live", "again"):
        stream = streams.raw_stream(s, f"{folder}/raw", rows.schema, files)
        stored.kept_by(stream, table.merge, writer, f"{folder}/checkpoint-{writer}").awaitTermination()
    return table.read()


add("stored_unique", _stored_unique, f"SELECT {LOG} FROM L QUALIFY {NEWEST.format(keys='account')}")


def _stored_totals(s: SparkSession, d: str) -> DataFrame:
    """The changes as signed parts by batch, each batch sent twice under its number."""
    changes = ad.changelog(s, d).select("op", F.coalesce("data", "prev").alias("r"), "block_number").select("op", "r.amount_cents", "block_number")
    table = stored.TotalsTable(s, f"{_folder(s)}/totals", AGGS)
    for batch in (2, 0, 1, 0, 2):
        table.add(changes.where(F.col("block_number") % 3 == batch), "changes", batch)
    return rounded(table.read())


add("stored_totals", _stored_totals, SQL["agg_delta"], log=False)


def _stored_reorg(s: SparkSession, d: str) -> DataFrame:
    """The log stored, three notices taken out of it, one of them twice; the part below the newest blocks compacted."""
    rows = ad.log(s, d)
    log = stored.LogTable(s, f"{_folder(s)}/log", rows.schema, 24)
    for batch, part in enumerate(("k < 50", "k >= 50")):
        log.append(rows.where(part), "log", batch)
    for start, end, seq in (*REORGS, REORGS[0]):
        log.undo(start, end, seq)
    log.confirm_depth()
    return log.read()


add("stored_reorg", _stored_reorg, f"SELECT {LOG} FROM L WHERE {KEPT}")


def _by_blocks(rows: DataFrame, blocks: list[int]) -> list[DataFrame]:
    """Parts in order of blocks, cut inside the given blocks (at log_index 1), as a stream gets them; rows of no block are in
    the first. The whole blocks are filtered first, below the window that numbers their rows."""
    block, second = F.col("block_number"), F.col("log_index") >= 1
    parts = []
    for low, high in zip([None, *blocks], [*blocks, None]):
        part = rows if low is None else rows.where(block >= low).where((block > low) | second)
        if high is not None:  # coalesce, as Spark would join tests for null to one that it cannot push below the window
            part = part.where(F.coalesce(block <= high, F.lit(True))).where(F.coalesce((block < high) | ~second, F.lit(True)))
        parts.append(part)
    return parts


def _fed(parts: list[DataFrame], folder: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Parts as the micro-batches of a stream, one after the other: all tasks write a part's files, then the stream starts
    again and takes them as one batch."""
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/raw")
        start(streams.raw_stream(part.sparkSession, f"{folder}/raw", part.schema, None)).awaitTermination()


def _stored_freeze(s: SparkSession, d: str) -> DataFrame:
    """The log in three parts that a stream takes one by one; each contract ends with the event that freezes it."""
    rows, folder = ad.log(s, d, True), _folder(s)
    table = stored.FrozenLog(s, f"{folder}/log", rows.schema, lambda L: lifecycle.local_triggers(L, _rules(s)), 100)
    _fed(_by_blocks(rows, [473_500, 473_800]), folder, lambda stream: stored.kept_by(stream, table.append, "live", f"{folder}/checkpoint"))
    return table.read().select("transaction_hash")


add("stored_freeze", _stored_freeze, SQL["freeze_effect"], log=False)


def _stored_children(s: SparkSession, d: str) -> DataFrame:
    """Children and their events from one stream of three parts: sign-ups register an account, whose events are then kept."""
    rows, folder = ad.log(s, d), _folder(s)
    found = lambda L: registry.children(L.select("event_name", "block_number", "log_index", "account", "k"), "f", "signup", "account", "shop")
    events = lambda L: L.withColumn("contract_address", F.col("account"))
    table = stored.ChildLog(s, f"{folder}/log", rows.schema, found, found(rows).schema, 100)
    _fed(_by_blocks(rows, [473_500, 473_800]), folder, lambda stream: stored.kept_by(events(stream), table.append, "live", f"{folder}/checkpoint"))
    return table.read().select("contract_name", "transaction_hash")


add("stored_children", _stored_children, SQL["child_events"], log=False)


def _stream_log_index(s: SparkSession, d: str) -> DataFrame:
    """Numbers in the block over a stream whose parts end inside blocks."""
    folder = _folder(s)
    parts = _by_blocks(decode.with_log_index(ad.raw_events(s, d).select("block_number", "event_seq")), [473_400, 473_600])
    _fed(parts, folder, lambda stream: streams.appended(stateful.with_log_index(stream.drop("log_index")), f"{folder}/log", f"{folder}/checkpoint"))
    return s.read.schema("block_number bigint, event_seq bigint, log_index bigint").parquet(f"{folder}/log")


add("stream_log_index", _stream_log_index, SQL["log_index"], log=False)


def _stream_confirmed(s: SparkSession, d: str) -> DataFrame:
    """Rows once they are ten blocks deep, from a stream of three parts."""
    rows, folder = ad.log(s, d).withColumn("ingest_seq", F.lit(0).cast("bigint")), _folder(s)
    _fed(_by_blocks(rows, [473_500, 473_800]), folder, lambda stream: streams.appended(stateful.confirmed(stream), f"{folder}/log", f"{folder}/checkpoint"))
    return s.read.schema(rows.schema).parquet(f"{folder}/log").drop("ingest_seq")


add("stream_confirmed", _stream_confirmed, SQL["confirmed_split"], log=False)


def _stream_debounce(s: SparkSession, d: str) -> DataFrame:
    """Debounced readings of a stream of triggers in three parts; a last trigger of no view moves event time past them all."""
    folder = _folder(s)
    schema = "contract_address string, function string, ts bigint"
    _asked(s, d).select("contract_address", "function", "ts").write.parquet(f"{folder}/all")
    asked = s.read.schema(schema).parquet(f"{folder}/all")
    parts = [asked.where((F.col("ts") >= first * 3600 + 7) & (F.col("ts") < last * 3600 + 7)) for first, last in ((0, 473_500), (473_500, 473_800), (473_800, 2 * TIP))]
    _fed([*parts, config_table(s, [("", "", 3 * TIP * 3600)], schema)], folder, lambda stream: streams.appended(stateful.debounced(stream, 7200), f"{folder}/log", f"{folder}/checkpoint"))
    return s.read.schema(schema).parquet(f"{folder}/log").where("function <> ''")


add("stream_debounce", _stream_debounce, SQL["view_debounce"], log=False)


def _stream_timestamps(s: SparkSession, d: str) -> DataFrame:
    """Timestamps from a stream of blocks; a last event and a last block of no contract end the wait."""
    folder = _folder(s)
    rows = raw(s, d).select("block_number", "event_seq")
    ends = config_table(s, [(TIP * 2, -1)], "block_number bigint, event_seq bigint")
    rows.repartitionByRange(3, "block_number").write.parquet(f"{folder}/raw")
    ends.write.mode("append").parquet(f"{folder}/raw")
    blocks = ad.log(s, d).where("block_number % 5 <> 0").select("block_number", "timestamp").distinct()
    blocks.repartitionByRange(3, "block_number").write.parquet(f"{folder}/blocks")
    ends.select("block_number", F.lit(0).cast("bigint").alias("timestamp")).write.mode("append").parquet(f"{folder}/blocks")
    events = streams.raw_stream(s, f"{folder}/raw", "block_number bigint, event_seq bigint", 1)
    times = streams.raw_stream(s, f"{folder}/blocks", "block_number bigint, timestamp bigint", 1)
    streams.appended(streams.timestamped(events, times, 1000), f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return s.read.schema("event_seq bigint, timestamp bigint").parquet(f"{folder}/log").where("event_seq >= 0")


add("stream_timestamps", _stream_timestamps, SQL["timestamp_enrich"], log=False)


def _outputs(s: SparkSession, d: str) -> DataFrame:
    """A query's rows as JSON and as CSV with a header."""
    folder = _folder(s)
    rows = ad.log(s, d).where("event_name = 'purchase'").select("block_number", "log_index", "account", "amount_cents")
    query.write_json(rows, f"{folder}/json")
    query.write_csv(rows, f"{folder}/csv")
    read = [s.read.schema(rows.schema).json(f"{folder}/json"), s.read.schema(rows.schema).option("header", True).csv(f"{folder}/csv")]
    return read[0].withColumn("format", F.lit("json")).unionByName(read[1].withColumn("format", F.lit("csv")))


add("outputs", _outputs, "SELECT block_number, log_index, account, amount_cents, format FROM L, (SELECT unnest(['json', 'csv']) AS format) WHERE event_name = 'purchase'")


def _abi_files(s: SparkSession, d: str) -> DataFrame:
    """An interface file for each event of the log, in the three shapes that are read, as a catalog."""
    folder = _folder(s)
    event = lambda name: F.concat(F.lit('[{"type": "event", "name": "shop::Shop::'), name, F.lit('", "kind": "struct", "members": [{"name": "who", "type": "felt", "kind": "key"}, {"name": "n", "type": "u64"}]}, {"type": "function", "name": "total", "state_mutability": "view", "inputs": [], "outputs": [{"type": "u64"}]}]'))
    names = ad.log(s, d).select("event_name").distinct()
    listed, size = event(F.col("event_name")), F.length("event_name")
    text = F.when(size % 3 == 0, listed).when(size % 3 == 1, F.concat(F.lit('{"abi": '), listed, F.lit("}"))).otherwise(F.to_json(F.struct(listed.alias("abi"))))
    names.select(text.alias("value"), F.col("event_name").alias("file")).write.partitionBy("file").text(f"{folder}/abi")
    files = s.read.option("wholetext", True).text(f"{folder}/abi").select(F.col("file").alias("abi_name"), F.trim("value").alias("text"))
    return abi.abi_catalog(abi.abi_entries(files)).select("abi_name", "kind", "name", "part", "pos", "member", "type_name")


add("abi_catalog", _abi_files, ", N AS (SELECT DISTINCT event_name AS abi_name FROM L) SELECT abi_name, 'event' AS kind, abi_name AS name, 'key' AS part, 0 AS pos, 'who' AS member, 'felt' AS type_name FROM N UNION ALL SELECT abi_name, 'event', abi_name, 'data', 1, 'n', 'u64' FROM N UNION ALL SELECT abi_name, 'function', 'total', 'output', 0, NULL, 'u64' FROM N")
