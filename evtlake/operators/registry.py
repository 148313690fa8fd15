"""Contracts found in events: children of factories and deployments by class hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import Filter, Query
from .query import listed

META = {"block_number", "transaction_hash", "log_index", "timestamp", "contract_address", "event_name", "status", "contract_name"}


def hex_prefixed(address: Column) -> Column:
    return F.when(address.startswith("0x"), address).otherwise(F.concat(F.lit("0x"), address))


def named(template: str, values: dict[str, Column]) -> Column:
    """A template with {names} replaced, one name after the other; where a value is null its name stays."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.coalesce(F.replace(out, F.lit("{" + name + "}"), value.cast("string")), out)
    return out


def short_hex(address: Column) -> Column:
    """The last eight digits, without the prefix."""
    return F.right(F.regexp_replace(address, "^0x", ""), F.lit(8))


def children(events: DataFrame, factory: str, event: str, field: str, child_abi: str, template: str = "{factory}_{short_address}", shared: bool = False) -> DataFrame:
    """Child contracts of one rule: every event with the address field; all other decoded fields are their metadata."""
    fields = [c for c in events.columns if c not in META and c != field]
    rows = events.where((F.col("event_name") == event) & F.col(field).isNotNull()).withColumn("address", hex_prefixed(F.col(field)))
    meta = F.map_filter(F.create_map(*(x for c in fields for x in (F.lit(c), F.col(c).cast("string")))), lambda k, v: v.isNotNull()) if fields else F.create_map().cast("map<string,string>")
    values = {"factory": F.lit(factory), "short_address": short_hex(F.col("address")), **{c: F.col(c) for c in fields}}
    return rows.select(
        named(template, values).alias("contract_name"), F.col("address").alias("contract_address"), F.lit(child_abi).alias("abi_name"), F.col("block_number").alias("start_block"), "log_index",
        F.lit(factory).alias("factory_name"), meta.alias("factory_meta"), F.lit(shared).alias("shared"), F.lit(True).alias("dynamic"),
    )


def first_registrations(found: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """The first of each name, unless the registry has it. Counts of skipped rows: the difference of counts."""
    order = Window.partitionBy("contract_name").orderBy("start_block", "log_index")
    rows = found.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    return rows if registry is None else rows.join(registry.select("contract_name"), "contract_name", "left_anti")


def deployments(raw: DataFrame, version: int | None = None, address_key: int | None = None, address_data: int | None = None, class_hash_key: int | None = None, class_hash_data: int | None = None) -> DataFrame:
    """Deployer events by layout: address and class_hash; other shapes are skipped.

    Without a version the layout is told by the shape; the places of the address and the class hash in keys or data (from 0,
    data before keys) may then be given. A place beyond the event skips it.
    """
    key, data = (lambda i: F.try_element_at("keys", F.lit(i + 1))), (lambda i: F.try_element_at("data", F.lit(i + 1)))
    one = F.size("keys") >= 4 if version is None else F.lit(version == 1)
    zero = (F.size("keys") == 1) & (F.size("data") >= 4) if version is None else F.lit(version == 0)
    layouts = [[key(1), data(0)], [data(0), data(3)]]
    for i, (in_keys, in_data) in enumerate([(address_key, address_data), (class_hash_key, class_hash_data)] if version is None else []):
        if in_keys is not None or in_data is not None:
            layouts[0][i] = layouts[1][i] = data(in_data) if in_data is not None else key(in_keys)
    one_at, zero_at = (F.struct(a.alias("address"), c.alias("class_hash")) for a, c in layouts)
    pick = F.when(one, one_at).when(zero, zero_at)
    return raw.withColumn("d", pick).where("d.address IS NOT NULL AND d.class_hash IS NOT NULL").select("block_number", "event_seq", F.col("d.address").alias("contract_address"), F.col("d.class_hash").alias("class_hash"))


def discovered(found: DataFrame, watched: DataFrame, template: str = "{class_hash_short}_{address_short}") -> DataFrame:
    """Registry rows of deployments with a watched class hash. watched: class_hash, group, abi_name, shared."""
    values = {"class_hash_short": short_hex(F.col("class_hash")), "address_short": short_hex(F.col("contract_address")), "class_hash": F.col("class_hash"), "address": F.col("contract_address"), "group": F.nullif("group", F.lit(""))}
    rows = found.join(watched, "class_hash")
    return rows.select(
        named(template, values).alias("contract_name"), "contract_address", "abi_name", F.col("block_number").alias("start_block"), F.col("event_seq").alias("log_index"),
        F.when(F.col("shared"), F.col("abi_name")).alias("factory_name"), "class_hash", "shared", F.lit(True).alias("dynamic"),
    )


def of_class(registry: DataFrame, class_hash: str, cursors: DataFrame) -> DataFrame:
    return registry.where(F.col("class_hash") == class_hash).join(cursors, "contract_name", "left")


def merged(static: DataFrame, stored: DataFrame) -> DataFrame:
    """Static contracts, and stored ones of other names."""
    return static.unionByName(stored.join(static.select("contract_name"), "contract_name", "left_anti"), allowMissingColumns=True)


def resynced(registry: DataFrame, rules: DataFrame) -> DataFrame:
    """Children with the current rule of their factory and ABI, else of their ABI under any factory (the least by name)."""
    exact = rules.select("factory_name", "abi_name", F.col("events").alias("own"))
    loose = rules.groupBy("abi_name").agg(F.min_by("events", "factory_name").alias("any"))
    rows = registry.join(exact, ["factory_name", "abi_name"], "left").join(loose, "abi_name", "left")
    return rows.withColumn("events", F.coalesce("own", "any")).drop("own", "any")


def child_events(raw: DataFrame, registry: DataFrame) -> DataFrame:
    """Events of registered contracts from their start block on."""
    starts = registry.select("contract_address", "contract_name", "start_block")
    return raw.join(starts, "contract_address").where(F.col("block_number") >= F.col("start_block")).drop("start_block")


def children_list(registry: DataFrame, cursors: DataFrame, factory: str, promote: list[str], filters: tuple[Filter, ...] = (), query: Query | None = None) -> DataFrame:
    """Children of a factory with promoted metadata and cursors, filtered, ordered and paged."""
    query = query or Query(order="deployment_block")
    rows = registry.where(F.col("factory_name") == factory).join(cursors, "contract_name", "left")
    rows = rows.select("contract_name", "contract_address", F.col("start_block").alias("deployment_block"), F.coalesce("last_block", F.lit(0).cast("bigint")).alias("last_block"), *(F.col("factory_meta").getItem(m).alias(m) for m in promote))
    return listed(rows, Query((*filters, *query.filters), query.order, query.descending, query.limit, query.offset))


def children_count(registry: DataFrame, factory: str, meta: dict[str, str] | None = None) -> DataFrame:
    tests = [F.col("factory_meta").getItem(k) == v for k, v in (meta or {}).items()]
    rows = registry.where(reduce(Column.__and__, tests, F.col("factory_name") == factory))
    return rows.agg(F.count(F.lit(1)).alias("count"))
