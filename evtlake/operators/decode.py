"""From raw events to typed columns: match contract, selector and rule, decode, number, and set failures apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.felt import Kind, Types, any_error, compiled
from ..schemas import DEFAULT_STATUS
from ..sources.config import held, sized

ELEMENT = "^0x[0-9a-fA-F]{1,64}$"
METADATA = ["block_number", "transaction_hash", "log_index", "timestamp", "contract_address", "event_name", "status"]


def accepted(contracts: DataFrame, catalog: DataFrame, rules: DataFrame) -> DataFrame:
    """contract_address and selector of every event that a rule takes, with contract_name, abi_name and event_name."""
    events = catalog.where("kind = 'event'").select("abi_name", "selector", F.col("name").alias("event_name")).distinct()
    known = contracts.select("contract_name", "contract_address", "abi_name")
    wanted = rules.select("contract_name", "event_name").distinct()
    return known.join(events, "abi_name").join(wanted, ["contract_name", "event_name"], "left_semi")


def matched(raw: DataFrame, contracts: DataFrame, catalog: DataFrame, rules: DataFrame) -> DataFrame:
    """Raw events with contract_name, abi_name and event_name; unknown contracts, selectors and events without a rule go.

    The configuration is joined first, so that events meet one table, by address and selector together: a broadcast up to
    `config.BROADCAST_ROWS` rows, beyond it a shuffle on both keys.
    """
    rows = raw.withColumn("selector", F.try_element_at("keys", F.lit(1)))
    return rows.join(sized(accepted(contracts, catalog, rules)), ["contract_address", "selector"])


def status_or_default(status: Column) -> Column:
    return F.coalesce(F.nullif(status, F.lit("")), F.lit(DEFAULT_STATUS))


def with_log_index(rows: DataFrame) -> DataFrame:
    """Zero-based number in the block, by event_seq, over the accepted rows."""
    return rows.withColumn("log_index", (F.row_number().over(Window.partitionBy("block_number").orderBy("event_seq")) - 1).cast("bigint"))


def member_columns(kinds: list[tuple[str, str, Kind]]) -> tuple[list[Column], Column]:
    """Value columns of (part, member, kind) in order, and the first error. Keys start after the selector."""
    at: dict[str, Column | int] = {"key": 1, "data": 0, "output": 0}
    values, errors = [], []
    columns = {"key": "keys", "data": "data", "output": "result"}
    for part in dict.fromkeys(part for part, _, _ in kinds):
        odd = F.exists(F.col(columns[part]), lambda e: ~e.rlike(ELEMENT))
        errors.append(F.when(odd, F.lit("not a field element")))
    for part, member, kind in kinds:
        src = F.col(columns[part])
        value, error, at[part] = compiled(kind, src, at[part])
        values.append(value.alias(member))
        errors.append(error)
    return values, any_error(errors)


def decoded(rows: DataFrame, kinds: list[tuple[str, str, Kind]]) -> DataFrame:
    """rows with one column for each member and decode_error."""
    values, error = member_columns(kinds)
    return rows.select(*rows.columns, *values, error.alias("decode_error"))


def kinds_of(catalog: DataFrame, types: dict[str, Types]) -> dict[tuple[str, str], list[tuple[str, str, Kind]]]:
    """(abi, event or view) to its members, keys first. An unnamed only output takes the view's name, several output_i."""
    out: dict[tuple[str, str], list] = {}
    rows = [r for r in catalog.collect() if r["kind"] in ("event", "function") and r["type_name"] is not None]  # interface files: a small table
    for r in sorted(rows, key=lambda r: (r["abi_name"], r["name"], r["part"] != "key", r["pos"])):
        kind = types.get(r["abi_name"], Types()).resolve(r["type_name"])
        out.setdefault((r["abi_name"], r["name"]), []).append((r["part"], r["member"], kind))
    for (_, name), members in out.items():
        for i, (part, member, kind) in enumerate(members):
            if not member:
                members[i] = (part, name if len(members) == 1 else f"output_{i}", kind)
    return out


def decode_wide(raw: DataFrame, contracts: DataFrame, catalog: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, list[str]]]:
    """(decoded rows, failed rows, {event: members}), all events in one pass: metadata and for each event one struct, null in
    rows of others (true for an event without members). Failed rows keep their raw form and the error, and take no log_index.
    """
    catalog = held(catalog)
    kinds = {k: m for k, m in kinds_of(catalog, _types(catalog)).items() if not any(p == "output" for p, _, _ in m)}
    for r in catalog.where("kind = 'event' AND type_name IS NULL").collect():
        kinds.setdefault((r["abi_name"], r["name"]), [])
    rows = matched(raw, contracts, catalog, rules)
    own = {k: (F.col("abi_name") == k[0]) & (F.col("event_name") == k[1]) for k in kinds}
    layouts: dict[tuple, list[tuple[str, str]]] = {}  # events with the same members are decoded by the same expressions
    for k, members in kinds.items():
        layouts.setdefault(tuple(members), []).append(k)
    error, values = F.lit(None).cast("string"), []
    for members, events in layouts.items():
        takes = reduce(Column.__or__, (own[k] for k in events))
        columns, failure = member_columns(list(members))
        error = F.when(takes, failure).otherwise(error)
        values.append(F.when(takes, F.struct(*columns) if columns else F.lit(True)))
    every = rows.withColumn("decode_error", error)
    good = with_log_index(every.where("decode_error IS NULL"))
    time = F.col("timestamp") if "timestamp" in raw.columns else F.lit(0).cast("bigint")
    names: dict[tuple[str, str], str] = {}
    for abi, event in kinds:
        names[abi, event] = event if event not in names.values() else f"{abi}_{event}"
    place = {k: i for i, events in enumerate(layouts.values()) for k in events}
    wide = good.withColumns({f"_layout{i}": v for i, v in enumerate(values)}).select(
        "block_number", "transaction_hash", "log_index", time.alias("timestamp"), "contract_address", "event_name", status_or_default(F.col("finality_status")).alias("status"), "contract_name",
        *(F.when(own[k], F.col(f"_layout{place[k]}")).alias(names[k]) for k in kinds),
    )
    return wide, every.where("decode_error IS NOT NULL"), {names[k]: [m for _, m, _ in members] for k, members in kinds.items()}


def decode_events(raw: DataFrame, contracts: DataFrame, catalog: DataFrame, rules: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """({event: typed rows}, failed rows) of `decode_wide`. Store its rows first where several events are read."""
    wide, failed, events = decode_wide(raw, contracts, catalog, rules)
    rows = {e: wide.where(F.col(f"`{e}`").isNotNull()) for e in events}
    return {e: rows[e].select(*METADATA, "contract_name", *(F.col(f"`{e}`.`{m}`").alias(m) for m in members)) for e, members in events.items()}, failed


def _types(catalog: DataFrame) -> dict[str, Types]:
    from ..sources.abi import types_of

    return types_of(catalog)


def decode_results(results: DataFrame, kinds: list[tuple[str, str, Kind]]) -> DataFrame:
    """View outputs from a CALL_RESULT table."""
    return decoded(results, kinds)


def as_text(df: DataFrame) -> DataFrame:
    """Compound columns as JSON text, others as text, null as ''."""
    out = []
    for f in df.schema.fields:
        compound = f.dataType.typeName() in ("array", "struct", "map")
        out.append(F.coalesce(F.to_json(F.col(f.name)) if compound else F.col(f.name).cast("string"), F.lit("")).alias(f.name))
    return df.select(*out)


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """try_cast to the table's types; for booleans the text 'true' alone is true."""
    out = []
    for c in df.columns:
        to = types.get(c)
        if to == "boolean":
            out.append((F.lower(F.col(c).cast("string")) == "true").alias(c))
        else:
            out.append((F.col(c).try_cast(to) if to else F.col(c)).alias(c))
    return df.select(*out)


