import random

import pytest
from pyspark.sql import functions as F

from evtlake.operators import changelog as ch
from evtlake.operators import decode, lifecycle, query, registry, tables, views
from evtlake.plans import adapters, catalog
from evtlake.schemas import Aggregate, Filter, Query, TableSpec
from evtlake.sources import events as src

ROW = "block_number bigint, log_index bigint, "
AGGS = [Aggregate("s", "sum", "v"), Aggregate("n", "count", "v"), Aggregate("a", "avg", "v")]


@pytest.mark.parametrize("kind", ["bigint", "string"])
@pytest.mark.parametrize("op,n", [("eq", 1), ("neq", 4), ("gt", 2), ("gte", 3), ("lt", 2), ("lte", 3)])
def test_filters(spark, kind, op, n):
    df = spark.createDataFrame([(i, 0, str(10 * i)) for i in range(5)] + [(9, 0, None)], ROW + "score string").withColumn("score", F.col("score").cast(kind))
    for literal in (20, "20"):
        assert query.counted(df, [Filter("score", op, literal)]).first()[0] == n
    assert query.counted(df, [Filter("absent", op, 1)]).first()[0] == 0


def test_bad_arguments():
    for bad in (lambda: Filter("a", "like", 1), lambda: Query(limit=0), lambda: Query(offset=-1), lambda: Aggregate("a", "max", "b"), lambda: TableSpec("t", "unique")):
        with pytest.raises(ValueError):
            bad()


def test_order_ties_and_pages(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], ROW + "x string")
    assert [r["x"] for r in query.listed(df, Query()).collect()] == ["c", "b", "a"]
    assert [r["x"] for r in query.listed(df, Query(descending=False, limit=1, offset=1)).collect()] == ["b"]
    assert query.listed(df, Query(offset=5)).count() == 0
    assert [r["x"] for r in query.after_event(df, 1, 0).collect()] == ["b", "c"]
    no_index = df.drop("log_index")
    assert query.listed(no_index, Query(order="x", limit=None)).first()["x"] == "c"


def test_unique(spark):
    df = spark.createDataFrame([(1, 0, "alice", 100), (2, 0, "alice", 200), (3, 0, "bob", 150), (3, 1, "bob", 160), (4, 0, None, 1)], ROW + "who string, v bigint")
    assert {(r["who"], r["v"]) for r in tables.latest(df, "who").collect()} == {("alice", 200), ("bob", 160), (None, 1)}
    # the filter comes after the latest row is picked
    assert query.unique_query(df, ["who"], Query((Filter("v", "eq", 100),))).count() == 0


def test_totals(spark):
    df = spark.createDataFrame([("100",), ("250",), ("150",), (None,), ("x",)], "v string")
    row = tables.totals(df, AGGS).first()
    assert (row["s"], row["n"], row["a"]) == (500.0, 5, 100.0)
    row = tables.totals(df.where("false"), AGGS).first()
    assert (row["s"], row["n"], row["a"]) == (0.0, 0, 0.0)


def test_deltas_cancel(spark):
    changes = spark.createDataFrame([("insert", 100), ("insert", 200), ("update", 5), ("delete", 100), ("delete", 200)], "op string, v bigint")
    row = tables.merged_deltas(tables.deltas(changes, AGGS), AGGS).first()
    assert (row["s"], row["n"], row["a"]) == (0.0, 0, 0.0)


def test_exact_sum(spark):
    values = [2**256 - 1, 2**128, 7, 0]
    df = spark.createDataFrame([(str(v),) for v in values] + [(None,)], "v string")
    assert tables.exact_sum(df, "v").first()[0] == str(sum(values))
    assert tables.exact_sum(df.where("false"), "v").first()[0] == "0"


def _changes(spark, seed):
    rng = random.Random(seed)
    live, rows = {}, []
    for seq in range(60):
        key = rng.randrange(12)
        if key not in live:
            live[key] = seq
            rows.append((0, key, "insert", seq, (seq,), None))
        elif rng.random() < 0.5:
            rows.append((0, key, "update", seq, (seq,), (live[key],)))
            live[key] = seq
        else:
            rows.append((0, key, "delete", seq, None, (live.pop(key),)))
    return spark.createDataFrame(rows, ROW + "op string, op_seq bigint, data struct<v:bigint>, prev struct<v:bigint>"), live


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_apply_and_revert(spark, seed):
    changes, live = _changes(spark, seed)
    assert {r["log_index"]: r["v"] for r in ch.applied(changes).collect()} == live
    before, _ = changes.where("op_seq < 40"), None
    want = {r["log_index"]: r["v"] for r in ch.applied(before).collect()}
    got = {r["log_index"]: r["v"] for r in ch.applied(ch.reverted(changes, F.col("op_seq") >= 40)).collect()}
    assert got == want
    twice = ch.inverse(ch.inverse(changes))
    assert sorted(map(str, twice.collect())) == sorted(map(str, changes.collect()))


def test_reorg(spark):
    log = spark.createDataFrame([(10, 0), (11, 0), (12, 0)], "block_number bigint, log_index bigint")
    reorgs = spark.createDataFrame([(11, 12, 1)], "start_block bigint, end_block bigint, seq bigint")
    assert [r[0] for r in ch.surviving(log, reorgs).collect()] == [10]
    again = log.where("block_number > 10").withColumn("ingest_seq", F.lit(1)).unionByName(log.withColumn("ingest_seq", F.lit(0)))
    assert ch.surviving(again, reorgs).count() == 3
    cursors = spark.createDataFrame([("a", 12), ("b", 10)], "contract_name string, last_block bigint")
    assert {r[0]: r[1] for r in ch.reset_cursors(cursors, 11).collect()} == {"a": 10, "b": 10}
    assert ch.reset_cursors(cursors, 0).agg(F.max("last_block")).first()[0] == 0
    assert ch.surviving(log, reorgs.where("false")).count() == 3


def test_key_filter_and_split(spark):
    raw = spark.createDataFrame([(i, ["0xa" if i % 2 else "0xb", "0x1"][: i % 3]) for i in range(12)], "block_number bigint, keys array<string>")
    assert {r[0] for r in raw.where(src.key_match([["0xa"], []])).collect()} == {1, 5, 7, 11}
    assert src.history_and_live(raw, raw, 5, 3).count() == 9
    parts = src.partitioned_union(raw, [F.col("block_number") < 5, F.col("block_number") < 8, F.lit(True)])
    assert sorted(r[0] for r in parts.collect()) == list(range(12))


def test_stored_raw(spark, tmp_path):
    raw = spark.createDataFrame([(i * 5000, i, ["0x1"]) for i in range(8)], "block_number bigint, event_seq bigint, keys array<string>")
    src.write_raw(raw, str(tmp_path / "raw"))
    got = src.block_range(src.read_raw(spark, str(tmp_path / "raw")), 5000, 20000)
    assert sorted(r["block_number"] for r in got.collect()) == [5000, 10000, 15000, 20000]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block_bucket" in plan and "PushedFilters: [IsNotNull(block_number)" in plan


def test_start_blocks(spark):
    contracts = spark.createDataFrame([("a", None), ("b", 0), ("c", 50), ("d", 5), ("e", None)], "contract_name string, start_block bigint")
    cursors = spark.createDataFrame([("c", 10), ("d", 10), ("e", 7)], "contract_name string, last_block bigint")
    assert {r[0]: r[1] for r in query.start_blocks(contracts, cursors, 99).collect()} == {"a": 99, "b": 0, "c": 50, "d": 11, "e": 8}


def test_deployments(spark):
    rows = [(1, 1, ["s", "0xa", "0xd", "0x1"], ["0xc1", "0x0"]), (1, 2, ["s"], ["0xb", "0xd", "0x1", "0xc2"]), (1, 3, ["s", "x"], ["y"])]
    raw = spark.createDataFrame(rows, "block_number bigint, event_seq bigint, keys array<string>, data array<string>")
    assert {(r["contract_address"], r["class_hash"]) for r in registry.deployments(raw).collect()} == {("0xa", "0xc1"), ("0xb", "0xc2")}


def test_deployments_with_given_places(spark):
    raw = spark.createDataFrame([(1, 1, ["s", "a1", "a2", "a3"], ["d0", "d1"]), (1, 2, ["s"], ["d0", "d1", "d2", "d3"]), (1, 3, ["s", "x"], ["y"])], "block_number bigint, event_seq bigint, keys array<string>, data array<string>")
    got = lambda **k: {r["event_seq"]: (r["contract_address"], r["class_hash"]) for r in registry.deployments(raw, **k).collect()}
    assert got(address_key=3, class_hash_data=1) == {1: ("a3", "d1")}
    assert got(address_key=3, address_data=1, class_hash_key=0) == {1: ("d1", "s"), 2: ("d1", "s")}
    assert got(version=0, address_key=3) == {2: ("d0", "d3")} and got(version=1) == {1: ("a1", "d0"), 3: ("x", "y")}


def test_readings_over_buckets(spark):
    rng = random.Random(3)
    readings = [("v", "f", 0, t, [str(t)]) for t in sorted(rng.sample(range(3000), 40))] + [("w", "f", 0, 2999, ["x"])]
    asked = [(v, "f", rng.randrange(3100), 0) for v in "vwx" for _ in range(60)]
    r = spark.createDataFrame(readings, "contract_address string, function string, block_number bigint, ts bigint, result array<string>")
    a = spark.createDataFrame(asked, "contract_address string, function string, ts bigint, block_number bigint")
    want = sorted((v, t, min(x[3] for x in readings if x[0] == v and x[3] >= t)) for v, _, t, _ in asked if any(x[0] == v and x[3] >= t for x in readings))
    for bucket in (7, 100, 10_000):
        assert sorted((x["contract_address"], x["asked_ts"], x["ts"]) for x in views.readings_at(a, r, bucket).collect()) == want
    ticks = lambda bucket: sorted(map(tuple, views.ticks(a, 20, 3200, bucket).collect()))
    assert ticks(9) == ticks(10_000) != []


def test_children(spark):
    events = spark.createDataFrame([(5, 0, "Pair", "c001", "0xE"), (6, 0, "Pair", "0xc001", "0xF"), (7, 0, "Pair", None, "0xE")], "block_number bigint, log_index bigint, event_name string, pair string, token0 string")
    found = registry.first_registrations(registry.children(events, "F", "Pair", "pair", "abi", "{factory}-{token0}-{short_address}"))
    assert {(r["contract_name"], r["contract_address"], r["start_block"], r["factory_meta"]["token0"]) for r in found.collect()} == {("F-0xE-c001", "0xc001", 5, "0xE"), ("F-0xF-c001", "0xc001", 6, "0xF")}


def test_names(spark):
    """Short forms are the last eight digits without the prefix; a group that is not set stays in the template."""
    rows = spark.createDataFrame([("0x1234567", "0x96", ""), ("0x00aabbccddee", "0x123456789", "g")], "contract_address string, class_hash string, group string").withColumn("block_number", F.lit(1)).withColumn("event_seq", F.lit(0))
    watched = rows.select("class_hash", "group", F.lit("abi").alias("abi_name"), F.lit(False).alias("shared"))
    names = lambda *template: {r["contract_name"] for r in registry.discovered(rows.drop("group"), watched, *template).collect()}
    assert names() == {"96_1234567", "23456789_bbccddee"}
    assert names("{group}-{address}-{class_hash}") == {"{group}-0x1234567-0x96", "g-0x00aabbccddee-0x123456789"}


def test_freeze(spark):
    contracts = spark.createDataFrame([("o", "0x2222", {"option_token": "0x01111", "expiry": "0x64"}), ("p", "0x3", {})], "contract_name string, contract_address string, factory_meta map<string,string>")
    schema = "contract_name string, kind string, event string, source string, meta_field string, op string, value string"
    rules = spark.createDataFrame([("o", "sibling", "Settled", None, "option_token", None, None)], schema)
    events = spark.createDataFrame([("z", "0x9999", "Settled", 1, 0), ("y", "0x1111", "Settled", 2, 0)], "contract_name string, contract_address string, event_name string, block_number bigint, log_index bigint")
    assert lifecycle.sibling_triggers(events.where("block_number = 1"), rules, contracts).count() == 0
    assert lifecycle.sibling_triggers(events, rules, contracts).first()["frozen_at_block"] == 2
    for value, now, hit in (("now()", 100, True), ("now() - 1s", 100, False), ("now() - 2d", 100 + 172800, True), ("0x63", 0, False), ("100", 0, True), ("bad", 0, False), ("now() + x", 0, False)):
        rule = spark.createDataFrame([("o", "predicate", None, None, "expiry", "lte", value), ("p", "predicate", None, None, "expiry", "lte", value)], schema)
        assert (lifecycle.predicate_matches(contracts, rule, now).count() == 1) == hit, value


def test_predicates_compare_exactly(spark):
    big = "9" * 60
    cases = [
        ("19.6", "lt", "20", True), ("19.6", "gte", "20", False), ("20.0", "eq", "20", True), ("-1.5", "lt", "-1.4", True), ("-0", "eq", "0", True), ("1e3", "eq", "1000", True), (".5", "gt", "0.49", True),
        (big + ".1", "gt", big, True), (big, "eq", big, True), ("0x" + "f" * 64, "eq", str(2**256 - 1), True), ("007", "eq", "7", True), ("0X10", "eq", "16", False), ("1.2.3", "gt", "0", False), (" 5 ", "lte", "0x5", True),
        ("-3", "gt", "2", False), ("100", "gt", "99.999", True), ("", "eq", "0", False),
    ]
    contracts = spark.createDataFrame([(str(i), {"m": c[0]}) for i, c in enumerate(cases)], "contract_name string, factory_meta map<string,string>")
    rules = spark.createDataFrame([(str(i), "predicate", "m", c[1], c[2]) for i, c in enumerate(cases)], "contract_name string, kind string, meta_field string, op string, value string")
    assert {r[0] for r in lifecycle.predicate_matches(contracts, rules, 0).collect()} == {str(i) for i, c in enumerate(cases) if c[3]}


def test_debounce(spark):
    times = [0, 1, 4, 5, 11, 40, 41, 49]
    assert views.debounced_times(times, 10) == [0, 10, 20, 40, 50]
    asked = spark.createDataFrame([(v, "f", t) for v in ("a", "b") for t in reversed(times)], "contract_address string, function string, ts bigint")
    got = views.debounced(asked, 10).collect()
    assert sorted((r[0], r[2]) for r in got) == sorted((v, t) for v in ("a", "b") for t in [0, 10, 20, 40, 50])
    assert views.debounced(asked, 0).count() == 16


def test_migration(spark):
    old, new = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, "x")], "a int, b string")
    assert {tuple(r) for r in tables.migrated(old, new).collect()} == {(1, None), (2, "x")}


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    query.write_json(df, str(tmp_path / "j"))
    query.write_csv(df, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 1


def test_log_index_has_no_gaps_where_events_are_missing(spark):
    rows = [(b, s) for b in (1, 2) for s in range(12) if s % 3]
    out = decode.with_log_index(spark.createDataFrame(rows, "block_number bigint, event_seq bigint")).collect()
    assert {(r["block_number"], r["event_seq"]): r["log_index"] for r in out} == {(b, s): s - 1 - s // 3 for b, s in rows}


def events_table(spark, path, n):
    """n events over 300 hours as the supplied table has them."""
    second = 473_352 * 3600 + F.col("id") % 300 * 3600
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds(second).alias("ts"), (F.col("id") % 11).alias("user_id"), F.lit("error").alias("event_type"), F.lit(1.5).alias("value"), F.lit('{"k": 7}').alias("props"))
    rows.write.parquet(f"{path}/events.parquet")


def test_a_page_past_the_end_of_a_larger_log(spark, tmp_path):
    events_table(spark, tmp_path, 150_100)
    assert catalog.QUERIES["page_past_end"](spark, str(tmp_path)).count() == 0


def test_parts_of_a_log_are_whole_and_filtered_below_its_window(spark, tmp_path):
    events_table(spark, tmp_path, 3000)
    log = adapters.log(spark, str(tmp_path))
    parts = catalog._by_blocks(log, [473_400, 473_500])
    got = [[tuple(r) for r in p.select("block_number", "log_index").collect()] for p in parts]
    assert sorted(r for p in got for r in p) == sorted(tuple(r) for r in log.select("block_number", "log_index").collect())
    assert max(got[0]) < (473_400, 1) <= min(got[1]) and max(got[1]) < (473_500, 1) <= min(got[2])
    for part in parts:
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "Filter" in plan[plan.index("Window") :] and "Repartition" not in plan  # no part is one task's


def test_files_of_a_micro_batch_are_as_many_as_cores(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("block_number"), F.lit(0).alias("log_index"))
    files = catalog._split(rows, str(tmp_path / "raw"), 3)
    assert files == spark.sparkContext.defaultParallelism > 1
    assert len(list((tmp_path / "raw").glob("*.parquet"))) == 3 * files
