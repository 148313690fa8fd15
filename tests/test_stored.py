"""Stored tables and stateful streams: any split and order of batches, repeats, restarts."""

import os
import random
import shutil
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from evtlake.operators import changelog as ch
from evtlake.operators import lifecycle, ranges, registry, tables, views
from evtlake.schemas import Aggregate
from evtlake.streaming import stateful, stored, streams
from evtlake.streaming.versions import Version, Versioned

LOG = "block_number bigint, log_index bigint, who string, v bigint"
rng = random.Random(3)
ROWS = [(rng.randrange(60), i, rng.choice(["a", "b", "c", None]), rng.randrange(100)) for i in range(200)]
AGGS = [Aggregate("s", "sum", "v"), Aggregate("n", "count", "v"), Aggregate("a", "avg", "v")]


def rows_of(df):
    return sorted(map(repr, df.collect()))


def shuffled(n):
    """The rows in n batches in no order, some of them twice under their number."""
    parts = [[] for _ in range(n)]
    for r in rng.sample(ROWS, len(ROWS)):
        parts[rng.randrange(n)].append(r)
    order = [*range(n), *rng.sample(range(n), min(n, 2))]
    rng.shuffle(order)
    return parts, order


@pytest.mark.parametrize("n", [1, 3])
def test_unique_and_log(spark, tmp_path, n):
    df = spark.createDataFrame(ROWS, LOG)
    parts, order = shuffled(n)
    unique = stored.UniqueTable(spark, str(tmp_path / "u"), df.schema, ["who"], 4)
    first = stored.UniqueTable(spark, str(tmp_path / "f"), df.schema, ["who"], 4, first=True)
    log = stored.LogTable(spark, str(tmp_path / "l"), df.schema, 7)
    for batch in order:
        rows = spark.createDataFrame(parts[batch], LOG)
        for take in (unique.merge, first.merge, log.append):
            take(rows, "w", batch)
    assert rows_of(unique.read()) == rows_of(tables.latest(df, "who"))
    assert rows_of(first.read()) == rows_of(tables.earliest(df, "who"))
    assert rows_of(log.read()) == rows_of(df)
    assert rows_of(log.read(10, 30)) == rows_of(df.where("block_number BETWEEN 10 AND 30"))
    assert unique.store.version().applied == {"w": ((0, n - 1),)}
    newest = log.latest()
    assert rows_of(newest) == rows_of(df.orderBy(F.desc("block_number"), F.desc("log_index")).limit(1))
    assert {f.split("_bucket=")[1].split("/")[0] for f in newest.inputFiles()} == {"8"}
    assert stored.LogTable(spark, str(tmp_path / "none"), df.schema).latest().count() == 0


def test_redelivered_rows_replace_themselves(spark, tmp_path):
    log = stored.LogTable(spark, str(tmp_path / "l"), spark.createDataFrame([], LOG).schema, 10)
    log.append(spark.createDataFrame([(1, 0, "a", 1), (1, 1, "a", 2), (25, 0, "b", 3), (None, 0, "n", 4)], LOG), "w", 0)
    before = log.store.version()
    log.append(spark.createDataFrame([(1, 1, "a", 9), (1, 1, "a", 9), (30, 0, "c", 5), (None, 0, "n", 6)], LOG), "w", 1)
    after = log.store.version()
    assert {tuple(r) for r in log.read().collect()} == {(1, 0, "a", 1), (1, 1, "a", 9), (25, 0, "b", 3), (30, 0, "c", 5), (None, 0, "n", 6)}
    assert after.folders[2] == before.folders[2] and after.folders[0] != before.folders[0]
    log.append(spark.createDataFrame([], LOG), "w", 2)
    assert log.store.version().has("w", 2) and log.read().count() == 5


def test_the_later_ingest_seq_of_a_position_stays(spark, tmp_path):
    schema = LOG + ", ingest_seq bigint"
    rows = [(rng.choice([1, 12, 25, None]), rng.randrange(4), rng.choice("ab"), i, rng.choice([None, 0, 1, 2])) for i in range(90)]
    log = stored.LogTable(spark, str(tmp_path / "l"), spark.createDataFrame([], schema).schema, 10)
    best = {}
    for batch in range(3):
        part = rows[batch * 30 : batch * 30 + 30]
        log.append(spark.createDataFrame(part, schema), "w", batch)
        for r in part:
            rank = (-1 if r[4] is None else r[4], batch)
            if rank >= best.get(r[:2], ((-2,), []))[0]:
                best[r[:2]] = rank, [*(best[r[:2]][1] if best.get(r[:2], (None,))[0] == rank else []), r]
    got = [tuple(r) for r in log.read().collect()]
    assert sorted(map(repr, (r[:2] for r in got))) == sorted(map(repr, best))
    assert all(r in best[r[:2]][1] for r in got)  # rows of one batch and ingest_seq are equals


def test_a_batch_is_cached_once_and_shuffled_once(spark, tmp_path, monkeypatch):
    plans, write = [], Versioned.write

    def seen(self, rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return write(self, rows)

    df = spark.createDataFrame(ROWS, LOG).withColumns({"contract_address": F.concat(F.lit("0x"), "who"), "event_name": F.lit("new")})
    df.write.parquet(str(tmp_path / "raw"))
    rows = spark.read.parquet(str(tmp_path / "raw"))
    children = lambda e: registry.children(e, "f", "new", "who", "abi")
    table = stored.ChildLog(spark, str(tmp_path / "t"), rows.schema, children, children(rows).schema, 7)
    assert "RDD" not in table.read()._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(Versioned, "write", seen)
    table.append(rows.where("block_number < 31"), "w", 0)
    table.append(rows.where("block_number >= 31"), "w", 1)
    logs = [p for p in plans if "rangepartitioning" in p]
    assert len(logs) == 2
    assert all(p.count("partitioning(") == 1 and p.count("InMemoryRelation") == 1 for p in logs)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_undone_ranges(spark, tmp_path):
    schema = LOG + ", ingest_seq bigint"
    df = spark.createDataFrame([(*r, r[1] % 3) for r in ROWS], schema)
    log = stored.LogTable(spark, str(tmp_path / "l"), df.schema, 7)
    log.append(df.where("v < 50"), "w", 0)
    log.append(df.where("v >= 50"), "w", 1)
    notices = [(10, 16, 2), (40, 44, 1), (9, 3, 3), (500, 600, 4)]
    written = files(tmp_path)
    for notice in (*notices, notices[0]):
        log.undo(*notice)
    reorgs = spark.createDataFrame(notices, "start_block bigint, end_block bigint, seq bigint")
    assert rows_of(log.read()) == rows_of(ch.surviving(df, reorgs))
    assert all(files(tmp_path)[f] == t for f, t in written.items())
    version = log.store.version()
    untouched = [b for b in version.folders if not (10 // 7 <= b <= 16 // 7 or 40 // 7 <= b <= 44 // 7)]
    assert untouched and all(len(version.folders[b]) == 2 for b in untouched)
    log.undo(10, 16, 2)
    assert log.store.version() == version
    kept = rows_of(log.read())
    log.confirm_depth(5)
    top = df.agg(F.max("block_number")).first()[0]
    done = log.store.version()
    assert done.notes == {"confirmed": top - 5} and all(len(f) == 1 for b, f in done.folders.items() if (b + 1) * 7 <= top - 5)
    log.undo(0, top - 5, 9)  # confirmed blocks stay
    assert rows_of(log.read()) == kept
    log.store.vacuum(1)
    assert rows_of(log.read()) == kept and len(log.store.numbers()) == 1
    assert {f for f in files(tmp_path)} == {f for f in files(tmp_path) if any(x in f for fs in log.store.version().folders.values() for x in fs)}


@pytest.mark.parametrize("n", [1, 4])
def test_totals(spark, tmp_path, n, monkeypatch):
    monkeypatch.setattr(stored, "PARTS", 2)
    changes = spark.createDataFrame([(rng.choice(["insert", "insert", "update", "delete"]), v) for *_, v in ROWS], "op string, v bigint").withColumn("part", F.monotonically_increasing_id() % n).persist()
    table = stored.TotalsTable(spark, str(tmp_path / "t"), AGGS)
    assert tuple(table.read().first()) == (0.0, 0, 0.0)
    for batch in [*range(n), 0, n - 1]:
        table.add(changes.where(F.col("part") == batch), "w", batch)
    assert table.read().first() == tables.merged_deltas(tables.deltas(changes, AGGS), AGGS).first()
    assert len(table.store.version().folders[0]) <= 2


def test_two_writers_and_broken_ones(spark, tmp_path):
    store = Versioned(spark, str(tmp_path), spark.createDataFrame([], LOG).schema)
    old = store.version()
    store.publish(old, Version().with_batch("a", 0))
    with pytest.raises(Exception, match="exists|Exist"):
        store.publish(old, Version().with_batch("b", 0))
    assert store.version().applied == {"a": ((0, 0),)} and store.read().count() == 0
    ranges_ = Version().with_batch("a", 5).with_batch("a", 3).with_batch("a", 4).with_batch("a", 9)
    assert ranges_.applied == {"a": ((3, 5), (9, 9))} and ranges_.has("a", 4) and not ranges_.has("a", 6)


def test_a_stream_keeps_a_table_over_restarts(spark, tmp_path):
    df = spark.createDataFrame(ROWS, LOG)
    table = stored.UniqueTable(spark, str(tmp_path / "u"), df.schema, ["who"], 4)
    for i in range(3):
        df.where(F.col("log_index") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "raw"))
        stored.kept_by(streams.raw_stream(spark, str(tmp_path / "raw"), LOG, 1), table.merge, "s", str(tmp_path / "c")).awaitTermination()
    assert rows_of(table.read()) == rows_of(tables.latest(df, "who")) and table.store.version().applied == {"s": ((0, 2),)}


def test_frozen_and_child_logs_for_any_split(spark, tmp_path):
    schema = "contract_name string, contract_address string, event_name string, block_number bigint, log_index bigint, child string"
    rows = [(f"c{i % 3}", f"0x{i % 3}", "end" if i in (40, 43, 70) else "new" if i % 9 == 0 else "x", i // 4, i % 4, f"0x{i % 3}" if i % 2 else None) for i in range(100)]
    df = spark.createDataFrame(rows, schema)
    rules = spark.createDataFrame([("c1", "local", "end")], "contract_name string, kind string, event string")
    triggers = lambda e: lifecycle.local_triggers(e, rules)
    children = lambda e: registry.children(e, "f", "new", "child", "abi")
    want_frozen = rows_of(lifecycle.until_frozen(df, triggers(df)))
    want_children = rows_of(registry.child_events(df.drop("contract_name"), registry.first_registrations(children(df))).select(*sorted(df.columns)))
    for k, cuts in enumerate(((), (50,), (10, 41, 42))):
        frozen = stored.FrozenLog(spark, str(tmp_path / f"z{k}"), df.schema, triggers, 5)
        child = stored.ChildLog(spark, str(tmp_path / f"y{k}"), df.schema, children, children(df).schema, 5)
        edges = [0, *cuts, len(rows)]
        for batch, (a, b) in enumerate(zip(edges, edges[1:])):
            part = spark.createDataFrame(rows[a:b], schema)
            for _ in range(2):
                frozen.append(part, "w", batch)
                child.append(part, "w", batch)
        assert rows_of(frozen.read().select(*df.columns)) == want_frozen
        assert rows_of(frozen.log.read().select(*df.columns)) == want_frozen  # cut when written, not only when read
        assert rows_of(child.read().select(*sorted(df.columns))) == want_children
    late = stored.FrozenLog(spark, str(tmp_path / "late"), df.schema, triggers, 5)
    for batch, part in enumerate((rows[60:], rows[:60])):
        late.append(spark.createDataFrame(part, schema), "w", batch)
    assert rows_of(late.read().select(*df.columns)) == want_frozen


def run(stream, path, checkpoint):
    streams.appended(stream, str(path), str(checkpoint)).awaitTermination()


def fed(spark, tmp_path, name, batches, schema, operator, out):
    """What operator gives on a stream of files, stopped and started again after each."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "raw"))
        run(operator(streams.raw_stream(spark, str(tmp_path / name / "raw"), schema, 1)), tmp_path / name / "out", tmp_path / name / "c")
    return [tuple(r) for r in spark.read.schema(out).parquet(str(tmp_path / name / "out")).collect()]


def test_numbers_in_a_block_over_restarts(spark, tmp_path):
    rows = [(i // 10, i) for i in range(45)]
    got = fed(spark, tmp_path, "n", [rows[:4], rows[4:27], rows[27:]], "block_number bigint, event_seq bigint", stateful.with_log_index, "block_number bigint, event_seq bigint, log_index bigint")
    assert sorted(got) == [(b, s, s % 10) for b, s in rows]


def test_pending_rows_over_restarts(spark, tmp_path):
    schema = "block_number bigint, log_index bigint, ingest_seq bigint"
    rows = [(b, i, 0) for b in range(30) for i in range(2)]
    more = [(27, 0, 5), (60, 0, 5)]  # 27 comes again after the notice, 60 moves the height
    notices = [(25, 28, 3), (9, 4, 4)]
    spark.createDataFrame(notices, "start_block bigint, end_block bigint, seq bigint").write.parquet(str(tmp_path / "p" / "notices"))
    undone = lambda: spark.readStream.schema("start_block bigint, end_block bigint, seq bigint").parquet(str(tmp_path / "p" / "notices"))
    got = fed(spark, tmp_path, "p", [rows[:21], rows[21:], more], schema, lambda s: stateful.confirmed(s, undone(), 10), schema)
    assert sorted(got) == sorted([r for r in rows if not 25 <= r[0] <= 28] + [(27, 0, 5)])


def test_pending_rows_stay_in_the_jvm(spark, tmp_path):
    schema = "block_number bigint, log_index bigint, ingest_seq bigint"
    stream = spark.readStream.schema(schema).parquet(str(tmp_path))
    notices = spark.readStream.schema("start_block bigint, end_block bigint, seq bigint").parquet(str(tmp_path))
    for got in (stateful.confirmed(stream), stateful.confirmed(stream, notices)):
        assert "TransformWithState" not in got._jdf.queryExecution().analyzed().toString()


def test_debounce_over_restarts(spark, tmp_path):
    schema = "contract_address string, function string, ts bigint"
    times = sorted(rng.sample(range(1000, 2000), 60))
    edges = [0, 20, 21, 60]
    batches = [[(a, "f", t) for t in times[i:j] for a in ("0x1", "0x2")][::-1] for i, j in zip(edges, edges[1:])]
    got = fed(spark, tmp_path, "d", [*batches, [("", "", 9000)]], schema, lambda s: stateful.debounced(s, 50), schema)
    want = [(a, "f", t) for a in ("0x1", "0x2") for t in views.debounced_times(times, 50)]
    assert sorted(g for g in got if g[1]) == sorted(want)


class Kept:
    """A value or a list of one key's state, and how often it is read."""

    def __init__(self):
        self.held, self.reads = None, 0

    def exists(self):
        return self.held is not None

    def get(self):
        self.reads += 1
        return self.held

    def update(self, value):
        self.held = value

    put = update

    def appendList(self, values):
        self.held = [*(self.held or []), *values]

    def clear(self):
        self.held = None


def test_debounce_reads_waiting_triggers_once_a_batch():
    waiting, timers = Kept(), set()
    handle = SimpleNamespace(getListState=lambda *_: waiting, getValueState=lambda *_: Kept(), registerTimer=timers.add)
    view = stateful._Debounce(50)
    view.init(handle)
    times, got = sorted(rng.sample(range(1000, 9000), 600)), []
    for batch in (times[:400], times[400:], []):
        list(view.handleInputRows(("a", "f"), iter([{"ts": t} for t in batch]), None)) if batch else None
        now = (batch[-1] - 20 if batch else 10_000) * 1000  # some wait for the next batch
        while due := sorted(t for t in timers if t <= now):
            timers.remove(due[0])
            expired = SimpleNamespace(getExpiryTimeInMs=lambda t=due[0]: t)
            got += [r["ts"] for r in view.handleExpiredTimer(("a", "f"), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), expired)]
    assert got == views.debounced_times(times, 50)
    assert waiting.reads < 12


def test_followed_restarts_without_repeats(spark, tmp_path):
    schema = "block_number bigint, log_index bigint"
    live = str(tmp_path / "live")
    stored_rows = [(b, 0) for b in range(10)]
    spark.createDataFrame([(b, 0) for b in range(8, 14)], schema).coalesce(1).write.parquet(live)
    for more in ([], [(b, 0) for b in range(10, 14)]):  # the stored log has grown by the second start
        if more:
            spark.createDataFrame([(b, 0) for b in range(14, 16)], schema).coalesce(1).write.mode("append").parquet(live)
        log = spark.createDataFrame(stored_rows + more, schema)
        streams.followed(log, streams.raw_stream(spark, live, schema), 3, 0, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = [r[0] for r in spark.read.schema("event_id string").parquet(str(tmp_path / "out" / "*")).collect()]
    assert sorted(got) == sorted(f"{b}:0" for b in range(4, 16))


def test_followed_after_a_break_in_the_replay(spark, tmp_path):
    schema = "block_number bigint, log_index bigint"
    spark.createDataFrame([(5, 0)], schema).write.parquet(str(tmp_path / "live"))
    log = spark.createDataFrame([(1, 0), (2, 0)], schema)
    go = lambda: streams.followed(log, streams.raw_stream(spark, str(tmp_path / "live"), schema), 0, 0, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    go()
    shutil.rmtree(tmp_path / "out" / "replay")
    log = log.unionByName(spark.createDataFrame([(5, 0)], schema))
    go()
    assert sorted(r[0] for r in spark.read.schema("event_id string").parquet(str(tmp_path / "out" / "*")).collect()) == ["1:0", "2:0", "5:0"]


def test_points_in_ranges(spark):
    spans = [(rng.randrange(300), rng.randrange(300), i) for i in range(60)] + [(5, 5, 60), (0, 2**40, 61), (None, 9, 62), (7, None, 63), (-5, 3, 64)]
    points = spark.createDataFrame([(p,) for p in [*range(300), None]], "p bigint")
    spans_df = spark.createDataFrame(spans, "a bigint, b bigint, i bigint")
    joined = ranges.within(points, "p", spans_df, "a", "b")
    want = [(p, i) for p in range(300) for a, b, i in spans if a is not None and b is not None and a <= p <= b]
    assert sorted((r["p"], r["i"]) for r in joined.collect()) == sorted(want)
    assert ranges.within(points, "p", spans_df.where("false"), "a", "b").count() == 0
    reorgs = spans_df.toDF("start_block", "end_block", "seq")
    log = points.select(F.col("p").alias("block_number"), F.lit(0).alias("log_index"))
    for df in (ch.surviving(log, reorgs), ch.surviving_contracts(log.select(F.col("block_number").alias("start_block"), F.lit(True).alias("dynamic")), reorgs)):
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin BuildRight, Cross", "")


def test_many_ranges(spark):
    points = spark.range(1_000_000).withColumnRenamed("id", "p")
    spans = spark.range(100_000).select((F.col("id") * 10).alias("a"), (F.col("id") * 10 + 4).alias("b"))
    assert ranges.within(points, "p", spans, "a", "b").count() == 500_000


def test_exact_sum_signs(spark):
    values = ["-5", "7", "+3", "x", "1.5", None, "-" + "9" * 78]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert tables.exact_sum(df, "v").first()[0] == str(5 - int("9" * 78))
    assert tables.exact_sum(df.limit(2), "v").first()[0] == "2"
    assert tables.exact_sum(df.where("v = '-5'"), "v").first()[0] == "-5"
