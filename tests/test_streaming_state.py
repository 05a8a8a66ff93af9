"""Streams with state: late events, freed state, replayed batches, restarts."""

import datetime as dt
import glob
import os
import shutil

import pytest

from kiln.operators import ml, reports, sensors
from kiln.plans.context import Ctx
from kiln.streaming import streams

SF = "/root/testdata/sf0.001"
DAY = dt.datetime(2026, 3, 2)          # a Monday


class Feed:
    """A folder of files, one micro-batch each, in order."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, str(path), schema, 0

    def add(self, rows):
        part = f"{self.path}-part{self.n}"
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(part)
        os.makedirs(self.path, exist_ok=True)
        for f in glob.glob(f"{part}/*.parquet"):
            target = f"{self.path}/{self.n:03d}.parquet"
            shutil.copyfile(f, target)
            os.utime(target, (1_700_000_000 + self.n, 1_700_000_000 + self.n))
        self.n += 1
        return self

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


LOG = "seq long, ts timestamp, run_id int, agent_role string, tool_name string"


def call(seq, hours, run, role, tool):
    return seq, DAY + dt.timedelta(hours=hours), run, role, tool


def tools(spark, versions):
    return {(r.run_id, r.agent_role): (r.first_seq, r.tools) for r in streams.latest(versions, ["run_id", "agent_role"]).collect()}


def run_tools(spark, feed, run):
    return streams.run_batches(streams.stream_tools_by_role(feed.stream(), "2 hours", idle_days=0.5), run, "update")


def test_tools_in_first_seen_order_over_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path / "log", LOG)
    feed.add([call(5, 0, 1, "a", "x"), call(6, 0, 1, "a", "y"), call(7, 0, 1, None, "x"), call(8, 0, 2, "", "z")])
    feed.add([call(3, 1, 1, "a", "z"), call(9, 1, 1, "a", "x"), call(10, 1, 2, None, None)])      # an earlier number arrives later
    run = streams.new_run(spark, "t")
    got = tools(spark, run_tools(spark, feed, run))
    rows = [r for k in (0, 1) for r in spark.read.parquet(f"{tmp_path}/log-part{k}").collect()]
    want = {(r.run_id, r.agent_role): (r.first_seq, r.tools)
            for r in reports.tool_usage_by_role(spark.createDataFrame(rows, LOG)).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {k: v for k, v in want.items() if k[0] == 1}
    assert got[1, "a"] == (3, ["z", "x", "y"]) and got[2, "unknown"] == (8, ["z", None])


def test_late_calls_are_dropped_and_idle_keys_forgotten(spark, tmp_path):
    feed = Feed(spark, tmp_path / "log", LOG)
    feed.add([call(1, 0, 1, "a", "x")])
    feed.add([call(2, 10, 2, "a", "x")])                 # the watermark moves on to hour 8
    feed.add([call(2, 10, 2, "a", "x")])
    feed.add([call(3, 1, 1, "a", "late"), call(4, 10, 1, "a", "y")])       # hour 1 is behind it, and was in the batch before
    feed.add([call(5, 100, 3, "a", "x")])                # everything else is idle
    feed.add([call(6, 101, 1, "a", "again")])            # the key starts anew
    run = streams.new_run(spark, "t")
    versions = run_tools(spark, feed, run)
    first = {tuple(r.tools) for r in versions.filter("run_id = 1 and first_seq < 6").collect()}
    assert first == {("x",), ("x", "y")}
    assert tools(spark, versions)[1, "a"] == (6, ["again"])
    # what the last batch left in the state store: the keys of the last hours only
    state = spark.read.format("statestore").load(run.checkpoint).select("key.*").collect()
    assert len(state) <= 2


COST = "tanggal timestamp, biaya_perbaikan_idr double"
TICKET = "tanggal timestamp, kategori string"


def weekly(spark, cases, tickets, run, mode="append"):
    return streams.run_batches(streams.stream_weekly_cost(cases.stream(), tickets.stream(), "10 days"), run, mode)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_closed_weeks_late_events_and_restart(spark, tmp_path):
    cases, tickets = Feed(spark, tmp_path / "cases", COST), Feed(spark, tmp_path / "tickets", TICKET)
    cases.add([(day(0), 10.25), (day(6), 5.5), (day(8), 100.0)])
    tickets.add([(day(1), "produk_cacat"), (day(9), None)])
    run = streams.new_run(spark, "weeks")
    assert weekly(spark, cases, tickets, run).count() == 0              # nothing is ten days old yet
    cases.add([(day(2), 1.0), (day(20), 7.0)])                          # in time; then the first week closes
    tickets.add([(day(13), "eskalasi_kritikal")])
    again = {str(r.minggu): (r.biaya_maintenance_idr, r.biaya_kompensasi_cs_idr, r.n_tickets, r.total_biaya_operasional_idr)
             for r in weekly(spark, cases, tickets, run).collect()}      # a restart from the checkpoint
    assert again == {"2026-03-02": (16.75, 400000.0, 1, 400016.75)}
    cases.add([(day(3), 999.0), (day(40), 1.0)])                        # the first week is closed: dropped
    tickets.add([(day(40), None)])
    rows = weekly(spark, cases, tickets, run).collect()
    assert sorted((str(r.minggu), r.biaya_maintenance_idr) for r in rows) == [
        ("2026-03-02", 16.75), ("2026-03-09", 100.0), ("2026-03-16", 7.0)]


def test_weeks_do_not_depend_on_the_time_zone(spark, tmp_path):
    """Wall-clock values: Sunday late stays in its week in any session zone."""
    schema = "tanggal timestamp_ntz, biaya_perbaikan_idr double"
    late = dt.datetime(2026, 3, 8, 23, 30)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for k, zone in enumerate(("UTC", "Asia/Jakarta", "America/New_York")):
            spark.conf.set("spark.sql.session.timeZone", zone)
            cases, tickets = Feed(spark, tmp_path / f"c{k}", schema), Feed(spark, tmp_path / f"t{k}", "tanggal timestamp_ntz, kategori string")
            cases.add([(late, 3.0)])
            tickets.add([(late, "retur_barang")])
            got = streams.latest(weekly(spark, cases, tickets, streams.new_run(spark, "z"), "update"), ["minggu"]).collect()
            assert [(str(r.minggu), r.biaya_maintenance_idr, r.biaya_kompensasi_cs_idr) for r in got] == [("2026-03-02", 3.0, 250000.0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_scored_stream_equals_batch_and_replays(spark, tmp_path):
    readings = Ctx(spark, SF).sensor.cache()
    model = ml.train_forest(readings, trees=5, depth=4)
    ml.save_model(model, f"{tmp_path}/model")
    loaded = ml.load_model(f"{tmp_path}/model")
    parts = readings.randomSplit([0.5, 0.5], seed=1)
    feed = Feed(spark, tmp_path / "readings", readings.schema)
    for p in parts:
        feed.add(p.collect())
    cols = ["record_id", "failure_type", "predicted_failure", "top_classes"]
    run = streams.new_run(spark, "score")

    def once():
        return streams.run_batches(streams.stream_label_and_score(feed.stream(), loaded).select(*cols), run)

    want = sorted(map(tuple, ml.score_failures(loaded, sensors.label_failures(readings)).select(*cols).collect()))
    assert sorted(map(tuple, once().select(*cols).collect())) == want
    # the last batch was written, but its commit was lost: it is replayed and replaces itself
    commits = [f for f in glob.glob(f"{run.checkpoint.removeprefix('file:')}/commits/*") if os.path.basename(f).isdigit()]
    lost = max(commits, key=lambda f: int(os.path.basename(f)))
    for f in (lost, os.path.join(os.path.dirname(lost), f".{os.path.basename(lost)}.crc")):
        os.remove(f)
    assert sorted(map(tuple, once().select(*cols).collect())) == want


def test_run_id_gives_the_same_folders(spark):
    a, b = streams.new_run(spark, "n", "daily"), streams.new_run(spark, "n", "daily")
    assert a == b != streams.new_run(spark, "n")
    with pytest.raises(AssertionError):
        assert streams.new_run(spark, "n") == streams.new_run(spark, "n")


class Held:
    """The state of a bucket that has none yet."""

    exists = hasTimedOut = False

    def update(self, value):
        self.value = value

    def setTimeoutTimestamp(self, ms):
        self.timeout = ms

    def getCurrentWatermarkMs(self):
        return 0


def test_one_call_for_a_bucket_of_keys():
    frames = [streams.pd.DataFrame({"run_id": ["1", "1", None], "agent_role": ["r", "r", "s"], "tool_name": ["b", "a", None],
                                    "seq": [5, 7, 6], "ms": [1, 3, 2]}),
              streams.pd.DataFrame({"run_id": ["1", None], "agent_role": ["r", "s"], "tool_name": ["a", None], "seq": [4, streams.NO_NUMBER],
                                    "ms": [9, 8]})]
    held = Held()
    out, = streams._first_seen(100)((0,), iter(frames), held)
    assert out.values.tolist() == [["1", "r", 4, ["a", "b"]], [None, "s", 6, [None]]]
    assert held.value == (["1", None], ["r", "s"], [["b", "a"], [None]], [[5, 4], [6]], [9, 8]) and held.timeout == 108


def test_keys_that_share_a_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "STATE_BUCKETS", 1)
    test_tools_in_first_seen_order_over_batches(spark, tmp_path / "order")
    feed = Feed(spark, tmp_path / "log", LOG)
    feed.add([call(1, 0, 1, "a", "x"), call(2, 3, 2, "a", "x")])
    feed.add([call(3, 14, 3, "a", "x")])                 # the watermark moves on to hour 12: run 1 is idle, run 2 is not
    feed.add([call(4, 14, 1, "a", "new"), call(5, 14, 2, "a", "y"), call(6, 14, None, "a", "z")])
    got = tools(spark, run_tools(spark, feed, streams.new_run(spark, "t")))
    assert got == {(1, "a"): (4, ["new"]), (2, "a"): (2, ["x", "y"]), (3, "a"): (3, ["x"]), (None, "a"): (6, ["z"])}
