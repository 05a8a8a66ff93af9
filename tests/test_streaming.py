"""Streams driven to completion equal their batch counterparts."""

import pytest
from pyspark.sql import functions as F

from kiln.operators import reports
from kiln.plans import queries as Q
from kiln.plans.context import Ctx
from kiln.streaming import streams

SF = "/root/testdata/sf0.001"


def test_stream_weekly_cost_equals_batch(spark):
    s = {(r.minggu, r.n_tickets) for r in Q.QUERIES["stream_weekly_cost"](spark, SF).collect()}
    t = Ctx(spark, SF).tickets
    b = {(r.minggu, r.n) for r in reports.weekly_sum(t, "tanggal", F.count(F.lit(1)), "n").collect()}
    assert s == b


def test_stream_past_its_limit_raises(spark):
    slow = F.udf(lambda x: __import__("time").sleep(20) or x, "long")
    s = streams.read_stream(spark, SF, "events").select(slow("event_id").alias("event_id"))
    with pytest.raises(TimeoutError):
        streams.run_append(s, streams.new_run(spark, "slow"), timeout_s=1)


def test_stream_triage_equals_batch(spark):
    a = {tuple(r) for r in Q.QUERIES["stream_triage"](spark, SF).collect()}
    b = {tuple(r) for r in Q.QUERIES["triage"](spark, SF).collect()}
    assert a == b


def test_stream_tool_usage_and_labels_equal_batch(spark):
    a = {tuple(r) for r in Q.QUERIES["stream_tool_usage"](spark, SF).collect()}
    u = Q.QUERIES["tool_usage_by_role"](spark, SF).collect()
    b = {(r.run_id, r.agent_role, t) for r in u for t in r.tools.split(", ")}
    assert a == b
    s = {tuple(r) for r in Q.QUERIES["stream_label_and_score"](spark, SF).collect()}
    t = {tuple(r) for r in Q.QUERIES["label_failures"](spark, SF).collect()}
    assert s == t
