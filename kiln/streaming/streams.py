"""Structured Streaming operators.

Sources are file streams over parquet (a glob path: a plain file path is not
a valid stream source).  Event time is cast to TIMESTAMP because watermarks
reject TIMESTAMP_NTZ.  State is bounded: every stateful operator forgets what
lies behind its watermark.

A run has a checkpoint and an output folder under the session's checkpoint
directory (the shared folder named by ``spark.checkpoint.dir`` on a cluster).
``new_run`` with a ``run_id`` always gives the same folders, so that a restarted
driver resumes where its checkpoint ends; without one every run is a new one.

Sinks: ``run_append`` writes rows once they are final (Spark's parquet sink);
``run_batches`` writes each micro-batch to a folder of its own, named after its
number: a batch that is replayed after a failure replaces its own folder and
writes nothing twice.  ``latest`` then keeps the newest version of each key.

``run_*`` drive a stream to completion with ``availableNow`` and return a batch
DataFrame reading the sink -- that is how the registered queries and tests
compare streams with their batch equivalents.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kiln.functions.text import fixed_map
from kiln.operators import ml, reports, sensors
from kiln.operators import triage as triage_ops
from kiln.session import ensure_checkpoint_dir
from kiln.sources.tables import table_path
from kiln.sources.views import VIEW_DEPS, VIEW_SQL

STATE_BUCKETS = 4096         # of the keys of a stream: a constant, as a checkpoint's state lies in them
NO_NUMBER = (1 << 63) - 1    # stands for a call without a sequence number: after all others


@dataclass
class StreamRun:
    checkpoint: str
    output: str


def new_run(spark: SparkSession, name: str, run_id: str | None = None) -> StreamRun:
    """Folders of a run: with a ``run_id`` the same ones each time, so that it resumes; else new ones."""
    root = os.path.join(os.path.dirname(ensure_checkpoint_dir(spark).rstrip("/")) if run_id else ensure_checkpoint_dir(spark), "kiln-streams")
    base = os.path.join(root, f"{name}-{run_id or uuid.uuid4().hex[:12]}")
    return StreamRun(os.path.join(base, "checkpoint"), os.path.join(base, "output"))


def read_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int | None = None) -> DataFrame:
    """A parquet file stream over one driver table (schema from the batch files)."""
    path = table_path(sf_dir, table)
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path.replace(f"{table}.parquet", f"{table}*.parquet"))


def stream_view(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A derived view over streaming base tables (stateless projections only)."""
    args = {t: read_stream(spark, sf_dir, t) for t in VIEW_DEPS[view]}
    return spark.sql(VIEW_SQL[view], **args)


def event_time(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.col(col).cast("timestamp"))


# --- operators (streaming DataFrame in, streaming DataFrame out) --------------

def _first_seen(idle_ms: int) -> Callable:
    """State of a bucket of (run, role) keys: of each its tools, each with the first sequence number seen, and its last call.

    A call into Python for each key would cost more than the key's calls.
    """
    def update(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        # keys idle for too long are forgotten
        held = {(run, role): (dict(zip(names, numbers, strict=True)), last)
                for run, role, names, numbers, last in (zip(*state.get, strict=True) if state.exists else ()) if last + idle_ms > now}
        changed = {}
        if not state.hasTimedOut:
            for pdf in frames:
                text = [[v if isinstance(v, str) else None for v in pdf[c].to_numpy()] for c in ("run_id", "agent_role", "tool_name")]
                for run, role, tool, seq, ms in zip(*text, pdf["seq"].tolist(), pdf["ms"].tolist(), strict=True):
                    seen, last = held.get((run, role), (None, 0))
                    if seen is None:
                        seen = {}
                    if seq < seen.get(tool, NO_NUMBER + 1):
                        seen[tool] = seq
                    held[run, role] = changed[run, role] = (seen, max(last, ms))
        if not held:
            state.remove()
        else:
            rows = [(run, role, list(seen), list(seen.values()), last) for (run, role), (seen, last) in held.items()]
            state.update(tuple(map(list, zip(*rows, strict=True))))
            state.setTimeoutTimestamp(max(min(r[-1] for r in rows), now) + idle_ms)
        if changed:
            out = []
            for (run, role), (seen, _) in changed.items():
                order = sorted(seen, key=lambda t, seen=seen: (seen[t], t or ""))
                out.append((run, role, seen[order[0]], order))
            out = pd.DataFrame(out, columns=["run_id", "agent_role", "first_seq", "tools"])
            yield out
    return update


def stream_tools_by_role(log: DataFrame, delay: str = "1 day", idle_days: float = 7) -> DataFrame:
    """The distinct tools of each (run, role) in first-seen order, as D6.

    Rows of (run_id, agent_role, first_seq, tools): a new version of a key's row
    whenever one of its calls arrives (update mode; see ``latest``).  State holds
    the tools of a key, not its calls, and lies in ``STATE_BUCKETS`` buckets of keys.  Calls older than ``delay`` before the newest
    of the batches up to the last but one are dropped, and a key without calls for ``idle_days`` of event time is forgotten.
    """
    role = F.coalesce(F.nullif(F.col("agent_role"), F.lit("")), F.lit(reports.UNKNOWN_ROLE))
    calls = event_time(log, "ts").withColumn("agent_role", role).withWatermark("ts", delay)
    types = dict(log.dtypes)
    schema = "run_id string, agent_role string, first_seq long, tools array<string>"
    held = "runs array<string>, roles array<string>, tools array<array<string>>, seqs array<array<long>>, lasts array<long>"
    bucket = F.pmod(F.xxhash64("run_id", "agent_role"), F.lit(STATE_BUCKETS)).cast("int")
    found = (calls.select(bucket.alias("_bucket"), F.col("run_id").cast("string").alias("run_id"), "agent_role", "tool_name",
                          F.coalesce(F.col("seq").cast("long"), F.lit(NO_NUMBER)).alias("seq"), "ts",
                          F.coalesce(F.unix_millis("ts"), F.lit(0)).alias("ms"))
             .groupBy("_bucket")
             .applyInPandasWithState(_first_seen(int(idle_days * 86_400_000)), schema, held, "update", GroupStateTimeout.EventTimeTimeout))
    return found.select(F.col("run_id").cast(types["run_id"]).alias("run_id"), "agent_role",
                        F.nullif(F.col("first_seq"), F.lit(NO_NUMBER)).alias("first_seq"), "tools")


def stream_label_and_score(readings: DataFrame, model=None) -> DataFrame:
    """Stateless labelling of sensor readings, and their scoring by a saved model (see ``ml.score_failures``)."""
    labelled = sensors.label_failures(readings)
    return labelled if model is None else ml.score_failures(model, labelled)


def wall_clock(ts: Column) -> Column:
    """The instant at which clocks in UTC show ``ts``, whatever the session's time zone."""
    return F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone())


def cost_events(cases: DataFrame, tickets: DataFrame) -> DataFrame:
    """Both cost streams as one table of events: ts, maintenance and compensation amounts, whether a ticket."""
    rate = fixed_map(reports.COMPENSATION_RATES)
    money = "decimal(18,2)"
    return cases.select(
        wall_clock(F.col("tanggal")).alias("ts"), F.col("biaya_perbaikan_idr").cast(money).alias("m"),
        F.lit(0).cast(money).alias("c"), F.lit(0).alias("ticket"),
    ).unionByName(tickets.select(
        wall_clock(F.col("tanggal")).alias("ts"), F.lit(0).cast(money).alias("m"),
        F.coalesce(rate[F.col("kategori")], F.lit(0)).cast(money).alias("c"), F.lit(1).alias("ticket")))


def stream_weekly_cost(cases: DataFrame, tickets: DataFrame, delay: str = "30 days") -> DataFrame:
    """Maintenance cost and complaint compensation per Monday-start week (tumbling event-time windows).

    In append mode a week comes once, when the watermark has passed its end, and
    its state is freed; events of weeks that are closed are dropped.  In update
    mode open weeks come too, in versions.
    """
    events = cost_events(cases, tickets).withWatermark("ts", delay)
    week = F.window("ts", "7 days", "7 days", "4 days")       # the epoch was a Thursday
    return events.groupBy(week).agg(F.sum("m").alias("m"), F.sum("c").alias("c"), F.sum("ticket").alias("n_tickets")).select(
        F.to_date(F.to_utc_timestamp(F.col("window.start"), F.current_timezone())).alias("minggu"),
        F.col("m").cast("double").alias("biaya_maintenance_idr"), F.col("c").cast("double").alias("biaya_kompensasi_cs_idr"),
        "n_tickets", (F.col("m").cast("double") + F.col("c").cast("double")).alias("total_biaya_operasional_idr"))


def with_pending_vendors(weeks: DataFrame, vendors: DataFrame) -> DataFrame:
    """The snapshot of pending vendors beside each week, as C5 has it."""
    return weeks.select("minggu", "biaya_maintenance_idr", "biaya_kompensasi_cs_idr",
                        reports.pending_vendor_count(vendors).alias("vendor_pending_count"), "total_biaya_operasional_idr")


def stream_triage(questions: DataFrame) -> DataFrame:
    """I4: stateless triage of a question stream."""
    t = triage_ops.triage(questions)
    return t.select("query_id",
                    F.array_join("intents", ",").alias("intents"),
                    F.array_join("plan", ",").alias("plan"),
                    F.size("intents").alias("n_intents"),
                    F.col("in_scope").cast("int").alias("in_scope"),
                    triage_ops.ids_text(F.col("ids")).alias("ids"))


# --- drivers --------------------------------------------------------------------

def _drain(query, timeout_s: float | None) -> None:
    """Wait until the stream has ended.  Past a caller's limit it is stopped and
    the call fails: a partial sink is never taken for the result."""
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"stream not drained within {timeout_s} s")
    if query.exception() is not None:
        raise query.exception()


def run_append(stream: DataFrame, run: StreamRun, timeout_s: float | None = None) -> DataFrame:
    """Drain a stream with ``availableNow`` into a parquet sink (append mode)."""
    q = (stream.writeStream.format("parquet").option("path", run.output)
         .option("checkpointLocation", run.checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    _drain(q, timeout_s)
    return stream.sparkSession.read.schema(stream.schema).parquet(run.output)


def run_batches(stream: DataFrame, run: StreamRun, mode: str = "append", finish: Callable[[DataFrame], DataFrame] = lambda d: d,
                timeout_s: float | None = None) -> DataFrame:
    """Drain a stream into one folder per micro-batch; returns all rows with their ``batch``.

    ``finish`` completes a micro-batch as a plain DataFrame, say with a snapshot of
    a table that no stream holds.
    """
    def write(batch: DataFrame, number: int) -> None:
        finish(batch).write.mode("overwrite").parquet(os.path.join(run.output, f"batch={number}"))

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", run.checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    _drain(q, timeout_s)
    return read_batches(stream.sparkSession, run)


def read_batches(spark: SparkSession, run: StreamRun) -> DataFrame:
    """All rows of a run's sink, with the number of their ``batch``."""
    return spark.read.option("basePath", run.output).parquet(run.output)


def latest(versions: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of each key of a sink of batches."""
    others = [c for c in versions.columns if c not in (*keys, "batch")]
    return (versions.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col("batch")).alias("_row"))
            .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others]))
