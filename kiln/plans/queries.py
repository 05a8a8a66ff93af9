"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads whole driver tables (through the derived views) so its work
grows with them.  Array and map results are flattened to strings so the SQL
oracle can compare them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.operators import answers, dense, lookup, metrics, ml, reports, retrieval, sensors, split, textprep, tfidf
from kiln.operators import smote as smote_ops
from kiln.operators import triage as triage_ops
from kiln.operators.staging import materialize
from kiln.plans.context import Ctx
from kiln.sources import io
from kiln.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- reports ------------------------------------------------------------------

def _weekly(c: Ctx) -> DataFrame:
    return reports.weekly_operating_cost(c.cases, c.tickets, c.vendors)


@register
def weekly_operating_cost(spark, sf_dir):
    return _weekly(Ctx(spark, sf_dir))


@register
def cost_summary(spark, sf_dir):
    return reports.cost_summary(_weekly(Ctx(spark, sf_dir)), 4)


@register
def value_counts_failure(spark, sf_dir):
    return reports.value_counts(sensors.label_failures(Ctx(spark, sf_dir).sensor), "failure_type")


@register
def failure_rate(spark, sf_dir):
    return reports.failure_rate(sensors.label_failures(Ctx(spark, sf_dir).sensor))


@register
def tool_usage_by_role(spark, sf_dir):
    u = reports.tool_usage_by_role(Ctx(spark, sf_dir).tool_log)
    return u.select("run_id", "agent_role", "first_seq", F.array_join("tools", ", ").alias("tools"))


@register
def citations(spark, sf_dir):
    return reports.citations(Ctx(spark, sf_dir).tool_log)


@register
def latency_summary(spark, sf_dir):
    return reports.latency_summary(Ctx(spark, sf_dir).tool_log)


@register
def latency_quantiles(spark, sf_dir):
    return reports.merged_quantiles(reports.latency_sketches(Ctx(spark, sf_dir).tool_log))


# --- sensors ------------------------------------------------------------------

@register
def label_failures(spark, sf_dir):
    return sensors.label_failures(Ctx(spark, sf_dir).sensor).select(
        "record_id", "machine_id", "failure_type", "machine_failure")


@register
def derive_failure_type(spark, sf_dir):
    return sensors.derive_failure_type(Ctx(spark, sf_dir).raw_machine).select(
        "product_id", "machine_failure", "failure_type")


@register
def round_robin_machine(spark, sf_dir):
    return sensors.round_robin_machine(Ctx(spark, sf_dir).raw_machine).select(
        "product_id", "type", "type_index", "machine_id")


@register
def map_machine_schema(spark, sf_dir):
    return sensors.map_machine_schema(Ctx(spark, sf_dir).raw_machine)


# --- triage -------------------------------------------------------------------

def _triaged(c: Ctx) -> DataFrame:
    return triage_ops.triage(c.queries)


def _triaged_once(c: Ctx) -> DataFrame:
    # read by several branches (ID lookups, the anti-joined rest, plans): triage once
    return materialize(_triaged(c))


@register
def triage(spark, sf_dir):
    t = _triaged(Ctx(spark, sf_dir))
    return t.select("query_id",
                    F.array_join("intents", ",").alias("intents"),
                    F.array_join("plan", ",").alias("plan"),
                    F.size("intents").alias("n_intents"),
                    F.col("in_scope").cast("int").alias("in_scope"),
                    triage_ops.ids_text(F.col("ids")).alias("ids"))


@register
def classify_by_lexicon(spark, sf_dir):
    found = triage_ops.classify_by_lexicon(Ctx(spark, sf_dir).queries, triage_ops.lexicon_table(spark))
    return found.select("query_id", F.array_join("intents", ",").alias("intents"))


@register
def extract_ids(spark, sf_dir):
    return lookup.exploded_ids(_triaged(Ctx(spark, sf_dir)))


@register
def routing_eval(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return triage_ops.routing_eval(_triaged(c), c.routing)


@register
def out_of_scope(spark, sf_dir):
    return triage_ops.out_of_scope(_triaged(Ctx(spark, sf_dir)))


# --- lookups ------------------------------------------------------------------

def _labelled_sensors(c: Ctx) -> DataFrame:
    return sensors.label_failures(c.sensor)


@register
def exact_lookup(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return lookup.exact_lookup(_triaged_once(c), c.tickets, c.cases, _labelled_sensors(c))


@register
def po_lookup(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return lookup.po_lookup(_triaged(c), c.tickets)


@register
def vendor_lookup(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return lookup.vendor_lookup(c.vendor_keys, c.vendors)


@register
def vendor_gap_report(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return lookup.vendor_gap_report(c.vendors, lookup.checklist(spark))


# --- documents and retrieval --------------------------------------------------

CONV_KEYS = ("conv_id", "turn")


def _chunks(c: Ctx) -> DataFrame:
    # driver documents carry no "## " headings: sections are lines
    return textprep.chunk_sections(c.t.documents, "doc_id", "text", sep="\n", marker="")


def _conversation_queries(c: Ctx) -> DataFrame:
    return c.t.conversations.select("conv_id", "turn", F.col("text").alias("query"))


@register
def chunk_sections(spark, sf_dir):
    return _chunks(Ctx(spark, sf_dir))


def _case_history(c: Ctx) -> DataFrame:
    return textprep.build_case_history(c.cases, c.tickets)


@register
def build_case_history(spark, sf_dir):
    return _case_history(Ctx(spark, sf_dir))


@register
def upsert_documents(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    base = c.t.documents.select("doc_id", "text", "lang", "source")
    incoming = base.join(c.t.labels.select("doc_id", "quality", "toxic"), "doc_id", "inner")
    return textprep.upsert_documents(base, incoming, "doc_id")


@register
def tfidf_vocab(spark, sf_dir):
    v = tfidf.fit_vocabulary(Ctx(spark, sf_dir).t.documents, "doc_id", "text")
    return v.select("term", "term_index", "df", "cf", F.round("idf", 9).alias("idf"))


@register
def tfidf_search(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    index = tfidf.fit_index(c.t.documents, "doc_id", "text").cache()
    return tfidf.search(index, _conversation_queries(c), 3, CONV_KEYS, "query")


def _sop_hits(c: Ctx, k: int) -> DataFrame:
    chunks = _chunks(c)      # cut again where it is read: written, they would be as large as the documents
    return retrieval.sop_search(retrieval.sop_index(chunks).cache(), chunks, _conversation_queries(c), k, CONV_KEYS, "query")


@register
def sop_search(spark, sf_dir):
    return _sop_hits(Ctx(spark, sf_dir), 3).select(*CONV_KEYS, "rank", "doc_id", "source_id", "distance")


@register
def grounding_rate(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return retrieval.grounding_rate(_conversation_queries(c), _sop_hits(c, 1), CONV_KEYS)


@register
def citation_coverage(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    responses = retrieval.render_responses(_sop_hits(c, 2), CONV_KEYS)
    return retrieval.citation_coverage(_conversation_queries(c), responses, CONV_KEYS)


def _hybrid(c: Ctx, triaged: DataFrame | None = None) -> DataFrame:
    # read by the index build several times (counts, ids, size)
    history = materialize(_case_history(c))
    index = tfidf.fit_index(history, "doc_id", "text").cache()
    asked = _triaged_once(c) if triaged is None else triaged
    return retrieval.hybrid_search(asked, index, c.tickets, c.cases, _labelled_sensors(c), 3)


@register
def hybrid_search(spark, sf_dir):
    return _hybrid(Ctx(spark, sf_dir))


@register
def routing_accuracy(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return retrieval.routing_accuracy(_hybrid(c), c.routing)


# --- labels, splits, metrics ----------------------------------------------------

@register
def label_dictionary(spark, sf_dir):
    return split.label_dictionary(Ctx(spark, sf_dir).tickets, "kategori")


@register
def stratified_split(spark, sf_dir):
    ds = split.prepare_text_dataset(Ctx(spark, sf_dir).tickets)
    return ds.select("ticket_id", "label", "class_rank", "split")


@register
def class_weights(spark, sf_dir):
    w = split.class_weights(Ctx(spark, sf_dir).t.labels, "quality")
    return w.select("label", "n", F.round("weight", 9).alias("weight"))


def _rule_predictions(c: Ctx) -> DataFrame:
    """Truth: the current labelling rules; prediction: the older rule set."""
    return c.sensor.select(sensors.label_rule().alias("truth"),
                           sensors.label_rule(sensors.OSF_LIMITS_V2).alias("prediction"))


@register
def classification_scores(spark, sf_dir):
    s = metrics.classification_scores(_rule_predictions(Ctx(spark, sf_dir)))
    return s.select("n", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision_macro", "recall_macro", "f1_macro")])


@register
def classification_report(spark, sf_dir):
    r = metrics.classification_report(_rule_predictions(Ctx(spark, sf_dir)))
    return r.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@register
def dense_search(spark, sf_dir):
    emb = Ctx(spark, sf_dir).t.embeddings
    return dense.dense_search(emb, emb, 5, q_key="vec_id", d_key="vec_id", dim=64)


@register
def embedding_search(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    asked = _conversation_queries(c).select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), "query")
    return dense.text_search(asked, c.t.documents, 3, dense.hashed_projections(64), 64)


@register
def running_context(spark, sf_dir):
    steps = answers.agent_output(answers.plan_steps(_triaged(Ctx(spark, sf_dir))))
    return answers.running_context(steps)


# --- streaming (driven to completion, result read back from the sink) ------------

def _weekly_stream(c: Ctx, run: streams.StreamRun) -> DataFrame:
    # cases are an aggregate of order lines, so they become a stream by way of files
    source = f"{run.output}-cases"
    c.cases.select("case_id", "tanggal", "biaya_perbaikan_idr").write.parquet(source)
    cases = c.spark.readStream.schema(c.spark.read.parquet(source).schema).parquet(source)
    return streams.stream_weekly_cost(cases, streams.stream_view(c.spark, c.sf_dir, "v_tickets"))


@register
def stream_weekly_cost(spark, sf_dir):
    run = streams.new_run(spark, "weekly_cost")
    weeks = streams.run_batches(_weekly_stream(Ctx(spark, sf_dir), run), run, "update")
    return streams.latest(weeks, ["minggu"]).filter("n_tickets > 0").select("minggu", "biaya_kompensasi_cs_idr", "n_tickets")


@register
def stream_closed_weeks(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    run = streams.new_run(spark, "closed_weeks")
    weeks = streams.run_batches(_weekly_stream(c, run), run, "append",
                                lambda batch: streams.with_pending_vendors(batch, c.vendors))
    return weeks.drop("batch")


def _tool_stream(spark, sf_dir, name: str) -> DataFrame:
    run = streams.new_run(spark, name)
    s = streams.stream_tools_by_role(streams.stream_view(spark, sf_dir, "v_tool_log"))
    return streams.latest(streams.run_batches(s, run, "update"), ["run_id", "agent_role"])


@register
def stream_tool_usage(spark, sf_dir):
    u = _tool_stream(spark, sf_dir, "tool_usage")
    return u.select("run_id", "agent_role", F.explode("tools").alias("tool_name"))


@register
def stream_tools_by_role(spark, sf_dir):
    u = _tool_stream(spark, sf_dir, "tools_by_role")
    return u.select("run_id", "agent_role", "first_seq", F.array_join("tools", ", ").alias("tools"))


@register
def stream_label_and_score(spark, sf_dir):
    s = streams.stream_label_and_score(streams.stream_view(spark, sf_dir, "v_sensor")).select(
        "record_id", "machine_id", "failure_type", "machine_failure")
    return streams.run_append(s, streams.new_run(spark, "label_and_score"))


@register
def stream_score_failures(spark, sf_dir):
    run = streams.new_run(spark, "score_failures")
    ml.save_model(ml.train_forest(Ctx(spark, sf_dir).sensor), f"{run.output}-model")
    model = ml.load_model(f"{run.output}-model")
    s = streams.stream_label_and_score(streams.stream_view(spark, sf_dir, "v_sensor"), model).select(
        "record_id", "failure_type", "predicted_failure", "top_classes")
    return streams.run_batches(s, run).drop("batch")


@register
def stream_triage(spark, sf_dir):
    s = streams.stream_triage(streams.stream_view(spark, sf_dir, "v_queries"))
    return streams.run_append(s, streams.new_run(spark, "triage"))


# --- oversampling and models ----------------------------------------------------

def _failure_train(c: Ctx) -> DataFrame:
    # read by several scalar subqueries, the k-NN graph and the ranking
    data = ml.failure_dataset(c.sensor, columns=["record_id", "failure_type", *sensors.FEATURES], in_place=True)
    return materialize(data.filter(F.col("split") == "train"))


@register
def smote(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    resampled = smote_ops.smote(_failure_train(c), "record_id", "failure_type", sensors.FEATURES, rank_col="class_rank")
    return smote_ops.smote_summary(resampled, "failure_type")


@register
def smote_neighbours(spark, sf_dir):
    train = _failure_train(Ctx(spark, sf_dir))
    x = F.array(*[F.col(c).cast("double") for c in sensors.FEATURES])
    points = train.select("record_id", "failure_type", x.alias("_x")).withColumn("_sq", dense.squared_norm(F.col("_x")))
    return smote_ops.neighbour_graph(points, "record_id", "failure_type", smote_ops.MAX_NEIGHBOURS, len(sensors.FEATURES),
                                      staged=True)


@register
def smote_samples(spark, sf_dir):
    out = smote_ops.smote(_failure_train(Ctx(spark, sf_dir)), "record_id", "failure_type", sensors.FEATURES, rank_col="class_rank")
    return out.select("sample_id", F.col("failure_type").alias("label"), "is_synthetic", "nb_key",
                      *[F.round(F.col("features")[i], 8).alias(c) for i, c in enumerate(sensors.FEATURES)])


@register
def train_failure_model(spark, sf_dir):
    return ml.train_failure_model(Ctx(spark, sf_dir).sensor).results


@register
def score_failures(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    trained = ml.train_failure_model(c.sensor)
    return ml.score_failures(trained.model, ml.failure_dataset(c.sensor)).select(
        "record_id", "failure_type", "split", "predicted_failure", "top_classes")


@register
def classify_complaints(spark, sf_dir):
    ds = split.prepare_text_dataset(Ctx(spark, sf_dir).tickets).cache()
    model = ml.train_complaint_classifier(ds.filter(F.col("split") == "train"))
    return ml.classify_complaints(model, ds).select(
        "ticket_id", "label", "split", "predicted_label", "confidence", "distribution")


# --- composites -------------------------------------------------------------------

@register
def answer_facts(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    tri = _triaged_once(c)
    chunks = _chunks(c)
    # policies are looked up for questions that the plan gives to customer service
    asked = tri.filter(F.array_contains("plan", "cs"))
    sop_hits = retrieval.sop_search(retrieval.sop_index(chunks).cache(), chunks, asked, 1, ("query_id",), "query")
    vendor_ids = lookup.exploded_ids(tri).filter(F.col("id_type") == "vendor_id")
    gaps = lookup.vendor_gap_report(c.vendors, lookup.checklist(spark))
    summary = reports.cost_summary(_weekly(c), 4)
    # nothing runs for questions out of scope
    return answers.answer_facts(answers.plan_steps(tri), _hybrid(c, tri.filter("in_scope")), sop_hits, gaps, vendor_ids, summary)


@register
def evaluate_all(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    conv = _conversation_queries(c)
    # one top-2 search serves both: top-1 is its first rank
    top2 = materialize(_sop_hits(c, 2))
    # fixed values: the names of metrics and components
    frames = {
        "accuracy": metrics.classification_scores(_rule_predictions(c)),
        "explainability": retrieval.citation_coverage(
            conv, retrieval.render_responses(top2, CONV_KEYS), CONV_KEYS),
        "hallucination_proxy": retrieval.grounding_rate(conv, top2.filter(F.col("rank") == 1), CONV_KEYS),
        "effectiveness": retrieval.routing_accuracy(_hybrid(c), c.routing),
        "efficiency": reports.latency_summary(c.tool_log).agg(
            F.avg("avg_latency_ms").alias("avg_latency_ms"), F.sum("n_calls").alias("n_calls")),
    }
    report = io.evaluation_report(frames, {
        "accuracy": "failure_labels.rules_v2_vs_v3",
        "explainability": "cs_agent.sop_retriever",
        "hallucination_proxy": "cs_agent.sop_retriever",
        "effectiveness": "case_history_search",
        "efficiency": "tool_log",
    })
    return report.select("metric", "component", "name", F.round("value", 6).alias("value"))


@register
def class_floor(spark, sf_dir):
    return split.class_floor(_failure_train(Ctx(spark, sf_dir)), "failure_type")


@register
def quantize_readings(spark, sf_dir):
    s = sensors.quantize_readings(sensors.physics_features(Ctx(spark, sf_dir).sensor))
    return s.select("record_id", *sensors.FEATURES, F.round("power_w", 6).alias("power_w"),
                    F.round("delta_t_k", 6).alias("delta_t_k"), F.round("strain", 6).alias("strain"))
