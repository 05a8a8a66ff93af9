"""Per-question agent plans: running context and answer facts.

A question's plan has at most four agents, so every window here is bounded by
the plan length, never by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions.text import fixed_map
from kiln.operators.triage import AGENT_LABELS


def plan_steps(triaged: DataFrame, key: str = "query_id") -> DataFrame:
    """One row per (question, step) of the ordered agent plan."""
    return triaged.select(key, "query", F.posexplode("plan").alias("pos", "agent"))


def agent_output(steps: DataFrame) -> DataFrame:
    """The text an agent contributes.  Without a language model this is the
    agent's heading and the question it was given."""
    label = fixed_map(AGENT_LABELS)[F.col("agent")]
    return steps.withColumn("output", F.concat(label, F.lit(" menangani: "), F.col("query")))


def running_context(steps: DataFrame, key: str = "query_id") -> DataFrame:
    """Each agent sees the concatenation of the earlier agents' outputs,
    ``"\\n[<Agent label>]: <output>\\n"`` each, in plan order."""
    label = fixed_map(AGENT_LABELS)[F.col("agent")]
    line = F.concat(F.lit("\n["), label, F.lit("]: "), F.col("output"), F.lit("\n"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return steps.select(key, "pos", "agent", F.array_join(F.collect_list(line).over(w), "").alias("context"))


def answer_facts(steps: DataFrame, case_hits: DataFrame, sop_hits: DataFrame, vendor_gaps: DataFrame,
                 vendor_ids: DataFrame, summary: DataFrame, key: str = "query_id") -> DataFrame:
    """The data facts each planned agent would answer from.

    * maintenance / cs: the question's case-history hits (exact or semantic);
    * cs also: its best policy chunk;
    * vendor: the missing documents of the vendors the question names;
    * finance: the cost summary (one row, attached as scalar subqueries).

    Every per-question list is bounded by k or by the IDs in the question.
    """
    def per_query(df: DataFrame, order: str, text) -> DataFrame:
        return (df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), text.alias("t")))).alias("_l"))
                .select(key, F.array_join(F.transform("_l", lambda s: s["t"]), "; ").alias("_f")))

    cases = per_query(case_hits, "rank", F.concat(F.col("doc_key"), F.lit(" ("), F.col("doc_type"), F.lit(")")))
    sop = per_query(sop_hits.filter(F.col("rank") == 1), "rank",
                    F.concat(F.lit("SOP "), F.col("source_id").cast("string")))
    gaps = vendor_gaps.groupBy("vendor_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.col("dokumen"))), ", ").alias("_docs"))
    vend = per_query(vendor_ids.join(gaps, vendor_ids.id == gaps.vendor_id, "left"), "pos",
                     F.concat(F.col("id"), F.lit(": "), F.coalesce(F.col("_docs"), F.lit("-"))))
    fin_text = F.concat(F.lit("total "), summary.select(F.col("total_operasional_idr").cast("string")).scalar(),
                        F.lit(", trend "), summary.select("trend").scalar())
    facts = (steps.join(cases.withColumnRenamed("_f", "_cases"), key, "left")
             .join(sop.withColumnRenamed("_f", "_sop"), key, "left")
             .join(vend.withColumnRenamed("_f", "_vendor"), key, "left"))
    text = (F.when(F.col("agent") == "maintenance", F.coalesce("_cases", F.lit("")))
            .when(F.col("agent") == "cs", F.concat_ws(" | ", "_cases", "_sop"))
            .when(F.col("agent") == "vendor", F.coalesce("_vendor", F.lit("")))
            .when(F.col("agent") == "finance", fin_text))
    return facts.select(key, "pos", "agent", text.alias("facts"))
