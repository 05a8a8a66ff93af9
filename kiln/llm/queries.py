"""Registered queries of the training-data operators: one thin query per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm import (chat, decontaminate, langid, lexical, licenses, linecrf, manifest, mixing, neardup, pseudonyms,
                      quality, secrets, sharding)
from kiln.llm.common import read_documents, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_quality_divergence(spark, sf_dir):
    scored = quality.score(read_documents(spark, sf_dir))
    return scored.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


@register
def op2_template_decontamination(spark, sf_dir):
    return decontaminate.find_leaks(read_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


@register
def op3_secret_ledger(spark, sf_dir):
    paths, _, findings = secrets.scan_versions(read_documents(spark, sf_dir))
    return secrets.report(paths, findings)


@register
def op4_chat_segments(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_segments(rows.unionByName(chat.probe(spark))))


@register
def op5_minimax_sharding(spark, sf_dir):
    return sharding.assign(read_documents(spark, sf_dir))


@register
def op6_zstd_language(spark, sf_dir):
    docs = read_documents(spark, sf_dir)
    train = docs.filter(~langid.held_out(F.col("doc_id")))
    return langid.identify(docs, train).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@register
def op7_feistel_pseudonyms(spark, sf_dir):
    return pseudonyms.pseudonymize(read_documents(spark, sf_dir), pseudonyms.DEMO_KEY)


@register
def op8_license_dice(spark, sf_dir):
    return licenses.scan(read_documents(spark, sf_dir))


@register
def op9_minmax_neardup(spark, sf_dir):
    return neardup.near_duplicates(read_documents(spark, sf_dir))


@register
def op10_golden_ratio_mix(spark, sf_dir):
    return mixing.mix(read_documents(spark, sf_dir))


@register
def op11_octopus_manifest(spark, sf_dir):
    return manifest.report(read_documents(spark, sf_dir))


@register
def op12_line_crf(spark, sf_dir):
    docs = read_documents(spark, sf_dir)
    own = ~linecrf.held_out(F.col("doc_id"))
    field = linecrf.train(docs.filter(own), read_table(spark, sf_dir, "labels").filter(own))
    return linecrf.score(docs, field).select(
        "doc_id", linecrf.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= linecrf.ACCEPT).cast("int").alias("predicted"))


@register
def op13_stratified_search(spark, sf_dir):
    return lexical.rank(read_table(spark, sf_dir, "benchmark"), read_documents(spark, sf_dir))
