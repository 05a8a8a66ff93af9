"""Secret scans over an incremental blob ledger (DataFrame functions only).

Every version of every path is content-addressed by the SHA-256 of its text.
The ledger says which rule versions each blob has been scanned with; only
unseen (blob, rule version) pairs are scanned, once for all copies, and the
findings are joined back to all paths.

Spans are in code points, end exclusive.  Spark has no match positions, so they
are derived: splitting a text by a pattern gives the pieces between the
matches, and their lengths add up to the positions.

Cases: a null text counts as empty and has no spans; equal texts share a blob;
repeated rows and null paths give one result row each; a rule that changes its
version is scanned again; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import let, materialize

SALT = 16                    # a blob's paths are spread over so many join keys
BROADCAST_BLOBS = 200_000    # blobs to scan that are broadcast (20 MB); beyond, a shuffle join


class Rule(NamedTuple):
    name: str
    version: int
    pattern: str             # the same leftmost matches in Java's and RE2's dialect
    hint: str                # a pattern that any text with a match also has; cheap to look for
    group: int = 0           # the group whose length counts
    least: int = 0           # matches whose group is shorter are dropped (they still use up their text)


# the order of the rules is the order of kinds at equal starts
RULES = (
    Rule("assign", 1, "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
         "[:=]", 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]+", "AKIA", 0, 20),
    Rule("hex", 1, "[0-9a-f]{24,}", "[0-9a-f]{24}"),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,255}", "gh[pousr]_"),
    Rule("jwt", 1, "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", "eyJ"),
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "-----BEGIN "),
    Rule("slack", 1, "xox[abprs]-[A-Za-z0-9-]{10,}", "xox"),
    Rule("url", 1, "[a-z][a-z0-9+.-]{0,20}://[^\\s:@/]{1,200}:[^\\s:@/]{1,200}@", "://"),
)
BASE = ("assign", "access", "hex")
_PLAIN = set("AKIA eyJ xox ://".split()) | {"-----BEGIN "}
SPAN = "array<struct<start:int,end:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """The rule's matches in ``text`` as an array of (start, end), in order."""
    def placed(x):
        # walk over (piece, match) pairs and keep the position
        walked = F.aggregate(
            F.sequence(F.lit(0), F.size(x["m"]) - 1),
            F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
            lambda acc, i: let(
                F.struct((acc["at"] + F.length(F.get(x["p"], i))).alias("s"), F.length(F.get(x["m"], i)).alias("n")),
                lambda y: F.struct(
                    (y["s"] + y["n"]).alias("at"),
                    F.concat(acc["out"], F.when(
                        F.length(F.get(x["g"], i)) >= rule.least,
                        F.array(F.struct(y["s"].alias("start"), (y["s"] + y["n"]).alias("end")))
                    ).otherwise(F.array()).cast(SPAN)).alias("out"))),
            lambda acc: acc["out"])
        return F.when(F.size(x["m"]) > 0, walked).otherwise(F.array().cast(SPAN))

    pattern = F.lit(rule.pattern)
    parts = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"),
                     F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("g"),
                     F.split(text, rule.pattern, -1).alias("p"))
    hinted = text.contains(rule.hint) if rule.hint in _PLAIN else text.rlike(rule.hint)
    return F.when(hinted & text.rlike(rule.pattern), let(parts, placed)).otherwise(F.array().cast(SPAN))


def _names(rules: tuple[Rule, ...]) -> Column:
    return F.array(*[F.lit(f"{r.name}@{r.version}") for r in rules])


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, rule_version, start, end of the blobs' (blob, text, todo) unseen rules."""
    def found(rule):
        name = f"{rule.name}@{rule.version}"
        named = F.transform(spans(F.col("text"), rule), lambda s: F.struct(
            F.lit(name).alias("rule_version"), s["start"].alias("start"), s["end"].alias("end")))
        return F.when(F.array_contains("todo", name), named).otherwise(
            F.array().cast("array<struct<rule_version:string,start:int,end:int>>"))

    found = [found(r) for r in rules]
    return blobs.select("blob", F.explode(F.concat(*found)).alias("f")).select("blob", "f.*")


def scan_versions(versions: DataFrame, path_col: str = "doc_id", text_col: str = "text",
                  rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None,
                  findings: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, ledger, findings) after scanning what the ledger has not seen.

    paths: path, blob of every row of ``versions``; ledger: blob, seen (its
    rule versions); findings: blob, rule_version, start, end.  The last two are
    complete, also for blobs of earlier runs, and are what the next run takes.
    """
    texts = versions.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.select("path", F.sha2("text", 256).alias("blob"), "text")
    paths = materialize(texts.select("path", "blob"))
    everything = _names(rules)
    if ledger is None:
        fresh = texts.groupBy("blob").agg(F.first("text").alias("text")).select("blob", "text", everything.alias("todo"))
        seen = paths.select("blob").distinct().select("blob", everything.alias("seen"))
    else:
        known = paths.select("blob").distinct().join(ledger, "blob", "full")
        known = materialize(known.select("blob", F.coalesce("seen", F.array().cast("array<string>")).alias("seen"))
                            .join(paths.select("blob").distinct().withColumn("here", F.lit(True)), "blob", "left"))
        todo = materialize(known.filter("here").select("blob", F.array_except(everything, "seen").alias("todo"))
                           .filter(F.size("todo") > 0))
        few = todo.count() <= BROADCAST_BLOBS
        fresh = (texts.join(F.broadcast(todo) if few else todo, "blob")
                 .groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo")))
        seen = known.select("blob", F.when(F.col("here"), F.array_union("seen", everything)).otherwise(
            F.col("seen")).alias("seen"))
    new = scan(fresh, rules)
    if findings is not None:
        new = new.unionByName(findings)
    return paths, materialize(seen), materialize(new)


def _digest_text(found: Column) -> Column:
    """kind:start:end by start, then in the order of the rules, comma-joined."""
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(paths: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans of every path."""
    current = {f"{r.name}@{r.version}": (k, r.name) for k, r in enumerate(rules)}
    number = F.create_map(*[x for n, (k, _) in current.items() for x in (F.lit(n), F.lit(k))])
    kind = F.create_map(*[x for n, (_, name) in current.items() for x in (F.lit(n), F.lit(name))])
    by_blob = (findings.filter(F.col("rule_version").isin(list(current)))
               .groupBy("blob").agg(F.collect_list(F.struct(
                   F.col("start"), number[F.col("rule_version")].alias("k"), kind[F.col("rule_version")].alias("kind"),
                   F.col("end"))).alias("found"))
               .select("blob", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"), "found"))
    rows = paths.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALT)).cast("int")).join(
        by_blob, ["blob", "salt"], "left")
    found = F.coalesce("found", F.array().cast("array<struct<start:int,k:int,kind:string,end:int>>"))
    rows = rows.select("path", found.alias("found"))
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("found", lambda s: s["kind"])
    counts = [(F.size("found") - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{n}") for n in BASE]
    return rows.select(F.col("path").alias("doc_id"), *counts, F.sha2(_digest_text(base), 256).alias("base_sha256"),
                       _digest_text(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"))
