"""Quality rules by distribution divergence (DataFrame functions only).

Each document gets two histograms: character classes and the most common words
of its language.  Both are compared with the language's reference by the
Jensen-Shannon distance (base 2, so 0 to 1); texts too short for a stable
histogram are not compared.

Cases: a null or blank text has no words and fails the base rule; a null
language forms a language of its own; repeated rows are judged each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.common import let, materialize, row_struct, words

WINDOW = 5
MIN_WORDS = 10             # base rule
MAX_REPEAT_PERCENT = 20    # base rule
COMMON_WORDS = 24          # bins of the word histogram, besides "other"
MAX_COMMON_CHARS = 6       # common words are short: candidates have at most this many letters
MIN_CHARS = 120            # below, the class histogram is not compared
MIN_COMPARED_WORDS = 60    # below, the word histogram is not compared
MAX_CLASS_DISTANCE = 0.20
CLASS_SLACK_CHARS = 40     # the class limit is wider by this over the text's length: short texts scatter more
MAX_WORD_DISTANCE = 0.40
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
CLASSES = ("space", "upper", "digit", "punct", "symbol", "other")


def _count(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in the class (run-wise removal of all others)."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from the window hashes in order."""
    def covered(pos):
        # windows start at sorted positions: add the words not covered yet
        return F.aggregate(pos, F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
                           lambda a, p: F.struct(
                               (a["total"] + p + WINDOW - F.greatest(a["end"], p)).alias("total"),
                               (p + WINDOW).alias("end")),
                           lambda a: a["total"].cast("long"))

    def marked(s):
        def place(e, i):
            # the first and last entries have one neighbour only
            twin = (F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False))
                    | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
            return F.when(twin, e["p"])
        return F.array_sort(F.filter(F.transform(s, place), lambda p: p.isNotNull()))

    def counted(h):
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            covered(let(pairs, marked)))

    return let(hashes, counted)


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, kept columns, words ``w`` and the base figures."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), *keep, text.alias("_text"), words(F.col(text_col)).alias("w"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    windows = let(F.col("w"), lambda w: F.when(F.size(w) >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    ).otherwise(F.array().cast("array<bigint>")))
    d = d.select("doc_id", *keep, "_text", "w",
                 F.size("w").cast("long").alias("n_words"),
                 F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                 _count(F.col("_text"), "#*$%&|<>").alias("n_symbols"),
                 let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                 windows.alias("_h"))
    d = d.withColumn("n_repeat_words", _repeat_words(F.col("_h"))).drop("_h")
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                 k: int = COMMON_WORDS) -> DataFrame:
    """lang, common: the k most frequent short words of each language over all documents."""
    counted = (docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"),
                           F.explode(words(F.col(text_col))).alias("word"))
               .filter(F.length("word") <= MAX_COMMON_CHARS)
               .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return (counted.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= k)
            .groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))),
                                             lambda x: x["word"]).alias("common")))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return let(F.struct(counts.alias("n"), total.alias("t")),
               lambda s: F.transform(s["n"], lambda x: x / F.greatest(s["t"], F.lit(1))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two equally long share arrays."""
    half = F.zip_with(p, q, lambda a, b: (
        F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
        + F.when(b > 0, b * F.log2(2 * b / (a + b))).otherwise(0.0)) / 2)
    return F.sqrt(F.greatest(F.aggregate(half, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def _map_literal(common: dict[str, list[str]]) -> Column:
    pairs = [x for lang, ws in common.items() for x in (F.lit(lang), F.array(*map(F.lit, ws)))]
    return F.create_map(*pairs)


def _measured(docs: DataFrame, max_langs: int) -> DataFrame:
    """Base figures and both histograms, one output row per input row.

    ``docs`` has doc_id, text, lang and any columns whose name starts with an
    underscore, which are passed on.  The common words of each language travel
    as one small literal when there are at most ``max_langs`` languages, else
    by a join.
    """
    keep = tuple(c for c in docs.columns if c.startswith("_"))
    docs = docs.withColumn("lang", F.coalesce("lang", F.lit("")))
    lists = common_words(docs, "text", "lang")
    few = lists.limit(max_langs + 1).collect()
    if len(few) <= max_langs:
        own = F.element_at(_map_literal({r["lang"]: r["common"] for r in few}), F.col("lang")) if few else F.lit(None)
        d = base_counts(docs, "doc_id", "text", ("lang", *keep)).withColumn("common", own.cast("array<string>"))
    else:
        d = base_counts(docs.join(lists, "lang", "left"), "doc_id", "text", ("lang", "common", *keep))
    d = d.withColumn("common", F.coalesce("common", F.array().cast("array<string>")))
    n_chars = F.length("_text").cast("long")
    five = (n_chars - F.col("word_chars"), _count(F.col("_text"), "\\p{Lu}"), _count(F.col("_text"), "\\p{Nd}"),
            _count(F.col("_text"), ".,;:!?'\"()\\-"), F.col("n_symbols"))
    d = d.select("doc_id", "lang", *keep, *BASE, n_chars.alias("n_chars"),
                 F.xxhash64("_text").alias("text_hash"), F.array(*five).alias("_five"),
                 # place of each word in its language's list, 0 when it is not in there
                 let(F.col("common"), lambda own: F.transform("w", lambda x: F.array_position(own, x))).alias("_place"))
    # the classes are disjoint, so "other" is what is left
    classes = F.concat("_five", F.array(
        F.col("n_chars") - F.aggregate("_five", F.lit(0).cast("long"), lambda a, x: a + x)))
    bins = F.array(*[(F.size("_place") - F.size(F.array_remove("_place", F.lit(k).cast("long")))).cast("long")
                     for k in range(COMMON_WORDS + 1)])
    return d.select("doc_id", "lang", *keep, *BASE, "n_chars", "text_hash",
                    classes.alias("classes"), bins.alias("bins"))


def _judged(measured: DataFrame, refs: DataFrame, max_langs: int) -> DataFrame:
    """Add class_distance, word_distance and kept.  A few references are broadcast, many are joined."""
    few = refs.limit(max_langs + 1).collect()
    if len(few) <= max_langs:
        refs = F.broadcast(refs.sparkSession.createDataFrame(few, refs.schema))
    d = measured.join(refs, "lang", "left")
    d = d.withColumn("class_distance", F.when(
        F.col("n_chars") >= MIN_CHARS, js_distance(_shares(F.col("classes")), F.col("class_ref"))))
    d = d.withColumn("word_distance", F.when(
        F.col("n_words") >= MIN_COMPARED_WORDS, js_distance(_shares(F.col("bins")), F.col("word_ref"))))
    bad = (F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE + CLASS_SLACK_CHARS / F.col("n_chars"),
                      F.lit(False))
           | F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False)))
    return d.withColumn("kept", ~F.col("base_failed") & ~bad)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          max_langs: int = 500) -> DataFrame:
    """Base figures, distances to the language references and the verdict, per document."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    d = materialize(_measured(docs, max_langs))
    return _judged(d, _references(d), max_langs).select(
        "doc_id", *BASE, "kept", "class_distance", "word_distance")


def keep_clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               max_langs: int = 500) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns.

    The verdict is computed beside each row, so whole texts are read twice
    (references, then verdicts) and never shuffled.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                    row_struct(docs))
    refs = _references(materialize(_measured(d.drop("_row"), max_langs)))
    return _judged(_measured(d, max_langs), refs, max_langs).filter("kept").select("_row.*")


def _references(features: DataFrame) -> DataFrame:
    """lang, class_ref, word_ref: pooled histograms over the distinct texts that pass the base rule.

    Copies count once, so a text repeated through the corpus does not pull its
    language's reference towards itself.
    """
    once = (features.filter(~F.col("base_failed")).groupBy("lang", "text_hash")
            .agg(F.max("classes").alias("classes"), F.max("bins").alias("bins")))

    def pooled(col, n):
        return F.array(*[F.coalesce(F.sum(F.get(col, F.lit(i))), F.lit(0)) for i in range(n)])

    sums = once.groupBy("lang").agg(pooled("classes", len(CLASSES)).alias("classes"),
                                    pooled("bins", COMMON_WORDS + 1).alias("bins"))
    return sums.select("lang", _shares(F.col("classes")).alias("class_ref"), _shares(F.col("bins")).alias("word_ref"))
