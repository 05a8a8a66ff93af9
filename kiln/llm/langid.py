"""Language identification by compression.

Each language has a few zstandard dictionaries of raw content, made of texts of
that language.  A text belongs to the language whose dictionary compresses it
best.  Where the best two languages are a few bytes apart, as for very short
texts, the other dictionaries are asked too and the sizes added up; where the
best two stay too close, the answer is marked as rejected.

Texts are compressed whole, in pieces of a few kilobytes, so that the dictionary
matters as much at the end of a long text as at its start.

The dictionaries are made from a bounded sample: of each language, the texts of
``SAMPLE_CHARS`` characters with the smallest hash of their content, up to
``DICTIONARIES * DICTIONARY_BYTES``.  Every row is read to draw it.

Cases: a null text, or one without a letter, is "und" with score 0; ties go to
the language with more labelled texts; copies of a text are sampled once; without
any labelled text all rows are "und"; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.common import materialize

UNDETERMINED = "und"
DICTIONARIES = 3                  # of each language
DICTIONARY_BYTES = 64_000
CLOSE_BYTES = 4                   # apart at the most when further dictionaries are asked
TOTAL_BYTES = 16_000_000          # of all dictionaries; with very many languages each gets less
SAMPLE_CHARS = (200, 4000)        # texts that make dictionaries
SAMPLE_TEXTS = 400                # of each language at most: enough to fill its dictionaries
PIECE_BYTES = 4096
LEVEL = 6
MIN_MARGIN = 0.01                 # of the second best size: below, the answer is rejected
LETTER = r"\p{L}"


def sample(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, r, text: at most ``SAMPLE_TEXTS`` distinct texts of each language, in random order."""
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter(
        "lang is not null and text is not null")
    # texts of a good length first: others are taken only where a language lacks them
    far = (~F.length("text").between(*SAMPLE_CHARS)).cast("int")
    hashed = texts.filter(F.col("text").rlike(LETTER)).select("lang", far.alias("far"), F.xxhash64("text").alias("r"), "text")
    # choose by narrow keys, each once whatever the number of its copies; then fetch only the chosen texts, cut
    order = Window.partitionBy("lang").orderBy("far", "r")
    keys = hashed.select("lang", "far", "r").distinct().withColumn("place", F.row_number().over(order)).filter(
        F.col("place") <= SAMPLE_TEXTS)
    cut = hashed.select("lang", "far", "r", F.substring("text", 1, 8 * SAMPLE_CHARS[1]).alias("text"))
    return cut.join(materialize(keys), ["lang", "far", "r"]).groupBy("lang", "place").agg(F.min("text").alias("text"))


def dictionaries(samples: DataFrame, counts: dict[str, int]) -> dict[str, list[bytes]]:
    """The raw content of each language's dictionaries, frequent languages first; bounded by ``TOTAL_BYTES``."""
    rows = samples.orderBy("lang", "place").collect()
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (-counts[x], x))
    room = min(DICTIONARY_BYTES, TOTAL_BYTES // max(1, len(langs) * DICTIONARIES))
    out: dict[str, list[bytes]] = {}
    for lang in langs:
        parts = [bytearray() for _ in range(DICTIONARIES)]
        for k, r in enumerate(r for r in rows if r["lang"] == lang):
            part = parts[k % DICTIONARIES]
            if len(part) < room:
                part += r["text"].lower().encode() + b"\n"
        out[lang] = [bytes(p[:room]) for p in parts if p]
    return out


class Classifier:
    def __init__(self, raw: dict[str, list[bytes]], level: int = LEVEL):
        self.langs = list(raw)
        self.coders = []
        for lang in self.langs:
            own = []
            for content in raw[lang]:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                own.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False,
                                                    write_checksum=False, write_dict_id=False))
            self.coders.append(own)

    def sizes(self, text: str) -> list[tuple[int, str]]:
        """(compressed size, language), best first; ties to the more frequent language."""
        data = text.lower().encode()
        pieces = [data[i:i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        total = [0] * len(self.langs)
        for k in range(DICTIONARIES):
            for i, own in enumerate(self.coders):
                coder = own[k % len(own)]
                total[i] += sum(len(coder.compress(p)) for p in pieces)
            ranked = sorted(zip(total, self.langs, strict=True), key=lambda x: x[0])
            if len(ranked) < 2 or ranked[1][0] - ranked[0][0] > CLOSE_BYTES * (k + 1):
                break
        return ranked

    def predict(self, text: str | None, has_letter: bool | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if text is None or not self.langs or not has_letter:
            return UNDETERMINED, 0.0, True
        ranked = self.sizes(text)
        if len(ranked) == 1:
            return ranked[0][1], 1.0, False
        margin = (ranked[1][0] - ranked[0][0]) / ranked[1][0]
        # the margin in bytes as odds, half a bit to the byte
        score = 1 / (1 + 2 ** -min(60.0, (ranked[1][0] - ranked[0][0]) / 2))
        return ranked[0][1], score, margin < MIN_MARGIN


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row of ``docs``, learned from ``train``."""
    labelled = train.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col).cast("string")).count().collect()}
    raw = docs.sparkSession.sparkContext.broadcast(dictionaries(sample(train, text_col, lang_col), counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(raw.value)
        for batch in batches:
            lang, score, rejected = [], [], []
            for text, has_letter in zip(batch.column(1), batch.column(2), strict=True):
                a, b, c = model.predict(text.as_py(), has_letter.as_py())
                lang.append(a)
                score.append(b)
                rejected.append(c)
            yield pa.record_batch({"doc_id": batch.column(0).cast(pa.int64()), "lang_pred": pa.array(lang, pa.string()),
                                   "score": pa.array(score, pa.float64()), "rejected": pa.array(rejected, pa.bool_())})

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), text.rlike(LETTER).alias("has_letter")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by the checksum of their id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
