"""Scalar text helpers (H1-H6, H11, H14, H20): all JVM-side column expressions."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip()/str.isspace() whitespace set, as a regex class usable in
# both Java regex and RE2.
PY_WHITESPACE = (r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                 r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# word characters in the sense of a Unicode-aware \w
WORD_CLASS = r"[\p{L}\p{N}_]"
NON_WORD_CLASS = r"[^\p{L}\p{N}_]"
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
_REGEX_META = re.compile(r"([.^$|?*+()\[\]{}\\])")
# every character Python's str.strip() removes (all are below U+3001)
PY_WHITESPACE_CHARS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def fixed_map(d: dict) -> Column:
    """A literal MAP column from a small fixed dictionary."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def regex_literal(s: str) -> str:
    """Escape regex metacharacters; valid for Java regex and RE2 alike."""
    return _REGEX_META.sub(r"\\\1", s)


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: Spark's plain trim only removes spaces, so trim
    the whole Unicode whitespace set (a native trim, ~10x faster than a regex)."""
    return F.btrim(c, F.lit(PY_WHITESPACE_CHARS))


def tokenize(c: Column) -> Column:
    """H5: lower-case words of two or more word characters, in order.

    Maximal word runs of length >= 2 -- the same tokens as extracting
    ``[\\p{L}\\p{N}_]{2,}``, but splitting is cheaper than match extraction.
    """
    return F.filter(F.split(F.lower(c), NON_WORD_CLASS + "+"), lambda t: F.length(t) >= 2)


def keyword_pattern(keywords: list[str]) -> str:
    """H2: one alternation with Unicode word boundaries on both sides.

    Literal-escaped, so "nda" cannot hit inside "ditunda".
    """
    alt = "|".join(regex_literal(k.lower()) for k in keywords)
    return f"(^|{NON_WORD_CLASS})({alt})($|{NON_WORD_CLASS})"


def split_list(c: Column, sep: str = "; ", none_marker: str | None = "-") -> Column:
    """H6: split a multi-valued string and strip every element.

    ``none_marker`` (``-``) means an empty list.
    """
    parts = F.transform(F.split(c, regex_literal(sep)), py_strip)
    if none_marker is None:
        return parts
    return F.when(c == F.lit(none_marker), F.array().cast("array<string>")).otherwise(parts)


def rupiah(c: Column) -> Column:
    """``Rp 1,234,567`` (no decimals)."""
    return F.concat(F.lit("Rp "), F.format_number(c, 0))


def percent_text(c: Column, decimals: int = 1) -> Column:
    """``12.3%`` from a percentage value."""
    return F.concat(F.format_string(f"%.{decimals}f", c), F.lit("%"))


def metadata_text(m: Column, skip: str = "type") -> Column:
    """``k=v, k=v`` over a metadata map without one key, in key order."""
    kept = F.map_filter(m, lambda k, _v: k != F.lit(skip))
    entries = F.array_sort(F.map_entries(kept))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")


def softmax(logits: Column) -> Column:
    """Softmax of a raw logit array (max-shifted for stability)."""
    mx = F.array_max(logits)
    ex = F.transform(logits, lambda x: F.exp(x - mx))
    total = F.aggregate(ex, F.lit(0.0), lambda a, x: a + x)
    return F.transform(ex, lambda x: x / total)


def argmax(values: Column) -> Column:
    """0-based index of the largest element (first on ties)."""
    return F.array_position(values, F.array_max(values)) - 1
