"""DuckDB SQL of the training-data queries that SQL can express.

Written from the definitions, not from the operators: windows, shingles and
bigrams are compared as text, not as hashes, and links are found by a plain
join of equal shingles.  Pseudonyms, compression, template windows, the
capacity search, the schedule (64-bit hashes) and chat escaping have no SQL;
their tests compare with brute force.
"""

from __future__ import annotations

from kiln.llm import licenses, quality, secrets

ORACLES: dict[str, str] = {}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_Q = quality
ORACLES["op1_quality_divergence"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + {_Q.WINDOW - 1}], ' ') AS k
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {_Q.WINDOW - 1})) AS i FROM d WHERE len(w) >= {_Q.WINDOW})),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(generate_series(i, i + {_Q.WINDOW - 1})) AS p FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
base AS (
  SELECT d.doc_id, lang, t, w, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
judged AS (
  SELECT *, n_words < {_Q.MIN_WORDS} OR 100 * n_repeat_words > {_Q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base),
counted AS (
  SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM d)
  WHERE length(word) <= {_Q.MAX_COMMON_CHARS} GROUP BY lang, word),
common AS (
  SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM counted
  QUALIFY place <= {_Q.COMMON_WORDS}),
hist AS (
  SELECT doc_id, 'c' || k AS bin, n FROM (
    SELECT doc_id, unnest([1, 2, 3, 4, 5, 6]) AS k,
           unnest([sp, up, dg, pu, sy, length(t) - sp - up - dg - pu - sy]) AS n
    FROM (SELECT doc_id, t, length(t) - word_chars AS sp, length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS up,
                 length(regexp_replace(t, '[^\\p{{Nd}}]+', '', 'g')) AS dg,
                 length(regexp_replace(t, '[^.,;:!?''"()\\-]+', '', 'g')) AS pu, n_symbols AS sy FROM judged))
  UNION ALL
  SELECT x.doc_id, 'w' || coalesce(place, 0), count(*)
  FROM (SELECT doc_id, lang, unnest(w) AS word FROM d) x LEFT JOIN common USING (lang, word) GROUP BY ALL),
once AS (SELECT lang, min(doc_id) AS doc_id FROM judged WHERE NOT base_failed GROUP BY lang, t),
ref AS (SELECT lang, bin, sum(n) AS n FROM once JOIN hist USING (doc_id) GROUP BY lang, bin),
ref_share AS (SELECT lang, bin, n / sum(n) OVER (PARTITION BY lang, bin[1]) AS q FROM ref),
own_share AS (SELECT doc_id, bin, n / greatest(sum(n) OVER (PARTITION BY doc_id, bin[1]), 1) AS p FROM hist),
sides AS (
  SELECT j.doc_id, r.bin[1] AS kind, coalesce(p, 0) AS p, q
  FROM judged j JOIN ref_share r USING (lang) LEFT JOIN own_share o ON o.doc_id = j.doc_id AND o.bin = r.bin
  UNION ALL
  SELECT o.doc_id, o.bin[1], p, 0 FROM own_share o JOIN judged USING (doc_id)
  WHERE lang IN (SELECT lang FROM ref_share) AND (lang, bin) NOT IN (SELECT (lang, bin) FROM ref_share)),
js AS (
  SELECT doc_id, kind, sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
                                          + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2), 0)) AS js
  FROM sides GROUP BY doc_id, kind),
scored AS (
  SELECT j.*, CASE WHEN length(t) >= {_Q.MIN_CHARS} THEN c.js END AS cd,
         CASE WHEN n_words >= {_Q.MIN_COMPARED_WORDS} THEN w.js END AS wd
  FROM judged j LEFT JOIN js c ON c.doc_id = j.doc_id AND c.kind = 'c' LEFT JOIN js w ON w.doc_id = j.doc_id AND w.kind = 'w')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(cd > {_Q.MAX_CLASS_DISTANCE} + {_Q.CLASS_SLACK_CHARS} / length(t), false)
       AND NOT coalesce(wd > {_Q.MAX_WORD_DISTANCE}, false) AS kept,
       round(cd, 6) AS class_distance, round(wd, 6) AS word_distance
FROM scored"""


def _rule_sql(k: int, r: secrets.Rule) -> str:
    pattern = _text(r.pattern)
    return f"""
  SELECT doc_id, {k} AS k, {_text(r.name)} AS kind, a AS start, a + length(m[i]) AS stop
  FROM (SELECT doc_id, i, m, g,
               list_sum(list_transform(p[1:i], lambda x: length(x)))
               + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a
        FROM (SELECT *, unnest(generate_series(1, len(m))) AS i
              FROM (SELECT doc_id, regexp_extract_all(t, {pattern}, 0) AS m, regexp_extract_all(t, {pattern}, {r.group}) AS g,
                           string_split_regex(t, {pattern}) AS p FROM d WHERE regexp_matches(t, {pattern}))))
  WHERE length(g[i]) >= {r.least}"""


_SPAN = "kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT)"
_IS_BASE = "kind IN (" + ", ".join(map(_text, secrets.BASE)) + ")"
ORACLES["op3_secret_ledger"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(_rule_sql(k, r) for k, r in enumerate(secrets.RULES))}),
per AS (
  SELECT doc_id, {', '.join(f"count(*) FILTER (kind = {_text(n)}) AS n_{n}" for n in secrets.BASE)},
         coalesce(string_agg({_SPAN}, ',' ORDER BY start, k) FILTER ({_IS_BASE}), '') AS base,
         string_agg({_SPAN}, ',' ORDER BY start, k) AS spans, count(*) AS n_spans
  FROM found GROUP BY doc_id)
SELECT doc_id, {', '.join(f"coalesce(n_{n}, 0) AS n_{n}" for n in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN per USING (doc_id)"""

_NORMAL = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{Nd}}]+'), lambda x: x <> '')"
_BIGRAMS = "list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))"
ORACLES["op8_license_dice"] = f"""
WITH t AS (
  SELECT template, license, {_BIGRAMS} AS b
  FROM (SELECT template, license, {_NORMAL.format('text')} AS w FROM (VALUES
    {', '.join(f"({k}, {_text(lic)}, {_text(text)})" for k, (lic, text) in enumerate(licenses.TEMPLATES))}
  ) v(template, license, text))),
u AS (
  SELECT DISTINCT doc_id, unit FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM documents
    UNION ALL SELECT doc_id, unnest(string_split_regex(text, '\\n[\\x20\\x09\\r]*\\n')) FROM documents
    UNION ALL SELECT doc_id, text FROM documents) WHERE unit IS NOT NULL),
b AS (
  SELECT doc_id, unit, {_BIGRAMS} AS b FROM (SELECT doc_id, unit, {_NORMAL.format('unit')} AS w FROM u) WHERE len(w) > 1),
hit AS (
  SELECT doc_id, unit, license, template, any_value(m) AS size, 2 * count(*) / (any_value(m) + any_value(n)) AS dice
  FROM (SELECT doc_id, unit, len(b) AS m, unnest(b) AS bigram FROM b WHERE len(b) < 1000)
  JOIN (SELECT template, license, len(b) AS n, unnest(b) AS bigram FROM t) USING (bigram)
  GROUP BY doc_id, unit, license, template),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license, size) AS r
  FROM hit WHERE dice >= {licenses.THRESHOLD} QUALIFY r = 1)
SELECT doc_id, license, max(dice) AS dice, CAST(arg_min(size, [-dice, size]) AS BIGINT) AS unit_bigrams, count(*) AS n_units
FROM best GROUP BY doc_id, license"""

ORACLES["op9_minmax_neardup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
reach AS (
  SELECT doc_id AS id, doc_id AS other FROM d
  UNION
  SELECT id, b FROM reach JOIN links ON a = other)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM d JOIN reach ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

# the checksum of the decimal id, bit by bit; trees as rows (level, index), eight children to a node
ORACLES["op11_octopus_manifest"] = """
WITH RECURSIVE
src AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS k, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ord(s)::BIGINT)),
           lambda c, b: list_reduce([xor(c, b), 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT],
             lambda x, y: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) AS crc
  FROM documents),
digests AS (
  SELECT doc_id, k, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS altered FROM src),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM digests),
nodes AS (
  SELECT k, 0 AS lvl, pos AS idx, leaf AS h, n AS width FROM leaves
  UNION ALL
  SELECT k, lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(width) + 7) // 8
  FROM nodes WHERE width > 1 GROUP BY k, lvl, idx // 8),
floor AS (
  SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS g, count(*) OVER () AS n FROM nodes WHERE width = 1),
upper AS (
  SELECT 0 AS lvl, g AS idx, subroot AS h, n AS width FROM floor
  UNION ALL
  SELECT lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(width) + 7) // 8
  FROM upper WHERE width > 1 GROUP BY lvl, idx // 8),
low_steps AS (
  SELECT l.k, l.pos, n.lvl, coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (n.idx < l.pos // CAST(power(8, n.lvl) AS BIGINT)), '') AS a,
         coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (n.idx > l.pos // CAST(power(8, n.lvl) AS BIGINT)), '') AS b
  FROM leaves l JOIN nodes n ON n.k = l.k AND n.width > 1 AND n.idx // 8 = l.pos // CAST(power(8, n.lvl + 1) AS BIGINT)
  GROUP BY l.k, l.pos, n.lvl),
high_steps AS (
  SELECT f.k, n.lvl, coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (n.idx < f.g // CAST(power(8, n.lvl) AS BIGINT)), '') AS a,
         coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (n.idx > f.g // CAST(power(8, n.lvl) AS BIGINT)), '') AS b
  FROM floor f JOIN upper n ON n.width > 1 AND n.idx // 8 = f.g // CAST(power(8, n.lvl + 1) AS BIGINT)
  GROUP BY f.k, n.lvl),
ways AS (
  SELECT k, pos, string_agg(a || b, '' ORDER BY part, lvl) AS proof, list(a || '|' || b ORDER BY part, lvl) AS steps
  FROM (SELECT k, pos, 0 AS part, lvl, a, b FROM low_steps
        UNION ALL SELECT l.k, l.pos, 1, h.lvl, h.a, h.b FROM leaves l JOIN high_steps h USING (k)) GROUP BY k, pos),
proofs AS (
  SELECT l.doc_id, l.leaf, f.subroot, (SELECT h FROM upper WHERE width = 1) AS root, sha256(coalesce(w.proof, '')) AS proof_sha256,
         list_reduce(list_concat([coalesce(l.altered, l.leaf)], coalesce(w.steps, [])),
                     lambda x, s: sha256(split_part(s, '|', 1) || x || split_part(s, '|', 2))) AS folded_root
  FROM leaves l JOIN floor f USING (k) LEFT JOIN ways w ON w.k = l.k AND w.pos = l.pos)
SELECT *, folded_root = root AS verified FROM proofs
"""

_TERMS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

ORACLES["op13_stratified_search"] = f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, t, len(t) AS n FROM (SELECT doc_id, {_TERMS} AS t FROM documents) WHERE len(t) > 0),
stats AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(t) AS term FROM docs) GROUP BY ALL),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), stats),
norm AS (SELECT d, doc_id, 75 + (25 * n * docs) // terms AS m FROM docs, stats),
items AS (
  SELECT q, item_id, term, count(*) AS times
  FROM (SELECT q, item_id, unnest(t) AS term
        FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS t FROM (SELECT DISTINCT item_id, text FROM benchmark))) GROUP BY ALL),
scores AS (
  SELECT q, item_id, d, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM items JOIN tf USING (term) JOIN weight USING (term) JOIN norm USING (d) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""
