"""DuckDB oracle SQL for each registered query (same views, plain ANSI SQL)."""

from __future__ import annotations

from kiln.sources.views import with_views

ORACLES: dict[str, str] = {}

RATE_CASE = ("CASE kategori WHEN 'eskalasi_kritikal' THEN 800000 WHEN 'produk_cacat' THEN 400000 "
             "WHEN 'retur_barang' THEN 250000 WHEN 'keterlambatan_pengiriman' THEN 150000 ELSE 0 END")

WEEKLY_BODY = f"""
WITH maint AS (
  SELECT CAST(date_trunc('week', tanggal) AS DATE) AS minggu,
         CAST(sum(CAST(biaya_perbaikan_idr AS DECIMAL(18,2))) AS DOUBLE) AS m
  FROM v_cases GROUP BY 1),
comp AS (
  SELECT CAST(date_trunc('week', tanggal) AS DATE) AS minggu,
         CAST(sum({RATE_CASE}) AS DOUBLE) AS c
  FROM v_tickets GROUP BY 1),
weekly AS (
  SELECT coalesce(maint.minggu, comp.minggu) AS minggu,
         coalesce(m, 0.0) AS biaya_maintenance_idr,
         coalesce(c, 0.0) AS biaya_kompensasi_cs_idr,
         (SELECT count(*) FROM v_vendors WHERE status_validasi <> 'Lengkap - Aktif') AS vendor_pending_count,
         coalesce(m, 0.0) + coalesce(c, 0.0) AS total_biaya_operasional_idr
  FROM maint FULL OUTER JOIN comp ON maint.minggu = comp.minggu)"""

ORACLES["weekly_operating_cost"] = with_views(WEEKLY_BODY + "\nSELECT * FROM weekly", "v_cases", "v_tickets", "v_vendors")

ORACLES["cost_summary"] = with_views(WEEKLY_BODY + """,
recent AS (SELECT * FROM weekly ORDER BY minggu DESC LIMIT 4)
SELECT 4 AS n_weeks, count(*) AS n_rows,
       coalesce(sum(biaya_maintenance_idr), 0.0) AS total_maintenance_idr,
       coalesce(sum(biaya_kompensasi_cs_idr), 0.0) AS total_kompensasi_cs_idr,
       coalesce(sum(total_biaya_operasional_idr), 0.0) AS total_operasional_idr,
       avg(total_biaya_operasional_idr) AS avg_weekly_idr,
       coalesce(CAST(max_by(vendor_pending_count, minggu) AS VARCHAR), 'N/A') AS vendor_pending,
       CASE WHEN count(*) >= 2 AND max_by(total_biaya_operasional_idr, minggu) > min_by(total_biaya_operasional_idr, minggu)
            THEN 'naik' ELSE 'turun/stabil' END AS trend
FROM recent""", "v_cases", "v_tickets", "v_vendors")

LABEL_CASE = """CASE
  WHEN tool_wear_min > 200 THEN 'Tool Wear Failure'
  WHEN process_temperature_k - air_temperature_k < 8.6 AND rotational_speed_rpm < 1380 THEN 'Heat Dissipation Failure'
  WHEN torque_nm * (rotational_speed_rpm * 2 * pi() / 60) < 3500
    OR torque_nm * (rotational_speed_rpm * 2 * pi() / 60) > 9000 THEN 'Power Failure'
  WHEN tool_wear_min * torque_nm > CASE WHEN machine_id IN ('CNC-01','CNC-02','CNC-03') THEN {h}
       WHEN machine_id IN ('CONV-01','CONV-02') THEN {m} WHEN machine_id = 'PRESS-01' THEN {l} END
    THEN 'Overstrain Failure'
  ELSE 'No Failure' END"""
LABEL_V3 = LABEL_CASE.format(h=7000, m=8500, l=10000)
LABEL_V2 = LABEL_CASE.format(h=10000, m=11500, l=13000)

LABELLED = f"""
WITH labelled AS (
  SELECT record_id, machine_id, {LABEL_V3} AS failure_type FROM v_sensor)"""

ORACLES["label_failures"] = with_views(LABELLED + """
SELECT record_id, machine_id, failure_type,
       CAST(CASE WHEN failure_type <> 'No Failure' THEN 1 ELSE 0 END AS INTEGER) AS machine_failure
FROM labelled""", "v_sensor")

ORACLES["value_counts_failure"] = with_views(LABELLED + """
SELECT failure_type, count(*) AS n FROM labelled GROUP BY failure_type""", "v_sensor")

ORACLES["failure_rate"] = with_views(LABELLED + """
SELECT count(*) AS n_rows,
       CAST(sum(CASE WHEN failure_type <> 'No Failure' THEN 1 ELSE 0 END) AS BIGINT) AS n_failures,
       round(avg(CASE WHEN failure_type <> 'No Failure' THEN 1.0 ELSE 0.0 END::DOUBLE) * 100, 4) AS failure_pct
FROM labelled""", "v_sensor")

TOOL_FIRSTS = """
WITH firsts AS (
  SELECT run_id, coalesce(nullif(agent_role, ''), 'unknown') AS agent_role, tool_name, min(seq) AS first_seq
  FROM v_tool_log GROUP BY 1, 2, 3),
usage AS (
  SELECT run_id, agent_role, min(first_seq) AS first_seq,
         string_agg(tool_name, ', ' ORDER BY first_seq) AS tools,
         string_agg(coalesce(CASE tool_name
             WHEN 'machine_failure_predictor' THEN 'model prediksi kegagalan mesin'
             WHEN 'case_history_search' THEN 'pencarian kasus historis'
             WHEN 'sop_retriever' THEN 'dokumen SOP resmi (RAG)'
             WHEN 'complaint_category_classifier' THEN 'model klasifikasi kategori komplain (fine-tuned)'
             WHEN 'vendor_document_validator' THEN 'checklist validasi dokumen vendor'
             WHEN 'finance_weekly_summary' THEN 'ringkasan biaya operasional mingguan' END, tool_name),
           ', ' ORDER BY first_seq) AS tool_labels
  FROM firsts GROUP BY run_id, agent_role)"""

ORACLES["tool_usage_by_role"] = with_views(TOOL_FIRSTS + """
SELECT run_id, agent_role, first_seq, tools FROM usage""", "v_tool_log")

ORACLES["citations"] = with_views(TOOL_FIRSTS + """
SELECT run_id, count(*) AS n_roles,
       '---' || chr(10) || 'Sumber yang benar-benar digunakan (tercatat otomatis dari log eksekusi):' || chr(10)
         || string_agg('- ' || agent_role || ': ' || tool_labels, chr(10) ORDER BY first_seq) AS citation
FROM usage GROUP BY run_id""", "v_tool_log")

ORACLES["latency_summary"] = with_views("""
SELECT tool_name, count(*) AS n_calls, round(avg(latency_ms), 2) AS avg_latency_ms, max(latency_ms) AS max_latency_ms
FROM v_tool_log GROUP BY tool_name""", "v_tool_log")

ORACLES["derive_failure_type"] = with_views("""
SELECT product_id, machine_failure, CASE WHEN machine_failure = 0 THEN 'No Failure'
  WHEN twf = 1 THEN 'Tool Wear Failure' WHEN hdf = 1 THEN 'Heat Dissipation Failure'
  WHEN pwf = 1 THEN 'Power Failure' WHEN osf = 1 THEN 'Overstrain Failure'
  WHEN rnf = 1 THEN 'Random Failure' ELSE 'Random Failure' END AS failure_type
FROM v_raw_machine""", "v_raw_machine")

RR = """
WITH rr AS (
  SELECT *, row_number() OVER (PARTITION BY type ORDER BY row_order) - 1 AS type_index,
         row_number() OVER (ORDER BY row_order) - 1 AS row_index
  FROM v_raw_machine),
mapped AS (
  SELECT *, CASE type
    WHEN 'H' THEN ['CNC-01', 'CNC-02', 'CNC-03'][type_index % 3 + 1]
    WHEN 'M' THEN ['CONV-01', 'CONV-02'][type_index % 2 + 1]
    WHEN 'L' THEN 'PRESS-01' END AS machine_id
  FROM rr)"""

ORACLES["round_robin_machine"] = with_views(RR + """
SELECT product_id, type, type_index, machine_id FROM mapped""", "v_raw_machine")

ORACLES["map_machine_schema"] = with_views(RR + """
SELECT printf('REC-%05d', row_index + 1) AS record_id, machine_id, product_id AS original_product_id,
       TIMESTAMP '2026-01-01 00:00:00' + to_hours(row_index) AS timestamp,
       air_temperature_k, process_temperature_k, rotational_speed_rpm, torque_nm, tool_wear_min,
       CAST(machine_failure AS INTEGER) AS machine_failure,
       CASE WHEN machine_failure = 0 THEN 'No Failure'
  WHEN twf = 1 THEN 'Tool Wear Failure' WHEN hdf = 1 THEN 'Heat Dissipation Failure'
  WHEN pwf = 1 THEN 'Power Failure' WHEN osf = 1 THEN 'Overstrain Failure'
  ELSE 'Random Failure' END AS failure_type
FROM mapped""", "v_raw_machine")

# --- triage -------------------------------------------------------------------

from kiln.functions.text import keyword_pattern  # noqa: E402
from kiln.operators.lookup import CHECKLIST_ROWS  # noqa: E402
from kiln.operators.triage import AGENT_KEYWORDS, ID_PATTERNS  # noqa: E402


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_INTENT_LIST = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(lower(query), {_sql_str(keyword_pattern(kws))}) THEN '{agent}' END"
    for agent, kws in AGENT_KEYWORDS.items()) + "], lambda x: x IS NOT NULL)"
_ID_COLS = ",\n  ".join(
    f"list_transform(regexp_extract_all(query, {_sql_str('(?i)' + chr(92) + 'b' + p + chr(92) + 'b')}), lambda x: upper(x)) AS id_{t}"
    for t, p in ID_PATTERNS.items())

TRIAGED = f"""
WITH triaged AS (
  SELECT query_id, query, {_INTENT_LIST} AS intents,
  {_ID_COLS}
  FROM v_queries)"""

ORACLES["triage"] = with_views(TRIAGED + """
SELECT query_id, array_to_string(intents, ',') AS intents,
       array_to_string(list_concat(list_filter(intents, lambda x: x <> 'finance'),
                                   list_filter(intents, lambda x: x = 'finance')), ',') AS plan,
       CAST(len(intents) AS INTEGER) AS n_intents,
       CAST(CASE WHEN len(intents) > 0 THEN 1 ELSE 0 END AS INTEGER) AS in_scope,
       concat_ws(';', """ + ", ".join(
    f"CASE WHEN len(id_{t}) > 0 THEN '{t}:' || array_to_string(id_{t}, ',') END" for t in ID_PATTERNS) + """) AS ids
FROM triaged""", "v_queries")

ORACLES["classify_by_lexicon"] = with_views(TRIAGED + """
SELECT query_id, array_to_string(intents, ',') AS intents FROM triaged""", "v_queries")

IDS_LONG = TRIAGED + """,
ids AS (""" + "\n  UNION ALL ".join(
    f"SELECT query_id, '{t}' AS id_type, CAST(generate_subscripts(id_{t}, 1) - 1 AS INTEGER) AS pos, unnest(id_{t}) AS id FROM triaged"
    for t in ID_PATTERNS) + ")"

ORACLES["extract_ids"] = with_views(IDS_LONG + "\nSELECT query_id, id_type, pos, id FROM ids", "v_queries")

ORACLES["routing_eval"] = with_views(TRIAGED + """,
j AS (
  SELECT t.query_id, t.intents, list_filter(string_split(r.expected_agents, ','), lambda x: x <> '') AS exp
  FROM triaged t JOIN v_routing r ON t.query_id = r.query_id)
SELECT query_id, array_to_string(intents, ',') AS predicted, array_to_string(exp, ',') AS expected,
       array_to_string(list_filter(exp, lambda x: NOT list_contains(intents, x)), ',') AS missing,
       array_to_string(list_filter(intents, lambda x: NOT list_contains(exp, x)), ',') AS extra,
       CAST(CASE WHEN len(list_filter(exp, lambda x: NOT list_contains(intents, x))) = 0
             AND len(list_filter(intents, lambda x: NOT list_contains(exp, x))) = 0 THEN 1 ELSE 0 END AS INTEGER) AS exact
FROM j""", "v_queries", "v_routing")

ORACLES["out_of_scope"] = with_views(TRIAGED + """
SELECT query_id, """ + _sql_str(
    "Maaf, pertanyaan ini berada di luar cakupan sistem PT Cipta Manufaktur Nusantara. "
    "Sistem ini hanya menangani pertanyaan seputar empat domain: (1) Maintenance -- "
    "kondisi mesin dan prediksi kegagalan, (2) Customer Service -- keluhan pelanggan "
    "dan SOP, (3) Vendor/Procurement -- validasi dokumen vendor, dan (4) Finance -- "
    "biaya operasional. Silakan ajukan pertanyaan yang berkaitan dengan salah satu "
    "domain tersebut, atau hubungi divisi terkait secara langsung untuk pertanyaan lain.") + """ AS message
FROM triaged WHERE len(intents) = 0""", "v_queries")

# --- lookups ------------------------------------------------------------------

TICKET_SUMMARY = "'[' || kategori || '] ' || isi_komplain || ' (status: ' || status_resolusi || ')'"

ENTITIES = f""",
ent AS (
  SELECT 'ticket' AS id_type, upper(ticket_id) AS id, row_order, ticket_id AS matched_id,
         '[' || kategori || '] ' || isi_komplain || ' (status: ' || status_resolusi || ', waktu_respons: '
         || CAST(waktu_respons_jam AS VARCHAR) || ' jam)' AS summary
  FROM v_tickets
  UNION ALL
  SELECT 'maintenance_case', upper(case_id), row_order, case_id, '[' || machine_id || '] ' || failure_type
         || ': ' || catatan_teknisi || ' (downtime: ' || CAST(downtime_jam AS VARCHAR) || ' jam, biaya: Rp'
         || format('{{:,.0f}}', biaya_perbaikan_idr) || ')' FROM v_cases
  UNION ALL
  SELECT 'sensor_record', upper(record_id), row_order, record_id,
         'machine_id=' || machine_id || ', failure_type=' || ({LABEL_V3}) || ', tool_wear_min=' || CAST(tool_wear_min AS VARCHAR)
         || ', torque_Nm=' || CAST(torque_nm AS VARCHAR)
  FROM v_sensor),
plain AS (
  SELECT i.query_id, i.id_type, i.pos, i.id, arg_min(e.matched_id, e.row_order) AS matched_id,
         arg_min(e.summary, e.row_order) AS summary
  FROM ids i JOIN ent e ON i.id_type = e.id_type AND i.id = e.id
  WHERE i.id_type IN ('ticket', 'maintenance_case', 'sensor_record')
  GROUP BY i.query_id, i.id_type, i.pos, i.id),
po AS (
  SELECT i.query_id, i.id_type, i.pos, i.id, arg_min(t.ticket_id, t.row_order) AS matched_id,
         arg_min({TICKET_SUMMARY}, t.row_order) AS summary
  FROM ids i JOIN v_tickets t ON contains(upper(t.isi_komplain), i.id)
  WHERE i.id_type = 'po_number'
  GROUP BY i.query_id, i.id_type, i.pos, i.id)"""

ORACLES["exact_lookup"] = with_views(IDS_LONG + ENTITIES + """
SELECT *, CASE id_type WHEN 'ticket' THEN 0 WHEN 'maintenance_case' THEN 1 WHEN 'po_number' THEN 2
                       WHEN 'sensor_record' THEN 3 END AS type_rank
FROM (SELECT * FROM plain UNION ALL SELECT * FROM po)""", "v_queries", "v_tickets", "v_cases", "v_sensor")

ORACLES["po_lookup"] = with_views(IDS_LONG + ENTITIES + """
SELECT query_id, pos, id, matched_id, summary FROM po""", "v_queries", "v_tickets", "v_cases", "v_sensor")

ORACLES["vendor_lookup"] = with_views("""
SELECT k.key_id, k.key, min(v.row_order) AS row_order,
       arg_min(v.vendor_id, v.row_order) AS vendor_id, arg_min(v.nama_vendor, v.row_order) AS nama_vendor,
       arg_min(v.dokumen_belum_lengkap, v.row_order) AS dokumen_belum_lengkap,
       arg_min(v.status_validasi, v.row_order) AS status_validasi, arg_min(v.kategori, v.row_order) AS kategori,
       arg_min(v.kelengkapan_dokumen_pct, v.row_order) AS kelengkapan_dokumen_pct, arg_min(v.skor_risiko, v.row_order) AS skor_risiko,
       CAST(CASE WHEN count(v.vendor_id) > 0 THEN 1 ELSE 0 END AS INTEGER) AS found
FROM v_vendor_keys k LEFT JOIN v_vendors v
  ON length(k.key) > 0 AND (contains(lower(v.vendor_id), lower(k.key)) OR contains(lower(v.nama_vendor), lower(k.key)))
GROUP BY k.key_id, k.key""", "v_vendor_keys", "v_vendors")

_CHECKLIST_VALUES = ",\n  ".join(
    "(" + ", ".join([_sql_str(d), _sql_str(w), "NULL" if m is None else repr(m), _sql_str(n), str(i)]) + ")"
    for i, (d, w, m, n) in enumerate(CHECKLIST_ROWS))

ORACLES["vendor_gap_report"] = with_views(f"""
WITH cl(dokumen, wajib, masa_berlaku_bulan, catatan, ord) AS (VALUES
  {_CHECKLIST_VALUES}),
notes AS (SELECT dokumen, arg_min(wajib, ord) AS wajib, arg_min(catatan, ord) AS catatan FROM cl GROUP BY dokumen),
parts AS (
  SELECT vendor_id, status_validasi,
         CASE WHEN dokumen_belum_lengkap = '-' THEN []::VARCHAR[]
              ELSE list_transform(string_split(dokumen_belum_lengkap, '; '),
                                  lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) END AS docs
  FROM v_vendors),
docs AS (
  SELECT vendor_id, status_validasi, CAST(generate_subscripts(docs, 1) - 1 AS INTEGER) AS pos, unnest(docs) AS dokumen
  FROM parts)
SELECT d.vendor_id, d.status_validasi, d.pos, d.dokumen, n.wajib, n.catatan
FROM docs d LEFT JOIN notes n ON d.dokumen = n.dokumen""", "v_vendors")

# --- documents and retrieval --------------------------------------------------

TOKEN_RE = r"'[\p{L}\p{N}_]{2,}'"
WS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

CHUNKS = f"""
WITH parts AS (
  SELECT doc_id AS source_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS chunk_index,
         unnest(string_split(text, chr(10))) AS s
  FROM documents),
chunks AS (
  SELECT CAST(source_id AS VARCHAR) || '::chunk-' || CAST(chunk_index AS VARCHAR) AS chunk_id, source_id, chunk_index,
         regexp_replace(s, '^{WS}+|{WS}+$', '', 'g') AS text
  FROM parts
  WHERE length(regexp_replace(s, '^{WS}+|{WS}+$', '', 'g')) >= 20)"""

ORACLES["chunk_sections"] = CHUNKS + "\nSELECT * FROM chunks"

CASE_HISTORY = """
WITH case_history AS (
  SELECT 'maint::' || case_id AS doc_id,
         '[' || machine_id || '] ' || failure_type || ': downtime ' || CAST(CAST(downtime_jam AS BIGINT) AS VARCHAR) || ' jam' AS text,
         'maintenance_case' AS type, machine_id, failure_type, downtime_jam, biaya_perbaikan_idr,
         CAST(NULL AS VARCHAR) AS kategori, CAST(NULL AS VARCHAR) AS status_resolusi
  FROM v_cases
  UNION ALL
  SELECT 'ticket::' || ticket_id, '[' || kategori || '] ' || isi_komplain, 'complaint_ticket',
         NULL, NULL, NULL, NULL, kategori, status_resolusi
  FROM v_tickets)"""

ORACLES["build_case_history"] = with_views(CASE_HISTORY + "\nSELECT * FROM case_history", "v_cases", "v_tickets")

ORACLES["upsert_documents"] = """
WITH base AS (SELECT doc_id, text, lang, source FROM documents),
incoming AS (SELECT b.doc_id, b.text, b.lang, b.source, l.quality, l.toxic FROM base b JOIN labels l ON b.doc_id = l.doc_id)
SELECT doc_id, text, lang, source, CAST(NULL AS INTEGER) AS quality, CAST(NULL AS INTEGER) AS toxic
FROM base WHERE doc_id NOT IN (SELECT doc_id FROM incoming)
UNION ALL SELECT * FROM incoming"""


def tfidf_ctes(p: str, docs: str, queries: str, k: int, max_features: int = 512) -> str:
    """Brute-force TF-IDF top-k in SQL: ``docs`` yields (doc_id, text), ``queries``
    yields (qtext); every (distinct query, doc) pair is scored."""
    return f"""
{p}_docs AS ({docs}),
{p}_tc AS (
  SELECT doc_id, term, count(*) AS tf
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {TOKEN_RE})) AS term FROM {p}_docs)
  GROUP BY doc_id, term),
{p}_vocab AS (
  SELECT term, df, cf, ln((1.0 + (SELECT count(*) FROM {p}_docs)) / (1.0 + df)) + 1.0 AS idf
  FROM (SELECT term, count(*) AS df, sum(tf) AS cf FROM {p}_tc GROUP BY term)
  ORDER BY cf DESC, term ASC LIMIT {max_features}),
{p}_dw AS (SELECT doc_id, term, tf * idf AS raw FROM {p}_tc JOIN {p}_vocab USING (term)),
{p}_dp AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS w FROM {p}_dw),
{p}_dflag AS (
  SELECT d.doc_id, CASE WHEN d.doc_id IN (SELECT doc_id FROM {p}_dp) THEN 1 ELSE 0 END AS nz FROM {p}_docs d),
{p}_q AS (SELECT DISTINCT qtext FROM ({queries})),
{p}_qtc AS (
  SELECT qtext, term, count(*) AS tf
  FROM (SELECT qtext, unnest(regexp_extract_all(lower(qtext), {TOKEN_RE})) AS term FROM {p}_q)
  GROUP BY qtext, term),
{p}_qw AS (SELECT qtext, term, tf * idf AS raw FROM {p}_qtc JOIN {p}_vocab USING (term)),
{p}_qp AS (SELECT qtext, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY qtext)) AS w FROM {p}_qw),
{p}_qflag AS (
  SELECT q.qtext, CASE WHEN q.qtext IN (SELECT qtext FROM {p}_qp) THEN 1 ELSE 0 END AS qn FROM {p}_q q),
{p}_dot AS (
  SELECT q.qtext, d.doc_id, sum(q.w * d.w) AS dot FROM {p}_qp q JOIN {p}_dp d USING (term) GROUP BY q.qtext, d.doc_id),
{p}_all AS (
  SELECT q.qtext, f.doc_id,
         round(greatest(0.0, q.qn + f.nz - 2 * coalesce(t.dot, 0.0)), 9) + 0.0 AS distance
  FROM {p}_qflag q CROSS JOIN {p}_dflag f
  LEFT JOIN {p}_dot t ON t.qtext = q.qtext AND t.doc_id = f.doc_id),
{p}_top AS (
  SELECT qtext, doc_id, distance, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY qtext ORDER BY distance, doc_id) AS rank FROM {p}_all)
  WHERE rank <= {k})"""


ORACLES["tfidf_vocab"] = f"""
WITH {tfidf_ctes('d', 'SELECT doc_id, text FROM documents', 'SELECT text AS qtext FROM conversations', 3)}
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_index, df, CAST(cf AS BIGINT) AS cf, round(idf, 9) AS idf
FROM d_vocab"""

ORACLES["tfidf_search"] = f"""
WITH {tfidf_ctes('d', 'SELECT doc_id, text FROM documents', 'SELECT text AS qtext FROM conversations', 3)}
SELECT c.conv_id, c.turn, CAST(t.rank AS INTEGER) AS rank, t.doc_id, round(t.distance, 6) AS distance
FROM conversations c JOIN d_top t ON c.text = t.qtext"""


def _sop_sql(k: int) -> str:
    return CHUNKS + "," + tfidf_ctes(
        's', 'SELECT chunk_id AS doc_id, text FROM chunks', 'SELECT text AS qtext FROM conversations', k) + f"""
, hits AS (
  SELECT c.conv_id, c.turn, CAST(t.rank AS INTEGER) AS rank, t.doc_id, ch.source_id, round(t.distance, 6) AS distance
  FROM conversations c JOIN s_top t ON c.text = t.qtext JOIN chunks ch ON ch.chunk_id = t.doc_id)"""


ORACLES["sop_search"] = _sop_sql(3) + "\nSELECT * FROM hits"

ORACLES["grounding_rate"] = _sop_sql(1) + """
, g AS (
  SELECT c.conv_id, c.turn, CASE WHEN coalesce(min(h.distance), 999.0) < 1.6 THEN 1 ELSE 0 END AS grounded
  FROM conversations c LEFT JOIN hits h ON c.conv_id = h.conv_id AND c.turn = h.turn
  GROUP BY c.conv_id, c.turn)
SELECT count(*) AS n_queries, CAST(sum(grounded) AS BIGINT) AS n_grounded, round(avg(grounded) * 100, 1) AS pct_grounded
FROM g"""

ORACLES["citation_coverage"] = _sop_sql(2) + """
, g AS (
  SELECT c.conv_id, c.turn, CASE WHEN count(h.doc_id) > 0 THEN 1 ELSE 0 END AS has
  FROM conversations c LEFT JOIN hits h ON c.conv_id = h.conv_id AND c.turn = h.turn
  GROUP BY c.conv_id, c.turn)
SELECT count(*) AS n_queries, CAST(sum(has) AS BIGINT) AS n_with_citation, round(avg(has) * 100, 1) AS pct_with_citation
FROM g"""

HYBRID = IDS_LONG + ENTITIES + """,
exact AS (
  SELECT query_id, 'exact' AS source,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY type_rank, pos, id) AS INTEGER) AS rank,
         matched_id AS doc_key,
         CASE id_type WHEN 'ticket' THEN 'complaint_ticket' WHEN 'po_number' THEN 'complaint_ticket'
                      WHEN 'maintenance_case' THEN 'maintenance_case' ELSE 'sensor_record' END AS doc_type,
         CAST(NULL AS DOUBLE) AS distance
  FROM (SELECT *, CASE id_type WHEN 'ticket' THEN 0 WHEN 'maintenance_case' THEN 1 WHEN 'po_number' THEN 2
                               ELSE 3 END AS type_rank
        FROM (SELECT * FROM plain UNION ALL SELECT * FROM po))),
rest AS (SELECT query_id, query FROM v_queries WHERE query_id NOT IN (SELECT query_id FROM exact)),
""" + CASE_HISTORY.replace("WITH case_history", "case_history", 1).strip() + "," + tfidf_ctes(
    'h', 'SELECT doc_id, text FROM case_history', 'SELECT query AS qtext FROM rest', 3) + """,
hybrid AS (
  SELECT * FROM exact
  UNION ALL
  SELECT r.query_id, 'semantic', CAST(t.rank AS INTEGER), t.doc_id,
         CASE WHEN starts_with(t.doc_id, 'maint::') THEN 'maintenance_case' ELSE 'complaint_ticket' END,
         round(t.distance, 6)
  FROM rest r JOIN h_top t ON r.query = t.qtext)"""

ORACLES["hybrid_search"] = with_views(HYBRID + "\nSELECT * FROM hybrid",
                                      "v_queries", "v_tickets", "v_cases", "v_sensor")

ORACLES["routing_accuracy"] = with_views(HYBRID + """,
detail AS (
  SELECT r.query_id, r.expected_type,
         count(CASE WHEN h.doc_type = 'maintenance_case' THEN 1 END) AS mc,
         count(CASE WHEN h.doc_type = 'complaint_ticket' THEN 1 END) AS tc
  FROM v_routing r LEFT JOIN hybrid h ON r.query_id = h.query_id
  GROUP BY r.query_id, r.expected_type),
scored AS (
  SELECT CASE WHEN (CASE WHEN mc >= tc THEN 'maintenance_case' ELSE 'complaint_ticket' END) = expected_type
              THEN 1 ELSE 0 END AS correct FROM detail)
SELECT count(*) AS n_queries, CAST(sum(correct) AS BIGINT) AS n_correct,
       round(avg(correct) * 100, 1) AS routing_accuracy_pct
FROM scored""", "v_queries", "v_tickets", "v_cases", "v_sensor", "v_routing")

# --- labels, splits, metrics ----------------------------------------------------

ORACLES["label_dictionary"] = with_views("""
SELECT kategori AS label, CAST(row_number() OVER (ORDER BY kategori) - 1 AS INTEGER) AS label_id
FROM (SELECT DISTINCT kategori FROM v_tickets WHERE kategori IS NOT NULL)""", "v_tickets")

ORACLES["stratified_split"] = with_views("""
WITH base AS (SELECT ticket_id, kategori AS label, md5('42:' || ticket_id) AS h FROM v_tickets),
c AS (SELECT label, count(*) AS n FROM base GROUP BY label),
t AS (SELECT *, sum(n) OVER () AS total FROM c),
t2 AS (SELECT *, total - CAST(ceil(total * CAST(0.2 AS DOUBLE)) AS BIGINT) AS ntrain FROM t),
t3 AS (SELECT *, CAST((CAST(n AS HUGEINT) * ntrain) // total AS BIGINT) AS fl,
              (CAST(n AS HUGEINT) * ntrain) % total AS rem FROM t2),
t4 AS (SELECT *, ntrain - sum(fl) OVER () AS lft, row_number() OVER (ORDER BY rem DESC, label ASC) AS r FROM t3),
quota AS (SELECT label, fl + CASE WHEN r <= lft THEN 1 ELSE 0 END AS n_train FROM t4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) - 1 AS class_rank FROM base)
SELECT ranked.ticket_id, ranked.label, CAST(class_rank AS BIGINT) AS class_rank,
       CASE WHEN class_rank < n_train THEN 'train' ELSE 'test' END AS split
FROM ranked JOIN quota USING (label)""", "v_tickets")

ORACLES["class_weights"] = """
WITH c AS (SELECT quality AS label, count(*) AS n FROM labels GROUP BY quality)
SELECT label, n, round((SELECT count(*) FROM labels) / ((SELECT count(*) FROM c) * CAST(n AS DOUBLE)), 9) AS weight FROM c"""

PRED = f"""
WITH pred AS (SELECT {LABEL_V3} AS truth, {LABEL_V2} AS prediction FROM v_sensor),
conf AS (SELECT truth AS t, prediction AS p, count(*) AS n FROM pred GROUP BY 1, 2),
ast AS (SELECT t AS label, sum(n) AS support, sum(CASE WHEN t = p THEN n ELSE 0 END) AS tp FROM conf GROUP BY t),
ap AS (SELECT p AS label, sum(n) AS predicted FROM conf GROUP BY p),
pc0 AS (SELECT coalesce(ast.label, ap.label) AS label, CAST(coalesce(support, 0) AS BIGINT) AS support, coalesce(tp, 0) AS tp,
               coalesce(predicted, 0) AS predicted FROM ast FULL OUTER JOIN ap ON ast.label = ap.label),
pc1 AS (SELECT label, support, tp,
               CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pc0),
pc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
       FROM pc1)"""

ORACLES["classification_scores"] = with_views(PRED + """
SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 9) AS accuracy, round(avg(precision), 9) AS precision_macro,
       round(avg(recall), 9) AS recall_macro, round(avg(f1), 9) AS f1_macro
FROM pc""", "v_sensor")

ORACLES["classification_report"] = with_views(PRED + """
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM pc
UNION ALL
SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT) FROM pc
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9),
       round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM pc
UNION ALL
SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM pc""", "v_sensor")

ORACLES["dense_search"] = """
WITH e AS (SELECT vec_id, embedding FROM embeddings),
flat AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM e),
d AS (SELECT a.vec_id AS q, b.vec_id AS vec_id, sum((a.x - b.x) * (a.x - b.x)) AS dist
      FROM flat a JOIN flat b ON a.i = b.i GROUP BY a.vec_id, b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(dist, 9), vec_id) AS rank FROM d)
SELECT q AS query_vec_id, CAST(rank AS INTEGER) AS rank, vec_id, round(dist, 6) AS distance FROM r WHERE rank <= 5"""

ORACLES["running_context"] = with_views(TRIAGED + """,
steps AS (
  SELECT query_id, query, CAST(generate_subscripts(plan, 1) - 1 AS INTEGER) AS pos, unnest(plan) AS agent
  FROM (SELECT query_id, query, list_concat(list_filter(intents, lambda x: x <> 'finance'),
                                            list_filter(intents, lambda x: x = 'finance')) AS plan FROM triaged)),
lab AS (SELECT *, CASE agent WHEN 'maintenance' THEN 'Maintenance Agent' WHEN 'cs' THEN 'Customer Service Agent'
                             WHEN 'vendor' THEN 'Vendor & Procurement Agent' WHEN 'finance' THEN 'Finance Agent' END AS label
        FROM steps)
SELECT query_id, pos, agent,
       coalesce(string_agg(chr(10) || '[' || label || ']: ' || label || ' menangani: ' || query || chr(10), '')
                OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context
FROM lab""", "v_queries")

# --- streaming ------------------------------------------------------------------

ORACLES["stream_weekly_cost"] = with_views(f"""
SELECT CAST(date_trunc('week', tanggal) AS DATE) AS minggu, CAST(sum({RATE_CASE}) AS DOUBLE) AS biaya_kompensasi_cs_idr,
       count(*) AS n_tickets
FROM v_tickets GROUP BY 1""", "v_tickets")

# weeks that end at or before the newest event less 30 days
ORACLES["stream_closed_weeks"] = with_views(WEEKLY_BODY + """,
newest AS (SELECT max(t) AS t FROM (SELECT max(CAST(tanggal AS TIMESTAMP)) AS t FROM v_cases UNION ALL SELECT max(CAST(tanggal AS TIMESTAMP)) FROM v_tickets))
SELECT weekly.* FROM weekly, newest WHERE CAST(minggu AS TIMESTAMP) + INTERVAL 7 DAYS <= t - INTERVAL 30 DAYS""", "v_cases", "v_tickets", "v_vendors")
ORACLES["stream_tools_by_role"] = ORACLES["tool_usage_by_role"]
ORACLES["stream_tool_usage"] = with_views("""
SELECT DISTINCT run_id, coalesce(nullif(agent_role, ''), 'unknown') AS agent_role, tool_name FROM v_tool_log""", "v_tool_log")

ORACLES["stream_label_and_score"] = ORACLES["label_failures"]
ORACLES["stream_triage"] = ORACLES["triage"]

# --- oversampling ------------------------------------------------------------------


def split_sql(base: str) -> str:
    """CTE ``splitted(k, label, class_rank, split)`` of the exact stratified split;
    ``base`` yields (k, label)."""
    return f"""
sbase AS (SELECT k, label, md5('42:' || CAST(k AS VARCHAR)) AS h FROM ({base})),
sc AS (SELECT label, count(*) AS n FROM sbase GROUP BY label),
st AS (SELECT *, sum(n) OVER () AS total FROM sc),
st2 AS (SELECT *, total - CAST(ceil(total * CAST(0.2 AS DOUBLE)) AS BIGINT) AS ntrain FROM st),
st3 AS (SELECT *, CAST((CAST(n AS HUGEINT) * ntrain) // total AS BIGINT) AS fl,
               (CAST(n AS HUGEINT) * ntrain) % total AS rem FROM st2),
st4 AS (SELECT *, ntrain - sum(fl) OVER () AS lft, row_number() OVER (ORDER BY rem DESC, label ASC) AS r FROM st3),
squota AS (SELECT label, fl + CASE WHEN r <= lft THEN 1 ELSE 0 END AS n_train FROM st4),
sranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) - 1 AS class_rank FROM sbase),
splitted AS (SELECT sranked.k, sranked.label, class_rank,
                    CASE WHEN class_rank < n_train THEN 'train' ELSE 'test' END AS split
             FROM sranked JOIN squota USING (label))"""


ORACLES["smote"] = with_views(LABELLED + "," + split_sql("SELECT record_id AS k, failure_type AS label FROM labelled") + """,
tr AS (SELECT label, count(*) AS n FROM splitted WHERE split = 'train' GROUP BY label)
SELECT label, n AS n_original, (SELECT max(n) FROM tr) - n AS n_synthetic, (SELECT max(n) FROM tr) AS n_total,
       CAST(1 AS INTEGER) AS within_bounds
FROM tr""", "v_sensor")

# in-class neighbours by all pairs; the choices of base point, neighbour and gap from the same MD5 texts
FEATURE_NAMES = ["air_temperature_k", "process_temperature_k", "rotational_speed_rpm", "torque_nm", "tool_wear_min"]
_SQUARES = " + ".join(f"power(CAST(a.{c} AS DOUBLE) - CAST(b.{c} AS DOUBLE), 2)" for c in FEATURE_NAMES)
_POINTS = (LABELLED + "," + split_sql("SELECT record_id AS k, failure_type AS label FROM labelled") + f""",
pts AS (SELECT s.k, s.label, {", ".join(FEATURE_NAMES)} FROM splitted s JOIN v_sensor v ON v.record_id = s.k WHERE split = 'train'),
nb AS (
  SELECT a.k, a.label, b.k AS nb_key,
         CAST(row_number() OVER (PARTITION BY a.k ORDER BY round({_SQUARES}, 9), b.k) AS INTEGER) AS nb_rank
  FROM pts a JOIN pts b ON a.label = b.label AND a.k <> b.k QUALIFY nb_rank <= 5)""")
ORACLES["smote_neighbours"] = with_views(_POINTS + "\nSELECT k AS record_id, nb_rank, nb_key FROM nb", "v_sensor")
_DRAW = "CAST(concat('0x', substr(md5(concat_ws(':', '42', k, CAST(s AS VARCHAR){0})), 1, 8)) AS BIGINT)"
_BETWEEN = ", ".join(
    f"round(CASE WHEN nb_key IS NULL THEN CAST(p.{c} AS DOUBLE) ELSE CAST(p.{c} AS DOUBLE) + u * (CAST(q.{c} AS DOUBLE) - CAST(p.{c} AS DOUBLE)) END, 8)"
    f" AS {c}" for c in FEATURE_NAMES)
ORACLES["smote_samples"] = with_views(_POINTS + f""",
cls AS (SELECT label, count(*) AS n FROM pts GROUP BY label),
lim AS (SELECT max(n) AS target, greatest(1, least(5, min(n) - 1)) AS k_eff FROM cls),
base AS (
  SELECT k, label, n, target - n AS need, k_eff, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', k))) - 1 AS r
  FROM pts JOIN cls USING (label), lim),
drawn AS (
  SELECT *, unnest(range(need // n + CASE WHEN r < need % n THEN 1 ELSE 0 END)) AS s FROM base),
chosen AS (
  SELECT k, label, s, CASE WHEN least(k_eff, n - 1) >= 1 THEN {_DRAW.format('')} % least(k_eff, n - 1) + 1 END AS nb_rank,
         CAST({_DRAW.format(", 'u'")} % 1000000 AS DOUBLE) / 1000000 AS u FROM drawn),
synth AS (
  SELECT concat(c.k, '#s', CAST(c.s AS VARCHAR)) AS sample_id, c.label, CAST(1 AS INTEGER) AS is_synthetic, nb_key, {_BETWEEN}
  FROM chosen c JOIN pts p ON p.k = c.k LEFT JOIN nb ON nb.k = c.k AND nb.nb_rank = c.nb_rank LEFT JOIN pts q ON q.k = nb_key)
SELECT * FROM synth UNION ALL
SELECT k, label, CAST(0 AS INTEGER), NULL, {", ".join(f"round(CAST({c} AS DOUBLE), 8)" for c in FEATURE_NAMES)} FROM pts""", "v_sensor")

# --- composites and helpers -----------------------------------------------------------

ORACLES["class_floor"] = with_views(LABELLED + "," + split_sql("SELECT record_id AS k, failure_type AS label FROM labelled") + """,
tr AS (SELECT label, count(*) AS n FROM splitted WHERE split = 'train' GROUP BY label)
SELECT min(n) AS min_class_count, greatest(1, least(5, min(n) - 1)) AS k_neighbors FROM tr""", "v_sensor")

ORACLES["quantize_readings"] = with_views("""
SELECT record_id, round(air_temperature_k, 1) AS air_temperature_k, round(process_temperature_k, 1) AS process_temperature_k,
       CAST(rotational_speed_rpm AS INTEGER) AS rotational_speed_rpm, round(torque_nm, 1) AS torque_nm,
       CAST(tool_wear_min AS INTEGER) AS tool_wear_min,
       round(torque_nm * (rotational_speed_rpm * 2 * pi() / 60), 6) AS power_w,
       round(process_temperature_k - air_temperature_k, 6) AS delta_t_k,
       round(tool_wear_min * torque_nm, 6) AS strain
FROM v_sensor""", "v_sensor")
