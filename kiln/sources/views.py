"""Derived input views over the driver tables.

Each view is one SQL text that runs unchanged in Spark SQL (with the base tables
passed as DataFrame arguments, no global temp views) and in DuckDB (where the
base tables are registered views).  The same text therefore feeds both the
engine and the oracle, so both sides read identical inputs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from kiln.sources.tables import TABLES, Tables

VIEW_SQL: dict[str, str] = {
    # machine sensor readings: every failure rule of the labeller fires
    "v_sensor": """
SELECT concat('REC-', lpad(CAST(event_id AS VARCHAR(20)), CAST(greatest(6, length(CAST(event_id AS VARCHAR(20)))) AS INTEGER), '0')) AS record_id,
 CASE user_id % 6 WHEN 0 THEN 'CNC-01' WHEN 1 THEN 'CNC-02' WHEN 2 THEN 'CNC-03'
                  WHEN 3 THEN 'CONV-01' WHEN 4 THEN 'CONV-02' ELSE 'PRESS-01' END AS machine_id,
 ts, CAST(2950 + event_id * 7 % 60 AS DOUBLE) / 10 AS air_temperature_k,
 CAST(3020 + event_id * 7 % 60 + event_id * 13 % 50 AS DOUBLE) / 10 AS process_temperature_k,
 1100 + event_id * 37 % 1000 AS rotational_speed_rpm,
 CAST(30 + event_id * 53 % 720 AS DOUBLE) / 10 AS torque_nm,
 (event_id * 17 + user_id * 29) % 260 AS tool_wear_min,
 event_id AS row_order
FROM {events}""",
    # complaint tickets
    "v_tickets": """
SELECT concat('TCK-', lpad(CAST(o_orderkey AS VARCHAR(20)), CAST(greatest(6, length(CAST(o_orderkey AS VARCHAR(20)))) AS INTEGER), '0')) AS ticket_id, o_orderdate AS tanggal,
 concat('PT ', CAST(o_custkey % 5 AS VARCHAR(20))) AS pelanggan,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'eskalasi_kritikal' WHEN '2-HIGH' THEN 'produk_cacat'
                      WHEN '3-MEDIUM' THEN 'retur_barang' ELSE 'keterlambatan_pengiriman' END AS kategori,
 concat('Pesanan PO-', lpad(CAST(o_orderkey AS VARCHAR(20)), CAST(greatest(6, length(CAST(o_orderkey AS VARCHAR(20)))) AS INTEGER), '0'),
        ' belum sampai, sudah lewat ', CAST(o_orderkey % 9 + 1 AS VARCHAR(20)), ' hari') AS isi_komplain,
 CAST(o_custkey % 80 AS DOUBLE) / 10 AS waktu_respons_jam,
 CASE o_orderstatus WHEN 'F' THEN 'Selesai - kompensasi diberikan' WHEN 'O' THEN 'Dalam proses investigasi'
                    ELSE 'Eskalasi ke manajemen' END AS status_resolusi,
 o_orderkey AS row_order
FROM {orders}""",
    # maintenance cases, one per order
    "v_cases": """
SELECT concat('MTC-', lpad(CAST(l_orderkey AS VARCHAR(20)), CAST(greatest(6, length(CAST(l_orderkey AS VARCHAR(20)))) AS INTEGER), '0')) AS case_id,
 CASE l_orderkey % 3 WHEN 0 THEN 'CNC-01' WHEN 1 THEN 'CONV-01' ELSE 'PRESS-01' END AS machine_id,
 CASE l_orderkey % 5 WHEN 0 THEN 'Tool Wear Failure' WHEN 1 THEN 'Heat Dissipation Failure'
   WHEN 2 THEN 'Power Failure' WHEN 3 THEN 'Overstrain Failure' ELSE 'Random Failure' END AS failure_type,
 min(l_shipdate) AS tanggal, CAST(count(*) AS DOUBLE) AS downtime_jam,
 CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS biaya_perbaikan_idr,
 concat('downtime ', CAST(count(*) AS VARCHAR(20)), ' jam') AS catatan_teknisi,
 l_orderkey AS row_order
FROM {lineitem} GROUP BY l_orderkey""",
    # vendor profiles
    "v_vendors": """
SELECT concat('VND-', lpad(CAST(s_suppkey AS VARCHAR(20)), CAST(greatest(4, length(CAST(s_suppkey AS VARCHAR(20)))) AS INTEGER), '0')) AS vendor_id, s_name AS nama_vendor,
 CASE s_suppkey % 3 WHEN 0 THEN 'Bahan Baku' WHEN 1 THEN 'Jasa Logistik' ELSE 'Suku Cadang' END AS kategori,
 CAST(CASE s_suppkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 60 WHEN 2 THEN 80 ELSE 40 END AS DOUBLE) + CAST(s_suppkey % 10 AS DOUBLE) / 10 AS kelengkapan_dokumen_pct,
 CASE s_suppkey % 4 WHEN 0 THEN 'Rendah' WHEN 3 THEN 'Tinggi' ELSE 'Sedang' END AS skor_risiko,
 CASE s_suppkey % 4 WHEN 0 THEN '-' WHEN 1 THEN 'NPWP; Sertifikat ISO 9001' WHEN 2 THEN 'NDA'
                    ELSE 'SIUP; Kontrak Kerjasama; NDA' END AS dokumen_belum_lengkap,
 CASE s_suppkey % 4 WHEN 0 THEN 'Lengkap - Aktif' WHEN 3 THEN 'Tertunda - Dokumen Kurang'
                    ELSE 'Perlu Klarifikasi' END AS status_validasi,
 s_suppkey AS row_order
FROM {supplier}""",
    # free-text questions, one per order (the table grows with the data): ids, PO,
    # two intents, one intent, out of scope, unknown id
    "v_queries": """
SELECT o_orderkey AS query_id, CASE o_orderkey % 6
 WHEN 0 THEN concat('status tiket TCK-', lpad(CAST(o_orderkey AS VARCHAR(20)), CAST(greatest(6, length(CAST(o_orderkey AS VARCHAR(20)))) AS INTEGER), '0'),
                    ' dan mtc-', lpad(CAST(o_orderkey + 3 AS VARCHAR(20)), CAST(greatest(6, length(CAST(o_orderkey + 3 AS VARCHAR(20)))) AS INTEGER), '0'))
 WHEN 1 THEN concat('pesanan po-', lpad(CAST(o_orderkey AS VARCHAR(20)), CAST(greatest(6, length(CAST(o_orderkey AS VARCHAR(20)))) AS INTEGER), '0'), ' belum sampai ke pelanggan')
 WHEN 2 THEN 'Mesin CNC-01 sering error, berapa estimasi biaya kalau ditunda'
 WHEN 3 THEN 'Cek kelengkapan dokumen vendor dan sertifikat ISO'
 WHEN 4 THEN 'berapa gaji karyawan'
 ELSE 'tiket TCK-999999 tidak ada, keterlambatan pengiriman' END AS query
FROM {orders}""",
    # tool-call log: one row per tool call, one null role
    "v_tool_log": """
SELECT event_id AS seq, ts, user_id AS run_id,
 CASE event_type WHEN 'click' THEN 'Customer Service Specialist' WHEN 'view' THEN 'Maintenance Analyst'
   WHEN 'purchase' THEN 'Finance Analyst' WHEN 'signup' THEN 'Vendor & Procurement Analyst' ELSE NULL END AS agent_role,
 CASE event_id % 3 WHEN 0 THEN 'sop_retriever' WHEN 1 THEN 'case_history_search'
                   ELSE 'machine_failure_predictor' END AS tool_name, value AS latency_ms
FROM {events}""",
    # expected routing for the question table, by question template
    "v_routing": """
SELECT o_orderkey AS query_id, CASE o_orderkey % 6
 WHEN 0 THEN 'cs,maintenance' WHEN 1 THEN 'cs' WHEN 2 THEN 'maintenance,finance'
 WHEN 3 THEN 'vendor' WHEN 4 THEN '' ELSE 'cs' END AS expected_agents,
 CASE o_orderkey % 6 WHEN 2 THEN 'maintenance_case' ELSE 'complaint_ticket' END AS expected_type
FROM {orders}""",
    # vendor search keys typed by users: lower-case vendor id, numeric name tail,
    # upper-case name prefix (matches several vendors: the first one wins)
    "v_vendor_keys": """
SELECT s_suppkey AS key_id, CASE s_suppkey % 3
 WHEN 0 THEN lower(concat('VND-', lpad(CAST(s_suppkey AS VARCHAR(20)), CAST(greatest(4, length(CAST(s_suppkey AS VARCHAR(20)))) AS INTEGER), '0')))
 WHEN 1 THEN substr(s_name, 10)
 ELSE upper(substr(s_name, 1, length(s_name) - 1)) END AS key
FROM {supplier}""",
    # raw machine readings with the five failure flags (input of schema mapping)
    "v_raw_machine": """
SELECT event_id AS row_order,
 CASE user_id % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'M' ELSE 'L' END AS type,
 concat(CASE user_id % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'M' ELSE 'L' END,
        lpad(CAST(event_id AS VARCHAR(20)), CAST(greatest(5, length(CAST(event_id AS VARCHAR(20)))) AS INTEGER), '0')) AS product_id,
 CAST(2950 + event_id * 7 % 60 AS DOUBLE) / 10 AS air_temperature_k,
 CAST(3020 + event_id * 7 % 60 + event_id * 13 % 50 AS DOUBLE) / 10 AS process_temperature_k,
 1100 + event_id * 37 % 1000 AS rotational_speed_rpm,
 CAST(30 + event_id * 53 % 720 AS DOUBLE) / 10 AS torque_nm,
 (event_id * 17 + user_id * 29) % 260 AS tool_wear_min,
 CASE WHEN (event_id * 17 + user_id * 29) % 260 > 200 THEN 1 ELSE 0 END AS twf,
 CASE WHEN event_id * 13 % 50 < 16 AND 1100 + event_id * 37 % 1000 < 1380 THEN 1 ELSE 0 END AS hdf,
 CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS pwf,
 CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS osf,
 CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS rnf,
 CASE WHEN (event_id * 17 + user_id * 29) % 260 > 200 OR event_id % 11 = 0 OR event_id % 13 = 0
        OR event_id % 97 = 0 OR event_id % 101 = 0
        OR (event_id * 13 % 50 < 16 AND 1100 + event_id * 37 % 1000 < 1380) THEN 1 ELSE 0 END AS machine_failure
FROM {events}""",
}

# which base tables each view reads
VIEW_DEPS = {name: tuple(sorted(set(re.findall(r"\{(\w+)\}", sql)))) for name, sql in VIEW_SQL.items()}


def spark_view(spark: SparkSession, sf_dir: str, name: str, tables: Tables | None = None) -> DataFrame:
    """Build a derived view as a DataFrame (no temp views are registered)."""
    t = tables or Tables(spark, sf_dir)
    args = {dep: getattr(t, dep) for dep in VIEW_DEPS[name]}
    return spark.sql(VIEW_SQL[name], **args)


def duck_view_sql(name: str) -> str:
    """The view text with plain table names, for a DuckDB CTE."""
    return VIEW_SQL[name].format(**{t: t for t in TABLES})


def with_views(sql: str, *names: str) -> str:
    """Prefix an oracle query with the CTEs of the views it uses.

    A body that starts with its own ``WITH`` is merged into one CTE list.
    """
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({duck_view_sql(n)}\n)" for n in names)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
