"""DuckDB formulations of the domain views (independent of the Spark code).

name -> (dependencies, SELECT text). Used as CTEs by the oracle queries.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, sql: str, deps: list[str] | None = None) -> None:
    VIEWS[name] = (deps or [], sql)


view("v_inv_ord", """
SELECT CAST(l_shipdate AS DATE) AS event_date,
       concat('SUP-', l_suppkey) AS supplier_code,
       concat('SKU-', l_partkey) AS product_sku,
       concat('WH-', l_suppkey % 25) AS warehouse_code,
       l_quantity * 10 AS on_hand_quantity,
       CAST(floor(l_quantity * 50 * l_tax) AS DOUBLE) AS reserved_quantity,
       CAST(l_linenumber * 15 AS DOUBLE) AS inbound_quantity,
       CAST(1 + (l_orderkey * 37 + l_partkey * 11) % 600 AS DOUBLE) AS forecast_quantity,
       CAST((l_orderkey * 53 + l_suppkey * 7) % 600 AS DOUBLE) AS actual_demand_quantity,
       l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_suppkey
FROM lineitem
""")

view("v_inv", """
SELECT event_date, supplier_code, product_sku, warehouse_code, on_hand_quantity,
       reserved_quantity, inbound_quantity, forecast_quantity, actual_demand_quantity
FROM v_inv_ord
""", ["v_inv_ord"])

view("v_inv_clean", """
SELECT event_date, supplier_code, product_sku, warehouse_code, on_hand_quantity,
       reserved_quantity, inbound_quantity, forecast_quantity, actual_demand_quantity
FROM v_inv_ord
QUALIFY row_number() OVER (
  PARTITION BY event_date, supplier_code, product_sku, warehouse_code
  ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) = 1
""", ["v_inv_ord"])

# History as delivered by a partner CSV: planted blank keys, NULL / negative quantities.
view("v_inv_raw", """
SELECT event_date,
       CASE WHEN l_orderkey % 211 = 0 THEN '  ' ELSE supplier_code END AS supplier_code,
       CASE WHEN l_orderkey % 389 = 0 THEN NULL ELSE product_sku END AS product_sku,
       warehouse_code,
       CASE WHEN l_partkey % 307 = 0 THEN NULL ELSE on_hand_quantity END AS on_hand_quantity,
       reserved_quantity,
       CASE WHEN l_suppkey % 53 = 0 AND l_linenumber = 3 THEN -1.0 ELSE inbound_quantity END
         AS inbound_quantity,
       forecast_quantity,
       actual_demand_quantity
FROM v_inv_ord
""", ["v_inv_ord"])

# Risk projection (C1-C4) over any history view, parametrised by textual replace.
RISK_PROJECTION = """
SELECT *,
       greatest(on_hand_quantity - reserved_quantity, 0.0) AS available_quantity,
       greatest(on_hand_quantity - reserved_quantity, 0.0) + inbound_quantity - forecast_quantity
         AS projected_ending_quantity,
       greatest(-(greatest(on_hand_quantity - reserved_quantity, 0.0) + inbound_quantity
                  - forecast_quantity), 0.0) AS projected_shortage_quantity,
       forecast_quantity - actual_demand_quantity AS forecast_error,
       abs(forecast_quantity - actual_demand_quantity) AS absolute_forecast_error
FROM {src}
"""

view("v_proj_base", RISK_PROJECTION.format(src="v_inv"), ["v_inv"])
view("v_proj", """
SELECT *, CASE WHEN forecast_quantity > 0 THEN projected_shortage_quantity / forecast_quantity
               ELSE 0.0 END AS shortage_ratio
FROM v_proj_base
""", ["v_proj_base"])
view("v_thr", """
SELECT coalesce(quantile_cont(shortage_ratio, 0.5), 0.0) AS low_to_medium,
       coalesce(quantile_cont(shortage_ratio, 0.8), 0.0) AS medium_to_high
FROM v_proj WHERE shortage_ratio > 0
""", ["v_proj"])
view("v_curated", """
SELECT p.*, CASE WHEN shortage_ratio = 0 THEN 'none'
                 WHEN shortage_ratio <= t.low_to_medium THEN 'low'
                 WHEN shortage_ratio <= t.medium_to_high THEN 'medium'
                 ELSE 'high' END AS severity
FROM v_proj p CROSS JOIN v_thr t
""", ["v_proj", "v_thr"])

# The same chain over the de-duplicated history (the pipeline input).
view("c_proj_base", RISK_PROJECTION.format(src="v_inv_clean"), ["v_inv_clean"])
view("c_proj", """
SELECT *, CASE WHEN forecast_quantity > 0 THEN projected_shortage_quantity / forecast_quantity
               ELSE 0.0 END AS shortage_ratio
FROM c_proj_base
""", ["c_proj_base"])
view("c_thr", """
SELECT coalesce(quantile_cont(shortage_ratio, 0.5), 0.0) AS low_to_medium,
       coalesce(quantile_cont(shortage_ratio, 0.8), 0.0) AS medium_to_high
FROM c_proj WHERE shortage_ratio > 0
""", ["c_proj"])
view("c_curated", """
SELECT p.*, CASE WHEN shortage_ratio = 0 THEN 'none'
                 WHEN shortage_ratio <= t.low_to_medium THEN 'low'
                 WHEN shortage_ratio <= t.medium_to_high THEN 'medium'
                 ELSE 'high' END AS severity
FROM c_proj p CROSS JOIN c_thr t
""", ["c_proj", "c_thr"])
# Per-date thresholds (one run per partition date: the backfill).
view("d_thr", """
SELECT event_date,
       quantile_cont(shortage_ratio, 0.5) AS low_to_medium,
       quantile_cont(shortage_ratio, 0.8) AS medium_to_high
FROM c_proj WHERE shortage_ratio > 0 GROUP BY event_date
""", ["c_proj"])
view("d_curated", """
SELECT p.*, CASE WHEN shortage_ratio = 0 THEN 'none'
                 WHEN shortage_ratio <= coalesce(t.low_to_medium, 0.0) THEN 'low'
                 WHEN shortage_ratio <= coalesce(t.medium_to_high, 0.0) THEN 'medium'
                 ELSE 'high' END AS severity
FROM c_proj p LEFT JOIN d_thr t USING (event_date)
""", ["c_proj", "d_thr"])


def d_uint(seed, idx: str, field: str) -> str:
    """DuckDB twin of ``synthetic.uint``."""
    return f"CAST(('0x' || substr(md5(concat('{seed}-', {idx}, '-{field}')), 1, 8)) AS BIGINT)"


def d_unit(seed, idx: str, field: str) -> str:
    return f"({d_uint(seed, idx, field)} / 4294967296.0)"


view("v_recon_base", """
SELECT l_partkey * 4294967296 + l_suppkey AS record_index,
       concat('SUP-', l_suppkey) AS supplier_code,
       concat('SKU-', l_partkey) AS product_sku,
       concat('WH-', l_suppkey % 25) AS warehouse_code,
       CAST(floor(sum(l_quantity)) AS BIGINT) AS hub_quantity,
       [-20, -8, -3, 0, 0, 0, 0, 4, 9, 25][
         CAST(('0x' || substr(md5(concat('42-', l_partkey, '-', l_suppkey)), 1, 8)) AS BIGINT) % 10 + 1]
         AS delta
FROM lineitem GROUP BY l_partkey, l_suppkey
""")
view("v_supplier_feed", """
SELECT record_index, supplier_code, product_sku, warehouse_code,
       greatest(hub_quantity + delta, 0) AS reported_quantity
FROM v_recon_base
""", ["v_recon_base"])
view("v_hub", "SELECT record_index, product_sku, warehouse_code, hub_quantity FROM v_recon_base",
     ["v_recon_base"])
view("v_recon", """
SELECT s.record_index, s.supplier_code, s.product_sku, s.warehouse_code, s.reported_quantity,
       h.hub_quantity, s.reported_quantity - h.hub_quantity AS difference_quantity,
       (s.reported_quantity - h.hub_quantity) = 0 AS matches
FROM v_supplier_feed s JOIN v_hub h USING (record_index, product_sku, warehouse_code)
""", ["v_supplier_feed", "v_hub"])

SEED = 20260729
view("g_recon_base", f"""
SELECT o_orderkey AS record_index,
       {d_uint(SEED, 'o_orderkey', 'hub')} % 500 AS hub_quantity,
       [-20, -8, -3, 0, 0, 0, 0, 4, 9, 25][{d_uint(SEED, 'o_orderkey', 'delta')} % 10 + 1] AS delta,
       printf('SYN-SKU-%07d', o_orderkey) AS product_sku,
       printf('SYN-WH-%02d', o_orderkey % 25) AS warehouse_code,
       concat('SYN-SUPPLIER-', o_orderkey % 4) AS supplier_code
FROM orders
""")
view("g_recon", """
SELECT record_index, supplier_code, product_sku, warehouse_code,
       greatest(hub_quantity + delta, 0) AS reported_quantity, hub_quantity,
       greatest(hub_quantity + delta, 0) - hub_quantity AS difference_quantity,
       greatest(hub_quantity + delta, 0) - hub_quantity = 0 AS matches
FROM g_recon_base
""", ["g_recon_base"])


def _normal(seed, idx, field):
    us = " + ".join(d_unit(seed, idx, f"{field}{k}") for k in range(1, 5))
    return f"(({us}) - 2.0) * {repr(3.0 ** 0.5)}"


view("g_risk_base", f"""
SELECT o_orderkey AS record_index,
       printf('SYN-RISK-SKU-%07d', o_orderkey) AS product_sku,
       printf('SYN-WH-%02d', o_orderkey % 25) AS warehouse_code,
       CAST(20 + {d_uint(SEED, 'o_orderkey', 'on_hand')} % 480 AS DOUBLE) AS on_hand_quantity,
       {d_unit(SEED, 'o_orderkey', 'reserved')} AS u_res,
       CAST({d_uint(SEED, 'o_orderkey', 'inbound')} % 180 AS DOUBLE) AS inbound_quantity,
       0.65 + {d_unit(SEED, 'o_orderkey', 'factor')} * 0.8 AS factor,
       {_normal(SEED, 'o_orderkey', 'noise')} AS z
FROM orders
""")
view("g_risk_r", """
SELECT *, CAST(floor(on_hand_quantity * (u_res * 0.45)) AS DOUBLE) AS reserved_quantity FROM g_risk_base
""", ["g_risk_base"])
view("g_risk_f", """
SELECT *, greatest(1.0, round_even((on_hand_quantity - reserved_quantity + inbound_quantity) * factor, 0))
         AS forecast_quantity FROM g_risk_r
""", ["g_risk_r"])
view("g_risk", """
SELECT record_index, product_sku, warehouse_code, on_hand_quantity, reserved_quantity, inbound_quantity,
       forecast_quantity,
       greatest(0.0, round_even(forecast_quantity * (1.0 + 0.18 * z), 0)) AS actual_demand_quantity
FROM g_risk_f
""", ["g_risk_f"])
view("g_proj_base", RISK_PROJECTION.format(src="g_risk"), ["g_risk"])
view("g_proj", """
SELECT *, CASE WHEN forecast_quantity > 0 THEN projected_shortage_quantity / forecast_quantity
               ELSE 0.0 END AS shortage_ratio
FROM g_proj_base
""", ["g_proj_base"])
view("g_thr", """
SELECT coalesce(quantile_cont(shortage_ratio, 0.5), 0.0) AS low_to_medium,
       coalesce(quantile_cont(shortage_ratio, 0.8), 0.0) AS medium_to_high
FROM g_proj WHERE shortage_ratio > 0
""", ["g_proj"])
view("g_curated", """
SELECT p.*, CASE WHEN shortage_ratio = 0 THEN 'none'
                 WHEN shortage_ratio <= t.low_to_medium THEN 'low'
                 WHEN shortage_ratio <= t.medium_to_high THEN 'medium'
                 ELSE 'high' END AS severity
FROM g_proj p CROSS JOIN g_thr t
""", ["g_proj", "g_thr"])

UNITS_SQL = "['EACH', 'CASE', 'PALLET', 'KILOGRAM']"
ROW_KEY_SQL = ("CAST(('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
               "l_quantity, l_extendedprice)), 1, 15)) AS BIGINT)")

view("v_feed_records", f"""
SELECT concat('JOB-', l_suppkey, '-', year(l_shipdate)) AS import_job_id,
       CAST(year(l_shipdate) AS INTEGER) AS job_seq,
       concat('SUP-', l_suppkey) AS supplier_id,
       concat('REF-', l_orderkey % 400) AS source_reference,
       {ROW_KEY_SQL} AS source_row,
       concat(CASE WHEN l_partkey % 10 = 0 THEN 'NEW-' ELSE 'EXT-' END, l_partkey) AS external_sku,
       concat(CASE WHEN l_suppkey % 25 = 7 THEN 'YARD-' ELSE 'LOC-' END, l_suppkey % 25) AS external_location,
       l_shipdate AS observed_at,
       {UNITS_SQL}[(l_partkey + l_suppkey % 2 + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) % 4 + 1] AS source_unit,
       CAST(l_quantity AS DECIMAL(18,3)) AS on_hand_quantity,
       CAST(l_quantity * l_discount AS DECIMAL(18,3)) AS reserved_quantity,
       CAST(CASE WHEN l_linenumber % 2 = 1 THEN NULL
                 ELSE 1 + (l_partkey + l_suppkey % 2) % 12 + CASE WHEN l_linenumber = 6 THEN 1 ELSE 0 END END
            AS DECIMAL(18,3)) AS units_per_source_unit
FROM lineitem
""")
view("v_product_map", f"""
SELECT DISTINCT concat('SUP-', l_suppkey) AS supplier_id, concat('EXT-', l_partkey) AS external_sku,
       concat('PRD-', l_partkey) AS product_id,
       {UNITS_SQL}[(l_partkey + l_suppkey % 2) % 4 + 1] AS source_unit,
       CAST(1 + (l_partkey + l_suppkey % 2) % 12 AS DECIMAL(18,3)) AS units_per_source_unit,
       CAST(1 + (l_partkey * 3 + l_suppkey) % 3 AS INTEGER) AS version, (l_partkey * 3 + l_suppkey) % 7 <> 0 AS active
FROM lineitem
""")
view("v_warehouse_map", """
SELECT concat('SUP-', s_suppkey) AS supplier_id, concat('LOC-', s_suppkey % 25) AS external_location,
       concat('WH-', s_suppkey % 25) AS warehouse_id,
       CAST(1 + s_suppkey % 2 AS INTEGER) AS version, s_suppkey % 11 <> 10 AS active
FROM supplier
""")
VERDICT_CHAIN = [("flagged", """
SELECT r.*, pm.product_id, pm.source_unit AS map_unit, pm.units_per_source_unit AS map_factor,
       pm.version AS product_mapping_version, wm.warehouse_id, wm.version AS warehouse_mapping_version,
       CASE WHEN pm.product_id IS NULL THEN 'product_mapping_not_found'
            WHEN wm.warehouse_id IS NULL THEN 'warehouse_mapping_not_found'
            WHEN pm.source_unit <> r.source_unit THEN 'source_unit_mismatch'
            WHEN r.units_per_source_unit IS NOT NULL AND r.units_per_source_unit <> pm.units_per_source_unit
              THEN 'unit_conversion_mismatch' END AS map_code,
       CASE WHEN pm.product_id IS NULL THEN 'external_sku'
            WHEN wm.warehouse_id IS NULL THEN 'external_location'
            WHEN pm.source_unit <> r.source_unit THEN 'source_unit'
            WHEN r.units_per_source_unit IS NOT NULL AND r.units_per_source_unit <> pm.units_per_source_unit
              THEN 'units_per_source_unit' END AS map_field
FROM {src} r
LEFT JOIN (SELECT * FROM v_product_map WHERE active) pm USING (supplier_id, external_sku)
LEFT JOIN (SELECT * FROM v_warehouse_map WHERE active) wm USING (supplier_id, external_location)
""", ["{src}", "v_product_map", "v_warehouse_map"]),
# Sequential semantics, written as windows: first row of the key in the job,
# and the earliest job whose first row passes the mapping rules.
("verdicts_base", """
SELECT *,
       min(source_row) OVER (PARTITION BY supplier_id, source_reference, external_sku, external_location, job_seq)
         AS first_row,
       first_value(map_code IS NULL) OVER (
         PARTITION BY supplier_id, source_reference, external_sku, external_location, job_seq
         ORDER BY source_row) AS first_ok
FROM {p}_flagged
""", ["{p}_flagged"]),
("verdicts_acc", """
SELECT *, min(CASE WHEN first_ok AND source_row = first_row THEN job_seq END) OVER (
            PARTITION BY supplier_id, source_reference, external_sku, external_location) AS accepted_job
FROM {p}_verdicts_base
""", ["{p}_verdicts_base"]),
("verdicts", """
SELECT *, source_row <> first_row AS duplicate_in_file,
       coalesce(accepted_job < job_seq, false) AS already_imported,
       CASE WHEN source_row <> first_row OR coalesce(accepted_job < job_seq, false)
            THEN 'duplicate_source_record' ELSE map_code END AS error_code,
       CASE WHEN source_row <> first_row OR coalesce(accepted_job < job_seq, false)
            THEN NULL ELSE map_field END AS field_name,
       (CASE WHEN source_row <> first_row OR coalesce(accepted_job < job_seq, false)
            THEN 'duplicate_source_record' ELSE map_code END) IS NULL AS accepted
FROM {p}_verdicts_acc
""", ["{p}_verdicts_acc"]),
]


def verdict_views(prefix: str, src: str) -> None:
    """Define ``{prefix}_flagged`` .. ``{prefix}_verdicts`` over record view ``src``."""
    for name, sql, deps in VERDICT_CHAIN:
        view(f"{prefix}_{name}", sql.replace("{src}", src).replace("{p}", prefix),
             [d.replace("{src}", src).replace("{p}", prefix) for d in deps])


verdict_views("v", "v_feed_records")

view("v_snapshots", """
SELECT import_job_id, job_seq, supplier_id, product_id, warehouse_id, source_reference, external_sku,
       external_location, observed_at, source_row, source_unit,
       CAST(on_hand_quantity * map_factor AS DECIMAL(18,3)) AS on_hand_quantity,
       CAST(reserved_quantity * map_factor AS DECIMAL(18,3)) AS reserved_quantity,
       CAST(map_factor AS DECIMAL(18,3)) AS units_per_source_unit,
       product_mapping_version, warehouse_mapping_version
FROM v_verdicts WHERE accepted
""", ["v_verdicts"])

# --- partner payloads (same renderings as the Spark views) -------------------
SB_CANON = "snapshot_ref,as_of,partner_sku,depot,case_count,units_per_case"
SB_REORDERED = "depot,partner_sku,snapshot_ref,as_of,units_per_case,case_count,note"
SB_MISSING = "snapshot_ref,partner_sku,case_count,units_per_case"
SB_WIDE = ",".join(f"x{i}" for i in range(1, 35)) + ",," + SB_CANON
SB_WIDE_VALUES = ",".join(str(i) for i in range(34)) + ",blank"

view("sb_files", """
SELECT concat('B-', s_suppkey) AS file_id, s_suppkey,
       CASE WHEN s_suppkey % 17 = 0 THEN 3 WHEN s_suppkey % 7 = 0 THEN 4 ELSE CAST(s_suppkey % 3 AS INTEGER) END AS variant
FROM supplier
""")
view("sb_vals", f"""
SELECT f.file_id, f.variant, {ROW_KEY_SQL} AS source_row,
       concat('SB-', l_orderkey % 400) AS snapshot_ref,
       CASE WHEN l_partkey % 13 = 0 THEN strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S')
            WHEN l_partkey % 11 = 0 AND l_linenumber = 5 THEN 'not-a-time'
            ELSE strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '-07:00' END AS as_of,
       CASE WHEN l_orderkey % 97 = 0 THEN '' ELSE concat('EXT-', l_partkey) END AS partner_sku,
       concat('LOC-', l_suppkey % 25) AS depot,
       CASE WHEN l_partkey % 17 = 0 THEN '-2' ELSE printf('%.3f', l_quantity) END AS case_count,
       CASE WHEN l_partkey % 19 = 0 THEN '0' WHEN l_partkey % 23 = 0 THEN '1.2345'
            ELSE printf('%.3f', CAST(1 + l_partkey % 12 AS DOUBLE)) END AS units_per_case,
       '"not ""final"", ' || chr(10) || 'see below"' AS note,
       concat('"SB ""', l_orderkey % 400, '"", a"') AS quoted_ref
FROM lineitem JOIN sb_files f ON l_suppkey = f.s_suppkey
""", ["sb_files"])
view("sb_lines", f"""
SELECT file_id, CAST(1 AS BIGINT) AS source_row,
       CASE variant WHEN 0 THEN '{SB_REORDERED}' WHEN 3 THEN '{SB_MISSING}' WHEN 4 THEN '{SB_WIDE}'
                    ELSE '{SB_CANON}' END AS text,
       true AS is_header
FROM sb_files
UNION ALL
SELECT file_id, source_row,
       CASE variant
         WHEN 0 THEN concat_ws(',', depot, partner_sku, snapshot_ref, as_of, units_per_case, case_count, note)
         WHEN 2 THEN concat_ws(',', snapshot_ref, as_of, partner_sku, depot, case_count, units_per_case, 'extra')
         WHEN 3 THEN concat_ws(',', snapshot_ref, partner_sku, case_count, units_per_case)
         WHEN 4 THEN concat_ws(',', '{SB_WIDE_VALUES}', quoted_ref, as_of, partner_sku, depot, case_count,
                               units_per_case)
         ELSE concat_ws(',', snapshot_ref, as_of, partner_sku, depot, case_count, units_per_case) END AS text,
       false AS is_header
FROM sb_vals
""", ["sb_files", "sb_vals"])
view("sb_headers", """
SELECT file_id, string_split(text, ',') AS hdr,
       list_sort(list_filter(['snapshot_ref', 'as_of', 'partner_sku', 'depot', 'case_count', 'units_per_case'],
                             lambda x: NOT list_contains(string_split(text, ','), x))) AS missing
FROM sb_lines WHERE is_header
""", ["sb_lines"])
view("sb_fields", """
SELECT l.file_id, l.source_row, f[list_position(h.hdr, 'snapshot_ref')] AS snapshot_ref,
       f[list_position(h.hdr, 'as_of')] AS as_of, f[list_position(h.hdr, 'partner_sku')] AS partner_sku,
       f[list_position(h.hdr, 'depot')] AS depot, f[list_position(h.hdr, 'case_count')] AS case_count,
       f[list_position(h.hdr, 'units_per_case')] AS units_per_case
FROM (SELECT *, list_transform(
        regexp_extract_all(',' || text, ',("(?:[^"]|"")*"|[^,]*)', 1),
        lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:len(x) - 1], '""', '"') ELSE x END) AS f
      FROM sb_lines WHERE NOT is_header) l
JOIN sb_headers h USING (file_id)
WHERE len(h.missing) = 0
""", ["sb_lines", "sb_headers"])


def _str_bad(c):
    return f"({c} IS NULL OR length({c}) < 1 OR length({c}) > 100)"


def _ts_bad(c):
    return (f"({c} IS NULL OR NOT regexp_matches(trim({c}), '(Z|z|[+-]\\d\\d:?\\d\\d)$') "
            f"OR TRY_CAST(trim({c}) AS TIMESTAMPTZ) IS NULL)")


def _dec_bad(c, positive):
    t = f"trim({c})"
    frac = f"length(rtrim(regexp_extract({t}, '\\.(\\d*)$', 1), '0'))"
    ints = f"length(ltrim(regexp_extract({t}, '^[+-]?(\\d*)', 1), '0'))"
    cmp = "<=" if positive else "<"
    return (f"({c} IS NULL OR NOT regexp_full_match({t}, '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)') OR {frac} > 3 "
            f"OR {ints} + {frac} > 18 OR TRY_CAST({t} AS DECIMAL(38,10)) {cmp} 0)")


SB_CHECKS = [
    ("snapshot_ref", _str_bad("snapshot_ref")), ("as_of", _ts_bad("as_of")),
    ("partner_sku", _str_bad("partner_sku")), ("depot", _str_bad("depot")),
    ("case_count", _dec_bad("case_count", False)), ("units_per_case", _dec_bad("units_per_case", True)),
]
view("sb_field_errors", "\nUNION ALL\n".join(
    f"SELECT file_id, source_row, '{name}' AS field_name FROM sb_fields WHERE {cond}" for name, cond in SB_CHECKS
), ["sb_fields"])
view("sb_records", """
SELECT file_id, snapshot_ref AS source_reference, source_row, partner_sku AS external_sku,
       depot AS external_location, timezone('UTC', CAST(trim(as_of) AS TIMESTAMPTZ)) AS observed_at,
       'CASE' AS source_unit, CAST(trim(case_count) AS DECIMAL(18,3)) AS on_hand_quantity,
       CAST(0 AS DECIMAL(18,3)) AS reserved_quantity,
       CAST(trim(units_per_case) AS DECIMAL(18,3)) AS units_per_source_unit
FROM sb_fields f
WHERE NOT EXISTS (SELECT 1 FROM sb_field_errors e WHERE e.file_id = f.file_id AND e.source_row = f.source_row)
""", ["sb_fields", "sb_field_errors"])
view("sb_adapter_errors", """
SELECT file_id AS import_job_id, CAST(NULL AS BIGINT) AS source_row, 'missing_csv_headers' AS code,
       CAST(NULL AS VARCHAR) AS field_name
FROM sb_headers WHERE len(missing) > 0
UNION ALL
SELECT file_id, source_row, 'invalid_csv_field', field_name FROM sb_field_errors
""", ["sb_headers", "sb_field_errors"])
view("sb_feed", """
SELECT file_id AS import_job_id, 1 AS job_seq, concat('SUP-', file_id[3:]) AS supplier_id, source_reference, source_row,
       external_sku, external_location, observed_at, source_unit, on_hand_quantity, reserved_quantity,
       units_per_source_unit
FROM sb_records
""", ["sb_records"])
verdict_views("sb", "sb_feed")

# Supplier A: one JSON snapshot per order.
view("sa_items", f"""
SELECT concat('SA-', l_orderkey) AS payload_id, l_orderkey,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {ROW_KEY_SQL}) AS source_row,
       concat('EXT-', l_partkey) AS item_number, concat('LOC-', l_suppkey % 25) AS location,
       CASE WHEN l_partkey % 31 = 0 THEN '-5.000' ELSE printf('%.3f', l_quantity) END AS on_hand,
       CASE WHEN l_linenumber = 2 THEN NULL
            ELSE printf('%.3f', CAST(floor(l_quantity * l_discount) AS DOUBLE)) END AS allocated,
       CASE WHEN l_partkey % 29 = 0 THEN 'BOX' ELSE {UNITS_SQL}[l_partkey % 4 + 1] END AS unit
FROM lineitem
""")
view("sa_item_errors", f"""
SELECT payload_id, concat('items.', source_row - 1, '.on_hand') AS field_name FROM sa_items
WHERE {_dec_bad('on_hand', False)}
UNION ALL
SELECT payload_id, concat('items.', source_row - 1, '.allocated') FROM sa_items
WHERE allocated IS NOT NULL AND {_dec_bad('allocated', False)}
UNION ALL
SELECT payload_id, concat('items.', source_row - 1, '.unit') FROM sa_items
WHERE unit NOT IN ('EACH', 'CASE', 'PALLET', 'KILOGRAM')
""", ["sa_items"])
view("sa_records", """
SELECT i.payload_id, i.payload_id AS source_reference, i.source_row, i.item_number AS external_sku,
       i.location AS external_location, o.o_orderdate - INTERVAL 2 HOUR AS observed_at, i.unit AS source_unit,
       CAST(i.on_hand AS DECIMAL(18,3)) AS on_hand_quantity,
       CAST(coalesce(i.allocated, '0') AS DECIMAL(18,3)) AS reserved_quantity
FROM sa_items i JOIN orders o ON o.o_orderkey = i.l_orderkey
WHERE i.payload_id NOT IN (SELECT payload_id FROM sa_item_errors)
""", ["sa_items", "sa_item_errors"])

# Carrier C events: arrival order, re-sent copies, planted defects.
view("cc_raw", """
SELECT event_id * 2 AS arrival_seq, * FROM events
UNION ALL
SELECT event_id * 2 + 1 AS arrival_seq, * FROM events WHERE event_id % 13 = 0
""")
view("cc_events", """
SELECT arrival_seq, concat('C-EVT-', event_id) AS external_event_id,
       concat(CASE WHEN user_id % 41 = 0 THEN 'T-LOST-' ELSE 'T-' END, user_id, '-', strftime(ts, '%Y%m%d'))
         AS tracking_reference,
       CASE event_type WHEN 'signup' THEN 'picked_up' WHEN 'click' THEN 'in_transit' WHEN 'view' THEN 'delayed'
                       WHEN 'purchase' THEN 'delivered' WHEN 'error' THEN 'cancelled' END AS event_type,
       ts AS occurred_at, CASE WHEN event_type = 'view' THEN 'WEATHER' END AS reason_code,
       user_id, strftime(ts, '%Y%m%d') AS d
FROM cc_raw WHERE event_id % 50 <> 0 AND event_id % 10 <> 3
""", ["cc_raw"])
view("cc_rejects", """
SELECT arrival_seq, concat('C-EVT-', event_id) AS external_event_id, 'event' AS field_name
FROM cc_raw WHERE event_id % 50 = 0
UNION ALL
SELECT arrival_seq, concat('C-EVT-', event_id), 'event_time' FROM cc_raw WHERE event_id % 10 = 3
""", ["cc_raw"])
view("v_shipments", """
WITH d AS (SELECT DISTINCT user_id, strftime(ts, '%Y%m%d') AS d FROM events)
SELECT concat('SHP-', user_id, '-', d) AS shipment_id, concat('T-', user_id, '-', d) AS tracking_reference,
       concat('SUP-', user_id % 7) AS supplier_id FROM d
UNION ALL
SELECT concat('SHP-', user_id, '-', d, '-B'), concat('T-', user_id, '-', d), 'SUP-X' FROM d
WHERE user_id % 37 = 0
""")

# --- shipment lifecycle: matching and the arrival-order fold ------------------
view("cc_matched", """
WITH r AS (SELECT tracking_reference, count(*) AS n, min(shipment_id) AS sid FROM v_shipments GROUP BY ALL)
SELECT e.*, CASE WHEN r.n IS NULL THEN 'not_found' WHEN r.n > 1 THEN 'ambiguous' ELSE 'matched' END
              AS match_status,
       CASE WHEN r.n = 1 THEN r.sid END AS shipment_id
FROM cc_events e LEFT JOIN r USING (tracking_reference)
""", ["cc_events", "v_shipments"])
view("cc_transitions", "SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{b}', '{c}')" for a, b, c in [
        ("planned", "picked_up", "picked_up"), ("planned", "delayed", "delayed"),
        ("planned", "cancelled", "cancelled"), ("picked_up", "in_transit", "in_transit"),
        ("picked_up", "delayed", "delayed"), ("picked_up", "delivered", "delivered"),
        ("picked_up", "cancelled", "cancelled"), ("in_transit", "delayed", "delayed"),
        ("in_transit", "delivered", "delivered"), ("in_transit", "cancelled", "cancelled"),
        ("delayed", "in_transit", "in_transit"), ("delayed", "delivered", "delivered"),
        ("delayed", "cancelled", "cancelled")]) + ") t(s, e, n)")
view("cc_seq", """
SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY arrival_seq) AS rn
FROM cc_matched WHERE match_status = 'matched'
""", ["cc_matched"])
view("cc_fold", """
SELECT * FROM (
WITH RECURSIVE fold(shipment_id, rn, arrival_seq, verdict, status, acc) AS (
  SELECT q.shipment_id, q.rn, q.arrival_seq,
         CASE WHEN t.n IS NULL THEN 'illegal_transition' ELSE 'accepted' END,
         coalesce(t.n, 'planned'),
         CASE WHEN t.n IS NULL THEN CAST([] AS VARCHAR[]) ELSE [q.external_event_id] END
  FROM cc_seq q LEFT JOIN cc_transitions t ON t.s = 'planned' AND t.e = q.event_type
  WHERE q.rn = 1
  UNION ALL
  SELECT q.shipment_id, q.rn, q.arrival_seq,
         CASE WHEN list_contains(f.acc, q.external_event_id) THEN 'duplicate'
              WHEN t.n IS NULL THEN 'illegal_transition' ELSE 'accepted' END,
         CASE WHEN list_contains(f.acc, q.external_event_id) OR t.n IS NULL THEN f.status ELSE t.n END,
         CASE WHEN NOT list_contains(f.acc, q.external_event_id) AND t.n IS NOT NULL
              THEN list_append(f.acc, q.external_event_id) ELSE f.acc END
  FROM fold f JOIN cc_seq q ON q.shipment_id = f.shipment_id AND q.rn = f.rn + 1
  LEFT JOIN cc_transitions t ON t.s = f.status AND t.e = q.event_type
)
SELECT q.*, f.verdict, f.status AS status_after
FROM fold f JOIN cc_seq q USING (shipment_id, rn))
""", ["cc_seq", "cc_transitions"])
view("cc_verdicts", """
SELECT arrival_seq, external_event_id, tracking_reference, event_type, occurred_at, shipment_id,
       match_status, verdict, status_after FROM cc_fold
UNION ALL
SELECT arrival_seq, external_event_id, tracking_reference, event_type, occurred_at, shipment_id,
       match_status, match_status, NULL FROM cc_matched WHERE match_status <> 'matched'
""", ["cc_fold", "cc_matched"])
view("cc_states", """
SELECT shipment_id,
       arg_max(status_after, arrival_seq) AS status,
       arg_min(occurred_at, arrival_seq) FILTER (WHERE event_type = 'picked_up') AS shipped_at,
       arg_max(occurred_at, arrival_seq) FILTER (WHERE event_type = 'delivered') AS delivered_at,
       count(*) AS accepted_events
FROM cc_verdicts WHERE verdict = 'accepted' GROUP BY shipment_id
""", ["cc_verdicts"])

view("v_mapping_upserts", """
SELECT event_id, ts, concat('EXT-U', user_id) AS external_sku, concat('PRD-', event_type) AS product_id,
       'EACH' AS source_unit, CAST(1 + CAST(floor(value) AS BIGINT) % 3 AS DECIMAL(18,3)) AS units_per_source_unit,
       true AS active, concat('LOC-U', user_id) AS external_location,
       concat('WH-', CAST(floor(value) AS BIGINT) % 3) AS warehouse_id, event_type <> 'error' AS warehouse_active
FROM events WHERE event_type <> 'purchase'
""")
view("v_pm_versions", """
WITH c AS (
  SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0
                 WHEN product_id IS NOT DISTINCT FROM lag(product_id) OVER w
                  AND source_unit IS NOT DISTINCT FROM lag(source_unit) OVER w
                  AND units_per_source_unit IS NOT DISTINCT FROM lag(units_per_source_unit) OVER w
                  AND active IS NOT DISTINCT FROM lag(active) OVER w THEN 0 ELSE 1 END AS changed
  FROM v_mapping_upserts WINDOW w AS (PARTITION BY external_sku ORDER BY ts, event_id))
SELECT *, CAST(1 + sum(changed) OVER (PARTITION BY external_sku ORDER BY ts, event_id
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS version,
       lead(ts) OVER (PARTITION BY external_sku ORDER BY ts, event_id) AS valid_to
FROM c
""", ["v_mapping_upserts"])
view("v_wm_versions", """
WITH c AS (
  SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0
                 WHEN warehouse_id IS NOT DISTINCT FROM lag(warehouse_id) OVER w
                  AND warehouse_active IS NOT DISTINCT FROM lag(warehouse_active) OVER w THEN 0 ELSE 1 END
           AS changed
  FROM v_mapping_upserts WINDOW w AS (PARTITION BY external_location ORDER BY ts, event_id))
SELECT *, CAST(1 + sum(changed) OVER (PARTITION BY external_location ORDER BY ts, event_id
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS version
FROM c
""", ["v_mapping_upserts"])
view("v_mapped_snapshots", """
SELECT event_id, ts AS applied_at, concat('EXT-U', user_id) AS external_sku,
       CAST(floor(value) AS DECIMAL(18,3)) AS source_quantity
FROM events WHERE event_type = 'purchase'
""")

# --- hub entities -------------------------------------------------------------
AS_OF_SQL = "TIMESTAMP '2001-06-01 00:00:00'"
view("e_jobs", """
WITH b AS (
  SELECT *, o_orderdate + to_seconds(o_orderkey % 86400) AS created_at,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'failed' WHEN '2-HIGH' THEN 'completed'
              WHEN '3-MEDIUM' THEN 'completed_with_errors' WHEN '4-NOT SPECIFIED' THEN 'queued'
              ELSE 'processing' END AS status
  FROM orders)
SELECT concat('JOB-', o_orderkey) AS job_id, o_orderkey AS job_key, concat('SUP-', o_orderkey % 100) AS supplier_id,
       CASE WHEN o_orderkey % 2 = 0 THEN 'supplier_a_json' ELSE 'supplier_b_csv' END AS source_type,
       status, created_at, concat('idem-', o_orderkey % 5000) AS idempotency_key,
       sha256(o_orderstatus) AS content_sha256, CAST(o_orderkey % 4 AS INTEGER) AS attempt_count,
       3 AS max_attempts,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(trunc(o_totalprice) AS BIGINT) END AS payload_size,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE created_at + to_seconds((o_orderkey % 7) * 86400) END
         AS next_retry_at,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE created_at + to_seconds(o_orderkey % 90) END AS dispatched_at,
       CASE WHEN status = 'processing' THEN created_at + to_seconds(300) END AS lease_expires_at,
       CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 15 <> 0 THEN concat('JOB-', o_orderkey - 5) END
         AS replay_of_job_id,
       CASE WHEN o_orderkey % 9 = 0 THEN concat('bad id ', o_orderkey) ELSE concat('corr-', o_orderkey) END
         AS correlation_id,
       CAST(o_orderkey % 50 AS INTEGER) AS accepted_records, CAST(o_custkey % 5 AS INTEGER) AS rejected_records,
       CASE WHEN status IN ('completed', 'completed_with_errors', 'failed') THEN created_at + to_seconds(3600) END
         AS completed_at
FROM b
""")
view("e_attempts", f"""
SELECT concat('JOB-', l_orderkey) AS job_id, l_linenumber, {ROW_KEY_SQL} AS attempt_key,
       CASE WHEN l_returnflag = 'R' THEN 'TimeoutError' WHEN l_returnflag = 'A' THEN 'OperationalError'
            WHEN l_linestatus = 'O' THEN 'PermanentImportError' END AS error_type,
       l_shipdate AS started_at
FROM lineitem
""")
view("e_op_events", """
SELECT event_id AS event_seq, concat('OPE-', event_id) AS event_id, ts AS occurred_at,
       concat('JOB-', event_id % 15000) AS job_id, event_type AS component,
       CASE WHEN value > 50 THEN 'failed' ELSE 'succeeded' END AS status, props AS details
FROM events
""")
view("e_runs", """
SELECT concat('RUN-', c_custkey) AS run_id,
       CASE WHEN c_custkey % 2 = 0 THEN 'inventory_reconciliation' ELSE 'stockout_risk' END AS run_type,
       CASE WHEN c_custkey % 2 = 1 THEN 'numpy' WHEN c_custkey % 4 = 0 THEN 'pandas' ELSE 'polars' END AS engine,
       CAST(c_custkey % 1000 + 1 AS INTEGER) AS input_rows, CAST(abs(c_acctbal) AS DECIMAL(18,3)) AS duration_ms,
       TIMESTAMP '2026-01-01 00:00:00' + to_seconds(c_custkey * 60) AS created_at
FROM customer
""")
view("e_shipment_events", """
SELECT concat('SHIP-', event_id) AS shipment_id, concat('C-EVT-', user_id) AS external_event_id,
       CASE event_type WHEN 'signup' THEN 'picked_up' WHEN 'click' THEN 'in_transit' WHEN 'view' THEN 'delayed'
                       WHEN 'purchase' THEN 'delivered' ELSE 'returned' END AS event_type,
       CASE WHEN event_type = 'view' THEN 'WEATHER' END AS reason_code
FROM events
""")
view("e_import_errors", """
SELECT concat('JOB-', l_orderkey) AS job_id, 'invalid_csv_field' AS error_code,
       CASE WHEN l_linenumber % 2 = 1 THEN 'case_count' END AS field_name,
       concat('Input should be greater than 0, not ', l_linenumber) AS message
FROM lineitem WHERE l_returnflag = 'R'
""")
view("e_job_snapshots", """
SELECT concat('JOB-', l_orderkey) AS job_id, l_linenumber AS source_row, concat('PRD-', l_partkey) AS product_id,
       CAST(trunc(l_quantity) AS BIGINT) AS on_hand
FROM lineitem WHERE l_linestatus = 'F'
""")
view("e_reconciliations", """
SELECT concat('RUN-', l_suppkey) AS run_id, l_partkey AS record_index, concat('SUP-', l_suppkey) AS supplier_code,
       concat('SKU-', l_partkey) AS product_sku, concat('WH-', l_suppkey % 25) AS warehouse_code
FROM lineitem
""")
view("e_products", """
SELECT concat('PRD-', p_partkey) AS product_id, concat('SKU-', p_partkey) AS sku, p_name AS name
FROM part
""")
view("e_warehouses", """
SELECT concat('WH-', n_nationkey) AS warehouse_id, concat('wh-', lower(n_name)) AS code, n_name AS name,
       CASE WHEN n_nationkey = 13 THEN 'Mars/Olympus'
            ELSE ['Africa/Lagos', 'America/New_York', 'Asia/Tokyo', 'Europe/Berlin', 'Asia/Dubai'][n_regionkey + 1]
       END AS timezone
FROM nation
""")
view("e_suppliers", """
SELECT concat('SUP-', s_suppkey) AS supplier_id, concat(' sup_', s_suppkey, ' ') AS code, s_name AS name,
       s_acctbal AS balance
FROM supplier
""")
view("e_orders", """
SELECT concat('PO-', o_orderkey) AS order_id, concat('SUP-', o_custkey % 100) AS supplier_id,
       concat('REF-', o_orderkey) AS reference,
       CASE o_orderstatus WHEN 'F' THEN 'received' WHEN 'P' THEN 'partially_received' ELSE 'submitted' END AS status
FROM orders
""")
view("e_order_lines", f"""
SELECT concat('PO-', l_orderkey) AS order_id,
       concat(CASE WHEN l_partkey % 10 = 0 THEN 'PRD-GONE-' ELSE 'PRD-' END, l_partkey) AS product_id,
       l_linenumber AS pos1, {ROW_KEY_SQL} AS pos2,
       CAST(l_quantity AS DECIMAL(18,3)) AS ordered_quantity,
       CAST(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0.0 END AS DECIMAL(18,3)) AS received_quantity
FROM lineitem
""")
view("e_order_shipments", """
SELECT concat('SHIP-', o_orderkey) AS shipment_id, concat('PO-', o_orderkey) AS order_id,
       concat('SUP-', (CASE WHEN o_orderkey % 13 = 0 THEN o_custkey + 1 ELSE o_custkey END) % 100) AS supplier_id,
       concat('T-', o_orderkey % 14900) AS tracking_reference
FROM orders
""")
view("e_manifests", """
WITH d AS (
  SELECT CAST(l_shipdate AS DATE) AS d, list_sort(list(DISTINCT concat('WH-', l_suppkey % 25))) AS wh,
         count(*) AS input_rows
  FROM lineitem GROUP BY 1),
r AS (SELECT *, unnest(CASE WHEN day(d) % 2 = 0 THEN [1, 2] ELSE [1] END) AS run FROM d)
SELECT concat('manifests/inventory-risk/event_date=', strftime(d, '%Y-%m-%d'), '/run_id=run-', run, '.json')
         AS manifest_key,
       CASE WHEN day(d) % 7 = 0 THEN 'failed' ELSE 'succeeded' END AS status,
       strftime(d, '%Y-%m-%d') AS partition_date, concat('run-', run) AS run_id,
       CAST(d AS TIMESTAMP) + to_seconds(run * 3600) AS created_at, input_rows,
       CASE WHEN day(d) % 7 = 0 THEN CAST([] AS VARCHAR[]) ELSE list_transform(wh, lambda w: concat(
         'curated/inventory-risk/event_date=', strftime(d, '%Y-%m-%d'), '/run_id=run-', run,
         '/warehouse_code=', w, '/part-00000.parquet')) END AS curated_keys,
       CASE WHEN day(d) % 7 = 0 THEN CAST([] AS VARCHAR[]) ELSE [concat(
         'curated/inventory-risk-summary/event_date=', strftime(d, '%Y-%m-%d'), '/run_id=run-', run,
         '/part-00000.parquet')] END AS summary_keys
FROM r
""")

view("e_positions", """
SELECT warehouse_id, product_id, arg_max(on_hand_quantity, (job_seq, source_row)) AS on_hand_quantity,
       arg_max(reserved_quantity, (job_seq, source_row)) AS reserved_quantity, CAST(count(*) AS INTEGER) AS version
FROM v_snapshots GROUP BY warehouse_id, product_id
""", ["v_snapshots"])
view("e_lines_numbered", """
SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY pos1, pos2) AS line_number FROM e_order_lines
""", ["e_order_lines"])
view("e_attempts_numbered", """
SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY l_linenumber, attempt_key) AS attempt_number,
       CASE WHEN error_type IS NULL THEN 'succeeded'
            WHEN error_type IN ('OperationalError', 'TransientImportError', 'TimeoutError', 'ConnectionError')
            THEN 'retry_scheduled' ELSE 'failed' END AS status
FROM e_attempts
""", ["e_attempts"])

view("v_http", """
SELECT event_id, ts AS completed_at, concat('/api/v1/', event_type) AS route,
       CASE WHEN event_id % 20 = 0 THEN '500' WHEN event_id % 20 < 3 THEN '404' ELSE '200' END AS status,
       value / 10 AS duration_s, CAST(round(value * 100000) AS BIGINT) AS duration_us,
       epoch_us(ts) AS end_us
FROM events
""")
view("v_http_windows", """
SELECT *, date_trunc('minute', completed_at) - to_minutes(k) AS window_start
FROM v_http, range(0, 5) t(k)
""", ["v_http"])
