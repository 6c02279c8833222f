"""The adapters of :mod:`tidemark.sources.adapters` as DuckDB common table expressions, for the oracle queries."""

from __future__ import annotations

from tidemark.sources.adapters import FLOWS, INSTANTS

QUARTERS = """
q AS (
  SELECT l_suppkey AS s, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS start,
         round(sum(l_extendedprice * (1 - l_discount)), 4) AS r, sum(l_quantity) AS n
  FROM lineitem GROUP BY 1, 2),
quarters AS (
  SELECT s, start, CAST(start + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS "end", year(start) * 4 + quarter(start) - 1 AS qn, r, n,
         round(sum(r) OVER (PARTITION BY s ORDER BY start), 4) AS cr, sum(n) OVER (PARTITION BY s ORDER BY start) AS cn
  FROM q)"""


def _long(values: dict[str, str], kind: str, where: str) -> str:
    flow = kind == "flow"
    parts = " UNION ALL ".join(
        f"""SELECT lpad(CAST(s AS VARCHAR), 10, '0') AS cik, 'S' || s AS ticker, '{k}' AS metric_key, '{kind}' AS fact_type, 'USD' AS unit,
        CAST({v} AS DOUBLE) AS val, {'start' if flow else 'CAST(NULL AS DATE)'} AS start, "end", CAST("end" + 30 AS DATE) AS filed, CAST("end" + 30 AS DATE) AS effective_date,
        {'CAST("end" - start + 1 AS INT)' if flow else 'CAST(NULL AS INT)'} AS duration_days,
        CASE WHEN (s + qn) % 13 <> 0 THEN CAST(qn // 4 AS INT) END AS fiscal_year, CASE WHEN (s + qn) % 13 <> 0 THEN CAST(qn % 4 + 1 AS INT) END AS fiscal_quarter,
        '{'quarter' if flow else 'instant'}' AS period_type FROM quarters WHERE {where}"""
        for k, v in values.items()
    )
    return parts


FLOW = f"{QUARTERS},\nflow AS ({_long(FLOWS, 'flow', 'true')})"
INSTANT = f"{QUARTERS},\ninstant AS ({_long(INSTANTS, 'instant', 'true')})"
BOTH = f"{FLOW},\ninstant AS ({_long(INSTANTS, 'instant', 'true')})"

COMPANIES = """
companies AS (
  SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, 'S' || s_suppkey AS ticker, 'Brand#' || (s_suppkey % 25 + 1) AS listed,
         s_name AS company_name, r_name AS sector, n_name AS industry
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

BARS = """
bars AS (
  SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS price_date, round(sum(l_extendedprice * 100)) / sum(l_quantity) / 100 AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
PROXIES = BARS.replace("bars AS", "proxies AS").replace("p_brand", "p_type")
SPY = """
spy AS (
  SELECT 'SPY' AS ticker, CAST(l_shipdate AS DATE) AS price_date, round(sum(l_extendedprice * 100)) / sum(l_quantity) / 100 AS close, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 2)"""
MACRO = """
daily AS (
  SELECT CAST(o_orderdate AS DATE) AS observation_date, round(sum(o_totalprice * 100)) / count(*) / 1e7 AS rate, sum(o_custkey) / count(*) / 100 AS spread, round(sum(o_totalprice * 100)) / count(*) / 1e6 AS vix
  FROM orders GROUP BY 1),
macro AS (
  SELECT series_id, observation_date, CASE WHEN (observation_date - DATE '1970-01-01') % 17 <> 0 THEN value END AS value
  FROM (UNPIVOT daily ON rate, spread, vix INTO NAME series_id VALUE value))"""
