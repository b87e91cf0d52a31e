"""DuckDB SQL that recomputes each registered query independently.

The oracle re-derives the price rows from the test tables with window SQL
(``row_number() OVER (PARTITION BY date ...)``), which is independent of the
distributed numbering the Spark side uses.
"""

from __future__ import annotations

# Fixed parameter values (FIXTURES.md).
ITEM = "small_ring"
FROM, TO, DATE, AS_OF = "1998-01-01", "1998-12-31", "1998-08-23", "1998-12-31"

FACT_CTES = """
j AS (
  SELECT l.*, CAST(l_shipdate AS DATE) AS d, s_name, p_name, p_brand, p_type,
         n.n_nationkey AS nk, n.n_name AS nn
  FROM lineitem l JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey
  LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN nation n ON n.n_nationkey = c_nationkey AND n.n_nationkey <> 0),
k AS (
  SELECT *, 1 + row_number() OVER (PARTITION BY d ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn,
         CASE WHEN l_returnflag = 'R' AND l_linenumber % 3 = 0 THEN NULL
              ELSE CAST(floor(l_extendedprice / l_quantity) AS INTEGER) END AS mid
  FROM j),
rows_ AS (
  SELECT d AS trade_date,
    (['日','月','火','水','木','金','土'])[dayofweek(d) + 1] AS weekday_ja,
    'M' || lpad(CAST(l_suppkey AS VARCHAR), 4, '0') AS market_code, s_name AS market_name,
    replace(p_name, ' ', '_') AS item_code, p_name AS item_name,
    coalesce(CAST(nk AS VARCHAR), 'UNKNOWN') AS origin_code, coalesce(nn, '不明') AS origin_name,
    p_brand AS grade, p_type AS class, l_returnflag AS product_name, l_linestatus AS unit_weight,
    CAST(l_quantity AS DECIMAL(14,3)) AS item_total_ton,
    CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN NULL
         ELSE CAST(l_quantity AS DECIMAL(14,3)) END AS arrival_ton,
    mid + 10 AS price_high_yen, mid AS price_mid_yen, mid - 10 AS price_low_yen,
    CASE l_returnflag WHEN 'A' THEN '強含み' WHEN 'R' THEN '弱含み' END AS trend_label,
    strftime(d, '%Y%m%d') || '/all_' || strftime(d, '%Y%m%d') || '.csv' AS source_file,
    CAST(rn AS INTEGER) AS source_row_no
  FROM k),
fact AS (SELECT * EXCLUDE (market_name, item_name, origin_name) FROM rows_),
dim_market AS (SELECT row_number() OVER (ORDER BY market_code) AS id, market_code, market_name
               FROM (SELECT market_code, max(market_name) AS market_name FROM rows_ GROUP BY 1)),
dim_item AS (SELECT row_number() OVER (ORDER BY item_code) AS id, item_code, item_name
             FROM (SELECT item_code, max(item_name) AS item_name FROM rows_ GROUP BY 1)),
dim_origin AS (SELECT row_number() OVER (ORDER BY origin_code) AS id, origin_code, origin_name
               FROM (SELECT origin_code, max(origin_name) AS origin_name FROM rows_ GROUP BY 1)),
dim_grade AS (SELECT row_number() OVER (ORDER BY grade, class, product_name, unit_weight) AS id,
                     grade, class, product_name, unit_weight
              FROM (SELECT DISTINCT grade, class, product_name, unit_weight FROM rows_))
"""


def with_fact(select_sql: str, extra_ctes: str = "") -> str:
    ctes = FACT_CTES.strip() + (",\n" + extra_ctes.strip() if extra_ctes else "")
    return "WITH " + ctes + "\n" + select_sql


def r2(x: str) -> str:
    """S7 in DuckDB: round(x*100)/100 on a DOUBLE."""
    return f"round(CAST({x} AS DOUBLE) * 100) / 100"


DAILY_SELECT = f"""
  strftime(f.trade_date, '%Y-%m-%d') AS trade_date, weekday_ja, f.market_code, market_name,
  f.item_code, item_name, f.origin_code, origin_name, grade, class, product_name, unit_weight,
  {r2('item_total_ton')} AS item_total_ton, {r2('arrival_ton')} AS arrival_ton,
  price_high_yen, price_mid_yen, price_low_yen, trend_label, source_file, source_row_no"""

NAMES_JOIN = """
  JOIN dim_market m ON m.market_code = f.market_code
  JOIN dim_item i ON i.item_code = f.item_code
  JOIN dim_origin o ON o.origin_code = f.origin_code"""


def prices_daily() -> str:
    return with_fact(f"""
SELECT {DAILY_SELECT}
FROM (SELECT * FROM fact WHERE item_code = '{ITEM}' AND trade_date >= DATE '{FROM}' AND trade_date <= DATE '{TO}'
      ORDER BY trade_date DESC NULLS FIRST, source_file, source_row_no LIMIT 100 OFFSET 0) f
{NAMES_JOIN}""")


def prices_daily_by_price() -> str:
    return with_fact(f"""
SELECT {DAILY_SELECT}
FROM (SELECT * FROM fact WHERE item_code = '{ITEM}' AND trade_date >= DATE '{FROM}' AND trade_date <= DATE '{TO}'
      ORDER BY price_mid_yen DESC NULLS FIRST, source_file, source_row_no LIMIT 50 OFFSET 20) f
{NAMES_JOIN}""")


# the item with the most rows on its latest date, and the (date, item) with the most markets
BUSIEST_LATEST = """
busiest AS (SELECT item_code FROM fact JOIN (SELECT item_code, max(trade_date) AS trade_date FROM fact GROUP BY 1) USING (item_code, trade_date)
            GROUP BY 1 ORDER BY count(*) DESC, item_code LIMIT 1)"""
BUSIEST_DAY = """
busiest AS (SELECT trade_date, item_code FROM fact GROUP BY 1, 2
            ORDER BY count(DISTINCT market_code) DESC, trade_date, item_code LIMIT 1)"""


def prices_latest(item: str = f"'{ITEM}'", extra: str = "", limit: int = 100) -> str:
    return with_fact(f"""
SELECT {DAILY_SELECT}, (SELECT count(*) FROM lt) AS total_count
FROM (SELECT * FROM lt ORDER BY trade_date DESC NULLS FIRST, source_file, source_row_no LIMIT {limit}) f
{NAMES_JOIN}""", f"""{extra}
lt AS (SELECT * FROM fact WHERE item_code = {item}
         AND trade_date = (SELECT max(trade_date) FROM fact WHERE item_code = {item}))""")


def result_meta_sql(ranked: int) -> str:
    """The metadata of five results."""
    return with_fact(f"""
SELECT 'dimension_list' AS query, (SELECT count(*) FROM dim_item WHERE contains(lower(item_name), 'ring') OR contains(lower(item_code), 'ring')) AS total,
  20 AS "limit", NULL AS latest_trade_date, NULL AS default_from, NULL AS default_window_days
UNION ALL SELECT 'prices_latest', (SELECT count(*) FROM lt), 1, (SELECT strftime(max(trade_date), '%Y-%m-%d') FROM lt), NULL, NULL
UNION ALL SELECT 'prices_trend', (SELECT count(DISTINCT trade_date) FROM fact WHERE item_code = '{ITEM}' AND price_mid_yen IS NOT NULL
  AND trade_date BETWEEN DATE '{FROM}' AND DATE '{TO}'), NULL, NULL, NULL, NULL
UNION ALL SELECT 'prices_summary', (SELECT count(DISTINCT item_code || strftime(trade_date, '%Y-%m')) FROM fact WHERE trade_date >= DATE '1998-11-30'),
  NULL, NULL, '1998-11-30', 31
UNION ALL SELECT 'rank_items', (SELECT least({ranked}, count(DISTINCT item_code)) FROM fact WHERE trade_date = DATE '{DATE}' AND arrival_ton IS NOT NULL),
  {ranked}, NULL, NULL, NULL""", f"""{BUSIEST_LATEST},
lt AS (SELECT f.* FROM fact f JOIN busiest USING (item_code)
       WHERE trade_date = (SELECT max(trade_date) FROM fact WHERE item_code = (SELECT item_code FROM busiest)))""")


def trend_sql(where: str, keys: str = "trade_date") -> str:
    sel = "item_code, " if "item_code" in keys else ""
    return with_fact(f"""
SELECT {sel}strftime(trade_date, '%Y-%m-%d') AS trade_date, count(price_mid_yen) AS rows_count,
  {r2('avg(price_mid_yen)')} AS avg_price_mid_yen, max(price_mid_yen) AS max_price_mid_yen,
  min(price_mid_yen) AS min_price_mid_yen, {r2('sum(arrival_ton)')} AS arrival_ton_sum
FROM fact {where}
GROUP BY {keys} HAVING count(price_mid_yen) > 0""")


def summary_sql(period: str, where: str, all_items: bool = False) -> str:
    sel = "item_code, " if all_items else ""
    return with_fact(f"""
SELECT {sel}{period} AS period, count(*) AS rows_count,
  {r2('avg(price_mid_yen)')} AS avg_price_mid_yen, {r2('sum(arrival_ton)')} AS arrival_ton_sum
FROM fact {where}
GROUP BY {sel}{period}""")


PERIODS = {
    "day": "strftime(trade_date, '%Y-%m-%d')",
    "week": "strftime(date_trunc('week', trade_date), '%Y-%m-%d')",
    "month": "strftime(trade_date, '%Y-%m')",
}


def compare_sql(metric: str, where: str, all_items: bool = False, extra: str = "") -> str:
    val = "avg(price_mid_yen)" if metric == "price_mid" else "sum(arrival_ton)"
    sel = "f.item_code, " if all_items else ""
    return with_fact(f"""
SELECT {sel}f.market_code, m.market_name, f.rows_count, {r2('f.metric_value')} AS metric_value
FROM (SELECT {'item_code, ' if all_items else ''}market_code, count(*) AS rows_count,
             CAST({val} AS DOUBLE) AS metric_value
      FROM fact {where} GROUP BY ALL) f
JOIN dim_market m ON m.market_code = f.market_code""", extra)


def rank_sql(metric: str, where: str, limit: int, order: str = "DESC", per_date: bool = False) -> str:
    col = "arrival_ton" if metric == "arrival" else "price_mid_yen"
    val = f"sum({col})" if metric == "arrival" else f"avg({col})"
    if per_date:
        return with_fact(f"""
SELECT strftime(t.trade_date, '%Y-%m-%d') AS trade_date, t.item_code, i.item_name, t.rows_count,
       {r2('t.metric_value')} AS metric_value
FROM top t JOIN dim_item i ON i.item_code = t.item_code WHERE r <= {limit}""", f"""
agg AS (SELECT trade_date, item_code, count({col}) AS rows_count, CAST({val} AS DOUBLE) AS metric_value
        FROM fact {where} GROUP BY trade_date, item_code HAVING count({col}) > 0),
top AS (SELECT *, row_number() OVER (PARTITION BY trade_date
                ORDER BY metric_value {order} NULLS LAST, item_code) AS r FROM agg)""")
    return with_fact(f"""
SELECT t.item_code, i.item_name, t.rows_count, {r2('t.metric_value')} AS metric_value
FROM (SELECT item_code, count({col}) AS rows_count, CAST({val} AS DOUBLE) AS metric_value
      FROM fact {where} GROUP BY item_code HAVING count({col}) > 0
      ORDER BY metric_value {order} NULLS LAST, item_code LIMIT {limit}) t
JOIN dim_item i ON i.item_code = t.item_code""")


def dim_sql(kind: str, q: str | None, sort: str, order: str, limit: int, offset: int) -> str:
    code, name = f"{kind}_code", f"{kind}_name"
    where = f"WHERE {code} LIKE '%{q}%' OR {name} LIKE '%{q}%'" if q else ""
    nulls = "NULLS LAST" if order == "ASC" else "NULLS FIRST"
    tie = ", id" if sort != "id" else ""
    return with_fact(f"""
SELECT id, {code} AS code, {name} AS name FROM dim_{kind} {where}
ORDER BY {sort} {order} {nulls}{tie} LIMIT {limit} OFFSET {offset}""")


# ------------------------------------------------------------------ ingest
# Expected parse of the FIXTURES §4 dirty rows, computed from the clean rows
# and the defect class g (no parsing involved).
PARSED_CTES = """
r AS (SELECT *, (day(trade_date) * 31 + source_row_no) % 50 AS g FROM rows_),
parsed AS (
  SELECT r.*,
    CASE WHEN g = 0 THEN 'date' WHEN g = 1 THEN 'code' WHEN g = 2 THEN 'number'
         WHEN g = 3 THEN 'negative' WHEN g <> 7 AND price_mid_yen < 10 THEN 'negative'
         WHEN g = 4 THEN 'name' END AS reject_class
  FROM r),
acc AS (
  SELECT trade_date, weekday_ja, market_code, replace(replace(market_name, ' ', ''), '　', '') AS market_name,
    item_code, replace(replace(item_name, ' ', ''), '　', '') AS item_name,
    CASE WHEN g = 5 THEN 'UNKNOWN' ELSE origin_code END AS origin_code,
    CASE WHEN g = 5 THEN '不明' ELSE replace(replace(origin_name, ' ', ''), '　', '') END AS origin_name,
    grade, class, product_name, unit_weight, item_total_ton, arrival_ton,
    price_high_yen, price_mid_yen, CASE WHEN g = 7 THEN 0 ELSE price_low_yen END AS price_low_yen,
    trend_label, source_file, source_row_no
  FROM parsed WHERE reject_class IS NULL)
"""

PARSED_COLS = """trade_date, weekday_ja, market_code, market_name, item_code, item_name, origin_code, origin_name,
  grade, class, product_name, unit_weight, CAST(item_total_ton AS DOUBLE) AS item_total_ton,
  CAST(arrival_ton AS DOUBLE) AS arrival_ton, price_high_yen, price_mid_yen, price_low_yen, trend_label,
  source_file, source_row_no"""


def with_parsed(select_sql: str, extra: str = "") -> str:
    return with_fact(select_sql, PARSED_CTES + ("," + extra if extra else ""))


def parse_rows_sql() -> str:
    return with_parsed(f"SELECT {PARSED_COLS} FROM acc")


def quarantine_sql() -> str:
    return with_parsed("SELECT reject_class, count(*) AS rows FROM parsed WHERE reject_class IS NOT NULL GROUP BY 1")


def origin_counts_sql() -> str:
    return with_parsed("SELECT origin_code, origin_name, count(*) AS rows FROM acc GROUP BY 1, 2")


FILE_STATS = """
fs AS (SELECT source_file AS file_path, count(*) AS rows_total,
              count(*) FILTER (WHERE reject_class IS NULL) AS rows_ok,
              count(*) FILTER (WHERE reject_class IS NOT NULL) AS rows_error
       FROM parsed GROUP BY 1),
files AS (SELECT row_number() OVER (ORDER BY y.run_id, fs.file_path) AS id, y.run_id, fs.*,
                 CASE WHEN rows_error > 0 THEN 'partial_success' ELSE 'success' END AS status
          FROM fs JOIN (SELECT y, row_number() OVER (ORDER BY y) AS run_id
                        FROM (SELECT DISTINCT CAST(substr(file_path, 1, 4) AS INTEGER) AS y FROM fs)) y
            ON y.y = CAST(substr(fs.file_path, 1, 4) AS INTEGER)),
runs AS (SELECT run_id AS id, count(*) AS files, CAST(0 AS BIGINT) AS failed_files,
                CAST(sum(rows_total) AS BIGINT) AS rows_total,
                CAST(sum(rows_ok) AS BIGINT) AS rows_ok, CAST(sum(rows_error) AS BIGINT) AS rows_error,
                'success' AS status,
                CAST(NULL AS VARCHAR) AS error_message
         FROM files GROUP BY run_id)
"""


def file_stats_sql() -> str:
    return with_parsed("""
SELECT source_file, count(*) AS rows_total, count(*) FILTER (WHERE reject_class IS NULL) AS rows_ok,
  count(*) FILTER (WHERE reject_class IS NOT NULL) AS rows_error,
  CASE WHEN count(*) FILTER (WHERE reject_class IS NOT NULL) > 0 THEN 'partial_success' ELSE 'success' END AS status
FROM parsed GROUP BY 1""")


def run_audit_sql(run_type: str) -> str:
    return with_parsed(f"""
SELECT id, '{run_type}' AS run_type, status, error_message, files, failed_files, rows_total, rows_ok, rows_error
FROM runs""", FILE_STATS)


def status_rollup_sql() -> str:
    return with_parsed("""
SELECT split_part(file_path, '/', 1) AS date_key, count(*) AS files, CAST(0 AS BIGINT) AS failed_files,
  CAST(sum(rows_total) AS BIGINT) AS rows_total, CAST(sum(rows_ok) AS BIGINT) AS rows_ok,
  CAST(sum(rows_error) AS BIGINT) AS rows_error
FROM files GROUP BY 1""", FILE_STATS)


def ingestion_runs_sql(run_type: str, limit: int, offset: int) -> str:
    return with_parsed(f"""
SELECT id, '{run_type}' AS run_type, status, error_message, rows_total
FROM runs ORDER BY id DESC LIMIT {limit} OFFSET {offset}""", FILE_STATS)


def ingestion_files_sql(run_id: int, limit: int, offset: int) -> str:
    return with_parsed(f"""
SELECT id, run_id, file_path, rows_total, rows_ok, rows_error, status
FROM files WHERE run_id = {run_id} ORDER BY id DESC LIMIT {limit} OFFSET {offset}""", FILE_STATS)


def coverage_sql(run_type: str) -> str:
    return with_parsed(f"""
SELECT strftime(min(trade_date), '%Y-%m-%d') AS earliest_trade_date,
  strftime(max(trade_date), '%Y-%m-%d') AS latest_trade_date, count(*) AS fact_rows_total,
  (SELECT max(id) FROM runs) AS last_ingestion_run_id,
  (SELECT status FROM runs ORDER BY id DESC LIMIT 1) AS last_ingestion_status,
  '{run_type}' AS last_ingestion_run_type
FROM fact""", FILE_STATS)


def dim_upsert_sql(kind: str) -> str:
    code, name = f"{kind}_code", f"{kind}_name"
    return with_parsed(f"""
SELECT o.id, o.code AS {code}, coalesce(b.name, o.name) AS {name}, b.code IS NOT NULL AS updated
FROM old o LEFT JOIN b ON b.code = o.code
UNION ALL
SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY b.code), b.code, b.name, true
FROM b WHERE b.code NOT IN (SELECT code FROM old)""", f"""
old AS (SELECT row_number() OVER (ORDER BY code) AS id, code, name
        FROM (SELECT {code} AS code, max({name}) AS name FROM rows_
              WHERE trade_date < DATE '1995-02-01' GROUP BY 1)),
b AS (SELECT {code} AS code, max({name}) AS name FROM acc GROUP BY 1)""")


def grade_upsert_sql() -> str:
    k = "grade, class, product_name, unit_weight"
    return with_parsed(f"""
SELECT o.id, o.grade, o.class, o.product_name, o.unit_weight, b.grade IS NOT NULL AS updated
FROM old o LEFT JOIN b USING (grade, class, product_name, unit_weight)
UNION ALL
SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY {k}), {k}, true
FROM (SELECT * FROM b EXCEPT SELECT {k} FROM old)""", f"""
old AS (SELECT row_number() OVER (ORDER BY {k}) AS id, {k}
        FROM (SELECT DISTINCT {k} FROM rows_ WHERE trade_date < DATE '1995-02-01')),
b AS (SELECT DISTINCT {k} FROM acc)""")


FACT_OUT = """trade_date, weekday_ja, market_code, item_code, origin_code, grade, class, product_name,
  unit_weight, CAST(item_total_ton AS DOUBLE) AS item_total_ton, CAST(arrival_ton AS DOUBLE) AS arrival_ton,
  price_high_yen, price_mid_yen, price_low_yen, trend_label, source_file, source_row_no"""


def fact_upsert_sql() -> str:
    return with_parsed(f"""
SELECT {FACT_OUT}, false AS updated FROM fact f
WHERE NOT EXISTS (SELECT 1 FROM inc i WHERE i.source_file = f.source_file AND i.source_row_no = f.source_row_no)
UNION ALL
SELECT {FACT_OUT}, true AS updated FROM inc""", """
inc AS (SELECT * FROM acc)""")


def surrogate_sql() -> str:
    return with_fact("""
SELECT f.source_file, f.source_row_no, m.id AS market_id, i.id AS item_id, o.id AS origin_id, gd.id AS grade_id
FROM fact f JOIN dim_market m USING (market_code) JOIN dim_item i USING (item_code)
JOIN dim_origin o USING (origin_code) JOIN dim_grade gd USING (grade, class, product_name, unit_weight)""")
