"""Registered extraction (E1-E4, E6, E8, E9), quality (Q1, Q2) and scalar
function (S1-S10, S13) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seika.functions import dates as D
from seika.functions import parse as PA
from seika.functions import text as TX
from seika.operators import quality as Q
from seika.plans import oracle as O
from seika.plans.registry import register
from seika.sources import encoding as EN
from seika.sources import portal as P
from seika.sources import testdata as TD

HREF = r'href="(/[^"]*)"'
LI_BLOCK = r"(?s)<li>(.*?)</li>"
MARKET_FILTER = "The"

# RE2 has no Unicode \s; this class is Java's (?U)\s spelled out.
_WS = r"[\t\n\x{0b}\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _clean_sql(x: str) -> str:
    inner = f"regexp_replace({x}, '{_WS}+', ' ', 'g')"
    return f"regexp_replace({inner}, '^{_WS}+|{_WS}+$', '', 'g')"


_MATCHES = f"regexp_extract_all(html, '{HREF}', 1)"
_BLOCKS = f"""
b AS (SELECT page_id, unnest(bl) AS body, generate_subscripts(bl, 1) AS pos
      FROM (SELECT page_id, regexp_extract_all(html, '{LI_BLOCK}', 1) AS bl FROM pages)),
r AS (SELECT page_id, CAST(pos AS VARCHAR) AS row_no,
             {_clean_sql("regexp_replace(body, '<[^>]*>', ' ', 'g')")} AS market,
             regexp_extract_all(body, '{HREF}', 1) AS ids FROM b),
rows_ AS (SELECT * FROM r WHERE market <> '' AND len(ids) > 0)"""

ORACLE = {
    "portal_dates": f"""
WITH m AS (SELECT page_id, unnest(ms) AS value, generate_subscripts(ms, 1) AS pos
           FROM (SELECT page_id, {_MATCHES} AS ms FROM pages)),
f AS (SELECT page_id, value, min(pos) AS p FROM m GROUP BY 1, 2)
SELECT page_id, true AS has_match, CAST(row_number() OVER (PARTITION BY page_id ORDER BY p) AS INTEGER) AS ord,
       value FROM f
UNION ALL
SELECT page_id, false, NULL, NULL FROM pages WHERE len({_MATCHES}) = 0""",
    "portal_market_rows": f"WITH {_BLOCKS.strip()}\n"
                          f"SELECT page_id, row_no, market, CAST(len(ids) AS INTEGER) AS id_count FROM rows_",
    "market_contains_filter": f"WITH {_BLOCKS.strip()}\n"
                              f"SELECT page_id, row_no, market FROM rows_ "
                              f"WHERE contains(lower(market), '{MARKET_FILTER.lower()}')",
    "csv_id_category": f"""WITH {_BLOCKS.strip()},
e AS (SELECT page_id, row_no, unnest(ids) AS csv_id, generate_subscripts(ids, 1) - 1 AS id_pos FROM rows_)
SELECT page_id, row_no, CAST(id_pos AS INTEGER) AS id_pos, csv_id,
  CASE WHEN id_pos = 0 THEN 'vegetable' WHEN id_pos = 1 THEN 'fruit' ELSE 'col' || (id_pos + 1) END AS category
FROM e""",
    "clean_text": f"SELECT page_id, {_clean_sql('html')} AS text FROM pages",
    "safe_file_name": """
WITH s AS (SELECT page_id,
             'attachment; filename="' || regexp_extract(url, '[^/]+$') || '"' AS disp,
             CAST(page_id AS VARCHAR) || '_' || regexp_extract(url, '//([^/:?#]+)', 1) || '_vegetable' AS fb
           FROM pages),
n AS (SELECT page_id, fb, trim(split_part(disp, '"', 2)) AS m FROM s),
d AS (SELECT page_id, fb, CASE WHEN m <> '' THEN url_decode(regexp_replace(lower(m), '^utf-8''''', ''))
                               ELSE fb || '.csv' END AS name FROM n),
e AS (SELECT page_id, fb, name, regexp_extract(name, '(\\.[^./]*)$', 1) AS ext FROM d)
SELECT page_id,
  coalesce(nullif(translate(trim(fb || '_' || left(name, length(name) - length(ext))), '/\\:*?"<>| ', '__________'), ''),
           'unknown') || CASE WHEN ext = '' THEN '.csv' ELSE ext END AS file_name
FROM e""",
    "sjis_to_utf8": O.with_fact("""
SELECT DISTINCT 'weekday_ja' AS source, weekday_ja AS value, weekday_ja AS decoded FROM rows_
UNION SELECT DISTINCT 'origin_name', origin_name, origin_name FROM rows_
UNION SELECT DISTINCT 'trend_label', trend_label, trend_label FROM rows_ WHERE trend_label IS NOT NULL"""),
}


def _pages(spark, sf_dir):
    return TD.read_table(spark, sf_dir, "pages")


def _li_rows(spark, sf_dir):
    return P.market_rows(_pages(spark, sf_dir), block=LI_BLOCK, no_group=None, market_group=1,
                         body_group=1, id_pattern=HREF, strip_tags=True)


@register("portal_dates", ORACLE["portal_dates"])
def portal_dates(spark, sf_dir):
    """Distinct link targets of each page in first-seen order (the date
    pattern's form, with the page pattern as a parameter)."""
    return P.page_dates(_pages(spark, sf_dir), pattern=HREF)


@register("portal_market_rows", ORACLE["portal_market_rows"])
def portal_market_rows(spark, sf_dir):
    """Table blocks of each page with a label and at least one id."""
    return _li_rows(spark, sf_dir).select("page_id", "row_no", "market",
                                          F.size("csv_ids").alias("id_count"))


@register("market_contains_filter", ORACLE["market_contains_filter"])
def market_contains_filter(spark, sf_dir):
    """Blocks whose label contains 'the' in any case."""
    return P.filter_markets(_li_rows(spark, sf_dir), f"  {MARKET_FILTER} ").select("page_id", "row_no", "market")


@register("csv_id_category", ORACLE["csv_id_category"])
def csv_id_category(spark, sf_dir):
    """Every id of every block with its positional category."""
    return P.csv_id_categories(_li_rows(spark, sf_dir)).select("page_id", "row_no", "id_pos", "csv_id", "category")


@register("clean_text", ORACLE["clean_text"])
def clean_text(spark, sf_dir):
    """Whole pages with white-space runs collapsed and trimmed."""
    return _pages(spark, sf_dir).select("page_id", TX.clean_text("html").alias("text"))


@register("safe_file_name", ORACLE["safe_file_name"])
def safe_file_name(spark, sf_dir):
    """Download file name from a Content-Disposition built from each URL."""
    pg = _pages(spark, sf_dir)
    disp = F.concat(F.lit('attachment; filename="'), F.regexp_extract("url", r"[^/]+$", 0), F.lit('"'))
    fb = F.concat(F.col("page_id").cast("string"), F.lit("_"),
                  F.regexp_extract("url", r"//([^/:?#]+)", 1), F.lit("_vegetable"))
    return pg.select("page_id", P.download_file_name(disp, fb).alias("file_name"))


@register("sjis_to_utf8", ORACLE["sjis_to_utf8"])
def sjis_to_utf8(spark, sf_dir):
    """Japanese texts of the price rows encoded to windows-31j bytes and
    decoded back."""
    rows = TD.price_rows(spark, sf_dir, with_row_no=False)
    vals = (rows.select(F.lit("weekday_ja").alias("source"), F.col("weekday_ja").alias("value"))
            .unionByName(rows.select(F.lit("origin_name").alias("source"), F.col("origin_name").alias("value")))
            .unionByName(rows.where(F.col("trend_label").isNotNull())
                         .select(F.lit("trend_label").alias("source"), F.col("trend_label").alias("value")))
            .distinct())
    return vals.select("source", "value", EN.sjis_to_utf8(EN.utf8_to_sjis("value")).alias("decoded"))


# ------------------------------------------------------------------ quality

@register("orphan_check", O.with_fact("""
SELECT 'market' AS dimension, market_code AS key, count(*) AS rows FROM fact
  WHERE market_code NOT IN (SELECT market_code FROM rows_ WHERE trade_date < DATE '1995-02-01') GROUP BY 2
UNION ALL
SELECT 'item', item_code, count(*) FROM fact
  WHERE item_code NOT IN (SELECT item_code FROM rows_ WHERE trade_date < DATE '1995-02-01') GROUP BY 2
UNION ALL
SELECT 'origin', origin_code, count(*) FROM fact
  WHERE origin_code NOT IN (SELECT origin_code FROM rows_ WHERE trade_date < DATE '1995-02-01') GROUP BY 2
UNION ALL
SELECT 'grade', concat_ws('|', grade, class, product_name, unit_weight), count(*) FROM fact f
  WHERE NOT EXISTS (SELECT 1 FROM rows_ r WHERE r.trade_date < DATE '1995-02-01' AND r.grade = f.grade
                    AND r.class = f.class AND r.product_name = f.product_name AND r.unit_weight = f.unit_weight)
  GROUP BY 2"""))
def orphan_check(spark, sf_dir):
    """Q1: fact keys without a dimension row, checked against the dimensions
    of January 1995 (so later codes are orphans)."""
    from seika.plans.ingest_queries import _jan_1995_star
    return Q.orphan_check(_jan_1995_star(spark, sf_dir))


@register("duplicate_key_check", O.with_parsed("""
SELECT source_file, source_row_no, count(*) AS copies
FROM (SELECT source_file, source_row_no FROM fact
      UNION ALL SELECT source_file, source_row_no FROM acc)
GROUP BY 1, 2 HAVING count(*) > 1"""))
def duplicate_key_check(spark, sf_dir):
    """Q2: duplicated (source_file, source_row_no) after appending the re-sent
    rows without the upsert."""
    from seika.plans.ingest_queries import resent_batch
    rows = TD.price_rows(spark, sf_dir)  # the fact and the re-sent files are of the same rows
    fact = TD.star(spark, sf_dir, dims=(), rows=rows).fact.select("source_file", "source_row_no")
    return Q.duplicate_keys(fact.unionByName(resent_batch(spark, sf_dir, rows).select("source_file", "source_row_no")),
                            ["source_file", "source_row_no"])


# ------------------------------------------------------------------ scalar functions

def _raw(spark, sf_dir):
    return TD.raw_rows(spark, sf_dir)


_RAW_CODE_SQL = O.with_parsed("""
SELECT DISTINCT CASE WHEN g = 1 THEN '' WHEN g = 9 THEN '　 ' || substr(market_code, 1, 2) || ' 　'
                     || substr(market_code, 3) || ' ' ELSE market_code END AS raw,
  CASE WHEN g = 1 THEN '' WHEN g = 9 THEN substr(market_code, 1, 2) || ' 　' || substr(market_code, 3)
       ELSE market_code END AS trimmed,
  CASE WHEN g = 1 THEN '' ELSE market_code END AS normalized
FROM r""")


@register("trim_unicode", _RAW_CODE_SQL)
def trim_unicode(spark, sf_dir):
    """Raw market codes, Unicode-trimmed and normalised."""
    raw = _raw(spark, sf_dir).select(F.col("市場コード").alias("raw")).distinct()
    return raw.select("raw", TX.trim_unicode("raw").alias("trimmed"), TX.normalize_code("raw").alias("normalized"))


@register("normalize_code_name", O.with_parsed("""
SELECT DISTINCT CASE WHEN g = 4 THEN '　' ELSE item_name END AS raw,
  CASE WHEN g = 4 THEN '' ELSE replace(replace(item_name, ' ', ''), '　', '') END AS normalized FROM r"""))
def normalize_code_name(spark, sf_dir):
    """Item names with inner spaces and U+3000 removed."""
    raw = _raw(spark, sf_dir).select(F.col("品目名").alias("raw")).distinct()
    return raw.select("raw", TX.normalize_code("raw").alias("normalized"))


@register("parse_required_int", O.with_parsed("""
SELECT DISTINCT CASE WHEN g = 0 THEN '13' ELSE CAST(month(trade_date) AS VARCHAR) END AS text,
  CASE WHEN g = 0 THEN 13 ELSE month(trade_date) END AS value, true AS ok FROM r"""))
def parse_required_int(spark, sf_dir):
    """S3: the month field parsed."""
    raw = _raw(spark, sf_dir).select(F.col("月").alias("text")).distinct()
    v, ok = PA.parse_required_int(F.col("text"))
    return raw.select("text", v.alias("value"), ok.alias("ok"))


@register("parse_nullable_float", O.with_parsed("""
SELECT DISTINCT CASE WHEN g = 3 THEN '-5' ELSE coalesce(CAST(arrival_ton AS VARCHAR), '') END AS text,
  CASE WHEN g = 3 THEN -5.0 ELSE CAST(arrival_ton AS DOUBLE) END AS value, true AS ok FROM r"""))
def parse_nullable_float(spark, sf_dir):
    """The arrival field parsed ('' is NULL)."""
    raw = _raw(spark, sf_dir).select(F.col("入荷量").alias("text")).distinct()
    v, ok = PA.parse_nullable_float(F.col("text"))
    return raw.select("text", v.alias("value"), ok.alias("ok"))


@register("parse_nullable_int", O.with_parsed("""
SELECT DISTINCT CASE WHEN g = 2 THEN 'abc' WHEN price_mid_yen IS NULL THEN '-'
                     WHEN g = 6 THEN CAST(price_mid_yen AS VARCHAR) || '.9'
                     ELSE CAST(price_mid_yen AS VARCHAR) END AS text,
  CASE WHEN g = 2 THEN NULL ELSE CAST(price_mid_yen AS BIGINT) END AS value, g <> 2 AS ok FROM r
UNION
SELECT DISTINCT CASE WHEN g = 7 THEN '-0.4' WHEN price_mid_yen IS NULL THEN '-'
                     ELSE CAST(price_mid_yen - 10 AS VARCHAR) END,
  CASE WHEN g = 7 THEN 0 ELSE CAST(price_mid_yen - 10 AS BIGINT) END, true FROM r"""))
def parse_nullable_int(spark, sf_dir):
    """The mid and low price fields parsed (integers, '.9' truncated,
    '-0.4' to 0)."""
    raw = _raw(spark, sf_dir)
    texts = raw.select(F.col("中値").alias("text")).unionByName(raw.select(F.col("安値").alias("text"))).distinct()
    v, ok = PA.parse_nullable_int(F.col("text"))
    return texts.select("text", v.alias("value"), ok.alias("ok"))


@register("parse_trade_date", O.with_parsed("""
SELECT DISTINCT CAST(year(trade_date) AS VARCHAR) AS y, CASE WHEN g = 0 THEN '13' ELSE CAST(month(trade_date) AS VARCHAR) END AS m,
  CAST(day(trade_date) AS VARCHAR) AS d, CASE WHEN g = 0 THEN NULL ELSE trade_date END AS trade_date FROM r"""))
def parse_trade_date(spark, sf_dir):
    """(year, month, day) texts to a calendar date; month 13 gives NULL."""
    raw = _raw(spark, sf_dir).select(F.col("年").alias("y"), F.col("月").alias("m"), F.col("日").alias("d")).distinct()
    y, _ = PA.parse_required_int(F.col("y"))
    m, _ = PA.parse_required_int(F.col("m"))
    d, _ = PA.parse_required_int(F.col("d"))
    return raw.select("y", "m", "d", PA.parse_trade_date(y, m, d).alias("trade_date"))


@register("round2", O.with_fact("""
SELECT DISTINCT price_mid_yen, round(CAST(price_mid_yen AS DOUBLE) / 8.0 * 100) / 100 AS value
FROM fact WHERE price_mid_yen IS NOT NULL"""))
def round2(spark, sf_dir):
    """Mid price / 8 rounded half away from zero to 2 places."""
    f = TD.price_rows(spark, sf_dir, with_row_no=False).where(F.col("price_mid_yen").isNotNull())
    return f.select("price_mid_yen", D.round2(F.col("price_mid_yen") / F.lit(8.0)).alias("value")).distinct()


@register("period_label", O.with_fact("""
SELECT DISTINCT trade_date, strftime(trade_date, '%Y-%m-%d') AS day,
  strftime(date_trunc('week', trade_date), '%Y-%m-%d') AS week, strftime(trade_date, '%Y-%m') AS month FROM rows_"""))
def period_label(spark, sf_dir):
    """Day, Monday-week and month labels of every trade date."""
    d = TD.price_rows(spark, sf_dir, with_row_no=False).select("trade_date").distinct()
    return d.select("trade_date", *[D.period_label("trade_date", g).alias(g) for g in ("day", "week", "month")])


@register("calendar_shift", O.with_fact("""
SELECT DISTINCT trade_date,
  CAST(date_trunc('month', trade_date) - INTERVAL 1 MONTH + (day(trade_date) - 1) * INTERVAL 1 DAY AS DATE) AS minus_1m,
  CAST(date_trunc('month', trade_date) - INTERVAL 6 MONTH + (day(trade_date) - 1) * INTERVAL 1 DAY AS DATE) AS minus_6m,
  CAST(date_trunc('month', trade_date) - INTERVAL 12 MONTH + (day(trade_date) - 1) * INTERVAL 1 DAY AS DATE) AS minus_1y,
  trade_date - 31 AS recent_from
FROM rows_"""))
def calendar_shift(spark, sf_dir):
    """S9 + S13: Go ``AddDate`` shifts (day overflow rolls into the next month)
    and the 31-day default window start, for every trade date."""
    d = TD.price_rows(spark, sf_dir, with_row_no=False).select("trade_date").distinct()
    return d.select("trade_date", D.calendar_shift("trade_date", months=-1).alias("minus_1m"),
                    D.calendar_shift("trade_date", months=-6).alias("minus_6m"),
                    D.calendar_shift("trade_date", years=-1).alias("minus_1y"),
                    F.date_sub("trade_date", 31).alias("recent_from"))


@register("like_search", O.with_fact("""
SELECT id, item_code, item_name FROM dim_item WHERE item_code LIKE '%sm_ll%' OR item_name LIKE '%sm_ll%'"""))
def like_search(spark, sf_dir):
    """LIKE search with a '_' wildcard inside the query text."""
    st = TD.star(spark, sf_dir, with_row_no=False)
    return st.dim_item.where(TX.like_search("item_code", "item_name", "sm_ll")).select("id", "item_code", "item_name")

