"""Portal page extraction (E1-E5, E8, E9) as column expressions over a page table.

Every function works on a whole page per row with Spark's regex functions
(``regexp_extract_all``); no per-page Python runs. Patterns are parameters:
the reference's portal patterns are the defaults.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seika.functions.text import clean_text, safe_file_name, trim_unicode

# The portal's markup patterns (Java regex syntax).
DATE_INPUT = r'name="s006\.dataDate"\s+value="(\d{8})"'
DATE_HEADER = r'(?s)<h3 class="h3_title"[^>]*>\s*([^<]+?)\s*</h3>'
ROW_BLOCK = (r'(?s)<tr>\s*<td class="kubun_td3_norb_left">\s*([^<]+?)\s*</td>\s*'
             r'<td class="kubun_td3_norb_left">\s*([^<]+?)\s*</td>(.*?)</tr>')
CSV_ID = r"chohyoSubmit\('form003','([^']+)'\)"
# Category names of a row's CSV ids by position.
CATEGORIES = ["vegetable", "fruit"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def distinct_matches(html, pattern: str = DATE_INPUT, group: int = 1) -> Column:
    """All matches of ``group``, de-duplicated, first-seen order kept
    (``array_distinct`` keeps the first occurrence)."""
    return F.array_distinct(F.regexp_extract_all(_c(html), F.lit(pattern), group))


def page_dates(pages: DataFrame, html: str = "html", key: str = "page_id",
               pattern: str = DATE_INPUT) -> DataFrame:
    """E1 long form: (key, ord, value); ``has_match`` false marks the pages the
    reference rejects ("could not parse available dates")."""
    d = pages.select(key, distinct_matches(html, pattern).alias("_v"))
    return (d.select(key, (F.size("_v") > 0).alias("has_match"),
                     F.posexplode_outer("_v").alias("ord", "value"))
             .withColumn("ord", F.col("ord") + 1))


def date_label(html, fallback) -> Column:
    """Header label of a result page (E2): the ``h3`` title, else the date."""
    m = F.regexp_extract(_c(html), DATE_HEADER, 1)
    return F.when(m != "", clean_text(m)).otherwise(_c(fallback))


def market_rows(pages: DataFrame, html: str = "html", key: str = "page_id",
                block: str = ROW_BLOCK, no_group: int | None = 1, market_group: int = 2,
                body_group: int = 3, id_pattern: str = CSV_ID, strip_tags: bool = False) -> DataFrame:
    """One row per table block: row no, market name, CSV ids; blocks with
    a blank market or no id are skipped. ``no_group=None`` numbers blocks by
    position; ``strip_tags`` removes markup from the market text.

    Output (key, row_no, market, csv_ids, _pos): a page without any row left
    is one the reference rejects ("no csv rows parsed"); ``pages_without_rows``
    lists those.
    """
    h = F.col(html)
    groups = {"body": body_group, "market": market_group}
    if no_group is not None:
        groups["no"] = no_group
    arrays = {k: F.regexp_extract_all(h, F.lit(block), g) for k, g in groups.items()}
    z = pages.select(key, F.arrays_zip(*[a.alias(k) for k, a in arrays.items()]).alias("_z"))
    ex = z.select(key, F.posexplode("_z").alias("_pos", "_b"))
    market_txt = F.col("_b.market")
    if strip_tags:
        market_txt = F.regexp_replace(market_txt, "<[^>]*>", " ")
    rows = ex.select(
        key,
        (clean_text(F.col("_b.no")) if no_group is not None
         else (F.col("_pos") + 1).cast("string")).alias("row_no"),
        clean_text(market_txt).alias("market"),
        F.regexp_extract_all(F.col("_b.body"), F.lit(id_pattern), 1).alias("csv_ids"),
        F.col("_pos"))
    rows = rows.where((F.col("market") != "") & (F.size("csv_ids") > 0))
    return rows


def pages_without_rows(pages: DataFrame, rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages with no usable table row (the reference's error case)."""
    return pages.select(key).join(rows.select(key), key, "left_anti")


def filter_markets(rows: DataFrame, market_filter: str | None, col: str = "market") -> DataFrame:
    """Case-insensitive substring on the trimmed filter; blank keeps all
    (a plain ``contains``, never ``LIKE``, so % and _ are literal)."""
    f = (market_filter or "").strip()
    if not f:
        return rows
    return rows.where(F.contains(F.lower(F.col(col)), F.lit(f.lower())))


def csv_id_categories(rows: DataFrame, ids: str = "csv_ids") -> DataFrame:
    """One row per CSV id with its category: ``vegetable``, ``fruit``,
    then ``col<i+1>`` by position."""
    ex = rows.select("*", F.posexplode(ids).alias("id_pos", "csv_id")).drop(ids)
    cat = F.concat(F.lit("col"), (F.col("id_pos") + 1).cast("string"))
    for i in range(len(CATEGORIES) - 1, -1, -1):
        cat = F.when(F.col("id_pos") == i, F.lit(CATEGORIES[i])).otherwise(cat)
    return ex.withColumn("category", cat)


def resolve_dates(date: str | None = None, from_: str | None = None,
                  to: str | None = None) -> tuple[str, _dt.date | None, _dt.date | None] | None:
    """E5 parameters: a single ``date`` wins and is not validated (returned as
    ``("single", None, None)`` with the text kept by the caller); otherwise both
    bounds (YYYYMMDD) are parsed and reversed bounds rejected. None means the
    dates come from the portal page (E1)."""
    if date:
        return ("single", None, None)
    if from_ and to:
        try:
            f = _dt.datetime.strptime(from_, "%Y%m%d").date()
            t = _dt.datetime.strptime(to, "%Y%m%d").date()
        except ValueError as e:
            raise ValueError(f"invalid -from/-to: {e}") from None
        if f > t:
            raise ValueError("the range ends before it begins")
        return ("range", f, t)
    return None


def expand_date_range(df: DataFrame, from_col: str, to_col: str, out: str = "date_key") -> DataFrame:
    """E5: every day of [from, to] inclusive as ``YYYYMMDD`` (rows with
    reversed bounds give none; validate parameters with ``resolve_dates``)."""
    seq = F.sequence(F.col(from_col), F.col(to_col), F.expr("INTERVAL 1 DAY"))
    return df.select("*", F.explode(F.when(F.col(from_col) <= F.col(to_col), seq)).alias("_d")) \
             .withColumn(out, F.date_format("_d", "yyyyMMdd")).drop("_d")


def download_file_name(disposition, fallback_base) -> Column:
    """E9 ``resolveFilename``: the name in Content-Disposition (lower-cased,
    ``utf-8''`` prefix dropped, URL-decoded when valid), else
    ``<fallback>.csv``; result ``sanitize(<fallback>_<base>) + <ext>`` with
    ``.csv`` when the name has no extension."""
    # RFC 6266: the extended parameter (charset'language'value) counts before the plain one
    header = _c(disposition)
    extended = F.regexp_extract(header, r"(?i)\bfilename\*\s*=\s*[^';]*'[^';]*'([^;\s]+)", 1)
    quoted = F.regexp_extract(header, r'(?i)\bfilename\s*=\s*"([^"]*)"', 1)
    token = F.regexp_extract(header, r'(?i)\bfilename\s*=\s*([^\s";]+)', 1)
    m = trim_unicode(F.coalesce(F.nullif(extended, F.lit("")), F.nullif(quoted, F.lit("")), token))
    low = F.regexp_replace(F.lower(m), r"^utf-8''", "")
    decoded = F.coalesce(F.try_url_decode(low), low)
    name = F.when(m != "", decoded).otherwise(F.concat(_c(fallback_base), F.lit(".csv")))
    name = F.when(name == "", F.concat(_c(fallback_base), F.lit(".csv"))).otherwise(name)
    ext = F.regexp_extract(name, r"(\.[^./]*)$", 1)
    base = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return F.concat(safe_file_name(F.concat(_c(fallback_base), F.lit("_"), base)),
                    F.when(ext == "", F.lit(".csv")).otherwise(ext))
