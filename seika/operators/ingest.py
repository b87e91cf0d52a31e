"""CSV rows to the star schema: parse, quarantine, stats, upserts, audit.

Every step is a DataFrame transformation; the only driver-side values are the
run's parameters and a handful of per-batch scalars (next ids).

Row flow of one batch:
  raw text rows --parse_rows--> typed rows + reject_reason + load_error
    --rejects--> quarantine table (kept, with reasons; the reference only counts)
    --accepted, file not failed--> group poison check (I11)
    --loadable--> dimension upserts (I9, I10) and fact merge (I13)
  per file: rows_total / rows_ok / rows_error / status (I8) --> run audit (I14)
"""

from __future__ import annotations

import datetime as _dt
import uuid

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seika.functions.parse import (checked_float, float_candidate, int32_overflow, int_candidate,
                                   nullable_number_text, parse_required_int, parse_trade_date,
                                   to_decimal_14_3)
from seika.functions.text import blank_to_default, normalize_code, pack_texts, trim_unicode, unpack_texts
from seika.operators.numbering import number_rows
from seika.schemas import (CODE_DIMS, FACT_COLUMNS, Star, FILE_FAILED, FILE_PARTIAL, FILE_SUCCESS,
                           GRADE_KEY, MAX_LEN, REQUIRED_HEADERS, RUN_FAILED, RUN_PARTIAL,
                           RUN_SUCCESS, UNKNOWN_ORIGIN_CODE, UNKNOWN_ORIGIN_NAME)
from seika.session import stage

# Reject reason classes (first failing rule wins, in this order).
REASON_DATE, REASON_CODE, REASON_NUMBER, REASON_NEGATIVE, REASON_NAME = (
    "date", "code", "number", "negative", "name")

_NUMERIC_FIELDS = [("品目計", "float"), ("入荷量", "float"), ("高値", "int"), ("中値", "int"), ("安値", "int")]


def _field(h: str) -> Column:
    # a short row gives NULL for missing fields; the reference reads them as ''
    return F.coalesce(F.col(h), F.lit(""))


_CODES = {"market_code": "市場コード", "item_code": "品目コード", "origin_code": "産地コード",
          "market_name": "市場名", "item_name": "品目名", "origin_name": "産地名"}
_TEXTS = {"weekday_ja": "曜日", "grade": "等級", "class": "階級", "product_name": "品名",
          "unit_weight": "量目", "trend_label": "動向"}


def _cut(df: DataFrame, *also: Column) -> DataFrame:
    """The same rows behind a count of them. Spark merges no expressions and moves no filter across observed metrics,
    so what lies below is computed once, in generated code of its own."""
    return df.observe(f"parsed-{uuid.uuid4().hex[:12]}", F.count(F.lit(1)).alias("rows"), *also)


def parse_rows(raw: DataFrame) -> DataFrame:
    """I5 (with S1-S6, I7): typed price rows with ``reject_reason``,
    ``reject_class`` (NULL when accepted) and ``load_error`` (values a stored
    column cannot hold: over-length text, INT or NUMERIC(14,3) overflow).

    ``raw`` has the 20 header columns as text plus any pass-through columns
    (source_file, source_row_no, ...), which are kept.

    Three projections: trim every field once, parse once, then decide; each
    parsed value is a column of its own, so the rule chain refers to it
    instead of repeating its expression (keeps whole-stage codegen compact).
    Cuts keep the three apart: merged, they outgrow one generated method.
    """
    keep = [c for c in raw.columns if c not in REQUIRED_HEADERS]
    raw = _cut(raw)
    # 1. text: trimmed fields, normalised codes and names, number text
    t = raw.select(
        *keep,
        *[trim_unicode(_field(h)).alias(f"_t_{h}") for h in ("年", "月", "日")],
        *[normalize_code(_field(h)).alias(k) for k, h in _CODES.items()],
        *[trim_unicode(_field(h)).alias(k) for k, h in _TEXTS.items()],
        *[nullable_number_text(_field(h)).alias(f"_n_{h}") for h, _ in _NUMERIC_FIELDS])
    t = _cut(t)
    # 2. values and their parse flags
    ymd = {}
    for h, k in (("年", "y"), ("月", "m"), ("日", "d")):
        v, ok = parse_required_int(F.col(f"_t_{h}"), trim=False)
        ymd[k], ymd[f"{k}_ok"] = v, ok
    # 2a. number candidates once per field (each feeds value and flag below)
    cand = {}
    for i, (h, kind) in enumerate(_NUMERIC_FIELDS):
        n = F.col(f"_n_{h}")
        cand[f"_c{i}"] = float_candidate(n) if kind == "float" else int_candidate(n)
    t = t.select("*", *[c.alias(k) for k, c in cand.items()])
    nums = {}
    for i, (h, kind) in enumerate(_NUMERIC_FIELDS):
        n, c = F.col(f"_n_{h}"), F.col(f"_c{i}")
        v = checked_float(c) if kind == "float" else c
        nums[f"_v{i}"], nums[f"_ok{i}"] = v, n.isNull() | v.isNotNull()
    p = t.select(*keep, *_CODES, *_TEXTS,
                 *[c.alias(f"_{k}") for k, c in ymd.items()],
                 *[c.alias(k) for k, c in nums.items()])
    p = _cut(p.withColumn("trade_date", parse_trade_date(F.col("_y"), F.col("_m"), F.col("_d"))))
    # 3. first failing rule, typed values, load errors
    reason = (F.when(~F.col("_y_ok"), F.lit("invalid 年")).when(~F.col("_m_ok"), F.lit("invalid 月"))
               .when(~F.col("_d_ok"), F.lit("invalid 日"))
               .when(F.col("trade_date").isNull(), F.lit("invalid date"))
               .when((F.col("market_code") == "") | (F.col("item_code") == ""),
                     F.lit("missing required codes")))
    for i, (h, _) in enumerate(_NUMERIC_FIELDS):
        reason = reason.when(~F.col(f"_ok{i}"), F.lit(f"invalid {h}"))
    for i, (h, _) in enumerate(_NUMERIC_FIELDS):
        reason = reason.when(F.col(f"_v{i}") < 0, F.lit(f"invalid {h}: negative"))
    reason = reason.when((F.col("market_name") == "") | (F.col("item_name") == ""),
                         F.lit("missing required names"))
    p = p.withColumn("reject_reason", reason)
    r = F.col("reject_reason")
    cls = (F.when(r.isNull(), F.lit(None))
            .when(r.startswith("invalid 年") | r.startswith("invalid 月") | r.startswith("invalid 日")
                  | (r == "invalid date"), F.lit(REASON_DATE))
            .when(r == "missing required codes", F.lit(REASON_CODE))
            .when(r.endswith(": negative"), F.lit(REASON_NEGATIVE))
            .when(r == "missing required names", F.lit(REASON_NAME))
            .otherwise(F.lit(REASON_NUMBER)))
    total_v, arrival_v, high_v, mid_v, low_v = (F.col(f"_v{i}") for i in range(5))
    total_dec, arrival_dec = to_decimal_14_3(total_v), to_decimal_14_3(arrival_v)
    values = {
        "trade_date": F.col("trade_date"),
        "weekday_ja": F.col("weekday_ja"),
        "market_code": F.col("market_code"), "market_name": F.col("market_name"),
        "item_code": F.col("item_code"), "item_name": F.col("item_name"),
        "origin_code": blank_to_default(F.col("origin_code"), UNKNOWN_ORIGIN_CODE),
        "origin_name": blank_to_default(F.col("origin_name"), UNKNOWN_ORIGIN_NAME),
        "grade": F.col("grade"), "class": F.col("class"),
        "product_name": F.col("product_name"), "unit_weight": F.col("unit_weight"),
        "item_total_ton": total_dec, "arrival_ton": arrival_dec,
        "price_high_yen": F.when(~int32_overflow(high_v), high_v.cast("int")),
        "price_mid_yen": F.when(~int32_overflow(mid_v), mid_v.cast("int")),
        "price_low_yen": F.when(~int32_overflow(low_v), low_v.cast("int")),
        "trend_label": F.nullif(F.col("trend_label"), F.lit("")),
    }
    load_error = (F.when(total_v.isNotNull() & total_dec.isNull(), F.lit("numeric field overflow: 品目計"))
                   .when(arrival_v.isNotNull() & arrival_dec.isNull(), F.lit("numeric field overflow: 入荷量"))
                   .when(int32_overflow(high_v) | int32_overflow(mid_v) | int32_overflow(low_v),
                         F.lit("integer out of range")))
    for col, n in MAX_LEN.items():
        if col in values or col in keep:  # source_file is passed through
            load_error = load_error.when(F.char_length(F.col(col)) > n, F.lit(f"value too long for {col}"))
    out = p.select(*keep, *[v.alias(k) for k, v in values.items()],
                   r.alias("reject_reason"), cls.alias("reject_class"),
                   F.when(r.isNull(), load_error).alias("load_error"))
    # A filter on the reason stays above the cut. Below, each of its columns would be
    # replaced by the expression behind it, and every field parsed a dozen times.
    return _cut(out, F.count("reject_reason").alias("rejected"))


def accepted(parsed: DataFrame) -> DataFrame:
    """Rows that passed every rule."""
    return parsed.where(F.col("reject_reason").isNull()).drop("reject_reason", "reject_class")


def rejected(parsed: DataFrame) -> DataFrame:
    """The quarantine table, one row per rejected record with its reason."""
    return parsed.where(F.col("reject_reason").isNotNull())


def file_stats(parsed: DataFrame, failed_files: DataFrame | None = None,
               file_col: str = "source_file") -> DataFrame:
    """I8: rows_total / rows_ok / rows_error per file, status ``failed``
    (file-level error), ``partial_success`` (some rows rejected) or ``success``.

    ``failed_files`` (file_col, error) lists files failed before or during the
    load (bad header, poisoned group); their row counts stay as parsed.
    """
    stats = parsed.groupBy(file_col).agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count_if(F.col("reject_reason").isNull()).alias("rows_ok"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("rows_error"))
    if failed_files is not None:
        stats = stats.join(failed_files.select(file_col, "error"), file_col, "full_outer")
        stats = stats.na.fill(0, ["rows_total", "rows_ok", "rows_error"])
    else:
        stats = stats.withColumn("error", F.lit(None).cast("string"))
    status = (F.when(F.col("error").isNotNull(), F.lit(FILE_FAILED))
               .when(F.col("rows_error") > 0, F.lit(FILE_PARTIAL))
               .otherwise(F.lit(FILE_SUCCESS)))
    return stats.withColumn("status", status)


def group_poison(parsed: DataFrame, group_col: str = "date_key", file_col: str = "source_file") -> DataFrame:
    """Per date group, the first load error of any accepted row (NULL if
    none). A group with an error loads nothing and all its files fail.
    One row per group: a small table."""
    bad = parsed.where(F.col("reject_reason").isNull() & F.col("load_error").isNotNull())
    return bad.groupBy(group_col).agg(
        F.min_by(F.concat_ws(": ", F.col(file_col), F.col("load_error")),
                 F.struct(F.col(file_col), F.col("source_row_no"))).alias("group_error"))


def loadable(parsed: DataFrame, failed_files: DataFrame | None, poison: DataFrame | None,
             group_col: str = "date_key", file_col: str = "source_file") -> DataFrame:
    """I15 + I11: accepted rows of files that did not fail, in groups without a
    load error. Both exclusion tables have one row per file / group."""
    ok = accepted(parsed)
    if failed_files is not None:
        ok = ok.join(failed_files.select(file_col), file_col, "left_anti")
    if poison is not None:
        ok = ok.join(poison.select(group_col), group_col, "left_anti")
    return ok.drop("load_error")


# ------------------------------------------------------------ dimensions

def batch_names(rows: DataFrame, code: str, name: str,
                order_cols=("date_key", "source_file", "source_row_no")) -> DataFrame:
    """Code -> name of a batch; the newest (date group, file, row) wins.

    The newest row of each name in a file comes first: a maximum of numbers is a
    hash aggregation, while one of structs sorts its rows."""
    present = [c for c in order_cols if c in rows.columns]
    newest = rows.groupBy(code, name, *present[:-1]).agg(F.max(present[-1]).alias(present[-1]))
    return newest.groupBy(code).agg(F.max_by(F.col(name), F.struct(*present)).alias(name))


def upsert_dimension(existing: DataFrame, batch: DataFrame, key_cols: list[str],
                     value_cols: list[str], now: _dt.datetime) -> DataFrame:
    """Insert new keys, update values and ``updated_at`` of present
    ones; ``id`` and ``created_at`` of existing keys are kept, untouched keys
    stay as they are. New ids continue after the largest id, in key order.
    """
    ts = F.lit(now).cast("timestamp")
    # one row a key, read by the kept and by the new rows: the batch itself is read once
    b = stage(batch.select(*key_cols, *[F.col(v).alias(f"_new_{v}") for v in value_cols]), "dim-batch").withColumn("_in", F.lit(True))
    j = existing.join(b, key_cols, "full_outer")
    kept = j.where(F.col("id").isNotNull()).select(
        "id", *key_cols,
        *[F.when(F.col("_in"), F.col(f"_new_{v}")).otherwise(F.col(v)).alias(v) for v in value_cols],
        "created_at", F.when(F.col("_in"), ts).otherwise(F.col("updated_at")).alias("updated_at"))
    new = j.where(F.col("id").isNull()).select(*key_cols, *[F.col(f"_new_{v}").alias(v) for v in value_cols])
    max_id = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"))
    new = number_rows(new, [], key_cols, out="_seq")
    new = new.withColumn("_m", max_id.scalar())  # scalar subquery: one value
    new = new.select((F.col("_m") + F.col("_seq")).cast("bigint").alias("id"), *key_cols, *value_cols,
                     ts.alias("created_at"), ts.alias("updated_at"))
    return kept.unionByName(new)


def upsert_code_dimension(existing: DataFrame, rows: DataFrame, kind: str, now: _dt.datetime, **order) -> DataFrame:
    """I9 for market / item / origin; ``order`` as in ``batch_names``."""
    code, name = CODE_DIMS[kind]
    return upsert_dimension(existing, batch_names(rows, code, name, **order), [code], [name], now)


def upsert_grade_dimension(existing: DataFrame, rows: DataFrame, now: _dt.datetime) -> DataFrame:
    """Keyed on the four grade columns (not on a joined string, which can
    collide); an update only touches ``updated_at``."""
    return upsert_dimension(existing, rows.select(*GRADE_KEY).distinct(), GRADE_KEY, [], now)


def resolve_surrogate_keys(fact: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Code -> id for the four dimensions (grade on its four columns). A
    fact row whose key no dimension holds is an error that names the dimension
    and the key, when the result is computed; rows are never dropped."""
    out = fact
    keys = {kind: [CODE_DIMS[kind][0]] for kind in ("market", "item", "origin")} | {"grade": list(GRADE_KEY)}
    for kind, key in keys.items():
        found = F.col(f"_{kind}_id")
        named = F.concat_ws(" / ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
        out = out.join(dims[kind].select(F.col("id").alias(f"_{kind}_id"), *key), key, "left")
        out = out.withColumn(f"{kind}_id", F.when(found.isNotNull(), found).otherwise(
            F.raise_error(F.concat(F.lit(f"no {kind} for key "), named)).cast(out.schema[f"_{kind}_id"].dataType))).drop(f"_{kind}_id")
    return out


# ------------------------------------------------------------ fact

def fact_rows(rows: DataFrame, now: _dt.datetime) -> DataFrame:
    """Loadable parsed rows in the stored fact shape."""
    ts = F.lit(now).cast("timestamp")
    extra = [c for c in ("load_month",) if c in rows.columns]
    return rows.select(*FACT_COLUMNS, *extra, ts.alias("ingested_at"), ts.alias("created_at"),
                       ts.alias("updated_at"))


def merge_facts(existing: DataFrame, incoming: DataFrame, partition_col: str | None = None,
                touched: list[str] | None = None) -> DataFrame:
    """Upsert on (source_file, source_row_no). Incoming rows replace
    measures, keys, ``ingested_at`` and ``updated_at``; ``created_at`` of an
    existing row is kept; existing rows absent from the batch are kept (a
    shorter re-send deletes nothing). Incoming keys must be unique.

    With ``partition_col``/``touched`` (the partitions the batch's files map
    to; a file's key fixes its partition) the joins read only those
    partitions of the existing table; the other partitions pass through
    untouched (and a partition-scoped publish never reads them).
    """
    key = ["source_file", "source_row_no"]
    cols = [c for c in existing.columns]
    rest = None
    if partition_col and touched is not None:
        in_batch = F.col(partition_col).isin(touched)
        rest = existing.where(~in_batch)
        existing = existing.where(in_batch)
    # one full outer join: an incoming row replaces everything but created_at; texts travel as one
    texts = [c for c in cols if c not in key and existing.schema[c].dataType == incoming.schema[c].dataType == T.StringType()]
    values = [c for c in cols if c not in key and c not in texts]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, F.struct(*values, pack_texts(texts).alias("_texts")).alias(name))
    j = side(existing, "_old").join(side(incoming, "_new"), key, "full_outer")
    out = j.select(*key, *[
        (F.coalesce(F.col("_old.created_at"), F.col("_new.created_at")) if c == "created_at" else
         F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))).alias(c)
        for c in (*values, "_texts")])
    out = out.withColumn("_texts", unpack_texts("_texts")).withColumns({c: F.get("_texts", F.lit(i)) for i, c in enumerate(texts)}).select(*cols)
    return out if rest is None else rest.select(*cols).unionByName(out)


# ------------------------------------------------------------ audit

def run_status(file_log: DataFrame, fail_fast: bool = False) -> Column:
    """I14 status expression over an aggregate of the file log."""
    return (F.when(F.col("failed_files") > 0, F.lit(RUN_FAILED if fail_fast else RUN_PARTIAL))
             .otherwise(F.lit(RUN_SUCCESS)))


def run_summary(file_log: DataFrame, group_cols: list[str] | None = None,
                fail_fast: bool = False) -> DataFrame:
    """Files, failed files, row totals and the first error, per run
    (or per ``group_cols``). ``rows_error > 0`` alone leaves a run successful."""
    g = group_cols or []
    agg = file_log.groupBy(*g).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("status") == FILE_FAILED).alias("failed_files"),
        F.sum("rows_total").cast("bigint").alias("rows_total"),
        F.sum("rows_ok").cast("bigint").alias("rows_ok"),
        F.sum("rows_error").cast("bigint").alias("rows_error"),
        F.min_by(F.col("error"), F.when(F.col("error").isNotNull(), F.col("file_path"))).alias("error_message"))
    return agg.withColumn("status", run_status(agg, fail_fast)).withColumn(
        "error_message", F.when(F.col("failed_files") > 0, F.col("error_message")))


def number_file_log(file_log: DataFrame, first_id: int | Column = 1) -> DataFrame:
    """File log ids in (run, file) order, continuing after ``first_id - 1``."""
    return number_rows(file_log, [], ["run_id", "file_path"], out="id", start=1).withColumn(
        "id", F.col("id") + (first_id if isinstance(first_id, Column) else F.lit(first_id)) - 1)


# ------------------------------------------------------------ file batches

@dataclass
class IngestResult:
    """Everything one ingest run produces, as lazy DataFrames."""
    star: Star
    file_log: DataFrame
    run: DataFrame
    rejects: DataFrame
    parsed: DataFrame
    touched: list = None       # fact partitions (load_month) the run may change
    first: bool = False        # nothing was stored before: the facts are the run's own rows


def ingest_files(spark: SparkSession, root: str, existing: Star | None, run_type: str = "manual_utf8",
                 now: _dt.datetime | None = None, fail_fast: bool = False, ext: str = ".csv",
                 only: list[str] | None = None) -> IngestResult | None:
    """One ingest run over the CSV files below ``root``.

    ``only`` restricts the run to these files (absolute paths, e.g. the new
    files of a streaming micro-batch). Returns None when there is no file
    (I16: skipped, not failed). Files with
    a bad or empty header fail (I4); a date group with a load error fails as a
    whole and loads nothing (I11); rows of failed files are never loaded
    (I15). Dimensions and facts are upserted against ``existing`` (I9-I13);
    the run and file log follow the reference's status rules (I8, I14).
    """
    from seika.sources import csv_files as C
    now = now or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    listing = C.list_files(spark, root, ext)
    if only is not None:
        wanted = spark.createDataFrame([(C.strip_scheme_text(p),) for p in only], "abs_path string").distinct()
        listing = listing.join(wanted, "abs_path", "left_semi")
    # Stage the batch once (the reference's temporary stage table): every
    # later step reads the staged records / parsed rows instead of re-reading
    # and re-parsing the files. Stages are Parquet tables in the cluster's
    # shared checkpoint folder, so a lost executor costs a re-read.
    listing = stage(listing, "listing")
    files = stage(listing.select("file_path", "date_key", "abs_path")
                  .join(C.file_hashes(listing), "file_path"), "files")
    # Spark's reader takes the batch's readable files by name: one entry per file
    listed = files.select("abs_path", "date_key", "read_error").collect()
    paths = [r.abs_path for r in listed if r.read_error is None]
    date_keys = {r.date_key for r in listed}
    if not listed:
        return None
    unparsable: list[str] = []
    records = C.read_records(spark, root, paths, unparsable=unparsable)
    if unparsable:
        files = files.withColumn("read_error", F.when(F.col("abs_path").isin(unparsable), F.lit("read file: a record has too many fields"))
                                 .otherwise(F.col("read_error")))
    maps = C.header_maps(records)
    header_err = (files.join(maps.select("file_path", "missing"), "file_path", "inner")
                  .select("file_path", "date_key",
                          F.when(F.col("missing").isNotNull(),
                                 F.concat(F.lit("missing required column: "), F.col("missing")))
                           .alias("error")))
    no_header = files.join(maps.select("file_path"), "file_path", "left_anti").select(
        "file_path", "date_key", F.coalesce("read_error", F.lit("read header: EOF")).alias("error"))
    header_failed = header_err.where(F.col("error").isNotNull()).unionByName(no_header)
    raw = C.labelled_rows(records, maps)
    parsed = stage(parse_rows(raw), "parsed")
    # One row per group or file, stored: joins then see how few they are, and the parsed rows stay where they are.
    poison = stage(group_poison(parsed, "date_key", "source_file"), "poison")
    group_failed = files.join(poison, "date_key").select(
        "file_path", "date_key", F.col("group_error").alias("error"))
    failed = stage(header_failed.unionByName(group_failed)
                   .groupBy("file_path").agg(F.min("error").alias("error")), "failed-files")
    stats = (files.join(parsed.groupBy(F.col("source_file").alias("file_path")).agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count_if(F.col("reject_reason").isNull()).alias("rows_ok"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("rows_error")), "file_path", "left")
        .join(failed, "file_path", "left")
        .na.fill(0, ["rows_total", "rows_ok", "rows_error"]))
    stats = stats.withColumn("status", F.when(F.col("error").isNotNull(), F.lit(FILE_FAILED))
                             .when(F.col("rows_error") > 0, F.lit(FILE_PARTIAL)).otherwise(F.lit(FILE_SUCCESS)))
    ok_rows = loadable(parsed.withColumnRenamed("source_file", "file_path"),
                       failed.select("file_path"), poison, "date_key", "file_path") \
        .withColumnRenamed("file_path", "source_file")
    empty = existing is None
    if empty:
        existing = empty_star(spark)
    ts = F.lit(now).cast("timestamp")
    # Files in the order of their date groups and names: one number then tells which of two rows is newer, and
    # the names of a file or a date are not kept apart on the way. One row a file, as its month is.
    order = number_rows(files.select("date_key", "file_path"), [], ["date_key", "file_path"], out="_file_no")
    order = stage(order.select(F.col("file_path").alias("source_file"), "_file_no", load_month(F.col("date_key")).alias("load_month")), "file-order")
    newest = ok_rows.join(order.drop("load_month"), "source_file").withColumn("_newest", F.shiftleft("_file_no", 32) + F.col("source_row_no"))
    dims = {k: upsert_code_dimension(existing.dim(k), newest, k, now, order_cols=("_newest",)) for k in CODE_DIMS}
    grade = upsert_grade_dimension(existing.dim_grade, ok_rows, now)
    fact_in = fact_rows(ok_rows.join(order.drop("_file_no"), "source_file"), now)
    old_fact = existing.fact
    if "load_month" not in old_fact.columns:
        old_fact = old_fact.withColumn("load_month", load_month(F.split("source_file", "/").getItem(0)))
    # months of this batch's files (from the listing): the fact partitions it can touch
    touched = sorted({_month_of(dk) for dk in date_keys})
    fact = fact_in.select(*old_fact.columns)
    if not empty:
        fact = merge_facts(old_fact, fact, "load_month", touched)
    run_id = (existing.runs.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).scalar()
              if existing.runs is not None else F.lit(1))
    first_file_id = (existing.files.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).scalar()
                     if existing.files is not None else F.lit(1))
    log = number_rows(stats.withColumn("run_id", run_id), [], ["file_path"], out="_n")
    log = log.select((F.col("_n") + first_file_id - 1).cast("bigint").alias("id"),
                     F.col("run_id").cast("bigint").alias("run_id"), "file_path",
                     F.coalesce("file_hash", F.lit("")).alias("file_hash"),
                     *[F.col(c).cast("int").alias(c) for c in ("rows_total", "rows_ok", "rows_error")],
                     "status", "error", ts.alias("created_at"), ts.alias("updated_at"))
    run = run_summary(log, ["run_id"], fail_fast).select(
        F.col("run_id").alias("id"), F.lit(run_type).alias("run_type"), ts.alias("started_at"),
        ts.alias("finished_at"), "status", "error_message", ts.alias("created_at"), ts.alias("updated_at"))
    runs = run if existing.runs is None else existing.runs.select(*run.columns).unionByName(run)
    files_all = (log.drop("error") if existing.files is None
                 else existing.files.select(*log.drop("error").columns).unionByName(log.drop("error")))
    new = Star(fact=fact, dim_market=dims["market"], dim_item=dims["item"], dim_origin=dims["origin"],
               dim_grade=grade, runs=runs, files=files_all)
    return IngestResult(star=new, file_log=log, run=run, rejects=rejected(parsed), parsed=parsed,
                        touched=touched, first=empty)


def _month_of(date_key: str) -> str:
    """``load_month`` of a date folder name, on the driver (same rule as below)."""
    import re
    m = re.search(r"(\d{6})\d{2}$", date_key or "")
    return m.group(1) if m else "unknown"


def load_month(date_key: Column) -> Column:
    """Fact partition of a file: the month of its date folder (YYYYMM), so a
    corrected trade date never moves a row across partitions."""
    m = F.regexp_extract(date_key, r"(\d{6})\d{2}$", 1)
    return F.when(m != "", m).otherwise(F.lit("unknown"))


def empty_star(spark: SparkSession) -> Star:
    """A warehouse with no rows, in the stored schemas."""
    from seika.schemas import FACT_SCHEMA
    ts = "created_at timestamp, updated_at timestamp"

    def e(ddl):
        return spark.createDataFrame([], ddl)
    fact = spark.createDataFrame([], FACT_SCHEMA).withColumn("load_month", F.lit(None).cast("string"))
    return Star(fact=fact,
                dim_market=e(f"id bigint, market_code string, market_name string, {ts}"),
                dim_item=e(f"id bigint, item_code string, item_name string, {ts}"),
                dim_origin=e(f"id bigint, origin_code string, origin_name string, {ts}"),
                dim_grade=e(f"id bigint, grade string, class string, product_name string, unit_weight string, {ts}"),
                runs=None, files=None)
