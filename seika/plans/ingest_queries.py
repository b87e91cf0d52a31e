"""Registered ingest queries (I5-I14, Q3, R2, R12, R13) over the dirty rows view.

The batch is the FIXTURES §4 text rows; its date group is the file's date
folder and the audit groups files into one run per calendar year.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seika.operators import ingest as I
from seika.operators import prices as R
from seika.operators.numbering import number_rows
from seika.plans import oracle as O
from seika.plans.registry import register
from seika.schemas import GRADE_KEY, Star
from seika.sources import testdata as TD

NOW = _dt.datetime(1999, 1, 2, 0, 0, 0)
RUN_TYPE = "fixture_backfill"


def parsed_batch(spark, sf_dir, rows: DataFrame | None = None) -> DataFrame:
    """The dirty text rows, landed (staged as a table in the shared checkpoint
    folder, as a file drop would be) and then parsed. Landing keeps the
    rendering of the fixture out of the parse job's generated code. ``rows``:
    numbered price rows that the caller reads too."""
    from seika.session import stage
    raw = TD.raw_rows(spark, sf_dir, rows).withColumn("date_key", F.split("source_file", "/").getItem(0))
    return I.parse_rows(stage(raw, "raw-rows"))


def _as_double(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in ("item_total_ton", "arrival_ton")
                           if c in df.columns})


PARSED_COLUMNS = ["trade_date", "weekday_ja", "market_code", "market_name", "item_code", "item_name",
                  "origin_code", "origin_name", *GRADE_KEY, "item_total_ton", "arrival_ton",
                  "price_high_yen", "price_mid_yen", "price_low_yen", "trend_label", "source_file",
                  "source_row_no"]


@register("parse_rows", O.parse_rows_sql())
def parse_rows(spark, sf_dir):
    """Typed rows accepted by the first-failure-wins rules."""
    return _as_double(I.accepted(parsed_batch(spark, sf_dir)).select(*PARSED_COLUMNS))


@register("row_quarantine", O.quarantine_sql())
def row_quarantine(spark, sf_dir):
    """Rejected rows counted per reason class (the rows themselves are kept
    by ``ingest.rejected``)."""
    return (I.rejected(parsed_batch(spark, sf_dir)).groupBy("reject_class")
            .agg(F.count(F.lit(1)).alias("rows")))


@register("default_unknown_origin", O.origin_counts_sql())
def default_unknown_origin(spark, sf_dir):
    """Accepted rows per (origin_code, origin_name); blanks became UNKNOWN / 不明."""
    return (I.accepted(parsed_batch(spark, sf_dir)).groupBy("origin_code", "origin_name")
            .agg(F.count(F.lit(1)).alias("rows")))


@register("file_stats", O.file_stats_sql())
def file_stats(spark, sf_dir):
    """I8: per file rows_total / rows_ok / rows_error and status."""
    return I.file_stats(parsed_batch(spark, sf_dir)).drop("error")


def audit(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """File log and run table of the backfill: one run per calendar year."""
    stats = I.file_stats(parsed_batch(spark, sf_dir)).withColumnRenamed("source_file", "file_path")
    stats = stats.withColumn("year", F.substring("file_path", 1, 4).cast("int"))
    years = number_rows(stats.select("year").distinct(), [], ["year"], out="run_id")
    # one row per calendar year: a bounded table
    stats = stats.join(F.broadcast(years), "year")
    ts = F.lit(NOW).cast("timestamp")
    files = I.number_file_log(stats).select(
        "id", "run_id", "file_path", F.lit("").alias("file_hash"), "rows_total", "rows_ok",
        "rows_error", "status", "error", ts.alias("created_at"), ts.alias("updated_at"))
    runs = I.run_summary(files, ["run_id"]).select(
        F.col("run_id").alias("id"), F.lit(RUN_TYPE).alias("run_type"), ts.alias("started_at"),
        ts.alias("finished_at"), "status", "error_message", "files", "failed_files",
        "rows_total", "rows_ok", "rows_error", ts.alias("created_at"), ts.alias("updated_at"))
    return runs, files.drop("error")


@register("run_audit", O.run_audit_sql(RUN_TYPE))
def run_audit(spark, sf_dir):
    """Run rows with status and totals."""
    runs, _ = audit(spark, sf_dir)
    return runs.drop("started_at", "finished_at", "created_at", "updated_at")


@register("status_rollup", O.status_rollup_sql())
def status_rollup(spark, sf_dir):
    """Q3: files, failed files and row totals per date group."""
    _, files = audit(spark, sf_dir)
    files = files.withColumn("date_key", F.split("file_path", "/").getItem(0)).withColumn(
        "error", F.lit(None).cast("string"))
    return I.run_summary(files, ["date_key"]).drop("status", "error_message")


def _audit_star(spark, sf_dir) -> Star:
    st = TD.star(spark, sf_dir, with_row_no=False, dims=())
    st.runs, st.files = audit(spark, sf_dir)
    return st


@register("ingestion_runs", O.ingestion_runs_sql(RUN_TYPE, 3, 2))
def ingestion_runs(spark, sf_dir):
    """Runs newest first, limit 3 offset 2."""
    page, _ = R.ingestion_runs(_audit_star(spark, sf_dir), limit=3, offset=2)
    return page.select("id", "run_type", "status", "error_message", "rows_total")


@register("ingestion_files", O.ingestion_files_sql(4, 25, 5))
def ingestion_files(spark, sf_dir):
    """File logs of run 4, newest first, limit 25 offset 5."""
    page, _ = R.ingestion_files(_audit_star(spark, sf_dir), run_id="4", limit=25, offset=5)
    return page.select("id", "run_id", "file_path", "rows_total", "rows_ok", "rows_error", "status")


@register("coverage", O.coverage_sql(RUN_TYPE))
def coverage(spark, sf_dir):
    """R2: date range, exact row count and the latest run."""
    out, _ = R.coverage(_audit_star(spark, sf_dir))
    return out.drop("last_ingestion_finished_at")


# ------------------------------------------------------------------ upserts

def _jan_1995_rows(spark, sf_dir) -> DataFrame:
    return TD.price_rows(spark, sf_dir, with_row_no=False).where(F.col("trade_date") < F.lit(_dt.date(1995, 2, 1)))


def _jan_1995_star(spark, sf_dir) -> Star:
    """The warehouse after loading January 1995 only (ids in code order)."""
    st = TD.star(spark, sf_dir, with_row_no=True, dims=())
    rows = _jan_1995_rows(spark, sf_dir)
    return Star(fact=st.fact, **{f"dim_{k}": TD.dimension(rows, k) for k in ("market", "item", "origin", "grade")})


def resent_batch(spark, sf_dir, rows: DataFrame | None = None) -> DataFrame:
    """Loadable rows of every file, re-sent as dirty text (the whole table)."""
    return I.loadable(parsed_batch(spark, sf_dir, rows), None, None)


for _kind in ("market", "item", "origin"):
    def _mk(kind):
        @register(f"dim_upsert_{kind}", O.dim_upsert_sql(kind))
        def _q(spark, sf_dir):
            """Upsert the re-sent batch's codes/names (all files) into a
            dimension holding January 1995's codes; newest row wins a name."""
            old = TD.dimension(_jan_1995_rows(spark, sf_dir), kind)
            out = I.upsert_code_dimension(old, resent_batch(spark, sf_dir), kind, NOW)
            return out.withColumn("updated", F.col("updated_at") == F.lit(NOW)).drop("created_at", "updated_at")
        return _q
    _mk(_kind)


@register("dim_upsert_grade", O.grade_upsert_sql())
def dim_upsert_grade(spark, sf_dir):
    """Upsert of the four-column grade key."""
    old = TD.dimension(_jan_1995_rows(spark, sf_dir), "grade")
    out = I.upsert_grade_dimension(old, resent_batch(spark, sf_dir), NOW)
    return out.withColumn("updated", F.col("updated_at") == F.lit(NOW)).drop("created_at", "updated_at")


@register("fact_upsert", O.fact_upsert_sql())
def fact_upsert(spark, sf_dir):
    """Merge every re-sent file into the full fact table on
    (source_file, source_row_no); rejected rows of the re-send keep their old
    version, nothing is deleted."""
    rows = TD.price_rows(spark, sf_dir)  # the fact and the re-sent files are of the same rows
    st = TD.star(spark, sf_dir, dims=(), rows=rows)
    incoming = I.fact_rows(resent_batch(spark, sf_dir, rows), NOW)
    merged = I.merge_facts(st.fact, incoming)
    return _as_double(merged.withColumn("updated", F.col("updated_at") == F.lit(NOW))
                      .drop("ingested_at", "created_at", "updated_at"))


@register("resolve_surrogate_keys", O.surrogate_sql())
def resolve_surrogate_keys(spark, sf_dir):
    """Code -> id for the four dimensions on every fact row."""
    st = TD.star(spark, sf_dir, with_row_no=True)
    out = I.resolve_surrogate_keys(st.fact, {"market": st.dim_market, "item": st.dim_item,
                                             "origin": st.dim_origin, "grade": st.dim_grade})
    return out.select("source_file", "source_row_no", "market_id", "item_id", "origin_id", "grade_id")
