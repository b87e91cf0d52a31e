"""Stored tables of the price warehouse.

The fact table keeps the dimensions' natural keys (codes, and the four grade
columns) next to the measures; each dimension table maps its key to a
surrogate ``id`` and the current name. A rename in a dimension is therefore
seen by every fact row at once, as with a surrogate-key join, while point
queries filter the fact directly on the code and skip row groups by Parquet
min/max statistics.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

GRADE_KEY = ["grade", "class", "product_name", "unit_weight"]

FACT_COLUMNS = [
    "trade_date", "weekday_ja", "market_code", "item_code", "origin_code",
    *GRADE_KEY,
    "item_total_ton", "arrival_ton", "price_high_yen", "price_mid_yen", "price_low_yen",
    "trend_label", "source_file", "source_row_no",
]

FACT_SCHEMA = T.StructType([
    T.StructField("trade_date", T.DateType(), False),
    T.StructField("weekday_ja", T.StringType(), False),
    T.StructField("market_code", T.StringType(), False),
    T.StructField("item_code", T.StringType(), False),
    T.StructField("origin_code", T.StringType(), False),
    T.StructField("grade", T.StringType(), False),
    T.StructField("class", T.StringType(), False),
    T.StructField("product_name", T.StringType(), False),
    T.StructField("unit_weight", T.StringType(), False),
    T.StructField("item_total_ton", T.DecimalType(14, 3), True),
    T.StructField("arrival_ton", T.DecimalType(14, 3), True),
    T.StructField("price_high_yen", T.IntegerType(), True),
    T.StructField("price_mid_yen", T.IntegerType(), True),
    T.StructField("price_low_yen", T.IntegerType(), True),
    T.StructField("trend_label", T.StringType(), True),
    T.StructField("source_file", T.StringType(), False),
    T.StructField("source_row_no", T.IntegerType(), False),
    T.StructField("ingested_at", T.TimestampType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("updated_at", T.TimestampType(), False),
])

# name -> (code column, name column) for the three code/name dimensions
CODE_DIMS = {
    "market": ("market_code", "market_name"),
    "item": ("item_code", "item_name"),
    "origin": ("origin_code", "origin_name"),
}

# The 20 required CSV headers, in the reference's order.
REQUIRED_HEADERS = [
    "年", "月", "日", "曜日",
    "市場名", "市場コード",
    "品目名", "品目コード",
    "産地名", "産地コード",
    "品目計", "入荷量",
    "高値", "中値", "安値",
    "等級", "階級", "品名", "量目", "動向",
]

# Defaults for a blank origin.
UNKNOWN_ORIGIN_CODE = "UNKNOWN"
UNKNOWN_ORIGIN_NAME = "不明"

# Run and file statuses.
RUN_SUCCESS, RUN_PARTIAL, RUN_FAILED, RUN_RUNNING = "success", "partial_failed", "failed", "running"
FILE_SUCCESS, FILE_PARTIAL, FILE_FAILED = "success", "partial_success", "failed"

# Stored column widths (varchar limits); longer values abort the date group.
MAX_LEN = {
    "market_code": 32, "item_code": 32, "origin_code": 32,
    "market_name": 255, "item_name": 255, "origin_name": 255,
    "grade": 64, "class": 64, "product_name": 255, "unit_weight": 64,
    "weekday_ja": 16, "trend_label": 64, "source_file": 1024,
}


@dataclass
class Star:
    """The warehouse: fact table, four dimensions and the audit tables."""
    fact: DataFrame
    dim_market: DataFrame
    dim_item: DataFrame
    dim_origin: DataFrame
    dim_grade: DataFrame
    runs: DataFrame | None = None
    files: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    def dim(self, kind: str) -> DataFrame:
        return {"market": self.dim_market, "item": self.dim_item,
                "origin": self.dim_origin, "grade": self.dim_grade}[kind]
