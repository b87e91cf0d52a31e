"""Data-quality checks on the warehouse (Q1, Q2).

The stored tables carry no enforced constraints (Parquet), so the reference's
foreign and unique keys become checks that return the offending keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seika.schemas import CODE_DIMS, GRADE_KEY, Star


def orphan_check(star: Star) -> DataFrame:
    """Q1: fact keys that have no dimension row, per dimension, with the
    number of fact rows holding them. Each check is a left-anti join of the
    fact's distinct keys (aggregated first) against the dimension."""
    out = None
    for kind, (code, _) in CODE_DIMS.items():
        keys = star.fact.groupBy(code).agg(F.count(F.lit(1)).alias("rows"))
        miss = keys.join(star.dim(kind).select(code), code, "left_anti").select(
            F.lit(kind).alias("dimension"), F.col(code).alias("key"), "rows")
        out = miss if out is None else out.unionByName(miss)
    g = star.fact.groupBy(*GRADE_KEY).agg(F.count(F.lit(1)).alias("rows"))
    gm = g.join(star.dim_grade.select(*GRADE_KEY), GRADE_KEY, "left_anti").select(
        F.lit("grade").alias("dimension"), F.concat_ws("|", *GRADE_KEY).alias("key"), "rows")
    return out.unionByName(gm)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q2: keys that occur more than once, with their number of copies."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
              .where(F.col("copies") > 1))


def dimension_duplicates(star: Star) -> DataFrame:
    """Q2 on the dimensions: codes (or grade keys) held by more than one row."""
    out = None
    for kind, (code, _) in CODE_DIMS.items():
        d = duplicate_keys(star.dim(kind), [code]).select(
            F.lit(kind).alias("dimension"), F.col(code).alias("key"), "copies")
        out = d if out is None else out.unionByName(d)
    g = duplicate_keys(star.dim_grade, GRADE_KEY).select(
        F.lit("grade").alias("dimension"), F.concat_ws("|", *GRADE_KEY).alias("key"), "copies")
    return out.unionByName(g)
