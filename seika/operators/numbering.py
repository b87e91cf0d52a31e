"""Exact sequential numbering and running totals without sending a whole group to one task.

``row_number() OVER (PARTITION BY g ORDER BY k)`` puts every row of a group in
one task; one hot group (a date holding a third of the data, say) then becomes
one task. Here Spark range-partitions and sorts the rows by (g, k), so a hot group
spans many ranges, and the result is written once with each row's place
(``monotonically_increasing_id``: range number and position in the range). A
row's number is its position past the group's first row in its range, shifted by
the group's rows in earlier ranges.

The totals by range are a small table: ranges are contiguous, so (group,
range) pairs are at most ``groups + ranges``. Every size takes this one path;
adaptive execution joins small ranges, so a small input has one. The places are
stored before they are read, so a recomputed task can't disagree with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seika.functions.text import pack_texts, unpack_texts
from seika.session import stage

RANGE_SHIFT = 33  # monotonically_increasing_id keeps the partition in the bits above
BLOCK_ROWS = 20_000  # rows of one block of ``with_rows_before``: a task's share, not a limit


def in_ranges(df: DataFrame, keys: list[str], ranges: int | None = None, drop: list[str] | None = None) -> DataFrame:
    """``df`` stored in contiguous key ranges (nulls first) with ``_range`` (number of the row's range) and
    ``_at`` (ascending over the whole table). ``ranges`` fixes their number; else Spark's settings do. Columns that
    are in ``drop`` are not stored. Texts that are no keys travel as one."""
    texts = [f.name for f in df.schema.fields if f.dataType == T.StringType() and f.name not in keys and f.name not in (drop or [])]
    kept = [c for c in df.columns if c not in (drop or [])]
    if len(texts) > 1:
        df = df.select(*[c for c in df.columns if c not in texts], pack_texts(texts).alias("_texts"))
    by = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    placed = by.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    if len(texts) > 1:
        placed = placed.withColumn("_texts", unpack_texts("_texts")).withColumns({c: F.get("_texts", F.lit(i)) for i, c in enumerate(texts)})
    return stage(placed.select(*kept, "_at"), "ranges").withColumn("_range", F.shiftright("_at", RANGE_SHIFT))


def number_rows(df: DataFrame, group_cols: list[str], order_cols: list[str],
                out: str = "rn", start: int = 1, ranges: int | None = None, drop: list[str] | None = None) -> DataFrame:
    """Add ``out`` = start + 0-based position of the row inside its group in
    ``order_cols`` order. Group columns must be non-null; rows with equal keys get
    different numbers, in an order that is fixed when the ranges are stored. Order columns that are
    in ``drop`` are left out of the result.

    The table of groups by range is broadcast: callers number by a group with a
    fixed bound (calendar dates, files of one batch, or no group)."""
    placed = in_ranges(df, [*group_cols, *order_cols], ranges, drop)
    counts = placed.groupBy(*group_cols, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*group_cols).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*group_cols, "_range", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return (placed.join(F.broadcast(shift), [*group_cols, "_range"])
            .withColumn(out, (F.col("_at") + F.col("_shift") + F.lit(start)).cast("bigint"))
            .select(*[c for c in df.columns if c != out and c not in (drop or [])], out))


def running(df: DataFrame, order_cols: list[str], sums: dict[str, str] | None = None,
            maxima: dict[str, Column] | None = None, minima: dict[str, str] | None = None,
            ranges: int | None = None) -> DataFrame:
    """Running totals over the whole table in ``order_cols`` order: ``out: column`` of
    ``sums`` adds a running sum, of ``maxima`` the running maximum of an expression
    (nulls passed over), and ``out: o`` of ``minima`` the running minimum of the
    running sum ``o``. Summed within each range, then shifted by the totals of the
    earlier ranges (one row a range). Rows with equal keys follow one another."""
    sums, maxima, minima = sums or {}, maxima or {}, minima or {}
    placed = in_ranges(df.withColumns({f"_x_{o}": c for o, c in maxima.items()}), order_cols, ranges)
    here = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumns({**{f"_s_{o}": F.sum(v).over(here) for o, v in sums.items()},
                                **{f"_h_{o}": F.max(f"_x_{o}").over(here) for o in maxima}})
    if minima:
        local = local.withColumns({f"_l_{m}": F.min(f"_s_{o}").over(here) for m, o in minima.items()})

    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("_range").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_t_{o}") for o, v in sums.items()],
        *[F.max(f"_x_{o}").alias(f"_t_{o}") for o in maxima], *[F.min(f"_l_{m}").alias(f"_t_{m}") for m in minima])
    before = totals.select("*", *[F.coalesce(F.sum(f"_t_{o}").over(earlier), F.lit(0)).alias(f"_b_{o}") for o in sums],
                           *[F.max(f"_t_{o}").over(earlier).alias(f"_b_{o}") for o in maxima])
    before = before.select("_range", *[f"_b_{o}" for o in (*sums, *maxima)],
                           *[F.min(F.col(f"_t_{m}") + F.col(f"_b_{o}")).over(earlier).alias(f"_b_{m}") for m, o in minima.items()])
    out = local.join(F.broadcast(before), "_range").withColumns(
        {**{o: F.col(f"_b_{o}") + F.col(f"_s_{o}") for o in sums},
         **{o: F.greatest(f"_b_{o}", f"_h_{o}") for o in maxima},
         **{m: F.least(F.col(f"_b_{m}"), F.col(f"_b_{o}") + F.col(f"_l_{m}")) for m, o in minima.items()}})
    added = [*sums, *maxima, *minima]
    return out.select(*[c for c in df.columns if c not in added], *added)


def with_rows_before(df: DataFrame, order_cols: list[str], rows: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For frames that look at most ``rows`` rows back: numbers the rows (``_no``, from 0),
    cuts them into blocks (``_block``) and repeats each block's last ``rows`` rows at the head
    of the next one (``_own`` is false there). A window over ``_block`` ordered by ``_no``
    then sees what a window over the whole table would; drop the rows that aren't ``_own`` after it."""
    if not 0 <= rows <= block_rows:
        raise ValueError("a block must hold the rows looked back at")
    numbered = number_rows(df, [], order_cols, out="_no", start=0)
    block = F.floor(F.col("_no") / block_rows)
    last = F.col("_no") % block_rows >= block_rows - rows
    return (numbered.withColumn("_home", block)
            .withColumn("_block", F.explode(F.when(last, F.array(block, block + 1)).otherwise(F.array(block))))
            .withColumn("_own", F.col("_block") == F.col("_home")).drop("_home"))
