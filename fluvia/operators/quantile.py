"""Exact quantiles of any number of rows by repeated histogram narrowing.

Every wanted quantile is one or two order statistics. The span from a group's least to its greatest value is cut into
``BUCKETS`` equal parts and their rows are counted; the parts that hold wanted ranks are the next, narrower spans, from
the least to the greatest value in them. After ``LEVELS`` rounds only the rows of the last spans are counted by value.
Tasks add up counts (with partial sums before each shuffle) and never hold a group's values.

Where a count shows that no group has more than ``TASK_VALUES`` of them, Spark's ``percentile``, which holds a group's different
values in a task, gives the same in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

BUCKETS = 4096
LEVELS = 1
#: Values of a group that a task may hold: 30 years of hours.
TASK_VALUES = 1 << 18


def _place(points: list[float], n: Column) -> list[Column]:
    return [F.lit(p) * (n - 1) for p in points]


def fits(rows: DataFrame, keys: tuple[str, ...], column: str, most: int = TASK_VALUES) -> bool:
    """Whether no group has more than ``most`` values; counts them."""
    return (rows.groupBy(*keys).agg(F.count(column).alias("_n")).agg(F.max("_n")).first()[0] or 0) <= most


def select(rows: DataFrame, keys: tuple[str, ...], column: str, points: list[float], buckets: int = BUCKETS, levels: int = LEVELS, small: bool | None = None) -> DataFrame:
    """(keys, n, q): the count of non-null values and their quantiles in order of ``points``, linear between neighbours.

    Equal to Spark's ``percentile``. A group without values has no row; without keys an empty table gives one row of nulls with n = 0, as an aggregate does.
    ``rows`` is read several times: pass a written table. small: what ``fits`` says of it, if that is known.
    """
    if fits(rows, keys, column) if small is None else small:
        q = F.percentile(column, F.array(*map(F.lit, points)))
        return rows.groupBy(*keys).agg(F.count(column).alias("n"), q.alias("q")).where(F.col("n") > 0 if keys else F.lit(True))
    live = rows.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_v"))
    by, on = list(keys), [*keys, "_all"]
    live = live.withColumn("_all", F.lit(0))
    ends = live.groupBy(*on).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ranks = F.array_sort(F.array_distinct(F.flatten(F.array(*(F.array(F.floor(x), F.ceil(x)) for x in _place(points, F.col("n")))))))
    spans = ends.select(*on, F.lit(0).cast("long").alias("_before"), "_lo", "_hi", ranks.alias("_ranks"))
    for level in range(levels + 1):
        # a few spans for each group, which is a station or a station's bin
        inside = live.join(F.broadcast(spans), on).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        width = F.col("_hi") / 2 - F.col("_lo") / 2  # halves: the span may pass the largest double
        part = F.when(width > 0, F.floor(F.least((F.col("_v") / 2 - F.col("_lo") / 2) / width, F.lit(1.0)) * (buckets - 1))).otherwise(0)
        part = part if level < levels else F.col("_v")
        counted = inside.groupBy(*on, "_lo", part.alias("_part")).agg(F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.first("_before").alias("_before"), F.first("_ranks").alias("_ranks"))
        w = Window.partitionBy(*on, "_lo").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        start = F.col("_before") + F.coalesce(F.sum("_c").over(w), F.lit(0))
        mine = F.filter("_ranks", lambda r: (r >= F.col("_s")) & (r < F.col("_s") + F.col("_c")))
        found = counted.withColumn("_s", start).withColumn("_mine", mine).where(F.size("_mine") > 0)
        spans = found.select(*on, F.col("_s").alias("_before"), F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), F.col("_mine").alias("_ranks"))
    values = spans.groupBy(*on).agg(F.map_from_entries(F.flatten(F.collect_list(F.transform("_ranks", lambda r: F.struct(r.alias("r"), F.col("_lo").alias("v")))))).alias("_m"))
    both = ends.join(values, on)
    out = []
    for x in _place(points, F.col("n")):
        low, high = F.col("_m")[F.floor(x)], F.col("_m")[F.ceil(x)]
        out.append(F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high))
    done = both.select(*by, "n", F.array(*out).alias("q"))
    if by:
        return done
    return rows.sparkSession.range(1).select(F.lit(0).alias("_all")).join(both.select("_all", "n", F.array(*out).alias("q")), "_all", "left").select(F.coalesce("n", F.lit(0)).alias("n"), "q")


def median(rows: DataFrame, keys: tuple[str, ...], column: str, small: bool | None = None) -> DataFrame:
    """(keys, median)."""
    return select(rows, keys, column, [0.5], small=small).select(*keys, F.col("q")[0].alias("median"))


def slim(rows: DataFrame, keys: tuple[str, ...], *columns: str) -> DataFrame:
    """The columns that the rounds read, written once."""
    return written(rows.select(*keys, *columns), "values")
