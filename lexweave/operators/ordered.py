"""Order statistics and windows over few, large groups: no task sees a whole group.

Percentiles are exact. A sketch brackets each wanted place, then all values outside the brackets are only
counted, and the element is found among the few within. Windows are cut into blocks of time or of
row numbers, and each block gets the rows before it that its first windows reach back to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.stages import written

#: One over the sketch's error, the brackets' half width, and the rows from which on a group is bracketed.
ACCURACY, HALF, BRACKETED_FROM = 20_000, 2e-4, 50_000
#: Rows of a block of row numbers; seconds of a block of time.
BLOCK_ROWS, BLOCK_SECONDS = 100_000, 3600


def order_statistics(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], places: Callable[[Column, float], Column] | None = None, **more: Column) -> DataFrame:
    """For each group of the keys: n, the aggregates ``more``, and for each named share the element of its place, from 0, among the sorted values.

    The place is floor(n * share), at most n - 1, or what ``places`` makes of n and share; it must be within
    a row of n * share. Rows without a value count for nothing. Without keys there is one row.
    """
    rows = df.filter(F.col(value).isNotNull())
    place = places or (lambda n, share: F.least(F.floor(n * F.lit(share)), n - 1))
    cuts = [min(1.0, max(0.0, share + d)) for share in shares.values() for d in (-HALF, HALF)]
    whole = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(c.alias(name) for name, c in more.items()), F.min(value).alias("__min"), F.max(value).alias("__max"), F.percentile_approx(value, F.array(*map(F.lit, cuts)), ACCURACY).alias("__q"))
    small = F.col("n") < BRACKETED_FROM
    bounds = whole.select(*keys, *(F.when(small, F.col("__max" if k % 2 else "__min")).otherwise(F.col("__q")[k]).alias(f"__b{k}") for k in range(len(cuts))))
    near = rows.select(*keys, value).join(bounds, keys) if keys else rows.select(value).crossJoin(F.broadcast(bounds))  # one row

    v, within, region = F.col(value), F.lit(False), F.lit(0)
    for k in range(0, len(cuts), 2):
        low, high = F.col(f"__b{k}"), F.col(f"__b{k + 1}")
        within, region = within | ((v >= low) & (v <= high)), region + (v >= low).cast("int") + (v > high).cast("int")
    counted = near.groupBy(*keys, within.alias("__in"), region.alias("__region"), F.when(within, v).alias("__value")).agg(F.count("*").alias("c"), F.min(value).alias("v"))
    # without keys, a group of what the brackets hold is all that a task gets
    running = counted.select(*keys, "v", "__in", F.sum("c").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("v")).alias("upto"))
    sized = running.join(whole.select(*keys, "n"), keys) if keys else running.crossJoin(F.broadcast(whole.select("n")))

    def at(share: float) -> Column:
        return F.min(F.when(F.col("upto") > place(F.col("n"), share), F.struct("v", "__in")))

    found = sized.groupBy(*keys).agg(*(at(share).alias(name) for name, share in shares.items()))
    exact = [F.when(F.col(name)["__in"], F.col(name)["v"]).when(F.col(name).isNotNull(), F.raise_error(F.lit("a bracket misses its place"))).alias(name) for name in shares]
    found = found.select(*keys, *exact)
    out = whole.join(found, keys) if keys else whole.crossJoin(F.broadcast(found))
    return out.select(*keys, "n", *more, *shares)


def block_numbers(df: DataFrame, keys: list[str], time: str, *order: str, seconds: int = BLOCK_SECONDS) -> DataFrame:
    """df with __n, each row's number, from 1, in its group by time and order: local numbers in blocks of time, and the counts of the blocks before."""
    block = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (seconds * 1_000_000))
    rows = df.withColumn("__block", block)
    local = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(time, *order))
    before = F.sum("c").over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy(*keys, "__block").agg(F.count("*").alias("c")).select(*keys, "__block", F.coalesce(before, F.lit(0)).alias("__before"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "__block")]
    out = rows.withColumn("__local", local).alias("l").join(offsets.alias("r"), same)
    return out.select(*(F.col(f"l.`{c}`") for c in df.columns), (F.col("__local") + F.col("__before")).alias("__n"))


def over_last_rows(df: DataFrame, keys: list[str], time: str, *order: str, last: int, rows: int = BLOCK_ROWS, **aggregates: Column) -> DataFrame:
    """df with aggregates over each row and the ``last`` - 1 rows of its group before it.

    Groups are cut into blocks of ``rows`` row numbers; the last rows of a block go to the next one as well.
    """
    rows = max(rows, last)
    numbered = block_numbers(df, keys, time, *order)
    own = F.floor((F.col("__n") - 1) / rows)
    next_too = F.pmod(F.col("__n") - 1, F.lit(rows)) >= rows - (last - 1)
    dealt = numbered.withColumn("__own", own).withColumn("__block", F.explode(F.when(next_too, F.array(own, own + 1)).otherwise(F.array(own))))
    window = Window.partitionBy(*keys, "__block").orderBy("__n").rowsBetween(1 - last, 0)
    out = dealt.select("*", *(c.over(window).alias(name) for name, c in aggregates.items()))
    return out.filter("__own = __block").drop("__n", "__own", "__block")


def over_last_seconds(df: DataFrame, keys: list[str], time: str, seconds: int, block: int = BLOCK_SECONDS, **aggregates: Column) -> DataFrame:
    """df with aggregates over the rows of each row's group that are at most so many seconds older, itself included.

    Groups are cut into blocks of time; rows that the next block's windows reach go there as well.
    """
    width = max(seconds, block) * 1_000_000
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    own = F.floor(micros / width)
    reached = micros >= (own + 1) * width - seconds * 1_000_000
    dealt = df.withColumns({"__at": micros, "__own": own}).withColumn("__block", F.explode(F.when(reached, F.array(own, own + 1)).otherwise(F.array(own))))
    window = Window.partitionBy(*keys, "__block").orderBy("__at").rangeBetween(-seconds * 1_000_000, 0)
    out = dealt.select("*", *(c.over(window).alias(name) for name, c in aggregates.items()))
    return out.filter("__own = __block").drop("__at", "__own", "__block")


def row_numbers(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """df with row numbers from 1 within each key, by ``order``: ranges of rows are numbered by themselves, and each adds what stands before it. df is written, so it should have the columns in need only."""
    rows = written(df.repartitionByRange(key, order).withColumn("__part", F.spark_partition_id()), "row-numbers")
    sizes = rows.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__own")).agg(F.count("*").alias("n"))
    before = sizes.select("__key", "__own", (F.sum("n").over(Window.partitionBy("__key").orderBy("__own")) - F.col("n")).alias("__before"))
    numbered = rows.withColumn("__at", F.row_number().over(Window.partitionBy(key, "__part").orderBy(order)))
    joined = numbered.join(F.broadcast(before), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__own")))
    return joined.select(*df.columns, (F.col("__before") + F.col("__at")).alias(name))
