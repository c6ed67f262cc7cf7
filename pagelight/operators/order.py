"""Order over a whole table without one task that sees it: numbering, running values, order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

BINS = 1024
FEW = 20_000  # values of a range that are ordered as they are
SMALL = 100_000  # ranges up to which they are broadcast


def ranged(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """df in ranges of `order`, written with each row's range as `place`."""
    return written(df.repartitionByRange(*order).withColumn("place", F.spark_partition_id()), "ranges")


def _before(places: DataFrame, fold) -> DataFrame:
    """(place, before): fold of all earlier places; one row a place comes together, as many as there are ranges."""
    held = places.agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("held"))
    earlier = lambda p: F.transform(F.filter("held", lambda h: h["place"] < p), lambda h: h["x"])
    return places.select("place").crossJoin(F.broadcast(held)).select("place", fold(earlier(F.col("place"))).alias("before"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with 1..n in the order of some columns: places in a range, after the counts of the ranges before it.

    Rows that are equal in all order columns get their numbers in no order."""
    rows = ranged(df, order)
    counts = rows.groupBy("place").agg(F.count("*").alias("x"))
    offset = _before(counts, lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x))
    at = F.row_number().over(Window.partitionBy("place").orderBy(*order))
    return rows.withColumn(name, at).join(F.broadcast(offset), "place").withColumn(name, F.col(name) + F.col("before")).drop("place", "before")


def best_so_far(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """df with the largest `value` of the rows before in the order of a column that has no value twice; null for the first."""
    rows = ranged(df, [order])
    top = _before(rows.groupBy("place").agg(F.max(value).alias("x")), F.array_max)
    here = F.max(value).over(Window.partitionBy("place").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_here", here).join(F.broadcast(top), "place").withColumn(name, F.greatest("_here", "before")).drop("place", "before", "_here")


def order_statistics(df: DataFrame, by: str, value: str, places: dict[str, Column], few: int | None = None) -> DataFrame:
    """(by, n, a column a place): the values at given places (from 0, expressions of the count n) of each group's sorted
    ones; nulls, and NaN, aren't values. Exact.

    Counts over BINS equal parts of a range of values say in which part a place lies; that part is the next range,
    until it holds few values or one value alone. Counts combine before their shuffle; no task sorts or
    holds a group, only a range of at most `few` values, or as many counts as there are distinct ones in it."""
    few = FEW if few is None else few
    # a group as a structure: null is a group like any other, and structures of nulls are equal in a join
    data = df.select(F.struct(F.col(by).alias("of")).alias(by), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    sizes = written(data.groupBy(by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "sizes")
    place = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), p.cast("long").alias("place")) for k, p in places.items()])).alias("x")
    # a target: the place sought inside a range lo..hi, before which `below` values lie
    targets = sizes.select(by, "lo", "hi", F.col("n").alias("inside"), F.lit(0).cast("long").alias("below"), place).select("*", "x.*").drop("x").where("place >= 0 and place < inside")
    targets = written(targets, "targets")
    done = []
    while True:
        done.append(targets.where("lo = hi").select(by, "key", F.col("lo").alias("v")))
        targets = targets.where("lo < hi")
        if not targets.where(F.col("inside") > few).limit(1).count():
            break
        ranges = targets.select(by, "lo", "hi").distinct()
        share = F.nanvl((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2), F.lit(1.5 / BINS))  # NaN: between infinities
        part = F.when(F.col("v") == F.col("hi"), BINS - 1).when(F.col("v") == F.col("lo"), 0).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1))).cast("int")
        inside = data.join(_some(ranges), by).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        bins = inside.groupBy(by, "lo", "hi", part.alias("part")).agg(F.count("*").alias("c"), F.min("v").alias("new_lo"), F.max("v").alias("new_hi"))
        upto = F.sum("c").over(Window.partitionBy(by, "lo", "hi").orderBy("part"))
        bins = bins.withColumn("upto", upto)
        found = targets.join(bins, [by, "lo", "hi"]).where((F.col("place") < F.col("below") + F.col("upto")) & (F.col("place") >= F.col("below") + F.col("upto") - F.col("c")))
        targets = written(found.select(by, "key", "place", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), F.col("c").alias("inside"), (F.col("below") + F.col("upto") - F.col("c")).alias("below")), "targets")
    ranges = targets.select(by, "lo", "hi").distinct()
    counts = data.join(_some(ranges), by).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).groupBy(by, "lo", "hi", "v").agg(F.count("*").alias("c"))
    counts = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(by, "lo", "hi").orderBy("v")))
    last = targets.join(counts, [by, "lo", "hi"]).where((F.col("place") < F.col("below") + F.col("upto")) & (F.col("place") >= F.col("below") + F.col("upto") - F.col("c"))).select(by, "key", "v")
    for part in done:
        last = last.unionByName(part)
    wide = last.groupBy(by).agg(*[F.max(F.when(F.col("key") == k, F.col("v"))).alias(k) for k in places])
    return sizes.select(by, "n").join(wide, by, "left").select(F.col(by)["of"].alias(by), "n", *places)


def _some(ranges: DataFrame) -> DataFrame:
    return F.broadcast(ranges) if ranges.limit(SMALL + 1).count() <= SMALL else ranges


def linear_percentiles(df: DataFrame, by: str, value: str, qs: dict[str, float], few: int | None = None) -> DataFrame:
    """(by, n, a column a name): percentiles with linear interpolation between neighbours, from order statistics."""
    n = F.col("n")
    at = {name: (n - 1) * q for name, q in qs.items()}
    places = {f"{name}_{side}": f(at[name]) for name in qs for side, f in (("lo", F.floor), ("hi", F.ceil))}
    out = order_statistics(df, by, value, places, few)
    between = lambda name: F.col(f"{name}_lo") + (at[name] - F.floor(at[name])) * (F.col(f"{name}_hi") - F.col(f"{name}_lo"))
    return out.select(by, "n", *[between(name).alias(name) for name in qs])
