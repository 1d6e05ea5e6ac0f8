"""Running sums, row numbers, values before a row and values at a place, of groups of any size: no group is sorted by one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.sources.folders import keep, scratch

#: Parts into which rows are cut by their order, cells into which a range is cut, and groups up to which their ranges are broadcast.
PARTS, CELLS, FEW_GROUPS = 64, 4096, 1 << 16


def _parts(rows: DataFrame, order: str) -> Column:
    """The part of PARTS that a row lies in, cut at quantiles of `order`."""
    splits = sorted(set(rows.approxQuantile(order, [i / PARTS for i in range(1, PARTS)], 0.005)))
    return F.size(F.filter(F.array(*map(F.lit, splits)), lambda s: s <= F.col(order))) if splits else F.lit(0)


def previous(rows: DataFrame, by: list[str], order: str, value: Column, name: str) -> DataFrame:
    """rows with the last `value` that isn't null of those before them in their group, by a number `order` that no two rows of a group share.

    Each part of a group looks back by itself; what the parts before it leave comes from one value a part.
    """
    cut = rows.withColumn("__part", _parts(rows, order)).withColumn("__value", value)
    lasts = cut.filter("__value is not null").groupBy(*by, "__part").agg(F.max_by("__value", order).alias("__last"))
    places = cut.select(*by, "__part").distinct().join(lasts, [*by, "__part"], "left")
    back = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    carried = places.select(*by, "__part", F.last("__last", True).over(back(Window.partitionBy(*by).orderBy("__part"))).alias("__carried"))
    own = F.last("__value", True).over(back(Window.partitionBy(*by, "__part").orderBy(order)))
    return cut.withColumn("__own", own).join(carried, [*by, "__part"]).withColumn(name, F.coalesce("__own", "__carried")).select(*rows.columns, name)


def running(rows: DataFrame, by: list[str], order: str, value: Column, name: str, tie: list[Column] = []) -> DataFrame:
    """rows with the sum of `value` over the rows of their group up to and with their own, by a number `order`, then `tie`.

    Rows are cut at quantiles of `order` into PARTS parts; each part of a group is summed and numbered by itself, and what lies before a part comes from
    the sums. Without ties in all of the order, rows that tie are numbered in any order.
    """
    cut = rows.withColumn("__part", _parts(rows, order)).withColumn("__value", value)
    sums = cut.groupBy(*by, "__part").agg(F.sum("__value").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.sum("__value").over(Window.partitionBy(*by, "__part").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("__own", own).join(sums.select(*by, "__part", before.alias("__before")), [*by, "__part"]).withColumn(name, F.col("__before") + F.col("__own")).select(*rows.columns, name)


def numbered(rows: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """rows with their number in their group, from 1, by a number `order`."""
    return running(rows, by, order, F.lit(1), name)


def at_places(rows: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """by and, for each name, the value at a place of the group in ascending order (from 1; made of the group's number of values); a name's
    value is null where its place is outside. Null and NaN count for nothing; groups without a value have no row.

    Exact, by histograms: the range that holds a place is cut into CELLS cells, counted, and narrowed to the values of the place's cell, until
    they are one value. What is held for a group doesn't grow with its values.
    """
    v = rows.select(*by, F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    spark, at, number = rows.sparkSession, scratch(rows.sparkSession, "places"), 0
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), f(F.col("n")).cast("long").alias("place")) for n, f in places.items()])
    first = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = keep(first.select(*by, "n", F.inline(wanted), "lo", "hi").filter("place between 1 and n").drop("n"), f"{at}/0")
    while True:
        left = state.filter("lo < hi")
        many = left.count()
        if not many:
            break
        met = v.join(F.broadcast(left) if many <= FEW_GROUPS else left, by)
        share = F.nanvl((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.5))
        cell = F.when(F.col("v") == F.col("hi"), CELLS - 1).when(F.col("v") == F.col("lo"), 0).otherwise(F.floor(share * (CELLS - 1)))
        cells = met.filter("v between lo and hi").groupBy(*by, "name", "place", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "name").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        nearer = cells.withColumn("before", before).filter("place > before and place <= before + n").select(*by, "name", (F.col("place") - F.col("before")).alias("place"), "lo", "hi")
        number += 1
        state = keep(state.filter("lo = hi").unionByName(nearer), f"{at}/{number}")
    return state.groupBy(*by).agg(*[F.max(F.when(F.col("name") == n, F.col("lo"))).alias(n) for n in places])
