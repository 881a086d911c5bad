"""Sequence operators as windows and folds: clusters, runs, fills, next starts, steps, firsts and lasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_clusters(rows: DataFrame, group: list[str], value: str, gap: float) -> DataFrame:
    """Adds ``cluster``: values in order, a new cluster where the step from the one before is above ``gap``."""
    order = Window.partitionBy(*group).orderBy(value)
    new = F.when(F.col(value) - F.lag(value).over(order) > gap, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def runs(rows: DataFrame, group: list[str], order: str, key: str, gap: int) -> DataFrame:
    """(group, key, start, end, n) of runs of one key whose places are at most ``gap`` apart."""
    inside = Window.partitionBy(*group, key).orderBy(order)
    new = F.when(F.col(order) - F.lag(order).over(inside) > gap, 1).otherwise(0)
    numbered = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, key, "_run").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("_run")


def fill_both(rows: DataFrame, group: list[str], order: str, value: str) -> Column:
    """The last known value, or before the first one that."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*group).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return F.coalesce(F.last(value, ignorenulls=True).over(before), F.first(value, ignorenulls=True).over(after))


def extents(markers: DataFrame, group: list[str], start: str, last: Column) -> DataFrame:
    """Adds ``end_at``: one before the next start of the group, at least the own start, or ``last``."""
    order = Window.partitionBy(*group).orderBy(start)
    return markers.withColumn("end_at", F.coalesce(F.greatest(F.lead(start).over(order) - 1, F.col(start)), last))


def accepted_steps(rows: DataFrame, group: str, order: str, number: str, step: int) -> DataFrame:
    """(group, accepted): numbers in order, each kept if it is above the last kept one by at most ``step``; the first always."""
    listed = rows.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(number).alias("n")))), lambda x: x["n"]).alias("ns"))

    def keep(acc, n):
        last = F.try_element_at(acc, F.lit(-1))
        return F.when(last.isNull() | ((n > last) & (n <= last + step)), F.concat(acc, F.array(n))).otherwise(acc)

    return listed.select(group, F.aggregate("ns", F.array().cast("array<bigint>"), keep).alias("accepted"))


def keep_first(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def last_rows(rows: DataFrame, group: list[str], order: str, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(order)))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def modal_first(rows: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """(group, value, n): the most frequent value, of equals the one seen first."""
    counted = rows.groupBy(*group, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    if not group:
        return counted.orderBy(F.desc("n"), "_first").limit(1).drop("_first")
    return keep_first(counted, group, F.desc("n"), F.col("_first")).drop("_first")


def deepest_cover(points: DataFrame, spans: DataFrame, cell: int) -> DataFrame:
    """(point, id): of the spans that hold a point the deepest, of equals the last. Takes points (group, place) and spans (group, id, start, end, level, seq).

    Spans are cut into cells of ``cell`` places, so that the join is an equi-join on (group, cell) and not on ranges.
    """
    cut = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("end") / cell))))
    held = points.withColumn("cell", F.floor(F.col("place") / cell)).join(cut, ["group", "cell"]).where("place between start and end")
    return held.groupBy("group", "place").agg(F.max_by("id", F.struct("level", "seq")).alias("id"))


def numbered(rows: DataFrame, lead: str, *rest: str, name: str = "place") -> DataFrame:
    """Adds the place of each row in the order of ``lead`` (a number, not null) and ``rest``.

    Rows are dealt by ranges of ``lead`` found at its quantiles and numbered inside each; only counts of ranges meet in one task.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(F.col(lead).cast("double"), F.array(*[F.lit(k / n) for k in range(1, n)]), F.lit(1000)) if n > 1 else F.lit(None)).first()[0]
    bounds = F.array(*[F.lit(float(x)) for x in sorted(set(cuts or []))]).cast("array<double>")
    dealt = rows.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= F.col(lead).cast("double"))))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(lead, *rest))
    return dealt.withColumn(name, inside).join(F.broadcast(starts), "_range").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_range", "_before")


def nearest(asked: DataFrame, held: DataFrame, place: str, value: str, name: str, wide: float) -> DataFrame:
    """(place, name, diff): the row of ``held`` whose value is nearest to each place, at most ``wide`` away, of equals the least name.

    Both sides are cut into cells as wide as ``wide``; a place stands in three of them and meets there the last value up to it and the
    first from it on, by windows in the order of values. So no place is paired with all values of a cell. Values and places are distinct.
    """
    # In one cell: values and places in one order.
    cell = lambda c: F.floor(F.col(c) / wide)
    a = asked.select(F.explode(F.array(*[cell(place) + k for k in (-1, 0, 1)])).alias("_cell"), F.col(place).alias("_at"), F.lit(None).cast(held.schema[name].dataType).alias("_name"), F.lit(True).alias("_asks"))
    b = held.select(cell(value).alias("_cell"), F.col(value).alias("_at"), F.col(name).alias("_name"), F.lit(False).alias("_asks"))
    seen = F.when(~F.col("_asks"), F.struct(F.col("_at").alias("value"), F.col("_name").alias("name")))
    so_far = lambda order: F.last(seen, ignorenulls=True).over(Window.partitionBy("_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = a.unionByName(b).withColumn("_below", so_far((F.asc("_at"), F.asc("_asks")))).withColumn("_above", so_far((F.desc("_at"), F.asc("_asks")))).where("_asks")
    pair = rows.select(F.col("_at").alias(place), F.explode(F.array("_below", "_above")).alias("_v")).where("_v is not null")
    pair = pair.select(place, F.col("_v.name").alias(name), F.abs(F.col("_v.value") - F.col(place)).alias("diff")).where(F.col("diff") <= wide)
    return pair.groupBy(place).agg(F.min_by(name, F.struct("diff", name)).alias(name), F.min("diff").alias("diff"))
