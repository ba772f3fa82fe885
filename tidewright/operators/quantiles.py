"""Exact quantiles of groups by distributed selection: rounds of counting in ever narrower ranges, for all groups at once.

A group's values are never gathered. Each round cuts the range that holds a wanted rank into BUCKETS parts, counts the
rows of each part by partial aggregation, and goes on with the part that holds the rank, from its least to its greatest
value; ranges of one value are done. Whatever the size of a group, no task holds more of it than BUCKETS rows a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import col, num
from ..sources.scratch import stored

#: Parts of a range in each round.
BUCKETS = 256
#: A range of one sign whose ends differ by more than this factor is cut by logarithms.
_WIDE = 1e6
MAX_ROUNDS = 100


def _bucket(buckets: int) -> Column:
    """The part of lo..hi that v falls into: never less for a greater v, and different for lo and hi."""
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")

    def share(part: Column) -> Column:
        return F.least(F.greatest(F.floor(part * buckets), F.lit(0)), F.lit(buckets - 1)).cast("int")

    endless = F.lit(float("inf"))
    by_log = share((F.log(F.abs(v)) - F.log(F.abs(lo))) / (F.log(F.abs(hi)) - F.log(F.abs(lo))))
    wide = F.greatest(F.abs(lo), F.abs(hi)) / _WIDE > F.least(F.abs(lo), F.abs(hi))
    return (
        F.when((lo == -endless) | (hi == endless), F.when(v == -endless, 0).when(v == endless, 2).otherwise(1))
        .when((lo <= 0) & (hi >= 0), F.signum(v).cast("int") + 1)
        .when(wide, by_log)
        .otherwise(share((v - lo) / (hi - lo)))
    )


def exact_quantiles(df: DataFrame, group_by: str, value: str, at: list[float], buckets: int = BUCKETS) -> DataFrame:
    """(key, n, min, max, q): per group the number, least and greatest of its values, and its quantiles, interpolated between neighbours.

    Values that are no numbers are left out; a group without any has null quantiles. Equal to an exact percentile.
    """
    rows = df.select(col(group_by).alias("key"), num(df, value).alias("v"))
    groups = stored(rows.groupBy("key").agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max")), "groups")
    places = F.array(*[f((F.col("n") - 1) * p).cast("long") for p in at for f in (F.floor, F.ceil)])
    ranks = stored(groups.where("n > 0").select("key", F.explode(F.array_distinct(places)).alias("rank")), "ranks")
    # (key, lo, hi, before): ranges that hold wanted ranks, and how many values of the group lie below
    ranges = stored(groups.where("n > 0").selectExpr("key", "min as lo", "max as hi", "0L as before", "n"), "ranges")
    done = []
    for _ in range(MAX_ROUNDS):
        done.append(ranges.where("lo = hi"))
        open_ = ranges.where("lo < hi").drop("n")
        if open_.isEmpty():
            break
        inside = rows.alias("r").join(open_.alias("o"), F.col("r.key").eqNullSafe(F.col("o.key")) & F.col("v").between(F.col("lo"), F.col("hi"))).select("o.key", "lo", "hi", "before", "v")
        counts = inside.groupBy("key", "lo", "hi", "before", _bucket(buckets).alias("bucket")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        below = F.sum("n").over(Window.partitionBy("key", "lo", "hi").orderBy("bucket")) - F.col("n")  # over `buckets` rows at most
        parts = counts.select("key", F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("before") + below).alias("before"), "n")
        holds = F.col("p.key").eqNullSafe(F.col("w.key")) & (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
        ranges = stored(parts.alias("p").join(ranks.alias("w"), holds, "left_semi"), "ranges")
    else:
        raise RuntimeError(f"quantiles are not settled after {MAX_ROUNDS} rounds")
    found = done[0]
    for part in done[1:]:
        found = found.union(part)
    holds = F.col("f.key").eqNullSafe(F.col("w.key")) & (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
    values = ranks.alias("w").join(found.alias("f"), holds).select("w.key", F.struct("rank", F.col("lo").alias("v")).alias("at"))
    by_rank = values.groupBy("key").agg(F.map_from_entries(F.collect_list("at")).alias("at"))  # as many entries as ranks were asked for
    joined = groups.alias("g").join(by_rank.alias("b"), F.col("g.key").eqNullSafe(F.col("b.key")), "left").select("g.*", "at")

    def quantile(p: float) -> Column:
        place = (F.col("n") - 1) * p
        low, high = (F.col("at")[f(place).cast("long")] for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return joined.select("key", "n", "min", "max", F.when(F.col("n") > 0, F.array(*map(quantile, at))).alias("q"))
