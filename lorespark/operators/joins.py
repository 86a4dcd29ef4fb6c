"""Joins that are not plain equalities, as equalities plus aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def asof_latest(left: DataFrame, right: DataFrame, key: str, at: str, valid_from: str, take: list[str]) -> DataFrame:
    """Each left row with the right row of its key that is latest at or before ``at``, else the earliest one.

    The right side has few rows per key (validity periods), so it is gathered into one sorted array per key
    and the join is an equality; a left row without ``at`` gets nulls.
    """
    periods = right.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(valid_from), *take))).alias("__p"))
    hit = F.coalesce(F.try_element_at(F.filter("__p", lambda p: p[valid_from] <= F.col(at)), F.lit(-1)), F.try_element_at("__p", F.lit(1)))
    out = left.join(periods, key, "left").withColumn("__h", F.when(F.col(at).isNotNull(), hit))
    return out.select(*left.columns, *[F.col(f"__h.{c}").alias(c) for c in take])


def epoch_label(at: Column, boundaries: list[tuple[str, str]], last: str) -> Column:
    """Label of the first boundary that ``at`` is before; a constant list of boundaries becomes one expression."""
    out = None
    for stamp, label in boundaries:
        c = at < F.to_timestamp(F.lit(stamp))
        out = F.when(c, label) if out is None else out.when(c, label)
    return F.when(at.isNotNull(), out.otherwise(last)) if out is not None else F.lit(last)


def band_join(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, days: int) -> DataFrame:
    """Rows of equal keys whose dates differ by at most ``days``: an equality on day buckets, each left row in three."""
    width = days + 1
    lb = left.withColumn("__day", F.datediff(a, F.lit("1970-01-01"))).withColumn("__b", F.explode(F.sequence(F.floor((F.col("__day") - days) / width), F.floor((F.col("__day") + days) / width))))
    rb = right.withColumn("__b", F.floor(F.datediff(b, F.lit("1970-01-01")) / width))
    return lb.join(rb, [*keys, "__b"]).where(F.abs(F.datediff(a, b)) <= days).drop("__b", "__day")


def semi_any(df: DataFrame, key: str, *sides: DataFrame) -> DataFrame:
    """Rows whose key is in any side: EXISTS OR EXISTS as one semi join with the union of keys."""
    keys = sides[0].select(key)
    for s in sides[1:]:
        keys = keys.unionByName(s.select(key))
    return df.join(keys.distinct(), key, "left_semi")


def points_in(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, lo: str, hi: str) -> DataFrame:
    """Pairs of a point and an interval of its key that holds it; lo and hi are inclusive integers.

    An interval shorter than 2**L lies in one or two aligned blocks of that size, so both sides meet by
    equality on (keys, L, block); a point takes part once per level that occurs, at most 64.  Intervals with
    a null end or lo > hi hold nothing.
    """
    iv = intervals.where(F.col(lo) <= F.col(hi)).withColumn("__l", F.ceil(F.log2(F.col(hi) - F.col(lo) + 2)).cast("int"))
    used = sorted(r[0] for r in iv.select("__l").distinct().collect())
    size = F.expr("shiftleft(1L, __l)")
    iv = iv.withColumn("__b", F.explode(F.array_distinct(F.array(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))))
    levels = F.array(*[F.lit(x) for x in used]).cast("array<int>")
    pts = points.withColumn("__l", F.explode(levels)).withColumn("__b", F.floor(F.col(point) / size))
    return pts.join(iv, [*keys, "__l", "__b"]).where(F.col(point).between(F.col(lo), F.col(hi))).drop("__l", "__b")
