"""Preparation of voice recognition: clusters of voice messages and the context around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import clean_snippet

GAP, CAP, SPAN = 12, 8, 8


def positions(messages: DataFrame, page: list[str], order: list[Column]) -> DataFrame:
    """pos: place of a message on its page, oldest first; a page is bounded."""
    return messages.withColumn("pos", F.row_number().over(Window.partitionBy(*page).orderBy(*order)) - 1)


def clusters(placed: DataFrame, page: list[str], voice: Column, gap: int = GAP, cap: int = CAP) -> DataFrame:
    """Voice messages with their cluster: neighbours at most ``gap`` places apart, at most ``cap`` in one.

    Only neighbouring distances are tested, so a run is numbered and cut every ``cap`` rows.
    """
    w = Window.partitionBy(*page).orderBy("pos")
    v = placed.where(voice).withColumn("__new", F.when(F.col("pos") - F.lag("pos").over(w) <= gap, 0).otherwise(1))
    v = v.withColumn("run", F.sum("__new").over(w)).drop("__new")
    n = F.row_number().over(Window.partitionBy(*page, "run").orderBy("pos")) - 1
    return v.withColumn("cluster", F.floor(n / cap))


def batches(clustered: DataFrame, page: list[str], peer: str, msg: str, ts: str) -> DataFrame:
    """One row per cluster: key <peer>-<first>-<last>, its places, its first date."""
    at = lambda c: F.struct("pos", c)
    g = clustered.groupBy(*page, "run", "cluster").agg(F.min(at(msg)).alias("a"), F.max(at(msg)).alias("b"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n"),
                                                       F.min_by(F.date_format(ts, "yyyy-MM-dd"), F.when(F.col(ts).isNotNull(), F.col("pos"))).alias("batch_date"))
    return g.withColumn("batch_key", F.concat_ws("-", peer, f"a.{msg}", f"b.{msg}")).drop("a", "b")


def context(placed: DataFrame, batch: DataFrame, page: list[str], span: int = SPAN, lines: int = 60, chars: int = 120) -> DataFrame:
    """(batch_key, context): the messages around each cluster, the last ``lines`` of them, cut to ``chars``.

    A batch covers few blocks of ``span`` places, so places join batches by block.
    """
    b = batch.select(*page, "batch_key", (F.col("lo") - span).alias("lo"), (F.col("hi") + span).alias("hi")).withColumn("blk", F.explode(F.sequence(F.floor(F.col("lo") / span), F.floor(F.col("hi") / span))))
    p = placed.withColumn("blk", F.floor(F.col("pos") / span))
    j = p.join(b, [*page, "blk"]).where(F.col("pos").between(F.col("lo"), F.col("hi")) & (F.length("text") > 0))
    line = F.concat(F.coalesce("sender", F.lit("?")), F.lit(": "), F.substring(F.regexp_replace("text", "\n", " "), 1, chars))
    got = j.groupBy("batch_key").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("ls"))  # at most a cluster and its surroundings
    tail = F.when(F.size("ls") > lines, F.slice("ls", F.size("ls") - lines + 1, lines)).otherwise(F.col("ls"))
    return got.select("batch_key", F.array_join(F.transform(tail, lambda x: x["line"]), "\n").alias("context"))


def neighbour_snippets(placed: DataFrame, page: list[str], reach: int = 2, most: int = 3) -> DataFrame:
    """The message itself and its neighbours, cleaned: the first ``most`` longer than three characters."""
    w = Window.partitionBy(*page).orderBy("pos").rowsBetween(-reach, reach)
    raw = F.collect_list(F.when(F.length("text") > 0, F.col("__snip"))).over(w)
    return placed.withColumn("__snip", clean_snippet(F.substring("text", 1, 60))).withColumn("snippets", F.slice(F.filter(raw, lambda s: F.length(s) > 3), 1, most)).drop("__snip")
