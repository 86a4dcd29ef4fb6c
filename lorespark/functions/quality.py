"""Transcript quality: repeats and their judgement, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorespark.functions.text import as_col, words

# Words that living speech repeats.
FILLERS = "ха хах хе хи хо ах ох ой эх ня не нет да вот ну а и то так эм м мм".split()


def repetition_stats(c: Column | str) -> Column:
    """struct<best, word, share, n>: longest run of one word, the first word to reach it, its share of all words, their number."""
    w = words(F.coalesce(as_col(c), F.lit("")))
    start = F.struct(F.lit(0).alias("best"), F.lit("").alias("word"), F.lit(0).alias("run"), F.lit("").alias("prev"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x == s["prev"], s["run"] + 1).otherwise(1)
        return F.struct(F.greatest(s["best"], run).alias("best"), F.when(run > s["best"], x).otherwise(s["word"]).alias("word"), run.alias("run"), x.alias("prev"))

    return F.aggregate(w, start, step, lambda s: F.struct(s["best"].alias("best"), s["word"].alias("word"),
                                                         F.when(F.size(w) > 0, s["best"] / F.size(w)).otherwise(0.0).alias("share"), F.size(w).alias("n")))


def is_suspect(stats: Column) -> Column:
    """A recogniser caught in a loop rather than lively speech."""
    return (F.when(stats["best"] >= 15, True).when(stats["word"].isin(*FILLERS), False).when(stats["best"] >= 7, True)
            .otherwise((stats["best"] >= 4) & (stats["share"] > 0.3) & (stats["n"] >= 30)))


def is_useless(own: Column | str, total: Column | str) -> Column:
    own, total = as_col(own), as_col(total)
    return (own < 30) & (F.when(total > 0, own / total).otherwise(0.0) < 0.02)
