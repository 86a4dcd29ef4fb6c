"""Chat export: rendered blocks, packed into parts of a size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.dates import between_months, spoken_day
from lorespark.functions.text import fmt_duration


def blocks(rows: DataFrame, fmt: str = "md") -> DataFrame:
    """Adds ``block`` (a message as text) and ``day_head`` (the heading its day needs); rows have who, sent_at, text, transcript, duration_s, has_voice, atts."""
    when = F.coalesce(F.date_format("sent_at", "HH:mm"), F.lit("--:--"))
    head = F.concat(F.lit("**"), F.col("who"), F.lit("** · "), when, F.lit("\n")) if fmt == "md" else F.concat(F.lit("["), when, F.lit("] "), F.col("who"), F.lit(":\n"))
    dur = fmt_duration("duration_s")
    said = F.length("transcript") > 0
    voice = (F.when(said, F.concat(F.lit("🎤 *Голосовое ("), dur, F.lit("):* "), F.col("transcript"))).when(F.col("has_voice"), F.concat(F.lit("🎤 *Голосовое ("), dur, F.lit(") — без расшифровки*")))
             if fmt == "md" else F.when(said, F.concat(F.lit("[голосовое "), dur, F.lit("] "), F.col("transcript"))).when(F.col("has_voice"), F.concat(F.lit("[голосовое "), dur, F.lit(", без расшифровки]"))))
    atts = F.when(F.size("atts") > 0, F.array_join(F.transform("atts", lambda a: F.concat(F.lit("["), a, F.lit("]"))), ", "))
    body = F.concat_ws("\n", F.when(F.length("text") > 0, F.col("text")), voice, atts)
    day = F.concat(F.lit("## "), spoken_day("sent_at"), F.lit("\n\n"))
    day = day if fmt == "md" else F.regexp_replace(day, "[#*]", "")
    return rows.withColumn("block", F.concat(head, F.when(F.length(body) > 0, body).otherwise("*(пусто)*"), F.lit("\n\n"))).withColumn("day_head", F.coalesce(day, F.lit("")))


def parts(blocked: DataFrame, keys: list[str], order: list[Column], cap: int, head: int = 0, cont: int = 0) -> DataFrame:
    """Adds ``part`` and ``shown`` (the block with the day's heading where the day changes or a part begins).

    A part is closed when the next block would take it over ``cap`` bytes (0: never); ``head`` and ``cont`` are
    the sizes of the first and of later parts' own headings.  Rows stream through in order; nothing but the
    running size is held.
    """
    names = [f.name for f in blocked.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocked.schema) + ", part int, shown string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, part, size, prev = None, 1, 0, None
        for pdf in batches:
            ps, shown = [], []
            for k, block, day in zip(pdf[keys].itertuples(index=False, name=None), pdf.block, pdf.day_head, strict=True):
                if k != key:
                    key, part, size, prev = k, 1, head, None
                text = (day if day != prev else "") + block
                if cap and size + len(text.encode()) > cap:
                    part, size, text = part + 1, cont, day + block
                size, prev = size + len(text.encode()), day
                ps.append(part)
                shown.append(text)
            yield pdf.assign(part=ps, shown=shown)

    ordered = blocked.repartition(*keys).sortWithinPartitions(*keys, *order).select(*names)
    return ordered.mapInPandas(run, schema)


def write_parts(parted: DataFrame, keys: list[str], order: list[Column], path: str) -> None:
    """One text file per key and part, by the commit protocol."""
    (parted.repartition(*keys, "part").sortWithinPartitions(*keys, "part", *order).select(*keys, "part", F.regexp_replace("shown", "\n+$", "").alias("value")).write.mode("overwrite").partitionBy(*keys, "part").text(path))


def dump(messages: DataFrame, dialogs: DataFrame, peer: int, since: tuple[int, int], until: tuple[int, int]) -> DataFrame:
    """(line) of one dialog's months in order: a header with the name, the months and the number of messages, then a line a message.  Sorted; write it as text."""
    m = messages.where((F.col("peer_id") == peer) & between_months("sent_at", since, until))
    who = F.when(F.col("is_own"), "Я").when(F.coalesce(F.trim("sender"), F.lit("")) != "", F.col("sender")).otherwise("?")
    rows = m.select(F.lit(1).alias("o"), "sent_at", "vk_msg_id", "id", F.concat(F.date_format("sent_at", "yyyy-MM-dd HH:mm"), F.lit(" "), who, F.lit(": "), F.replace("text", F.lit("\n"), F.lit(" "))).alias("line"))
    span = f"{since[0]}-{since[1]:02d} – {until[0]}-{until[1]:02d}"
    name = dialogs.where(F.col("peer_id") == peer).agg(F.first("name").alias("name"))
    null = F.lit(None)
    head = m.agg(F.count("*").alias("n")).crossJoin(F.broadcast(name)).select(F.lit(0).alias("o"), null.cast("timestamp").alias("sent_at"), null.cast("long").alias("vk_msg_id"), null.cast("long").alias("id"),  # one row each
                                                                             F.concat(F.lit("# "), F.coalesce("name", F.lit("?")), F.lit(f", {span}, сообщений: "), "n").alias("line"))
    return head.unionByName(rows).orderBy("o", "sent_at", "vk_msg_id", "id").select("line")


def day_changes(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    day = F.to_date("sent_at")
    return rows.withColumn("new_day", ~F.coalesce(day.eqNullSafe(F.lag(day).over(Window.partitionBy(*keys).orderBy(*order))), F.lit(False)))
