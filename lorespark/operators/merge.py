"""Keyed merges on immutable snapshots: each returns the new table, to be written to a new path."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str] | None = None, when: Column | None = None, expr: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``new`` replace or join those of ``old``.

    ``update``: the columns that a match overwrites (default: all but the keys).  ``when``: a condition on the
    old row (columns under alias ``old``) for a match to overwrite.  ``expr``: values other than the new ones,
    over the aliases ``old`` and ``new``.  ``new`` must have one row per key; null keys match nothing.
    """
    o, n = old.withColumn("__o", F.lit(True)).alias("old"), new.withColumn("__n", F.lit(True)).alias("new")
    cond = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    both = o.join(n, cond, "full")
    hit = F.col("old.__o").isNotNull() & F.col("new.__n").isNotNull()
    over = hit & F.coalesce(when, F.lit(False)) if when is not None else hit
    update = [c for c in new.columns if c not in keys] if update is None else update
    out = []
    for c in old.columns:
        fresh = (expr or {}).get(c, F.col(f"new.{c}") if c in new.columns else F.lit(None))
        stale = F.col(f"old.{c}")
        if c in keys:
            out.append(F.coalesce(stale, F.col(f"new.{c}")).alias(c))
        elif c in new.columns:
            kept = F.when(over, fresh).otherwise(stale) if c in update else stale
            out.append(F.when(F.col("old.__o").isNull(), F.col(f"new.{c}")).otherwise(kept).alias(c))
        else:
            out.append(stale.alias(c))
    return both.select(*out)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def delete_stale(old: DataFrame, fresh_keys: DataFrame, keys: list[str], scope: Column) -> DataFrame:
    """Rows inside the scope stay only if their key is among the fresh ones; rows outside stay."""
    inside = F.coalesce(scope, F.lit(False))
    return old.where(~inside).unionByName(old.where(inside).join(fresh_keys.select(*keys).distinct(), keys, "left_semi").select(*old.columns))


def guarded_wipe(old: DataFrame, scope: Column, independent: DataFrame) -> DataFrame:
    """Drop the scope only if an independent count finds nothing that would belong there."""
    left = independent.limit(1).count()
    if left:
        raise ValueError("the control query still finds rows for the scope; nothing is deleted")
    return old.where(~F.coalesce(scope, F.lit(False)))


def refresh(old: DataFrame, fresh: DataFrame, keys: list[str], scope: Column) -> DataFrame:
    """Incremental refresh: new keys come in, rows whose key exists stay as they are (their embedding is kept), and rows of the scope whose key is gone leave."""
    return insert_ignore(delete_stale(old, fresh, keys, scope), fresh, keys)


def rebuild(old: DataFrame, fresh: DataFrame, peers: DataFrame, source: str) -> DataFrame:
    """All rows of one source and of the given peers give way to the fresh ones of those peers."""
    mine = peers.select("peer_id").distinct()
    other = old.where(~F.coalesce(F.col("source") == source, F.lit(False))).unionByName(old.where(F.col("source") == source).join(mine, "peer_id", "left_anti").select(*old.columns))
    return other.unionByName(fresh.where(F.col("source") == source).join(mine, "peer_id", "left_semi").select(*old.columns))


def insert_where_none(old: DataFrame, stage: DataFrame, messages: DataFrame) -> DataFrame:
    """Attachments of ``stage`` (by peer_id and vk_msg_id) join those of ``old``, only for messages that have none yet.

    Returns old's columns without id, which the store gives; a staged row of an unknown message is left out.
    """
    bare = messages.select("peer_id", "vk_msg_id", F.col("id").alias("message_id")).join(old.select("message_id").distinct(), "message_id", "left_anti")
    cols = [c for c in old.columns if c != "id"]
    return old.select(*cols).unionByName(stage.join(bare, ["peer_id", "vk_msg_id"]).select(*cols))


def merge_meta(meta: Column, patch: dict[str, object]) -> Column:
    """JSON object with the keys of the patch set, the right side winning; other values keep their type.  Text that is no object counts as empty."""
    m = F.coalesce(F.from_json(meta, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    kept = F.map_filter(m, lambda k, _: ~k.isin(*patch))
    return F.to_json(F.map_concat(kept, F.create_map(*[x for k, v in patch.items() for x in (F.lit(k), F.parse_json(F.lit(json.dumps(v, ensure_ascii=False))))])))


def violations(df: DataFrame, keys: list[str], allowed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(rule, n) of broken integrity rules: repeated keys, values out of range."""
    dup = df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("unique " + ",".join(keys)).alias("rule"), "n")
    for c, vals in (allowed or {}).items():
        dup = dup.unionByName(df.where(F.col(c).isNotNull() & ~F.col(c).isin(*vals)).agg(F.count("*").alias("n")).select(F.lit(f"check {c}").alias("rule"), "n"))
    return dup
