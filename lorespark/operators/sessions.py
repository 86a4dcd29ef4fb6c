"""Sessions: events of one entity divided by silence, by pointer doubling.

All events of an entity inside one time bucket as wide as the gap belong to one session, so events
are first reduced to (entity, bucket) nodes, with map-side combining; a hot entity is spread over
its buckets.  A node links to the node one bucket earlier if its first event follows that node's last
one within the gap (no earlier node can be within the gap).  ``resolve_roots`` then squares the
links until every node points at the first node of its session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.session import Stage


def resolve_roots(links: DataFrame, keys: list[str], node: str = "node", ptr: str = "ptr", name: str = "roots") -> DataFrame:
    """Follow predecessor links to their ends by pointer doubling.

    ``links`` has one row (keys, node, ptr) per node that has a predecessor; nodes without one are
    roots and need no row.  Returns (keys, node, ptr) with ptr = the root.  Each round joins the
    links with themselves, so a chain of n links takes log2(n) rounds; rounds are written to the
    shared folder, and the loop ends when a round changes nothing.  An empty table gives an empty one.
    """
    stage = Stage(links.sparkSession, name)
    cur = stage.cut(links.select(*keys, node, ptr))
    while True:
        up = cur.select(*keys, F.col(node).alias(ptr), F.col(ptr).alias("__up"))
        nxt = stage.cut(cur.join(up, [*keys, ptr], "left")
                        .select(*keys, node, F.coalesce("__up", ptr).alias(ptr), F.col("__up").isNotNull().alias("__moved")))
        moved = nxt.where("__moved").limit(1).count()
        stage.drop(cur)
        cur = nxt
        if not moved:
            return cur.drop("__moved")


def _roots(nodes: DataFrame, gap: int) -> DataFrame:
    """(ent, node, ptr) of the nodes that do not start a session."""
    before = nodes.select("ent", (F.col("node") + 1).alias("node"), F.col("last.us").alias("prev_us"))
    links = (nodes.select("ent", "node", F.col("first.us").alias("us")).join(before, ["ent", "node"])
             .where(F.col("us") - F.col("prev_us") <= gap)
             .select("ent", "node", (F.col("node") - 1).alias("ptr")))
    return resolve_roots(links, ["ent"], name="session-links")


def session_roots(events: DataFrame, entity: str, ts: str, gap_seconds: int = 180 * 60) -> DataFrame:
    """(entity, node, root): the session of every bucket, floor(micros / gap), that has events."""
    gap = gap_seconds * 1_000_000
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    nodes = Stage(events.sparkSession, "session-nodes").cut(
        events.select(F.col(entity).alias("ent"), us.alias("us")).where("ent is not null and us is not null")
        .groupBy("ent", F.floor(F.col("us") / F.lit(gap)).cast("long").alias("node"))
        .agg(F.min(F.struct("us")).alias("first"), F.max(F.struct("us")).alias("last")))
    roots = _roots(nodes, gap)
    return nodes.join(roots, ["ent", "node"], "left").select(F.col("ent").alias(entity), "node", F.coalesce("ptr", "node").alias("root"))


def sessionize(events: DataFrame, entity: str, ts: str, event_id: str, gap_seconds: int = 180 * 60) -> DataFrame:
    """One row per session: (entity, first_id, last_id, started_at, ended_at, duration_s, n_events).

    Events are ordered by (ts, event_id); a session ends where the next event comes more than
    ``gap_seconds`` later.  Rows of equal (entity, event_id) count once, at their earliest ts.
    Rows whose entity, ts or event_id is null are left out; an empty table gives no session.
    Further columns are ignored, whatever their names.
    """
    gap = gap_seconds * 1_000_000
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    once = (events.select(F.col(entity).alias("ent"), F.col(event_id).alias("eid"), us.alias("us"))
            .where("ent is not null and eid is not null and us is not null")
            .groupBy("ent", "eid").agg(F.min("us").alias("us")))
    at = F.struct("us", "eid")
    nodes = Stage(events.sparkSession, "session-nodes").cut(
        once.groupBy("ent", F.floor(F.col("us") / F.lit(gap)).cast("long").alias("node"))
        .agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")))
    roots = _roots(nodes, gap)
    done = (nodes.join(roots, ["ent", "node"], "left")
            .groupBy("ent", F.coalesce("ptr", "node").alias("root"))
            .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n_events")))
    return done.select(
        F.col("ent").alias(entity), F.col("first.eid").alias("first_id"), F.col("last.eid").alias("last_id"),
        F.timestamp_micros("first.us").alias("started_at"), F.timestamp_micros("last.us").alias("ended_at"),
        ((F.col("last.us") - F.col("first.us")) / 1e6).alias("duration_s"), "n_events")
