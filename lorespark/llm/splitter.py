"""Oversized texts cut at natural boundaries with overlap, all greedy cuts derived in parallel.

Every boundary of a text (paragraph, sentence, word; a fixed grid inside runs without blanks) is joined
to its farthest legal successor: the piece that starts there ends at the farthest paragraph end in the
upper half of the limit, else the farthest sentence end there, else the farthest word end or grid
position; the next piece starts at the first boundary at most ``overlap`` characters before that end.
The successor tables are then squared: after k rounds the cuts 0 .. 2**k - 1 of every text are known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.session import Stage

OVERSIZED = 2600
LIMIT = 1200
OVERLAP = 100
#: Runs without blanks longer than this get a grid of possible cuts.
LONG_RUN = 200
GRID = 50

_BREAK = re.compile(r"\s+")
_PARAGRAPH = re.compile("[\\n\\r\u2028\u2029]")
_SENTENCE_END = re.compile(r"[.!?…]['\"»”)\]]*\Z")
_MARK = re.compile("[\u0300-\u036f\u200b-\u200d\ufe0e\ufe0f\U0001f3fb-\U0001f3ff]")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions, ranks): 3 after a line's end, 2 after a sentence, 1 after a word, 0 in a long run.  0 is one, the end is not."""
    pos, rank, last = [0], [3], 0

    def grid(lo: int, hi: int) -> None:
        for p in range(lo + GRID, hi, GRID) if hi - lo > LONG_RUN else ():
            while p < hi and (_MARK.match(text, p) or text[p - 1] == "\u200d"):
                p += 1
            if pos[-1] < p < hi:
                pos.append(p)
                rank.append(0)

    for m in _BREAK.finditer(text):
        grid(last, m.start())
        last = m.end()
        if last < len(text):
            if last - m.start() > LONG_RUN:  # a long blank run is cut like any other
                grid(m.start(), last)
            if last > pos[-1]:
                pos.append(last)
                rank.append(3 if _PARAGRAPH.search(m.group()) else 2 if _SENTENCE_END.search(text[max(0, m.start() - 4): m.start()]) else 1)
    grid(last, len(text))
    return np.array(pos), np.array(rank)


def successors(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, end, succ) for the boundaries a cut can start at; succ -1 where the piece reaches the end."""
    n = len(text)
    pos, rank = boundaries(text)
    ends = np.append(pos[1:], n)
    er = np.append(rank[1:], 3)
    end = ends[np.maximum(np.searchsorted(ends, pos + limit, "right") - 1, 0)]
    for r in (2, 3):  # the better kind overrules
        nice = ends[er >= r]
        at = nice[np.maximum(np.searchsorted(nice, pos + limit, "right") - 1, 0)]
        end = np.where((at > pos + limit // 2) & (at <= pos + limit), at, end)
    end = np.where(pos + limit >= n, n, end)
    # a stretch without any boundary in reach cannot occur: the grid is finer than the limit
    nxt = np.searchsorted(pos, np.maximum(end - overlap, pos + 1))
    succ = np.where(end >= n, -1, pos[np.minimum(nxt, len(pos) - 1)])
    # boundaries that no cut of a cut can reach need no row
    keep = np.isin(pos, succ) | (pos == 0)
    keep &= np.isin(pos, succ[keep]) | (pos == 0)
    return pos[keep], end[keep], succ[keep]


def cuts(texts: DataFrame, keys: list[str], text: str = "text", oversized: int = OVERSIZED, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(keys, h, piece, start, end) of every text of more than ``oversized`` code points; end is exclusive.

    The pieces of a text cover it, each has at most ``limit`` code points, and consecutive ones share at
    most ``overlap``, less where no boundary allows more.  Null texts and texts within the size give no row;
    repeated rows give one set of pieces; rows of equal keys but unlike texts are told apart by h.
    """
    if not 0 <= overlap < limit // 4 or oversized < limit or limit < 4 * LONG_RUN:
        raise ValueError("overlap must be under a quarter of the limit, the limit at least four long runs and at most the size")
    stage = Stage(texts.sparkSession, "cuts")
    # one struct as the key, as structs with null fields are equal where plain nulls are not
    long = texts.select(F.struct(*keys, F.xxhash64(text).alias("h")).alias("k"), F.col(text).alias("t")).where(F.length("t") > oversized)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(1).to_pylist()):
                node, end, succ = successors(t, limit, overlap)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(node), i))), pa.array(node), pa.array(end), pa.array(succ)], ["k", "node", "end", "succ"])

    kind = long.schema["k"].dataType.simpleString()
    table = stage.cut(long.mapInArrow(nodes, f"k {kind}, node long, end long, succ long").dropDuplicates(["k", "node"]))
    hop = table.where("succ >= 0").select("k", "node", "succ")
    reached = table.where("node = 0").select("k", F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("piece"))
    step = 1
    while not hop.isEmpty():
        more = reached.join(hop, ["k", "node"]).select("k", F.col("succ").alias("node"), (F.col("piece") + step).alias("piece"))
        ahead = hop.select("k", F.col("node").alias("succ"), F.col("succ").alias("next"))
        old, reached = (hop, reached), stage.cut(reached.unionByName(more))
        hop = stage.cut(hop.join(ahead, ["k", "succ"]).select("k", "node", F.col("next").alias("succ")))
        for df in old:
            stage.drop(df)
        step *= 2
    return reached.join(table.select("k", "node", "end"), ["k", "node"]).select("k.*", "piece", F.col("node").alias("start"), "end")


def pieces(texts: DataFrame, keys: list[str], text: str = "text", **how: int) -> DataFrame:
    """``cuts`` with the text of each piece."""
    key = F.struct(*keys, "h").alias("k")
    spans = cuts(texts, keys, text, **how).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("piece", "start", "end"))).alias("spans"))  # one text's pieces
    src = texts.select(*keys, F.xxhash64(text).alias("h"), F.col(text).alias("t")).where(F.length("t") > how.get("oversized", OVERSIZED)).select(key, "t").dropDuplicates(["k"])
    return (src.join(spans, "k").withColumn("s", F.explode("spans"))
            .select("k.*", "s.piece", "s.start", "s.end", F.expr("substring(t, cast(s.start as int) + 1, cast(s.end - s.start as int))").alias("text")))
