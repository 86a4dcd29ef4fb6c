"""Retrieval measured on labelled cases, in all modes at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.operators.retrieval import RERANK_POOL, RRF_K, first_rank, metrics, pool_size, terms
from lorespark.providers import Embedder, Scorer, checked_scores, checked_vectors

MODES = ("fts", "vector", "hybrid", "vector+rr", "hybrid+rr")
#: Cases of one pass over the chunks; their vectors are broadcast.
BLOCK = 4096


def vector_legs(chunks: DataFrame, ids: list[int], vectors: np.ndarray, pool: int, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """(case_id, id, vrank): the ``pool`` nearest chunks of each of a block of query vectors; every batch of chunks keeps its own best only."""
    q = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    shared, dim = chunks.sparkSession.sparkContext.broadcast((np.array(ids, np.int64), q)), vectors.shape[1]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, q = shared.value
        for b in batches:
            lists = b.column(1)
            ok = np.asarray(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(lists), dim), False)) & np.asarray(b.column(0).is_valid())
            own = b.column(0).filter(pa.array(ok)).to_numpy()
            x = lists.filter(pa.array(ok)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
            sound = np.isfinite(x).all(1) & (x != 0).any(1)
            own, x = own[sound], x[sound]
            if not len(own):
                continue
            dist = 1 - q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
            k = min(pool, len(own))
            cut = np.partition(dist, k - 1, axis=1)[:, k - 1: k]
            r, c = np.nonzero(dist <= cut)
            for lo in range(0, len(r), 50_000):
                s = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(case[r[s]]), pa.array(own[c[s]]), pa.array(dist[r[s], c[s]])], ["case_id", "id", "dist"])

    near = chunks.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v")).mapInArrow(best, "case_id long, id long, dist double")
    w = Window.partitionBy("case_id").orderBy("dist", "id")
    return near.withColumn("vrank", F.row_number().over(w)).where(F.col("vrank") <= pool).select("case_id", "id", "vrank")


def fts_legs(chunks: DataFrame, cases: DataFrame, pool: int, id_col: str = "id", text: str = "text") -> DataFrame:
    """(case_id, id, frank): chunks with all the words of a case's query, by the number of their occurrences.

    A case is joined by its rarest word only, so a chunk without that word is never paired with it; the other
    words are then looked up in the chunk's own counts.
    """
    q = cases.select("case_id", F.array_distinct(terms("query")).alias("words")).where(F.size("words") > 0)
    asked = q.select(F.explode("words").alias("word")).distinct()
    counts = chunks.select(F.col(id_col).alias("id"), F.explode(terms(text)).alias("word")).join(asked, "word", "left_semi").groupBy("id", "word").agg(F.count("*").alias("n"))
    often = counts.groupBy("word").agg(F.count("*").alias("df"))
    rarest = (q.select("case_id", F.explode("words").alias("word")).join(often, "word", "left")
              .groupBy("case_id").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word")))
    held = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("has"))  # at most a chunk's own words
    pairs = counts.select("id", "word").join(rarest, "word").join(q, "case_id").join(held, "id")
    hits = (pairs.where(F.forall("words", lambda w: F.col("has")[w].isNotNull()))
            .withColumn("n", F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.col("has")[w])))
    w = Window.partitionBy("case_id").orderBy(F.desc("n"), "id")
    return hits.withColumn("frank", F.row_number().over(w)).where(F.col("frank") <= pool).select("case_id", "id", "frank")


def fused(vec: DataFrame | None, fts: DataFrame | None, top: int, k: int = RRF_K) -> DataFrame:
    """(case_id, id, score, rank) of each case's best by reciprocal ranks."""
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    if vec is not None and fts is not None:
        both = vec.join(fts, ["case_id", "id"], "full").withColumn("score", part("vrank") + part("frank"))
    else:
        both = vec.withColumn("score", part("vrank")) if vec is not None else fts.withColumn("score", part("frank"))
    w = Window.partitionBy("case_id").orderBy(F.desc("score"), "id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("case_id", "id", "score", "rank")


def reranked(found: DataFrame, chunks: DataFrame, cases: DataFrame, scorer: Scorer, top: int, batch: int = 16) -> DataFrame:
    """The pool of each case in the order of a scorer; ties keep the former order."""
    rows = found.join(chunks.select("id", "text"), "id").join(cases.select("case_id", "query"), "case_id").select("case_id", "id", "rank", "query", "text")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = np.zeros(len(pdf))
            for query, at in pdf.groupby("query").indices.items():
                for lo in range(0, len(at), batch):
                    docs = [pdf.text.iloc[i] or "" for i in at[lo: lo + batch]]
                    s[at[lo: lo + batch]] = checked_scores(scorer.scores(query, docs), len(docs))
            yield pd.DataFrame({"case_id": pdf.case_id, "id": pdf.id, "was": pdf["rank"], "score": s})

    w = Window.partitionBy("case_id").orderBy(F.desc("score"), "was")
    return rows.mapInPandas(score, "case_id long, id long, was long, score double").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("case_id", "id", "score", "rank")


def evaluate(chunks: DataFrame, cases: DataFrame, embedder: Embedder, scorer: Scorer, top: int = 20, days: int = 1, modes: tuple[str, ...] = MODES) -> DataFrame:
    """(mode, mrr, top1, top5, misses, cases, wrong_source) over labelled cases (case_id, query, peer_id, day).

    A case is hit by the first result of its peer within ``days`` of its day.  ``wrong_source``: cases whose
    peer has no chunk near that day, which no search can find.  Cases go in blocks of ``BLOCK``.
    """
    wanted = pool_size(max(top, RERANK_POOL))
    stated = sorted((r.case_id, r.query or "") for r in cases.select("case_id", "query").collect()) if any("fts" != m for m in modes) else []
    vec = None
    for lo in range(0, len(stated), BLOCK):
        part = stated[lo: lo + BLOCK]
        v = np.array(checked_vectors(embedder.embed([q for _, q in part]), len(part), embedder.dim), float)
        leg = vector_legs(chunks, [i for i, _ in part], v, wanted)
        vec = leg if vec is None else vec.unionByName(leg)
    fts = fts_legs(chunks, cases, wanted)
    place = chunks.select("id", "peer_id", "ts_from")
    pools = {"fts": (None, fts), "vector": (vec, None), "hybrid": (vec, fts)}
    out = None
    for mode in modes:
        legs, rr = pools[mode.split("+")[0]], mode.endswith("+rr")
        got = fused(*legs, RERANK_POOL if rr else top)
        got = reranked(got, chunks, cases, scorer, top) if rr else got
        ranks = first_rank(got.join(place, "id"), cases, days).withColumn("mode", F.lit(mode))
        out = ranks if out is None else out.unionByName(ranks)
    near = place.select("peer_id", F.col("ts_from").cast("date").alias("d")).distinct().select("peer_id", F.explode(F.sequence(F.date_sub("d", days), F.date_add("d", days))).alias("day")).distinct()
    lost = cases.select("peer_id", "day").join(near, ["peer_id", "day"], "left_anti").agg(F.count("*").alias("wrong_source"))
    return metrics(out, 0, ["mode"]).crossJoin(F.broadcast(lost))  # one row
