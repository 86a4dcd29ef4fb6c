"""Search over chunks: exact vectors, full text, reciprocal-rank fusion, reranking, evaluation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions.dates import between_dates
from lorespark.functions.stem import stem
from lorespark.functions.text import as_col
from lorespark.functions.vectors import check_query, cosine_distance, is_sound
from lorespark.providers import Embedder, Scorer, checked_scores, embed_column

RRF_K = 60
RERANK_POOL = 100
# Words without meaning for search, of both languages.
STOP_WORDS = frozenset("и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему the a an of to in is and or it on for with as at by be this that".split())


def pool_size(top: int) -> int:
    return max(5 * top, 50)


def filters(peers: list[int] | None = None, sources: list[str] | None = None, date_from: str | None = None, date_to: str | None = None, ts: str = "ts_from") -> Column:
    """The condition that both legs apply before their limit; undated chunks fall to any date bound."""
    cond = F.lit(True)
    if peers:
        cond = cond & F.col("peer_id").isin(*[int(p) for p in peers])
    if sources:
        cond = cond & F.col("source").isin(*sources)
    if date_from or date_to:
        cond = cond & between_dates(ts, date_from, date_to)
    return cond


def ranked(df: DataFrame, order: list[Column], pool: int, rank: str) -> DataFrame:
    """The first ``pool`` rows with their rank: limited first, so the window sees no more than that."""
    return df.orderBy(*order).limit(pool).withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long"))


def vector_leg(chunks: DataFrame, query: list[float], pool: int, dim: int = 64, where: Column | None = None, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """(id, dist, vrank): exact nearest chunks by cosine distance; ids and vectors only are read."""
    df = chunks if where is None else chunks.where(where)
    near = df.where(is_sound(vec, dim)).select(F.col(id_col).alias("id"), cosine_distance(vec, check_query(query, dim)).alias("dist"))
    return ranked(near, [F.asc("dist"), F.asc("id")], pool, "vrank")


def terms(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(as_col(text)), F.lit(r"([\p{L}\p{N}]+)"), 1)


def inverted_index(chunks: DataFrame, id_col: str = "id", text: str = "text", stemmed: bool = True) -> DataFrame:
    """(term, id, positions): one row per term of a chunk, made row by row without a shuffle; words are cut in the JVM and stemmed once per worker."""
    known: dict[str, str] = {}

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str, int, list[int]]] = []
            for i, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at: dict[str, list[int]] = {}
                for k, w in enumerate(words or ()):
                    if stemmed:
                        if (s := known.get(w)) is None:
                            if len(known) > 500_000:
                                known.clear()
                            s = known[w] = stem(w)
                        w = s
                    at.setdefault(w, []).append(k)
                out += [(w, i, ks) for w, ks in at.items()]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int32()))], ["term", "id", "positions"])

    return chunks.select(F.col(id_col).cast("long").alias("id"), terms(text).alias("words")).mapInArrow(turn, "term string, id long, positions array<int>")


INDEX_BUCKETS = 64


def write_index(index: DataFrame, path: str, buckets: int = INDEX_BUCKETS) -> None:
    """Store an inverted index, one folder per hash of the term, so that a query reads its terms' folders only.

    Rows are rebalanced by folder: small ones share a task, and one with a frequent term is split by size.
    """
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    (index.withColumn("bucket", bucket).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(path))


def stored_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def of_terms(index: DataFrame, wanted: list[str], buckets: int = INDEX_BUCKETS) -> DataFrame:
    """The index rows of some terms; of a stored index only their folders are read."""
    hit = index.where(F.col("term").isin(*wanted))
    if "bucket" not in index.columns:
        return hit
    own = index.sparkSession.range(1).select(F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)).cast("int") for t in wanted])).first()[0]
    return hit.where(F.col("bucket").isin(*sorted(set(own))))


def parse_query(q: str, stemmed: bool = True) -> tuple[list[list[list[str]]], list[list[str]]]:
    """Web-search syntax: (all of: any of: phrase of terms, none of: phrases).  Words are ANDed, 'or' joins neighbours, quotes make phrases, a minus excludes."""
    must: list[list[list[str]]] = []
    never: list[list[str]] = []
    join = False
    for neg, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', q):
        if word.lower() in ("or", "или") and not neg and must:
            join = True
            continue
        ts = [w for w in re.findall(r"[^\W_]+", (quoted or word).lower()) if w not in STOP_WORDS or not stemmed]
        ts = [stem(t) if stemmed else t for t in ts]
        if not ts:
            continue
        if neg:
            never.append(ts)
        elif join:
            must[-1].append(ts)
            join = False
        else:
            must.append([ts])
    return must, never


def _phrase_hits(pos: dict[str, list[int]], phrase: list[str]) -> list[tuple[int, int]]:
    """Extents of the phrase: each term right after the one before."""
    sets = [set(pos.get(t, ())) for t in phrase]
    return [(p, p + len(phrase) - 1) for p in sorted(sets[0]) if all(p + k in s for k, s in enumerate(sets))]


def cover_density(pos: dict[str, list[int]], must: list[list[list[str]]], never: list[list[str]], weight: float = 0.1) -> float | None:
    """Rank by the covers of Clarke, Cormack and Tudhope: the shortest stretches with all the terms, each worth its density; None: no match."""
    if any(_phrase_hits(pos, p) for p in never):
        return None
    lists = []
    for alternatives in must:
        hits = sorted({h for p in alternatives for h in _phrase_hits(pos, p)})
        if not hits:
            return None
        lists.append(hits)
    if not lists:
        return None
    rank, start = 0.0, -1
    ends = [0] * len(lists)
    while True:
        hi = -1  # the first end by which every list has a hit that starts after the last cover's start
        for i, hits in enumerate(lists):
            while ends[i] < len(hits) and hits[ends[i]][0] <= start:
                ends[i] += 1
            if ends[i] == len(hits):
                return rank
            hi = max(hi, hits[ends[i]][1])
        lo = min(max(h for h in hits if h[1] <= hi)[0] for hits in lists)
        n = sum(len(a[0]) for a in must)
        rank += n * weight / max(1, hi - lo + 1 - n + 1)
        start = lo


def fts_leg(index: DataFrame, query: str, pool: int, stemmed: bool = True) -> DataFrame:
    """(id, rank_cd, frank): chunks that match all of the query, by cover density.  The index is cut to the query's terms before anything is grouped."""
    must, never = parse_query(query, stemmed)
    wanted = sorted({t for alt in must for p in alt for t in p} | {t for p in never for t in p})
    empty = index.sparkSession.createDataFrame([], "id long, rank_cd double, frank long")
    if not must:
        return empty

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(i, cover_density({p["term"]: list(p["positions"]) for p in ps}, must, never)) for i, ps in zip(pdf.id, pdf.ps, strict=True)]
            yield pd.DataFrame([g for g in got if g[1] is not None], columns=["id", "rank_cd"])

    hits = of_terms(index, wanted).groupBy("id").agg(F.collect_list(F.struct("term", "positions")).alias("ps"))  # at most the query's terms
    required = sorted({t for alt in must if len(alt) == 1 for t in alt[0]})
    if required:
        hits = hits.where(F.size(F.array_intersect(F.transform("ps", lambda p: p["term"]), F.array(*[F.lit(t) for t in required]))) == len(required))
    found = hits.mapInPandas(score, "id long, rank_cd double")
    return ranked(found, [F.desc("rank_cd"), F.asc("id")], pool, "frank")


def fts_scan_leg(chunks: DataFrame, query: str, pool: int, stemmed: bool = True, id_col: str = "id", text: str = "text") -> DataFrame:
    """The same result as ``fts_leg`` without an index: one scan, no shuffle.

    A term's forms share its first letters, so texts without them are dropped in the JVM; only the rest is
    tokenised and stemmed.
    """
    must, never = parse_query(query, stemmed)
    if not must:
        return chunks.sparkSession.createDataFrame([], "id long, rank_cd double, frank long")
    df = chunks.select(F.col(id_col).alias("id"), as_col(text).alias("raw")).where("raw is not null")
    for alternatives in must:
        heads = [t[: max(2, len(t) - 1)] if stemmed else t for p in alternatives for t in p[:1]]
        df = df.where(F.col("raw").rlike("(?iu)" + "|".join(re.sub("[её]", "[её]", re.escape(h)) for h in heads)))
    df = df.withColumn("low", F.lower("raw"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t in zip(pdf.id, pdf.low, strict=True):
                pos: dict[str, list[int]] = {}
                for k, w in enumerate(re.findall(r"[^\W_]+", t)):
                    pos.setdefault(stem(w) if stemmed else w, []).append(k)
                r = cover_density(pos, must, never)
                if r is not None:
                    out.append((i, r))
            yield pd.DataFrame(out, columns=["id", "rank_cd"])

    return ranked(df.select("id", "low").mapInPandas(score, "id long, rank_cd double"), [F.desc("rank_cd"), F.asc("id")], pool, "frank")


def fts_simple_leg(chunks: DataFrame, query_terms: list[str], pool: int, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, n_hits, frank): chunks with all terms (lower-case words), by the number of their occurrences; all in the JVM, no index.

    Texts without the letters of every term are dropped first, so few are folded to lower case and searched for whole words.
    """
    raw, low = as_col(text), F.lower(as_col(text))
    n = [F.regexp_count(low, F.lit(rf"(?<![\p{{L}}\p{{N}}])\Q{t}\E(?![\p{{L}}\p{{N}}])")) for t in query_terms]
    df = chunks.select(F.col(id_col).alias("id"), raw.alias(text))
    for t in query_terms:
        df = df.where(raw.rlike(rf"(?iu)\Q{t}\E"))
    for c in n:
        df = df.where(c > 0)
    hits = n[0]
    for c in n[1:]:
        hits = hits + c
    return ranked(df.select("id", hits.cast("long").alias("n_hits")), [F.desc("n_hits"), F.asc("id")], pool, "frank")


def fuse(vec: DataFrame | None, fts: DataFrame | None, top: int, k: int = RRF_K) -> DataFrame:
    """(id, score, vrank, frank) of the best by reciprocal ranks; an absent list counts nothing."""
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    null = F.lit(None).cast("long")
    if vec is None:
        both = fts.select("id", null.alias("vrank"), "frank")
    elif fts is None:
        both = vec.select("id", "vrank", null.alias("frank"))
    else:
        both = vec.select("id", "vrank").join(fts.select("id", "frank"), "id", "full")
    return both.withColumn("score", part("vrank") + part("frank")).orderBy(F.desc("score"), F.asc("id")).limit(top)


def with_rows(best: DataFrame, chunks: DataFrame, dialogs: DataFrame) -> DataFrame:
    """The chosen ids with their rows: the pool is limited, so it is the broadcast side."""
    d = dialogs.select("peer_id", "name")
    return F.broadcast(best).join(chunks, "id").join(d, "peer_id").select("id", "peer_id", "name", "ts_from", "ts_to", "n_messages", "text", "score", "vrank", "frank", "source")


def search(chunks: DataFrame, dialogs: DataFrame, query: str, embedder: Embedder, mode: str = "hybrid", top: int = 10, index: DataFrame | None = None, **where) -> DataFrame:
    """Mode vector, fts or hybrid; the filters hold inside both legs."""
    if mode not in ("vector", "fts", "hybrid"):
        raise ValueError(mode)
    cond, pool = filters(**where), pool_size(top)
    inside = chunks.where(cond)
    vec = vector_leg(inside, embedder.embed([query])[0], pool, embedder.dim) if mode != "fts" else None
    if mode != "vector":
        fts = fts_scan_leg(inside, query, pool) if index is None else fts_leg(index.join(inside.select("id"), "id", "left_semi"), query, pool)
    else:
        fts = None
    return with_rows(fuse(vec, fts, top), chunks, dialogs)


def rerank(found: DataFrame, query: str, scorer: Scorer, top: int, batch: int = 16) -> DataFrame:
    """The best of a bounded pool by a scorer of (query, text); ties keep the former order."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s: list[float] = []
            for k in range(0, len(pdf), batch):
                docs = [t or "" for t in pdf.text.iloc[k: k + batch]]
                s += checked_scores(scorer.scores(query, docs), len(docs))
            yield pdf.assign(rescore=s)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", rescore double"
    return found.mapInPandas(run, schema).orderBy(F.desc("rescore"), F.desc("score"), F.asc("id")).limit(top).withColumn("score", F.col("rescore")).drop("rescore")


def reranked_search(chunks: DataFrame, dialogs: DataFrame, query: str, embedder: Embedder, scorer: Scorer, mode: str = "hybrid", top: int = 10, **where) -> DataFrame:
    return rerank(search(chunks, dialogs, query, embedder, mode, max(RERANK_POOL, top), **where), query, scorer, top)


def backfill(chunks: DataFrame, done: DataFrame, embedder: Embedder, keys: list[str]) -> DataFrame:
    """Embeddings for chunks that have none yet; done: the embedding table, keyed like chunks."""
    todo = chunks.select(*keys, "text").join(done.select(*keys), keys, "left_anti")
    return embed_column(todo, "text", "embedding", embedder).drop("text")


def containing(docs: DataFrame, needles: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id) for each stated passage start (item_id, start), a fixed set, that a text holds word for word."""
    stated = [(i, t) for i, t in needles.collect() if t]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(d, i) for d, t in zip(pdf[doc_id], pdf[text], strict=True) for i, n in stated if n in t], columns=[doc_id, "item_id"]).astype("int64")

    return docs.select(doc_id, text).mapInPandas(run, f"{doc_id} long, item_id long")


def sharing(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 13) -> DataFrame:
    """(doc_id, item_id) for each stated passage (item_id, passage), a fixed set, with which a text shares ``least`` consecutive words, or all of a shorter one.

    Words are runs of letters or digits in lower case, ё as е, without soft hyphens and zero-width spaces; what stands between them does not matter.
    """
    def words(t: str) -> list[str]:
        return re.findall(r"[^\W_]+", re.sub("[\u00ad\u200b\u200c\u200d\u2060\ufeff]", "", t).lower().replace("ё", "е"))

    stated: dict[int, dict[str, set[int]]] = {}
    for i, t in passages.collect():
        w = words(t or "")
        n = min(least, len(w))
        for x in range(len(w) - n + 1 if n else 0):
            stated.setdefault(n, {}).setdefault(" ".join(w[x: x + n]), set()).add(i)
    first = {n: {k.split(" ", 1)[0] for k in runs} for n, runs in stated.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple[int, int]] = []
            for d, t in zip(pdf[doc_id], pdf[text], strict=True):
                w = words(t)
                found: set[int] = set()
                for n, runs in stated.items():
                    for x in range(len(w) - n + 1):
                        if w[x] in first[n] and (ids := runs.get(" ".join(w[x: x + n]))):
                            found |= ids
                out += [(d, i) for i in found]
            yield pd.DataFrame(out, columns=[doc_id, "item_id"]).astype("int64")

    return docs.select(doc_id, text).mapInPandas(run, f"{doc_id} long, item_id long")


def metrics(ranks: DataFrame, n_cases: int | Column, group: list[str]) -> DataFrame:
    """MRR, hits at 1 and 5, misses; ranks: one row per case, null rank for a miss."""
    r = F.col("rank")
    return ranks.groupBy(*group).agg(F.round(F.sum(F.coalesce(1.0 / r, F.lit(0.0))) / F.count("*"), 6).alias("mrr"), F.count_if(r == 1).alias("top1"), F.count_if(r <= 5).alias("top5"), F.count_if(r.isNull()).alias("misses"), F.count("*").alias("cases"))


def first_rank(results: DataFrame, cases: DataFrame, days: int = 1) -> DataFrame:
    """(case_id, rank) of the first result of the expected peer within ``days`` of the expected day; results have case_id, rank, peer_id, ts_from."""
    hit = (results.join(cases.select("case_id", "peer_id", "day"), ["case_id", "peer_id"]).where(F.abs(F.datediff(F.col("ts_from").cast("date"), "day")) <= days).groupBy("case_id").agg(F.min("rank").alias("rank")))
    return cases.select("case_id").join(hit, "case_id", "left")
