"""Queries of the archive operators, each with the SQL it is compared with where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions.dates import bounds, between_dates, between_months
from lorespark.functions.quality import is_suspect, is_useless, repetition_stats
from lorespark.functions.text import attachment_kind, collapse_repeats, fmt_duration, is_boilerplate, media_file, peer_kind, preview, sanitize_filename
from lorespark.operators import analytics, asr, chunking, export, joins, merge, retrieval
from lorespark.providers import HashEmbedder, OverlapScorer
from lorespark.session import scratch_path
from lorespark.session import table as T
from lorespark.sources import html
from lorespark.sources.media import url_size
from lorespark.streaming.ingest import session_windows

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


US = F.unix_micros
#: A fixed query vector and query words.
VECTOR = [round(((i * 37) % 19 - 9) / 10 + 0.05, 2) for i in range(64)]
VECTOR_SQL = "[" + ", ".join(map(str, VECTOR)) + "]::DOUBLE[]"
TERMS = ["завтра", "утра"]


class _Fixed(HashEmbedder):
    def embed(self, texts):
        return [VECTOR for _ in texts]


# ---- retrieval
_SOUND = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


def _vec(where: str, pool: int) -> str:
    return f"""v0 AS (SELECT id, 1 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) AS dist
      FROM (SELECT id, embedding::DOUBLE[] AS e, {VECTOR_SQL} AS q FROM chunks WHERE {_SOUND} AND {where})),
    v AS (SELECT id, dist, row_number() OVER (ORDER BY dist, id) AS vrank FROM v0 ORDER BY dist, id LIMIT {pool})"""


_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


def _fts(where: str, pool: int) -> str:
    return f"""f0 AS (SELECT id, {_TOK} AS w FROM chunks WHERE text IS NOT NULL AND {where}),
    f1 AS (SELECT id, len(list_filter(w, lambda x: x = '{TERMS[0]}')) AS a, len(list_filter(w, lambda x: x = '{TERMS[1]}')) AS b FROM f0),
    f AS (SELECT id, a + b AS n_hits, row_number() OVER (ORDER BY a + b DESC, id) AS frank FROM f1 WHERE a > 0 AND b > 0 ORDER BY a + b DESC, id LIMIT {pool})"""


_FUSED = "SELECT id, vrank, frank, coalesce(1.0::DOUBLE / (60 + vrank), 0) + coalesce(1.0::DOUBLE / (60 + frank), 0) AS score FROM {} ORDER BY score DESC, id LIMIT {}"


@query("WITH " + _vec("true", 50) + " SELECT id, vrank, round(dist, 6) AS dist FROM v")
def vector_topk(s: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_leg(T(s, d, "chunks"), VECTOR, 50).select("id", "vrank", F.round("dist", 6).alias("dist"))


_WHERE = "source = 'photo' AND epoch_us(ts_from) >= 1420070400000000 AND epoch_us(ts_from) < 1609459200000000"


@query("WITH " + _vec(_WHERE, 50) + " SELECT id, vrank, round(dist, 6) AS dist FROM v")
def vector_topk_filtered(s, d):
    where = retrieval.filters(sources=["photo"], date_from="2015", date_to="2020")
    return retrieval.vector_leg(T(s, d, "chunks"), VECTOR, 50, where=where).select("id", "vrank", F.round("dist", 6).alias("dist"))


@query("WITH " + _fts("true", 50) + " SELECT id, n_hits, frank FROM f")
def fts_and_match(s, d):
    return retrieval.fts_simple_leg(T(s, d, "chunks"), TERMS, 50)


def _index(s, d):
    """The stored index of the chunks, written at the session's first use."""
    known = s.__dict__.setdefault("_lorespark_index", {})
    if d not in known:
        path = scratch_path(s, "index")
        retrieval.write_index(retrieval.inverted_index(T(s, d, "chunks").select("id", "text")), path)
        known[d] = path
    return retrieval.stored_index(s, known[d])


@query()
def fts_index(s, d):
    """The same as fts_cover_rank, through a stored inverted index."""
    return retrieval.fts_leg(_index(s, d), 'морковный кекс or суп -"на углях"', 50)


# one term in forms that share a stem: the rank of a single term is its number of occurrences
@query("""WITH w AS (SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM chunks WHERE text IS NOT NULL),
    n AS (SELECT id, len(list_filter(w, lambda x: x IN ('кекс', 'кекса', 'кексу', 'кексом', 'кексе', 'кексы', 'кексов', 'кексам', 'кексами', 'кексах'))) AS n FROM w)
    SELECT id, round(n * 0.1, 6) AS rank, row_number() OVER (ORDER BY n DESC, id) AS frank FROM n WHERE n > 0 ORDER BY n DESC, id LIMIT 50""")
def fts_index_term(s, d):
    return retrieval.fts_leg(_index(s, d), "кекс", 50).select("id", F.round("rank_cd", 6).alias("rank"), "frank")


@query()
def fts_cover_rank(s, d):
    return retrieval.fts_scan_leg(T(s, d, "chunks").select("id", "text"), 'морковный кекс or суп -"на углях"', 50)


def _legs(s, d):
    c = T(s, d, "chunks")
    return retrieval.vector_leg(c, VECTOR, 50), retrieval.fts_simple_leg(c, TERMS, 50)


@query("WITH " + _vec("true", 50) + ", " + _fts("true", 50) + ", u AS (SELECT id, vrank, frank FROM v FULL JOIN f USING (id)), best AS (" + _FUSED.format("u", 10) + """)
    SELECT best.id, peer_id, d.name, source, vrank, frank, round(score, 9) AS score FROM best JOIN chunks c ON c.id = best.id JOIN dialogs d USING (peer_id)""")
def rrf_hybrid(s, d):
    best = retrieval.fuse(*_legs(s, d), top=10)
    return retrieval.with_rows(best, T(s, d, "chunks"), T(s, d, "dialogs")).select("id", "peer_id", "name", "source", "vrank", "frank", F.round("score", 9).alias("score"))


@query("WITH " + _vec("true", 50) + ", best AS (" + _FUSED.format("(SELECT id, vrank, NULL::BIGINT AS frank FROM v)", 10) + ") SELECT id, vrank, round(score, 9) AS score FROM best")
def rrf_vector_only(s, d):
    return retrieval.fuse(_legs(s, d)[0], None, 10).select("id", "vrank", F.round("score", 9).alias("score"))


@query("WITH " + _fts("true", 50) + ", best AS (" + _FUSED.format("(SELECT id, NULL::BIGINT AS vrank, frank FROM f)", 10) + ") SELECT id, frank, round(score, 9) AS score FROM best")
def rrf_fts_only(s, d):
    return retrieval.fuse(None, _legs(s, d)[1], 10).select("id", "frank", F.round("score", 9).alias("score"))


@query("WITH " + _vec("true", 500) + ", best AS (" + _FUSED.format("(SELECT id, vrank, NULL::BIGINT AS frank FROM v)", 100) + """),
    r AS (SELECT best.id, score, (CASE WHEN list_contains(w, 'завтра') THEN 1 ELSE 0 END + CASE WHEN list_contains(w, 'утра') THEN 1 ELSE 0 END + CASE WHEN list_contains(w, 'сервисе') THEN 1 ELSE 0 END) / 3.0 AS s
          FROM best JOIN (SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM chunks) t USING (id) JOIN chunks c ON c.id = best.id JOIN dialogs USING (peer_id))
    SELECT id, round(s, 6) AS score FROM r ORDER BY s DESC, r.score DESC, id LIMIT 10""")
def rerank_topk(s, d):
    c = T(s, d, "chunks").drop("embedding")
    best = retrieval.fuse(retrieval.vector_leg(T(s, d, "chunks"), VECTOR, retrieval.pool_size(100)), None, 100)
    found = retrieval.with_rows(best, c, T(s, d, "dialogs"))
    return retrieval.rerank(found, "завтра утра сервисе", OverlapScorer(), 10).select("id", F.round("score", 6).alias("score"))


@query()
def search_reranked(s, d):
    return retrieval.reranked_search(T(s, d, "chunks"), T(s, d, "dialogs"), "морковный кекс", _Fixed(64), OverlapScorer(), top=10, date_from="2014-03").select("id", "peer_id", "score")


_PLAIN = """regexp_extract_all(replace(lower(regexp_replace({}, '[\\x{{00AD}}\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')), 'ё', 'е'), '[\\p{{L}}\\p{{N}}]+')"""


@query(f"""WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}]+')) AS w, passage FROM eval_items),
    qt AS (SELECT item_id, unnest(w) AS term FROM q),
    dt AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM documents WHERE text IS NOT NULL),
    hits AS (SELECT item_id, doc_id, count(*) AS n FROM qt JOIN dt USING (term) GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS rank FROM hits),
    pw AS (SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, {_PLAIN.format('passage')} AS w FROM eval_items) WHERE len(w) > 0),
    ps AS (SELECT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM pw)),
    dw AS (SELECT doc_id, {_PLAIN.format('text')} AS w FROM documents WHERE text IS NOT NULL),
    ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM ps))),
    target AS (SELECT q.item_id, d.doc_id FROM q JOIN documents d ON contains(d.text, left(q.passage, 60)) UNION SELECT item_id, doc_id FROM ps JOIN ds USING (k, s)),
    found AS (SELECT t.item_id, min(CASE WHEN r.rank <= 20 THEN r.rank END) AS rank FROM target t LEFT JOIN ranked r USING (item_id, doc_id) GROUP BY 1),
    first AS (SELECT q.item_id, rank, f.item_id IS NULL AS lost FROM q LEFT JOIN found f USING (item_id))
    SELECT round(sum(coalesce(1.0 / rank, 0)) / count(*), 6) AS mrr, count(*) FILTER (rank = 1) AS top1, count(*) FILTER (rank <= 5) AS top5, count(*) FILTER (rank IS NULL) AS misses, count(*) AS cases,
      count(*) FILTER (lost) AS no_target FROM first""")
def eval_mrr(s, d):
    """Held-out questions against documents by shared words; the targets are documents with the start of the passage or 13 words of it in a row.

    All items are cases; one without target is a miss, and counted in no_target.
    """
    items, docs = T(s, d, "eval_items"), T(s, d, "documents").select("doc_id", "text")
    qt = items.select("item_id", F.explode(F.array_distinct(retrieval.terms("question"))).alias("term"))
    dt = docs.select("doc_id", F.explode(F.array_distinct(retrieval.terms("text"))).alias("term"))
    hits = dt.join(F.broadcast(qt), "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("n"))  # a fixed set of 200 questions
    best = analytics.top_per(hits, ["item_id"], [F.desc("n"), F.asc("doc_id")], 20)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("n"), F.asc("doc_id"))))
    known = docs.where("text is not null and doc_id is not null")
    start = retrieval.containing(known, items.select("item_id", F.substring("passage", 1, 60).alias("start")))
    target = start.unionByName(retrieval.sharing(known, items.select("item_id", "passage"))).distinct()
    found = target.join(best, ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.min("rank").alias("rank"), F.lit(True).alias("aimed"))
    ranks = items.select("item_id").join(found, "item_id", "left").withColumn("g", F.lit(1))
    none = ranks.groupBy("g").agg(F.count_if(F.col("aimed").isNull()).alias("no_target"))
    return retrieval.metrics(ranks, 0, ["g"]).join(none, "g").drop("g")


# ---- dates and sessions
def _bound_query(lo, hi):
    a, b = bounds(lo, hi)
    cond = " AND ".join(x for x in (f"epoch_us(sent_at) >= epoch_us(TIMESTAMP '{a}')" if a else "", f"epoch_us(sent_at) < epoch_us(TIMESTAMP '{b}')" if b else "") if x)
    return f"SELECT peer_id, count(*) AS n FROM messages WHERE {cond} GROUP BY 1"


for _name, _lo, _hi in (("date_bounds_year", "2009", "2012"), ("date_bounds_month", "2010-11", "2010-12"), ("date_bounds_day", "2017-02-01", "2017-02-28")):
    QUERIES[_name] = lambda s, d, lo=_lo, hi=_hi: T(s, d, "messages").where(between_dates("sent_at", lo, hi)).groupBy("peer_id").agg(F.count("*").alias("n"))
    SQL[_name] = _bound_query(_lo, _hi)


@query("SELECT peer_id, count(*) AS n FROM messages WHERE year(make_timestamp(epoch_us(sent_at))) * 12 + month(make_timestamp(epoch_us(sent_at))) BETWEEN 2009 * 12 + 11 AND 2011 * 12 + 2 GROUP BY 1")
def month_range(s, d):
    return T(s, d, "messages").where(between_months("sent_at", (2009, 11), (2011, 2))).groupBy("peer_id").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 10800000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM e)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n_events FROM n GROUP BY user_id, sid""")
def session_window_native(s, d):
    e = T(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return session_windows(e, "user_id", "ts").select("user_id", US("started_at").alias("start_us"), US("ended_at").alias("end_us"), "n_events")


@query("SELECT year(make_timestamp(epoch_us(sent_at))) AS year, count(*) AS n FROM messages WHERE sent_at IS NOT NULL GROUP BY 1")
def year_histogram(s, d):
    return T(s, d, "messages").where("sent_at is not null").groupBy(F.year("sent_at").cast("long").alias("year")).agg(F.count("*").alias("n"))


# ---- participation and entities
@query("""WITH v AS (SELECT DISTINCT message_id FROM attachments WHERE kind = 'voice'),
    p AS (SELECT peer_id, count(*) AS total, count(*) FILTER (is_own) AS mine, count(*) FILTER (v.message_id IS NOT NULL) AS voice, count(*) FILTER (v.message_id IS NOT NULL AND is_own) AS voice_mine,
          count(DISTINCT year(make_timestamp(epoch_us(sent_at)))) AS n_years FROM messages m LEFT JOIN v ON v.message_id = m.id GROUP BY 1)
    SELECT *, round(mine / total, 4) AS share, CASE WHEN peer_id >= 2000000000 THEN 'chat' WHEN peer_id < 0 THEN 'community' ELSE 'user' END AS kind FROM p""")
def participation(s, d):
    return analytics.participation(T(s, d, "messages"), T(s, d, "attachments")).select("peer_id", "total", "mine", "voice", "voice_mine", F.size("years").cast("long").alias("n_years"), "share", "kind")


@query("SELECT peer_id, count(*) AS total FROM messages GROUP BY 1 HAVING count(*) FILTER (is_own) < 30 AND count(*) FILTER (is_own) / count(*) < 0.02")
def useless_dialogs(s, d):
    return T(s, d, "messages").groupBy("peer_id").agg(F.count("*").alias("total"), F.count_if("is_own").alias("mine")).where(is_useless("mine", "total")).select("peer_id", "total")


@query("SELECT peer_id, name, total_msgs, voice_total FROM dialogs WHERE NOT useless AND total_msgs > 200 ORDER BY total_msgs DESC, peer_id LIMIT 30")
def export_chat_list(s, d):
    return T(s, d, "dialogs").where("not useless and total_msgs > 200").orderBy(F.desc_nulls_first("total_msgs"), "peer_id").limit(30).select("peer_id", "name", "total_msgs", "voice_total")


_VOC = ", ".join("'" + w + "'" for w in analytics.NO_NAMES)


@query(f"""WITH t AS (SELECT peer_id, trim(replace(text, chr(10), ' '), ' ') AS t FROM messages WHERE is_own AND text <> ''),
    w AS (SELECT peer_id, lower(regexp_extract(t, '^\\s*([А-ЯЁа-яё][а-яё]{{2,12}})\\s*[,!]', 1)) AS word FROM t UNION ALL SELECT peer_id, lower(regexp_extract(t, ',\\s*([А-ЯЁа-яё][а-яё]{{2,12}})\\s*[,.!?]*\\s*$', 1)) FROM t),
    n AS (SELECT peer_id, word, count(*) AS n FROM w WHERE word <> '' AND word NOT IN ({_VOC}) GROUP BY 1, 2)
    SELECT peer_id, word, n FROM (SELECT *, row_number() OVER (PARTITION BY peer_id ORDER BY n DESC, word) AS r FROM n) WHERE r <= 15""")
def vocatives(s, d):
    return analytics.vocatives(T(s, d, "messages"))


@query("""WITH w AS (SELECT peer_id, unnest(regexp_extract_all(lower(text), '[а-яёa-z]{3,14}')) AS word FROM messages WHERE is_own AND text <> ''),
    h AS (SELECT peer_id, word, count(*) AS n FROM w GROUP BY 1, 2), p AS (SELECT peer_id, sum(n) AS n_here FROM h GROUP BY 1), a AS (SELECT word, sum(n) AS n_all FROM h GROUP BY 1), t AS (SELECT sum(n) AS total FROM h),
    s AS (SELECT h.peer_id, h.word, h.n, (h.n / n_here) / ((n_all - h.n + 1) / greatest(total - n_here, 1)) AS ratio FROM h JOIN a USING (word) JOIN p USING (peer_id), t WHERE h.n >= 4)
    SELECT peer_id, word, n, ratio FROM (SELECT peer_id, word, n, round(ratio, 1) AS ratio, row_number() OVER (PARTITION BY peer_id ORDER BY round(ratio, 1) DESC, n DESC, word) AS r FROM s WHERE ratio > 3) WHERE r <= 20""")
def distinctive_words(s, d):
    return analytics.distinctive(T(s, d, "messages"))


@query("""WITH r AS (SELECT id, peer_id, strftime(make_timestamp(epoch_us(sent_at)), '%Y') AS year, strftime(make_timestamp(epoch_us(sent_at)), '%d.%m.%Y') AS day, is_own, text,
      row_number() OVER (PARTITION BY peer_id, strftime(make_timestamp(epoch_us(sent_at)), '%Y') ORDER BY length(text) DESC, id) AS rn FROM messages WHERE length(text) BETWEEN 40 AND 400)
    SELECT id, peer_id, year, day, is_own, replace(left(text, 220), chr(10), ' ') AS text FROM r WHERE rn <= 6""")
def sample_per_year(s, d):
    return analytics.sample_by_year(T(s, d, "messages"))


@query("""SELECT name, count(*) AS n FROM messages JOIN dialogs USING (peer_id) WHERE peer_id <> 2000000007 AND regexp_matches(text, '(?i)(^|[^а-яё])(марат|инга)([^а-яё]|$)') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")
def mentions_elsewhere(s, d):
    return analytics.mentions_elsewhere(T(s, d, "messages"), T(s, d, "dialogs"), 2000000007, ["марат", "инга"])


@query("""SELECT d.peer_id, d.total_msgs, epoch_us(min(sent_at)) AS first_us, epoch_us(max(sent_at)) AS last_us FROM dialogs d LEFT JOIN messages m USING (peer_id)
    WHERE kind = 'user' AND NOT useless AND coalesce(meta ->> '$.name_manual', name) = 'DELETED' AND total_msgs >= 20 GROUP BY 1, 2""")
def deleted_candidates(s, d):
    return analytics.deleted_candidates(T(s, d, "dialogs"), T(s, d, "messages")).select("peer_id", "total_msgs", US("first_at").alias("first_us"), US("last_at").alias("last_us"))


# ---- joins, aggregates, sets
@query("""SELECT m.id, array_to_string(list_sort(list_distinct(list(att_type) FILTER (att_type IS NOT NULL))), ', ') AS atts, coalesce(bool_or(kind = 'voice'), false) AS has_voice
    FROM messages m JOIN attachments a ON a.message_id = m.id GROUP BY 1""")
def attachments_agg(s, d):
    a = T(s, d, "attachments").groupBy("message_id").agg(F.array_join(F.array_sort(F.collect_set("att_type")), ", ").alias("atts"), F.coalesce(F.bool_or(F.col("kind") == "voice"), F.lit(False)).alias("has_voice"))
    return T(s, d, "messages").select("id").join(a, F.col("id") == F.col("message_id")).select("id", "atts", "has_voice")


@query("""SELECT count(*) AS n, sum(CASE WHEN v.attachment_id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS with_voice, round(sum(duration_s::DOUBLE), 2) AS seconds
    FROM messages m LEFT JOIN attachments a ON a.message_id = m.id LEFT JOIN voice_transcripts v ON v.message_id = m.id""")
def message_fanout(s, d):
    m, a, v = T(s, d, "messages").select("id"), T(s, d, "attachments").select("message_id"), T(s, d, "voice_transcripts").select(F.col("message_id").alias("mid"), "attachment_id", "duration_s")
    j = m.join(a, m.id == a.message_id, "left").join(v, m.id == v.mid, "left")
    return j.agg(F.count("*").alias("n"), F.count("attachment_id").alias("with_voice"), F.round(F.sum(F.col("duration_s").cast("double")), 2).alias("seconds"))


@query("""SELECT a.id AS attachment_id, m.peer_id FROM attachments a JOIN messages m ON m.id = a.message_id JOIN dialogs d USING (peer_id)
    WHERE a.kind = 'photo' AND a.url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM photo_analysis p WHERE p.attachment_id = a.id AND p.status <> 'net_error')""")
def pending_antijoin(s, d):
    a = T(s, d, "attachments").where("kind = 'photo' and url is not null").select(F.col("id").alias("attachment_id"), "message_id")
    done = T(s, d, "photo_analysis").where("status <> 'net_error'").select("attachment_id")
    m = T(s, d, "messages").select(F.col("id").alias("message_id"), "peer_id")
    return a.join(done, "attachment_id", "left_anti").join(m, "message_id").join(T(s, d, "dialogs").select("peer_id"), "peer_id").select("attachment_id", "peer_id")


@query("""SELECT peer_id, kind FROM dialogs d WHERE EXISTS (SELECT 1 FROM photo_analysis p JOIN messages m ON m.id = p.message_id WHERE m.peer_id = d.peer_id) OR EXISTS (SELECT 1 FROM chunks c WHERE c.peer_id = d.peer_id AND c.source = 'photo')""")
def exists_or_exists(s, d):
    seen = T(s, d, "photo_analysis").select(F.col("message_id").alias("id")).join(T(s, d, "messages").select("id", "peer_id"), "id")
    return joins.semi_any(T(s, d, "dialogs").select("peer_id", "kind"), "peer_id", seen, T(s, d, "chunks").where("source = 'photo'"))


#: The two sides of the merges: results of a first run, and of one that repeats what failed or gave no text; together all rows.
_FIRST, _AGAIN = "status <> 'unreadable'", "status <> 'ok' OR ocr_text IS NULL"


@query("""WITH old AS (SELECT attachment_id, status, bytes FROM photo_analysis WHERE status <> 'unreadable'), new AS (SELECT attachment_id, 'again' AS status, n_faces::INT AS bytes FROM photo_analysis WHERE status <> 'ok' OR ocr_text IS NULL)
    SELECT coalesce(o.attachment_id, n.attachment_id) AS attachment_id, coalesce(n.status, o.status) AS status, CASE WHEN n.attachment_id IS NOT NULL THEN n.bytes ELSE o.bytes END AS bytes FROM old o FULL JOIN new n USING (attachment_id)""")
def upsert_merge(s, d):
    p = T(s, d, "photo_analysis")
    old = p.where(_FIRST).select("attachment_id", "status", "bytes")
    new = p.where(_AGAIN).select("attachment_id", F.lit("again").alias("status"), F.col("n_faces").cast("int").alias("bytes"))
    return merge.upsert(old, new, ["attachment_id"])


@query("""WITH old AS (SELECT attachment_id, status FROM photo_analysis WHERE status <> 'unreadable'), new AS (SELECT attachment_id, 'retried' AS status FROM photo_analysis WHERE status <> 'ok' OR ocr_text IS NULL)
    SELECT coalesce(o.attachment_id, n.attachment_id) AS attachment_id, CASE WHEN o.attachment_id IS NULL THEN n.status WHEN n.attachment_id IS NOT NULL AND o.status = 'net_error' THEN n.status ELSE o.status END AS status FROM old o FULL JOIN new n USING (attachment_id)""")
def conditional_upsert(s, d):
    p = T(s, d, "photo_analysis")
    old, new = p.where(_FIRST).select("attachment_id", "status"), p.where(_AGAIN).select("attachment_id", F.lit("retried").alias("status"))
    return merge.upsert(old, new, ["attachment_id"], when=F.col("old.status") == "net_error")


@query("""WITH old AS (SELECT id, att_type FROM attachments WHERE download_ok IS NOT NULL) SELECT id, att_type FROM old UNION ALL SELECT id, upper(att_type) FROM attachments a WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.id = a.id)""")
def insert_ignore(s, d):
    a = T(s, d, "attachments")
    return merge.insert_ignore(a.where("download_ok is not null").select("id", "att_type"), a.select("id", F.upper("att_type").alias("att_type")), ["id"])


@query("""WITH fresh AS (SELECT DISTINCT peer_id, msg_from, msg_to FROM chunks JOIN dialogs USING (peer_id) WHERE own_share >= 0.2::FLOAT AND source = 'messages') SELECT id, source FROM chunks c WHERE source <> 'messages' OR EXISTS (SELECT 1 FROM fresh f WHERE f.peer_id = c.peer_id AND f.msg_from = c.msg_from AND f.msg_to = c.msg_to)""")
def stale_keys(s, d):
    c = T(s, d, "chunks").select("id", "peer_id", "msg_from", "msg_to", "source")
    fresh = c.join(T(s, d, "dialogs").where(F.col("own_share") >= F.lit(0.2).cast("float")).select("peer_id"), "peer_id")
    return merge.delete_stale(c, fresh.where("source = 'messages'"), ["peer_id", "msg_from", "msg_to"], F.col("source") == "messages").select("id", "source")


@query("""SELECT peer_id, coalesce(CASE WHEN useless OR kind = 'user' THEN 'Имя' END, meta ->> '$.name_manual', name) AS name FROM dialogs""")
def dialog_names(s, d):
    """Upsert of dialog names where a manual name in the old row's meta survives, then a merge of keys into meta."""
    dl = T(s, d, "dialogs").select("peer_id", "name", "kind", "useless", F.coalesce("meta", F.lit("{}")).alias("meta"))
    new = dl.select("peer_id", "name")
    up = merge.upsert(dl, new, ["peer_id"], expr={"name": F.coalesce(F.get_json_object("old.meta", "$.name_manual"), F.col("new.name"))})
    patched = up.withColumn("meta", F.when(F.coalesce(F.col("useless"), F.lit(False)) | (F.col("kind") == "user"), merge.merge_meta(F.col("meta"), {"name_manual": "Имя"})).otherwise(F.col("meta")))
    return patched.select("peer_id", F.coalesce(F.get_json_object("meta", "$.name_manual"), "name").alias("name"))


@query("""SELECT peer_id, vk_msg_id, arg_min(id, id) AS id FROM messages GROUP BY 1, 2""")
def stage_dedup(s, d):
    return merge.first_seen(T(s, d, "messages").select("peer_id", "vk_msg_id", "id"), ["peer_id", "vk_msg_id"], [F.asc("id")])


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY message_id, id) AS r FROM attachments WHERE kind IN ('voice', 'photo') AND url IS NOT NULL AND url <> '') SELECT id, kind, url FROM k WHERE r = 1""")
def media_manifest_dedup(s, d):
    a = T(s, d, "attachments").where("kind in ('voice', 'photo') and url <> ''")
    return merge.first_seen(a, ["url"], [F.asc("message_id"), F.asc("id")]).select("id", "kind", "url")


@query("""SELECT id, CASE WHEN contains(coalesce(url, ''), '/amsg/') AND suffix(lower(split_part(coalesce(url, ''), '?', 1)), '.ogg') THEN 'voice' WHEN att_type = 'Фотография' THEN 'photo' ELSE 'other' END AS kind,
    left(sha1(url), 16) || regexp_extract(split_part(url, '?', 1), '(\\.[A-Za-z0-9]{1,5})$', 1) AS file, nullif(regexp_extract(url, 'size=(\\d+x\\d+)', 1), '') AS url_size FROM attachments""")
def attachment_kinds(s, d):
    return url_size(T(s, d, "attachments")).select("id", attachment_kind("att_type", "url").alias("kind"), media_file("url").alias("file"), "url_size")


@query("""SELECT d.peer_id, d.kind, d.useless, d.name, count(a.id) FILTER (v.attachment_id IS NULL) AS pending FROM dialogs d JOIN messages m ON m.peer_id = d.peer_id JOIN attachments a ON a.message_id = m.id AND a.kind = 'voice'
    LEFT JOIN voice_transcripts v ON v.attachment_id = a.id GROUP BY 1, 2, 3, 4 HAVING count(a.id) FILTER (v.attachment_id IS NULL) > 0""")
def queue_pending_having(s, d):
    return analytics.pending_voice(*(T(s, d, t) for t in ("dialogs", "messages", "attachments", "voice_transcripts"))).select("peer_id", "kind", "useless", "name", "pending")


@query("""WITH p AS (SELECT d.peer_id, d.kind, d.useless, d.name, d.own_share, count(*) AS pending FROM dialogs d JOIN messages m ON m.peer_id = d.peer_id JOIN attachments a ON a.message_id = m.id AND a.kind = 'voice'
    WHERE NOT EXISTS (SELECT 1 FROM voice_transcripts v WHERE v.attachment_id = a.id) GROUP BY 1, 2, 3, 4, 5)
    SELECT row_number() OVER (ORDER BY CASE WHEN peer_id = 2000000007 THEN 1 ELSE 1073741824 END, pending DESC, peer_id) AS position, peer_id, name, pending, CASE WHEN own_share > 0.4::FLOAT THEN 'done' ELSE 'pending' END AS status
    FROM p WHERE peer_id = 2000000007 OR (NOT coalesce(useless, false) AND kind NOT IN ('community', 'chat'))""")
def queue_build(s, d):
    pend = analytics.pending_voice(*(T(s, d, t) for t in ("dialogs", "messages", "attachments", "voice_transcripts")))
    old = pend.select("peer_id", F.when(F.col("own_share") > F.lit(0.4).cast("float"), "done").otherwise("running").alias("status"))
    return analytics.build_queue(pend, old, first=[2000000007], wanted_chats=[2000000007])


@query("""WITH years AS (SELECT DISTINCT peer_id, year(make_timestamp(epoch_us(sent_at))) AS y FROM messages WHERE sent_at IS NOT NULL), periods AS (SELECT peer_id, y AS year_from, 'с ' || y AS description FROM (SELECT DISTINCT peer_id, year(make_timestamp(epoch_us(sent_at))) AS y FROM messages WHERE sent_at IS NOT NULL AND is_own))
    SELECT y.peer_id, y.y, coalesce((SELECT arg_max(description, year_from) FROM periods p WHERE p.peer_id = y.peer_id AND p.year_from <= y.y), (SELECT arg_min(description, year_from) FROM periods p WHERE p.peer_id = y.peer_id)) AS description FROM years y""")
def asof_period(s, d):
    years = T(s, d, "messages").where("sent_at is not null").select("peer_id", F.year("sent_at").cast("long").alias("y")).distinct()
    spoke = T(s, d, "messages").where("sent_at is not null and is_own").select("peer_id", F.year("sent_at").cast("long").alias("y")).distinct()
    periods = spoke.select("peer_id", F.col("y").alias("year_from"), F.concat(F.lit("с "), F.col("y").cast("string")).alias("description"))
    return joins.asof_latest(years, periods, "peer_id", "y", "year_from", ["description"])


_EPOCHS = [("2025-01-01 01:01:34", "v1"), ("2025-06-01 01:34:59", "v2"), ("2025-09-01 01:36:40", "v3"), ("2025-12-01 01:48:47", "v4")]
_CASE = "CASE " + " ".join(f"WHEN epoch_us(created_at) < epoch_us(TIMESTAMP '{t}') THEN '{v}'" for t, v in _EPOCHS) + " ELSE 'v5' END"


@query(f"SELECT {_CASE} AS version, settings, count(*) AS n FROM voice_transcripts WHERE created_at IS NOT NULL GROUP BY 1, 2")
def epoch_range_join(s, d):
    v = T(s, d, "voice_transcripts").where("created_at is not null")
    return v.groupBy(joins.epoch_label(F.col("created_at"), _EPOCHS, "v5").alias("version"), "settings").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT m.id AS vid, peer_id, sent_at FROM voice_transcripts t JOIN messages m ON m.id = t.message_id), p AS (SELECT DISTINCT m.id AS pid, peer_id, sent_at FROM photo_analysis t JOIN messages m ON m.id = t.message_id)
    SELECT vid, pid FROM v JOIN p USING (peer_id) WHERE abs(date_diff('day', make_timestamp(epoch_us(v.sent_at))::DATE, make_timestamp(epoch_us(p.sent_at))::DATE)) <= 1""")
def band_join_eval(s, d):
    m = T(s, d, "messages").select("id", "peer_id", F.to_date("sent_at").alias("day"))
    v = T(s, d, "voice_transcripts").select(F.col("message_id").alias("id")).join(m, "id").select(F.col("id").alias("vid"), "peer_id", F.col("day").alias("vday"))
    p = T(s, d, "photo_analysis").select(F.col("message_id").alias("id")).distinct().join(m, "id").select(F.col("id").alias("pid"), "peer_id", F.col("day").alias("pday"))
    return joins.band_join(v, p, ["peer_id"], "vday", "pday", 1).select("vid", "pid")


@query("""SELECT c.id, count(*) AS n FROM chunks c JOIN messages m ON m.peer_id = c.peer_id AND m.vk_msg_id BETWEEN c.msg_from AND c.msg_to GROUP BY 1""")
def chunk_sources(s, d):
    c = T(s, d, "chunks").select("id", "peer_id", "msg_from", "msg_to")
    return joins.points_in(T(s, d, "messages").select("peer_id", "vk_msg_id"), c, ["peer_id"], "vk_msg_id", "msg_from", "msg_to").groupBy("id").agg(F.count("*").alias("n"))


_SETS = "(SELECT peer_id FROM messages WHERE is_own) {} (SELECT m.peer_id FROM photo_analysis p JOIN messages m ON m.id = p.message_id)"


def _sides(s, d):
    m = T(s, d, "messages")
    return m.where("is_own").select("peer_id"), T(s, d, "photo_analysis").select(F.col("message_id").alias("id")).join(m.select("id", "peer_id"), "id").select("peer_id")


QUERIES["set_union"], SQL["set_union"] = lambda s, d: _sides(s, d)[0].union(_sides(s, d)[1]).distinct(), _SETS.format("UNION")
QUERIES["set_intersect"], SQL["set_intersect"] = lambda s, d: _sides(s, d)[0].intersect(_sides(s, d)[1]), _SETS.format("INTERSECT")
QUERIES["set_except"], SQL["set_except"] = lambda s, d: _sides(s, d)[0].subtract(_sides(s, d)[1]), _SETS.format("EXCEPT")


# ---- reports
@query("""SELECT 'dialogs' AS t, count(*) AS n FROM dialogs UNION ALL SELECT 'messages', count(*) FROM messages UNION ALL SELECT 'attachments', count(*) FROM attachments UNION ALL SELECT 'voice_transcripts', count(*) FROM voice_transcripts
    UNION ALL SELECT 'first', epoch_us(min(sent_at)) FROM messages UNION ALL SELECT 'last', epoch_us(max(sent_at)) FROM messages""")
def verify_counts(s, d):
    parts = [T(s, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n") for t in ("dialogs", "messages", "attachments", "voice_transcripts")]
    m = T(s, d, "messages").agg(US(F.min("sent_at")).alias("a"), US(F.max("sent_at")).alias("b"))
    parts.append(m.select(F.expr("stack(2, 'first', a, 'last', b) as (t, n)")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""SELECT d.name, emb_model, count(*) AS n, count(*) FILTER (embedding IS NOT NULL) AS done FROM chunks JOIN dialogs d USING (peer_id) GROUP BY 1, 2""")
def embed_stats(s, d):
    return T(s, d, "chunks").select("peer_id", "emb_model", "embedding").join(T(s, d, "dialogs").select("peer_id", "name"), "peer_id").groupBy("name", "emb_model").agg(F.count("*").alias("n"), F.count("embedding").alias("done"))


@query("SELECT settings, count(*) AS n, count(*) FILTER (suspect) AS suspect, round(avg(max_repeat), 2) AS avg_repeat FROM voice_transcripts GROUP BY 1")
def settings_report(s, d):
    return T(s, d, "voice_transcripts").groupBy("settings").agg(F.count("*").alias("n"), F.count_if("suspect").alias("suspect"), F.round(F.avg("max_repeat"), 2).alias("avg_repeat"))


@query("SELECT status, count(*) AS n FROM photo_analysis GROUP BY 1")
def photo_status(s, d):
    return T(s, d, "photo_analysis").groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n, count(*) FILTER (length(ocr_text) >= 8) AS with_text, count(*) FILTER (n_faces > 0) AS with_faces, round(count(*) FILTER (length(ocr_text) >= 8) / count(*), 4) AS share FROM photo_analysis WHERE status = 'ok'""")
def photo_stats(s, d):
    p = T(s, d, "photo_analysis").where("status = 'ok'")
    return p.agg(F.count("*").alias("n"), F.count_if(F.length("ocr_text") >= 8).alias("with_text"), F.count_if(F.col("n_faces") > 0).alias("with_faces"), F.round(F.count_if(F.length("ocr_text") >= 8) / F.count("*"), 4).alias("share"))


@query("""SELECT x ->> '$.id' AS label, count(*) AS n FROM (SELECT unnest(json_transform(labels, '["JSON"]')) AS x FROM photo_analysis WHERE labels IS NOT NULL AND json_valid(labels)) WHERE try_cast(x ->> '$.conf' AS DOUBLE) >= 0.5 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""")
def labels_unnest_top(s, d):
    x = T(s, d, "photo_analysis").select(F.explode(F.from_json("labels", "array<string>")).alias("x"))
    x = x.select(F.get_json_object("x", "$.id").alias("label"), F.get_json_object("x", "$.conf").try_cast("double").alias("conf")).where("conf >= 0.5")
    return x.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(12)


@query()
def label_pick(s, d):
    return T(s, d, "photo_analysis").select("attachment_id", F.array_join(chunking.label_names("labels"), ", ").alias("tags"))


@query("""WITH r AS (SELECT attachment_id, message_id, status, ocr_conf, ocr_text, row_number() OVER (PARTITION BY message_id ORDER BY attachment_id) AS ord FROM photo_analysis)
    SELECT attachment_id, ord FROM r WHERE status = 'ok' AND ocr_conf >= 0.6::FLOAT AND length(ocr_text) >= 40""")
def photo_ordinal_then_filter(s, d):
    w = Window.partitionBy("message_id").orderBy("attachment_id")
    p = T(s, d, "photo_analysis").select("attachment_id", "message_id", "status", "ocr_conf", "ocr_text").withColumn("ord", F.row_number().over(w).cast("long"))
    return p.where((F.col("status") == "ok") & (F.col("ocr_conf") >= F.lit(0.6).cast("float")) & (F.length("ocr_text") >= 40)).select("attachment_id", "ord")


# ---- transcripts
@query()
def repetition_suspect(s, d):
    v = T(s, d, "voice_transcripts").select("attachment_id", repetition_stats("transcript").alias("r"))
    return v.select("attachment_id", F.col("r.best").alias("best"), F.col("r.word").alias("word"), F.round("r.share", 6).alias("share"), is_suspect(F.col("r")).alias("suspect"))


_BOILER = "regexp_matches(transcript, '(?i)субтитры\\s*(делал|сделал|создавал|подготовил|от)?|редактор\\s+субтитров|корректор|dimatorzok|amara\\.org|продолжение\\s+следует|подписывайтесь\\s+на\\s+канал|спасибо\\s+за\\s+просмотр|ставьте\\s+лайки')"


@query(f"SELECT attachment_id, coalesce({_BOILER}, false) AS boiler FROM voice_transcripts")
def boilerplate_flag(s, d):
    return T(s, d, "voice_transcripts").select("attachment_id", is_boilerplate("transcript").alias("boiler"))


@query()
def quality_gate(s, d):
    q = analytics.quality(T(s, d, "voice_transcripts"), T(s, d, "messages"))
    return q.withColumn("stop", (F.col("total") >= 20) & (F.col("bad_pct") > 5))


@query(f"""SELECT peer_id, count(*) AS total, count(*) FILTER (trim(coalesce(transcript, '')) = '') AS empty, count(*) FILTER (trim(coalesce(transcript, '')) <> '' AND {_BOILER}) AS boiler FROM voice_transcripts v JOIN messages m ON m.id = v.message_id GROUP BY 1""")
def quality_counts(s, d):
    return analytics.quality(T(s, d, "voice_transcripts"), T(s, d, "messages")).select("peer_id", "total", "empty", "boiler")


@query("""SELECT a.id, CASE WHEN v.attachment_id IS NOT NULL AND v.transcript IS NOT NULL THEN 'done' WHEN v.max_repeat >= 3 THEN 'exhausted' ELSE 'left' END AS status FROM attachments a LEFT JOIN voice_transcripts v ON v.attachment_id = a.id WHERE a.kind = 'voice'""")
def transcript_status(s, d):
    v = T(s, d, "voice_transcripts").select(F.col("attachment_id").alias("name"), "transcript", "max_repeat")
    voice = T(s, d, "attachments").where("kind = 'voice'").select(F.col("id").alias("name"))
    got = analytics.transcript_status(voice, v.where("transcript is not null"), v.select("name", F.col("max_repeat").alias("attempts")))
    return got.select(F.col("name").alias("id"), "status")


def _placed(s, d):
    m = T(s, d, "messages").select("id", "peer_id", "page_file", "vk_msg_id", "sent_at", "sender", "text")
    v = T(s, d, "attachments").where("kind = 'voice'").select(F.col("message_id").alias("id")).distinct().withColumn("voice", F.lit(True))
    return asr.positions(m.join(v, "id", "left"), ["peer_id", "page_file"], [F.asc("vk_msg_id"), F.asc("id")])


_PLACED = """WITH p AS (SELECT m.*, row_number() OVER (PARTITION BY peer_id, page_file ORDER BY vk_msg_id, id) - 1 AS pos, EXISTS (SELECT 1 FROM attachments a WHERE a.message_id = m.id AND a.kind = 'voice') AS voice FROM messages m),
    v AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY peer_id, page_file ORDER BY pos) <= 12 THEN 0 ELSE 1 END AS fresh FROM p WHERE voice),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY peer_id, page_file ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM v),
    c AS (SELECT *, (row_number() OVER (PARTITION BY peer_id, page_file, run ORDER BY pos) - 1) // 8 AS cluster FROM r)
"""


@query(_PLACED + "SELECT peer_id || '-' || arg_min(vk_msg_id, pos) || '-' || arg_max(vk_msg_id, pos) AS batch_key, min(pos) AS lo, max(pos) AS hi, count(*) AS n FROM c GROUP BY peer_id, page_file, run, cluster")
def voice_clusters(s, d):
    c = asr.clusters(_placed(s, d), ["peer_id", "page_file"], F.col("voice"))
    return asr.batches(c, ["peer_id", "page_file"], "peer_id", "vk_msg_id", "sent_at").select("batch_key", F.col("lo").cast("long"), F.col("hi").cast("long"), "n")


@query(_PLACED + """, b AS (SELECT peer_id, page_file, peer_id || '-' || arg_min(vk_msg_id, pos) || '-' || arg_max(vk_msg_id, pos) AS batch_key, min(pos) - 8 AS lo, max(pos) + 8 AS hi FROM c GROUP BY peer_id, page_file, run, cluster),
    x AS (SELECT batch_key, pos, coalesce(sender, '?') || ': ' || left(replace(text, chr(10), ' '), 120) AS line, row_number() OVER (PARTITION BY batch_key ORDER BY pos DESC) AS back FROM p JOIN b USING (peer_id, page_file) WHERE pos BETWEEN lo AND hi AND text <> '')
    SELECT batch_key, string_agg(line, chr(10) ORDER BY pos) AS context FROM x WHERE back <= 60 GROUP BY 1""")
def context_window(s, d):
    placed = _placed(s, d)
    b = asr.batches(asr.clusters(placed, ["peer_id", "page_file"], F.col("voice")), ["peer_id", "page_file"], "peer_id", "vk_msg_id", "sent_at")
    return asr.context(placed, b, ["peer_id", "page_file"])


@query()
def neighbor_snippets(s, d):
    n = asr.neighbour_snippets(_placed(s, d), ["peer_id", "page_file"]).where("voice")
    return n.select("id", F.array_join("snippets", " | ").alias("snippets"))


# ---- chunks and export
def _lines(s, d):
    return chunking.message_lines(*(T(s, d, t) for t in ("messages", "attachments", "voice_transcripts")), chunking.select_dialogs(T(s, d, "dialogs")))


@query()
def chunk_dialogs(s, d):
    c = chunking.with_header(chunking.chunk_dialogs(_lines(s, d), T(s, d, "messages")), T(s, d, "dialogs"))
    return c.select("peer_id", "part", "msg_from", "msg_to", US("ts_from").alias("from_us"), US("ts_to").alias("to_us"), "n_messages", "text", F.array_join("senders", ",").alias("senders"), "n_voice", "has_own", "month")


@query()
def chunk_stats(s, d):
    c = chunking.chunk_dialogs(_lines(s, d), T(s, d, "messages"))
    return c.groupBy("peer_id").agg(F.count("*").alias("chunks"), F.sum(F.length("body")).alias("chars"), F.sum(F.when(F.col("part") <= 1, F.col("n_voice"))).alias("voice"), F.sum(F.when(F.col("part") <= 1, F.col("n_messages"))).alias("messages"))


@query()
def photo_chunks(s, d):
    c = chunking.photo_chunks(T(s, d, "photo_analysis"), T(s, d, "messages"), T(s, d, "dialogs"))
    return c.select("peer_id", "msg_from", "part", "attachment_id", "text", F.array_join("tags", ",").alias("tags"), "ocr_chars", "month")


@query("""WITH r AS (SELECT p.*, row_number() OVER (PARTITION BY message_id ORDER BY attachment_id) AS part FROM photo_analysis p)
    SELECT m.peer_id, m.vk_msg_id AS msg_from, part, attachment_id, length(regexp_replace(ocr_text, '^\\s+|\\s+$', '', 'g')) AS ocr_chars FROM r JOIN messages m ON m.id = r.message_id JOIN dialogs d USING (peer_id)
    WHERE status = 'ok' AND ocr_conf >= 0.6::FLOAT AND length(ocr_text) >= 40 AND len(regexp_extract_all(ocr_text, '\\p{L}{3,}')) >= 3""")
def photo_chunk_keys(s, d):
    c = chunking.photo_chunks(T(s, d, "photo_analysis"), T(s, d, "messages"), T(s, d, "dialogs"))
    return c.select("peer_id", "msg_from", F.col("part").cast("long").alias("part"), "attachment_id", F.col("ocr_chars").cast("long").alias("ocr_chars"))


@query()
def collapse_repeats_text(s, d):
    m = T(s, d, "messages").select("id", collapse_repeats("text").alias("text"))
    return m.select("id", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query()
def split_long_lines(s, d):
    m = T(s, d, "messages").where(F.length("text") > chunking.HARD_MAX).select("id", F.posexplode(chunking.split_lines(F.concat(F.lit("Я (10:00): "), "text"))).alias("part", "piece"))
    return m.select("id", "part", F.length("piece").alias("n"))


def _export_rows(s, d):
    a = T(s, d, "attachments").groupBy("message_id").agg(F.array_sort(F.collect_set("att_type")).alias("atts"), F.coalesce(F.bool_or(F.col("kind") == "voice"), F.lit(False)).alias("has_voice"))
    v = merge.first_seen(T(s, d, "voice_transcripts").select("message_id", "attachment_id", "transcript", "duration_s"), ["message_id"], [F.asc("attachment_id")]).drop("attachment_id")
    m = T(s, d, "messages").select("id", "peer_id", "vk_msg_id", "sent_at", "sender", "is_own", "text")
    r = m.join(a.withColumnRenamed("message_id", "id"), "id", "left").join(v.withColumnRenamed("message_id", "id"), "id", "left")
    return r.withColumn("who", chunking.speaker("is_own", "sender", F.lit(None).cast("string"))).withColumn("has_voice", F.coalesce("has_voice", F.lit(False))).withColumn("atts", F.coalesce("atts", F.array().cast("array<string>")))


@query("""WITH a AS (SELECT message_id, array_to_string(list_transform(list_sort(list_distinct(list(att_type) FILTER (att_type IS NOT NULL))), lambda x: '[' || x || ']'), ', ') AS atts, coalesce(bool_or(kind = 'voice'), false) AS hv FROM attachments GROUP BY 1),
    v AS (SELECT message_id, arg_min(transcript, attachment_id) AS tr0, first(transcript ORDER BY attachment_id) AS tr, first(duration_s ORDER BY attachment_id) AS du FROM voice_transcripts GROUP BY 1),
    r AS (SELECT m.id, CASE WHEN is_own THEN 'Я' WHEN coalesce(sender, '') <> '' THEN sender ELSE '?' END AS who, coalesce(strftime(make_timestamp(epoch_us(sent_at)), '%H:%M'), '--:--') AS clk, text,
      (floor(trunc(coalesce(du, 0)) / 60))::BIGINT || ':' || lpad((trunc(coalesce(du, 0))::BIGINT % 60)::VARCHAR, 2, '0') AS dur, tr, coalesce(hv, false) AS hv, atts FROM messages m LEFT JOIN a ON a.message_id = m.id LEFT JOIN v ON v.message_id = m.id),
    b AS (SELECT id, who, clk, concat_ws(chr(10), CASE WHEN text <> '' THEN text END, CASE WHEN tr <> '' THEN '[голосовое ' || dur || '] ' || tr WHEN hv THEN '[голосовое ' || dur || ', без расшифровки]' END, nullif(atts, '')) AS body FROM r)
    SELECT id, '[' || clk || '] ' || who || ':' || chr(10) || CASE WHEN body <> '' THEN body ELSE '*(пусто)*' END || chr(10) || chr(10) AS block FROM b""")
def export_render(s, d):
    return export.blocks(_export_rows(s, d), "txt").select("id", "block")


@query()
def export_parts(s, d):
    p = export.parts(export.blocks(_export_rows(s, d)), ["peer_id"], [F.asc_nulls_last("sent_at"), F.asc("vk_msg_id"), F.asc("id")], cap=20_000, head=200, cont=100)
    return p.groupBy("peer_id", "part").agg(F.count("*").alias("n"), F.sum(F.octet_length("shown")).alias("bytes"))


@query("SELECT peer_id, left(trim(regexp_replace(regexp_replace(regexp_replace(name, '[^\\p{L}\\p{N}_ \\-]', '_', 'g'), '_{2,}', '_', 'g'), ' {2,}', ' ', 'g')), 50) AS file FROM dialogs WHERE name <> ''")
def file_names(s, d):
    return T(s, d, "dialogs").where("name <> ''").select("peer_id", sanitize_filename("name").alias("file"))


@query("SELECT id, CASE WHEN length(text) > 400 THEN left(text, 400) || '…' ELSE text END AS text FROM chunks")
def previews(s, d):
    return T(s, d, "chunks").select("id", preview("text").alias("text"))


@query("SELECT attachment_id, (trunc(coalesce(duration_s, 0))::BIGINT // 60) || ':' || lpad((trunc(coalesce(duration_s, 0))::BIGINT % 60)::VARCHAR, 2, '0') AS dur FROM voice_transcripts")
def durations(s, d):
    return T(s, d, "voice_transcripts").select("attachment_id", fmt_duration("duration_s").alias("dur"))


@query("SELECT peer_id, CASE WHEN peer_id >= 2000000000 THEN 'chat' WHEN peer_id < 0 THEN 'community' ELSE 'user' END AS kind FROM dialogs")
def peer_kinds(s, d):
    return T(s, d, "dialogs").select("peer_id", peer_kind("peer_id").alias("kind"))


@query("SELECT 'unique peer_id,vk_msg_id' AS rule, count(*) AS n FROM (SELECT 1 FROM messages GROUP BY peer_id, vk_msg_id HAVING count(*) > 1) UNION ALL SELECT 'check sender', count(*) FROM messages WHERE sender IS NOT NULL AND sender <> 'Вы'")
def integrity(s, d):
    return merge.violations(T(s, d, "messages").select("peer_id", "vk_msg_id", "sender"), ["peer_id", "vk_msg_id"], {"sender": ("Вы",)})


_PAGE = """SELECT peer_id, vk_msg_id, arg_min(epoch_us(sent_at) // 1000000, id) AS at_s, arg_min(is_own, id) AS is_own, arg_min(md5(regexp_replace(regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), '\\s', '', 'g')), id) AS digest FROM messages
    GROUP BY 1, 2"""


@query(_PAGE)
def html_messages(s, d):
    """All messages written as archive pages and read back."""
    from lorespark.functions.dates import MONTHS
    m = merge.first_seen(T(s, d, "messages"), ["peer_id", "vk_msg_id"], [F.asc("id")])
    msk = F.from_utc_timestamp(F.timestamp_micros(US("sent_at")), "Europe/Moscow")
    day = F.concat(F.day(msk), F.lit(" "), F.element_at(F.array(*[F.lit(x) for x in MONTHS]), F.month(msk)), F.lit(" "), F.year(msk), F.lit(" в "), F.hour(msk), F.lit(":"), F.date_format(msk, "mm:ss"))
    esc = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    who = F.when(F.col("is_own"), "Вы").otherwise("<a href=\"https://host.example/id1\">Имя</a>")
    body = F.concat(F.lit('<div class="message" data-id="'), F.col("vk_msg_id"), F.lit('"><div class="message__header">'), who, F.coalesce(F.concat(F.lit(", "), day), F.lit("")), F.lit("</div><div>"), esc, F.lit('<div class="kludges"></div></div></div>'))
    pages = m.withColumn("b", body).groupBy("peer_id", F.concat("page_file", F.lit("-"), F.floor(F.col("vk_msg_id") / 50)).alias("page_file")).agg(F.concat(F.lit("<html>"), F.array_join(F.collect_list("b"), "\n"), F.lit("</html>")).alias("html"))
    got = html.parse_messages(pages.withColumn("page_no", F.lit(0)))
    return got.select("peer_id", "vk_msg_id", F.unix_seconds("sent_at").alias("at_s"), "is_own", F.md5(F.regexp_replace("text", r"\s", "")).alias("digest"))
