"""Queries of refresh, selection, reports and evaluation, each with the SQL it is compared with where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions import sql
from lorespark.functions.dates import MONTHS_GENITIVE
from lorespark.functions.text import TYPOS
from lorespark.operators import analytics, chunking, evaluation, export, merge, retrieval
from lorespark.plans import archive
from lorespark.providers import HashEmbedder, OverlapScorer
from lorespark.session import table as T
from lorespark.sources import files, media

QUERIES, SQL = {}, {}
#: Words of address as the SQL of the vocatives query counts them.
_VOCATIVES = archive.SQL["vocatives"].replace("SELECT peer_id, word, n FROM (SELECT *, row_number() OVER (PARTITION BY peer_id ORDER BY n DESC, word) AS r FROM n) WHERE r <= 15", "SELECT * FROM n")


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f
    return add


@query("SELECT peer_id, kind FROM dialogs WHERE NOT coalesce(useless, false) AND coalesce(total_msgs, 0) > 0 AND kind = 'user'")
def dialog_selection(s: SparkSession, d: str) -> DataFrame:
    return chunking.select_dialogs(T(s, d, "dialogs"), kind="user").select("peer_id", "kind")


_KEYS = ["peer_id", "msg_from", "msg_to", "part", "source"]


def _snapshots(s, d):
    """The chunks of a first run (one per key, the earliest), and those of a second one, which made them of the dialogs with enough own messages."""
    c = T(s, d, "chunks").select("id", *_KEYS, "emb_model")
    old = merge.first_seen(c, _KEYS, [F.asc("id")])
    new = merge.first_seen(c, _KEYS, [F.desc("id")]).join(T(s, d, "dialogs").where(F.col("own_share") >= F.lit(0.2).cast("float")).select("peer_id"), "peer_id").select(*c.columns)
    return old, new


_SNAP = """WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY peer_id, msg_from, msg_to, part, source ORDER BY id) AS r FROM chunks) WHERE r = 1),
    n AS (SELECT c.* FROM (SELECT *, row_number() OVER (PARTITION BY peer_id, msg_from, msg_to, part, source ORDER BY id DESC) AS r FROM chunks) c JOIN dialogs USING (peer_id) WHERE r = 1 AND own_share >= 0.2::FLOAT)"""


@query(_SNAP + """ SELECT id, source FROM o WHERE source <> 'messages' OR EXISTS (SELECT 1 FROM n WHERE n.peer_id = o.peer_id AND n.msg_from = o.msg_from AND n.msg_to = o.msg_to AND n.part = o.part AND n.source = o.source)
    UNION ALL SELECT id, source FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE n.peer_id = o.peer_id AND n.msg_from = o.msg_from AND n.msg_to = o.msg_to AND n.part = o.part AND n.source = o.source)""")
def chunk_refresh(s, d):
    old, new = _snapshots(s, d)
    return merge.refresh(old, new, _KEYS, F.col("source") == "messages").select("id", "source")


@query(_SNAP + """ SELECT id, source FROM o WHERE source <> 'photo' OR peer_id NOT IN (SELECT peer_id FROM n) UNION ALL SELECT id, source FROM n WHERE source = 'photo'""")
def chunk_rebuild(s, d):
    old, new = _snapshots(s, d)
    return merge.rebuild(old, new, new.select("peer_id"), "photo").select("id", "source")


@query("""WITH o AS (SELECT * FROM attachments WHERE download_ok IS NOT NULL), m AS (SELECT peer_id, vk_msg_id, min(id) AS id FROM messages GROUP BY 1, 2),
    st AS (SELECT DISTINCT m.peer_id, m.vk_msg_id, a.att_type, a.kind, a.url FROM attachments a JOIN messages m ON m.id = a.message_id)
    SELECT message_id, att_type, kind, url FROM o UNION ALL SELECT m.id, att_type, kind, url FROM st JOIN m USING (peer_id, vk_msg_id) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.message_id = m.id)""")
def attachment_guard(s, d):
    a, m = T(s, d, "attachments").select("id", "message_id", "att_type", "kind", "url", "download_ok"), T(s, d, "messages").select("id", "peer_id", "vk_msg_id")
    stage = a.drop("id").join(m.withColumnRenamed("id", "message_id"), "message_id").select("peer_id", "vk_msg_id", "att_type", "kind", "url").distinct()
    first = m.groupBy("peer_id", "vk_msg_id").agg(F.min("id").alias("id"))
    return merge.insert_where_none(a.where("download_ok is not null").drop("download_ok"), stage, first)


@query("""SELECT peer_id, meta ->> '$.name_manual' AS manual, meta ->> '$.checked' AS checked, meta ->> '$.times' AS times FROM (SELECT peer_id, json_merge_patch(coalesce(meta, '{}'), '{"checked": true, "times": 3}') AS meta FROM dialogs)""")
def meta_merge(s, d):
    m = merge.merge_meta(F.coalesce("meta", F.lit("{}")), {"checked": True, "times": 3})
    return T(s, d, "dialogs").select("peer_id", m.alias("meta")).select("peer_id", *[F.get_json_object("meta", f"$.{k}").alias(a) for k, a in (("name_manual", "manual"), ("checked", "checked"), ("times", "times"))])


@query("SELECT peer_id, count(*) AS n, round(sum(coalesce(duration_s::DOUBLE, 0)) / 60, 1) AS minutes FROM voice_transcripts v JOIN messages m ON m.id = v.message_id GROUP BY 1")
def minutes_per_peer(s, d):
    return analytics.minutes_per_peer(T(s, d, "voice_transcripts"), T(s, d, "messages"))


@query("""WITH p AS (SELECT d.peer_id, d.kind, d.useless, count(*) AS pending FROM dialogs d JOIN messages m ON m.peer_id = d.peer_id JOIN attachments a ON a.message_id = m.id AND a.kind = 'voice'
    WHERE NOT EXISTS (SELECT 1 FROM voice_transcripts v WHERE v.attachment_id = a.id) GROUP BY 1, 2, 3)
    SELECT CASE WHEN useless THEN 'useless' WHEN kind = 'community' THEN 'community' WHEN kind = 'chat' THEN 'chat' ELSE 'queue' END AS reason, count(*) AS dialogs, sum(pending)::BIGINT AS pending FROM p GROUP BY 1""")
def queue_totals(s, d):
    return analytics.queue_totals(analytics.pending_voice(*(T(s, d, t) for t in ("dialogs", "messages", "attachments", "voice_transcripts"))))


@query("""WITH p AS (SELECT *, coalesce(status = 'ok', false) AS ok, coalesce(ocr_conf >= 0.6::FLOAT, false) AS conf, coalesce(length(ocr_text) >= 40, false) AS long, coalesce(len(regexp_extract_all(ocr_text, '\\p{L}{3,}')) >= 3, false) AS words,
      labels IS NOT NULL AND (NOT json_valid(labels) OR len(list_filter(json_transform(labels, '["JSON"]'), lambda x: (x ->> '$.id') IS NULL OR try_cast(x ->> '$.conf' AS DOUBLE) IS NULL)) > 0) AS broken FROM photo_analysis)
    SELECT count(*) AS photos, count(*) FILTER (NOT ok) AS not_ok, count(*) FILTER (ok AND NOT conf) AS unsure, count(*) FILTER (ok AND conf AND NOT long) AS short, count(*) FILTER (ok AND conf AND long AND NOT words) AS wordless,
      count(*) FILTER (ok AND conf AND long AND words) AS chunked, count(*) FILTER (coalesce(broken, false)) AS bad_labels FROM p""")
def photo_run(s, d):
    return analytics.photo_run(T(s, d, "photo_analysis"))


@query("""SELECT a.id AS attachment_id, m.peer_id FROM attachments a JOIN messages m ON m.id = a.message_id JOIN dialogs d USING (peer_id)
    WHERE a.kind = 'photo' AND a.url IS NOT NULL AND d.kind = 'user' AND own_share >= 0.2::FLOAT AND NOT EXISTS (SELECT 1 FROM photo_analysis p WHERE p.attachment_id = a.id AND p.status <> 'net_error')
    ORDER BY epoch_us(sent_at) NULLS LAST, a.id LIMIT 25""")
def photos_oldest_first(s, d):
    return media.pending_photos(*(T(s, d, t) for t in ("attachments", "photo_analysis", "messages", "dialogs")), kind="user", least_own=0.2, limit=25).select("attachment_id", "peer_id")


@query("""WITH m AS (SELECT * FROM messages WHERE peer_id = 2000000007 AND epoch_us(sent_at) >= epoch_us(TIMESTAMP '2010-01-01') AND epoch_us(sent_at) < epoch_us(TIMESTAMP '2012-04-01'))
    SELECT '# ' || (SELECT coalesce(name, '?') FROM dialogs WHERE peer_id = 2000000007) || ', 2010-01 – 2012-03, сообщений: ' || count(*) AS line FROM m
    UNION ALL SELECT strftime(make_timestamp(epoch_us(sent_at)), '%Y-%m-%d %H:%M') || ' ' || CASE WHEN is_own THEN 'Я' WHEN trim(coalesce(sender, '')) <> '' THEN sender ELSE '?' END || ': ' || replace(text, chr(10), ' ') FROM m""")
def dialog_dump(s, d):
    return export.dump(T(s, d, "messages"), T(s, d, "dialogs"), 2000000007, (2010, 1), (2012, 3))


@query("""SELECT id FROM attachments a WHERE kind = 'voice' AND url IS NOT NULL AND EXISTS (SELECT 1 FROM attachments f WHERE f.download_ok AND f.url IS NOT NULL AND left(sha1(f.url), 16) || regexp_extract(split_part(f.url, '?', 1), '(\\.[A-Za-z0-9]{1,5})$', 1)
    = left(sha1(a.url), 16) || regexp_extract(split_part(a.url, '?', 1), '(\\.[A-Za-z0-9]{1,5})$', 1))""")
def voice_with_files(s, d):
    from lorespark.functions.text import media_file
    a = T(s, d, "attachments").where("url is not null")
    listing = a.where("download_ok").select(F.concat(F.lit("/media/"), media_file("url")).alias("path"))
    return files.with_files(a.where("kind = 'voice'").select("id", "url"), listing).select("id")


#: Longest run of a word: rows numbered by place, and by place within the word; equal differences are one run.
_RUNS = """w AS (SELECT attachment_id, unnest(x) AS word, generate_subscripts(x, 1) AS i FROM (SELECT attachment_id, regexp_extract_all(lower(coalesce(transcript, '')), '[\\p{L}\\p{N}\\p{M}_\\x{200c}\\x{200d}]+') AS x FROM voice_transcripts)),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY attachment_id, word ORDER BY i) AS grp FROM w),
    r AS (SELECT attachment_id, word, grp, count(*) AS run, min(i) AS start FROM g GROUP BY 1, 2, 3),
    b AS (SELECT attachment_id, max(run) AS best, arg_min(word, (-run, start + run)) AS word FROM r GROUP BY 1),
    n AS (SELECT attachment_id, count(*) AS n FROM w GROUP BY 1),
    st AS (SELECT v.attachment_id, v.message_id, v.transcript, coalesce(best, 0) AS best, coalesce(word, '') AS word, round(coalesce(best / n, 0), 6) AS share, coalesce(n, 0) AS n FROM voice_transcripts v LEFT JOIN b USING (attachment_id) LEFT JOIN n USING (attachment_id)),
    q AS (SELECT *, CASE WHEN best >= 15 THEN true WHEN word IN ('""" + "', '".join(sql.FILLERS) + """') THEN false WHEN best >= 7 THEN true ELSE best >= 4 AND share > 0.3 AND n >= 30 END AS suspect FROM st)"""
_BOILER = "regexp_matches(transcript, '(?i)субтитры\\s*(делал|сделал|создавал|подготовил|от)?|редактор\\s+субтитров|корректор|dimatorzok|amara\\.org|продолжение\\s+следует|подписывайтесь\\s+на\\s+канал|спасибо\\s+за\\s+просмотр|ставьте\\s+лайки')"
_QUALITY = "WITH " + _RUNS + f""", j AS (SELECT peer_id, trim(coalesce(transcript, '')) = '' AS blank, suspect, coalesce({_BOILER}, false) AS boiler FROM q JOIN messages m ON m.id = q.message_id),
    c AS (SELECT peer_id, count(*) AS total, count(*) FILTER (NOT blank AND suspect) AS suspect, count(*) FILTER (NOT blank AND boiler) AS boiler, count(*) FILTER (blank) AS empty FROM j GROUP BY 1)
    SELECT *, suspect + boiler + empty AS bad, round(100 * (suspect + boiler + empty) / total, 1) AS bad_pct, total >= 20 AND round(100 * (suspect + boiler + empty) / total, 1) > 5 AS stop FROM c"""
SQL["repetition_suspect"] = "WITH " + _RUNS + " SELECT attachment_id, best, word, share, suspect FROM q"
SQL["quality_gate"] = _QUALITY


@query("WITH " + _RUNS + f""" SELECT attachment_id, concat_ws(',', CASE WHEN suspect THEN 'suspect' END, CASE WHEN {_BOILER} THEN 'boilerplate' END) AS reasons FROM q WHERE trim(coalesce(transcript, '')) <> '' AND (suspect OR coalesce({_BOILER}, false))""")
def bad_transcripts(s, d):
    return analytics.bad_transcripts(T(s, d, "voice_transcripts")).select("attachment_id", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT attachment_id AS name FROM voice_transcripts WHERE NOT coalesce(settings = (SELECT max(settings) FROM voice_transcripts), false)")
def reset_by_settings(s, d):
    v = T(s, d, "voice_transcripts").select(F.col("attachment_id").alias("name"), "settings")
    return files.to_reset(v, settings=v.agg(F.max("settings")).first()[0])


@query("SELECT attachment_id, best, suspect FROM (WITH " + _RUNS + " SELECT attachment_id, best, suspect FROM q)")
def sql_functions(s, d):
    sql.register(s)
    T(s, d, "voice_transcripts").createOrReplaceTempView("lorespark_voice")
    return s.sql("SELECT attachment_id, repetition_stats(transcript).best AS best, is_suspect(transcript) AS suspect FROM lorespark_voice")


#: A bound that holds in these tables.
@query("SELECT peer_id, count(*) AS total FROM messages GROUP BY 1 HAVING count(*) FILTER (is_own) < 150 AND count(*) FILTER (is_own) / count(*) < 0.35")
def dialogs_rarely_joined(s, d):
    n = T(s, d, "messages").groupBy("peer_id").agg(F.count("*").alias("total"), F.count_if("is_own").alias("mine"))
    return n.where((F.col("mine") < 150) & (F.col("mine") / F.col("total") < 0.35)).select("peer_id", "total")


@query("""WITH v AS (SELECT peer_id, word, n, row_number() OVER (PARTITION BY peer_id ORDER BY n DESC, word) AS r FROM (""" + _VOCATIVES + """) WHERE n >= 3)
    SELECT d.peer_id, (SELECT string_agg(word, ',' ORDER BY r) FROM v WHERE v.peer_id = d.peer_id AND r <= 5) AS names FROM dialogs d WHERE kind = 'user'""")
def name_guesses(s, d):
    peers = T(s, d, "dialogs").where("kind = 'user'")
    return analytics.guesses(T(s, d, "messages"), peers).select("peer_id", F.array_join("names", ",").alias("names"))


@query()
def identify(s, d):
    """Candidates as if all user dialogs had lost their name."""
    nameless = T(s, d, "dialogs").withColumn("meta", F.lit("{}")).withColumn("name", F.lit("DELETED"))
    return analytics.identify(nameless, T(s, d, "messages")).select("peer_id", F.array_join("names", ",").alias("names"), F.size("samples").alias("n_samples"), F.length("prompt").alias("n_prompt"))


@query("""SELECT peer_id, first_us, last_us FROM (SELECT d.peer_id, epoch_us(min(sent_at)) AS first_us, epoch_us(max(sent_at)) AS last_us FROM dialogs d LEFT JOIN messages m USING (peer_id) WHERE kind = 'user' AND NOT useless AND total_msgs >= 20 GROUP BY 1)""")
def nameless_spans(s, d):
    nameless = T(s, d, "dialogs").withColumn("meta", F.lit("{}")).withColumn("name", F.lit("DELETED"))
    got = analytics.deleted_candidates(nameless, T(s, d, "messages"))
    return got.select("peer_id", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"))


@query("(SELECT peer_id FROM messages WHERE text = '') EXCEPT (SELECT m.peer_id FROM voice_transcripts v JOIN messages m ON m.id = v.message_id)")
def set_except_voice(s, d):
    m = T(s, d, "messages")
    return m.where("text = ''").select("peer_id").subtract(T(s, d, "voice_transcripts").select(F.col("message_id").alias("id")).join(m.select("id", "peer_id"), "id").select("peer_id"))


# ---- evaluation
def _cases(s, d):
    """Every chunk's own first words as a query that has to find it: (case_id, query, peer_id, day), one per dialog and month."""
    c = T(s, d, "chunks").where("text is not null and ts_from is not null and source = 'messages'")
    w = Window.partitionBy("peer_id", F.date_format("ts_from", "yyyy-MM")).orderBy("id")
    first = c.withColumn("r", F.row_number().over(w)).where("r = 1")
    return first.select(F.col("id").alias("case_id"), F.array_join(F.slice(retrieval.terms("text"), 9, 3), " ").alias("query"), "peer_id", F.to_date("ts_from").alias("day")).where("query <> ''")


_T = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


@query(f"""WITH c0 AS (SELECT id, peer_id, ts_from, {_T} AS w, row_number() OVER (PARTITION BY peer_id, strftime(make_timestamp(epoch_us(ts_from)), '%Y-%m') ORDER BY id) AS r FROM chunks WHERE text IS NOT NULL AND ts_from IS NOT NULL AND source = 'messages'),
    q AS (SELECT id AS case_id, list_distinct(w[9:11]) AS words, peer_id, make_timestamp(epoch_us(ts_from))::DATE AS day FROM c0 WHERE r = 1 AND len(w) >= 9),
    t AS (SELECT id, word, count(*) AS n FROM (SELECT id, unnest({_T}) AS word FROM chunks WHERE text IS NOT NULL) GROUP BY 1, 2),
    h AS (SELECT case_id, t.id, sum(n) AS n FROM (SELECT case_id, unnest(words) AS word FROM q) x JOIN t USING (word) GROUP BY 1, 2 HAVING count(*) = (SELECT len(words) FROM q WHERE q.case_id = x.case_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, id) AS rank FROM h),
    f AS (SELECT q.case_id, min(CASE WHEN rank <= 20 AND c.peer_id = q.peer_id AND abs(date_diff('day', make_timestamp(epoch_us(c.ts_from))::DATE, day)) <= 1 THEN rank END) AS rank FROM q LEFT JOIN k USING (case_id) LEFT JOIN chunks c ON c.id = k.id GROUP BY 1)
    SELECT 'fts' AS mode, round(sum(coalesce(1.0 / rank, 0)) / count(*), 6) AS mrr, count(*) FILTER (rank = 1) AS top1, count(*) FILTER (rank <= 5) AS top5, count(*) FILTER (rank IS NULL) AS misses, count(*) AS cases, 0::BIGINT AS wrong_source FROM f""")
def eval_fts(s, d):
    return evaluation.evaluate(T(s, d, "chunks"), _cases(s, d), HashEmbedder(64), OverlapScorer(), modes=("fts",))


@query()
def eval_modes(s, d):
    """All five modes over the same cases; the embedder knows nothing of the stored vectors, so its modes show the harness, not the model."""
    return evaluation.evaluate(T(s, d, "chunks"), _cases(s, d), HashEmbedder(64), OverlapScorer())


# ---- SQL of queries that stand in archive
_NAMES = ", ".join("('" + k + "', '" + v + "')" for k, v in chunking.LABELS.items())
_TAGS = f"""names(id, name) AS (VALUES {_NAMES}),
    items AS (SELECT attachment_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM (SELECT attachment_id, json_transform(labels, '["JSON"]') AS x FROM photo_analysis WHERE labels IS NOT NULL AND json_valid(labels))),
    sure AS (SELECT attachment_id, trim(x ->> '$.id') AS id, try_cast(x ->> '$.conf' AS DOUBLE) AS conf, i FROM items),
    shown AS (SELECT attachment_id, coalesce(name, replace(s.id, '_', ' ')) AS name, row_number() OVER (PARTITION BY attachment_id ORDER BY conf DESC, i) AS r FROM sure s LEFT JOIN names n ON n.id = s.id WHERE conf >= 0.7 AND length(s.id) > 0),
    once AS (SELECT attachment_id, name, min(r) AS r FROM shown GROUP BY 1, 2),
    four AS (SELECT attachment_id, list(name ORDER BY r)[1:4] AS tags FROM once GROUP BY 1)"""
SQL["label_pick"] = "WITH " + _TAGS + " SELECT p.attachment_id, coalesce(array_to_string(tags, ', '), '') AS tags FROM photo_analysis p LEFT JOIN four USING (attachment_id)"

_MONTH = "CASE month(make_timestamp(epoch_us({0}))) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MONTHS_GENITIVE, 1)) + " END"
_DAY = "(day(make_timestamp(epoch_us({0}))) || ' ' || " + _MONTH + " || ' ' || year(make_timestamp(epoch_us({0}))))"
SQL["photo_chunks"] = "WITH " + _TAGS + f""", r AS (SELECT p.*, row_number() OVER (PARTITION BY message_id ORDER BY attachment_id) AS part FROM photo_analysis p),
    x AS (SELECT m.peer_id, m.vk_msg_id AS msg_from, part, attachment_id, regexp_replace(ocr_text, '^\\s+|\\s+$', '', 'g') AS ocr, coalesce(tags, []) AS tags, sent_at, d.name, d.kind, is_own, trim(coalesce(sender, '')) AS sender
      FROM r JOIN messages m ON m.id = r.message_id JOIN dialogs d USING (peer_id) LEFT JOIN four USING (attachment_id)
      WHERE status = 'ok' AND ocr_conf >= 0.6::FLOAT AND length(ocr_text) >= 40 AND len(regexp_extract_all(ocr_text, '\\p{{L}}{{3,}}')) >= 3)
    SELECT peer_id, msg_from, part, attachment_id, length(ocr) AS ocr_chars, array_to_string(tags, ',') AS tags, strftime(make_timestamp(epoch_us(sent_at)), '%Y-%m') AS month,
      CASE kind WHEN 'user' THEN 'Переписка с ' || name WHEN 'chat' THEN 'Беседа «' || name || '»' ELSE 'Сообщество «' || name || '»' END || coalesce(', ' || {_DAY.format('sent_at')} || ' года.', '.') || chr(10)
      || CASE WHEN is_own THEN 'Я' WHEN sender IN ('DELETED', 'Deleted', 'deleted', '', 'Вы') THEN CASE WHEN kind = 'user' THEN name ELSE '?' END ELSE sender END || ' (' || coalesce(strftime(make_timestamp(epoch_us(sent_at)), '%H:%M'), '--:--') || '): [фотография'
      || CASE WHEN len(tags) > 0 THEN ', ' || array_to_string(tags, ', ') ELSE '' END || ']' || chr(10) || 'Текст на фотографии: ' || ocr AS text FROM x"""

#: Packing by a walk over each dialog's rows.
SQL["export_parts"] = f"""WITH RECURSIVE a AS (SELECT message_id, array_to_string(list_transform(list_sort(list_distinct(list(att_type) FILTER (att_type IS NOT NULL))), lambda x: '[' || x || ']'), ', ') AS atts, coalesce(bool_or(kind = 'voice'), false) AS hv FROM attachments GROUP BY 1),
    v AS (SELECT message_id, first(transcript ORDER BY attachment_id) AS tr, first(duration_s ORDER BY attachment_id) AS du FROM voice_transcripts GROUP BY 1),
    r AS (SELECT m.id, peer_id, vk_msg_id, epoch_us(sent_at) AS us, coalesce('## ' || {_DAY.format('sent_at')} || chr(10) || chr(10), '') AS day, CASE WHEN is_own THEN 'Я' WHEN coalesce(sender, '') <> '' THEN sender ELSE '?' END AS who,
      coalesce(strftime(make_timestamp(epoch_us(sent_at)), '%H:%M'), '--:--') AS clk, text, (trunc(coalesce(du, 0))::BIGINT // 60) || ':' || lpad((trunc(coalesce(du, 0))::BIGINT % 60)::VARCHAR, 2, '0') AS dur, tr, coalesce(hv, false) AS hv, atts
      FROM messages m LEFT JOIN a ON a.message_id = m.id LEFT JOIN v ON v.message_id = m.id),
    b AS (SELECT *, concat_ws(chr(10), CASE WHEN text <> '' THEN text END, CASE WHEN tr <> '' THEN '🎤 *Голосовое (' || dur || '):* ' || tr WHEN hv THEN '🎤 *Голосовое (' || dur || ') — без расшифровки*' END, nullif(atts, '')) AS body FROM r),
    o AS (SELECT peer_id, row_number() OVER (PARTITION BY peer_id ORDER BY us NULLS LAST, vk_msg_id, id) AS n, day, strlen(day) AS dl, strlen('**' || who || '** · ' || clk || chr(10) || CASE WHEN body <> '' THEN body ELSE '*(пусто)*' END || chr(10) || chr(10)) AS bl FROM b),
    w AS (SELECT peer_id, n, day, 1 AS part, dl + bl AS shown, 200 + dl + bl AS size FROM o WHERE n = 1 AND 200 + dl + bl <= 20000
      UNION ALL SELECT peer_id, n, day, 2, dl + bl, 100 + dl + bl FROM o WHERE n = 1 AND 200 + dl + bl > 20000
      UNION ALL SELECT o.peer_id, o.n, o.day, CASE WHEN fits THEN part ELSE part + 1 END, CASE WHEN fits THEN need ELSE dl + bl END, CASE WHEN fits THEN size + need ELSE 100 + dl + bl END
      FROM (SELECT w.part, w.size, w.day AS was, o.*, CASE WHEN o.day <> w.day THEN o.dl ELSE 0 END + o.bl AS need, w.size + CASE WHEN o.day <> w.day THEN o.dl ELSE 0 END + o.bl <= 20000 AS fits FROM w JOIN o ON o.peer_id = w.peer_id AND o.n = w.n + 1) o)
    SELECT peer_id, part, count(*) AS n, sum(shown)::BIGINT AS bytes FROM w GROUP BY 1, 2"""

_FIXES = "map([" + ", ".join(f"'{k}'" for k in TYPOS) + "], [" + ", ".join(f"'{v}'" for v in TYPOS.values()) + "])"
SQL["neighbor_snippets"] = f"""WITH p AS (SELECT m.id, peer_id, page_file, text, row_number() OVER (PARTITION BY peer_id, page_file ORDER BY vk_msg_id, id) - 1 AS pos, EXISTS (SELECT 1 FROM attachments a WHERE a.message_id = m.id AND a.kind = 'voice') AS voice FROM messages m),
    w AS (SELECT *, list_transform(list_filter(regexp_split_to_array(regexp_replace(left(text, 60), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\x{{200c}}\\x{{200d}}\\s\\p{{Z}}.,!?—-]', ' ', 'g'), '[\\s\\p{{Z}}]+'), lambda x: length(x) > 0),
      lambda x: struct_pack(w := x, core := regexp_replace(x, '^[.,!?—-]+|[.,!?—-]+$', '', 'g'))) AS ws FROM p),
    c AS (SELECT *, array_to_string(list_transform(ws, lambda x: CASE WHEN x.core = '' THEN x.w ELSE coalesce({_FIXES}[lower(x.core)], x.core) || substr(x.w, length(x.core) + 1) END), ' ') AS snip FROM w),
    n AS (SELECT id, voice, list(CASE WHEN length(text) > 0 THEN snip END) OVER (PARTITION BY peer_id, page_file ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM c)
    SELECT id, array_to_string(list_filter(near, lambda x: x IS NOT NULL AND length(x) > 3)[1:3], ' | ') AS snippets FROM n WHERE voice"""

#: Sentences, and of long ones words cut to size, are packed by a walk over them.
SQL["split_long_lines"] = r"""WITH RECURSIVE m AS (SELECT id, text FROM messages WHERE length(text) > 2600),
    s AS (SELECT id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT id, string_split(regexp_replace(text, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)) AS x FROM m)),
    w AS (SELECT id, i, unnest(x) AS w, generate_subscripts(x, 1) AS j FROM (SELECT id, i, list_filter(regexp_split_to_array(s, '[\s\p{Z}]+'), lambda x: x <> '') AS x FROM s WHERE length(s) > 1200)),
    u AS (SELECT id, i, 0 AS j, 0 AS k, length(s) AS n FROM s WHERE length(s) BETWEEN 1 AND 1200
      UNION ALL SELECT id, i, j, k, least(1200, length(w) - k * 1200) FROM (SELECT *, unnest(range(0, (length(w) + 1199) // 1200)) AS k FROM w)),
    o AS (SELECT id, n, row_number() OVER (PARTITION BY id ORDER BY i, j, k) AS r FROM u),
    p AS (SELECT id, r, 0 AS part, n AS size FROM o WHERE r = 1
      UNION ALL SELECT o.id, o.r, CASE WHEN size + 1 + o.n > 1200 THEN part + 1 ELSE part END, CASE WHEN size + 1 + o.n > 1200 THEN o.n ELSE size + 1 + o.n END FROM p JOIN o ON o.id = p.id AND o.r = p.r + 1)
    SELECT id, part, max(size) + length('Я (10:00): ') AS n FROM p GROUP BY 1, 2"""
