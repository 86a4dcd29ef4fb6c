"""Participation, entity hints, transcription queue, transcript quality, photo statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.quality import is_suspect, is_useless, repetition_stats
from lorespark.functions.text import is_boilerplate, peer_kind

# Words of address that name nobody.
NO_NAMES = """слушай смотри блин ладно короче милый милая солнце спасибо привет пока люблю прости ну да нет вот это как что почему когда если конечно кстати серьезно правда боже господи давай ой ай
хорошо окей понял поняла точно наверное просто типа алло эй сорри извини лол кек ага угу так всё лан мда ого омг воу хех пфф вай дада ааа ммм погоди понимаешь интересно круто отлично забей вообще
поздно дома""".split()
VOCATIVES = (r"^\s*([А-ЯЁа-яё][а-яё]{2,12})\s*[,!]", r",\s*([А-ЯЁа-яё][а-яё]{2,12})\s*[,.!?]*\s*$")
WORD = r"(?iu)([а-яёa-z]{3,14})"


def participation(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Counters per dialog, with the flag of dialogs one hardly takes part in."""
    voice = attachments.where("kind = 'voice'").select(F.col("message_id").alias("id")).distinct().withColumn("voice", F.lit(True))
    m = messages.select("id", "peer_id", "is_own", "sent_at").join(voice, "id", "left")
    a = m.groupBy("peer_id").agg(F.count("*").alias("total"), F.count_if("is_own").alias("mine"), F.count_if("voice").alias("voice"), F.count_if(F.col("voice") & F.col("is_own")).alias("voice_mine"),
                                 F.array_sort(F.collect_set(F.year("sent_at"))).alias("years"))
    return (a.withColumn("share", F.round(F.col("mine") / F.col("total"), 4)).withColumn("kind", peer_kind("peer_id")).withColumn("useless", is_useless("mine", "total")))


def vocatives(messages: DataFrame, mine: list[str] | None = None, top: int = 15) -> DataFrame:
    """(peer_id, word, n): how own messages address each dialog's other side, ``top`` per dialog."""
    t = F.trim(F.regexp_replace("text", "\n", " "))
    w = F.array(*[F.lower(F.regexp_extract(t, rx, 1)) for rx in VOCATIVES])
    words = messages.where("is_own and text <> ''").select("peer_id", F.explode(w).alias("word")).where((F.col("word") != "") & ~F.col("word").isin(*NO_NAMES))
    for nick in mine or []:
        words = words.where(~F.col("word").startswith(nick.lower()))
    n = words.groupBy("peer_id", "word").agg(F.count("*").alias("n"))
    return top_per(n, ["peer_id"], [F.desc("n"), F.asc("word")], top)


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def distinctive(messages: DataFrame, top: int = 20, least: int = 4, ratio: float = 3.0) -> DataFrame:
    """(peer_id, word, n, ratio): words far commoner in own messages of a dialog than in those of all others, which are taken whole."""
    words = messages.where("is_own and text <> ''").select("peer_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), 1)).alias("word"))
    here = words.groupBy("peer_id", "word").agg(F.count("*").alias("n"))
    per = here.groupBy("peer_id").agg(F.sum("n").alias("n_here"))
    every = here.groupBy("word").agg(F.sum("n").alias("n_all"))
    total = here.agg(F.sum("n").alias("total"))
    s = (here.where(F.col("n") >= least).join(every, "word").join(per, "peer_id").crossJoin(F.broadcast(total))  # one row
         .withColumn("ratio", (F.col("n") / F.col("n_here")) / ((F.col("n_all") - F.col("n") + 1) / F.greatest(F.col("total") - F.col("n_here"), F.lit(1)))).where(F.col("ratio") > ratio))
    return top_per(s.select("peer_id", "word", "n", F.round("ratio", 1).alias("ratio")), ["peer_id"], [F.desc("ratio"), F.desc("n"), F.asc("word")], top)


def sample_by_year(messages: DataFrame, per_year: int = 6) -> DataFrame:
    m = messages.where(F.length("text").between(40, 400)).select("id", "peer_id", F.date_format("sent_at", "yyyy").alias("year"), "sent_at", "is_own", "text")
    top = top_per(m, ["peer_id", "year"], [F.desc(F.length("text")), F.asc("id")], per_year)
    return top.select("id", "peer_id", "year", F.date_format("sent_at", "dd.MM.yyyy").alias("day"), "is_own", F.replace(F.substring("text", 1, 220), F.lit("\n"), F.lit(" ")).alias("text"))


def mentions_elsewhere(messages: DataFrame, dialogs: DataFrame, peer: int, names: list[str], top: int = 8) -> DataFrame:
    """(name, n) of the other dialogs that mention any of the names as a word."""
    from re import escape
    rx = r"(?iu)(^|[^а-яё])(" + "|".join(escape(n) for n in names[:5]) + r")([^а-яё]|$)"
    return (messages.where((F.col("peer_id") != peer) & F.col("text").rlike(rx)).join(dialogs.select("peer_id", "name"), "peer_id").groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("name")).limit(top))


def deleted_candidates(dialogs: DataFrame, messages: DataFrame, least: int = 20) -> DataFrame:
    """User dialogs without a name, with the time they span."""
    span = messages.groupBy("peer_id").agg(F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at"))
    name = F.coalesce(F.get_json_object("meta", "$.name_manual"), F.col("name"))
    return dialogs.where((F.col("kind") == "user") & ~F.col("useless") & (name == "DELETED") & (F.col("total_msgs") >= least)).join(span, "peer_id", "left")


def pending_voice(dialogs: DataFrame, messages: DataFrame, attachments: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(peer_id, kind, useless, name, own_share, pending): dialogs with voice messages not yet transcribed."""
    a = attachments.where("kind = 'voice'").select(F.col("id").alias("att"), "message_id")
    todo = a.join(transcripts.select(F.col("attachment_id").alias("att")), "att", "left_anti")
    n = todo.join(messages.select(F.col("id").alias("message_id"), "peer_id"), "message_id").groupBy("peer_id").agg(F.count("*").alias("pending"))
    return dialogs.select("peer_id", "kind", "useless", "name", "own_share").join(n, "peer_id")


def route(pending: DataFrame, wanted_chats: list[int] | None = None) -> DataFrame:
    """Adds ``skip``: the reason a dialog is left out, null for those in the queue."""
    listed = F.col("peer_id").isin(*wanted_chats) if wanted_chats else F.lit(False)
    return pending.withColumn("skip", F.when(listed, F.lit(None).cast("string")).when(F.col("useless"), "useless").when(F.col("kind") == "community", "community").when(F.col("kind") == "chat", "chat"))


def build_queue(pending: DataFrame, previous: DataFrame | None = None, first: list[int] | None = None, wanted_chats: list[int] | None = None) -> DataFrame:
    """(position, peer_id, name, pending, status): chosen dialogs first, then the longest; done and skipped ones keep their state."""
    q = route(pending, wanted_chats).where("skip is null")
    if previous is not None:
        q = q.join(previous.select("peer_id", F.col("status").alias("__was")), "peer_id", "left")
        q = q.withColumn("status", F.when(F.col("__was").isin("done", "skipped"), F.col("__was")).otherwise("pending"))
    else:
        q = q.withColumn("status", F.lit("pending"))
    pos = F.array_position(F.array(*[F.lit(int(p)) for p in first]).cast("array<bigint>"), F.col("peer_id")) if first else F.lit(0)
    order = [F.when(pos > 0, pos).otherwise(1 << 30), F.desc("pending"), F.asc("peer_id")]
    return q.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long")).select("position", "peer_id", "name", "pending", "status")  # one row a dialog


def judged(transcripts: DataFrame) -> DataFrame:
    s = transcripts.withColumn("__s", repetition_stats("transcript"))
    blank = F.coalesce(F.length(F.trim("transcript")), F.lit(0)) == 0
    return (s.withColumn("is_empty", blank).withColumn("is_suspect", ~blank & is_suspect(F.col("__s"))).withColumn("is_boiler", ~blank & is_boilerplate("transcript"))
            .withColumn("best", F.col("__s.best")).drop("__s"))


def quality(transcripts: DataFrame, messages: DataFrame) -> DataFrame:
    """Per dialog: transcripts, suspect, boilerplate and empty ones, share of bad ones in per cent (one may count twice)."""
    j = judged(transcripts).join(messages.select(F.col("id").alias("message_id"), "peer_id"), "message_id")
    q = j.groupBy("peer_id").agg(F.count("*").alias("total"), F.count_if("is_suspect").alias("suspect"), F.count_if("is_boiler").alias("boiler"), F.count_if("is_empty").alias("empty"))
    return q.withColumn("bad", F.col("suspect") + F.col("boiler") + F.col("empty")).withColumn("bad_pct", F.round(100 * F.col("bad") / F.col("total"), 1))


def gate(q: DataFrame, least: int = 20, most_pct: float = 5.0) -> DataFrame:
    return q.where((F.col("total") >= least) & (F.col("bad_pct") > most_pct))


def transcript_status(voice: DataFrame, done: DataFrame, attempts: DataFrame, most: int = 3) -> DataFrame:
    """(name, status): done if text and description exist, exhausted after ``most`` attempts, else left."""
    return (voice.join(done.select("name", F.lit(True).alias("__d")), "name", "left").join(attempts.select("name", "attempts"), "name", "left")
            .select("name", F.when(F.col("__d"), "done").when(F.col("attempts") >= most, "exhausted").otherwise("left").alias("status")))


def bad_transcripts(transcripts: DataFrame) -> DataFrame:
    """(attachment_id, reasons) of transcripts that a recogniser's loop or leftover text spoils, for another run."""
    j = judged(transcripts)
    why = F.filter(F.array(F.when(F.col("is_suspect"), F.lit("suspect")), F.when(F.col("is_boiler"), F.lit("boilerplate"))), lambda x: x.isNotNull())
    return j.select("attachment_id", why.alias("reasons")).where(F.size("reasons") > 0)


def minutes_per_peer(transcripts: DataFrame, messages: DataFrame) -> DataFrame:
    """(peer_id, n, minutes) of recorded speech."""
    j = transcripts.select("message_id", "duration_s").join(messages.select(F.col("id").alias("message_id"), "peer_id"), "message_id")
    return j.groupBy("peer_id").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce(F.col("duration_s").cast("double"), F.lit(0.0))) / 60, 1).alias("minutes"))


def queue_totals(pending: DataFrame, wanted_chats: list[int] | None = None) -> DataFrame:
    """(reason, dialogs, pending): what is in the queue, and what is left out for each reason."""
    r = route(pending, wanted_chats)
    return r.groupBy(F.coalesce("skip", F.lit("queue")).alias("reason")).agg(F.count("*").alias("dialogs"), F.sum("pending").alias("pending"))


def photo_run(photos: DataFrame, min_conf: float = 0.6, min_chars: int = 40) -> DataFrame:
    """Counters of a run over photos: all, not ok, unsure, short, wordless, chunked, and those whose labels are no JSON array or hold a broken item."""
    ok, conf = F.coalesce(F.col("status") == "ok", F.lit(False)), F.coalesce(F.col("ocr_conf") >= F.lit(min_conf).cast("float"), F.lit(False))
    long, words = F.coalesce(F.length("ocr_text") >= min_chars, F.lit(False)), F.coalesce(F.regexp_count("ocr_text", F.lit(r"\p{L}{3,}")) >= 3, F.lit(False))
    items = F.from_json("labels", "array<string>")
    broken = F.col("labels").isNotNull() & (items.isNull() | F.exists(items, lambda x: F.get_json_object(x, "$.id").isNull() | F.get_json_object(x, "$.conf").try_cast("double").isNull()))
    return photos.agg(F.count("*").alias("photos"), F.count_if(~ok).alias("not_ok"), F.count_if(ok & ~conf).alias("unsure"), F.count_if(ok & conf & ~long).alias("short"),
                      F.count_if(ok & conf & long & ~words).alias("wordless"), F.count_if(ok & conf & long & words).alias("chunked"), F.count_if(F.coalesce(broken, F.lit(False))).alias("bad_labels"))


def guesses(messages: DataFrame, peers: DataFrame, least: int = 3, top: int = 5) -> DataFrame:
    """(peer_id, names, words) of each peer: the commonest forms of address met ``least`` times, and the most distinctive words."""
    mine = peers.select("peer_id").distinct()
    own = messages.join(mine, "peer_id", "left_semi")
    v = vocatives(own, top=top).where(F.col("n") >= least).groupBy("peer_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("s"), "word"))).alias("v"))
    d = distinctive(messages, top=top).join(mine, "peer_id", "left_semi").groupBy("peer_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("ratio")).alias("s"), (-F.col("n")).alias("n"), "word"))).alias("d"))  # at most top each
    return mine.join(v, "peer_id", "left").join(d, "peer_id", "left").select("peer_id", F.transform("v", lambda x: x["word"]).alias("names"), F.transform("d", lambda x: x["word"]).alias("words"))


def identify(dialogs: DataFrame, messages: DataFrame, least: int = 20) -> DataFrame:
    """(peer_id, names, words, samples, prompt): one row per nameless dialog, with the question for a language model."""
    cand = deleted_candidates(dialogs, messages, least)
    s = sample_by_year(messages.join(cand.select("peer_id"), "peer_id", "left_semi"))
    who = F.when(F.col("is_own"), F.lit("Я")).otherwise("Он")
    lines = s.groupBy("peer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("year", "id", F.concat(F.lit("["), F.col("day"), F.lit("] "), who, F.lit(": "), F.col("text")).alias("line")))), lambda x: x["line"]).alias("samples"))  # six a year
    g = guesses(messages, cand).join(lines, "peer_id", "left")
    listed = lambda c: F.coalesce(F.array_join(c, ", "), F.lit(""))
    prompt = F.concat(F.lit("Кто собеседник в этой переписке? Обращения: "), listed("names"), F.lit(". Слова: "), listed("words"), F.lit(".\n"), F.coalesce(F.array_join("samples", "\n"), F.lit("")), F.lit("\nОтвет: JSON с полями name, confidence, reason."))
    return g.withColumn("prompt", prompt)
