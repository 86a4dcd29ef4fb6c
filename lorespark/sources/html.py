"""Archive pages: cp1251 HTML, newest message first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.dates import parse_date
from lorespark.functions.text import attachment_kind, clean_text, media_file, message_text, trim_all, unescape
from lorespark.operators.merge import first_seen

_ATTACHMENT = r"""(?s)attachment__description">([^<]*)</div>(?:\s*<a class='attachment__link' href='([^']*)')?"""


def decode_cp1251(c: Column | str) -> Column:
    """Bytes of an archive page as text; needs the legacy charset settings of build_session."""
    return F.decode(F.col(c) if isinstance(c, str) else c, "windows-1251")


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """(peer_id, page_file, page_no, html) of messages/<peer>/messages<N>.html."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", "messages*.html").option("recursiveFileLookup", "true").load(root)
    return (b.select(F.regexp_extract("path", r"/(-?\d+)/messages\d+\.html$", 1).alias("peer"), F.regexp_extract("path", r"/(messages(\d+)\.html)$", 1).alias("page_file"),
                     F.regexp_extract("path", r"/messages(\d+)\.html$", 1).try_cast("int").alias("page_no"), decode_cp1251("content").alias("html"))
            .where("peer <> ''").select(F.col("peer").cast("long").alias("peer_id"), "page_file", "page_no", "html"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(peer_id, name) of index-messages.html; of repeated peers the last entry."""
    page = spark.read.format("binaryFile").load(path).select(decode_cp1251("content").alias("h"))
    rx = r'href="(-?\d+)/messages0\.html"[^>]*>([^<]+)'
    rows = page.select(F.posexplode(F.arrays_zip(F.regexp_extract_all("h", F.lit(rx), 1).alias("p"), F.regexp_extract_all("h", F.lit(rx), 2).alias("n"))).alias("i", "x"))
    rows = rows.select("i", F.col("x.p").cast("long").alias("peer_id"), trim_all(unescape(F.col("x.n"))).alias("name"))
    return first_seen(rows, ["peer_id"], [F.desc("i")]).drop("i")


def split_messages(pages: DataFrame) -> DataFrame:
    """One row per message of each page: its own columns, msg_id and body; idx is its place, newest first."""
    cut = F.slice(F.split("html", '<div class="message" data-id="'), 2, 1 << 30)
    rows = pages.select(*[c for c in pages.columns if c != "html"], F.posexplode(cut).alias("idx", "m"))
    return (rows.withColumn("msg_id", F.regexp_extract("m", r'^(\d+)"', 1).try_cast("long")).where("msg_id is not null")
            .withColumn("body", F.regexp_replace("m", r'^\d+"', "")).drop("m"))


def parse_messages(pages: DataFrame) -> DataFrame:
    """(peer_id, vk_msg_id, sent_at, sender, is_own, text, page_file), a message that stands on two pages once."""
    m = split_messages(pages)
    sender = trim_all(unescape(F.regexp_extract("body", r'message__header">(?:<a[^>]*>)?([^<,]+)', 1)))
    out = m.select("peer_id", F.col("msg_id").alias("vk_msg_id"), parse_date("body").alias("sent_at"), F.when(F.length(sender) > 0, sender).otherwise("?").alias("sender"), message_text("body").alias("text"), "page_file", "page_no", "idx")
    out = out.withColumn("is_own", F.col("sender") == "Вы")
    return first_seen(out, ["peer_id", "vk_msg_id"], [F.asc("page_no"), F.asc("idx")]).drop("page_no", "idx")


def parse_attachments(pages: DataFrame) -> DataFrame:
    """(peer_id, vk_msg_id, att_type, kind, url, file), each once."""
    m = split_messages(pages)
    pair = F.arrays_zip(F.regexp_extract_all("body", F.lit(_ATTACHMENT), 1).alias("t"), F.regexp_extract_all("body", F.lit(_ATTACHMENT), 2).alias("u"))
    a = m.select("peer_id", F.col("msg_id").alias("vk_msg_id"), F.explode(pair).alias("a")).select("peer_id", "vk_msg_id", clean_text(F.col("a.t")).alias("att_type"), unescape(F.col("a.u")).alias("url"))
    return a.distinct().withColumn("kind", attachment_kind("att_type", "url")).withColumn("file", F.when(F.col("url") != "", media_file("url")))


def media_manifest(attachments: DataFrame) -> DataFrame:
    """Voice and photo addresses, each at its first message."""
    return first_seen(attachments.where("kind in ('voice', 'photo') and url <> ''"), ["url"], [F.asc("peer_id"), F.asc("vk_msg_id")])


def links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, href, text) of the links of any page, entities decoded, tags inside the text dropped."""
    rx = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(rx), 1).alias("h"), F.regexp_extract_all(html, F.lit(rx), 2).alias("t"))
    return pages.select(key, F.posexplode(both).alias("pos", "x")).select(key, "pos", unescape(F.col("x.h")).alias("href"), clean_text(F.col("x.t"), keep_lines=False).alias("text"))
