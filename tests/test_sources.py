from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
import struct

from pyspark.sql import functions as F

from lorespark.plans import archive
from lorespark.schemas import SCHEMAS
from lorespark.sources import files, html, media
from lorespark.streaming.ingest import Snapshot, merge_stream, session_windows

PAGE = """<html><div class="message" data-id="{0}">
  <div class="message__header"><a href="https://h.example/id1">Имя &amp; Ко</a>, 27 дек 2018 в 0:58:19</div>
  <div>первый &lt;тест&gt;<br>строка<div class="kludges"><div class="attachment">
  <div class="attachment__description">Фотография</div>
  <a class='attachment__link' href='https://h.example/a.jpg?size=10x20'>x</a></div></div></div></div>
<div class="message" data-id="{1}"><div class="message__header">Вы, 31 фев 2018 в 0:58:19</div><div>второй</div></div></html>"""


def test_archive_pages(spark, tmp_path):
    for peer, no, ids in ((5, 0, (2, 1)), (5, 50, (1, 3)), (-7, 0, (9, 8))):
        d = tmp_path / "messages" / str(peer)
        d.mkdir(parents=True, exist_ok=True)
        (d / f"messages{no}.html").write_bytes(PAGE.format(*ids).encode("cp1251") + b"\x98")
    pages = html.read_pages(spark, str(tmp_path / "messages"))
    m = {(r.peer_id, r.vk_msg_id): r for r in html.parse_messages(pages).collect()}
    assert set(m) == {(5, 1), (5, 2), (5, 3), (-7, 8), (-7, 9)}
    assert m[5, 2].sender == "Имя & Ко" and m[5, 2].text.split() == ["первый", "<тест>", "строка"] and m[5, 2].sent_at is not None and not m[5, 2].is_own
    assert m[5, 3].is_own and m[5, 3].sent_at is None and m[5, 1].page_file == "messages0.html"
    a = html.parse_attachments(pages).collect()
    assert {r.vk_msg_id for r in a} == {2, 1, 9} and all(r.kind == "photo" and r.file.endswith(".jpg") for r in a)
    assert html.media_manifest(html.parse_attachments(pages)).count() == 1
    assert media.url_size(html.parse_attachments(pages)).first().url_size == "10x20"
    (tmp_path / "index-messages.html").write_bytes('<a href="5/messages0.html">Один</a> <a href="-7/messages0.html">Два</a> <a href="5/messages0.html">Три</a>'.encode("cp1251"))
    assert {(r.peer_id, r.name) for r in html.read_index(spark, str(tmp_path / "index-messages.html")).collect()} == {(5, "Три"), (-7, "Два")}


def test_all_messages_go_through_pages(spark, tmp_path):
    texts = ["просто", "тире — и «кавычки»…", "смех 😀 № 5", "\u00a0край\u00a0и\u00a0середина\u00a0", "a <b> & c", "две\nстроки", "", None, "naïve 中文"]
    data = [(i, 5, 100 + i, dt.datetime(2020, 1, 1, 12), i % 2 == 0, t, "messages0.html") for i, t in enumerate(texts)]
    data += [(50, 5, 100, dt.datetime(2021, 1, 1), False, "повтор", "messages0.html"), (51, -7, 100, None, False, "без даты…", "messages0.html")]
    spark.createDataFrame(data, "id long, peer_id long, vk_msg_id long, sent_at timestamp, is_own boolean, text string, page_file string").write.parquet(str(tmp_path / "messages.parquet"))
    got = {(r.peer_id, r.vk_msg_id): (r.at_s, r.is_own, r.digest) for r in archive.html_messages(spark, str(tmp_path)).collect()}
    at = int(dt.datetime(2020, 1, 1, 12, tzinfo=dt.UTC).timestamp())
    digest = lambda t: hashlib.md5(re.sub(r"\s", "", (t or "").strip(), flags=re.A).encode()).hexdigest()
    want = {(5, 100 + i): (at, i % 2 == 0, digest(t)) for i, t in enumerate(texts)} | {(-7, 100): (None, False, digest("без даты…"))}
    assert got == want


def test_files(spark, tmp_path):
    t = tmp_path / "transcripts"
    t.mkdir()
    (t / "-5-10.txt").write_text("речь")
    (t / "-5-10.meta.json").write_text(json.dumps({"msg_id": 10, "attempts": 2, "ok": True}))
    (t / "6-11.meta.json").write_text(json.dumps({"msg_id": 11, "attempts": 3}))
    got = {r.name: r for r in files.read_transcripts(spark, str(t)).collect()}
    assert (got["-5-10"].peer_id, got["-5-10"].msg_id, got["-5-10"].transcript, got["-5-10"].meta.attempts) == (-5, 10, "речь", 2)
    assert got["6-11"].transcript is None and got["6-11"].peer_id == 6
    v = tmp_path / "vocab"
    v.mkdir()
    (v / "5.md").write_text("# Слова\n```text\nдача, я, мангал\n```\n## Собрано\n- ёж — зверь *(встретилось: 5-1-2, 2020-01-01)*\n")
    (v / "5-periods.md").write_text("# Периоды\n### Школа, 2010 год, начало\nописание\n```text\nподсказка\n```\n### 2010 год опять\nдругое\n### Потом 2012 год\nтретье\n")
    terms = {(r.term, r.source, r.gloss) for r in files.read_vocab(spark, str(v)).collect()}
    assert terms == {("дача", "manual", None), ("мангал", "manual", None), ("ёж", "sonnet", "зверь")}
    assert {(r.year_from, r.description, r.whisper_prompt) for r in files.read_periods(spark, str(v)).collect()} == {(2010, "другое", ""), (2012, "третье", "")}
    known = spark.createDataFrame([(5, "Дача у реки")], "peer_id long, term string")
    new = spark.createDataFrame([(5, "дача — место"), (5, "мангал - жарить"), (5, "я")], "peer_id long, term string")
    assert [r.key for r in files.new_terms(new, known).collect()] == ["мангал"]
    files.append_jsonl(spark.createDataFrame([("voice", "u", 1, 2, "x", "f")], files.MANIFEST), str(tmp_path / "m"))
    files.append_jsonl(spark.createDataFrame([("photo", "u", 1, 2, "x", "f")], files.MANIFEST), str(tmp_path / "m"))
    assert files.read_jsonl(spark, str(tmp_path / "m"), files.MANIFEST).where("kind = 'voice'").count() == 1
    ogg = b"x" * 9 + b"OggS" + b"\0\0" + struct.pack("<q", 96000) + b"rest"
    df = spark.createDataFrame([(ogg,), (b"nothing",), (None,)], "b binary").select(files.ogg_duration("b"))
    assert [r[0] for r in df.collect()] == [2.0, 0.0, 0.0]
    assert files.columns_differ(spark.createDataFrame([], "a int, z int"), ["a", "b"]) == (["b"], ["z"])


def test_media(spark):
    def fetch(url):
        if url == "net":
            raise OSError("down")
        code = {"gone": 404, "busy": 503}.get(url, 200)
        return media.Reply(code, b"<html>" if url == "stub" else b"jpegdata", {"Content-Type": "image/jpeg", "X": "y"})

    def analyse(b):
        return {"lines": [("раз", 0.9), ("два", 0.8)], "labels": [{"id": "a", "conf": 0.3}, {"id": "b", "conf": 0.9}, {"id": "c", "conf": 0.1}], "n_faces": 1}

    got = {r.url: r for r in media.fetch_all(spark.createDataFrame([(u,) for u in ("ok", "net", "gone", "busy", "stub")], "url string"), fetch).collect()}
    assert {u: r.status for u, r in got.items()} == {"ok": "ok", "net": "net_error", "gone": "http_error", "busy": "http_error", "stub": "html_stub"}
    assert len(got["ok"].sha256) == 64 and json.loads(got["ok"].headers) == {"Content-Type": "image/jpeg"}
    a = media.analyse_all(media.fetch_all(spark.createDataFrame([("ok",)], "url string"), fetch), analyse).first()
    assert a.ocr_text == "раз\nдва" and a.ocr_conf == 0.85 and [x["id"] for x in json.loads(a.labels)] == ["b", "a"]


def test_streams(spark, tmp_path):
    src, target = str(tmp_path / "in"), Snapshot(spark, str(tmp_path / "table"), SCHEMAS["vocab_terms"])
    spark.createDataFrame([(1, "a", "x", "manual", None, None), (1, "b", "x", "manual", None, None)], SCHEMAS["vocab_terms"]).write.parquet(src)
    for add in ([(1, "b", "new", "manual", None, None), (2, "c", "y", "manual", None, None)], None):
        merge_stream(spark.readStream.schema(SCHEMAS["vocab_terms"]).parquet(src), target, ["peer_id", "term"], "gloss", f"test-{tmp_path.name}").awaitTermination()
        if add:
            spark.createDataFrame(add, SCHEMAS["vocab_terms"]).write.mode("append").parquet(src)
    assert sorted((r.peer_id, r.term, r.gloss) for r in target.read().collect()) == [(1, "a", "x"), (1, "b", "new"), (2, "c", "y")]
    ev = spark.createDataFrame([(1, "2020-01-01 00:00:00"), (1, "2020-01-01 03:00:00"), (1, "2020-01-01 06:00:01")], "u long, t string").select("u", F.to_timestamp("t").alias("ts"))
    assert sorted(r.n_events for r in session_windows(ev, "u", "ts").collect()) == [1, 2]


def test_core_stands_without_the_optional_subpackage():
    import pathlib
    root = pathlib.Path(__file__).parent.parent / "lorespark"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "lorespark.llm" not in p.read_text().replace("``lorespark.llm``", ""), p
