"""Refresh, selection, SQL functions, media and streams: small cases with their edges."""

from __future__ import annotations

import datetime as dt
import json
import struct

import pytest
from pyspark.sql import functions as F

from lorespark.functions import sql
from lorespark.functions.dates import spoken_day
from lorespark.operators import analytics, chunking, evaluation, export, merge
from lorespark.operators.chunking import split_long
from lorespark.providers import HashEmbedder, OverlapScorer, PlainAnalyzer, SilentTranscriber
from lorespark.schemas import create_tables, fill
from lorespark.session import Stage, scratch
from lorespark.sources import files, html, media
from lorespark.streaming.ingest import Snapshot, StopRun, check_flags, merge_stream


def test_merge_meta_keeps_types(spark):
    rows = [(1, '{"a": 1, "b": [1, {"c": null}], "d": "x", "e": true}'), (2, None), (3, "no json"), (4, "{}")]
    got = {r.i: json.loads(r.m) for r in spark.createDataFrame(rows, "i int, m string").select("i", merge.merge_meta(F.col("m"), {"d": "ю\"", "n": 3}).alias("m")).collect()}
    assert got[1] == {"a": 1, "b": [1, {"c": None}], "d": "ю\"", "e": True, "n": 3} and got[2] == got[3] == got[4] == {"d": "ю\"", "n": 3}


def test_refresh_rebuild_and_guard(spark):
    old = spark.createDataFrame([(1, "a", "messages", "kept"), (1, "b", "messages", "gone"), (1, "p", "photo", "stays"), (2, "a", "messages", "kept")], "peer_id long, k string, source string, v string")
    new = spark.createDataFrame([(1, "a", "messages", "new"), (1, "c", "messages", "new"), (2, "a", "messages", "new")], "peer_id long, k string, source string, v string")
    got = {tuple(r) for r in merge.refresh(old, new, ["peer_id", "k", "source"], F.col("source") == "messages").collect()}
    assert got == {(1, "a", "messages", "kept"), (1, "c", "messages", "new"), (1, "p", "photo", "stays"), (2, "a", "messages", "kept")}
    got = {tuple(r) for r in merge.rebuild(old, new, new.where("peer_id = 1"), "messages").collect()}
    assert got == {(1, "a", "messages", "new"), (1, "c", "messages", "new"), (1, "p", "photo", "stays"), (2, "a", "messages", "kept")}
    m = spark.createDataFrame([(10, 1, 100), (11, 1, 101), (12, None, 102)], "id long, peer_id long, vk_msg_id long")
    have = spark.createDataFrame([(1, 10, "x")], "id long, message_id long, att_type string")
    stage = spark.createDataFrame([(1, 100, "y"), (1, 101, "y"), (1, 101, "z"), (9, 9, "y"), (None, 102, "y")], "peer_id long, vk_msg_id long, att_type string")
    assert {tuple(r) for r in merge.insert_where_none(have, stage, m).collect()} == {(10, "x"), (11, "y"), (11, "z")}
    assert merge.refresh(old.limit(0), new.limit(0), ["k"], F.lit(True)).count() == 0


def test_dialog_selection(spark):
    d = spark.createDataFrame([(1, "user", False, 5), (2, "user", True, 5), (3, "chat", None, 5), (4, "user", False, 0), (5, "user", False, None)], "peer_id long, kind string, useless boolean, total_msgs int")
    ids = lambda df: {r.peer_id for r in df.collect()}
    assert ids(chunking.select_dialogs(d)) == {1, 3} and ids(chunking.select_dialogs(d, everything=True)) == {1, 2, 3}
    assert ids(chunking.select_dialogs(d, kind="user")) == {1} and ids(chunking.select_dialogs(d, peers=[3, 4])) == {3}


def test_sql_functions(spark):
    sql.register(spark)
    one = lambda q: spark.sql(f"SELECT {q} AS x").first().x
    assert one("collapse_repeats(repeat('ХА', 10))") == "ХАХАХА" and one("collapse_repeats('код 111111')") == "код 111111" and one("collapse_repeats(null)") is None
    assert one("html_unescape('a &amp; b')") == "a & b" and one("is_suspect(repeat('недель ', 9))") and not one("is_suspect(repeat('ха ', 10))") and not one("is_suspect(null)")
    assert tuple(one("repetition_stats('да да да нет')"))[:2] == (3, "да") and one("cosine_distance(array(1D, 0D), array(1D, 1D))") == pytest.approx(1 - 2**-0.5)
    assert one("ru_stem('деревнями')") == one("ru_stem('деревня')")
    line = "Я (10:00): " + "слово " * 400
    assert [r.piece for r in spark.sql(f"SELECT piece FROM split_long('{line}') ORDER BY part").collect()] == split_long(line)


def test_empty_replies_are_retried_with_pauses():
    pauses, replies = [], [media.Reply(200, b"", {}), media.Reply(200, b"", {}), media.Reply(200, b"data", {})]
    assert media.judge("u", lambda u: replies.pop(0), sleep=pauses.append)[1] == "ok" and pauses == [2.0, 4.0]
    assert media.judge("u", lambda u: media.Reply(200, b"", {}), sleep=lambda s: None)[1] == "net_error"
    assert media.judge("u", lambda u: media.Reply(200, b" <html>", {}), sleep=lambda s: None)[1] == "html_stub"


def test_image_sizes(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 20, 30) + b"\x01\x01\x11\x00"
    rows = [(1, b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 7, 9)), (2, b"GIF89a" + struct.pack("<HH", 3, 4)), (3, jpeg), (4, b"text"), (5, None), (6, b"\xff\xd8")]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, b binary").select("i", media.image_size("b").alias("s")).collect()}
    assert [tuple(got[i]) for i in (1, 2, 3)] == [(7, 9), (3, 4), (30, 20)] and all(got[i].width is None for i in (4, 5, 6))
    assert SilentTranscriber().transcribe(b"", "")["duration_s"] == 0 and PlainAnalyzer().analyse("а\nб".encode())["lines"] == [("а", 1.0), ("б", 1.0)]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, schema = tmp_path / "in", "k long, v string, t long"
    src.mkdir()
    stream = lambda: spark.readStream.schema(schema).json(str(src))
    for n, rows in enumerate([[(1, "a", 1)], [(1, "b", 2), (2, "x", 1)], [(3, "z", 1)], [(4, "q", 1)]]):
        (src / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("k", "v", "t"), r, strict=True))) for r in rows))
        target = Snapshot(spark, str(tmp_path / "out"), schema)  # as a new session would
        merge_stream(stream(), target, ["k"], "t", "test").awaitTermination()
        assert len(target.versions()) == min(n + 1, 3) and target.versions()[-1] == n + 1  # each file once
    assert {tuple(r) for r in target.read().collect()} == {(1, "b", 2), (2, "x", 1), (3, "z", 1), (4, "q", 1)}


def test_flags_stop_and_hold(spark, tmp_path):
    naps = []

    def nap(s):
        naps.append(s)
        (tmp_path / "pause").unlink()
    (tmp_path / "pause").touch()
    check_flags(spark, str(tmp_path), 1.0, nap)
    assert naps == [1.0]
    (tmp_path / "stop").touch()
    with pytest.raises(StopRun):
        check_flags(spark, str(tmp_path))


def test_scratch_is_emptied(spark):
    with scratch(spark):
        cut = Stage(spark, "test").cut(spark.range(3))
        path = cut._lorespark_path
        assert cut.count() == 3
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)


def test_vocabulary_is_appended(spark):
    v = spark.createDataFrame([(1, "# Слова\n\n```text\nбарсик\n```\n"), (2, "x\n\n" + files.SECTION + "\n- а — б *(встретилось: k, d)*\n")], "peer_id long, value string")
    t = spark.createDataFrame([(1, "Барсик — кот", None), (1, "дача", "дом"), (1, "дача", "дом"), (2, "гараж", None), (2, "а", "x"), (3, "нет", None), (1, None, None)], "peer_id long, term string, gloss string")
    got = {r.peer_id: r.value for r in files.appended(v, t, "5-1-9", "2020-01-01").collect()}
    assert got[1].endswith(files.SECTION + "\n- дача — дом *(встретилось: 5-1-9, 2020-01-01)*\n") and got[1].count("арсик") == 1
    assert got[2].count(files.SECTION) == 1 and got[2].endswith("- гараж —  *(встретилось: 5-1-9, 2020-01-01)*\n") and set(got) == {1, 2}


def test_resets_and_files(spark):
    meta = spark.createDataFrame([("a", "v1"), ("b", "v2"), ("c", None)], "name string, settings string")
    bad = spark.createDataFrame([("b",), ("b",)], "name string")
    names = files.to_reset(meta, "v2", bad)
    assert {r.name for r in names.collect()} == {"a", "b", "c"} and files.reset(meta, names).count() == 0 and {r.name for r in files.reset(meta, bad).collect()} == {"a", "c"}
    urls = spark.createDataFrame([("http://x/a.ogg",), ("http://x/b.ogg",), (None,)], "url string")
    have = urls.limit(1).select(F.concat(F.lit("/m/"), F.substring(F.sha1("url"), 1, 16), F.lit(".ogg")).alias("path"))
    assert {r.url for r in files.with_files(urls, have).collect()} == {"http://x/a.ogg"}
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "id long, v string")
    assert files.schema_differs(df, "id int, w string", ["id"]) == ["missing w", "unexpected v", "id is bigint, not int", "null key", "repeated key"]
    assert files.schema_differs(df, "id long, v string") == []


def test_tables_lie_for_their_joins(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS layout")
    spark.sql("USE default")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        create_tables(spark, str(tmp_path / "t"), 4, "layout")
        m = spark.range(200).select("id", F.lit(5).cast("long").alias("peer_id"), F.col("id").alias("vk_msg_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("sent_at", "timestamp"), ("sender", "string"), ("is_own", "boolean"), ("text", "string"), ("fwd_json", "string"), ("page_file", "string"))])
        a = spark.range(300).select("id", (F.col("id") % 200).alias("message_id"), *[F.lit("x").alias(c) for c in ("att_type", "kind", "url", "local_path")], F.lit(True).alias("download_ok"))
        fill(spark, "messages", m, "layout")
        fill(spark, "attachments", a, "layout")
        j = spark.table("layout.messages").alias("m").join(spark.table("layout.attachments").alias("a"), F.col("m.id") == F.col("a.message_id")).select("a.id")
        assert j.count() == 300 and "Exchange" not in j._jdf.queryExecution().executedPlan().toString()
        assert spark.table("layout.chunks").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        spark.sql("DROP DATABASE layout CASCADE")


def test_links(spark):
    page = '<p><A class="x" href="/a?b=1&amp;c=2"><b>раз</b>\n два</A> <a name="n">нет</a><a href=\'#\'></a>'
    got = html.links(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string"), "page_id").collect()
    assert [tuple(r) for r in got] == [(1, 0, "/a?b=1&c=2", "раз два"), (1, 1, "#", "")]


def test_undated_rows_have_no_heading(spark):
    df = spark.createDataFrame([(dt.datetime(2016, 5, 10),), (None,)], "t timestamp")
    assert [r[0] for r in df.select(spoken_day("t")).collect()] == ["10 мая 2016", None]


def test_evaluation_modes(spark):
    e = HashEmbedder(64)
    texts = ["кот спит на окне", "пёс бежит по двору", "рыба плывёт в реке", "кот и пёс дружат"]
    rows = [(i, 5, dt.datetime(2020, 1, 1 + i), t, e.embed([t])[0]) for i, t in enumerate(texts)] + [(9, 5, None, None, None), (10, None, None, "", [0.0] * 64)]
    chunks = spark.createDataFrame(rows, "id long, peer_id long, ts_from timestamp, text string, embedding array<double>").withColumn("embedding", F.col("embedding").cast("array<float>"))
    cases = spark.createDataFrame([(1, "кот спит", 5, dt.date(2020, 1, 1)), (2, "рыба в реке", 5, dt.date(2020, 1, 4)), (3, "пёс", 5, dt.date(2021, 1, 1)), (4, "", 5, dt.date(2020, 1, 1)), (5, None, 6, dt.date(2020, 1, 1))], "case_id long, query string, peer_id long, day date")
    got = {r.mode: r for r in evaluation.evaluate(chunks, cases, e, OverlapScorer()).collect()}
    assert set(got) == set(evaluation.MODES) and all(r.cases == 5 and r.wrong_source == 2 for r in got.values())
    assert got["fts"].top1 == 2 and got["fts"].misses == 3 and got["hybrid+rr"].top1 >= 2 and got["vector"].mrr > 0.4
    assert evaluation.evaluate(chunks, cases.limit(0), e, OverlapScorer(), modes=("fts",)).count() == 0


def test_reports(spark):
    v = spark.createDataFrame([(1, 10, 60.0, "недель " * 9), (2, 10, None, "ставьте лайки"), (3, 11, 30.0, None), (4, 99, 30.0, "речь")], "attachment_id long, message_id long, duration_s double, transcript string")
    m = spark.createDataFrame([(10, 1), (11, 2)], "id long, peer_id long")
    assert {tuple(r) for r in analytics.minutes_per_peer(v, m).collect()} == {(1, 2, 1.0), (2, 1, 0.5)}
    assert {r.attachment_id: r.reasons for r in analytics.bad_transcripts(v).collect()} == {1: ["suspect"], 2: ["boilerplate"]}
    p = spark.createDataFrame([("ok", 0.9, "слова " * 10, "[]"), ("ok", 0.9, "1 " * 40, '[{"id": "x"}]'), ("ok", 0.5, "x", "broken"), (None, None, None, None), ("ok", 0.9, "кот", None)], "status string, ocr_conf float, ocr_text string, labels string")
    assert tuple(analytics.photo_run(p).first()) == (5, 1, 1, 1, 1, 1, 2)
    msgs = spark.createDataFrame([(1, 5, 1, dt.datetime(2020, 1, 2), "Имя", False, "раз\nдва"), (2, 5, 2, dt.datetime(2020, 3, 2), " ", False, "три"), (3, 5, 3, None, "Вы", True, "нет")], "id long, peer_id long, vk_msg_id long, sent_at timestamp, sender string, is_own boolean, text string")
    d = spark.createDataFrame([(5, "Имя")], "peer_id long, name string")
    assert [r.line for r in export.dump(msgs, d, 5, (2020, 1), (2020, 3)).collect()] == ["# Имя, 2020-01 – 2020-03, сообщений: 2", "2020-01-02 00:00 Имя: раз два", "2020-03-02 00:00 ?: три"]
    assert [r.line for r in export.dump(msgs, d, 7, (2020, 1), (2020, 3)).collect()] == ["# ?, 2020-01 – 2020-03, сообщений: 0"]
