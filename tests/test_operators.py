from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lorespark.operators import analytics, asr, chunking, export, joins, merge, retrieval
from lorespark.plans import archive
from lorespark.providers import HashEmbedder, OverlapScorer, checked_scores, checked_vectors, embed_column, retried

T0 = dt.datetime(2020, 1, 1, 12)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, s string, n int")
    new = spark.createDataFrame([(2, "B", 20), (3, "C", 30)], "k long, s string, n int")
    assert rows(merge.upsert(old, new, ["k"])) == [(1, "a", 1), (2, "B", 20), (3, "C", 30)]
    assert rows(merge.upsert(old, new, ["k"], update=["n"])) == [(1, "a", 1), (2, "b", 20), (3, "C", 30)]
    assert rows(merge.upsert(old, new, ["k"], when=F.col("old.n") > 5)) == [(1, "a", 1), (2, "b", 2), (3, "C", 30)]
    once = merge.upsert(old, new, ["k"])
    assert rows(merge.upsert(once, new, ["k"])) == rows(once)
    assert rows(merge.insert_ignore(old, new, ["k"])) == [(1, "a", 1), (2, "b", 2), (3, "C", 30)]
    assert rows(merge.delete_stale(old, new, ["k"], F.lit(True))) == [(2, "b", 2)]
    assert rows(merge.guarded_wipe(old, F.col("k") == 1, new.where("k > 9"))) == [(2, "b", 2)]
    with pytest.raises(ValueError):
        merge.guarded_wipe(old, F.col("k") == 1, new)
    m = spark.createDataFrame([('{"a": "1", "b": "2"}',), (None,)], "m string").select(merge.merge_meta(F.col("m"), {"b": "3"}).alias("m")).collect()
    assert m[0].m in ('{"a":"1","b":"3"}', '{"b":"3","a":"1"}') and m[1].m == '{"b":"3"}'
    assert rows(merge.violations(old.unionByName(old), ["k"], {"s": ("a",)})) == [("check s", 2), ("unique k", 2)]


def test_all_items_are_cases(spark, tmp_path):
    w = [f"слово{i}" for i in range(30)]
    items = [(1, "слово0 слово1", " ".join(w)), (2, "слово5", " ".join(["начало"] * 9 + w[5:20])), (3, "нигде", "нет такого места ни в одном из документов этого собрания вообще никогда"), (4, "слово1", "Ещё слово1")]
    docs = [(10, " ".join(w)), (11, "\n".join(w[5:18]).upper()), (12, "слово5 " + " ".join(w[6:17])), (13, None), (14, "тут еще,  слово1!")]
    spark.createDataFrame(items, "item_id long, question string, passage string").write.parquet(str(tmp_path / "eval_items.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    r = archive.eval_mrr(spark, str(tmp_path)).first()
    # item 1 finds 10 first; item 2 aims at 10 and 11; item 4 at 14, behind 10; item 3 has no target
    assert (r.cases, r.misses, r.no_target, r.top1, r.top5) == (4, 1, 1, 2, 3) and r.mrr == round((1 + 1 + 0.5) / 4, 6)


def test_joins(spark):
    left = spark.createDataFrame([(1, 2010), (1, 2015), (1, None), (2, 2010)], "p long, y int")
    right = spark.createDataFrame([(1, 2012, "a"), (1, 2014, "b")], "p long, f int, d string")
    assert rows(joins.asof_latest(left, right, "p", "y", "f", ["d"])) == [(1, 2010, "a"), (1, 2015, "b"), (1, None, None), (2, 2010, None)]
    rng = random.Random(2)
    pts = [(rng.randint(1, 3), rng.randint(-500, 5000)) for _ in range(200)]
    ivs = [(i, rng.randint(1, 3), a := rng.randint(-600, 5000), a + rng.choice([0, 1, 7, 300, 4000, -5])) for i in range(60)]
    got = joins.points_in(spark.createDataFrame(pts, "k long, x long"), spark.createDataFrame(ivs, "i long, k long, lo long, hi long"), ["k"], "x", "lo", "hi").select("i", "x")
    assert rows(got) == sorted(((i, x) for i, k, lo, hi in ivs for k2, x in pts if k == k2 and lo <= x <= hi), key=str)
    a = spark.createDataFrame([(1, dt.date(2020, 1, d)) for d in range(1, 20)], "k long, a date")
    b = spark.createDataFrame([(1, dt.date(2020, 1, d)) for d in (3, 9, 19)], "k long, b date")
    assert {(r.a.day, r.b.day) for r in joins.band_join(a, b, ["k"], "a", "b", 1).collect()} == {(x, y) for x in range(1, 20) for y in (3, 9, 19) if abs(x - y) <= 1}


def model(msgs, gap=10800):
    """The chunking contract, plainly, over one dialog: (sent_at, id, line)."""
    out, buf, prev = [], [], None
    for at, i, line in msgs:
        far = prev is not None and at is not None and (at - prev).total_seconds() > gap
        if len(line) > 2600:
            if buf:
                out.append((0, buf))
            out += [(n, [(i, p)]) for n, p in enumerate(chunking.split_long(line), 1)]
            buf = []
        else:
            if buf and (far or sum(len(x) for _, x in buf) + len(line) > 2600 or len(buf) >= 80):
                out.append((0, buf))
                buf = [] if far else chunking.overlap(buf)
            buf = buf + [(i, line)]
            if sum(len(x) for _, x in buf) >= 1200:
                out.append((0, buf))
                buf = chunking.overlap(buf)
        prev = at or prev
    if buf:
        out.append((0, buf))
    return [(part, k[0][0], k[-1][0], len(k)) for part, b in out if (k := [x for x in b if x[1]])]


def test_chunk_fold_against_the_contract(spark):
    rng = random.Random(3)
    data, want = [], []
    for peer in (1, 2, 3):
        at, msgs = T0, []
        for i in range(250):
            at += dt.timedelta(minutes=rng.choice([1, 2, 30, 181, 400] if peer != 3 else [1]))
            n = rng.choice([0, 5, 40, 300, 900, 3000] if peer != 3 else [0, 3])
            msgs.append((None if rng.random() < 0.02 else at, i, ("слово " * (n // 6 + 1))[:n].strip()))
        msgs.sort(key=lambda m: (m[0] is None, m[0] or T0, m[1]))
        rend = [(a, i, f"Имя ({a.strftime('%H:%M') if a else '--:--'}): {t}" if t else "") for a, i, t in msgs]
        want += [(peer, *c) for c in model(rend)]
        data += [(i + peer * 1000, peer, i, a, "Имя", False, t) for a, i, t in msgs]
    m = spark.createDataFrame(data, "id long, peer_id long, vk_msg_id long, sent_at timestamp, sender string, is_own boolean, text string")
    lines = chunking.message_lines(m, spark.createDataFrame([], "message_id long, att_type string"), spark.createDataFrame([], "message_id long, transcript string, duration_s float"),
                                   spark.createDataFrame([(p, "Друг", "user") for p in (1, 2, 3)], "peer_id long, name string, kind string"))
    got = chunking.chunk_dialogs(lines).select("peer_id", "part", "msg_from", "msg_to", "n_messages")
    assert rows(got) == sorted(want, key=str)
    bodies = chunking.with_header(chunking.chunk_dialogs(lines), spark.createDataFrame([(p, "Друг", "user") for p in (1, 2, 3)], "peer_id long, name string, kind string"))
    assert all(r.text.startswith("Переписка с Друг") for r in bodies.collect())


def test_render_and_labels(spark):
    df = spark.createDataFrame([("Я", T0, " привет ", "речь", 65.0, ["Фото"]), ("Имя", None, "", None, None, ["Фото", "Файл"]), ("Имя", T0, "", None, None, [])], "who string, sent_at timestamp, text string, transcript string, duration_s double, atts array<string>")
    assert [r[0] for r in df.select(chunking.rendered()).collect()] == ["Я (12:00): привет [голосовое 1:05] речь", "Имя (--:--): [Фото], [Файл]", ""]
    lab = spark.createDataFrame([('[{"id": "cat", "conf": 0.9}, {"id": "feline", "conf": 0.95}, 5, {"id": "new_thing", "conf": 0.8}, {"id": "car", "conf": 0.1}, {"id": "sky", "conf": "x"}]',), (None,), ("broken",)], "l string")
    assert [r[0] for r in lab.select(chunking.label_names("l")).collect()] == [["кошка", "new thing"], [], []]
    who = spark.createDataFrame([(True, "x"), (False, "DELETED"), (False, None), (False, "Имя")], "o boolean, s string").select(chunking.speaker("o", "s", F.lit("Друг")))
    assert [r[0] for r in who.collect()] == ["Я", "Друг", "Друг", "Имя"]


def test_photo_numbers_stay_when_the_bound_moves(spark):
    p = spark.createDataFrame([(i, 1, "ok", "три слова здесь " * 4, c, None, 0, "u") for i, c in ((1, 0.9), (2, 0.1), (3, 0.8))], "attachment_id long, message_id long, status string, ocr_text string, ocr_conf float, labels string, n_faces smallint, url string")
    m = spark.createDataFrame([(1, 5, 10, T0, False, "Имя")], "id long, peer_id long, vk_msg_id long, sent_at timestamp, is_own boolean, sender string")
    d = spark.createDataFrame([(5, "Друг", "user")], "peer_id long, name string, kind string")
    for bound, parts in ((0.6, [1, 3]), (0.0, [1, 2, 3]), (0.85, [1])):
        assert sorted(r.part for r in chunking.photo_chunks(p, m, d, min_conf=bound).collect()) == parts


def test_retrieval(spark):
    c = spark.createDataFrame([(1, "кошка спит на диване"), (2, "собака и кошки спят"), (3, "кошка кошка кошка"), (4, None), (5, "машина")], "id long, text string")
    ix = retrieval.inverted_index(c)
    for q in ("кошка", "кошка спать", '"кошка спит"', "кошка -собака", "машина or кошка", ""):
        a, b = rows(retrieval.fts_leg(ix, q, 10)), rows(retrieval.fts_scan_leg(c, q, 10))
        assert a == b
    assert {r.id for r in retrieval.fts_leg(ix, "кошки", 10).collect()} == {1, 2, 3}
    assert {r.id for r in retrieval.fts_leg(ix, "кошки -собака", 10).collect()} == {1, 3}
    assert [r.id for r in retrieval.fts_simple_leg(c, ["кошка"], 10).orderBy("frank").collect()] == [3, 1]
    vec = spark.createDataFrame([(1, 1), (2, 2)], "id long, vrank long")
    fts = spark.createDataFrame([(2, 1), (1, 2), (3, 3)], "id long, frank long")
    f = retrieval.fuse(vec, fts, 10).collect()
    assert [r.id for r in f] == [1, 2, 3] and f[0].score == pytest.approx(1 / 61 + 1 / 62) and f[0].score == f[1].score
    assert [r.id for r in retrieval.fuse(vec, None, 1).collect()] == [1]
    docs = spark.createDataFrame([(i, t, 0.1) for i, t in ((1, "про рыбалку"), (2, "как варить суп из тыквы"), (3, "машина"))], "id long, text string, score double")
    assert retrieval.rerank(docs, "суп из тыквы", OverlapScorer(), 3).first().id == 2
    e = HashEmbedder(16)
    chunks = spark.createDataFrame([(i, 5, T0, T0, 1, t, [float(x) for x in e.embed([t])[0]], "messages") for i, t in ((1, "кошка спит"), (2, "машина едет"))], "id long, peer_id long, ts_from timestamp, ts_to timestamp, n_messages int, text string, embedding array<float>, source string")
    dl = spark.createDataFrame([(5, "Друг")], "peer_id long, name string")
    for mode in ("vector", "fts", "hybrid"):
        assert retrieval.search(chunks, dl, "кошка спит", e, mode, top=1, date_to="2020").first().id == 1
    assert retrieval.search(chunks, dl, "кошка", e, date_from="2021").count() == 0
    assert retrieval.backfill(chunks, chunks.where("id = 1"), e, ["id"]).count() == 1
    res = spark.createDataFrame([(1, 1, 9, T0), (1, 2, 5, T0), (2, 1, 5, None)], "case_id long, rank long, peer_id long, ts_from timestamp")
    cases = spark.createDataFrame([(1, 5, dt.date(2020, 1, 2)), (2, 5, dt.date(2020, 1, 1))], "case_id long, peer_id long, day date")
    assert rows(retrieval.first_rank(res, cases)) == [(1, 2), (2, None)]
    m = retrieval.metrics(retrieval.first_rank(res, cases).withColumn("mode", F.lit("x")), 2, ["mode"]).first()
    assert (m.mrr, m.top1, m.top5, m.misses) == (0.25, 0, 1, 1)


def test_providers(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("x")
        return "ok"
    assert retried(flaky, sleep=lambda s: None) == "ok"
    for bad in ([[0.0, 0.0]], [[1.0]], [[float("nan"), 1.0]], []):
        with pytest.raises(ValueError):
            checked_vectors(bad, 1, 2)
    with pytest.raises(ValueError):
        checked_scores([float("inf")], 1)
    out = embed_column(spark.createDataFrame([(1, "a"), (2, None)], "id long, text string"), "text", "v", HashEmbedder(8)).collect()
    assert all(len(r.v) == 8 for r in out)


def test_analytics(spark):
    m = spark.createDataFrame([(1, 1, 1, True, "Саша, привет", T0), (2, 1, 2, True, "ты где, Саша?", T0), (3, 1, 3, False, "Пётр, ау", T0), (4, 2, 4, True, "слушай, дела", T0), (5, 2, 5, None, "", None)], "id long, peer_id long, vk_msg_id long, is_own boolean, text string, sent_at timestamp")
    assert rows(analytics.vocatives(m)) == [(1, "саша", 2), (2, "дела", 1)]
    assert rows(analytics.vocatives(m, mine=["саш"])) == [(2, "дела", 1)]
    a = spark.createDataFrame([(10, 1, "voice"), (11, 1, "voice"), (12, 4, "photo")], "id long, message_id long, kind string")
    p = {r.peer_id: r for r in analytics.participation(m, a).collect()}
    assert (p[1].total, p[1].mine, p[1].voice, p[1].voice_mine, p[1].years, p[1].useless) == (3, 2, 1, 1, [2020], False) and p[2].years == [2020]
    v = spark.createDataFrame([(1, 1, "речь " * 20), (2, 1, "Субтитры сделал кто-то"), (3, 3, None), (4, 3, "нормально")], "attachment_id long, message_id long, transcript string")
    q = analytics.quality(v, m).first()
    assert (q.total, q.suspect, q.boiler, q.empty, q.bad, q.bad_pct) == (4, 1, 1, 1, 3, 75.0)
    assert analytics.gate(analytics.quality(v, m), least=4).count() == 1


def test_asr(spark):
    m = spark.createDataFrame([(i, 1, "p", i, T0 if i % 2 else None, "Имя", f"текст номер {i}", i in (3, 5, 40)) for i in range(50)], "id long, peer_id long, page_file string, vk_msg_id long, sent_at timestamp, sender string, text string, voice boolean")
    placed = asr.positions(m, ["peer_id", "page_file"], [F.asc("vk_msg_id")])
    b = asr.batches(asr.clusters(placed, ["peer_id", "page_file"], F.col("voice")), ["peer_id", "page_file"], "peer_id", "vk_msg_id", "sent_at")
    assert sorted((r.batch_key, r.lo, r.hi, r.n) for r in b.collect()) == [("1-3-5", 3, 5, 2), ("1-40-40", 40, 40, 1)]
    ctx = {r.batch_key: r.context.split("\n") for r in asr.context(placed, b, ["peer_id", "page_file"]).collect()}
    assert ctx["1-3-5"][0] == "Имя: текст номер 0" and len(ctx["1-3-5"]) == 14 and len(ctx["1-40-40"]) == 17
    snip = asr.neighbour_snippets(placed, ["peer_id", "page_file"]).where("vk_msg_id = 3").first().snippets
    assert snip == ["текст номер 1", "текст номер 2", "текст номер 3"]
    dense = spark.createDataFrame([(i, 1, "p", i, None, "x", "y", True) for i in range(20)], m.schema)
    c = asr.clusters(asr.positions(dense, ["peer_id", "page_file"], [F.asc("vk_msg_id")]), ["peer_id", "page_file"], F.col("voice"))
    assert sorted(r["count"] for r in c.groupBy("run", "cluster").count().collect()) == [4, 8, 8]


def test_export(spark, tmp_path):
    m = spark.createDataFrame([(1, i, "Имя", T0 + dt.timedelta(hours=9 * i), "т" * 50, None, None, i == 0, []) for i in range(10)], "peer_id long, id long, who string, sent_at timestamp, text string, transcript string, duration_s double, has_voice boolean, atts array<string>")
    b = export.blocks(m)
    got = export.parts(b, ["peer_id"], [F.asc("sent_at")], cap=400, head=100, cont=50).orderBy("id").collect()
    size, part, prev = 100, 1, None
    for r in got:
        t = (r.day_head if r.day_head != prev else "") + r.block
        if size + len(t.encode()) > 400:
            part, size, t = part + 1, 50, r.day_head + r.block
        size, prev = size + len(t.encode()), r.day_head
        assert (r.part, r.shown) == (part, t)
    assert "без расшифровки" in got[0].block and part > 1
    assert export.blocks(m, "txt").first().day_head.startswith(" 1 января 2020")
    export.write_parts(export.parts(b, ["peer_id"], [F.asc("sent_at")], cap=0), ["peer_id"], [F.asc("sent_at")], str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x")).count() > 10


def test_empty_tables(spark):
    m = spark.createDataFrame([], "id long, peer_id long, vk_msg_id long, is_own boolean, text string, sent_at timestamp")
    a = spark.createDataFrame([], "id long, message_id long, kind string")
    assert analytics.participation(m, a).count() == 0 and analytics.distinctive(m).count() == 0 and analytics.vocatives(m).count() == 0 and analytics.sample_by_year(m).count() == 0
    iv = spark.createDataFrame([], "k long, lo long, hi long")
    assert joins.points_in(spark.createDataFrame([(1, 2)], "k long, x long"), iv, ["k"], "x", "lo", "hi").count() == 0
