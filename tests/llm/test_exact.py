"""Operators with an exact answer, against brute force."""

from __future__ import annotations

import datetime as dt
import os
import random

import numpy as np
import pytest

from lorespark.llm import ann, conversations, leakage, mixing, splitter

T0 = dt.datetime(2020, 1, 1)


# ---- most similar vectors
def truth(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in np.lexsort((ids, -np.round(s[i], 12)))[: min(k, len(ids) - 1)]}


def near(spark, rows, **how):
    df = spark.createDataFrame(rows, "id long, v array<float>, vec string, rep int")
    return {(r.id, r.neighbour) for r in ann.nearest(df, "id", "v", dim=8, **how).collect()}


def test_neighbours_recall(spark):
    rng = np.random.default_rng(0)
    c = rng.normal(size=(12, 8))
    x = (c[rng.integers(0, 12, 1500)] + 0.5 * rng.normal(size=(1500, 8))).astype(np.float32)
    rows = [(i, v.tolist(), "a", 1) for i, v in enumerate(x)]
    want = truth(np.arange(1500), x.astype(np.float64), 10)
    assert len(near(spark, rows, cell_rows=150) & want) / len(want) > 0.97
    assert len(near(spark, rows, cell_rows=150, max_cell=60) & want) / len(want) > 0.97  # every cell is cut into blocks
    assert near(spark, rows, cell_rows=150, exact=True) == want


@pytest.mark.parametrize("sample", [8000, 600])
def test_recall_holds_over_many_cells(spark, sample):
    """300 cells and more, fitted from the sample, or divided from a few coarse ones; a third of the rows is one dense spot."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 8)).astype(np.float32)
    x[::3] = x[0] + 0.02 * x[::3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    seen = []
    was = ann.calibrate

    def spy(model, *a):
        seen.append((len(model.leaves), was(model, *a)))
        return seen[-1][1]
    ann.calibrate = spy
    try:
        found = ann.nearest(df, "id", "v", dim=8, cell_rows=18, sample_rows=sample).cache()
        found.count()
    finally:
        ann.calibrate = was
    assert seen[0][0] >= 300 and seen[0][1] < 150
    want = truth(np.arange(6000), x.astype(np.float64), 10)
    assert len({(r.id, r.neighbour) for r in found.collect()} & want) / len(want) > 0.95
    r = ann.recall_of(found, df, "id", "v", dim=8, block=16).first()
    assert r.queries == 60 and r.neighbours == 600 and r.recall > 0.95
    found.unpersist()


def test_near_cells_are_searched_together():
    """A query is sent to a group once; a group's scan finds the exact neighbours."""
    rng = np.random.default_rng(6)
    c = rng.normal(size=(4, 64))
    x = ann.unit(c[rng.integers(0, 4, 16000)] + rng.normal(size=(16000, 64)))
    model = ann.new_model(ann.fit_cells(x.astype(np.float32), 16000, 400))
    home = model.cells(x.astype(np.float32), 1)[:, 0]
    counted = np.bincount(home, minlength=len(model.leaves))
    group, probed = ann.groups(model, counted, 6000), model.cells(x[:512].astype(np.float32), len(model.leaves) // 4)
    assert np.bincount(group, counted).max() <= 6000 and len(ann._probed(probed, group)[0]) < 4 * 512
    assert ann.groups(model, counted, 100).max() == len(model.leaves) - 1
    every = np.tile(np.arange(len(model.leaves)), (512, 1))
    ids = np.arange(16000)
    nid, s = ann.scan(model, x[:512], ids[:512], every, x, ids, home, 10)
    z = x[:512] @ x.T
    z[ids[:512], ids[:512]] = -9
    assert (nid == np.argsort(-z, axis=1, kind="stable")[:, :10]).all() and np.allclose(s, -np.sort(-z, axis=1)[:, :10])


def test_neighbours_of_copies_and_unsound_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 8)).astype(np.float32)
    x[:15] = x[0]
    x[20] = x[21]
    rows = [(i, v.tolist(), None, None) for i, v in enumerate(x)]
    bad = [(100, None), (101, [0.0] * 8), (102, [1.0] * 7), (103, [float("nan")] * 8), (104, [1.0] * 7 + [float("inf")]), (None, [1.0] * 8), (105, [])]
    got = near(spark, rows + [(*b, "x", 1) for b in bad])
    assert got == truth(np.arange(40), x.astype(np.float64), 10)
    assert near(spark, []) == set() and near(spark, rows[:1]) == set() and near(spark, rows[:2]) == {(0, 1), (1, 0)}


def test_codes_weigh_the_parallel_error():
    rng = np.random.default_rng(2)
    x = ann.unit(rng.normal(size=(2000, 32)), np.float32)
    m = ann.new_model(ann.fit_cells(x, 2000, 500))
    ann.fit_books(x, m)
    leaf = m.cells(x, 1)[:, 0]
    plain = ann.Model(m.coarse, m.leaves, m.starts, m.books, 1.0)

    def parallel(model):
        return (((x - model.decode(model.encode(x, leaf), leaf)) * x).sum(1) ** 2).mean()
    assert m.eta > 1 and parallel(m) < parallel(plain)


# ---- splitting
def check_pieces(text, cuts, limit=1200, overlap=100):
    cuts = sorted(cuts)
    assert cuts[0][1] == 0 and cuts[-1][2] == len(text) and [c[0] for c in cuts] == list(range(len(cuts)))
    for (_, a, b), nxt in zip(cuts, [*cuts[1:], None], strict=True):
        assert 0 < b - a <= limit
        if nxt:
            assert a < nxt[1] <= b and b - nxt[1] <= overlap


def test_split(spark):
    rng = random.Random(4)
    texts = {1: "коротко", 2: "слово " * 900, 3: "а" * 5000, 4: "\n\n".join("Предложение номер %d. " % i * rng.randint(1, 30) for i in range(60)), 5: " " * 4000 + "x", 6: "x" * 2600, 7: "x" * 2601, 8: "👩‍👩‍👧é" * 900, 9: None, 10: "", 11: "Короткая фраза. " * 5000}
    rows = [("m", i, t, 3, "h") for i, t in texts.items()] + [("m", 2, texts[2], 3, "h"), ("m", 2, "другой " * 600, 3, "h"), (None, 3, texts[3], 1, "")]
    df = spark.createDataFrame(rows, "src string, row_id long, text string, node int, piece string")
    got: dict = {}
    for r in splitter.cuts(df, ["src", "row_id"]).collect():
        got.setdefault((r.src, r.row_id, r.h), []).append((r.piece, r.start, r.end))
    assert {k[:2] for k in got} == {("m", i) for i in (2, 3, 4, 5, 7, 8, 11)} | {(None, 3)} and sum(k[1] == 2 for k in got) == 2
    for (_, i, _), c in got.items():
        check_pieces(texts[i] if c[-1][2] != len("другой " * 600) or i != 2 else "другой " * 600, c)
    ends = {texts[11][c[2] - 2] for c in next(v for k, v in got.items() if k[1] == 11)}
    assert ends == {"."}
    out = [r.text for r in splitter.pieces(df.where("src = 'm' and row_id = 4"), ["src", "row_id"]).orderBy("piece").collect()]
    assert out[0] == texts[4][: len(out[0])] and texts[4].endswith(out[-1]) and all(p in texts[4] for p in out)


def test_squared_tables_equal_the_sequential_cuts(spark):
    text = " ".join("слово" * (i % 3 + 1) + ("." if i % 7 == 0 else "") for i in range(3000))
    node, end, succ = splitter.successors(text, 1200, 100)
    nxt = dict(zip(node.tolist(), zip(end.tolist(), succ.tolist(), strict=True), strict=True))
    want, at = [], 0
    while at >= 0:
        want.append((len(want), at, nxt[at][0]))
        at = nxt[at][1]
    got = splitter.cuts(spark.createDataFrame([(1, text)], "id long, text string"), ["id"]).collect()
    assert sorted((r.piece, r.start, r.end) for r in got) == want
    with pytest.raises(ValueError):
        splitter.cuts(spark.createDataFrame([(1, text)], "id long, text string"), ["id"], overlap=600)


# ---- leakage
def longest(a, b):
    aw, bw = leakage.normalise(a).split(), leakage.normalise(b).split()
    return max((n for i in range(len(aw)) for j in range(len(bw)) for n in [next((k for k in range(min(len(aw) - i, len(bw) - j)) if aw[i + k] != bw[j + k]), min(len(aw) - i, len(bw) - j))]), default=0)


def test_leaks(spark):
    rng = random.Random(5)
    vocab = [f"слово{i}" for i in range(60)] + ["и", "в", "на"]
    words = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, words(40)) for i in range(12)] + [(50, "короткий пример"), (51, None), (52, "")]
    docs = []
    for d in range(60):
        i, n = rng.randrange(12), rng.choice([0, 11, 12, 13, 14, 25, 40])
        w = items[i][1].split()
        s = rng.randint(0, 40 - n)
        stretch = " ".join(w[s: s + n])
        if d % 5 == 0:
            stretch = stretch.replace("о", "О").replace(" ", "  —\n", 3).replace("сл", "с­л")
        docs.append((d, words(30) + " . " + stretch + " ! " + words(200 if d % 9 else 4000), "x", 1))
    docs += [(100, None, "x", 1), (101, "", "x", 1), (None, items[0][1], "x", 1), (0, docs[0][1], "x", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, words string, item_id int")
    it = spark.createDataFrame(items, "item_id long, passage string")
    got = {(r.item_id, r.doc_id) for r in leakage.leaks(df, it).collect() if r.words >= 13}
    assert got == {(i, d) for d, t, *_ in docs if d is not None and t for i, p in items if p and longest(t[:800], p) >= 13}
    assert leakage.leaks(df.limit(0), it).count() == 0


def test_leak_with_an_edit(spark):
    p = "вчера мы поехали на озеро и долго искали место для палатки среди сосен"
    df = spark.createDataFrame([(1, "начало " + p.replace("долго", "долга") + " конец"), (2, "совсем другой рассказ про горы и снег")], "doc_id long, text string")
    got = leakage.leaks(df, spark.createDataFrame([(7, p)], "item_id long, passage string")).collect()
    assert [(r.item_id, r.doc_id, r.edits) for r in got] == [(7, 1, 1)] and got[0].words < 13


# ---- conversations
def judge(rows, gap=10800):
    keep = [r for r in rows if r[1] is not None and r[2] is not None]
    lost = [r for r in keep if r[3] is None]
    by: dict = {}
    for r in keep:
        if r[3] is not None:
            by.setdefault(r[1], []).append(r)
    out = set()
    for p, rs in by.items():
        rs.sort(key=lambda r: (r[3], r[2]))
        parts = [[rs[0]]]
        for a, b in zip(rs, rs[1:], strict=False):
            parts.append([b]) if (b[3] - a[3]).total_seconds() > gap else parts[-1].append(b)
        for c in parts:
            lo, hi = min(r[2] for r in c), max(r[2] for r in c)
            key = (p, c[0][2], c[-1][2])
            if any(not (r[4] or "").strip() or r[5] is None or (r[4] == "Вы") != r[5] for r in c) or any(x[1] == p and lo <= x[2] <= hi for x in lost):
                out.add((*key, "broken"))
            if not any(ch.isalnum() for r in c for ch in r[6] or ""):
                out.add((*key, "empty"))
            if all(r[5] for r in c) or not any(r[5] for r in c):
                out.add((*key, "missing_reply"))
    return out


SCHEMA = "id long, peer_id long, vk_msg_id long, sent_at timestamp, sender string, is_own boolean, text string, fwd_json string, page_file string"


def reasons(spark, path):
    got = conversations.conversations(spark, path)
    return {(r.peer_id, r.msg_from, r.msg_to, k) for r in got.collect() for k in ("broken", "empty", "missing_reply") if r[k]}


def test_conversations(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        own = rng.random() < 0.5
        sender = rng.choice(["Вы"] * 9 + [None, " ", "Имя"]) if own else rng.choice(["Имя"] * 12 + ["Вы", ""])
        rows.append((i, 7 if rng.random() < 0.4 else rng.randint(1, 5), i if rng.random() < 0.95 else i - 40, None if rng.random() < 0.02 else T0 + dt.timedelta(minutes=i * rng.choice([30, 31]) + rng.choice([0, 0, 3000])),
                     sender, own, rng.choice(["привет", "!!", "", "да"]), None, "p"))
    seen, out = {}, []
    for r in rows:  # ids of a peer are unique but for true copies
        if (r[1], r[2]) not in seen:
            seen[r[1], r[2]] = r
            out.append(r)
    copies = [(1000 + i, *r[1:6], (r[6] or "") + " ", *r[7:]) for i, r in enumerate(out[:30])]
    long = [(2000 + i, 9, i, T0 + dt.timedelta(hours=2 * i), "Вы" if i % 2 else "Имя", bool(i % 2), "текст", None, "p") for i in range(1500)]  # over three eras
    odd = [(5000, None, 1, T0, "Имя", False, "x", None, "p"), (5001, 1, None, T0, "Имя", False, "x", None, "p")]
    path = str(tmp_path / "messages.parquet")
    spark.createDataFrame(out + copies + long + odd, SCHEMA).repartition(3).write.parquet(path)
    assert reasons(spark, path) == judge(out + long)
    kept = conversations.conversations(spark, path).where("not (broken or empty or missing_reply)")
    t = conversations.turns(spark, path, kept.where("peer_id = 9")).collect()
    assert len(t) == 1500 and {r.speaker for r in t} == {"own", "other"}


def test_late_rows_join_or_are_counted(spark, tmp_path):
    day, hour = dt.timedelta(days=1), dt.timedelta(hours=1)
    m = lambda i, at, own: (i, 1, i, T0 + at, "Вы" if own else "Имя", own, "текст", None, "p")
    files = [[m(1, 0 * hour, True), m(2, hour, False), m(9, 20 * hour, True)],  # the watermark falls a day behind the latest row
             [m(3, 2 * hour, True), m(10, 21 * hour, False)],  # late, but in time: joins the first conversation
             [m(20, 5 * day, True)], [m(21, 5 * day + hour, False)], [m(4, 3 * hour, False)]]  # 4 is too late
    path = tmp_path / "messages"
    path.mkdir()
    own = conversations.own_session(spark)
    schema = spark.createDataFrame([], SCHEMA).schema
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        part = next((tmp_path / f"w{n}").glob("part-*.parquet"))
        target = path / f"{n}.parquet"
        part.rename(target)
        os.utime(target, (1_600_000_000 + n, 1_600_000_000 + n))
    closed, late = conversations.run_stream(own, conversations.message_stream(own, str(path), schema, files=1), several=True)
    got = {(r["first"]["vk"], r["last"]["vk"], r.n_rows) for r in spark.read.parquet(closed).where("peer_id is not null").collect()}
    assert (late, got) == (1, {(1, 3, 3), (9, 10, 2), (20, 21, 2)})
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != conversations.ROCKSDB
    whole = spark.createDataFrame([r for f in files for r in f], SCHEMA)
    whole.write.parquet(str(tmp_path / "whole.parquet"))
    assert conversations.conversations(spark, str(tmp_path / "whole.parquet")).count() == 3  # one batch: none is late


def test_no_conversation(spark, tmp_path):
    path = str(tmp_path / "messages.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert reasons(spark, path) == set()


# ---- mixing
def test_weights():
    tok = {"a": 1000, "b": 100, "c": 10}
    tau, w = mixing.temperature_weights(tok, target_entropy=0.9)
    assert mixing.entropy(w) == pytest.approx(0.9, abs=1e-6) and 0 < tau < 1
    tau, w = mixing.temperature_weights(tok, max_repeats={"a": 2, "b": 2, "c": 2})
    assert max(1110 * w[s] / tok[s] for s in tok) == pytest.approx(2, rel=1e-6)
    g, alpha = mixing.target_weights(tok, {"a": 0.5, "b": 0.3, "c": 0.1, "d": 0.1}, {"a": 1, "b": 9, "c": 2, "d": 5}, 1110)
    assert g["c"] == 20 and g["d"] == 0 and g["a"] / g["b"] == pytest.approx(5 / 3) and sum(g.values()) == pytest.approx(1110)
    assert 0 < alpha["c"] < 1 == alpha["a"] == alpha["b"]
    assert sum(mixing.target_weights(tok, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 1e9)[0].values()) == 1100


def test_stretches_keep_the_tokens():
    text = ("слово and 12345 — ещё...  \n" * 9000) + "x" * 250_000 + " конец слов"
    enc = mixing._encoding(open(mixing.TOKENIZER, "rb").read())
    parts = list(mixing.stretches(text))
    assert "".join(parts) == text and len(parts) > 2 and sum(len(enc.encode_ordinary(p)) for p in parts) == len(enc.encode_ordinary(text))


def test_mixtures_follow_the_exponent(spark):
    docs = spark.createDataFrame([(i, "кот дом лес " * (1 + i % 3), s) for i, s in enumerate(["big"] * 3000 + ["mid"] * 300 + ["tiny"] * 30)], "doc_id long, text string, source string")
    goal = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 4), ("tiny", 0.2, 4)], "source string, target_share double, max_repeats int")
    share = {by: {r.source: r for r in mixing.mix(docs, goal, by=by)[1].collect()} for by in ("limit", "entropy", "targets")}
    assert all(r.repeats <= r.max_repeats + 1e-9 for x in share.values() for r in x.values())
    lim, ent = share["limit"]["big"].exponent, share["entropy"]["big"].exponent
    assert 0 < ent < lim < 1 and share["limit"]["tiny"].repeats == pytest.approx(4, rel=0.01)
    t = {s: r.tokens for s, r in share["limit"].items()}
    w = mixing._normal({s: float(x) ** lim for s, x in t.items()})
    assert all(share["limit"][s].share == pytest.approx(w[s], abs=0.001) for s in t if s != "big")


def test_mix(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice(["кот", "дом", "лес", "tree"]) for _ in range(rng.randint(1, 30))), s, i, 1) for i, s in enumerate(["big"] * 400 + ["mid"] * 60 + [" MID "] * 20 + ["tiny"] * 8)]
    docs += [(900, None, "big", 0, 0), (901, "", "mid", 0, 0), (902, "чужой", None, 0, 0), (903, "чужой", "other", 0, 0), (None, "без номера", "tiny", 0, 0), docs[0], docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, block int, pass int")
    goal = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("tiny", 0.1, 4), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    m, rep = mixing.mix(df, goal)
    r = {x.source: x for x in rep.collect()}
    assert r["absent"].tokens_used == 0 and r["tiny"].repeats == pytest.approx(4) and r["tiny"].records == 9
    assert r["big"].share / r["mid"].share == pytest.approx(5 / 3, rel=0.05) and all(x.repeats <= x.max_repeats + 1e-9 for x in r.values())
    rows = m.collect()
    assert sum(x.n_tokens for x in rows) == sum(x.tokens_used for x in r.values()) and {x.source for x in rows} == {"big", "mid", "tiny"}
    uses: dict = {}
    for x in rows:
        if x.doc_id not in (None, 0):
            uses.setdefault((x.source, x.doc_id), []).append(x["pass"])
    assert all(len(set(p)) == len(p) for p in uses.values())
    assert {len(p) for (s, _), p in uses.items() if s == "tiny"} == {4}
    empty, rep = mixing.mix(df.limit(0), goal)
    assert empty.count() == 0 and all(x.share == 0 for x in rep.collect())
