"""Operators that learn, on held-out examples, and their edge cases."""

from __future__ import annotations

import random

import numpy as np

from lorespark.llm import abuse, ocr, pii, residue

EDGE = [None, "", "   ", "\n", "а", "😀" * 3, "слово " * 20000]
PROSE = ["вчера ездили на дачу и сажали картошку до самого вечера", "мама просила купить хлеба и молока по дороге домой", "завтра экзамен а я ещё не открывал учебник", "у соседей опять громко играет музыка спать невозможно",
         "мы договорились встретиться у входа в парк в семь часов", "он рассказал смешную историю про своего кота", "надо починить кран пока вода не залила кухню", "поезд опаздывает на сорок минут сидим ждём на вокзале"]


# ---- residue
def test_residue(spark):
    bad = ["Lorem ipsum dolor sit amet quando nemo orbis vela", "404 Not Found", "Ошибка 502. Сервис временно недоступен. Попробуйте позже.", "Для работы этой страницы включите JavaScript", "Субтитры подготовила студия «Парус»",
           "Здесь будет текст расшифровки.", "[02:10] Превышен лимит запросов, повторите через 12 секунд", "Сyбтитры сделaл Парус", "звонок {{имя}} вчера " + PROSE[0], "${user.name}", "<noscript>Включите скрипты</noscript>"]
    good = PROSE * 6 + ["написал ему что страница не найдена а он смеётся", "субтитры у фильма кривые смотреть больно", "сервер упал и все пошли пить чай", "[01:05] " + PROSE[1], "ставь 100% и не спорь", "письмо на <vasya@host.example> ушло"]
    rows = [(i, t, 0.0) for i, t in enumerate(bad + good)] + [(1000 + i, t, 0.0) for i, t in enumerate(EDGE)] + [(0, bad[0], 0.0), (None, bad[0], 0.0)]
    df = spark.createDataFrame(rows, "attachment_id long, transcript string, coverage double")
    got = residue.detect(df, "attachment_id", "transcript").collect()
    out = {r.attachment_id for r in got if r.excluded}
    assert {r[1] for r in rows if r[0] in out and r[0] is not None} == set(bad) and {r.attachment_id for r in got} >= {1004, 1006}
    assert residue.detect(df.limit(0), "attachment_id", "transcript").count() == 0


def test_residue_does_not_hang_on_the_size_of_the_table(spark):
    rng = random.Random(7)
    words = " ".join(PROSE).split()
    bad = ["500 Internal Server Error", "410 Gone"]
    spoken = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(1500)] + [f"{rng.choice(PROSE)} и тогда {b.lower()}, {rng.choice(PROSE)}" for b in bad for _ in range(4)]
    texts = spoken + bad * 2
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")

    def out(times):
        many = df.crossJoin(spark.range(times).select("id").withColumnRenamed("id", "copy")).selectExpr("id * 1000 + copy as id", "text")
        return {(texts[r.id // 1000], r.excluded) for r in residue.detect(many, "id", "text").collect()}
    assert out(1) == out(20) == {(t, t in bad) for t in texts}


# ---- personal information
def test_spoken_digits():
    assert pii.spoken_digits("плюс семь девятьсот семьдесят три двести сорок один ноль пять сорок") == "79732410540"
    assert pii.spoken_digits("серия сорок три двенадцать номер двести шестьдесят четыре сто двадцать восемь") == "4312264128"


def test_forms_that_no_table_has():
    def got(text):
        return {(k, text[a:b]) for k, a, b, *_ in pii.spans(text)}
    assert ("phone", "восемь девять один два три ноль ноль четыре пять шесть семь") in got("позвони мне восемь девять один два три ноль ноль четыре пять шесть семь")
    assert ("name", "Шевченко Олег") in got("это Шевченко Олег") and ("name", "Гринберг Анна Сергеевна") in got("спроси Гринберг Анна Сергеевна")
    assert ("address", "набережная Мойки 12") in got("набережная Мойки 12") and ("address", "на Лесной, 5") in got("живу на Лесной, 5") and not got("на той неделе 5 раз")
    assert ("address", "ул. Садовая, д. 12 корп. 3, кв. 4") in got("ул. Садовая, д. 12 корп. 3, кв. 4")
    rare = np.full(pii.WORD_BUCKETS, 0.1)
    rare[pii.word_bucket("коваль")] = 1.0
    assert ("name", "Коваль Ирина") in {(k, "это Коваль Ирина"[a:b]) for k, a, b, *_ in pii.spans("это Коваль Ирина", rare)} and not pii.spans("Привет Ирина", rare)


def test_votes_for_never_speak_against():
    votes = [((1, 1, 1), 700), ((1, 1, 0), 5000), ((1, 0, 0), 300), ((0, 0, -1), 900), ((0, 1, -1), 30)]
    for times in (1, 1000):
        post = pii.expectation([(p, n * times) for p, n in votes])
        assert post[1, 1, 1] >= post[1, 1, 0] >= 0.9 and post[0, 0, -1] == 0 and post == pii.expectation(votes)


def test_numbers_beside_numbers():
    def got(text):
        return {(k, text[a:b]) for k, a, b, *_ in pii.spans(text) if k in ("phone", "id_number")}
    assert {("id_number", "100-561-811-47"), ("phone", "8 (975) 830 48 73")} <= got("снилс 100-561-811-47. 8 (975) 830 48 73")
    assert ("phone", "8-973-485-56-63") in got("квартира 150. 8-973-485-56-63") and ("phone", "79748179883") in got("кв. 254\n79748179883")
    assert {("phone", "89751397888")} <= got("кв 54. 89751397888") & got("дом 5 89751397888") & got("89751397888 2020 12 31")
    three = got("100-561-811-47 8 (975) 830 48 73 45 07 123456")
    assert {("id_number", "100-561-811-47"), ("phone", "8 (975) 830 48 73"), ("id_number", "45 07 123456")} <= three
    assert {("phone", f"897513978{n}") for n in range(10, 40)} <= got(" ".join(f"897513978{n}" for n in range(10, 40)))
    assert ("id_number", "4512\n123456") in got("паспорт 4512\n123456") and not got("трек 12345678901234")
    assert {("id_number", "45 07\n123456"), ("phone", "89751397888")} <= got("паспорт 45 07\n123456\n89751397888")


def test_personal_information(spark):
    rng = random.Random(1)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    fams, given = ["Лопатин", "Черемухов", "Зорина", "Белкина"], ["Олег", "Павел", "Анна", "Ирина"]
    make = {"email": lambda: rng.choice([f"пиши на user{num(2)}@host.example", f"почта user{num(2)} собака host точка example"]), "phone": lambda: rng.choice([f"звони +7 (9{num(2)}) {num(3)}-{num(2)}-{num(2)}", f"мой номер 89{num(9)}"]),
            "id_number": lambda: rng.choice([f"паспорт 45 0{num(1)} {num(6)}", f"снилс {num(3)}-{num(3)}-{num(3)} {num(2)}", f"ИНН 77{num(10)}"]), "address": lambda: rng.choice([f"живу на ул. Садовая, д. {rng.randint(1, 99)}, кв. {rng.randint(1, 99)}", f"адрес Лесная улица, дом {rng.randint(1, 99)}"]),
            "name": lambda: rng.choice([f"документы на имя {rng.choice(given)} {rng.choice(fams)}", f"спроси там {rng.choice(fams)} {rng.choice(given)}"])}
    decoys = [lambda: f"заказ № {num(10)} ждёт", lambda: f"сумма {num(1)} {num(3)} {num(3)} рублей", lambda: f"трек {num(14)} не обновляется", lambda: "подпишись на @vasya там смешно", lambda: "гуляли по улице Садовой до темноты", lambda: "Олег пришёл позже всех"]
    rows, want = [], set()
    for i in range(400):
        parts = [rng.choice(PROSE)]
        for k, f in make.items():
            if rng.random() < 0.2:
                parts.append(f())
                want.add((i, k))
        if rng.random() < 0.4:
            parts.append(rng.choice(decoys)())
        rng.shuffle(parts)
        rows.append(("m", i, ". ".join(parts), "x", 1))
    rows += [("m", 1000 + i, t, "x", 1) for i, t in enumerate(EDGE)] + [("m", 0, rows[0][2], "x", 1)]
    df = spark.createDataFrame(rows, "src string, row_id long, text string, kind string, start int")
    got = {(r.row_id, r.kind) for r in pii.detect(df, ["src", "row_id"]).collect()}
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95
    masked = {r.row_id: r.text for r in pii.masked(df.where("row_id > 0"), ["src", "row_id"]).collect()}
    assert all(pii.PLACEHOLDER[k] in masked[i] for i, k in got if i > 0) and masked[1000] is None and masked[1006] == EDGE[6]
    clean = [r for r in rows if 0 < r[1] < 400 and not any((r[1], k) in got for k in make)]
    assert all(masked[r[1]] == r[2] for r in clean)
    assert pii.detect(df.limit(0), ["src", "row_id"]).count() == 0
    null = spark.createDataFrame([(None, None, rows[i][2]) for i in range(30)], "src string, row_id long, text string")
    assert sorted(r.text for r in pii.masked(null, ["src", "row_id"]).collect()) != sorted(r[2] for r in rows[:30]) and pii.masked(null, ["src", "row_id"]).count() == 30


# ---- scanned pages
def page(rng, words, hyphen=False, misread=False, head=None, number=None):
    body = [" ".join(rng.choice(words) for _ in range(7)) for _ in range(8)]
    if hyphen:
        body[2] = body[2] + " неприят-"
        body[3] = "ность " + body[3]
    if misread:
        w = rng.choice([x for x in words if any(c in "еилмпн" for c in x)])
        k = rng.choice([i for i, c in enumerate(w) if c in "еилмпн"])
        body[4] += " " + w[:k] + {"е": "с", "и": "н", "л": "п", "м": "ш", "п": "ц", "н": "и"}[w[k]] + w[k + 1:]
    return "\n".join(([head] if head else []) + body + ([number] if number else []))


def test_ocr(spark):
    rng = random.Random(2)
    words = "берёза неприятность огород солнечный картошка соседи вечером поехали думаю дорога высокий пришлось".split()
    rows, want = [], set()
    for i in range(120):
        h, m, t, n = (rng.random() < 0.3 for _ in range(4))
        msg = i // 2 if t else 1000 + i
        head = f"Памятка про огород {'выпуск' if i % 2 else 'вылуск'}" if t else None
        rows.append([i, msg, page(rng, words, h, m, head, rng.choice(["— 12 —", "Страница 3 из 9", "[44]"]) if n else None), h, m, t, n])
    for r in rows:
        i, msg, _, h, m, t, n = r
        twin = any(o[1] == msg and o[0] != i and o[5] for o in rows)
        want |= {(i, k) for k, on in (("hyphenation", h), ("misrecognition", m), ("running_header", t and twin), ("page_number", n)) if on}
    data = [(i, msg, "ok", 0.9, t, 1, "k") for i, msg, t, *_ in rows]
    data += [(5000 + i, 77, "ok", 0.9, t, 1, "k") for i, t in enumerate(EDGE)] + [(6000, 1, "ok", 0.5, rows[0][2], 1, "k"), (6001, None, None, 0.9, rows[1][2], 1, "k"), (6002, 3, "ok", None, rows[1][2], 1, "k"), (0, rows[0][1], "ok", 0.9, rows[0][2], 1, "k"),
             (7000, 88, "ok", 0.9, "КАССОВЫЙ ЧЕК №1\nХЛЕБ 1 x 20.00 = 20.00\nИТОГ 20.00\n630", 1, "k"), (7001, 89, "ok", 0.9, "Лена\nбыл(а) недавно\nмы поехали вечером\n20:22\nСообщение", 1, "k")]
    df = spark.createDataFrame(data, "attachment_id long, message_id long, status string, ocr_conf float, ocr_text string, words int, kind string")
    got = {(r.attachment_id, r.kind) for r in ocr.noise(df).collect()}
    seen = {(a, k) for a, k in got if k != "misrecognition"} ^ {(a, k) for a, k in want if k != "misrecognition"}
    assert not seen, seen
    m = {a for a, k in got if k == "misrecognition"}
    w = {a for a, k in want if k == "misrecognition"}
    assert len(m & {a for a, *_ in rows}) >= 0.5 * len(w) and not {a for a in m if a >= 5000}
    text = {r.attachment_id: r.text for r in ocr.repaired(df).collect()}
    for i, msg, t, h, *_ in rows:
        if h:
            assert "неприятность" in text[i] and "неприят-" not in text[i]
    assert all("—" not in text[i] for i, *_, n in rows if n) and ocr.noise(df.limit(0)).count() == 0


def test_misread_forms_do_not_hang_on_counts(spark):
    def fixes(times, copies=1):
        rows = []
        for r in range(times):  # "дсревня" stands among the neighbours of "деревня", "лечь" stands beside other words than "печь"
            texts = [f"длинная деревня ведет к реке {r} {k}" for k in range(4)] + [f"длинная дсревня ведет к реке {r}"] + [f"топить печь дровами {r} {k}" for k in range(4)] + [f"хочу лечь спать {r}"]
            rows += [(len(texts) * r + i, t) for i, t in enumerate(texts)]
        rows = [(c * 10_000 + i, 1, "ok", 0.9, t) for c in range(copies) for i, t in rows]
        df = spark.createDataFrame(rows, "attachment_id long, message_id long, status string, ocr_conf float, ocr_text string")
        return {r.word: r.correction for r in ocr.corrections(ocr.parts(df)).collect()}
    assert fixes(1)["дсревня"] == fixes(1, copies=2)["дсревня"] == "деревня"
    assert fixes(2) == fixes(6) == fixes(6, copies=3) == {"дсревня": "деревня"}


def test_compounds_keep_their_hyphen():
    assert ocr.repair("он купил чёрно-\nбелый фильм и пошёл домой\nсмотреть его один вечером", {}, set(), {"черно-белый"}) == "он купил чёрно-белый фильм и пошёл домой смотреть его один вечером"


# ---- abuse
def test_fold():
    assert abuse.fold("с.в.о.л.о.ч.ь и св0л04ь, сволооочь cвoлoчь") == "сволочь и сволочь, сволочь сволочь"
    lex = abuse.Lexicon(["козел", "тварь"])
    assert abuse.prepare(["ты к**ел, т**рь"], lex) == ["ты козел, тварь"]


def test_wide_letters_are_folded():
    assert abuse.fold("ｉｄｉｏｔ 𝐢𝐝𝐢𝐨𝐭") == "idiot idiot"


def test_threshold_lies_between_clean_and_true():
    score, true = np.array([0.99, 0.98, 0.97, 0.9, 0.3, 0.2, 0.1]), np.array([True, True, True, True, False, False, False])
    z = abuse.best_threshold(score, true, np.ones(7))
    assert np.log(0.3 / 0.7) < z < np.log(9)


def test_votes_trust_raters_who_agree():
    labels = [(d, "none", r) for d in range(20) for r in "ab"] + [(d, "abusive", "c") for d in range(20)]
    assert all(v[0] == "none" for v in abuse.rater_votes(labels).values())


def test_abuse_held_out(spark):
    rng = random.Random(3)
    bad = {"abusive": ["заткнись ты {}", "какой же ты {} смотреть тошно", "сдохни {}", "я тебя найду {}"], "hateful": ["эти {} не люди а паразиты", "выселить всех {} из города", "{} хуже скота"], "sexual": ["хочу тебя голой прямо сейчас {}", "она стонала всю ночь {}"]}
    fill = ["дрянь", "сволочь", "козёл", "идиот", "соседи", "приезжие", "милая", "детка"]
    docs, labels, want = [], [], {}
    for d in range(400):
        k = rng.choice(["none"] * 3 + list(bad))
        parts = [rng.choice(PROSE) for _ in range(4)]
        if k != "none":
            parts.insert(rng.randint(0, 4), rng.choice(bad[k]).format(rng.choice(fill)))
        docs.append((d, ". ".join(parts), rng.choice(["a", " A ", None]), 0.0))
        want[d] = k
        if d < 200:
            labels += [(d, k, "r1"), (d, k if rng.random() < 0.9 else "none", "r2")]
    docs += [(1000 + i, t, "b", 0.0) for i, t in enumerate(EDGE)] + [(None, "заткнись ты дрянь", "b", 0.0), docs[0]]
    labels += [(99999, "none", "r1"), (None, "none", "r1"), (1, None, "r1"), (1000, "abusive", "r1")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, abusive double")
    lab = spark.createDataFrame(labels, "doc_id long, label string, rater string")
    s = abuse.scores(df, lab, keep=("source",))
    got = {(r.doc_id, r.category) for r in abuse.found(s).collect()}
    true = {(d, k) for d, k in want.items() if k != "none" and d >= 200}
    held = {g for g in got if 200 <= g[0] < 400}
    assert len(held & true) / len(true) > 0.9 and len(held & true) / len(held) > 0.9
    assert not {g for g in got if g[0] >= 1000} and s.count() == len(docs)
    rate = {r.source: r for r in abuse.rates(s).collect()}
    assert set(rate) == {"a", "b", "unknown"} and rate["b"].documents == len(EDGE) + 1
    assert abuse.scores(df.limit(0), lab.limit(0)).count() == 0
