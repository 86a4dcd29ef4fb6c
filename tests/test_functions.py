from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lorespark.functions import dates, quality, stem, text, vectors
from lorespark.operators.chunking import TARGET, split_long


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("raw,want", [("ХА" * 10, "ХАХАХА"), ("!" * 12, "!!!"), ("а" * 40, "ааа"), ("мне 1000000 рублей", "мне 1000000 рублей"), ("10000000 раз", "10000000 раз"), ("0,0000001", "0,0000001"),
                                      ("код 111111", "код 111111"), ("год 2000", "год 2000"), ("обычное предложение без повторов.", "обычное предложение без повторов."), (None, None), ("", "")])
def test_collapse_repeats(spark, raw, want):
    assert one(spark, raw, text.collapse_repeats) == want


def test_split_long():
    assert split_long("Имя (10:00): коротко") == ["Имя (10:00): коротко"]
    parts = split_long("Имя (10:00): " + "слово " * 400)
    assert len(parts) >= 2 and all(p.startswith("Имя (10:00): ") for p in parts) and sum(p.count("слово") for p in parts) == 400
    parts = split_long("Имя (10:00): " + "Х" * 4000)
    assert len(parts) >= 3 and all(len(p) - len("Имя (10:00): ") <= TARGET for p in parts)


@pytest.mark.parametrize("lo,hi,want", [(None, "2016", (None, dt.date(2017, 1, 1))), (None, "2016-05", (None, dt.date(2016, 6, 1))), (None, "2016-12", (None, dt.date(2017, 1, 1))), (None, "2016-05-10", (None, dt.date(2016, 5, 11))),
                                        ("2016-05-10", None, (dt.date(2016, 5, 10), None)), ("2016", "2016", (dt.date(2016, 1, 1), dt.date(2017, 1, 1)))])
def test_bounds(lo, hi, want):
    assert dates.bounds(lo, hi) == want


def test_bounds_of_one_day(spark):
    df = spark.createDataFrame([(dt.datetime(2016, 5, 10, 23, 59),), (dt.datetime(2016, 5, 11),), (None,)], "ts timestamp")
    assert df.where(dates.between_dates("ts", "2016-05-10", "2016-05-10")).count() == 1
    with pytest.raises(ValueError):
        dates.bounds("май")


@pytest.mark.parametrize("t,want", [("недель " * 9, True), ("ха " * 10, False), ("ну " * 43, True), ("мы вчера ходили в лес и видели белку", False), ("", False), (None, False)])
def test_suspect(spark, t, want):
    assert one(spark, t, lambda c: quality.is_suspect(quality.repetition_stats(c))) is want


def test_repetition_stats(spark):
    r = one(spark, "да да да нет", quality.repetition_stats)
    assert (r.best, r.word) == (3, "да") and 0 < r.share <= 1
    r = one(spark, "", quality.repetition_stats)
    assert (r.best, r.word, r.share) == (0, "", 0.0)


def test_parse_date(spark):
    got = one(spark, "Имя, 10 мая 2016 в 21:03:04", lambda c: F.unix_seconds(dates.parse_date(c)))
    assert got == int(dt.datetime(2016, 5, 10, 18, 3, 4, tzinfo=dt.UTC).timestamp())
    assert one(spark, "без даты", dates.parse_date) is None and one(spark, ", 31 фев 2016 в 1:02:03", dates.parse_date) is None and one(spark, None, dates.parse_date) is None


@pytest.mark.parametrize("label,url,want", [("Файл", "https://h/amsg/rec.ogg?extra=1", "voice"), ("Фотография", "", "photo"), ("Файл", "https://h/doc.pdf", "other"), (None, None, "other")])
def test_attachment_kind(spark, label, url, want):
    assert spark.createDataFrame([(label, url)], "l string, u string").select(text.attachment_kind("l", "u")).first()[0] == want


@pytest.mark.parametrize("t,want", [("Субтитры сделал DimaTorzok", True), ("Редактор субтитров А.Семкин", True), ("Продолжение следует...", True), ("обычная фраза", False), (None, False)])
def test_boilerplate(spark, t, want):
    assert one(spark, t, text.is_boilerplate) is want


def test_clean_text(spark):
    assert one(spark, "<b>привет &amp; мир</b>\x00", text.clean_text) == "привет & мир"
    assert one(spark, "a &#128526; b", text.clean_text) == "a 😎 b" and one(spark, None, text.clean_text) is None
    assert one(spark, "h</div>тело<br><div class=\"kludges\">вложение", text.message_text) == "тело"


def test_small_text_functions(spark):
    assert one(spark, 125.9, text.fmt_duration, "double") == "2:05" and one(spark, None, text.fmt_duration, "double") == "0:00"
    assert one(spark, "Чат: «друзья»/2", text.sanitize_filename) == "Чат_ _друзья_2" and one(spark, "", text.sanitize_filename) == "chat"
    assert one(spark, "Ето так здорово ^^' карашо!!", text.clean_snippet) == "это так здорово хорошо!!"
    assert one(spark, "а" * 500, text.preview) == "а" * 400 + "…"
    assert one(spark, "https://h/a/b.jpg?size=1x2", text.media_file).endswith(".jpg")


def test_vectors(spark):
    assert one(spark, [1.0, 0.0], lambda c: vectors.cosine_distance(c, [0.0, 2.0]), "array<float>") == pytest.approx(1.0)
    for bad in (None, [], [0.0, 0.0], [1.0, float("nan")], [1.0, None], [1.0]):
        assert one(spark, bad, lambda c: vectors.is_sound(c, 2), "array<float>") is False
    with pytest.raises(ValueError):
        vectors.check_query([0.0, 0.0], 2)


def test_stems():
    for a, b in (("книгами", "книга"), ("города", "городов"), ("читала", "читали"), ("running", "runs"), ("cities", "city")):
        assert stem.stem(a) == stem.stem(b), (a, b)
