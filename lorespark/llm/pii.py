"""Personal information in free text, by weak supervision.

Wide patterns propose spans of five kinds.  Labelers (format, gazetteers, cue words on either side, decoy
words, corpus statistics of name-like words) each vote for, against or not at all.  Expectation
maximisation over the counted vote patterns of all spans estimates how reliable each labeler is, without
any labelled data, and a final span classifier is fitted on the resulting probabilities of a bounded
sample of spans.  The spans it accepts are replaced with typed placeholders.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.session import Stage

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Spans that the final classifier is fitted on, at most (about, by hash).
TRAIN_SPANS = 6000
BITS = 15
#: Buckets in which words of surname form or in capitals are counted: every word counts, words of one bucket together.
WORD_BUCKETS = 1 << 18

# The gazetteer of given names.
GIVEN = """александр алексей анатолий андрей антон аркадий арсений артём артур богдан борис вадим валентин валерий василий виктор виталий владимир владислав всеволод вячеслав геннадий георгий герман глеб
григорий данил данила даниил денис дмитрий евгений егор ефим захар иван игнат игорь илья кирилл клим константин лев леонид макар максим марат марк матвей михаил никита николай олег павел пётр платон прохор роман
руслан савва савелий святослав семён сергей станислав степан тарас тимофей тимур фёдор филипп эдуард эльдар юрий яков ян ярослав
александра алевтина алина алиса алла алёна анастасия ангелина анжелика анна антонина арина валентина валерия варвара василиса вера вероника виктория галина дарья диана дина ева евгения евдокия екатерина елена
елизавета жанна зинаида злата зоя инга инна ирина карина кира клавдия кристина ксения лада лариса лена лидия лилия любовь людмила майя маргарита марина мария милана мира надежда наталья наталия нелли ника нина
оксана олеся ольга полина раиса регина римма рита роза руслана светлана снежана софия софья стелла таисия тамара татьяна ульяна фаина элеонора эльвира эмма юлия яна ярослава
аля боря вася ваня гриша даша дима женя катя костя коля лиза люба маша миша мила надя наташа нюра оля паша петя саша света серёжа соня таня толя юля юра яша""".split()
# Number words.
_UNITS = {w: i for i, w in enumerate("ноль один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split())}
_TENS = {w: 10 * i for i, w in enumerate("двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split(), 2)}
_HUNDREDS = {w: 100 * i for i, w in enumerate("сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split(), 1)}
_SPOKEN_STEMS = ("ноль", "один", "дв", "три", "четыр", "пят", "шест", "сем", "восем", "девя", "сто", "сорок", "сот")
_NUM = _UNITS | _TENS | _HUNDREDS | {"одна": 1, "две": 2, "нуль": 0}
_N = "(?:" + "|".join(sorted(_NUM, key=len, reverse=True)) + ")"
# Words that speak for or against a kind.
CUES = {
    "email": re.compile(r"почт|адрес|ящик|mail|имейл|логин|сюда|скинь|счет|пиши", re.I),
    "phone": re.compile(r"звон|набери|телефон|тел\b|тел\.|номер|мобил|дозвон|переведи|мастер|банк", re.I),
    "id_number": re.compile(r"паспорт|сери[яи]|выдан|снилс|страхов|\bинн\b|справк", re.I),
    "address": re.compile(r"адрес|прописк|приезжай|доставк|посылк|живу|живет|такси|переехал|квартир|\bкв\b|индекс|прожива|регистрац|куда ехать|оставил", re.I),
    "name": re.compile(r"на имя|фамили|отчеств|спроси|подпиши|представ|спис[ок]|переда[тйл]|просил|сосед|документ|зовут|инициал|получател|отправител|директор|мастер|врач|учител", re.I),
}
DECOYS = {
    "email": re.compile(r"подпис|кличк|лает|аккаунт|канал", re.I),
    "phone": re.compile(r"заказ|трек|накладн|догов[оа]р|штрих|артикул|сч[её]тчик|показани|сумма|верси|инн\b|снилс|паспорт|сери[яи]|рубл|страхов|автобус|код\b|isbn", re.I),
    "id_number": re.compile(r"заказ|трек|накладн|догов[оа]р|штрих|артикул|сч[её]тчик|показани|сумма|верси|рубл|автобус|встреча|звони|набери|телефон|переведи|isbn|счёт\b", re.I),
    "address": re.compile(r"гуля|автобус|маршрут|рубл|кабинет|страниц|верси|серия \d|сезон|стать[яюи]|глав[аеу]", re.I),
    "name": re.compile(r"улиц|площад|имени\b|роман[а-я]* писат|фильм|книг|песн|режисс|актер|памятник|музей", re.I),
}
DIGITS = re.compile(r"(?<![\w.])\+?\(?\d(?:[\d()\s.№\-]|(?:,?\s*(?:серия|номер)\s+))*\d(?![\w])", re.I)
#: Groups of a digit span, what two numbers rather than one stand around, and groups that make a phone or an id by themselves.
_GROUP = re.compile(r"\+?\(?\d+")
_BREAK = re.compile(r"\s*[\r\n]\s*|\.\s+")
_SHAPED = re.compile(r"(?:\+?[78][\s.\-]*\(?\d{3}|\(?9\d{2})\)?[\s.\-]*\d{3}[\s.\-]*\d\d[\s.\-]*\d\d|\d{3}[ \-]\d{3}[ \-]\d{3}[ \-]\d\d|\d\d ?\d\d\s*№?\s*\d{6}|\d{10,12}")
EMAIL = re.compile(r"(?:mailto:)?[\w.+\-]+\s?(?:@|\(at\)|\[at\]|\(собака\)|\[собака\])\s?[\w\-]+(?:(?:\.|\s?(?:\(dot\)|\[dot\]|\[точка\]|\(точка\))\s?)[\w\-]+)+"
                   r"|[\w.\-]+(?:\s(?:точка|нижнее подч[её]ркивание|дефис|тире|минус|dot|underscore|dash)\s[\w\-]+)*\s(?:собака|собачка|эт|at)\s[\w\-]+(?:\s(?:точка|дефис|тире|минус|dot|dash)\s[\w\-]+)*?\s(?:точка|dot)\s[a-zа-я]{2,}(?:\s(?:точка|dot)\s[a-zа-я]{2,})*", re.I)
SPOKEN = re.compile(rf"(?<!\w)(?:плюс\s+)?{_N}(?:(?:\s+|,\s*|\s+номер\s+){_N})+(?!\w)", re.I)
_S = r"[А-ЯЁа-яё][а-яёА-ЯЁ\-]{3,}"
_STREET = r"[А-ЯЁа-яё][а-яёА-ЯЁ\-]*(?:ая|яя|ую|юю|ой|ей)"
# Words for kinds of streets, whole and short.
_SORT = r"(?:улиц[аеуы]|ул|проспект[аеу]?|просп|пр-к?т|пр|переул(?:ок|ка|ке|ку)|пер|шоссе|ш|бульвар[аеу]?|б-р|бул|набережн(?:ая|ой|ую)|наб|площад[ьи]|пл|проезд[аеу]?|тупик[аеу]?|алле[яюи]|линия|тракт)"
_BUILDING = r"\d{1,4}(?:\s?(?:[кКkK/\-]|корп(?:ус)?\.?|стр(?:оение)?\.?|лит(?:ера)?\.?)\s?\d{1,4}|\s?[А-Яа-я](?![\w.]))?"
_UNIT = r"(?!\s*(?:руб|час|мин|дн|лет|год|км|мет|этаж|раз|сек|процент|%|шт|кг|\d{2}:))(?!:\d)"
_HOUSE = rf"(?:(?:д\.?|дом)\s*)?(?:{_BUILDING}|{_N}(?:\s+{_N})?(?:\s+{_N})?){_UNIT}"
_FLAT = rf"(?:,?\s*(?:кв\.?|квартира)\s*(?:\d{{1,4}}|{_N}(?:\s+{_N})?(?:\s+{_N})?))"
_TOWN = r"(?:\d{6},\s*(?:г\.\s*|город\s+)?|г\.\s*|город\s+)[А-ЯЁа-яё][а-яёА-ЯЁ\-]+,\s*"
ADDRESS = re.compile(
    rf"(?:{_TOWN})?(?<!\w){_SORT}(?:\.\s*|\s+){_S}(?:\s[А-ЯЁ][а-яё\-]{{3,}})?,?\s*{_HOUSE}{_FLAT}?"
    rf"|(?:{_TOWN})?{_STREET}\s+{_SORT}\b\.?,?\s*{_HOUSE}{_FLAT}?"
    rf"|\d{{6}},\s*{_TOWN}{_S},\s*{_HOUSE}{_FLAT}?|(?:г\.|город)\s*{_S},\s*{_S},\s*{_HOUSE}{_FLAT}?"
    rf"|{_S},\s*{_STREET},\s*(?:д\.?|дом)\s*\d{{1,4}}{_FLAT}?|(?:на\s+)?{_STREET},?\s+{_HOUSE}{_FLAT}|на\s+[А-ЯЁ][а-яё\-]*ую,\s*{_HOUSE}{_FLAT}?", re.I)
#: A street of adjective form and a house, no more: an address only where a cue stands before it.
BARE = re.compile(rf"(?:на\s+|в\s+)?{_STREET},?\s+{_HOUSE}", re.I)
TOKEN = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
# Endings of family names and patronymics, of all cases.
SURNAME = re.compile(r".{2,}(?:енко|[аеоиу]йко|ч[уе]к(?:а|у|ом|е)?|щук(?:а|у|ом|е)?|[юу]к|[ая]нян|ян|швили|дзе|берг(?:а|у|ом|е)?|штейн(?:а|у|ом|е)?|ман|ич|ей?ко|[оеё]в|[иы]н|ский|цкий|[оеё]ва|[иы]на|ская|цкая|[оеё]ву|[иы]ну|[оеё]вой|[иы]ной|[оеё]вым|[иы]ным|ского|скому|скую|ской|цкой|[оеё]ве|[оеё]вых|[иы]ных)\Z")
PATRONYMIC = re.compile(r".{2,}(?:[оеё]вич(?:а|у|ем|е)?|[оеё]вн(?:а|ы|е|у|ой)|ьич(?:а|у|ом|е)?|иничн(?:а|ы|е|у|ой))\Z")


def _forms(name: str) -> set[str]:
    n = name.replace("ё", "е")
    if n[-1] == "а":
        return {n, *(n[:-1] + e for e in ("ы", "и", "е", "у", "ой"))}
    if n[-1] == "я":
        return {n, *(n[:-1] + e for e in ("и", "е", "ю", "ей"))}
    if n[-1] == "й":
        return {n, *(n[:-1] + e for e in ("я", "ю", "ем", "е", "и"))}
    if n[-1] == "ь":
        return {n, *(n[:-1] + e for e in ("я", "ю", "ем", "е", "и"))}
    if n == "павел":
        return {"павел", "павла", "павлу", "павлом", "павле"}
    if n == "петр":
        return {"петр", "петра", "петру", "петром", "петре"}
    return {n, *(n + e for e in ("а", "у", "ом", "е"))}


GIVEN_FORMS = frozenset(f for n in GIVEN for f in _forms(n))


def spoken_digits(text: str) -> str:
    """Digits that number words stand for: "девятьсот семь сорок" is 907 40."""
    out, last = [], 0
    for w in re.findall(r"\w+", text.lower()):
        if w == "номер":
            last = 0
        if w not in _NUM:
            continue
        v = _NUM[w]
        # a smaller number after a round one continues it: "двести сорок один"
        if out and v and ((last == 100 and v < 100) or (last == 10 and v < 10)):
            out[-1] += v
            last = 10 if 20 <= v < 100 else 1
        else:
            out.append(v)
            last = 100 if v >= 100 else 10 if v >= 20 else 1
    return "".join(str(v) if v else "0" for v in out)


Span = tuple[str, int, int, tuple[int, ...], str]  # kind, start, end, votes, what else the classifier sees


def _near(text: str, a: int, b: int) -> tuple[str, str]:
    return text[max(0, a - 32): a].lower().replace("ё", "е"), text[b: b + 28].lower().replace("ё", "е")


def _cue(kind: str, before: str, after: str) -> tuple[int, int]:
    """A cue on either side votes for; a decoy that stands closer than any cue votes against."""
    cue = max((m.end() for m in CUES[kind].finditer(before)), default=-1)
    decoy = max((m.end() for m in DECOYS[kind].finditer(before)), default=-1)
    plus = 1 if cue > decoy or CUES[kind].search(after) else 0
    minus = -1 if decoy > cue or (DECOYS[kind].search(after) and cue < 0) else 0
    return plus, minus


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def _shaped(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Runs of whole groups between a and b that are shaped like one phone or id; of nested ones the longest."""
    groups = [(m.start(), m.end(), _digits(m.group())) for m in _GROUP.finditer(text, a, b)]
    out: list[tuple[int, int]] = []
    for i, (x, _, _) in enumerate(groups):
        n, best = 0, 0
        for _, y, k in groups[i:]:
            n += k
            if n > 12:
                break
            if n >= 10 and _SHAPED.fullmatch(text, x, y):
                best = y
        if best and not (out and best <= out[-1][1]):
            out.append((x, best))
    return out


def number_runs(text: str) -> list[tuple[int, int]]:
    """Where a phone or id may stand: digit spans of 10 to 12 digits, and the shaped runs of those that hold more than one number.

    Line ends and a dot before a blank part numbers, unless none of the parts has the digits of one.
    """
    out: list[tuple[int, int]] = []
    for m in DIGITS.finditer(text):
        if _digits(m.group()) < 10:
            continue
        ends = [(x.start(), x.end()) for x in _BREAK.finditer(text, m.start(), m.end())]
        cut = list(zip([m.start(), *(y for _, y in ends)], [*(x for x, _ in ends), m.end()], strict=True))
        parts = [(x, y) for x, y in cut if _digits(text[x:y]) >= 10]
        for x, y in parts or [(m.start(), m.end())]:
            whole = _digits(text[x:y]) <= 12
            out += [(x, y)] if whole else []
            if not whole or not _SHAPED.fullmatch(text, x, y):
                out += [r for r in _shaped(text, x, y) if r != (x, y)]
        if parts:  # a number that a line end cuts may stand beside a whole one
            out += [r for r in _shaped(text, m.start(), m.end()) if not any(r[0] < y and x < r[1] for x, y in out)]
    return out


def _numbers(text: str) -> Iterator[Span]:
    found = [(a, b, re.sub(r"\D", "", text[a:b]), text[a:b], False) for a, b in number_runs(text)] if sum(map(text.count, "0123456789")) >= 9 else []
    low = text.lower()
    if sum(map(low.count, _SPOKEN_STEMS)) >= 5:
        for m in SPOKEN.finditer(text):
            d = spoken_digits(m.group())
            if len(d) >= 9:
                found.append((m.start(), m.end(), d, m.group(), True))
    for a, b, d, raw, said in found:
        before, after = _near(text, a, b)
        n = len(d)
        direct = re.search(r"(?:заказ\w*|трек\w*|артикул\w*|\bинн|снилс|паспорт\w*|страхов\w*|сери[яи]|сумма)\W*(?:серия\W*|и\s+номер\W*|номер\W*)*\Z", before)
        mobile = ((n == 11 and d[0] in "78" and d[1] == "9") or (n == 10 and d[0] == "9")) and not direct  # the labeler abstains beside another kind's word
        shape = re.sub(r"\d", "0", raw) if not said else "said"
        if n in (10, 11) and not (said and n == 10 and d[0] != "9"):
            grouped = bool(re.fullmatch(r"(?:\+?\d)?[\s.(\-]*\d{3}[\s.)\-]*\d{3}[\s.\-]*\d\d[\s.\-]*\d\d", raw.strip())) or said
            odd = -1 if re.fullmatch(r"\d{3}[ \-]\d{3}[ \-]\d{3}[ \-]\d\d|\d\d \d\d\s*№?\s*\d{6}|\d{4}\s*№?\s+\d{6}", raw) or "№" in raw else 0
            plus = 1 if raw.startswith("+") or said and raw.lower().startswith("плюс") or n == 11 and d[:2] in ("79", "89") and not direct else 0
            yield "phone", a, b, (1 if mobile else 0 if direct and d[0] in "789" else -1, 1 if grouped and mobile else 0, plus, odd, *_cue("phone", before, after)), shape
        if n in (9, 10, 11, 12):
            layout = 1 if re.fullmatch(r"\d{3}[ \-]\d{3}[ \-]\d{3}[ \-]\d\d|(?:\d{4}|\d\d \d\d)(?:\s*№\s*|\s+|,?\s*номер\s*)\d{6}", raw, re.I) else 0  # a plain run of digits has none
            sort = 1 if re.search(r"инн\W*$|снилс\W*$|страхов\w*\W*$|пасп\w*\W*(?:серия\W*)?$|сери[яи]\W*(?:и\s+номер\W*)?$", before) or re.match(r"\W*это\s+паспорт", after) else 0
            if raw.startswith("+"):
                layout = sort = 0
            size = 1 if n == 10 or n == 12 or (n == 11 and layout) else 0
            call = -1 if mobile and not layout and not sort else 0
            yield "id_number", a, b, (layout, sort, size, call, *_cue("id_number", before, after)), shape


def _emails(text: str) -> Iterator[Span]:
    low = text.lower()
    if "@" not in text and "собак" not in low and "собачк" not in low and "(at)" not in low and "[at]" not in low and "точка" not in low and " dot " not in low:
        return
    for m in EMAIL.finditer(text):
        raw = m.group()
        before, after = _near(text, m.start(), m.end())
        latin = bool(re.search(r"[a-z]{2}", raw, re.I))
        sign = 1 if "@" in raw else 1 if re.search(r"\(at\)|\[at\]|соба|\bэт\b", raw, re.I) else 0
        end = 1 if re.search(r"[a-zа-я]{2,}\Z", raw, re.I) else -1
        yield "email", m.start(), m.end(), (sign, end, 1 if latin else -1, *_cue("email", before, after)), "@" if "@" in raw else "said"


def _addresses(text: str, a: int = 0, b: int = 1 << 60) -> Iterator[Span]:
    taken: list[tuple[int, int]] = []
    for m in ADDRESS.finditer(text, a, b):
        raw, start = m.group(), m.start()
        if (lead := re.match(r"[а-яё\-]+,\s*", raw)) and re.search(_STREET, raw[lead.end():]):  # a word before the street that is no town
            raw, start = raw[lead.end():], start + lead.end()
        taken.append((start, m.end()))
    if CUES["address"].search(text, max(0, a - 40), b):
        taken += [m.span() for m in BARE.finditer(text, a, b) if CUES["address"].search(_near(text, *m.span())[0]) and not any(m.start() < e and s < m.end() for s, e in taken)]
    for start, end in taken:
        raw, (before, after) = text[start:end], _near(text, start, end)
        street = 1 if re.search(rf"\b{_SORT}\b", raw, re.I) else 0
        flat = 1 if re.search(r"\bкв\b|квартира|\d[/\-]\d", raw, re.I) else 0
        town = 1 if re.search(r"\d{6},|\bг\.|город", raw, re.I) else 0
        house = 1 if re.search(r"\bд\.|\bдом\b", raw, re.I) else 0
        named = re.search(r"([а-яё\-]{3,}(?:ая|яя|ую|юю))\b", raw, re.I)
        yield "address", start, end, (street, flat, town, house, 1 if named else 0, *_cue("address", before, after)), re.sub(r"\d+", "0", re.sub(r"[^\W\d_]{4,}", "a", raw.lower()))[:24]


_OPENS = re.compile(r"(?:\A|[.!?…:\n])\s*\Z")  # where a sentence begins
_INITIAL = re.compile(r"\b[А-ЯЁ]\.|\b[а-яё]\.\s?[а-яё]\.")


@lru_cache(maxsize=200_000)
def _kind(word: str) -> str:
    """g: given name, p: patronymic, s: surname by form."""
    low = word.lower().replace("ё", "е")
    if low in GIVEN_FORMS:
        return "g"
    if len(low) >= 5:
        return "p" if PATRONYMIC.match(low) else "s" if SURNAME.match(low) else ""
    return ""


@lru_cache(maxsize=200_000)
def _given(word: str) -> bool:
    return _kind(word) in ("g", "p")


def _names(text: str, rare: np.ndarray | None) -> Iterator[Span]:
    """Runs of given name, patronymic, surname and initials with at least two parts.

    A word in capitals is a family name whatever its ending if it stands beside a given name with
    patronymic, or beside a given name and mostly beside names in all texts.
    """
    if not any(map(_given, TOKEN.findall(text))) and not _INITIAL.search(text):
        return
    toks = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text)]
    kind = [("i" if len(w) == 1 and text[b: b + 1] == "." and w.lower() not in "ь ы ъ" else _kind(w)) for _, b, w in toks]
    for x, k in enumerate(kind):  # a family name of any ending: beside given name and patronymic, or mostly met beside names
        if k != "g" or not toks[x][2][0].isupper():
            continue
        last = x + 1 if kind[x + 1: x + 2] == ["p"] else x
        for y, gap in ((x - 1, text[toks[x - 1][1]: toks[x][0]] if x else ""), (last + 1, text[toks[last][1]: toks[last + 1][0]] if last + 1 < len(toks) else "")):
            if gap == " " and not kind[y] and len(toks[y][2]) > 3 and toks[y][2][0].isupper():
                known = rare is not None and rare[word_bucket(toks[y][2].lower().replace("ё", "е"))] >= 0.6
                if known or last > x and (y > x or not _OPENS.search(text, max(0, toks[y][0] - 3), toks[y][0])):
                    kind[y] = "s"
                    break
    i = 0
    while i < len(toks):
        if not kind[i]:
            i += 1
            continue
        j = i
        while j + 1 < len(toks) and kind[j + 1] and j - i < 3 and re.fullmatch(r"\.? ?|\s", text[toks[j][1]: toks[j + 1][0]]) and (kind[j] == "i" or "." not in text[toks[j][1]: toks[j + 1][0]]):
            j += 1
        for lo in range(i, j + 1):  # the longest run that makes a name
            for hi in range(j, lo, -1):
                parts = "".join(kind[lo: hi + 1])
                low = any(k == "i" and toks[lo + x][2].islower() for x, k in enumerate(parts))
                if re.fullmatch(r"sgp?|gp?s|gp|sii?|ii?s|sgi|sg", parts) and not (low and "ii" not in parts):
                    a, b = toks[lo][0], toks[hi][1] + (1 if kind[hi] == "i" else 0)
                    words = [toks[x][2] for x in range(lo, hi + 1)]
                    before, after = _near(text, a, b)
                    cased = [w[0].isupper() for w, k in zip(words, parts, strict=True) if k != "i"]
                    fam = [w.lower().replace("ё", "е") for w, k in zip(words, parts, strict=True) if k == "s"]
                    odd = float(rare[word_bucket(fam[0])]) if rare is not None and fam else 1.0
                    votes = (1 if "p" in parts else 0, 1 if "i" in parts else 0, 1 if all(cased) else -1 if len(cased) > 1 and cased[0] and not cased[1] else 0,
                             1 if odd >= 0.5 else -1 if odd < 0.2 else 0, *_cue("name", before, after))
                    yield "name", a, b, votes, parts + ("A" if all(cased) else "a") + (f" {round(odd, 1)}")
                    i = hi
                    break
            else:
                continue
            break
        i += 1


#: No address is without one of these, and without a number near by.
_ANCHOR = re.compile(r"улиц|ул\b|просп|пр[.\- ]|переул|пер[. ]|шоссе|ш\.|бульв|бул\.|б-р|наб|площад|пл\.|проезд|тупик|алле[яюи]|линия|тракт|кв[. ]|квартир|дом |д\.|г\.|город |(?:[уо][юй]|[ая]я|ей),? (?=\d|[одтчпшсв])")
_NUMBER = re.compile(r"\d|один|два|две|три|четыр|пять|шесть|семь|восем|девят|десят|дцать|сорок|сто")


def _places(text: str) -> list[tuple[int, int]]:
    """Stretches, on borders of words, that every address of the text lies in."""
    low = text.lower()
    if not _NUMBER.search(low):
        return []
    if len(low) != len(text):
        return [(0, len(text))]
    out: list[tuple[int, int]] = []
    for m in _ANCHOR.finditer(low):
        if _NUMBER.search(low, m.start(), m.end() + 60):
            a, b = low.rfind(" ", 0, max(0, m.start() - 80)) + 1, min(len(low), m.end() + 120)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def spans(text: str, rare: np.ndarray | None = None) -> list[Span]:
    out = list(_emails(text))
    out += _numbers(text)
    for a, b in _places(text):
        out += _addresses(text, a, b)
    out += _names(text, rare)
    return out


@lru_cache(maxsize=200_000)
def word_bucket(word: str) -> int:
    return zlib.crc32(word.encode()) & (WORD_BUCKETS - 1)


def name_counts(texts: list[str]) -> Counter:
    """(bucket of a word of surname form or in capitals, stands beside a given name, patronymic or initial): count."""
    out: Counter = Counter()
    for t in texts:
        toks = TOKEN.findall(t)
        kinds = list(map(_kind, toks))
        for i, k in enumerate(kinds):
            if k == "s" or not k and len(toks[i]) > 3 and toks[i][0].isupper():
                near = [x for x in (i - 1, i + 1) if 0 <= x < len(toks)]
                out[word_bucket(toks[i].lower().replace("ё", "е")), any(kinds[x] in ("g", "p") or len(toks[x]) == 1 and toks[x].lower() not in "аиоувксяэ" for x in near)] += 1
    return out


def expectation(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, trust: float = 0.1) -> dict[tuple[int, ...], float]:
    """Probability that a span is of its kind, for each vote pattern; labelers are independent given the truth.

    A labeler's vote for never speaks against, nor its vote against for, and silence speaks less than a vote:
    otherwise two sorts of true spans, with and without some sign, could be taken for true and false ones.
    The belief that votes tend to be right weighs as much as the share ``trust`` of the spans, so the outcome
    depends on the shares of the patterns and not on how many spans there are.
    """
    if not patterns:
        return {}
    v = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float) / sum(c for _, c in patterns)
    post = np.clip(0.5 + 0.22 * v.sum(1), 0.05, 0.95)  # labelers start as better than chance
    like = (v[:, :, None] == np.array([-1, 0, 1])).astype(float)
    for _ in range(rounds):
        prior = np.clip(n @ post, 0.02, 0.98)
        pos = (np.einsum("p,plk->lk", n * post, like) + trust * np.array([0.1, 0.35, 0.55])) / (n @ post + trust)
        neg = (np.einsum("p,plk->lk", n * (1 - post), like) + trust * np.array([0.55, 0.35, 0.1])) / (n @ (1 - post) + trust)
        llr = np.log(pos) - np.log(neg)
        llr[:, 0], llr[:, 2] = np.minimum(llr[:, 0], 0), np.maximum(llr[:, 2], 0)
        llr[:, 1] = np.clip(llr[:, 1], llr[:, 0] / 2, llr[:, 2] / 2).clip(-1, 1)
        z = np.log(prior / (1 - prior)) + np.einsum("plk,lk->p", like, llr)
        post = 1 / (1 + np.exp(-np.clip(z, -20, 20)))
    # a span that no labeler supports is none, whatever the estimates
    return {p: float(x) if max(p) > 0 else 0.0 for (p, _), x in zip(patterns, post, strict=True)}


def features(kind: str, before: str, after: str, seen: str, votes: tuple[int, ...]) -> list[int]:
    f = [f"{kind}|b", f"{kind}|{seen}", *(f"{kind}|v{i}={x}" for i, x in enumerate(votes))]
    left, right = re.findall(r"\w+|[№@]", before)[-3:], re.findall(r"\w+|[№@]", after)[:2]
    f += [f"{kind}|l|{w[:8]}" for w in left] + [f"{kind}|r|{w[:8]}" for w in right]
    return [hash_text(x) for x in f]


def hash_text(s: str) -> int:
    h = 2166136261
    for c in s.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ (h >> 15)) & ((1 << BITS) - 1)


def fit_classifier(rows: list[tuple[list[int], float, float]], rounds: int = 150, l2: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels: rows of (features, probability, weight)."""
    w = np.zeros(1 << BITS)
    if not rows:
        return w
    row = np.repeat(np.arange(len(rows)), [len(f) for f, *_ in rows])
    col = np.concatenate([f for f, *_ in rows]).astype(np.int64)
    y, c = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    c *= len(rows) / c.sum()
    scale = 1 / (np.bincount(col, c[row], 1 << BITS) * 0.25 * (len(col) / len(rows)) ** 0.5 + l2)
    m = np.zeros_like(w)
    for _ in range(rounds):
        r = c * (1 / (1 + np.exp(-np.bincount(row, w[col], len(rows)))) - y)
        m = 0.8 * m - 0.25 * scale * (np.bincount(col, r[row], 1 << BITS) + l2 * 0.05 * w)
        w = w + m
    return w


_unpack = lru_cache(maxsize=10_000)(lambda s: tuple("-0+".index(c) - 1 for c in s))
_CAND = "array<struct<kind: string, start: long, end: long, votes: string, seen: string, before: string, after: string>>"
_CAND_ARROW = pa.list_(pa.struct([(f, pa.int64() if f in ("start", "end") else pa.string()) for f in ("kind", "start", "end", "votes", "seen", "before", "after")]))


def _shares(src: DataFrame) -> np.ndarray:
    """Per bucket: the share of its words of surname form that stand beside other parts of a name; 1 where there are none."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, WORD_BUCKETS), np.int64)
        for b in batches:
            for (k, near), n in name_counts(b.column(0).to_pylist()).items():
                total[int(near), k] += n
        at = np.nonzero(total.any(0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[1, at]), pa.array(total[0, at])], ["bucket", "near", "far"])

    got = src.select("__text").mapInArrow(count, "bucket int, near long, far long").groupBy("bucket").agg(F.sum("near").alias("near"), F.sum("far").alias("far")).toArrow()  # at most WORD_BUCKETS rows
    near, far = got.column("near").to_numpy(), got.column("far").to_numpy()
    out = np.ones(WORD_BUCKETS, np.float32)
    out[got.column("bucket").to_numpy()] = near / np.maximum(near + far, 1)
    return out


def _proposed(src: DataFrame, keys: list[str], stage: Stage, whole: bool) -> DataFrame:
    """(keys, [text], cands) of every row of (keys, __text), candidates with their votes; rows without any only if ``whole``, which also keeps the text."""
    rare = src.sparkSession.sparkContext.broadcast(_shares(src.where("__text is not null")))
    at = len(keys)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            rows = [[(k, x, y, "".join("-0+"[q + 1] for q in v), seen, *_near(t, x, y)) for k, x, y, v, seen in spans(t, rare.value)] if t and len(t) >= 5 else [] for t in texts]
            cands = pa.array([[dict(zip(("kind", "start", "end", "votes", "seen", "before", "after"), r, strict=True)) for r in rs] for rs in rows], _CAND_ARROW)
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in range(at + (1 if whole else 0))), cands], [*keys, *(["__text"] if whole else []), "cands"])
            yield out if whole else out.filter(pa.array([bool(r) for r in rows], pa.bool_()))

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if whole or f.name != "__text")
    return stage.cut(src.mapInArrow(propose, f"{head}, cands {_CAND}"))


def _fitted(cands: DataFrame) -> np.ndarray:
    """The span classifier: reliabilities from the counts of all vote patterns, then a fit on a bounded sample of unlike candidates, each weighed by its number."""
    one = cands.select(F.explode("cands").alias("c")).select("c.*")
    patterns = one.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()  # at most 3**7 patterns a kind
    post = {k: expectation([(_unpack(r.votes), r.n) for r in patterns if r.kind == k]) for k in KINDS}
    unlike = one.groupBy("kind", "before", "after", "seen", "votes").agg(F.count("*").alias("n"))
    spread = F.pmod(F.xxhash64("kind", "before", "after", "seen", "votes"), F.lit(1 << 20))
    total = one.select(F.approx_count_distinct(F.xxhash64("kind", "before", "after", "seen", "votes"))).first()[0]
    sample = unlike.where(spread <= int(min(1.0, TRAIN_SPANS / max(1, total)) * (1 << 20))).collect()
    return fit_classifier(sorted((features(r.kind, r.before, r.after, r.seen, _unpack(r.votes)), post[r.kind][_unpack(r.votes)], float(r.n)) for r in sample))


def _judged(model: np.ndarray, cands: list[dict]) -> list[tuple[str, int, int, float]]:
    z = [model[features(c["kind"], c["before"], c["after"], c["seen"], _unpack(c["votes"]))].sum() for c in cands]
    p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))
    return [(c["kind"], c["start"], c["end"], float(x)) for c, x in zip(cands, p, strict=True) if x >= 0.5]


def detect(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, kind, start, end, probability) of the accepted spans; end is exclusive, in code points.

    Null and empty texts have none; repeated rows give their spans once each; texts are searched whole.
    """
    spark = texts.sparkSession
    src = texts.select(*keys, F.col(text).alias("__text")).where(F.length("__text") >= 5)
    cand = _proposed(src, keys, Stage(spark, "pii"), False)
    model, at = spark.sparkContext.broadcast(_fitted(cand)), len(keys)  # of a fixed size

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, *s) for i, cs in enumerate(b.column(at).to_pylist()) for s in _judged(model.value, cs)]
            take = pa.array([g[0] for g in got], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in range(at)), pa.array([g[1] for g in got], pa.string()), *(pa.array([g[c] for g in got], pa.int64()) for c in (2, 3)), pa.array([g[4] for g in got], pa.float64())],
                                             [*keys, "kind", "start", "end", "probability"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__text")
    return cand.mapInArrow(judge, head + ", kind string, start long, end long, probability double")


def masked(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, text) of every row, accepted spans replaced with placeholders; of overlapping spans the likeliest stays.

    Texts stay with their candidates, so no text is shuffled; null texts stay null.
    """
    spark = texts.sparkSession
    src = texts.select(*keys, F.col(text).alias("__text"))
    cand = _proposed(src, keys, Stage(spark, "pii"), True)
    model, at = spark.sparkContext.broadcast(_fitted(cand)), len(keys)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, cs in zip(b.column(at).to_pylist(), b.column(at + 1).to_pylist(), strict=True):
                taken: list[tuple[int, int, str]] = []
                for k, x, y, _ in sorted(_judged(model.value, cs) if cs else [], key=lambda s: (-s[3], s[1] - s[2], s[1])):
                    if all(y <= a or x >= e for a, e, _ in taken):
                        taken.append((x, y, k))
                for a, e, k in sorted(taken, reverse=True):
                    t = t[:a] + PLACEHOLDER[k] + t[e:]
                out.append(t)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(at)), pa.array(out, pa.string())], [*keys, text])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__text")
    return cand.select(*keys, "__text", "cands").mapInArrow(mask, f"{head}, `{text}` string")
