"""Abusive, hateful and sexual content by a classifier chain.

Texts are folded (disguises undone: look-alikes, digits, spaced, stretched and starred letters), cut into
sentences and overlapping windows of words, and each window becomes a bag of hashed words, word pairs and
letter n-grams.  Three linear models are chained: the one for ``hateful`` also sees the probability of
``abusive``, the one for ``sexual`` those of both; in training these are out-of-fold predictions, so the
later models learn from probabilities as unsure as they will meet.  A document's score in a category is
that of its worst window.

The models are fitted here, on seed sentences and on a sample of at most ``LABELLED`` labelled documents.
Raters are weighed by how often they agree with the others.  A label says that some window of a document
has it; which, is chosen first by the seed model and by words that tell a category's documents from clean
ones, then by models of the other folds: a window that those do not confirm is no example.  The threshold
of each category is the one with the best F1 over out-of-fold scores of labelled documents and seeds.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.session import Stage

CATEGORIES = ("abusive", "hateful", "sexual")
#: Labelled documents and windows that the models are fitted on, at most.
LABELLED = 2000
WINDOWS = 15000
FOLDS = 3
SELECTIONS = 2  # rounds in which the examples are chosen anew by models that did not see them
BITS = 18
WIDTH = 12  # words of a window
THRESHOLD = 0.5

# Words and phrases that the seed sentences are made of, general knowledge of the two languages.
INSULTS = """идиот дебил кретин придурок тупица урод уродина тварь мразь скотина сволочь гнида ублюдок подонок козёл сука падла мудак дрянь ничтожество паскуда дегенерат недоумок чмо шавка гадина
подлец мерзавец тупорылый безмозглый мразота имбецил дура дурак быдло""".split()
INSULTS_EN = "idiot moron loser scumbag bastard bitch asshole jerk imbecile dumbass retard cunt prick pig".split()
TO_A_PERSON = ["ну ты и {}", "слышь ты {}", "{} ты конченый", "заткни пасть {}", "пошёл вон {}", "ненавижу тебя {}", "сдохни {}", "молчи {} пока цел"]
TO_A_PERSON_EN = ["you are such a {}", "you {} get lost", "shut your mouth {}", "i hate you {}"]
THREATS = ["убью тебя", "я тебя прибью", "я тебя зарежу", "я тебя найду и прикончу", "задушу тебя своими руками", "придушил бы тебя", "сломаю тебе челюсть", "переломаю тебе ноги", "голову тебе оторву", "закопаю тебя в лесу", "тебе не жить", "ты труп", "ты пожалеешь что родился",
           "иди повесься", "закрой свой рот", "тошнит от тебя", "лечи голову", "зря тебя родили",
           "i will kill you", "i will hurt you and your family", "i know where you live you are dead", "i will break your neck", "go die", "kill yourself", "drop dead", "you are worthless and pathetic", "nobody wants you here"]
GROUPS = "приезжих чужаков иноверцев иностранцев беженцев кочевников горцев южан северян".split()
OF_A_GROUP = ["гнать {} вон из города", "ненавижу {} всех до одного", "выселить бы {} отсюда", "{} надо давить как клопов", "перебить {} и дело с концом", "не берите {} на работу это недочеловеки", "от {} только грязь и зараза", "не пускайте {} к детям", "зачистить район от {} бить их"]
HATE = ["приезжие хуже скотов", "иноверцы не люди", "они нелюди и паразиты", "они все воры от рождения", "это низшая раса", "это порода воров и предателей", "грязный народ", "тупой народ от природы", "весь этот народ отбросы", "нелюди", "вырезать их веру под корень", "с такими рядом жить нельзя они как скот", "вырожденцы",
        "foreigners are vermin", "throw those people out of our country", "that race is filth", "those people are animals not humans", "keep those filthy people away from our children", "they are subhuman and should be exterminated", "never hire these people they are inferior"]
SEX = ["хочу тебя трахнуть", "трахались всю ночь", "потрахаемся", "отсоси мне", "она сосала и глотала", "сделай мне минет", "сделала минет", "возьми мой член в рот", "твой член внутри меня", "кончи мне на грудь", "он кончил ей на лицо", "я кончаю", "дрочу на твои фото", "подрочи мне", "раздвинь ноги", "раздвинула ножки и стонала",
       "вылизать тебя между ног", "облизать тебе соски", "сиськи наружу", "покажи сиськи", "скинь голое фото", "пришли интимное фото", "сними трусики", "сядь сверху и скачи", "войди в меня глубже", "у меня на тебя встал", "приезжай без белья", "раздену тебя и возьму сзади", "оргазм", "мокрая киска", "порно",
       "fuck me all night", "we fucked on the floor", "suck my cock", "she gave me a blowjob", "lick my pussy", "show me your tits", "send me naked pictures", "i want to lick you naked", "sit on my dick", "cum on my face", "he came inside me", "i am so horny i masturbate", "moaning and screaming in bed"]
PLAIN = ["корова отелилась и вся скотина сыта", "коза и козёл пасутся за оврагом", "сука принесла пятерых щенков", "гнида под микроскопом выглядит как капля", "дурак в колоде остаётся последним", "слово кретин пришло из медицины", "в романе достоевского идиот это князь", "лектор объяснил откуда взялось слово сволочь",
         "тварь из глубин моря светится", "убить время в очереди", "убил весь вечер на уборку", "мороз меня убивает", "чуть не умер со смеху", "повесился компьютер", "душит кашель", "переломал все ветки в саду", "член совета выступил с докладом", "главный член предложения", "член экипажа", "рот полоскать ромашкой",
         "грудь болит надо к врачу", "маммолог осмотрел грудь", "кормление грудью", "голые стены после ремонта", "голая правда", "кончил институт", "кончилась мука", "секс как раздел учебника биологии", "трусы и носки сохнут", "сел сверху на чемодан", "лизать мороженое", "стонала дверь на ветру",
         "паразиты у кота вывели таблетками", "тараканов травим на кухне", "клопов давить бесполезно", "порода собак редкая", "народ собрался на площади", "беженцев разместили в школе", "приезжих встретили хлебом", "грязь на дорогах", "зараза ходит по школе грипп", "выселить из общежития за долги", "вырезать фигурки из бумаги",
         "он обозвал меня идиотом и потом извинился", "в кино герой кричит сдохни", "в старой книге написано что их гнали", "учитель разобрал почему такие слова унижают людей", "статья о том как травят беженцев", "модератор удалил оскорбления",
         "the word idiot comes from greek", "a pig and a goat on the farm", "the doctor examined her breast", "the cat brought a dead mouse", "this heat is killing me", "you are dead right", "the villain shouts i will kill you in the film", "members of the committee", "nobody wants to wash the dishes", "we were screaming at the concert", "take off your shoes"]


def seed_sentences() -> list[tuple[str, str]]:
    """(sentence, category or none)."""
    out = [(x.format(w), "abusive") for k, w in enumerate(INSULTS) for x in TO_A_PERSON[k % 2:: 2]]
    out += [(x.format(w), "abusive") for k, w in enumerate(INSULTS_EN) for x in TO_A_PERSON_EN[k % 2:: 2]]
    out += [(x.format(w), "hateful") for k, w in enumerate(GROUPS) for x in OF_A_GROUP[k % 3:: 3]]
    return out + [(x, "abusive") for x in THREATS] + [(x, "hateful") for x in HATE] + [(x, "sexual") for x in SEX] + [(x, "none") for x in PLAIN]


_INVISIBLE = re.compile("[­​-‏⁠﻿̶̀́]")
_SPACED = re.compile(r"(?<![^\W_])[^\W_]([.\-_* ])[^\W_](?:\1[^\W_])+(?![^\W_])")  # one kind of sign all through
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_ODD = re.compile(r"[^\W_]*[^\W\d_][@$0-9*][\w@$*]*|[@$*0-9]+[^\W\d_][\w@$*]*|[a-z]+[а-я]\w*|[а-я]+[a-z]\w*")
_TRIGGER = re.compile(r"[a-zа-я][@$*0-9]|[@$*0-9][a-zа-я]|[a-z][а-я]|[а-я][a-z]")  # no odd word is without one
# Signs that stand for a letter in a disguised word.
_TO_CYR = str.maketrans("aceopxykmtnubh@03461", "асеорхукмтпивнаозчбл")
_TO_LAT = str.maketrans("@$01345", "asoieas")
_END = np.zeros(0x3000, bool)
_END[[ord(c) for c in ".!?…\n\r;"]] = True


def _unmask(m: re.Match) -> str:
    w = m.group()
    if not any(c.isalpha() for c in w):
        return w
    cyr = sum("а" <= c <= "я" for c in w)
    lat = sum("a" <= c <= "z" for c in w)
    if cyr and cyr >= lat or "*" in w and cyr:
        return w.translate(_TO_CYR) if sum(c.isdigit() for c in w) <= len(w) // 2 else w
    return w.translate(_TO_LAT) if lat > sum(c.isdigit() for c in w) and not cyr and len(w) < 16 else w


def fold(text: str) -> str:
    t = text.lower().replace("ё", "е")
    if not t.isascii():
        if max(t) > "\u20ff":  # full-width and mathematical letters
            t = unicodedata.normalize("NFKC", t).lower().replace("ё", "е")
        t = _INVISIBLE.sub("", t)
    t = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m.group()) if not m.group().replace(" ", "").isdigit() else m.group(), t)
    t = _STRETCHED.sub(r"\1", t)
    return _ODD.sub(_unmask, t) if _TRIGGER.search(t) else t


class Lexicon:
    """Words that a starred word may stand for, by length and ends."""

    def __init__(self, words: list[str]):
        self.by: dict[tuple[int, str], list[str]] = {}
        for w in words:
            self.by.setdefault((len(w), w[0]), []).append(w)
        self.known: dict[str, str] = {}

    def __call__(self, m: re.Match) -> str:
        w = m.group()
        if w not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            rx = re.compile("".join("." if c == "*" else re.escape(c) for c in w) + r"\Z")
            self.known[w] = next((x for x in self.by.get((len(w), w[0]), ()) if rx.match(x)), w)
        return self.known[w]


_STARRED = re.compile(r"[^\W_]+\*+[^\W_]*")


def prepare(texts: list[str], lexicon: Lexicon) -> list[str]:
    out = []
    for t in texts:
        t = fold(t)
        out.append(_STARRED.sub(lexicon, t) if "*" in t else t)
    return out


@dataclass
class Bags:
    """Features of the windows of texts: (window, feature) pairs; two sets of windows overlap by half."""
    n_texts: int
    feature: np.ndarray
    windows: list[np.ndarray]  # per set: window number of each feature
    text_of: list[np.ndarray]  # per set: text of each window
    n_word: int = 0  # so many features, the first ones, are of words and pairs


def bags(texts: list[str]) -> Bags:
    joined = "\n\n".join(texts) + "\n"
    c = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    low = np.minimum(c, 0x2FFF)
    letter = _LETTER[low]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    at = np.nonzero(first)[0]
    if not len(at):
        return Bags(len(texts), np.zeros(0, np.int64), [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2)
    word = np.cumsum(first) - 1
    pos = np.nonzero(letter)[0]
    own = word[pos]
    nth = pos - at[own]
    x = c[pos].astype(np.uint64) * _POWERS[np.minimum(nth, 63)]
    starts = np.searchsorted(own, np.arange(len(at)))
    h = np.add.reduceat(x, starts)
    h ^= h >> np.uint64(32)
    ends = np.concatenate([[0], np.cumsum(_END[low])])
    bounds = np.cumsum([0] + [len(t) + 2 for t in texts])
    doc = np.searchsorted(bounds, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (ends[at[1:]] != ends[at[:-1]]) | (doc[1:] != doc[:-1])
    sent = np.cumsum(new) - 1
    in_sent = np.arange(len(at)) - np.nonzero(new)[0][sent]
    uni = _bucket(h)
    pair = np.nonzero(~new)[0]
    bi = _bucket(h[pair] * np.uint64(0x9E3779B97F4A7C15) + h[pair - 1] * np.uint64(3))
    # letter four-grams inside words
    cc = c.astype(np.uint64)
    g = cc[:-3] + cc[1:-2] * np.uint64(70001) + cc[2:-1] * np.uint64(4900140001) + cc[3:] * np.uint64(343014700210003)
    whole = letter[:-3] & letter[1:-2] & letter[2:-1] & letter[3:]
    gp = np.nonzero(whole)[0]
    gram = _bucket(g[gp] * np.uint64(7) + np.uint64(11))
    feature = np.concatenate([uni, bi, gram])
    of = np.concatenate([np.arange(len(at)), pair, word[gp]])
    windows, text_of = [], []
    for shift in (0, WIDTH // 2):
        part = (in_sent + shift) // WIDTH
        brk = np.ones(len(at), bool)
        brk[1:] = new[1:] | (part[1:] != part[:-1])
        win = np.cumsum(brk) - 1
        windows.append(win[of])
        text_of.append(doc[np.nonzero(brk)[0]])
    return Bags(len(texts), feature, windows, text_of, len(uni) + len(bi))


_LETTER = np.array([chr(i).isalnum() for i in range(0x3000)])
_POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64) | np.uint64(1), dtype=np.uint64)


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(row: np.ndarray, feature: np.ndarray, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 2.0, rounds: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression on the features that occur, by momentum steps scaled per feature.  Returns (hashed weights, weights of extra + bias)."""
    used, col = np.unique(feature, return_inverse=True)
    n = len(y)
    curve = 0.25 * np.bincount(row, minlength=n).mean()  # bounds how far the features of one window add up
    scale = 1 / (np.bincount(col, weight[row], len(used)) ** 0.5 * curve**0.5 + l2)
    w, v = np.zeros(len(used)), np.zeros(extra.shape[1] + 1)
    v[-1] = np.log((weight @ y + 1) / (weight @ (1 - y) + 1)) / 2
    ex = np.column_stack([extra, np.ones(n)])
    vs = 1 / ((ex * ex * weight[:, None]).sum(0) * 0.25 + 1.0)
    mw, mv = np.zeros_like(w), np.zeros_like(v)
    for _ in range(rounds):
        r = weight * (sigmoid(np.bincount(row, w[col], n) + ex @ v) - y)
        mw = 0.8 * mw - 0.2 * scale * (np.bincount(col, r[row], len(used)) + l2 * w)
        mv = 0.8 * mv - 0.2 * vs * (ex.T @ r)
        w, v = w + np.clip(mw, -0.3, 0.3), v + np.clip(mv, -0.5, 0.5)
    out = np.zeros(1 << BITS)
    out[used] = w
    return out, v


@dataclass
class Chain:
    weights: np.ndarray  # [3, 2**BITS]
    extra: list[np.ndarray]
    lexicon: Lexicon
    shift: np.ndarray  # [3], log odds of each category's threshold

    def windows(self, b: Bags, k: int) -> np.ndarray:
        """Probabilities [3, windows] of one set of windows."""
        n = len(b.text_of[k])
        out = np.zeros((3, n))
        for i in range(3):
            z = np.bincount(b.windows[k], self.weights[i][b.feature], n) + self.extra[i][-1]
            for j in range(i):
                z += self.extra[i][j] * out[j]
            out[i] = sigmoid(z)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        """[3, texts]: the highest probability of any window, odds taken relative to the threshold's, so 0.5 is the threshold."""
        b = bags(prepare(texts, self.lexicon))
        best = np.zeros((3, len(texts)))
        for k in range(2):
            p = self.windows(b, k)
            for i in range(3):
                np.maximum.at(best[i], b.text_of[k], p[i])
        return np.where(best > 0, sigmoid(np.log(np.maximum(best, 1e-12) / np.maximum(1 - best, 1e-12)) - self.shift[:, None]), 0.0)


@dataclass
class Rows:
    """Windows of seeds and documents, both sets of windows: (window, feature) pairs, and the unit (seed or document) and fold of each window."""
    row: np.ndarray
    feature: np.ndarray
    unit: np.ndarray
    fold: np.ndarray

    def only(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of the windows kept, numbered anew."""
        use = keep[self.row]
        return (np.cumsum(keep) - 1)[self.row[use]], self.feature[use]

    def out_of_fold(self, keep: np.ndarray, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int) -> np.ndarray:
        """Each window's probability by a model that did not see its fold, fitted on the windows kept."""
        n = len(self.unit)
        p, ex = np.zeros(n), np.column_stack([extra, np.ones(n)])
        for f in range(FOLDS):
            mine, seen = self.fold == f, keep & (self.fold != f)
            w, v = train(*self.only(seen), extra[seen], y[seen], weight[seen], rounds=rounds)
            row, feature = self.only(mine)
            p[mine] = sigmoid(np.bincount(row, w[feature], mine.sum()) + ex[mine] @ v)
        return p


def chain(rows: Rows, keep: np.ndarray, y: np.ndarray, weight: np.ndarray, lexicon: Lexicon) -> tuple[Chain, np.ndarray]:
    """Fit the three models in turn; the earlier ones' probabilities are out of fold in training.  Also returns all out-of-fold probabilities."""
    extra, weights, extras = np.zeros((len(rows.unit), 0)), [], []
    for i in range(3):
        w, v = train(*rows.only(keep), extra[keep], y[i, keep], weight[keep])
        weights.append(w)
        extras.append(v)
        extra = np.column_stack([extra, rows.out_of_fold(keep, extra, y[i], weight, 120)])
    return Chain(np.array(weights, np.float32), extras, lexicon, np.zeros(3)), extra.T


def best_threshold(score: np.ndarray, true: np.ndarray, weight: np.ndarray, near: float = 0.985) -> float:
    """Log odds of a threshold: the middle of those whose F1 is within ``near`` of the best, as erring raters blur which is best."""
    o = np.argsort(-score)
    s, tp, fp = score[o], np.cumsum((weight * true)[o]), np.cumsum((weight * ~true)[o])
    if not tp[-1]:
        return 0.0
    f1 = 2 * tp / (tp + fp + tp[-1])
    f1[:-1][s[1:] == s[:-1]] = 0  # equal scores stay together
    good = np.nonzero(f1 >= near * f1.max())[0]
    z = np.log(np.clip(s, 1e-4, 1 - 1e-4) / (1 - np.clip(s, 1e-4, 1 - 1e-4)))
    low = z[good[-1] + 1] if good[-1] + 1 < len(z) else z[good[-1]]
    return float(np.clip((z[good[0]] + max(low, -3.0)) / 2, -2.0, 3.0))


def rater_votes(labels: list[tuple[int, str, str]]) -> dict[int, tuple[str, float]]:
    """Document: (label, certainty).  A rater's weight is how often they agree with the others on shared documents."""
    by: dict[int, list[tuple[str, str]]] = {}
    for d, label, rater in labels:
        by.setdefault(d, []).append((label, rater))
    agree: dict[str, list[int]] = {}
    for votes in by.values():
        for i, (a, r) in enumerate(votes):
            for j, (b, _) in enumerate(votes):
                if i != j:
                    agree.setdefault(r, []).append(a == b)
    trust = {r: (sum(x) + 4) / (len(x) + 5) for r, x in agree.items()}
    out = {}
    for d, votes in by.items():
        total: dict[str, float] = {}
        for a, r in votes:
            t = min(trust.get(r, 0.8), 0.98)
            total[a] = total.get(a, 0) + np.log(t / (1 - t))
        best = max(total, key=lambda a: (total[a], a))
        rest = sum(x for a, x in total.items() if a != best)
        out[d] = (best, float(sigmoid(np.array(total[best] - rest))))
    return out


def telling(b: Bags, inside: np.ndarray, others: np.ndarray, served: np.ndarray, share: float = 0.03, least: int = 4, odds: float = 2.5, total: float = 5.0) -> np.ndarray:
    """For documents of a category without an example so far: the window whose features tell the category's
    documents from all others most, if they do so clearly.  inside and others are per window."""
    out = np.zeros(len(inside), bool)
    n_in, n_others = len(np.unique(b.text_of[0][inside])), len(np.unique(b.text_of[0][others]))
    if n_in < 2 * least or n_others < 2 * least:
        return out
    win, feat = b.windows[0][: b.n_word], b.feature[: b.n_word]

    def documents(mask: np.ndarray) -> np.ndarray:
        use = mask[win]
        pairs = np.unique(b.text_of[0][win[use]] * (1 << BITS) + feat[use])
        return np.bincount(pairs % (1 << BITS), minlength=1 << BITS)

    a, c = documents(inside), documents(others)
    lo = np.log((a + 0.5) / (n_in + 1)) - np.log((c + 0.5) / (n_others + 1))
    lo[(a < max(least, share * n_in)) | (lo < odds)] = 0
    score = np.bincount(win, lo[feat], len(inside))
    best = np.zeros(b.n_texts)
    np.maximum.at(best, b.text_of[0], np.where(inside, score, 0))
    return inside & ~served[b.text_of[0]] & (score >= total) & (score == best[b.text_of[0]])


def examples(p: np.ndarray, label: np.ndarray, unit: np.ndarray, least: float) -> np.ndarray:
    """[3, windows]: in documents of a category, the windows that are likely, or the likeliest one if it is not unlikely."""
    y = np.zeros(p.shape, bool)
    for i in range(3):
        best = np.full(unit.max() + 1, -1.0)
        np.maximum.at(best, unit, p[i])
        y[i] = (label == i) & ((p[i] >= 0.5) | ((p[i] == best[unit]) & (p[i] >= least)))
    return y


def fit(labelled: list[tuple[str, str, float]]) -> Chain:
    """labelled: (text, label, certainty) of documents.  No labelled document: the seeds alone."""
    seeds = seed_sentences()
    lexicon = Lexicon(sorted({w for t, k in seeds if k != "none" for w in fold(t).split() if len(w) >= 4}))
    rng = np.random.default_rng(5)
    b = bags(prepare([t for t, _ in seeds] + [x[0] for x in labelled], lexicon))
    n_seeds, n0, n = len(seeds), len(b.text_of[0]), len(b.text_of[0]) + len(b.text_of[1])
    unit = np.concatenate(b.text_of)
    rows = Rows(np.concatenate([b.windows[0], b.windows[1] + n0]), np.tile(b.feature, 2), unit, (rng.permutation(b.n_texts) % FOLDS)[unit])
    truth = np.array([CATEGORIES.index(k) if k in CATEGORIES else -1 for k in [k for _, k in seeds] + [x[1] for x in labelled]])
    certain = np.concatenate([np.ones(n_seeds), [x[2] for x in labelled]])
    label, sure, is_seed = truth[unit], certain[unit], unit < n_seeds
    y = np.array([is_seed & (label == i) for i in range(3)])
    start, p = chain(rows, is_seed, y.astype(float), sure, lexicon)
    if not labelled:
        return start
    p = np.concatenate([start.windows(b, 0), start.windows(b, 1)], 1)
    y |= examples(p, label, unit, 0.35) & ~is_seed
    served = [np.bincount(unit, y[i], b.n_texts) > 0 for i in range(3)]
    for i in range(3):
        first = slice(0, n0)
        mine = label[first] == i
        y[i, first] |= telling(b, mine & ~is_seed[first], ~mine & ~is_seed[first], served[i])
    for turn in range(SELECTIONS + 1):
        top, positive = p.max(0), y.any(0)
        weight = sure.copy()
        weight[~is_seed & (label >= 0) & ~positive & (top > 0.2)] = 0  # unclear windows of a labelled document
        weight[~is_seed & (label < 0) & (top > 0.8)] *= 0.5  # a rater may have erred
        # every example and every window that looks like one; of the others at most about WINDOWS
        keep = (is_seed | positive | (top > 0.05) | (rng.random(n) < WINDOWS / max(1, n))) & (weight > 0)
        if turn < SELECTIONS:
            p = np.array([rows.out_of_fold(keep, np.zeros((n, 0)), y[i].astype(float), weight, 60) for i in range(3)])
            y = np.where(is_seed, y, examples(p, label, unit, 0.3))
    model, oof = chain(rows, keep, y.astype(float), weight, lexicon)
    for i in range(3):
        s = np.zeros(b.n_texts)
        np.maximum.at(s, unit, oof[i])
        model.shift[i] = best_threshold(s, truth == i, certain)
    return model


def scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, abusive, hateful, sexual) for every row: the probability that the text itself is such.

    Null and wordless texts score 0; rows without id keep a null id; repeated rows are scored alike; labels
    of unknown documents and of null text are ignored; without labels the seed sentences alone are used.
    """
    spark = docs.sparkSession
    named = labels.where("doc_id is not null and label is not null").select("doc_id", "label", F.coalesce("rater", F.lit("")).alias("rater"))
    many = named.select("doc_id").distinct().count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) <= int(min(1.0, LABELLED / max(1, many)) * (1 << 20))
    votes = rater_votes([tuple(r) for r in named.where(share).distinct().collect()])  # about LABELLED documents
    ids = spark.createDataFrame([(d,) for d in sorted(votes)], "__id long")
    picked = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text")).where("__text is not null").join(F.broadcast(ids), "__id").dropDuplicates(["__id"]).orderBy("__id").collect() if votes else []
    model = spark.sparkContext.broadcast(fit([(t, *votes[d]) for d, t in picked]))  # weights of a fixed size

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = b.num_columns - 1
            raw, out, lo = [t or "" for t in b.column(last).to_pylist()], [], 0
            while lo < len(raw):
                hi, size = lo, 0
                while hi < len(raw) and (size == 0 or size < 300_000):
                    size += len(raw[hi])
                    hi += 1
                out.append(model.value.score(raw[lo:hi]))
                lo = hi
            s = np.concatenate(out, 1) if out else np.zeros((3, 0))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(last)), *(pa.array(s[i]) for i in range(3))], [doc_id, *keep, *CATEGORIES])

    src = docs.select(doc_id, *keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != text)
    return src.mapInArrow(judge, schema + "".join(f", {c} double" for c in CATEGORIES))


def found(scored: DataFrame, doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    hit = F.filter(F.array(*[F.when(F.col(c) >= threshold, F.lit(c)) for c in CATEGORIES]), lambda x: x.isNotNull())
    return scored.where(F.col(doc_id).isNotNull()).select(doc_id, F.explode(hit).alias("category")).distinct()


def rates(scored: DataFrame, source: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """Per source (trimmed, lower case; null as unknown): documents, and share at or above the threshold per category."""
    return (scored.groupBy(F.coalesce(F.lower(F.trim(F.col(source))), F.lit("unknown")).alias("source"))
            .agg(F.count("*").alias("documents"), *[F.avg((F.col(c) >= threshold).cast("double")).alias(c) for c in CATEGORIES]))
