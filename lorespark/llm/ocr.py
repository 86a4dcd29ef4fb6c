"""Noise in text from scanned pages, and its repair.

Every photo's text is taken apart once: words (line-end hyphens undone), hyphenated places, lines.  The
rest are joins in SQL over the words of all photos:

* misrecognition: the anagram hash of a word is the sum of its letters' hashes; a word less one letter
  has the hash less that letter's.  Rare words meet frequent ones at equal reduced hashes, which finds
  all pairs one substitution apart; the substitution must be one that readers confuse, and the most
  frequent variant is the correction.  Words that mix scripts or digits are folded first.  Counts are
  of distinct texts, and only their ratio decides; where it is near, a form whose neighbours are
  not those of the frequent one is a word of its own;
* hyphenation: evidence is the words' counts, joined against hyphenated;
* running headers: lines of one message that agree after confusable letters are folded to classes and
  that stand on two photos, found by the smallest and largest photo of each (message, line) group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.session import Stage

MIN_CONF = 0.6
#: Distinct texts with the frequent form per text with the rare one: at least NEAR, or FAR for words of up to three letters.
#: Below FAR, the share of the rare form's neighbours that the frequent form has too must be OWN at least; as if of
#: three neighbours two had been seen with both before, so that the ratio alone decides on a form with hardly any.
NEAR, FAR, OWN = 3, 10, 0.4
# Signs that stand for a Cyrillic letter inside a Cyrillic word.
LOOKALIKES = {"0": "о", "1": "л", "3": "з", "4": "ч", "6": "б", "7": "т", "8": "в", "a": "а", "b": "в", "c": "с", "e": "е", "h": "н", "k": "к", "m": "т", "o": "о", "p": "р",
              "t": "т", "x": "х", "y": "у", "u": "и", "n": "п", "l": "л", "r": "г", "s": "ѕ"}
# Letters of one alphabet that are read as one another.
CONFUSED = ["ес", "ин", "лп", "мш", "пц", "шщ", "зэ", "бв", "гт", "пн", "ьъ", "цщ"]
# Classes of signs that a line's key does not tell apart.
CLASSES = ["ео0oecсё", "инhun", "лпц1lд", "мшщт7tm", "з3э", "в8b", "ч4", "б6", "рp", "уy", "хx", "кk", "аa", "ьъы"]
_CLASS = {ord(c): g[0] for g in CLASSES for c in g}
HYPHENS = "-­¬‐‑"
_CUT = re.compile(rf"(?<=[^\W_])[{HYPHENS}][ \t]*\r?\n[ \t]*([^\W_]+)")
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_NUMBER = re.compile(r"(?:c|с)?(?:[тtm7][рp](?:\.|[^\W\d_]*)?)?\s*[-–—\[(]?\s*\d{1,4}\s*(?:(?:/|из)\s*\d{1,4})?\s*[-–—\])]?", re.I)
_BESIDE = re.compile(r"\d{1,4}(?:\s{2,}|\t+)(\S.*[^\W\d_].*)|(\S.*[^\W\d_].*?)(?:\s{2,}|\t+)\d{1,4}")
_CLOCK = re.compile(r"\d{1,2}:\d{2}")
_ITEM = re.compile(r"[-–—•*]\s+\S|\d{1,2}[.)]\s+\S|\d{1,2}:\d{2}\s+[-–—]")
_RECEIPT = re.compile(r"\d\s*[xх]\s*\d+[.,]\d\d|\bИТОГ|ЧЕК\b")


def tidy(word: str) -> str:
    return word.lower().replace("ё", "е")


def cuts(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, first part, second part) of words cut at a line end; of a word cut twice the first cut."""
    out: list[tuple[int, int, str, str]] = []
    for m in _CUT.finditer(text):
        i = m.start()
        while i and text[i - 1].isalnum():
            i -= 1
        if (not out or i >= out[-1][1]) and any(map(str.isalpha, text[i: m.start()])):
            out.append((i, m.end(), text[i: m.start()], m[1]))
    return out


def uncut(text: str, found: list[tuple[int, int, str, str]], join) -> str:
    """The text with each cut word replaced by join(first part, second part), or left as it is for None."""
    out, at = [], 0
    for a, b, x, y in found:
        out += [text[at:a], text[a:b] if (w := join(x, y)) is None else w]
        at = b
    return "".join(out) + text[at:]


def mixed_and_plain(word: Column) -> tuple[Column, Column]:
    """Whether a Cyrillic word has foreign signs that stand for letters, and the word with them folded; compounds are judged as a whole."""
    bare = F.replace(word, F.lit("-"), F.lit(""))
    cyr = F.length(F.regexp_replace(bare, "[^а-я]", ""))
    odd = F.length(F.regexp_replace(bare, "[^" + "".join(LOOKALIKES) + "іi]", ""))
    mixed = (cyr >= 1) & (odd >= 1) & (cyr + odd == F.length(bare)) & (F.length(bare) >= 3) & (cyr >= odd)
    plain = F.translate(word, "і", "i")
    for a, b in (("i[oо]", "ю"), ("[ьb]i", "ы")):
        plain = F.regexp_replace(plain, a, b)
    return mixed, F.when(mixed, F.translate(plain, "".join(LOOKALIKES), "".join(LOOKALIKES.values()))).otherwise(word)


def line_key(line: str) -> str:
    """What is left of a line when case, digits at its ends, signs and confusable letters are folded."""
    t = line.strip().lower().replace("і", "i").replace("ьi", "ы").replace("iо", "ю").replace("io", "ю")
    t = re.sub(r"^\d{1,4}\s{2,}|\s{2,}\d{1,4}$", "", t)
    return re.sub(r"[\W_]+", "", t.translate(_CLASS))


def is_page(lines: list[str]) -> bool:
    """Running text: mostly lines of prose, no chat clock, no receipt."""
    solid = [x.strip() for x in lines if x.strip()]
    if any(_CLOCK.fullmatch(x) for x in solid) or any(_RECEIPT.search(x) for x in solid):
        return False
    prose = [x for x in solid if len(re.findall(r"[^\W_]{2,}", x)) >= 3 and not _ITEM.match(x)]
    items = sum(bool(_ITEM.match(x)) for x in solid)
    return len(prose) >= 2 and len(prose) * 2 >= len(solid) and items * 3 < len(solid)


def number_lines(lines: list[str]) -> list[int]:
    """Lines that are, or have beside them, a page number."""
    out = []
    for i, x in enumerate(lines):
        x = x.strip()
        if not x or not any(c.isdigit() for c in x):
            continue
        if _NUMBER.fullmatch(x) or (m := _BESIDE.fullmatch(x)) and len((m[1] or m[2]).split()) >= 2:
            out.append(i)
    return out


def take_apart(text: str) -> tuple[list[str], list[tuple[str, str, str]], list[str], bool, bool, str]:
    """(words, hyphenated (joined, compound, tail), line keys, page of running text, has a page number, words in order)."""
    cut = []
    found = cuts(text)
    for _, _, x, y in found:
        a, b = tidy(x), tidy(y)
        if y[0].isupper() and x[-1].islower() or not any(c.isalpha() for c in b):
            continue
        cut.append((a + b, f"{a}-{b}", b))
    joined = uncut(text, found, lambda x, y: x + y)
    run = list(map(tidy, _WORD.findall(joined)))
    words = sorted({w for w in run if any(c.isalpha() for c in w)} | {p for w in run if "-" in w for p in w.split("-") if len(p) > 1})
    lines = re.split(r"\r?\n", text)
    page = is_page(lines)
    keys = [k for x in lines if len(x.split()) >= 2 and len(k := line_key(x)) >= 8] if page else []
    return words, cut, sorted(set(keys)), page, page and bool(number_lines(lines)), " ".join(run)


_PARTS = "attachment_id long, message_id long, words array<string>, cuts array<struct<joined: string, compound: string, tail: string>>, keys array<string>, paged boolean, numbered boolean, run string, good boolean, h long"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("joined", pa.string()), ("compound", pa.string()), ("tail", pa.string())]))
    for b in batches:
        rows = [take_apart(t) for t in b.column(2).to_pylist()]
        cuts = [[{"joined": j, "compound": c, "tail": t} for j, c, t in r[1]] for r in rows]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array(cuts, kind), pa.array([r[2] for r in rows], pa.list_(pa.string())),
                                          pa.array([r[3] for r in rows]), pa.array([r[4] for r in rows]), pa.array([r[5] for r in rows], pa.string()), b.column(3), b.column(4)],
                                         ["attachment_id", "message_id", "words", "cuts", "keys", "paged", "numbered", "run", "good", "h"])


def parts(photos: DataFrame) -> DataFrame:
    """The taken-apart texts, written once.  good marks the photos that are judged: ok and read well enough."""
    src = photos.select(F.col("attachment_id").cast("long"), F.col("message_id").cast("long"), F.col("ocr_text").alias("text"),
                        F.coalesce((F.col("status") == "ok") & (F.col("ocr_conf") >= F.lit(MIN_CONF).cast("float")), F.lit(False)).alias("good"), F.xxhash64("ocr_text").alias("h"))
    return Stage(photos.sparkSession, "ocr").cut(src.where("attachment_id is not null and trim(text) <> ''").mapInArrow(_parse, _PARTS))


def vocabulary(taken: DataFrame) -> DataFrame:
    """(word, n, mixed, plain): the words of good photos with the number of distinct texts that have them, written once; copies of a text are no further evidence."""
    once = taken.where("good").dropDuplicates(["h"])
    n = once.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    mixed, plain = mixed_and_plain(F.col("word"))
    return Stage(taken.sparkSession, "ocr-vocabulary").cut(n.withColumn("mixed", mixed).withColumn("plain", plain))


def corrections(taken: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """(word, correction, n, n_correct): misread words with their most frequent confusable variant."""
    spark = taken.sparkSession
    stage = Stage(spark, "ocr-words")
    vocab = vocabulary(taken) if vocab is None else vocab
    once = taken.where("good").dropDuplicates(["h"])
    clean = vocab.where(~F.col("mixed")).select(F.col("word").alias("plain"), F.col("n").alias("n_correct"))
    by_sign = (vocab.where("mixed").join(clean, "plain", "left").where("n_correct is not null or (length(word) >= 5 and not word rlike '^[0-9]')")
               .select("word", F.col("plain").alias("correction"), "n", F.coalesce("n_correct", F.lit(0)).alias("n_correct")))
    pairs = {(a, b) for a, b in ((p[0], p[1]) for p in CONFUSED)} | {(b, a) for a, b in ((p[0], p[1]) for p in CONFUSED)}
    confused = spark.createDataFrame(sorted(pairs), "a string, b string")  # a fixed list
    met = stage.cut(spark.sql(f"""
        WITH hashed AS (
          SELECT plain, n_correct AS n, aggregate(split(plain, ''), 0L, (s, c) -> s + pmod(xxhash64(c), 1099511627776L)) AS anagram FROM {{vocab}}),
        reduced AS (
          SELECT plain, n, length(plain) AS len, c AS letter, anagram - pmod(xxhash64(c), 1099511627776L) AS key
          FROM hashed LATERAL VIEW explode(array_distinct(split(plain, ''))) AS c)
        SELECT DISTINCT r.plain AS word, r.n, f.plain AS correction, f.n AS n_correct
          FROM reduced r JOIN reduced f ON r.key = f.key AND r.len = f.len AND f.n >= r.n * IF(r.len <= 3, {FAR}, {NEAR})
          JOIN {{confused}} k ON k.a = f.letter AND k.b = r.letter
          WHERE levenshtein(r.plain, f.plain) = 1""", vocab=clean.where("plain rlike '^[а-я]{2,}$'"), confused=confused))
    far = F.col("n_correct") >= FAR * F.col("n")
    by_letter = (met.where(far).unionByName(_at_home(once, met.where(~far))).groupBy("word")
                 .agg(F.max_by("correction", F.struct("n_correct", "correction")).alias("correction"), F.first("n").alias("n"), F.max("n_correct").alias("n_correct")))
    return stage.cut(by_sign.unionByName(by_letter))


def _at_home(once: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (word, n, correction, n_correct) whose word has its correction's neighbours in the texts."""
    asked = pairs.select(F.col("word").alias("form")).union(pairs.select("correction")).distinct()
    two = once.select(F.split("run", " ").alias("t")).where("size(t) > 1").select(
        F.explode(F.arrays_zip(F.expr("slice(t, 1, size(t) - 1)").alias("a"), F.expr("slice(t, 2, size(t) - 1)").alias("b"))).alias("x"))
    after = two.select(F.col("x.a").alias("form"), F.lit(1).alias("side"), F.col("x.b").alias("other"))
    before = two.select(F.col("x.b").alias("form"), F.lit(-1).alias("side"), F.col("x.a").alias("other"))
    beside = Stage(once.sparkSession, "ocr-beside").cut(after.unionByName(before).join(asked, "form", "left_semi").groupBy("form", "side", "other").agg(F.count("*").alias("k")))
    theirs = beside.select(F.col("form").alias("correction"), "side", "other", F.lit(True).alias("both"))
    seen = (pairs.select("word", "correction").join(beside.withColumnRenamed("form", "word"), "word").join(theirs, ["correction", "side", "other"], "left")
            .groupBy("word", "correction").agg(F.sum("k").alias("k"), F.sum(F.when(F.col("both"), F.col("k")).otherwise(0)).alias("shared")))
    kept = pairs.join(seen, ["word", "correction"], "left").where((F.coalesce("shared", F.lit(0)) + 2) / (F.coalesce("k", F.lit(0)) + 3) >= OWN)
    return kept.select(*pairs.columns)


def noise(photos: DataFrame) -> DataFrame:
    """(attachment_id, kind) for photos with status ok and confidence of at least 0.6, one row per kind of noise.

    Null, empty and blank texts have none; a null status or confidence counts as bad; repeated rows of one
    photo give its kinds once; a photo without message has no running header.
    """
    taken = parts(photos)
    vocab = vocabulary(taken)
    fixes = corrections(taken, vocab)
    good = taken.where("good")
    words = good.select("attachment_id", F.explode("words").alias("word"))
    misread = words.join(fixes.select("word"), "word", "left_semi").select("attachment_id", F.lit("misrecognition").alias("kind"))
    cut = good.select("attachment_id", F.explode("cuts").alias("c")).select("attachment_id", "c.joined", "c.compound")
    cut = (cut.join(vocab.select(F.col("word").alias("joined"), F.col("n").alias("nj")), "joined", "left")
           .join(vocab.select(F.col("word").alias("compound"), F.col("n").alias("nc")), "compound", "left"))
    hyphen = cut.where("coalesce(nc, 0) < coalesce(nj, 1)").select("attachment_id", F.lit("hyphenation").alias("kind"))
    number = good.where("numbered").select("attachment_id", F.lit("page_number").alias("kind"))
    return misread.unionByName(hyphen).unionByName(number).unionByName(headers(taken).select("attachment_id", F.lit("running_header").alias("kind"))).distinct()


def headers(taken: DataFrame) -> DataFrame:
    """(attachment_id, key): title lines of good pages that stand on another photo of the message."""
    keyed = taken.where("message_id is not null").select("message_id", "attachment_id", "good", F.explode("keys").alias("key"))
    seen = keyed.groupBy("message_id", "key").agg(F.min("attachment_id").alias("lo"), F.max("attachment_id").alias("hi")).where("lo <> hi")
    return keyed.where("good").join(seen, ["message_id", "key"], "left_semi").select("attachment_id", "key").distinct()


def repair(text: str, fixes: dict[str, str], header_keys: set[str], keep_compounds: set[str]) -> str:
    """Continuous paragraphs: title lines and page numbers out, hyphens undone, misread words corrected."""
    lines = re.split(r"\r?\n", text)
    page = is_page(lines)
    drop = set(number_lines(lines)) if page else set()
    kept = [x for i, x in enumerate(lines) if i not in drop and not (header_keys and line_key(x) in header_keys)]
    body = "\n".join(kept)
    body = uncut(body, cuts(body), lambda x, y: None if y[0].isupper() and x[-1].islower() else f"{x}-{y}" if tidy(f"{x}-{y}") in keep_compounds else x + y)

    def fix(m: re.Match) -> str:
        w = m.group()
        if (c := fixes.get(tidy(w))) is None:
            return w
        return c.upper() if w.isupper() and len(w) > 1 else c.capitalize() if w[0].isupper() else c

    body = _WORD.sub(fix, body)
    if not page:
        return body.strip()
    return "\n\n".join(" ".join(p.split()) for p in re.split(r"\n[ \t]*\n", body) if p.strip())


def repaired(photos: DataFrame) -> DataFrame:
    """(attachment_id, text) of the photos that are judged, repaired."""
    taken = parts(photos)
    vocab = vocabulary(taken)
    fixes = corrections(taken, vocab)
    own = taken.where("good").select("attachment_id", F.explode("words").alias("word")).join(fixes.select("word", "correction"), "word").select("attachment_id", F.lit("fix").alias("what"), "word", "correction")
    head = headers(taken).select("attachment_id", F.lit("head").alias("what"), F.col("key").alias("word"), F.lit(None).cast("string").alias("correction"))
    cut = taken.where("good").select("attachment_id", F.explode("cuts").alias("c")).select("attachment_id", "c.joined", "c.compound")
    whole = (cut.join(vocab.select(F.col("word").alias("joined"), F.col("n").alias("nj")), "joined", "left")
             .join(vocab.select(F.col("word").alias("compound"), F.col("n").alias("nc")), "compound", "left")
             .where("coalesce(nc, 0) >= coalesce(nj, 1)").select("attachment_id", F.lit("compound").alias("what"), F.col("compound").alias("word"), F.lit(None).cast("string").alias("correction")))
    small = own.unionByName(head).unionByName(whole).groupBy("attachment_id").agg(F.collect_set(F.struct("what", "word", "correction")).alias("edits"))  # at most a text's words and lines
    texts = photos.where(f"status = 'ok' and ocr_conf >= float({MIN_CONF}) and trim(ocr_text) <> ''").select("attachment_id", "ocr_text").dropDuplicates(["attachment_id"])
    all_ = texts.join(small, "attachment_id", "left")  # the one join that carries texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, edits in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                of = {k: [(e["word"], e["correction"]) for e in edits or () if e["what"] == k] for k in ("fix", "head", "compound")}
                out.append(repair(t, dict(of["fix"]), {w for w, _ in of["head"]}, {w for w, _ in of["compound"]}))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["attachment_id", "text"])

    return all_.select("attachment_id", "ocr_text", "edits").mapInArrow(run, "attachment_id long, text string")
