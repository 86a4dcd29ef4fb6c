"""Column builders for archive text."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Voice transcripts whose recogniser fell back on subtitle credits.
BOILERPLATE = (r"(?iu)субтитры\s*(делал|сделал|создавал|подготовил|от)?|редактор\s+субтитров|корректор|dimatorzok|amara\.org"
               r"|продолжение\s+следует|подписывайтесь\s+на\s+канал|спасибо\s+за\s+просмотр|ставьте\s+лайки")
# Where the text of a message ends in an archive page.
TEXT_STOPS = ('<div class="kludges">', '<div class="pagination', '<div class="item">')
# Spellings that are corrected in prompt snippets.
TYPOS = {"ето": "это", "етому": "этому", "карашо": "хорошо", "довай": "давай", "лоол": "лол", "ниче": "ничего", "щас": "сейчас", "че": "чё"}


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


def unescape(c: Column | str) -> Column:
    """Entities decoded; values without '&' never reach Python."""
    c = as_col(c)
    return F.when(c.contains("&"), _unescape(c)).otherwise(c)


def trim_all(c: Column | str) -> Column:
    """Blanks, tabs and line ends off both sides."""
    return F.regexp_replace(as_col(c), r"(?U)^\s+|\s+$", "")


def clean_text(c: Column | str, keep_lines: bool = True) -> Column:
    """Tags become blanks, entities are decoded, NULs go, blanks are squeezed; line ends stay unless told otherwise."""
    t = F.regexp_replace(unescape(F.regexp_replace(as_col(c), r"<[^>]+>", " ")), "\\x00", "")
    return trim_all(F.regexp_replace(t, r"[ \t]+" if keep_lines else r"(?U)\s+", " "))


def message_text(body: Column | str) -> Column:
    """Text between a message's header and its attachments."""
    b = as_col(body)
    rest = F.when(b.contains("</div>"), F.regexp_replace(b, r"(?s)\A.*?</div>", "")).otherwise(b)
    for stop in TEXT_STOPS:
        rest = F.substring_index(rest, stop, 1)
    return clean_text(rest)


def collapse_repeats(c: Column | str) -> Column:
    """Five or more repeats of a unit of up to four characters become three; runs of digits, points, commas and blanks stay.

    Most texts have no such repeat; a plain test keeps them off the full pattern.
    """
    c = as_col(c)
    full = F.regexp_replace(c, r"(?U)(([\d.,\s]{1,4}?)\2{4,})|([^\n]{1,4}?)\3{4,}", "$1$3$3$3")
    return F.when(c.rlike(r"([^\n]{1,4}?)\1{4}"), full).otherwise(c)


def fmt_duration(c: Column | str) -> Column:
    """m:ss, fractions cut, null as 0."""
    s = F.coalesce(as_col(c).cast("int"), F.lit(0))
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def sanitize_filename(c: Column | str, longest: int = 50, default: str = "chat") -> Column:
    """Letters, digits, blanks, hyphens and underscores only; runs of underscores and blanks squeezed."""
    t = F.regexp_replace(as_col(c), r"(?U)[^\w \-]", "_")
    t = F.substring(trim_all(F.regexp_replace(F.regexp_replace(t, "_{2,}", "_"), " {2,}", " ")), 1, longest)
    return F.when(F.length(t) > 0, t).otherwise(F.lit(default))


def url_path(c: Column | str) -> Column:
    return F.split(as_col(c), "[?]")[0]


def media_file(c: Column | str) -> Column:
    """File name of a medium: the first 16 digits of its address' SHA-1 and the extension."""
    ext = F.regexp_extract(url_path(c), r"(\.[A-Za-z0-9]{1,5})$", 1)
    return F.concat(F.substring(F.sha1(as_col(c)), 1, 16), ext)


def attachment_kind(label: Column | str, url: Column | str) -> Column:
    """voice for recorded messages, photo for photographs, else other."""
    u = F.coalesce(as_col(url), F.lit(""))
    return F.when(u.contains("/amsg/") & F.lower(url_path(u)).endswith(".ogg"), "voice").when(as_col(label) == "Фотография", "photo").otherwise("other")


def peer_kind(peer: Column | str) -> Column:
    p = as_col(peer)
    return F.when(p >= 2_000_000_000, "chat").when(p < 0, "community").otherwise("user")


def is_boilerplate(c: Column | str) -> Column:
    return F.coalesce(as_col(c).rlike(BOILERPLATE), F.lit(False))


def words(c: Column | str) -> Column:
    """Lower-case runs of word characters."""
    return F.regexp_extract_all(F.lower(as_col(c)), F.lit(r"(?U)(\w+)"), 1)


def clean_snippet(c: Column | str) -> Column:
    """Pictographs and signs out, known misspellings corrected, punctuation after a word kept."""
    t = F.regexp_replace(as_col(c), r"(?U)[^\w\s.,!?—-]", " ")
    fix = F.create_map(*[F.lit(x) for kv in TYPOS.items() for x in kv])

    def one(w: Column) -> Column:
        core = F.regexp_replace(w, r"^[.,!?—-]+|[.,!?—-]+$", "")
        tail = F.substring(w, F.length(core) + F.lit(1), F.length(w))
        return F.when(F.length(core) == 0, w).otherwise(F.concat(F.coalesce(F.element_at(fix, F.lower(core)), core), tail))

    return F.array_join(F.transform(F.filter(F.split(t, r"(?U)\s+"), lambda w: F.length(w) > 0), one), " ")


def preview(c: Column | str, size: int = 400) -> Column:
    c = as_col(c)
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("…"))).otherwise(c)


def prompt_text(*parts: Column, size: int) -> Column:
    return F.substring(F.concat_ws(" ", *parts), 1, size)


def vocab_key(c: Column | str) -> Column:
    """Term before the first dash, trimmed, lower case."""
    return F.lower(trim_all(F.split(as_col(c), "[—–-]")[0]))
