"""Evaluation passages inside corpus documents, by the q-gram lemma.

Text is reduced to lower-case words (maximal runs of letters or digits, ё as е, soft hyphens and
zero-width spaces dropped) joined by one blank.  If a stretch of L characters of an item lies in a
document with at most ``budget`` edits, the two share at least L - q + 1 - q * budget q-grams whose
diagonals (position in the document minus position in the item) differ by at most ``budget``.  So:

1. the q-grams of all items form a sorted table that is shipped to every task (its size is checked;
   more items are worked off in blocks);
2. each document's q-grams are looked up in it, hits are sorted by diagonal and position, and runs of
   hits in overlapping bands of ``2 * width`` diagonals are counted;
3. bands that reach the bound are verified by an alignment restricted to the band's diagonals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from lorespark.session import Stage

#: A document or item word and what is absent between its letters.
WORD = re.compile(r"[^\W_]+")
ABSENT = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")
Q = 24
#: Shortest stretch looked for, in words.  In characters it is, for each item, the length of the shortest
#: stretch of so many consecutive words of that item, or the whole item if it has fewer.
MIN_WORDS = 13
BUDGET = 1
#: Items shipped to the tasks at once: a block has at most this many characters.
BLOCK_CHARS = 2_000_000


def normalise(text: str | None) -> str:
    return " ".join(WORD.findall(ABSENT.sub("", text or "").lower().replace("ё", "е")))


_MULT = np.uint64(0x9E3779B97F4A7C15)


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of every q-gram of a code point array."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(codes) - q + 1, np.uint64)
    for i in range(q):
        h = h * np.uint64(1_000_003) + codes[i: len(codes) - q + 1 + i]
    h *= _MULT
    return h ^ (h >> np.uint64(29))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def shortest(words: list[str], n: int = MIN_WORDS) -> int:
    """Characters of the shortest stretch of n consecutive words."""
    ends = np.cumsum([0] + [len(w) + 1 for w in words])
    return int((ends[n:] - ends[:-n]).min()) - 1 if len(words) > n else int(ends[-1]) - 1


class Index:
    """The q-grams of a block of items, sorted by hash, with a bitmap that turns most look-ups away."""

    BITS = 22

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.texts = [normalise(p) for _, p in items]
        self.chars = np.array([shortest(t.split()) for t in self.texts], np.int64)
        h, item, pos = [], [], []
        for n, t in enumerate(self.texts):
            g = grams(codes_of(t))
            h.append(g)
            item.append(np.full(len(g), n, np.int32))
            pos.append(np.arange(len(g), dtype=np.int32))
        h = np.concatenate(h) if h else np.zeros(0, np.uint64)
        o = np.argsort(h, kind="stable")
        self.hash = h[o]
        self.item = np.concatenate(item)[o] if item else np.zeros(0, np.int32)
        self.pos = np.concatenate(pos)[o] if pos else np.zeros(0, np.int32)
        self.bitmap = np.zeros(1 << self.BITS, bool)
        self.bitmap[(self.hash >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document position, item, item position) of every shared q-gram."""
        g = grams(codes)
        at = np.nonzero(self.bitmap[(g >> np.uint64(64 - self.BITS)).astype(np.int64)])[0]
        lo = np.searchsorted(self.hash, g[at])
        ok = lo < len(self.hash)
        at, lo = at[ok], lo[ok]
        ok = self.hash[lo] == g[at]
        at, lo = at[ok], lo[ok]
        n = np.searchsorted(self.hash, g[at], "right") - lo
        doc = np.repeat(at, n)
        k = np.repeat(lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return doc, self.item[k], self.pos[k]


def banded(a: str, b: str, band: int, limit: int) -> int:
    """Edit distance of two strings along diagonals within ``band`` of the corner's; limit + 1 if above the limit."""
    if abs(len(a) - len(b)) > band:
        return limit + 1
    prev = {j: j for j in range(0, min(len(b), band) + 1)}
    for i in range(1, len(a) + 1):
        cur = {}
        for j in range(max(0, i - band), min(len(b), i + band) + 1):
            best = prev.get(j, limit + 1) + 1
            if j:
                best = min(best, prev.get(j - 1, limit + 1) + (a[i - 1] != b[j - 1]), cur.get(j - 1, limit + 1) + 1)
            cur[j] = best
        prev = cur
        if min(cur.values()) > limit:
            return limit + 1
    return prev.get(len(b), limit + 1)


def longest_common_words(a: list[str], b: list[str]) -> int:
    """Words in the longest run that both lists have."""
    at: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        at.setdefault(w, []).append(j)
    best, prev = 0, {}
    for w in a:
        prev = {j: prev.get(j - 1, 0) + 1 for j in at.get(w, ())}
        best = max(best, *prev.values()) if prev else best
    return best


def regions(index: Index, texts: list[str], budget: int = BUDGET) -> list[tuple[int, int, int, int, int]]:
    """(number of the text, number of the item, first character in the text, characters, edits) of each
    verified region of normalised texts, which are looked up together."""
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    joined = "\0".join(texts)
    doc, item, pos = index.hits(codes_of(joined))
    bound = np.maximum(1, np.minimum(index.chars - Q + 1, index.chars - Q + 1 - Q * budget))
    group = (np.searchsorted(starts, doc, "right") - 1) * len(bound) + item
    # an item with fewer hits in a text than its bound has no region there
    n = np.bincount(group, minlength=len(texts) * len(bound))
    ok = n[group] >= bound[item]
    doc, item, pos, group = doc[ok], item[ok], pos[ok], group[ok]
    if len(doc) == 0:
        return []
    width = max(1, budget)
    diag = doc - pos.astype(np.int64)
    base = diag - diag.min()
    out: dict[tuple[int, int, int], tuple[int, int, int, int, int]] = {}
    for shift in (0, width):  # bands of 2 * width diagonals, each shifted by half: overlapping
        band = (base + shift) // (2 * width)
        o = np.lexsort((doc, band, group))
        gr, bd, dp, ip, it = group[o], band[o], doc[o], pos[o], item[o]
        # a run ends where two hits are further apart than budget edits explain
        new = np.ones(len(o), bool)
        new[1:] = (gr[1:] != gr[:-1]) | (bd[1:] != bd[:-1]) | (dp[1:] - dp[:-1] > Q * (budget + 1))
        start = np.nonzero(new)[0]
        end = np.append(start[1:], len(o))
        enough = end - start >= bound[it[start]]
        for s, e in zip(start[enough], end[enough], strict=True):
            at, first = np.unique(dp[s:e], return_index=True)  # repeated q-grams count once
            k, long = int(it[s]), int(index.chars[it[s]])
            # every stretch of the minimal length with enough q-grams, until one lies within the budget
            for w in np.nonzero(np.searchsorted(at, at + long - Q, "right") - np.arange(len(at)) >= bound[k])[0]:
                d0, i0 = int(at[w]), int(ip[s + first[w]])
                a, b = joined[d0: d0 + long], index.texts[k][i0: i0 + long]
                edits = 0 if a == b else banded(a, b, width, budget)
                if edits <= budget:
                    out[(int(gr[s]), d0, i0)] = (int(gr[s]) // len(bound), k, d0 - int(starts[int(gr[s]) // len(bound)]), int(at[-1]) + Q - d0, edits)
                    break
    return list(out.values())


def batched(texts: list[str], chars: int = 200_000) -> Iterator[tuple[int, int]]:
    """Slices of about so many characters."""
    lo, size = 0, 0
    for n, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield lo, n + 1
            lo, size = n + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def item_blocks(rows: Iterator) -> Iterator[list[tuple[int, str]]]:
    """(id, passage) rows in blocks of about ``BLOCK_CHARS`` characters."""
    block: list[tuple[int, str]] = []
    size = 0
    for i, p in rows:
        if size + len(p or "") > BLOCK_CHARS and block:
            yield block
            block, size = [], 0
        block.append((i, p or ""))
        size += len(p or "")
    if block:
        yield block


SCHEMA = "item_id long, doc_id long, chars long, edits long, words long"


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """(item_id, doc_id, chars, edits, words): every pair that shares a region, with its longest region,
    that region's edits, and the longest run of common words.

    Items come to the driver in blocks of bounded text (the held-out set is a stated query set); each block is
    compared with all documents and its result written before the next is read, so one block is held at a time.  Null or wordless texts share nothing; repeated rows of either
    side give the same pair once per row, so callers use distinct(); rows without id are left out.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "leaks")
    src = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text").where("doc_id is not null and text is not null")
    found = spark.createDataFrame([], SCHEMA)
    for block in item_blocks(items.select(item_id, passage).where(f"{item_id} is not null").toLocalIterator()):
        shared = spark.sparkContext.broadcast(Index(block))  # bounded by BLOCK_CHARS

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            words = [t.split() for t in index.texts]
            for b in batches:
                ids, texts = b.column(0).to_pylist(), [normalise(t) for t in b.column(1).to_pylist()]
                by: dict[tuple[int, int], tuple[int, int]] = {}
                for lo, hi in batched(texts):
                    for n, k, _, chars, edits in regions(index, texts[lo:hi]):
                        by[lo + n, k] = max(by.get((lo + n, k), (0, 0)), (chars, -edits))
                rows = [(index.ids[k], ids[n], chars, -edits, longest_common_words(texts[n].split(), words[k])) for (n, k), (chars, edits) in by.items()]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["item_id", "doc_id", "chars", "edits", "words"]).astype("int64"), preserve_index=False)

        found = found.unionByName(stage.cut(src.mapInArrow(find, SCHEMA)))
        shared.destroy()
    return found
