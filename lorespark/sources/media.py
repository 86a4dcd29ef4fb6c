"""Media fetched and analysed through providers, in parallel over partitions."""

from __future__ import annotations

import hashlib
import json
import struct
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lorespark.providers import retried


class Reply(NamedTuple):
    status: int
    body: bytes
    headers: dict[str, str]


Fetch = Callable[[str], Reply]
RESULT = "url string, status string, error string, bytes int, sha256 string, content_type string, headers string, content binary"


def judge(url: str, fetch: Fetch, tries: int = 3, sleep: Callable = time.sleep) -> tuple:
    """ok, html_stub, http_error (4xx at once, 5xx after all tries) or net_error, to which an empty reply leads after all tries; back-off between tries."""
    class Retry(Exception):
        pass

    def once() -> Reply:
        r = fetch(url)
        if r.status >= 500:
            raise Retry(f"HTTP {r.status}")
        if r.status < 400 and not r.body:
            raise ValueError("empty reply")
        return r

    try:
        r = retried(once, tries, 2.0, sleep)
    except Retry as e:
        return url, "http_error", str(e), None, None, None, None, None
    except Exception as e:  # noqa: BLE001
        return url, "net_error", str(e)[:200], None, None, None, None, None
    if r.status >= 400:
        return url, "http_error", f"HTTP {r.status}", None, None, None, None, None
    if r.body.lstrip()[:1] == b"<":
        return url, "html_stub", "a page instead of a medium", len(r.body), None, r.headers.get("Content-Type"), None, None
    kept = {k: v for k, v in r.headers.items() if k in ("Content-Type", "Last-Modified", "ETag")}
    return url, "ok", None, len(r.body), hashlib.sha256(r.body).hexdigest(), r.headers.get("Content-Type"), json.dumps(kept), r.body


def fetch_all(urls: DataFrame, fetch: Fetch, sleep: Callable = time.sleep) -> DataFrame:
    """One result per row of ``url``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([judge(u, fetch, sleep=sleep) for u in pdf.url], columns=[c.split()[0] for c in RESULT.split(", ")])

    return urls.select("url").mapInPandas(run, RESULT)


def analyse_all(fetched: DataFrame, analyse: Callable[[bytes], dict], min_label: float = 0.25, labels: int = 12) -> DataFrame:
    """OCR lines joined, their mean confidence, the surest labels, faces; an image that cannot be read gets status unreadable."""
    out = "url string, status string, ocr_text string, ocr_conf double, labels string, n_faces int"

    def one(url: str, status: str, content) -> tuple:
        if status != "ok":
            return url, status, None, None, None, None
        try:
            a = analyse(bytes(content))
            conf = [c for _, c in a["lines"]]
            best = sorted((x for x in a["labels"] if x["conf"] > min_label), key=lambda x: -x["conf"])[:labels]
            return url, "ok", "\n".join(t for t, _ in a["lines"]), round(sum(conf) / len(conf), 3) if conf else None, json.dumps(best), a["n_faces"]
        except Exception:  # noqa: BLE001
            return url, "unreadable", None, None, None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([one(u, s, c) for u, s, c in zip(pdf.url, pdf.status, pdf.content, strict=True)], columns=[c.split()[0] for c in out.split(", ")])

    return fetched.mapInPandas(run, out)


def url_size(df: DataFrame, url: str = "url") -> DataFrame:
    w, h = F.regexp_extract(url, r"size=(\d+)x(\d+)", 1), F.regexp_extract(url, r"size=(\d+)x(\d+)", 2)
    return df.withColumn("url_size", F.when(w != "", F.concat_ws("x", w, h)))


def dimensions(content: bytes | None) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG, GIF, BMP or JPEG image; None for anything else."""
    b = bytes(content or b"")
    if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
        return struct.unpack(">II", b[16:24])
    if b[:6] in (b"GIF87a", b"GIF89a") and len(b) >= 10:
        return struct.unpack("<HH", b[6:10])
    if b[:2] == b"BM" and len(b) >= 26:
        w, h = struct.unpack("<ii", b[18:26])
        return w, abs(h)
    at = 2
    while b[:2] == b"\xff\xd8" and at + 9 <= len(b):
        if b[at] != 0xFF:
            return None
        if 0xC0 <= b[at + 1] <= 0xCF and b[at + 1] not in (0xC4, 0xC8, 0xCC):  # a frame's header
            h, w = struct.unpack(">HH", b[at + 5: at + 9])
            return w, h
        at += 2 if b[at + 1] == 0xFF or 0xD0 <= b[at + 1] <= 0xD8 else 2 + struct.unpack(">H", b[at + 2: at + 4])[0]
    return None


@F.pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def image_size(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([dimensions(c) or (None, None) for c in content], columns=["width", "height"]).astype("Int32")


def pending_photos(attachments: DataFrame, photos: DataFrame, messages: DataFrame, dialogs: DataFrame, kind: str | None = None, peers: list[int] | None = None, least_own: float | None = None, limit: int | None = None) -> DataFrame:
    """(attachment_id, message_id, peer_id, url, sent_at) of photos with an address that have no result, or only a network error, oldest first.

    ``kind``, ``peers`` and ``least_own`` (share of own messages) choose dialogs; undated photos come last.
    """
    a = attachments.where("kind = 'photo' and url is not null").select(F.col("id").alias("attachment_id"), "message_id", "url")
    todo = a.join(photos.where("status <> 'net_error'").select("attachment_id"), "attachment_id", "left_anti")
    d = dialogs.select("peer_id", F.col("kind").alias("__kind"), "own_share")
    if kind is not None:
        d = d.where(F.col("__kind") == kind)
    if peers:
        d = d.where(F.col("peer_id").isin(*[int(p) for p in peers]))
    if least_own is not None:
        d = d.where(F.col("own_share") >= least_own)
    m = messages.select(F.col("id").alias("message_id"), "peer_id", "sent_at")
    out = todo.join(m, "message_id").join(d.select("peer_id"), "peer_id").select("attachment_id", "message_id", "peer_id", "url", "sent_at")
    out = out.orderBy(F.asc_nulls_last("sent_at"), "attachment_id")
    return out.limit(limit) if limit else out
