"""External models behind replaceable interfaces, each with a deterministic default that needs no network."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Embedder(Protocol):
    dim: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Scorer(Protocol):
    def scores(self, query: str, docs: Sequence[str]) -> list[float]: ...


class Transcriber(Protocol):
    def transcribe(self, audio: bytes, prompt: str) -> dict: ...  # text, duration_s


class ImageAnalyzer(Protocol):
    def analyse(self, image: bytes) -> dict: ...  # lines [(text, confidence)], labels [{id, conf}], n_faces


class SilentTranscriber:
    """No text, the length that the audio states: keeps the pipeline whole where there is no recogniser."""

    def transcribe(self, audio: bytes, prompt: str) -> dict:
        at = audio.rfind(b"OggS")
        seconds = int.from_bytes(audio[at + 6: at + 14], "little", signed=True) / 48000 if at >= 0 and at + 14 <= len(audio) else 0.0
        return {"text": "", "duration_s": seconds}


class PlainAnalyzer:
    """Takes the bytes for text, one line each; an image that is no text is unreadable."""

    def analyse(self, image: bytes) -> dict:
        return {"lines": [(x, 1.0) for x in image.decode("utf-8").splitlines() if x], "labels": [], "n_faces": 0}


class HashEmbedder:
    """Hashed words, L2-normalised."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in re.findall(r"\w+", t.lower()) or [""]:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            v[0] += 1e-3 if not any(v) else 0.0
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v])
        return out


class OverlapScorer:
    """Share of the query's words that the document has."""

    def scores(self, query: str, docs: Sequence[str]) -> list[float]:
        q = set(re.findall(r"\w+", query.lower()))
        return [len(q & set(re.findall(r"\w+", d.lower()))) / max(1, len(q)) for d in docs]


def retried(call: Callable, tries: int = 3, pause: float = 2.0, sleep: Callable = time.sleep):
    """The call's result; linear back-off between tries; the last error if all fail."""
    for k in range(1, tries + 1):
        try:
            return call()
        except Exception:
            if k == tries:
                raise
            sleep(pause * k)


def checked_vectors(vectors: list[list[float]], n: int, dim: int) -> list[list[float]]:
    if len(vectors) != n:
        raise ValueError(f"{len(vectors)} vectors for {n} texts")
    for v in vectors:
        if len(v) != dim or not all(map(math.isfinite, v)) or not any(v):
            raise ValueError(f"a vector must have {dim} finite values, not all zero")
    return vectors


def checked_scores(scores: list[float], n: int) -> list[float]:
    if len(scores) != n or not all(map(math.isfinite, scores)):
        raise ValueError("scores must be finite and one per document")
    return scores


def embed_column(df: DataFrame, text: str, out: str, embedder: Embedder, batch: int = 16) -> DataFrame:
    """The rows with an embedding column, in batches of the service's size."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vecs: list[list[float]] = []
            for k in range(0, len(pdf), batch):
                texts = [t or "" for t in pdf[text].iloc[k: k + batch]]
                vecs += checked_vectors(retried(lambda texts=texts: embedder.embed(texts)), len(texts), embedder.dim)
            yield pdf.assign(**{out: vecs})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` array<float>"
    return df.mapInPandas(run, schema)
