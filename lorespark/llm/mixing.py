"""Mixing sources to target weights.

Temperature mixing raises each source's share of the tokens to an exponent.  Two forms:

* without targets, weights are proportional to share**tau, and tau is bisected so that the weights have
  a given entropy, or is the largest change from the natural shares (the smallest tau) at which no source
  exceeds its repetition limit;
* with targets, weights are proportional to share * (target / share)**alpha: alpha 0 are the natural
  shares, 1 the targets.  alpha is bisected as the largest value at which no source exceeds its limit.  The
  source that binds there stays at its limit, and alpha is raised on for the others, until it is 1: every
  source that its limit does not hold back has its target share relative to the others of that kind.  The
  alpha at which each source bound is reported.

The weights are realised by budgeted block permutations: each full repetition of a source is a
permutation of its blocks (hash buckets of its records); the last, partial one takes blocks in permuted
order as long as the budget lasts.  The block where it ends is divided into blocks once more in the same
way, and of the last of those the records that still fit are taken.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.session import Stage

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern that the vocabulary file belongs to.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCKS = 1024
_BORDER = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")  # a blank between letters begins a pre-token
LONG = 100_000


def stretches(text: str) -> Iterator[str]:
    """The text in stretches of about ``LONG`` characters that end where a pre-token does, so that their tokens are the text's."""
    lo = 0
    while m := _BORDER.search(text, lo + LONG):
        yield text[lo: m.start()]
        lo = m.start()
    yield text[lo:]


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def count_tokens(docs: DataFrame, text: str, out: str = "n_tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns of docs other than text, and the tokens of the text; 0 for null."""
    with open(tokenizer, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, under 1 MB
    keep = [c for c in docs.columns if c != text]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks.value)
        for b in batches:
            n = [sum(len(enc.encode_ordinary(s)) for s in stretches(t)) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), pa.array(n, pa.int64())], [*keep, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    return docs.select(*keep, text).mapInArrow(count, f"{schema}, `{out}` long")


def entropy(w: dict) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def _bisect(good, lo: float, hi: float, rounds: int = 60) -> float:
    """The largest x in [lo, hi] with good(x), for a good that turns false once."""
    if good(hi):
        return hi
    for _ in range(rounds):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if good(mid) else (lo, mid)
    return lo


def _normal(w: dict) -> dict:
    total = sum(w.values())
    return {s: x / total for s, x in w.items()} if total else w


def temperature_weights(tokens: dict[str, int], target_entropy: float | None = None, max_repeats: dict[str, int] | None = None, budget: float | None = None) -> tuple[float, dict[str, float]]:
    """(tau, weights) of the form without targets.  tau 1 keeps the natural shares, 0 makes all equal."""
    p = _normal({s: t for s, t in tokens.items() if t > 0})
    at = lambda tau: _normal({s: x**tau for s, x in p.items()})
    if target_entropy is not None:  # entropy falls as tau grows
        tau = _bisect(lambda x: entropy(at(x)) >= target_entropy, 0.0, 64.0)
    else:
        size = budget or sum(tokens.values())
        fits = lambda x: all(size * w <= max_repeats[s] * tokens[s] * (1 + 1e-9) for s, w in at(x).items())
        tau = 1 - _bisect(lambda x: fits(1 - x), 0.0, 1.0)
    return tau, at(tau)


def target_weights(tokens: dict[str, int], targets: dict[str, float], max_repeats: dict[str, int], budget: float) -> tuple[dict[str, float], dict[str, float]]:
    """(tokens that each source gives, alpha up to which each followed its target), of the form with targets.  A source without tokens or target gives none."""
    room = {s: float(max_repeats.get(s, 1)) * tokens.get(s, 0) for s in targets}
    live = [s for s in targets if room[s] > 0 and targets[s] > 0]
    budget, given, reached, alpha = min(budget, sum(room[s] for s in live)), {s: 0.0 for s in targets}, {s: 0.0 for s in targets}, 0.0
    while live:
        p, q = _normal({s: tokens[s] for s in live}), _normal({s: targets[s] for s in live})
        left = budget - sum(given.values())
        at = lambda a, p=p, q=q: _normal({s: p[s] * (q[s] / p[s]) ** a for s in p})
        fits = lambda a, at=at, left=left: all(left * w <= room[s] * (1 + 1e-9) for s, w in at(a).items())
        alpha = max(alpha, _bisect(fits, alpha, 1.0) if fits(alpha) else alpha)
        w = at(alpha)
        if alpha == 1.0 and fits(1.0):
            return given | {s: left * x for s, x in w.items()}, reached | dict.fromkeys(live, 1.0)
        tight = max(live, key=lambda s: (left * w[s] / room[s], s))  # the one that binds at this alpha
        given[tight], reached[tight] = room[tight], alpha
        live.remove(tight)
    return given, reached


def _fill(blocks: list[tuple[int, int]], left: float, seed: int, turn: int) -> tuple[list[tuple[int, int]], tuple[int, int, int] | None, float]:
    """Blocks (number, tokens) in permuted order while the budget lasts: (number, place) of whole ones, the one it ends in with what is left, and that."""
    whole: list[tuple[int, int]] = []
    for place, (b, t) in enumerate(sorted(blocks, key=lambda x: hash_place(seed, turn, x[0]))):
        if t > left + 0.5:
            return whole, (b, place, int(left)), 0.0
        whole.append((b, place))
        left -= t
    return whole, None, left


def mix(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", budget: float | None = None,
        seed: int = 17, tokenizer: str = TOKENIZER, by: str = "targets") -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    mixture: one row per use of a record: (doc_id, source, pass, block, n_tokens); passes count from 0, block is
    the place of the record's block in that pass's permutation.  report: one row per source of ``targets``
    (source, target_share, max_repeats): the exponent, its tokens and records, tokens used, share reached, repeats.
    ``by``: "targets"; "entropy", the exponent at which the weights have the entropy of the targets, as far as
    limits allow; "limit", the smallest exponent at which no source exceeds its limit.
    The default budget is the tokens that the sources have.  Source names are compared trimmed and in lower
    case; records of other sources, of none, or without tokens stay out.  An empty table gives no mixture.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "mixing")
    goals = {r[0].strip().lower(): (r[1] or 0.0, r[2] if r[2] is not None else 1) for r in targets.select("source", "target_share", "max_repeats").collect() if r[0]}  # one row per source
    named = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.trim(F.col(source))).alias("source"), F.col(text).alias("text")).where(F.col("source").isin(*goals))
    slot = F.xxhash64("doc_id", "n_tokens", F.lit(seed))
    sized = stage.cut(count_tokens(named, "text", tokenizer=tokenizer).where("n_tokens > 0").withColumn("slot", slot)
                      .withColumn("bucket", F.pmod("slot", F.lit(BLOCKS)).cast("int")).withColumn("sub", F.pmod(F.shiftright("slot", 20), F.lit(BLOCKS)).cast("int")))
    blocks = sized.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()  # sources x BLOCKS
    tokens, records = {s: 0 for s in goals}, {s: 0 for s in goals}
    for s, _, t, n in blocks:
        tokens[s] += t
        records[s] += n
    limits, size = {s: g[1] for s, g in goals.items()}, float(budget if budget is not None else sum(tokens.values()))
    if by == "targets":
        given, exponent = target_weights(tokens, {s: g[0] for s, g in goals.items()}, limits, size)
    else:
        wanted = entropy(_normal({s: g[0] for s, g in goals.items() if tokens[s]})) if by == "entropy" else None
        tau, w = temperature_weights(tokens, wanted, limits, size)
        given = {s: min(size * w.get(s, 0.0), float(limits[s] * tokens[s])) for s in goals}
        exponent = dict.fromkeys(goals, tau)
    plan: list[tuple[str, int, int, int]] = []  # source, pass, bucket, place of whole blocks
    ends: list[tuple[str, int, int, int, int]] = []  # and with the tokens left, of the block where a source ends
    for s in goals:
        left, turn = given[s], 0
        own = [(b, t) for x, b, t, _ in blocks if x == s]
        while own and left >= 1:
            whole, end, left = _fill(own, left, seed, turn)
            plan += [(s, turn, b, place) for b, place in whole]
            ends += [(s, turn, *end)] if end else []
            turn += 1
    out = ["doc_id", "source", "pass", "block", "n_tokens"]
    mixture = sized.join(F.broadcast(spark.createDataFrame(plan, "source string, pass int, bucket int, block int")), ["source", "bucket"]).select(*out)  # at most sources x BLOCKS x repeats rows
    edge = sized.join(F.broadcast(spark.createDataFrame(ends, "source string, pass int, bucket int, block int, left long")), ["source", "bucket"])  # one row per source
    subs: dict[tuple, list[tuple[int, int]]] = {}
    for *k, sub, t in edge.groupBy("source", "pass", "block", "left", "sub").agg(F.sum("n_tokens")).collect():  # sources x BLOCKS
        subs.setdefault(tuple(k), []).append((sub, t))
    parts: list[tuple[str, int, int]] = []
    for (s, turn, _, left), own in subs.items():
        whole, end, _ = _fill(own, left, seed + 1, turn)
        parts += [(s, sub, -1) for sub, _ in whole] + ([(s, end[0], end[2])] if end else [])
    few = edge.join(F.broadcast(spark.createDataFrame(parts, "source string, sub int, allowed long")), ["source", "sub"])
    run = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("slot", "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # a millionth of a source
    last = few.where("allowed >= 0").withColumn("run", run).where("run <= allowed").select(*out)
    mixture = mixture.unionByName(few.where("allowed < 0").select(*out)).unionByName(last)
    used = {r[0]: (r[1], r[2]) for r in mixture.groupBy("source").agg(F.sum("n_tokens"), F.count("*")).collect()}
    total = sum(t for t, _ in used.values())
    rows = [(s, float(g[0]), (used.get(s, (0, 0))[0] / total) if total else 0.0, float(exponent[s]), int(g[1]), tokens[s], records[s], used.get(s, (0, 0))[0], used.get(s, (0, 0))[1],
             used.get(s, (0, 0))[0] / tokens[s] if tokens[s] else 0.0) for s, g in goals.items()]
    report = spark.createDataFrame(rows, "source string, target_share double, share double, exponent double, max_repeats int, tokens long, records long, tokens_used long, records_used long, repeats double")
    return mixture, report


def hash_place(seed: int, turn: int, bucket: int) -> int:
    """A pseudo-random place of a block in the permutation of one pass."""
    x = (seed * 1_000_003 + turn) * 1_000_003 + bucket
    x = (x ^ (x >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF
    x = (x ^ (x >> 12)) * 0x297A2D39 & 0xFFFFFFFF
    return x ^ (x >> 15)
