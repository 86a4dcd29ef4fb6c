"""Most similar vectors for every vector: cells fitted to the data, exact comparison in the cells that a query probes.

1. Exact copies of a vector are folded into one representative, so a mass of copies costs nothing.
2. A bounded sample fits the cells.
3. Every vector has one home cell.  All vectors are counted; cells of more than twice ``cell_rows`` are
   divided by leaves that are fitted per cell, in parallel, so the tree grows with the data and with
   its dense spots.
4. ``CALIBRATION`` vectors are compared exactly with all others.  From their true neighbours comes the
   number of cells that a query has to probe for ``recall``.  It is no constant, so it holds as cells
   grow in number.
5. Near cells form groups.  Every vector is sent as a query to each group of the cells it probes, once, and
   compared with the members of these cells by products of matrices.
6. A group is searched in blocks of members and of queries, each pair of blocks a task.
   The lists of a query's groups are merged to its k best.

Score-aware codes of four bits for two dimensions (``fit_books``, ``encode``, ``decode``: codebooks that minimise
|e|^2 + (eta - 1) (e . x)^2, which weighs the part of the residual e that is parallel to the vector x by eta) are not
part of the search.  Their scores need a margin that lets hundreds of members a query through to be compared exactly
after all, which takes several times as long as exact products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.session import Stage

#: Rows that the cells and the codebooks are fitted on, at most.
SAMPLE_ROWS = 32768
CODEBOOK_ROWS = 8192
#: Rows of one divided cell that its leaves are fitted on, at most.
LEAF_ROWS = 65536
#: Vectors compared with all others to set the probes.
CALIBRATION = 512


def matrix(col: pa.ChunkedArray | pa.Array, dtype=np.float32) -> np.ndarray:
    """Rows of a binary column of one width as a matrix."""
    parts = col.chunks if isinstance(col, pa.ChunkedArray) else [col]
    rows = []
    for a in parts:
        if len(a):
            off = np.frombuffer(a.buffers()[1], np.int64 if pa.types.is_large_binary(a.type) else np.int32)[a.offset: a.offset + len(a) + 1]
            rows.append(np.frombuffer(a.buffers()[2], np.uint8)[off[0]: off[-1]].copy().view(dtype).reshape(len(a), -1))
    return np.concatenate(rows) if rows else np.zeros((0, 0), dtype)


def binary(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m)
    width = m.shape[1] * m.itemsize
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer((np.arange(len(m) + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(m.tobytes())])


def unit(x: np.ndarray, dtype=np.float64) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(dtype)


def _packer(dim: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            keep = np.asarray(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(lists), dim), False)) & np.asarray(b.column(0).is_valid())
            ids, lists = b.column(0).filter(pa.array(keep)), lists.filter(pa.array(keep))
            x = lists.flatten().cast(pa.float32()).to_numpy(zero_copy_only=False).reshape(-1, dim)
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(ok)), binary(x[ok] + np.float32(0))], ["id", "vec"])
    return pack


def packed(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, vec): the sound vectors as bytes."""
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).mapInArrow(_packer(dim), "id long, vec binary")


def kmeans(x: np.ndarray, k: int, iters: int, rng: np.random.Generator, spherical: bool) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(iters):
        a = np.concatenate([(x[lo: lo + 4096] @ c.T - (0 if spherical else 0.5 * (c * c).sum(1))).argmax(1) for lo in range(0, len(x), 4096)])
        n = np.bincount(a, minlength=k)
        for d in range(x.shape[1]):
            s = np.bincount(a, x[:, d], k)
            c[:, d] = np.where(n > 0, s / np.maximum(n, 1), c[:, d])
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _best(scores: np.ndarray, w: int) -> np.ndarray:
    return np.argpartition(-scores, w - 1, axis=1)[:, :w] if w < scores.shape[1] else np.tile(np.arange(scores.shape[1]), (len(scores), 1))


@dataclass
class Model:
    coarse: np.ndarray  # [c, d]
    leaves: np.ndarray  # [l, d], ordered by coarse cell
    starts: np.ndarray  # [c + 1], the leaves of each coarse cell
    books: np.ndarray  # [m, 16, 2]
    eta: float

    def cells(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` nearest leaves of every row, nearest first, -1 where there are fewer.

        Leaves are looked for in the nearest coarse cells: twice as many as probes and six more.
        """
        n, c = len(x), len(self.coarse)
        if len(self.leaves) == c:
            z = x @ self.leaves.T
            at = _best(z, min(probes, c))
            at = np.take_along_axis(at, np.lexsort((at, -np.take_along_axis(z, at, 1)), axis=1), 1)
            return np.pad(at.astype(np.int32), ((0, 0), (0, probes - at.shape[1])), constant_values=-1)
        top = _best(x @ self.coarse.T, min(2 * probes + 6, c))
        rows, leaf, sims = [], [], []
        for k in np.unique(top):
            r = np.nonzero((top == k).any(1))[0]
            lo, hi = self.starts[k], self.starts[k + 1]
            if lo == hi:
                continue
            z = x[r] @ self.leaves[lo:hi].T
            best = _best(z, min(probes, hi - lo))
            rows.append(np.repeat(r, best.shape[1]))
            leaf.append((best + lo).ravel())
            sims.append(np.take_along_axis(z, best, 1).ravel())
        out = np.full((n, probes), -1, np.int32)
        if rows:
            rows, leaf, sims = np.concatenate(rows), np.concatenate(leaf), np.concatenate(sims)
            o = np.lexsort((leaf, -sims, rows))
            rows, leaf = rows[o], leaf[o]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            keep = rank < probes
            out[rows[keep], rank[keep]] = leaf[keep]
        return out

    def encode(self, x: np.ndarray, leaf: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Four-bit codes by coordinate descent on the anisotropic loss."""
        m, n = len(self.books), len(x)
        xs, r = _halves(x, m), _halves(x - self.leaves[leaf], m)
        codes, par, row = np.zeros((n, m), np.uint8), np.zeros(n, np.float32), np.arange(n)
        size, along = [], []  # of the error, and of its part along x, for each of the 16 words
        for j in range(m):
            b = self.books[j]
            size.append((b * b).sum(1) - 2 * r[:, j] @ b.T)
            along.append((xs[:, j] * r[:, j]).sum(1, keepdims=True) - xs[:, j] @ b.T)
            codes[:, j] = size[j].argmin(1)
            par += along[j][row, codes[:, j]]
        for _ in range(sweeps):
            for j in range(m):
                p = (par - along[j][row, codes[:, j]])[:, None] + along[j]
                best = (size[j] + (self.eta - 1) * p * p).argmin(1)
                par = p[row, best]
                codes[:, j] = best
        return codes

    def decode(self, codes: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        d = self.leaves.shape[1]
        return self.leaves[leaf] + np.concatenate([self.books[j][codes[:, j]] for j in range(len(self.books))], 1)[:, :d]


def _halves(x: np.ndarray, m: int) -> np.ndarray:
    if x.shape[1] < 2 * m:
        x = np.pad(x, ((0, 0), (0, 2 * m - x.shape[1])))
    return x.reshape(len(x), m, 2)


def fit_cells(x: np.ndarray, n_total: int, cell_rows: int, seed: int = 7) -> np.ndarray:
    k = max(1, min(math.ceil(n_total / cell_rows), len(x) // 16))
    return kmeans(x, k, 10, np.random.default_rng(seed), True).astype(np.float32)


def fit_books(x: np.ndarray, model: Model, seed: int = 7) -> None:
    """Codebooks of the residuals to the leaves, from a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))[:CODEBOOK_ROWS]]
    m, eta, leaf = len(model.books), model.eta, model.cells(x, 1)[:, 0]
    xs, r = _halves(x, m), _halves(x - model.leaves[leaf], m)
    for j in range(m):
        c = kmeans(r[:, j], min(16, len(x)), 8, rng, False)
        model.books[j] = np.concatenate([c, np.repeat(c[-1:], 16 - len(c), 0)])
    for _ in range(3):  # alternate codes and weighted least squares
        codes = model.encode(x, leaf, 1)
        e = r - np.stack([model.books[j][codes[:, j]] for j in range(m)], 1)
        par = (e * xs).sum((1, 2))
        for j in range(m):
            rest = par - (e[:, j] * xs[:, j]).sum(1)
            for k16 in range(16):
                w = codes[:, j] == k16
                if not w.any():
                    continue
                a, b = xs[w, j], r[w, j]
                lhs = w.sum() * np.eye(2) + (eta - 1) * a.T @ a
                rhs = b.sum(0) + (eta - 1) * (a * (rest[w] + (a * b).sum(1))[:, None]).sum(0)
                model.books[j, k16] = np.linalg.solve(lhs, rhs)
            e[:, j] = r[:, j] - model.books[j][codes[:, j]]
            par = rest + (e[:, j] * xs[:, j]).sum(1)


def new_model(coarse: np.ndarray, leaves: np.ndarray | None = None, starts: np.ndarray | None = None, threshold: float = 0.2) -> Model:
    """A model without codebooks yet.  eta follows from the score threshold."""
    d = coarse.shape[1]
    leaves = coarse if leaves is None else leaves
    starts = np.arange(len(coarse) + 1) if starts is None else starts
    return Model(coarse, leaves, starts, np.zeros(((d + 1) // 2, 16, 2), np.float32), max(1.0, (d - 1) * threshold**2 / (1 - threshold**2)))


def _hits(scores: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of all scores of at least the row's bound, in order; the width is a multiple of eight, so that eight are looked at at once."""
    width = scores.shape[1]
    mask = (scores >= least[:, None]).ravel()
    eight = np.flatnonzero(mask.view(np.uint64))
    at = (eight[:, None] * 8 + np.arange(8)).ravel()
    return np.divmod(at[mask[at]], width)


def scan(model: Model, q: np.ndarray, q_ids: np.ndarray, probed: np.ndarray, x: np.ndarray, ids: np.ndarray, home: np.ndarray, k: int, at_once: int = 256, piece: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of x in the ``probed`` leaves of every row of q.  id -1 where there are fewer.

    Products of matrices, a block of queries by a piece of a leaf, in single precision; what may reach the k-th best is
    compared in double.
    """
    order = np.argsort(home, kind="stable")
    x, ids, home = x[order], ids[order], home[order]
    here, first = np.unique(home, return_index=True)
    ends = np.append(first[1:], len(home))
    leaves, x32 = model.leaves[here], np.concatenate([x.astype(np.float32), np.zeros((8, x.shape[1]), np.float32)])
    out_id, out_s = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -np.inf)
    scores = np.empty(at_once * piece, np.float32)
    # queries of one nearest leaf go together and begin there, so that their bounds are high at once
    starts = np.concatenate([(q[lo: lo + 8192].astype(np.float32) @ leaves.T).argmax(1) for lo in range(0, len(q), 8192)])
    in_turn = np.argsort(starts, kind="stable")
    for lo_q in range(0, len(q), at_once):
        s = in_turn[lo_q: lo_q + at_once]
        q64, own, want = q[s], q_ids[s], probed[s]
        q32, best_s, best_id = q64.astype(np.float32), out_s[s], out_id[s]
        for at in np.argsort(-leaves @ leaves[starts[s[len(s) // 2]]], kind="stable"):
            rows = np.nonzero((want == here[at]).any(1))[0]
            for lo in range(first[at], ends[at], piece) if len(rows) else ():
                hi = min(lo + piece, ends[at])
                width = hi - lo + 7 & ~7
                z = scores[: len(rows) * width].reshape(len(rows), width)
                np.matmul(q32[rows], x32[lo: lo + width].T, out=z)
                z[:, hi - lo:] = -np.inf
                least = np.maximum(best_s[rows, -1], -2) - 1e-5
                fresh = np.nonzero(np.isneginf(best_s[rows, -1]))[0]
                if len(fresh) and hi - lo > k:  # no bound yet: the piece's own, the query itself left out
                    least[fresh] = np.partition(z[fresh], width - k - 1, axis=1)[:, width - k - 1] - 1e-5
                r, c = _hits(z, least.astype(np.float32))
                c += lo
                r, other = rows[r], own[rows[r]] != ids[c]
                r, c = r[other], c[other]
                s_ = np.concatenate([np.einsum("pd,pd->p", q64[r[a: a + 65536]], x[c[a: a + 65536]]) for a in range(0, max(1, len(r)), 65536)])
                high = s_ >= best_s[r, -1]
                r, c, s_ = r[high], c[high], s_[high]
                if not len(r):
                    continue
                changed = np.unique(r)
                rr, ii, ss = np.concatenate([r, np.repeat(changed, k)]), np.concatenate([ids[c], best_id[changed].ravel()]), np.concatenate([s_, best_s[changed].ravel()])
                o = np.lexsort((ii, -ss, rr))
                rr = rr[o]
                o = o[np.arange(len(rr)) - np.searchsorted(rr, rr) < k]
                best_id[changed], best_s[changed] = ii[o].reshape(-1, k), ss[o].reshape(-1, k)
        out_id[s], out_s[s] = best_id, best_s
    return out_id, out_s


def groups(model: Model, counted: np.ndarray, most: int) -> np.ndarray:
    """Per leaf the group it is searched with: near leaves of together at most ``most`` rows, or one larger leaf.

    Near leaves are probed by the same queries, and a query is sent to a group once, however many leaves of it it probes.
    """
    out, n, todo = np.zeros(len(model.leaves), np.int64), 0, [np.arange(len(model.leaves))]
    while todo:
        part = todo.pop()
        if len(part) == 1 or counted[part].sum() <= most:
            out[part] = n
            n += 1
            continue
        c = kmeans(model.leaves[part], 2, 10, np.random.default_rng(len(part)), True)
        z = model.leaves[part] @ (c[0] - c[1])
        side = z > 0
        if side.all() or not side.any():
            side = np.argsort(np.argsort(z, kind="stable")) < len(part) // 2
        todo += [part[side], part[~side]]
    return out


def exact_nearest(sound: DataFrame, queries: pa.Table, k: int) -> DataFrame:
    """(id, neighbour, similarity, vec): the exact k most similar of all sound vectors to each of a bounded set of queries (id, vec).

    The queries are broadcast; every partition keeps their k best and the lists are merged.
    """
    shared = sound.sparkSession.sparkContext.broadcast((queries.column("id").to_numpy(), unit(matrix(queries.column("vec")))))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        q32 = q.astype(np.float32)
        keep_s, keep_i, keep_v = np.full((len(q), k), -9.0), np.full((len(q), k), -1, np.int64), None
        for b in batches:
            raw_ids, raw = b.column(0).to_numpy(), matrix(b.column(1))
            for lo in range(0, len(raw_ids), 4096):
                ids, v = raw_ids[lo: lo + 4096], raw[lo: lo + 4096]
                x = unit(v)
                if keep_v is None:
                    keep_v = np.zeros((len(q), k, v.shape[1]), np.float32)
                s = q32 @ x.astype(np.float32).T
                s[q_ids[:, None] == ids[None, :]] = -9
                r, c = np.nonzero(s >= (keep_s[:, -1] - 1e-5)[:, None].astype(np.float32))
                if len(r) > len(q) * k:  # far more than can stay: only each query's best
                    cut = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k), None] - np.float32(1e-5)
                    r, c = np.nonzero((s >= cut) & (s > -9))
                exact = np.einsum("pd,pd->p", q[r], x[c])
                rr = np.concatenate([r, np.repeat(np.arange(len(q)), k)])
                ii, ss = np.concatenate([ids[c], keep_i.ravel()]), np.concatenate([exact, keep_s.ravel()])
                vv = np.concatenate([v[c], keep_v.reshape(-1, v.shape[1])])
                o = np.lexsort((ii, -ss, rr))
                rank = np.arange(len(rr)) - np.searchsorted(rr[o], rr[o])
                o = o[rank < k]
                keep_i, keep_s, keep_v = ii[o].reshape(-1, k), ss[o].reshape(-1, k), vv[o].reshape(len(q), k, -1)
        if keep_v is not None:
            r, c = np.nonzero(keep_s > -9)
            for lo in range(0, len(r), 10000):
                a, b2 = r[lo: lo + 10000], c[lo: lo + 10000]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[a]), pa.array(keep_i[a, b2]), pa.array(keep_s[a, b2]), binary(keep_v[a, b2])], ["id", "neighbour", "similarity", "vec"])

    top = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return sound.mapInArrow(best, "id long, neighbour long, similarity double, vec binary").withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).drop("r")


def calibrate(model: Model, reps: DataFrame, queries: pa.Table, k: int, recall: float) -> int:
    """The number of cells to probe, from the true neighbours of the queries."""
    true = exact_nearest(reps, queries, k).toArrow()  # CALIBRATION x k rows
    if not true.num_rows:
        return 1
    at = {i: p for p, i in enumerate(queries.column("id").to_pylist())}
    q = unit(matrix(queries.column("vec")), np.float32)[[at[i] for i in true.column("id").to_pylist()]]
    home = model.cells(unit(matrix(true.column("vec")), np.float32), 1)[:, 0]
    probes = 1
    while probes < len(model.leaves):
        if (model.cells(q, probes) == home[:, None]).any(1).mean() >= recall:
            break
        probes += 1 if probes < 16 else probes // 8
    return min(probes, len(model.leaves))


def nearest(vectors: DataFrame, id_col: str, vec_col: str, dim: int = 64, k: int = 10, recall: float = 0.99, cell_rows: int = 6000,
            max_cell: int = 16384, sample_rows: int = SAMPLE_ROWS, exact: bool = False) -> DataFrame:
    """(id, neighbour, similarity): the k most similar other vectors of every sound vector, by cosine.

    A vector is sound if it is not null, has ``dim`` finite values and is not all zero; others, and rows
    without id, take no part.  Ties go to the smaller id; copies of a vector are neighbours of one another
    at similarity 1.  Fewer than k other vectors give fewer rows; an empty table gives none.  ``recall`` is
    the share of true neighbours that the probed cells must hold; ``exact`` probes all cells.
    """
    spark = vectors.sparkSession
    stage = Stage(spark, "ann")
    empty = "id long, neighbour long, similarity double"
    sound = packed(vectors, id_col, vec_col, dim)
    rn = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    firsts = stage.cut(sound.withColumn("rn", rn).where(F.col("rn") <= k + 1)
                       .withColumn("rep", F.min("id").over(Window.partitionBy("vec"))))
    reps = firsts.where("rn = 1").select("id", "vec")
    n, copies = firsts.agg(F.count_if(F.col("rn") == 1), F.count_if(F.col("rn") > 1)).first()
    if n == 0:
        return spark.createDataFrame([], empty)

    def drawn(rows: int, salt: int) -> pa.Table:
        """About ``rows`` of the representatives, by a hash of the vector."""
        by = reps.where(F.pmod(F.xxhash64("vec", F.lit(salt)), F.lit(1 << 30)) <= int(min(1.0, rows / n) * (1 << 30)))
        got = by.toArrow().sort_by("id")
        return got if got.num_rows else reps.orderBy("id").limit(rows).toArrow()

    sample = unit(matrix(drawn(sample_rows, 0).column("vec")), np.float32)
    model = new_model(fit_cells(sample, n, cell_rows))
    counted = _count(reps, model)
    if (counted > 2 * cell_rows).any():
        model = _divide(reps, model, counted, cell_rows)
        counted = _count(reps, model)
    probes = len(model.leaves) if exact else calibrate(model, reps, drawn(CALIBRATION, 1), k, recall)
    shared = spark.sparkContext.broadcast(model)  # the leaves grow as n / cell_rows: 256 bytes each, 43 MB at a billion vectors
    block = min(4 * max_cell, max(max_cell, n // 16))  # larger for more rows: the copies of rows in blocks shrink as blocks grow
    group = groups(model, counted, block)
    base_blocks = np.maximum(1, np.ceil(np.bincount(group, counted) / block)).astype(np.int64)
    asked = _count(reps, model, probes, group)
    query_blocks = np.maximum(1, np.ceil(asked / block)).astype(np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every vector as a member of a block of the group of its home cell, and as a query of a block of each group of the cells it probes."""
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), matrix(b.column(1))
            c = shared.value.cells(unit(x, np.float32), probes)
            mix = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            out = []
            for query in (False, True):
                row, part = _probed(c, group) if query else (np.arange(len(ids)), group[c[:, 0]])
                mine, others = (query_blocks, base_blocks) if query else (base_blocks, query_blocks)
                times = others[part]
                r, p = np.repeat(row, times), np.repeat(part, times)
                own = (mix[row] // (1 if query else 7) % mine[part]).repeat(times)
                other = np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times)
                out.append((r, p, own if query else other, other if query else own, np.full(len(r), query)))
            r, p, qb, bb, role = (np.concatenate(z) for z in zip(*out, strict=True))
            for lo in range(0, len(r), 20000):
                s = slice(lo, lo + 20000)
                yield pa.RecordBatch.from_arrays([pa.array(p[s].astype(np.int32)), pa.array(qb[s].astype(np.int32)), pa.array(bb[s].astype(np.int32)), pa.array(role[s]), pa.array(ids[r[s]]), binary(x[r[s]])],
                                                 ["part", "qb", "bb", "query", "id", "vec"])

    def search(t: pa.Table) -> pa.Table:
        query, ids, x = t.column("query").to_numpy(), t.column("id").to_numpy(), unit(matrix(t.column("vec")))
        if query.all() or not query.any():
            return pa.table({"id": ids[:0], "ids": binary(np.zeros((0, k), np.int64)), "sims": binary(np.zeros((0, k)))})

        def cells(rows: np.ndarray, probes: int) -> np.ndarray:
            return np.concatenate([shared.value.cells(rows[lo: lo + 10000].astype(np.float32), probes) for lo in range(0, len(rows), 10000)])

        q, members = x[query], x[~query]
        nid, s = scan(shared.value, q, ids[query], cells(q, probes), members, ids[~query], cells(members, 1)[:, 0], k)
        return pa.table({"id": ids[query], "ids": binary(nid), "sims": binary(s)})

    parts = (reps.mapInArrow(spread, "part int, qb int, bb int, query boolean, id long, vec binary")
             .groupBy("part", "qb", "bb").applyInArrow(search, "id long, ids binary, sims binary"))

    def merge(t: pa.Table) -> pa.Table:
        nid, s = matrix(t.column("ids"), np.int64), matrix(t.column("sims"), np.float64)
        own = np.repeat(t.column("id").to_numpy(), nid.shape[1])
        nid, s = nid.ravel(), s.ravel()
        ok = nid >= 0
        own, nid, s = own[ok], nid[ok], s[ok]
        o = np.lexsort((nid, -s, own))
        own, nid, s = own[o], nid[o], s[o]
        keep = np.arange(len(own)) - np.searchsorted(own, own) < k
        return pa.table({"id": own[keep], "neighbour": nid[keep], "similarity": s[keep]})

    buckets = max(12, math.ceil(int((asked * base_blocks).sum()) / 60000))
    found = (parts.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
             .groupBy("bucket").applyInArrow(lambda t: merge(t), empty))
    if not copies:
        return found
    # copies: a representative stands for its k + 1 smallest ids; every member gets the list of its group without itself
    group = firsts.withColumn("size", F.count("*").over(Window.partitionBy("rep"))).where("size > 1")
    few = group.select("rep", F.col("id").alias("nid"))
    wide = (found.select(F.col("id").alias("own"), F.col("neighbour").alias("rep"), "similarity").join(few, "rep", "left")
            .select("own", F.coalesce("nid", "rep").alias("nid"), "similarity")
            .unionByName(few.select(F.col("rep").alias("own"), "nid", F.lit(1.0).alias("similarity"))))
    top = Window.partitionBy("own").orderBy(F.desc("similarity"), "nid")
    lists = (wide.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)
             .groupBy("own").agg(F.array_sort(F.collect_list(F.struct("r", "nid", "similarity"))).alias("best")))  # at most k + 1 each
    members = sound.join(group.where("rn = 1").select("vec", "rep"), "vec").select(F.col("rep").alias("own"), "id")
    full = lists.join(members, "own", "left").withColumn("id", F.coalesce("id", "own"))
    rest = F.slice(F.filter("best", lambda b: b["nid"] != F.col("id")), 1, k)
    return full.select("id", F.explode(rest).alias("b")).select("id", F.col("b.nid").alias("neighbour"), F.col("b.similarity").alias("similarity"))


def _probed(c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a table of probed cells and the groups of these, each pair once."""
    row, col = np.nonzero(c >= 0)
    pair = np.unique(row * (int(group.max()) + 1) + group[c[row, col]])
    return np.divmod(pair, int(group.max()) + 1)


def _count(reps: DataFrame, model: Model, probes: int = 1, group: np.ndarray | None = None) -> np.ndarray:
    """Rows of every cell, or queries that probe any cell of a group: one number per cell or group, added up per partition first."""
    shared = reps.sparkSession.sparkContext.broadcast(model)
    group = np.arange(len(model.leaves)) if group is None else group

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(int(group.max()) + 1, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(_probed(shared.value.cells(unit(matrix(b.column(1)), np.float32), probes), group)[1], minlength=len(total))
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    got = reps.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(group.max()) + 1, np.int64)
    out[got.cell.to_numpy()] = got.n.to_numpy()
    return out


def _divide(reps: DataFrame, model: Model, counted: np.ndarray, cell_rows: int) -> Model:
    """The model with leaves in place of every cell of over twice ``cell_rows``, fitted per cell on at most about ``LEAF_ROWS`` of its rows."""
    want = np.where(counted > 2 * cell_rows, np.ceil(counted / cell_rows), 1).astype(np.int64)
    shared = reps.sparkSession.sparkContext.broadcast(model)
    share = np.minimum(1.0, LEAF_ROWS / np.maximum(counted, 1))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, x = b.column(0).to_numpy(), matrix(b.column(1))
                c = shared.value.cells(unit(x, np.float32), 1)[:, 0]
                mix = ((ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.float64) / (1 << 31)
                use = (want[c] > 1) & (mix <= share[c])
                yield pa.RecordBatch.from_arrays([pa.array(c[use]), binary(x[use])], ["cell", "vec"])

    def leaves(t: pa.Table) -> pa.Table:
        c, x = t.column("cell")[0].as_py(), unit(matrix(t.column("vec")), np.float32)
        got = kmeans(x, min(int(want[c]), max(1, len(x) // 8)), 8, np.random.default_rng(c), True)
        return pa.table({"cell": pa.array([c] * len(got), pa.int32()), "vec": binary(got.astype(np.float32))})

    got = reps.mapInArrow(draw, "cell int, vec binary").groupBy("cell").applyInArrow(leaves, "cell int, vec binary").toArrow()
    by, cells = matrix(got.column("vec")), got.column("cell").to_numpy()
    parts = [by[cells == c] if (cells == c).any() else model.coarse[c: c + 1] for c in range(len(model.coarse))]
    return new_model(model.coarse, np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts]))


def pairs(neighbours: DataFrame) -> DataFrame:
    return neighbours.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def recall_per_query(neighbours: DataFrame, vectors: DataFrame, id_col: str, vec_col: str, dim: int = 64, k: int = 10, block: int = 4096) -> DataFrame:
    """(id, neighbours, found): of every row whose id is divisible by 100, its exact neighbours and how many of them ``neighbours`` has.

    The queries are taken against all rows, ``block`` at a time.
    """
    sound = Stage(vectors.sparkSession, "ann").cut(packed(vectors, id_col, vec_col, dim))
    asked = sound.where("id % 100 = 0")
    blocks = max(1, math.ceil(asked.count() / block))
    true = None
    for i in range(blocks):
        part = exact_nearest(sound, asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow(), k).select("id", "neighbour")
        true = part if true is None else true.unionByName(part)
    both = true.join(neighbours.select("id", "neighbour", F.lit(1).alias("hit")), ["id", "neighbour"], "left")
    return both.groupBy("id").agg(F.count("*").alias("neighbours"), F.count("hit").alias("found"))


def recall_of(neighbours: DataFrame, vectors: DataFrame, id_col: str, vec_col: str, dim: int = 64, k: int = 10, block: int = 4096) -> DataFrame:
    """(queries, neighbours, found, recall) over all those queries."""
    per = recall_per_query(neighbours, vectors, id_col, vec_col, dim, k, block)
    got = per.agg(F.count("*").alias("queries"), F.sum("neighbours").alias("neighbours"), F.sum("found").alias("found"))
    return got.withColumn("recall", F.col("found") / F.col("neighbours"))
