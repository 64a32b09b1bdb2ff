"""Approximate dense retrieval: inverted file with product codes, one-bit codes or two-column codes, and graph search.

All follow published methods: OPQ (Ge et al. 2013) with IVF-ADC (Jegou et al. 2011), RaBitQ (Gao and Long 2024),
anisotropic quantisation (Guo et al. 2020), and navigable graphs per block with a merge as the distributable form of HNSW
(Malkov and Yashunin 2018). A quantiser is fitted on a bounded sample (TRAIN_ROWS vectors in the order of a hash of the
id), every vector is encoded where it lies, and a search streams the codes past the queries: each partition keeps its best
candidates per query, which alone are shuffled and re-ranked with the full vectors. Nothing gathers a list in one task, so
the cap on the number of lists is harmless at any size. How many lists a query reads and how many candidates are re-ranked
is measured on the sample (`tune`); the stated numbers are the least.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import vectors as V
from rankloom.operators.dense import by_blocks, nlist, pq_parts
from rankloom.operators.topk import ranked

TRAIN_ROWS = 200_000
TUNE_QUERIES = 128
GRAPH_BLOCK = 10_000


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 13) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 16384] @ c.T - half, axis=1) for i in range(0, len(x), 16384)]) if len(x) else np.zeros(0, np.int64)


def _training(corpus: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, int]:
    """A bounded sample, the same on every run, and the number of all vectors."""
    n = corpus.count()
    pick = corpus if n <= rows else corpus.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_003)) < math.ceil(1_000_003 * rows / n))
    got = pick.select(F.xxhash64("doc_id", F.lit(13)).alias("h"), "v").toPandas().sort_values("h", kind="stable").head(rows)
    return np.stack([np.asarray(v, np.float64) for v in got.v]) if len(got) else np.zeros((0, 1)), n


@dataclass
class ProductCodes:
    """Rotation learned with the codebooks, coarse lists, one byte per sub-vector of the residual; asymmetric scores."""

    parts: int = 32
    rounds: int = 4
    probes: int = 32
    candidates: int = 100
    state: dict = field(default_factory=dict)

    def fit(self, x: np.ndarray, n: int) -> ProductCodes:
        d = x.shape[1]
        m = pq_parts(n, d, self.parts)
        r = np.eye(d)
        for _ in range(self.rounds):
            y = x @ r
            coarse = kmeans(y, nlist(n))
            res = y - coarse[nearest(y, coarse)]
            books = [kmeans(res[:, p], 256, 5) for p in np.split(np.arange(d), m)]
            coded = np.concatenate([b[nearest(res[:, p], b)] for b, p in zip(books, np.split(np.arange(d), m))], axis=1) + coarse[nearest(y, coarse)]
            u, _, vt = np.linalg.svd(x.T @ coded)
            r = u @ vt
        y = x @ r
        coarse = kmeans(y, nlist(n))
        res = y - coarse[nearest(y, coarse)]
        self.state = {"r": r, "coarse": coarse, "books": [kmeans(res[:, p], 256, 5) for p in np.split(np.arange(d), m)]}
        return self

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = x @ self.state["r"]
        cell = nearest(y, self.state["coarse"])
        res = y - self.state["coarse"][cell]
        cols = np.split(np.arange(y.shape[1]), len(self.state["books"]))
        return cell, np.stack([nearest(res[:, p], b) for p, b in zip(cols, self.state["books"])], axis=1).astype(np.uint8)

    def ask(self, q: np.ndarray) -> dict:
        y = q @ self.state["r"]
        cols = np.split(np.arange(y.shape[1]), len(self.state["books"]))
        lead = y @ self.state["coarse"].T
        return {"lead": lead, "tables": [y[:, p] @ b.T for p, b in zip(cols, self.state["books"])], "probe": _probe(lead, self.state.get("probes", self.probes))}

    def score(self, a: dict, rows: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        s = np.repeat(a["lead"][rows, cell][:, None], len(codes), axis=1)
        for j, t in enumerate(a["tables"]):
            s += t[rows][:, codes[:, j]]
        return s


@dataclass
class OneBitCodes:
    """Sign of the rotated residual direction per column, with its length and the cosine to its code: the estimate of the
    inner product is unbiased."""

    probes: int = 32
    candidates: int = 100
    seed: int = 13
    state: dict = field(default_factory=dict)

    def fit(self, x: np.ndarray, n: int) -> OneBitCodes:
        r, _ = np.linalg.qr(np.random.default_rng(self.seed).standard_normal((x.shape[1],) * 2))
        self.state = {"r": r, "coarse": kmeans(x, nlist(n))}
        return self

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.state["coarse"])
        res = x - self.state["coarse"][cell]
        length = np.linalg.norm(res, axis=1)
        o = (res / np.maximum(length, 1e-12)[:, None]) @ self.state["r"]
        bits = o >= 0
        fit = np.abs(o).sum(1) / math.sqrt(o.shape[1])
        extra = np.stack([length, np.maximum(fit, 1e-6)], axis=1).astype(np.float32)
        return cell, np.concatenate([np.packbits(bits, axis=1), extra.view(np.uint8)], axis=1)

    def ask(self, q: np.ndarray) -> dict:
        lead = q @ self.state["coarse"].T
        return {"lead": lead, "q": q @ self.state["r"], "probe": _probe(lead, self.state.get("probes", self.probes))}

    def score(self, a: dict, rows: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        d = a["q"].shape[1]
        w = (d + 7) // 8
        sign = np.unpackbits(codes[:, :w], axis=1)[:, :d].astype(np.float64) * 2 - 1
        extra = np.ascontiguousarray(codes[:, w:]).view(np.float32)
        est = (a["q"][rows] @ sign.T) / math.sqrt(d) / extra[:, 1]
        return a["lead"][rows, cell][:, None] + est * extra[:, 0]


@dataclass
class PairCodes:
    """A tree of about sqrt(n) leaves, at least a tenth of them searched; 16 centres per two columns, chosen so that the
    error along the vector weighs more than the error across it."""

    threshold: float = 0.2
    candidates: int = 1000
    state: dict = field(default_factory=dict)

    def fit(self, x: np.ndarray, n: int) -> PairCodes:
        leaves = max(1, int(math.sqrt(n))) if n >= 1000 else 1
        coarse = kmeans(x, leaves)
        res = x - coarse[nearest(x, coarse)]
        self.state = {"coarse": coarse, "probes": max(1, math.ceil(leaves / 10)), "books": [kmeans(res[:, i : i + 2], 16, 6) for i in range(0, x.shape[1], 2)]}
        return self

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.state["coarse"])
        res = x - self.state["coarse"][cell]
        d, t = x.shape[1], self.threshold
        eta = (d - 1) * t * t / (1 - t * t)
        u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
        along = np.zeros(len(x))
        codes = np.zeros((len(x), len(self.state["books"])), np.uint8)
        for j, b in enumerate(self.state["books"]):
            err = res[:, None, 2 * j : 2 * j + 2] - b[None]
            par = along[:, None] + (err * u[:, None, 2 * j : 2 * j + 2]).sum(2)
            codes[:, j] = np.argmin((err**2).sum(2) + max(0.0, eta - 1) * par**2, axis=1)
            along = np.take_along_axis(par, codes[:, j : j + 1].astype(np.int64), axis=1)[:, 0]
        return cell, codes

    def ask(self, q: np.ndarray) -> dict:
        lead = q @ self.state["coarse"].T
        return {"lead": lead, "tables": [q[:, 2 * j : 2 * j + 2] @ b.T for j, b in enumerate(self.state["books"])], "probe": _probe(lead, self.state["probes"])}

    score = ProductCodes.score


def _probe(lead: np.ndarray, probes: int) -> np.ndarray:
    """Which lists each query reads."""
    p = min(probes, lead.shape[1])
    out = np.zeros(lead.shape, dtype=bool)
    np.put_along_axis(out, np.argpartition(-lead, p - 1, axis=1)[:, :p], True, axis=1)
    return out


def tune(quantiser, x: np.ndarray, n: int, k: int, recall: float) -> None:
    """Sets the probes and candidates with which the first vectors of the sample x, as queries, find the given share of
    their true k (themselves left out) in n vectors. The list loses at most half of what may be lost, the codes the rest."""
    asked = min(TUNE_QUERIES, len(x))
    k = min(k, len(x) - 1)
    if k < 1:
        return
    cell, codes = (np.concatenate(z) for z in zip(*[quantiser.encode(x[i : i + 16384]) for i in range(0, len(x), 16384)]))
    blocks = []
    for i in range(0, asked, 16):
        own = np.arange(i, min(i + 16, asked))
        s = x[own] @ x.T
        s[np.arange(len(own)), own] = -np.inf
        blocks.append((own, np.argpartition(-s, k - 1, axis=1)[:, :k]))
    lead = quantiser.ask(x[:asked])["lead"]
    place = np.argsort(np.argsort(-lead, axis=1, kind="stable"), axis=1)
    places = np.concatenate([np.take_along_axis(place[own], cell[true], axis=1) for own, true in blocks])
    least = quantiser.state.get("probes", getattr(quantiser, "probes", 1))
    probes = max(least, 1 + int(np.quantile(places, (1 + recall) / 2, method="higher")))
    quantiser.state["probes"] = probes
    at = [np.flatnonzero(cell == c) for c in range(lead.shape[1])]
    ranks = []
    for own, true in blocks:
        a = quantiser.ask(x[own])
        est = np.full((len(own), len(x)), -np.inf)
        for c, members in enumerate(at):
            rows = np.flatnonzero(a["probe"][:, c])
            if len(rows) and len(members):
                est[np.ix_(rows, members)] = quantiser.score(a, rows, c, codes[members])
        for r in range(len(own)):
            got = est[r, true[r]]
            order = np.sort(est[r])
            ranks.append(np.where(np.isfinite(got), len(x) - np.searchsorted(order, got), len(x)))
    need = int(np.quantile(np.concatenate(ranks), recall, method="higher"))
    quantiser.state["candidates"] = max(quantiser.candidates, math.ceil(need * max(1.0, n / len(x))))


@dataclass(frozen=True)
class CodeIndex:
    """codes: doc_id, cell, code. The quantiser is small: lists and codebooks."""

    quantiser: object
    codes: DataFrame
    vectors: DataFrame


def build(corpus: DataFrame, quantiser, k: int = 10, recall: float = 0.95) -> CodeIndex:
    """corpus: doc_id, v. Probes and candidates are tuned for the recall of k hits."""
    x, n = _training(corpus)
    q = quantiser.fit(x, n) if len(x) else quantiser
    if len(x):
        tune(q, x, n, k, recall)
    sent = corpus.sparkSession.sparkContext.broadcast(_packed(q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _unpacked(type(q), sent.value)
        for b in batches:
            if b.num_rows:
                x = np.stack([np.asarray(v, np.float64) for v in b.column("v").to_pylist()])
                cell, code = own.encode(x)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], names=["doc_id", "cell", "code"])

    kind = corpus.schema["doc_id"].dataType.simpleString()
    return CodeIndex(q, corpus.select("doc_id", "v").mapInArrow(run, f"doc_id {kind}, cell int, code binary"), corpus)


def _packed(q) -> dict:
    return dict(q.__dict__)


def _unpacked(kind: type, fields: dict):
    q = kind()
    q.__dict__.update(fields)
    return q


def search(index: CodeIndex, queries: DataFrame, k: int, candidates: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the best candidates by code (as many as the index was tuned for, if not stated),
    re-ranked with the full vectors. queries: query_id, v, sent to all tasks in blocks."""
    return by_blocks(queries, lambda part: _search(index, part, k, candidates))


def _search(index: CodeIndex, queries: DataFrame, k: int, candidates: int | None) -> DataFrame:
    pdf = queries.select("query_id", "v").toPandas()
    spark, c = queries.sparkSession, max(candidates or index.quantiser.state.get("candidates", index.quantiser.candidates), k)
    keys = pdf.query_id.tolist()
    q = np.stack([np.asarray(v, np.float64) for v in pdf.v]) if len(pdf) else np.zeros((0, 1))
    sent = spark.sparkContext.broadcast((_packed(index.quantiser), index.quantiser.ask(q) if len(pdf) and index.quantiser.state else None, keys))
    kind = type(index.quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, asked, names = sent.value
        if asked is None:
            return
        own = _unpacked(kind, fields)
        ids: list = []
        hq, hs, hi = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for b in batches:
            cell = b.column("cell").to_numpy()
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(cell), -1) if len(cell) else None
            base = len(ids)
            ids += b.column("doc_id").to_pylist()
            parts = [(hq, hs, hi)]
            for one in np.unique(cell):
                at, rows = np.flatnonzero(cell == one), np.flatnonzero(asked["probe"][:, one])
                if len(rows):
                    s = own.score(asked, rows, int(one), code[at])
                    keep = min(c, len(at))
                    top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                    parts.append((np.repeat(rows, keep), np.take_along_axis(s, top, 1).ravel(), (base + at[top]).ravel()))
            hq, hs, hi = (np.concatenate(z) for z in zip(*parts))
            order = np.lexsort((hi, -hs, hq))
            hq, hs, hi = hq[order], hs[order], hi[order]
            start = np.flatnonzero(np.r_[True, hq[1:] != hq[:-1]]) if len(hq) else np.zeros(0, np.int64)
            ok = np.arange(len(hq)) - np.repeat(start, np.diff(np.r_[start, len(hq)])) < c
            hq, hs, hi = hq[ok], hs[ok], hi[ok]
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in hq]), pa.array([ids[i] for i in hi]), pa.array(hs, pa.float64())], names=["query_id", "doc_id", "estimate"]) if len(hq) else pa.RecordBatch.from_pylist([])

    dt, qt = index.vectors.schema["doc_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    found = index.codes.mapInArrow(lambda it: (x for x in run(it) if x.num_rows), f"query_id {qt}, doc_id {dt}, estimate double")
    near = ranked(found, ["query_id"], "estimate", ["doc_id"], c, digits=None).drop("rank")
    scored = near.join(index.vectors.select("doc_id", "v"), "doc_id").join(queries.select("query_id", F.col("v").alias("qv")), "query_id")
    return ranked(scored.select("query_id", "doc_id", V.dot(F.col("qv"), F.col("v")).alias("score")), ["query_id"], "score", ["doc_id"], k)


# --- graphs -----------------------------------------------------------------------------------------------------------


def graph(x: np.ndarray, links: int, seed: int = 42) -> np.ndarray:
    """Neighbour lists: the nearest vectors and a few far ones that keep the graph connected."""
    n = len(x)
    near = max(1, min(links - max(1, links // 4), n - 1))
    out = np.empty((n, near), np.int64)
    for i in range(0, n, 2048):
        s = x[i : i + 2048] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 2048] = np.argpartition(-s, near - 1, axis=1)[:, :near] if near < n else np.argsort(-s, axis=1)[:, :near]
    far = np.random.default_rng(seed).integers(0, n, (n, max(1, links // 4)))
    return np.concatenate([out, far], axis=1)


def graph_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, k: int, ef: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries at once: (similarities, rows) of the k best found, -inf where there are fewer."""
    n, ef = len(x), min(ef, len(x))
    entry = np.random.default_rng(seed).choice(n, min(n, 32), replace=False)
    seen = np.zeros((len(q), n), dtype=bool)
    rows = np.broadcast_to(entry, (len(q), len(entry))).copy()
    sims = q @ x[entry].T
    seen[:, entry] = True
    done = np.zeros(rows.shape, dtype=bool)
    everyone = np.arange(len(q))
    for _ in range(4 * ef):
        open_ = np.where(done, -np.inf, sims)
        at = open_.argmax(axis=1)
        if not np.isfinite(open_[everyone, at]).any():
            break
        live = np.isfinite(open_[everyone, at])
        done[everyone, at] = True
        nb = links[rows[everyone, at]]
        new = ~np.take_along_axis(seen, nb, axis=1) & live[:, None]
        np.put_along_axis(seen, nb, np.take_along_axis(seen, nb, axis=1) | live[:, None], axis=1)
        s = np.where(new, np.einsum("qd,qmd->qm", q, x[nb]), -np.inf)
        rows, sims, done = np.concatenate([rows, nb], 1), np.concatenate([sims, s], 1), np.concatenate([done, ~new], 1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :ef]
        rows, sims, done = (np.take_along_axis(z, order, 1) for z in (rows, sims, done))
    first = np.array([[s and r not in row[:j] for j, (r, s) in enumerate(zip(row, np.isfinite(sim)))] for row, sim in zip(rows[:, : 2 * k].tolist(), sims[:, : 2 * k])]) if len(q) else np.zeros((0, 0), bool)
    sims = np.where(first, sims[:, : 2 * k], -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(sims, order, 1), np.take_along_axis(rows[:, : 2 * k], order, 1)


@dataclass(frozen=True)
class GraphIndex:
    """blocks: ids (array), v and links (packed rows) of each block of about GRAPH_BLOCK vectors."""

    blocks: DataFrame
    links: int


def graph_build(corpus: DataFrame, links: int = 32) -> GraphIndex:
    blocks = max(1, math.ceil(corpus.count() / GRAPH_BLOCK))
    dt = corpus.schema["doc_id"].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id", kind="stable")
        x = np.stack([np.asarray(v, np.float64) for v in part.v])
        return pd.DataFrame({"ids": [part.doc_id.tolist()], "v": [x.tobytes()], "links": [graph(x, links).astype(np.int32).tobytes()]})

    return GraphIndex(corpus.select("doc_id", "v", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")).groupBy("block").applyInPandas(run, f"ids array<{dt}>, v binary, links binary"), links)


def graph_search_index(index: GraphIndex, queries: DataFrame, k: int, ef: int = 128) -> DataFrame:
    """(query_id, doc_id, score, rank): every block searched by every query, merged."""
    return by_blocks(queries, lambda part: _graph_search(index, part, k, ef))


def _graph_search(index: GraphIndex, queries: DataFrame, k: int, ef: int) -> DataFrame:
    pdf = queries.select("query_id", "v").toPandas()
    q = np.stack([np.asarray(v, np.float64) for v in pdf.v]) if len(pdf) else np.zeros((0, 1))
    sent = queries.sparkSession.sparkContext.broadcast((pdf.query_id.tolist(), q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        for b in batches:
            for ids, v, links in zip(b.column("ids").to_pylist(), b.column("v").to_pylist(), b.column("links").to_pylist()):
                x = np.frombuffer(v).reshape(len(ids), -1)
                near = np.frombuffer(links, np.int32).reshape(len(ids), -1).astype(np.int64)
                for i in range(0, len(q), 256):
                    s, rows = graph_search(x, near, q[i : i + 256], k, ef)
                    r, c = np.nonzero(np.isfinite(s))
                    if len(r):
                        yield pa.RecordBatch.from_arrays([pa.array([names[i + a] for a in r]), pa.array([ids[a] for a in rows[r, c]]), pa.array(s[r, c])], names=["query_id", "doc_id", "score"])

    dt, qt = index.blocks.schema["ids"].dataType.elementType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    return ranked(index.blocks.mapInArrow(run, f"query_id {qt}, doc_id {dt}, score double"), ["query_id"], "score", ["doc_id"], k)


def graph_topk(corpus: DataFrame, queries: DataFrame, k: int, links: int = 32, ef: int = 128) -> DataFrame:
    return graph_search_index(graph_build(corpus, links), queries, k, ef)
