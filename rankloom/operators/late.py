"""Late interaction: exact MaxSim, candidate pruning by centroids, and fixed-dimensional encodings.

A document or query is an array of token vectors. MaxSim is the sum over query tokens of the best inner product with a
document token. Exact scoring multiplies in Arrow batches; the approximate systems find candidates first (centroid
equi-join after Santhanam et al. 2022, encodings after Jayaram et al. 2024) and score only these exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import vectors as V
from rankloom.operators import dense, scan
from rankloom.operators.quantised import kmeans, nearest
from rankloom.operators.topk import ranked

TRAIN_TOKENS = 200_000


def maxsim(q: Column, d: Column) -> Column:
    best = F.transform(q, lambda x: F.array_max(F.transform(d, lambda y: V.dot(x, y))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def token_matrix(df: DataFrame, key: list[str], v: str, order: str) -> DataFrame:
    """(key, tokens): vectors of a key gathered in order; a key is one document, its tokens are bounded by its length."""
    return df.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(v).alias("v")))), lambda x: x["v"]).alias("tokens"))


def exact(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) over all documents. corpus: doc_id, tokens; queries: query_id, tokens."""
    return scan.hits(exact_lists(corpus, queries, k, []))


def exact_lists(corpus: DataFrame, queries: DataFrame, k: int, by: list[str], total: bool = True) -> DataFrame:
    """exact() in the form of scan.nearest. total: the sum over the query's tokens counts, else the best of them."""
    return scan.nearest(corpus.where(F.size("tokens") > 0), queries.where(F.size("tokens") > 0), k, by, total)


def rerank(candidates: DataFrame, corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact MaxSim of candidate pairs (query_id, doc_id)."""
    pairs = candidates.select("query_id", "doc_id").join(corpus.select("doc_id", F.col("tokens").alias("d")), "doc_id").join(queries.select("query_id", F.col("tokens").alias("q")), "query_id")
    return ranked(pairs.select("query_id", "doc_id", maxsim(F.col("q"), F.col("d")).alias("score")), ["query_id"], "score", ["doc_id"], k)


@dataclass(frozen=True)
class PlaidIndex:
    """centroids: float rows; spread: half the range of a residual; codes: doc_id, t, c, code (one byte per column)."""

    centroids: np.ndarray
    spread: float
    bits: int
    codes: DataFrame


def plaid_build(corpus: DataFrame, centroids: int | None = None, bits: int = 8) -> PlaidIndex:
    """Every token as its nearest centroid and the residual in `bits` per column. The centroids are fitted on at most
    TRAIN_TOKENS tokens; by default their number grows with the root of the number of tokens, 256 at least."""
    toks = corpus.select("doc_id", F.posexplode("tokens").alias("t", "v"))
    n = toks.count()
    wanted = centroids or max(256, min(TRAIN_TOKENS // 16, 1 << int(4 * np.sqrt(max(n, 1))).bit_length() - 1))
    pick = toks if n <= TRAIN_TOKENS else toks.where(F.pmod(F.xxhash64("doc_id", "t"), F.lit(1_000_003)) < int(1_000_003 * TRAIN_TOKENS / n))
    x = pick.select(F.xxhash64("doc_id", "t").alias("h"), "v").toPandas().sort_values("h", kind="stable").head(TRAIN_TOKENS)
    x = np.stack([np.asarray(v, np.float64) for v in x.v]) if len(x) else np.zeros((0, 1))
    c = kmeans(x, min(wanted, len(x))) if len(x) else x
    spread = float(np.abs(x - c[nearest(x, c)]).max() or 1.0) if len(x) else 1.0
    sent, steps = corpus.sparkSession.sparkContext.broadcast((c, spread)), 2**bits - 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, spread = sent.value
        for b in batches:
            if b.num_rows:
                x = np.stack([np.asarray(v, np.float64) for v in b.column("v").to_pylist()])
                own = nearest(x, c)
                code = np.clip(np.round((x - c[own] + spread) / (2 * spread) * steps), 0, steps).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array(own, pa.int32()), pa.array([r.tobytes() for r in code], pa.binary())], names=["doc_id", "t", "c", "code"])

    return PlaidIndex(c, spread, bits, toks.mapInArrow(encode, f"doc_id {corpus.schema['doc_id'].dataType.simpleString()}, t int, c int, code binary"))


def plaid_search(index: PlaidIndex, queries: DataFrame, k: int, probes: int = 32, full: int = 8192) -> DataFrame:
    """Documents that hold a probed centroid are scored by centroids alone, the best `full` of them with decoded tokens; only
    these documents' codes are gathered. k is not cut to the corpus."""
    spark = queries.sparkSession
    dt, qt = index.codes.schema["doc_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    if not len(index.centroids):
        return spark.createDataFrame([], f"query_id {qt}, doc_id {dt}, score double, rank int")
    sent, steps = spark.sparkContext.broadcast((index.centroids, index.spread)), 2**index.bits - 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, _ = sent.value
        for b in batches:
            if b.num_rows:
                s = np.stack([np.asarray(v, np.float64) for v in b.column("v").to_pylist()]) @ c.T
                p = min(probes, s.shape[1])
                top = np.argpartition(-s, p - 1, axis=1)[:, :p]
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(np.repeat(np.arange(len(s)), p))), pa.array(np.repeat(b.column("t").to_numpy(), p)), pa.array(top.ravel(), pa.int32()), pa.array(np.take_along_axis(s, top, 1).ravel())], names=["query_id", "qt", "c", "s"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, spread = sent.value
        for b in batches:
            if b.num_rows:
                code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                near = c[b.column("c").to_numpy()] + code / steps * 2 * spread - spread
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array(list(near), pa.list_(pa.float64()))], names=["doc_id", "t", "v"])

    probed = queries.select("query_id", F.posexplode("tokens").alias("t", "v")).mapInArrow(ask, f"query_id {qt}, qt int, c int, s double")
    rough = probed.join(index.codes.select("doc_id", "c").distinct(), "c").groupBy("query_id", "doc_id", "qt").agg(F.max("s").alias("s")).groupBy("query_id", "doc_id").agg(F.sum("s").alias("rough"))
    near = ranked(rough, ["query_id"], "rough", ["doc_id"], full)
    held = index.codes.join(near.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(decode, f"doc_id {dt}, t int, v array<double>")
    return rerank(near, token_matrix(held, ["doc_id"], "v", "t"), queries, k)


def plaid(corpus: DataFrame, queries: DataFrame, k: int, centroids: int | None = None, probes: int = 32, full: int = 8192, bits: int = 8) -> DataFrame:
    return plaid_search(plaid_build(corpus, centroids, bits), queries, k, probes, full)


def planes(dims: int, sims: int, proj: int, reps: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Seeded hyperplanes and sign projections; part of the metadata of an encoding."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((reps, dims, sims)), rng.choice([-1.0, 1.0], (reps, dims, proj)) / np.sqrt(proj)


def encode_fixed(tokens: np.ndarray, h: np.ndarray, p: np.ndarray, query: bool) -> np.ndarray:
    """Buckets by the signs of the hyperplanes; a query sums its tokens per bucket, a document averages them and fills an
    empty bucket with the token of the nearest bucket."""
    reps, _, sims = h.shape
    power = 1 << np.arange(sims)
    out = []
    for r in range(reps):
        bucket = ((tokens @ h[r] > 0) * power).sum(1)
        proj = tokens @ p[r]
        f = np.zeros((1 << sims, proj.shape[1]))
        np.add.at(f, bucket, proj)
        if not query:
            n = np.bincount(bucket, minlength=1 << sims)
            f /= np.maximum(n, 1)[:, None]
            empty = np.flatnonzero(n == 0)
            if len(empty):
                bits = np.array([[bin(e ^ b).count("1") for b in bucket] for e in empty])
                f[empty] = proj[bits.argmin(axis=1)]
        out.append(f.ravel())
    return np.concatenate(out)


def fixed_encodings(df: DataFrame, key: str, query: bool, dims: int, sims: int = 5, proj: int = 16, reps: int = 20, seed: int = 42) -> DataFrame:
    """(key, v): one vector of reps * 2^sims * proj numbers per token matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, p = planes(dims, sims, proj, reps, seed)
        for b in batches:
            if b.num_rows:
                vs = [encode_fixed(np.array(m, np.float64), h, p, query) for m in b.column("tokens").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(vs, pa.list_(pa.float64()))], names=[key, "v"])

    return df.select(key, "tokens").where(F.size("tokens") > 0).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, v array<double>")


def muvera_search(encodings: DataFrame, corpus: DataFrame, queries: DataFrame, k: int, dims: int, candidates: int = 1000, sims: int = 5, proj: int = 16, reps: int = 20, seed: int = 42) -> DataFrame:
    """Exact inner products of the encodings give candidates, MaxSim re-ranks them. encodings: doc_id, v of the corpus."""
    q = fixed_encodings(queries, "query_id", True, dims, sims, proj, reps, seed)
    return rerank(dense.flat(encodings, q, max(candidates, k), []), corpus, queries, k)


def muvera(corpus: DataFrame, queries: DataFrame, k: int, dims: int, candidates: int = 1000, sims: int = 5, proj: int = 16, reps: int = 20, seed: int = 42) -> DataFrame:
    return muvera_search(fixed_encodings(corpus, "doc_id", False, dims, sims, proj, reps, seed), corpus, queries, k, dims, candidates, sims, proj, reps, seed)
