"""Most similar vectors for every vector.

Method: adaptive dimension scan over an inverted-file index. Vectors are normalised and rotated; per model, k-means on a
bounded sample gives cells. Each vector that asks probes its nearest cells. Within a probed list the distance is built up over
blocks of columns; after each block a hypothesis test abandons every candidate that is hardly among the k best any more, and
only survivors see the next columns. The rotation is to the principal axes of the sample, so the first columns tell most. The
test is fitted on the sample: a share `risk` of true neighbours has more of its squared distance in the columns seen so far than
the test allows for. The threshold is the k-th best so far: the nearest cell is scanned first, then the next few, then the rest.

Data layout: a vector is shipped once to the group of its own cell as an item, and once to each group of cells that it
probes; a group is about GROUP_ROWS vectors of neighbouring cells, so small models are one group and nothing is shipped
twice. Groups that the sample shows to be larger, or to hold more than WORK_PAIRS pairs, are cut into blocks by a hash of
the vector, so no task gets more than a block of each side. Exact copies are collapsed to one row with its k + 1 lowest ids
(more can't be needed), within each Arrow batch before the shuffle and within the task after it, so a third of all rows
may be one vector. The cells are the only broadcast; their number is bounded by MAX_CELLS per model.

Bounded sample: TRAIN_ROWS distinct index vectors per model at most, chosen by a hash of the vector, fit rotation, cells
and block sizes; every vector is indexed. Up to 67 million vectors a model the cells grow with the root of their number;
beyond that MAX_CELLS holds and the work per query grows in proportion.

Defined results for odd input: vectors that are null, of another length, all zero or hold a null, NaN or infinite number
take no part; neither do rows with a null id or model; repeated rows count once (an id with different vectors counts with
each); equal similarities are ordered by id; a vector is never its own neighbour; models with few vectors give shorter
lists; an empty table gives an empty result. Only the named columns are read, so extra columns never clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.session import materialize

TRAIN_ROWS = 32_768
MAX_CELLS = 4_096
GROUP_ROWS = 65_536
WORK_PAIRS = 150_000_000
ROUNDS = ((0, 1), (1, 4), (4, None))


@dataclass(frozen=True)
class SearchParameters:
    """dims: length of a vector. probes: cells scanned per query. cells_per_root: cells per square root of the number of
    vectors. columns: columns per block of the scan. risk: of the test, the share of true neighbours at the threshold that each
    block may lose; 0 or too small a sample: only candidates whose partial distance is too large already are abandoned."""

    dims: int = 64
    probes: int = 16
    cells_per_root: float = 0.5
    columns: int = 16
    risk: float = 0.002
    seed: int = 7


@dataclass(frozen=True)
class Cells:
    """Of one model: rotation, rotated centres, group of each cell, item blocks and query blocks of each group, the share of
    a neighbour's squared distance that may lie in the columns seen after each block, and of each cell a similarity that
    the k-th neighbours of its vectors reach."""

    rotation: np.ndarray
    centres: np.ndarray
    group: np.ndarray
    item_blocks: np.ndarray
    query_blocks: np.ndarray
    share: np.ndarray
    floor: np.ndarray


def unit(vectors, dims: int) -> np.ndarray:
    x = np.asarray(vectors, dtype=np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means; empty cells keep their centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[i : i + 8192] @ c.T, axis=1) for i in range(0, len(x), 8192)])
        order = np.argsort(own, kind="stable")
        cells, first = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c[cells] = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c[cells])
    return c


def merge_best(query: np.ndarray, sim: np.ndarray, item: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, sim, item) of each query, ordered by query, similarity and item."""
    order = np.lexsort((item, -sim, query))
    query, sim, item = query[order], sim[order], item[order]
    start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
    keep = rank < k
    return query[keep], sim[keep], item[keep]


def block_edges(p: SearchParameters) -> list[int]:
    """The number of columns seen after each block."""
    return [*range(p.columns, p.dims, p.columns), p.dims]


def adaptive_scan(q: np.ndarray, x: np.ndarray, threshold: np.ndarray, share: np.ndarray, p: SearchParameters, alive_after: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of q, similarity, row of x) of unit vectors whose similarity reaches the threshold of the query, found
    block by block of columns. alive_after: gets [pairs, pairs alive after each block].

    Whether survivors are picked out or multiplied with the others only follows from their number, not which pairs survive.
    Half the squared length of x is subtracted along with each block, so the test is one comparison with a number per query."""
    seen, alive, i, j, told = 0, None, None, None, [len(q) * len(x)]
    dot, length, far = np.zeros((len(q), len(x)), np.float32), np.zeros(len(q)), 2 - 2 * threshold + 2e-6
    for upto, part in zip(block_edges(p), share):
        qs, xs = q[:, seen:upto], x[:, seen:upto]
        length += np.einsum("qd,qd->q", qs, qs, dtype=np.float64)
        half = 0.5 * np.einsum("xd,xd->x", xs, xs)
        bound = ((length - part * far) / 2).astype(np.float32)
        if i is None:
            dot += qs @ xs.T
            dot -= half
            ok = dot >= bound[:, None]
            alive = ok if alive is None else alive & ok
            n = int(np.count_nonzero(alive))
            if n < 0.05 * alive.size or upto == p.dims:
                i, j = np.nonzero(alive)
                s = dot[i, j]
        else:
            s = s + np.einsum("nd,nd->n", qs[i], xs[j]) - half[j]
            ok = s >= bound[i]
            i, j, s = i[ok], j[ok], s[ok]
            n = len(i)
        told.append(n)
        seen = upto
    if alive_after is not None:
        alive_after.append(told)
    return i, s + np.float32(0.5), j


def best_of_cells(q: np.ndarray, probes: np.ndarray, threshold: np.ndarray, x: np.ndarray, cell: np.ndarray, k: int, cells: Cells, p: SearchParameters, alive_after: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, similarity, row of x) of the k best items of each query. probes: cells of each query, nearest first, -1
    for none; threshold: a similarity below which nothing is wanted, -inf for none."""
    order = np.argsort(cell, kind="stable")
    x, held = x[order], cell[order]
    names, start = np.unique(held, return_index=True)
    stop = np.r_[start[1:], len(held)]
    place = {int(c): (int(a), int(b)) for c, a, b in zip(names, start, stop)}
    limit = threshold.astype(np.float64).copy()
    best = (np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int64))
    for lo, hi in ROUNDS:
        now = probes[:, lo:hi]
        row, col = np.nonzero(now >= 0)
        at = now[row, col]
        o = np.argsort(at, kind="stable")
        row, at = row[o], at[o]
        own, first = np.unique(at, return_index=True)
        found = [best]
        for c, a, b in zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(at)]):
            if c not in place:
                continue
            u, w = place[c]
            for s0 in range(a, b, step := max(1, 8_000_000 // (w - u))):
                rows = row[s0 : min(b, s0 + step)]
                free = ~np.isfinite(limit[rows])
                if free.any():
                    some = rows[free]
                    sim = q[some] @ x[u:w].T
                    top = np.argpartition(-sim, k - 1, axis=1)[:, :k] if w - u > k else np.broadcast_to(np.arange(w - u), sim.shape)
                    found.append((np.repeat(some, top.shape[1]), np.take_along_axis(sim, top, axis=1).ravel(), order[u + top.ravel()]))
                    rows = rows[~free]
                if len(rows):
                    i, sim, j = adaptive_scan(q[rows], x[u:w], limit[rows], cells.share, p, alive_after)
                    found.append((rows[i], sim, order[u + j]))
        best = merge_best(*(np.concatenate(z) for z in zip(*found)), k)
        full = np.bincount(best[0], minlength=len(q)) >= k
        worst = np.full(len(q), np.inf)
        np.minimum.at(worst, best[0], best[1])
        limit = np.where(full, np.maximum(limit, worst - 1e-6), limit)
    return best


# --- distributed steps ------------------------------------------------------------------------------------------------

_KEY = ["model_id", "h1", "h2"]


def valid_vectors(df: DataFrame, dims: int, query: bool) -> DataFrame:
    """(vec_id, model_id, query, embedding, h1, h2) of the rows that take part; h1 and h2 are hashes of the vector."""
    e = F.col("embedding")
    odd = F.coalesce(reduce(Column.__or__, [F.array_contains(e, F.lit(x).cast("float")) for x in (math.nan, math.inf, -math.inf)]), F.lit(True))
    rows = df.select("vec_id", "model_id", F.lit(query).alias("query"), e.cast("array<float>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("model_id").isNotNull() & (F.size(e) == dims))
    return rows.where(~odd & ((F.array_max(e) > 0) | (F.array_min(e) < 0))).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})


def nearest_cells(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each row, nearest first."""
    n, out = min(n, len(centroids)), []
    for i in range(0, len(x), 4096):
        s = x[i : i + 4096] @ centroids.T
        top = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < len(centroids) else np.broadcast_to(np.arange(n), s.shape)
        out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, axis=1), axis=1, kind="stable"), axis=1))
    return np.concatenate(out).astype(np.int32) if out else np.zeros((0, n), np.int32)


def fit_cells(x: np.ndarray, distinct: float, askers: float, k: int, p: SearchParameters) -> Cells:
    """x: unit vectors of the sample of a model with about `distinct` vectors, about `askers` of which will ask."""
    _, axes = np.linalg.eigh(x.T @ x)
    rotation = axes[:, ::-1].astype(np.float32)
    x = (x @ axes[:, ::-1]).astype(np.float32)
    centres = kmeans(x, int(min(MAX_CELLS, max(1, math.ceil(p.cells_per_root * math.sqrt(distinct))), max(1, len(x) // 8))), 6, p.seed)
    near = nearest_cells(x, centres, p.probes)
    own, scale = near[:, 0], distinct / len(x)
    groups = max(1, math.ceil(distinct / GROUP_ROWS))
    group = np.argmax(centres @ kmeans(centres, groups, 6, p.seed).T, axis=1) if groups > 1 else np.zeros(len(centres), np.int64)
    held = np.bincount(own, minlength=len(centres)) * scale
    asked = np.bincount(near.ravel(), minlength=len(centres)) * (askers / len(x))
    touched = np.array([(group[near] == g).any(axis=1).mean() * askers for g in range(group.max() + 1)])
    items = np.bincount(group, weights=held)
    item_blocks = np.maximum(1, np.ceil(items / (2 * GROUP_ROWS))).astype(np.int64)
    query_blocks = np.maximum(np.ceil(np.bincount(group, weights=held * asked) / item_blocks / WORK_PAIRS), np.ceil(touched / (2 * GROUP_ROWS)))
    floor, shares = np.full(len(centres), -np.inf), []
    for c in range(len(centres)):
        if np.count_nonzero(at := own == c) > k:
            y = x[at]
            s = y @ y.T
            np.fill_diagonal(s, np.inf)
            top = np.argpartition(-s, k, axis=1)[:, : k + 1]
            floor[c] = np.take_along_axis(s, top, axis=1).min()
            apart = np.cumsum((y[:, None, :] - y[top]) ** 2, axis=2)[:, :, [e - 1 for e in block_edges(p)]].reshape(-1, len(block_edges(p)))
            shares.append((apart / np.maximum(apart[:, -1:], 1e-12))[apart[:, -1] > 1e-6])
    shares = np.concatenate(shares) if shares else np.zeros((0, len(block_edges(p))))
    share = np.quantile(shares, 1 - p.risk, axis=0) if p.risk > 0 and len(shares) * p.risk >= 4 else np.ones(len(block_edges(p)))
    share[-1] = 1.0
    return Cells(rotation, centres, group.astype(np.int32), item_blocks, np.maximum(1, query_blocks).astype(np.int64), share, floor)


def train_cells(index: DataFrame, queries: DataFrame, asks: frozenset[str], k: int, p: SearchParameters) -> dict[str, Cells]:
    """The cells of each model, fitted on a sample of its index vectors in a task each."""
    count = lambda df: {r.model_id: r.n for r in df.groupBy("model_id").agg(F.count("*").alias("n")).collect()}  # noqa: E731 - a row per model
    n, nq = count(index), count(queries)
    if not n:
        return {}
    rate = F.create_map(*[F.lit(v) for m, c in n.items() for v in (m, min(1.0, TRAIN_ROWS / c))])[F.col("model_id")]
    sample = index.where(F.pmod(F.xxhash64("h1", F.lit(p.seed)), F.lit(1 << 30)) < rate * (1 << 30)).select(*_KEY, "embedding").dropDuplicates(_KEY)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        import pickle

        m = pdf.model_id.iloc[0]
        pdf = pdf.sort_values(["h1", "h2"])
        distinct = len(pdf) / min(1.0, TRAIN_ROWS / n[m])
        askers = (n[m] if asks & {"ii", "iq"} else 0) + (nq.get(m, 0) if "qi" in asks else 0)
        got = fit_cells(unit(np.concatenate(pdf.embedding.to_numpy()), p.dims), distinct, askers, k, p)
        return pd.DataFrame({"model_id": [m], "cells": [pickle.dumps(tuple(got.__dict__.values()))]})

    import pickle

    return {r.model_id: Cells(*pickle.loads(r.cells)) for r in sample.groupBy("model_id").applyInPandas(fit, "model_id string, cells binary").collect()}


def _copies(keys: list[np.ndarray], ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of one copy of each distinct key, offsets into, ids): the `keep` lowest different ids of each."""
    order = np.lexsort((ids, *keys))
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in keys:
        new[1:] |= c[order][1:] != c[order][:-1]
    same = np.zeros(len(order), dtype=bool)
    same[1:] = ~new[1:] & (ids[order][1:] == ids[order][:-1])
    which = np.cumsum(new) - 1
    first, which, ids = order[new], which[~same], ids[order][~same]
    start = np.searchsorted(which, np.arange(len(first)))
    ok = np.arange(len(ids)) - start[which] < keep
    ids, which = ids[ok], which[ok]
    return first, np.searchsorted(which, np.arange(len(first) + 1)), ids


_PLACED = pa.schema([("model_id", pa.string()), ("grp", pa.int32()), ("ib", pa.int32()), ("qb", pa.int32()), ("role", pa.int32()), ("query", pa.bool_()), ("h1", pa.int64()), ("h2", pa.int64()), ("ids", pa.list_(pa.int64())), ("cells", pa.binary()), ("v", pa.binary())])
_PLACED_SQL = "model_id string, grp int, ib int, qb int, role int, query boolean, h1 long, h2 long, ids array<long>, cells binary, v binary"
ITEM, ASKS_INDEX, ASKS_QUERIES = 1, 2, 4


def place(vectors: DataFrame, cells, asks: frozenset[str], k: int, p: SearchParameters) -> DataFrame:
    """A row of each distinct vector of a batch for each block in which it is an item, asks, or both. role: sum of ITEM,
    ASKS_INDEX and ASKS_QUERIES; cells: those that it probes in the group, the nearest first, -1 for cells of other groups, and at the end its own cell.
    Vectors of a model without index vectors are left out: there is nothing to compare them with."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            models = b.column("model_id").to_numpy(zero_copy_only=False)
            ids, h1, h2, query = (b.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "h1", "h2", "query"))
            values = b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, p.dims)
            for m in sorted(set(models) & set(cells.value)):
                own, at = cells.value[m], np.flatnonzero(models == m)
                first, offsets, few = _copies([query[at], h1[at], h2[at]], ids[at], k + 1)
                at = at[first]
                x = (unit(values[at], p.dims) @ own.rotation.astype(np.float64)).astype(np.float32)
                near = nearest_cells(x, own.centres, p.probes)
                few = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(few))
                role = np.where(query[at], ("iq" in asks) * ITEM, ("ii" in asks or "qi" in asks) * ITEM)
                ask = np.where(query[at], ("qi" in asks) * ASKS_INDEX, ("ii" in asks) * ASKS_INDEX + ("iq" in asks) * ASKS_QUERIES)
                grp, mix = own.group[near], (h1[at] ^ (h1[at] >> 29)) & 0x7FFFFFFF
                for g in np.unique(grp).tolist():
                    home, there = grp[:, 0] == g, (grp == g).any(axis=1)
                    nib, nqb = int(own.item_blocks[g]), int(own.query_blocks[g])
                    probes = np.concatenate([np.where(grp == g, near, -1), near[:, :1]], axis=1).astype(np.int16)
                    for ib in range(nib):
                        for qb in range(nqb):
                            r = np.where(home & (mix % nib == ib), role, 0) + np.where(there & (mix // nib % nqb == qb), ask, 0)
                            if len(s := np.flatnonzero(r)):
                                part = x[s]
                                yield pa.RecordBatch.from_arrays([
                                    pa.array([m] * len(s), pa.string()), *(pa.array(np.full(len(s), c), pa.int32()) for c in (g, ib, qb)), pa.array(r[s], pa.int32()), pa.array(query[at][s]), pa.array(h1[at][s]), pa.array(h2[at][s]),
                                    few.take(pa.array(s)), pa.array([c.tobytes() for c in probes[s]], pa.binary()), pa.array([c.tobytes() for c in part], pa.binary())], schema=_PLACED)

    blocks = sum(int((c.item_blocks * c.query_blocks).sum()) for c in cells.value.values())
    placed = vectors.select("vec_id", "model_id", "query", "h1", "h2", "embedding").mapInArrow(run, _PLACED_SQL)
    return placed.repartition(max(1, 3 * blocks), *_BLOCK)  # a number of its own: a block is small, what is done with it is not


_BLOCK = ["model_id", "grp", "ib", "qb"]
_HITS = pa.struct([("d", pa.float64()), ("id", pa.int64())])
_LISTS = pa.schema([("model_id", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("to_query", pa.bool_()), ("hits", pa.list_(_HITS))])


def _scan(placed: DataFrame, cells, k: int, least: float, p: SearchParameters) -> DataFrame:
    """(model_id, h1, h2, to_query, hits): the best items of each asking vector among the cells that it probes in a group."""

    def run(t: pa.Table) -> pa.Table:
        m = t.column("model_id")[0].as_py()
        own, width = cells.value[m], min(p.probes, len(cells.value[m].centres))
        role, h1, h2, query = (t.column(c).to_numpy() for c in ("role", "h1", "h2", "query"))
        v = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float32).reshape(-1, p.dims)
        probes = np.frombuffer(b"".join(t.column("cells").to_pylist()), np.int16).reshape(-1, width + 1)
        probes, home = probes[:, :-1].astype(np.int64), probes[:, -1].astype(np.int64)
        ids = t.column("ids").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        of, flat = np.repeat(np.arange(len(ids)), ids.value_lengths().to_numpy()), ids.flatten().to_numpy()
        out = []
        for to_query, flag in ((False, ASKS_INDEX), (True, ASKS_QUERIES)):
            held = ((role & ITEM) > 0) & (query == to_query)
            asking = np.flatnonzero(role & flag)
            if not held.any() or not len(asking):
                continue
            some = held[of]
            first, offsets, few = _copies([h1[of[some]], h2[of[some]]], flat[some], k + 1)
            item = of[some][first]
            asking = asking[_copies([h1[asking], h2[asking]], np.zeros(len(asking), np.int64), 1)[0]]
            # away from its own group a vector starts with what the neighbours of its cell reach
            start = np.full(len(asking), least) if to_query else np.where(probes[asking, 0] >= 0, least, np.maximum(own.floor[home[asking]], least))
            i, s, j = best_of_cells(v[asking], probes[asking], start, v[item], home[item], k + 1, own, p)
            many = np.diff(offsets)[j]  # each item stands for its copies
            i, s = np.repeat(i, many), np.repeat(s, many)
            j = few[np.repeat(offsets[j], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            i, s, j = merge_best(i, s, j, k + 1)
            who, start = np.unique(i, return_index=True)
            hits = pa.ListArray.from_arrays(pa.array(np.r_[start, len(i)], pa.int32()), pa.StructArray.from_arrays([pa.array(-s.astype(np.float64)), pa.array(j)], fields=list(_HITS)))
            out.append(pa.Table.from_arrays([pa.array([m] * len(who), pa.string()), pa.array(h1[asking[who]]), pa.array(h2[asking[who]]), pa.array(np.full(len(who), to_query)), hits], schema=_LISTS))
        return pa.concat_tables(out) if out else _LISTS.empty_table()

    return placed.groupBy(*_BLOCK).applyInArrow(run, "model_id string, h1 long, h2 long, to_query boolean, hits array<struct<d:double,id:bigint>>")


def lists(index: DataFrame, queries: DataFrame, asks: frozenset[str], k: int, p: SearchParameters, least: float = -math.inf) -> DataFrame:
    """(vec_id, model_id, query, to_query, hits): k nearest vectors as an array of (d, id), d = -similarity, best first; none
    below the similarity `least`. asks: "ii" index vectors among index vectors, "qi" queries among index vectors, "iq" index
    vectors among queries; query and to_query tell these apart. Vectors without a hit are left out."""
    spark = index.sparkSession
    i, q = valid_vectors(index, p.dims, False), valid_vectors(queries, p.dims, True)
    cells = spark.sparkContext.broadcast(train_cells(i, q, asks, k, p))
    both = i.unionByName(q)
    got = _scan(place(both, cells, asks, k, p), cells, k, least, p)
    if any(c.item_blocks.sum() > 1 for c in cells.value.values()):  # lists come from several blocks of items
        got = got.groupBy(*_KEY, "to_query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k + 1).alias("hits"))
    members = both.select("vec_id", "query", *_KEY).distinct()
    wanted = F.concat(F.when(F.col("query"), "q").otherwise("i"), F.when(F.col("to_query"), "q").otherwise("i")).isin(*asks)
    rows = members.join(got, _KEY).where(wanted)
    return rows.select("vec_id", "model_id", "query", "to_query", F.slice(F.filter("hits", lambda h: h["id"] != F.col("vec_id")), 1, k).alias("hits"))


def nearest(collection: DataFrame, queries: DataFrame, k: int = 10, p: SearchParameters = SearchParameters()) -> DataFrame:
    """(vec_id, model_id, hits): for every valid vector of queries its k most similar vectors of the collection with the
    same model, as an array of (d, id) with d = -similarity, best first. Both inputs: vec_id, model_id, embedding."""
    return lists(collection, queries, frozenset({"qi"}), k, p).select("vec_id", "model_id", "hits")


def neighbour_rows(lists: DataFrame) -> DataFrame:
    """(model_id, vec_id, neighbour, similarity, place) from the lists of nearest()."""
    return lists.select("model_id", "vec_id", F.posexplode("hits").alias("pos", "h")).select("model_id", "vec_id", F.col("h.id").alias("neighbour"), (-F.col("h.d")).alias("similarity"), (F.col("pos") + 1).alias("place"))


def mutual_pairs(index: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.9, p: SearchParameters = SearchParameters()) -> DataFrame:
    """(vec_a, vec_b, similarity): index vectors, or an index and a query vector, each among the other's k most similar
    vectors of the table that the other is in, with at least the given similarity, which is the scan's first threshold."""
    got = lists(index, queries, frozenset({"ii", "qi", "iq"}), k, p, least)
    rows = materialize(got.select("model_id", "vec_id", "to_query", F.explode("hits").alias("h")).select("model_id", "vec_id", "to_query", F.col("h.id").alias("neighbour"), (-F.col("h.d")).alias("similarity")), "nn-close")
    there = rows.where("not to_query").select("model_id", "vec_id", "neighbour", "similarity")
    back = rows.select("model_id", F.col("neighbour").alias("vec_id"), F.col("vec_id").alias("neighbour")).distinct()
    pairs = there.join(back, ["model_id", "vec_id", "neighbour"])
    return pairs.groupBy(F.least("vec_id", "neighbour").alias("vec_a"), F.greatest("vec_id", "neighbour").alias("vec_b")).agg(F.max("similarity").alias("similarity"))
