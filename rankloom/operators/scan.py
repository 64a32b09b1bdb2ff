"""Exact top-k by scans: a task holds some queries and reads all documents of their group, block by block.

The documents are written once, in order of group and id, to the shared scratch folder as blocks of plain bytes. The queries
are spread over the tasks, and no task's hits need another's: what a task holds is its queries, their best k so far and one
block, whatever the number of documents; no hit is shuffled. Scores are first taken in single precision; whatever could be
among the best k by the bound of its rounding error is scored again in double precision, so the result is that of double
precision. The order is that of topk.ranked: by 9 decimals, then by id, which is the order of reading.

Vectors much longer than the rest are searched first, those of several blocks together. No score is over the product of the
lengths, so a query whose list is full of better ones needs no shorter vectors; where lengths are alike, all are searched at once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.session import materialize, written

#: Numbers in a stored block, about; queries scored at once; hits that a task holds, about.
BLOCK_VALUES, TILE, HELD_HITS = 262_144, 128, 1_600_000
#: Numbers of longer vectors, about, that a task keeps for the following classes of length, so that their blocks are read once.
HELD_VALUES = 4_000_000
#: Tasks for each core, so that tasks of unequal length leave no core idle.
TASKS_PER_CORE = 4


def group_key(by: list[str]):
    return F.concat_ws("\u0001", *by) if by else F.lit("")


def runs(keys: list) -> Iterator[tuple[int, int]]:
    """(start, end) of equal neighbours."""
    k = np.array(keys, dtype=object)
    cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
    yield from ((s, e) for s, e in zip(cuts, cuts[1:]) if e > s)


def store(corpus: DataFrame, by: list[str]) -> str:
    """Writes corpus (by, doc_id, tokens: vectors of single or double precision) as blocks; the folder."""
    kind = "f4" if corpus.schema["tokens"].dataType.elementType.elementType.simpleString() == "float" else "f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, held, size = None, [], 0

        def block() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            counts, m = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            x = m.reshape(int(counts.sum()), -1)
            # of the longest token; not a number, if one of them is not finite
            length = np.sqrt(np.maximum.reduceat(np.where(np.isfinite(x).all(1), (x.astype(np.float64) ** 2).sum(1), np.nan), np.r_[0, np.cumsum(counts)[:-1]]))
            cols = [pa.array([g]), pa.array([len(ids)], pa.int32()), pa.array([len(m)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([counts.astype("i4").tobytes()], pa.binary()), pa.array([length.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["g", "n", "values", "ids", "counts", "length", "m"])

        for b in batches:
            keys = b.column("g").to_pylist()
            for s, e in runs(keys):
                if held and keys[s] != g:
                    yield block()
                    held, size = [], 0
                g = keys[s]
                while s < e:
                    rest = b.slice(s, e - s)
                    lengths = np.diff(rest.column("tokens").offsets.to_numpy())
                    first = rest.column("tokens").slice(0, 1).flatten()
                    dims = len(first.flatten()) // len(first)
                    n = max(1, int(np.searchsorted(np.cumsum(lengths) * dims, BLOCK_VALUES - size, "right")))
                    part = rest.slice(0, n)
                    values = part.column("tokens").flatten().flatten().to_numpy(zero_copy_only=False).astype(kind)
                    held.append((part.column("doc_id"), lengths[:n], values))
                    size, s = size + len(values), s + n
                    if size >= BLOCK_VALUES or n < len(rest):
                        yield block()
                        held, size = [], 0
        if held:
            yield block()

    ids = corpus.schema["doc_id"].dataType.simpleString()
    rows = corpus.select(group_key(by).alias("g"), *by, "doc_id", "tokens").sort(*by, "doc_id").select("g", "doc_id", "tokens")
    return written(rows.mapInArrow(pack, f"g string, n int, values long, ids array<{ids}>, counts binary, length binary, m binary"), "blocks", {"parquet.block.size": str(16 << 20)})


def blocks(folder: str, g: str, columns: list[str]) -> Iterator[dict[str, Any]]:
    """The stored blocks of a group in order."""
    import pyarrow.fs
    import pyarrow.parquet as pq

    fs, at = pyarrow.fs.FileSystem.from_uri(folder)
    found = [(int(m[1]), f.path) for f in fs.get_file_info(pyarrow.fs.FileSelector(at)) if (m := re.match(r"part-(\d+)", f.base_name))]
    for _, path in sorted(found):
        with fs.open_input_file(path) as source:
            file = pq.ParquetFile(source, pre_buffer=False)
            for r in range(file.num_row_groups):
                s = file.metadata.row_group(r).column(0).statistics  # of g
                if s is not None and s.has_min_max and not s.min <= g <= s.max:
                    continue
                for b in file.iter_batches(1, row_groups=[r], columns=["g", *columns], use_threads=False):
                    if b.num_rows and b.column("g")[0].as_py() == g:
                        yield {c: b.column(c)[0] for c in columns}


def nine(s: np.ndarray) -> np.ndarray:
    """Nine decimals, halves away from zero."""
    y = s * 1e9
    return np.where(np.abs(y) < 2**52, np.copysign(np.floor(np.abs(y) + 0.5), y) / 1e9, s)


class Best:
    """The best k of the queries of one tile. Of equal documents the first by number are kept."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.r, self.i, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.floor, self.last = np.full(n, -np.inf), np.full(n, -1)  # of full lists: the last score, in nine decimals, and document
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, r: np.ndarray, i: np.ndarray, s: np.ndarray) -> None:
        s9, floor = nine(s), self.floor[r]
        ok = np.isfinite(s) & ((s9 > floor) | (s9 == floor) & (i < self.last[r]))
        if ok.any():
            self.new.append((r[ok], i[ok], s[ok]))
            self.waiting += int(ok.sum())
        if self.waiting >= self.n * self.k or self.waiting and not np.isfinite(self.floor).all():
            self.merge()

    def merge(self) -> None:
        if not self.new:
            return
        r, i, s = (np.concatenate([a, *(x[j] for x in self.new)]) for j, a in enumerate((self.r, self.i, self.s)))
        self.new, self.waiting = [], 0
        r9 = nine(s)
        o = np.lexsort((i, -r9, r))
        r, i, s, r9 = r[o], i[o], s[o], r9[o]
        start = np.searchsorted(r, np.arange(self.n + 1))
        keep = np.arange(len(r)) - start[r] < self.k
        full = np.flatnonzero(np.diff(start) >= self.k)
        self.floor[full], self.last[full] = r9[start[full] + self.k - 1], i[start[full] + self.k - 1]
        self.r, self.i, self.s = r[keep], i[keep], s[keep]


def over(s: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of s at or over the row's limit. Where few are, eight at a time are passed over that hold none."""
    flat = (s >= low[:, None]).ravel()
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64))
    if len(eights) * 32 < len(flat):
        a, b = np.nonzero(flat[:whole].reshape(-1, 8)[eights])
        at = np.r_[eights[a] * 8 + b, whole + np.flatnonzero(flat[whole:])]
    else:
        at = np.flatnonzero(flat)
    return np.divmod(at, s.shape[1])


def limits(s: np.ndarray, floor: np.ndarray, k: int, error: np.ndarray) -> np.ndarray:
    """Scores under these cannot be among the best k: by the floor of full lists, or by the k best of this block."""
    low = floor - error
    if not np.isfinite(low).all() and s.shape[1] > k:
        at = np.flatnonzero(~np.isfinite(low))
        low[at] = np.partition(s[at], s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 2 * error[at]
    return (low - 1e-9 - np.abs(np.where(np.isfinite(low), low, 0)) * 4e-7).astype(s.dtype)


def matrix(cell: Any, values: int, rows: int) -> np.ndarray:
    raw = cell.as_buffer()
    return np.frombuffer(raw, "f4" if len(raw) == 4 * values else "f8").reshape(rows, -1)


def _levels(counts: np.ndarray, x: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """counts falls. Matrix t has the t-th token of all rows that have one: a prefix of the rows."""
    return [x[start[: int((counts > t).sum())] + t] for t in range(int(counts[0]) if len(counts) else 0)]


def classes(folder: str, g: str, least: int) -> list[tuple[float, float, int]]:
    """(over, up to, tokens): the lengths of the documents from long to short in up to four classes, apart by a gap of an eighth
    of an octave or more; all but the last of `least` documents or more."""
    found: dict[int, tuple[int, float, int]] = {}
    for b in blocks(folder, g, ["counts", "length"]):
        length, many = np.frombuffer(b["length"].as_buffer()), np.frombuffer(b["counts"].as_buffer(), "i4")
        fine = ~np.isnan(length)
        length, many = length[fine], many[fine]
        step = np.floor(8 * np.log2(np.clip(length, 1e-300, 1e300))).astype(int)
        for p in np.unique(step).tolist():
            own, (n, top, tokens) = step == p, found.get(p, (0, 0.0, 0))
            found[p] = (n + int(own.sum()), max(top, float(length[own].max())), tokens + int(many[own].sum()))
    cuts, sizes, many, last = [np.inf], [0], 0, 0
    for p in sorted(found, reverse=True):
        if many >= least and p < last - 1 and len(cuts) < 4:
            cuts.append(found[p][1])
            sizes.append(0)
            many = 0
        many, last, sizes[-1] = many + found[p][0], p, sizes[-1] + found[p][2]
    return list(zip([*cuts[1:], -1.0], cuts, sizes))


#: Documents of a class of length: numbers in the order of reading, counts of tokens, the tokens, the largest length, ids.
_Docs = tuple[np.ndarray, np.ndarray, np.ndarray, float, np.ndarray | None]


def _gathered(parts: list[_Docs]) -> _Docs:
    if len(parts) == 1:
        return parts[0]
    i, c, x, length, ids = zip(*parts)
    return np.concatenate(i), np.concatenate(c), np.concatenate(x), max(length), None if ids[0] is None else np.concatenate(ids)


def _by_class(folder: str, g: str, found: list[tuple[float, float, int]], dims: int, ids: bool) -> Iterator[Iterator[_Docs]]:
    """For each class its documents, those of several blocks together where a block has few. Following classes that are small
    are kept when the blocks are read for one, so that they need no reading of their own."""
    kept: dict[int, list[_Docs]] = {}

    def read(first: int) -> Iterator[_Docs]:
        wanted, room = [first], HELD_VALUES
        while wanted[-1] + 1 < len(found) and (room := room - found[wanted[-1] + 1][2] * dims) >= 0:
            wanted.append(wanted[-1] + 1)
        waiting, size, at = {w: [] for w in wanted}, dict.fromkeys(wanted, 0), 0
        for b in blocks(folder, g, ["n", "values", "counts", "length", "m", *(["ids"] if ids else [])]):
            dc, length = np.frombuffer(b["counts"].as_buffer(), "i4").astype(np.int64), np.frombuffer(b["length"].as_buffer())
            base, at = at, at + len(dc)
            x, db = matrix(b["m"], b["values"].as_py(), int(dc.sum())), np.r_[0, np.cumsum(dc)[:-1]]
            names_ = np.array(b["ids"].values.to_pylist(), dtype=object) if ids else None
            for w in wanted:
                do = np.flatnonzero((length > found[w][0]) & (length <= found[w][1]))
                if not len(do):
                    continue
                many = dc[do]
                rows = np.repeat(db[do] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
                own = (base + do, many, x if len(rows) == len(x) else x[rows], float(length[do].max()), None if names_ is None else names_[do])
                size[w] += own[2].size
                waiting[w].append(own)
                if 2 * size[w] >= BLOCK_VALUES:
                    full, waiting[w], size[w] = _gathered(waiting[w]), [], 0
                    if w == first:
                        yield full
                    else:
                        kept.setdefault(w, []).append(full)
        for w in wanted[1:]:
            kept[w] = [*kept.get(w, []), *([_gathered(waiting[w])] if waiting[w] else [])]
        if waiting[first]:
            yield _gathered(waiting[first])

    for j in range(len(found)):
        yield iter(kept.pop(j)) if j in kept else read(j)


def search(folder: str, g: str, counts: np.ndarray, q: np.ndarray, k: int, total: bool, own: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document's number in the order of reading, score) of the best k, in order. counts: tokens of each query, q: all
    their tokens. The score is the sum (total) or the maximum over the query's tokens of the best inner product with a token
    of the document. own: ids of the queries, which are no hits of themselves."""
    order, begin = np.argsort(-counts, kind="stable"), np.r_[0, np.cumsum(counts)[:-1]]
    each = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    size, reach = np.add.reduceat(each, begin)[order], (np.add if total else np.maximum).reduceat(each, begin)[order]
    counts, begin, dims, wanted = counts[order], begin[order], q.shape[1], k + (own is not None)
    tiles = [slice(s, min(s + TILE, len(counts))) for s in range(0, len(counts), TILE)]
    best = [Best(t.stop - t.start, k) for t in tiles]
    found = classes(folder, g, wanted)
    for (_, upto, _), docs_of in zip(found, _by_class(folder, g, found, dims, own is not None)):
        # (tile, its rows whose lists vectors of these lengths can change, the same as places in order)
        open_ = [(top, rows, rows + t.start) for t, top in zip(tiles, best) if len(rows := np.flatnonzero(~(top.floor > reach[t] * upto * (1 + 1e-9) + 2e-9)))]
        if not open_:
            break
        asked: dict[str, list] = {}
        for number, dc, x, longest, ids in docs_of:
            do, db = np.argsort(-dc, kind="stable"), np.r_[0, np.cumsum(dc)[:-1]]
            number, dc, db, ids = number[do], dc[do], db[do], None if ids is None else ids[do]
            kind = "f4" if size.max() * longest < 1e30 else "f8"
            if kind not in asked:
                asked[kind] = [_levels(counts[p], q.astype(kind, copy=False), begin[p]) for _, _, p in open_]
            docs = [np.ascontiguousarray(v.T).astype(kind, copy=False) for v in _levels(dc, x, db)]
            error = size * longest * (dims + int(counts[0]) + 8) * (2.0**-23 if kind == "f4" else 2.0**-52)
            for (top, rows, p), levels in zip(open_, asked[kind]):
                s = None
                for v in levels:
                    one = v @ docs[0]
                    for d in docs[1:]:
                        np.maximum(one[:, : d.shape[1]], v @ d, out=one[:, : d.shape[1]])
                    if s is None:
                        s = one
                    else:
                        (np.add if total else np.maximum)(s[: len(one)], one, out=s[: len(one)])
                r, c = over(s, limits(s, top.floor[rows], wanted, error[p]))
                if ids is not None and len(r):
                    apart = ids[c] != own[order[p]][r]
                    r, c = r[apart], c[apart]
                if len(r):
                    top.add(rows[r], number[c], _exact(q, begin[p], counts[p], x, db, dc, r, c, total))
        for top in best:
            top.merge()
    out = [(order[t][top.r], top.i, top.s) for t, top in zip(tiles, best)]
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _exact(q: np.ndarray, qb: np.ndarray, qc: np.ndarray, x: np.ndarray, db: np.ndarray, dc: np.ndarray, r: np.ndarray, c: np.ndarray, total: bool) -> np.ndarray:
    out = np.empty(len(r))
    for a in range(0, len(r), step := max(1, 2_000_000 // q.shape[1])):
        rr, cc = r[a : a + step], c[a : a + step]
        s = np.zeros(len(rr)) if total else np.full(len(rr), -np.inf)
        for t in range(int(qc[rr].max())):
            p = np.flatnonzero(qc[rr] > t)
            top = np.full(len(p), -np.inf)
            qt = q[qb[rr[p]] + t].astype(np.float64)
            for u in range(int(dc[cc[p]].max())):
                o = np.flatnonzero(dc[cc[p]] > u)
                dot = np.einsum("ij,ij->i", qt if len(o) == len(p) else qt[o], x[db[cc[p[o]]] + u].astype(np.float64))
                top[o] = np.maximum(top[o], dot)
            s[p] = s[p] + top if total else np.maximum(s[p], top)
        out[a : a + step] = s
    return out


def names(folder: str, g: str, numbers: np.ndarray) -> Callable[[np.ndarray], pa.Array]:
    """Looks up ids by the documents' numbers: `numbers` are all that will be asked."""
    wanted, got, at = np.unique(numbers), [], 0
    for b in blocks(folder, g, ["ids"]):
        ids = b["ids"].values
        a, z = np.searchsorted(wanted, (at, at + len(ids)))
        if z > a:
            got.append(ids.take(pa.array(wanted[a:z] - at)))
        at += len(ids)
    every = pa.concat_arrays(got) if got else pa.array([])
    return lambda i: every.take(pa.array(np.searchsorted(wanted, i)))


def spread(queries: DataFrame, folder: str, by: list[str], most: int, weight: str, once: str = "query_id") -> DataFrame | None:
    """Queries (g and more) in partitions of about equal work, of about `most` values of `once` at most; None if there is
    nothing to search. Queries of one value of `once`, which is worked on once, go together. Counts per group pass through
    the driver."""
    spark = queries.sparkSession
    docs = {r.g: r.n for r in spark.read.parquet(folder).groupBy("g").agg(F.sum(weight).alias("n")).collect()}
    asked = {r.g: r.n for r in queries.groupBy("g").agg((F.count("*") if once == "query_id" else F.count_distinct(once)).alias("n")).collect() if r.g in docs}
    if not asked:
        return None
    goal = max(1.0, sum(n * docs[g] for g, n in asked.items()) / (TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    rows, part, load, held = [], 0, 0.0, 0
    for g, n in sorted(asked.items(), key=lambda x: -x[1] * docs[x[0]]):
        pieces = min(n, max(math.ceil(n / most), math.ceil(n * docs[g] / goal)))
        if pieces == 1 and held and load + n * docs[g] <= goal and held + n <= most:
            load, held = load + n * docs[g], held + n
            rows.append((g, part - 1, 1))
            continue
        rows.append((g, part, pieces))
        part += pieces
        load, held = (n * docs[g], n) if pieces == 1 else (0.0, 0)
    places = F.broadcast(spark.createDataFrame(rows, "g string, _first int, _pieces int"))
    place = (F.col("_first") + F.pmod(F.xxhash64(once, F.lit(11)), F.col("_pieces"))).cast("int")
    return queries.join(places, "g").withColumn("_part", place).drop("_first", "_pieces").repartitionById(part, "_part").drop("_part")


def emitted(b: pa.Table, by: list[str], r: np.ndarray, i: np.ndarray, s: np.ndarray, name: Callable[[np.ndarray], pa.Array]) -> Iterator[pa.RecordBatch]:
    """A row for each query: by, query_id, docs and scores in order of rank. r is grouped."""
    cuts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
    for a in range(0, len(cuts), 512):
        own = cuts[a : a + 512]
        z = cuts[a + 512] if a + 512 < len(cuts) else len(r)
        offsets = pa.array(np.r_[own, z] - own[0], pa.int32())
        q = pa.array(r[own])
        yield pa.RecordBatch.from_arrays([*[b.column(c).take(q).combine_chunks() for c in (*by, "query_id")], pa.ListArray.from_arrays(offsets, name(i[own[0] : z])), pa.ListArray.from_arrays(offsets, pa.array(s[own[0] : z]))], names=[*by, "query_id", "docs", "scores"])


def listing(queries: DataFrame, id_type: str, by: list[str]) -> str:
    kind = lambda c: queries.schema[c].dataType.simpleString()
    return ", ".join([*[f"{b} {kind(b)}" for b in by], f"query_id {kind('query_id')}", f"docs array<{id_type}>", "scores array<double>"])


def hits(lists: DataFrame) -> DataFrame:
    """Lists as rows: doc_id, score, rank in place of docs and scores."""
    rest = [c for c in lists.columns if c not in ("docs", "scores")]
    return lists.select(*rest, F.posexplode(F.arrays_zip("docs", "scores")).alias("p", "x")).select(*rest, F.col("x.docs").alias("doc_id"), F.col("x.scores").alias("score"), (F.col("p") + 1).cast("int").alias("rank"))


def mapped(queries: DataFrame, folder: str, by: list[str], most: int, id_type: str, run: Callable[[pa.Table, str], Iterator[pa.RecordBatch]], weight: str = "values", once: str = "query_id") -> DataFrame:
    """run(queries of a group, group) in every task."""
    schema = listing(queries, id_type, by)
    asked = materialize(queries.select(group_key(by).alias("g"), *queries.columns), "queries")
    parts = spread(asked, folder, by, most, weight, once)
    if parts is None:
        return queries.sparkSession.createDataFrame([], schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            g = np.array(t.column("g").to_pylist(), dtype=object)
            for own in sorted(set(g)):
                yield from run(t.take(pa.array(np.flatnonzero(g == own))).combine_chunks(), own)

    return parts.mapInArrow(task, schema)


def asked_tokens(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    col = t.column("tokens").combine_chunks()
    counts = np.diff(col.offsets.to_numpy()).astype(np.int64)
    return counts, col.flatten().flatten().to_numpy(zero_copy_only=False).reshape(int(counts.sum()), -1)


def nearest(corpus: DataFrame, queries: DataFrame, k: int, by: list[str], total: bool = True, exclude_self: bool = False) -> DataFrame:
    """(by, query_id, docs, scores): exact top-k. corpus: by, doc_id, tokens; queries: by, query_id, tokens; no list
    of tokens is empty. Vectors with a number that is not finite take no part."""
    folder = store(corpus, by)

    def run(t: pa.Table, g: str) -> Iterator[pa.RecordBatch]:
        counts, q = asked_tokens(t)
        fine = np.minimum.reduceat(np.isfinite(q).all(1), np.r_[0, np.cumsum(counts)[:-1]])
        if not fine.all():
            q, t, counts = q[np.repeat(fine, counts)], t.filter(pa.array(fine)), counts[fine]
        if not len(counts):
            return
        own = np.array(t.column("query_id").to_pylist(), dtype=object) if exclude_self else None
        r, i, s = search(folder, g, counts, q, k, total, own)
        if len(r):
            yield from emitted(t, by, r, i, s, names(folder, g, i))

    most = max(256, min(16_384, HELD_HITS // max(1, k)))
    return mapped(queries.select(*by, "query_id", "tokens"), folder, by, most, corpus.schema["doc_id"].dataType.simpleString(), run)


def _codes(x: np.ndarray) -> np.ndarray:
    bits = np.packbits(x >= 0, axis=1)
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)


#: Places in a key of one number: query of the tile, distance, number of the document.
_FAR, _NUMBER = 18, 36


def search_codes(folder: str, g: str, q: np.ndarray, k: int, candidates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As search, for one token a document: the candidates nearest by sign bits, equal ones by the order of reading, then the
    best k of them by exact scores, for which the blocks are read a second time."""
    tiles = [slice(s, min(s + TILE, len(q))) for s in range(0, len(q), TILE)]
    asked, near, new, waiting = [_codes(q[t]) for t in tiles], [np.zeros(0, np.int64) for _ in tiles], [[] for _ in tiles], [0] * len(tiles)
    limit = [np.full(t.stop - t.start, 1 << 15, np.int64) for t in tiles]  # of full lists: their last distance

    def merge(j: int) -> None:
        key = np.sort(np.concatenate([near[j], *new[j]]))
        new[j], waiting[j] = [], 0
        r = key >> (_FAR + _NUMBER)
        start = np.searchsorted(r, np.arange(len(limit[j]) + 1))
        full = np.flatnonzero(np.diff(start) >= candidates)
        limit[j][full] = (key[start[full] + candidates - 1] >> _NUMBER) & ((1 << _FAR) - 1)
        near[j] = key[np.arange(len(key)) - start[r] < candidates]

    at = 0
    for b in blocks(folder, g, ["n", "values", "m"]):
        x = matrix(b["m"], b["values"].as_py(), b["n"].as_py())
        fine = np.flatnonzero(np.isfinite(x).all(1))
        base, at = at, at + len(x)
        code = np.ascontiguousarray(_codes(x[fine]).T)
        for j, own in enumerate(asked):
            apart = np.bitwise_count(own[:, 0, None] ^ code[0])
            for w in range(1, len(code)):
                apart = apart + np.bitwise_count(own[:, w, None] ^ code[w]).astype(np.int16)
            low = limit[j].copy()
            if len(fine) > candidates and (open_ := np.flatnonzero(low == 1 << 15)).size:
                low[open_] = np.partition(apart[open_], candidates - 1, axis=1)[:, candidates - 1].astype(np.int64) + 1
            # documents come in order: one as far as the last of a full list is behind it
            r, c = np.nonzero(apart < np.minimum(low, np.iinfo(apart.dtype).max).astype(apart.dtype)[:, None])
            if len(r):
                new[j].append(r << (_FAR + _NUMBER) | apart[r, c].astype(np.int64) << _NUMBER | base + fine[c])
                waiting[j] += len(r)
                if waiting[j] >= len(own) * candidates or (limit[j] == 1 << 15).any():
                    merge(j)
    for j in range(len(tiles)):
        merge(j)
    r = np.concatenate([(key >> (_FAR + _NUMBER)) + t.start for key, t in zip(near, tiles)])
    i = np.concatenate(near) & ((1 << _NUMBER) - 1)
    if not len(r):
        return r, i, np.zeros(0)
    order, s, at = np.argsort(i), np.empty(len(r)), 0
    ordered = i[order]
    for b in blocks(folder, g, ["n", "values", "m"]):
        x = matrix(b["m"], b["values"].as_py(), b["n"].as_py())
        a, z = np.searchsorted(ordered, (at, at + len(x)))
        for p in range(a, z, step := max(1, 2_000_000 // q.shape[1])):
            own = order[p : min(p + step, z)]
            s[own] = np.einsum("ij,ij->i", q[r[own]].astype(np.float64), x[i[own] - at].astype(np.float64))
        at += len(x)
    held = nine(s).reshape(len(q), -1)  # as many candidates for each query
    if held.shape[1] > k:
        keep = np.flatnonzero(held >= np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k, None])
        r, i, s = r[keep], i[keep], s[keep]
    o = np.lexsort((i, -nine(s), r))
    r, i, s = r[o], i[o], s[o]
    first = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[first], i[first], s[first]


def nearest_codes(corpus: DataFrame, queries: DataFrame, k: int, by: list[str], candidates: int) -> DataFrame:
    """(by, query_id, docs, scores) by search_codes; corpus and queries as for nearest, with one token each."""
    folder = store(corpus, by)

    def run(t: pa.Table, g: str) -> Iterator[pa.RecordBatch]:
        _, q = asked_tokens(t)
        fine = np.isfinite(q).all(1)
        t, q = t.filter(pa.array(fine)), q[fine]
        if len(q):
            r, i, s = search_codes(folder, g, q, k, candidates)
            if len(r):
                yield from emitted(t, by, r, i, s, names(folder, g, i))

    return mapped(queries.select(*by, "query_id", "tokens"), folder, by, max(64, min(16_384, HELD_HITS // candidates)), corpus.schema["doc_id"].dataType.simpleString(), run)
