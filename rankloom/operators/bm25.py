"""Sparse retrieval: inverted index and BM25.

A search is a scan (see scan): documents are stored in order of their ids as blocks, each with the postings of its own
terms, and a task adds up the weights of its queries' terms block by block, in single precision; what could be among the
best k by the bound of the rounding error is added up again in double precision. No pair of query and document leaves its
task. Query terms are distinct, and queries of the same terms are scored once, in one task; so are documents of the same
tokens, which have one score: they are stored as one, at the place of their first id, and taken apart in the lists. Queries
of a task that share their commonest terms are neighbours, and the weights of these terms are added up once for all of them.
Documents without a query term are not returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import tokens
from rankloom.operators import scan
# by name, as tasks use these: the module itself would take the session along
from rankloom.operators.scan import TILE, Best, blocks, emitted, limits, nine, over, runs
from rankloom.session import written

#: Tokens and documents of a stored block, about. A term that one document in so many of a block has is a row of numbers there,
#: if it is one of the first so many terms.
BLOCK_TOKENS, BLOCK_DOCS, DENSE, ROWS = 262_144, 4_096, 128, 1_024


@dataclass(frozen=True)
class Bm25Index:
    """postings: by, term, doc_id, tf, dl. doc_stats: by, doc_id, dl. corpus_stats: by, n, avgdl. df: by, term, df."""

    postings: DataFrame
    doc_stats: DataFrame
    corpus_stats: DataFrame
    df: DataFrame
    by: tuple[str, ...] = ()
    docs: DataFrame | None = None

    def texts(self) -> DataFrame:
        """(by, doc_id, tokens) of all documents, in any order of tokens."""
        if self.docs is not None:
            return self.docs
        key = [*self.by, "doc_id"]
        held = self.postings.groupBy(*key).agg(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf").cast("int")))).alias("tokens"))
        return self.doc_stats.select(*key).join(held, key, "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))

    def weights(self, k1: float = 0.9, b: float = 0.4) -> DataFrame:
        """(by, term, doc_id, w): idf times saturated term frequency."""
        p = self.postings.join(self.df, [*self.by, "term"])
        stats = F.broadcast(self.corpus_stats)  # one row per dataset
        p = p.join(stats, list(self.by)) if self.by else p.crossJoin(stats)
        idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        norm = 1 - b + b * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1e-9))
        return p.select(*self.by, "term", "doc_id", (idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * norm)).alias("w"))

    def save(self, path: str) -> None:
        self.postings.repartition(*self.by, "term").sortWithinPartitions(*self.by, "term").write.mode("overwrite").parquet(f"{path}/postings")
        for name in ("doc_stats", "corpus_stats", "df"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def open(spark: SparkSession, path: str, by: tuple[str, ...] = ()) -> Bm25Index:
        return Bm25Index(*[spark.read.parquet(f"{path}/{n}") for n in ("postings", "doc_stats", "corpus_stats", "df")], by)


def build(documents: DataFrame, by: tuple[str, ...] = ()) -> Bm25Index:
    """documents: by, doc_id, title, text. A title counts again beside the text that holds it already."""
    cols = list(by)
    docs = documents.select(*cols, "doc_id", tokens(F.concat_ws("\n", F.nullif("title", F.lit("")), "text")).alias("tokens")).select(*cols, "doc_id", "tokens", F.size("tokens").alias("dl"))
    doc_stats = docs.select(*cols, "doc_id", F.col("dl").cast("long").alias("dl"))
    corpus_stats = doc_stats.groupBy(*cols).agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    postings = docs.select(*cols, "doc_id", "dl", F.explode("tokens").alias("term")).groupBy(*cols, "doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    return Bm25Index(postings, doc_stats, corpus_stats, postings.groupBy(*cols, "term").agg(F.count("*").alias("df")), by, docs.drop("dl"))


def _store(docs: DataFrame, by: list[str], k: int) -> str:
    """Writes docs (by, doc_id, tokens) as blocks with their postings in order of term and document; the folder. A document
    stands for all of the same tokens: copies is their number, same has the first k ids in order, more than a list can hold."""

    def block(g: str, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        same = pa.concat_arrays([p.column("same") for p in parts])
        dl = np.concatenate([np.diff(p.column("tokens").offsets.to_numpy()) for p in parts]).astype("i4")
        terms = pa.concat_arrays([p.column("tokens").flatten() for p in parts]).dictionary_encode()
        key, tf = np.unique(terms.indices.to_numpy().astype(np.int64) * len(dl) + np.repeat(np.arange(len(dl)), dl), return_counts=True)
        starts = np.searchsorted(key, np.arange(len(terms.dictionary) + 1) * len(dl)).astype("i4")
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        copies = np.concatenate([p.column("copies").to_numpy() for p in parts])
        raw = [pa.array([x.astype("i4").tobytes()], pa.binary()) for x in (np.diff(same.offsets.to_numpy()), copies, dl, starts, key % len(dl), tf)]
        return pa.RecordBatch.from_arrays([pa.array([g]), pa.array([len(dl)], pa.int32()), one(same.flatten()), one(terms.dictionary), *raw], names=["g", "n", "ids", "terms", "held", "copies", "dl", "starts", "docs", "tf"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, held, size, rows = None, [], 0, 0
        for b in batches:
            keys = b.column("g").to_pylist()
            for s, e in runs(keys):
                if held and keys[s] != g:
                    yield block(g, held)
                    held, size, rows = [], 0, 0
                g = keys[s]
                while s < e:
                    rest = b.slice(s, e - s)
                    ends = rest.column("tokens").offsets.to_numpy()[1:] - rest.column("tokens").offsets[0].as_py()
                    n = min(len(rest), BLOCK_DOCS - rows, max(1, int(np.searchsorted(ends, BLOCK_TOKENS - size, "right"))))
                    held.append(rest.slice(0, n))
                    size, rows, s = size + int(ends[n - 1]), rows + n, s + n
                    if size >= BLOCK_TOKENS or rows >= BLOCK_DOCS or n < len(rest):
                        yield block(g, held)
                        held, size, rows = [], 0, 0
        if held:
            yield block(g, held)

    ids = docs.schema["doc_id"].dataType.simpleString()
    # documents without tokens are no hits and need no ids, however many they are
    bags = docs.groupBy(*by, F.sort_array("tokens").alias("tokens")).agg(F.count("*").cast("int").alias("copies"), F.min("doc_id").alias("first"), F.slice(F.sort_array(F.collect_list(F.when(F.size("tokens") > 0, F.col("doc_id")))), 1, k).alias("same"))
    rows = bags.select(scan.group_key(by).alias("g"), *by, "first", "copies", "same", "tokens").sort(*by, "first").select("g", "copies", "same", "tokens")
    return written(rows.mapInArrow(pack, f"g string, n int, ids array<{ids}>, terms array<string>, held binary, copies binary, dl binary, starts binary, docs binary, tf binary"), "postings", {"parquet.block.size": str(16 << 20)})


def _ints(cell) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), "i4").astype(np.int64)


def _summed(rough: np.ndarray, rows: list[list[int]], sums: list[np.ndarray], s: np.ndarray) -> None:
    """s[j]: the sum of the rows of `rough` that rows[j] names, 0 for none. What a query has in common with the one before, from
    the first row on, is not added up again: sums[i], room that is used again, has the sum of the first i + 2 rows."""
    before: list[int] = []
    for j, own in enumerate(rows):
        same = 0
        while same < min(len(own), len(before)) and own[same] == before[same]:
            same += 1
        for i in range(max(same, 1), len(own)):
            if len(sums) < i:
                sums.append(np.empty_like(rough[0]))
            np.add(rough[own[0]] if i == 1 else sums[i - 2], rough[own[i]], out=sums[i - 1])
        s[j] = sums[len(own) - 2] if len(own) > 1 else rough[own[0] if own else -1]
        before = own


def _best(folder: str, g: str, asked: list[tuple[int, ...]], terms: list[str], k: int, k1: float, b: float) -> list[Best]:
    """The best documents, of those stored, for each of the asked sets of terms (places in `terms`), by tiles of TILE."""
    df, n, length = np.zeros(len(terms)), 0, 0
    place = {t: i for i, t in enumerate(terms)}
    known = lambda x: [(i, place[t]) for i, t in enumerate(x["terms"].values.to_pylist()) if t in place]
    for x in blocks(folder, g, ["terms", "copies", "dl", "starts", "docs"]):
        copies, starts = _ints(x["copies"]), _ints(x["starts"])
        n, length, many = n + int(copies.sum()), length + int((_ints(x["dl"]) * copies).sum()), np.r_[0, np.cumsum(copies[_ints(x["docs"])])]
        for i, t in known(x):
            df[t] += many[starts[i + 1]] - many[starts[i]]
    idf, mean = np.log(1 + (n - df + 0.5) / (df + 0.5)), max(length / max(n, 1), 1e-9)
    tiles = [asked[s : s + TILE] for s in range(0, len(asked), TILE)]
    best = [Best(len(t), k) for t in tiles]
    errors = [np.array([(len(q) + 4) * 2.0**-23 * (k1 + 1) * idf[list(q)].sum() for q in t]) for t in tiles]
    at = 0
    for x in blocks(folder, g, ["n", "terms", "dl", "starts", "docs", "tf"]):
        m, dl, starts, docs, tf = x["n"].as_py(), *(_ints(x[c]) for c in ("dl", "starts", "docs", "tf"))
        norm = k1 * (1 - b + b * dl / mean)
        thick, thin = {}, {}
        for i, t in known(x):
            d, f = docs[starts[i] : starts[i + 1]], tf[starts[i] : starts[i + 1]]
            (thick if t < ROWS and len(d) * DENSE >= m else thin)[t] = (d, idf[t] * (f * (k1 + 1)) / (f + norm[d]))
        exact = np.zeros((len(thick) + 1, m))  # the last row stands for no term
        row = {}
        for j, (t, (d, w)) in enumerate(thick.items()):
            exact[j, d], row[t] = w, j
        rough, few, sums = exact.astype("f4"), {t: (d, w.astype("f4")) for t, (d, w) in thin.items()}, []
        for t, top, error in zip(tiles, best, errors):
            s = np.empty((len(t), m), "f4")
            rows = [[row[z] for z in q if z in row] for q in t]
            rare = [[z for z in q if z in few] for q in t]
            _summed(rough, rows, sums, s)
            for j, other in enumerate(rare):
                for z in other:
                    d, w = few[z]
                    s[j, d] += w
            # no document without a term, whatever the limit
            r, c = over(s, np.maximum(limits(s, top.floor, k, error), np.float32(1e-30)))
            if not len(r):
                continue
            wide = np.full((len(t), max(1, max(map(len, rows)))), len(exact) - 1)
            for j, own in enumerate(rows):
                wide[j, : len(own)] = own
            score = np.zeros(len(r))
            for a in range(0, len(r), 100_000):
                score[a : a + 100_000] = exact[wide[r[a : a + 100_000]], c[a : a + 100_000, None]].sum(1)
            if any(rare):
                order = np.argsort(r, kind="stable")
                cut = np.searchsorted(r[order], np.arange(len(t) + 1))
                for j in np.flatnonzero(np.diff(cut)):
                    own = order[cut[j] : cut[j + 1]]
                    for z in rare[j]:
                        d, w = thin[z]
                        p = np.minimum(np.searchsorted(d, c[own]), len(d) - 1)
                        score[own] += np.where(d[p] == c[own], w[p], 0)
            top.add(r, at + c, score)
        at += m
    for top in best:
        top.merge()
    return best


def _apart(folder: str, g: str, r: np.ndarray, i: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(query, id, score) of the best k documents, from the best k stored ones: r rises, within it the score falls."""
    wanted, got, counts, at = np.unique(i), [], [], 0
    for x in blocks(folder, g, ["n", "ids", "held"]):
        n, held = x["n"].as_py(), _ints(x["held"])
        a, z = np.searchsorted(wanted, (at, at + n))
        if z > a:
            own = wanted[a:z] - at
            many, begin = held[own], np.r_[0, np.cumsum(held)][own]
            got.append(x["ids"].values.take(pa.array(np.repeat(begin - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum()))))
            counts.append(many)
        at += n
    ids, many = pa.concat_arrays(got), np.concatenate(counts)
    begin, place, s9 = np.r_[0, np.cumsum(many)[:-1]], np.empty(len(ids), np.int64), nine(s)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    own = np.searchsorted(wanted, i)
    # out: what has k documents of better scores before it
    before = np.r_[0, np.cumsum(many[own])[:-1]]
    level = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (s9[1:] != s9[:-1])])
    query = np.searchsorted(r, r)  # the first row of the same query
    level = np.repeat(level, np.diff(np.r_[level, len(r)]))
    keep = before[level] - before[query] < k
    r, s, s9, own = r[keep], s[keep], s9[keep], own[keep]
    times = many[own]
    row = np.repeat(np.arange(len(r)), times)
    d = np.repeat(begin[own] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(len(row))
    o = np.lexsort((place[d], -s9[row], r[row]))
    row, d = row[o], d[o]
    r = r[row]
    first = np.flatnonzero(np.arange(len(r)) - np.searchsorted(r, r) < k)
    return r[first], ids.take(pa.array(d[first])), s[row[first]]


def lists(index: Bm25Index, queries: DataFrame, k: int = 100, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """search() in the form of scan.nearest."""
    by, docs = list(index.by), index.texts()
    folder = _store(docs, by, k)

    def run(t: pa.Table, g: str) -> Iterator[pa.RecordBatch]:
        own = t.column("terms").to_pylist()
        # terms of many queries first, and queries in order of their terms: neighbours begin alike, which is added up once
        many = Counter(z for q in set(map(tuple, own)) for z in q)
        terms = sorted(many, key=lambda z: (-many[z], z))
        place = {z: i for i, z in enumerate(terms)}
        each = [tuple(sorted(place[z] for z in q)) for q in own]
        sets = {q: i for i, q in enumerate(sorted(set(each)))}
        which = np.array([sets[q] for q in each])
        best = _best(folder, g, list(sets), terms, k, k1, b)
        r = np.concatenate([top.r + TILE * j for j, top in enumerate(best)])
        i, s = np.concatenate([top.i for top in best]), np.concatenate([top.s for top in best])
        if not len(r):
            return
        r, ids, s = _apart(folder, g, r, i, s, k)
        start = np.searchsorted(r, np.arange(len(sets) + 1))
        for a in range(0, len(which), 4096):
            w = which[a : a + 4096]
            many = start[w + 1] - start[w]
            pick = np.repeat(start[w] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            yield from emitted(t, by, np.repeat(np.arange(a, a + len(w)), many), pick, s[pick], lambda p: ids.take(pa.array(p)))

    asked = queries.select(*by, "query_id", F.array_distinct(tokens(F.col("text"))).alias("terms")).where(F.size("terms") > 0)
    asked = asked.withColumn("terms", F.sort_array("terms"))
    return scan.mapped(asked, folder, by, max(256, min(16_384, scan.HELD_HITS // max(1, k))), docs.schema["doc_id"].dataType.simpleString(), run, "n", "terms")


def search(index: Bm25Index, queries: DataFrame, k: int = 100, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """(by, query_id, doc_id, score, rank): queries has by, query_id, text."""
    return scan.hits(lists(index, queries, k, k1, b))
