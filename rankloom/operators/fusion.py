"""Reciprocal rank fusion: a union and one sum, no join. Of lists, it is done batch by batch where the lists arrive."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rankloom.operators.topk import ranked

# The parts of each hybrid system.
SYSTEMS = {
    "hybrid-rrf-bm25-dense": ("sparse", "dense"),
    "hybrid-rrf-bm25-li": ("sparse", "li"),
    "hybrid-rrf-dense-li": ("dense", "li"),
    "hybrid-rrf-bm25-dense-li": ("sparse", "dense", "li"),
}


def rrf(components: list[DataFrame], group: list[str], item: str = "doc_id", constant: int = 60, depth: int = 100, k: int = 100) -> DataFrame:
    """Components have group, item and rank; each is cut at depth."""
    parts = [c.where(F.col("rank") <= depth).select(*group, item, (1.0 / (constant + F.col("rank"))).alias("s")) for c in components]
    total = reduce(DataFrame.unionByName, parts).groupBy(*group, item).agg(F.sum("s").alias("score"))
    return ranked(total, group, "score", [item], k)


#: Entries of lists, about, that are fused at once.
FUSED = 262_144


def _order(*keys: np.ndarray) -> np.ndarray:
    """Order by keys (whole numbers from 0), the first first, equal ones as they stand: one sort of packed numbers if they fit."""
    n, bits = len(keys[0]), [int(k.max()).bit_length() for k in keys]
    own = max(1, (n - 1).bit_length())
    if sum(bits) + own > 63:
        return np.lexsort(keys[::-1])
    packed = np.zeros(n, np.int64)
    for k, b in zip(keys, bits):
        packed = packed << b | k
    return np.sort(packed << own | np.arange(n)) & ((1 << own) - 1)


def _rounded(s: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's round: halves of the number as it is written go up."""
    y = s * 10.0**digits
    out = np.floor(y + 0.5) / 10.0**digits
    near = np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-4)
    if len(near):
        values, at = np.unique(s[near], return_inverse=True)
        unit = Decimal(1).scaleb(-digits)
        out[near] = np.array([float(Decimal(repr(float(v))).quantize(unit, ROUND_HALF_UP)) for v in values])[at]
    return out


def _fuse(t: pa.Table, other: str | None, every: pa.Array | None, k: int, constant: int, digits: int | None) -> pa.Table:
    """The fused lists of whole queries, as rows. t: (other), query_id, docs; equal query_ids are neighbours."""
    docs = t.column("docs").combine_chunks()
    counts, ids = np.diff(docs.offsets.to_numpy()).astype(np.int64), docs.flatten().dictionary_encode()
    sort = pc.sort_indices(ids.dictionary).to_numpy()
    place = np.empty(len(sort), np.int64)
    place[sort] = np.arange(len(sort))
    code = place[ids.indices.to_numpy()]
    names = t.column("query_id").combine_chunks()
    number = names.dictionary_encode().indices.to_numpy()
    first = np.r_[True, number[1:] != number[:-1]]
    group, rows, most = np.cumsum(first) - 1, np.arange(len(counts)), 1
    if other is not None:
        col = t.column(other).combine_chunks()
        values = pc.unique(pa.concat_arrays([*([every] if every is not None else [pa.array([None], col.type)] if col.null_count else []), col.drop_null()]))
        most, own = max(1, len(values)), pc.fill_null(pc.index_in(col, values), 0).to_numpy().astype(np.int64)
        if every is not None:
            times = np.where(col.is_null().to_numpy(zero_copy_only=False), len(every), 1)
            rows = np.repeat(rows, times)
            own = own[rows] + np.arange(len(rows)) - np.repeat(np.r_[0, np.cumsum(times)[:-1]], times)
        group = group[rows] * most + own
    many, begin = counts[rows], np.r_[0, np.cumsum(counts)[:-1]][rows]
    p = np.arange(many.sum()) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many)
    g, c, part = np.repeat(group, many), code[np.repeat(begin, many) + p], 1.0 / (constant + 1 + p)
    o = _order(g, c)
    g, c, part = g[o], c[o], part[o]
    start = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])]) if len(g) else np.zeros(0, np.int64)
    score = np.add.reduceat(part, start) if len(start) else np.zeros(0)
    g, c = g[start], c[start]
    if len(g):
        nine = np.floor(score * 1e9 + 0.5).astype(np.int64)
        o = _order(g, nine.max() - nine)  # equal ones are in order of doc_id
        g, c, score = g[o], c[o], score[o]
    rank = np.arange(len(g)) - np.searchsorted(g, g)
    keep = np.flatnonzero(rank < k)
    g, c, score, rank = g[keep], c[keep], score[keep], rank[keep]
    own = [values.take(pa.array(g % most))] if other is not None else []
    shown = score if digits is None else _rounded(score, digits)
    columns = [*own, names.take(pa.array(np.flatnonzero(first)[g // most])), pa.array(rank + 1), ids.dictionary.take(pa.array(sort[c])), pa.array(shown)]
    return pa.table(columns, names=[*([other] if other is not None else []), "query_id", "rank", "doc_id", "score"])


def rrf_lists(components: list[DataFrame], group: list[str], k: int = 100, constant: int = 60, all_of: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """As rrf, of lists: components have group and docs, an array in order of rank. A list moves as one row, by query_id, and is
    fused where it arrives, without another shuffle or sort of documents. group: query_id and at most one more column.
    all_of: that column's values; a list that lacks it counts for each of them, and is repeated on arrival only. digits: of
    the score as returned; ranks do not depend on it. Columns: group, rank, doc_id, score, as they are shown, so that no row is
    copied for another order."""
    spark = components[0].sparkSession
    (other,) = [c for c in group if c != "query_id"] or [None]
    moved = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [c.withColumn("_part", F.lit(i)) for i, c in enumerate(components)])
    kinds = {f.name: f.dataType for f in moved.schema.fields}
    every = None
    if all_of is not None:
        every = pa.array([r[0] for r in all_of.distinct().collect() if r[0] is not None], to_arrow_type(kinds[other]))  # as many as there are groups of one query
    # lists of a query in one order, so that sums do not depend on arrival; enough partitions that sorting needs no disk
    moved = moved.repartition(max(96, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "query_id").sortWithinPartitions("query_id", "_part").select(*group, "docs")

    def whole(held: list[pa.RecordBatch], last: bool) -> Iterator[pa.Table]:
        """Tables of whole queries of about FUSED entries; what is left of the last query goes back to held."""
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        number = t.column("query_id").combine_chunks().dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True])
        many = np.diff(t.column("docs").combine_chunks().offsets.to_numpy()).astype(np.int64)
        if every is not None:
            many = many * np.where(t.column(other).is_null().to_numpy(), len(every), 1)
        size = np.r_[0, np.cumsum(many)][cuts]
        a, end = 0, len(cuts) - (1 if last else 2)
        while a < end:
            z = min(end, max(a + 1, int(np.searchsorted(size, size[a] + FUSED, "right")) - 1))
            yield t.slice(cuts[a], cuts[z] - cuts[a]).combine_chunks()
            a = z
        if not last:
            held.extend(t.slice(cuts[end]).combine_chunks().to_batches())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
                for t in whole(held, False):
                    yield from _fuse(t, other, every, k, constant, digits).to_batches(max_chunksize=65_536)
        if held:
            for t in whole(held, True):
                yield from _fuse(t, other, every, k, constant, digits).to_batches(max_chunksize=65_536)

    shape = ", ".join([*([f"`{other}` {kinds[other].simpleString()}"] if other is not None else []), f"query_id {kinds['query_id'].simpleString()}", f"rank long, doc_id {kinds['docs'].elementType.simpleString()}, score double"])
    return moved.mapInArrow(task, shape)
