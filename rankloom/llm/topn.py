"""Top N items within every group.

Method: partition lower bounds. Every partition reduces its rows to its own best N distinct items per group; where a
partition holds N or more items of a group, its N-th best is a valid lower bound of the group's global N-th best. The
tightest bound per group is joined back, candidates below it are dropped before the shuffle, and the survivors are ranked.

The order is total: score from high to low, equal scores by item ascending in byte order; bounds are compared in that
same order, so ties at the bound neither lose nor multiply rows. However large a group is, each partition sends at most N
of its items, and of those only what beats the best bound; repeated rows collapse before they are sent.

Defined results for odd input: rows with a null group column, a null item or a null, NaN or infinite score take no part;
an item counts once per group with its highest score; -0.0 equals 0.0; groups with fewer items give fewer rows; an empty
table gives an empty result. Only the named columns are read, so extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.session import materialize

CHUNK_ROWS = 200_000


def local_best(t: pa.Table, groups: list[str], n: int) -> pa.Table:
    """The best n distinct items of every group of t, with `nth` set on the n-th of a group."""
    code = np.zeros(t.num_rows, dtype=np.int64)
    for g in groups:
        d = t[g].combine_chunks().dictionary_encode()
        code = code * max(1, len(d.dictionary)) + d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, code = np.unique(code, return_inverse=True)
    d = t["item"].combine_chunks().dictionary_encode()
    place = np.empty(len(d.dictionary), dtype=np.int64)
    place[pc.sort_indices(d.dictionary).to_numpy()] = np.arange(len(d.dictionary))
    item = place[d.indices.to_numpy(zero_copy_only=False)]
    score = t["score"].to_numpy()

    order = np.lexsort((-score, item, code))  # best row of each (group, item) first
    first = np.ones(len(order), dtype=bool)
    first[1:] = (code[order][1:] != code[order][:-1]) | (item[order][1:] != item[order][:-1])
    order = order[first]
    order = order[np.lexsort((item[order], -score[order], code[order]))]
    c = code[order]
    start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.array([], dtype=np.int64)
    rank = np.arange(len(c)) - np.repeat(start, np.diff(np.r_[start, len(c)]))
    keep = rank < n
    return t.take(pa.array(order[keep])).select([*groups, "item", "score"]).append_column("nth", pa.array(rank[keep] == n - 1))


def partition_candidates(df: DataFrame, groups: list[str], item: str, score: str, n: int) -> DataFrame:
    """(g0.., item, score, nth): each partition's own best n items of each group."""
    names = [f"g{i}" for i in range(len(groups))]
    s = F.col(score).cast("double")
    rows = df.select(*[F.col(g).alias(a) for g, a in zip(groups, names)], F.col(item).alias("item"), (s + F.lit(0.0)).alias("score"))
    rows = rows.where(" and ".join(f"{c} is not null" for c in [*names, "item", "score"])).where(~F.isnan("score") & (F.abs("score") != F.lit(float("inf"))))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        state, size = None, 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= max(CHUNK_ROWS, state.num_rows if state is not None else 0):
                t = pa.Table.from_batches(held)
                state = local_best(t if state is None else pa.concat_tables([state.drop(["nth"]), t]), names, n)
                held, size = [], 0
        if held:
            t = pa.Table.from_batches(held)
            state = local_best(t if state is None else pa.concat_tables([state.drop(["nth"]), t]), names, n)
        if state is not None:
            yield from state.combine_chunks().to_batches(max_chunksize=50_000)

    return rows.mapInArrow(reduce, rows.selectExpr("*", "true as nth").schema)


def top_n(df: DataFrame, groups: list[str], item: str, score: str, n: int, place: str = "place") -> DataFrame:
    """groups, item, score, place (from 1): the best n items of every group."""
    names = [f"g{i}" for i in range(len(groups))]
    cand = materialize(partition_candidates(df, groups, item, score, n), "topn")
    bound = cand.where("nth").groupBy(*names).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("item").alias("i"))).alias("bound"))
    kept = cand.join(bound, names, "left").where("bound is null or -score < bound.s or (-score = bound.s and item <= bound.i)")
    best = kept.select(*names, "item", "score").repartition(*names).groupBy(*names, "item").agg(F.max("score").alias("score"))
    ranked = best.withColumn(place, F.row_number().over(Window.partitionBy(*names).orderBy(F.desc("score"), "item"))).where(F.col(place) <= n)
    return ranked.select(*[F.col(a).alias(g) for g, a in zip(groups, names)], F.col("item").alias(item), F.col("score").alias(score), place)
