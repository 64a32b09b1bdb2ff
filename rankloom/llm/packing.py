"""Filling fixed-capacity containers: texts into sequences of a token capacity.

Method: cost-balanced packing. The cost of an item is linear plus quadratic in its length (attention); items go in
descending order to the sequence of lowest cost that has room. A sequence is opened only when no sequence has room; at the
end, the emptiest sequences are dissolved as far as their items fit elsewhere.

Items are spread over blocks by a hash of their id; a block is about BLOCK_SEQUENCES sequences and at most BLOCK_ITEMS items
on average and is packed in one task, so no task ever sees more than its block, and only the last few sequences of a block
lack tokens. An item longer than the capacity is cut into full sequences of its own and a rest that is packed like an item.

Defined results for odd input: null and empty texts are no items (size 0); a null, zero or negative capacity means no
limit and gives no rows; repeated rows of a limit count once, several capacities of a model are packed apart; equal sizes are ordered by id; repeated ids are items each;
an empty table gives an empty result. Only the named columns are read, so extra columns never clash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_SEQUENCES = 512
BLOCK_ITEMS = 20_000


def cost(length: np.ndarray, quadratic: float) -> np.ndarray:
    """Estimated compute of a text: linear layers plus attention within the text."""
    length = np.asarray(length, dtype=np.float64)
    return length + quadratic * length * length


def pack_block(sizes: np.ndarray, capacity: int, quadratic: float = 1 / 2048) -> np.ndarray:
    """The sequence number of each item; sizes are descending and at most the capacity."""
    n = len(sizes)
    seq = np.full(n, -1, dtype=np.int64)
    start = max(1, math.ceil(sizes.sum() / capacity))
    room = np.full(n + start, capacity, dtype=np.int64)
    load = np.zeros(n + start)
    costs = cost(sizes, quadratic)
    opened = start
    for i in range(n):
        size = sizes[i]
        fits = np.where(room[:opened] >= size, load[:opened], np.inf)
        k = int(np.argmin(fits)) if opened else 0
        if fits[k] == np.inf:
            k = opened
            opened += 1
        seq[i] = k
        room[k] -= size
        load[k] += costs[i]
    _dissolve(seq, sizes, room, opened, capacity)
    used, seq = np.unique(seq, return_inverse=True)
    return seq


def _dissolve(seq: np.ndarray, sizes: np.ndarray, room: np.ndarray, opened: int, capacity: int) -> None:
    """Empties sequences, emptiest first, whose items all fit into the tightest gaps of others."""
    by_seq: dict[int, list[int]] = {}
    for i, s in enumerate(seq):
        by_seq.setdefault(int(s), []).append(i)
    free = room[:opened].copy()
    free[[k for k in range(opened) if k not in by_seq]] = -1
    for k in sorted(by_seq, key=lambda k: -free[k]):
        if free[k] <= 0:
            break
        trial, moves = free.copy(), []
        trial[k] = -1
        for i in by_seq[k]:
            gaps = np.where(trial >= sizes[i], trial, capacity + 1)
            j = int(np.argmin(gaps))
            if gaps[j] > capacity:
                break
            trial[j] -= sizes[i]
            moves.append((i, j))
        else:
            free = trial
            for i, j in moves:
                seq[i] = j
                by_seq[j].append(i)
            by_seq[k] = []


def pack(items: DataFrame, limits: DataFrame, quadratic: float = 1 / 2048, block_sequences: int = BLOCK_SEQUENCES, block_items: int = BLOCK_ITEMS, seed: int = 17) -> DataFrame:
    """(model_id, capacity, sequence, doc_id, piece, pieces, start, length): every token of every item once per model and
    capacity.

    items: doc_id, size. limits: model_id, capacity. `sequence` is unique within a model; start and length are token
    offsets into the item."""
    caps = limits.select("model_id", F.col("capacity").cast("long").alias("cap")).where("model_id is not null and cap > 0").distinct()
    items = items.select("doc_id", F.col("size").cast("long").alias("size")).where("size > 0")
    each = items.crossJoin(F.broadcast(caps))  # a few models: a fixed table, not a pairing of items
    each = each.withColumn("full", F.floor(F.col("size") / F.col("cap"))).withColumn("rest", F.col("size") % F.col("cap"))
    each = each.withColumn("pieces", (F.col("full") + (F.col("rest") > 0).cast("long")).cast("int"))
    name = F.concat_ws(":", F.lit("f"), F.col("cap").cast("string"), F.xxhash64("doc_id").cast("string"), F.col("doc_id").cast("string"), F.col("piece").cast("string"))
    whole = each.where("full > 0").select("model_id", "cap", "doc_id", "pieces", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"))
    whole = whole.select("model_id", F.col("cap").alias("capacity"), name.alias("sequence"), "doc_id", F.col("piece").cast("int").alias("piece"), "pieces", (F.col("piece") * F.col("cap")).alias("start"), F.col("cap").alias("length"))
    rest = each.where("rest > 0").select("model_id", "cap", "doc_id", "pieces", (F.col("pieces") - 1).alias("piece"), (F.col("full") * F.col("cap")).alias("start"), F.col("rest").alias("length"))
    totals = rest.groupBy("model_id", "cap").agg(F.sum("length").alias("tokens"), F.count("*").alias("n")).select(
        "model_id", "cap", F.greatest(F.lit(1), F.ceil(F.col("tokens") / (F.col("cap") * block_sequences)), F.ceil(F.col("n") / block_items)).alias("blocks"))
    placed = rest.join(F.broadcast(totals), ["model_id", "cap"]).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        cap = int(pdf["cap"].iloc[0])
        seq = pack_block(pdf["length"].to_numpy(np.int64), cap, quadratic)
        pdf["sequence"] = [f"p:{cap}:{b}:{s}" for b, s in zip(pdf["block"], seq)]
        return pdf.rename(columns={"cap": "capacity"})[["model_id", "capacity", "sequence", "doc_id", "piece", "pieces", "start", "length"]]

    kind = items.schema["doc_id"].dataType.simpleString()
    packed = placed.groupBy("model_id", "cap", "block").applyInPandas(run, f"model_id string, capacity long, sequence string, doc_id {kind}, piece int, pieces int, start long, length long")
    return whole.unionByName(packed)


def fill_report(packed: DataFrame) -> DataFrame:
    """(model_id, capacity, items, sequences, tokens, unused, fill): how full the sequences are."""
    per = packed.groupBy("model_id", "capacity", "sequence").agg(F.sum("length").alias("t"), F.count("*").alias("c"))
    return (
        per.groupBy("model_id", "capacity").agg(F.sum("c").alias("items"), F.count("*").alias("sequences"), F.sum("t").alias("tokens"))
        .select("model_id", "capacity", "items", "sequences", "tokens", (F.col("sequences") * F.col("capacity") - F.col("tokens")).alias("unused"), F.round(F.col("tokens") / (F.col("sequences") * F.col("capacity")), 6).alias("fill"))
    )


def packing_kept(packed: DataFrame, least_fill: float) -> DataFrame:
    """(model_id, capacity, pieces, tokens, fits, filled): counts over all sequences, whether none exceeds its capacity, and
    whether the share of used tokens reaches least_fill or no better filling with whole sequences exists."""
    per = packed.groupBy("model_id", "capacity", "sequence").agg(F.sum("length").alias("t"), F.count("*").alias("c"))
    tokens = F.sum("t")
    return per.groupBy("model_id", "capacity").agg(
        F.sum("c").alias("pieces"), tokens.alias("tokens"), F.bool_and(F.col("t") <= F.col("capacity")).alias("fits"),
        ((tokens >= least_fill * F.count("*") * F.col("capacity")) | (F.count("*") <= F.ceil(tokens / F.col("capacity")) + 1)).alias("filled"))
