"""Mixing sources to target weights.

Method: Sainte-Lague apportionment. The wanted total of a recipe is cut into seats, equal blocks of tokens, which go one by
one to the source with the highest quotient weight / (2 q + 1); each source's seats are apportioned to its shards in the
same way. A seat is so small that the smallest wanted share has SEATS_OF_SMALLEST of them. Within a shard, blocks of whole
documents are taken in seeded order as often as the shard's tokens go into its quota; the block in which the quota ends
is taken document by document, and what is then left is filled with the largest documents that fit; exchanges of single
documents bring it nearer; of up to FEW documents the best choice is taken. So a shard ends within half its smallest unused document of its quota, and no source with a positive target that can reach it stays empty.

A source of any size is split into shards of about SHARD_TOKENS tokens, so no task orders more than a shard; shards are
apportioned in groups of SHARD_GROUP, so no task lists all shards of a source. A source that cannot reach its target is used
max_repeats times; the others keep their targets, so the mixture is then smaller than wanted and the report says by how
much.

Defined results for odd input: source and recipe names are compared tidied, sources reported in lower case; rows with a
null weight, recipe, source or max_repeats take no part; repeated rows count once; several different rows for one source
of a recipe add their weights and use the largest max_repeats; a weight of zero or below wants nothing; a null
size_factor is 1; sources without documents have no tokens; documents with a null or blank source or a null or empty text
are in no source; repeated documents each count; empty tables give empty results. Only the named columns are read, so
extra columns never clash.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import byte_tokens, tidy_key
from rankloom.session import materialize

SHARD_TOKENS = 8_000_000
SHARD_GROUP = 1_024
BLOCK_TOKENS = 8_192
SEATS_OF_SMALLEST = 512
FEW = 16


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray | None = None) -> np.ndarray:
    """Seats by highest quotient weight / (2 q + 1); equal quotients go to the first in the list; no one beyond its cap.

    Found by search of the divisor instead of seat by seat, so that it takes the same time for any number of seats."""
    w = np.where(np.isfinite(weights) & (weights > 0), weights, 0.0).astype(np.float64)
    cap = np.full(len(w), max(int(seats), 0), dtype=np.int64) if caps is None else np.maximum(np.asarray(caps, dtype=np.int64), 0)
    cap = np.where(w > 0, cap, 0)
    seats = int(min(seats, np.minimum(cap, max(int(seats), 0)).sum())) if len(w) else 0
    if seats <= 0:
        return np.zeros(len(w), dtype=np.int64)

    def held(divisor: float) -> np.ndarray:  # seats whose quotient w / (2 q + 1) exceeds the divisor
        return np.minimum(np.ceil(np.maximum((w / divisor - 1) / 2, 0)), cap).astype(np.int64)

    lo, hi = w[w > 0].min() / (2.0 * seats + 3) / 2, w.max() * 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        if held(mid).sum() > seats:
            lo = mid
        else:
            hi = mid
    q = held(hi * (1 + 1e-9))
    for _ in range(seats - int(q.sum())):  # the last few, quotient by quotient
        q[np.argmax(np.where(q < cap, w / (2 * q + 1), -1.0))] += 1
    return q


@dataclass(frozen=True)
class Mixture:
    """sources: recipe, source, weight, max_repeats, available, target_share, target, seat (tokens), seats, wanted, short.
    shards: recipe, source, shard, wanted, times. documents: source, shard, doc_id, size."""

    sources: DataFrame
    shards: DataFrame
    documents: DataFrame
    block_tokens: int
    seed: int

    def selection(self) -> DataFrame:
        """(recipe, source, doc_id, size, copies): the mixture itself."""
        block_tokens, seed = self.block_tokens, self.seed

        def run(docs: pd.DataFrame, quotas: pd.DataFrame) -> pd.DataFrame:
            docs = docs.sort_values(["h", "doc_id", "size"], kind="stable")
            size, ids, out = docs["size"].to_numpy(np.int64), docs["doc_id"].to_numpy(), []
            for r in quotas.sort_values("recipe").itertuples(index=False):
                mark = zlib.crc32(f"{seed}\x01{r.recipe}\x01{r.source}\x01{r.shard}".encode())
                copies = choose(size, r.wanted, r.times, block_tokens, mark)
                at = np.flatnonzero(copies)
                out.append((np.full(len(at), r.recipe, dtype=object), np.full(len(at), r.source, dtype=object), ids[at], size[at], copies[at]))
            names = ("recipe", "source", "doc_id", "size", "copies")
            return pd.DataFrame({n: pd.Series(c, dtype=t) for n, c, t in zip(names, map(np.concatenate, zip(*out)) if out else [[]] * 5, (object, object, None, np.int64, np.int64))})

        kind, key = self.documents.schema["doc_id"].dataType.simpleString(), ["source", "shard"]
        docs = self.documents.withColumn("h", F.xxhash64("doc_id", F.lit(seed + 1)))
        return docs.groupBy(*key).cogroup(self.shards.where("wanted > 0").groupBy(*key)).applyInPandas(run, f"recipe string, source string, doc_id {kind}, size long, copies long")

    def report(self, selection: DataFrame) -> DataFrame:
        """sources with `reached` and `reached_share`, summed over a selection."""
        reached = selection.groupBy("recipe", "source").agg(F.sum(F.col("copies") * F.col("size")).alias("reached"))
        got = self.sources.join(reached, ["recipe", "source"], "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
        return got.withColumn("reached_share", F.try_divide("reached", F.sum("reached").over(Window.partitionBy("recipe"))))


def choose(size: np.ndarray, wanted: int, times: int, block_tokens: int, mark: int) -> np.ndarray:
    """Copies of each document of a shard, in its seeded order, that come closest to `wanted` tokens, at most `times` each."""
    of = int(size.sum())
    full = min(int(wanted // of), int(times)) if of else 0
    copies = np.full(len(size), full, dtype=np.int64)
    rest = int(wanted) - full * of
    if rest <= 0 or full >= times:
        return copies
    if len(size) <= FEW:  # every choice is tried
        sums = np.zeros(1, dtype=np.int64)
        for x in size:
            sums = np.concatenate([sums, sums + x])
        return copies + (int(np.argmin(np.abs(sums - rest))) >> np.arange(len(size)) & 1)
    block = (np.cumsum(size) - size) // block_tokens
    names, first = np.unique(block, return_index=True)
    place = np.empty(len(names), dtype=np.int64)
    place[np.random.default_rng(mark).permutation(len(names))] = np.arange(len(names))
    order = np.argsort(np.repeat(place, np.diff(np.r_[first, len(size)])), kind="stable")
    taken = int(np.searchsorted(np.cumsum(size[order]), rest, side="right"))  # whole blocks, and the head of the last one
    copies[order[:taken]] += 1
    rest -= int(size[order[:taken]].sum())
    left = order[taken:]
    left = left[np.argsort(-size[left], kind="stable")]
    falling, at = -size[left], 0
    while rest > 0:
        at = max(at, int(np.searchsorted(falling, -rest, side="left")))  # the largest that fits
        if at >= len(left):
            break
        copies[left[at]] += 1
        rest -= int(size[left[at]])
        at += 1
    unused = left[copies[left] == full]
    if len(unused) and size[unused[-1]] - rest < rest:
        copies[unused[-1]] += 1
        rest -= int(size[unused[-1]])
    _exchange(size, copies, full, rest, int(wanted) // 1000)
    return copies


def _exchange(size: np.ndarray, copies: np.ndarray, full: int, rest: int, near: int) -> None:
    """Exchanges documents with and without the extra copy, pair by pair, while that halves what is still missing or too much."""
    by_size = np.argsort(size, kind="stable")
    while abs(rest) > near:
        more = copies[by_size] > full
        has, lacks = by_size[more], by_size[~more]
        if not len(has) or not len(lacks):
            return
        wish = size[has] + rest  # the size that a substitute should have
        at = np.searchsorted(size[lacks], wish)
        at = np.stack([np.clip(at - 1, 0, len(lacks) - 1), np.clip(at, 0, len(lacks) - 1)])
        off = np.abs(size[lacks[at]] - wish)
        row, i = np.unravel_index(int(np.argmin(off)), off.shape)
        if 2 * off[row, i] > abs(rest):
            return
        old, new = has[i], lacks[at[row, i]]
        copies[old] -= 1
        copies[new] += 1
        rest -= int(size[new] - size[old])


def read_targets(targets: DataFrame) -> DataFrame:
    rows = targets.select(
        tidy_key(F.col("recipe")).alias("recipe_key"), F.col("recipe"), tidy_key(F.col("source")).alias("source"), F.col("weight").cast("double").alias("weight"),
        F.col("max_repeats").cast("long").alias("max_repeats"), F.coalesce(F.col("size_factor").cast("double"), F.lit(1.0)).alias("size_factor"))
    rows = rows.where("recipe_key is not null and source is not null and weight is not null and max_repeats is not null and not isnan(weight)")
    once = rows.groupBy("recipe_key", "source", "weight", "max_repeats", "size_factor").agg(F.min("recipe").alias("recipe"))
    per = once.groupBy("recipe_key", "source").agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("weight"), F.max("max_repeats").alias("max_repeats"), F.max("size_factor").alias("size_factor"), F.min("recipe").alias("recipe"))
    return per.withColumn("recipe", F.min("recipe").over(Window.partitionBy("recipe_key"))).drop("recipe_key")


def cut(documents: DataFrame, shard_tokens: int = SHARD_TOKENS, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(documents with source and shard; tokens per source)."""
    docs = documents.select("doc_id", tidy_key(F.col("source")).alias("source"), byte_tokens(F.col("text")).alias("size")).where("source is not null and size > 0")
    docs = materialize(docs, "mix-docs")
    tokens = materialize(docs.groupBy("source").agg(F.sum("size").alias("available")), "mix-sources", 1)
    n = F.greatest(F.lit(1), F.ceil(F.col("available") / shard_tokens))
    return docs.join(tokens, "source").withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), n)).drop("available"), tokens


def _spread(quotas: DataFrame, parts: DataFrame, key: list[str], part: str) -> DataFrame:
    """Apportions the seats of each row of quotas (recipe, key, seats, seat, max_repeats, full) to its parts (key, part, tokens)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(part, kind="stable")
        caps = np.ceil(pdf.max_repeats * pdf.tokens / pdf.seat).to_numpy(np.int64)
        return pdf.assign(seats=sainte_lague(pdf.tokens.to_numpy(np.float64), int(pdf.seats.iloc[0]), caps))

    fields = ", ".join(["recipe string", "source string", *[f"{k} long" for k in (*key[1:], part)], "seats long", "seat long", "max_repeats long", "full boolean", "tokens long"])
    names = [f.split()[0] for f in fields.split(", ")]
    met = quotas.select("recipe", *key, "seats", "seat", "max_repeats", "full").join(parts, key).select(*names)
    return met.groupBy("recipe", *key).applyInPandas(run, fields)


def mix(documents: DataFrame, targets: DataFrame, shard_tokens: int = SHARD_TOKENS, block_tokens: int = BLOCK_TOKENS, seed: int = 11) -> Mixture:
    docs, tokens = cut(documents, shard_tokens, seed)
    want = read_targets(targets).join(tokens, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    recipe = Window.partitionBy("recipe")
    want = want.withColumn("target_share", F.try_divide("weight", F.sum("weight").over(recipe))).withColumn("target", F.col("target_share") * F.col("size_factor") * F.sum("available").over(recipe))

    def to_sources(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", kind="stable")
        target, most = pdf.target.to_numpy(np.float64), np.maximum(pdf.max_repeats * pdf.available, 0).to_numpy(np.int64)
        seat = int(max(1, min(block_tokens, target[target > 0].min() // SEATS_OF_SMALLEST))) if (target > 0).any() else 1
        # as if nobody had a cap: a source that cannot reach its target leaves the others at theirs
        seats = sainte_lague(target, int(round(target.sum() / seat)))
        # the seats tell who is near its limit, the exact comparison decides
        short = ((seats + 2) * seat >= most) & (target > 0) & (most < target)
        wanted = np.where(short, most, np.minimum(seats * seat, most))
        return pdf.assign(seat=seat, seats=seats, wanted=wanted, short=short)[["recipe", "source", "weight", "max_repeats", "available", "target_share", "target", "seat", "seats", "wanted", "short"]]

    schema = "recipe string, source string, weight double, max_repeats long, available long, target_share double, target double, seat long, seats long, wanted long, short boolean"
    alloc = materialize(want.fillna(0.0, ["target", "target_share"]).groupBy("recipe").applyInPandas(to_sources, schema), "mix-alloc", 1)
    parts = docs.groupBy("source", "shard").agg(F.sum("size").alias("tokens")).withColumn("top", F.floor(F.col("shard") / SHARD_GROUP))
    tops = parts.groupBy("source", "top").agg(F.sum("tokens").alias("tokens"))
    full = F.col("wanted") >= F.col("max_repeats") * F.col("available")
    quotas = _spread(alloc.where("wanted > 0").withColumn("full", full), tops, ["source"], "top").drop("tokens")
    quotas = _spread(quotas, parts, ["source", "top"], "shard")
    most = F.col("max_repeats") * F.col("tokens")
    shards = quotas.select("recipe", "source", "shard", F.when(F.col("full"), most).otherwise(F.least(F.col("seats") * F.col("seat"), most)).alias("wanted"), F.col("max_repeats").alias("times"))
    return Mixture(alloc, shards, docs, block_tokens, seed)
