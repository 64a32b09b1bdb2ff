"""Dense retrieval: exact search and the compressed indexes.

Exact search has two forms with the same result: `flat` multiplies blocks (see scan), `flat_expression` is the plain join
with array expressions, for small query sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import vectors as V
from rankloom.operators import scan
from rankloom.operators.topk import ranked

#: Most queries that a pass of by_blocks sends to all tasks at once.
QUERY_BLOCK = 50_000


# Numbers of sub-vectors, the first that fits is taken.
PQ_PARTS = (32, 24, 16, 12, 8, 6, 4, 2, 1)


def nlist(n: int) -> int:
    """Coarse lists of an inverted file over n vectors."""
    return 1 if n <= 1 else max(1, min(max(16, int(4 * math.sqrt(n))), 256, n))


def nlist_expr(n):
    return F.when(n <= 1, 1).otherwise(F.greatest(F.lit(1), F.least(F.greatest(F.lit(16), F.floor(4 * F.sqrt(n))), F.lit(256), n)))


def pq_parts(n: int, dims: int, requested: int = 32) -> int:
    """Sub-vectors of a product quantiser: the first of the choices that divides dims and has enough training vectors,
    else the first that divides dims."""
    choices = [requested, *PQ_PARTS]
    for need in (True, False):
        for m in choices:
            if m > 0 and dims % m == 0 and (not need or n >= max(256, 128 * m)):
                return m
    return 1


def pq_parts_expr(n, dims, requested: int = 32):
    choices = F.array(*[F.lit(m) for m in (requested, *PQ_PARTS)])
    divides = F.filter(choices, lambda m: dims % m == 0)
    return F.coalesce(F.try_element_at(F.filter(divides, lambda m: n >= F.greatest(F.lit(256), 128 * m)), F.lit(1)), F.try_element_at(divides, F.lit(1)), F.lit(1))


def flat_expression(corpus: DataFrame, queries: DataFrame, k: int, by: list[str], exclude_self: bool = False) -> DataFrame:
    """corpus: by, doc_id, v; queries: by, query_id, v. All query rows are scored against all corpus rows of their group."""
    c, q = corpus.select(*by, "doc_id", F.col("v").alias("dv")), queries.select(*by, "query_id", F.col("v").alias("qv"))
    pairs = c.join(q, by) if by else c.crossJoin(q)
    if exclude_self:
        pairs = pairs.where("doc_id <> query_id")
    return ranked(pairs.select(*by, "query_id", "doc_id", V.dot(F.col("qv"), F.col("dv")).alias("score")), [*by, "query_id"], "score", ["doc_id"], k)


def flat(corpus: DataFrame, queries: DataFrame, k: int, by: list[str], exclude_self: bool = False) -> DataFrame:
    """As flat_expression, by block products; ids may be of any type."""
    return scan.hits(flat_lists(corpus, queries, k, by, exclude_self))


def flat_lists(corpus: DataFrame, queries: DataFrame, k: int, by: list[str], exclude_self: bool = False) -> DataFrame:
    """flat() in the form of scan.nearest."""
    return scan.nearest(one_token(corpus), one_token(queries), k, by, exclude_self=exclude_self)


def one_token(df: DataFrame) -> DataFrame:
    return df.withColumn("tokens", F.array("v")).drop("v")


def by_blocks(queries: DataFrame, search: Callable[[DataFrame], DataFrame], block: int | None = None) -> DataFrame:
    """search() of all queries, in passes of about `block` (QUERY_BLOCK); each pass has whole queries, so results simply add up."""
    passes = max(1, math.ceil(queries.count() / (block or QUERY_BLOCK)))
    if passes == 1:
        return search(queries)
    parts = [search(queries.where(F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(passes)) == i)) for i in range(passes)]
    return reduce(DataFrame.unionByName, parts)


def binary_rerank(corpus: DataFrame, queries: DataFrame, k: int, by: list[str], dims: int, candidates: int = 1000) -> DataFrame:
    """Sign codes, the nearest candidates by Hamming distance, then exact re-ranking, by scans as in flat."""
    return scan.hits(scan.nearest_codes(one_token(corpus), one_token(queries), k, by, max(candidates, k)))
