"""nDCG, recall, MRR and MAP of rankings against judgements.

Everything is one aggregation per query over the judged hits: joins on the pair, sums over ranks. A query with judgements
and no hit counts 0; a query without judgements is skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_query(rankings: DataFrame, qrels: DataFrame, query: list[str], over: list[str] | None = None, k: int = 10, depth: int = 100) -> DataFrame:
    """(over, query, ndcg_at_10, recall_at_100, mrr_at_10, map_at_100).

    rankings: over, query, doc_id, rank. qrels: query, doc_id, rel. over: columns of rankings, such as a system, each value
    of which is scored on all judged queries."""
    over = over or []
    judged = qrels.where("rel > 0")
    ideal_rank = F.row_number().over(Window.partitionBy(*query).orderBy(F.desc("rel"), "doc_id"))
    ideal = judged.withColumn("r", ideal_rank).groupBy(*query).agg(F.sum(F.when(F.col("r") <= k, (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("r") + 1))).alias("idcg"), F.count("*").alias("relevant"))
    hits = rankings.where(F.col("rank") <= depth).select(*over, *query, "doc_id", "rank").join(judged, [*query, "doc_id"])
    running = Window.partitionBy(*over, *query).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = hits.withColumn("found", F.count("*").over(running)).groupBy(*over, *query).agg(
        F.sum(F.when(F.col("rank") <= k, (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.count("*").alias("hits"), F.min(F.when(F.col("rank") <= k, F.col("rank"))).alias("first"), F.sum(F.col("found") / F.col("rank")).alias("precision"))
    base = ideal if not over else rankings.select(*over).distinct().crossJoin(ideal)  # systems times judged queries: the result itself
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return base.join(found, [*over, *query], "left").select(
        *over, *query, zero(F.col("dcg") / F.col("idcg")).alias("ndcg_at_10"), zero(F.col("hits") / F.col("relevant")).alias("recall_at_100"),
        zero(1 / F.col("first")).alias("mrr_at_10"), zero(F.col("precision") / F.least(F.col("relevant"), F.lit(depth))).alias("map_at_100"))


METRICS = ("ndcg_at_10", "recall_at_100", "mrr_at_10", "map_at_100")


def means(scores: DataFrame, over: list[str] | None = None) -> DataFrame:
    """Mean of each metric over the evaluated queries, 0 if there are none, and their number."""
    return scores.groupBy(*(over or [])).agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS], F.count("*").alias("queries"))
