"""Registered queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import byte_tokens
from rankloom.llm import mixing, neighbours, packing, sentences, topn
from rankloom.operators import dense
from rankloom.session import materialize


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.mutual_pairs(_t(spark, sf, "dense_index"), _t(spark, sf, "dense_queries")).select("vec_a", "vec_b")


def p2_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    index, queries = (_t(spark, sf, t) for t in ("dense_index", "dense_queries"))
    return neighbours.neighbour_rows(neighbours.lists(index, queries, frozenset({"ii", "qi"}), 10, neighbours.SearchParameters()))


def p2_neighbours_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Per model the queries (vectors whose id is divisible by 20) that have an index vector beside them, and whether the lists
    of p2_neighbours hold at least 0.9 of their ten nearest by exact search."""
    index, queries = (neighbours.valid_vectors(_t(spark, sf, t), 64, t == "dense_queries") for t in ("dense_index", "dense_queries"))
    vector = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    ready = lambda df, key: df.select("model_id", F.col("vec_id").alias(key), vector.alias("v")).distinct().withColumn("_n", norm).withColumn("v", F.transform("v", lambda x: x / F.col("_n"))).drop("_n")
    asked = materialize(ready(index.unionByName(queries).where("vec_id % 20 = 0"), "query_id"), "nn-asked")
    exact = dense.flat(ready(index, "doc_id"), asked, 10, ["model_id"], exclude_self=True).select("model_id", F.col("query_id").alias("vec_id"), F.col("doc_id").alias("neighbour"))
    found = p2_neighbours(spark, sf).where("vec_id % 20 = 0").select("model_id", "vec_id", "neighbour", F.lit(1).alias("hit"))
    return exact.join(found, ["model_id", "vec_id", "neighbour"], "left").groupBy("model_id").agg(F.count_distinct("vec_id").alias("queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("recall_kept"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return topn.top_n(_t(spark, sf, "hits"), ["system", "query_id"], "doc_id", "score", 10).select("system", "query_id", "doc_id", "place")


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    limits = _t(spark, sf, "seq_limits").select("model_id", F.col("capacity_tokens").alias("capacity"))
    return packing.pack(_t(spark, sf, "documents").select("doc_id", byte_tokens(F.col("text")).alias("size")), limits)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that the packing had to spread over several sequences: their second piece has a sequence of its own."""
    return _packed(spark, sf).where("piece = 1").select("model_id", "doc_id").distinct()


def p6_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf)


def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every document without its sequence: what the packing must cover, each token once."""
    return _packed(spark, sf).select("model_id", F.col("capacity").cast("long").alias("capacity"), "doc_id", F.col("piece").cast("long").alias("piece"), "start", "length")


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf))


def p6_kept(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packing_kept(_packed(spark, sf), 0.95)


def _mixture(spark: SparkSession, sf: str) -> mixing.Mixture:
    return mixing.mix(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf).sources.where("short").select("recipe", "source").distinct()


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    m = _mixture(spark, sf)
    return m.report(m.selection())


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf).selection()


def p7_shares_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each source that can reach its target does, within 1 % or one document of its average size, and whether any
    other is used up; whether copies stay within max_repeats."""
    m = _mixture(spark, sf)
    picked = materialize(m.selection(), "mix-picked")
    most = picked.groupBy("recipe", "source").agg(F.max("copies").alias("most"))
    one = m.documents.groupBy("source").agg(F.avg("size").alias("one"))
    r = m.report(picked).join(most, ["recipe", "source"], "left").join(one, "source", "left")
    goal = F.least(F.col("target"), F.col("available") * F.col("max_repeats"))
    near = F.abs(F.col("reached") - goal) <= F.greatest(0.01 * goal, F.coalesce("one", F.lit(0)))
    return r.select("recipe", "source", "available", F.round("target", 3).alias("target"), F.when(F.col("short"), F.col("reached") == F.col("available") * F.col("max_repeats")).otherwise(near).alias("share_kept"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("cap_kept"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentences(_t(spark, sf, "documents"), with_text=False).distinct()


def p8_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentences(_t(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_neighbours, p2_neighbours_kept, p5_found, p6_found, p6_sequences, p6_pieces, p6_fill, p6_kept, p7_found, p7_shares, p7_mixture, p7_shares_kept, p8_found, p8_sentences)}

_VALID = """SELECT vec_id, model_id, embedding::DOUBLE[] AS e FROM {} WHERE vec_id IS NOT NULL AND model_id IS NOT NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"""

_PIECES = """
WITH p AS (SELECT model_id, capacity_tokens::BIGINT AS capacity, doc_id, strlen(text) AS size, unnest(range(0, (strlen(text) + capacity_tokens - 1) // capacity_tokens)) AS piece
  FROM documents, (SELECT DISTINCT model_id, capacity_tokens FROM seq_limits WHERE capacity_tokens > 0 AND model_id IS NOT NULL) WHERE strlen(text) > 0)
"""
_MIX = r"""
WITH t AS (SELECT DISTINCT recipe, lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS source, weight, max_repeats, size_factor FROM mix_targets WHERE weight IS NOT NULL),
d AS (SELECT lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS source, sum(strlen(text)) AS tokens FROM documents GROUP BY 1),
j AS (SELECT t.*, coalesce(d.tokens, 0) AS tokens, sum(weight) OVER w AS ws, sum(coalesce(d.tokens, 0)) OVER w AS total FROM t LEFT JOIN d USING (source) WINDOW w AS (PARTITION BY recipe))
"""

SQL = {
    "p2_found": f"""
WITH i AS (SELECT DISTINCT * FROM ({_VALID.format("dense_index")})), q AS (SELECT DISTINCT * FROM ({_VALID.format("dense_queries")})),
ii AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM i a JOIN i b ON a.model_id = b.model_id AND a.vec_id <> b.vec_id),
qi AS (SELECT q.vec_id AS a, i.vec_id AS b, list_cosine_similarity(q.e, i.e) AS s FROM q JOIN i USING (model_id)),
r AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM ii
  UNION ALL SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) FROM qi
  UNION ALL SELECT b, a, s, row_number() OVER (PARTITION BY b ORDER BY s DESC, a) FROM qi)
SELECT DISTINCT least(x.a, x.b) AS vec_a, greatest(x.a, x.b) AS vec_b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.k <= 10 AND y.k <= 10 AND x.s >= 0.9""",
    "p2_neighbours_kept": f"""
WITH i AS (SELECT DISTINCT vec_id, model_id FROM ({_VALID.format("dense_index")})), q AS (SELECT * FROM i UNION SELECT DISTINCT vec_id, model_id FROM ({_VALID.format("dense_queries")}))
SELECT model_id, count(DISTINCT vec_id) AS queries, true AS recall_kept FROM q WHERE vec_id % 20 = 0 AND EXISTS (SELECT 1 FROM i WHERE i.model_id = q.model_id AND i.vec_id <> q.vec_id) GROUP BY 1""",
    "p5_found": """
WITH best AS (SELECT system, query_id, doc_id, max(score) AS score FROM hits
  WHERE system IS NOT NULL AND query_id IS NOT NULL AND doc_id IS NOT NULL AND score IS NOT NULL AND isfinite(score) GROUP BY ALL)
SELECT system, query_id, doc_id, place FROM (
  SELECT system, query_id, doc_id, row_number() OVER (PARTITION BY system, query_id ORDER BY score DESC, doc_id) AS place FROM best) WHERE place <= 10""",
    "p6_found": "SELECT DISTINCT model_id, doc_id FROM documents, seq_limits WHERE strlen(text) > capacity_tokens",
    "p6_pieces": _PIECES + "SELECT model_id, capacity, doc_id, piece, piece * capacity AS start, least(capacity, size - piece * capacity) AS length FROM p",
    "p6_kept": _PIECES + "SELECT model_id, capacity, count(*) AS pieces, sum(least(capacity, size - piece * capacity))::BIGINT AS tokens, true AS fits, true AS filled FROM p GROUP BY 1, 2",
    "p7_found": _MIX + "SELECT DISTINCT recipe, source FROM j WHERE tokens * max_repeats < weight / ws * size_factor * total",
    "p7_shares_kept": _MIX + "SELECT recipe, source, tokens::BIGINT AS available, round(weight / ws * size_factor * total, 3) AS target, true AS share_kept, true AS cap_kept FROM j",
}
