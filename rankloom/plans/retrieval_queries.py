"""Registered queries of the retrieval operators, with equal SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions import vectors as V
from rankloom.functions.text import tokens
from rankloom.operators import bm25, dense, fusion, late, metrics, quantised, scan, systems
from rankloom.operators.topk import ranked
from rankloom.session import materialize, scratch_root
from rankloom.sources import datasets, sinks

DIMS = 64


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- inputs -----------------------------------------------------------------------------------------------------------


def _live(df: DataFrame, key: str) -> DataFrame:
    """One row per key that is not deleted."""
    title = F.max("title") if "title" in df.columns else F.lit(None).cast("string")
    return df.where(f"deleted_at is null and {key} is not null").groupBy("dataset", key).agg(title.alias("title"), F.max("text").alias("text"))


def dataset(spark: SparkSession, sf: str, limit: int | None = None) -> datasets.RetrievalDataset:
    return datasets.load(
        _live(_t(spark, sf, "corpus"), "doc_id"), _live(_t(spark, sf, "queries"), "query_id").drop("title"), _t(spark, sf, "qrels").withColumn("rel0", F.col("score")),
        limit, by=("dataset",), order=[F.col("received_at"), F.col("qrel_id"), F.coalesce(F.col("score"), F.lit(1.0))])


def _is_valid():
    e = F.col("embedding")
    return F.col("vec_id").isNotNull() & F.col("model_id").isNotNull() & (F.size(e) == DIMS) & ~V.has_non_finite(e) & F.exists(e, lambda x: x != 0)


def vectors(spark: SparkSession, sf: str, table: str, key: str) -> DataFrame:
    """(model_id, key, v) of the valid vectors, each once."""
    return stored_vectors(spark, sf, table, key).withColumn("v", F.col("v").cast("array<double>"))


def stored_vectors(spark: SparkSession, sf: str, table: str, key: str) -> DataFrame:
    """As vectors, in the table's single precision and in ranges of model and key: half the bytes, and sorting moves nothing."""
    return _t(spark, sf, table).where(_is_valid()).select("model_id", F.col("vec_id").alias(key), F.col("embedding").alias("v")).repartitionByRange("model_id", key).distinct()


def _keyed(spark: SparkSession, sf: str, table: str, key: str, model: str | None = None) -> DataFrame:
    """(vec_id, model_id, key, v): each valid vector (of a model) with each key that any row of its vec_id has; in one shuffle,
    which moves no vector of another model."""
    wanted = _is_valid() if model is None else _is_valid() & (F.col("model_id") == model)
    rows = _t(spark, sf, table).where("vec_id is not null").groupBy("vec_id").agg(
        F.collect_set(key).alias("keys"), F.array_distinct(F.collect_list(F.when(wanted, F.struct("model_id", F.col("embedding").alias("v"))))).alias("own"))
    return rows.select("vec_id", F.explode("keys").alias(key), "own").select("vec_id", key, F.explode("own").alias("x")).select("vec_id", "x.model_id", key, "x.v")


def _first_vectors(spark: SparkSession, sf: str, table: str, key: str, model: str = "larkspur-small") -> DataFrame:
    """(key, v): the first valid vector of each document or query of a model."""
    own = _keyed(spark, sf, table, key, model).drop("model_id")
    return own.repartitionByRange(key).groupBy(key).agg(F.min_by("v", "vec_id").alias("v"))


def _tokens_of(spark: SparkSession, sf: str, table: str, key: str, *by: str) -> DataFrame:
    """(by, key, tokens): all valid vectors of a document or query as its token matrix."""
    return late.token_matrix(_keyed(spark, sf, table, key).repartitionByRange(*by, key), [*by, key], "v", "vec_id")


def hit_rankings(spark: SparkSession, sf: str, k: int = 100) -> DataFrame:
    """(system, dataset, query_id, doc_id, score, rank) of the written hits."""
    h = _t(spark, sf, "hits").where("system is not null and dataset is not null and query_id is not null and doc_id is not null and score is not null and not isnan(score) and abs(score) < double('infinity')")
    best = h.groupBy("system", "dataset", "query_id", "doc_id").agg(F.max("score").alias("score"))
    return ranked(best, ["system", "dataset", "query_id"], "score", ["doc_id"], k, digits=None)


# --- datasets ---------------------------------------------------------------------------------------------------------


def ds_docs(spark, sf):
    return dataset(spark, sf).documents


def ds_queries_with_qrels(spark, sf):
    return dataset(spark, sf).queries


def ds_qrels(spark, sf):
    return dataset(spark, sf).qrels


def ds_qrels_rows(spark, sf):
    return dataset(spark, sf).qrels_rows


def ds_query_limit(spark, sf):
    d = dataset(spark, sf, limit=5)
    return d.qrels.join(d.queries, ["dataset", "query_id"]).select("dataset", "query_id", "doc_id", "rel")


def ds_bright_explode(spark, sf):
    d = dataset(spark, sf)
    gold = d.qrels.groupBy("dataset", "query_id").agg(F.collect_list("doc_id").alias("gold_ids"))
    ex = _live(_t(spark, sf, "queries"), "query_id").join(gold, ["dataset", "query_id"], "left").select("dataset", F.col("query_id").alias("id"), F.col("text").alias("query"), "gold_ids")
    docs = _live(_t(spark, sf, "corpus"), "doc_id").select("dataset", F.col("doc_id").alias("id"), F.col("text").alias("content"))
    g = datasets.load_gold(ex, docs, by=("dataset",))
    return g.queries.select("dataset", "query_id").join(g.qrels, ["dataset", "query_id"], "left").select("dataset", "query_id", "doc_id", "rel")


# --- sparse -----------------------------------------------------------------------------------------------------------


def token_counts(spark, sf):
    t = _t(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


def _index(spark, sf):
    return bm25.build(dataset(spark, sf).documents, ("dataset",))


def tf(spark, sf):
    return _index(spark, sf).postings.select("dataset", "doc_id", "term", "tf")


def df(spark, sf):
    return _index(spark, sf).df


def doc_stats(spark, sf):
    return _index(spark, sf).doc_stats


def corpus_stats(spark, sf):
    return _index(spark, sf).corpus_stats.select("dataset", "n", F.round("avgdl", 6).alias("avgdl"))


def _sparse(spark, sf, k=100):
    d = dataset(spark, sf)
    return bm25.search(bm25.build(d.documents, ("dataset",)), d.queries, k)


def bm25_topk(spark, sf):
    return _sparse(spark, sf).select("dataset", "query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


# --- dense ------------------------------------------------------------------------------------------------------------


def _pairs(spark, sf):
    return stored_vectors(spark, sf, "dense_index", "doc_id"), stored_vectors(spark, sf, "dense_queries", "query_id")


def _fusion_shown(r: DataFrame, *by: str) -> DataFrame:
    """As _shown, of scores that the fusion has rounded itself."""
    return r.select(*by, "query_id", "rank", "doc_id", "score")


def _shown(r: DataFrame, *by: str) -> DataFrame:
    return r.select(*by, "query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


def dense_flat_topk(spark, sf):
    return _shown(dense.flat(*_pairs(spark, sf), 10, ["model_id"]), "model_id")


def dense_flat_expression_topk(spark, sf):
    """The same by array expressions: vectors of `embeddings` whose id divides by 20 against all others."""
    e = _t(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return _shown(dense.flat_expression(e.withColumnRenamed("vec_id", "doc_id"), e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10, [], True))


def dense_truncated_topk(spark, sf):
    c, q = (d.withColumn("v", V.truncate(F.col("v"), 32)) for d in _pairs(spark, sf))
    return _shown(dense.flat(c, q, 10, ["model_id"]), "model_id")


def dense_sanitised(spark, sf):
    e = _t(spark, sf, "dense_index").where(F.size("embedding") == DIMS).select("vec_id", F.col("embedding").alias("v")).distinct()
    s = V.sanitise(e, "v")
    return s.select("vec_id", F.round(V.norm(F.col("v")), 6).alias("norm"), *[F.round(F.col("v")[i], 6).alias(f"x{i}") for i in (0, 31, 63)])


def binary_codes(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", V.sign_string(F.col("embedding")).alias("code"), V.hamming(V.sign_words(F.col("embedding"), DIMS), F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))).cast("long").alias("ones"))


def binary_rerank_topk(spark, sf):
    return _shown(dense.binary_rerank(*_pairs(spark, sf), 10, ["model_id"], DIMS), "model_id")


def ivf_plan(spark, sf):
    n = vectors(spark, sf, "dense_index", "vec_id").groupBy("model_id").agg(F.count("*").alias("n"))
    return n.select("model_id", "n", dense.nlist_expr(F.col("n")).cast("long").alias("nlist"), dense.pq_parts_expr(F.col("n"), F.lit(DIMS)).cast("long").alias("m"))


def _own(spark, sf):
    e = _t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.withColumnRenamed("vec_id", "doc_id"), e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")


def ivfpq_topk(spark, sf):
    c, q = _own(spark, sf)
    return _shown(quantised.search(quantised.build(c, quantised.ProductCodes()), q, 10))


def rabitq_topk(spark, sf):
    c, q = _own(spark, sf)
    return _shown(quantised.search(quantised.build(c, quantised.OneBitCodes()), q, 10))


def ah_topk(spark, sf):
    c, q = _own(spark, sf)
    return _shown(quantised.search(quantised.build(c, quantised.PairCodes()), q, 10))


def hnsw_like_topk(spark, sf):
    c, q = _own(spark, sf)
    return _shown(quantised.graph_topk(c, q, 10))


# --- late interaction -------------------------------------------------------------------------------------------------


def _matrices(spark, sf):
    e = _t(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("doc_id"), "vec_id", "embedding")
    m = late.token_matrix(e, ["doc_id"], "embedding", "vec_id")
    return m, m.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")


def maxsim_topk(spark, sf):
    return _shown(late.exact(*_matrices(spark, sf), 10))


def plaid_topk(spark, sf):
    return _shown(late.plaid(*_matrices(spark, sf), 10))


def muvera_topk(spark, sf):
    return _shown(late.muvera(*_matrices(spark, sf), 10, DIMS))


# --- systems by name --------------------------------------------------------------------------------------------------

INDEXED = ("dense-hnsw", "dense-opq-ivfpq", "dense-rabitq", "dense-scann", "dense-binary-rerank", "li-fastplaid", "li-muvera")


def systems_kept(spark, sf):
    """Per approximate system: the queries answered, whether the recall of ten against exact search is at least 0.9, and
    whether an index that was saved and opened again gives the same hits."""
    rows = []
    folder = f"{scratch_root(spark).rstrip('/')}/systems-{uuid.uuid4().hex}"
    for family, data in (("dense", _own(spark, sf)), ("late_interaction", _matrices(spark, sf))):
        corpus, queries = (materialize(d, f"systems-{n}") for d, n in zip(data, ("corpus", "queries")))
        exact = systems.search(systems.prepare(systems.resolve(family), corpus, DIMS), queries, 10, DIMS)
        exact = materialize(exact.select("query_id", "doc_id"), "systems-exact")
        for name in INDEXED:
            if name not in systems.SYSTEMS[family]:
                continue
            first = systems.prepare(name, corpus, DIMS, folder)
            hits = materialize(systems.search(first, queries, 10, DIMS).select("query_id", "doc_id"), f"systems-{name}")
            again = systems.prepare(name, corpus, DIMS, folder)
            same = first.status == again.status == "not_applicable" or (first.status, again.status) == ("built", "loaded")
            other = systems.search(again, queries, 10, DIMS).select("query_id", "doc_id")
            differ = other.exceptAll(hits).count() + hits.exceptAll(other).count()
            found = exact.join(hits, ["query_id", "doc_id"]).count() / max(1, exact.count())
            rows.append((name, hits.select("query_id").distinct().count(), found >= 0.9, same and differ == 0))
    return spark.createDataFrame(rows, "system string, queries long, recall_kept boolean, opened_same boolean")


# --- fusion -----------------------------------------------------------------------------------------------------------


def _component(spark: SparkSession, sf: str, part: str) -> DataFrame:
    """(query_id, docs): the lists of a part."""
    if part == "sparse":
        d = dataset(spark, sf)
        got = bm25.lists(bm25.build(d.documents, ("dataset",)), d.queries, 100)
    elif part == "dense":
        got = dense.flat_lists(_first_vectors(spark, sf, "dense_index", "doc_id"), _first_vectors(spark, sf, "dense_queries", "query_id"), 100, [])
    else:
        got = late.exact_lists(_tokens_of(spark, sf, "dense_index", "doc_id"), _tokens_of(spark, sf, "dense_queries", "query_id"), 100, [])
    return got.select("query_id", "docs")


def _fused(system: str):
    def run(spark, sf):
        return _fusion_shown(fusion.rrf_lists([_component(spark, sf, p) for p in fusion.SYSTEMS[system]], ["query_id"], digits=6))

    return run


def _dense_lists_by_model(spark: SparkSession, sf: str, k: int = 100) -> DataFrame:
    """(model_id, query_id, docs, scores): a pair counts by its two nearest vectors."""
    return late.exact_lists(_tokens_of(spark, sf, "dense_index", "doc_id", "model_id"), _tokens_of(spark, sf, "dense_queries", "query_id", "model_id"), k, ["model_id"], total=False)


def _dense_by_model(spark: SparkSession, sf: str, k: int = 100) -> DataFrame:
    """The same as (model_id, query_id, doc_id, score, rank)."""
    return scan.hits(_dense_lists_by_model(spark, sf, k))


def _fused_by_model(system: str):
    """As _fused, with one dense list per model over all its vectors; lists without a model take part in each fusion."""

    def run(spark, sf):
        models = _t(spark, sf, "dense_index").where(_is_valid()).select("model_id").distinct()
        parts = [_dense_lists_by_model(spark, sf).drop("scores") if p == "dense" else _component(spark, sf, p) for p in fusion.SYSTEMS[system]]
        return _fusion_shown(fusion.rrf_lists(parts, ["model_id", "query_id"], all_of=models, digits=6), "model_id")

    return run


# --- metrics ----------------------------------------------------------------------------------------------------------


def _scores(spark, sf):
    return metrics.per_query(hit_rankings(spark, sf), dataset(spark, sf).qrels, ["dataset", "query_id"], ["system"])


def metrics_per_query(spark, sf):
    return _scores(spark, sf).select("system", "dataset", "query_id", *[F.round(m, 6).alias(m) for m in metrics.METRICS])


def metrics_mean(spark, sf):
    m = metrics.means(_scores(spark, sf), ["system", "dataset"])
    return m.select("system", "dataset", "queries", *[F.round(x, 6).alias(x) for x in metrics.METRICS])


def bm25_metrics(spark, sf):
    """The whole chain: dataset, index, search, score."""
    d = dataset(spark, sf)
    found = bm25.lists(bm25.build(d.documents, ("dataset",)), d.queries, 100)
    # a list moves as one row; only judged hits count, so only these become rows
    hits = found.join(d.qrels, ["dataset", "query_id"]).select("dataset", "query_id", "doc_id", F.array_position("docs", F.col("doc_id")).cast("int").alias("rank")).where("rank > 0")
    s = metrics.per_query(hits, d.qrels, ["dataset", "query_id"])
    return metrics.means(s).select("queries", *[F.round(x, 6).alias(x) for x in metrics.METRICS])


def rankings_sidecar(spark, sf):
    key = ["system", "dataset", "query_id"]
    per = sinks.sidecar(hit_rankings(spark, sf), dataset(spark, sf).qrels, key, key[1:])
    return per.select(*key, F.size("hits").cast("long").alias("hits"), F.array_join(F.transform("hits", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["doc_id"])), ",").alias("ranking"))


def ideal_ranking(spark, sf):
    w = Window.partitionBy("dataset", "query_id").orderBy(F.desc("rel"), "doc_id")
    return dataset(spark, sf).qrels.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 10").select("dataset", "query_id", "rank", "doc_id", "rel")


QUERIES = {
    f.__name__: f
    for f in (
        ds_docs, ds_queries_with_qrels, ds_qrels, ds_qrels_rows, ds_query_limit, ds_bright_explode, token_counts, tf, df, doc_stats, corpus_stats, bm25_topk,
        dense_flat_topk, dense_flat_expression_topk, dense_truncated_topk, dense_sanitised, binary_codes, binary_rerank_topk, ivf_plan, ivfpq_topk, rabitq_topk,
        ah_topk, hnsw_like_topk, maxsim_topk, plaid_topk, muvera_topk, systems_kept, metrics_per_query, metrics_mean, bm25_metrics, rankings_sidecar, ideal_ranking,
    )
} | {f"rrf_{s.removeprefix('hybrid-rrf-').replace('-', '_')}": _fused(s) for s in fusion.SYSTEMS}
QUERIES |= {f"rrf_{s.removeprefix('hybrid-rrf-').replace('-', '_')}_by_model": _fused_by_model(s) for s in fusion.SYSTEMS if "dense" in fusion.SYSTEMS[s]}

# --- SQL --------------------------------------------------------------------------------------------------------------

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_S = _STRIP.format
_DOCS = f"""live AS (SELECT dataset, doc_id, max(title) AS title, max(text) AS text FROM corpus WHERE deleted_at IS NULL AND doc_id IS NOT NULL GROUP BY 1, 2),
docs AS (SELECT dataset, doc_id, coalesce({_S("title")}, '') AS title, concat_ws(chr(10), nullif({_S("title")}, ''), nullif({_S("text")}, '')) AS text FROM live)"""
_RELS = """rels AS (SELECT *, coalesce(score, 1.0) AS rel FROM qrels WHERE coalesce(score, 1.0) > 0 AND query_id IS NOT NULL AND doc_id IS NOT NULL),
judged AS (SELECT dataset, query_id, doc_id, rel FROM (SELECT *, row_number() OVER (PARTITION BY dataset, query_id, doc_id ORDER BY received_at DESC NULLS LAST, qrel_id DESC, rel DESC) AS o FROM rels) WHERE o = 1)"""
_QS = f"""liveq AS (SELECT dataset, query_id, coalesce(nullif({_S("max(text)")}, ''), '') AS text FROM queries WHERE deleted_at IS NULL AND query_id IS NOT NULL GROUP BY 1, 2),
qs AS (SELECT * FROM liveq SEMI JOIN judged USING (dataset, query_id))"""
_TOK = """tok AS (SELECT dataset, doc_id, regexp_extract_all(lower(concat_ws(chr(10), nullif(title, ''), text)), '[a-z0-9]+') AS t FROM docs),
stats AS (SELECT dataset, count(*) AS n, coalesce(avg(len(t)), 0) AS avgdl FROM tok GROUP BY 1),
post AS (SELECT dataset, doc_id, dl, term, count(*) AS tf FROM (SELECT dataset, doc_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
dfs AS (SELECT dataset, term, count(*) AS df FROM post GROUP BY 1, 2)"""
_BM25 = """qt AS (SELECT DISTINCT dataset, query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM qs),
sc AS (SELECT dataset, query_id, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 1.9::DOUBLE) / (tf + 0.9::DOUBLE * (0.6::DOUBLE + 0.4::DOUBLE * dl / greatest(avgdl, 1e-9)))) AS score
  FROM qt JOIN post USING (dataset, term) JOIN dfs USING (dataset, term) JOIN stats USING (dataset) GROUP BY 1, 2, 3),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc) WHERE rank <= 100)"""


def _valid(table: str, key: str = "vec_id") -> str:
    return f"""(SELECT DISTINCT model_id, vec_id AS {key}, embedding::DOUBLE[] AS v FROM {table} WHERE vec_id IS NOT NULL AND model_id IS NOT NULL AND len(embedding) = {DIMS}
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""


_NORM32 = "list_transform(v[1:32], lambda x: x / sqrt(list_dot_product(v[1:32], v[1:32])))"
_CUT = "SELECT {by}query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY {by}query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= {k}"
_HITS = """best AS (SELECT system, dataset, query_id, doc_id, max(score) AS score FROM hits WHERE system IS NOT NULL AND dataset IS NOT NULL AND query_id IS NOT NULL AND doc_id IS NOT NULL AND score IS NOT NULL AND isfinite(score) GROUP BY ALL),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system, dataset, query_id ORDER BY score DESC, doc_id) AS rank FROM best) WHERE rank <= 100)"""


def _metrics_sql(rankings: str, over: str) -> str:
    """CTEs up to `scored`. rankings: a relation with over, dataset, query_id, doc_id, rank."""
    using = f"({over}dataset, query_id)"
    base = f"(SELECT DISTINCT {over.rstrip(', ')} FROM {rankings}) CROSS JOIN ideal" if over else "ideal"
    return f"""ideal AS (SELECT dataset, query_id, sum((2 ** rel - 1) / log2(r + 1)) FILTER (WHERE r <= 10) AS idcg, count(*) AS relevant
  FROM (SELECT *, row_number() OVER (PARTITION BY dataset, query_id ORDER BY rel DESC, doc_id) AS r FROM judged) GROUP BY 1, 2),
h AS (SELECT *, count(*) OVER (PARTITION BY {over}dataset, query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS found FROM {rankings} JOIN judged USING (dataset, query_id, doc_id)),
f AS (SELECT {over}dataset, query_id, sum((2 ** rel - 1) / log2(rank + 1)) FILTER (WHERE rank <= 10) AS dcg, count(*) AS hits, min(rank) FILTER (WHERE rank <= 10) AS first, sum(found / rank) AS prec FROM h GROUP BY ALL),
scored AS (SELECT {over}dataset, query_id, coalesce(dcg / idcg, 0) AS ndcg_at_10, coalesce(hits / relevant, 0) AS recall_at_100, coalesce(1 / first, 0) AS mrr_at_10, coalesce(prec / least(relevant, 100), 0) AS map_at_100
  FROM {base} LEFT JOIN f USING {using})"""


_M = ", ".join(f"round({m}, 6) AS {m}" for m in metrics.METRICS)
_MM = ", ".join(f"round(avg({m}), 6) AS {m}" for m in metrics.METRICS)
_FLAT = f"WITH s AS (SELECT i.model_id, query_id, doc_id, list_dot_product(i.v, q.v) AS score FROM {_valid('dense_index', 'doc_id')} i JOIN {_valid('dense_queries', 'query_id')} q USING (model_id)) "


def _first_sql(table: str, key: str) -> str:
    return f"(SELECT {key}, arg_min(v, vec_id) AS v FROM {_valid(table)} JOIN (SELECT DISTINCT vec_id, {key} FROM {table} WHERE {key} IS NOT NULL) USING (vec_id) WHERE model_id = 'larkspur-small' GROUP BY 1)"


def _tokens_sql(table: str, key: str) -> str:
    return f"(SELECT {key}, list(v ORDER BY vec_id) AS m FROM {_valid(table)} JOIN (SELECT DISTINCT vec_id, {key} FROM {table} WHERE {key} IS NOT NULL) USING (vec_id) GROUP BY 1)"


_MAXSIM = "list_sum(list_transform(q.m, lambda x: list_max(list_transform(d.m, lambda y: list_dot_product(x, y)))))"
_PARTS = {
    "sparse": f"{_DOCS}, {_RELS}, {_QS}, {_TOK}, {_BM25}, c_sparse AS (SELECT query_id, doc_id, rank FROM sparse)",
    "dense": f"ds AS (SELECT query_id, doc_id, list_dot_product(d.v, q.v) AS score FROM {_first_sql('dense_index', 'doc_id')} d, {_first_sql('dense_queries', 'query_id')} q), c_dense AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ds)",
    "li": f"ls AS (SELECT query_id, doc_id, {_MAXSIM} AS score FROM {_tokens_sql('dense_index', 'doc_id')} d, {_tokens_sql('dense_queries', 'query_id')} q), c_li AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ls)",
}


def _rrf_sql(system: str) -> str:
    parts = fusion.SYSTEMS[system]
    union = " UNION ALL ".join(f"SELECT query_id, doc_id, rank FROM c_{p} WHERE rank <= 100" for p in parts)
    return f"WITH {', '.join(_PARTS[p] for p in parts)}, s AS (SELECT query_id, doc_id, sum(1::DOUBLE / (60 + rank)) AS score FROM ({union}) GROUP BY 1, 2) " + _CUT.format(by="", k=100)


SQL = {
    "ds_docs": f"WITH {_DOCS} SELECT dataset, doc_id, title, text FROM docs",
    "ds_queries_with_qrels": f"WITH {_RELS}, {_QS} SELECT dataset, query_id, text FROM qs",
    "ds_qrels": f"WITH {_RELS} SELECT * FROM judged",
    "ds_qrels_rows": f"WITH {_RELS} SELECT dataset, count(*) AS qrels_rows FROM rels GROUP BY 1",
    "ds_query_limit": f"WITH {_RELS}, {_QS}, five AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY query_id) AS r FROM qs) WHERE r <= 5) SELECT dataset, query_id, doc_id, rel FROM judged SEMI JOIN five USING (dataset, query_id)",
    "ds_bright_explode": f"WITH {_RELS}, {_QS} SELECT l.dataset, l.query_id, j.doc_id, CASE WHEN j.doc_id IS NOT NULL THEN 1.0::DOUBLE END AS rel FROM liveq l LEFT JOIN judged j USING (dataset, query_id)",
    "token_counts": "SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents)",
    "tf": f"WITH {_DOCS}, {_TOK} SELECT dataset, doc_id, term, tf FROM post",
    "df": f"WITH {_DOCS}, {_TOK} SELECT * FROM dfs",
    "doc_stats": f"WITH {_DOCS}, {_TOK} SELECT dataset, doc_id, len(t) AS dl FROM tok",
    "corpus_stats": f"WITH {_DOCS}, {_TOK} SELECT dataset, n, round(avgdl, 6) AS avgdl FROM stats",
    "bm25_topk": f"WITH {_DOCS}, {_RELS}, {_QS}, {_TOK}, {_BM25} SELECT dataset, query_id, rank, doc_id, round(score, 6) AS score FROM sparse",
    "dense_flat_topk": _FLAT + _CUT.format(by="model_id, ", k=10),
    "dense_flat_expression_topk": "WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id) " + _CUT.format(by="", k=10),
    "dense_truncated_topk": f"WITH i AS (SELECT model_id, doc_id, {_NORM32} AS v FROM {_valid('dense_index', 'doc_id')}), q AS (SELECT model_id, query_id, {_NORM32} AS v FROM {_valid('dense_queries', 'query_id')}), s AS (SELECT model_id, query_id, doc_id, list_dot_product(i.v, q.v) AS score FROM i JOIN q USING (model_id)) " + _CUT.format(by="model_id, ", k=10),
    "dense_sanitised": f"""WITH e AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM dense_index WHERE len(embedding) = {DIMS}),
b AS (SELECT bool_or(len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) > 0) AS bad FROM e),
z AS (SELECT vec_id, bad, CASE WHEN bad THEN list_transform(v, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 0.0::DOUBLE ELSE x END) ELSE v END AS v FROM e, b),
n AS (SELECT vec_id, CASE WHEN bad AND list_dot_product(v, v) > 0 THEN list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) ELSE v END AS v FROM z)
SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(v[1], 6) AS x0, round(v[32], 6) AS x31, round(v[64], 6) AS x63 FROM n""",
    "binary_codes": "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '') AS code, len(list_filter(embedding, lambda x: x >= 0)) AS ones FROM embeddings",
    "binary_rerank_topk": f"""WITH p AS (SELECT i.model_id, query_id, doc_id, list_dot_product(i.v, q.v) AS score, list_sum(list_transform(list_zip(i.v, q.v), lambda x: CASE WHEN (x[1] >= 0) <> (x[2] >= 0) THEN 1 ELSE 0 END)) AS h
  FROM {_valid('dense_index', 'doc_id')} i JOIN {_valid('dense_queries', 'query_id')} q USING (model_id)),
s AS (SELECT * EXCLUDE (c) FROM (SELECT *, row_number() OVER (PARTITION BY model_id, query_id ORDER BY h, doc_id) AS c FROM p) WHERE c <= 1000) """ + _CUT.format(by="model_id, ", k=10),
    "ivf_plan": f"""WITH c AS (SELECT model_id, count(*) AS n FROM {_valid('dense_index')} GROUP BY 1)
SELECT model_id, n, CASE WHEN n <= 1 THEN 1 ELSE greatest(1, least(greatest(16, floor(4 * sqrt(n))::BIGINT), 256, n)) END AS nlist,
  coalesce(list_filter([32, 16, 8, 4, 2, 1], lambda m: n >= greatest(256, 128 * m))[1], 32)::BIGINT AS m FROM c""",
    "maxsim_topk": f"WITH d AS (SELECT floor(vec_id / 4)::BIGINT AS doc_id, list(embedding::DOUBLE[] ORDER BY vec_id) AS m FROM embeddings GROUP BY 1), s AS (SELECT q.doc_id AS query_id, d.doc_id, {_MAXSIM} AS score FROM d, d q WHERE q.doc_id % 20 = 0) " + _CUT.format(by="", k=10),
    "systems_kept": f"""SELECT s.system, CASE WHEN s.system LIKE 'li-%' THEN (SELECT count(DISTINCT vec_id // 4) FROM embeddings WHERE (vec_id // 4) % 20 = 0) ELSE (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) END AS queries, true AS recall_kept, true AS opened_same
  FROM (VALUES {', '.join(f"('{x}')" for x in INDEXED)}) s(system)""",
    "metrics_per_query": f"WITH {_HITS}, {_RELS}, {_metrics_sql('r', 'system, ')} SELECT system, dataset, query_id, {_M} FROM scored",
    "metrics_mean": f"WITH {_HITS}, {_RELS}, {_metrics_sql('r', 'system, ')} SELECT system, dataset, count(*) AS queries, {_MM} FROM scored GROUP BY 1, 2",
    "bm25_metrics": f"WITH {_DOCS}, {_RELS}, {_QS}, {_TOK}, {_BM25}, {_metrics_sql('sparse', '')} SELECT count(*) AS queries, {_MM} FROM scored",
    "rankings_sidecar": f"WITH {_HITS} SELECT system, dataset, query_id, count(*) AS hits, string_agg(rank || ':' || doc_id, ',' ORDER BY rank) AS ranking FROM r GROUP BY 1, 2, 3",
    "ideal_ranking": f"WITH {_RELS} SELECT * FROM (SELECT dataset, query_id, row_number() OVER (PARTITION BY dataset, query_id ORDER BY rel DESC, doc_id) AS rank, doc_id, rel FROM judged) WHERE rank <= 10",
} | {f"rrf_{s.removeprefix('hybrid-rrf-').replace('-', '_')}": _rrf_sql(s) for s in fusion.SYSTEMS}


def _keyed_sql(table: str, key: str) -> str:
    return f"(SELECT model_id, {key}, v FROM {_valid(table)} JOIN (SELECT DISTINCT vec_id, {key} FROM {table} WHERE {key} IS NOT NULL) USING (vec_id))"


_DENSE_BY_MODEL = f"""ds AS (SELECT model_id, query_id, doc_id, max(list_dot_product(d.v, q.v)) AS score FROM {_keyed_sql('dense_index', 'doc_id')} d JOIN {_keyed_sql('dense_queries', 'query_id')} q USING (model_id) GROUP BY ALL),
c_dense AS (SELECT model_id, query_id, doc_id, row_number() OVER (PARTITION BY model_id, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ds)"""


def _rrf_by_model_sql(system: str) -> str:
    parts = fusion.SYSTEMS[system]
    union = " UNION ALL ".join(f"SELECT model_id, query_id, doc_id, rank FROM c_{p}{'' if p == 'dense' else ', models'} WHERE rank <= 100" for p in parts)
    ctes = ", ".join(_DENSE_BY_MODEL if p == "dense" else _PARTS[p] for p in parts)
    return f"WITH models AS (SELECT DISTINCT model_id FROM {_valid('dense_index')}), {ctes}, s AS (SELECT model_id, query_id, doc_id, sum(1::DOUBLE / (60 + rank)) AS score FROM ({union}) GROUP BY 1, 2, 3) " + _CUT.format(by="model_id, ", k=100)


SQL |= {f"rrf_{s.removeprefix('hybrid-rrf-').replace('-', '_')}_by_model": _rrf_by_model_sql(s) for s in fusion.SYSTEMS if "dense" in fusion.SYSTEMS[s]}
