"""Registered queries of the run-fact operators, with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.operators import measures
from rankloom.plans import leaderboard as lb
from rankloom.plans.retrieval_queries import _QS, _RELS, dataset
from rankloom.sources import results, sinks


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _facts(spark, sf):
    return results.facts(_t(spark, sf, "result_files"))


def _runs(spark, sf):
    return lb.runs(_facts(spark, sf))


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


def _d(c: str):
    """Numbers that may be null are shown as doubles."""
    return F.col(c).cast("double").alias(c)


def facts_normalised(spark, sf):
    return _runs(spark, sf).select(
        "file_id", "benchmark", "dataset", "model_id", _d("truncate_dim"), "family", "system", "exact", "status", "compression", "precision", "hardware", "query_rows", *[_r(m) for m in results.QUALITY],
        _r("e2e_ms_p50"), _d("sample_size"), _r("index_bytes"), _r("storage_gb", 9), _r("cost_per_million_queries_usd"))


def facts_labels(spark, sf):
    return _runs(spark, sf).select("model_id", _d("truncate_dim"), "benchmark", "dataset", "system", "model_label", "dataset_label", "system_label").distinct()


def facts_status(spark, sf):
    return _runs(spark, sf).groupBy("status_given", "status").agg(F.count("*").alias("n"))


def pick_index_bytes(spark, sf):
    f = _facts(spark, sf)
    return f.select("file_id", F.coalesce(*[F.col(k) for k in results.INDEX_BYTES]).alias("seven_keys"), F.coalesce(*[F.col(k) for k in results.INDEX_BYTES[:-1]]).alias("six_keys"))


def hybrid_backfill(spark, sf):
    b = lb.backfill(_runs(spark, sf))
    return b.select("file_id", F.col("parts").cast("long").alias("parts"), _r("e2e_ms_p50"), _r("retrieval_ms_p50"), _d("sample_size"), "status")


def _requirements(spark, sf):
    r = _runs(spark, sf)
    alone = r.where("family in ('dense', 'late_interaction')")
    return lb.requirements(r.select("benchmark", "dataset"), alone.select("system", "model_id").distinct(), r.where("family in ('sparse', 'hybrid')").select("system").distinct()), r


def coverage_requirements(spark, sf):
    return _requirements(spark, sf)[0]


def coverage_missing(spark, sf):
    return lb.missing(*_requirements(spark, sf))


def coverage_latency_problem(spark, sf):
    req, r = _requirements(spark, sf)
    best = lb.best_candidate(lb.candidates(req, r).where("file_id is not null"), ["benchmark", "dataset", "system", "model_id"])
    return best.where("require_latency").select("benchmark", "dataset", "system", "model_id", "file_id", lb.latency_problem().alias("problem")).where("problem is not null")


def best_candidate(spark, sf):
    return lb.best_candidate(_runs(spark, sf), ["benchmark", "dataset", "system", "model_id"]).select("benchmark", "dataset", "system", "model_id", "file_id", _d("sample_size"))


def needs_latency(spark, sf):
    return _runs(spark, sf).where(lb.needs_latency(True)).select("file_id", _d("query_rows"), _d("sample_size"))


def inventory(spark, sf):
    return lb.inventory(_runs(spark, sf))


def export_summary(spark, sf):
    return sinks.export_summary(_runs(spark, sf))


_CONFIG = ["family", "model_id", "system"]


def complete_configs(spark, sf):
    """Configurations that cover every year of their benchmark: orders by customer segment, configuration is the nation."""
    o, c = _t(spark, sf, "orders"), _t(spark, sf, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("benchmark"), F.year("o_orderdate").alias("dataset"), "c_nationkey", "o_orderpriority", "o_totalprice")
    got = lb.complete_configs(rows, ["benchmark"], ["c_nationkey", "o_orderpriority"], measures=("o_totalprice",))
    return got.select("benchmark", "c_nationkey", "o_orderpriority", "datasets", "rows", F.round("o_totalprice", 7).alias("mean"))


def complete_configs_runs(spark, sf):
    """Of the runs: systems that were run on every dataset of a benchmark."""
    got = lb.complete_configs(_runs(spark, sf), ["benchmark"], ["system"])
    return got.select("benchmark", "system", "datasets", "rows", "status", "sample_min", "sample_max", *[_r(m) for m in (*results.QUALITY, "e2e_ms_p50")])


def component_map_mean(spark, sf):
    m = lb.component_means(_runs(spark, sf), ["benchmark", "family", "system"], "component_ms")
    return m.select("benchmark", "family", "system", "part", _r("mean"))


def _front(spark, sf):
    return lb.frontier(_t(spark, sf, "part"), ["p_brand"], "p_retailprice", "p_size", "p_partkey")


def pareto_frontier(spark, sf):
    return _front(spark, sf).select("p_brand", "p_partkey", "p_retailprice", "p_size", F.col("position").cast("long").alias("position"))


def pareto_knee(spark, sf):
    return lb.knees(_front(spark, sf), ["p_brand"], "p_retailprice", "p_size").select("p_brand", "p_partkey", F.round("distance", 6).alias("distance"))


def pareto_picks(spark, sf):
    return lb.picks(_front(spark, sf), ["p_brand"], "p_retailprice", "p_size").select("p_brand", "p_partkey", "pick")


def leaderboard(spark, sf):
    v = lb.leaderboard(_runs(spark, sf), config=("family", "system"))
    return v.select("benchmark", "family", "system", F.col("rank").cast("long").alias("rank"), "datasets", "on_frontier", _r("quality_selected"), _r("e2e_ms_p50"))


def leaderboard_dataset(spark, sf):
    v = lb.leaderboard(_runs(spark, sf), "map_at_100", "storage_gb", "dense", "beir", "claimcheck", "storage_gb", False)
    return v.select("file_id", "system", F.col("rank").cast("long").alias("rank"), "on_frontier", _r("quality_selected"), _r("storage_gb", 9))


def leader(spark, sf):
    r = lb.usable(_runs(spark, sf))
    return lb.leaders(r, ["benchmark", "dataset"], "ndcg_at_10", ["file_id"]).select("benchmark", "dataset", "file_id", "model_id", "system", _r("ndcg_at_10"))


def axis_stats(spark, sf):
    a = lb.axis_stats(_runs(spark, sf), ["benchmark"], "e2e_ms_p50", "ndcg_at_10")
    return a.select("benchmark", _r("lo"), _r("hi"), "log_axis", F.col("ticks").cast("long").alias("ticks"), _r("y_lo"), _r("y_hi"))


def latency_summary(spark, sf):
    s = measures.latency_summary(_t(spark, sf, "events"), ["event_type"], "value")
    return s.select("event_type", "samples", _r("p50"), _r("p99"), _r("mean"))


def latency_sample(spark, sf):
    return measures.latency_sample(dataset(spark, sf).queries.select("dataset", "query_id"), ["dataset"])


def latency_sample_kept(spark, sf):
    """What a fixed sample must hold in each dataset: min(200, n) different positions, each of the query at that place."""
    q = dataset(spark, sf).queries.select("dataset", "query_id")
    s = measures.latency_sample(q, ["dataset"])
    place = q.withColumn("place", F.row_number().over(Window.partitionBy("dataset").orderBy("query_id")) - 1)
    return s.join(place, ["dataset", "query_id"]).groupBy("dataset").agg(F.count_distinct("position").alias("sampled"), F.bool_and(F.col("position") == F.col("place")).alias("in_place"))


def batch_cyclic(spark, sf):
    rows = _t(spark, sf, "orders")
    return measures.cyclic_batch(rows, "position", F.count("*"), 64, 14_980)


def cost(spark, sf):
    f = _facts(spark, sf)
    return f.where("e2e_ms_p50 is not null").select("file_id", F.round(measures.query_cost(F.col("e2e_ms_p50")), 6).alias("per_million_queries"), F.round(measures.indexing_cost(measures.docs_per_second(F.col("query_rows"), F.col("e2e_ms_p50"))), 6).alias("per_million_docs"))


def storage(spark, sf):
    v = _t(spark, sf, "dense_index").where("embedding is not null").groupBy("model_id").agg(F.count_distinct("vec_id").alias("n"), F.sum(F.size("embedding")).cast("long").alias("numbers"))
    b = measures.dense_bytes(F.col("n"), F.lit(64))
    return v.select("model_id", "n", *measures.storage_summary(F.col("numbers") * 2, F.col("n")), b["binary_rerank"].cast("long").alias("binary_rerank"), b["hnsw"].cast("long").alias("hnsw"))


def skip_small_corpus(spark, sf):
    n = _t(spark, sf, "corpus").groupBy("dataset").agg(F.count_distinct("doc_id").alias("docs"))
    s = spark.createDataFrame([("dense-flat",), ("dense-opq-ivfpq",)], "system string")
    return n.crossJoin(F.broadcast(s)).select("dataset", "system", "docs", lb.small_corpus_skip(F.col("docs"), F.col("system")).alias("status"))


def skip_existing(spark, sf):
    req, r = _requirements(spark, sf)
    return lb.skip_existing(req.where("model_id is not null").select("benchmark", "dataset", "system", "model_id"), r, ["benchmark", "dataset", "system", "model_id"])


def result_paths(spark, sf):
    f = _runs(spark, sf)
    return f.select("file_id", sinks.result_path(F.col("benchmark"), F.col("dataset"), F.col("system"), F.col("model_id"), F.lit(sinks.suffix(512)), None).alias("path"))


def cache_keys(spark, sf):
    """Content keys of representations: the first 24 hex digits of a hash over the sorted fields as JSON."""
    f = _runs(spark, sf).select("benchmark", "dataset", "family", "model_id", "truncate_dim").distinct()
    null = F.lit(None).cast("string")
    key = sinks.cache_key(
        schema_version=F.lit("0.2"), kind=F.lit("corpus"), family=F.col("family"), model_id=F.col("model_id"), dataset_id=F.concat_ws("/", "benchmark", "dataset"), dataset_name=F.col("dataset"), split=F.lit("test"), query_limit=null,
        representation_key=sinks.representation_key(F.col("family"), F.col("truncate_dim"), null))
    return f.select("benchmark", "dataset", "family", "model_id", _d("truncate_dim"), key.alias("key"))


def coverage_report(spark, sf):
    return lb.coverage_report(*_requirements(spark, sf))


def plot_rows(spark, sf):
    return lb.plot_rows(_runs(spark, sf)).select("file_id", "benchmark", "dataset", "family", "model_id", "system", _r("ndcg_at_10"), _r("e2e_ms_p50"), _r("storage_gb", 9))


def best_part(spark, sf):
    return lb.best_part(_runs(spark, sf), ["benchmark", "dataset", "system", "model_id"]).select("benchmark", "dataset", "system", "model_id", "file_id")


def component_bytes(spark, sf):
    return lb.backfill(_runs(spark, sf)).select("file_id", _r("component_bytes"))


def axis_ticks(spark, sf):
    a = lb.axis_stats(_runs(spark, sf), ["benchmark"], "e2e_ms_p50", "ndcg_at_10")
    return a.select("benchmark", F.explode("tick_values").alias("tick"))


def benchmarks_in_order(spark, sf):
    return _runs(spark, sf).select("benchmark", lb.benchmark_order(F.col("benchmark")).cast("long").alias("place")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        facts_normalised, facts_labels, facts_status, pick_index_bytes, hybrid_backfill, coverage_requirements, coverage_missing, coverage_latency_problem, best_candidate, needs_latency, inventory, export_summary,
        complete_configs, complete_configs_runs, component_map_mean, pareto_frontier, pareto_knee, pareto_picks, leaderboard, leaderboard_dataset, leader, axis_stats, latency_summary, latency_sample, batch_cyclic,
        cost, storage, skip_small_corpus, skip_existing, result_paths, cache_keys, latency_sample_kept, coverage_report, plot_rows, best_part, component_bytes, axis_ticks, benchmarks_in_order,
    )
}

# --- SQL --------------------------------------------------------------------------------------------------------------


def _txt(p: str) -> str:
    return f"CASE WHEN json_type(j, '$.{p}') = 'VARCHAR' THEN json_extract_string(j, '$.{p}') END"


def _num(p: str) -> str:
    return f"CASE WHEN json_type(j, '$.{p}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN json_extract(j, '$.{p}')::DOUBLE END"


_F = f"""raw AS (SELECT file_id, file_path, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM result_files),
f AS (SELECT DISTINCT file_id, file_path, {_txt("dataset.benchmark")} AS benchmark, {_txt("dataset.name")} AS dataset, {_num("dataset.query_rows")}::BIGINT AS query_rows, {_txt("model.id")} AS model_id, {_num("model.truncate_dim")}::BIGINT AS truncate_dim,
  coalesce({_txt("retrieval_system.family")}, {_txt("model.family")}, 'unknown') AS family, coalesce({_txt("retrieval_system.name")}, 'dense-flat') AS system, coalesce(json_extract_string(j, '$.retrieval_system.exact') = 'true', false) AS exact,
  {_txt("status")} AS status_given, {_txt("latency.status")} AS latency_status, {_num("latency.e2e_query_ms_p50")} AS e2e, {_num("latency.latency_sample_size")}::BIGINT AS sample_size, {_num("latency.retrieval_ms_p50_topk100")} AS ret,
  json_extract(j, '$.latency.component_e2e_ms_p50') AS comp, json_extract(j, '$.storage.component_index_bytes') AS comp_bytes, {", ".join(f"{_num('quality.' + m)} AS {m}" for m in results.QUALITY)}, {", ".join(f"{_num('storage.' + k)} AS {k}" for k in results.INDEX_BYTES)},
  {_num("cost.cost_per_million_queries_usd")} AS usd, coalesce({", ".join(f"nullif({_txt(s + 'precision')}, '')" for s in ("run.", "latency.", "model.", "system.", "retrieval_system.", ""))}, 'unknown') AS prec, coalesce({_txt("run.hardware_label")}, {_txt("system.platform")}, 'unknown') AS hw
  FROM raw WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.model') IS NOT NULL AND json_type(j, '$.dataset') IS NOT NULL AND json_type(j, '$.quality') IS NOT NULL AND json_extract_string(j, '$.schema_version') = '0.3' AND json_type(j, '$.schema_version') = 'VARCHAR'),
r AS (SELECT *, coalesce({", ".join(results.INDEX_BYTES)}) AS index_bytes, CASE WHEN status_given IN ('not_applicable_small_corpus', 'failed', 'pending', 'quality_only', 'latency_skipped') THEN status_given WHEN latency_status = 'skipped' THEN 'quality_only'
  WHEN status_given IS NOT NULL AND status_given NOT IN ('completed', '') THEN status_given WHEN coalesce({", ".join(results.QUALITY)}) IS NOT NULL AND e2e IS NULL THEN 'quality_only' ELSE 'completed' END AS status,
  CASE WHEN index_bytes_binary_rerank IS NOT NULL THEN '1-bit+rerank' WHEN index_bytes_muvera IS NOT NULL THEN 'muvera' WHEN index_bytes_pq IS NOT NULL THEN 'pq' WHEN index_bytes_hnsw IS NOT NULL THEN 'hnsw' WHEN index_bytes_int8 IS NOT NULL THEN 'int8' ELSE 'fp16' END AS compression FROM f)"""
_WITH = f"WITH {_F} "
_SKIP = "('not_applicable_small_corpus', 'skipped_high_dim_opq_compute', 'backend_oom_full8192_a100', 'latency_oom', 'component_latency_unavailable')"
_Q6 = ", ".join(f"round({m}, 6) AS {m}" for m in results.QUALITY)
_REQ = """req AS (SELECT * FROM (SELECT DISTINCT benchmark, dataset FROM r), (SELECT DISTINCT system, model_id, true AS require_latency FROM r WHERE family IN ('dense', 'late_interaction')
  UNION ALL SELECT DISTINCT system, NULL, system <> 'sparse-bm25' FROM r WHERE family IN ('sparse', 'hybrid')))"""
_BEST = "ORDER BY (e2e IS NOT NULL) DESC, coalesce(sample_size, 0) DESC, file_path DESC, file_id DESC"
_TITLE = "array_to_string(list_transform(str_split({}, '-'), lambda w: upper(w[1]) || lower(w[2:])), '-')"
_PARTS_SQL = "(VALUES " + ", ".join(f"('{s}', '{p}', '{lb.PART_SYSTEMS[p]}')" for s, ps in lb.SYSTEMS.items() for p in ps) + ") p(system, part, part_system)"
_LABELS_SQL = "CASE system " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lb.SYSTEM_LABELS.items()) + " ELSE array_to_string(list_transform(str_split(system, '-'), lambda w: upper(w[1]) || lower(w[2:])), ' ') END"
_FRONT = """prev AS (SELECT *, max(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_size DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM part),
front AS (SELECT p_brand, p_partkey, p_retailprice, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS position FROM prev WHERE b IS NULL OR p_size > b)"""
_KNEE = """k AS (SELECT *, count(*) OVER w AS n, min(p_retailprice) OVER w AS x0, max(p_retailprice) OVER w AS x1, min(p_size) OVER w AS q0, max(p_size) OVER w AS q1 FROM front WINDOW w AS (PARTITION BY p_brand)),
d AS (SELECT *, (p_size - q0)::DOUBLE / greatest(q1 - q0, CASE WHEN q1 = q0 THEN 1 ELSE 0 END) - (CASE WHEN q1 = q0 THEN 0.0 ELSE 1.0 END)::DOUBLE * (p_retailprice - x0) / CASE WHEN x1 = x0 THEN 1 ELSE x1 - x0 END AS distance FROM k),
knee AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY round(distance, 12) DESC, position) AS o FROM d WHERE n >= 3 AND position > 1 AND position < n) WHERE o = 1)"""

SQL = {
    "facts_normalised": _WITH + f"SELECT file_id, benchmark, dataset, model_id, truncate_dim::DOUBLE AS truncate_dim, family, system, exact, status, compression, prec AS precision, hw AS hardware, query_rows, {_Q6}, round(e2e, 6) AS e2e_ms_p50, sample_size::DOUBLE AS sample_size, round(index_bytes, 6) AS index_bytes, round(index_bytes / 1e9, 9) AS storage_gb, round(usd, 6) AS cost_per_million_queries_usd FROM r",
    "facts_labels": _WITH + f"""SELECT DISTINCT model_id, truncate_dim::DOUBLE AS truncate_dim, benchmark, dataset, system,
  array_to_string(list_transform(regexp_extract_all(str_split(model_id, '/')[-1], '[^-\\s]+'), lambda w: CASE WHEN lower(w) IN ('bge', 'gte', 'nv', 'e5') THEN upper(w) ELSE upper(w[1]) || w[2:] END), ' ') || CASE WHEN truncate_dim > 0 THEN ' @' || truncate_dim || 'd' ELSE '' END AS model_label,
  CASE WHEN benchmark = 'bright' THEN 'BRIGHT ' || {_TITLE.format('dataset')} WHEN benchmark = 'limit' THEN 'LIMIT' ELSE {_TITLE.format('dataset')} END AS dataset_label, {_LABELS_SQL} AS system_label FROM r""",
    "facts_status": _WITH + "SELECT status_given, status, count(*) AS n FROM r GROUP BY 1, 2",
    "pick_index_bytes": _WITH + f"SELECT file_id, index_bytes AS seven_keys, coalesce({', '.join(results.INDEX_BYTES[:-1])}) AS six_keys FROM r",
    "hybrid_backfill": _WITH + f""", one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY benchmark, dataset, model_id, system ORDER BY file_path DESC, file_id DESC) AS o FROM r) WHERE o = 1),
m AS (SELECT h.file_id, coalesce(TRY_CAST(json_extract_string(h.comp, '$.' || p.part) AS DOUBLE), c.e2e) AS e, c.sample_size AS n, c.ret FROM r h JOIN {_PARTS_SQL} ON h.system = p.system LEFT JOIN one c ON c.benchmark = h.benchmark AND c.dataset = h.dataset AND c.model_id = h.model_id AND c.system = p.part_system WHERE h.family = 'hybrid'),
a AS (SELECT file_id, count(*) AS parts, CASE WHEN count(e) = count(*) THEN sum(e) END AS e, CASE WHEN count(n) = count(*) THEN min(n) END AS n, CASE WHEN count(ret) = count(*) THEN sum(ret) END AS rt FROM m GROUP BY 1)
SELECT r.file_id, coalesce(parts, 0) AS parts, round(coalesce(e, e2e), 6) AS e2e_ms_p50, round(coalesce(rt, e, ret), 6) AS retrieval_ms_p50, CASE WHEN e IS NOT NULL THEN coalesce(n, sample_size) ELSE sample_size END::DOUBLE AS sample_size, CASE WHEN e IS NOT NULL THEN 'completed' ELSE status END AS status
FROM r LEFT JOIN a USING (file_id) WHERE family = 'hybrid'""",
    "coverage_requirements": _WITH + f", {_REQ} SELECT benchmark, dataset, system, model_id, require_latency FROM req",
    "coverage_missing": _WITH + f", {_REQ} SELECT benchmark, dataset, system, model_id, require_latency FROM req q WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.benchmark = q.benchmark AND r.dataset = q.dataset AND r.system = q.system AND (q.model_id IS NULL OR q.model_id = r.model_id))",
    "coverage_latency_problem": _WITH + f""", {_REQ}, c AS (SELECT q.benchmark, q.dataset, q.system, q.model_id, require_latency, file_id, status_given, e2e, query_rows, sample_size, row_number() OVER (PARTITION BY q.benchmark, q.dataset, q.system, q.model_id {_BEST}) AS o
  FROM req q JOIN r ON r.benchmark = q.benchmark AND r.dataset = q.dataset AND r.system = q.system AND (q.model_id IS NULL OR q.model_id = r.model_id)),
p AS (SELECT *, CASE WHEN query_rows > 0 THEN least(200, query_rows) ELSE 200 END AS want FROM c WHERE o = 1 AND require_latency)
SELECT * FROM (SELECT benchmark, dataset, system, model_id, file_id, CASE WHEN coalesce(status_given IN {_SKIP}, false) THEN NULL WHEN e2e IS NULL THEN 'missing e2e_query_ms_p50' WHEN sample_size IS DISTINCT FROM want THEN 'stale sample size ' || coalesce(sample_size::VARCHAR, 'None') || ', expected ' || want END AS problem FROM p) WHERE problem IS NOT NULL""",
    "best_candidate": _WITH + f"SELECT benchmark, dataset, system, model_id, file_id, sample_size::DOUBLE AS sample_size FROM (SELECT *, row_number() OVER (PARTITION BY benchmark, dataset, system, model_id {_BEST}) AS o FROM r) WHERE o = 1",
    "needs_latency": _WITH + "SELECT file_id, query_rows::DOUBLE AS query_rows, sample_size::DOUBLE AS sample_size FROM r WHERE e2e IS NULL OR sample_size IS DISTINCT FROM least(200, query_rows)",
    "inventory": _WITH + f""", x AS (SELECT *, coalesce(family IN ('dense', 'late_interaction') AND e2e IS NULL AND NOT coalesce(status_given IN {_SKIP}, false), false) AS lack FROM r),
y AS (SELECT *, family IN ('dense', 'late_interaction') AND NOT lack AND sample_size IS NOT NULL AND sample_size <> 200 AND sample_size IS DISTINCT FROM query_rows AS stale FROM x),
z AS (SELECT 'family' AS dimension, family AS value, lack, stale FROM y UNION ALL SELECT 'system', system, lack, stale FROM y UNION ALL SELECT 'model', model_id, lack, stale FROM y)
SELECT dimension, value, count(*) AS rows, count(*) FILTER (WHERE lack) AS latency_missing, count(*) FILTER (WHERE stale) AS latency_stale FROM z GROUP BY 1, 2""",
    "export_summary": _WITH + "SELECT count(*) AS runs, count(DISTINCT benchmark) AS benchmarks, count(DISTINCT model_id) AS models, count(DISTINCT system) AS systems FROM r",
    "complete_configs": """WITH x AS (SELECT c_mktsegment AS benchmark, year(o_orderdate) AS dataset, c_nationkey, o_orderpriority, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
a AS (SELECT benchmark, count(DISTINCT dataset) AS n FROM x GROUP BY 1)
SELECT benchmark, c_nationkey, o_orderpriority, count(DISTINCT dataset) AS datasets, count(*) AS rows, round(avg(o_totalprice), 7) AS mean FROM x JOIN a USING (benchmark) GROUP BY benchmark, c_nationkey, o_orderpriority, n HAVING count(DISTINCT dataset) = n""",
    "complete_configs_runs": _WITH + f""", a AS (SELECT benchmark, count(DISTINCT dataset) AS n FROM r GROUP BY 1)
SELECT benchmark, system, count(DISTINCT dataset) AS datasets, count(*) AS rows, CASE WHEN bool_and(status = 'completed') THEN 'completed' ELSE 'quality_only' END AS status, min(sample_size) FILTER (WHERE sample_size > 0) AS sample_min, max(sample_size) FILTER (WHERE sample_size > 0) AS sample_max,
  {", ".join(f"round(avg({m}), 6) AS {m}" for m in results.QUALITY)}, round(avg(e2e), 6) AS e2e_ms_p50 FROM r JOIN a USING (benchmark) GROUP BY benchmark, system, n HAVING count(DISTINCT dataset) = n""",
    "component_map_mean": _WITH + ", k AS (SELECT benchmark, family, system, comp, unnest(json_keys(comp)) AS part FROM r WHERE json_type(comp) = 'OBJECT') SELECT benchmark, family, system, part, round(avg(TRY_CAST(json_extract_string(comp, '$.' || part) AS DOUBLE)), 6) AS mean FROM k GROUP BY 1, 2, 3, 4",
    "pareto_frontier": f"WITH {_FRONT} SELECT p_brand, p_partkey, p_retailprice, p_size, position FROM front",
    "pareto_knee": f"WITH {_FRONT}, {_KNEE} SELECT p_brand, p_partkey, round(distance, 6) AS distance FROM knee",
    "pareto_picks": f"""WITH {_FRONT}, {_KNEE}, a AS (SELECT f.*, count(*) OVER (PARTITION BY p_brand) AS n, k.position AS kp FROM front f LEFT JOIN (SELECT p_brand AS b, position FROM knee) k ON f.p_brand = k.b)
SELECT * FROM (SELECT p_brand, p_partkey, CASE WHEN position = 1 THEN 'first' WHEN position = n THEN 'last' WHEN n <= 3 OR position = coalesce(kp, n // 2 + 1) THEN 'knee' END AS pick FROM a) WHERE pick IS NOT NULL""",
    "leaderboard": _WITH + f""", u AS (SELECT * FROM r WHERE coalesce({", ".join(results.QUALITY)}) IS NOT NULL), a AS (SELECT benchmark, count(DISTINCT dataset) AS n FROM u GROUP BY 1),
v AS (SELECT benchmark, family, system, count(DISTINCT dataset) AS datasets, avg(ndcg_at_10) AS q, avg(e2e) AS x FROM u JOIN a USING (benchmark) GROUP BY benchmark, family, system, n HAVING count(DISTINCT dataset) = n),
p AS (SELECT *, max(q) OVER (PARTITION BY benchmark ORDER BY x, q DESC, family, system ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM v WHERE x IS NOT NULL AND q IS NOT NULL)
SELECT v.benchmark, v.family, v.system, row_number() OVER (PARTITION BY v.benchmark ORDER BY v.q DESC NULLS LAST, v.family, v.system) AS rank, v.datasets, coalesce(p.b IS NULL AND p.q IS NOT NULL OR p.q > p.b, false) AS on_frontier, round(v.q, 6) AS quality_selected, round(v.x, 6) AS e2e_ms_p50
FROM v LEFT JOIN p ON v.benchmark = p.benchmark AND v.family = p.family AND v.system = p.system""",
    "leaderboard_dataset": _WITH + f""", v AS (SELECT *, map_at_100 AS q, index_bytes / 1e9 AS x, concat_ws(chr(1), benchmark, family, model_id, system, file_id::VARCHAR) AS id FROM r WHERE coalesce({", ".join(results.QUALITY)}) IS NOT NULL AND family = 'dense' AND benchmark = 'beir' AND dataset = 'claimcheck'),
p AS (SELECT file_id, q, max(q) OVER (ORDER BY x, q DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM v WHERE x IS NOT NULL AND q IS NOT NULL)
SELECT v.file_id, v.system, row_number() OVER (ORDER BY v.x ASC NULLS LAST, v.id) AS rank, coalesce(p.b IS NULL AND p.q IS NOT NULL OR p.q > p.b, false) AS on_frontier, round(v.q, 6) AS quality_selected, round(v.x, 9) AS storage_gb FROM v LEFT JOIN p USING (file_id)""",
    "leader": _WITH + f"SELECT benchmark, dataset, file_id, model_id, system, round(ndcg_at_10, 6) AS ndcg_at_10 FROM (SELECT *, row_number() OVER (PARTITION BY benchmark, dataset ORDER BY ndcg_at_10 DESC NULLS LAST, file_id) AS o FROM r WHERE coalesce({', '.join(results.QUALITY)}) IS NOT NULL) WHERE o = 1",
    "axis_stats": _WITH + """, g AS (SELECT benchmark, min(e2e) FILTER (WHERE e2e > 0) AS lo, max(e2e) FILTER (WHERE e2e > 0) AS hi, count(*) FILTER (WHERE e2e > 0) AS n, min(ndcg_at_10) AS q0, max(ndcg_at_10) AS q1 FROM r GROUP BY 1)
SELECT benchmark, round(lo, 6) AS lo, round(hi, 6) AS hi, coalesce(n >= 2 AND hi / lo >= 30, false) AS log_axis, len(list_filter([0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000, 100000], lambda t: t >= lo / 1.5 AND t <= hi * 1.5)) AS ticks,
  round(greatest(0, q0 - greatest(0.015, (q1 - q0) * 0.1)), 6) AS y_lo, round(least(1, q1 + greatest(0.015, (q1 - q0) * 0.1)), 6) AS y_hi FROM g""",
    "latency_summary": "SELECT event_type, count(value) AS samples, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean FROM events GROUP BY 1",
    "batch_cyclic": "SELECT slot, (slot + 14980) % n AS position FROM range(64) t(slot), (SELECT count(*) AS n FROM orders)",
    "cost": _WITH + "SELECT file_id, round(e2e / 3.6 * 1.99, 6) AS per_million_queries, round(CASE WHEN query_rows > 0 AND e2e > 0 THEN 1e6 / (query_rows / (e2e / 1000)) / 3600 * 1.99 END, 6) AS per_million_docs FROM r WHERE e2e IS NOT NULL",
    "storage": "SELECT model_id, n, numbers * 2 AS index_bytes_fp16, numbers AS index_bytes_int8, NULL::BIGINT AS index_bytes_pq, CASE WHEN n > 0 THEN numbers * 2 / n ELSE 0 END::DOUBLE AS index_bytes_per_doc, n * 8 + n * 128 AS binary_rerank, n * (256 + 268) AS hnsw FROM (SELECT model_id, count(DISTINCT vec_id) AS n, sum(len(embedding))::BIGINT AS numbers FROM dense_index WHERE embedding IS NOT NULL GROUP BY 1)",
    "skip_small_corpus": "SELECT dataset, system, docs, CASE WHEN system = 'dense-opq-ivfpq' AND docs < 10000 THEN 'not_applicable_small_corpus' END AS status FROM (SELECT dataset, count(DISTINCT doc_id) AS docs FROM corpus GROUP BY 1), (VALUES ('dense-flat'), ('dense-opq-ivfpq')) s(system)",
    "skip_existing": _WITH + f", {_REQ} SELECT benchmark, dataset, system, model_id FROM req q WHERE model_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r WHERE r.benchmark = q.benchmark AND r.dataset = q.dataset AND r.system = q.system AND q.model_id = r.model_id AND e2e IS NOT NULL AND coalesce(latency_status, '') <> 'skipped')",
    "result_paths": _WITH + "SELECT file_id, concat_ws('/', 'results', benchmark, dataset, system, replace(replace(model_id, '/', '__'), ' ', '_') || '.seq512.json') AS path FROM r",
    "cache_keys": _WITH + """SELECT DISTINCT benchmark, dataset, family, model_id, truncate_dim::DOUBLE AS truncate_dim,
  sha256('{"dataset_id": ' || to_json(concat_ws('/', benchmark, dataset))::VARCHAR || ', "dataset_name": ' || coalesce(to_json(dataset)::VARCHAR, 'null') || ', "family": ' || to_json(family)::VARCHAR || ', "kind": "corpus", "model_id": ' || coalesce(to_json(model_id)::VARCHAR, 'null')
    || ', "query_limit": null, "representation_key": ' || CASE WHEN family = 'dense' AND truncate_dim IS NOT NULL THEN '"dim' || truncate_dim || '"' ELSE 'null' END || ', "schema_version": "0.2", "split": "test"}')[1:24] AS key FROM r""",
    "latency_sample_kept": f"WITH {_RELS}, {_QS} SELECT dataset, least(200, count(*)) AS sampled, true AS in_place FROM qs GROUP BY 1",
    "coverage_report": _WITH + f""", {_REQ}, c AS (SELECT q.benchmark, q.dataset, q.system, q.model_id, require_latency, file_id, status_given, e2e, query_rows, sample_size, row_number() OVER (PARTITION BY q.benchmark, q.dataset, q.system, q.model_id {_BEST}) AS o
  FROM req q JOIN r ON r.benchmark = q.benchmark AND r.dataset = q.dataset AND r.system = q.system AND (q.model_id IS NULL OR q.model_id = r.model_id)),
p AS (SELECT *, CASE WHEN query_rows > 0 THEN least(200, query_rows) ELSE 200 END AS want FROM c WHERE o = 1 AND require_latency),
bad AS (SELECT benchmark, dataset, system, model_id, CASE WHEN coalesce(status_given IN {_SKIP}, false) THEN NULL WHEN e2e IS NULL THEN 'missing e2e_query_ms_p50' WHEN sample_size IS DISTINCT FROM want THEN 'stale sample size ' || coalesce(sample_size::VARCHAR, 'None') || ', expected ' || want END AS problem FROM p
  UNION ALL SELECT benchmark, dataset, system, model_id, 'missing' FROM req q WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.benchmark = q.benchmark AND r.dataset = q.dataset AND r.system = q.system AND (q.model_id IS NULL OR q.model_id = r.model_id)))
SELECT concat_ws(' / ', benchmark, dataset, system, coalesce(model_id, 'any model')) AS requirement, problem FROM bad WHERE problem IS NOT NULL""",
    "plot_rows": _WITH + "SELECT file_id, benchmark, dataset, family, model_id, system, round(ndcg_at_10, 6) AS ndcg_at_10, round(e2e, 6) AS e2e_ms_p50, round(index_bytes / 1e9, 9) AS storage_gb FROM r WHERE coalesce(status_given, 'completed') = 'completed' AND ndcg_at_10 IS NOT NULL AND e2e IS NOT NULL",
    "best_part": _WITH + """SELECT benchmark, dataset, system, model_id, file_id FROM (SELECT *, row_number() OVER (PARTITION BY benchmark, dataset, system, model_id ORDER BY (NOT contains(str_split(file_path, '/')[-1], '.seq512')), length(str_split(file_path, '/')[-1]), str_split(file_path, '/')[-1], file_id) AS o
  FROM r WHERE status_given IS NULL OR status_given IN ('completed', 'quality_only', 'latency_skipped')) WHERE o = 1""",
    "component_bytes": _WITH + f""", one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY benchmark, dataset, model_id, system ORDER BY file_path DESC, file_id DESC) AS o FROM r) WHERE o = 1),
m AS (SELECT h.file_id, coalesce(TRY_CAST(json_extract_string(h.comp_bytes, '$.' || p.part) AS DOUBLE), c.index_bytes) AS v FROM r h JOIN {_PARTS_SQL} ON h.system = p.system LEFT JOIN one c ON c.benchmark = h.benchmark AND c.dataset = h.dataset AND c.model_id = h.model_id AND c.system = p.part_system WHERE h.family = 'hybrid'),
a AS (SELECT file_id, CASE WHEN count(v) = count(*) THEN sum(v) END AS v FROM m GROUP BY 1)
SELECT r.file_id, round(v, 6) AS component_bytes FROM r LEFT JOIN a USING (file_id) WHERE family = 'hybrid'""",
    "axis_ticks": _WITH + """, g AS (SELECT benchmark, min(e2e) FILTER (WHERE e2e > 0) AS lo, max(e2e) FILTER (WHERE e2e > 0) AS hi FROM r GROUP BY 1),
t AS (SELECT unnest([0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000, 100000])::DOUBLE AS tick) SELECT benchmark, tick FROM g, t WHERE tick >= lo / 1.5 AND tick <= hi * 1.5""",
    "benchmarks_in_order": _WITH + "SELECT DISTINCT benchmark, CASE benchmark WHEN 'beir' THEN 1 WHEN 'bright' THEN 2 WHEN 'limit' THEN 3 ELSE 4 END AS place FROM r",
}
