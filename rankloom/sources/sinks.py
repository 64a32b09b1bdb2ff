"""Writers: facts, rankings sidecars, skip rows, leaderboard export, manifests, result paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def safe_name(model: Column) -> Column:
    """A model id as a path part."""
    return F.replace(F.replace(model, F.lit("/"), F.lit("__")), F.lit(" "), F.lit("_"))


def result_path(benchmark: Column, dataset: Column, system: Column, model: Column, suffix: Column, limit: int | None = None) -> Column:
    """Where a fact file belongs; limited runs go to the smoke tree."""
    root = F.lit("results/smoke" if limit is not None else "results")
    return F.concat_ws("/", root, benchmark, dataset, system, F.concat(safe_name(model), F.coalesce(suffix, F.lit("")), F.lit(".json")))


def suffix(max_seq_length: int | None = None, truncate_dim: int | None = None, **params: object) -> str:
    """The parameters that tell runs of one model and system apart, as dotted parts in the order given."""
    parts = [f"dim{truncate_dim}"] if truncate_dim else []
    parts += [f"seq{max_seq_length}"] if max_seq_length else []
    parts += [f"{k}{v}" if k != "kind" else str(v) for k, v in params.items() if v is not None]
    return "".join(f".{p}" for p in parts)


def write_facts(facts: DataFrame, path: str) -> None:
    facts.write.mode("overwrite").json(path, ignoreNullFields=False)


def sidecar(rankings: DataFrame, qrels: DataFrame, query: list[str], judged: list[str] | None = None) -> DataFrame:
    """(query, qrels map, hits ordered by rank). judged: the columns of query that judgements have, if not all."""
    key = judged or query
    hits = rankings.groupBy(*query).agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("hits"))
    rels = qrels.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("doc_id", "rel"))).alias("qrels"))
    return hits.join(rels, key, "left")


def skip_rows(spark: SparkSession, cells: list[tuple[str, str, str, str]], status: str, reason: str) -> DataFrame:
    """Rows (benchmark, dataset, system, model_id) that were not run, with null measurements."""
    df = spark.createDataFrame(cells, "benchmark string, dataset string, system string, model_id string")
    nulls = [F.lit(None).cast("double").alias(c) for c in ("ndcg_at_10", "recall_at_100", "mrr_at_10", "map_at_100", "e2e_ms_p50", "index_bytes", "cost_per_million_queries_usd")]
    return df.select("*", F.lit(status).alias("status"), F.lit(reason).alias("skip_reason"), *nulls)


def export_summary(runs: DataFrame) -> DataFrame:
    """Number of rows and of different benchmarks, models and systems."""
    return runs.agg(F.count("*").alias("runs"), F.count_distinct("benchmark").alias("benchmarks"), F.count_distinct("model_id").alias("models"), F.count_distinct("system").alias("systems"))


def write_export(runs: DataFrame, path: str) -> None:
    runs.write.mode("overwrite").json(f"{path}/rows", ignoreNullFields=False)
    export_summary(runs).write.mode("overwrite").json(f"{path}/summary")


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def merge_measurements(facts: DataFrame, measured: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """facts with the given columns replaced where a new measurement exists; write it to another path than it came from."""
    m = measured.select(*key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return reduce(lambda d, c: d.withColumn(c, F.coalesce(f"_new_{c}", c)).drop(f"_new_{c}"), columns, facts.join(m, key, "left"))


def cache_key(**fields: Column) -> Column:
    """24 hex digits of the SHA-256 of the fields as JSON in the order of their names, null where a field is null."""
    quoted = lambda c: F.coalesce(F.to_json(F.struct(c.alias("v"))), F.lit("{}"))
    parts = [F.concat(F.lit(f'"{k}": '), F.coalesce(F.nullif(F.regexp_extract(quoted(fields[k]), r'(?s)^\{"v":(.*)\}$', 1), F.lit("")), F.lit("null"))) for k in sorted(fields)]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256), 1, 24)


def representation_key(family: Column, truncate_dim: Column, max_seq_length: Column) -> Column:
    """What tells representations of one model apart; only dense ones have a key."""
    part = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(name), c.cast("string")))
    return F.when(family == "dense", F.nullif(F.concat_ws("-", part("dim", truncate_dim), part("seq", max_seq_length)), F.lit("")))


def provenance(spark: SparkSession, hardware: str = "unknown", commit: str | None = None) -> dict[str, object]:
    """Where and when a run was made, as literals of its row."""
    import platform
    from datetime import UTC, datetime

    return {"created_at": datetime.now(UTC).isoformat(), "platform": platform.platform(), "hardware_label": hardware, "git_sha": commit, "spark": spark.version, "parallelism": spark.sparkContext.defaultParallelism}


def fact_rows(cells: DataFrame, quality: DataFrame, key: list[str], run: dict[str, object]) -> DataFrame:
    """Facts of sparse and hybrid runs: cells with their measured quality and the provenance of the run as a struct."""
    return cells.join(quality, key, "left").withColumn("run", F.struct(*[F.lit(v).alias(k) for k, v in run.items()])).withColumn("schema_version", F.lit("0.3"))


def write_hybrid_manifest(rows: DataFrame, path: str) -> None:
    """One JSON row per hybrid run: its path, system and parts."""
    rows.write.mode("overwrite").json(path, ignoreNullFields=False)
