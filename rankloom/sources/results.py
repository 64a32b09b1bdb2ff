"""Run facts: result files as rows, rankings sidecars, manifests.

A fact file is one JSON object. Bodies are parsed once into a variant in the JVM, strictly: a body that is not a valid
object gives no row. A number counts only where the file holds a JSON number (never a boolean or a numeric string)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "0.3"
# Serving size of a run, first present wins.
INDEX_BYTES = ("index_bytes_backend", "index_bytes_binary_rerank", "index_bytes_muvera", "index_bytes_pq", "index_bytes_hnsw", "index_bytes_fp16", "index_bytes_int8")
QUALITY = ("ndcg_at_10", "recall_at_100", "mrr_at_10", "map_at_100")
P99 = ("e2e_query_ms_p99", "serving_batch_1_e2e_ms_p99", "e2e_ms_p99")


def read_folder(spark: SparkSession, folder: str, include_smoke: bool = False) -> DataFrame:
    """(file_path, body) of every JSON file below folder; smoke and sweep trees, sidecars and manifests are left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("body"))
    return files.where(keep_path(F.col("file_path"), include_smoke))


def keep_path(path: Column, include_smoke: bool = False) -> Column:
    parts = F.split(path, "/")
    ok = ~F.array_contains(parts, "sweeps") & ~path.endswith(".rankings.json") & ~path.contains("manifest")
    return ok if include_smoke else ok & ~F.array_contains(parts, "smoke")


def parsed(files: DataFrame) -> DataFrame:
    """files with a variant `j`; rows whose body is no JSON object are dropped."""
    got = files.withColumn("j", F.try_parse_json("body"))
    return got.where(F.schema_of_variant("j").startswith("OBJECT"))


def text(path: str) -> Column:
    """The string at path; null for anything else."""
    v = F.try_variant_get("j", f"$.{path}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get("j", f"$.{path}", "string"))


def number(path: str) -> Column:
    v = F.try_variant_get("j", f"$.{path}", "variant")
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get("j", f"$.{path}", "double"))


def has(path: str) -> Column:
    """Whether the file has the path, be it null."""
    return F.try_variant_get("j", f"$.{path}", "variant").isNotNull()


def facts(files: DataFrame, any_version: bool = False) -> DataFrame:
    """One flat row per fact file that names a model, a dataset and a quality section. files: file_id, file_path,
    created_at, body."""
    p = parsed(files)
    p = p.where(has("model") & has("dataset") & has("quality"))
    if not any_version:
        p = p.where(text("schema_version") == SCHEMA_VERSION)
    return p.select(
        "file_id", "file_path", "created_at", text("dataset.benchmark").alias("benchmark"), text("dataset.name").alias("dataset"), number("dataset.query_rows").cast("long").alias("query_rows"),
        text("model.id").alias("model_id"), text("model.family").alias("model_family"), text("model.search_mode").alias("search_mode"), number("model.truncate_dim").cast("long").alias("truncate_dim"),
        text("retrieval_system.name").alias("system_given"), text("retrieval_system.family").alias("system_family"), text("retrieval_system.backend").alias("backend_given"), text("retrieval_system.compression").alias("compression_given"),
        F.coalesce(F.try_variant_get("j", "$.retrieval_system.exact", "boolean"), F.lit(False)).alias("exact"), text("status").alias("status_given"), text("latency.status").alias("latency_status"),
        number("latency.e2e_query_ms_p50").alias("e2e_ms_p50"), F.coalesce(*[number(f"latency.{k}") for k in P99]).alias("e2e_ms_p99"), number("latency.query_encode_ms_p50").alias("encode_ms_p50"),
        number("latency.retrieval_ms_p50_topk100").alias("retrieval_ms_p50"), number("latency.latency_sample_size").cast("long").alias("sample_size"),
        F.try_variant_get("j", "$.retrieval_system.params.components", "array<string>").alias("components"), *[text(f"retrieval_system.params.{c}").alias(c) for c in ("dense_model", "dense_system", "li_model", "li_system")],
        F.try_variant_get("j", "$.latency.component_e2e_ms_p50", "map<string,double>").alias("component_ms"), F.try_variant_get("j", "$.storage.component_index_bytes", "map<string,double>").alias("component_bytes"),
        *[number(f"quality.{m}").alias(m) for m in QUALITY], *[number(f"storage.{k}").alias(k) for k in INDEX_BYTES], number("storage.index_bytes_per_doc").alias("index_bytes_per_doc"),
        number("cost.cost_per_million_queries_usd").alias("cost_per_million_queries_usd"),
        F.coalesce(*[F.nullif(text(f"{s}precision"), F.lit("")) for s in ("run.", "latency.", "model.", "system.", "retrieval_system.", "")], F.lit("unknown")).alias("precision"),
        F.coalesce(text("run.hardware_label"), text("system.platform"), F.lit("unknown")).alias("hardware"), text("run.created_at").alias("run_created_at"),
    ).dropDuplicates(["file_id"])


def first_source(spark: SparkSession, folders: list[str], fallback: DataFrame) -> DataFrame:
    """The JSON rows of the first of the folders that can be read, else the fallback."""
    for folder in folders:
        try:
            got = spark.read.json(folder)
        except AnalysisException:
            continue
        if got.columns and "_corrupt_record" not in got.columns:
            return got
    return fallback


def read_sidecar(sidecars: DataFrame) -> DataFrame:
    """(query_id, rank, doc_id, score) of rankings sidecars (body)."""
    schema = "queries array<struct<query_id:string,qrels:map<string,double>,hits:array<struct<rank:int,doc_id:string,score:double>>>>"
    q = sidecars.select(F.explode(F.from_json("body", schema)["queries"]).alias("q"))
    return q.select("q.query_id", F.explode("q.hits").alias("h")).select("query_id", "h.rank", "h.doc_id", "h.score")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)
