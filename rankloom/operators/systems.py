"""Retrieval systems by name: which family they serve, their parameters, their index, and the search.

An index is built from a corpus, or opened from a folder if it was saved there for the same system, parameters and documents;
otherwise it is built anew and saved. Saved indexes are parquet tables and a table of metadata, so any cluster can read
them. Exact systems need none."""

from __future__ import annotations

import io
import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import dense, late, quantised

# Systems by family with the parameters that a run names; the first of a family is its default.
SYSTEMS: dict[str, dict[str, dict[str, Any]]] = {
    "dense": {
        "dense-flat": {},
        "dense-hnsw": {"m": 32, "ef_construction": 200, "ef_search": 128},
        "dense-opq-ivfpq": {"nlist": "auto", "pq_m": 32},
        "dense-rabitq": {"nlist": "auto", "pq_m": None},
        "dense-scann": {"candidates": 1000},
        "dense-binary-rerank": {"candidates": 1000},
    },
    "late_interaction": {
        "li-exact": {},
        "li-fastplaid": {"nbits": 8, "n_ivf_probe": 32, "n_full_scores": 8192, "kmeans_niters": 4, "use_fast": True},
        "li-muvera": {"k_sim": 5, "dim_proj": 16, "r_reps": 20, "candidates": 1000},
    },
}


def family_of(model_id: str, explicit: str | None = None) -> str:
    return explicit or ("late_interaction" if "colbert" in model_id.lower() else "dense")


def resolve(family: str, name: str | None = None) -> str:
    """The system of that name, or the default of the family; ValueError for an unknown one or one of another family."""
    if family not in SYSTEMS:
        raise ValueError(f"unknown family {family!r}; known: {sorted(SYSTEMS)}")
    if name is None:
        return next(iter(SYSTEMS[family]))
    if name not in SYSTEMS[family]:
        other = [f for f, systems in SYSTEMS.items() if name in systems]
        raise ValueError(f"{name} serves {other[0]} models, not {family} ones" if other else f"unknown system {name!r}")
    return name


def parameters(name: str, **given: Any) -> dict[str, Any]:
    """The parameters that a run of the system names: its own ones, where given in place of the usual; others are left out."""
    own = next(systems[name] for systems in SYSTEMS.values() if name in systems)
    return {k: given.get(k, v) if given.get(k) is not None else v for k, v in own.items()}


@dataclass(frozen=True)
class Prepared:
    """status: not_applicable, built or loaded."""

    name: str
    params: dict[str, Any]
    corpus: DataFrame
    index: Any
    status: str


_CODES = {"dense-opq-ivfpq": quantised.ProductCodes, "dense-rabitq": quantised.OneBitCodes, "dense-scann": quantised.PairCodes}


def _build(name: str, corpus: DataFrame, p: dict[str, Any], dims: int) -> Any:
    if name == "dense-hnsw":
        return quantised.graph_build(corpus, p["m"])
    if name in _CODES:
        own = {"parts": p["pq_m"]} if name == "dense-opq-ivfpq" else {"candidates": p["candidates"]} if name == "dense-scann" else {}
        return quantised.build(corpus, _CODES[name](**own))
    if name == "li-fastplaid":
        return late.plaid_build(corpus, bits=p["nbits"])
    if name == "li-muvera":
        return late.fixed_encodings(corpus, "doc_id", False, dims, p["k_sim"], p["dim_proj"], p["r_reps"])
    return None


def identity(corpus: DataFrame) -> dict[str, int]:
    """What tells sets of documents apart: their number and an order-free hash of ids and contents."""
    content = [c for c in ("v", "tokens") if c in corpus.columns]
    r = corpus.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("doc_id", *content)), F.lit(0)).alias("h")).first()
    return {"documents": r.n, "hash": r.h}


def _save(spark: SparkSession, index: Any, path: str, meta: dict[str, Any]) -> None:
    arrays: dict[str, Any] = {}
    if isinstance(index, quantised.CodeIndex):
        index.codes.write.mode("overwrite").parquet(f"{path}/rows")
        q = index.quantiser
        arrays = {k: np.stack(v) if k == "books" else np.asarray(v) for k, v in q.state.items()} | {f"own_{k}": np.asarray(v) for k, v in q.__dict__.items() if k != "state"}
    elif isinstance(index, quantised.GraphIndex):
        index.blocks.write.mode("overwrite").parquet(f"{path}/rows")
        arrays = {"links": np.asarray(index.links)}
    elif isinstance(index, late.PlaidIndex):
        index.codes.repartition("c").sortWithinPartitions("c", "doc_id", "t").write.mode("overwrite").parquet(f"{path}/rows")
        arrays = {"centroids": index.centroids, "spread": np.asarray(index.spread), "bits": np.asarray(index.bits)}
    else:
        index.write.mode("overwrite").parquet(f"{path}/rows")
    out = io.BytesIO()
    np.savez(out, **arrays)
    # last, so that a folder with metadata is whole
    spark.createDataFrame([(json.dumps(meta, sort_keys=True), out.getvalue())], "meta string, arrays binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def _open(spark: SparkSession, name: str, corpus: DataFrame, path: str, meta: dict[str, Any]) -> Any:
    """The index saved in path, or None if there is none or it is one of other parameters or documents."""
    try:
        row = spark.read.parquet(f"{path}/meta").first()
    except AnalysisException:
        return None
    if row is None or row.meta != json.dumps(meta, sort_keys=True):
        return None
    arrays, rows = dict(np.load(io.BytesIO(row.arrays))), spark.read.parquet(f"{path}/rows")
    if name in _CODES:
        own = {k.removeprefix("own_"): v.item() for k, v in arrays.items() if k.startswith("own_")}
        state = {k: (list(v) if k == "books" else v.item() if v.ndim == 0 else v) for k, v in arrays.items() if not k.startswith("own_")}
        return quantised.CodeIndex(_CODES[name](**own, state=state), rows, corpus)
    if name == "dense-hnsw":
        return quantised.GraphIndex(rows, arrays["links"].item())
    if name == "li-fastplaid":
        return late.PlaidIndex(arrays["centroids"], arrays["spread"].item(), arrays["bits"].item(), rows)
    return rows


def prepare(name: str, corpus: DataFrame, dims: int, folder: str | None = None, **given: Any) -> Prepared:
    """corpus: doc_id and v, or doc_id and tokens. folder: where the index is looked for and saved; none: it is built lazily
    for this session."""
    p, spark = parameters(name, **given), corpus.sparkSession
    if name in ("dense-flat", "dense-binary-rerank", "li-exact"):
        return Prepared(name, p, corpus, None, "not_applicable")
    if folder is None:
        return Prepared(name, p, corpus, _build(name, corpus, p, dims), "built")
    path, meta = f"{folder.rstrip('/')}/{name}", {"system": name, "params": p, "dims": dims} | identity(corpus)
    if (index := _open(spark, name, corpus, path, meta)) is not None:
        return Prepared(name, p, corpus, index, "loaded")
    _save(spark, _build(name, corpus, p, dims), path, meta)
    return Prepared(name, p, corpus, _open(spark, name, corpus, path, meta), "built")


def search(prepared: Prepared, queries: DataFrame, k: int, dims: int) -> DataFrame:
    """(query_id, doc_id, score, rank) of the prepared system. queries: query_id and v, or query_id and tokens."""
    name, p, corpus, index = prepared.name, prepared.params, prepared.corpus, prepared.index
    run: dict[str, Callable[[], DataFrame]] = {
        "dense-flat": lambda: dense.flat(corpus, queries, k, []),
        "dense-binary-rerank": lambda: dense.binary_rerank(corpus, queries, k, [], dims, p["candidates"]),
        "dense-hnsw": lambda: quantised.graph_search_index(index, queries, k, p["ef_search"]),
        "li-exact": lambda: late.exact(corpus, queries, k),
        "li-fastplaid": lambda: late.plaid_search(index, queries, k, p["n_ivf_probe"], p["n_full_scores"]),
        "li-muvera": lambda: late.muvera_search(index, corpus, queries, k, dims, p["candidates"], p["k_sim"], p["dim_proj"], p["r_reps"]),
    }
    return run[name]() if name in run else quantised.search(index, queries, k)


def encoded(texts: DataFrame, encode: Callable[[list[str]], np.ndarray], key: str) -> DataFrame:
    """(key, v) of texts (key, text) by a caller's model, batch by batch: encode maps a list of texts to unit or other rows of
    numbers; they are brought to unit length. Null texts count as empty ones."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.asarray(encode([t or "" for t in b.column("text").to_pylist()]), dtype=np.float32)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(list(x), pa.list_(pa.float32()))], names=[key, "v"])

    return texts.select(key, "text").mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, v array<float>")


def saved_vectors(df: DataFrame, path: str, meta: dict[str, Any]) -> tuple[DataFrame, bool]:
    """(vectors, whether they were there): the table saved in path if its metadata are equal, else df, saved there now."""
    spark, text = df.sparkSession, json.dumps(meta, sort_keys=True)
    try:
        row = spark.read.parquet(f"{path}/meta").first()
        if row is not None and row.meta == text:
            return spark.read.parquet(f"{path}/rows"), True
    except AnalysisException:
        pass
    df.write.mode("overwrite").parquet(f"{path}/rows")
    spark.createDataFrame([(text,)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return spark.read.parquet(f"{path}/rows"), False
