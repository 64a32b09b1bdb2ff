"""Latency, cost and storage arithmetic."""

from __future__ import annotations

import random
from collections.abc import Callable
from time import perf_counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOURLY_USD = 1.99


def latency_summary(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, samples, p50, p99, mean) with linear interpolation between order statistics; exact."""
    v = F.col(value)
    return samples.groupBy(*by).agg(F.count(v).alias("samples"), F.percentile(v, 0.5).alias("p50"), F.percentile(v, 0.99).alias("p99"), F.avg(v).alias("mean"))


def sample_positions(n: int, size: int = 200, seed: int = 13) -> list[int]:
    """The fixed latency sample: positions in query order, sorted."""
    return sorted(random.Random(seed).sample(range(n), min(size, n)))


def latency_sample(queries: DataFrame, by: list[str], size: int = 200, seed: int = 13) -> DataFrame:
    """The queries of the fixed sample of each group, numbered in string order of their id; at most `size` positions per
    group are computed from the counts. A group is numbered prefix by prefix of its ids, so that no task sorts it whole."""
    spark = queries.sparkSession
    placed = queries.withColumn("_run", F.substring("query_id", 1, 8))  # rows of one prefix stay together; prefixes are ordered
    per = placed.groupBy(*by, "_run").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy(*by, "_run").orderBy("query_id")) - 1
    numbered = placed.withColumn("_own", own).join(offsets, [*by, "_run"]).withColumn("position", (F.col("_own") + F.col("_before")).cast("int")).drop("_own", "_before", "_run")
    counts = per.groupBy(*by).agg(F.sum("n").alias("n")).collect()
    wanted = [(*[r[b] for b in by], p) for r in counts for p in sample_positions(r.n, size, seed)]
    fields = ", ".join([*[f"{b} {queries.schema[b].dataType.simpleString()}" for b in by], "position int"])
    return numbered.join(F.broadcast(spark.createDataFrame(wanted, fields)), [*by, "position"])


def cyclic_batch(rows: DataFrame, position: str, n: Column, batch: int, offset: int) -> DataFrame:
    """Slot 0..batch-1 of a batch that starts at offset and wraps around n rows."""
    slots = rows.sparkSession.range(batch).select(F.col("id").alias("slot"))
    return slots.crossJoin(F.broadcast(rows.agg(n.alias("n")))).select("slot", F.pmod(F.col("slot") + offset, F.col("n")).alias(position))


def parse_batches(value: str | None) -> list[int]:
    """Comma-separated batch sizes: sorted, each once, 1 if there are none."""
    return sorted({int(x) for x in (value or "").split(",") if x.strip()}) or [1]


def query_cost(e2e_ms: Column, hourly_usd: Column | float = HOURLY_USD) -> Column:
    """USD per million queries."""
    return e2e_ms / 1000 * 1e6 / 3600 * hourly_usd


def indexing_cost(docs_per_second: Column, hourly_usd: Column | float = HOURLY_USD) -> Column:
    """USD per million documents; null where the rate is null or not positive."""
    return F.when(docs_per_second > 0, 1e6 / docs_per_second / 3600 * hourly_usd)


def docs_per_second(docs: Column, encode_ms: Column) -> Column:
    return F.when(encode_ms > 0, docs / (encode_ms / 1000))


def storage_summary(fp16_bytes: Column, docs: Column, pq_bytes: Column | None = None) -> list[Column]:
    return [
        fp16_bytes.cast("long").alias("index_bytes_fp16"), F.floor(fp16_bytes / 2).cast("long").alias("index_bytes_int8"), (pq_bytes if pq_bytes is not None else F.lit(None).cast("long")).alias("index_bytes_pq"),
        F.when(docs > 0, fp16_bytes / docs).otherwise(F.lit(0.0)).alias("index_bytes_per_doc"),
    ]


def dense_bytes(n: Column, dims: Column, links: int = 32) -> dict[str, Column]:
    """Bytes of n vectors by form. The graph form is an estimate: full vectors and link lists."""
    return {"fp16": n * dims * 2, "int8": n * dims, "binary_rerank": n * F.ceil(dims / 8) + n * dims * 2, "hnsw": n * (4 * dims + 4 * (2 * links + 3))}


def late_bytes(tokens: Column, dims: Column, docs: Column, encoding: int = 20 * 32 * 16) -> dict[str, Column]:
    return {"fp16": tokens * dims * 2, "muvera": docs * encoding * 4 + tokens * dims * 2}


def timed_status(run: Callable[[], object]) -> tuple[object, float, str]:
    """(result or None, milliseconds, "ok" or "oom"): an action that runs out of memory is a status, any other error is raised."""
    t = perf_counter()
    try:
        got, status = run(), "ok"
    except Exception as e:  # noqa: BLE001 - told apart by what it says
        if not isinstance(e, MemoryError) and "OutOfMemory" not in str(e):
            raise
        got, status = None, "oom"
    return got, (perf_counter() - t) * 1000, status


def serving_batch(encode: Callable[[list[int]], object], search: Callable[[object], object], n: int, batch: int, repeats: int = 3, warm_up: int = 1) -> dict[str, object]:
    """Times of one batch size over a sample of n queries, per query: p50 and p99 of encoding, of retrieval and of both, where
    the end-to-end median is the sum of the two medians. Batch i starts at query i * batch and wraps around."""
    rows = lambda i: [(i * batch + j) % n for j in range(batch)]
    for i in range(warm_up if n else 0):
        if timed_status(lambda: search(encode(rows(i))))[2] != "ok":
            return {"batch_size": batch, "status": "oom"}
    enc, ret = [], []
    for i in range(repeats if n else 0):
        asked, ms, status = timed_status(lambda: encode(rows(i)))
        enc.append(ms / batch)
        if status == "ok":
            _, ms, status = timed_status(lambda: search(asked))
            ret.append(ms / batch)
        if status != "ok":
            return {"batch_size": batch, "status": status}
    return {"batch_size": batch, "status": "ok", "samples": len(enc)} | end_to_end(enc, ret)


def end_to_end(encode_ms: list[float], retrieval_ms: list[float]) -> dict[str, float | None]:
    def q(v: list[float], p: float) -> float | None:
        v = sorted(v)
        at = p * (len(v) - 1)
        return v[int(at)] + (at - int(at)) * (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]) if v else None

    both = [a + b for a, b in zip(encode_ms, retrieval_ms)]
    e, r = q(encode_ms, 0.5), q(retrieval_ms, 0.5)
    return {"query_encode_ms_p50": e, "retrieval_ms_p50": r, "e2e_ms_p50": None if e is None or r is None else e + r, "e2e_ms_p99": q(both, 0.99)}


def latency_row(batches: list[dict[str, object]], sample: int) -> dict[str, object]:
    """One flat row of all measured batch sizes: serving_batch_<size>_<field>, and the isolated figures of batch 1; without a
    measurement the row of a skipped run."""
    if not batches:
        return {"status": "skipped", "latency_sample_size": 0, "e2e_query_ms_p50": None, "e2e_query_ms_p99": None}
    flat = {f"serving_batch_{b['batch_size']}_{k}": v for b in batches for k, v in b.items() if k != "batch_size"}
    one = next((b for b in batches if b["batch_size"] == 1 and b["status"] == "ok"), {})
    whole = all(b["status"] == "ok" for b in batches)
    return {"status": "measured" if whole else "partial", "latency_sample_size": sample, "e2e_query_ms_p50": one.get("e2e_ms_p50"), "e2e_query_ms_p99": one.get("e2e_ms_p99")} | flat


def timed(run: Callable[[], object], repeats: int = 1, warm_up: int = 0) -> list[float]:
    """Milliseconds of each repeat of an action, after unmeasured warm-up runs."""
    for _ in range(warm_up):
        run()
    out = []
    for _ in range(repeats):
        t = perf_counter()
        run()
        out.append((perf_counter() - t) * 1000)
    return out
