"""Retrieval datasets: documents, queries and relevance judgements as DataFrames.

All loaders work on tables that may hold several datasets: `by` names the columns that tell datasets apart (none for a
single dataset). Rules: the first present of several column spellings is the id; title and text are joined by a line break
where both have content; a judgement without a score counts 1; judgements of zero or below are dropped; of several
judgements of a pair the last one wins; only judged queries are evaluated, in string order of their id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.text import strip

# Public dataset names by benchmark.
REGISTRY = {
    "beir": ("nfcorpus", "scifact", "fiqa", "arguana", "scidocs", "trec-covid"),
    "bright": ("biology", "economics", "psychology", "robotics", "stackoverflow", "leetcode"),
    "limit": ("limit",),
}
# Accepted spellings, first present wins.
DOC_ID = ("_id", "id", "corpus-id", "corpus_id", "doc_id")
QUERY_ID = ("_id", "id", "query-id", "query_id")
QREL_QUERY = ("query-id", "query_id", "qid")
QREL_DOC = ("corpus-id", "corpus_id", "doc_id")
QREL_SCORE = ("score", "relevance")


def benchmark_of(name: str) -> str:
    """The benchmark of a registered dataset; ValueError for an unknown one."""
    for benchmark, names in REGISTRY.items():
        if name in names:
            return benchmark
    raise ValueError(f"unknown dataset {name!r}; known: {sorted(n for v in REGISTRY.values() for n in v)}")


@dataclass(frozen=True)
class RetrievalDataset:
    """documents: by, doc_id, title, text. queries: by, query_id, text. qrels: by, query_id, doc_id, rel.
    qrels_rows: by, qrels_rows (every kept judgement counts, also repeated ones)."""

    benchmark: str
    name: str
    documents: DataFrame
    queries: DataFrame
    qrels: DataFrame
    qrels_rows: DataFrame
    by: tuple[str, ...] = ()


def row_id(df: DataFrame, spellings: tuple[str, ...]) -> Column:
    """The first non-null of the spellings that df has, as a string; KeyError if it has none."""
    present = [c for c in spellings if c in df.columns]
    if not present:
        raise KeyError(f"none of {spellings} in {df.columns}")
    return F.coalesce(*[F.col(f"`{c}`").cast("string") for c in present])


def row_text(title: Column, text: Column) -> Column:
    """Both stripped; title, line break and text where both have content, else whichever has."""
    return F.concat_ws("\n", F.nullif(strip(title), F.lit("")), F.nullif(strip(text), F.lit("")))


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def load(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, limit: int | None = None, by: tuple[str, ...] = (), name: str = "", benchmark: str = "", order: list[Column] | None = None) -> RetrievalDataset:
    """Corpus, queries and judgements in separate tables. order: what makes a judgement the last one (default: its score)."""
    by_cols = list(by)
    docs = corpus.select(*by_cols, row_id(corpus, DOC_ID).alias("doc_id"), F.coalesce(strip(_optional(corpus, "title")), F.lit("")).alias("title"), row_text(_optional(corpus, "title"), _optional(corpus, "text")).alias("text"))
    score = F.coalesce(*[F.col(c).cast("double") for c in QREL_SCORE if c in qrels.columns], F.lit(1.0))
    rels = qrels.select(*by_cols, row_id(qrels, QREL_QUERY).alias("query_id"), row_id(qrels, QREL_DOC).alias("doc_id"), score.alias("rel"), F.struct(*(order or [score])).alias("o")).where("rel > 0 and query_id is not null and doc_id is not null")
    qrels_rows = rels.groupBy(*by_cols).agg(F.count("*").alias("qrels_rows"))
    last = rels.groupBy(*by_cols, "query_id", "doc_id").agg(F.max_by("rel", "o").alias("rel"))
    q = queries.select(*by_cols, row_id(queries, QUERY_ID).alias("query_id"), row_text(_optional(queries, "title"), _optional(queries, "text")).alias("text"))
    q = q.join(last, [*by_cols, "query_id"], "left_semi")
    if limit is not None:
        w = Window.partitionBy(*by_cols).orderBy("query_id")
        q = q.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).drop("r")
        last = last.join(q, [*by_cols, "query_id"], "left_semi")
        qrels_rows = rels.join(q, [*by_cols, "query_id"], "left_semi").groupBy(*by_cols).agg(F.count("*").alias("qrels_rows"))
    return RetrievalDataset(benchmark, name, docs, q, last, qrels_rows, by)


def load_gold(examples: DataFrame, documents: DataFrame, limit: int | None = None, by: tuple[str, ...] = (), name: str = "", benchmark: str = "bright") -> RetrievalDataset:
    """Examples with a list of gold ids: each becomes a judgement of 1. Queries without gold ids stay; metrics skip them."""
    by_cols = list(by)
    q = examples.select(*by_cols, F.col("id").cast("string").alias("query_id"), strip(F.coalesce(F.col("query"), F.lit(""))).alias("text"), "gold_ids")
    if limit is not None:
        q = q.withColumn("r", F.row_number().over(Window.partitionBy(*by_cols).orderBy("query_id"))).where(F.col("r") <= limit).drop("r")
    rels = q.select(*by_cols, "query_id", F.explode("gold_ids").alias("doc_id")).where("doc_id is not null").withColumn("rel", F.lit(1.0))
    docs = documents.select(*by_cols, F.col("id").cast("string").alias("doc_id"), F.lit("").alias("title"), strip(F.coalesce(F.col("content"), F.lit(""))).alias("text"))
    return RetrievalDataset(benchmark, name, docs, q.drop("gold_ids"), rels.distinct(), rels.groupBy(*by_cols).agg(F.count("*").alias("qrels_rows")), by)


def load_folder(spark: SparkSession, folder: str, name: str, limit: int | None = None) -> RetrievalDataset:
    """A registered dataset from parquet: corpus, queries, qrels, or examples and documents for gold-id datasets."""
    benchmark = benchmark_of(name)
    read = lambda t: spark.read.parquet(f"{folder}/{name}/{t}.parquet")
    if benchmark == "bright":
        return load_gold(read("examples"), read("documents"), limit, name=name)
    return load(read("corpus"), read("queries"), read("qrels"), limit, name=name, benchmark=benchmark)
