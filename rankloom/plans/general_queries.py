"""Registered queries of the general data-processing problems: schema drift, nested records, orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import nested_records, orphans, schema_drift


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _drift(spark: SparkSession, sf: str, with_text: bool = False) -> schema_drift.Drift:
    return schema_drift.detect(_t(spark, sf, "result_files"), _t(spark, sf, "schema_catalog"), with_text=with_text)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _drift(spark, sf).changes().select("file_id", "field_path", "change").distinct()


def p1_table(spark: SparkSession, sf: str) -> DataFrame:
    return _drift(spark, sf, with_text=True).table()


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return _drift(spark, sf).report()


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    nodes = nested_records.explode_records(_t(spark, sf, "result_files"), with_fields=False)
    return nodes.where("ordinal is not null").select("file_id", "parent_path", "node_path")


def p3_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of all flat tables in long form: kind, keys and the row's own fields as JSON."""
    nodes = nested_records.explode_records(_t(spark, sf, "result_files"))
    return nodes.select("file_id", "node_no", "parent_no", "kind", "ordinal", "node_path", F.to_json("fields").alias("fields"))


def p3_table_serving_batches(spark: SparkSession, sf: str) -> DataFrame:
    """One of the flat tables with its typed columns."""
    tables = nested_records.flat_tables(nested_records.explode_records(_t(spark, sf, "result_files")))
    return tables["latency.serving_batches"]


def _orphans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    refs = orphans.references(_t(spark, sf, "qrels"), "qrel_id", "dataset", {"query": "query_id", "doc": "doc_id"}, "judged_at")
    owners = orphans.parents(_t(spark, sf, "queries"), "query", "dataset", "query_id", "loaded_at", "deleted_at").unionByName(
        orphans.parents(_t(spark, sf, "corpus"), "doc", "dataset", "doc_id", "loaded_at", "deleted_at"))
    return refs, orphans.find_orphans(refs, owners)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf)[1].select(F.col("ref_id").alias("qrel_id"), "side", "reason").distinct()


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_report(*_orphans(spark, sf))


QUERIES = {f.__name__: f for f in (p1_found, p1_table, p1_report, p3_found, p3_nodes, p3_table_serving_batches, p4_found, p4_report)}

_P4 = r"""
WITH q AS (SELECT qrel_id, coalesce(lower(regexp_replace(dataset, '^\s+|\s+$', '', 'g')), '') AS ns, query_id, doc_id, judged_at FROM qrels),
refs AS (
  SELECT qrel_id, 'query' AS side, ns, lower(regexp_replace(query_id, '^\s+|\s+$', '', 'g')) AS k, judged_at FROM q
  UNION ALL SELECT qrel_id, 'doc', ns, lower(regexp_replace(doc_id, '^\s+|\s+$', '', 'g')), judged_at FROM q),
own AS (
  SELECT 'query' AS side, coalesce(lower(regexp_replace(dataset, '^\s+|\s+$', '', 'g')), '') AS ns, lower(regexp_replace(query_id, '^\s+|\s+$', '', 'g')) AS k, loaded_at, deleted_at FROM queries
  UNION ALL SELECT 'doc', coalesce(lower(regexp_replace(dataset, '^\s+|\s+$', '', 'g')), ''), lower(regexp_replace(doc_id, '^\s+|\s+$', '', 'g')), loaded_at, deleted_at FROM corpus),
told AS (
  SELECT r.qrel_id, r.side, r.ns, r.judged_at, r.k, count(o.k) AS n,
    count(*) FILTER (WHERE o.k IS NOT NULL AND (o.loaded_at IS NULL OR o.loaded_at <= r.judged_at) AND (o.deleted_at IS NULL OR r.judged_at < o.deleted_at)) AS alive,
    count(*) FILTER (WHERE o.k IS NOT NULL AND (o.loaded_at IS NULL OR o.loaded_at <= r.judged_at)) AS loaded
  FROM (SELECT DISTINCT * FROM refs WHERE k IS NOT NULL AND k <> '') r LEFT JOIN own o ON r.side = o.side AND r.ns = o.ns AND r.k = o.k
  GROUP BY ALL),
verdict AS (SELECT *, CASE WHEN n = 0 THEN 'missing' WHEN judged_at IS NULL OR alive > 0 THEN NULL WHEN loaded > 0 THEN 'deleted' ELSE 'late' END AS reason FROM told)
"""

SQL = {
    "p4_found": _P4 + "SELECT DISTINCT qrel_id, side, reason FROM verdict WHERE reason IS NOT NULL",
    "p4_report": _P4 + """SELECT side, ns, strftime(judged_at, '%Y-%m') AS month, count(*) AS refs, count(*) FILTER (WHERE reason = 'missing') AS missing,
  count(*) FILTER (WHERE reason = 'deleted') AS deleted, count(*) FILTER (WHERE reason = 'late') AS late FROM verdict GROUP BY 1, 2, 3""",
}
