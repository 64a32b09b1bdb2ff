"""References to records that do not exist.

Method: references and the validity intervals of parent rows are brought to one row format, co-partitioned by key and
sorted by time, and merged in one linear sweep: a running count of the parent rows alive tells for every reference
whether its key lives at its time; the rest of the partition tells missing, deleted and late apart.

Skew: references are reduced to distinct (key, time) before the shuffle, parent rows to distinct intervals. A key that
has more than 1/HOT_SHARE of all rows is cut into time ranges, each swept on its own with the count carried in; there are
at most HOT_SHARE such keys, so their table is bounded and may be broadcast.

Defined results for odd input: a null or blank key is no reference and no parent; a null namespace compares equal to a
null one; a reference without a time can only be `missing`; a parent row without a start lives from the beginning, one
without an end for ever, one that ends at or before its start never lives (but exists); repeated rows count once; empty
tables of parents make every reference missing. Columns are renamed on entry, so extra columns never clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import tidy, tidy_key
from rankloom.session import materialize

HOT_SHARE = 2000
HOT_LEAST = 500_000
_KEY = ["side", "ns", "key"]
_BEGIN = -(2**63)


def references(df: DataFrame, ref_id: str, ns: str, keys: dict[str, str], at: str) -> DataFrame:
    """(ref_id, side, ns, key, at): one row per reference; keys maps the name of a side to its key column."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), tidy_key(F.col(c)).alias("key")) for s, c in keys.items()])
    return (
        df.select(F.col(ref_id).alias("ref_id"), F.coalesce(tidy(F.col(ns)), F.lit("")).alias("ns"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.explode(sides).alias("s"))
        .select("ref_id", "s.side", "ns", "s.key", "at").where("key is not null")
    )


def parents(df: DataFrame, side: str, ns: str, key: str, start: str, end: str) -> DataFrame:
    """(side, ns, key, start, end) in microseconds."""
    return df.select(
        F.lit(side).alias("side"), F.coalesce(tidy(F.col(ns)), F.lit("")).alias("ns"), tidy_key(F.col(key)).alias("key"),
        F.coalesce(F.unix_micros(F.col(start).cast("timestamp")), F.lit(_BEGIN)).alias("start"), F.unix_micros(F.col(end).cast("timestamp")).alias("end"),
    ).where("key is not null").distinct()


def _events(times: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows of the sweep: at, rank (parents before references of the same time), delta, start of the parent row."""
    refs = times.select(*_KEY, F.col("at"), F.lit(1).alias("rank"), F.lit(0).alias("delta"), F.lit(None).cast("long").alias("start"), F.lit(False).alias("parent"))
    lives = F.col("end").isNull() | (F.col("end") > F.col("start"))
    begin = F.struct(F.col("start").alias("at"), F.when(lives, 1).otherwise(0).alias("delta"))
    stop = F.struct(F.col("end").alias("at"), F.lit(-1).alias("delta"))
    own = owners.select(*_KEY, "start", F.explode(F.when(lives & F.col("end").isNotNull(), F.array(begin, stop)).otherwise(F.array(begin))).alias("e"))
    own = own.select(*_KEY, F.col("e.at").alias("at"), F.lit(0).alias("rank"), F.col("e.delta").alias("delta"), "start", F.lit(True).alias("parent"))
    return refs.unionByName(own)


def _ranges(events: DataFrame, hot_rows: int | None) -> DataFrame:
    """events with a column `part`: 0, and for hot keys the time range, each range with a carried-in row."""
    per_key = events.groupBy(*_KEY).agg(F.count("*").alias("rows"), F.min(F.when(F.col("at") > _BEGIN, F.col("at"))).alias("lo"), F.max("at").alias("hi"))
    if hot_rows is None:
        total = events.count()
        hot_rows = max(HOT_LEAST, total // HOT_SHARE + 1)
    hot = materialize(per_key.where(F.col("rows") > hot_rows).withColumn("parts", F.ceil(F.col("rows") / hot_rows).cast("int")), "hot", 1)
    if not hot.head(1):
        return events.withColumn("part", F.lit(0))
    h = F.broadcast(hot.select(*_KEY, "lo", "hi", "parts"))  # at most HOT_SHARE rows
    place = F.when(F.col("parts").isNull() | F.col("at").isNull() | (F.col("at") <= F.col("lo")), 0).otherwise(
        F.least(F.col("parts") - 1, ((F.col("at") - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo") + 1) * F.col("parts")).cast("int")))
    placed = events.join(h, _KEY, "left").withColumn("part", place)
    sums = placed.where("parts is not null and parent").groupBy(*_KEY, "part").agg(F.sum("delta").alias("delta"), F.min("start").alias("start"))
    grid = hot.select(*_KEY, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    before = Window.partitionBy(*_KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        grid.join(sums, [*_KEY, "part"], "left")
        .select(*_KEY, "part", F.coalesce(F.sum(F.coalesce("delta", F.lit(0))).over(before), F.lit(0)).cast("int").alias("delta"), F.min("start").over(Window.partitionBy(*_KEY)).alias("start"))
        .where("start is not null")
        .select(*_KEY, F.lit(_BEGIN).alias("at"), F.lit(-1).alias("rank"), "delta", "start", F.lit(True).alias("parent"), "part")
    )
    return placed.select(*_KEY, "at", "rank", "delta", "start", "parent", "part").unionByName(carried)


def find_orphans(refs: DataFrame, owners: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """(ref_id, side, ns, key, at, reason) of every orphan reference; see references() and parents() for the inputs."""
    times = refs.select(*_KEY, "at").distinct()
    rows = _ranges(_events(times, owners), hot_rows)
    part = Window.partitionBy(*_KEY, "part")
    sweep = part.orderBy(F.col("at").asc_nulls_last(), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = rows.select(
        *_KEY, "at", "rank", F.sum("delta").over(sweep).alias("alive"), F.max("parent").over(part).alias("exists"), F.min("start").over(part).alias("first"),
    ).where("rank = 1")
    reason = (
        F.when(~F.col("exists"), "missing").when(F.col("at").isNull() | (F.col("alive") > 0), None)
        .when(F.col("first") <= F.col("at"), "deleted").otherwise("late")
    )
    verdict = told.withColumn("reason", reason).where("reason is not null").select(*_KEY, F.coalesce("at", F.lit(_BEGIN)).alias("t"), "reason")
    r = refs.withColumn("t", F.coalesce("at", F.lit(_BEGIN)))
    return r.join(verdict, [*_KEY, "t"]).select("ref_id", "side", "ns", "key", "at", "reason").distinct()


def orphan_report(refs: DataFrame, orphans: DataFrame) -> DataFrame:
    """(side, ns, month, refs, missing, deleted, late): counts of distinct references per table, namespace and month."""
    month = F.date_format(F.timestamp_micros("at"), "yyyy-MM").alias("month")
    all_refs = refs.distinct().groupBy("side", "ns", month).agg(F.count("*").alias("refs"))
    bad = orphans.groupBy("side", "ns", month).agg(*[F.sum((F.col("reason") == r).cast("long")).alias(r) for r in ("missing", "deleted", "late")])
    same = all_refs["side"].eqNullSafe(bad["side"]) & all_refs["ns"].eqNullSafe(bad["ns"]) & all_refs["month"].eqNullSafe(bad["month"])
    return all_refs.join(bad, same, "left").select(all_refs["side"], all_refs["ns"], all_refs["month"], "refs", *[F.coalesce(bad[r], F.lit(0)).alias(r) for r in ("missing", "deleted", "late")])
