"""Session builder and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def build_session(app: str = "rankloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the engine expects; on a cluster the cluster's own settings win."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Where that is unset, a temporary one in local
    mode; on a cluster that is an error, as executors would write to disks of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rankloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        _written.append((spark, root))
    return root


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> str:
    """Writes df once as a table in the shared folder; its place with scheme, for readers outside Spark too."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/rankloom-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.options(**(options or {})).parquet(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return whole if not whole.startswith("file:/") or whole.startswith("file:///") else "file://" + whole.removeprefix("file:")


def materialize(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Writes df once as a table in the shared folder and returns a reader of it: the lineage is cut, a lost executor
    costs a re-read and not a recomputation, and several consumers share one evaluation."""
    if partitions:
        df = df.coalesce(partitions)
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def release_scratch() -> None:
    """Deletes the tables written by materialize. Runs at exit; call it earlier once no frame built on them is needed."""
    while _written:
        spark, path = _written.pop()
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
            continue
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone already at exit
            pass


atexit.register(release_scratch)
