"""Session factory and reliable lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Whether a query's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables that cut_table() made and nobody dropped: they are removed when the driver's process ends.
_LEFT: dict[str, DataFrame] = {}


@atexit.register
def _remove_left() -> None:
    for path, made in list(_LEFT.items()):
        try:
            remove_path(made.sparkSession, path)
        except Exception:  # the JVM is gone
            return


def get_session(app: str = "sparkloom", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; further settings by keyword, dots as double underscores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in spark.checkpoint.dir; make one only where it is unset and all is on one machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sparkloom-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4()}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder or file, wherever Spark's file systems keep it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame, *by: str) -> DataFrame:
    """As cut(), but as a compressed table in the shared folder, with a folder for each value of ``by``: for large intermediate results. The shuffle files that it took are removed at once."""
    spark = df.sparkSession
    path, before = shared_path(spark, "table"), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    made = spark.read.schema(df.schema).parquet(path)
    _LEFT[path] = made
    return made


def drop_table(df: DataFrame) -> None:
    """Remove the files of a DataFrame that cut_table() returned; nothing that still reads it may run afterwards."""
    for path in [p for p, made in _LEFT.items() if made is df]:
        remove_path(df.sparkSession, path)
        del _LEFT[path]


def drop_part(df: DataFrame, folder: str) -> None:
    """Remove one folder of a DataFrame that cut_table() returned."""
    for path in [p for p, made in _LEFT.items() if made is df]:
        remove_path(df.sparkSession, f"{path}/{folder}")
