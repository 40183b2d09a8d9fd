"""Session factory and the few runtime helpers every operator shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "threadloom", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with UTC, AQE and skew handling on; ``conf`` overrides single settings."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Catalyst prunes columns and pushes filters into this scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, in local mode without it one that goes with this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="threadloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


#: The folder of local mode, once it is made.
_LOCAL: list[str] = []


def checkpoint(df: DataFrame, in_loop: bool = False) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder of the cluster.

    The folder is ``shared_folder``; on a cluster an unset one is an error.
    A checkpoint keeps the size that the optimizer estimated, for a join the product of both sides.
    ``in_loop`` leaves it unknown, since its digits would double with every round of joins.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    cut = df.checkpoint(eager=True)
    if not in_loop:
        return cut
    rows = spark._jsparkSession.internalCreateDataFrame(cut._jdf.queryExecution().toRdd(), cut._jdf.schema(), False)
    return DataFrame(rows, spark)
