"""Session factory and session-level helpers.

Nothing here overrides a cluster's own settings: every value is set only where the session has none.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", memory: str = "8g", app: str = "spanframe", **conf: str) -> SparkSession:
    """A session for one machine (tests, bench); a cluster brings its own session instead."""
    partitions = str(cores) if str(cores).isdigit() else "8"
    settings = {"spark.sql.shuffle.partitions": partitions, "spark.driver.memory": memory} | DEFAULTS | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: the session's ``spark.checkpoint.dir``.

    Only a session on one machine that names none (tests) gets a temporary one; on a cluster a machine-local folder would lose data, so
    a missing setting is an error there.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spanframe-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there: its lineage is cut and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut as by :func:`checkpointed`, and readers take only the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by ``keys`` only where the scan gives fewer partitions than the session has cores.

    A single small parquet file is one partition; windows and Python stages over it would use one core. On large
    inputs the scan already gives more partitions than cores and nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)
