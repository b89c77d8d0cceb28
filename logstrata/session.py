"""Session set-up shared by jobs, tests and the bench."""

from __future__ import annotations

import tempfile
from pathlib import Path
from shutil import make_archive
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, name: str = "logstrata", **conf: str) -> SparkSession:
    """A session with the settings the engine relies on; `conf` keys use `_` for `.`."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("_", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever they start. Spark distributes the archive, so it may lie on the driver's disk."""
    root = Path(__file__).resolve().parent
    packed = make_archive(f"{tempfile.mkdtemp(prefix='logstrata-')}/{root.name}", "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(packed)


def use_utc(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Only a local-mode session without that setting gets a folder of its own; on a cluster a
    machine-local folder would be lost with its executor, so a missing setting is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Reliable checkpoint: later stages reread the written rows instead of recomputing them.

    `tasks`: shuffles on the way to the rows have that many partitions, whatever the session's setting, and none are put together again.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    if tasks is None:
        return df.checkpoint(eager=True)
    wanted = {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in wanted}
    try:  # a new frame is planned when its rows are made, so the settings hold for this job only
        for key, value in wanted.items():
            spark.conf.set(key, value)
        return df.select("*").checkpoint(eager=True)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def stored(df: DataFrame) -> DataFrame:
    """As cut_lineage, written as compressed Parquet in the shared folder: for rows with texts, which a checkpoint writes in full width."""
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
