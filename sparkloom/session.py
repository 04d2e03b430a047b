"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sparkloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; the master comes from the cluster unless given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir; where it is unset, make one if all executors are on this machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "sparkloom-checkpoints"))


_written: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str = "") -> str:
    """A new place in the folder all executors share; what is put there goes with `release`, or when the application ends."""
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    _written.setdefault(sc.applicationId, []).append(path)
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(place)
    return f"{path}/{name}" if name else path


def release(spark: SparkSession) -> None:
    """Delete what this application has put in the shared folder so far; frames that still read it are lost."""
    sc = spark.sparkContext
    for path in _written.pop(sc.applicationId, []):
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: survives the loss of executors and cuts the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a compressed table in the shared checkpoint folder, read back; cuts the lineage like `cut`."""
    path = shared_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
