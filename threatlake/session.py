"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "threatlake", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs expect; on a cluster spark-submit supplies the rest."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_local_scratch: list[str] = []


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder that ``spark.checkpoint.dir`` names.

    A cluster must name that folder: a machine's own disk is not seen by the other machines, so
    nothing is written where the setting is missing.  Only a session that is a single process
    (unit tests) falls back to a folder of its own, which goes when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not _local_scratch:
            _local_scratch.append(tempfile.mkdtemp(prefix="threatlake-"))
            atexit.register(shutil.rmtree, _local_scratch[0], ignore_errors=True)
        base = _local_scratch[0]
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared scratch folder and read from there.

    Cuts the lineage: a lost executor costs a new read, not the steps before, and the rows are the
    same in every later read.
    """
    path = scratch_path(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
