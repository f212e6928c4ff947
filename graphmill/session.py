"""Session set-up and the two ways in which a job cuts its lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings of a session that graphmill makes itself; a session that exists keeps its own.
DEFAULTS = {
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "graphmill", **conf: str) -> SparkSession:
    """A session with graphmill's defaults; keyword arguments are not needed on a cluster."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")  # tasks are parallel already; the workers of a local session inherit it
    return importable(SparkSession.builder.appName(app).config(map=DEFAULTS | conf).getOrCreate())


def importable(spark: SparkSession) -> SparkSession:
    """spark, whose Python workers find this package where the driver has it: enough wherever they see the driver's files.
    Elsewhere give the package with --py-files or install it."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only a local master without the setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if told:
        return told
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="graphmill-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """df, written once as a table in the shared folder and read from there.

    Later stages start from the files, so a lost executor costs no recomputation of what came before. Tables lie below a
    folder named by the application; it may be deleted when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/graphmill-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphmill_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later step reads."""
    for df in tables:
        path = getattr(df, "_graphmill_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
