"""Session defaults, table access and lineage cutting."""

from __future__ import annotations

import glob
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "docloom", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.legacy.javaCharsets": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**base, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def reachable(spark: SparkSession) -> SparkSession:
    """The session, its Python workers being told where this package lies if they aren't.

    On a cluster the package is installed on the executors or handed over with ``--py-files``; the path added
    here then only comes second.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*filter(None, known), root])
    return spark


#: A table smaller than this isn't worth an exchange.
SPREAD_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder, over all cores.

    A table of one small file is one task, however much work its rows make; one that has fewer tasks than the
    session has cores is redistributed. Tables of any size worth a cluster have more, and are read as they are.
    """
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    size = parquet_bytes(path)
    cores = spark.sparkContext.defaultParallelism
    if size is None or not SPREAD_BYTES <= size < cores * 16 * SPREAD_BYTES or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset, and the master is local, a temporary folder is taken; on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="docloom-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=eager)


def parquet_bytes(path: str) -> int | None:
    """Size of a local parquet file or folder; None where it cannot be told."""
    path = path.removeprefix("file://")
    if not os.path.exists(path):
        return None
    files = [path] if os.path.isfile(path) else glob.glob(f"{path}/**/*.parquet", recursive=True)
    return sum(os.path.getsize(f) for f in files)
