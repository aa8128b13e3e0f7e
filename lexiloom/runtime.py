"""Session, table and checkpoint helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "lexiloom", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def findable(spark: SparkSession) -> None:
    """Lets Python workers find this package even when they start elsewhere than in its folder."""
    env, root = spark.sparkContext.environment, repo_root()
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` over enough partitions to keep every core busy with costly work on each row.

    A table in fewer pieces than there are cores is small or badly cut: it is
    dealt out once. One that is cut well stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Where it names none, a folder of this machine serves only if all of Spark
    runs in one process here (tests); on a cluster that is refused, as executors
    couldn't read each other's files.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    d = tempfile.mkdtemp(prefix="lexiloom-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", "file://" + d)
    return "file://" + d


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` cut from its lineage by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def latest(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """One row per key: the one loaded last.

    Rows sent twice differ in `order` only or carry a correction; the last one
    wins, ties go to the greatest values so that the result doesn't depend on
    partitioning. A null `order` loses against any other. The aggregate combines
    on the map side, so a key repeated millions of times shuffles as a few rows.
    """
    rest = [c for c in cols if c not in keys]
    pick = F.max(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in rest])).alias("_r")
    return df.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def hash64(*cols: Column) -> Column:
    return F.xxhash64(*cols)


def repo_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
