"""SparkSession construction and session-level settings.

Cluster settings (executor sizing, ``spark.checkpoint.dir``) are read from
the session the cluster gives us; a default is only filled in when a setting
is missing, which happens in local tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Confs every job of the library relies on.
REQUIRED_CONF = {
    # Runtime re-planning: coalesce small shuffles, split skewed join partitions,
    # turn sort-merge joins into broadcast joins once real sizes are known.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A generated method over 8,000 bytes is never JIT-compiled (parse_rows makes
    # one of about 15,000): fall back to split projections beyond that.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Shift-JIS / windows-31j decoding of portal CSV bytes (E6) needs both.
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
}


def build_session(master: str | None = None, app_name: str = "seika",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None, driver_memory: str | None = None) -> SparkSession:
    """Create (or join) a session with the library's required settings.

    ``driver_memory`` matters in local mode only, where the driver JVM runs
    every task; on a cluster executor sizing comes from the cluster's confs.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            b = b.config("spark.driver.memory", driver_memory or os.environ.get("SEIKA_DRIVER_MEMORY", "8g"))
    b = b.config("spark.ui.enabled", "false")
    b = b.config("spark.sql.session.timeZone", "UTC")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**REQUIRED_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime-settable confs to an existing session (e.g. the driver's)."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.isModifiable(k):  # a static conf is fixed by the cluster
            spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def refuse_local_folder(master: str) -> None:
    """Raise unless all tasks of ``master`` run on this machine."""
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir is not set, and with master {master} a folder of this machine "
                           "is not shared; set it to a folder that driver and executors see")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Taken from ``spark.checkpoint.dir`` as the cluster names it. Only a local
    master may do without: a scratch folder is then created and registered. On
    a cluster that folder would be each machine's own, so this is an error.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        refuse_local_folder(sc.master)
        d = os.environ.get("SEIKA_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="seika-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a Parquet table below the shared checkpoint folder and
    read it back: lineage is cut, a lost executor costs a re-read, and later
    steps scan columnar data (faster than an RDD checkpoint of rows)."""
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/seika-stage/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
