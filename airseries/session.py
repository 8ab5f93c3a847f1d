"""Session defaults and lineage cutting.

UTC session zone (every hour/day bucket is a UTC bucket), ANSI on (so all
coercions go through ``try_cast``), AQE on (runtime coalescing, skew-join
splitting and size-checked broadcast conversion).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Runtime (size-checked) broadcast of small join sides; explicit broadcast()
    # is used only for constant tables with a proven bound.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "airseries", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster, leave ``master`` unset so spark-submit decides.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    apply_sql_defaults(spark)
    return spark


#: Folder that holds this package.
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def apply_sql_defaults(spark: SparkSession) -> None:
    """Settings the operators rely on (safe to call repeatedly).

    Python workers find this package by path, whatever folder the driver was
    started in (on a cluster the package is installed, or its folder shared).
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests, laptops) gets a private temporary folder
    when the setting is absent; on a cluster a missing setting is an error,
    because a machine-local folder does not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if sc.master.startswith("local"):
        d = tempfile.mkdtemp(prefix="airseries-ckpt-")
        sc.setCheckpointDir(d)
        return sc.getCheckpointDir() or d
    raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` itself, which outlives the session (else this session's)."""
    current = checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or current


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared checkpoint folder (never local)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written hand-off tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", name)
