"""Session helpers.

The library never creates machine-local scratch space on a cluster: anything
that must survive executor loss (staged ZIP members, lineage cuts, written
intermediate tables) goes under ``spark.checkpoint.dir``.  Only when that
setting is absent on a local master (unit tests, a laptop) do we create one under the local
temp directory and register it on the session; on a cluster its absence is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
}


def get_spark(app: str = "tabsight", cpus: int | str | None = None,
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the provided session."""
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(_LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_ROOTS: dict[int, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for staged data: ``spark.checkpoint.dir`` or, if unset, a new temp dir."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_ROOTS.get(id(spark.sparkContext))
    if not root:
        sc_dir = spark.sparkContext.getCheckpointDir()
        root = os.path.dirname(sc_dir) if sc_dir else None
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not root:
        # unset on a local master (tests, a laptop): a fresh local folder, registered on the context only
        # (Spark rejects runtime changes of core settings such as spark.checkpoint.dir)
        root = tempfile.mkdtemp(prefix="tabsight-ckpt-")
        _LOCAL_ROOTS[id(spark.sparkContext)] = root
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/tabsight/{kind}/{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder below the checkpoint folder, in whatever store it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
