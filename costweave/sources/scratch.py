"""Where intermediate tables go: the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def scratch_base(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Unset, a temporary folder is made and set for a session whose tasks all run in the driver's
    process; on several machines such a folder would be a different one on each, so it raises.
    """
    base = spark.conf.get(SETTING, None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='costweave-')}"
    spark.conf.set(SETTING, base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the driver's JVM ends."""
    path = f"{scratch_base(spark)}/costweave-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return f"{path}/{name}"
