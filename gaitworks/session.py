"""Session defaults for local runs. On a cluster pass the session you already have, with the package on the executors
(``spark.submit.pyFiles``, or ``package_archive`` and ``addPyFile``)."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    # local Python workers find the package wherever the driver was started
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([top, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gaitworks")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, prefix: str) -> str:
    """A fresh folder in the shared checkpoint folder of the cluster.

    Where ``spark.checkpoint.dir`` is unset a temporary folder serves a local
    master (tests, laptops); on a cluster that is an error, as executors would
    each write to their own disk.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        return tempfile.mkdtemp(prefix=f"{prefix}-")
    return f"{shared.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it cuts lineage, fixes partitions and outlives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def package_archive(path: str) -> str:
    """Zip the package to ``path`` for ``spark.sparkContext.addPyFile``; Python stages import it on the executors."""
    root = os.path.dirname(os.path.abspath(__file__))
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    whole = os.path.join(folder, f)
                    z.write(whole, os.path.relpath(whole, os.path.dirname(root)))
    return path
