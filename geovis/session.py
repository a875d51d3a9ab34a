"""Session settings every geovis job relies on, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators depend on for right results.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    # JSON-LD blocks on real pages repeat keys; the last one wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

# Settings that keep large runs even; a session may override them.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on to an existing session."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def get_session(app: str = "geovis", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session. `master` is only passed for local runs; a cluster sets its own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**TUNING, **REQUIRED, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one job below the cluster's shared `spark.checkpoint.dir`.

    Only a local master may fall back to a temporary folder: elsewhere it would not be
    visible to the other machines.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="geovis-")
    return f"{root.rstrip('/')}/geovis-{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df` as a written table in the shared folder: costly rows that several steps
    read are computed once, and survive the loss of an executor."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """The rows of `df` as a table in the shared folder, dealt and sorted by `key`. Two such tables
    of one key and number of buckets are joined without moving their rows again."""
    table = f"geovis_{name}_{uuid.uuid4().hex}"
    path = work_dir(df.sparkSession, name)
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)
