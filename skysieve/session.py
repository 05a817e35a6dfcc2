"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# the JVM does not compile methods over 8000 bytes; rule chains beyond that
# run several times faster as separate small methods
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
JIT_METHOD_LIMIT = "8000"
SPARK_METHOD_LIMIT = "65535"


def build_session(app: str = "skysieve", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the engine expects; `master` only in local runs."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config(METHOD_LIMIT, JIT_METHOD_LIMIT)
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def compile_small_methods(spark: SparkSession) -> None:
    """Give a session made elsewhere the method limit of `build_session`, unless another was set."""
    if spark.conf.get(METHOD_LIMIT, SPARK_METHOD_LIMIT) == SPARK_METHOD_LIMIT:
        spark.conf.set(METHOD_LIMIT, JIT_METHOD_LIMIT)


_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by `spark.checkpoint.dir`.

    Only a local master, where driver and tasks are one process, gets a temp folder if it is unset;
    on a cluster a machine-local folder loses rows, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table that is written once and read back."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df, name: str):
    """Cut lineage: write `df` to the shared folder once and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
