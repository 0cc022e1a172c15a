"""Session helpers: a tuned local session, the shared scratch folder, lineage cuts."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "oddrows", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; clusters pass their own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a folder of its own; a cluster without it is told to set one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    folder = tempfile.mkdtemp(prefix="oddrows-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing ``df`` once to the shared folder and reading it back.

    Parquet keeps column pruning and filter pushdown for the later passes, and the files
    outlive any executor.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/oddrows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KEPT: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist a frame that several passes read. It is rebuilt from its plan if a node is lost."""
    _KEPT.append(df.persist())
    return _KEPT[-1]


def release() -> None:
    """Unpersist everything kept so far."""
    while _KEPT:
        with contextlib.suppress(Exception):  # its session may have been stopped
            _KEPT.pop().unpersist()
