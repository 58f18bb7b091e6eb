"""Session factory and the two helpers for cutting lineage.

``materialize`` writes a table to the shared folder the cluster names in
``spark.checkpoint.dir`` and reads it back, so that a lost executor costs a
re-read and never a recomputation from the raw input.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of a batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

_written: list[tuple[SparkSession, str]] = []


def get_session(app: str = "loomspan", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession) -> None:
    """Batches for Python workers that are small although rows hold whole texts or pages.

    Spark takes their bounds from the session when a query runs, so larger ones that are set there are lowered; smaller ones stay.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = str(spark.conf.get(key)).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, but only on a local
    master: on a cluster a machine-local folder would lose data.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="loomspan-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return it re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomspan/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned, of which all that depends on them has been written itself."""
    for table in tables:
        entry = (table.sparkSession, table._written_at)
        if entry in _written:
            _written.remove(entry)
            _delete(*entry)


def release() -> None:
    """Delete every table written by ``materialize`` in this process."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session is gone, and so is any way to reach its store
            pass


atexit.register(release)
