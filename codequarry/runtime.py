"""Session helpers: shipping this package to executors and cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()

#: Bytes of rows that a Python worker gets at once, about.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers, once per context."""
    sc = spark.sparkContext
    if sc in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="codequarry-"), "codequarry.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("codequarry", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED[sc] = path


def small_batches(spark: SparkSession) -> None:
    """From now on this session's rows go to Python workers in batches of about ``BATCH_BYTES``.

    Executor and worker both hold a batch, and copies of it: 10,000 whole texts or pairs of sets are tens of MB each time.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Meanwhile each query's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder of its own;
    a cluster without it is refused, since executors could not read each other.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = os.path.join(tempfile.gettempdir(), "codequarry-shared")
    os.makedirs(folder, exist_ok=True)
    return f"file://{folder}"


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/codequarry/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
