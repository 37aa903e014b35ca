"""What a session needs before the package's operators run on its executors."""

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of an Arrow batch at most: whole texts in batches of the default 10,000 rows would fill executors' memory.
BATCH_ROWS = 1000
#: Bytes of an Arrow batch, unless one row has more: very long texts must not meet in one batch.
BATCH_BYTES = 16 << 20

_local_root = None


def prepare(spark: SparkSession) -> None:
    """Sends the package's source to the executors, once for each Spark context, and keeps Arrow batches small."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, BATCH_ROWS)
    spark.conf.set(ARROW_BYTES, BATCH_BYTES)
    context = spark.sparkContext
    if getattr(context, "_seqloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="seqloom-src-")
    with zipfile.ZipFile(os.path.join(folder, "seqloom_src.zip"), "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, str(path.relative_to(package.parent)))
    context.addPyFile(os.path.join(folder, "seqloom_src.zip"))
    context._seqloom_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one temporary folder a process, in local mode only."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="seqloom-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return f"file://{_local_root}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared root; it goes when the driver's JVM ends."""
    target = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return target
