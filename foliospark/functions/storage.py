"""The folder that the driver and all executors share: scratch tables in it, and file systems for Python tasks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from foliospark.functions.frames import ship

#: Spark's switch that deletes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict[str, str] = {}
#: Of each session that is writing: [writes under way, the switch's setting before the first of them].
_WRITING: dict[int, list] = {}
_LOCK = threading.Lock()
#: Scratch tables that are still there.
_SCRATCH: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent in a local session (tests) a temporary folder of this machine is made; a cluster without
    the setting is an error, as its executors would not see such a folder.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _OWN.setdefault(spark.sparkContext.applicationId, "")
        if not found:
            own = tempfile.mkdtemp(prefix="folio-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            found = _OWN[spark.sparkContext.applicationId] = f"file://{own}"
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed by ``clear`` or when the driver's Python ends."""
    ship(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.unregister(_at_exit)
        atexit.register(_at_exit, spark)
    _SCRATCH.append(path)
    return path


def _at_exit(spark: SparkSession) -> None:
    clear(spark)


def clear(spark: SparkSession) -> int:
    """Removes all scratch tables that this Python has made so far, and gives their number: for long sessions, between jobs
    whose results have been written elsewhere or read."""
    made, _SCRATCH[:] = list(_SCRATCH), []
    for path in made:
        remove(spark, path)
    return len(made)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended already; the cluster's own clean-up has the folder
        return


def write(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Writes Parquet and drops the shuffle files of this one execution when it ends; later readers start from the files.

    The switch is the session's, so writes that run side by side in threads share it: the first one sets it, the last one
    puts back what was there.
    """
    with _LOCK:
        own = _WRITING.setdefault(id(spark), [0, spark.conf.get(CLEANUP, "false")])
        own[0] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        with _LOCK:
            own[0] -= 1
            if not own[0]:
                spark.conf.set(CLEANUP, own[1])
                del _WRITING[id(spark)]


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and fixes the rows for every later reader."""
    path = scratch(spark, name)
    write(spark, df, path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(file system, path) of a URI for the Python side of executors: file, hdfs, s3, gs and abfs stores."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def read_blocks(uri: str) -> Iterator[dict]:
    """Rows of a Parquet folder that Spark has written, read in a task one at a time, in the order of the files' names."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, root = open_fs(uri)
    names = sorted(f.path for f in files.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
    for name in names:
        with files.open_input_file(name) as handle:
            for batch in pq.ParquetFile(handle).iter_batches(batch_size=1):
                yield from batch.to_pylist()
