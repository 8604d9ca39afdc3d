"""A cache of vectors that several jobs may add to at the same time.

Under ``path``, ``data`` has a Parquet folder for each commit and ``log`` an entry for each version: a JSON line that names the
folder. A writer drops the keys that earlier commits have, writes its rows, and claims the next version by putting the
entry in place only if there is none. If another job was faster, it drops the keys of the commits in between and tries the
next version. So every key has one row, that of the lowest version, and readers need no shuffle to find it.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import storage

SCHEMA = "key string, vector array<float>"


class VectorCache:
    """Vectors by key. ``schema`` must have a column ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: str = SCHEMA):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        return jvm, place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of commits."""
        _, place, files = self._files()
        if not files.exists(place):
            return 0
        return max((int(s.getPath().getName()) for s in files.listStatus(place) if s.getPath().getName().isdigit()), default=0)

    def _folders(self, first: int, last: int) -> list[str]:
        jvm, place, files = self._files()
        out = []
        for n in range(first, last + 1):
            stream = files.open(jvm.org.apache.hadoop.fs.Path(place, f"{n:020d}"))
            out.append(json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["data"])
            stream.close()
        return [f"{self.path}/data/{name}" for name in out]

    def read(self, version: int | None = None) -> DataFrame:
        """All vectors as of ``version``, or of now: one row a key."""
        last = self.version() if version is None else version
        return self._of(1, last)

    def _of(self, first: int, last: int) -> DataFrame:
        folders = self._folders(first, last)
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _claim(self, version: int, folder: str) -> bool:
        """Puts the entry of ``version`` in place, whole and only if there is none."""
        jvm, place, files = self._files()
        body = json.dumps({"data": folder}) + "\n"
        files.mkdirs(place)
        hidden, entry = jvm.org.apache.hadoop.fs.Path(place, f".{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(place, f"{version:020d}")
        if files.getScheme() == "file":  # a hard link fails if its name is there, which a local rename does not
            kept, name = f"{place.toUri().getPath()}/{hidden.getName()}", f"{place.toUri().getPath()}/{entry.getName()}"
            with open(kept, "w", encoding="utf-8") as f:
                f.write(body)
            try:
                os.link(kept, name)
            except FileExistsError:
                return False
            finally:
                os.remove(kept)
            return True
        out = files.create(hidden, False)
        out.write(bytearray(body.encode()))
        out.close()
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(entry.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(hidden, entry, [])
        except Exception as e:
            files.delete(hidden, False)
            if "AlreadyExists" in str(e):
                return False
            raise
        return True

    def append(self, rows: DataFrame) -> int:
        """Adds the rows whose keys are not there yet, of a repeated key the one with the least values; gives the version.

        Rows without a key are left out. Nothing is committed if there is nothing new. ``rows`` is evaluated once.
        """
        columns = [f.strip().split(" ")[0] for f in self.schema.split(",")]
        others = [c for c in columns if c != "key"]
        one = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct(*others)).alias("r")).select("key", *[F.col(f"r.{c}").alias(c) for c in others])
        seen, known, stale = 0, self.version(), None
        fresh = one
        while True:
            fresh = fresh.select(*columns).join(self._of(seen + 1, known).select("key"), "key", "left_anti") if known > seen else fresh.select(*columns)
            folder = uuid.uuid4().hex
            storage.write(self.spark, fresh, f"{self.path}/data/{folder}")
            if stale:
                storage.remove(self.spark, stale)
            stale = f"{self.path}/data/{folder}"
            fresh = self.spark.read.schema(self.schema).parquet(stale)
            if fresh.isEmpty():
                storage.remove(self.spark, stale)
                return self.version()
            if self._claim(known + 1, folder):
                return known + 1
            seen, known = known, self.version()
