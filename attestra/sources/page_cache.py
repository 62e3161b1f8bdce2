"""Prepared pages that outlive a run, by file version.

A file's version is its path, size and time. A refresh compares the files that
are there with the versions that are kept, prepares the pages of those that are
new or changed, and lists anew what counts; files that went, and older versions,
are no longer listed. What was prepared before is neither read nor written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import exists

VERSION = ["path", "size", "modified"]
_INDEX = "path string, size long, modified timestamp, run string"


class PageCache:
    """Kept below ``folder``: ``pages/run=<id>`` holds what a refresh prepared, ``index/<number>`` the versions that count after it. One refresh at a time; a lost one leaves nothing that counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _last(self) -> int:
        """The number of the last index that was written to its end."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        where = hadoop.Path(f"{self.folder}/index")
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
        return max((int(n) for n in names if n.isdigit() and files.exists(hadoop.Path(f"{self.folder}/index/{n}/_SUCCESS"))), default=0)

    def index(self) -> DataFrame:
        n = self._last()
        return self.spark.read.schema(_INDEX).parquet(f"{self.folder}/index/{n}") if n else self.spark.createDataFrame([], _INDEX)

    def changed(self, files: DataFrame) -> DataFrame:
        """Of ``files(path, size, modified, ...)`` those whose version is not kept."""
        return files.join(self.index().select(*VERSION), VERSION, "left_anti")

    def refresh(self, files: DataFrame, prepare: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Bring the cache to ``files`` and return their prepared pages.

        ``prepare`` gets the files to be prepared and returns their pages with
        ``path`` and any other columns; a file without a page counts as prepared.
        Files that are listed twice are one. Times are kept to the microsecond;
        a null size or time is a version that is never kept, so that its file is
        prepared each time.
        """
        files = files.select(*VERSION).distinct()
        run = uuid.uuid4().hex
        old, new = self.index(), self.changed(files)
        pages = prepare(new)
        pages.join(new.withColumnsRenamed({"size": "_size", "modified": "_modified"}), "path").write.parquet(f"{self.folder}/pages/run={run}")
        listed = old.join(files, VERSION, "left_semi").unionByName(new.withColumn("run", F.lit(run)))
        number = self._last() + 1
        # A refresh that was lost has left a folder that does not count.
        listed.write.mode("overwrite").parquet(f"{self.folder}/index/{number}")
        return self.read(pages.schema)

    def read(self, schema) -> DataFrame:
        """The pages of all versions that count; of runs without one nothing is read."""
        index = self.index().withColumnsRenamed({"size": "_size", "modified": "_modified"})
        runs = [r["run"] for r in index.select("run").distinct().collect()]  # as many as refreshes that still count
        if not runs or not exists(self.spark, f"{self.folder}/pages"):
            return self.spark.createDataFrame([], schema)
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", _size long, _modified timestamp, run string"
        rows = self.spark.read.schema(kept).parquet(f"{self.folder}/pages").where(F.col("run").isin(runs))
        known = F.col("i.path").eqNullSafe(F.col("p.path")) & F.col("i._size").eqNullSafe(F.col("p._size")) & F.col("i._modified").eqNullSafe(F.col("p._modified")) & (F.col("i.run") == F.col("p.run"))
        return rows.alias("p").join(index.alias("i"), known, "left_semi").select(*[f"p.`{f.name}`" for f in schema.fields])

    def compact(self, schema) -> None:
        """Write what counts as one run, and remove what does not."""
        run, number = uuid.uuid4().hex, self._last()
        if not number:
            return
        index = self.index()
        renamed = index.drop("run").withColumnsRenamed({"size": "_size", "modified": "_modified"})
        self.read(schema).join(renamed, "path").write.parquet(f"{self.folder}/pages/run={run}")
        index.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{self.folder}/index/{number + 1}")
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for name, stays in (("pages", f"run={run}"), ("index", str(number + 1))):
            where = hadoop.Path(f"{self.folder}/{name}")
            files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for f in files.listStatus(where):
                if f.isDirectory() and f.getPath().getName() != stays:
                    files.delete(f.getPath(), True)
