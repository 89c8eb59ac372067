"""Files below a folder, listed by tasks.

Spark's readers list a tree on the driver and hold every file there. Here tasks list folders, and what they don't get to is
dealt out again, so the driver holds no path. Folders in a store that only Spark's readers can open, and patterns in place of
a folder, are left to Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmill import sinks
from lawmill.session import materialise

#: Folders that a task lists below each one that it is given.
WALK = 100
ROWS = 20_000
FOUND = "path string, folder boolean"


def store(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path, and the path there."""
    if root.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", root)
    return fs.FileSystem.from_uri(root)


def hidden(name: str) -> bool:
    """What Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name and not name.startswith(("_common_metadata", "_metadata"))) or name.endswith("._COPYING_")


def _by_spark(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root).select("path")


def files_below(spark: SparkSession, root: str, suffix: str, walk: int = WALK) -> DataFrame:
    """(path) of all files whose name ends in ``suffix``, as Spark's readers find and name them."""
    if re.search(r"[*?\[\]{}\\]", root):
        return _by_spark(spark, root, suffix)
    top = sinks.resolved(spark, root).rstrip("/")
    try:
        target, base = store(top)
        if target.get_file_info(base).type != fs.FileType.Directory:
            return _by_spark(spark, root, suffix)
    except (pa.ArrowException, OSError):
        return _by_spark(spark, root, suffix)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, base = store(top)
        base, found = base.rstrip("/"), []
        for batch in batches:
            for given in batch["path"]:
                todo, n = [given], 0
                while todo and n < walk:
                    folder, n = todo.pop(), n + 1
                    for entry in target.get_file_info(fs.FileSelector(base + folder)):
                        name = entry.base_name
                        if not hidden(name):
                            if entry.type == fs.FileType.Directory:
                                todo.append(f"{folder}/{name}")
                            elif name.endswith(suffix):
                                found.append((f"{top}{folder}/{name}", False))
                    if len(found) >= ROWS:
                        yield pd.DataFrame(found, columns=["path", "folder"])
                        found = []
                found += [(folder, True) for folder in todo]
        yield pd.DataFrame(found, columns=["path", "folder"]).astype({"path": object, "folder": bool})

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rest, files = spark.createDataFrame([("",)], "path string"), None
    while True:
        round_ = materialise(rest.mapInPandas(search, FOUND))
        here = round_.filter(~F.col("folder")).select("path")
        files = here if files is None else files.unionByName(here)
        rest = round_.filter("folder").select("path")
        if rest.isEmpty():
            return files
        rest = rest.repartition(tasks, "path")
