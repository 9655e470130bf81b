"""Tables of folders that a rebuild replaces as a whole: readers follow a list of valid folders.

``<path>/data/run=<id>/<column>=<value>/..`` holds what one write left, and
``<path>/commits`` the lists: every write adds one file that names all valid folders,
those of earlier writes that still hold included. The file is renamed into place when
all data is written, so a write that fails, at any point, leaves the state before it.
"""

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT = "version bigint, folder string, n bigint"
_PLAIN = re.compile(r"[A-Za-z0-9_.-]+")


def _files(spark: SparkSession, path: str):
    """(the file system that has a path, the path in it)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    files, at = _files(spark, f"{path}/commits")
    return spark.read.schema(COMMIT).json(f"{path}/commits") if files.exists(at) else None


def listed(spark: SparkSession, path: str) -> tuple[int, dict[str, int]]:
    """The newest version and its folders with their rows; version 0 has none.

    As many as the table has folders, which the columns it is stored by list.
    """
    commits = _commits(spark, path)
    if commits is None:
        return 0, {}
    newest = (
        commits.groupBy("version")
        .agg(F.collect_list(F.struct("folder", "n")).alias("folders"))
        .orderBy(F.desc("version"))
        .first()
    )
    if newest is None:
        return 0, {}
    return newest.version, {x.folder: x.n for x in newest.folders if x.folder is not None}


def write(df: DataFrame, path: str, by: Sequence[str], stays: Callable[[dict[str, str]], bool] | None = None) -> None:
    """Store ``df`` by the columns ``by`` and make its folders the valid ones.

    Folders of earlier writes whose column values ``stays`` accepts remain valid beside
    them; without it none does. One writer at a time: of two at once, the later commit
    would not know the other's folders. Files are of an even size.
    """
    spark, path, run = df.sparkSession, path.rstrip("/"), uuid.uuid4().hex
    version, folders = listed(spark, path)
    target = f"{path}/data/run={run}"
    df.hint("rebalance", *by).write.partitionBy(*by).parquet(target)
    written = spark.read.schema(df.schema).parquet(target).groupBy(*by).agg(F.count("*").alias("n")).collect()
    kept = {f: n for f, n in folders.items() if stays is not None and stays(_values(f))}
    for row in written:
        values = [str(row[c]) for c in by]
        if not all(map(_PLAIN.fullmatch, values)):
            raise ValueError(f"no folder can be named by {dict(zip(by, values, strict=True))}")
        kept["/".join([f"run={run}", *(f"{c}={v}" for c, v in zip(by, values, strict=True))])] = row.n
    rows = [(version + 1, f, n) for f, n in kept.items()] or [(version + 1, None, None)]
    spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("append").json(f"{path}/commits")


def _values(folder: str) -> dict[str, str]:
    return dict(part.split("=", 1) for part in folder.split("/")[1:])


def read(spark: SparkSession, path: str, schema: T.StructType, wanted: Callable[[dict[str, str]], bool] | None = None) -> DataFrame:
    """The rows of the valid folders, or of those whose column values are ``wanted``. Only these are listed."""
    path = path.rstrip("/")
    version, folders = listed(spark, path)
    if not version:
        raise FileNotFoundError(f"nothing has been written to {path}")
    chosen = [f"{path}/data/{f}" for f in sorted(folders) if wanted is None or wanted(_values(f))]
    if not chosen:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*chosen).select(*schema.names)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Remove data that the newest commit does not name; returns the removed folders.

    For when nothing reads an older state any more.
    """
    path = path.rstrip("/")
    valid = set(listed(spark, path)[1])
    files, root = _files(spark, f"{path}/data")
    removed = []

    def clear(at, name: str) -> None:
        for status in files.listStatus(at):
            folder = f"{name}/{status.getPath().getName()}".lstrip("/")
            if folder in valid:
                continue
            if status.isDirectory() and any(v.startswith(f"{folder}/") for v in valid):
                clear(status.getPath(), folder)
            elif status.isDirectory():
                files.delete(status.getPath(), True)
                removed.append(folder)

    clear(root, "")
    return removed
