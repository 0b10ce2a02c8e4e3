"""Tables in the folder that driver and executors share: they cut lineage, and any executor reads what another wrote."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset, a master of one process (tests) takes a folder made once per application; any other master is an error, since
    executors on other machines would not see a folder that the driver chose.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        return _own[app]
    if "://" in found:
        return found.rstrip("/")
    # A path without a scheme belongs to the default file system.
    path, fs = handle(spark, found)
    return re.sub("^file:/+", "file:///", fs.makeQualified(path).toString()).rstrip("/")


def handle(spark: SparkSession, name: str):
    """(path, file system) of a name, by Spark's own file access."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lost executors cost no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once nothing that is still to run reads them."""
    for table in tables:
        path, fs = handle(table.sparkSession, table.stored_path)
        fs.delete(path, True)


def exists(spark: SparkSession, name: str) -> bool:
    path, fs = handle(spark, name)
    return fs.exists(path)


def fingerprint(spark: SparkSession, *names: str) -> str:
    """A digest of the files below the paths, by name, length and time of change: equal for as long as nothing was written there."""
    found = []
    for name in names:
        path, fs = handle(spark, name)
        files = fs.listFiles(path, True)
        while files.hasNext():
            status = files.next()
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()[:32]
