"""Shared scratch tables.

Iterative operators cut their lineage by writing a Parquet table into the
folder that the cluster names in ``spark.checkpoint.dir``. All executors see
that folder, so a table survives the loss of any of them.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable for Python workers, once per application.

    Nothing is done where PYTHONPATH names its folder, as executors then have
    it; otherwise a zip of the package is added to the application.
    """
    package = os.path.dirname(os.path.abspath(__file__))
    root, app = os.path.dirname(package), spark.sparkContext.applicationId
    if app in _shipped or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="orthant-"), "orthant.zip")
    atexit.register(shutil.rmtree, os.path.dirname(target), True)
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def base_folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Only where that is unset and all of Spark runs in one process (tests) a
    temporary folder takes its place; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="orthant-")
    return base.rstrip("/")


def shared_root(spark: SparkSession) -> str:
    """Folder of this application's scratch tables, in ``base_folder``."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{base_folder(spark)}/orthant-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_table(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` itself if it is a plain Parquet table, whose rows keep their places however often they are read; else written as one."""
    plan = df._jdf.queryExecution().analyzed().getClass().getSimpleName()
    files = df.inputFiles() if plan == "LogicalRelation" else []
    return df if files and all(f.endswith(".parquet") for f in files) else materialize(df, name)


def release(df: DataFrame) -> None:
    """Delete a table that ``materialize`` made in this application and nothing reads any more; any other stays."""
    own = _roots.get(df.sparkSession.sparkContext.applicationId)
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if own and _plain(path).startswith(_plain(own) + "/"):
            _remove(df.sparkSession, path)


def _plain(path: str) -> str:
    """``path`` with one slash where a URI may have one or three."""
    scheme, colon, rest = path.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}" if colon and "/" not in scheme else path
