"""Session helpers: shared working folder, table loading, materialisation.

Intermediate tables go to the folder the cluster names in
``spark.checkpoint.dir`` (all executors share it, so losing an executor loses
nothing).  Only where that setting is absent, as in tests, an own folder is
made and set.
"""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable on the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    try:
        path = f"{shared_dir(spark)}/codeloom/code-{uuid.uuid4().hex}/codeloom.zip"
    except RuntimeError:
        return  # no shared folder: the package has to come with the application
    package = Path(__file__).resolve().parent
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    files, P = fs(spark, path)
    out = files.create(P(path), True)
    out.write(bytearray(made.getvalue()))
    out.close()
    sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, else the checkpoint folder
    set on the context, else one made here (local mode and tests only)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="codeloom-")
    atexit.register(shutil.rmtree, made, True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


_made: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared one; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/codeloom/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def drop_work() -> None:
    """Delete the folders that this driver has made for intermediate tables."""
    while _made:
        spark, path = _made.pop()
        try:
            files, P = fs(spark, path)
            files.delete(P(path), True)
        except Exception:  # noqa: BLE001, S112
            continue  # the session is gone; the folder stays


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage without tying the data to any executor: a later stage
    that loses an executor re-reads files instead of re-running Python.
    """
    spark = df.sparkSession
    ship(spark)
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give work in Python all cores where the scan has fewer partitions.

    A table in one small file is one partition; it is dealt out once.  A table
    with at least as many partitions as cores stays as it is, so large inputs
    never move for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def fs(spark: SparkSession, path: str):
    """Hadoop FileSystem and Path class for ``path`` (any scheme)."""
    jvm = spark.sparkContext._jvm
    Path = jvm.org.apache.hadoop.fs.Path
    return Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), Path


def publish(spark: SparkSession, beside: str, target: str) -> None:
    """Rename ``beside`` to ``target``, which must not exist yet.

    The target is whole or absent, and of several runs that publish the same
    target only one succeeds; the others get ``FileExistsError``.
    """
    sc = spark.sparkContext
    fs_ = sc._jvm.org.apache.hadoop.fs
    files, P = fs(spark, target)
    files.mkdirs(P(target).getParent())
    how = sc._gateway.new_array(fs_.Options.Rename, 1)
    how[0] = fs_.Options.Rename.NONE
    try:
        fs_.FileContext.getFileContext(P(target).toUri(), sc._jsc.hadoopConfiguration()).rename(files.makeQualified(P(beside)), files.makeQualified(P(target)), how)
    except Exception as e:
        if files.exists(P(target)):
            raise FileExistsError(f"another run has published {target}") from e
        raise
