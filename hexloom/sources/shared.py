"""Tables in the folder that all executors share, which cut lineage and outlive a lost executor; and the package itself,
sent to executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only where that is unset and driver and executors are one process, a
    temporary one; a cluster without a shared folder is an error, as its executors couldn't read each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="hexloom-"))
    return _own_dir[0]


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Delete the tables that ``written`` makes inside, but for those made with ``keep``, when the block ends."""
    _scratch.append([])
    try:
        yield
    finally:
        for df in _scratch.pop():
            dropped(df)


def written(df: DataFrame, name: str, keep: bool = False, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage.

    ``keep``: the table outlives the innermost ``scratch`` block (but not one around that). ``by``: its last column, each
    of whose values gets a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    back = spark.read.schema(df.schema).parquet(path)
    back._hexloom_path = path
    level = len(_scratch) - 1 - keep
    if level >= 0:
        _scratch[level].append(back)
    return back


def dropped(df: DataFrame) -> None:
    """Delete a table that ``written`` made and that nothing reads any more."""
    path = getattr(df, "_hexloom_path", None)
    if path:
        deleted(df.sparkSession, path)


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which need no copy of it then; once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_hexloom_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="hexloom-")) / "hexloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    sc.addPyFile(str(path))
    sc._hexloom_shipped = True
