"""Tables written to end a lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
#: Tables of this process in the shared folder; what is left goes when the process ends.
_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset and all runs in one process (tests), one of our own."""
    global _own_dir
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="strata-shared-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: later plans start at its files, also after an executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/strata-{name}-{uuid.uuid4().hex[:12]}"
    _made[path] = df.sparkSession
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Take away tables made by ``written`` that nothing reads any more."""
    for df in tables:
        for path in {p for p in _made if any(p.rsplit("/", 1)[-1] in f for f in df.inputFiles())}:
            _delete(_made.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove_all() -> None:
    for path, spark in list(_made.items()):
        with contextlib.suppress(Exception):  # the cluster may be gone
            _delete(spark, path)
