"""Session-level helpers: reading tables, shared scratch space, input spreading."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for data that must outlive an executor.

    It is what the cluster names in ``spark.checkpoint.dir``. Only a plain
    ``local[...]`` session without that setting gets a temporary folder of
    this machine; anywhere else a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="gleaner-")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)


@contextmanager
def discarding() -> Iterator[None]:
    """Deletes, at its end, the tables that `materialise` wrote since it began; what was made of them must be used up by then."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        while len(_WRITTEN) > before:
            spark, path = _WRITTEN.pop()
            try:
                _delete(spark, path)
            except Exception as e:  # noqa: BLE001 - the work itself is done
                warnings.warn(f"{path} was not deleted: {e}", stacklevel=2)


@atexit.register
def _delete_written() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared scratch folder and read it back.

    Cuts the lineage like a checkpoint, but as compressed columnar files that
    later readers can prune. A lost executor loses nothing, and values that
    depend on the task that made them (row ids) are fixed from here on. The
    table is deleted when the session ends, or by `discarding`.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/gleaner-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Split the rows over all cores if the scan has fewer splits than cores.

    Large inputs have more splits than that and pass unchanged, without a
    shuffle; a small single-file input would otherwise keep one core busy. So
    do rows that come from a shuffle, which are spread already.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def tasks(spark: SparkSession, least: int = 0) -> int:
    """How many tasks a shuffle before heavy work should have, at least `least`.

    Given as a number, adaptive execution leaves it alone; otherwise it would
    merge partitions by their bytes before the work, not by the work.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, least)


def default_session(app: str = "gleaner", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this engine is planned for; given values win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return b.config(map=base | conf).getOrCreate()


__all__ = ["table", "scratch_dir", "materialise", "discarding", "spread", "tasks", "default_session"]
