"""Session factory and the shared scratch folder that lineage is cut into."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_TIME_ZONE = "UTC"


def build_session(app: str = "lorespark", master: str | None = None, time_zone: str = DEFAULT_TIME_ZONE,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and the charset settings that cp1251 pages need."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", time_zone)
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.legacy.javaCharsets", "true")
         .config("spark.sql.legacy.codingErrorAction", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where it is unset and Spark is local."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    known = getattr(spark, "_lorespark_dir", None)
    if known is None:
        known = "file://" + tempfile.mkdtemp(prefix="lorespark-")
        spark._lorespark_dir = known  # type: ignore[attr-defined]
    return known


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python or the surrounding ``scratch`` ends."""
    path = f"{shared_dir(spark)}/lorespark/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    _PATHS.append(path)
    return path


_PATHS: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are deleted at the end, for drivers that live long; results have to be written or collected before."""
    before = set(_PATHS)
    try:
        yield
    finally:
        for path in [p for p in _PATHS if p not in before]:
            _delete(spark, path)
            _PATHS.remove(path)


class Stage:
    """Intermediate tables of one operator run, written to the shared folder.

    ``cut`` writes a DataFrame as parquet and reads it back, so later steps neither recompute it
    nor depend on executors that may be lost; ``drop`` removes a table no longer needed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def cut(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, self.name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lorespark_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_lorespark_path", None):
            _delete(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
