"""Incremental runs: files that arrived since the last one, merged into a snapshot; sessions over a stream."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators.merge import first_seen, upsert


def session_windows(stream: DataFrame, entity: str, ts: str, gap_seconds: int = 180 * 60, watermark: str = "1 day") -> DataFrame:
    """Sessions by the built-in window; for batches the watermark has no effect.  A pause of exactly the gap does not end one."""
    w = F.session_window(ts, f"{gap_seconds} seconds")
    return (stream.withWatermark(ts, watermark).groupBy(w.alias("w"), entity).agg(F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count("*").alias("n_events")).drop("w"))


class Snapshot:
    """A table as a row of numbered snapshots in one folder; a merge writes a new one, then names it current.

    The last ``keep`` snapshots stay, for readers that are still at an older one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 3):
        self.spark, self.path, self.schema, self.keep = spark, path.rstrip("/"), schema, max(2, keep)

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs()
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()]
        ok = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(v for v in done if fs.exists(ok(f"{self.path}/v{v}/_SUCCESS")))

    def read(self) -> DataFrame:
        v = self.versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v[-1]}") if v else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame) -> None:
        """Readers see the new snapshot only once it is complete."""
        v = self.versions()
        df.write.mode("overwrite").parquet(f"{self.path}/v{(v[-1] if v else 0) + 1}")
        fs, _ = self._fs()
        for old in v[: max(0, len(v) + 1 - self.keep)]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{old}"), True)


class StopRun(Exception):
    """A run ends before its next batch because its folder holds a file named ``stop``."""


def check_flags(spark: SparkSession, folder: str, poll: float = 5.0, sleep: Callable = time.sleep) -> None:
    """Raise StopRun if ``stop`` lies in the folder; wait while ``pause`` does."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    while True:
        if fs.exists(path(f"{folder}/stop")):
            raise StopRun(folder)
        if not fs.exists(path(f"{folder}/pause")):
            return
        sleep(poll)


def merge_stream(stream: DataFrame, target: Snapshot, keys: list[str], order: str, name: str, flags: str | None = None):
    """Drain a stream into the snapshot by keyed upsert.

    The checkpoint, which marks what has been taken in, lies beside the snapshots, so a later session goes on
    from there.  ``flags``: a folder whose files ``stop`` and ``pause`` end or hold the run between batches.
    """
    def merge(batch: DataFrame, _: int) -> None:
        if flags:
            check_flags(target.spark, flags)
        target.write(upsert(target.read(), first_seen(batch, keys, [F.desc_nulls_last(order)]), keys))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{target.path}/_checkpoint/{name}").trigger(availableNow=True).start()


def touched_peers(batch: DataFrame, old: DataFrame) -> DataFrame:
    """All rows of the peers that a batch touches: what has to be chunked anew, as late rows may join any session."""
    return old.join(batch.select("peer_id").distinct(), "peer_id", "left_semi")
