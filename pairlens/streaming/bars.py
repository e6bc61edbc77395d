"""Structured Streaming: ticks to two-leg bars, features with state, and the latest signal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import KEY, TS
from ..sources.shared import shared_folder, staged

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


def event_stream(spark: SparkSession, path: str, schema: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Rows of Parquet files as they come; times of no zone are taken as UTC, as watermarks need."""
    reader = spark.readStream.schema(schema or EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn(TS, F.col(TS).cast("timestamp"))


def stream_bars(ticks: DataFrame, a: str, b: str, width: str = "1 hour", delay: str = "1 hour", kind: str = "event_type", value: str = "value") -> DataFrame:
    """Bars of a tumbling window: the last value by time of each leg. Both legs are one aggregation, so no stream is joined to another.

    Rows older than the watermark are dropped; windows without both legs give no bar. Of rows of one time the largest value counts.
    """
    leg = lambda name: F.max(F.when(F.col(kind) == name, F.struct(F.col(TS).alias("at"), F.col(value).alias("v")))).getField("v")
    bars = ticks.where(F.col(kind).isin(a, b)).withWatermark(TS, delay).groupBy(F.window(TS, width).alias("w")).agg(leg(a).alias("a_close"), leg(b).alias("b_close"))
    return bars.where("a_close is not null and b_close is not null").select(F.lit(f"{a}/{b}").alias(KEY), F.col("w.start").alias(TS), "a_close", "b_close")


STATE = "ema_fast double, ema_slow double, n bigint, last timestamp, ratios array<double>"
OUT = f"{KEY} string, {TS} timestamp, ratio double, ema_slope double, zscore_30 double, zscore_90 double, signal string"


def incremental_features(bars: DataFrame, idle: str | None = None) -> DataFrame:
    """Per series the averages (10 and 30), scores (30 and 90) and the rule signal of each new bar, from a state of the two
    averages and the last 90 ratios. All bars of a batch are taken in time order, however they are cut into pieces. A bar that is not after the
    last one of the state comes too late and is left out, as are repeats of a time (the first by the two closes counts) and bars without a ratio."""
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fast, slow, n, last, ratios = state.get if state.exists else (0.0, 0.0, 0, None, [])
        last, ratios, out = None if last is None else pd.Timestamp(last), list(ratios), []
        for row in pd.concat(list(parts)).sort_values([TS, "a_close", "b_close"]).itertuples(index=False):
            at, r = getattr(row, TS), row.a_close / row.b_close if row.b_close else float("nan")
            if np.isnan(r) or last is not None and at <= last:
                continue
            fast, slow = (r, r) if n == 0 else (fast + (r - fast) * 2 / 11, slow + (r - slow) * 2 / 31)
            n, last, ratios = n + 1, at, [*ratios, r][-90:]
            z = [score(ratios, size) for size in (30, 90)]
            slope = r - ratios[-6] if len(ratios) > 5 else None
            out.append((key[0], at, r, fast - slow, *z, decide(z[0], slope)))
        state.update((fast, slow, n, None if last is None else last.to_pydatetime(), ratios))
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return bars.groupBy(KEY).applyInPandasWithState(run, OUT, STATE, "append", timeout)


def score(ratios: list[float], size: int) -> float | None:
    if len(ratios) < size:
        return None
    x = np.array(ratios[-size:])
    dev = x.std(ddof=1)
    return float((x[-1] - x.mean()) / dev) if dev > 0 else None


def decide(z: float | None, slope: float | None) -> str:
    calm = slope is not None and abs(slope) < 0.5
    if z is not None and calm and z > 1:
        return "b"
    if z is not None and calm and z < -1:
        return "a"
    return "a" if slope is not None and slope > 0 else "b"


def run_available(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Take all that is there, write it as Parquet, and read the result."""
    folder = folder or shared_folder(stream.sparkSession, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}")


class KeyedStore:
    """The latest row of each key below a folder, in hash buckets.

    A bucket's rows are files of their own version; a manifest for each batch says which version of each bucket counts. A batch reads and rewrites the buckets
    it touches and no others, so what it writes follows the batch, not the store. A batch that is run again writes its versions anew and the same manifest. Versions that no
    manifest of the last ``keep`` names go.
    """

    def __init__(self, spark: SparkSession, folder: str, schema, keys: tuple[str, ...] = (KEY,), order: str = TS, buckets: int = 64, keep: int = 3):
        self.spark, self.folder, self.keys, self.order, self.buckets, self.keep = spark, folder.rstrip("/"), list(keys), order, buckets, keep
        self.schema = schema if isinstance(schema, str) else schema.toDDL()
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = lambda p: hadoop.Path(f"{self.folder}/{p}")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Batches with a whole manifest, oldest first."""
        if not self._fs.exists(self._path("manifests")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path("manifests"))]
        return sorted(int(n[2:]) for n in names if n.startswith("b=") and self._fs.exists(self._path(f"manifests/{n}/_SUCCESS")))

    def versions(self, batch: int) -> dict[int, int]:
        """{bucket: version}, a number for each bucket."""
        return {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version long").parquet(f"{self.folder}/manifests/b={batch}").collect()}

    def rows(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/data/version={v}/bucket={b}" for b, v in versions.items()]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        done = self.batches()
        return self.rows(self.versions(done[-1]) if done else {})

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        before = [b for b in self.batches() if b < batch_id]
        known = self.versions(before[-1]) if before else {}
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        columns = batch.columns
        # of a crowd of rows of one key one is left in each task before they meet
        latest = lambda df: df.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), F.struct(self.order, *[c for c in columns if c != self.order])).alias("r")).select("r.*")
        news = staged(latest(batch).withColumn("bucket", bucket), "news")
        touched = sorted(r["bucket"] for r in news.select("bucket").distinct().collect())
        if touched:
            old = self.rows({b: known[b] for b in touched if b in known})
            both = latest(news.drop("bucket").unionByName(old)).withColumn("bucket", bucket)
            both.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/version={batch_id}")
        now = known | dict.fromkeys(touched, batch_id)
        self.spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifests/b={batch_id}")
        self.tidy()

    def tidy(self) -> None:
        """Remove manifests before the last few, and the files that no manifest names."""
        done = self.batches()
        kept, old = done[-self.keep :], done[: -self.keep]
        if not old:
            return
        named = {(b, v) for m in kept for b, v in self.versions(m).items()}
        for m in old:
            for b, v in self.versions(m).items():
                if (b, v) not in named:
                    self._fs.delete(self._path(f"data/version={v}/bucket={b}"), True)
            self._fs.delete(self._path(f"manifests/b={m}"), True)


def upsert_latest(stream: DataFrame, folder: str, buckets: int = 64, keep: int = 3):
    """Keep one row a series, its latest, in a KeyedStore below folder, batch by batch. A batch that is run again after a failure makes the same store."""
    store = KeyedStore(stream.sparkSession, folder, stream.schema, buckets=buckets, keep=keep)
    return stream.writeStream.foreachBatch(store.merge).option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()


def latest_version(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of the store below folder."""
    return KeyedStore(spark, folder, schema).read()
