import datetime as dt

import numpy as np
import pandas as pd
from panels import panel

from pairlens.operators import features as f
from pairlens.operators.signals import rule_signal
from pairlens.streaming import bars as st


def test_late_ticks_are_dropped(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = lambda hours, kind, v: [(k, start + dt.timedelta(hours=h), 1, kind, v) for k, h in enumerate(hours)]
    schema = st.EVENTS.replace("timestamp_ntz", "timestamp")
    spark.createDataFrame(rows([0.1, 1.1, 5.1], "click", 1.0) + rows([0.2, 1.2, 5.2], "view", 2.0), schema).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    # rows are held against the watermark of the batch before, so one more batch lies between
    spark.createDataFrame(rows([5.3], "view", 2.0), schema).coalesce(1).write.parquet(str(tmp_path / "in/a2"))
    spark.createDataFrame(rows([1.9], "click", 99.0) + rows([9.5], "view", 2.0), schema).coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = st.event_stream(spark, str(tmp_path / "in/*"), schema, files_per_trigger=1)
    got = st.run_available(st.stream_bars(stream, "click", "view"), "bars", str(tmp_path / "out")).orderBy("ts").collect()
    assert [(r.a_close, r.b_close) for r in got][:2] == [(1.0, 2.0), (1.0, 2.0)] and all(r.a_close < 99 for r in got)


def test_state_equals_batch_and_latest_is_kept(spark, tmp_path):
    p = panel(130, ("x", "y"))
    for k, part in enumerate(np.array_split(p.sort_values("ts"), 3)):
        spark.createDataFrame(pd.DataFrame(part)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = lambda: spark.readStream.schema("series_id string, ts timestamp, a_close double, b_close double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = st.run_available(st.incremental_features(source()), "f", str(tmp_path / "out")).orderBy("series_id", "ts").toPandas()
    want = f.momentum_features(f.ratio_features(spark.createDataFrame(p))).withColumn("signal", rule_signal()).orderBy("series_id", "ts").toPandas()
    np.testing.assert_allclose(got.ema_slope, want.ratio_ema_slope, rtol=1e-8, atol=1e-12)
    np.testing.assert_allclose(got.zscore_90.astype(float), want.ratio_zscore_90.astype(float), rtol=1e-7)
    assert (got.signal == want.signal).all()
    st.upsert_latest(source(), str(tmp_path / "last")).awaitTermination()
    last = st.latest_version(spark, str(tmp_path / "last"), "series_id string, ts timestamp, a_close double, b_close double").toPandas()
    assert len(last) == 2 and (last.ts == p.ts.max()).all()


def test_pieces_of_a_batch_and_late_bars(spark, tmp_path):
    """A batch that comes in pieces of 50 rows in no order equals the whole; bars that are not after the state's last go."""
    p = panel(300)
    cut = p.ts.sort_values().iloc[199]
    late = p[p.ts == cut].assign(a_close=999.0)
    shuffled = lambda d, k: spark.createDataFrame(d.sample(frac=1, random_state=k)).coalesce(1)
    shuffled(p[p.ts <= cut], 1).write.parquet(str(tmp_path / "in/0"))
    shuffled(pd.concat([p[p.ts > cut], late, p[p.ts == p.ts.min()]]), 2).write.parquet(str(tmp_path / "in/1"))
    source = spark.readStream.schema("series_id string, ts timestamp, a_close double, b_close double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = st.run_available(st.incremental_features(source), "f", str(tmp_path / "out")).orderBy("ts").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = f.momentum_features(f.ratio_features(spark.createDataFrame(p))).orderBy("ts").toPandas()
    assert len(got) == 300
    np.testing.assert_allclose(got.ema_slope, want.ratio_ema_slope, rtol=1e-8, atol=1e-12)


def test_store_writes_what_a_batch_touches(spark, tmp_path):
    """Against a dictionary; files follow the batch, old versions go, and a batch that runs again changes nothing."""
    schema = "series_id string, ts timestamp, a_close double, b_close double"
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    store, want = st.KeyedStore(spark, str(tmp_path / "s"), schema, buckets=16, keep=2), {}
    assert store.read().count() == 0
    rng = np.random.default_rng(3)
    batches = [[(f"k{k}", day(0), float(k), 1.0) for k in range(200)]] + [[(f"k{rng.integers(200)}", day(int(rng.integers(-2, 9))), float(rng.random()), 2.0) for _ in range(3)] for _ in range(5)] + [[]]
    for n, rows in enumerate(batches):
        for _ in range(2 if n in (0, 3) else 1):
            store.merge(spark.createDataFrame(rows, schema), n)
        for r in rows:
            if r[0] not in want or r[1:] > want[r[0]][1:]:
                want[r[0]] = r
        assert sorted(map(tuple, store.read().collect())) == sorted(want.values())
        if rows and n:
            touched = [p for p in (tmp_path / f"s/data/version={n}").glob("bucket=*")]
            assert len(touched) <= 3
    assert store.batches() == [5, 6]
    named = {(b, v) for m in store.batches() for b, v in store.versions(m).items()}
    there = {(int(p.name[7:]), int(p.parent.name[8:])) for p in (tmp_path / "s/data").glob("version=*/bucket=*")}
    assert there == named
