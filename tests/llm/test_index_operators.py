import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from pairlens.llm import permindex, warc
from pairlens.llm.common import stage_path, stage_table


def test_permutation_index(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (1500, 16))
    x[700:720] = x[3]
    rows = [(k, v.tolist(), 0.5) for k, v in enumerate(x)]
    rows += [(2000, None, 0.0), (2050, [0.0] * 16, 0.0), (2100, [float("nan")] * 16, 0.0), (2150, [1.0] * 15 + [None], 0.0), (2200, [1.0, 2.0], 0.0), (None, [1.0] * 16, 0.0), (2250, [], 0.0), rows[50], rows[50]]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score double")
    got = permindex.search(table, lambda i: i % 50 == 0, shard_rows=400, block_rows=8, pivots=64, prefix=24).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    assert {r.query_id for r in got} == set(range(0, 1500, 50))
    for q in range(0, 1500, 50):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        cosine = u @ u[q]
        cosine[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(cosine, 12)))[:5]
        hits += len(set(best.tolist()) & {r.vec_id for r in mine})
        for r in mine:
            assert r.score == pytest.approx(cosine[r.vec_id], abs=1e-12)
    assert hits / 150 >= 0.9
    q = sorted((r for r in got if r.query_id == 700), key=lambda r: r["rank"])
    assert [r.vec_id for r in q] == [3, 701, 702, 703, 704]


@pytest.mark.parametrize("spread", [1e-5, 1e-3, 0.01, 0.05])
def test_a_third_near_copies(spread):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (6000, 32))
    crowd = np.arange(0, 6000, 3)
    x[crowd] = x[0] + rng.normal(0, spread, (len(crowd), 32))
    pivots = permindex.distinct_directions(x[:1024], 128)
    order = permindex.orders(x, pivots, 48)
    q = crowd[::50]
    got = permindex.search_shard(np.arange(6000), x, order, q, x[q], order[q], 5, 0.18, 300)
    u, hits = permindex.unit(x), 0
    for i in q:
        cosine = u @ u[i]
        cosine[i] = -9
        hits += len(set(np.argsort(-cosine, kind="stable")[:5].tolist()) & {v for a, v, _ in got if a == i})
    assert hits / (5 * len(q)) >= 0.99


def test_recall_on_fifty_thousand_vectors_without_clusters(spark):
    """The hardest case: the five nearest have cosines of about 0.5."""
    rng = np.random.default_rng(12)
    x = rng.normal(0, 1, (50_000, 64)).astype(np.float32)
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(50_000), "embedding": x.tolist()}), "vec_id bigint, embedding array<float>")
    got = permindex.search(table, lambda i: i % 500 == 0).toPandas()
    u, hits = permindex.unit(x.astype(float)), 0
    for q, mine in got.groupby("query_id"):
        cosine = u @ u[q]
        cosine[q] = -9
        best = np.argsort(-cosine)[:5]
        hits += len(set(best.tolist()) & set(mine.vec_id))
        np.testing.assert_allclose(mine.score, cosine[mine.vec_id], atol=1e-12)
    assert len(got) == 500 and hits / 500 >= 0.9


def test_few_vectors_and_none(spark):
    schema = "vec_id bigint, embedding array<float>"
    got = permindex.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], schema), lambda i: i == 0).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2), (2, 1)]
    assert permindex.search(spark.createDataFrame([], schema), lambda i: i == 0).count() == 0
    assert permindex.search(spark.createDataFrame([(5, [1.0])], schema), lambda i: i % 5 == 0).count() == 0


def pages():
    rng = random.Random(2)
    rows = [(k, f"https://www.h{k % 7}.example/p/{k % 50}?x={k}", f"<p>{rng.random()} ü\r\n\r\nWARC/1.1\r\n</p>" * rng.randint(1, 4)) for k in range(300)]
    rows += [(400 + k, "http://hot.example/", "same") for k in range(150)]
    return rows + [(600, None, None), (601, "http://a.example/ b\nc", ""), (602, "", "long" * 30_000), (None, "http://n.example", "null key"), (700, "http://r.example", "twice"), (700, "http://r.example", "twice")]


def test_archive_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, url_key int").repartition(5)
    got = warc.archive(df).collect()
    assert len(got) == len(rows)
    payload = [(r[2] or "").encode() for r in rows]
    last = {}
    for r, p in zip(rows, payload):
        last[p] = max((k for k in (last.get(p), r[0]) if k is not None), default=None)
    want = sorted((str(r[0]), len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if r[0] == last[p] else "revisit", str(None if r[0] == last[p] else last[p])) for r, p in zip(rows, payload))
    assert want == sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got)
    keys = [(r.url_key, r.captured_at, r.page_id is not None, r.page_id or 0) for r in got]
    assert keys == sorted(keys)
    assert warc.archive(df.limit(0)).count() == 0
    few = warc.archive(df, min_payload=10).where("record_type = 'revisit'").collect()
    assert few == []


def test_loser_tree():
    rng = random.Random(3)
    for k in (1, 2, 3, 7, 16):
        pieces = [sorted((("run", rng.choice("abc"), rng.randint(0, 9), rng.randint(0, 99)) for _ in range(rng.randint(0, 30))), key=warc.order) for _ in range(k)]
        merged = list(warc.LoserTree([map(warc.order, p) for p in pieces]))
        assert [key for _, key in merged] == sorted(warc.order(r) for p in pieces for r in p)
        assert Counter(run for run, _ in merged) == Counter({i: len(p) for i, p in enumerate(pieces) if p})
    assert list(warc.LoserTree([])) == []


def test_any_id_and_small_ranges(spark):
    ids = [-(2**63), -5, 0, 253_402_300_800, 2**63 - 1]
    rows = [(k, f"http://h{k % 3}.example", f"page {k % 2}" * 400) for k in ids] + [(k, "http://x.example", "y" * 200_000) for k in range(10, 14)]
    path = stage_path(spark, "warc")
    warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path, file_bytes=50_000)
    found = stage_table(warc.runs(spark, path), "runs")
    assert found.select("run").distinct().count() > 1  # by bytes
    got = warc.merge(found, rows_per_task=2).collect()
    assert {r.page_id for r in got} == {r[0] for r in rows} and len(got) == len(rows)
    keys = [(r.url_key, r.captured_at, r.page_id) for r in got]
    assert keys == sorted(keys) and all(r.captured_at.year < 2100 for r in got)


def test_broken_records():
    with pytest.raises(ValueError):
        list(warc.records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.records(b"nothing"))


def test_url_keys():
    assert warc.url_key("https://www.B.example.com:443/a?b=1#c") == "com,example,b)/a?b=1#c"
    assert warc.url_key("http://x.example:8080") == "example,x:8080)/" and warc.url_key("") == ""
