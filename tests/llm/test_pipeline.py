import random

import pytest
from data import DE, EN, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(11)
    rows = [(k, words(rng, EN if k % 2 else DE, 90), "en" if k % 2 else "de", f"s{k % 3}", 0) for k in range(240)]
    junk = [(300 + k, " ".join(w + "###" for w in words(rng, EN, 60).split()), "en", "s1", 0) for k in range(60)]
    item = " ".join(f"q{k}" for k in range(25))
    copies = [(400, rows[8][1], "de", "s0", 0), (401, rows[9][1] + " " + rows[9][1], "en", "s0", 0), (402, rows[10][1], "de", None, 0)]
    leaks = [(500, rows[20][1][:200] + " " + item + " " + words(rng, DE, 40), "de", "s2", 0)]
    blank = [(600, None, None, None, 0), (601, "", "en", "s1", 0)]
    spark.createDataFrame(rows + junk + copies + leaks + blank, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1) for r in rows[::2] + rows[1::4]] + [(j[0], 0) for j in junk[::2]], "doc_id bigint, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    seen = [{r.doc_id for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen.append({r.doc_id for r in docs.collect()})
    good, known, single, clean = seen[1:]
    assert not good & set(range(300, 360)) and len(good & set(range(240))) >= 235
    assert len(known & set(range(240))) >= len(good & set(range(240))) - 2 and not known & {600, 601}
    assert known - single == {400, 401, 402} & known  # 401 is a text written twice: the same shares of shingles
    assert single - clean == {500} & single
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    assert {r.doc_id for r in mixed} <= clean and all(r.copies > 0 for r in mixed)
    target = {r.source: r.target for r in mixed}
    for s, t in target.items():
        assert abs(sum(r.taken for r in mixed if r.source == s) - t) <= 100


def test_run_equals_the_stages(spark, tables):
    got = corpus_pipeline.run(spark, tables)
    assert got.count() == corpus_pipeline.run(spark, tables).count() > 100
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
