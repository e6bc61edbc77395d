"""Toxicity: non-negative positive-unlabelled learning on the presence of words.

Confirmed toxic training rows are the positives; a sample of all training rows is the unlabelled text. Words are lower-cased, stripped of
ASCII punctuation and hashed to ``BUCKETS``, and so are their beginnings of 4 to 8 characters; the ``max_words`` buckets that most surely are more frequent among positives, and that by the
class prior mark more positives than other rows, become the features of a linear scorer. The class prior is the share of 1 among the labelled training rows. Fitting takes bounded
samples (``max_positive``, ``max_unlabelled`` rows by the key's hash); scoring reads whole texts.

Defined cases: null text counts as empty and gets the score of a text without any feature. A null key is scored, but never
learned from. Without confirmed positives each row gets the prior, 0 where nothing is labelled. Extra columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nnpu
from .common import stage_table, utf8, words
from .quality import sample_texts, training_rows

BUCKETS = 1 << 22
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def parts(word: bytes) -> list[int]:
    """The buckets of a word and of its beginnings of 4 to 8 characters, which catch compounds and inflections."""
    w = word.strip(_EDGE)
    if not w:
        return []
    text = w.decode("utf-8", "replace")
    return [zlib.crc32(w) % BUCKETS, *[zlib.crc32(b"^" + text[:k].encode()) % BUCKETS for k in range(4, min(9, len(text)))]]


def buckets(text: bytes | None) -> list[int]:
    """The distinct buckets of a whole text, ascending."""
    return sorted({b for w in set(words(text)) for b in parts(w)})


@dataclass
class ToxicityModel:
    columns: dict[int, int]
    scorer: nnpu.PUModel

    def matrix(self, rows: list[list[int]]) -> np.ndarray:
        x = np.zeros((len(rows), len(self.columns)))
        for i, row in enumerate(rows):
            for b in row:
                if (j := self.columns.get(b)) is not None:
                    x[i, j] = 1
        return x

    def score(self, texts: list[bytes | None], seen: dict[bytes, list[int]] | None = None) -> np.ndarray:
        """seen: the columns of words met before; emptied when it has a few hundred thousand."""
        x, seen = np.zeros((len(texts), len(self.columns))), {} if seen is None else seen
        get = self.columns.get
        if len(seen) > 300_000:
            seen.clear()
        for i, t in enumerate(texts):
            for w in set(words(t)):
                at = seen.get(w)
                if at is None:
                    at = seen[w] = [j for b in parts(w) if (j := get(b)) is not None]
                for j in at:
                    x[i, j] = 1
        return self.scorer.score(x)


def choose(sample: DataFrame, prior: float, max_words: int) -> dict[int, int]:
    """Columns of the max_words buckets that tell positives most surely from unlabelled rows.

    sample: (k, p, x), x being a row's buckets. The log likelihood ratio of a bucket's rows among positives and among unlabelled rows that are not positives as well, against
    equal shares, must exceed the logarithm of the number of buckets tried: so few of them get there by chance, in small samples and in large ones. Counted on the executors;
    the driver gets the chosen ones only.
    """
    positive = sample.where("p").select("k", F.lit(True).alias("known")).distinct()
    rows = sample.join(F.broadcast(positive), "k", "left").select("p", "x", (~F.col("p") & F.col("known").isNull()).alias("other"))
    n_p, n_u, n_o = rows.agg(F.count(F.when(F.col("p"), 1)), F.count(F.when(~F.col("p"), 1)), F.count(F.when(F.col("other"), 1))).first()
    if not n_p or not n_o:
        return {}
    counts = rows.select("p", "other", F.explode("x").alias("bucket")).groupBy("bucket").agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("cp", F.col("p")), ("cu", ~F.col("p")), ("co", F.col("other")))])
    counts = stage_table(counts, "counts")
    tried = counts.count()
    x, m, expected = F.col("cp") / (F.col("cp") + F.col("co")), F.col("cp") + F.col("co"), n_p / (n_p + n_o)
    part = lambda share, against: F.when(share > 0, share * F.log(share / against)).otherwise(0.0)
    ratio = m * (part(x, F.lit(expected)) + part(1 - x, F.lit(1 - expected)))
    # by the prior, most rows with such a bucket must be positives
    good = counts.where((x > expected) & (F.col("cp") / n_p * prior >= F.col("cu") / n_u * 0.7)).withColumn("ratio", ratio).where(F.col("ratio") > float(np.log(max(tried, 2))))
    return {r["bucket"]: k for k, r in enumerate(good.orderBy(F.desc("ratio"), "bucket").limit(max_words).collect())}


def fit(docs: DataFrame, labels: DataFrame, train: F.Column, label: str = "toxic", key: str = "doc_id", text: str = "text", max_positive: int = 4000, max_unlabelled: int = 8000, max_words: int = 512) -> ToxicityModel:
    rows, prior = training_rows(docs, labels, train, label, key, max_positive, max_unlabelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([buckets(t) for t in utf8(b.column(2))], pa.list_(pa.int32()))], names=["k", "p", "x"])

    sample = stage_table(sample_texts(docs, rows, key, text).mapInArrow(run, "k string, p boolean, x array<int>"), "sample")
    model = ToxicityModel(choose(sample, prior, max_words), None)
    kept = F.array_intersect("x", F.array(*[F.lit(b) for b in model.columns])) if model.columns else F.array().cast("array<int>")
    got = sample.select("k", "p", kept.alias("x")).toArrow().sort_by([("k", "ascending"), ("p", "ascending")])
    p, x = np.array(got["p"].to_pylist(), bool), model.matrix(got["x"].to_pylist())
    model.scorer = nnpu.fit(x[p], x[~p], prior, steps=300, rate=0.03, decay=3e-5, standardise=False)
    return model


def predict(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: key, score (0 to 1), predicted (1 from 0.5)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        for b in batches:
            texts = utf8(b.column(1))
            s = np.concatenate([model.score(texts[i : i + 1000], seen) for i in range(0, len(texts), 1000)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype("int32"))], names=["key", "score", "predicted"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)
