"""Quality classifier: non-negative positive-unlabelled learning on surface statistics of whole texts.

Trusted positives are training rows labelled 1; unlabelled web text is a sample of all training rows. The class prior is estimated from both
(``nnpu.class_prior``), or given; rows labelled 0 are not looked at. Fitting takes bounded samples:
``max_positive`` and ``max_unlabelled`` rows, chosen by the key's hash.

Defined cases: null text counts as empty; texts without words have the statistics of an empty text. A null key is scored,
but never learned from. Without labelled positives each row gets the share of 1 among the labelled, 0 where nothing is labelled. Repeated label rows count once;
of contradictory ones the largest counts. Extra columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nnpu
from .common import pieces, smallest, utf8

#: Byte classes: upper case, lower case, digit, white space, other ASCII, beyond ASCII.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[:128] = 4
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
N_FEATURES = 16


def statistics(text: bytes | None) -> list[float]:
    """N_FEATURES numbers about a whole text, in time linear in its length."""
    text = text or b""
    plain = text.split()
    n = len(plain)
    if not n:
        return [0.0] * N_FEATURES
    share = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=6) / len(text)
    counts = Counter(plain)
    top = sum(c for _, c in counts.most_common(5))
    lines = text.split(b"\n")
    inner = sum(a == b for a, b in zip(plain, plain[1:], strict=False))
    odd = sum(c for w, c in counts.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:?")
    caps = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    bare = sum(c for w, c in counts.items() if not any(x >= 128 or 48 <= x <= 57 or 65 <= x <= 90 or 97 <= x <= 122 for x in w))
    return [
        float(np.log1p(n)), len(text) / n, len(counts) / n, float(np.log1p(n) - np.log1p(len(counts))), max(counts.values()) / n, top / n, inner / n,
        share[0], share[2], share[4], share[3], odd / n, caps / n, bare / n, len(set(lines)) / len(lines), float(np.log1p(len(lines)) / (1 + np.log1p(n))),
    ]


def matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), N_FEATURES)


def training_rows(docs: DataFrame, labels: DataFrame, train: F.Column, label: str, key: str, max_positive: int, max_unlabelled: int) -> tuple[DataFrame, float]:
    """(key, positive) of the sample, at most max_positive + max_unlabelled rows, and the share of 1 among the labelled."""
    marked = labels.where(train & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label)).alias("y"))
    total, ones = marked.agg(F.count("*"), F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0))).first()
    by = F.xxhash64(F.col("k").cast("string"), F.lit("sample"))
    positive = smallest(marked.where("y = 1").select("k"), max_positive, by, F.col("k"))
    # unlabelled text is a sample of all training rows, as the class prior is theirs; a row may be in both samples
    web = docs.where(train & F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct()
    both = positive.select("k", F.lit(True).alias("p")).union(smallest(web, max_unlabelled, by, F.col("k")).select("k", F.lit(False)))
    return both, (ones / total if total else 0.0)


def sample_texts(docs: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """(k, p, t): one text for each row of the sample, however many rows of docs have its key: that of the smallest hash."""
    # both samples are bounded, and so is this broadcast; texts of one key are cut down in the tasks first
    found = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(rows), "k")
    return found.groupBy("k", "p").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("r")).select(F.col("k").cast("string"), "p", "r.t")


def fit(docs: DataFrame, labels: DataFrame, train: F.Column, label: str = "quality", key: str = "doc_id", text: str = "text", max_positive: int = 4000, max_unlabelled: int = 8000, prior: float | None = None) -> nnpu.PUModel:
    """train: a condition on the key. Texts of the sample are turned to numbers on the executors; the driver gets those."""
    rows, labelled = training_rows(docs, labels, train, label, key, max_positive, max_unlabelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(matrix(utf8(b.column(2))).tolist(), pa.list_(pa.float64()))], names=["k", "p", "x"])

    got = sample_texts(docs, rows, key, text).mapInArrow(run, "k string, p boolean, x array<double>").toArrow().sort_by([("k", "ascending"), ("p", "ascending")])
    x = np.array(got["x"].to_pylist(), float).reshape(-1, N_FEATURES)
    p = np.array(got["p"].to_pylist(), bool)
    if prior is None:
        prior = nnpu.class_prior(x[p], x[~p]) if p.any() else labelled
    return nnpu.fit(x[p], x[~p], prior, hidden=16, steps=500, rate=0.02)


def predict(docs: DataFrame, model: nnpu.PUModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: key, score (0 to 1), predicted (1 from 0.5)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            s = model.score(matrix(utf8(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype("int32"))], names=["key", "score", "predicted"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)


def keep_good(docs: DataFrame, model: nnpu.PUModel, text: str = "text") -> DataFrame:
    """The rows with a score of 0.5 or more, all columns as they are."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield b.filter(pa.array(model.score(matrix(utf8(b.column(at)))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
