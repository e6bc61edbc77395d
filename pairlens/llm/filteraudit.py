"""Filter interaction audit by wide packed counters: what each of five filters removes in each of the 120 orders they can be applied in.

The failing filters of a document are a mask of five bits. Each mask stands for one wide integer whose fields (``WIDTH`` bits) hold the
outcomes of all 600 steps (120 orders of five): kept, removed here, redundant; then the sole failures, and what good and toxic documents
are removed. Tasks add up the integers of their documents for each part, one integer a part; partial sums meet in two levels of at most
``FAN_IN`` tasks, and are unpacked at the end. A field counts documents, so it holds 2**48 of them before it reaches its neighbour;
``unpack`` checks that the parts' totals are below.

Filters (words are maximal runs of anything but ASCII white space, case-sensitive): A under 200 words; B less than half of the words
distinct; C more than 3 % of the code points in A-Z; D holds one of ``#$%&*|``; E the same text as a row of a smaller doc_id, which is the
smallest doc_id of each text, found by aggregation of 128-bit hashes (equal hashes are taken as equal texts).

Defined cases: null text is empty text, and equal to it; a null lang is the empty part; a row without a doc_id has no labels, no smaller
row and is not smaller than another; rows of one doc_id and text are not smaller than each other; of repeated label rows one with 1
is enough. No documents: no parts, no rows. Extra columns are not looked at. Parts in a task are flushed beyond ``MOST_PARTS``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, utf8

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = [(order, k) for order in ORDERS for k in range(len(FILTERS))]
#: Fields: kept, removed, redundant of each step, sole failures of each filter, all documents, removals of good and of toxic documents.
N, SOLE = len(STEPS), 3 * len(STEPS)
TOTAL, GOOD = SOLE + len(FILTERS), SOLE + len(FILTERS) + 1
FIELDS, WIDTH = GOOD + 2 * N, 48
MOST_PARTS, FAN_IN = 64, 64
OUT = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

_SYMBOLS = re.compile(rb"[#$%&*|]")
_UPPER = bytes(range(65, 91))
_INNER = bytes(range(0x80, 0xC0))


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    n = len(words)
    points = len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, _INNER)))
    upper = len(text) - len(text.translate(None, _UPPER))
    return (n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * upper > 3 * points) << 2 | bool(_SYMBOLS.search(text)) << 3


@cache
def wide(mask: int, good: bool, toxic: bool) -> int:
    """The wide integer of one document."""
    field = np.zeros((FIELDS, WIDTH // 8), np.uint8)
    for s, (order, k) in enumerate(STEPS):
        fails = mask >> FILTERS.index(order[k]) & 1
        gone = any(mask >> FILTERS.index(f) & 1 for f in order[:k])
        removed = fails and not gone
        field[3 * s : 3 * s + 3, 0] = (not gone and not fails, removed, fails and gone)
        field[GOOD + s, 0], field[GOOD + N + s, 0] = removed and good, removed and toxic
    for k in range(len(FILTERS)):
        field[SOLE + k, 0] = mask == 1 << k
    field[TOTAL, 0] = 1
    return int.from_bytes(field.tobytes(), "little")


def packed(x: int) -> bytes:
    return x.to_bytes(FIELDS * WIDTH // 8, "little")


def unpack(x: int) -> np.ndarray:
    """The fields of a sum of wide integers."""
    raw = np.frombuffer(packed(x), np.uint8).reshape(FIELDS, WIDTH // 8)
    out = np.zeros((FIELDS, 8), np.uint8)
    out[:, : WIDTH // 8] = raw
    fields = out.view("<i8")[:, 0]
    if fields.max(initial=0) > fields[TOTAL]:
        raise OverflowError("a field counts more than all documents")
    return fields


def marked(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """(id, part, mask, h1, h2): the failures A to D and a hash of each row's text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = [t or b"" for t in utf8(b.column(2))]
            h = np.array([divmod(xxhash.xxh3_128_intdigest(t), 1 << 64) for t in texts], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([failures(t) for t in texts], pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["id", "part", "mask", "h1", "h2"])

    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, part string, mask int, h1 bigint, h2 bigint")


def masks(docs: DataFrame, labels: DataFrame, key: str, text: str, part: str, good: Column, toxic: Column) -> DataFrame:
    """(part, mask, good, toxic, n): documents with all five failures, rows of equal text summed up.

    Everything is aggregated in the tasks before it is shuffled, so that a text, a key or a part with a third of all rows is a few rows a task.
    """
    one = lambda c: F.coalesce(F.max(c.cast("int")) == 1, F.lit(False))
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(one(good).alias("good"), one(toxic).alias("toxic"))
    # rows without a key meet no labels: they are dealt out by their text
    salt = F.when(F.col("id").isNull(), F.pmod("h1", F.lit(997)) + 1).otherwise(0)
    rows = marked(docs, key, text, part).groupBy("id", "part", "mask", "h1", "h2").agg(F.count("*").alias("n")).withColumn("salt", salt)
    rows = rows.join(marks.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    has = F.col("id").isNotNull()
    same = rows.groupBy("h1", "h2", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("keyed"), F.min(F.when(has, F.struct("id", "n"))).alias("first")
    )
    # a row for each part and label of a text: the smallest key of all is not a copy
    least = F.min("first.id").over(Window.partitionBy("h1", "h2"))
    same = same.withColumn("least", least).withColumn("copies", F.col("keyed") - F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0))
    both = F.array(F.struct(F.col("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), F.col("copies").alias("n")))
    return same.select("part", "good", "toxic", F.inline(both)).where("n > 0")


def summed(rows: DataFrame) -> DataFrame:
    """(part, w): the sum of the wide integers of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([packed(x) for x in held.values()], pa.binary())], names=["part", "w"])

        for b in batches:
            for part, mask, good, toxic, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held[part] = held.get(part, 0) + n * wide(mask, good, toxic)
                if len(held) > MOST_PARTS:
                    yield out()
                    held.clear()
        yield out()

    partial = rows.select("part", "mask", "good", "toxic", "n").mapInArrow(run, "part string, w binary")
    return partial.groupBy("part", F.floor(F.spark_partition_id() / FAN_IN).alias("at")).applyInArrow(_added, "part string, w binary")


def _total(t: pa.Table) -> int:
    return sum(int.from_bytes(w.as_py(), "little") for w in t["w"])


def _added(t: pa.Table) -> pa.Table:
    return pa.table({"part": t["part"].slice(0, 1), "w": pa.array([packed(_total(t))], pa.binary())})


def _steps(t: pa.Table) -> pa.Table:
    """All rows of a part."""
    f = unpack(_total(t))
    steps, sole = f[:SOLE].reshape(N, 3), f[SOLE:TOTAL]
    at = np.array([FILTERS.index(order[k]) for order, k in STEPS])
    shapley = np.zeros(len(FILTERS), np.int64)
    np.add.at(shapley, at, steps[:, 1])
    columns = {"part": [t["part"][0].as_py()] * N, "filter_order": [o for o, _ in STEPS], "step": np.array([k + 1 for _, k in STEPS], np.int32), "filter": [o[k] for o, k in STEPS]}
    columns |= {"kept": steps[:, 0], "removed": steps[:, 1], "redundant": steps[:, 2], "unique_fails": sole[at], "good_lost": f[GOOD : GOOD + N], "toxic_lost": f[GOOD + N :], "shapley": shapley[at]}
    return pa.table(columns)


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """OUT: one row for each part, order and step."""
    rows = masks(docs, labels, key, text, part, F.col(quality) == 1, F.col(toxic) == 1)
    return summed(rows).groupBy("part").applyInArrow(_steps, OUT)


SQL = r"""
with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
l as (select doc_id, max(cast(quality = 1 as int)) good, max(cast(toxic = 1 as int)) toxic from labels where doc_id is not null group by doc_id),
m as (select part, coalesce(good, 0) good, coalesce(l.toxic, 0) toxic,
    case when len(w) < 200 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
    || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 'C' else '' end || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
    || case when min(d.doc_id) over (partition by t) < d.doc_id then 'E' else '' end fails from d left join l on d.doc_id = l.doc_id),
c as (select part, fails, count(*) n, sum(good) good, sum(toxic) toxic from m group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) f),
o as (select a.f || b.f || c.f || d.f || e.f ord from x a, x b, x c, x d, x e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s as (select ord, step, ord[step] f, left(ord, step - 1) earlier from o, (select unnest(range(1, 6)) step)),
r as (select part, ord, step, f, n, good, toxic, fails, contains(fails, f) own, translate(fails, earlier, '') <> fails gone from s, c),
g as (select part, ord, step, f, sum(n) filter (not own and not gone) kept, sum(n) filter (own and not gone) removed, sum(n) filter (own and gone) redundant, sum(n) filter (fails = f) unique_fails,
    sum(good) filter (own and not gone) good_lost, sum(toxic) filter (own and not gone) toxic_lost from r group by all)
select part, ord filter_order, cast(step as int) step, f as filter, cast(coalesce(kept, 0) as bigint) kept, cast(coalesce(removed, 0) as bigint) removed, cast(coalesce(redundant, 0) as bigint) redundant,
    cast(coalesce(unique_fails, 0) as bigint) unique_fails, cast(coalesce(good_lost, 0) as bigint) good_lost, cast(coalesce(toxic_lost, 0) as bigint) toxic_lost,
    cast(sum(coalesce(removed, 0)) over (partition by part, f) as bigint) shapley from g
"""
