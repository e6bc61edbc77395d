"""Benchmark decontamination: rare n-gram seeds join training passages to test items, then Smith-Waterman alignment of words.

An item of L words may be edited in E = floor(edits * L) words. Of the ways to tile the item with n-grams (n is 3, or less for
short items) that with the rarest grams in the corpus gives E + 1 disjoint seeds: E edits can spoil at most E of them, so each such
copy keeps a seed. Longer items have more seeds, the rarest gram of each stretch, so that ``min_run`` words copied in a row hold one.

An n-gram that more than ``crowd`` items have (a common opening, a template) is no seed of a single item. Items that have too few
other n-grams for E + 1 seeds are looked for by all of those, and where edits have spoilt them all, as one unit for each wording of the crowded words, decided by its shortest item
(single words of the others, outside of n-grams that are left, do not count); ``min_run`` or more such words in a row are
a unit of their own. So documents that hold a phrase of many items are aligned once with that phrase: rows and alignments grow with documents, not with documents times items.

Documents and units meet by a join on seeds; a document is aligned with the unit in windows around the places where they meet: match 1,
mismatch and gap -0.5. A passage is reported if its alignment scores ``min_score`` times L or more, which is what a copy with a fifth of its words
replaced gets, or ``min_run`` or more.

The corpus is scanned twice, whatever the number of items: for the frequencies of the items' n-grams, and for the seeds. Each scan looks
n-grams up in a filter of bits (16 MB at most, smaller for few items) before they are counted or joined; what passes it by chance is
dropped by the join, so the filter's size changes no result. Only documents that hold a seed are written.

Defined cases: null texts hold no words and are never contaminated; items without words (or with fewer than ``min_words``) are not
looked for; items of fewer than five words are found where all their words stand in a row, so an item of one word is found in every document with that word (``min_words``
leaves such items out). Equal items are reported under each item_id, or under the smallest if they are crowded; a document's repeats of a unit
give one row, its best alignment (the first of equal ones). Repeated rows are reported each. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, row_hashes, stage_table, utf8, words

MOST_LOG_BITS, SHIFTS = 27, (0, 27, 37)
ITEM, TEMPLATE, PASSAGE = range(3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def allowed(n: int, edits: float) -> int:
    return int(edits * n + 1e-9)


def gram_size(n: int, edits: float) -> int:
    """n of the n-grams of an item of this many words."""
    return max(1, min(3, n // (allowed(n, edits) + 1)))


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n-gram that starts at each word."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    h = np.full(len(codes) - n + 1, n, np.uint64)
    for j in range(n):
        h = (h ^ codes[j : len(codes) - n + 1 + j]) * _MIX
        h = h ^ (h >> np.uint64(29))
    return h


def codes_of(w: list[bytes]) -> np.ndarray:
    """Words as 64-bit hashes."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))


class Texts:
    """Some texts of a batch, one after the other: first is the row of the first, codes are all words, start and stop those of each text."""

    def __init__(self, first: int, codes: np.ndarray, lengths: list[int]):
        self.first, self.codes = first, codes
        self.stop = np.cumsum(lengths)
        self.start = self.stop - lengths
        self.row = np.repeat(np.arange(len(lengths)), lengths)

    def met(self, known: GramFilter) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the n-grams inside a text that pass the filter."""
        places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for n in known.sizes:
            h = grams(self.codes, n)
            at = known.passed(h)
            at = at[self.row[at] == self.row[at + n - 1]]
            places.append(at)
            hashes.append(h[at])
        return np.concatenate(places), np.concatenate(hashes)


def texts_of(array: pa.Array, most: int = 1 << 16) -> Iterator[Texts]:
    """The texts of a batch in parts of about so many words; a longer text is a part."""
    held, lengths, first = [], [], 0
    for t in utf8(array):
        w = words(t)
        held += w
        lengths.append(len(w))
        if len(held) >= most:
            yield Texts(first, codes_of(held), lengths)
            held, lengths, first = [], [], first + len(lengths)
    if lengths:
        yield Texts(first, codes_of(held), lengths)


def item_table(benchmark: DataFrame, item: str, text: str, edits: float, min_words: int) -> DataFrame:
    """One row for each item: iid, item, n (of its n-grams), codes, grams."""
    kind = benchmark.schema[item].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [codes_of(words(t)) for t in utf8(b.column(2))]
            at = [k for k, c in enumerate(codes) if len(c) >= max(1, min_words)]
            n = [gram_size(len(codes[k]), edits) for k in at]
            lists = [pa.array([x.view(np.int64) for x in v], pa.list_(pa.int64())) for v in ([codes[k] for k in at], [grams(codes[k], m) for k, m in zip(at, n, strict=True)])]
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(index), b.column(1).take(index), pa.array(n, pa.int32()), *lists], names=["iid", "item", "n", "codes", "grams"])

    rows = benchmark.select(F.monotonically_increasing_id().alias("iid"), F.col(item).alias("item"), F.col(text).cast("string").alias("text"))
    return stage_table(rows.mapInArrow(run, f"iid bigint, item {kind.simpleString()}, n int, codes array<bigint>, grams array<bigint>"), "items")


class GramFilter:
    """Bits for a set of n-grams (column gram, and column n): true of all of them and of few others."""

    def __init__(self, table: DataFrame):
        found = table.groupBy("n").agg(F.count("*").alias("c")).collect()
        self.sizes = sorted(r["n"] for r in found)
        total = sum(r["c"] for r in found)
        self.log_bits = min(MOST_LOG_BITS, max(12, (64 * total).bit_length()))
        mask = (1 << self.log_bits) - 1
        slots = F.explode(F.array(*[F.shiftrightunsigned("gram", s).bitwiseAND(F.lit(mask)) for s in SHIFTS]))
        # as many rows as the filter has words, however many grams there are
        rows = table.select(slots.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
        bits = np.zeros(1 << (self.log_bits - 6), np.int64)
        bits[rows["word"].to_numpy()] = rows["bits"].to_numpy()
        self.bits = table.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def passed(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be in the set."""
        bits, mask, at = self.bits.value, np.uint64((1 << self.log_bits) - 1), np.arange(len(h))
        for s in SHIFTS:
            slot = h[at] >> np.uint64(s) & mask
            at = at[(bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)]
        return at


def frequencies(docs: DataFrame, text: str, known: GramFilter, most: int = 500_000) -> DataFrame:
    """(gram, c): how often each n-gram that passes the filter is in the corpus, added up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def summed() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=["gram", "c"])

        for b in pieces(batches):
            for part in texts_of(b.column(0)):
                held.append(part.met(known)[1])
                n_held += len(held[-1])
                if n_held > most:
                    yield summed()
                    held, n_held = [], 0
        yield summed()

    return docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "gram bigint, c bigint").groupBy("gram").agg(F.sum("c").alias("c"))


def pick(counts: np.ndarray, n: int, length: int, edits: float, min_run: int) -> list[int]:
    """Where a unit's seeds start: E + 1 disjoint ones of the rarest tiling, and the rarest of each stretch that min_run words hold whole."""
    return sorted(set(tiling(counts, n, length, edits)) | set(stretches(counts, 0, len(counts), n, min_run) if length > min_run else ()))


def tiling(counts: np.ndarray, n: int, length: int, edits: float, usable: np.ndarray | None = None) -> list[int]:
    """E + 1 disjoint n-grams of the rarest tiling, none but usable ones; empty if no tiling has as many."""
    need, best = allowed(length, edits) + 1, None
    for offset in range(n):
        at = [p for p in range(offset, len(counts), n) if usable is None or usable[p]]
        if len(at) >= need:
            rare = sorted((counts[p], p) for p in at)[:need]
            if best is None or sum(f for f, _ in rare) < best[0]:
                best = (sum(f for f, _ in rare), [p for _, p in rare])
    return best[1] if best else []


def stretches(counts: np.ndarray, start: int, stop: int, n: int, min_run: int) -> list[int]:
    """The rarest n-gram of each stretch between two places; min_run words inside hold a stretch whole."""
    size = max(1, (min_run - n + 1) // 2)
    return [min(range(k, min(k + size, stop)), key=lambda p: (counts[p], p)) for k in range(start, stop, size)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Where flags are set: (first, one past the last) of each run."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def units_of(codes: np.ndarray, n: int, counts: np.ndarray, crowded: np.ndarray, edits: float, min_run: int) -> list[tuple[int, np.ndarray, int, int, list[int]]]:
    """What stands for an item: (kind, name, first word, one past the last, places of seeds in the item). Items with units of one kind and name share them.

    ITEM: by itself, with seeds that few items have. TEMPLATE: an item without enough of those to survive all edits, named by its crowded words. PASSAGE: min_run or more crowded words in a row.
    """
    length, out = len(codes), []
    passages_ = [(a, b + n - 1) for a, b in runs(crowded)]
    seeds = tiling(counts, n, length, edits, ~crowded)
    if seeds:
        for a, b in runs(~crowded) if length > min_run else ():
            # a run of words with one of these n-grams has the first, the last, or a whole stretch
            seeds += [a, b - 1, *stretches(counts, a, b, n, min_run)]
        out.append((ITEM, codes, 0, length, sorted(set(seeds))))
    else:
        if not crowded.all():
            out.append((ITEM, codes, 0, length, np.flatnonzero(~crowded).tolist()))
        named = np.concatenate([[length - sum(b - a for a, b in passages_) > 0], *(np.append(codes[a:b], 0) for a, b in passages_)]).astype(np.uint64)
        out.append((TEMPLATE, named, 0, length, pick(counts, n, length, edits, min_run)))
    for a, b in passages_:
        if b - a >= min_run and not any(kind == PASSAGE and np.array_equal(name, codes[a:b]) for kind, name, *_ in out):
            out.append((PASSAGE, codes[a:b], a, b, stretches(counts, a, b - n + 1, n, min_run)))
    return out


def unit_table(items: DataFrame, frequency: DataFrame, edits: float, min_run: int, crowd: int) -> DataFrame:
    """(uid, item, items, n, kind, codes, at, gram): what documents are aligned with. item is the smallest of the unit's items, items their number.

    An n-gram that more than ``crowd`` items have is crowded. Items that agree in what is crowded are one unit there, its shortest item or its passage,
    so that documents which hold a phrase of many items meet one unit, not each of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "s1", "s2", "iid", "n", "length", "codes", "at", "gram"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        for b in pieces(batches, 200):
            out, item = [], []
            for k, (iid, n, words_, rows) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True)):
                codes = np.array(words_, np.int64).view(np.uint64)
                counts, crowded = np.array([r["c"] for r in rows]), np.array([r["crowded"] for r in rows])
                for kind, name, first, last, at in units_of(codes, n, counts, crowded, edits, min_run):
                    s1, s2 = (iid, 0) if kind == ITEM else (x - (1 << 63) for x in divmod(xxhash.xxh3_128_intdigest(name.tobytes()), 1 << 64))
                    out.append((kind, s1, s2, iid, n, last - first, codes[first:last].view(np.int64), [p - first for p in at], [rows[p]["gram"] for p in at]))
                    item.append(k)
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types, strict=True)), b.column(1).take(pa.array(item, pa.int64()))], names=[*names, "item"])

    each = items.select("iid", "n", F.posexplode("grams").alias("at", "gram"))
    found = each.groupBy("gram").agg(F.count_distinct("iid").alias("items")).join(frequency, "gram", "left").select("gram", F.coalesce("c", F.lit(0)).alias("c"), (F.col("items") > crowd).alias("crowded"))
    # one group an item, as long as the item is
    rows = each.join(found, "gram").groupBy("iid").agg(F.sort_array(F.collect_list(F.struct("at", "gram", "c", "crowded"))).alias("rows"))
    kind = items.schema["item"].dataType.simpleString()
    single = items.select("iid", "item", "n", "codes").join(rows, "iid").mapInArrow(run, f"kind int, s1 bigint, s2 bigint, iid bigint, n int, length int, codes array<bigint>, at array<int>, gram array<bigint>, item {kind}")
    units = single.groupBy("kind", "s1", "s2", "n").agg(F.count("*").alias("items"), F.min("item").alias("item"), F.min(F.struct("length", "iid", "codes", "at", "gram")).alias("u"))
    return stage_table(units.select(F.monotonically_increasing_id().alias("uid"), "item", "items", "n", "kind", "u.codes", "u.at", "u.gram"), "units")


def align(item: np.ndarray, window: np.ndarray, penalty: float = 0.5) -> tuple[float, int, int]:
    """Best local alignment: score, first and last word of the window (-1 if none). Ties: the first end."""
    n = len(window)
    step = np.arange(n + 1) * penalty
    h, start = np.zeros(n + 1), np.arange(n + 1)
    best = (0.0, -1, -1)
    for w in item:
        t = np.zeros(n + 1)
        s = np.arange(n + 1)
        diagonal = h[:-1] + np.where(window == w, 1.0, -penalty)
        up = h[1:] - penalty
        t[1:] = np.maximum(np.maximum(diagonal, up), 0)
        s[1:] = np.where(t[1:] == 0, s[1:], np.where(diagonal >= up, start[:-1], start[1:]))
        lift = t + step
        run = np.maximum.accumulate(lift)
        origin = np.maximum.accumulate(np.where(lift >= run, np.arange(n + 1), 0))
        h, start = run - step, s[origin]
        j = int(h.argmax())
        if h[j] > best[0] + 1e-9:
            best = (float(h[j]), int(start[j]), j - 1)
    return best


def best_passage(item: np.ndarray, codes: np.ndarray, diagonals: list[int], slack: int) -> tuple[float, int, int]:
    """The best alignment of an item with windows of a document around the places where seeds met: score, first and last word."""
    spans: list[list[int]] = []
    for d in sorted(diagonals):
        lo, hi = max(0, d - slack), min(len(codes), d + len(item) + slack)
        if spans and lo <= spans[-1][1] - len(item):
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    found = ((*(a := align(item, codes[lo:hi]))[:1], -lo, a[1] + lo, a[2] + lo) for lo, hi in spans)
    score, _, first, last = max(found)
    return score, first, last


def passages(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, edits: float, min_score: float, min_words: int, min_run: int, crowd: int) -> DataFrame:
    """(key, h1, h2, item, items, score, length, matched, first_word, last_word) for each row and unit it holds a copy of; h1 and h2 name the row."""
    kind = docs.schema[key].dataType
    items = item_table(benchmark, item, item_text, edits, min_words)
    known = GramFilter(items.select("n", F.explode("grams").alias("gram")).distinct())
    units = unit_table(items, frequencies(docs, text, known), edits, min_run, crowd)
    seeds = units.select("uid", "n", F.inline(F.arrays_zip("at", "gram")))
    wanted = GramFilter(seeds.select("n", "gram").distinct())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            row, met = [], []
            for part in texts_of(b.column(4)):
                places, hashes = part.met(wanted)
                by = np.argsort(part.row[places], kind="stable")
                places, hashes = places[by], hashes[by]
                rows, edge = np.unique(part.row[places], return_index=True)
                for k, lo, hi in zip(rows, edge, np.append(edge[1:], len(places)), strict=False):  # no rows, no edges
                    row.append(part.first + k)
                    met.append((part.codes[part.start[k] : part.stop[k]].view(np.int64), (places[lo:hi] - part.start[k]).astype(np.int32), hashes[lo:hi].view(np.int64)))
            index = pa.array(row, pa.int64())
            lists = [pa.array([m[k] for m in met], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(index) for k in range(4)), *lists], names=["rid", "key", "h1", "h2", "codes", "at", "gram"])

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for k, (kind_, item_codes, codes, diagonals) in enumerate(zip(b.column(5).to_pylist(), b.column(6), b.column(7), b.column(8).to_pylist(), strict=True)):
                c = np.asarray(item_codes.values)
                score, first, last = best_passage(c, np.asarray(codes.values), diagonals, allowed(len(c), edits) + 1)
                if kind_ != PASSAGE and score >= min_score * len(c) - 1e-9 or score >= min_run - 1e-9:
                    at.append(k)
                    out.append((score / len(c), len(c), score, first, last))
            cols, index = list(zip(*out, strict=True)) if out else [()] * 5, pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k).take(index) for k in range(5)), *(pa.array(c, t) for c, t in zip(cols, (pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.int32()), strict=True))],
                names=["key", "h1", "h2", "item", "items", "score", "length", "matched", "first_word", "last_word"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), *row_hashes(docs), F.col(text).cast("string").alias("text"))
    found = stage_table(rows.mapInArrow(scan, f"rid bigint, key {kind.simpleString()}, h1 bigint, h2 bigint, codes array<bigint>, at array<int>, gram array<bigint>"), "met")
    hits = found.select("rid", F.inline(F.arrays_zip("at", "gram"))).withColumnRenamed("at", "place").join(seeds.select("gram", "uid", "at"), "gram")
    pairs = hits.groupBy("rid", "uid").agg(F.collect_set(F.col("place") - F.col("at")).alias("diagonals"))
    both = pairs.join(found.select("rid", "key", "h1", "h2", "codes"), "rid").join(units.select("uid", "item", "items", F.col("kind").alias("unit"), F.col("codes").alias("item_codes")), "uid")
    schema = f"key {kind.simpleString()}, h1 bigint, h2 bigint, item {benchmark.schema[item].dataType.simpleString()}, items bigint, score double, length int, matched double, first_word int, last_word int"
    return both.select("key", "h1", "h2", "item", "items", "unit", "item_codes", "codes", "diagonals").mapInArrow(aligned, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", edits: float = 0.2, min_score: float = 0.7, min_words: int = 1, min_run: int = 25, crowd: int = 16) -> DataFrame:
    """(key, item, items, score, length, matched, first_word, last_word) for each document and unit it holds a copy of.

    score is the share of the unit's words that the alignment is worth, matched that worth itself, length the unit's words. A unit is an item (items 1), or what
    more than crowd items have in common, under the smallest of them.
    """
    found = passages(docs, benchmark, key, text, item, item_text, edits, min_score, min_words, min_run, crowd)
    return found.drop("h1", "h2").withColumnsRenamed({"key": key, "item": item})


def keep_clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", edits: float = 0.2, min_score: float = 0.7, min_words: int = 1, min_run: int = 25, crowd: int = 16) -> DataFrame:
    """The rows that hold no copy of an item, all columns as they are. Rows equal in all columns share their fate."""
    h1, h2 = row_hashes(docs)
    gone = passages(docs, benchmark, key, text, item, item_text, edits, min_score, min_words, min_run, crowd)
    gone = stage_table(gone.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2")).distinct(), "gone")
    return docs.select("*", h1.alias("__h1"), h2.alias("__h2")).join(gone, ["__h1", "__h2"], "left_anti").select(*docs.columns)
