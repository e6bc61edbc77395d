"""Language-model scoring by deleted interpolation.

P(w | u) = a2 c(u w) / c(u) + a1 c(w) / N + a0 / (V + 1), with weights a for each bucket of the context's frequency c(u)
(powers of two). Weights are learned by expectation-maximisation on held-out counts: a part of the training rows is deleted from the counts,
and its tokens are predicted from the rest. Scores then use the counts of all training rows. Tokens are
words and one end a text; the first context of a text is its start.

How it runs: the documents are cut into token blocks (about ``block_tokens``), each written once as numbers into the block's own vocabulary.
A block asks for the corpus counts of its distinct words and word pairs: one row for each block and bucket of the 64-bit hashes, with the block's own counts, so a
word that is everywhere is one number a block. There are as many buckets as the tokens fill (``bucket_tokens`` each). Each bucket adds up what the blocks have and answers each block. Blocks and answers meet by
block, where all tokens are scored. Every count covers the whole corpus, and all that is shuffled grows with the input. Hashes of different pairs are taken to differ.

Defined cases: null and blank texts are an end only. Rows with a null key are scored, not learned from, and not held out. With no training
rows N = V = 0 and each token has probability 1. Words may hold any bytes but white space, NUL among them; keys may be of any type. Repeated rows count and are scored each. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stage_table, utf8, words

#: Codes of a block's vocabulary that every block has.
END, START = 0, 1
KEPT, DELETED, OTHER = 0, 1, 2
#: What stands for them among the words: no word holds a space.
_END, _START = b" end", b" start"


def pack(a: np.ndarray) -> bytes:
    """Bytes of the same place together, then compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")


def unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of 64-bit hashes (multiply and xor-shift)."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
        for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(s))) * np.uint64(m)
        return x ^ (x >> np.uint64(31))


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets are ranges of the hash's upper 32 bits, so that sorted hashes are sorted by bucket."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class Block:
    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {_END: END, _START: START}
        self.codes: list[int] = []
        self.lengths: list[int] = []
        self.parts: list[int] = []
        self.ids: list = []

    def add(self, key, text: bytes | None, part: int) -> None:
        put, v = self.vocabulary.setdefault, self.vocabulary
        w = words(text)
        self.codes += [put(x, len(v)) for x in w]
        self.codes.append(END)
        self.lengths.append(len(w) + 1)
        self.parts.append(part)
        self.ids.append(key)

    def row(self, block_id: int) -> list:
        codes, lengths, parts = np.array(self.codes, np.int32), np.array(self.lengths, np.int32), np.array(self.parts, np.int8)
        token_part = np.repeat(parts, lengths)
        deleted = token_part == DELETED
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.vocabulary], np.uint64)
        return [block_id, self.ids, pack(lengths), pack(parts), pack(hashes), pack(codes[deleted]), pack(codes[~deleted])]


BLOCK = ["block", "ids", "lengths", "parts", "hashes", "deleted", "codes"]


def token_blocks(docs: DataFrame, part: Column, key: str, text: str, block_tokens: int) -> DataFrame:
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, block = TaskContext.get().partitionId(), 0, Block()

        def out() -> pa.RecordBatch:
            r = block.row((task << 24) + n)
            kinds = [pa.int64(), pa.list_(to_arrow_type(kind)), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(r, kinds, strict=True)], names=BLOCK)

        for b in batches:
            for k, t, p in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist(), strict=True):
                block.add(k, t, p)
                if len(block.codes) >= block_tokens:
                    yield out()
                    block, n = Block(), n + 1
        if block.ids:
            yield out()

    schema = f"block bigint, ids array<{kind.simpleString()}>" + "".join(f", {c} binary" for c in BLOCK[2:])
    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), part.cast("int").alias("p")).mapInArrow(run, schema)


def n_buckets(blocks: DataFrame, tokens_each: int) -> int:
    """As many hash buckets as the tokens fill, so that one bucket's counts fit a task however large the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(int(unpack(x, "i4").sum()) for b in batches for x in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    total = blocks.select("lengths").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return max(1, -(-total // tokens_each))


def contexts(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The code before each token; the start at the first of each text."""
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int)] = START
    return before


def pairs(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return contexts(codes, lengths).astype(np.int64) << 32 | codes


def in_order(lengths: np.ndarray, parts: np.ndarray, deleted: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """All codes of a block as they stood."""
    all_codes = np.empty(lengths.sum(), np.int32)
    at = np.repeat(parts == DELETED, lengths)
    all_codes[at], all_codes[~at] = deleted, codes
    return all_codes


def asked(hashes: np.ndarray, codes: np.ndarray, lengths: np.ndarray, parts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Words and pairs of a block, each with its hashes ascending: (hashes, kept counts, deleted counts)."""
    token_part = np.repeat(parts, lengths)
    out = []
    for key, hash_of in ((codes.astype(np.int64), lambda u: hashes[u]), (pairs(codes, lengths), lambda u: mix(hashes[u >> 32], hashes[u & 0xFFFFFFFF]))):
        u, inverse = np.unique(key, return_inverse=True)
        kept, deleted = (np.bincount(inverse[token_part == p], minlength=len(u)) for p in (KEPT, DELETED))
        h = hash_of(u)
        by = np.argsort(h, kind="stable")
        out.append((h[by], kept[by], deleted[by]))
    return out


REQUEST = "bucket int, kind int, block bigint, hashes binary, kept binary, deleted binary"


def requests(blocks: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, lengths, parts, hashes, deleted, codes in zip(*(b.column(c).to_pylist() for c in ("block", "lengths", "parts", "hashes", "deleted", "codes")), strict=True):
                lengths, parts, hashes = unpack(lengths, "i4"), unpack(parts, "i1"), unpack(hashes, "u8")
                every = in_order(lengths, parts, unpack(deleted, "i4"), unpack(codes, "i4"))
                for kind, (h, kept, gone) in enumerate(asked(hashes, every, lengths, parts)):
                    cut = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
                    rows = []
                    for k, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)):
                        if lo < hi:
                            rows.append((k, kind, block, pack(np.diff(h[lo:hi], prepend=np.uint64(0))), pack(kept[lo:hi].astype(np.int32)), pack(gone[lo:hi].astype(np.int32))))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=[c.split()[0] for c in REQUEST.split(", ")])

    return blocks.select("block", "lengths", "parts", "hashes", "deleted", "codes").mapInArrow(run, REQUEST)


ANSWER = "block bigint, kind int, bucket int, kept binary, deleted binary, types bigint, tokens bigint, types_kept bigint, tokens_kept bigint"


def answer(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket and kind: the corpus counts for each block, and in one more row the totals."""
    parts = [(np.cumsum(unpack(h, "u8"), dtype=np.uint64), unpack(k, "i4"), unpack(d, "i4")) for h, k, d in zip(rows.hashes, rows.kept, rows.deleted, strict=True)]
    u, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    kept = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(u)).astype(np.int64)
    gone = np.bincount(inverse, np.concatenate([p[2] for p in parts]), len(u)).astype(np.int64)
    kind, bucket = int(rows.kind.iloc[0]), int(rows.bucket.iloc[0])
    ends = list(accumulate((len(p[0]) for p in parts), initial=0))
    out = [(b, kind, bucket, pack(kept[inverse[lo:hi]]), pack(gone[inverse[lo:hi]]), 0, 0, 0, 0) for b, lo, hi in zip(rows.block, ends, ends[1:], strict=False)]
    out.append((-1, kind, bucket, b"", b"", int((kept + gone > 0).sum()), int((kept + gone).sum()), int((kept > 0).sum()), int(kept.sum())))
    return pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])


def answered(rows: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """(kept, deleted) counts of words and of pairs, in the order of ascending hashes."""
    out = []
    for kind in (0, 1):
        got = rows[rows.kind == kind].sort_values("bucket")
        out.append(tuple(np.concatenate([unpack(x, "i8") for x in got[c]]) if len(got) else np.zeros(0, np.int64) for c in ("kept", "deleted")))
    return out


def context_bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0).astype(np.int64)


def token_counts(hashes: np.ndarray, codes: np.ndarray, lengths: np.ndarray, by_hash: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """c(u w), c(u), c(w) of each token, from counts in the order in which ``asked`` gives words and pairs."""
    words_u = np.unique(codes)
    word = np.zeros(len(hashes), np.int64)
    word[words_u[np.argsort(hashes[words_u], kind="stable")]] = by_hash[0]
    u, inverse = np.unique(pairs(codes, lengths), return_inverse=True)
    pair = np.zeros(len(u), np.int64)
    pair[np.argsort(mix(hashes[u >> 32], hashes[u & 0xFFFFFFFF]), kind="stable")] = by_hash[1]
    before = contexts(codes, lengths)
    return pair[inverse], word[np.where(before == START, END, before)], word[codes]


def learn(held: DataFrame, n: int, v: int, rounds: int) -> dict[int, list[float]]:
    """Weights by context bucket, from rows (context, pair, ctx, word, times). Each round is one sum over all rows."""
    p2 = F.when(F.col("ctx") > 0, F.col("pair") / F.col("ctx")).otherwise(0.0)
    rows = held.select("context", "times", p2.alias("p2"), (F.col("word") / F.lit(float(max(n, 1)))).alias("p1"), F.lit(1.0 / (v + 1)).alias("p0"))
    used = [r[0] for r in rows.select("context").distinct().collect()]
    weights = {c: [0.4, 0.4, 0.2] for c in used}
    for _ in range(rounds if used else 0):
        a = F.create_map(*[F.lit(x) if isinstance(x, int) else F.array(*map(F.lit, x)) for c in weights.items() for x in c])[F.col("context")]
        parts = [a[0] * F.col("p2"), a[1] * F.col("p1"), a[2] * F.col("p0")]
        total = parts[0] + parts[1] + parts[2]
        got = rows.groupBy("context").agg(*[F.sum(F.col("times") * p / total).alias(f"r{k}") for k, p in enumerate(parts)]).collect()
        # a context without deleted tokens of a kind keeps a trace of each weight
        weights = {r["context"]: [(r[f"r{k}"] + 1e-3) / (r["r0"] + r["r1"] + r["r2"] + 3e-3) for k in range(3)] for r in got}
    return weights


def score_texts(docs: DataFrame, train: Column, deleted: Column, key: str = "doc_id", text: str = "text", rounds: int = 12, block_tokens: int = 1_000_000, bucket_tokens: int = 1_000_000) -> DataFrame:
    """One row for each row: key, n_tokens, n_known, train_tokens, base_score, score (log10).

    train: rows to learn from; deleted: those of them whose tokens only teach the weights.
    """
    train, deleted = F.coalesce(train, F.lit(False)), F.coalesce(deleted, F.lit(False))
    part = F.when(~train, OTHER).when(deleted, DELETED).otherwise(KEPT)
    kind = docs.schema[key].dataType.simpleString()
    blocks = stage_table(token_blocks(docs, part, key, text, block_tokens), "blocks")
    buckets = n_buckets(blocks, bucket_tokens)
    answers = stage_table(requests(blocks, buckets).groupBy("bucket", "kind").applyInPandas(answer, ANSWER), "answers")
    sums = answers.where("block < 0 and kind = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("types", "tokens", "types_kept", "tokens_kept")]).first()
    v, n, v_kept, n_kept = sums
    given = answers.where("block >= 0").select("block", "kind", "bucket", "kept", "deleted")

    def held_out(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["context", "pair", "ctx", "word", "times"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in cols})
        b = left.iloc[0]
        lengths, parts, hashes = unpack(b.lengths, "i4"), unpack(b.parts, "i1"), unpack(b.hashes, "u8")
        codes = in_order(lengths, parts, unpack(b.deleted, "i4"), unpack(b.codes, "i4"))
        at = np.repeat(parts, lengths) == DELETED
        c2, cu, cw = (c[at] for c in token_counts(hashes, codes, lengths, [k for k, _ in answered(right)]))
        got, times = np.unique(np.stack([context_bucket(cu), c2, cu, cw]), axis=1, return_counts=True)
        return pd.DataFrame(dict(zip(cols, [*got, times], strict=True)))

    held = blocks.groupBy("block").cogroup(given.groupBy("block")).applyInPandas(held_out, "context bigint, pair bigint, ctx bigint, word bigint, times bigint")
    held = stage_table(held.groupBy("context", "pair", "ctx", "word").agg(F.sum("times").alias("times")), "held")
    weights = learn(held, n_kept, v_kept, rounds)
    table = np.array([weights.get(c) or weights.get(max((k for k in weights if k < c), default=-1)) or [0.4, 0.4, 0.2] for c in range(64)]) if weights else np.tile([0.4, 0.4, 0.2], (64, 1))
    unknown, whole = 1.0 / (v + 1), kind in ("tinyint", "smallint", "int", "bigint")

    def score(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        b = left.iloc[0]
        lengths, parts, hashes = unpack(b.lengths, "i4"), unpack(b.parts, "i1"), unpack(b.hashes, "u8")
        codes = in_order(lengths, parts, unpack(b.deleted, "i4"), unpack(b.codes, "i4"))
        c2, cu, cw = token_counts(hashes, codes, lengths, [k + d for k, d in answered(right)])
        a = table[context_bucket(cu)]
        # an unseen context leaves its share to the words
        p = np.where(cu > 0, a[:, 0] * c2 / np.maximum(cu, 1), 0) + np.where(cu > 0, a[:, 1], a[:, 0] + a[:, 1]) * cw / max(n, 1) + a[:, 2] * unknown
        if not n:
            p = np.ones(len(codes))
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int)
        base = np.log10((cw + 1) / (n + 1.0 * (v + 1)))
        return pd.DataFrame({
            "key": pd.array(b.ids, dtype="Int64") if whole else pd.Series(list(b.ids), dtype=object), "n_tokens": lengths.astype(np.int64), "n_known": np.add.reduceat((cw > 0).astype(np.int64), at), "train_tokens": np.full(len(lengths), n),
            "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(np.log10(p), at),
        })

    out = blocks.groupBy("block").cogroup(given.groupBy("block")).applyInPandas(score, f"key {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("key", key)
