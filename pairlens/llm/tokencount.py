"""Token counts under a unigram vocabulary, with forward scores shared along a trie.

A pre-token is a word (run of no ASCII white space) after the word-start sign. The best segmentation of a pre-token has
the largest sum of piece scores, then the fewest tokens. The new distinct pre-tokens of a batch are walked in sorted order, which is the depth-first order of
their trie: the forward scores (best sum and count at each place) of the prefix that two neighbours share are computed
once. The count at a pre-token's end is stored; a cache of at most ``cache_words`` counts serves later batches of the task.

The public vocabulary is a BPE one and gives merge ranks, not probabilities, and tokenizers are not trained here: a piece of rank r (from 0) scores -ln(r + 2),
as Zipf's law has it; a vocabulary with scores of its own may be given. A character without a piece becomes one byte token for each UTF-8 byte, each with the score of the last rank + 1.

Defined cases: null and blank texts have 0 tokens. Rows are counted each, repeated or not; null keys are kept. A word of any length takes
time linear in its length. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

START = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def load_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """piece: score, of the normal pieces of a sentencepiece model, in the order of their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {p: -math.log(r + 2) for r, p in enumerate(plain)}


class TrieCounter:
    def __init__(self, pieces: dict[str, float], cache_words: int = 300_000):
        self.pieces, self.cache_words, self.counts = pieces, cache_words, {}
        self.longest = max(map(len, pieces), default=1)
        self.other = -math.log(len(pieces) + 2)

    def add(self, words: set[str]) -> None:
        """Count the tokens of new words, in trie order."""
        pieces, longest, other, counts = self.pieces, self.longest, self.other, self.counts
        before, best, used = "", [0.0], [0]
        for word in sorted(words):
            text = START + word
            shared = len(os.path.commonprefix((before, text)))
            del best[shared + 1 :], used[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                n = len(text[end - 1].encode())
                score, count = best[end - 1] + other * n, used[end - 1] + n
                for start in range(max(0, end - longest), end):
                    s = pieces.get(text[start:end])
                    if s is not None and ((s := s + best[start]) > score or s == score and used[start] + 1 < count):
                        score, count = s, used[start] + 1
                best.append(score)
                used.append(count)
            counts[word] = used[len(text)]
            before = text

    def batch(self, texts: list[bytes | None]) -> tuple[list[int], list[int]]:
        """Pre-tokens and tokens of each text."""
        split = [[w.decode("utf-8", "replace") for w in t.split()] if t else [] for t in texts]
        new = {w for ws in split for w in ws if w not in self.counts}
        if len(self.counts) + len(new) > self.cache_words:
            self.counts = {}
            new = {w for ws in split for w in ws}
        self.add(new)
        get = self.counts.__getitem__
        return [len(ws) for ws in split], [sum(map(get, ws)) for ws in split]


_counters: dict[str, TrieCounter] = {}


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | dict[str, float] = VOCABULARY, step: int = 500) -> DataFrame:
    """One row for each row: key, n_pretokens, n_tokens, n_bytes.

    vocabulary: pieces with scores, or the path of a model on the driver; the pieces go to the tasks with the job. Tasks of a worker share counts.
    """
    kind = docs.schema[key].dataType.simpleString()
    pieces = load_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary
    name = hashlib.sha1(repr(sorted(pieces.items())).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(pieces)  # a vocabulary, whatever the number of documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(name) or _counters.setdefault(name, TrieCounter(sent.value))
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                texts = utf8(part.column(1))
                words, tokens = counter.batch(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array([len(t or b"") for t in texts], pa.int64())], names=["key", "n_pretokens", "n_tokens", "n_bytes"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, n_pretokens bigint, n_tokens bigint, n_bytes bigint").withColumnRenamed("key", key)
