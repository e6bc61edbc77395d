"""Language identification by compression.

For each language a zstandard raw-content dictionary is made from excerpts of a bounded sample of training texts, taken all
over each text. A text is cut
into pieces of ``piece_bytes`` that are compressed with each dictionary; the language whose pieces take the fewest
bytes in sum wins. ``score`` is the share of bytes that the best saves against the second best (0 to 1); a text with
a score below ``min_margin`` is rejected. Pieces keep a long text from becoming its own dictionary.

Defined cases: null text or text without a letter gives ``und``, score 0, rejected. Ties go to the first language by
code point (score 0, rejected). With no training rows every text is ``und``; with one language the score is 1.
A null key is predicted, but never learned from. Empty tables give empty results; columns other than key and text
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, utf8

UNKNOWN = "und"


@dataclass
class LanguageModel:
    """A dictionary of at most dict_bytes for each language."""

    dictionaries: dict[str, bytes]
    piece_bytes: int = 2048
    level: int = 5
    min_margin: float = 0.004

    def compressors(self) -> dict[str, zstandard.ZstdCompressor]:
        made = {}
        for lang, content in sorted(self.dictionaries.items()):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            made[lang] = zstandard.ZstdCompressor(level=self.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        return made


def fit(train: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = 600, excerpt_bytes: int = 512, n_pieces: int = 2, dict_bytes: int = 96 * 1024, max_langs: int = 1000, **model) -> LanguageModel:
    """Dictionaries from docs_per_lang keys a language, the first by (hash, key); all of them where there are fewer.

    A language's rows have equal parts of its dict_bytes, excerpt_bytes at most, so that all of them fit. A text longer than its part gives
    this many pieces, one from a hash-chosen place in each equal section of the text. Repeated rows of a key give
    one excerpt. The driver gets at most dict_bytes characters for each language, however large the table. More than max_langs languages are an error.
    """
    rows = train.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).alias("l")).where("k is not null and t is not null and l is not null")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.countDistinct("k").alias("n")).limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"{lang} has more than {max_langs} values: it does not name languages")
    if not counts:
        return LanguageModel({}, **model)
    part = {lang: max(16, min(excerpt_bytes, dict_bytes // min(n, docs_per_lang) - 1)) for lang, n in counts.items()}  # a line feed follows
    of = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("l")]
    share = of({lang: min(1.0, 1.3 * docs_per_lang / n + 50 / n) for lang, n in counts.items()})
    unit = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit("langid")), F.lit(1_000_000)) / 1_000_000
    some = rows.withColumn("u", unit).where(F.col("u") < share).withColumns({"n": F.length("t"), "part": of(part)})
    long = (F.floor((F.col("part") + 1) / n_pieces) - 1).cast("int")
    section = F.floor(F.col("n") / n_pieces).cast("int")
    place = lambda i: (i * section + F.pmod(F.xxhash64("k", i, F.lit("place")), F.greatest(section - long + 1, F.lit(1))) + 1).cast("int")
    cut = F.when(F.col("n") <= F.col("part"), F.array("t")).otherwise(F.array(*[F.substring(F.col("t"), place(F.lit(i)), long) for i in range(n_pieces)]))
    one = some.select("l", "u", "k", cut.alias("cut")).groupBy("l", "u", "k").agg(F.min("cut").alias("cut"))
    first = one.withColumn("nth", F.row_number().over(Window.partitionBy("l").orderBy("u", "k"))).where(F.col("nth") <= docs_per_lang)
    by: dict[str, list[tuple[int, bytes]]] = {lang: [] for lang in counts}
    for r in first.select("l", "nth", "cut").toLocalIterator():
        most = (part[r["l"]] + 1) // len(r["cut"]) - 1
        cuts = [p.lower().encode()[:most].decode(errors="ignore").encode() for p in r["cut"]]
        by[r["l"]].append((r["nth"], b"\n".join(cuts)))
    return LanguageModel({lang: b"\n".join(t for _, t in sorted(got)) for lang, got in by.items()}, **model)


def classify(text: bytes | None, compressors: dict[str, zstandard.ZstdCompressor], piece_bytes: int) -> tuple[str, float]:
    if not text or not compressors:
        return UNKNOWN, 0.0
    plain = text.decode("utf-8", "replace")
    if plain.isspace() or not any(c.isalpha() for c in plain):
        return UNKNOWN, 0.0
    low = plain.lower().encode()
    pieces = [low[i : i + piece_bytes] for i in range(0, len(low), piece_bytes)]
    sizes = sorted((sum(len(c.compress(p)) for p in pieces), lang) for lang, c in compressors.items())
    return sizes[0][1], 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0


def predict(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: key, lang_pred, score, accepted."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = model.compressors()
        for b in pieces(batches):
            got = [classify(t, made, model.piece_bytes) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[0] != UNKNOWN and x[1] >= model.min_margin for x in got], pa.bool_())],
                names=["key", "lang_pred", "score", "accepted"],
            )

    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double, accepted boolean")
    return out.withColumnRenamed("key", key)


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows whose language is told with enough margin, all columns as they are."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = model.compressors()
        for b in pieces(batches):
            got = (classify(t, made, model.piece_bytes) for t in utf8(b.column(at)))
            yield b.filter(pa.array([lang != UNKNOWN and score >= model.min_margin for lang, score in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
