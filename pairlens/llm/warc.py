"""WARC archives: write, read back, and merge the capture index of many files into one order.

Writing: payloads are grouped by their SHA-1; the record of the largest id is a response, the others revisit it. Records are plain text with a
blank line after each, so Spark's text writer makes the files (gzip, bounded by payload bytes and by records).
Reading: each file is parsed by its Content-Length headers, and gives a capture run sorted by URL key and time.
Merging: runs are cut at common borders by a range partitioning of (URL key, time, id); each task merges its pieces of the
runs with a loser tree, so that the partitions one after the other hold the captures in global order.

Defined cases: ids are any 64-bit numbers; null html is an empty payload; null url gives an empty URL key and no target header. Rows that repeat the largest id
of a payload are all responses; a payload that only rows with a null id have is a response each time. Payloads below
``min_payload`` bytes are all responses. A broken record or a payload that does not fit its digest raises ValueError. An
empty table gives no records. Extra columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage_path, stage_table

HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: 2100-01-01 in seconds from 1970.
LAST_SECOND = 4_102_444_800
CAPTURE = "run string, url_key string, captured_at timestamp, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"


def sha1_base32(payload: Column) -> Column:
    """Each 5 hexadecimal digits are 4 digits to base 32."""
    digest = F.sha1(payload.cast("binary"))
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]), HEX32, BASE32)


def url_key(url: str) -> str:
    """The host's labels from the last to the first, then the path and query: com,example)/a?b=1."""
    rest = url.split("://", 1)[-1]
    host, _, path = rest.partition("/")
    host = host.rsplit("@", 1)[-1].lower()
    port = host.partition(":")
    host = ",".join(reversed(port[0].removeprefix("www.").split(".")))
    return f"{host}{':' + port[2] if port[2] not in ('', '80', '443') else ''})/{path}" if url else ""


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", min_payload: int = 0, records_per_file: int = 4000, file_bytes: int = 16 << 20) -> None:
    """A record for each row, below path, in files of about file_bytes of payload and records_per_file records at most.

    Pages have no time: captures are dated by their id, in seconds from 1970, round and round in the years up to 2099.
    Which record of a payload is the response is settled on digests and ids alone; payloads move once, by digest and id, so that a payload that is everywhere is in many tasks.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), payload.alias("p")).withColumns({"d": sha1_base32(F.col("p")), "name": F.coalesce(F.col("k").cast("string"), F.lit("none"))})
    found = stage_table(rows.groupBy("d", "k", "name").agg(F.max(F.octet_length("p")).alias("n"), F.count("*").alias("times")), "payloads")
    first = found.where(F.col("n") >= min_payload).groupBy("d").agg(F.max("k").alias("first"))
    total = found.agg(F.coalesce(F.sum(F.col("n") * F.col("times")), F.lit(0))).first()[0]
    files = max(1, -(-total // file_bytes))
    marks = found.join(first, "d", "left").select("d", "name", "first").repartition(files, "d", "name")
    n, line = F.octet_length("p").cast("string"), "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), n, F.lit(line * 2))
    again = F.coalesce(F.col("k") != F.col("first"), F.col("first").isNotNull())
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), c, F.lit(">"))
    target = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("u", r"[\x00-\x20]", "%20"), F.lit(line)), F.lit(""))
    kind = F.when(again, F.concat(F.lit(f"WARC-Type: revisit{line}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{line}WARC-Refers-To: "), urn(F.col("first").cast("string")), F.lit(line))).otherwise(F.lit(f"WARC-Type: response{line}"))
    body = F.when(again, http).otherwise(F.concat(http, F.col("p")))
    when = F.date_format(F.timestamp_seconds(F.pmod(F.coalesce("k", F.lit(0)), F.lit(LAST_SECOND))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(F.lit(f"WARC/1.1{line}"), kind, F.lit("WARC-Record-ID: "), urn(F.col("name")), F.lit(line), target, F.lit("WARC-Date: "), when, F.lit(f"{line}Content-Type: application/http; msgtype=response{line}WARC-Payload-Digest: sha1:"), F.col("d"), F.lit(f"{line}Content-Length: "), F.octet_length("body").cast("string"), F.lit(line * 2), F.col("body"))
    joined = rows.repartition(files, "d", "name").join(marks.hint("shuffle_hash"), ["d", "name"], "left").withColumn("body", body)
    # the line separator of the text writer is the blank line that ends a record
    joined.select(head.alias("value")).write.option("lineSep", line * 2).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def records(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers (lower-case names) and block of each record of a file."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode().split("\r\n")[1:]
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, size = end + 4, int(head["content-length"])
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end after {size} bytes")
        yield head, view[start : start + size]
        at = start + size + 4


def _id(name: str | None) -> int | None:
    text = name[len("<urn:x-page:") : -1] if name else "none"
    return None if text == "none" else int(text)


def captures(data: bytes, run: str) -> list[tuple]:
    """A file's capture run, sorted by URL key, time and id."""
    import datetime as dt

    out = []
    for head, block in records(data):
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        cut = bytes(block[:4096]).find(b"\r\n\r\n") + 4
        stated = int(bytes(block[:cut]).lower().split(b"content-length:")[1].split(b"\r\n")[0])
        if head["warc-type"] == "response":
            payload = block[cut:]
            if len(payload) != stated or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"{run}: the payload of {head['warc-record-id']} does not fit its digest")
        url = head.get("warc-target-uri", "")
        when = dt.datetime.strptime(head["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=dt.UTC)
        out.append((run, url_key(url), when, _id(head["warc-record-id"]), url or None, head["warc-type"], _id(head.get("warc-refers-to")), stated, digest))
    return sorted(out, key=order)


def order(row: tuple) -> tuple:
    """URL key, time, id; a null id first."""
    return row[1], row[2], row[3] is not None, row[3] or 0


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _schema() -> pa.Schema:
    s, i = pa.string(), pa.int64()
    return pa.schema([("run", s), ("url_key", s), ("captured_at", pa.timestamp("us", tz="UTC")), ("page_id", i), ("url", s), ("record_type", s), ("refers_to", i), ("payload_bytes", i), ("payload_digest", s)])


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The sorted capture runs of all files below path."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = content.as_buffer()
                plain = zlib.decompressobj(31).decompress(data) if name.endswith(".gz") else bytes(data)
                yield _batch(captures(plain, name.rsplit("/", 1)[-1]), _schema())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(parse, CAPTURE)


class LoserTree:
    """k-way merge of sorted iterators: each inner node keeps the run that lost there; a step plays one path from leaf to root. Gives (run, key)."""

    def __init__(self, runs: list[Iterator]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf, starting=True)

    def _less(self, a: int, b: int) -> bool:
        """Run a's head goes before run b's; a finished run goes last, ties go by run."""
        x, y = self.heads[a], self.heads[b]
        return y is None and (x is not None or a < b) or x is not None and y is not None and (x, a) < (y, b)

    def _play(self, run: int, starting: bool = False) -> None:
        node, winner = (run + self.k) // 2, run
        while node > 0:
            if self.tree[node] < 0:
                if starting:
                    self.tree[node] = winner
                    return
            elif self._less(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.heads[run := self.tree[0]] is not None:
            yield run, self.heads[run]
            self.heads[run] = next(self.runs[run], None)
            self._play(run)


def keys_of(t: pa.Table, lo: int, hi: int, window: int = 1024) -> Iterator[tuple]:
    """What rows lo to hi are ordered by; a window is decoded at a time."""
    for at in range(lo, hi, window):
        part = t.slice(at, min(window, hi - at))
        ids = part["page_id"].to_pylist()
        yield from zip(part["url_key"].to_pylist(), part["captured_at"].cast(pa.int64()).to_pylist(), (i is not None for i in ids), (i or 0 for i in ids), strict=True)


def merge(index: DataFrame, rows_per_task: int = 100_000) -> DataFrame:
    """Captures in global order over the partitions, from runs that are sorted each in itself.

    Range borders cut all runs alike, at a page's id if need be; there are as many ranges as the captures fill, so that a task holds
    about rows_per_task of them, as columns, and decodes a window of each run's piece.
    """
    schema = _schema()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), schema)
        if not t.num_rows:
            return
        t = t.combine_chunks()
        run = t["run"].combine_chunks().dictionary_encode().indices.to_numpy()
        edge = np.concatenate([[0], np.nonzero(np.diff(run))[0] + 1, [len(run)]])
        place, out = edge[:-1].copy(), []
        for piece, _ in LoserTree([keys_of(t, lo, hi) for lo, hi in zip(edge, edge[1:], strict=False)]):
            out.append(place[piece])
            place[piece] += 1
            if len(out) == 10_000:
                yield from t.take(pa.array(out)).to_batches()
                out = []
        yield from t.take(pa.array(out, pa.int64())).to_batches()

    keys = ["url_key", "captured_at", "page_id"]
    n = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // rows_per_task))
    return index.repartitionByRange(n, *keys).sortWithinPartitions("run", *keys).mapInArrow(merged, CAPTURE)


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_payload: int = 0) -> DataFrame:
    """Write the pages, read the archives back, and return the merged capture index."""
    spark = pages.sparkSession
    path = stage_path(spark, "warc")
    write(pages, path, key, url, html, min_payload)
    return merge(stage_table(runs(spark, path), "runs"))
