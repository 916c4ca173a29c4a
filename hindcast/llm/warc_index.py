"""WARC archives of pages, and a globally ordered index of their captures.

Records are built next to the pages, gathered in volumes of about ``VOLUME_BYTES``, and written by Spark's text
writer, one volume a file: the line separator is the blank pair of lines that ends a record, so a file is a plain WARC file
and the write survives lost executors. A page whose payload another page with a smaller id has already is a revisit
record without payload. Reading parses the files by their Content-Length headers.

The index: every volume is a run, sorted where it was read by URL key, time and page. Runs are cut into ranges of
the key, and each range merges its parts of the runs with a loser tree. The ranges follow one another, so the whole is in
order; a number per URL key counts its captures, also where a key spans ranges.

Defined results: a null html is an empty payload; a null url has the empty key; payloads under ``LEAST_BYTES`` are never
revisits; repeated rows are captures each, the first response and its repeats alike; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.scale import scratch_path, written

LEAST_BYTES = 100
VOLUME_BYTES = 16 << 20
# The record format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = 1_577_836_800  # 2020-01-01: captures are dated one second apart by page id


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, then ``)`` and the rest in lower case, without scheme and fragment."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[^:/?#]*://|#.*$", "")
    host = F.regexp_extract(rest, r"^[^/?]*", 0)
    return F.when(rest == "", "").otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.substring(rest, F.length(host) + 1, F.length(rest)))
    )


def capture_time(page: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(page, F.lit(0)), F.lit(1 << 31))), "yyyyMMddHHmmss")


def planned(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Rows (page_id, url, html, digest, refers_to). Only digests and ids are shuffled to find the first of equal payloads."""
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    ).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    large = rows.where(F.octet_length("html") >= least)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("_last")).where("first < _last")
    first = written(first.select("digest", "first"), "repeated")  # Spark broadcasts it if it is small, else splits hot digests
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to")
    )


def _header(fields: list[tuple[str, str]]) -> bytes:
    return "\r\n".join([VERSION, *(f"{n}: {v}" for n, v in fields)]).encode() + END.encode()


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _record(page, url, html, digest, refers_to, date) -> bytes:
    payload = html.encode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        payload = b""
    return _header([*fields, ("Content-Type", "text/html"), ("Content-Length", str(len(payload)))]) + payload


def _volumes(limit: int):
    def build(batches) -> Iterator[pa.RecordBatch]:
        records, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                record = _record(*row)
                if records and size + len(record) > limit:
                    yield pa.RecordBatch.from_pydict({"value": pa.array([END.encode().join(records)], pa.binary())})
                    records, size = [], 0
                records.append(record)
                size += len(record) + len(END)
        if records:
            yield pa.RecordBatch.from_pydict({"value": pa.array([END.encode().join(records)], pa.binary())})

    return build


def write_archives(plan: DataFrame, path: str, volume_bytes: int = VOLUME_BYTES) -> None:
    """Write the planned records as WARC files under ``path``."""
    date = F.concat(capture_time(F.col("page_id")), F.lit("Z"))
    rows = plan.select("page_id", "url", "html", "digest", "refers_to", date)
    volumes = rows.mapInArrow(_volumes(volume_bytes), "value binary").select(F.col("value").cast("string").alias("value"))
    volumes.write.option("lineSep", END).option("maxRecordsPerFile", 1).text(path)


def parsed(volume: bytes) -> Iterator[dict]:
    """The records of a WARC file with their place, payload and headers."""
    at, end = 0, END.encode()
    while at < len(volume):
        head = volume.index(end, at)
        lines = volume[at:head].decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no WARC record at {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        body = head + len(end)
        stop = body + int(fields["Content-Length"])
        yield fields | {"offset": at, "payload": volume[body:stop]}
        at = stop + len(end)


_CAPTURES = "url_key string, capture_time string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, offset long"
_RAW = _CAPTURES.replace("url_key string", "url string")


def read_archives(spark, path: str) -> DataFrame:
    """One row per record. The digest and length of a response are taken from the payload that was read."""
    def page_of(urn: str) -> int | None:
        number = urn[len("<urn:page:") : -1]
        return None if number == "None" else int(number)

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for r in parsed(content.as_buffer().to_pybytes()):
                    fresh = r["WARC-Type"] == "response"
                    digest = hashlib.sha256(r["payload"]).hexdigest() if fresh else r["WARC-Payload-Digest"].split(":")[1]
                    length = len(r["payload"]) if fresh else int(r["X-Payload-Length"])
                    refers = None if fresh else page_of(r["WARC-Refers-To"])
                    rows.append((r["WARC-Target-URI"], r["WARC-Date"].rstrip("Z"), page_of(r["WARC-Record-ID"]), length, digest, r["WARC-Type"], refers, name.rsplit("/", 1)[-1], r["offset"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", "content").mapInArrow(read, _RAW)
    return rows.withColumn("url_key", url_key(F.col("url"))).select(*[c.split()[0] for c in _CAPTURES.split(", ")])


_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
_NAMES = [c.split()[0] for c in _RAW.split(", ")]


class LoserTree:
    """k-way merge of sorted iterators of (key, row): a replay from one leaf to the root costs log2(k) comparisons."""

    _DONE = object()

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads = [next(r, self._DONE) for r in self.runs] or [self._DONE]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._replay(leaf, building=True)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is self._DONE:
            return False
        return self.heads[b] is self._DONE or (self.heads[a][0], a) < (self.heads[b][0], b)

    def _replay(self, leaf: int, building: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.heads[winner := self.losers[0]] is not self._DONE:
            yield winner, self.heads[winner]
            self.heads[winner] = next(self.runs[winner], self._DONE)
            self._replay(winner)


def _merge(batches):
    """Merge the parts of all runs in a range; a part that did not arrive in order is put in order first."""
    runs: dict[str, list] = {}
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            key, time, page, *rest = row
            # null pages first; offset makes equal captures of a run distinct
            runs.setdefault(rest[4], []).append(((key, time, page is not None, page or 0, rest[5]), row))
    for part in runs.values():
        if any(a[0] > b[0] for a, b in zip(part, part[1:])):
            part.sort(key=lambda r: r[0])
    out, number, current, of_key = [], 0, None, 0
    for _run, (_key, row) in LoserTree([part for _, part in sorted(runs.items())]):
        of_key = of_key + 1 if row[0] == current else 1
        current = row[0]
        out.append((*row, number, of_key))
        number += 1
        if len(out) == 10_000:
            yield _rows(out)
            out = []
    if out:
        yield _rows(out)


_MERGED = _CAPTURES + ", position long, of_key long"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [*_TYPES, pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in _MERGED.split(", ")])


def capture_index(captures: DataFrame) -> DataFrame:
    """Captures in global order (range_no, position), numbered within their URL key from 1."""
    runs = captures.sortWithinPartitions("run", "url_key", "capture_time", "page_id", "offset")
    ranged = runs.repartitionByRange("url_key", "capture_time", "page_id", "run", "offset")
    merged = written(ranged.mapInArrow(_merge, _MERGED).withColumn("range_no", F.spark_partition_id()), "index")

    # A key may span ranges: its captures in earlier ranges are counted for the first key of each range only.
    firsts = merged.where("position = 0").select("url_key").distinct()  # a row for each range at most
    counts = merged.join(F.broadcast(firsts), "url_key").groupBy("url_key", "range_no").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("url_key").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("url_key", "range_no", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_earlier"))
    return (
        merged.join(F.broadcast(earlier), ["url_key", "range_no"], "left")
        .withColumn("capture_no", F.col("of_key") + F.coalesce("_earlier", F.lit(0)))
        .drop("of_key", "_earlier")
    )


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the pages to archives, read the archives back, and return the merged index."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(planned(pages, key, url, html), path)
    return capture_index(read_archives(pages.sparkSession, path))
