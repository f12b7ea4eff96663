"""WARC archives with revisit records, and their merged index.

Records are written and sorted by URL key and time within each archive, so that every archive is a sorted run. Reading parses
the archives by their lengths. The index entries of all runs are dealt by ranges of (URL key, time), and each range is an external merge of its
pieces of the runs: loser trees over a bounded number of runs, of each of which a few entries are held, in as many passes as it
takes. Ranges in order are the global order, so each URL's captures stand together.

Of records with equal payloads of at least MIN_BYTES bytes, that with the smallest page_id (nulls last) is the response, and the others
revisit it; rows that share that page_id are all responses. A null payload is empty; a null url leaves the header out and has key "".
Line breaks in URLs are percent-encoded. An empty table makes an archive without records.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colwright.columns import col, require
from colwright.llm.text import place, whole
from colwright.sources.shared import kept, shared_path

MIN_BYTES = 100
# Entries of a merge task's range, runs that are merged at once, and entries of each that are held.
RANGE_ROWS, FAN_IN, BUFFER_ROWS = 500_000, 64, 256
ARCHIVE_BYTES = 64 << 20
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = (
    "url_key string, captured string, page_id bigint, record_type string, payload_digest string, payload_bytes bigint,"
    " refers_to bigint, archive string, offset bigint, length bigint"
)


def url_key(url: Column) -> Column:
    """Host labels in reverse, then path and query, all in lower case: captures of one site sort together."""
    lower = F.lower(url)
    host = F.regexp_extract(lower, r"^[a-z]+://(?:[^/@]*@)?([^/:?#]*)", 1)
    rest = F.regexp_extract(lower, r"^[a-z]+://[^/?#]*([^#]*)", 1)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit(""))


def _header(*lines: tuple[str, Column | str]) -> Column:
    parts = [F.lit(VERSION)]
    parts += [F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value)) for name, value in lines]
    return F.concat_ws("\r\n", *parts)


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archives(df: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", captured: Column | None = None) -> None:
    """Write one record per row below `path`. `captured` is a timestamp; default: the start of 1970."""
    require(df, page_id, url, payload)
    when = F.lit(0).cast("timestamp") if captured is None else captured
    rows = df.select(
        col(page_id).cast("bigint").alias("page_id"),
        F.regexp_replace(F.regexp_replace(col(url), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
        whole(payload).alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("bigint"))
    sums = rows.filter(F.col("n") >= MIN_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
    repeated = kept(sums.filter("copies > 1").select(F.col("digest").alias("d"), "first_id"), "payloads")
    size = rows.agg(F.avg("n").alias("mean")).first()["mean"] or 1.0
    joined = rows.join(repeated, F.col("digest") == F.col("d"), "left")
    revisits = F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n"), F.lit("\r\n\r\n"))
    target = F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.col("url")))
    block = F.when(revisits, http).otherwise(F.concat(http, F.col("payload")))
    header = F.concat_ws(
        "\r\n",
        _header(
            ("WARC-Type", F.when(revisits, "revisit").otherwise("response")),
            ("WARC-Record-ID", _urn(F.col("page_id"))),
            ("WARC-Date", F.col("captured")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ),
        target,
        F.when(revisits, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("first_id")))),
        F.when(revisits, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    )
    record = F.concat(header, F.lit("\r\n\r\n"), block).alias("record")
    per_file = max(1, int(ARCHIVE_BYTES / (size + 500)))
    run = joined.withColumn("key", url_key(F.col("url"))).sortWithinPartitions("key", "captured", F.col("page_id").asc_nulls_last())
    run.select(record).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers (names in lower case), block, offset and length of each record."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no record at {at}")
        headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
        start, n = stop + 4, int(headers["content-length"])
        end = start + n
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} has another length")
        yield headers, data[start:end], at, end + 4 - at
        at = end + 4


def _number(urn: str | None) -> int | None:
    digits = urn.removeprefix("<urn:page:").rstrip(">") if urn else ""
    return int(digits) if digits else None


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    names = ["url", "captured", "page_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "archive", "offset", "length"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    for batch in batches:
        for name, content in zip(batch.column("path"), batch.column("content")):
            # An archive may be one compressed member or several.
            data, left = b"", content.as_py()
            while left:
                member = zlib.decompressobj(31)
                data += member.decompress(left)
                left = member.unused_data
            rows = []
            for headers, block, at, n in parse(data):
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = headers["warc-payload-digest"].removeprefix("sha256:")
                size = int(http.decode().rsplit("Content-Length: ", 1)[1])
                if headers["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"payload at {at} of {name} has another digest or length")
                rows.append((
                    headers.get("warc-target-uri"), headers["warc-date"], _number(headers["warc-record-id"]), headers["warc-type"],
                    digest, size, _number(headers.get("warc-refers-to")), name.as_py(), at, n,
                ))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of the match below it, so a step replays one path."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * len(runs)
        for i in range(len(runs)):
            self._play(i)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        return a is not None and (b is None or (a, i) < (b, j))

    def _play(self, i: int) -> None:
        """Send run i up from its leaf; a free node takes it, the last winner stays at the top."""
        node = (i + len(self.runs)) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        while self.runs and self.heads[self.losers[0]] is not None:
            best = self.losers[0]
            yield self.heads[best]
            self.heads[best] = next(self.runs[best], None)
            self._play(best)


def _entry(row: tuple, run: int, number: int) -> tuple:
    """A row behind what it is merged by: URL key, time, page (nulls last), then the run and the place in it."""
    return row[0], row[1], row[2] is None, row[2] or 0, run, number, row


def _read_run(source: pa.ipc.RecordBatchFileReader, batches: range, run: int) -> Iterator[tuple]:
    """The entries of a run, of which one batch is held at a time."""
    number = 0
    for i in batches:
        for row in zip(*(c.to_pylist() for c in source.get_batch(i).columns)):
            yield _entry(row, run, number)
            number += 1


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


class _Spool:
    """Sorted runs in one file of the shared folder, in batches that can be read one by one."""

    def __init__(self, path: str, schema: pa.Schema, rows: int):
        self.files, self.path = place(path)
        self.schema, self.rows, self.count, self.runs = schema, rows, 0, []
        self.sink = self.files.open_output_stream(self.path, compression=None)
        self.writer = pa.ipc.new_file(self.sink, schema)

    def new_run(self) -> None:
        self.runs.append(range(self.count, self.count))

    def add(self, batch: pa.RecordBatch) -> None:
        """Append to the last run."""
        for i in range(0, batch.num_rows, self.rows):
            self.writer.write_batch(batch.slice(i, self.rows))
            self.count += 1
        self.runs[-1] = range(self.runs[-1].start, self.count)

    def merged(self, first: int, last: int) -> Iterator[pa.RecordBatch]:
        """Some of the runs as one, in batches."""
        with self.files.open_input_file(self.path) as f:
            source = pa.ipc.open_file(f)
            rows = []
            for entry in LoserTree([_read_run(source, self.runs[i], i) for i in range(first, last)]):
                rows.append(entry[-1])
                if len(rows) == self.rows:
                    yield _batch(rows, self.schema)
                    rows = []
            if rows:
                yield _batch(rows, self.schema)

    def close(self) -> None:
        self.writer.close()
        self.sink.close()

    def remove(self) -> None:
        self.files.delete_file(self.path)


def _merge(scratch: str, fan_in: int, buffer_rows: int):
    """Over the entries of one range, sorted by archive: one sequence.

    The archives' pieces are spooled as runs to a file of the task's own. While there are more than `fan_in` runs, as many at a
    time become one longer run in the next file. A task holds `buffer_rows` entries of each run that it merges, however many the range has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spool, last = None, object()
        name = f"{scratch}/{uuid.uuid4().hex}"
        for batch in batches:
            if spool is None:
                files, folder = place(scratch)
                files.create_dir(folder, recursive=True)
                spool = _Spool(f"{name}-0", batch.schema, buffer_rows)
            archive = batch.column(batch.schema.get_field_index("archive")).to_pylist()
            cuts = [0] + [i for i in range(1, len(archive)) if archive[i] != archive[i - 1]] + [len(archive)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    if archive[a] != last:
                        last = archive[a]
                        spool.new_run()
                    spool.add(batch.slice(a, b - a))
        if spool is None:
            return
        spool.close()
        number = 0
        while len(spool.runs) > fan_in:
            number += 1
            longer = _Spool(f"{name}-{number}", spool.schema, buffer_rows)
            for i in range(0, len(spool.runs), fan_in):
                longer.new_run()
                for batch in spool.merged(i, min(i + fan_in, len(spool.runs))):
                    longer.add(batch)
            longer.close()
            spool.remove()
            spool = longer
        yield from spool.merged(0, len(spool.runs))
        spool.remove()

    return run


def merged_index(spark: SparkSession, path: str, range_rows: int = RANGE_ROWS, fan_in: int = FAN_IN, buffer_rows: int = BUFFER_ROWS) -> DataFrame:
    """The index entries of all archives below `path`, in the order of URL key and time; a task merges a range of about `range_rows`."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(_entries, INDEX.replace("url_key", "url"))
    runs = kept(found.withColumn("url_key", url_key(F.col("url"))).drop("url"), "runs")
    names = [p.strip().split()[0] for p in INDEX.split(",")]
    ranges = max(1, -(-runs.count() // range_rows))
    dealt = runs.select(*names).repartitionByRange(ranges, "url_key", "captured", "page_id", "archive", "offset")
    ordered = dealt.sortWithinPartitions("archive", "url_key", "captured", F.col("page_id").asc_nulls_last())
    return ordered.mapInArrow(_merge(shared_path(spark, "merge"), fan_in, buffer_rows), INDEX)


def archive_and_index(df: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", captured: Column | None = None) -> DataFrame:
    """Write the rows to archives in the shared folder and read their merged index."""
    path = shared_path(df.sparkSession, "warc")
    write_archives(df, path, page_id, url, payload, captured)
    return merged_index(df.sparkSession, path)
