"""WARC archives: write, read back, and merge the capture indexes of all files.

Writing: payload digests are hashed by Spark; of records with equal payloads of ``REVISIT_BYTES`` or more
the one with the smallest page id is the response, the others are revisits without a payload. Each task
writes its records, one gzip member each, to files of its own in the shared folder; a file's name holds
the task attempt, and only files named by attempts that succeeded are read, so a lost executor leaves an
unread file and nothing else.

Reading: every file is streamed record by record; digests are computed anew and must agree. A file's
captures, sorted by URL key and timestamp, are a run.

Merging: ranges of (URL key, timestamp, page, file, offset) are dealt to tasks, so captures of one URL
may span tasks; each task merges its slices of all runs with a loser tree. Tasks in order, and rows in
order within a task (``range_no``, ``place``), are the global order of the capture histories.

Defined cases: a null html is an empty payload; payloads below the limit are always responses; a null url
is the empty target; a row without page id is a response and nothing refers to it; repeated rows are each
a record, and all with the smallest page id of their payload are responses; an empty table writes no file and gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from murmullo.session import materialize, scratch_path

REVISIT_BYTES = 100
FILE_BYTES = 256 << 20
MERGE_ROWS = 200_000
CHUNK = 1 << 20
EPOCH = datetime.datetime(2020, 1, 1)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format


def url_key(url: str | None) -> str:
    """Sortable form of an address: host labels reversed, then path and query."""
    try:
        parts = urlsplit(url or "")
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def record(page_id: int | None, url: str | None, date: str, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record; a revisit (refers_to given) has only the HTTP header of its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = "none" if page_id is None else page_id
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url or '', safe=SAFE)}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


SAFE = "".join(chr(c) for c in range(33, 127))  # an address keeps all but blanks, control and non-ASCII characters


def parse(raw: bytes) -> dict:
    """Fields of a record; the digest of a response's payload must agree with its header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't agree with its header")
    page, refers = (re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(x, "")) for x in ("WARC-Record-ID", "WARC-Refers-To"))
    return {
        "page_id": int(page[1]) if page else None, "url": fields["WARC-Target-URI"], "date": fields["WARC-Date"], "payload_bytes": size,
        "payload_digest": digest, "record_type": kind, "refers_to": int(refers[1]) if refers else None, "payload": payload,
    }


def records(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of every gzip member of a file, a member at a time."""
    offset, data = 0, b""
    while data := data or stream.read(CHUNK):
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not data:
                data = stream.read(CHUNK)
                if not data:
                    raise EOFError("the file ends within a record")
            parts.append(unpack.decompress(data))
            used += len(data)
            data = unpack.unused_data
        yield offset, b"".join(parts)
        offset += used - len(data)


def write(pages: DataFrame, folder: str, date: Column | None = None) -> DataFrame:
    """Writes the archives below ``folder``; returns the files written (path, n_records), as a table.

    date: capture time of a row; by default ``EPOCH`` and as many seconds as the page id.
    """
    start = F.lit(EPOCH.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    second = F.pmod(F.coalesce(F.col("page_id"), F.lit(0)).cast("long"), F.lit(1 << 31))
    when = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second) if date is None else date
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("html"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).alias("bytes"),
    )
    long = (F.col("bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull()
    firsts = rows.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    firsts = materialize(firsts.select("digest", "first"), "responses")
    typed = rows.join(firsts, "digest", "left").withColumn("refers_to", F.when(long & (F.col("first") < F.col("page_id")), F.col("first")))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, path, n, size, number = TaskContext.get(), None, "", 0, 0, 0
        store, root = fs.FileSystem.from_uri(folder)
        done = []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, n))
                out = None

        store.create_dir(root, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"capture-{task.partitionId():06d}-{task.taskAttemptId():08d}-{number:04d}.warc.gz"
                    path, n, size, number = f"{folder}/{name}", 0, 0, number + 1
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                raw = record(row["page_id"], row["url"], row["date"], row["digest"], row["html"].encode(), row["refers_to"])
                packed = pack.compress(raw) + pack.flush()
                out.write(packed)
                n, size = n + 1, size + len(packed)
                if size >= FILE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], ["path", "n_records"])

    return materialize(typed.select("page_id", "url", "html", "date", "digest", "refers_to").mapInArrow(put, "path string, n_records long"), "archives")


RUN_SCHEMA = pa.schema([
    ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()),
])
RUN_COLUMNS = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"
ORDER = ["url_key", "captured", "page_id", "file", "offset"]


def order_key(row: dict) -> tuple:
    """Key of ``ORDER`` that sorts as Spark does: strings by code point, a null page first."""
    return row["url_key"], row["captured"], row["page_id"] is not None, row["page_id"] or 0, row["file"], row["offset"]


def read(files: DataFrame) -> DataFrame:
    """Capture runs of the files (path, n_records): a row per record, each file's rows in ``ORDER``."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist()):
                store, place = fs.FileSystem.from_uri(path)
                rows = []
                with store.open_input_stream(place, compression=None) as stream:
                    for offset, raw in records(stream):
                        row = parse(raw)
                        del row["payload"]
                        rows.append({**row, "url_key": url_key(row.pop("url")), "captured": row.pop("date"), "file": path, "offset": offset})
                if len(rows) != n:
                    raise ValueError(f"{path} has {len(rows)} records, {n} were written")
                rows.sort(key=order_key)
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[at:at + 10_000], schema=RUN_SCHEMA)

    # a number keeps Spark from merging the few bytes of all paths into one task
    return files.repartition(max(1, files.count()), "path").mapInArrow(get, RUN_COLUMNS)


class LoserTree:
    """Merges sorted iterables: an inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list, key):
        self.key, self.k = key, len(runs)
        self.runs = [iter(r) for r in runs]
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * self.k  # [0] is the winner of all
        for i in range(self.k):
            self._play(i)

    def _next(self, i):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), i, row)

    def _wins(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return self.heads[a][:2] < self.heads[b][:2]

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self.losers[node] == -1:  # the first to come waits for its match
                self.losers[node] = i
                return
            if self._wins(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.losers[0] = i

    def __iter__(self):
        while self.k and (head := self.heads[self.losers[0]]) is not None:
            yield head[2]
            i = self.losers[0]
            self.heads[i] = self._next(i)
            self._play(i)


def merge(runs: DataFrame) -> DataFrame:
    """All captures in global order: the columns of the runs, ``range_no`` and ``place`` within the range."""
    runs = materialize(runs, "runs")
    parts = max(1, -(-runs.count() // MERGE_ROWS))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                slices.setdefault(row["file"], []).append(row)
        part, held, place = TaskContext.get().partitionId(), [], 0
        for row in LoserTree(list(slices.values()), order_key):
            held.append(row)
            if len(held) == 10_000:
                yield out(held, part, place)
                held, place = [], place + len(held)
        if held:
            yield out(held, part, place)

    def out(rows, part, place):
        batch = pa.RecordBatch.from_pylist(rows, schema=RUN_SCHEMA)
        more = [pa.array([part] * len(rows), pa.int64()), pa.array(range(place, place + len(rows)), pa.int64())]
        return pa.RecordBatch.from_arrays(batch.columns + more, RUN_SCHEMA.names + ["range_no", "place"])

    dealt = runs.repartitionByRange(parts, *ORDER).sortWithinPartitions("file", *ORDER)
    return dealt.mapInArrow(join, RUN_COLUMNS + ", range_no long, place long")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages as WARC, reads the archives back and returns every capture in global order."""
    return merge(read(write(pages, folder or scratch_path(pages.sparkSession, "warc"))))
