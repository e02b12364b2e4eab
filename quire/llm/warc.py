"""WARC archives of pages, and their index by external merge.

Writing: each task writes gzip segments (one member per record) of about SEGMENT_BYTES to the shared folder; what it
returns, the manifest, names the segments of the attempt that succeeded, and nothing else is read later. Of pages with
equal payloads of at least min_revisit_bytes, that with the smallest page_id is the response, and others are revisits that
refer to it (rows that repeat the smallest page_id are responses too).

Reading: each segment is read back, its payloads are hashed again, and its captures are sorted by (URL key, time,
page_id) into a run. Runs are dealt by key range, sampled over all runs, and each range merges its slices of the runs
with a loser tree: partitions in order hold the captures in global order. One URL with very many captures is spread over
ranges by time.

Defined cases: null html is an empty payload; null url has an empty key; null page_id is carried as null; page times are
EPOCH plus page_id seconds as the table has none; payloads of any length are written whole, in one record; captures that tie
in URL key, time and page_id, as repeated rows do, keep the order of their runs, and share a record id if their payloads
are equal; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, new_path

SEGMENT_BYTES = 8 << 20
#: Bytes of a segment that are unpacked at a time, and runs that are merged at a time.
FEED, MOST_RUNS = 1 << 15, 64
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
MANIFEST = "file string, records long, bytes long"
INDEX = "run string, url_key string, capture_time string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
#: What stays as it is in a WARC-Target-URI (fixed values).
URI_SAFE = "%!#$&'()*+,/:;=?@[]~-._"


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, without www, user and default port; path; sorted query; no fragment."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url.strip().lower()
    host = re.sub(r"^www\d*\.", "", host)
    query = "&".join(sorted(u.query.lower().split("&"))) if u.query else ""
    name = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{name}){u.path.lower() or '/'}" + (f"?{query}" if query else "")


def capture_time(page_id: int | None) -> str:
    try:
        return (EPOCH + timedelta(seconds=page_id or 0)).strftime("%Y-%m-%dT%H:%M:%SZ")
    except OverflowError:
        return "9999-12-31T23:59:59Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, which states the payload's length, and leaves the payload out."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page {i} {digest}')}>"
    head = [
        "WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"X-Page-ID: {'' if page_id is None else page_id}", f"WARC-Date: {capture_time(page_id)}",
        f"WARC-Target-URI: {quote(url or '', safe=URI_SAFE)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member."""
    view, at = memoryview(data), 0
    while at < len(data):
        d, out, to = zlib.decompressobj(31), [], at
        while not d.eof:
            piece = view[to : to + FEED]
            if not len(piece):
                raise ValueError(f"the member at {at} is cut short")
            out.append(d.decompress(piece))
            to += len(piece)
        end = to - len(d.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def parse(content: bytes) -> dict:
    """The capture that a record holds; the payload of a response is hashed anew."""
    head, _, body = content.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    body = body[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda s: int(s) if s else None
    return {
        "url_key": url_key(fields["WARC-Target-URI"]), "capture_time": fields["WARC-Date"], "page_id": number(fields["X-Page-ID"]), "payload_bytes": size,
        "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("X-Refers-To-Page", "")),
    }


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def loser_tree(runs: list[list], key) -> Iterator:
    """Merges sorted runs. Inner nodes keep the loser of their match, so that each record costs one path to the root."""
    k = len(runs)
    if not k:
        return
    at = [0] * k
    end = (1,)
    head = [(0, *key(r[0]), i) if r else end for i, r in enumerate(runs)]
    tree = [-1] * k  # tree[0]: the winner

    def play(leaf: int) -> None:
        winner, node = leaf, (leaf + k) // 2
        while node > 0:
            if tree[node] == -1:
                tree[node] = winner
                return
            if head[tree[node]] < head[winner]:
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner

    for leaf in range(k):
        play(leaf)
    while head[w := tree[0]] != end:
        yield runs[w][at[w]]
        at[w] += 1
        head[w] = (0, *key(runs[w][at[w]]), w) if at[w] < len(runs[w]) else end
        node, winner = (w + k) // 2, w
        while node > 0:
            if head[tree[node]] < head[winner]:
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner


def with_revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, and in refers_to the page that a revisit refers to."""
    d = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    d = d.withColumn("sha", F.sha1("payload"))
    again = d.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return d.join(again, "sha", "left").select("page_id", "url", "payload", F.when(later, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes the archives under path and returns the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        made, buf, size, n, raw = [], [], 0, 0, 0

        def flush() -> None:
            nonlocal buf, size, n, raw
            name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):05d}.warc.gz"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(b"".join(buf))
            made.append({"file": name, "records": n, "bytes": size})
            buf, size, n, raw = [], 0, 0, 0

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i) for i in range(4))):
                payload = payload.as_py()
                c = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = c.compress(record(page_id.as_py(), url.as_py(), payload, base32_sha1(payload), refers_to.as_py())) + c.flush()
                buf.append(member)
                size, n, raw = size + len(member), n + 1, raw + len(payload)
                if size >= segment_bytes:
                    flush()
        if buf:
            flush()
        yield pa.RecordBatch.from_pylist(made, pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return cut(with_revisits(pages, min_revisit_bytes).mapInArrow(write, MANIFEST), "warc-manifest")


def capture_runs(manifest: DataFrame, path: str) -> DataFrame:
    """The captures of each segment, sorted: one run per segment."""
    schema = pa.schema([(c, pa.int64() if k == "long" else pa.string()) for c, k in (x.split() for x in INDEX.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{name}") as f:
                    data = f.read()
                run = [parse(content) | {"run": name, "file": name, "offset": at, "length": n} for at, n, content in members(data)]
                run.sort(key=_order)
                yield pa.RecordBatch.from_pylist(run, schema)

    segments = max(1, manifest.count())
    return cut(manifest.select("file").repartition(segments).mapInArrow(read, INDEX), "warc-runs")


def _order(x: dict) -> tuple:
    return x["url_key"], x["capture_time"], x["page_id"] is not None, x["page_id"] or 0


def merge_runs(runs: DataFrame, rows_per_range: int = 200_000) -> DataFrame:
    """The captures in global order of (url_key, capture_time, page_id): partition after partition."""
    schema = pa.schema([(c, pa.int64() if k == "long" else pa.string()) for c, k in (x.split() for x in INDEX.split(", "))])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                slices.setdefault(row["run"], []).append(row)
        out, runs = [], [slices[r] for r in sorted(slices)]
        while len(runs) > MOST_RUNS:
            runs = [list(loser_tree(runs[k : k + MOST_RUNS], _order)) for k in range(0, len(runs), MOST_RUNS)]
        for row in loser_tree(runs, _order):
            out.append(row)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    ranges = max(1, runs.count() // rows_per_range + 1, runs.sparkSession.sparkContext.defaultParallelism)
    order = ["url_key", "capture_time", "page_id"]
    return runs.repartitionByRange(ranges, *order).sortWithinPartitions("run", *order).mapInArrow(merge, INDEX)


def archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes pages as WARC, reads the archives back and returns the merged index."""
    return merge_runs(capture_runs(write_warc(pages, path, min_revisit_bytes), path))


def placed(index: DataFrame) -> DataFrame:
    """The index with place, the number of captures before each one in global order: its partition's offset, of a row a partition, and its place there."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for x in batches:
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array([part] * x.num_rows, pa.int32()), pa.array(range(at, at + x.num_rows), pa.int64())], names=[*x.schema.names, "part", "at"])
            at += x.num_rows

    rows = cut(index.mapInArrow(number, INDEX + ", part int, at long"), "warc-index")
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    known = rows.sparkSession.createDataFrame(offsets, "part int, before long")
    return rows.join(F.broadcast(known), "part").withColumn("place", F.col("before") + F.col("at")).drop("part", "at", "before")


def warc_digest(pages: DataFrame) -> DataFrame:
    """Of every page its record, its URL key, and its place in the ordered captures of all URLs."""
    index = placed(archive(pages, new_path(pages.sparkSession, "warc")))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "capture_time", "url_key", "place")
