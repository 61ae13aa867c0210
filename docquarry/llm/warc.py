"""Operator 10: WARC archives with deduplicated payloads and a two-level capture index."""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, lower_ascii, materialize, new_path, open_folder

REVISIT_FROM = 100  # bytes of payload from which equal payloads are stored once
_NS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
CAPTURE = "page_id long, key string, file string, at long, size long"


def url_key(url: Column) -> Column:
    """Sort key of a url: host labels reversed and joined by commas, ``)``, then path and query in lower case; the
    empty string for null. Blanks and control characters become ``%``."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.regexp_replace(F.substring(rest, F.length(host) + 1, F.length(rest)), r"#[\s\S]*$", "")
    key = F.concat(F.array_join(F.reverse(F.split(lower_ascii(host), r"\.")), ","), F.lit(")"), lower_ascii(tail))
    return F.coalesce(F.regexp_replace(key, r"[\x00-\x20\x7F]", "%"), F.lit(""))


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NS, f'page:{page_id}')}>"


def build_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, its own gzip member. A revisit carries the HTTP header and the full payload's length and digest,
    but no payload."""
    head = HTTP % len(payload)
    body = head if refers_to is not None else head + payload
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if refers_to is not None else b"response"),
        b"WARC-Record-ID: " + record_id(page_id).encode(),
        b"WARC-Date: 2000-01-01T00:00:00Z",
    ]
    if url is not None:
        lines.append(
            b"WARC-Target-URI: " + "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in url).encode()
        )
    lines += [
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"X-Page-ID: " + (b"" if page_id is None else str(page_id).encode()),
    ]
    if refers_to is not None:
        lines += [
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            b"WARC-Refers-To: " + record_id(refers_to).encode(),
            b"X-Refers-To-Page-ID: " + str(refers_to).encode(),
        ]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: " + str(len(body)).encode()]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"\r\n".join(lines) + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def parse_record(data: bytes) -> dict:
    """Headers (``:type``, lower-case names) and ``payload`` of one gzip member."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    out = {k.lower().decode(): v.decode() for k, _, v in (line.partition(b": ") for line in head.split(b"\r\n")[1:])}
    body = rest[: int(out["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    out["payload"], out["http-length"] = payload, http.rpartition(b": ")[2].decode()
    return out


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, digest, refers_to. Only digests are grouped; the page with the smallest id of a payload
    of at least REVISIT_FROM bytes is its response. A payload repeated under one page_id is stored again. Payloads of
    more than a thousandth of all pages (fewer than a thousand of them) are joined by broadcast, and short ones are not
    joined at all, so that no body that many pages share is gathered in one task."""
    html = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        html.alias("html"),
        F.sha2(html, 256).alias("digest"),
    )
    digests = materialize(rows.select("page_id", "digest", F.length("html").alias("n")), "payloads")
    first = (
        digests.where(F.col("n") >= REVISIT_FROM)
        .groupBy("digest")
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
    )
    first = materialize(first, "repeated")
    limit = max(digests.count() // 1000, 100)
    marked = rows.join(F.broadcast(first.where(F.col("_n") > limit).select("digest", "_first")), "digest", "left")
    done = F.col("_first").isNotNull() | (F.length("html") < REVISIT_FROM)
    rest = (
        marked.where(~done)
        .drop("_first")
        .join(first.where(F.col("_n") <= limit).select("digest", "_first"), "digest", "left")
    )
    return (
        marked.where(done)
        .unionByName(rest)
        .select(
            "page_id",
            "url",
            "html",
            "digest",
            F.when(F.col("page_id") != F.col("_first"), F.col("_first")).alias("refers_to"),
        )
    )


def write_archives(records: DataFrame, folder: str, per_file: int = 1 << 28) -> DataFrame:
    """Write the records to .warc.gz files in a shared folder; returns the captures (page_id, key, file, at, size).

    Each task writes files of up to about ``per_file`` bytes under names of its own attempt, so an attempt that is
    lost leaves only files that no capture names.
    """

    def run(batches):
        files, base = open_folder(folder)
        files.create_dir(base, recursive=True)
        task, number, out, name, at, rows = TaskContext.get(), 0, None, "", 0, []
        for batch in batches:
            for r in batch.to_pylist():
                if out is None or at >= per_file:
                    if out is not None:
                        out.close()
                    name, at, number = (
                        f"part-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.warc.gz",
                        0,
                        number + 1,
                    )
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                data = build_record(r["page_id"], r["url"], r["html"], r["digest"], r["refers_to"])
                out.write(data)
                rows.append((r["page_id"], r["key"], name, at, len(data)))
                at += len(data)
            if len(rows) >= 4096:
                yield _captures(rows)
                rows = []
        if out is not None:
            out.close()
        yield _captures(rows)

    return materialize(records.withColumn("key", url_key(F.col("url"))).mapInArrow(run, CAPTURE), "captures")


def _captures(rows: list) -> pa.RecordBatch:
    a, b, c, d, e = zip(*rows, strict=True) if rows else ([],) * 5
    return pa.RecordBatch.from_arrays(
        [
            pa.array(a, pa.int64()),
            pa.array(b, pa.string()),
            pa.array(c, pa.string()),
            pa.array(d, pa.int64()),
            pa.array(e, pa.int64()),
        ],
        names=["page_id", "key", "file", "at", "size"],
    )


def write_index(captures: DataFrame, folder: str, per_block: int = 3000) -> DataFrame:
    """Sort the captures by (key, page_id), pack them into compressed blocks of ``per_block`` lines in index files,
    and return the sparse directory: a row (first_key, first_id, file, at, size, lines) for each block."""

    def run(batches):
        files, base = open_folder(folder)
        files.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"index-{task.partitionId():06d}-{task.taskAttemptId()}.idx"
        lines, first, last, at, out, blocks = [], None, None, 0, None, []

        def flush():
            nonlocal lines, first, at, out
            if out is None:
                out = files.open_output_stream(f"{base}/{name}", compression=None)
            data = zlib.compress("".join(lines).encode())
            out.write(data)
            blocks.append((*first, name, at, len(data), len(lines)))
            at, lines = at + len(data), []

        for batch in batches:
            for r in batch.to_pylist():
                pair = (r["key"], r["page_id"])
                if len(lines) >= per_block and pair != last:  # equal pairs stay in one block
                    flush()
                if not lines:
                    first = pair
                last = pair
                lines.append(
                    f"{r['key']}\t{'' if r['page_id'] is None else r['page_id']}\t{r['file']}\t{r['at']}\t{r['size']}\n"
                )
        if lines:
            flush()
        if out is not None:
            out.close()
        names = ["first_key", "first_id", "file", "at", "size", "lines"]
        columns = zip(*blocks, strict=True) if blocks else ([],) * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=names)

    ordered = captures.repartitionByRange(F.col("key").asc(), F.col("page_id").asc_nulls_first()).sortWithinPartitions(
        "key", F.col("page_id").asc_nulls_first()
    )
    return materialize(
        ordered.mapInArrow(run, "first_key string, first_id long, file string, at long, size long, lines long"),
        "directory",
    )


def _block_lines(stream, at: int, size: int) -> list[list[str]]:
    stream.seek(at)
    return [line.split("\t") for line in zlib.decompress(stream.read(size)).decode().split("\n")[:-1]]


def lookup(directory: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """Captures (page_id, key, file, at, size) of the wanted (key, page_id) pairs.

    The directory lies in as many pieces as there are index files, one for each range partition of the captures. The
    driver and the executors hold the first entry of each file alone; a pair finds its file there by binary search.
    The pairs of a file meet the file's piece of the directory, where a binary search names the block; pairs of one
    block share one range read, and a binary search inside the block finds the capture.
    """
    spark = directory.sparkSession
    lowest = -(2**63)  # stands for a null page_id
    entries = directory.select(
        F.col("file").alias("index"), "first_key", F.coalesce("first_id", F.lit(lowest)).alias("first_id"), "at", "size"
    )
    wanted = wanted.select("key", F.coalesce("page_id", F.lit(lowest)).alias("page_id"))
    # a row for each index file
    heads = (
        entries.groupBy("index")
        .agg(F.min(F.struct("first_key", "first_id")).alias("h"))
        .select("h.first_key", "h.first_id", "index")
        .collect()
    )
    if not heads:
        return spark.createDataFrame([], CAPTURE)
    files = spark.sparkContext.broadcast(sorted((k.encode(), i, name) for k, i, name in heads))

    def place(batches):
        firsts = [x[:2] for x in files.value]
        for batch in batches:
            at = [max(0, bisect.bisect_right(firsts, (k.encode(), i)) - 1) for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([files.value[i][2] for i in at], pa.string()), *batch.columns],
                names=["index", "key", "page_id"],
            )

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks = sorted((k.encode(), i, at, n) for k, i, at, n in zip(*(right[c].to_pylist() for c in ("first_key", "first_id", "at", "size")), strict=True))
        firsts, rows, last, keys, lines = [b[:2] for b in blocks], [], -1, [], []
        if left.num_rows:
            store, base = open_folder(folder)
            with store.open_input_file(f"{base}/{left['index'][0].as_py()}") as stream:
                for key, page_id in sorted(
                    (k.encode(), i) for k, i in zip(left["key"].to_pylist(), left["page_id"].to_pylist(), strict=True)
                ):
                    block = max(0, bisect.bisect_right(firsts, (key, page_id)) - 1)
                    if block != last:
                        last, lines = block, _block_lines(stream, *blocks[block][2:])
                        keys = [(x[0].encode(), int(x[1]) if x[1] else lowest) for x in lines]
                    at = bisect.bisect_left(keys, (key, page_id))
                    while at < len(keys) and keys[at] == (key, page_id):
                        x = lines[at]
                        rows.append((page_id if page_id > lowest else None, x[0], x[2], int(x[3]), int(x[4])))
                        at += 1
        return pa.Table.from_batches([_captures(rows)])

    placed = wanted.mapInArrow(place, "index string, key string, page_id long")
    return placed.groupBy("index").cogroup(entries.groupBy("index")).applyInArrow(find, CAPTURE)


def fetch(captures: DataFrame, folder: str) -> DataFrame:
    """Range-read the captured records: page_id, url, record_type, refers_to, payload_bytes and payload_digest (of
    the payload as stored; for a revisit what its header says), payload. Reads of one file go in order of place."""

    def read(batches):
        files, base = open_folder(folder)
        name, stream = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    if name != r["file"]:
                        name, stream = r["file"], files.open_input_file(f"{base}/{r['file']}")
                    stream.seek(r["at"])
                    rec = parse_record(stream.read(r["size"]))
                    response = rec["warc-type"] == "response"
                    out.append(
                        (
                            int(rec["x-page-id"]) if rec["x-page-id"] else None,
                            rec.get("warc-target-uri"),
                            rec["warc-type"],
                            int(rec["x-refers-to-page-id"]) if not response else None,
                            len(rec["payload"]) if response else int(rec["http-length"]),
                            hashlib.sha256(rec["payload"]).hexdigest()
                            if response
                            else rec["warc-payload-digest"].removeprefix("sha256:"),
                            rec["payload"] if response else None,
                        )
                    )
                types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([],) * 7, types, strict=True)],
                    names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"],
                )

    slices = captures.withColumn("_slice", F.expr(f"at DIV {1 << 24}"))
    dealt = slices.repartition("file", "_slice").sortWithinPartitions("file", "at").select("file", "at", "size")
    return dealt.mapInArrow(
        read,
        "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary",
    )


def resolve(records: DataFrame) -> DataFrame:
    """Replace what a revisit's header says of its payload by the length and digest of the response it names."""
    rows = materialize(records.drop("payload"), "records")
    response = (
        rows.where("record_type = 'response' AND page_id IS NOT NULL")
        .groupBy(F.col("page_id").alias("refers_to"))
        .agg(F.max(F.struct("payload_digest", "payload_bytes")).alias("_r"))
    )
    revisits = rows.where("refers_to IS NOT NULL").drop("payload_digest", "payload_bytes")
    named = response.join(revisits.groupBy("refers_to").agg(F.count("*").alias("_n")), "refers_to")
    found = join_groups(revisits, named, "refers_to", "_n").select("*", "_r.payload_digest", "_r.payload_bytes")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return found.select(*columns).unionByName(rows.where("refers_to IS NULL").select(*columns))


def archive_and_read(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages to archives, index them, look every page up in the index and read its record back.

    Null html is an empty payload; a null url has no target and the empty key; a null page_id never refers to
    another page and is written as a response; repeated rows are records of their own. An empty table gives no
    rows; extra columns are ignored.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    captures = write_archives(plan_records(pages), folder)
    directory = write_index(captures, folder)
    wanted = captures.select("key", "page_id").distinct()
    return resolve(fetch(lookup(directory, folder, wanted), folder))
