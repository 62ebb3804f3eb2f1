"""WARC archives: a writer with revisit records and a splittable reader.

Writing. Payloads are compared by SHA-1 and length in the JVM. Of equal payloads of at least `least_bytes`, the
one with the largest page_id becomes a response record, the others revisit it. Each task writes its records, a
gzip member each, to files in the shared folder: under a name of its own first, then moved, so an attempt that is
lost leaves nothing half-written and one that is repeated replaces it.

Reading. Byte ranges are dealt out, a task for each (for several beyond `MOST_TASKS`). A task scans its range for gzip's magic
number, accepts a place only if a member decodes there to the header of a WARC record, one that ends within HEADER_BYTES,
and from then on goes from member to member, whose headers may be of any length; it owns the records that start inside its range, wherever they end. Ranges
need no index and may be cut anywhere. The writer keeps every header within HEADER_BYTES, so each of its records is found from any
range; verified() counts what was written against what is read.

Files are reached through pyarrow's file systems, so the shared folder may be file:, hdfs:, s3: or gs:.

Defined results: a null html is an empty payload; a null page_id is never the largest (equal payloads without
any id are all responses), and comes back as null; records of the largest id are all responses if it is repeated; a null url has no
target; control characters in urls are percent-encoded; a url of more than URL_BYTES bytes is left out of its record, which says so by the url's SHA-1 and length,
and comes back as null; no rows give no archive and no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.llm.common import fresh_path, read, stored

LEAST_BYTES = 1000
MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 1 << 30
RANGE_BYTES = 16 << 20
CHUNK = 1 << 16
#: A place in an archive whose record has a longer header isn't accepted, unless the record before it ends there.
HEADER_BYTES = 1 << 20
#: Longer urls aren't written.
URL_BYTES = 1 << 19
#: Partitions of ranges at most: more make a driver slow. Their ranges are read one after another.
MOST_TASKS = 200_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def decided(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, payload, digest, bytes, refers_to (null: response)."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload")).withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    small = own.where(F.col("bytes") >= least_bytes).select("page_id", "digest", "bytes")
    latest = small.groupBy("digest", "bytes").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1 AND latest IS NOT NULL")
    # Only the revisits, a row for each id and payload.
    refs = small.join(latest, ["digest", "bytes"]).where("NOT page_id <=> latest").select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("bytes").alias("r_bytes"), F.col("latest").alias("refers_to")).distinct()
    on = own["page_id"].eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")) & (F.col("bytes") == F.col("r_bytes"))
    return own.join(refs, on, "left").select("page_id", "url", "payload", "digest", "bytes", "refers_to")


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC record. A revisit has the payload's HTTP header, with its length, and no payload."""
    import hashlib
    import re

    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}"]
    if url is not None:
        target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        n = len(target.encode())
        head += [f"WARC-Target-URI: {target}"] if n <= URL_BYTES else [f"X-Target-URI-Digest: sha1:{hashlib.sha1(url.encode()).hexdigest()}", f"X-Target-URI-Length: {n}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The records of decided() to archives in a folder -> (path, size, records), stored: the archives are there when this returns."""

    def written(batches):
        import gzip

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        system, base = fs.FileSystem.from_uri(folder)
        done, out, size, part, count = [], None, 0, 0, 0

        def close():
            nonlocal out, size, part, count
            if out is not None:
                out.close()
                system.move(f"{base}/{own}", f"{base}/{name}")
                done.append((f"{folder}/{name}", size, count))
                out, size, part, count = None, 0, part + 1, 0

        for row in (row for whole in batches for at in range(0, whole.num_rows, 256) for row in zip(*[c.to_pylist() for c in whole.slice(at, 256).columns], strict=True)):
            if out is None:
                if not part:
                    system.create_dir(base, recursive=True)
                name = f"part-{task.partitionId():05d}-{part:04d}.warc.gz"
                own = f".{name}.{task.taskAttemptId()}"
                out = system.open_output_stream(f"{base}/{own}", compression=None)
            member = gzip.compress(record(*row), compresslevel=6, mtime=0)
            out.write(member)
            size += len(member)
            count += 1
            if size >= file_bytes:
                close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), *[pa.array([x[i] for x in done], pa.int64()) for i in (1, 2)]], names=["path", "size", "records"])

    return stored(records.mapInArrow(written, "path string, size bigint, records bigint"), "warc-files")


def parsed(data: bytes) -> dict | None:
    """The fields of a record's text, names in lower case, with its block as 'block'; None if it isn't one."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/1."):
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    return fields | {"block": rest[: int(fields["content-length"])], "whole": len(rest) >= int(fields["content-length"])}


def member_at(read_at, at: int, most: float = HEADER_BYTES) -> tuple[bytes, int] | None:
    """(text, end) of the gzip member at an offset, or None if what is there doesn't decode to a WARC record's start, with a header of fewer bytes than most."""
    import zlib

    stream, out, size, here, headed = zlib.decompressobj(31), [], 0, at, False
    try:
        while not stream.eof:
            chunk = read_at(here, CHUNK)
            if not chunk:
                return None
            out.append(stream.decompress(chunk))
            here += len(chunk)
            size += len(out[-1])
            if not headed and (size >= 7 or stream.eof):
                head = b"".join(out)
                headed = 0 <= head.find(b"\r\n\r\n") < most
                if not head.startswith(b"WARC/1.") or not headed and (stream.eof or size >= most):
                    return None
    except zlib.error:
        return None
    return b"".join(out), here - len(stream.unused_data)


def records_in(read_at, start: int, end: int):
    """The records whose members start in [start, end)."""
    at, sure = start, False
    while at < end:
        if not sure:
            window = read_at(at, CHUNK + len(MAGIC) - 1)
            k = window.find(MAGIC)
            if k < 0:
                if len(window) < CHUNK + len(MAGIC) - 1:
                    return
                at += CHUNK
                continue
            at += k
            if at >= end:
                return
        member = member_at(read_at, at, float("inf") if sure else HEADER_BYTES)
        fields = parsed(member[0]) if member else None
        if fields and fields["whole"]:
            yield fields
            at, sure = member[1], read_at(member[1], len(MAGIC)) == MAGIC
        else:
            at, sure = at + 1, False


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, size) -> RECORD: a row for each record, byte ranges dealt out to the tasks. The ranges are counted first: rows of some bytes would else be put together in one task."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    ranges = files.where("size > 0").select("path", "size", starts)
    ranges = ranges.repartitionByRange(max(1, min(ranges.count(), MOST_TASKS)), "path", "start")

    def rows(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}
        number = lambda x: int(n) if (n := (x or "").removeprefix("<urn:page:").removesuffix(">")) else None
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds.values())], names=list(kinds))
        out, held = [], 0
        for b in batches:
            for path, size, start in zip(*[c.to_pylist() for c in b.columns], strict=True):
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_file(place) as f:
                    for x in records_in(lambda at, n, f=f: f.read_at(n, at), start, min(size, start + range_bytes)):
                        http, _, payload = x["block"].partition(b"\r\n\r\n")
                        if x["warc-type"] == "revisit":
                            lengths = [line[15:].strip() for line in http.split(b"\r\n") if line[:15].lower() == b"content-length:"]
                            payload, n, digest = None, int(lengths[0]), x["warc-payload-digest"].removeprefix("sha1:")
                        else:
                            n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        out.append((number(x["warc-record-id"]), x.get("warc-target-uri"), x["warc-type"], number(x.get("warc-refers-to")), n, digest, payload))
                        held += len(payload or b"")
                        if len(out) >= 2000 or held >= 16 << 20:
                            yield batch(out)
                            out, held = [], 0
        yield batch(out)

    return ranges.mapInArrow(rows, RECORD)


def verified(files: DataFrame, rows: DataFrame) -> DataFrame:
    """rows, if there are as many of them as records were written to the files; else an error. Both are counted for this."""
    written, found = files.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first()["n"], rows.count()
    if written != found:
        raise ValueError(f"{written} records were written, {found} read")
    return rows


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write(decided(read(spark, sf_dir, "pages")), fresh_path(spark, "warc"))
    return read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op10_warc": op10_warc}
ORACLES = {
    "op10_warc": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS latest FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id IS DISTINCT FROM latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id IS DISTINCT FROM latest THEN latest END AS refers_to
FROM m
"""
}
