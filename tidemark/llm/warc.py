"""WARC archives: writing, normalising monolithic gzip files, reading by offset."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import save, shared_dir, table

#: Equal payloads from this size on are stored once.
MIN_REVISIT_BYTES = 1000
#: An archive ends at so many payload bytes; a longer record is alone in its own.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
#: A group of equal payloads is dealt out in so many parts.
SALTS = 16


def open_store(uri: str):
    """(file system, path) of a folder in the shared store."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def plan_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Rows (page_id, url, payload, digest, refers_to). Of equal payloads of at
    least ``min_bytes``, the largest page_id is kept and the others refer to it.

    Groups are found by partial aggregation of digests and joined back on digest
    and a salt, so that a large group is dealt to ``SALTS`` tasks. Null html is an
    empty payload. A row with a null page_id is always kept and never referred to;
    rows that share the largest page_id are all kept.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    groups = rows.where((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("least")).where("least < keeper")
    groups = groups.select("digest", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.join(groups, ["digest", "salt"], "left").select("page_id", "url", "payload", "digest", F.when(F.col("keeper") > F.col("page_id"), F.col("keeper")).alias("refers_to"))


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has headers but no payload."""
    kind = "response" if refers_to is None else "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def write_monolithic(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``rows`` (of ``plan_revisits``) as gzip files, each one stream over
    many records. Returns (archive, records); a file's name holds the task's
    attempt, so that a repeated task doesn't disturb what the first one wrote."""

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        store, base = open_store(folder)
        ctx, seq, out, size, n = TaskContext.get(), 0, None, 0, 0
        stem = f"{ctx.partitionId():05d}-{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        done = []

        def close():
            out.write(gz.flush())
            out.close()
            done.append((name, n))

        for batch in batches:
            for page_id, url, payload, digest, refers in zip(*(batch.column(i) for i in range(5)), strict=True):
                payload = payload.as_py()
                if out is not None and size + len(payload) > ARCHIVE_BYTES:
                    close()
                    out, seq = None, seq + 1
                if out is None:
                    name = f"{stem}-{seq:04d}.warc.gz"
                    out, gz, size, n = store.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                out.write(gz.compress(record(page_id.as_py(), url.as_py(), payload, digest.as_py(), refers.as_py())))
                size += len(payload)
                n += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["archive", "records"])

    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, "archive string, records long")


def records_of(stream, chunk: int = CHUNK):
    """Raw records of a gzip stream, one member or many, inflated once; memory is
    bounded by the longest record."""
    gz, buffer, at = zlib.decompressobj(31), bytearray(), 0
    while True:
        data = stream.read(chunk)
        ended = not data
        while data:
            buffer += gz.decompress(data, chunk)
            data = gz.unconsumed_tail
            if gz.eof:
                data = gz.unused_data
                gz = zlib.decompressobj(31)
            while True:
                end = buffer.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                head = bytes(buffer[at:end]).lower()
                spot = head.rfind(b"content-length: ") + 16
                need = end + 4 + int(head[spot : (head.find(b"\r\n", spot) + 1 or len(head) + 1) - 1]) + 4
                if len(buffer) < need:
                    break
                yield bytes(buffer[at:need])
                at = need
            if at > chunk:
                del buffer[:at]
                at = 0
        if ended:
            if len(buffer) > at:
                raise ValueError("the stream ends within a record")
            return


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite each of ``archives(archive)`` with every record as a gzip member of
    its own, and a sidecar ``.idx`` of ``offset length record-id`` lines beside it.
    Returns the index: (archive, offset, length)."""

    def rewrite(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        store, base = open_store(source)
        _, out_base = open_store(target)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                new, offsets, lengths, offset = f"{name.removesuffix('.warc.gz')}-{attempt}.warc.gz", [], [], 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream, store.open_output_stream(f"{out_base}/{new}", compression=None) as out, store.open_output_stream(f"{out_base}/{new}.idx") as side:
                    for raw in records_of(stream):
                        gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = gz.compress(raw) + gz.flush()
                        out.write(member)
                        side.write(f"{offset} {len(member)} {parse(raw)[0]['WARC-Record-ID']}\n".encode())
                        offsets.append(offset)
                        lengths.append(len(member))
                        offset += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([new] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["archive", "offset", "length"])

    return archives.select("archive").mapInArrow(rewrite, "archive string, offset long, length long")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read records by their offsets: (page_id, url, record_type, refers_to,
    payload_bytes, payload_digest). A response's bytes are counted and digested
    anew and must agree with its header."""

    def read(batches):
        import pyarrow as pa

        store, base = open_store(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        number = lambda x: None if x is None else int(x)
        opened: tuple = (None, None)
        for batch in batches:
            rows = []
            for name, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if opened[0] != name:
                    if opened[1]:
                        opened[1].close()
                    opened = (name, store.open_input_file(f"{base}/{name}"))
                headers, payload = parse(zlib.decompress(opened[1].read_at(length, offset), 31))
                digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                size = int(headers["X-Payload-Length"])
                if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"{name} at {offset}: the payload isn't what its header says")
                rows.append((number(headers.get("X-Page-ID")), headers.get("WARC-Target-URI"), headers["WARC-Type"], number(headers.get("X-Refers-To-Page-ID")), size, digest))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
        if opened[1]:
            opened[1].close()

    return index.select("archive", "offset", "length").mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string")


def archive_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Write ``pages(page_id, url, html)`` as monolithic archives and normalise
    them. Returns (archives, index, folder of the normalised archives). An empty
    table gives no archive; other columns are ignored."""
    from pyarrow import fs  # noqa: F401  workers need it too

    spark = pages.sparkSession
    base = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    store, path = open_store(base)
    store.create_dir(f"{path}/monolithic", recursive=True)
    store.create_dir(f"{path}/records", recursive=True)
    archives = save(write_monolithic(plan_revisits(pages), f"{base}/monolithic"), "archives")
    index = save(normalise(archives.repartition("archive"), f"{base}/monolithic", f"{base}/records"), "warc-index")
    return archives, index, f"{base}/records"


def op2_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index, folder = archive_pages(table(spark, sf_dir, "pages"))
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
k AS (SELECT digest, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN keeper > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper > page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k ON p.digest = k.digest
"""
