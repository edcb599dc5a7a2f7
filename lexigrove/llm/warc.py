"""WARC archives as chunked record tables.

write_warc() makes one archive of each partition, a gzip member for each record, and returns an
index of the records (path, offset, length).  Payloads of at least MIN_REVISIT bytes that are equal
are written once, as the response of the smallest page id; the others become revisits of it.
read_warc() streams records out of the archives as rows (record id, chunk number, bytes), each with
the digest of the payload so far, so that no payload is held as a whole.

Null payloads are empty; a null url leaves out the target header; rows that repeat a page id and its
payload are copies of one record and share its type; rows without a page id refer to others but
none refers to them.  A lost task writes a new archive; only archives named by the index are read.
"""

import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, table, work_path

MIN_REVISIT, CHUNK = 100, 256 << 10
READ_BYTES = 32 << 20  #: bytes of archives that a task reads back, about
BROADCAST_ROWS = 200_000  #: revisits up to which their ids (16 bytes each) are sent to every executor


def revisits(pages: DataFrame, page_id: str = "page_id", payload: str = "html") -> DataFrame:
    """(page, digest, refers_to) of the pages whose payload a smaller page id has too."""
    data = F.coalesce(payload, F.lit("")).cast("binary")
    marks = pages.select(F.col(page_id).alias("page"), F.sha2(data, 256).alias("digest"), F.length(data).alias("n")).where(F.col("n") >= MIN_REVISIT)
    first = marks.groupBy("digest").agg(F.min("page").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 AND refers_to IS NOT NULL")
    return marks.join(first.drop("copies"), "digest").where("NOT page <=> refers_to").select("page", "digest", "refers_to").distinct()


def write_warc(pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", payload: str = "html", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Writes the pages as archives under ``path`` and returns their index, written down: (path, offset, length)."""
    spark = pages.sparkSession
    path = path or work_path(spark, "warc")
    again = stage(revisits(pages, page_id, payload), "revisits")
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), F.coalesce(payload, F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    rows = rows.join((F.broadcast if again.count() <= broadcast_rows else lambda x: x)(again.withColumnRenamed("page", "_page").withColumnRenamed("digest", "_digest")), F.col("page").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    rows = rows.select(F.col("page").cast("string"), "url", "payload", "digest", F.col("refers_to").cast("string"))

    def f(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(path)
        system.create_dir(base, recursive=True)
        name, at, out = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, None

        for batch in batches:
            offsets, lengths = [], []
            page, link, data, digest, refers = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                out = out or system.open_output_stream(name, compression=None)
                body = data[i].as_buffer()  # the text's bytes in place, not a copy
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {body.size}\r\n\r\n".encode()
                other = refers[i].as_py()
                fields = ["WARC/1.1", f"WARC-Type: {'revisit' if other is not None else 'response'}", f"WARC-Record-ID: <urn:page:{page[i].as_py() if page[i].is_valid else ''}>", "WARC-Date: 2020-01-01T00:00:00Z"]
                if link[i].is_valid:
                    fields.append(f"WARC-Target-URI: {quote(link[i].as_py(), safe=':/?#[]@!$&()*+,;=%~')}")
                fields.append(f"WARC-Payload-Digest: sha256:{digest[i].as_py()}")
                if other is not None:
                    fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{other}>"]
                fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(head) + (0 if other is not None else body.size)}"]
                pack, size = zlib.compressobj(1, zlib.DEFLATED, 31), 0

                def put(x):
                    if x:
                        out.write(x)
                    return len(x)

                size += put(pack.compress("\r\n".join([*fields, "", ""]).encode() + head))
                if other is None:
                    for a in range(0, body.size, CHUNK):
                        size += put(pack.compress(body.slice(a, min(CHUNK, body.size - a))))
                size += put(pack.compress(b"\r\n\r\n")) + put(pack.flush())
                offsets.append(at)
                lengths.append(size)
                at += size
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["path", "offset", "length"])
        if out:
            out.close()

    return stage(rows.mapInArrow(f, "path string, offset long, length long"), "warc-index")


def read_warc(index: DataFrame, path_uri: str, data: bool = True) -> DataFrame:
    """Chunk rows of the records in ``index``: record_id, chunk_no, chunk, bytes and digest so far, is_last, and the headers' values.

    A revisit has one chunk, without bytes of its own; its bytes and digest are those its headers state.
    A response whose bytes don't have the digest of its headers raises.
    """
    fields = "record_id string, chunk_no int, chunk binary, n_bytes long, sha256 string, is_last boolean, record_type string, target_uri string, refers_to string"

    def f(batches):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(path_uri)
        opened, file = None, None
        rows = [[] for _ in range(9)]
        held = 0

        def full():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string()))], [x.split()[0] for x in fields.split(", ")])

        for batch in batches:
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if path != opened:
                    opened, file = path, system.open_input_file(path)
                file.seek(offset)
                pack, left, text = zlib.decompressobj(31), length, b""

                def more():  # the next bytes of the record, at most CHUNK of them
                    nonlocal left
                    while True:
                        x = pack.unconsumed_tail
                        if not x and left:
                            x = file.read(min(left, CHUNK))
                            left -= len(x)
                        got = pack.decompress(x, CHUNK)
                        if got or (not x and not left):
                            return got

                while text.count(b"\r\n\r\n") < 2:
                    if not (got := more()):
                        raise ValueError(f"{path} at {offset}: the record ends in its headers")
                    text += got
                own, http, body = text.split(b"\r\n\r\n", 2)
                given = {k.lower(): v.strip() for k, _, v in (x.partition(": ") for x in own.decode().split("\r\n")[1:])}
                size = int(next(x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                kind, claimed = given["warc-type"], given["warc-payload-digest"].removeprefix("sha256:")
                key, other = given["warc-record-id"][len("<urn:page:") : -1] or None, given.get("warc-refers-to")
                other = other and other[len("<urn:page:") : -1]

                def add(no, chunk, n, digest, last):
                    nonlocal held
                    for x, v in zip(rows, (key, no, chunk if data else None, n, digest, last, kind, given.get("warc-target-uri"), other)):
                        x.append(v)
                    held += len(chunk) if data else 0

                if kind == "revisit":
                    add(0, b"", size, claimed, True)
                else:
                    sha, done, no = hashlib.sha256(), 0, 0
                    while True:
                        chunk = body[: size - done]
                        sha.update(chunk)
                        done += len(chunk)
                        last = done == size
                        add(no, chunk, done, sha.hexdigest(), last)
                        no += 1
                        if last:
                            break
                        if held > 8 << 20:
                            yield full()
                            rows, held = [[] for _ in range(9)], 0
                        if not (body := more()):
                            raise ValueError(f"{path} at {offset}: the payload ends early")
                    if rows[4][-1] != claimed:
                        raise ValueError(f"{path} at {offset}: the payload's digest is not that of the header")
                if held > 8 << 20 or len(rows[0]) >= 5000:
                    yield full()
                    rows, held = [[] for _ in range(9)], 0
        if rows[0]:
            yield full()

    # tasks by bytes of the archives, not of the index; an offset is the sum of the lengths before it
    held = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(-(-held // READ_BYTES), index.sparkSession.sparkContext.defaultParallelism)
    parts = index.repartition(tasks, "path", F.floor(F.col("offset") / (held // tasks + 1 if held < tasks * READ_BYTES else READ_BYTES)))
    return parts.sortWithinPartitions("path", "offset").mapInArrow(f, fields)


def op8_warc_chunks(spark, sf_dir):
    """Writes all pages as archives, and reads their records back."""
    path = work_path(spark, "warc")
    index = write_warc(table(spark, sf_dir, "pages"), path)
    last = read_warc(index, path, data=False).where("is_last")
    return last.select(
        F.col("record_id").cast("long").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("sha256").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS f FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id > f THEN f END AS refers_to
FROM f
"""
