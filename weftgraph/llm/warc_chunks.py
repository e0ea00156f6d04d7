"""WARC archives as a chunked record table.

`write` stores each row as a WARC/1.0 record, a gzip member of its own, one archive per task, and `read_chunks` streams archives back as rows of
record identifier and chunk number. A payload is written and read CHUNK bytes at a time; each chunk row carries the
length and the SHA-1 of the payload up to its end, so that the last one has those of the whole, and no step gathers the
chunks of a record. Equal payloads of LEAST bytes or more are stored once: the largest page_id has the response record,
the others have revisit records that name it, the digest and the length. A record's identifier is its page_id and the row's
number in the table as read, so that rows with equal or null page_ids have identifiers of their own.

An archive is written under a name of its own attempt and moved into place when complete; only archives of tasks that
succeeded are in the manifest table, so a lost executor or a repeated task leaves no record twice.

Defined results: a null or empty html is a response of 0 bytes, which reads as one empty chunk; a null url is omitted; a
null page_id is kept as null and never referred to, unless all copies have none (then each is a response). Rows that
repeat the largest page_id with the same payload are all responses. Only page_id, url and html are read; an empty table
writes no archive and reads as an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialise, shared_dir, ship, store

LEAST = 1000
CHUNK = 1 << 16
#: Bytes read from an archive at once, and of chunk data in one batch of rows.
BLOCK = 1 << 20
BATCH_BYTES = 8 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def record_id(page_id, row: int) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{row}>"


def page_of(uri: str) -> int | None:
    x = uri.strip("<>").split(":")[-2]
    return int(x) if x else None


def assign(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages with refers_to: (page_id, row) of the response that a copy revisits, else null. Copies are grouped by digest and length;
    the groups are aggregated before the shuffle and joined back by a join whose large keys Spark can split."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row"))
    p = p.withColumn("_n", F.octet_length("html")).withColumn("_d", F.when(F.col("_n") >= least, F.sha1(F.col("html").cast("binary"))))
    copies = p.filter("_d IS NOT NULL").groupBy("_d", "_n").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("_first"), F.count("*").alias("_c")).filter("_c > 1 AND _first IS NOT NULL")
    copies = copies.select(F.col("_d").alias("_cd"), F.col("_n").alias("_cn"), "_first")
    joined = p.join(copies, (p["_d"] == copies["_cd"]) & (p["_n"] == copies["_cn"]), "left")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("_first.page_id")), F.col("_first"))
    return joined.select("page_id", "url", "html", "row", first["page_id"].alias("refers_to"), first["row"].alias("refers_row"))


def _head(kind: str, own: str, url, block: int, digest: str, more: list[str]) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", *more, f"Content-Length: {block}"]
    return "\r\n".join([*lines, "", ""]).encode()


def write(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes the records of pages; returns the manifest (path, records, bytes)."""
    spark = pages.sparkSession
    ship(spark)
    folder = shared_dir(spark, "warc")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        name = f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.warc.gz"
        files, path = store(name)
        out, records, size = None, 0, 0
        for batch in batches:
            ids, urls, html, numbers, refers, refers_rows = batch.columns
            for i in range(batch.num_rows):
                if out is None:
                    files.create_dir(path.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(f"{path}.open", compression=None)
                payload = memoryview(html[i].as_buffer())
                parts = [payload[a : a + CHUNK] for a in range(0, len(payload), CHUNK)]
                sha = hashlib.sha1()
                for x in parts:
                    sha.update(x)
                digest = base64.b32encode(sha.digest()).decode()
                own, url, first = record_id(ids[i].as_py(), numbers[i].as_py()), urls[i].as_py(), refers[i].as_py()
                if first is None:
                    head, body = _head("response", own, url, len(HTTP) + len(payload), digest, []), parts
                else:
                    more = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, refers_rows[i].as_py())}", f"X-Payload-Length: {len(payload)}"]
                    head, body = _head("revisit", own, url, len(HTTP), digest, more), []
                member = zlib.compressobj(1, zlib.DEFLATED, 31)
                for x in (head, HTTP, *body, b"\r\n\r\n"):
                    out.write(member.compress(x))
                    size += len(x)
                out.write(member.flush())
                records += 1
        if out is not None:
            out.close()
            files.move(f"{path}.open", path)
            yield pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return materialise(assign(pages, least).mapInArrow(run, "path string, records bigint, bytes bigint"), "warc-manifest")


class Inflated:
    """The bytes of a stream of gzip members, a bounded number at a time."""

    def __init__(self, stream):
        self.stream, self.member, self.held = stream, zlib.decompressobj(31), b""

    def read(self, n: int) -> bytes:
        while True:
            if self.member.eof:
                self.held, self.member = self.member.unused_data, zlib.decompressobj(31)
            if not self.held and not (more := self.stream.read(BLOCK)):
                return b""
            out = self.member.decompress(self.held or more, n)
            self.held = b"" if self.member.eof else self.member.unconsumed_tail
            if out:
                return out


class Reader:
    """Pulls lines and bytes from a stream, a block at a time."""

    def __init__(self, stream):
        self.stream, self.buffer, self.at = stream, b"", 0

    def fill(self) -> bool:
        more = self.stream.read(BLOCK)
        self.buffer, self.at = self.buffer[self.at :] + more, 0
        return bool(more)

    def line(self) -> bytes | None:
        while (end := self.buffer.find(b"\r\n", self.at)) < 0:
            if not self.fill():
                return None
        line, self.at = self.buffer[self.at : end], end + 2
        return line

    def take(self, n: int):
        """The next n bytes in pieces."""
        while n:
            if self.at == len(self.buffer) and not self.fill():
                raise ValueError("the archive ends within a record")
            piece = self.buffer[self.at : self.at + n]
            self.at += len(piece)
            n -= len(piece)
            yield piece


def records(stream):
    """(headers, chunks) of each record; chunks is to be used up before the next record. Only the payload is in chunks."""
    reader = Reader(stream)
    while (line := reader.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        head = {}
        while line := reader.line():
            key, _, value = line.partition(b":")
            head[key.decode().lower()] = value.strip().decode()

        def payload(left=int(head["content-length"])):
            line = None
            while line != b"" and left:  # the HTTP head
                line = reader.line()
                left -= len(line) + 2
            gathered = bytearray()
            for piece in reader.take(left):
                gathered += piece
                while len(gathered) >= CHUNK:
                    yield bytes(gathered[:CHUNK])
                    del gathered[:CHUNK]
            if gathered:
                yield bytes(gathered)

        yield head, payload()


SCHEMA = "record_id string, chunk_no int, data binary, record_type string, page_id bigint, target_uri string, refers_to bigint, bytes_so_far bigint, sha1_so_far string, last boolean, payload_bytes bigint, payload_digest string"


def read_chunks(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk rows of the archives in manifest.path. payload_bytes and payload_digest are those of the full payload, set
    on last chunks only: for responses as measured, for revisits as the record says. with_data=False leaves data null."""
    spark: SparkSession = manifest.sparkSession
    ship(spark)

    def rows(path: str):
        files, local = store(path)
        with files.open_input_stream(local, compression=None) as stream:
            for head, chunks in records(Inflated(stream)):
                own, kind = head["warc-record-id"], head["warc-type"]
                refers = page_of(head["warc-refers-to"]) if "warc-refers-to" in head else None
                fixed = (kind, page_of(own), head.get("warc-target-uri"), refers)
                sha, size, no, held = hashlib.sha1(), 0, 0, b""
                for chunk in chunks:
                    if no:  # one chunk is held back, as only the last is marked
                        yield (own, no - 1, held, *fixed, size, sha.hexdigest(), False, None, None)
                    held, size, no = chunk, size + len(chunk), no + 1
                    sha.update(chunk)
                said = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
                if kind == "response" and said != sha.hexdigest():
                    raise ValueError(f"{own} in {path}: the payload doesn't have its digest")
                full = int(head["x-payload-length"]) if kind == "revisit" else size
                yield (own, max(no - 1, 0), held, *fixed, size, sha.hexdigest(), True, full, said)

    def run(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])

        def batch(found):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

        for b in batches:
            for path in b.column(0).to_pylist():
                found, size = [], 0
                for row in rows(path):
                    found.append(row if with_data else (*row[:2], None, *row[3:]))
                    size += 200 + (len(row[2]) if with_data else 0)
                    if size >= BATCH_BYTES:
                        yield batch(found)
                        found, size = [], 0
                if found:
                    yield batch(found)

    paths = manifest.select("path")
    return paths.repartition(max(1, min(paths.count(), 10_000)), "path").mapInArrow(run, SCHEMA)


def stored(pages: DataFrame) -> DataFrame:
    """Writes pages and reads the archives back: one row per page."""
    chunks = read_chunks(write(pages), with_data=False)
    return chunks.filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
c AS (SELECT html, max(page_id) AS first FROM p WHERE strlen(html) >= {LEAST} GROUP BY html HAVING count(*) > 1)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN c ON p.html = c.html
"""
