"""WARC archives: a writer with revisit records, and a reader that splits archives at any byte.

Each record is a gzip member of its own. A reading task owns the records that start in its byte range: it scans for the
gzip magic, accepts a candidate only if the member decodes and begins with a WARC version line, and from there goes from
member to member, past the end of its range where a record crosses it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import FEW, Scratch

MAGIC = b"\x1f\x8b\x08"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """A response record, or a revisit of the page ``refers_to``; as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2020-01-01T00:00:00Z"]
    if url:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(raw: bytes) -> dict:
    """Fields of a decoded record. A revisit's payload length is its HTTP header's, as the payload is elsewhere."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    number = lambda x: int(t) if (t := x.removeprefix("<urn:page:").removesuffix(">")) else None
    kind = fields["warc-type"]
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest(payload) != stated):
        raise ValueError(f"record {fields['warc-record-id']}: payload and digest differ")
    return {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None, "payload_bytes": length, "payload_digest": stated, "record_type": kind, "refers_to": number(fields["warc-refers-to"]) if kind == "revisit" else None}


def filesystem(root: str):
    """(file system, path) of a URI; Hadoop's names of object stores are those of pyarrow's with a letter more."""
    return pfs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", root))


def _write_map(root: str, limit: int):
    def run(batches):
        fs, base = filesystem(root)
        fs.create_dir(base, recursive=True)
        out, name, size, done = None, None, 0, []
        try:
            for batch in batches:
                for page, url, text, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                    if out is None:  # a name for each attempt: a task that runs again leaves no half-written file in use
                        name, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(name, compression=None)  # members are compressed already
                    raw = record(page, url, (text or "").encode("utf-8", "surrogatepass"), first)
                    out.write(raw)
                    size += len(raw)
                    if size >= limit:
                        out.close()
                        done.append((name, size))
                        out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append((name, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "bytes"])

    return run


def write(spark: SparkSession, pages: DataFrame, root: str, scratch: Scratch, least: int = 0, limit: int = 256 << 20) -> DataFrame:
    """Archives under ``root`` (a URI that pyarrow's file systems know, on storage all executors share); (path, bytes).

    Of rows with equal payloads of at least ``least`` bytes the one with the smallest page_id is a response, the others
    revisit it; rows that repeat that page_id and payload are responses as well. Null html is an empty payload; null
    page_ids are written without a number, rank last, and are only revisited if no row has one."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = rows.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    # payloads that occur twice are a written table: a broadcast where they are few, so that no html is shuffled; else the join
    # is of two shuffled sides, of which Spark splits partitions that a hot payload makes large
    many = scratch.cut(rows.where(size >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1 and first is not null").select("digest", "first"))
    few = many.count() <= FEW // 4
    marked = rows.join(F.broadcast(many) if few else many, "digest", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    return scratch.cut(marked.mapInArrow(_write_map(root, limit), "path string, bytes long"))


def members(fs, path: str, start: int, end: int, chunk: int = 1 << 20):
    """Decoded records whose gzip member starts in [start, end) of an archive."""
    with fs.open_input_file(path) as f:
        total = f.size()
        buf, base = b"", start  # buf holds the bytes from base on
        at, sure = start, start == 0
        while at < min(end, total):
            # the next candidate
            while True:
                i = buf.find(MAGIC, at - base) if at >= base and at - base < len(buf) else -1
                if i >= 0:
                    break
                keep = max(at, base + len(buf) - 2) if len(buf) else at
                f.seek(base + len(buf))
                more = f.read(chunk)
                buf, base = buf[keep - base :] + more, keep
                at = keep
                if not more or base >= end:
                    return
            at = base + i
            if at >= end:
                return
            unpack, out, pos, ok = zlib.decompressobj(31), [], i, True
            try:
                while not unpack.eof:
                    if pos >= len(buf):
                        f.seek(base + len(buf))
                        more = f.read(chunk)
                        if not more:
                            ok = False
                            break
                        buf += more
                    part = unpack.decompress(buf[pos : pos + chunk])
                    pos += len(buf[pos : pos + chunk])
                    out.append(part)
                    if len(out) == 1 and len(part) >= 5 and not part.startswith(b"WARC/"):
                        ok = False
                        break
            except zlib.error:
                ok = False
            raw = b"".join(out) if ok else b""
            if not ok or not raw.startswith(b"WARC/"):
                at += 1  # magic bytes inside other data
                continue
            yield raw
            at = base + pos - len(unpack.unused_data)
            buf, base = buf[at - base :], at


def _read_map(root: str):
    def run(batches):
        fs, _ = filesystem(root)
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
        emit = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))
        for batch in batches:
            rows, size = [], 0
            for path, a, b in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
                for raw in members(fs, path, a, b):
                    rows.append(parse(raw))
                    size += len(raw)
                    if size > 4 << 20:
                        yield emit(rows)
                        rows, size = [], 0
            if rows:
                yield emit(rows)

    return run


def read(spark: SparkSession, archives: DataFrame, root: str, split: int = 4 << 20) -> DataFrame:
    """The records of ``archives(path, bytes)``: page_id, url, payload (null for revisits), payload_bytes,
    payload_digest, record_type, refers_to. Each range of ``split`` bytes is a row that any task may take."""
    ranges = archives.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("bytes", F.lit(1)) - 1, F.lit(split).cast("long"))).alias("start")).withColumn("end", F.col("start") + split)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(tasks, "path", "start").mapInArrow(_read_map(root), "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    root = scratch.path()
    archives = write(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), root, scratch)
    return read(spark, archives, root).drop("payload", "url")
