"""WARC archives with the index first.

Writing yields one index row per record: file, offset, length, URL and payload
digest, so that reading starts from the index: the selected records are sorted
by file and offset, neighbouring byte ranges are coalesced into one read, and
each record is cut out of it. Records are compressed one by one (.warc.gz), as
the format asks for. Payloads that occur again are written once, as a response;
the other pages get revisit records that name it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_facts, materialize, numbered, shared_folder

#: a read ends where the next range begins more than GAP bytes on, or at MOST
GAP = 64 * 1024
MOST = 8 * 1024 * 1024
#: size at which a task begins another file
FILE_BYTES = 256 * 1024 * 1024

INDEX = ("row_key long, page_id {0}, url string, file string, offset long, length long, digest string, "
         "payload_bytes long, record_type string, refers_to {0}")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def warc_record(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One gzip member. A revisit has no block; it names the response's page."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{url}:{digest}")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_one_line(url)}",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    block = b""
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"X-Refers-To-Page-ID: {refers_to}", f"X-Payload-Length: {len(payload)}"]
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) \
            + payload
        head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and HTTP payload of one compressed record."""
    raw = gzip.decompress(data)
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    head = {k.lower(): v for k, v in head.items()}
    block = rest[:int(head["content-length"])]
    return head, block.partition(b"\r\n\r\n")[2]


def _opened(folder: str):
    """File system and path of a folder on any store that the workers reach."""
    from pyarrow import fs
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write one record per row of ``pages`` into ``folder`` (new, below the
    shared checkpoint folder, if not given) and return the index, written as
    Parquet beside the archives: row_key, page_id, url, file, offset, length,
    digest, payload_bytes, record_type, refers_to.

    Of equal payloads of at least ``min_revisit_bytes`` bytes the row with the
    largest id is the response (null ids come first; of rows that repeat an id,
    one), the others revisit it; smaller payloads are all responses. A null
    payload is empty. An empty table gives no records. Other columns are
    ignored. A task that runs again writes new files; the index names only
    those of the attempt that Spark committed."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    id_type = pages.schema[id_col].dataType.simpleString()
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    scan = numbered(pages, page_id=F.col(id_col), url=F.col(url_col), payload=payload)
    keys = materialize(scan.select("row_key", "page_id", F.octet_length("payload").cast("long").alias("bytes"),
                                   F.sha2("payload", 256).alias("key")), "warc-keys")
    total = keys.count()
    again = materialize(
        keys.filter(F.col("bytes") >= min_revisit_bytes).groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "row_key")).alias("top"))
        .filter("n > 1").select("key", "n", F.col("top.page_id").alias("top_id"), F.col("top.row_key").alias("top_key")),
        "warc-again")
    # which rows revisit what: narrow, and only rows whose payload occurs again
    revisits = materialize(
        attach_facts(keys, again, ["key"], "n", total).filter("top_key is not null and row_key != top_key")
        .select("row_key", F.col("top_id").alias("refers_to"), F.lit(True).alias("revisit")), "warc-revisits")
    rows = scan.join(revisits, "row_key", "left")

    def write(batches):
        files, base = _opened(folder)
        files.create_dir(base, recursive=True)
        out, name, at = None, None, 0
        try:
            for b in batches:
                col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
                index = []
                for i in range(b.num_rows):
                    body = col["payload"][i].as_py()
                    page, url, to = (col[n][i].as_py() for n in ("page_id", "url", "refers_to"))
                    kind = "revisit" if col["revisit"][i].as_py() else "response"
                    digest = digest32(body)
                    record = warc_record(kind, page, url, body, digest, to)
                    if out is None or at + len(record) > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(record)
                    index.append((col["row_key"][i].as_py(), page, url, name, at, len(record), digest, len(body), kind, to))
                    at += len(record)
                columns = list(zip(*index)) or [()] * 10
                types = [pa.int64(), b.schema.field("page_id").type, pa.string(), pa.string(), pa.int64(), pa.int64(),
                         pa.string(), pa.int64(), pa.string(), b.schema.field("page_id").type]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                                 names=[x.strip().split(" ")[0] for x in INDEX.split(",")])
        finally:
            if out is not None:
                out.close()

    index = rows.select("row_key", "page_id", "url", "payload", "refers_to", "revisit") \
        .mapInArrow(write, INDEX.format(id_type))
    path = f"{folder}/index"
    index.write.parquet(path)
    return spark.read.schema(index.schema).parquet(path)


def read_warc(index: DataFrame, folder: str, gap: int = GAP, most: int = MOST) -> DataFrame:
    """Read the records that ``index`` selects: one row per index row with
    row_key, record_type, page, digest, payload (null for revisits) and
    refers_to, all as found in the archive.

    The selection is sorted by file and offset; ranges at most ``gap`` bytes
    apart are fetched by one read of at most ``most`` bytes (a longer record
    is read alone)."""
    # a task gets whole stretches of a file in order; only index rows move
    session = index.sparkSession
    tasks = max((index.agg(F.sum("length")).first()[0] or 0) // (4 * most) + 1, session.sparkContext.defaultParallelism)
    picked = index.select("row_key", "file", "offset", "length") \
        .withColumn("stretch", F.expr(f"offset div {most}")) \
        .repartition(int(tasks), "file", "stretch").sortWithinPartitions("file", "offset")

    def read(batches):
        files, base = _opened(folder)
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
        names = ["row_key", "record_type", "page", "digest", "payload", "refers_to"]

        def fetch(name, wanted):
            start, stop = wanted[0][1], max(o + n for _, o, n in wanted)
            with files.open_input_file(f"{base}/{name}") as f:
                f.seek(start)
                data = f.read(stop - start)
            rows = []
            for key, o, n in wanted:
                head, payload = parse_record(data[o - start:o - start + n])
                kind = head["warc-type"]
                rows.append((key, kind, head["x-page-id"], head["warc-payload-digest"].removeprefix("sha1:"),
                             payload if kind == "response" else None, head.get("x-refers-to-page-id")))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        name, wanted = None, []
        for b in batches:
            for key, file, o, n in zip(*(b.column(i).to_pylist() for i in range(4))):
                if wanted and (file != name or o - (wanted[-1][1] + wanted[-1][2]) > gap or o + n - wanted[0][1] > most):
                    yield fetch(name, wanted)
                    wanted = []
                name = file
                wanted.append((key, o, n))
        if wanted:
            yield fetch(name, wanted)

    return picked.select("row_key", "file", "offset", "length").mapInArrow(
        read, "row_key long, record_type string, page string, digest string, payload binary, refers_to string")


def resolved(pages: DataFrame, total: int) -> DataFrame:
    """Digest and length of each record's full payload from the records read:
    a revisit takes them from the response with its digest. One row per
    record: row_key, page, payload_bytes, payload_digest, record_type,
    refers_to."""
    narrow = materialize(pages.select(
        "row_key", "page", "digest", "record_type", "refers_to",
        F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1")), "warc-read")
    known = materialize(narrow.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.max("bytes").alias("full_bytes"), F.max("sha1").alias("full_sha1")), "warc-full")
    return attach_facts(narrow, known, ["digest"], "n", total).select(
        "row_key", "page", F.col("full_bytes").alias("payload_bytes"), base32_of_hex(F.col("full_sha1")).alias("payload_digest"),
        "record_type", "refers_to")


def base32_of_hex(digits):
    """Base32 of a 40-digit hexadecimal string (eight groups of five digits)."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", alphabet)
