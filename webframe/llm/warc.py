"""WARC archives: writing, normalising of whole-file gzip, and reading by an offset index.

`write_archives` writes records as Spark's text writer does, each file one gzip stream: the form in which
many archives are found, and which allows no access to single records. `normalise` inflates such a stream
once, from start to end, rewrites every record as a gzip member of its own and writes beside the archive a
sidecar with one line of JSON per record: offset, length, type and headers. `read_records` reads single
members by these offsets.

Payloads of `least` bytes or more that are equal are stored once: the record with the largest id is a
response, the others revisit it. Rows that repeat the id and payload of a response are responses too; a
null id is never the largest, and if a group has no id all its records are responses. Null payloads count
as empty, line breaks in urls are percent-encoded, null urls are empty. Only the id, url and payload are
read. A stream that ends within a record, or bytes that are no record, give an index line of type
`damaged` without a member, and the records before them stay.

Archive files are written by tasks to names of their own and then renamed, so a task that runs again
replaces what it wrote. The folder can be any that Arrow's file systems reach by its address, as executors
share it."""

from __future__ import annotations

import json
import posixpath
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.llm.shared import shuffle_partitions, stored

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
INDEX = (
    "file string, offset long, length long, record_type string, record_id string, target_uri string, "
    "refers_to string, payload_digest string, payload_bytes long"
)
STEP = 1 << 20


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:webframe:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def page_of(id_text: Column) -> Column:
    return F.regexp_extract(id_text, r"^<urn:webframe:page:(-?[0-9]+)>$", 1).try_cast("long")


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000) -> DataFrame:
    """page_id, record_type, refers_to and record, the record's text with its last line feed left off."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload"), "same": F.unhex(F.sha2("payload", 256))})
    large = rows.filter(F.col("size") >= least)
    groups = large.groupBy("same").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1 and top is not null")
    chosen = rows.join(stored(groups.select("same", "top"), "payload-groups"), "same", "left")
    revisit = F.col("top").isNotNull() & (F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("top"))
    kind = F.when(revisit, "revisit").otherwise("response")
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    size = F.col("size").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF * 2))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    profile = f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("kind"),
        F.lit(f"{CRLF}WARC-Record-ID: "), record_id(F.col("page_id")),
        F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), uri,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.sha1(F.col("payload").cast("binary")), F.lit(CRLF),
        F.when(revisit, F.concat(F.lit(profile), record_id(F.col("top")), F.lit(CRLF))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "),
        F.octet_length("block").cast("string"), F.lit(CRLF * 2), F.col("block"), F.lit(CRLF + "\r"),
    )
    made = chosen.withColumn("kind", kind).withColumn("block", block)
    return made.select("page_id", F.col("kind").alias("record_type"), F.when(revisit, F.col("top")).alias("refers_to"), head.alias("record"))


def write_archives(made: DataFrame, folder: str, per_file: int = 10_000) -> None:
    """Records as files of one gzip stream each. The writer ends every row with the record's last line feed."""
    made.select("record").write.option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


class _Records:
    """Cuts a stream of inflated bytes into records. The buffer holds one record and what came with it."""

    def __init__(self):
        self.buffer = bytearray()
        self.at = 0
        self.bad = False

    def feed(self, data: bytes):
        """Whole records (bytes, headers, where the block starts) as far as they have come."""
        if self.bad:
            return
        if self.at > STEP:
            del self.buffer[: self.at]
            self.at = 0
        self.buffer += data
        while True:
            head = self.buffer.find(b"\r\n\r\n", self.at)
            if head < 0:
                return
            headers = parse_headers(bytes(self.buffer[self.at : head]))
            size = headers.get("content-length", "")
            if not headers.get("", "").startswith("WARC/") or not size.isdigit():
                self.bad = True
                return
            end = head + 4 + int(size) + 4
            if len(self.buffer) < end:
                return
            yield bytes(self.buffer[self.at : end]), headers, head + 4 - self.at
            self.at = end

    def rest(self) -> int:
        return len(self.buffer) - self.at


def parse_headers(head: bytes) -> dict[str, str]:
    """Names in lower case; the first line under the empty name."""
    lines = head.decode("utf-8", "replace").split(CRLF)
    pairs = (line.partition(":") for line in lines[1:])
    return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in pairs}


def _described(headers: dict[str, str], block: bytes) -> dict:
    size = None
    head, _, payload = block.partition(CRLF.encode() * 2)
    if head.startswith(b"HTTP/"):
        given = parse_headers(head).get("content-length", "")
        size = int(given) if given.isdigit() else len(payload)
    return {
        "record_type": headers.get("warc-type", ""),
        "record_id": headers.get("warc-record-id", ""),
        "target_uri": headers.get("warc-target-uri", ""),
        "refers_to": headers.get("warc-refers-to"),
        "payload_digest": headers.get("warc-payload-digest"),
        "payload_bytes": size,
    }


def inflated(content: memoryview):
    """The bytes of one gzip stream or several, a piece at a time; stops where the stream is broken."""
    unzip = zlib.decompressobj(31)
    for at in range(0, len(content), STEP):
        data = bytes(content[at : at + STEP])
        while data:
            try:
                piece = unzip.decompress(data, STEP)
            except zlib.error:
                return
            if piece:
                yield piece
            if unzip.eof:
                data, unzip = unzip.unused_data, zlib.decompressobj(31)
            else:
                data = unzip.unconsumed_tail


def rewritten(content: memoryview, out, file: str):
    """Write each record of a gzip stream as a member of its own to `out`; yield the index entries."""
    cut, offset = _Records(), 0
    for piece in inflated(content):
        for raw, headers, start in cut.feed(piece):
            zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = zipper.compress(raw) + zipper.flush()
            out.write(member)
            yield {"file": file, "offset": offset, "length": len(member), **_described(headers, raw[start:-4])}
            offset += len(member)
    if cut.rest():
        yield {"file": file, "offset": None, "length": cut.rest(), "record_type": "damaged"}


def normalise(spark: SparkSession, source: str, folder: str, pattern: str = "*.gz") -> int:
    """Rewrite the archives in `source` to `folder`, with sidecars; the number of records."""
    pafs.FileSystem.from_uri(folder)[0].create_dir(pafs.FileSystem.from_uri(folder)[1], recursive=True)
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(source)

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                name = re.sub(r"(\.txt|\.warc)?\.gz$", "", posixpath.basename(path)) + ".warc.gz"
                own = posixpath.join(base, f".{name}.{uuid.uuid4().hex}")
                entries = []
                with fs.open_output_stream(own, compression=None) as out:
                    for entry in rewritten(memoryview(content.as_buffer()), out, name):
                        entries.append(json.dumps(entry, ensure_ascii=False))
                with fs.open_output_stream(own + ".idx", compression=None) as out:
                    out.write("".join(e + "\n" for e in entries).encode())
                fs.move(own, posixpath.join(base, name))
                fs.move(own + ".idx", posixpath.join(base, name + ".idx"))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(entries)], pa.int64())], ["file", "records"])

    done = found.select("path", "content").mapInArrow(run, "file string, records long")
    return done.agg(F.sum("records")).first()[0] or 0


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.idx").json(folder)


def read_records(index: DataFrame, folder: str, chunk: int = 8 << 20) -> DataFrame:
    """The index entries with `payload`, the bytes after the HTTP headers. Entries of one stretch of a file are read
    by one task, in order; stretches are spread over all tasks."""
    spark = index.sparkSession
    there = index.filter("record_type != 'damaged'").withColumn("stretch", F.col("offset") / F.lit(chunk) - F.pmod("offset", F.lit(chunk)) / F.lit(chunk))
    dealt = there.repartition(shuffle_partitions(spark), "file", "stretch").sortWithinPartitions("file", "offset").drop("stretch")
    columns = dealt.columns

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            held, payloads, at = 0, [], 0
            source, name = None, None
            for i, (file, offset, length) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")))):
                if file != name:
                    name, source = file, fs.open_input_file(posixpath.join(base, file))
                source.seek(offset)
                raw = zlib.decompress(source.read(length), 31)
                block = raw[raw.find(b"\r\n\r\n") + 4 : -4]
                payloads.append(block.partition(b"\r\n\r\n")[2])
                held += len(payloads[-1])
                if held > chunk:
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, i + 1 - at).columns, pa.array(payloads, pa.binary())], [*columns, "payload"])
                    held, payloads, at = 0, [], i + 1
            if payloads:
                yield pa.RecordBatch.from_arrays([*batch.slice(at).columns, pa.array(payloads, pa.binary())], [*columns, "payload"])

    return dealt.mapInArrow(run, INDEX + ", payload binary")
