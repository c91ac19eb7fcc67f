"""Web archives in ZIP packages: written from pages, read back by record ranges.

A package stores, uncompressed as ZIP members, an archive of one gzip member a WARC
record and an index of one line a record with its page id, offset and length. The reader
parses the package's directories, locates the archive and the index, and reads each
record by its range.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, open_store, write_once
from .zipread import Package

#: Payloads of at least so many bytes can be revisits.
MIN_REVISIT = 0
#: A package is closed at about so many bytes, and read in runs of about so many records.
PACKAGE_BYTES = 32_000_000
RUN_RECORDS = 2_000
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
_TIME = "2026-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC/1.1 record. A revisit names its response and has no payload of its own, just the payload's length and digest."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_TIME}",
        "WARC-Target-URI: " + "".join((url or "about:blank").split()),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, payload) of one record; raises ValueError if its lengths or its digest are wrong."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    payload = rest[:n].partition(b"\r\n\r\n")[2]
    if fields["warc-type"] == "response" and "sha1:" + digest(payload) != fields["warc-payload-digest"]:
        raise ValueError("the payload's digest is wrong")
    return fields, payload


def with_references(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload and refers_to: of equal payloads the smallest page_id is the response, null for itself.

    A null html is an empty payload. Rows that repeat a page_id and its payload are one
    response each; rows with a null page_id count after all others and are responses
    where only such rows share a payload. Only digests and ids are joined by payload;
    the html moves once.
    """
    t = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    t = t.withColumn("key", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))
    ids = t.filter(F.col("n") >= min_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).filter("rows > 1").select(F.col("key").alias("its_key"), "first")
    # Keys of payloads that occur once aren't in ``ids``; keys are joined to ids first, so that a hot payload's html isn't what is dealt by key.
    named = t.select("page_id", "key").distinct().join(ids, F.col("key") == F.col("its_key")).select(F.col("page_id").alias("its_page"), F.col("key").alias("its_key"), "first")
    joined = t.join(named, t["page_id"].eqNullSafe(named["its_page"]) & (t["key"] == named["its_key"]), "left")
    own = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    return joined.select("page_id", "url", "payload", F.when(own, F.col("first")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT, package_bytes: int = PACKAGE_BYTES) -> list[dict]:
    """Write ``pages`` (page_id, url, html) as packages in ``folder``; their list of path and records.

    A task that is repeated writes the same packages again and renames them into place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), []
        archive, index = io.BytesIO(), []

        def close() -> None:
            nonlocal archive, index
            if not index:
                return
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                for name, data in ((ARCHIVE, archive.getvalue()), (INDEX, "\n".join(index).encode())):
                    z.writestr(zipfile.ZipInfo(name), data)
            path = f"{folder}/pages-{task:06d}-{len(made):04d}.zip"
            write_once(path, [out.getbuffer()])
            made.append({"path": path, "records": len(index)})
            archive, index = io.BytesIO(), []

        for batch in batches:
            for r in batch.to_pylist():
                packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                data = packer.compress(record(r["page_id"], r["url"], r["payload"], r["refers_to"])) + packer.flush()
                index.append(json.dumps({"page_id": r["page_id"], "offset": archive.tell(), "length": len(data)}))
                archive.write(data)
                if archive.tell() > package_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    written = with_references(pages, min_bytes).mapInArrow(run, "path string, records long").collect()  # a row a package
    return sorted((r.asDict() for r in written), key=lambda r: r["path"])


def open_package(uri: str) -> Package:
    store, path = open_store(uri)
    f = store.open_input_file(path)

    def read_at(offset: int, length: int) -> bytes:
        f.seek(offset)
        return f.read(length)

    return Package(read_at, f.size())


def read_packages(spark: SparkSession, packages: list[dict], run_records: int = RUN_RECORDS) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and html of every record.

    A task takes runs of a package's records; each record is read by the range that the index gives.
    """
    runs = [(p["path"], a, min(a + run_records, p["records"])) for p in packages for a in range(0, p["records"], run_records)]
    plan = spark.createDataFrame(runs, "path string, first long, last long")
    if runs:
        plan = plan.repartition(min(len(runs), 4 * spark.sparkContext.defaultParallelism))

    def page(urn: str | None) -> int | None:
        text = (urn or "").strip("<>").rpartition(":")[2]
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                package = open_package(r["path"])
                start = package.data_start(ARCHIVE)
                out = []
                for line in package.read(INDEX).decode().split("\n")[r["first"] : r["last"]]:
                    at = json.loads(line)
                    fields, payload = parse(zlib.decompress(package.read(ARCHIVE, at["offset"], at["length"], start), 31))
                    response = fields["warc-type"] == "response"
                    out.append(
                        {
                            "page_id": page(fields["warc-record-id"]),
                            "url": fields["warc-target-uri"],
                            "record_type": fields["warc-type"],
                            "refers_to": page(fields.get("warc-refers-to")),
                            "payload_bytes": len(payload) if response else int(fields["x-payload-length"]),
                            "payload_digest": fields["warc-payload-digest"].partition(":")[2],
                            "html": payload.decode() if response else None,
                        }
                    )
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("html", pa.string())])
    return plan.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string")


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to packages in the shared folder and read all records back, without their html.

    A null html is an empty payload, a null url ``about:blank``. Of equal payloads the
    least page_id is the response; rows that repeat it and its payload are responses too,
    and null page_ids stay null. An empty table writes no package and gives no rows; other
    columns are ignored.
    """
    spark = pages.sparkSession
    return read_packages(spark, write_packages(pages, new_path(spark, "warc"))).drop("html")
