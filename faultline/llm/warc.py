"""WARC archives: a writer that stores equal payloads once, and a reader that salvages.

Archives are written by Spark's text writer, whose line separator is the blank line that ends a
record, so they appear whole or not at all on any file system Spark knows.  The reader takes the
bytes of an archive, plain or gzip members; where a check fails it searches for the next version
line or member, goes on there, and reports the bytes between as a quarantined gap.

Defined cases: null html is an empty payload; a null page id is written without that header and
reads as null; among equal payloads rows that share the smallest id are all responses; line breaks
in a url become spaces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.llm.frames import maybe_in, table
from faultline.scale import cut_lineage, ensure_checkpoint_dir

CRLF = "\r\n"
END = b"\r\n\r\n"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
LEAST_SHARED = 100
#: Records per archive file, so that no file outgrows a task's memory.
FILE_RECORDS = 2_000
READ = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, url string, offset long, gap_start long, gap_end long")


def records(pages: DataFrame) -> DataFrame:
    """One column `value`: the text of each record up to its closing blank line."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
                        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")),
                                         r"[\r\n]+", " ").alias("url"))
    size = F.octet_length("html").cast("long")
    keyed = rows.withColumn("_digest", F.sha2("html", 256)).withColumn("_bytes", size)
    first = (keyed.where(F.col("_bytes") >= LEAST_SHARED).groupBy("_digest")
             .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
             .select(F.col("_digest").alias("_shared"), "_first"))
    first = cut_lineage(first)
    # payloads that occur once go straight to their archive; only the others are shuffled
    flagged = maybe_in(keyed, "_digest", first.select(F.col("_shared").alias("_digest")), "_maybe")
    met = flagged.where("_maybe").join(first, F.col("_digest") == F.col("_shared"), "left").unionByName(
        flagged.where("NOT _maybe"), allowMissingColumns=True)
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("_first")) & F.col("_first").isNotNull(),
                       F.lit(False))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))

    def record_id(page, digest):
        named = F.md5(F.concat_ws("|", page.cast("string"), digest))
        return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(
            named, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", r"$1-$2-$3-$4-$5"), F.lit(">"))

    empty = F.lit("")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("_digest"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.col("url")),
        F.coalesce(line("WARC-Page-ID", F.col("page_id")), empty),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))),
        line("WARC-Payload-Length", F.col("_bytes")),
        F.when(again, F.concat(
            line("WARC-Profile",
                 F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", record_id(F.col("_first"), F.col("_digest"))),
            line("WARC-Refers-To-Page", F.col("_first")))).otherwise(empty),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("_bytes"))),
        F.lit(CRLF))
    return met.select(F.concat(head, F.when(again, empty).otherwise(F.col("html"))).alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """Archives of at most FILE_RECORDS records under `path`."""
    (records(pages).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", FILE_RECORDS)
     .mode("overwrite").text(path))


def _members(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, bytes) of the readable parts: gzip members, or everything that is plain."""
    at, n, plain = 0, len(raw), 0
    if not raw.startswith(MEMBER) and MEMBER not in raw:
        yield 0, n, raw
        return
    while at < n:
        found = raw.find(MEMBER, at)
        if found < 0:
            break
        reader = zlib.decompressobj(31)
        try:
            body = reader.decompress(raw[found:])
            good = reader.eof
        except zlib.error:
            good = False
        if good and VERSION.match(body):
            if found > plain:
                yield plain, found, raw[plain:found]
            end = n - len(reader.unused_data)
            yield found, end, body
            at = plain = end
        else:
            at = found + 1
    if plain < n:
        yield plain, n, raw[plain:]


def _record(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, payload and end of the record at `at`, if all its checks hold."""
    if not VERSION.match(raw, at):
        return None
    stop = raw.find(END, at)
    if stop < 0:
        return None
    headers = {}
    for line in raw[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isdigit():
        return None
    body = stop + 4
    end = body + int(length)
    if raw[end:end + 4] != END:
        return None
    payload = raw[body:end]
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    kind = headers.get("warc-type")
    if kind == "response" and digest and hashlib.sha256(payload).hexdigest() != digest:
        return None
    return headers, payload, end + 4


def salvage(raw: bytes) -> Iterator[tuple]:
    """(headers, payload, start, end) of sound records; (None, b"", start, end) of gaps."""
    for start, end, part in _members(raw):
        packed = part is not raw and raw[start:start + 3] == MEMBER
        at = lost = 0
        while at < len(part):
            got = _record(part, at)
            if got:
                if at > lost:
                    yield None, b"", start + (0 if packed else lost), end if packed else start + at
                yield got[0], got[1], start + (0 if packed else at), end if packed else start + got[2]
                at = lost = got[2]
            else:
                nxt = VERSION.search(part, at + 1)
                at = nxt.start() if nxt else len(part)
        if lost < len(part):
            yield None, b"", start + (0 if packed else lost), end


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per sound record, and a row with gap_start and gap_end per quarantined gap."""

    def number(text: str | None) -> int | None:
        return int(text) if text and text.lstrip("-").isdigit() else None

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                rows = []
                for headers, payload, start, end in salvage(raw.as_py()):
                    if headers is None:
                        rows.append((None, None, None, None, None, None, start, start, end))
                        continue
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
                    size = number(headers.get("warc-payload-length"))
                    rows.append((number(headers.get("warc-page-id")),
                                 len(payload) if headers.get("warc-type") == "response" else size,
                                 digest, headers.get("warc-type"),
                                 number(headers.get("warc-refers-to-page")),
                                 headers.get("warc-target-uri"), start, None, None))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(),
                         pa.int64(), pa.int64(), pa.int64()]
                cols = list(zip(*rows)) or [()] * 9
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds)],
                    [f.split()[0] for f in READ.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, READ)


def archive_path(spark: SparkSession) -> str:
    """A new folder in the shared place for checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"


def op5_salvaged_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = archive_path(spark)
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).where("gap_start IS NULL").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
